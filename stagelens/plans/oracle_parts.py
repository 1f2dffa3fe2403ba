"""Named SQL building blocks for the oracle statements (plain SQL, run by DuckDB)."""

from __future__ import annotations

# name -> (blocks it needs, SQL)
PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, sql: str, *needs: str) -> None:
    PARTS[name] = (needs, sql.strip())


def query(body: str, *needs: str) -> str:
    """Statement with the blocks it needs, in dependency order, as CTEs."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for dep in PARTS[name][0]:
            add(dep)
        order.append(name)

    for name in needs:
        add(name)
    ctes = ",\n".join(f"{n} AS (\n{PARTS[n][1]}\n)" for n in order)
    return (f"WITH {ctes}\n" if ctes else "") + body.strip()


def pct_avg(x: str, by: str) -> str:
    """Percentile rank, ties averaged, unknown values left out."""
    return (
        f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) "
        f"+ (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {by}) END"
    )


def pct_max(x: str, by: str) -> str:
    return (
        f"CASE WHEN {x} IS NOT NULL THEN cast(rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) "
        f"+ count(*) OVER (PARTITION BY {by}, {x}) - 1 AS double) / count({x}) OVER (PARTITION BY {by}) END"
    )


def clip_sql(x: str, lo: str, hi: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, {lo}), {hi}) END"


part("v_ticket", """
SELECT concat(cast(l_orderkey AS varchar), '-', cast(l_linenumber AS varchar)) AS ticket_no,
       l_orderkey AS performance_id, l_shipdate AS show_at,
       CASE WHEN l_returnflag = 'R' THEN 'cancel' ELSE 'booking' END AS event_type,
       cast(l_quantity AS bigint) AS quantity, cast(l_extendedprice AS decimal(18,2)) AS amount,
       l_partkey, l_suppkey, l_linenumber, l_linestatus AS channel, cast(round(l_tax * 100) AS int) AS payment, cast(round(l_discount * 100) AS int) AS discount
FROM lineitem""")

part("v_performance", """
SELECT o.o_orderkey AS performance_id, c.c_name AS title, n.n_name AS facility, r.r_name AS region,
       CASE WHEN o.o_custkey % 97 = 0 THEN NULL ELSE 8 + (o.o_custkey * 37) % 1500 END AS seats,
       o.o_orderkey % 14 - 1 AS access_score,
       CASE WHEN o.o_orderstatus = 'P' THEN 'composite' ELSE 'single' END AS kind,
       year(o.o_orderdate) AS yr
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""")

part("v_line_genre", """
SELECT performance_id, genre, rev, qty, cnt,
       row_number() OVER (PARTITION BY performance_id ORDER BY rev DESC, genre) AS rk_rev,
       row_number() OVER (PARTITION BY performance_id ORDER BY qty DESC, genre) AS rk_qty,
       row_number() OVER (PARTITION BY performance_id ORDER BY cnt DESC, genre) AS rk_cnt
FROM (SELECT t.performance_id, p.p_type AS genre, sum(t.amount) AS rev,
             cast(sum(t.quantity) AS bigint) AS qty, count(*) AS cnt
      FROM v_ticket t JOIN part p ON t.l_partkey = p.p_partkey
      GROUP BY t.performance_id, p.p_type) g""", "v_ticket")

part("v_label", """
SELECT performance_id, genre AS mid,
       CASE WHEN genre IN ('ECONOMY','STANDARD') THEN 'basic'
            WHEN genre IN ('PROMO','SMALL') THEN 'light' ELSE 'heavy' END AS broad
FROM v_line_genre WHERE rk_rev = 1""", "v_line_genre")

part("v_prediction", """
SELECT performance_id, run_id, max(CASE WHEN rk = 1 THEN genre END) AS genre1, max(CASE WHEN rk = 2 THEN genre END) AS genre2,
       max(CASE WHEN rk = 1 THEN p END) AS p1, max(CASE WHEN rk = 2 THEN p END) AS p2
FROM (SELECT performance_id, 1 AS run_id, genre, rk_rev AS rk,
             round(cast(rev AS double) / cast(sum(rev) OVER (PARTITION BY performance_id) AS double), 6) AS p FROM v_line_genre
      UNION ALL
      SELECT performance_id, 2, genre, rk_qty,
             round(cast(qty AS double) / cast(sum(qty) OVER (PARTITION BY performance_id) AS double), 6) FROM v_line_genre
      UNION ALL
      SELECT performance_id, 3, genre, rk_cnt,
             round(cast(cnt AS double) / cast(sum(cnt) OVER (PARTITION BY performance_id) AS double), 6) FROM v_line_genre) u
WHERE rk <= 2 GROUP BY performance_id, run_id""", "v_line_genre")

part("v_metrics", """
SELECT p.performance_id, p.title, p.facility, p.region, p.seats, p.kind, p.yr, p.access_score,
       s.sessions, s.sold, cast(s.revenue AS double) AS revenue,
       CASE WHEN p.seats IS NULL THEN NULL ELSE cast(s.sold AS double) / (s.sessions * p.seats) END AS occupancy,
       cast(s.sold AS double) / s.sessions AS avg_sold,
       CASE WHEN s.sold = 0 THEN NULL ELSE cast(s.revenue AS double) / s.sold END AS price,
       cast(s.revenue AS double) / s.sessions AS rev_per_session
FROM v_performance p JOIN (
  SELECT performance_id, count(DISTINCT show_at) AS sessions,
         cast(sum(CASE WHEN event_type = 'booking' THEN quantity ELSE -quantity END) AS bigint) AS sold,
         sum(CASE WHEN event_type = 'booking' THEN amount ELSE -amount END) AS revenue
  FROM v_ticket GROUP BY performance_id) s ON p.performance_id = s.performance_id""", "v_ticket", "v_performance")

part("v_occurrence", """
SELECT performance_id, role, name, count(*) AS times FROM (
  SELECT t.performance_id, 'cast' AS role, p.p_name AS name FROM v_ticket t JOIN part p ON t.l_partkey = p.p_partkey
  UNION ALL
  SELECT t.performance_id, 'crew', s.s_name FROM v_ticket t JOIN supplier s ON t.l_suppkey = s.s_suppkey
  UNION ALL
  SELECT t.performance_id, 'org', p.p_brand FROM v_ticket t JOIN part p ON t.l_partkey = p.p_partkey) u
GROUP BY performance_id, role, name""", "v_ticket")

part("v_cells", """
SELECT t.performance_id, t.l_linenumber, t.l_partkey, t.l_suppkey,
       concat(p.p_name, ' (', p.p_type, '), ', s.s_name, ' 등') AS cast_txt,
       concat(s.s_name, ',,', p.p_name, '외 ') AS crew_txt,
       concat(p.p_brand, '(', CASE t.l_linenumber % 3 WHEN 0 THEN 'host' WHEN 1 THEN 'producer' ELSE 'planner' END, '), ', s.s_name) AS org_txt
FROM v_ticket t JOIN part p ON t.l_partkey = p.p_partkey JOIN supplier s ON t.l_suppkey = s.s_suppkey""", "v_ticket")

# ---------------------------------------------------------------- scoring

part("iqr", """
SELECT m.* FROM v_metrics m JOIN (
  SELECT kind, quantile_cont(occupancy, 0.25) AS q1, quantile_cont(occupancy, 0.75) AS q3 FROM v_metrics GROUP BY kind) q
ON m.kind = q.kind
WHERE occupancy >= q1 - 1.5 * (q3 - q1) AND occupancy <= q3 + 1.5 * (q3 - q1)""", "v_metrics")

_FEATURES = """
SELECT m.*, {occ} AS f_occ, ln(1 + greatest(coalesce(sessions, 0), 0)) AS f_ses,
       ln(1 + greatest(coalesce(sold, 0), 0)) AS f_sold, avg_sold AS f_avg, price AS f_price, rev_per_session AS f_rev,
       least(greatest(coalesce(least(greatest(access_score, 0), 11), 0) / 11.0, 0), 1) AS f_acc
FROM {src} m"""

_F = ("occ", "ses", "sold", "avg", "price", "rev", "acc")


def _scored(variant: str, src: str, occ: str, guard: bool = False) -> None:
    v = variant + ("_guard" if guard else "")
    if not guard:
        part(f"feat_{v}", _FEATURES.format(occ=occ, src=src), src)
        bounds = ", ".join(
            f"quantile_cont(f_{f}, 0.05) AS lo_{f}, quantile_cont(f_{f}, 0.95) AS hi_{f}" for f in _F
        )
        clipped = ", ".join(clip_sql(f"f_{f}", f"lo_{f}", f"hi_{f}") + f" AS w_{f}" for f in _F)
        part(f"wins_{v}", f"""
SELECT f.*, {clipped} FROM feat_{v} f JOIN (SELECT kind, {bounds} FROM feat_{v} GROUP BY kind) b ON f.kind = b.kind
""", f"feat_{v}")
        ranks = ", ".join(pct_avg(f"w_{f}", "kind") + f" AS r_{f}" for f in _F)
        part(f"rank_{v}", f"""
SELECT w.*, {ranks}, {pct_max("f_price", "kind")} AS rx_price, {pct_max("f_rev", "kind")} AS rx_rev
FROM wins_{v} w""", f"wins_{v}")
        if variant == "as_run":
            afford = ("CASE WHEN rx_rev IS NOT NULL AND rx_price IS NOT NULL THEN "
                      "pow(greatest(rx_rev, 1e-9), 0.6) * pow(greatest(CASE WHEN rx_price < 0.5 THEN 0.5 ELSE 1 - rx_price END, 1e-9), 0.4) END")
        else:
            afford = "1 - r_price"
        part(f"usa_{v}", f"""
SELECT r.*, r_occ AS u, 0.5 * r_ses + 0.3 * r_sold + 0.2 * r_avg AS s, {afford} AS a,
       coalesce(price, 0) <= 0 OR coalesce(rev_per_session, 0) <= 0 AS is_free
FROM rank_{v} r""", f"rank_{v}")
    base = f"usa_{variant}"
    wu, ws, wa = {"as_run": (0.50, 0.30, 0.20), "as_reported": (0.45, 0.35, 0.20)}[variant]

    def g(x: str) -> str:
        return clip_sql(x, "1e-9", "1.0")

    plus = "core" if variant == "as_run" else "core * mult"
    if guard:
        plus += " * CASE WHEN NOT is_free AND r_rev < 0.20 THEN 0.95 ELSE 1.0 END"
    part(f"score_{v}", f"""
SELECT *, {plus} AS dpi FROM (
  SELECT x.*, CASE WHEN is_free THEN 'Free' ELSE 'Paid' END AS segment,
         CASE WHEN is_free THEN 100 * pow(pow({g('u')}, 0.6) * pow({g('s')}, 0.4), 1.0)
              ELSE 100 * pow(pow({g('u')}, {wu}) * pow({g('s')}, {ws}) * pow({g('a')}, {wa}), 1.0) END AS core,
         least(greatest(1 + 0.10 * (sqrt(r_acc) - avg(sqrt(r_acc)) OVER (PARTITION BY kind)), 0.90), 1.10) AS mult
  FROM {base} x) y""", base)


_scored("as_run", "iqr", "least(occupancy, 1.0)")
_scored("as_reported", "v_metrics", "occupancy")
_scored("as_reported", "v_metrics", "occupancy", guard=True)

GRID_SQL = ("SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {k}.0::double, {c}::double)"
    for i, (k, c) in enumerate((k, c) for k in (30, 60, 80, 100, 150) for c in (2.0, 3.0, 4.0, 5.0, 6.0))
) + ") g(cfg, k, cap)")


def _grid(v: str) -> None:
    part(f"gstat_{v}", f"""
SELECT kind, segment, region, count(*) AS n, avg(dpi) AS mu,
       (SELECT avg(dpi) FROM score_{v} z WHERE z.kind = s.kind AND z.segment = s.segment) AS grand
FROM score_{v} s GROUP BY kind, segment, region""", f"score_{v}")
    part("grid", GRID_SQL)
    part(f"gdelta_{v}", f"""
SELECT x.*, cfg, k, cap, greatest(least(n / (n + k) * (mu - grand), cap), -cap) AS delta
FROM gstat_{v} x CROSS JOIN grid""", f"gstat_{v}", "grid")
    part(f"gadj_{v}", f"""
SELECT s.performance_id, s.kind, s.segment, s.region, d.cfg, d.k, d.cap, s.dpi AS y, s.dpi - d.delta AS adj, abs(d.delta) AS dist
FROM score_{v} s JOIN gdelta_{v} d
ON s.kind = d.kind AND s.segment = d.segment AND s.region IS NOT DISTINCT FROM d.region
WHERE s.dpi IS NOT NULL""", f"score_{v}", f"gdelta_{v}")
    part(f"grankd_{v}", f"""
SELECT *, {pct_avg("y", "kind, segment, cfg")} AS ry, {pct_avg("adj", "kind, segment, cfg")} AS ra,
       avg(y) OVER (PARTITION BY kind, segment, cfg) AS my, avg(adj) OVER (PARTITION BY kind, segment, cfg) AS ma
FROM gadj_{v}""", f"gadj_{v}")
    part(f"gfig_{v}", f"""
SELECT a.kind, a.segment, a.cfg, a.k, a.cap, spearman, dist_p95, dist_mean_abs, cap_saturation,
       bpre / tpre AS eta_pre, bpost / tpost AS eta_post, sqrt(bpre / nn) AS rms_pre, sqrt(bpost / nn) AS rms_post
FROM (SELECT kind, segment, cfg, k, cap, corr(ry, ra) AS spearman, quantile_cont(dist, 0.95) AS dist_p95,
             avg(dist) AS dist_mean_abs, avg(CASE WHEN dist >= cap - 1e-12 THEN 1.0 ELSE 0.0 END) AS cap_saturation,
             sum((y - my) * (y - my)) AS tpre, sum((adj - ma) * (adj - ma)) AS tpost, count(*) AS nn
      FROM grankd_{v} GROUP BY ALL) a
JOIN (SELECT kind, segment, cfg, sum(n * (mu - m0) * (mu - m0)) AS bpre, sum(n * (mu2 - m1) * (mu2 - m1)) AS bpost FROM (
        SELECT kind, segment, cfg, region, count(*) AS n, avg(y) AS mu, avg(adj) AS mu2, min(my) AS m0, min(ma) AS m1
        FROM grankd_{v} GROUP BY ALL) q GROUP BY ALL) b
ON a.kind = b.kind AND a.segment = b.segment AND a.cfg = b.cfg""", f"grankd_{v}")

    def mm(x: str) -> str:
        w = "OVER (PARTITION BY kind, segment)"
        return f"({x} - min({x}) {w}) / (max({x}) {w} - min({x}) {w} + 1e-12)"

    part(f"gscore_{v}", f"""
SELECT *, row_number() OVER (PARTITION BY kind, segment ORDER BY round(score, 9), round(eta_post, 9), round(rms_post, 9), round(dist_p95, 9), cfg) AS place
FROM (SELECT *, 0.40 * {mm("eta_post")} + 0.30 * {mm("rms_post")} + 0.15 * {mm("dist_p95")} + 0.15 * {mm("(1 - spearman)")}
             + CASE WHEN spearman < 0.90 THEN 0.20 ELSE 0.0 END AS score FROM gfig_{v}) z""", f"gfig_{v}")
    part(f"scored_{v}", f"""
SELECT s.*, b.k, b.cap, d.delta, s.dpi - d.delta AS adj,
       CASE WHEN s.seats <= 300 THEN 'small' WHEN s.seats <= 1000 THEN 'medium' ELSE 'large' END AS size
FROM score_{v} s
JOIN gscore_{v} b ON s.kind = b.kind AND s.segment = b.segment AND b.place = 1
JOIN gdelta_{v} d ON s.kind = d.kind AND s.segment = d.segment AND d.cfg = b.cfg AND s.region IS NOT DISTINCT FROM d.region
""", f"score_{v}", f"gscore_{v}", f"gdelta_{v}")


for _v in ("as_run", "as_reported", "as_reported_guard"):
    _grid(_v)
