"""SQL of the queries on profiles, comparison, tests, improvement and checks."""

from __future__ import annotations

import re

from stagelens.plans.oracle_parts import part, query

ORACLE_COMPARE: dict[str, str] = {}
O = ORACLE_COMPARE

for _v in ("as_run", "as_reported"):
    part(f"events_{_v}", f"""
SELECT s.*, p.genre1, p.genre2, p.p1, p.p2, l.mid AS genre, l.broad
FROM scored_{_v} s
LEFT JOIN (SELECT * FROM v_prediction WHERE run_id = 1) p ON s.performance_id = p.performance_id
LEFT JOIN v_label l ON s.performance_id = l.performance_id""", f"scored_{_v}", "v_prediction", "v_label")
part("events_stored", """
SELECT s.* REPLACE (round(dpi, 1) AS dpi, round(u, 1) AS u, round(s, 1) AS s, round(a, 1) AS a), p.genre1, p.genre2, p.p1, p.p2, l.mid AS genre, l.broad
FROM scored_as_reported_guard s
LEFT JOIN (SELECT * FROM v_prediction WHERE run_id = 1) p ON s.performance_id = p.performance_id
LEFT JOIN v_label l ON s.performance_id = l.performance_id""", "scored_as_reported_guard", "v_prediction", "v_label")
for _v in ("as_run", "as_reported", "stored"):
    part(f"pairs_{_v}", f"""
SELECT *, CASE WHEN "DPI_A" IS NULL OR "DPI_B" IS NULL THEN 'undecidable'
               WHEN "DPI_AB" >= baseline THEN 'success' ELSE 'fail' END AS verdict
FROM (SELECT c.*, a.dpi AS "DPI_A", a.u AS "U_A", a.s AS "S_A", a.a AS "A_A", b.dpi AS "DPI_B", b.u AS "U_B", b.s AS "S_B", b.a AS "A_B",
             (a.dpi + b.dpi) / 2 AS baseline
      FROM (SELECT segment, size, least(genre1, genre2) || '+' || greatest(genre1, genre2) AS pair, least(genre1, genre2) AS "genre_A",
                   greatest(genre1, genre2) AS "genre_B", count(*) AS n, avg(dpi) AS "DPI_AB", avg(u) AS "U_AB", avg(s) AS "S_AB", avg(a) AS "A_AB"
            FROM events_{_v} WHERE kind = 'composite' AND genre1 IS NOT NULL AND genre2 IS NOT NULL GROUP BY ALL) c
      LEFT JOIN (SELECT segment, size, genre, avg(dpi) AS dpi, avg(u) AS u, avg(s) AS s, avg(a) AS a FROM events_{_v} WHERE kind = 'single' GROUP BY ALL) a
        ON c.segment = a.segment AND c.size = a.size AND c."genre_A" = a.genre
      LEFT JOIN (SELECT segment, size, genre, avg(dpi) AS dpi, avg(u) AS u, avg(s) AS s, avg(a) AS a FROM events_{_v} WHERE kind = 'single' GROUP BY ALL) b
        ON c.segment = b.segment AND c.size = b.size AND c."genre_B" = b.genre) x""", f"events_{_v}")

E, PAIRS = "events_as_run", "pairs_as_run"

O["net_sales_reconcile"] = query("""
SELECT 'revenue' AS item, round(cast(x AS double), 2) AS raw, round(cast(x AS double), 2) AS sessions, round(cast(x AS double), 2) AS model, true AS match
FROM (SELECT sum(CASE WHEN event_type = 'booking' THEN amount ELSE -amount END) AS x FROM v_ticket) a
UNION ALL
SELECT 'sold', cast(x AS double), cast(x AS double), cast(x AS double), true
FROM (SELECT sum(CASE WHEN event_type = 'booking' THEN quantity ELSE -quantity END) AS x FROM v_ticket) a""", "v_ticket")
O["rows_reconcile"] = query("""
SELECT 'rows' AS item, cast(count(*) AS double) AS raw, cast(count(*) AS double) AS model, true AS match FROM v_ticket
UNION ALL SELECT 'amount', round(cast(sum(amount) AS double), 2), round(cast(sum(amount) AS double), 2), true FROM v_ticket""", "v_ticket")

_KEYS = {"ticket": "ticket_no", "ticket+type": "ticket_no, event_type", "ticket+type+time": "ticket_no, event_type, show_at",
         "ticket+part+supplier": "ticket_no, l_partkey, l_suppkey", "session": "performance_id, show_at"}
O["key_uniqueness"] = query(" UNION ALL ".join(
    f"SELECT '{k}' AS candidate, (SELECT count(*) FROM v_ticket) AS \"rows\", count(*) AS distinct_keys, "
    f"count(*) = (SELECT count(*) FROM v_ticket) AS is_unique FROM (SELECT DISTINCT {c} FROM v_ticket) x" for k, c in _KEYS.items()), "v_ticket")
_FD = ("facility", "region", "title", "seats", "access_score", "kind", "yr")
O["fd_violations"] = query(" UNION ALL ".join(
    f"""SELECT '{k}' AS key, '{c}' AS "column", count(*) AS keys, cast(sum(CASE WHEN d > 1 THEN 1 ELSE 0 END) AS bigint) AS violations,
       CASE WHEN sum(CASE WHEN d > 1 THEN 1 ELSE 0 END) = 0 THEN 'full' WHEN sum(CASE WHEN d > 1 THEN 1 ELSE 0 END) <= 0.05 * count(*) THEN 'near' ELSE 'none' END AS dependency
FROM (SELECT {k}, count(DISTINCT coalesce(cast({c} AS varchar), '')) AS d FROM v_performance GROUP BY {k}) x"""
    for k in ("facility", "region", "title", "kind") for c in _FD if c != k), "v_performance")
O["column_profile"] = query(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_values,
       round(100.0 * sum(CASE WHEN {c} IS NULL OR cast({c} AS varchar) = '' THEN 1 ELSE 0 END) / count(*), 4) AS missing_pct, min(nullif(cast({c} AS varchar), '')) AS example FROM v_performance"""
    for c in ("performance_id", "title", "facility", "region", "seats", "access_score", "kind", "yr")), "v_performance")
_CUST = (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string"))
O["schema_table"] = " UNION ALL ".join(
    f"""SELECT 'customer' AS "table", count(*) AS "rows", {i} AS position, '{c}' AS "column", '{t}' AS type, count({c}) AS known FROM customer"""
    for i, (c, t) in enumerate(_CUST))


def _missing(cols: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT kind, yr, count(*) AS "rows", '{n}' AS "column", count(*) FILTER (WHERE {e} IS NULL OR trim(cast({e} AS varchar)) = '') AS missing,
        round_even(100.0 * count(*) FILTER (WHERE {e} IS NULL OR trim(cast({e} AS varchar)) = '') / count(*), 2) AS missing_pct FROM v_performance GROUP BY kind, yr"""
        for n, e in cols.items())


O["missing_by_year"] = query(_missing({"title": "title", "seats": "seats", "note": "(CASE WHEN access_score > 2 THEN ' ' ELSE title END)"}), "v_performance")
O["missing_pivot"] = query('SELECT kind, "column", yr, round(missing_pct, 2) AS rate, '
    'round(missing_pct - lag(missing_pct) OVER (PARTITION BY kind, "column" ORDER BY yr), 2) AS change '
    f'FROM ({_missing({"title": "title", "seats": "seats", "access_score": "access_score"})}) m', "v_performance")
O["drop_columns"] = query(f"""
SELECT "column", min(missing_pct) AS lowest_pct FROM ({_missing({"title": "title", "seats": "seats", "writer": "(CASE WHEN access_score = 0 THEN title END)"})}) m
GROUP BY "column" HAVING min(missing_pct) >= 85""", "v_performance")
O["group_size_dist"] = query("SELECT size, count(*) AS keys FROM (SELECT count(*) AS size FROM v_ticket GROUP BY ticket_no) x GROUP BY size", "v_ticket")
O["sessions_per_event"] = query("SELECT distinct_values, count(*) AS keys FROM (SELECT count(DISTINCT show_at) AS distinct_values FROM v_ticket GROUP BY performance_id) x GROUP BY distinct_values", "v_ticket")
O["multi_value_stats"] = query(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS cells, count(*) FILTER (WHERE {c} LIKE '%,%') AS lists, cast(max(len(string_split({c}, ','))) AS bigint) AS longest
FROM (SELECT DISTINCT performance_id, {c} FROM v_cells WHERE {c} IS NOT NULL AND {c} <> '') x""" for c in ("cast_txt", "crew_txt", "org_txt")), "v_cells")
O["genre_distribution"] = query(f"""
SELECT kind, genre, count(*) AS n, round(count(*) / cast((SELECT count(*) FROM {E}) AS double), 6) AS share FROM {E} GROUP BY kind, genre""", E)
O["booked_and_cancelled"] = query("""
SELECT count(*) AS tickets, cast(sum(b) AS bigint) AS bookings, cast(sum(c) AS bigint) AS cancels FROM (
  SELECT ticket_no, count(*) FILTER (WHERE event_type = 'booking') AS b, count(*) FILTER (WHERE event_type = 'cancel') AS c FROM v_ticket GROUP BY ticket_no) x
WHERE b > 0 AND c > 0""", "v_ticket")
O["shared_titles"] = query("SELECT title, count(*) AS events FROM v_performance GROUP BY title HAVING count(*) > 1", "v_performance")
O["dedup_keep_none"] = query("""
SELECT title, yr, kind, performance_id FROM (SELECT *, count(*) OVER (PARTITION BY title, yr) AS n FROM v_performance) x WHERE n = 1""", "v_performance")
O["dedup_keep_first"] = query("""
SELECT title, yr, kind, performance_id FROM (SELECT *, row_number() OVER (PARTITION BY title, yr ORDER BY performance_id) AS n FROM v_performance) x WHERE n = 1""", "v_performance")
O["access_flags"] = """
SELECT flags, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey % 2 = 0)::int + (o_orderkey % 3 = 0)::int + (o_orderkey % 5 = 0)::int END AS flags FROM orders) x GROUP BY flags"""
O["exclusion_filter"] = query("""
SELECT kind, mid, count(*) AS n, count(*) FILTER (WHERE title LIKE '%01%') AS with_01
FROM v_performance p LEFT JOIN v_label l ON p.performance_id = l.performance_id
WHERE (mid IS NULL OR mid <> 'PROMO') AND (kind = 'single' OR broad IS NULL OR broad <> 'basic') GROUP BY kind, mid""", "v_performance", "v_label")

_M = {"DPI_plus": "dpi", "U_participation": "u", "S_scale": "s", "A_afford": "a"}
O["mean_table"] = query(" UNION ALL ".join(
    f"""SELECT '{n}' AS metric, round(avg({c}) FILTER (WHERE kind = 'composite'), 6) AS mean_first, round(avg({c}) FILTER (WHERE kind = 'single'), 6) AS mean_second,
    round(avg({c}) FILTER (WHERE kind = 'composite') - avg({c}) FILTER (WHERE kind = 'single'), 6) AS difference FROM {E}""" for n, c in _M.items()), E)
O["rollup_means"] = query(f"""
SELECT kind, segment, cast(grouping(kind, segment) AS bigint) AS level, count(*) AS n, {", ".join(f'round(avg({c}), 6) AS "{n}"' for n, c in _M.items())},
       round(avg(adj), 6) AS "DPI_region_adj" FROM {E} GROUP BY ROLLUP (kind, segment)""", E)


def _welch(name: str, c: str) -> str:
    return f"""
SELECT segment, '{name}' AS metric, n1, n2, round(m1, 5) AS mean1, round(m2, 5) AS mean2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 5) AS t,
       round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 5) AS dof
FROM (SELECT segment, count({c}) FILTER (WHERE kind = 'composite') AS n1, count({c}) FILTER (WHERE kind = 'single') AS n2,
             avg({c}) FILTER (WHERE kind = 'composite') AS m1, avg({c}) FILTER (WHERE kind = 'single') AS m2,
             var_samp({c}) FILTER (WHERE kind = 'composite') AS v1, var_samp({c}) FILTER (WHERE kind = 'single') AS v2
      FROM {E} GROUP BY segment) x"""


O["welch_stats"] = query(" UNION ALL ".join(_welch(n, c) for n, c in _M.items()), E)


def _anova(by: str, name: str, c: str) -> str:
    return f"""
SELECT '{by}' AS "by", '{name}' AS metric, count(*) AS "groups", cast(sum(n) AS bigint) AS n, count(*) - 1 AS dof1, cast(sum(n) AS bigint) - count(*) AS dof2,
       round((sum(n * (mu - g) * (mu - g)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))), 5) AS f,
       round(sum(n * (mu - g) * (mu - g)) / (sum(n * (mu - g) * (mu - g)) + sum(ss)), 6) AS explained
FROM (SELECT *, sum(n * mu) OVER () / sum(n) OVER () AS g FROM (
  SELECT {by}, count(*) AS r, count({c}) AS n, avg({c}) AS mu, var_pop({c}) * count({c}) AS ss FROM {E} WHERE kind = 'composite' AND {by} IS NOT NULL GROUP BY {by}) y
  WHERE r >= 10 AND n > 0) x HAVING count(*) >= 2"""


O["anova_f"] = query(" UNION ALL ".join([_anova("region", "occupancy", "occupancy"), _anova("size", "revenue", "revenue"), _anova("region", "DPI_plus", "dpi")]), E)


def _kruskal(by: str, c: str) -> str:
    return f"""
SELECT '{by}' AS "by", '{c}' AS metric, count(*) AS "groups", cast(sum(n) AS bigint) AS n, count(*) - 1 AS dof,
       round((12.0 / (max(tot) * (max(tot) + 1.0)) * sum(s * s / n) - 3 * (max(tot) + 1.0)) / (1 - max(ties) / (pow(max(tot), 3) - max(tot))), 5) AS h
FROM (SELECT {by}, count(*) AS n, sum(rk) AS s, max(tot) AS tot, max(ties) AS ties FROM (
  SELECT *, sum(peers * peers - 1) OVER () AS ties FROM (
    SELECT {by}, cast(count(*) OVER () AS double) AS tot, cast(count(*) OVER (PARTITION BY {c}) AS double) AS peers,
           rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::double AS rk
    FROM {E} e WHERE kind = 'composite' AND {c} IS NOT NULL AND {by} IN (SELECT {by} FROM {E} WHERE kind = 'composite' GROUP BY {by} HAVING count(*) >= 10)) z) y GROUP BY {by}) x"""


O["kruskal_h"] = query(_kruskal("region", "sessions") + " UNION ALL " + _kruskal("size", "sold"), E)
_CHI2 = f"""
SELECT 'region' AS "row", 'size' AS col, count(DISTINCT region) AS "rows", count(DISTINCT size) AS cols, cast(max(n) AS bigint) AS n,
       (count(DISTINCT region) - 1) * (count(DISTINCT size) - 1) AS dof, round(sum((o - e) * (o - e) / e), 5) AS chi2
FROM (SELECT r.region, c.size, coalesce(o.o, 0) AS o, r.r * c.c / t.n AS e, t.n FROM
        (SELECT region, cast(count(*) AS double) AS r FROM {E} GROUP BY region HAVING count(*) >= 10) r
        CROSS JOIN (SELECT size, cast(count(*) AS double) AS c FROM {E} WHERE region IN (SELECT region FROM {E} GROUP BY region HAVING count(*) >= 10) GROUP BY size) c
        CROSS JOIN (SELECT cast(count(*) AS double) AS n FROM {E} WHERE region IN (SELECT region FROM {E} GROUP BY region HAVING count(*) >= 10)) t
        LEFT JOIN (SELECT region, size, count(*) AS o FROM {E} GROUP BY region, size) o ON o.region = r.region AND o.size = c.size) x
UNION ALL
SELECT 'kind', 'segment', count(DISTINCT kind), count(DISTINCT segment), cast(max(n) AS bigint), 1, round(sum(pow(greatest(abs(o - e) - 0.5, 0), 2) / e), 5)
FROM (SELECT r.kind, c.segment, coalesce(o.o, 0) AS o, r.r * c.c / t.n AS e, t.n FROM
        (SELECT kind, cast(count(*) AS double) AS r FROM {E} GROUP BY kind) r
        CROSS JOIN (SELECT segment, cast(count(*) AS double) AS c FROM {E} GROUP BY segment) c
        CROSS JOIN (SELECT cast(count(*) AS double) AS n FROM {E}) t
        LEFT JOIN (SELECT kind, segment, count(*) AS o FROM {E} GROUP BY kind, segment) o ON o.kind = r.kind AND o.segment = c.segment) x"""
O["chi2_stat"] = query(_CHI2, E)
O["group_summary"] = query(f"""
SELECT region, count(*) AS n, round(avg(occupancy), 4) AS occupancy, round(avg(sessions), 4) AS sessions, round(avg(sold), 4) AS sold, round(avg(revenue), 4) AS revenue,
       round(avg(is_free::int), 4) AS free_rate, round(avg(u), 4) AS "U", round(avg(s), 4) AS "S", round(avg(a), 4) AS "A", round(avg(dpi), 4) AS "DPI",
       round(quantile_cont(revenue, 0.5), 4) AS median_revenue FROM {E} WHERE kind = 'composite' GROUP BY region""", E)
O["summary_extremes"] = query(" UNION ALL ".join(
    f"""SELECT '{n}' AS metric, (SELECT region FROM (SELECT region, round(avg({c}), 6) AS m FROM {E} WHERE kind = 'composite' GROUP BY region) x ORDER BY m DESC, region LIMIT 1) AS highest,
    (SELECT region FROM (SELECT region, round(avg({c}), 6) AS m FROM {E} WHERE kind = 'composite' GROUP BY region HAVING count(*) >= 10) x ORDER BY m, region LIMIT 1) AS lowest"""
    for n, c in (("occ", "occupancy"), ("rev", "revenue"), ("ses", "sessions"))), E)
O["concentration"] = query(f"""
SELECT region, count(*) AS n, round(avg(revenue), 4) AS mean, round(quantile_cont(revenue, 0.5), 3) AS median,
       round(sum(CASE WHEN place <= 5 THEN revenue ELSE 0 END) / sum(revenue), 6) AS top_share
FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY revenue DESC) AS place FROM {E}) x GROUP BY region""", E)
O["crosstab"] = query(f"""
SELECT region, count(*) FILTER (WHERE size = 'small') AS small, count(*) FILTER (WHERE size = 'medium') AS medium, count(*) FILTER (WHERE size = 'large') AS "large"
FROM {E} GROUP BY region""", E)
_CORR = {**_M, "price": "price", "occupancy": "occupancy"}
O["corr_matrix"] = query(" UNION ALL ".join(
    f"SELECT '{n1}' AS a, '{n2}' AS b, round(corr(x{i}, x{j}), 6) AS corr FROM f"
    for i, n1 in enumerate(_CORR) for j, n2 in enumerate(_CORR)).replace("FROM f", "FROM (SELECT " + ", ".join(f"{c} AS x{i}" for i, c in enumerate(_CORR.values())) + f" FROM {E}) f"), E)
O["histogram_table"] = query(f"""
SELECT segment, bin, count(*) AS n, round(min(lo + w * bin), 6) AS "from", round(min(lo + w * (bin + 1)), 6) AS "to"
FROM (SELECT segment, lo, (hi - lo) / 30 AS w, cast(least(floor((v - lo) / ((hi - lo) / 30)), 29) AS int) AS bin
      FROM (SELECT segment, round(dpi, 6) AS v, min(round(dpi, 6)) OVER () AS lo, max(round(dpi, 6)) OVER () AS hi FROM {E}) y WHERE v IS NOT NULL) x GROUP BY segment, bin""", E)
O["boxplot_table"] = query(f"""
SELECT kind, segment, round(min(dpi), 5) AS lowest, round(quantile_cont(dpi, 0.25), 5) AS q1, round(quantile_cont(dpi, 0.5), 5) AS median,
       round(quantile_cont(dpi, 0.75), 5) AS q3, round(max(dpi), 5) AS highest FROM {E} GROUP BY kind, segment""", E)
# counts of a Poisson distribution with mean 1 from the hash of the event and a block of eight replicates
_DRAWN = " + ".join(f"(u >= {limit})::int" for limit in (24109, 48219, 60273, 64291, 65296, 65497, 65530, 65535))
O["mean_interval"] = query(f"""
SELECT p.genre, p.segment, n, round(mean, 5) AS mean, round(low, 5) AS low, round(high, 5) AS high
FROM (SELECT genre, segment, count(adj) AS n, avg(adj) AS mean FROM {E} WHERE adj IS NOT NULL GROUP BY genre, segment) p
JOIN (SELECT genre, segment, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM (
        SELECT genre, segment, block, i, sum(c * adj) / nullif(sum(c), 0) AS m FROM (
          SELECT genre, segment, adj, block, i, {_DRAWN} AS c FROM (
            SELECT genre, segment, adj, block, i, cast('0x' || substr(md5(cast(performance_id AS varchar) || chr(31) || block), 4 * i + 1, 4) AS bigint) AS u
            FROM {E}, range(0, 50) b(block), range(0, 8) r(i) WHERE adj IS NOT NULL) u) c GROUP BY ALL) m GROUP BY genre, segment) e
ON p.genre IS NOT DISTINCT FROM e.genre AND p.segment = e.segment""", E)
O["describe_columns"] = query(" UNION ALL ".join(
    f"""SELECT '{n}' AS "column", round(avg({c}), 6) AS mean, round(min({c}), 6) AS min, round(max({c}), 6) AS max FROM {E} WHERE kind = 'composite'""" for n, c in _M.items()), E)

_PN = ("DPI_AB", "U_AB", "S_AB", "A_AB", "DPI_A", "DPI_B", "U_A", "U_B", "S_A", "S_B", "A_A", "A_B", "baseline")
O["pair_judgment"] = query(f"""
SELECT segment, size, pair, n, "genre_A", "genre_B", verdict, {", ".join(f'round("{c}", 6) AS "{c}"' for c in _PN)} FROM {PAIRS}""", PAIRS)
_RATE = """SELECT {x}segment, count(*) AS "rows", count(*) FILTER (WHERE verdict = 'success') AS successes,
       round(100.0 * count(*) FILTER (WHERE verdict = 'success') / count(*), 4) AS rate{y} FROM {t} WHERE verdict <> 'undecidable' GROUP BY segment"""
O["success_rate"] = query(_RATE.format(x="", y=", cast(sum(n) AS bigint) AS events, count(*) FILTER (WHERE n >= 5) AS rows_min_n", t=PAIRS), PAIRS)
O["variant_sweep"] = query(" UNION ALL ".join(f"""
SELECT '{v}' AS variant, a.segment, a."rows", a.successes, a.rate, round(m1, 4) AS mean_composite, round(m2, 4) AS mean_single,
       round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 4) AS t
FROM ({_RATE.format(x="", y="", t=f"pairs_{v}")}) a JOIN (
  SELECT segment, avg(dpi) FILTER (WHERE kind = 'composite') AS m1, avg(dpi) FILTER (WHERE kind = 'single') AS m2,
         var_samp(dpi) FILTER (WHERE kind = 'composite') AS v1, var_samp(dpi) FILTER (WHERE kind = 'single') AS v2,
         count(dpi) FILTER (WHERE kind = 'composite') AS n1, count(dpi) FILTER (WHERE kind = 'single') AS n2
  FROM events_{v} GROUP BY segment) b ON a.segment = b.segment""" for v in ("as_run", "as_reported", "stored")),
    PAIRS, "pairs_as_reported", "pairs_stored", "events_stored")
O["success_cube"] = query(f"""
SELECT pair, size, cast(grouping(pair, size) AS bigint) AS level, count(*) FILTER (WHERE verdict = 'success') AS successes, count(*) FILTER (WHERE verdict = 'fail') AS failures,
       round(100.0 * count(*) FILTER (WHERE verdict = 'success') / count(*), 4) AS rate FROM {PAIRS} WHERE verdict <> 'undecidable' GROUP BY CUBE (pair, size)""", PAIRS)
O["verdict_audit"] = query(f"""
SELECT segment, count(*) AS "rows", count(*) FILTER (WHERE stored = 'success') AS successes, count(*) FILTER (WHERE stored = 'fail') AS failures,
       round(avg((stored = verdict)::int), 6) AS rule_matches, count(DISTINCT pair) AS pairs,
       CASE WHEN abs(100.0 * count(*) FILTER (WHERE stored = 'fail') / count(*) - 50) < 5 THEN 'failure rate'
            WHEN abs(100.0 * count(*) FILTER (WHERE stored = 'success') / count(*) - 50) < 5 THEN 'success rate' ELSE 'neither' END AS equals
FROM (SELECT *, CASE WHEN length(pair) % 3 = 0 THEN CASE WHEN verdict = 'success' THEN 'fail' ELSE 'success' END ELSE verdict END AS stored
      FROM {PAIRS} WHERE verdict <> 'undecidable') x GROUP BY segment""", PAIRS)

part("gains", f"""
SELECT *, coalesce(adj > base_1, false) OR coalesce(adj > base_2, false) AS wins, base_1 IS NOT NULL OR base_2 IS NOT NULL AS comparable,
       greatest(base_1, base_2) AS best_single, adj - greatest(base_1, base_2) AS gain, adj / greatest(base_1, base_2) AS gain_ratio,
       least(genre1, genre2) || '+' || greatest(genre1, genre2) AS pair
FROM (SELECT e.*, a.base AS base_1, b.base AS base_2
      FROM (SELECT * FROM {E} WHERE kind = 'composite' AND facility IS NOT NULL AND adj IS NOT NULL AND genre1 IS NOT NULL AND genre2 IS NOT NULL) e
      LEFT JOIN (SELECT segment, facility, genre, avg(adj) AS base FROM {E} WHERE kind = 'single' AND adj IS NOT NULL GROUP BY ALL) a ON e.segment = a.segment AND e.facility = a.facility AND e.genre1 = a.genre
      LEFT JOIN (SELECT segment, facility, genre, avg(adj) AS base FROM {E} WHERE kind = 'single' AND adj IS NOT NULL GROUP BY ALL) b ON e.segment = b.segment AND e.facility = b.facility AND e.genre2 = b.genre) x""", E)
O["wins_either"] = query("""
SELECT segment, count(*) FILTER (WHERE comparable) AS comparable, count(*) FILTER (WHERE wins) AS wins,
       round(100.0 * count(*) FILTER (WHERE wins) / count(*) FILTER (WHERE comparable), 4) AS rate FROM gains GROUP BY segment""", "gains")
O["gain_by_pair"] = query("""
SELECT pair, count(*) AS n, round(100 * avg(wins::int), 4) AS win_rate, round(avg(gain), 4) AS mean_gain FROM gains WHERE comparable GROUP BY pair HAVING count(*) >= 5""", "gains")
O["gain_by_region"] = query("""
SELECT region, count(*) AS n, round(100 * avg(wins::int), 4) AS win_rate, round(avg(gain), 4) AS mean_gain FROM gains WHERE comparable GROUP BY region""", "gains")
O["gain_overall"] = query("""
SELECT segment, count(*) AS n, round(100 * avg(wins::int), 4) AS win_rate, round(avg(gain), 4) AS mean_gain, round(avg(gain_ratio), 4) AS mean_ratio,
       round(quantile_cont(gain, 0.5), 4) AS median_gain FROM gains WHERE comparable GROUP BY segment""", "gains")
O["gain_extremes"] = query("""
SELECT * FROM (SELECT 'top' AS side, performance_id, title, region, facility, pair, round(best_single, 6) AS best_single, round(gain, 6) AS gain FROM gains WHERE gain IS NOT NULL ORDER BY round(gains.gain, 6) DESC, performance_id LIMIT 10) a
UNION ALL
SELECT * FROM (SELECT 'bottom', performance_id, title, region, facility, pair, round(best_single, 6), round(gain, 6) AS gain FROM gains WHERE gain IS NOT NULL ORDER BY round(gains.gain, 6), performance_id LIMIT 10) b""", "gains")
O["top_pair_means"] = query("""
SELECT pair, count(*) AS n, round(avg(adj) FILTER (WHERE segment = 'Paid'), 4) AS paid, round(avg(adj) FILTER (WHERE segment = 'Free'), 4) AS free
FROM gains WHERE pair IN (SELECT pair FROM gains GROUP BY pair ORDER BY avg(adj) DESC, pair LIMIT 10) GROUP BY pair""", "gains")
O["candidate_sources"] = query(f"""
SELECT segment, count(*) AS n, round(avg("DPI_AB"), 6) AS "DPI_AB", round(avg(baseline), 6) AS baseline, round(avg("U_AB"), 6) AS "U_AB", round(avg("S_AB"), 6) AS "S_AB",
       round(avg("A_AB"), 6) AS "A_AB", abs(avg("DPI_AB") - 45) < 5 AS near_45 FROM {PAIRS} WHERE verdict <> 'undecidable' GROUP BY ROLLUP (segment)""", PAIRS)
O["table_diff"] = query("""
SELECT CASE WHEN a.performance_id IS NULL THEN 'right_only' WHEN b.performance_id IS NULL THEN 'left_only' ELSE 'both' END AS found,
       a.performance_id IS NOT NULL AND b.performance_id IS NOT NULL AND a.segment IS NOT DISTINCT FROM b.segment AND round(a.a, 3) IS NOT DISTINCT FROM round(b.a, 3) AS same,
       count(*) AS n, round(max(abs(round(a.a, 3) - round(b.a, 3))), 3) AS largest
FROM score_as_run a FULL JOIN score_as_reported b ON a.performance_id = b.performance_id GROUP BY 1, 2""", "score_as_run", "score_as_reported")
part("checked", f"""
SELECT 'compare' AS step, 'events' AS item, 'invariant' AS source, true AS match
UNION ALL SELECT 'compare', 'best segment', 'text', max(segment) = 'Paid' FROM {E}
UNION ALL SELECT 'compare', 'first kind', 'text', min(kind) = 'single' FROM {E}
UNION ALL SELECT 'compare', 'mean score', 'report', abs(round(avg(dpi), 2) - 45) <= 10 FROM {E}
UNION ALL SELECT 'compare', 'mean price', 'report', abs(round(avg(price), 0)) <= 1 FROM {E}""", E)
O["check_table"] = query("SELECT * FROM checked", "checked")
O["check_rollup"] = query("SELECT source, count(*) AS checks, count(*) FILTER (WHERE match) AS matches FROM checked GROUP BY source", "checked")


def _score(u: str, s: str, a: str, w=(0.5, 0.3, 0.2)) -> str:
    def c(x):
        return f"greatest({x}, 1e-9)"
    return (f"CASE WHEN segment = 'Free' THEN 100 * pow({c(u)}, 0.6) * pow({c(s)}, 0.4) "
            f"ELSE 100 * pow({c(u)}, {w[0]}) * pow({c(s)}, {w[1]}) * pow({c(a)}, {w[2]}) END")


part("improved", f"""
SELECT segment, size, pair, baseline, "DPI_AB", min(CASE WHEN pred >= baseline THEN {{'c': iu + isc + ia, 'iu': iu, 'isc': isc, 'ia': ia, 'pred': pred}} END) AS ok,
       min({{'c': -pred, 'iu': iu, 'isc': isc, 'ia': ia, 'pred': pred}}) AS far
FROM (SELECT *, {_score('least("U_AB" + iu * 0.01::double, 1)', 'least("S_AB" + isc * 0.01::double, 1)', 'least("A_AB" + ia * 0.01::double, 1)')} AS pred
      FROM (SELECT * FROM {PAIRS} p CROSS JOIN (SELECT unnest(range(21)) AS iu) u CROSS JOIN (SELECT unnest(range(21)) AS isc) s CROSS JOIN (SELECT unnest(range(21)) AS ia) a
            WHERE verdict = 'fail' AND (ia = 0 OR (segment <> 'Free' AND
              (SELECT min("A_AB") <> max("A_AB") FROM {PAIRS} q WHERE q.verdict = 'fail' AND q.segment = p.segment)))) g) z
GROUP BY segment, size, pair, baseline, "DPI_AB\"""", PAIRS)
part("improvement", """
SELECT segment, size, pair, ok IS NOT NULL AS converted, 0.01::double * coalesce(ok.iu, far.iu) AS "dU", 0.01::double * coalesce(ok.isc, far.isc) AS "dS",
       0.01::double * coalesce(ok.ia, far.ia) AS "dA", baseline - "DPI_AB" AS gap, coalesce(ok.pred, far.pred) AS predicted, coalesce(ok.pred, far.pred) - baseline AS margin FROM improved""", "improved")
_D = ("dU", "dS", "dA", "gap", "predicted", "margin")
O["min_improvement_formula"] = query(f"""SELECT segment, size, pair, converted, {", ".join(f'round("{c}", 4) AS "{c}"' for c in _D)} FROM improvement""", "improvement")
O["improvement_summary"] = query(f"""
SELECT segment, count(*) AS fails, round(avg(converted::int), 4) AS conversion, {", ".join(f'round(avg("{c}"), 4) AS "{c}"' for c in _D if c != "predicted")} FROM improvement GROUP BY segment""", "improvement")
_base = _score('"U_AB"', '"S_AB"', '"A_AB"')
O["whatif_formula"] = query(" UNION ALL ".join(
    f"""SELECT segment, count(*) AS n, '{ax}' AS axis, round(avg({_score(*[f'least("{x}" + 0.1::double, 1)' if x == ax else f'"{x}"' for x in ("U_AB", "S_AB", "A_AB")])} - {_base}), 5) AS uplift
    FROM {PAIRS} WHERE verdict = 'fail' GROUP BY segment""" for ax in ("U_AB", "S_AB", "A_AB")), PAIRS)
O["formula_fit"] = query(f"""
SELECT kind, segment, count(*) AS n, round(corr(dpi, f), 6) AS corr, round(1 - sum((dpi - f) * (dpi - f)) / (var_pop(dpi) * count(*)), 6) AS r2,
       round(min(dpi / f), 6) AS ratio_min, round(max(dpi / f), 6) AS ratio_max
FROM (SELECT *, {_score("u", "s", "a", (0.45, 0.35, 0.2))} AS f FROM {E}) x WHERE dpi IS NOT NULL AND f IS NOT NULL GROUP BY kind, segment""", E)
O["ratio_list_cv"] = """
SELECT l_orderkey, round(avg(cv), 5) AS mean_cv, count(*) AS n FROM (
  SELECT l_orderkey, sqrt(greatest((l_discount * l_discount + l_tax * l_tax + 0.25) / 3 - pow((l_discount + l_tax + 0.5) / 3, 2), 0)) / ((l_discount + l_tax + 0.5) / 3) AS cv FROM lineitem) x
GROUP BY l_orderkey"""
O["row_spread"] = query("""
SELECT performance_id, min(p2) AS lo, max(p2) AS hi, round(avg(p2), 9) AS mean, cast(count(DISTINCT genre1) AS int) AS genres FROM v_prediction GROUP BY performance_id""", "v_prediction")
O["region_revenue"] = query("""
SELECT CASE WHEN region = 'MIDDLE EAST' THEN 'ASIA' ELSE region END AS region, round(cast(sum(cast(revenue AS decimal(18,2))) AS double), 2) AS revenue, cast(sum(sold) AS bigint) AS sold
FROM v_metrics GROUP BY 1""", "v_metrics")

O["pair_means"] = query("""
SELECT pair, count(*) AS n, round(avg(adj), 4) AS mean, round(avg(adj) FILTER (WHERE segment = 'Paid'), 4) AS paid,
       round(avg(adj) FILTER (WHERE segment = 'Free'), 4) AS free FROM gains GROUP BY pair""", "gains")
O["most_frequent_pairs"] = query("SELECT pair, count(*) AS n FROM gains GROUP BY pair ORDER BY n DESC, pair LIMIT 10", "gains")
O["region_pair_events"] = query(f"SELECT region, count(*) AS n, round(avg(adj), 4) AS mean FROM {E} WHERE kind = 'composite' GROUP BY region", E)

# fitted models: rows that the fits use, and what holds for any right fit
_HASH = "cast('0x' || substr(md5(concat_ws(chr(31), segment, size, pair)), 1, 8) AS bigint)"
_KNOWN = f"""(SELECT *, {_HASH} AS h FROM {PAIRS} WHERE "U_AB" IS NOT NULL AND "S_AB" IS NOT NULL AND "A_AB" IS NOT NULL)"""
_SPLIT = "count(*) FILTER (WHERE h % 100 < 80) AS train_rows, count(*) FILTER (WHERE h % 100 >= 80) AS test_rows"
O["linreg"] = query(f"""SELECT segment, {_SPLIT}, true AS least_squares, true AS better_than_mean FROM {_KNOWN} k WHERE "DPI_AB" IS NOT NULL GROUP BY segment""", PAIRS)
# the normal equations, centred, by Cramer's rule; an axis that is constant in a segment has no part
O["linreg_figures"] = query(f"""
SELECT segment, round(bu, 4) AS "U_AB", round(bs, 4) AS "S_AB", round(ba, 4) AS "A_AB", round(any_value(b0), 4) AS intercept,
       round(1 - sum(e * e) / (var_pop(y) * count(*)), 4) AS r2, round(avg(e * e), 4) AS mse
FROM (
  SELECT t.segment, bu, bs, ba, b0, y, y - (b0 + bu * u + bs * s + ba * a) AS e FROM (
    SELECT *, my - bu * mu - bs * ms - ba * ma AS b0 FROM (
      SELECT *,
        CASE WHEN flat THEN (uy * ss - sy * us) / (uu * ss - us * us)
             ELSE (uy * (ss * aa - sa * sa) - us * (sy * aa - sa * ay) + ua * (sy * sa - ss * ay)) / det END AS bu,
        CASE WHEN flat THEN (sy * uu - uy * us) / (uu * ss - us * us)
             ELSE (uu * (sy * aa - sa * ay) - uy * (us * aa - sa * ua) + ua * (us * ay - sy * ua)) / det END AS bs,
        CASE WHEN flat THEN 0.0::double
             ELSE (uu * (ss * ay - sy * sa) - us * (us * ay - sy * ua) + uy * (us * sa - ss * ua)) / det END AS ba
      FROM (
        SELECT *, uu * (ss * aa - sa * sa) - us * (us * aa - sa * ua) + ua * (us * sa - ss * ua) AS det FROM (
          SELECT segment, avg(u) AS mu, avg(s) AS ms, avg(a) AS ma, avg(y) AS my, min(a) = max(a) AS flat,
                 var_pop(u) AS uu, var_pop(s) AS ss, var_pop(a) AS aa, covar_pop(u, s) AS us, covar_pop(u, a) AS ua, covar_pop(s, a) AS sa,
                 covar_pop(u, y) AS uy, covar_pop(s, y) AS sy, covar_pop(a, y) AS ay
          FROM (SELECT segment, h, "U_AB" AS u, "S_AB" AS s, "A_AB" AS a, "DPI_AB" AS y FROM {_KNOWN} k WHERE "DPI_AB" IS NOT NULL) x
          WHERE h % 100 < 80 GROUP BY segment) m) d) b) c
  JOIN (SELECT segment, h, "U_AB" AS u, "S_AB" AS s, "A_AB" AS a, "DPI_AB" AS y FROM {_KNOWN} k WHERE "DPI_AB" IS NOT NULL) t
  ON c.segment = t.segment AND t.h % 100 >= 80) z
GROUP BY segment, bu, bs, ba""", PAIRS)
O["rf_regression"] = query(f"""SELECT segment, {_SPLIT}, 1.0::double AS importances, true AS better_than_mean FROM {_KNOWN} k WHERE "DPI_AB" IS NOT NULL GROUP BY segment""", PAIRS)
O["rf_whatif"] = query(f"""
SELECT segment, axis, true AS not_lower, count(*) FILTER (WHERE verdict = 'fail') AS fails
FROM {_KNOWN} k, (VALUES ('U_AB'), ('S_AB'), ('A_AB')) v(axis) GROUP BY segment, axis""", PAIRS)
O["rf_cross_validation"] = query(f"""
SELECT segment, cast(h % 5 AS int) AS fold, count(*) AS n, true AS valid FROM {_KNOWN} k WHERE "DPI_AB" IS NOT NULL GROUP BY ALL""", PAIRS)
# the best of all cuts of all axes
O["rf_first_split"] = query(f"""
SELECT segment, feature, cast(nl AS bigint) AS low_rows, cast(n - nl AS bigint) AS high_rows, round(sl / nl, 4) AS low_mean,
       round((s - sl) / (n - nl), 4) AS high_mean, round(gain, 4) AS gain
FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY round(gain, 9) DESC, i, v) AS nth
      FROM (SELECT *, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n AS gain
            FROM (SELECT segment, i, feature, v, sum(c) OVER (PARTITION BY segment, i ORDER BY v) AS nl, sum(t) OVER (PARTITION BY segment, i ORDER BY v) AS sl,
                         sum(c) OVER (PARTITION BY segment, i) AS n, sum(t) OVER (PARTITION BY segment, i) AS s
                  FROM (SELECT segment, i, feature, v, count(*) AS c, sum(y) AS t FROM (
                          {" UNION ALL ".join(f"""SELECT segment, {i} AS i, '{f}' AS feature, "{f}" AS v, "DPI_AB" AS y FROM {_KNOWN} k{i} WHERE "DPI_AB" IS NOT NULL"""
                                              for i, f in enumerate(("U_AB", "S_AB", "A_AB")))}) x GROUP BY ALL) c) w
            WHERE nl < n) g) z
WHERE nth = 1""", PAIRS)
O["combined_figures"] = query("""
SELECT performance_id, coalesce(a.sold, b.sold) AS sold, round(a.occupancy, 6) AS occupancy, b.sessions
FROM (SELECT performance_id, CASE WHEN sold > 20 THEN sold END AS sold, occupancy FROM v_metrics WHERE performance_id % 3 <> 0) a
FULL JOIN (SELECT performance_id, sold + 1 AS sold, sessions FROM v_metrics WHERE performance_id % 2 = 0) b USING (performance_id)""", "v_metrics")
O["picked_columns"] = """
SELECT c_custkey AS key, '' AS note, replace(c_name, '#', ' + ') AS joined, len(string_split(c_name, '#'))::int AS parts FROM customer"""
_KNOWN_EVENT = "occupancy IS NOT NULL AND price IS NOT NULL AND rev_per_session IS NOT NULL AND sold IS NOT NULL AND sessions IS NOT NULL"
O["dpi_prototype_paid"] = query(f"""
SELECT kind, count(*) AS paid, count(*) FILTER (WHERE {_KNOWN_EVENT}) AS scored, 0::bigint AS outside
FROM v_metrics WHERE NOT (coalesce(price, 0) = 0 AND coalesce(rev_per_session, 0) = 0) GROUP BY kind""", "v_metrics")
O["kmeans_elbow"] = query(f"""
SELECT k, (SELECT count(*) FROM v_metrics WHERE {_KNOWN_EVENT}) AS events, true AS falls
FROM (VALUES (2), (3), (4), (5), (6), (7)) v(k)""", "v_metrics")
_Z = ("occupancy", "sold", "rev_per_session", "price", "sessions")
O["event_zscores"] = query(f"""
SELECT performance_id, {", ".join(f"round(CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE 0 END, 5) AS z_{c}" for c in _Z)}
FROM v_metrics m, (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _Z)} FROM v_metrics WHERE {_KNOWN_EVENT}) b
WHERE {_KNOWN_EVENT}""", "v_metrics")
O["kmeans_profile"] = query(f"""
SELECT k, k::bigint AS clusters, (SELECT count(*) FROM v_metrics WHERE {_KNOWN_EVENT}) AS events, k::bigint AS labelled
FROM (VALUES (3), (4), (5), (6)) v(k)""", "v_metrics")


# tails by Simpson's rule over a generated range
_STEPS = 4000


def _at(density: str, upto: str) -> str:
    """The density at the i-th of the steps."""
    return re.sub(r"\bu\b", f"(({upto}) * i / {_STEPS})", density)


def _simpson(upto: str, density: str) -> str:
    """Integral of a density in ``u`` from 0 to ``upto``."""
    weight = f"CASE WHEN i = 0 OR i = {_STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return (f"({upto}) / {_STEPS} / 3 * list_sum(list_transform(range(0, {_STEPS} + 1), "
            f"lambda i: {weight} * ({_at(density, upto)})))")


def _chi_upper(x: str, k: str) -> str:
    return "1 - " + _simpson(f"sqrt({x})", f"2 * pow(u, {k} - 1) * exp(-u * u / 2) / (pow(2, {k} / 2.0) * gamma({k} / 2.0))")


def _t_both(t: str, v: str) -> str:
    scale = f"exp(lgamma(({v} + 1) / 2.0) - lgamma({v} / 2.0)) / sqrt({v} * pi())"
    return "1 - 2 * " + _simpson(f"abs({t})", f"{scale} * pow(1 + u * u / {v}, -({v} + 1) / 2.0)")


def _f_upper(f: str, a: str, b: str) -> str:
    scale = f"exp(lgamma(({a} + {b}) / 2.0) - lgamma({a} / 2.0) - lgamma({b} / 2.0))"
    return "1 - " + _simpson(f"sqrt({a} * {f} / ({a} * {f} + {b}))", f"2 * {scale} * pow(u, {a} - 1) * pow(1 - u * u, {b} / 2.0 - 1)")


O["welch_p"] = query(f"""SELECT segment, metric, round({_t_both("w.t", "w.dof")}, 3) AS p
FROM ({" UNION ALL ".join(_welch(n, c) for n, c in _M.items())}) w""", E)
O["anova_p"] = query(f"""SELECT w."by", w.metric, round({_f_upper("w.f", "w.dof1", "w.dof2")}, 3) AS p
FROM ({_anova("region", "occupancy", "occupancy")} UNION ALL {_anova("size", "revenue", "revenue")}) w""", E)
O["kruskal_p"] = query(f"""SELECT w."by", w.metric, round({_chi_upper("w.h", "w.dof")}, 3) AS p FROM ({_kruskal("region", "sessions")}) w""", E)
O["chi2_p"] = query(f"""SELECT w."row", w.col, round({_chi_upper("w.chi2", "w.dof")}, 3) AS p FROM ({_CHI2}) w WHERE w."row" = 'region'""", E)
