"""SQL of the queries on metrics, ranks, scores and region adjustment."""

from __future__ import annotations

from stagelens.plans.oracle_parts import clip_sql, pct_avg, pct_max, query

ORACLE_SCORE: dict[str, str] = {}
O = ORACLE_SCORE

O["perf_metrics"] = query("""
SELECT performance_id, title, facility, region, seats, kind, access_score, sessions, sold, round(revenue, 2) AS revenue,
       occupancy, avg_sold, price, rev_per_session FROM v_metrics""", "v_metrics")
O["top_revenue"] = query("""
SELECT performance_id, title, region, sessions, sold, round(revenue, 2) AS revenue
FROM v_metrics ORDER BY v_metrics.revenue DESC, performance_id LIMIT 5""", "v_metrics")
O["occupancy_over_one"] = query("""
SELECT kind, count(*) FILTER (WHERE occupancy > 1) AS "over", count(*) FILTER (WHERE occupancy IS NULL) AS "unknown", count(*) AS n
FROM v_metrics GROUP BY kind""", "v_metrics")
O["winsor_pctrank"] = query(f"""
SELECT performance_id, round({pct_avg("wo", "1")}, 6) AS occ_pct, round({pct_avg("wp", "1")}, 6) AS price_pct
FROM (SELECT performance_id, {clip_sql("occupancy", "lo1", "hi1")} AS wo, {clip_sql("price", "lo2", "hi2")} AS wp
      FROM v_metrics CROSS JOIN (SELECT quantile_cont(occupancy, 0.05) AS lo1, quantile_cont(occupancy, 0.95) AS hi1,
             quantile_cont(price, 0.05) AS lo2, quantile_cont(price, 0.95) AS hi2 FROM v_metrics) q) x""", "v_metrics")
O["cohort_pctrank"] = query(f"""
SELECT performance_id, yr, round({pct_avg("w", "yr")}, 6) AS rev_pct
FROM (SELECT performance_id, m.yr, {clip_sql("rev_per_session", "lo", "hi")} AS w
      FROM v_metrics m JOIN (SELECT yr, quantile_cont(rev_per_session, 0.05) AS lo, quantile_cont(rev_per_session, 0.95) AS hi
             FROM v_metrics GROUP BY yr) q ON m.yr = q.yr) x""", "v_metrics")
O["pctrank_max"] = query(f"""
SELECT performance_id, round({pct_max("price", "kind")}, 6) AS price_pct, round({pct_max("rev_per_session", "kind")}, 6) AS rev_pct
FROM v_metrics""", "v_metrics")
O["iqr_filter"] = query("SELECT performance_id, kind, round(occupancy, 4) AS occupancy FROM iqr", "iqr")
O["venue_bucket"] = query("""
SELECT size, size_strict, count(*) AS n, round(avg(occupancy), 4) AS mean_occ FROM (
  SELECT CASE WHEN seats <= 300 THEN 'small' WHEN seats <= 1000 THEN 'medium' ELSE 'large' END AS size,
         CASE WHEN seats < 300 THEN 'small' WHEN seats < 1000 THEN 'medium' ELSE 'large' END AS size_strict, occupancy
  FROM v_metrics) x GROUP BY size, size_strict""", "v_metrics")
O["segment_flag"] = query("""
SELECT kind, segment, count(*) FILTER (WHERE a) AS any_or_missing, count(*) FILTER (WHERE b) AS any_known,
       count(*) FILTER (WHERE c) AS both_zero, count(*) AS n
FROM (SELECT kind, coalesce(price, 0) <= 0 OR coalesce(rev_per_session, 0) <= 0 AS a,
             coalesce(price <= 0, false) OR coalesce(rev_per_session <= 0, false) AS b,
             coalesce(price, 0) = 0 AND coalesce(rev_per_session, 0) = 0 AS c,
             CASE WHEN coalesce(price, 0) <= 0 OR coalesce(rev_per_session, 0) <= 0 THEN 'Free' ELSE 'Paid' END AS segment
      FROM v_metrics) x GROUP BY kind, segment""", "v_metrics")

_DPI = """
SELECT performance_id, kind, segment, is_free, round(u, 6) AS "U_participation", round(s, 6) AS "S_scale",
       round(a, 6) AS "A_afford", round(mult, 6) AS access_multiplier, round(core, 4) AS "DPI_core",
       round(dpi, 4) AS "DPI_plus", round(adj, 4) AS "DPI_region_adj" FROM {}"""
O["dpi_as_run"] = query(_DPI.format("scored_as_run"), "scored_as_run")
O["dpi_as_reported"] = query(_DPI.format("scored_as_reported"), "scored_as_reported")
O["dpi_guardrail"] = query(_DPI.format("scored_as_reported_guard"), "scored_as_reported_guard")
O["dpi_access_multiplier"] = query("""
SELECT kind, access_score, count(*) AS n, round(min(mult), 6) AS lo, round(max(mult), 6) AS hi
FROM score_as_run GROUP BY kind, access_score""", "score_as_run")
O["dpi_prototype_free"] = query("""
SELECT performance_id, x.kind, round(0.4 * CASE WHEN occupancy IS NULL THEN NULL WHEN h1 = l1 THEN 0 ELSE (occupancy - l1) / (h1 - l1) END
  + 0.3 * CASE WHEN h2 = l2 THEN 0 ELSE (sold - l2) / (h2 - l2) END
  + 0.3 * CASE WHEN h3 = l3 THEN 0 ELSE (sessions - l3) / (h3 - l3) END, 6) AS "PI"
FROM (SELECT * FROM v_metrics WHERE coalesce(price, 0) = 0 AND coalesce(rev_per_session, 0) = 0) x
JOIN (SELECT kind, min(occupancy) AS l1, max(occupancy) AS h1, min(sold)::double AS l2, max(sold)::double AS h2,
             min(sessions)::double AS l3, max(sessions)::double AS h3
      FROM v_metrics WHERE coalesce(price, 0) = 0 AND coalesce(rev_per_session, 0) = 0 GROUP BY kind) b ON x.kind = b.kind""", "v_metrics")

_PF = {"occ": "occupancy", "ses": "ln(1 + greatest(coalesce(sessions, 0), 0))", "price": "price", "rev": "rev_per_session", "cv": "cv"}
_pf_bounds = ", ".join(f"quantile_cont(f_{k}, 0.05) AS lo_{k}, quantile_cont(f_{k}, 0.95) AS hi_{k}" for k in _PF)
_pf_clip = ", ".join(clip_sql(f"f_{k}", f"lo_{k}", f"hi_{k}") + f" AS w_{k}" for k in _PF)
_pf_rank = ", ".join(pct_avg(f"w_{k}", "kind") + f" AS r_{k}" for k in _PF)


def _g(x: str) -> str:
    return clip_sql(x, "1e-9", "1.0")


O["dpi_prototype"] = query(f"""
SELECT performance_id, is_free, round(100 * u, 4) AS "U", round(100 * s, 4) AS "S", round(100 * a, 4) AS "A",
       round(CASE WHEN is_free THEN 100 * pow({_g('u')}, 0.6) * pow({_g('s')}, 0.4)
             ELSE 100 * pow({_g('u')}, 0.45) * pow({_g('s')}, 0.35) * pow({_g('a')}, 0.2) * CASE WHEN r_rev < 0.2 THEN 0.95 ELSE 1.0 END END, 4) AS "DPI_final"
FROM (SELECT *, sqrt(r_occ * (1 - r_cv)) AS u, r_ses AS s, 1 - r_price AS a FROM (
  SELECT performance_id, kind, coalesce(price, 0) <= 0 OR coalesce(rev_per_session, 0) <= 0 AS is_free, {_pf_rank} FROM (
    SELECT f.*, {_pf_clip} FROM (SELECT m.*, {", ".join(f"{v} AS f_{k}" for k, v in _PF.items())} FROM v_metrics m JOIN (
        SELECT performance_id, CASE WHEN avg(sold) <> 0 THEN round(stddev_pop(sold) / avg(sold), 9) END AS cv FROM (
          SELECT performance_id, show_at, sum(CASE WHEN event_type = 'booking' THEN quantity ELSE -quantity END) AS sold
          FROM v_ticket GROUP BY performance_id, show_at) s GROUP BY performance_id) c ON m.performance_id = c.performance_id) f
    JOIN (SELECT kind, {_pf_bounds} FROM (SELECT m.*, {", ".join(f"{v} AS f_{k}" for k, v in _PF.items())} FROM v_metrics m JOIN (
        SELECT performance_id, CASE WHEN avg(sold) <> 0 THEN round(stddev_pop(sold) / avg(sold), 9) END AS cv FROM (
          SELECT performance_id, show_at, sum(CASE WHEN event_type = 'booking' THEN quantity ELSE -quantity END) AS sold
          FROM v_ticket GROUP BY performance_id, show_at) s GROUP BY performance_id) c ON m.performance_id = c.performance_id) f GROUP BY kind) b
    ON f.kind = b.kind) w) r) z""", "v_metrics")

O["region_eta2"] = query("""
SELECT s.kind, s.segment, count(*) AS n, count(DISTINCT region) AS "groups",
       round(sum((mu - m) * (mu - m)) / sum((dpi - m) * (dpi - m)), 6) AS eta2
FROM (SELECT *, avg(dpi) OVER (PARTITION BY kind, segment) AS m, avg(dpi) OVER (PARTITION BY kind, segment, region) AS mu FROM score_as_run) s
GROUP BY s.kind, s.segment""", "score_as_run")
O["region_rms"] = query("""
SELECT s.kind, s.segment, round(sqrt(avg((mu - m) * (mu - m))), 6) AS rms
FROM (SELECT *, avg(dpi) OVER (PARTITION BY kind, segment) AS m, avg(dpi) OVER (PARTITION BY kind, segment, region) AS mu FROM score_as_run) s
GROUP BY s.kind, s.segment""", "score_as_run")
O["region_adjust"] = query("""
SELECT performance_id, round(dpi - greatest(least(n / (n + 30.0) * (mu - m), 4.0), -4.0), 4) AS adjusted
FROM (SELECT *, avg(dpi) OVER (PARTITION BY kind, segment) AS m, avg(dpi) OVER (PARTITION BY kind, segment, region) AS mu,
             count(*) OVER (PARTITION BY kind, segment, region) AS n FROM score_as_run) s""", "score_as_run")
O["region_grid"] = query("""
SELECT kind, segment, cfg, k, cap, place, round(eta_pre, 6) AS eta_pre, round(eta_post, 6) AS eta_post, round(rms_pre, 6) AS rms_pre,
       round(rms_post, 6) AS rms_post, round(dist_p95, 6) AS dist_p95, round(dist_mean_abs, 6) AS dist_mean_abs,
       round(cap_saturation, 6) AS cap_saturation, round(spearman, 6) AS spearman, round(score, 4) AS score
FROM gscore_as_run""", "gscore_as_run")
O["region_grid_overlap"] = query("""
SELECT kind, segment, cfg, sum(CASE WHEN ra <= 10 AND rb <= 10 THEN 1 ELSE 0 END) / 10.0::double AS top_overlap FROM (
  SELECT kind, segment, cfg, row_number() OVER (PARTITION BY kind, segment, cfg ORDER BY round(y, 9) DESC, performance_id) AS ra,
         row_number() OVER (PARTITION BY kind, segment, cfg ORDER BY round(adj, 9) DESC, performance_id) AS rb FROM gadj_as_run) x GROUP BY kind, segment, cfg""", "gadj_as_run")
O["region_before_after"] = query("""
SELECT kind, segment, region, count(*) AS n, round(avg(dpi), 4) AS before, round(avg(adj), 4) AS "after"
FROM scored_as_run GROUP BY kind, segment, region""", "scored_as_run")
O["region_rank_pct"] = query(f"""
SELECT performance_id, region, round({pct_avg("dpi", "kind, segment, region")}, 6) AS pct FROM score_as_run""", "score_as_run")
O["spearman"] = query(f"""
SELECT kind, segment, round(corr(r0, r1), 6) AS adj, round(corr(r0, r2), 6) AS occ, round(corr(r0, r3), 6) AS sold FROM (
  SELECT kind, segment, {pct_avg("dpi", "kind, segment")} AS r0, {pct_avg("adj", "kind, segment")} AS r1,
         {pct_avg("occupancy", "kind, segment")} AS r2, {pct_avg("sold", "kind, segment")} AS r3
  FROM scored_as_run WHERE dpi IS NOT NULL) x GROUP BY kind, segment""", "scored_as_run")
O["topk_overlap"] = query("""
SELECT kind, segment, sum(CASE WHEN ra <= 10 AND rb <= 10 THEN 1 ELSE 0 END) / 10.0::double AS top_overlap FROM (
  SELECT kind, segment, row_number() OVER (PARTITION BY kind, segment ORDER BY round(dpi, 6) DESC NULLS LAST, performance_id) AS ra,
         row_number() OVER (PARTITION BY kind, segment ORDER BY round(adj, 6) DESC NULLS LAST, performance_id) AS rb
  FROM scored_as_run) x GROUP BY kind, segment""", "scored_as_run")
O["leaderboard"] = query("""
SELECT * FROM (SELECT kind, segment, performance_id, title, round(adj, 6) AS "DPI_region_adj", round(u, 6) AS "U_participation",
  round(s, 6) AS "S_scale", round(a, 6) AS "A_afford", row_number() OVER (PARTITION BY kind, segment ORDER BY round(adj, 6) DESC NULLS LAST,
  round(u, 6) DESC NULLS LAST, round(s, 6) DESC NULLS LAST, round(a, 6) DESC NULLS LAST, performance_id) AS place FROM scored_as_run) x
WHERE place <= 10""", "scored_as_run")
O["title_leaderboard"] = query("""
SELECT title, region, round(sum(adj * (sessions + 1e-9)) / sum(sessions + 1e-9), 4) AS dpi_wmean,
       round(sum(u * (sessions + 1e-9)) / sum(sessions + 1e-9), 6) AS u_wmean, cast(sum(sessions) AS bigint) AS sessions,
       round(quantile_cont(price, 0.5), 6) AS median_price
FROM scored_as_run GROUP BY title, region""", "scored_as_run")
