"""SQL of the queries on cells, people, the model, the graph and repeated runs."""

from __future__ import annotations

from stagelens.plans.oracle_parts import part, query

ORACLE_GRAPH: dict[str, str] = {}
O = ORACLE_GRAPH

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def strip(x: str) -> str:
    return _STRIP.format(x)


def clean(x: str) -> str:
    no_role = strip(rf"regexp_replace({x}, '\(.*?\)', '', 'g')")
    return strip(rf"regexp_replace({no_role}, '\s*(등|외|外)$', '', 'g')")


def legacy(x: str) -> str:
    return strip(rf"regexp_replace({x}, '\(.*?\)| 등| 외| 外', '', 'g')")


def _names(cleaner, source: str = "string_split({c}, ',')") -> str:
    return " UNION ALL ".join(
        f"SELECT performance_id, '{role}' AS role, {cleaner('x')} AS name FROM (SELECT performance_id, unnest({source.format(c=c)}) AS x FROM v_cells) s"
        for role, c in (("cast", "cast_txt"), ("crew", "crew_txt")))


part("v_names", f"SELECT * FROM ({_names(clean)}) n WHERE name <> ''", "v_cells")
part("v_events", """
SELECT l.performance_id, mid, broad, kind, yr, mid || '/' || cast(yr AS varchar) AS fine FROM v_label l JOIN v_performance p ON l.performance_id = p.performance_id""",
     "v_label", "v_performance")
part("v_people", """
SELECT o.performance_id, o.role, o.name, e.mid, e.broad, e.fine, e.kind, e.yr FROM v_occurrence o JOIN v_events e ON o.performance_id = e.performance_id
WHERE o.role <> 'org'""", "v_occurrence", "v_events")
part("v_orgs", r"""
SELECT DISTINCT performance_id, org, role FROM (
  SELECT performance_id, trim(regexp_replace(x, '\(([^)]*)\)\s*$', '')) AS org, coalesce(nullif(regexp_extract(trim(x), '\(([^)]*)\)\s*$', 1), ''), '미상') AS role
  FROM (SELECT performance_id, unnest(string_split(org_txt, ',')) AS x FROM v_cells WHERE org_txt <> '') s) y WHERE org <> ''""", "v_cells")

O["split_names"] = query("SELECT role, name, count(*) AS n FROM v_names GROUP BY role, name", "v_names")
O["split_names_twice"] = query(f"SELECT role, name, count(*) AS n FROM ({_names(lambda x: clean(clean(x)))}) s WHERE name <> '' GROUP BY role, name", "v_cells")
O["split_document_names"] = f"""
SELECT doc_id, cast(len(names) AS int) AS items, cast(len(list_distinct(names)) AS int) AS kinds, md5(array_to_string(names, '|')) AS digest
FROM (SELECT doc_id, list_filter(list_transform(string_split(text, ','), lambda x: {clean("x")}), lambda x: x <> '') AS names FROM documents) d"""
O["ghost_names"] = query(f"""
SELECT name, count(*) AS records FROM ({_names(legacy, "string_split(replace({c}, ' ', ''), ',')")}) w
WHERE name <> '' AND regexp_matches(name, '(?:등|외|外)$') AND name NOT IN (SELECT name FROM v_names) GROUP BY name""", "v_names")
O["org_roles"] = query("SELECT role, count(*) AS links, count(DISTINCT org) AS orgs FROM v_orgs GROUP BY role", "v_orgs")
O["multi_role_orgs"] = query("""
SELECT org, count(*) AS roles, string_agg(role, ', ' ORDER BY role) AS role_list FROM (SELECT DISTINCT org, role FROM v_orgs) x GROUP BY org HAVING count(*) > 1""", "v_orgs")
O["norm_genre"] = r"""
SELECT trim(regexp_replace(g, '\s*\(.*?\)', '', 'g')) AS genre, string_split(g, '(')[1] AS prefix, count(*) AS n
FROM (SELECT concat(p_type, ' (', p_brand, ') (x) ') AS g FROM part) x GROUP BY 1, 2"""
O["person_genre_score"] = query("""
SELECT name, mid AS genre, c AS count, round(c / cast(sum(c) OVER (PARTITION BY name) AS double), 6) AS score
FROM (SELECT name, mid, count(*) AS c FROM v_people GROUP BY name, mid) x""", "v_people")
O["person_lookup"] = query("SELECT name, mid, count(*) AS n FROM v_people WHERE name = 'red widget' GROUP BY name, mid", "v_people")
O["homonym_levels"] = query(" UNION ALL ".join(f"""
SELECT '{lv}' AS level, count(*) AS names, (SELECT count(DISTINCT {lv}) FROM v_people) AS genres, count(*) FILTER (WHERE g > 1) AS names_in_many, cast(sum(g) AS bigint) AS quasi_ids,
       round(avg((g > 1)::int), 6) AS share_in_many, round(avg(g), 6) AS mean_genres, round(avg(top), 6) AS mean_top_share
FROM (SELECT name, count(*) AS g, max(c) / cast(sum(c) AS double) AS top FROM (SELECT name, {lv}, count(*) AS c FROM v_people GROUP BY name, {lv}) y GROUP BY name) x"""
                                              for lv in ("broad", "mid", "fine")), "v_people")


def _dominant(where: str) -> str:
    return f"""SELECT name, mid, n, n_genres FROM (SELECT name, mid, count(*) AS n, count(*) OVER (PARTITION BY name) AS n_genres,
    row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, mid) AS rk FROM v_people WHERE {where} GROUP BY name, mid) x WHERE rk = 1"""


O["dominant_person"] = query(_dominant("kind = 'single'"), "v_people")
O["ambiguity_stats"] = query(f"""
SELECT count(DISTINCT p.name) AS names, count(DISTINCT CASE WHEN d.name IS NULL THEN p.name END) AS unseen,
       count(DISTINCT CASE WHEN d.n_genres = 1 THEN p.name END) AS one_genre, count(DISTINCT CASE WHEN d.n_genres > 1 THEN p.name END) AS ambiguous
FROM v_people p LEFT JOIN ({_dominant("kind = 'single' AND yr < 1997")}) d ON p.name = d.name WHERE p.kind = 'composite'""", "v_people")
O["resolved_people"] = query(f"""
SELECT p.name, coalesce(d.mid, 'composite') AS mid, d.mid IS NOT NULL AS resolved, count(*) AS links
FROM v_people p LEFT JOIN ({_dominant("kind = 'single'")}) d ON p.name = d.name WHERE p.kind = 'composite' GROUP BY ALL""", "v_people")
O["most_genres"] = query("""
SELECT name, count(*) AS genres, string_agg(fine, ', ' ORDER BY fine) AS genre_list FROM (SELECT DISTINCT name, fine FROM v_people) x
GROUP BY name ORDER BY count(*) DESC, name LIMIT 3""", "v_people")
O["name_collisions"] = query("""
SELECT count(*) AS names FROM (SELECT DISTINCT name FROM v_people) p JOIN (SELECT DISTINCT org FROM v_orgs) o ON o.org = p.name""", "v_people", "v_orgs")
O["dense_person_ids"] = query("""
SELECT name, mid, row_number() OVER (ORDER BY md5(concat_ws(chr(31), name, mid)), name, mid) AS person_id
FROM (SELECT DISTINCT name, mid FROM v_people WHERE kind = 'single') x""", "v_people")

part("links", f"""
SELECT n.performance_id, n.role, n.name, e.mid, e.kind FROM (SELECT DISTINCT performance_id, role, name FROM v_names) n JOIN v_events e ON n.performance_id = e.performance_id""", "v_names", "v_events")
part("resolved_links", """
SELECT performance_id, role, name, mid FROM links WHERE kind <> 'composite'
UNION ALL
SELECT l.performance_id, l.role, l.name, coalesce(d.mid, 'composite') FROM links l LEFT JOIN (
  SELECT name, mid FROM (SELECT name, mid, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, mid) AS rk FROM links WHERE kind <> 'composite' GROUP BY name, mid) x WHERE rk = 1) d
  ON l.name = d.name WHERE l.kind = 'composite'""", "links")


def _size(name: str, cols: int, sql: str) -> str:
    return f"SELECT '{name}' AS \"table\", n AS \"rows\", {cols} AS columns, n * {cols} AS cells FROM (SELECT count(*) AS n FROM ({sql}) q) z"


O["model_tables"] = query(" UNION ALL ".join([
    _size("facility", 2, "SELECT DISTINCT facility FROM v_performance WHERE performance_id IN (SELECT performance_id FROM v_ticket)"),
    _size("hall", 3, "SELECT DISTINCT facility, seats FROM v_performance WHERE performance_id IN (SELECT performance_id FROM v_ticket)"),
    _size("operator", 1, "SELECT DISTINCT l_suppkey FROM v_ticket"),
    _size("booking_channel", 1, "SELECT DISTINCT channel FROM v_ticket"),
    _size("payment_method", 1, "SELECT DISTINCT payment FROM v_ticket"),
    _size("discount_type", 1, "SELECT DISTINCT discount FROM v_ticket"),
    _size("genre", 2, "SELECT DISTINCT mid FROM v_events"),
    _size("subgenre", 3, "SELECT DISTINCT mid, fine FROM v_events"),
    _size("performance", 4, "SELECT performance_id FROM v_events"),
    _size("performance_genre", 5, "SELECT performance_id FROM v_events UNION ALL SELECT performance_id FROM v_prediction p JOIN (SELECT DISTINCT mid FROM v_events) g ON p.genre1 = g.mid WHERE run_id = 1 "
          "UNION ALL SELECT performance_id FROM v_prediction p JOIN (SELECT DISTINCT mid FROM v_events) g ON p.genre2 = g.mid WHERE run_id = 1"),
    _size("show_session", 3, "SELECT DISTINCT performance_id, show_at FROM v_ticket"),
    _size("person", 3, "SELECT DISTINCT name, mid FROM resolved_links"),
    _size("performance_person", 3, "SELECT DISTINCT performance_id, name, mid, role FROM resolved_links"),
    _size("organization", 2, "SELECT DISTINCT org FROM v_orgs"),
    _size("performance_org", 3, "SELECT DISTINCT performance_id, org, role FROM v_orgs"),
    _size("ticket_event", 10, "SELECT ticket_no FROM v_ticket"),
]), "v_events", "v_prediction", "resolved_links", "v_orgs")
# rows of each rule; the tables break none
_RULES = [
    ("facility", "key (facility)"), ("hall", "key (facility, seats)"), ("genre", "key (genre_id)"), ("genre", "key (genre)"),
    ("subgenre", "key (subgenre_id)"), ("subgenre", "key (genre_id, subgenre)"), ("performance", "key (performance_id)"),
    ("show_session", "key (session_id)"), ("show_session", "key (performance_id, show_at)"), ("person", "key (person_id)"),
    ("person", "key (name, genre)"), ("organization", "key (org_id)"), ("organization", "key (org)"),
    ("performance_person", "key (performance_id, person_id, role)"), ("performance_org", "key (performance_id, org_id, role)"),
    ("hall", "(facility) in facility (facility)"), ("subgenre", "(genre_id) in genre (genre_id)"),
    ("performance", "(genre_id) in genre (genre_id)"), ("performance", "(subgenre_id) in subgenre (subgenre_id)"),
    ("performance_genre", "(genre_id) in genre (genre_id)"), ("performance_genre", "(performance_id) in performance (performance_id)"),
    ("person", "(genre) in genre (genre)"), ("performance_person", "(person_id) in person (person_id)"),
    ("performance_org", "(org_id) in organization (org_id)"), ("ticket_event", "(session_id) in show_session (session_id)"),
    ("ticket_event", "(channel) in booking_channel (channel)"),
]
O["model_integrity"] = f"""SELECT r."table", r.rule, m."rows", 0::bigint AS broken FROM ({O["model_tables"]}) m
JOIN (VALUES {", ".join(f"('{t}', '{r}')" for t, r in _RULES)}) r("table", rule) ON m."table" = r."table\""""
_IN_GENRE = "(genre_id) in genre (genre_id)"
_GONE = "(SELECT min(mid) FROM v_events)"
O["model_integrity_damaged"] = query(f"""
SELECT 'subgenre' AS "table", '{_IN_GENRE}' AS rule, count(*) AS broken FROM (SELECT DISTINCT mid, fine FROM v_events WHERE mid = {_GONE}) x
UNION ALL SELECT 'performance', '{_IN_GENRE}', count(*) FROM v_events WHERE mid = {_GONE}
UNION ALL SELECT 'performance_genre', '{_IN_GENRE}', (SELECT count(*) FROM v_events WHERE mid = {_GONE})
  + (SELECT count(*) FILTER (genre1 = {_GONE}) + count(*) FILTER (genre2 = {_GONE}) FROM v_prediction WHERE run_id = 1)
UNION ALL SELECT 'person', '(genre) in genre (genre)', count(*) FROM (SELECT DISTINCT name, mid FROM resolved_links WHERE mid = {_GONE}) x
UNION ALL SELECT 'ticket_event', '(session_id) in show_session (session_id)', count(*)
FROM v_ticket t JOIN (SELECT performance_id, min(show_at) AS show_at FROM v_ticket GROUP BY performance_id) f
ON t.performance_id = f.performance_id AND t.show_at = f.show_at""", "v_events", "v_prediction", "resolved_links", "v_ticket")
O["performance_genres"] = query("""
SELECT v.performance_id, v.genre1 AS "first", v.p1 AS p_first, v.genre2 AS "second", v.p2 AS p_second, p.title
FROM v_prediction v JOIN v_performance p ON v.performance_id = p.performance_id
WHERE run_id = 1 AND kind = 'composite' AND v.genre2 IS NOT NULL ORDER BY v.p2 DESC, v.performance_id LIMIT 5""", "v_prediction", "v_performance")
O["prediction_catalog"] = query("""
SELECT 'raw' AS source, count(*) AS n, count(*) AS ids, 0 AS regions, 0 AS seats FROM v_performance
UNION ALL SELECT 'single', count(*), 0, count(region), 0 FROM v_performance WHERE kind = 'single'
UNION ALL SELECT 'composite', count(*), 0, count(region), count(seats) FROM v_performance WHERE kind = 'composite'""", "v_performance")
O["prediction_link_rate"] = query("""
SELECT kind, count(*) AS catalogue, count(carried) AS linked, count(*) FILTER (WHERE carried = title) AS titles_match,
       round(count(*) FILTER (WHERE carried = title) / cast(count(*) AS double), 6) AS match_rate
FROM (SELECT p.*, CASE WHEN v.performance_id IS NULL THEN NULL WHEN p.performance_id % 3 = 0 THEN min(title) OVER (PARTITION BY yr, kind) ELSE title END AS carried
      FROM v_performance p LEFT JOIN (SELECT performance_id FROM v_prediction WHERE run_id = 1 AND p1 > 0.5) v ON p.performance_id = v.performance_id) x
GROUP BY kind""", "v_performance", "v_prediction")
O["csv_by_year"] = query("SELECT kind, cast(yr AS int) AS yr, count(*) AS n, count(seats) AS seats, cast(sum(performance_id) AS bigint) AS id_sum FROM v_performance GROUP BY kind, yr", "v_performance")
O["ranked_sink"] = query("""
SELECT segment, performance_id, row_number() OVER (PARTITION BY segment ORDER BY round(adj, 6) DESC NULLS LAST, round(u, 6) DESC NULLS LAST, performance_id) AS place
FROM scored_as_run""", "scored_as_run")
O["audit_segments"] = query("""
SELECT s.segment, CASE WHEN coalesce(m.price, 0) = 0 AND coalesce(m.rev_per_session, 0) = 0 AND m.performance_id % 2 = 0 THEN 'Free' ELSE 'Paid' END AS spelled, count(*) AS n
FROM score_as_run s JOIN v_metrics m ON s.performance_id = m.performance_id GROUP BY 1, 2""", "score_as_run", "v_metrics")

# ---------------------------------------------------------------- graph

part("v_edge", """
SELECT performance_id, CASE WHEN role = 'org' THEN 'org:' ELSE 'person:' END || name AS node, name AS term, cast(sum(times) AS bigint) AS tf
FROM v_occurrence GROUP BY ALL""", "v_occurrence")


def _tfidf(term: str) -> str:
    return f"""
SELECT e.performance_id, e.node, e.tf, coalesce(e.tf * w.w, 0) AS weight FROM v_edge e LEFT JOIN (
  SELECT performance_id, t, raw / sqrt(sum(raw * raw) OVER (PARTITION BY performance_id)) AS w FROM (
    SELECT a.performance_id, a.t, a.tf * (ln((1.0::double + (SELECT count(DISTINCT performance_id) FROM v_edge)) / (1 + d.df)) + 1) AS raw
    FROM (SELECT performance_id, {term} AS t, sum(tf) AS tf FROM v_edge GROUP BY ALL) a
    JOIN (SELECT {term} AS t, count(DISTINCT performance_id) AS df FROM v_edge GROUP BY 1) d ON a.t = d.t) x) w
ON e.performance_id = w.performance_id AND e.term = w.t"""


part("v_weight", _tfidf("term"), "v_edge")
O["edge_tfidf"] = query("SELECT performance_id, node, tf, round(weight, 6) AS weight FROM v_weight", "v_weight")
O["edge_tfidf_lower"] = query(f"SELECT performance_id, count(*) FILTER (WHERE weight = 0) AS zero, round(sum(weight), 6) AS weight FROM ({_tfidf('lower(term)')}) x GROUP BY performance_id", "v_edge")
O["edge_view"] = query("""
SELECT relation, count(*) AS edges, count(DISTINCT target) AS targets FROM (
  SELECT DISTINCT performance_id, name AS target, 'has_' || role AS relation FROM v_people
  UNION ALL SELECT DISTINCT performance_id, name, 'by_org' FROM v_occurrence WHERE role = 'org'
  UNION ALL SELECT performance_id, mid, 'labeled_as' FROM v_events WHERE kind = 'single') x GROUP BY relation""", "v_people", "v_occurrence", "v_events")
part("v_graph", """
SELECT src, dst, sum(weight) AS weight FROM (
  SELECT 'performance:' || performance_id AS src, node AS dst, weight FROM v_weight
  UNION ALL SELECT node, 'performance:' || performance_id, weight FROM v_weight) x GROUP BY src, dst
UNION ALL
SELECT DISTINCT 'performance:' || performance_id AS s, s, 1.0::double FROM v_weight
UNION ALL SELECT DISTINCT node AS s, s, 1.0::double FROM v_weight""", "v_weight")
O["undirected_edges"] = query("SELECT src, dst, round(weight, 6) AS weight FROM v_graph", "v_graph")
O["node_types"] = query("""
SELECT string_split(key, ':')[1] AS type, count(*) AS n, min(node_id) AS first_id, max(node_id) AS last_id FROM (
  SELECT key, row_number() OVER (ORDER BY md5(key), key) AS node_id FROM (
    SELECT node AS key FROM v_weight UNION SELECT 'performance:' || performance_id FROM v_events UNION SELECT 'genre:' || mid FROM v_events) x) y GROUP BY 1""", "v_weight", "v_events")
O["node_features"] = query("""
SELECT is_performance, is_person, is_org, count(*) AS n FROM (
  SELECT DISTINCT node, 0 AS is_performance, (node LIKE 'person:%')::int AS is_person, (node LIKE 'org:%')::int AS is_org FROM v_weight
  UNION ALL SELECT 'performance:' || performance_id, 1, 0, 0 FROM v_events) x GROUP BY ALL""", "v_weight", "v_events")
O["graph_census"] = query("""
SELECT 'nodes_' || string_split(node, ':')[1] AS item, count(DISTINCT node) AS n FROM v_weight GROUP BY 1
UNION ALL SELECT 'nodes_performance', count(*) FROM v_performance
UNION ALL SELECT 'edges', count(*) FROM v_weight
UNION ALL SELECT 'zero_weight', count(*) FROM v_weight WHERE weight = 0
UNION ALL SELECT 'isolated_' || kind, count(*) FILTER (WHERE performance_id NOT IN (SELECT performance_id FROM v_weight)) FROM v_performance GROUP BY kind""", "v_weight", "v_performance")
part("v_split", """
SELECT performance_id, mid AS genre, cast('0x' || substr(md5(cast(performance_id AS varchar)), 1, 8) AS bigint) % 100 < 80 AS train FROM v_events WHERE kind = 'single'""", "v_events")
O["holdout_edge_cut"] = query("""
SELECT string_split(node, ':')[1] AS type, count(*) AS edges, count(DISTINCT performance_id) AS events FROM v_weight
WHERE performance_id NOT IN (SELECT performance_id FROM v_split WHERE NOT train) GROUP BY 1""", "v_weight", "v_split")


def _vote(edge: str, voting: str = "", w: str = "tf", genre_weight: str = "") -> str:
    return f"""
SELECT s.performance_id, coalesce(g1, (SELECT genre FROM v_split WHERE train GROUP BY genre ORDER BY count(*) DESC, genre LIMIT 1)) AS genre1, g2 AS genre2, g1 IS NOT NULL AS voted
FROM (SELECT performance_id FROM v_split WHERE NOT train) s LEFT JOIN (
  SELECT performance_id, max(CASE WHEN rk = 1 THEN genre END) AS g1, max(CASE WHEN rk = 2 THEN genre END) AS g2 FROM (
    SELECT performance_id, genre, row_number() OVER (PARTITION BY performance_id ORDER BY round(sum(votes), 6) DESC, genre) AS rk FROM (
      SELECT e.performance_id, h.genre, e.{w} * h.votes AS votes FROM {edge} e
      JOIN (SELECT node, b.genre, sum({w}) {genre_weight} AS votes FROM {voting or edge} a JOIN v_split b ON a.performance_id = b.performance_id AND b.train GROUP BY node, b.genre) h ON e.node = h.node
      WHERE e.performance_id IN (SELECT performance_id FROM v_split WHERE NOT train)) x GROUP BY performance_id, genre) y GROUP BY performance_id) v
ON s.performance_id = v.performance_id"""


part("v_vote", _vote("v_weight"), "v_weight", "v_split")
O["genre_vote"] = query("SELECT performance_id, genre1, genre2, voted FROM v_vote", "v_vote")
O["vote_accuracy"] = query("""
SELECT voted, count(*) AS n, round(avg((genre1 = genre)::int), 6) AS top1_acc, round(avg((genre1 = genre OR coalesce(genre2 = genre, false))::int), 6) AS top2_acc
FROM v_split s JOIN v_vote v ON s.performance_id = v.performance_id WHERE NOT train GROUP BY voted""", "v_vote", "v_split")
O["class_weights"] = query("""
SELECT genre, count(*) AS c, round((sum(count(*)) OVER () - count(*)) / (count(*) + 1e-6), 6) AS pos_weight, round(cast(sum(count(*)) OVER () AS double) / count(*), 6) AS inverse_share
FROM v_split WHERE train GROUP BY genre""", "v_split")
part("v_degree", "SELECT dst AS node, sqrt(sum(weight)) AS root FROM v_graph GROUP BY dst", "v_graph")
part("hop1", """
SELECT g.dst AS node, l.genre, sum(g.weight / a.root) / max(b.root) AS value FROM v_graph g
JOIN (SELECT 'performance:' || performance_id AS node, genre FROM v_split WHERE train) l ON g.src = l.node
JOIN v_degree a ON a.node = g.src JOIN v_degree b ON b.node = g.dst GROUP BY g.dst, l.genre""", "v_graph", "v_degree", "v_split")
part("hop2", """
SELECT g.dst AS node, l.genre, sum(g.weight * l.value / a.root) / max(b.root) AS value FROM v_graph g JOIN hop1 l ON g.src = l.node
JOIN v_degree a ON a.node = g.src JOIN v_degree b ON b.node = g.dst GROUP BY g.dst, l.genre""", "v_graph", "v_degree", "hop1")
O["propagate_1hop"] = query("SELECT node, genre, round(value, 8) AS value FROM hop1", "hop1")
O["propagate_2hop"] = query("SELECT node, genre, round(value, 8) AS value FROM hop2", "hop2")
part("shares", "SELECT node, genre, round(value / sum(value) OVER (PARTITION BY node), 8) AS p FROM hop2 WHERE node LIKE 'performance:%'", "hop2")
O["propagated_top2"] = query("""
SELECT node, max(CASE WHEN rk = 1 THEN genre END) AS genre1, max(CASE WHEN rk = 2 THEN genre END) AS genre2, round(max(CASE WHEN rk = 1 THEN p END), 5) AS p1,
       round(max(CASE WHEN rk = 2 THEN p END), 5) AS p2,
       least(max(CASE WHEN rk = 1 THEN genre END), max(CASE WHEN rk = 2 THEN genre END)) || '+' || greatest(max(CASE WHEN rk = 1 THEN genre END), max(CASE WHEN rk = 2 THEN genre END)) AS pair
FROM (SELECT s.*, row_number() OVER (PARTITION BY node ORDER BY p DESC, genre) AS rk FROM shares s
      WHERE node IN (SELECT 'performance:' || performance_id FROM v_events WHERE kind = 'composite')) x GROUP BY node""", "shares", "v_events")


def _metrics(truth: str, probs: str, key: str) -> str:
    return f"""
SELECT n, classes, top1_acc, top2_acc, subset_acc, round(2.0 * tp / (2 * tp + fp + fn), 6) AS micro_f1, macro_f1, weighted_f1,
       round(1 - (fp + fn) / cast(n * classes AS double), 6) AS hamming_acc
FROM (SELECT count(*) AS n, round(avg(t1), 6) AS top1_acc, round(avg(t2), 6) AS top2_acc, round(avg(sub), 6) AS subset_acc FROM (
        SELECT t.{key}, coalesce(max((p.genre = t.genre AND p.rk = 1)::int), 0) AS t1, coalesce(max((p.genre = t.genre AND p.rk <= 2)::int), 0) AS t2,
               (count(*) FILTER (WHERE p.p > 0.5 AND p.genre = t.genre) = 1 AND count(*) FILTER (WHERE p.p > 0.5 AND p.genre <> t.genre) = 0)::int AS sub
        FROM ({truth}) t LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY p DESC, genre) AS rk FROM ({probs}) z) p ON t.{key} = p.{key} GROUP BY t.{key}) a) b
CROSS JOIN (SELECT count(*) AS classes, cast(sum(tp) AS double) AS tp, cast(sum(fp) AS double) AS fp, cast(sum(fn) AS double) AS fn,
        round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1
      FROM (SELECT *, coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM (
        SELECT coalesce(s.genre, c.genre) AS genre, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(support, 0) - coalesce(tp, 0) AS fn
        FROM (SELECT genre, count(*) AS support FROM ({truth}) t GROUP BY genre) s FULL JOIN (
          SELECT p.genre, count(*) FILTER (WHERE p.genre = t.genre) AS tp, count(*) FILTER (WHERE p.genre <> t.genre) AS fp
          FROM ({probs}) p JOIN ({truth}) t ON p.{key} = t.{key} WHERE p.p > 0.5 GROUP BY p.genre) c ON s.genre = c.genre) d) e) f"""


O["holdout_metrics"] = query(_metrics("SELECT 'performance:' || performance_id AS node, genre FROM v_split WHERE NOT train", "SELECT node, genre, p FROM shares", "node"), "shares", "v_split")
O["multilabel_metrics"] = query(_metrics(
    "SELECT performance_id, mid AS genre FROM v_label",
    "SELECT performance_id, genre, round(qty / cast(sum(qty) OVER (PARTITION BY performance_id) AS double), 8) AS p FROM v_line_genre", "performance_id"), "v_label", "v_line_genre")
O["per_class_accuracy"] = query("""
SELECT mid AS genre, count(*) AS n, round(avg((genre1 = mid)::int), 6) AS top1_acc, round(avg((genre1 = mid OR coalesce(genre2 = mid, false))::int), 6) AS top2_acc
FROM v_label l JOIN v_prediction p ON l.performance_id = p.performance_id AND p.run_id = 2 GROUP BY mid""", "v_label", "v_prediction")

# ---------------------------------------------------------------- runs

part("v_pairs", """
SELECT *, CASE WHEN genre2 IS NOT NULL THEN least(genre1, genre2) || '+' || greatest(genre1, genre2) END AS pair, concat_ws('+', genre1, genre2) AS shown FROM v_prediction""", "v_prediction")
O["top2_pairs"] = query("SELECT * FROM v_pairs", "v_pairs")
O["run_agreement"] = query("""
SELECT a.run_id AS run_a, b.run_id AS run_b, count(*) AS n, round(avg((a.genre1 = b.genre1)::int), 6) AS first_agreement, round(avg((a.pair IS NOT DISTINCT FROM b.pair)::int), 6) AS pair_agreement
FROM v_pairs a JOIN v_pairs b ON a.performance_id = b.performance_id AND a.run_id < b.run_id GROUP BY a.run_id, b.run_id""", "v_pairs")
O["saved_agreement"] = query("""
SELECT count(*) AS n, round(avg((a.genre1 = b.genre1)::int), 6) AS same_first, round(avg((a.pair IS NOT DISTINCT FROM b.pair)::int), 6) AS same_pair
FROM v_pairs a JOIN v_pairs b ON a.performance_id = b.performance_id AND a.run_id = 1 AND b.run_id = 3""", "v_pairs")
_MIXED = "(SELECT * FROM v_prediction WHERE run_id = 1 AND performance_id IN (SELECT performance_id FROM v_performance WHERE kind = 'composite'))"
O["second_probability"] = query(" UNION ALL ".join(
    f"SELECT count(*) AS n, {t}::double AS threshold, count(*) FILTER (WHERE p2 >= {t}) AS reached FROM {_MIXED} m" for t in (0.5, 0.3, 0.1)), "v_prediction", "v_performance")
O["second_probability_summary"] = query(f"""
SELECT count(*) AS n, count(*) FILTER (WHERE p1 < 0.5) AS weak_first,
       count(*) FILTER (WHERE performance_id NOT IN (SELECT performance_id FROM v_occurrence WHERE role <> 'org')) AS nobody,
       round(quantile_cont(p2, 0.5), 9) AS median_p2 FROM {_MIXED} m""", "v_prediction", "v_performance", "v_occurrence")
O["accuracy_by_participants"] = query("""
SELECT participants, count(*) AS n, round(avg((genre1 = genre)::int), 6) AS top1_acc, round(avg((genre1 = genre OR coalesce(genre2 = genre, false))::int), 6) AS top2_acc
FROM (SELECT s.genre, v.genre1, v.genre2, s.performance_id IN (
        SELECT o.performance_id FROM v_occurrence o WHERE role = 'crew' AND name IN (
          SELECT t.name FROM v_occurrence t JOIN v_split b ON t.performance_id = b.performance_id AND b.train WHERE t.role = 'crew')) AS participants
      FROM v_split s JOIN v_vote v ON s.performance_id = v.performance_id WHERE NOT s.train) x GROUP BY participants""", "v_split", "v_vote", "v_occurrence")
part("v_consensus", """
SELECT performance_id, count(DISTINCT genre1) = 1 AS main_stable, count(DISTINCT coalesce(pair, '')) = 1 AS pair_stable, min(pair) AS pair, min(p2) AS min_p2, avg(p2) AS mean_p2
FROM v_pairs GROUP BY performance_id""", "v_pairs")


def _class(tau: str) -> str:
    return f"CASE WHEN pair_stable AND coalesce(min_p2 >= {tau}, false) THEN 'pair fixed' WHEN main_stable THEN 'main fixed' ELSE 'undecided' END"


O["consensus_class"] = query(f"""
SELECT performance_id, main_stable, pair_stable, round(min_p2, 6) AS min_p2, round(mean_p2, 9) AS mean_p2, {_class("0.3")} AS class FROM v_consensus""", "v_consensus")
_TAUS = "(VALUES (0.0::double), (0.1::double), (0.3::double), (0.5::double)) t(tau)"
O["threshold_sweep"] = query(f"""
SELECT tau, count(*) FILTER (WHERE c = 'pair fixed') AS pair_fixed, count(*) FILTER (WHERE c = 'main fixed') AS main_fixed, count(*) FILTER (WHERE c = 'undecided') AS undecided,
       round(count(*) FILTER (WHERE c = 'pair fixed') / cast(count(*) AS double), 6) AS pair_share
FROM (SELECT tau, {_class("tau")} AS c FROM v_consensus CROSS JOIN {_TAUS}) x GROUP BY tau""", "v_consensus")
O["confident_success"] = query(f"""
SELECT tau, segment, count(*) AS "rows", count(*) FILTER (WHERE ok) AS successes, round(100.0 * count(*) FILTER (WHERE ok) / count(*), 4) AS rate, cast(sum(n) AS bigint) AS events,
       count(*) FILTER (WHERE n >= 5) AS rows_min_n
FROM (SELECT c.*, c.dpi >= (a.dpi + b.dpi) / 2 AS ok FROM (
        SELECT tau, segment, size, v.pair, string_split(v.pair, '+')[1] AS g1, string_split(v.pair, '+')[2] AS g2, count(*) AS n, avg(dpi) AS dpi
        FROM events_as_run e JOIN v_consensus v ON e.performance_id = v.performance_id CROSS JOIN {_TAUS}
        WHERE kind = 'composite' AND pair_stable AND v.pair IS NOT NULL AND min_p2 >= tau GROUP BY ALL) c
      JOIN (SELECT segment, size, genre, avg(dpi) AS dpi FROM events_as_run WHERE kind = 'single' GROUP BY ALL) a ON a.segment = c.segment AND a.size = c.size AND a.genre = c.g1
      JOIN (SELECT segment, size, genre, avg(dpi) AS dpi FROM events_as_run WHERE kind = 'single' GROUP BY ALL) b ON b.segment = c.segment AND b.size = c.size AND b.genre = c.g2) x
WHERE ok IS NOT NULL GROUP BY tau, segment""", "events_as_run", "v_consensus")
O["confident_means"] = query(f"""
SELECT segment, class, count(*) AS n, round(avg(dpi), 5) AS mean FROM events_as_run e LEFT JOIN (SELECT performance_id, {_class("0.3")} AS class FROM v_consensus) c
ON e.performance_id = c.performance_id WHERE kind = 'composite' GROUP BY segment, class""", "events_as_run", "v_consensus")

part("e0", "SELECT performance_id, role || ':' || name AS node, cast(sum(times) AS bigint) AS tf FROM v_occurrence WHERE role <> 'org' GROUP BY ALL", "v_occurrence")
part("e1", "SELECT performance_id, 'person:' || name AS node, cast(sum(times) AS bigint) AS tf FROM v_occurrence WHERE role <> 'org' GROUP BY ALL", "v_occurrence")
part("v_pos_weight", """
SELECT genre, (sum(count(*)) OVER () - count(*)) / (count(*) + 1e-6) AS pos_weight FROM v_split WHERE train GROUP BY genre""", "v_split")
_GENRE_WEIGHT = "* max((SELECT g.pos_weight FROM v_pos_weight g WHERE g.genre = b.genre))"


_SEEDS = "(VALUES (42), (7)) seeds(seed)"
_BOTH = "(VALUES ('kept'), ('cut')) protocols(protocol)"
part("v_splits", """
SELECT 42 AS seed, performance_id, genre, train FROM v_split
UNION ALL SELECT 7, performance_id, genre, cast('0x' || substr(md5(cast(performance_id AS varchar) || chr(31) || '7'), 1, 8) AS bigint) % 100 < 80 FROM v_split""", "v_split")
part("a_edges", """
SELECT 0 AS config, performance_id, node, tf::double AS w FROM e0 UNION ALL SELECT 1, performance_id, node, tf::double FROM e1
UNION ALL SELECT 2, performance_id, node, tf::double FROM v_weight UNION ALL SELECT 3, performance_id, node, weight FROM v_weight
UNION ALL SELECT 4, performance_id, node, weight FROM v_weight""", "e0", "e1", "v_weight")
part("a_pos", """
SELECT seed, genre, (sum(count(*)) OVER (PARTITION BY seed) - count(*)) / (count(*) + 1e-6) AS pw FROM v_splits WHERE train GROUP BY seed, genre""", "v_splits")
part("a_hist", """
SELECT config, h.seed, node, h.genre, votes * CASE WHEN config = 4 THEN pw ELSE 1 END AS votes
FROM (SELECT e.config, s.seed, e.node, s.genre, sum(e.w) AS votes FROM a_edges e JOIN v_splits s ON e.performance_id = s.performance_id AND s.train GROUP BY ALL) h
JOIN a_pos p ON p.seed = h.seed AND p.genre = h.genre""", "a_edges", "v_splits", "a_pos")
part("a_asked", f"""
SELECT e.*, coalesce(NOT t.train, false) AS held FROM (SELECT * FROM a_edges, {_SEEDS}) e
LEFT JOIN v_splits t ON t.seed = e.seed AND t.performance_id = e.performance_id WHERE t.train IS DISTINCT FROM true""", "a_edges", "v_splits")
part("a_votes", """
SELECT a.config, a.seed, a.performance_id, h.genre, a.held, round(sum(a.w * h.votes), 6) AS votes
FROM a_asked a JOIN a_hist h ON a.config = h.config AND a.seed = h.seed AND a.node = h.node GROUP BY ALL""", "a_asked", "a_hist")
part("a_values", f"""
SELECT protocol, seed, performance_id, genre, 1.0::double AS value FROM v_splits, {_BOTH} WHERE train
UNION ALL SELECT protocol, seed, performance_id, genre, value
FROM (SELECT *, votes / nullif(sum(votes) OVER (PARTITION BY seed, performance_id), 0) AS value FROM a_votes WHERE config = 4) x, {_BOTH} WHERE protocol = 'kept' OR NOT held""",
     "v_splits", "a_votes")
part("a_second", """
SELECT h.protocol, h.seed, h.node, h.genre, h.votes * pw AS votes
FROM (SELECT v.protocol, v.seed, e.node, v.genre, sum(e.w * v.value) AS votes FROM a_edges e JOIN a_values v ON e.config = 4 AND e.performance_id = v.performance_id GROUP BY ALL) h
JOIN a_pos p ON p.seed = h.seed AND p.genre = h.genre""", "a_edges", "a_values", "a_pos")
part("a_cases", f"""
SELECT config, protocol, seed, performance_id, genre, votes FROM a_votes, {_BOTH} WHERE held
UNION ALL SELECT 5, h.protocol, a.seed, a.performance_id, h.genre, round(sum(a.w * h.votes), 6)
FROM a_asked a JOIN a_second h ON a.config = 4 AND a.held AND a.seed = h.seed AND a.node = h.node GROUP BY ALL""", "a_votes", "a_asked", "a_second")
part("a_said", f"""
SELECT t.config, t.protocol, t.seed, t.genre, coalesce(g1, major) AS genre1, g2 AS genre2
FROM (SELECT config, protocol, s.* FROM v_splits s, range(0, 6) c(config), {_BOTH} WHERE NOT train) t
JOIN (SELECT seed, arg_min(genre, (-n, genre)) AS major FROM (SELECT seed, genre, count(*) AS n FROM v_splits WHERE train GROUP BY ALL) m GROUP BY seed) f ON f.seed = t.seed
LEFT JOIN (SELECT config, protocol, seed, performance_id, max(genre) FILTER (rk = 1) AS g1, max(genre) FILTER (rk = 2) AS g2
           FROM (SELECT *, row_number() OVER (PARTITION BY config, protocol, seed, performance_id ORDER BY votes DESC, genre) AS rk FROM a_cases) r GROUP BY ALL) v
ON v.config = t.config AND v.protocol = t.protocol AND v.seed = t.seed AND v.performance_id = t.performance_id""", "v_splits", "a_cases")
part("a_figures", """
SELECT a.*, macro_f1 FROM (
  SELECT config, protocol, seed, avg((genre1 = genre)::int) AS top1_acc, avg((genre1 = genre OR coalesce(genre2 = genre, false))::int) AS top2_acc FROM a_said GROUP BY ALL) a
JOIN (SELECT config, protocol, seed, avg(2.0::double * tp / n) AS macro_f1 FROM (
        SELECT config, protocol, seed, c, sum(tp) AS tp, sum(n) AS n FROM (
          SELECT config, protocol, seed, genre AS c, (genre = genre1)::int AS tp, 1 AS n FROM a_said
          UNION ALL SELECT config, protocol, seed, genre1, 0, 1 FROM a_said) x GROUP BY ALL) y GROUP BY ALL) f
ON f.config = a.config AND f.protocol = a.protocol AND f.seed = a.seed""", "a_said")
part("a_means", "SELECT config, protocol, count(*) AS runs, " + ", ".join(
    f"avg({n}) AS {n}, min({n}) AS {n}_lo, max({n}) AS {n}_hi" for n in ("top1_acc", "top2_acc", "macro_f1")) + " FROM a_figures GROUP BY ALL", "a_figures")
_STEP = "['0 roles apart', '1 + one person', '2 + orgs', '3 + edge weights', '4 + genre weights', '5 + second round'][m.config + 1] AS step"
O["ablation"] = query(f"""
SELECT {_STEP}, protocol, nodes, edges, runs, {", ".join(f"round({n}{end}, 6) AS {n}{end}" for n in ("top1_acc", "top2_acc", "macro_f1") for end in ("", "_lo", "_hi"))},
       round(top1_acc - lag(top1_acc) OVER (PARTITION BY protocol ORDER BY m.config), 6) AS change
FROM a_means m JOIN (SELECT config, count(DISTINCT node) AS nodes, count(*) AS edges FROM a_edges GROUP BY config) s ON s.config = least(m.config, 4)""", "a_means", "a_edges")
O["ablation_pivot"] = query(f"""
SELECT {_STEP}, round(kept, 6) AS kept, round(cut, 6) AS cut, round(kept - cut, 6) AS difference,
       round(kept - lag(kept) OVER (ORDER BY m.config), 6) AS kept_change, round(cut - lag(cut) OVER (ORDER BY m.config), 6) AS cut_change
FROM (SELECT config, max(top1_acc) FILTER (protocol = 'kept') AS kept, max(top1_acc) FILTER (protocol = 'cut') AS cut FROM a_means GROUP BY config) m""", "a_means")

O["model_facilities"] = query("SELECT facility, min(region) AS region FROM v_performance p WHERE performance_id IN (SELECT performance_id FROM v_ticket) GROUP BY facility", "v_performance", "v_ticket")
O["model_performances"] = query("""
SELECT e.performance_id, p.kind, e.mid AS genre, e.mid || '/' || cast(p.yr AS varchar) AS subgenre
FROM v_label e JOIN v_performance p ON e.performance_id = p.performance_id""", "v_label", "v_performance")
O["model_org_bridge"] = query("""
SELECT org, role, count(*) AS links FROM (
  SELECT DISTINCT performance_id, trim(regexp_replace(x, '\\(.*', '')) AS org, coalesce(nullif(regexp_extract(x, '\\(([^)]*)\\)', 1), ''), '미상') AS role
  FROM (SELECT performance_id, unnest(string_split(org_txt, ',')) AS x FROM v_cells) c) b WHERE org <> '' GROUP BY org, role""", "v_cells")
O["model_sessions"] = query("""
SELECT performance_id, count(*) AS tickets, count(DISTINCT show_at) AS sessions, round(cast(sum(amount) AS double), 2) AS amount FROM v_ticket GROUP BY performance_id""", "v_ticket")
O["csv_roundtrip"] = r"""SELECT doc_id, source, md5(text || chr(13) || chr(10) || '\n \\n\' || chr(10) || ' ' || chr(13) || ' \r\\' || doc_id) AS digest FROM documents"""
O["encoding_by_data"] = "SELECT c_custkey::bigint AS custkey, '관객 ' || c_name AS name, false AS damaged FROM customer"
O["encoding_fallback"] = "SELECT c_custkey::bigint AS custkey, '관객 ' || c_name AS name, false AS damaged FROM customer"
O["json_sink"] = query("SELECT region, count(*) AS n, cast(sum(sold) AS bigint) AS sold FROM v_metrics GROUP BY region", "v_metrics")
O["table_sink"] = query("SELECT region, count(*) AS n, cast(sum(sessions) AS bigint) AS sessions FROM v_metrics WHERE kind = 'composite' GROUP BY region", "v_metrics")
part("u_e", """SELECT performance_id, CASE WHEN seats > 20 THEN title END AS title, yr FROM v_performance""", "v_performance")
part("u_l", "SELECT e.title, any_value(p.genre1) AS genre1 FROM u_e e JOIN v_prediction p ON e.performance_id = p.performance_id AND p.run_id = 1 WHERE e.yr < 1998 GROUP BY e.title HAVING count(*) = 1", "u_e", "v_prediction")
O["unique_title_join"] = query("""
SELECT e.performance_id, e.title, l.genre1 FROM u_e e
LEFT JOIN (SELECT l.* FROM u_l l JOIN (SELECT title FROM u_e GROUP BY title HAVING count(*) = 1) u ON l.title IS NOT DISTINCT FROM u.title) l
ON e.title IS NOT DISTINCT FROM l.title""", "u_e", "u_l")
O["known_anywhere"] = query("""
SELECT CASE kind WHEN 'composite' THEN 'C' ELSE 'S' END AS code, count(*) AS n, count(a) AS a, count(b) AS b
FROM (SELECT kind, CASE WHEN sold <> 0 THEN revenue / sold END AS a, CASE WHEN seats > 500 THEN occupancy END AS b FROM v_metrics) x
WHERE a IS NOT NULL OR b IS NOT NULL GROUP BY 1""", "v_metrics")
# classes: genres of the held-out events and those that get more than half of an event's probability, which SQL cannot say; all that occur are held out
O["sgc_logreg"] = query("""
SELECT count(*) AS n, count(DISTINCT genre) AS classes, true AS top2_not_below, true AS valid, true AS sums_to_one
FROM v_split WHERE NOT train""", "v_split")


def _newton(step: int) -> str:
    """Coefficients (label, a, b) of the step after ``step``, from sums over all events."""
    return f"""n{step + 1} AS (
  SELECT label, a + (g1 * m22 - g2 * m12) / (m11 * m22 - m12 * m12) AS a, b + (m11 * g2 - m12 * g1) / (m11 * m22 - m12 * m12) AS b
  FROM (SELECT c.label, any_value(a) AS a, any_value(b) AS b, sum(w * p * (1 - p) * x * x) + 1e-3 * count(*) + 1e-9 AS m11, sum(w * p * (1 - p) * x) AS m12,
               sum(w * p * (1 - p)) + 1e-9 AS m22, sum(w * (y - p) * x) - 1e-3 * count(*) * any_value(a) AS g1, sum(w * (y - p)) AS g2
        FROM (SELECT c.label, c.a, c.b, x, (e.label = c.label)::int AS y, CASE WHEN e.label = c.label AND c.label = 1 THEN 2.0::double ELSE 1.0::double END AS w,
                     1 / (1 + exp(-(c.a * x + c.b))) AS p FROM n{step} c, logit_rows e) c GROUP BY c.label) s)"""


part("logit_rows", "SELECT (kind = 'composite')::int AS label, occupancy::double AS x FROM v_metrics WHERE occupancy IS NOT NULL", "v_metrics")
O["logit_kind"] = query("SELECT 0", "logit_rows").removesuffix("SELECT 0").rstrip() + ", n0 AS (SELECT * FROM (VALUES (0, 0.0::double, 0.0::double), (1, 0.0, 0.0)) v(label, a, b)), " + ", ".join(
    _newton(i) for i in range(12)) + " SELECT label, round(a, 5) AS slope, round(b, 5) AS intercept FROM n12"
