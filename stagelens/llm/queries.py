"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagelens.llm.collocations import collocations
from stagelens.llm.common import table
from stagelens.llm.edit_prints import with_next
from stagelens.llm.langid import language
from stagelens.llm.merkle import manifest
from stagelens.llm.mixing import mix
from stagelens.llm.packing import pack
from stagelens.llm.pii import personal_data
from stagelens.llm.quality_rules import quality_rules
from stagelens.llm.quality_votes import quality_votes
from stagelens.llm.repeats import repeated_spans
from stagelens.llm.sharding import sharded
from stagelens.llm.simhash import hex_fingerprint, near_duplicates
from stagelens.llm.warc import archived_pages


def tokenizer() -> str:
    """Vocabulary file of the public tokenizer; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


QUERIES_LLM: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_LLM: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES_LLM[fn.__name__] = fn
    return fn


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


ORACLE_LLM["op1_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
m AS (SELECT page_id, strlen(payload) AS n, sha1(payload) AS digest, max(page_id) OVER (PARTITION BY payload) AS stored FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> stored THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> stored THEN stored END AS refers_to
FROM m
"""


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer())


@query
def op3_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "bits")


@query
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


@query
def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "drawn")


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")


@query
def op8_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents"))


@query
def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


@query
def op10_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_votes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(table(spark, sf_dir, "documents"), tampered=third)


def _merkle_sql(depth: int = 7, top_depth: int = 3) -> str:
    """All levels as tables of their own; a group that has one node left keeps it."""
    def enc(column: str) -> str:
        return f"coalesce(strlen({column}) || ':' || {column}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(enc(c) for c in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)) + ")"

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # crc32 of the decimal digits, bit by bit: a step is a byte to add or a shift (-1)
    crc = """xor(list_reduce(flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(doc_id::varchar, '')]),
        lambda acc, s: CASE WHEN s >= 0 THEN xor(acc, s::bigint)
                            WHEN acc % 2 = 1 THEN xor(acc >> 1, 3988292384::bigint) ELSE acc >> 1 END, 4294967295::bigint),
        4294967295::bigint)"""
    steps = [f"""d AS (SELECT doc_id, lang, {leaf('text')} AS leaf,
        CASE WHEN {crc} % 3 = 0 THEN {leaf(f"translate(text, '{upper}', '{lower}')")} ELSE {leaf('text')} END AS other
        FROM documents)""",
        "p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS pos FROM d)",
        "n0 AS (SELECT lang AS g, pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM p)",
        "w0 AS (SELECT doc_id, leaf, lang, lang AS g, pos, '' AS proof, other AS f FROM p)"]

    def climb(prefix: str, walker: str, depth: int) -> None:
        for k in range(depth):
            n, w = f"{prefix}{k}", f"{walker}{k}"
            steps.append(f"""{prefix}{k + 1} AS (SELECT g, pos // 8 AS pos,
                CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h,
                (any_value(n) + 7) // 8 AS n FROM {n} GROUP BY g, pos // 8)""")
            steps.append(f"""{walker}{k + 1} AS (SELECT w.doc_id, w.leaf, any_value(w.lang) AS lang, any_value(w.g) AS g, any_value(w.pos) // 8 AS pos,
                CASE WHEN any_value(n.n) = 1 THEN any_value(w.proof) ELSE any_value(w.proof) || coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos <> w.pos), '') END AS proof,
                CASE WHEN any_value(n.n) = 1 THEN any_value(w.f) ELSE sha256(string_agg(CASE WHEN n.pos = w.pos THEN w.f ELSE n.h END, '' ORDER BY n.pos)) END AS f
                FROM {w} w JOIN {n} n ON w.g IS NOT DISTINCT FROM n.g AND w.pos // 8 = n.pos // 8 GROUP BY w.doc_id, w.leaf)""")

    climb("n", "w", depth)
    steps.append(f"""s AS (SELECT g AS lang, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
        FROM n{depth})""")
    steps.append("m0 AS (SELECT '' AS g, pos, h, n FROM s)")
    steps.append(f"""v0 AS (SELECT w.doc_id, w.leaf, w.lang, '' AS g, s.pos, w.proof, w.f
        FROM w{depth} w JOIN s ON w.lang IS NOT DISTINCT FROM s.lang)""")
    climb("m", "v", top_depth)
    return f"""WITH {", ".join(steps)}
        SELECT v.doc_id, v.leaf, s.h AS subroot, m.h AS root, sha256(v.proof) AS proof_sha256, v.f AS folded_root, v.f = m.h AS verified
        FROM v{top_depth} v JOIN s ON v.lang IS NOT DISTINCT FROM s.lang CROSS JOIN m{top_depth} m"""


ORACLE_LLM["op11_merkle_manifest"] = _merkle_sql()


@query
def op12_label_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_LLM["op13_collocations"] = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::bigint AS n FROM words GROUP BY lang),
grams AS (SELECT lang, 1 AS k, unnest([[x] FOR x IN w]) AS g FROM words
          UNION ALL SELECT lang, 2, unnest([[w[i], w[i + 1]] FOR i IN range(1, len(w))]) FROM words
          UNION ALL SELECT lang, 3, unnest([[w[i], w[i + 1], w[i + 2]] FOR i IN range(1, len(w) - 1)]) FROM words),
f AS (SELECT lang || chr(10) || array_to_string(g, ' ') AS id, any_value(lang) AS lang, any_value(array_to_string(g, ' ')) AS phrase, any_value(g) AS g, any_value(k) AS k, count(*) AS a FROM grams GROUP BY id),
cand AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
parts AS (SELECT *, 1 AS j, lang || chr(10) || g[1] AS lp, lang || chr(10) || array_to_string(g[2:], ' ') AS rp FROM cand
          UNION ALL SELECT *, 2, lang || chr(10) || array_to_string(g[1:2], ' '), lang || chr(10) || g[3] FROM cand WHERE k = 3),
cuts AS (SELECT p.*, l.a AS l, r.a AS r, ((1000000::hugeint * p.a * p.a) // (l.a::hugeint * r.a))::bigint AS score
         FROM parts p JOIN f l ON l.id = p.lp JOIN f r ON r.id = p.rp),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, array_to_string(g[1:2], ' ') AS phrase, a FROM cand WHERE k = 3
           UNION ALL SELECT lang, array_to_string(g[2:3], ' '), a FROM cand WHERE k = 3),
most AS (SELECT lang, phrase, max(a) AS m FROM longer GROUP BY lang, phrase),
kept AS (SELECT b.* FROM best b LEFT JOIN most m ON m.lang = b.lang AND m.phrase = b.phrase AND b.k = 2
         WHERE m.m IS NULL OR 100 * m.m < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
