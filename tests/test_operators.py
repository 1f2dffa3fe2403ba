"""Operators against brute force on small frames, hot keys included."""

import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stagelens.functions import tails as T
from stagelens.operators import checks as K
from stagelens.operators import compare as P
from stagelens.operators import consensus as CO
from stagelens.operators import graph as G
from stagelens.operators import improve as I
from stagelens.operators import inference as H
from stagelens.operators import keys as U
from stagelens.operators import people as PE
from stagelens.operators import profile as PR
from stagelens.operators import score as S
from stagelens.operators import summaries as SU
from stagelens.operators.skew import hot_keys, key_sizes, skew_join


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_left_skew_join_with_a_third_of_null_keys(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 != 0, F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    right = spark.range(40).select(F.concat(F.lit("k"), "id").alias("k"), (F.col("id") * 2).alias("v"))
    got = skew_join(left, right, ["k"], ["id"], "left")
    assert sorted(got.select("id", "v").collect()) == sorted(left.join(right, "k", "left").select("id", "v").collect())
    assert got.filter("k IS NULL").count() == 1000


def test_skew_join_is_the_plain_join(spark, no_broadcast):
    n = 3000
    left = pd.DataFrame({"k": ["hot"] * (n // 3) + [f"k{i % 700}" for i in range(n - n // 3)], "i": range(n)})
    right = pd.DataFrame({"k": ["hot", "hot", *[f"k{i}" for i in range(0, 700, 2)]], "v": range(352)})
    a, b = spark.createDataFrame(left), spark.createDataFrame(right)
    assert [r["k"] for r in hot_keys(key_sizes(a, ["k"]), ["k"], 0.01).collect()] == ["hot"]
    for how in ("inner", "left"):
        got = skew_join(a, b, ["k"], ["i"], how).toPandas().sort_values(["i", "v"], ignore_index=True)
        want = left.merge(right, on="k", how=how).sort_values(["i", "v"], ignore_index=True)
        pd.testing.assert_frame_equal(got[["k", "i", "v"]], want[["k", "i", "v"]], check_dtype=False)


def test_tails():
    one = np.array
    assert T.beta_inc(one([691 / 2]), one([3.0]), one([691 / (691 + 6 * 11.78)]))[0] == pytest.approx(1.338e-12, rel=1e-3)
    assert T.beta_inc(one([5.0]), one([0.5]), one([10 / (10 + 2.228139**2)]))[0] == pytest.approx(0.05, abs=1e-6)
    assert T.gamma_upper(one([0.5, 5.0]), one([3.841459 / 2, 18.307038 / 2])) == pytest.approx([0.05, 0.05], abs=1e-7)
    assert T.gamma_upper(one([1.0]), one([30.0]))[0] == pytest.approx(math.exp(-30))


def test_p_values_on_frames(spark):
    df = spark.createDataFrame([(2.228139, 10.0), (None, 1.0)], "t double, d double")
    assert [r[0] for r in df.select(T.t_two_sided("t", "d")).collect()] == [pytest.approx(0.05, abs=1e-6), None]
    df = spark.createDataFrame([(3.841459, 1)], "x double, d int")
    assert df.select(T.chi2_upper("x", "d")).first()[0] == pytest.approx(0.05, abs=1e-6)


def test_welch_constant_sides(spark):
    rows = [("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 4.0, 1.0), ("b", 1.0, 1.0), ("b", 5.0, 1.0), ("b", 7.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, c double")
    out = {r["metric"]: r for r in H.welch_p(df, "g", "a", "b", ["x", "c"]).collect()}
    a, b = np.array([1, 2, 4.0]), np.array([1, 5, 7.0])
    t = (a.mean() - b.mean()) / math.sqrt(a.var(ddof=1) / 3 + b.var(ddof=1) / 3)
    assert out["x"]["t"] == pytest.approx(t)
    assert 0 < out["x"]["p"] < 1
    assert out["c"]["t"] is None and out["c"]["p"] is None


def test_anova_of_two_groups_is_t_squared(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(x)) for x in rng.normal(size=40)] + [("b", float(x)) for x in rng.normal(0.5, 1, size=30)] + [("tiny", 9.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    out = H.anova_p(df, "g", "x").first()
    a, b = (np.array([x for g, x in rows if g == k]) for k in "ab")
    pooled = (a.var(ddof=1) * 39 + b.var(ddof=1) * 29) / 68
    t = (a.mean() - b.mean()) / math.sqrt(pooled * (1 / 40 + 1 / 30))
    assert out["f"] == pytest.approx(t * t) and out["groups"] == 2 and out["dof2"] == 68


def test_kruskal(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": range(90), "g": rng.choice(list("abc"), 90), "x": rng.integers(0, 9, 90).astype(float)})
    rank = pdf["x"].rank()
    h = 12 / (90 * 91) * (rank.groupby(pdf["g"]).sum() ** 2 / pdf.groupby("g").size()).sum() - 3 * 91
    c = pdf["x"].value_counts()
    h /= 1 - (c**3 - c).sum() / (90**3 - 90)
    out = H.kruskal(spark.createDataFrame(pdf), "g", "x", ["id"]).first()
    assert out["h"] == pytest.approx(h) and out["dof"] == 2


def test_chi2_with_and_without_correction(spark):
    cells = {("a", "x"): 20, ("a", "y"): 10, ("b", "x"): 7, ("b", "y"): 23, ("rare", "x"): 3}
    rows = [k for k, n in cells.items() for _ in range(n)]
    out = H.chi2(spark.createDataFrame(rows, "r string, c string"), "r", "c").first()
    o = np.array([[20, 10], [7, 23.0]])
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    assert out["chi2"] == pytest.approx(((abs(o - e) - 0.5) ** 2 / e).sum())
    rows += [("a", "z")] * 5
    out = H.chi2(spark.createDataFrame(rows, "r string, c string"), "r", "c").first()
    o = np.array([[20, 10, 5], [7, 23, 0.0]])
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    assert out["chi2"] == pytest.approx(((o - e) ** 2 / e).sum()) and out["dof"] == 2


def occurrences():
    rng = np.random.default_rng(4)
    rows = {}
    for e in range(30):
        rows[(e, "org", "Hub")] = 1  # one name takes part everywhere
        for _ in range(rng.integers(1, 5)):
            rows[(e, str(rng.choice(["cast", "crew"])), f"n{rng.integers(0, 12)}")] = int(rng.integers(1, 3))
    return [(e, r, n, t) for (e, r, n), t in rows.items()]


def test_tfidf_and_propagation(spark, no_broadcast):
    occ = occurrences()
    df = spark.createDataFrame(occ, "performance_id long, role string, name string, times long")
    edges = G.tfidf(G.participant_edges(df))
    tf = Counter()
    for e, r, n, t in occ:
        tf[(e, ("org:" if r == "org" else "person:") + n)] += t
    deg = Counter(node for _, node in tf)
    raw = {k: t * (math.log(31 / (1 + deg[k[1]])) + 1) for k, t in tf.items()}
    norm = defaultdict(float)
    for (e, _), w in raw.items():
        norm[e] += w * w
    want = {k: tf[k] * raw[k] / math.sqrt(norm[k[0]]) for k in tf}
    got = {(r["performance_id"], r["node"]): r["weight"] for r in edges.collect()}
    assert got == pytest.approx(want)

    lower = {(r["performance_id"], r["node"]): r["weight"] for r in G.tfidf(G.participant_edges(df), lower_terms=True).collect()}
    assert all((w == 0) == (node == "org:Hub") for (_, node), w in lower.items())

    nodes = sorted({f"performance:{e}" for e, _ in tf} | {n for _, n in tf})
    at = {n: i for i, n in enumerate(nodes)}
    a = np.eye(len(nodes))
    for (e, n), w in want.items():
        a[at[f"performance:{e}"], at[n]] += w
        a[at[n], at[f"performance:{e}"]] += w
    d = 1 / np.sqrt(a.sum(1))
    y = np.zeros((len(nodes), 2))
    labels = [(f"performance:{e}", "xy"[e % 2]) for e in range(20)]
    for n, g in labels:
        y[at[n], "xy".index(g)] = 1
    step = d[:, None] * a * d
    e = edges.select(F.concat(F.lit("performance:"), F.col("performance_id").cast("string")).alias("p"), "node", "weight")
    graph = G.undirected(e, "p", "node", "weight")
    for hops in (1, 2, 3):
        y = step @ y
        out = G.propagate(graph, spark.createDataFrame(labels, "node string, genre string"), hops)
        got = {(r["node"], r["genre"]): r["value"] for r in out.collect()}
        want_y = {(n, g): y[at[n], j] for n in nodes for j, g in enumerate("xy") if y[at[n], j] != 0}
        assert got == pytest.approx(want_y)


def test_name_as_person_and_org(spark):
    rows = [(1, "cast", "X", 1), (1, "org", "X", 1), (2, "cast", "X", 1)]
    df = spark.createDataFrame(rows, "performance_id long, role string, name string, times long")
    both = {(r["performance_id"], r["node"], r["tf"]) for r in G.participant_edges(df).collect()}
    assert both == {(1, "person:X", 1), (1, "org:X", 1), (2, "person:X", 1)}
    one = {(r["performance_id"], r["node"], r["tf"]) for r in G.participant_edges(df, org_wins=True).collect()}
    assert one == {(1, "org:X", 2), (2, "person:X", 1)}


def test_genre_vote(spark, no_broadcast):
    occ = occurrences()
    df = G.participant_edges(spark.createDataFrame(occ, "performance_id long, role string, name string, times long"))
    train = {e: "abc"[e % 3] for e in range(20)}
    hist = defaultdict(Counter)
    edges = [(r["performance_id"], r["node"], r["tf"]) for r in df.collect()]
    for e, n, t in edges:
        if e in train:
            hist[n][train[e]] += t
    want = {}
    for e in (*range(20, 30), 99):
        c = Counter()
        for e2, n, t in edges:
            if e2 == e:
                for g, v in hist[n].items():
                    c[g] += v * t
        top = sorted(c, key=lambda g: (-c[g], g))[:2] or ["a"]
        want[e] = (top[0], top[1] if len(top) > 1 else None)
    targets = spark.createDataFrame([(e,) for e in want], "performance_id long")
    out = G.genre_vote(df, spark.createDataFrame(list(train.items()), "performance_id long, genre string"), targets)
    assert {r["performance_id"]: (r["genre1"], r["genre2"]) for r in out.collect()} == want


def test_prototype_index_grows_whole_trees(spark):
    rng = np.random.default_rng(5)
    data = pd.DataFrame(rng.random((6000, 3)), columns=["a", "b", "y"]).assign(k=range(6000))
    data["y"] += 0.1 * data["a"]
    df = spark.createDataFrame(data).coalesce(1).cache()

    def index(**depth):
        out = I.importance_weighted_index(df, "y", ["a", "b"], ["k"], trees=3, **depth)
        return np.array([r["PI"] for r in out.orderBy("k").collect()])

    whole = index()
    assert np.allclose(whole, index(depth=I.DEPTH)) and np.abs(whole - index(depth=12)).max() > 1e-4
    df.unpersist()


def test_minimal_improvement_by_brute_force(spark):
    rows = [("p", "Paid", 60.0, 48.0, 0.5, 0.45, 0.5), ("q", "Paid", 99.0, 30.0, 0.3, 0.3, 0.4), ("r", "Free", 55.0, 50.0, 0.5, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "k string, segment string, baseline double, DPI_AB double, U_AB double, S_AB double, A_AB double")
    got = {r["k"]: r for r in I.minimal_improvement(df, ["k"]).collect()}
    for k, seg, base, _, u, s, a in rows:
        best = far = None
        for iu, isc, ia in itertools.product(range(21), range(21), range(21) if seg == "Paid" else [0]):
            x, y, z = min(u + iu * 0.01, 1), min(s + isc * 0.01, 1), min(a + ia * 0.01, 1)
            pred = 100 * (x**0.6 * y**0.4 if seg == "Free" else x**0.5 * y**0.3 * z**0.2)
            if pred >= base and (best is None or iu + isc + ia < best[0]):
                best = (iu + isc + ia, iu, isc, ia)
            if far is None or pred > far[0] + 1e-12:
                far = (pred, iu, isc, ia)
        pick = best or far
        assert got[k]["converted"] == (best is not None)
        assert [got[k][c] for c in ("dU", "dS", "dA")] == pytest.approx([i * 0.01 for i in pick[1:]])


def test_verdicts(spark):
    df = spark.createDataFrame([(5.0, 4.0, 6.0), (4.9, 4.0, 6.0), (5.0, None, 6.0)], "x double, a double, b double")
    out = [r[0] for r in df.select(P.verdict(F.col("x"), F.col("a"), F.col("b"))).collect()]
    assert out == [P.SUCCESS, P.FAIL, P.UNDECIDABLE]


def test_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    assert {(r["k"], r["v"]) for r in U.keep_unique(df, ["k"]).collect()} == {("b", 3), (None, 4)}
    assert {(r["k"], r["v"]) for r in U.keep_first(df, ["k"], ["v"]).collect()} == {("a", 1), ("b", 3), (None, 4)}
    many = spark.range(5000).select((F.col("id") % 1700).alias("k"))
    ids = sorted(r["id"] for r in U.dense_ids(many, ["k"]).collect())
    assert ids == list(range(1, 1701))
    share = many.distinct().filter(U.in_training(0.8, "k")).count() / 1700
    assert 0.75 < share < 0.85


def test_profile_and_checks(spark):
    df = spark.createDataFrame([("k1", "x", None), ("k1", "x", "1"), ("k2", "y", ""), ("k2", "z", "")], "k string, a string, b string")
    out = {r["column"]: r["violations"] for r in PR.fd_violations(df, "k", ["a", "b"]).collect()}
    assert out == {"a": 1, "b": 1}
    prof = {r["column"]: (r["distinct_values"], r["missing_pct"], r["example"]) for r in PR.column_profile(df).collect()}
    assert prof["b"] == (2, 75.0, "1")
    uniq = {r["candidate"]: r["is_unique"] for r in PR.key_uniqueness(df, {"k": ["k"], "ab": ["k", "a", "b"]}).collect()}
    assert uniq == {"k": False, "ab": True}
    t = spark.createDataFrame([("1.0", "1"), ("1.2", "1"), ("x", "x"), (None, "x")], "a string, b string")
    assert [r[0] for r in t.select(K.check_column("a", "b", 0.1)).collect()] == [True, False, True, False]
    a = spark.createDataFrame([(1, "x"), (2, "y"), (4, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (3, "y"), (4, None)], "k int, v string")
    diff = {r["k"]: (r["found"], r["same"]) for r in K.diff_tables(a, b, ["k"], ["v"]).collect()}
    assert diff == {1: ("both", True), 2: ("left_only", False), 3: ("right_only", False), 4: ("both", True)}


def test_homonyms_and_resolution(spark, no_broadcast):
    rows = [("kim", "m"), ("kim", "m"), ("kim", "d"), ("lee", "d")]
    people = spark.createDataFrame(rows, "name string, mid string")
    levels = PE.homonym_levels(people, ["mid"]).first()
    assert (levels["names"], levels["genres"], levels["names_in_many"], levels["quasi_ids"]) == (2, 2, 1, 3)
    assert levels["mean_top_share"] == pytest.approx((2 / 3 + 1) / 2)
    dom = PE.dominant_genre(people, "mid")
    open_ = spark.createDataFrame([(1, "kim"), (1, "new")], "e int, name string")
    out = {(r["name"], r["mid"], r["resolved"]) for r in PE.resolve(open_, dom, "mid", "composite", ["e"]).collect()}
    assert out == {("kim", "m", True), ("new", "composite", False)}
    stats = PE.ambiguity(open_, dom).first()
    assert tuple(stats) == (2, 1, 0, 1)


def test_consensus(spark):
    rows = [(1, 1, "a", "b", 0.6, 0.4), (1, 2, "b", "a", 0.5, 0.35), (2, 1, "a", None, 1.0, None), (2, 2, "a", "c", 0.9, 0.1)]
    pred = spark.createDataFrame(rows, "performance_id int, run_id int, genre1 string, genre2 string, p1 double, p2 double")
    c = CO.consensus(pred).withColumn("class", CO.classify(0.3))
    assert {r["performance_id"]: r["class"] for r in c.collect()} == {1: CO.PAIR, 2: CO.MAIN}
    sweep = CO.threshold_sweep(CO.consensus(pred)).collect()
    assert all(r["pair_fixed"] + r["main_fixed"] + r["undecided"] == 2 for r in sweep)
    agree = CO.run_agreement(pred).first()
    assert (agree["n"], agree["first_agreement"], agree["pair_agreement"]) == (2, 0.5, 0.5)


def test_summaries(spark):
    df = spark.createDataFrame([("s", float(i)) for i in range(1, 11)] + [("t", 3.0)], "g string, v double")
    out = {r["g"]: r for r in SU.concentration(df, "g", "v").collect()}
    assert out["s"]["top_share"] == pytest.approx(40 / 55) and out["s"]["median"] == 5.5 and out["t"]["top_share"] == 1.0
    h = {r["bin"]: r["n"] for r in SU.histogram(df, "v", 3).collect()}
    assert h == {0: 4, 1: 3, 2: 4}
    top = S.top_n(df, [F.col("v").desc(), F.col("g")], 2)
    assert [r["v"] for r in top.collect()] == [10.0, 9.0]


def test_scoring_examples(spark):
    df = spark.createDataFrame([(False, 0.1), (False, 0.2), (True, 0.1), (False, None)], "f boolean, p double")
    assert [r[0] for r in df.select(S.guardrail(F.col("f"), F.col("p"))).collect()] == [0.95, 1.0, 1.0, 1.0]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 100])] + [(9, None)], "id int, v double")
    assert sorted(r["v"] for r in S.iqr_filter(df, "v").collect()) == [1, 2, 3, 4]
