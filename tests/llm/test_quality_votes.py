import numpy as np
import pyarrow as pa

from stagelens.llm import quality_votes as q
from tests.llm.cases import awkward, empty, rows_of

SF = "/root/testdata/sf0.01"


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    made = q.quality_votes(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good = [r.score for r in made if r.quality == 1]
    bad = [r.score for r in made if r.quality == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97
    assert np.mean([r.predicted == r.quality for r in made]) > 0.95
    assert all(0 <= r.score <= 1 for r in made)


def test_votes_against_a_plain_loop():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab c#d ")) for _ in range(80)) for _ in range(60)]
    counts = q.terms(pa.array(texts))
    model = q.learn(counts, (np.arange(60) % 3 == 0).astype(float), 8)
    scores = model.scores(counts[:20], neighbours=5)
    for row, got in zip(counts[:20], scores):
        own = q.weighted(row[None], model.idf)[0] @ model.space
        near = model.vectors @ (own / np.linalg.norm(own))
        order = np.argsort(-near, kind="stable")[:5]
        weight = np.maximum(near[order], 0) ** q.SHARPNESS
        plain = (weight @ model.labels[order] + q.PRIOR_WEIGHT * model.labels.mean()) / (weight.sum() + q.PRIOR_WEIGHT)
        assert abs(plain - got) < 1e-6


def test_largest_with_ties():
    near = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [1, 1, 1, 1, 1]])
    assert q._largest(near, 3).tolist() == [[0, 1, 2], [0, 1, 2]]


def test_space_is_the_singular_one():
    rng = np.random.default_rng(2)
    counts = np.zeros((40, q.COLUMNS))
    counts[:, :12] = rng.integers(0, 4, (40, 12))
    model = q.learn(counts, np.ones(40), 5)
    rows = q.weighted(counts, model.idf)
    exact = np.linalg.svd(rows, full_matrices=False)[1][:5]
    assert np.allclose(np.linalg.norm(rows @ model.space, axis=0), exact, rtol=1e-6)


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 1, 0), (6, None, 0), (14, 0, 0), (15, 0, None), (None, 1, 0), (99, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    made = q.quality_votes(docs, labels)
    assert made.count() == docs.count()
    rows = made.collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert by[3] == by[4] == by[5] and by[1] == by[2] and by[8] == by[9]
    assert rows_of(made, "doc_id", "score") == rows_of(q.quality_votes(docs, labels), "doc_id", "score")


def test_no_labels_and_no_documents(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in q.quality_votes(docs, labels).collect()} == {0.5}
    assert q.quality_votes(empty(spark), labels).count() == 0
