import numpy as np
import pytest

from tarnlake.llm import queries
from tarnlake.llm.quality import MEASURES, N_FEATURES, Rows, classify, estimate_prior, learn, measures, nn_pu_fit, nn_pu_step, pairs, reject

LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def scored(spark):
    return queries.op2_pu_quality(spark, "/root/testdata/sf0.01").toPandas()


def test_held_out_accuracy(spark, scored):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    held = scored[scored.held_out].merge(labels, on="doc_id")
    good, bad = held[held.quality == 1], held[held.quality == 0]
    assert (good.predicted == 1).mean() >= 0.97 and (bad.predicted == 0).mean() >= 0.7
    assert (good.score.to_numpy()[:, None] > bad.score.to_numpy()[None, :]).mean() >= 0.97


def test_rows_and_range(spark, scored):
    assert scored.doc_id.is_unique and len(scored) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    assert scored.score.between(0, 1).all() and (scored.predicted == (scored.score >= 0.3)).all()


def test_labels_that_are_0_do_not_matter(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    a, b = (classify(docs, x).select("doc_id", "score").collect() for x in (labels, labels.where("quality = 1")))
    assert sorted(a) == sorted(b) and len({r["score"] for r in a}) > 1


def test_prior_from_positives_and_unlabelled(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality in (0, 1)")
    share = labels.selectExpr("avg(quality)").first()[0]
    found = learn(spark.read.parquet(f"{sf}/documents.parquet"), labels).prior
    assert abs(found - share) < 0.12, (found, share)


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.9])
def test_prior_of_a_known_mixture(prior):
    rng = np.random.default_rng(5)
    row = lambda good: (*pairs(" ".join(rng.choice(["river", "stone", "light"] if good else ["xx$", "zz%", "river"], 30)).encode()), np.zeros(MEASURES))
    positive = [row(True) for _ in range(400)]
    unlabelled = [row(rng.random() < prior) for _ in range(800)]
    assert abs(estimate_prior(positive, unlabelled) - prior) < 0.07


def test_risk_and_gradient_by_brute_force():
    rng = np.random.default_rng(6)
    texts = ["the river", "xx $$ 12", "a stone of light", "", "q", "the end. the end."]
    rows = [(*pairs(t.encode()), measures(t.encode())) for t in texts]
    p, u = (Rows.of(x, np.zeros(MEASURES), np.ones(MEASURES)) for x in (rows[:3], rows[2:]))

    def dense(x):
        out = np.zeros((len(x), N_FEATURES + 1))
        for r, (at, value, shape) in zip(out, x):
            r[at], r[N_FEATURES - MEASURES : -1], r[-1] = value, shape, 1
        return out

    dp, du = dense(rows[:3]), dense(rows[2:])
    loss = lambda z: np.mean([np.log(1 + np.exp(-x)) for x in z])
    below = set()
    for prior in (0.1, 0.5, 0.95):
        for size in (0.0, 0.5, 2.0):
            w = rng.normal(size=N_FEATURES + 1) * size
            positive = lambda w: prior * loss(dp @ w)  # noqa: B023, E731
            negative = lambda w: loss(-du @ w) - prior * loss(-dp @ w)  # noqa: B023, E731
            got = nn_pu_step(w, p, u, prior)
            goal = (lambda w: positive(w) + negative(w)) if negative(w) >= 0 else (lambda w: -negative(w))
            below.add(negative(w) < 0)
            for k in [*np.flatnonzero(dp.any(axis=0) | du.any(axis=0))[::9], N_FEATURES]:
                step = np.zeros_like(w)
                step[k] = 1e-5
                assert got[k] == pytest.approx((goal(w + step) - goal(w - step)) / 2e-5, abs=1e-6)
    assert below == {True, False}


def test_labels_of_the_held_out_fold_do_not_matter(spark, odd_docs):
    labels = [(i, i % 3 > 0, 0, None) for i in range(0, 37)]
    make = lambda rows: spark.createDataFrame([(i, int(q), t, x) for i, q, t, x in rows], LABELS)
    from tarnlake.llm.common import fold_of

    flipped = [(i, not q if fold_of(i) == 0 else q, t, x) for i, q, t, x in labels]
    a, b = (classify(odd_docs, make(x)).select("doc_id", "score").collect() for x in (labels, flipped))
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1, 0, "x"), (3, 1, 0, "x"), (3, 0, 0, None), (6, None, 0, None), (9, 7, 0, None), (None, 1, 0, None), (12, 0, None, None), (15, 1, 0, None)], LABELS)
    got = classify(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert classify(no_docs, labels).collect() == []
    assert {r["score"] for r in classify(odd_docs, labels.limit(0)).collect()} == {0.5}
    kept = reject(odd_docs, labels)
    assert kept.schema == odd_docs.schema
    ids = sorted(str(r["doc_id"]) for r in got if r["predicted"])
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ids
    assert learn(odd_docs, labels.limit(0)) is None


def test_features_of_any_text():
    for text in (b"", b"a", b" ", b"\n\n", b"AB ab " * 9000):
        assert np.isfinite(measures(text)).all() and len(measures(text)) == MEASURES
    at, value = pairs(b"Abab " * 5000)
    short, small = pairs(b"abab " * 3)
    assert sorted(short) == sorted(at) and abs((value**2).sum() - 1) < 1e-9 and abs((small**2).sum() - 1) < 1e-9


def test_non_negative_risk_finds_the_positives():
    rng = np.random.default_rng(0)
    words = lambda k, n: " ".join(rng.choice(k, n)).encode()
    good, bad = ["river", "stone", "light"], ["xx$", "zz%", "qq#"]
    row = lambda t: (*pairs(t), measures(t))
    positive = [row(words(good, 40)) for _ in range(150)]
    unlabelled = [row(words(good if rng.random() < 0.7 else bad, 40)) for _ in range(300)]
    model = nn_pu_fit(positive, unlabelled, 0.7)
    assert min(model.score(words(good, 30)) for _ in range(20)) > 0.7 and max(model.score(words(bad, 30)) for _ in range(20)) < 0.3
