import math
import random

import numpy as np
import pytest

import corpus_pipeline
from tarnlake.llm.common import stage
from tarnlake.llm import simhash
from tarnlake.llm.simhash import drop_near_duplicates, near_duplicates
from tests.conftest import SF
from tests.llm import test_decontaminate, test_packing, test_substrings


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, function in corpus_pipeline.STAGES:
        after = stage(function(spark, docs, SF), name)
        out.append((name, docs, after))
        docs = after
    return out


def test_columns_and_ids(steps):
    for name, before, after in steps[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes
        ids = {r[0] for r in after.select("doc_id").collect()}
        assert ids and len(ids) == after.count() and ids <= {r[0] for r in before.select("doc_id").collect()}, name


def test_quality_keeps_the_good(spark):
    sf = "/root/testdata/sf0.01"  # the smallest tables have too few labels to learn from
    after = corpus_pipeline.quality_classifier(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    kept = {r[0] for r in after.select("doc_id").collect()}
    share = labels.assign(kept=labels.doc_id.isin(kept)).groupby("quality").kept.mean()
    assert share[1] >= 0.95 and share[0] <= 0.4


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_near_copies_against_all_pairs(spark, steps):
    _, before, after = steps[1]
    texts = dict(before.select("doc_id", "text").collect())
    kept = {r[0] for r in after.select("doc_id").collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    ids = sorted(texts)
    gone = [i for i in ids if i not in kept]
    for i in gone:
        assert max(like(sets[i], sets[j]) for j in ids if j != i) >= 0.8
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            assert not (texts[i] == texts[j] and i in kept and j in kept)


def test_passages(steps):
    _, before, after = steps[2]
    rows = [(i, (t or "").encode()) for i, t in before.select("doc_id", "text").collect()]
    want = {i: bytes(c for c, g in zip(t, gone) if not g).decode("utf-8", "ignore") for i, t, gone in test_substrings.covered(rows)}
    got = {r["doc_id"]: r for r in after.collect()}
    assert {i: r["text"] for i, r in got.items()} == want and all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_benchmark(spark, steps):
    _, before, after = steps[3]
    docs = [tuple(r) for r in before.select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r[0] for r in test_decontaminate.brute(docs, items) if not r[-1]}
    assert {r[0] for r in after.select("doc_id").collect()} == clean


def test_packed(steps):
    _, before, after = steps[4]
    test_packing.check(after.collect(), [tuple(r) for r in before.select("doc_id", "text").collect()])


def test_near_copies_are_found_and_others_left(spark, odd_docs):
    rng = random.Random(2)
    vocabulary = [f"w{rng.randint(0, 10**6)}" for _ in range(3000)]
    base = [[rng.choice(vocabulary) for _ in range(200)] for _ in range(40)]
    rows, pairs = [(i, " ".join(w)) for i, w in enumerate(base)], []
    for i, words in enumerate(base):
        for edits in (0, 1, 2, 3):
            w = list(words)
            for at in rng.sample(range(5, 195), edits):
                w[at] = "changed"
            rows.append((1000 + len(rows), " ".join(w)))
            pairs.append((i, rows[-1][0]))
    got = dict(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert np.mean([got[b] == a for a, b in pairs]) >= 0.98 and all(got[i] == i for i in range(40))
    left = drop_near_duplicates(odd_docs)
    assert left.schema == odd_docs.schema and any(r["doc_id"] is None for r in left.collect())
    assert drop_near_duplicates(odd_docs.limit(0)).collect() == []


def test_large_group_is_one(spark):
    rng = random.Random(3)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    rows = []
    for i in range(700):
        w = list(words)
        w[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(w)))
    assert {r["kept_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def copies(rng, words):
    """Appended, truncated and edited copies, some just over a similarity of 0.8."""
    fresh = lambda: f"n{rng.randint(0, 10**9)}"
    n = len(words)
    for share in (0.8, 0.85, 0.9):
        yield words + [fresh() for _ in range(int((n - 4) / share) - n + 4)]
        yield words[: -int((n - 4) * (1 - share))]
        yield words[int((n - 4) * (1 - share)) :]
        edited = list(words)
        for at in range(7, n - 7, int(10 / (1 - share)) + 1):
            edited[at] = fresh()
        yield edited


def test_copies_down_to_the_least_similarity(spark):
    rng = random.Random(7)
    rows, pairs = [], []
    for _ in range(30):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice((60, 120, 200)))]
        for copy in copies(rng, words):  # a base of its own for each, so that copies are not linked through others
            base = [f"{w}b{len(rows)}" for w in words]
            of = {w: b for w, b in zip(words, base)}
            a, b = " ".join(base), " ".join(of.get(w, w) for w in copy)
            rows += [(len(rows), a), (len(rows) + 1, b)]
            if jaccard(a, b) >= 0.8:
                pairs.append((len(rows) - 2, len(rows) - 1))
    got = dict(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert len(pairs) > 300 and [p for p in pairs if got[p[1]] != p[0]] == []
    assert sum(got[i] != i for i, _ in rows) == len(pairs)


def test_partners_behind_nearer_texts_are_compared(spark):
    rng = random.Random(11)
    rows, pairs = [], []
    for k in range(4):
        word = lambda n: [f"w{rng.randint(0, 10**12)}" for _ in range(n)]  # noqa: B023, E731
        x, one, two, three, four = word(160), word(8), word(8), word(8), word(8)
        b, c = x + one + two, x + three + four
        decoys = [one + x + three + word(26) for _ in range(60)]
        texts = [" ".join(t) for t in [*decoys, b, c]]
        assert jaccard(texts[-2], texts[-1]) >= 0.8 > max(jaccard(s, t) for i, s in enumerate(texts) for t in texts[i + 1 :] if (s, t) != (texts[-2], texts[-1]))
        rows += [(1000 * k + i, t) for i, t in enumerate(texts)]
        pairs.append((1000 * k + 60, 1000 * k + 61))
    got = dict(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sorted((got[i], i) for i in got if got[i] != i) == pairs


def test_long_texts_by_their_whole_shingle_sets(spark):
    rng = random.Random(13)
    rows, want = [], {}
    for n in (400, 700, 1500):
        for share in (0.77, 0.78, 0.79, 0.8, 0.81, 0.82):
            for _ in range(4):
                words = [f"w{rng.randint(0, 10**12)}" for _ in range(n)]
                kept = math.ceil((n - 4) * share) + 4
                at = rng.randint(0, n - kept)
                i = len(rows)
                rows += [(i, " ".join(words)), (i + 1, " ".join(words[at : at + kept]))]
                want[i + 1] = i if jaccard(rows[-2][1], rows[-1][1]) >= 0.8 else i + 1
    got = dict(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [i for i in want if got[i] != want[i]] == []


def test_bitmaps_bound_the_similarity_from_above():
    rng = np.random.default_rng(8)
    for n in (0, 1, 5, 40, 300, 5000):
        for share in (0.5, 0.79, 0.8, 0.81, 1.0):
            x = rng.integers(0, 1 << 63, n).astype(np.uint64)
            y = np.concatenate((x[: int(n * share)], rng.integers(0, 1 << 63, n - int(n * share)).astype(np.uint64)))
            x, y = np.unique(x), np.unique(y)
            rows = simhash._Rows({"bits": np.stack([simhash.parity_bits(z).view(np.uint64) for z in (x, y)]), "size": np.array([len(x), len(y)])})
            ok, differ = rows.allowed(np.array([0]), np.array([1]), 0.8)
            assert ok[0] or simhash.similarity(x, y) < 0.8
            assert differ[0] <= 10_000 * len(np.setxor1d(x, y)) / max(1, len(x) + len(y))


def test_buckets_of_many_texts_lose_no_pair(spark, monkeypatch):
    """Against all pairs, with buckets that are dealt in many blocks, among texts around the least similarity."""
    rng = random.Random(17)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(90)]
    rows = []
    for i in range(150):
        w = list(base)
        for at in rng.sample(range(90), rng.choice((0, 1, 2, 3, 4, 6))):
            w[at] = f"x{rng.randint(0, 30)}"
        rows.append((i, " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    parent = list(range(150))
    for i in range(150):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(parent[i], parent[j]), min(parent[i], parent[j])
                parent = [new if p == old else p for p in parent]
    assert 5 < len(set(parent)) < 140
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (7, 1024):
        monkeypatch.setattr(simhash, "HOT", hot)
        got = dict(near_duplicates(docs).collect())
        assert [got[i] for i in range(150)] == parent


def test_compared_texts_leave_the_rounds(spark, monkeypatch):
    """Texts that are close to many but similar to none are dealt to buckets once, not in each round."""
    rng = random.Random(19)
    word = lambda n: [f"w{rng.randint(0, 10**12)}" for _ in range(n)]
    common, group = word(150), word(100)
    rows = [(i, " ".join(common + word(70))) for i in range(80)]
    for i in range(80, 110):
        w = list(group)
        w[rng.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(w)))
    dealt, before = [], simhash._dealt
    counted = lambda texts, *a, **b: dealt.append(texts.count() if "tree" in texts.columns else None) or before(texts, *a, **b)
    monkeypatch.setattr(simhash, "_dealt", counted)
    got = dict(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {i: min(i, 80) for i in range(110)}
    assert dealt[0] is None and dealt[1] >= 80 and len(dealt) >= 3 and max(dealt[2:]) == 0


def test_wide_fingerprints_are_simhashes():
    rng = np.random.default_rng(21)
    for common, x, y in ((4, 1, 0), (12, 2, 1), (40, 5, 5), (400, 100, 0)):
        apart, words = [], 4
        for _ in range(150):
            z = rng.integers(0, 1 << 63, common + x + y).astype(np.uint64)
            pair = [simhash.wide_fingerprint(s, words) for s in (z[: common + x], np.append(z[:common], z[common + x :]))]
            apart.append(int(np.bitwise_count(pair[0] ^ pair[1]).sum()))
        assert np.mean(apart) / (64 * words) < simhash.FLIPS + 0.01
    z = rng.integers(0, 1 << 63, 700).astype(np.uint64)
    single = [np.unpackbits(simhash.wide_fingerprint(z[i : i + 1], 3).view(np.uint8)) for i in range(700)]
    assert abs(np.mean(single) - 0.5) < 0.01
    whole = np.unpackbits(simhash.wide_fingerprint(z, 3).view(np.uint8))
    assert np.mean(whole == (2 * np.sum(single, axis=0) > 700)) > 0.7  # votes of two strengths, of which these are the signs
    assert (simhash.wide_fingerprint(rng.permutation(z), 3) == simhash.wide_fingerprint(z, 3)).all()
    assert not simhash.wide_fingerprint(z[:0], 3).any()


def test_tables_find_pairs_of_the_least_similarity():
    rng = np.random.default_rng(22)
    for texts in (10, 50_000, 1_000_000):
        width, count = simhash.tables(texts)
        assert (1 - (1 - simhash.FLIPS) ** width) ** count <= simhash.MISSED and texts / 2**width <= simhash.SHARED
        words = max(3, -(-width * count // 64))
        for common, x, y in ((4, 1, 0), (40, 10, 0), (80, 10, 10)):
            for _ in range(50):
                z = rng.integers(0, 1 << 63, common + x + y).astype(np.uint64)
                a, b = (simhash.wide_fingerprint(s, words) for s in (z[: common + x], np.append(z[:common], z[common + x :])))
                p, q = (simhash.segments(f, width, count) for f in (a, b))
                assert len(set(p.tolist())) == count and (p == q).any()
                assert np.bitwise_count(a[:3] ^ b[:3]).sum() <= simhash.MOST_APART and np.bitwise_count(a[:2] ^ b[:2]).sum() <= simhash.MOST_IN_TWO


def test_near_copies_meet_by_their_simhashes(spark, monkeypatch):
    """With one table of a long segment, only texts whose whole segments agree meet."""
    words = [f"w{i * i}" for i in range(200)]
    changed = [*words[:100], "changed", *words[101:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words).upper()), (3, " ".join(changed))], "doc_id long, text string")
    docs = docs.withColumn("n_chars", docs["doc_id"] * 0)
    left = lambda: {r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, docs, SF).collect()}
    assert left() == {1}
    monkeypatch.setattr(simhash, "tables", lambda texts: (60, 1))
    prints = [simhash.wide_fingerprint(simhash.shingle_set(" ".join(w).encode()), 3) for w in (words, changed)]
    assert simhash.segments(prints[0], 60, 1) != simhash.segments(prints[1], 60, 1)
    assert left() == {1, 3}
