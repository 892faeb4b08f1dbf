import hashlib
import random
import zlib

import pytest

from tarnlake.llm import queries, substrings
from tarnlake.llm.substrings import Runs, remove_repeats, repeat_digests
from tests.conftest import SF


def covered(rows, n=50):
    """Which bytes of each row go, window by window."""
    least = {}
    for i, t in rows:
        if i is not None:
            for p in range(len(t) - n + 1):
                w = t[p : p + n]
                least[w] = min(least.get(w, i), i)
    for i, t in rows:
        gone = bytearray(len(t))
        if i is not None:
            for p in range(len(t) - n + 1):
                if least[t[p : p + n]] < i:
                    gone[p : p + n] = b"\1" * n
        yield i, t, gone


def brute(rows):
    out = []
    for i, t, gone in covered(rows):
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not before for g, before in zip(gone, b"\0" + gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def as_rows(table):
    return sorted((tuple(r) for r in table.collect()), key=str)


def given(docs):
    return [(i, (t or "").encode()) for i, t in docs.select("doc_id", "text").collect()]


def test_query(spark):
    got = as_rows(queries.op6_prefix_doubling_dedup(spark, SF))
    assert got == brute(given(spark.read.parquet(f"{SF}/documents.parquet")))
    assert sum(r[2] for r in got) > 1000


def test_odd_rows(spark, odd_docs):
    assert as_rows(repeat_digests(odd_docs)) == brute(given(odd_docs))
    left = remove_repeats(odd_docs)
    assert left.schema == odd_docs.schema
    want = sorted((i, bytes(c for c, g in zip(t, gone) if not g).decode("utf-8", "ignore")) for i, t, gone in covered(given(odd_docs)) if i is not None)
    assert sorted((r["doc_id"], r["text"] or "") for r in left.collect() if r["doc_id"] is not None) == want
    assert sum(r["text"] is None for r in left.collect()) == 1


@pytest.mark.parametrize("seed", range(3))
def test_shared_passages_of_any_length(spark, seed, monkeypatch):
    rng = random.Random(seed)
    text = lambda n, k=26: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[:k]) for _ in range(n))
    passages = [text(n) for n in (49, 50, 51, 70, 300)] + ["ab" * 60, "-" * 200]
    rows = [(i * 5 % 83, "".join(rng.choice(passages) if rng.random() < 0.4 else text(rng.randint(1, 90), rng.choice((2, 26))) for _ in range(rng.randint(0, 9)))) for i in range(83)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert as_rows(repeat_digests(docs)) == brute(given(docs))


def test_no_rows(spark, no_docs):
    assert repeat_digests(no_docs).collect() == [] and remove_repeats(no_docs).collect() == []


def test_runs_hold_each_window_once(monkeypatch):
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab \n") for _ in range(n)) for n in (0, 49, 50, 51, 400, 1000)] + [b"z" * 500]
    for stretch in (1 << 20, 120):
        monkeypatch.setattr(substrings, "STRETCH", stretch)
        found = Runs(texts)
        seen = sorted((int(i), int(b) + k) for i, b, n in zip(found.text, found.begin, found.windows) for k in range(n))
        assert seen == [(i, p) for i, t in enumerate(texts) for p in range(len(t) - 49)]
        name = {}
        for i, b, n, v in zip(found.text, found.begin, found.windows, found.name):
            for k in range(n):
                assert name.setdefault(texts[i][b + k : b + k + 50], v) == v


def test_equal_ranks_of_unequal_strings(monkeypatch):
    """Were all ranks the same, the comparison of bytes would still tell strings apart."""
    import numpy as np

    monkeypatch.setattr(substrings, "_window_ranks", lambda data, n: np.zeros(len(data), np.uint64))
    a, b = bytes(range(60)), bytes(range(100, 160))
    row = lambda doc, s: substrings._sent(1, 0, 0, *(np.array([x]) for x in (doc, doc - 5, 0, 60)), zlib.compress(s)).to_pylist()[0]
    (out,) = substrings._matched([row(1, a), row(2, b), row(3, b), row(4, a)], 50)
    got = [substrings._unsqueeze(out.to_pylist()[0][k]).tolist() for k in ("ranks", "begins", "sizes")]
    assert got == [[3, 4], [0, 0], [60, 60]]
