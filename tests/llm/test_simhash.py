import numpy as np
import xxhash

from tarnlake.llm import queries
from tarnlake.llm.simhash import fingerprint, simhash_groups
from tests.conftest import SF


def brute(rows):
    """Fingerprints bit by bit, and groups by comparing all pairs."""
    fps = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    ids = np.arange(len(rows))
    vec = np.array(fps, np.uint64)
    for _ in range(len(rows)):
        before = ids.copy()
        for i, fp in enumerate(vec):
            near = np.bitwise_count(vec ^ fp) <= 3
            ids[near] = ids[near].min()
        if (ids == before).all():
            break
    least = {}
    for (doc_id, _), g in zip(rows, ids):
        least[g] = min(least.get(g, doc_id), doc_id)
    return {(doc_id, f"{fp:016x}", least[g]) for (doc_id, _), fp, g in zip(rows, fps, ids)}


def test_query_against_all_pairs(spark):
    got = {tuple(r) for r in queries.op4_simhash_multi_index(spark, SF).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got == brute(rows)
    assert len({g for *_, g in got}) < len(got)


def test_odd_rows(spark, odd_docs):
    rows = simhash_groups(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    given = [tuple(r) for r in odd_docs.select("doc_id", "text").where("doc_id is not null").collect()]
    assert {tuple(r) for r in rows if r[0] is not None} == brute(given)
    empty = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert len(empty) >= 3 and len({r["component_id"] for r in empty}) == 1


def test_no_rows(spark, no_docs):
    assert simhash_groups(no_docs).collect() == []


def test_links_at_three_bits_and_not_at_four(spark):
    from tarnlake.llm.common import components
    from tarnlake.llm.simhash import fingerprint_links

    rng = np.random.default_rng(1)
    base = rng.integers(-(1 << 63), 1 << 63, 40, dtype=np.int64)
    rows = []
    for i, fp in enumerate(base.tolist()):
        other = fp & (2**64 - 1)
        for b in rng.choice(64, 3 + i % 2, replace=False).tolist():
            other ^= 1 << b
        rows += [(fp, 2 * i), (other - (1 << 64) if other >> 63 else other, 2 * i + 1)]
    links = fingerprint_links(spark.createDataFrame(rows, "fp long, rep long"))
    assert {frozenset(r) for r in links.collect()} == {frozenset((2 * i, 2 * i + 1)) for i in range(0, 40, 2)}
    assert {tuple(r) for r in components(links).collect()} == {(j, 2 * i) for i in range(0, 40, 2) for j in (2 * i, 2 * i + 1)}


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(str(i * i) for i in range(500)).encode()
    whole = fingerprint(text)
    monkeypatch.setattr("tarnlake.llm.simhash.AT_ONCE", 7)
    assert fingerprint(text) == whole
