import hashlib
import re

from tarnlake.llm import queries
from tarnlake.llm.decontaminate import contamination, excise, summary, words
from tests.conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=10):
    windows = {}
    for item_id, text in items:
        w = split(text)
        if item_id is not None and w:
            for i in range(max(1, len(w) - size + 1)):
                windows.setdefault(tuple(w[i : i + size]), set()).add(item_id)
    sizes = {len(k) for k in windows}
    out = []
    for doc_id, text in docs:
        w, hit, got = split(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    got |= found
        sha = hashlib.sha256(",".join(sorted(map(str, got))).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(got), sha, bool(hit)))
    return out


def test_words_of_bytes_as_of_text(odd_docs):
    for r in odd_docs.collect():
        assert [w.decode() for w in words((r["text"] or "").encode())] == split(r["text"])


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = [tuple(r) for r in queries.op7_benchmark_decontamination(spark, SF).collect()]
    assert sorted(got) == sorted(brute(docs, items))
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


ITEMS = "item_id long, text string, doc_id long"


def test_odd_rows_and_several_passes(spark, odd_docs):
    docs = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    texts = [t for _, t in docs if t]
    items = [(1, max(texts, key=len)[:80], None), (2, sorted(texts, key=len)[-2][50:220], 1), (3, None, 1), (None, texts[0], 1), (4, "", 1), (5, "alpha", 1), (2, "x", 1), (6, "three two", 1), (7, "one two THREE", 1)]
    table = spark.createDataFrame(items, ITEMS)
    key = lambda r: (r[0] is None, r)
    want = sorted(brute(docs, [x[:2] for x in items]), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    got = sorted((tuple(r) for r in summary(contamination(odd_docs, table)).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    assert got == want
    merged = {tuple(r) for r in summary(contamination(odd_docs, table, block_words=5)).collect()}
    assert merged == set(want)
    left = excise(odd_docs, table)
    assert left.columns == odd_docs.columns
    hit = {r[0] for r in want if r[-1]}
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - hit


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a x b y c d"), (3, "a x x x x b c d"), (4, "d c b a")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "a b c d")], "item_id long, text string")
    hit = lambda slop: {r["doc_id"] for r in contamination(docs, items, slop=slop).collect() if r["items"]}
    assert (hit(0), hit(2), hit(6)) == ({1}, {1, 2}, {1, 2, 3, 4})


def test_no_rows(spark, no_docs, odd_docs):
    none = spark.createDataFrame([], ITEMS)
    assert contamination(no_docs, none).collect() == []
    assert {r["n_hit"] for r in summary(contamination(odd_docs, none)).collect()} == {0}


def test_rows_that_share_an_id_or_have_none_are_judged_alone(spark):
    hit, clean = "a b c d e f g h i j k", "z y x w v u t s r q p"
    rows = [(None, hit), (None, clean), (None, None), (1, hit), (1, clean), (2, clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(9, hit)], "item_id long, text string")
    left = sorted((tuple(r) for r in excise(docs, items).collect()), key=str)
    assert left == sorted([r for r in rows if r[1] != hit], key=str)


def test_several_passes_give_the_rows_of_one(spark, odd_docs):
    rows = [(None, "a b c"), (None, "c b a"), (1, "a b c"), (1, "x y z"), (1, "a b c"), (2, None), (2, "")]
    items = [(1, "a b"), (2, "x y"), (3, "c b a"), (4, "b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table = spark.createDataFrame(items, "item_id long, text string")
    for n in (1, 4, 1000):
        got = [tuple(r) for r in summary(contamination(docs, table, block_words=n)).collect()]
        assert sorted(got, key=str) == sorted(brute(rows, items), key=str)
