from collections import Counter, defaultdict

from tarnlake.llm import langid, queries
from tarnlake.llm.common import fold_of
from tarnlake.llm.langid import identify_languages, letters
from tests.conftest import SF


def grams(text):
    """N-grams of one to three letters of words with a blank on either side, as the codes in use order them."""
    code = {}
    out = Counter()
    low = text.lower()
    flat = [c if c.isalpha() else " " for c in low]
    for ch, c in zip(flat, letters(text).tolist()):
        code[ch] = c
    word = []
    for ch in [*flat, " "]:
        if ch != " ":
            word.append(ch)
            continue
        if word:
            w = [" ", *word, " "]
            for n in (1, 2, 3):
                for i in range(len(w) - n + 1):
                    g = w[i : i + n]
                    if n == 1 and g == [" "] or n == 3 and g[1] == " ":
                        continue
                    out[(n, *(code.get(x, 0) for x in reversed(g)))] += 1
        word = []
    return out


def top(counts, most=300):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most]]


def brute(rows, most=300):
    per = defaultdict(Counter)
    for i, text, lang in rows:
        if i is not None and text is not None and lang is not None and fold_of(i) != 0:
            per[lang].update(grams(text))
    profiles = {lang: {g: k for k, g in enumerate(top(c, most))} for lang, c in per.items()}
    out = []
    for i, text, _ in rows:
        mine = top(grams(text or ""), most)
        far = {lang: sum(abs(p[g] - k) if g in p else most for k, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get) if mine and far else "und"
        out.append((i, i is not None and fold_of(i) == 0, best, round(1 - far[best] / (most * len(mine)), 9) if mine and far else 0.0))
    return sorted(out, key=str)


def as_rows(table):
    return sorted(((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in table.collect()), key=str)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = as_rows(queries.op5_rank_order_langid(spark, SF))
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()])
    known = dict(docs.select("doc_id", "lang").collect())
    held = [r for r in got if r[1]]
    assert sum(known[r[0]] == r[2] for r in held) >= 0.98 * len(held)


def test_odd_rows(spark, odd_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text", "lang").collect()]
    got = as_rows(identify_languages(odd_docs))
    assert got == brute(rows) and {r[2] for r in got} == {"en", "und"}


def test_no_rows(spark, no_docs):
    assert identify_languages(no_docs).collect() == []


def test_long_text_in_chunks(monkeypatch):
    text = "The quick brown fox, où l'été 𝔞𝔟c. " * 9
    whole = langid.counted(text)
    monkeypatch.setattr(langid, "_CHUNK", 11)
    parts = langid.counted(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
