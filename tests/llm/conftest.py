import random

import pytest

CLASHING = "row doc grp rest gone hit _gone _hit _row _share share same id kind shard token keys length_ before index node component tree key words n_words begins items".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rep long, fp string, piece string, " + ", ".join(f"`{x}` long" for x in CLASHING)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, long, repeated and near-equal texts, with columns whose names operators use inside."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "délta", "e", "ζ", "7", "it's", "end."]
    texts = [" ".join(rng.choice(words) + str(rng.randint(0, 40)) for _ in range(n)) for n in (1, 2, 3, 9, 40, 200, 400)]
    near = texts[5].split(" ")
    near[17] = "changed"
    texts += [texts[4], texts[4], " ".join(near), "x " * 30000, "", " \t\n", None, "é" * 60, "one  two\tthree", "\x1cq  r", texts[6][:900] + " cut"]
    rows = [(i * 3 % 37, t, None, "s", None, 1, "fp", None) for i, t in enumerate(texts)]
    rows += [(None, "no id at all", None, None, None, None, None, None), (3, texts[1], "en", "s", 1, 1, "a", "b")]
    return spark.createDataFrame([(*r, *range(len(CLASHING))) for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
