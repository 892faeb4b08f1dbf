import itertools
from collections import defaultdict

import numpy as np
import pytest

from tarnlake.llm import chat, queries
from tarnlake.llm.common import fold_of
SF = "/root/testdata/sf0.01"  # the smallest table has too few conversations


@pytest.fixture(scope="module")
def model(spark):
    return chat.learn(spark.read.parquet(f"{SF}/conversations.parquet"))


def test_roles_and_texts_of_held_out_conversations(spark):
    given = defaultdict(list)
    for conv_id, _, role, text in sorted(map(tuple, spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect())):
        given[conv_id].append((role, text))
    got = defaultdict(dict)
    for r in queries.op8_hmm_chat(spark, SF).collect():
        got[r["conv_id"]][r["turn"]] = (r["role_pred"], r["rendered"])
    held = [i for i in given if fold_of(i) == 0]
    assert set(got) == set(given) and len(held) > 3
    # without any marker a system turn that comes first looks like a user's
    turns = [(got[i].get(k, (None,))[0], r) for i in held for k, (r, _) in enumerate(given[i])]
    assert np.mean([a == b for a, b in turns]) >= 0.9
    marked = [i for i in held if chat.style_of(i) < 5]
    assert all(got[i][k][1] == chat.render(*turn) for i in marked for k, turn in enumerate(given[i]))


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    model = chat.Model.of_counts(rng.integers(0, 9, chat.STATES), rng.integers(0, 9, (chat.STATES,) * 2), rng.integers(0, 9, (chat.STATES, chat.SYMBOLS)))
    for _ in range(5):
        symbols = rng.integers(0, chat.SYMBOLS, 5).tolist()
        worth = lambda p: model.start[p[0]] + sum(model.emit[s, x] for s, x in zip(p, symbols)) + sum(model.move[a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
        best = max(itertools.product(range(chat.STATES), repeat=5), key=worth)
        assert worth(model.decode(symbols)) == pytest.approx(worth(best))


def test_markers():
    for text, role in (("User: hi", 2), ("### Human:", 2), ("**AI:** x", 3), ("[system] x", 1), ("<bot> x", 3), ("Q: x", 2), ("A:", 3), ("Note: x", 0), ("a b: c", 0), ("", 0), ("user hi", 0)):
        assert chat.marker(text)[0] == role


def test_every_style_round_trips(model):
    turns = [("system", "Be brief."), ("user", "Why?\nTell me."), ("assistant", "Because.\n\nIt is so."), ("user", "<|end|> Fine.")]
    for style in range(5):
        assert chat.parse(chat.write_transcript(turns, style)[0], model) == turns
    assert chat.render("user", "<|end|>").count("<|end|>") == 1


def test_odd_rows(spark, model):
    rows = [(1, 0, "user", "hi", "a"), (1, 1, None, "hello there", "b"), (1, 2, "robot", None, "c"), (1, None, "system", "", "d"), (None, 0, "user", "x.", "e"), (2, 0, "user", "same", "f"), (2, 0, "user", "same", "f"), (3, 5000, "user", "late", "g"), (3, 1, "user", "early", "g"), (4, 0, None, None, "h"), (5, 0, "user", "line\n" * 5000, "i")]
    got = [tuple(r) for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, stretch string").repartition(2)).collect()]
    assert {r[0] for r in got} == {1, None, 2, 3, 5} and sorted(r[1:3] for r in got if r[0] == 3) == [(2, 0), (2, 1)]
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(none).collect() == []
    texts = spark.createDataFrame([(1, "User: a\nAssistant: b"), (2, None), (3, " \n")], "id long, transcript string")
    assert [(r["id"], r["role"], r["text"]) for r in chat.parse_transcripts(texts, model).collect()] == [(1, "user", "a"), (1, "assistant", "b")]


def test_stretches_have_the_best_path():
    """A path through stretches is worth as much as the best one over all, whatever the ties."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    for k in range(30):
        model = chat.Model.of_counts(*(rng.integers(0, 2 + 9 * (k % 2), x) for x in (chat.STATES, (chat.STATES,) * 2, (chat.STATES, chat.SYMBOLS))))
        symbols = rng.integers(0, chat.SYMBOLS if k % 3 else 3, 40).tolist()
        worth = lambda p: model.start[p[0]] + sum(model.emit[s, x] for s, x in zip(p, symbols)) + sum(model.move[a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
        cuts = [0, *sorted(rng.choice(range(1, 40), 4, replace=False).tolist()), 40]
        rows = []
        for i, (a, b) in enumerate(itertools.pairwise(cuts)):
            (x, m), (y, n) = model.passage(symbols[a:b], True), model.passage(symbols[a:b], False)
            rows.append({"conv_id": 1, "stretch": i, "n_given": 1, "start_score": x.ravel().tolist(), "start_begun": m.ravel().tolist(), "score": y.ravel().tolist(), "begun": n.ravel().tolist()})
        placed = chat._place((1,), pa.Table.from_pylist(rows[::-1], chat._PASSAGES)).to_pylist()
        path = []
        for r, (a, b) in zip(placed, itertools.pairwise(cuts)):
            assert r["before"] == sum(s % 2 == 0 for s in path) and r["n_all"] == 5
            path += model.decode(symbols[a:b], r["entry"], r["last"])
        assert worth(path) == pytest.approx(worth(model.decode(symbols)))


def test_cuts_leave_no_trace(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = ["yes", "no", "Why?", "It is so.", "one\ntwo", "a <|end|>", "long " * 30, "", None, "User: x", "first\n\nsecond"]
    ids = [i for i in range(40) if chat.style_of(i) < 5]  # where no two readings are as likely
    rows = [(i, t, str(rng.choice(["user", "assistant", "system"])), words[rng.integers(len(words))]) for i in ids for t in range(int(rng.integers(1, 40)))]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    model = chat.learn(docs)
    monkeypatch.setattr(chat, "learn", lambda *_: model)
    want = sorted((tuple(r) for r in chat.format_conversations(docs).collect()), key=str)
    assert any("first\n\nsecond" in r[-1] for r in want)
    for n in (1, 2, 7):
        monkeypatch.setattr(chat, "STRETCH", n)
        assert sorted((tuple(r) for r in chat.format_conversations(docs).collect()), key=str) == want
