import numpy as np
import pytest

from tarnlake.llm import queries
from tarnlake.llm.neardup_vectors import vector_groups
from tests.conftest import SF


def brute(rows):
    """All pairs, by cosine in double precision."""
    good = [(i, np.array(v, np.float64) / np.abs(v).max()) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i, _ in rows if i is not None}
    n = {i: 0 for i, _ in rows if i is not None}
    for a, (i, x) in enumerate(good):
        for j, y in good[a + 1 :]:
            if len(x) == len(y) and i != j and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                links[i].add(j)
                links[j].add(i)
                n[i] += 1
                n[j] += 1
    root = {}
    for i in sorted(links):
        todo = [i] if i not in root else []
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = i
                todo += links[x]
    return {(i, n[i], root[i], root[i] == i) for i in links}


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = queries.op3_metric_range_join(spark, SF).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == brute(rows)


@pytest.mark.parametrize("block", [7, 40, 5000])
def test_odd_rows_and_small_blocks(spark, block):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        center = rng.normal(size=8)
        rows += [(center + rng.normal(size=8) * s).tolist() for s in rng.uniform(0, 0.25, 20)]
    rows += [rows[0]] * 40 + [[2 * x for x in rows[0]], [0.0] * 8, None, [], [1.0, None] * 4, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1e-200] * 8, [1e200] * 8, [1.0], [2.0], [-1.0]]
    rows = [(i * 7 % 1009, v, 1, 2) for i, v in enumerate(rows)] + [(None, rows[0], 1, 2), (None, None, 1, 2)]
    got = vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep long, n long").repartition(3), block=block).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got if r["vec_id"] is not None} == brute([r[:2] for r in rows])
    assert [tuple(r) for r in got if r["vec_id"] is None] == [(None, 0, None, True)] * 2


def test_no_rows(spark):
    assert vector_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_repeated_rows_count_once(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, [1.0, 0.01]), (4, [1.0, 0.01])]
    got = vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, 1, True)] * 2 + [(2, 2, 1, False)] + [(3, 0, 3, True)] * 2 + [(4, 2, 1, False)] * 2


def test_distances_to_the_pivot_prune_and_lose_nothing():
    from tarnlake.llm.neardup_vectors import _Block

    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    far = np.linalg.norm(x - x[0], axis=1)
    x, far = x[np.argsort(far)], np.sort(far)
    block = _Block()
    block.reps, block.vecs, block.fars = list(range(400)), [v.tobytes() for v in x], far.tolist()
    for at in range(0, 400, 50):
        block.meet(np.arange(at, at + 50), np.ones(50, np.int64), far[at : at + 50], block.vecs[at : at + 50], 0.95)
    assert [n for *_, n in block.end()] == ((x @ x.T >= 0.95).sum(axis=1) - 1).tolist()
