import random
from pathlib import Path

import pytest

from tarnlake.llm import common


@pytest.mark.parametrize("hub", [1 << 16, 9])
def test_components_against_a_search(spark, monkeypatch, hub):
    monkeypatch.setattr(common, "HUB", hub)
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5200)] + [(7, 7), (8, None), (None, 9)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = common.components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in list(parent))


def test_staged_tables_can_be_cleared(spark):
    path = common.new_path(spark, "some")
    df = common.stage(spark.range(5), path=path)
    assert df.count() == 5
    common.clear(spark, path)
    assert not Path(path.removeprefix("file://")).exists()


def test_long_texts_are_cut_at_white_space():
    texts = [b"ab cd", b"x" * 50 + b" y", b"", b"a b c d e f g h", b" " * 30]
    for most in (1, 4, 10, 1000):
        whole = [b""] * len(texts)
        for first, parts in common.strips(texts, most):
            for i, part in enumerate(parts, first):
                whole[i] += part
        assert whole == texts


@pytest.mark.parametrize("sizes", [[1, 3, 2], [70_000, 5, 70_000, 1]])
def test_span_hashes_depend_on_the_bytes_alone(sizes):
    import numpy as np

    rng = random.Random(1)
    spans = [bytes(rng.choice(b"abcxyz\xc3\xa9") for _ in range(n)) for n in sizes]
    one = common.span_hashes(*_laid(spans, b" "))
    two = common.span_hashes(*_laid(spans[::-1], b"\n \t"))
    assert one.tolist() == two[::-1].tolist() and len(np.unique(one)) == len(spans)


def _laid(spans, gap):
    import numpy as np

    data, begins = b"", []
    for x in spans:
        data += gap
        begins.append(len(data))
        data += x
    return np.frombuffer(data, np.uint8), np.array(begins), np.array([len(x) for x in spans])


@pytest.mark.parametrize(("master", "allowed"), [("local", True), ("local[8]", True), ("local[*]", True), ("local-cluster[3,2,1024]", False), ("yarn", False), ("spark://h:7077", False)])
def test_a_cluster_needs_a_shared_folder(master, allowed):
    from types import SimpleNamespace

    kept = {}
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: kept.get(k, d), set=kept.__setitem__), sparkContext=SimpleNamespace(master=master))
    if allowed:
        assert common.shared_dir(spark) == kept[common.CHECKPOINT_DIR]
    else:
        with pytest.raises(ValueError, match="checkpoint"):
            common.shared_dir(spark)
    kept[common.CHECKPOINT_DIR] = "hdfs://x/y/"
    assert common.shared_dir(spark) == "hdfs://x/y"
