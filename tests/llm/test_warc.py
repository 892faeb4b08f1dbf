import hashlib

import pyarrow as pa
import pytest

from tarnlake.llm import queries
from tarnlake.llm.common import new_path
from tarnlake.llm.warc import Bounds, member, members, parse, read_warc, record, write_warc
from tests.conftest import SF


def brute(pages):
    first = {}
    for page_id, body in pages:
        if page_id is not None and len(body) >= 100:
            first[body] = min(first.get(body, page_id), page_id)
    out = []
    for page_id, body in pages:
        to = first.get(body, page_id)
        to = None if page_id is None or to == page_id else to
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def test_query(spark):
    pages = [(i, (h or "").encode()) for i, h in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()]
    got = queries.op9_warc_writer(spark, SF)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(pages)


@pytest.fixture
def pages(spark):
    long = "<p>é\r\n\r\nWARC/1.1 " + "z" * 300
    rows = [(5, "http://a/ü x", long, 1), (2, None, long, 1), (9, "http://b", long, 2), (2, None, long, 1), (None, "u", long, 3), (3, "u", "small", 0), (4, "u", "small", 0), (7, "u", None, 0), (8, "u", "", 0)]
    rows += [(100 + i, f"http://c/{i}", f"{i}" * 200 if i % 3 else long, i) for i in range(60)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, first long").repartition(4)


def test_odd_rows_shards_and_repeats(spark, pages):
    want = brute([(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()])
    files = []
    for n in (3, 5):
        out = new_path(spark, "warc-test")
        manifest = write_warc(pages.repartition(n), out, shard_bytes=3000, file_bytes=600)
        files.append(sorted(tuple(r) for r in manifest.collect()))
        got = read_warc(spark, out).collect()
        assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == want
        assert all(len(r["payload"]) == r["payload_bytes"] for r in got if r["record_type"] == "response")
    assert files[0] == files[1] and len({f[0] for f in files[0]}) > 2 and len(files[0]) > len({f[0] for f in files[0]})


def test_no_rows(spark, pages):
    out = new_path(spark, "warc-test")
    assert write_warc(pages.limit(0), out).collect() == []
    assert read_warc(spark, out).collect() == []


def test_bounds_tell_one_id_apart_by_payload():
    import numpy as np

    bounds = Bounds(np.array([3, 7, 7, 7, 9]), np.array([5, -4, 0, 8, 2]))
    keys = [(i, p) for i in range(11) for p in range(-6, 12)]
    got = bounds.shard(*(np.array(x) for x in zip(*keys)))
    assert got.tolist() == [sum((a, b) <= k for a, b in zip(bounds.ids.tolist(), bounds.places.tolist())) for k in keys]


def test_a_hot_id_goes_to_several_shards(spark):
    rows = [(1 if i % 3 else None, f"http://a/{i}", f"{i} " * 300) for i in range(90)] + [(0, "x", "0 " * 300)]
    out = new_path(spark, "warc-test")
    manifest = write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), out, shard_bytes=5000)
    assert max(r["records"] for r in manifest.collect()) < 30
    got = read_warc(spark, out).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute([(i, h.encode()) for i, _, h in rows])


def test_record_round_trip_and_damage():
    data = record(7, "http://x/é", b"body\r\n\r\n" * 9, None)
    assert parse(data)["payload"] == b"body\r\n\r\n" * 9
    with pytest.raises(ValueError, match="digest"):
        parse(data.replace(b"body", b"bodi", 1))
    assert list(members(pa.input_stream(pa.py_buffer(member(b"a") + member(b"b"))), 3)) == [b"a", b"b"]
    with pytest.raises(ValueError, match="cut short"):
        list(members(pa.input_stream(pa.py_buffer(member(b"abc" * 50)[:-9]))))


def test_an_id_with_several_payloads(spark):
    a, b, c = ("<p>" + x * 200 for x in "abc")
    rows = [(1, a), (2, b), (3, a), (3, b), (3, c), (3, "small"), (4, c), (4, "small"), (5, a), (5, a), (5, "other" * 50), (2, a), (None, a), (None, c)]
    pages = spark.createDataFrame([(i, f"http://a/{k}", h) for k, (i, h) in enumerate(rows)], "page_id long, url string, html string").repartition(3)
    out = new_path(spark, "warc-test")
    write_warc(pages, out)
    got = read_warc(spark, out).collect()
    want = brute([(i, h.encode()) for i, h in rows])
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == want
    assert {r["payload"].decode() for r in got if r["record_type"] == "response"} == {h for _, h in rows}
