"""A deterministic sharded WARC writer, and a reader.

Shards are ranges of the record id and, among records that share one, of a hash
of the payload. Their bounds are taken from a sample that depends on these
alone, so the same records always give the same files. Each shard is a
partition of its own; its task sorts it by id and streams it into gzip members,
one per record; a file is closed once its compressed size reaches a bound. It is
written under a temporary name and renamed, so a repeated task replaces it with
the same bytes; only what the manifest table lists is committed. Record headers
and digests are made anew from the payload.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.common import pieces, stage, width

LEAST_REVISIT = 100
SHARD_BYTES = 32 << 20
#: Beyond so many, shards grow instead. Of the sample, about so many fall into a shard.
MOST_SHARDS, PER_SHARD = 1 << 16, 64
NO_ID = -(1 << 63)
FILE_BYTES = 16 << 20
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "shard int, path string, records long, bytes long, sha256 string"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id_of(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC 1.1 record, uncompressed: a revisit without payload if ``refers_to`` is given."""
    digest = hashlib.sha256(payload).hexdigest()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if refers_to is None else "revisit"
    block += payload if refers_to is None else b""
    head = [("WARC-Type", kind), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    head.append(("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"))
    if refers_to is not None:
        head.append(("WARC-Refers-To", _urn(refers_to)))
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member without a time or a name."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Bounds:
    """First ``(id, place)`` of the shards but the first, ascending."""

    def __init__(self, ids: np.ndarray, places: np.ndarray) -> None:
        self.ids, self.places = ids, places

    @classmethod
    def of(cls, pages: DataFrame, shard_bytes: int) -> Bounds:
        """From ``pages(page_id, place, n_bytes)``, of which a sample comes to the driver, some rows for each shard."""
        n, size = pages.agg(F.count(F.lit(1)), F.sum("n_bytes")).first()
        shards = min(MOST_SHARDS, -(-(size or 0) // shard_bytes))
        empty = np.zeros(0, np.int64)
        if shards < 2:
            return cls(empty, empty)
        every = max(1, n // (shards * PER_SHARD))
        keys = pages.select(F.coalesce("page_id", F.lit(NO_ID)).alias("id"), "place", "n_bytes").where(F.pmod(F.xxhash64("id", "place"), F.lit(every)) == 0).toArrow()
        ids, places, sizes = (keys.column(x).to_numpy() for x in ("id", "place", "n_bytes"))
        order = np.lexsort((places, ids))
        before = np.cumsum(sizes[order]) - sizes[order]  # so that shards are alike in bytes, not in rows
        at = np.unique(np.searchsorted(before, np.arange(1, shards) * (int(sizes.sum()) / shards)))
        ids, places = ids[order][at[at < len(order)]], places[order][at[at < len(order)]]
        new = np.append(True, (ids[1:] != ids[:-1]) | (places[1:] != places[:-1]))[: len(ids)]
        return cls(ids[new], places[new])

    def shard(self, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How many bounds are at or before each key."""
        low, found = np.searchsorted(self.ids, ids), np.searchsorted(self.ids, ids, side="right")
        for i in np.unique(low[found > low]).tolist():  # ids that bounds have: told apart by place
            mine = np.flatnonzero((low == i) & (found > low))
            found[mine] = i + np.searchsorted(self.places[i : found[mine[0]]], places[mine], side="right")
        return found


def revisits(small: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``(page_id, digest, place, first)`` of ``small(page_id, digest, place, n_bytes)``: payloads of pages that a smaller id has."""
    firsts = small.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("_last"))
    firsts = firsts.where(F.col("first") < F.col("_last")).select("digest", "first")
    return small.join(firsts, "digest").where(F.col("page_id") > F.col("first")).select("page_id", "digest", "place", "first")


def write_warc(pages: DataFrame, out: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write ``pages(page_id, url, html)`` below ``out`` and return the manifest, which is written there too.

    ``out`` is a folder that all executors reach, by a URI that pyarrow knows.
    Of equal payloads of at least 100 bytes the smallest id keeps its payload
    and the others revisit it. A null html is an empty payload, a null url is
    left out, a page without id is a response that nothing refers to. Rows
    that repeat an id are all written, each with its own payload or, if a
    smaller id has that payload, a mark of it; other columns are left out; an
    empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    small = stage(pages.select("page_id", F.sha2("payload", 256).alias("digest"), F.xxhash64("payload").alias("place"), F.octet_length("payload").cast("long").alias("n_bytes")), "digests")
    bounds = spark.sparkContext.broadcast(Bounds.of(small, shard_bytes))

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series(bounds.value.shard(ids.to_numpy(), places.to_numpy()).astype(np.int32))

    marks = revisits(small).distinct().withColumns({"url": F.lit(None).cast("string"), "payload": F.lit(None).cast("binary")})
    rows = pages.withColumns({"place": F.xxhash64("payload"), "digest": F.lit(None).cast("string"), "first": F.lit(None).cast("long")}).unionByName(marks).withColumn("shard", shard_of(F.coalesce("page_id", F.lit(NO_ID)), "place"))
    # one shuffle: a mark arrives just before the rows with its id and payload
    rows = rows.repartitionById(len(bounds.value.ids) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "place", F.col("payload").isNotNull(), "url")

    def run(batches):
        writer, marked, firsts = None, None, {}
        for batch in pieces(batches, column="payload"):
            for row in batch.to_pylist():
                if writer is None or writer.shard != row["shard"]:
                    if writer:
                        yield from writer.end()
                    writer = _ShardWriter(out, row["shard"], file_bytes)
                if row["payload"] is None:
                    if marked != (row["page_id"], row["place"]):
                        marked, firsts = (row["page_id"], row["place"]), {}
                    firsts[row["digest"]] = row["first"]
                    continue
                first = firsts.get(hashlib.sha256(row["payload"]).hexdigest()) if marked == (row["page_id"], row["place"]) else None
                yield from writer.add(member(record(row["page_id"], row["url"], row["payload"], first), level))
        if writer:
            yield from writer.end()

    manifest = rows.mapInArrow(run, MANIFEST)
    manifest.write.parquet(f"{out}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


class _ShardWriter:
    """Rolls the files of one shard."""

    def __init__(self, out: str, shard: int, file_bytes: int) -> None:
        self.fs, self.root = fs.FileSystem.from_uri(out)
        self.shard, self.file_bytes, self.files = shard, file_bytes, 0
        self.stream = None

    def add(self, data: bytes) -> Iterator[pa.RecordBatch]:
        if self.stream is None:
            folder = posixpath.join(self.root, "temporary")
            self.fs.create_dir(folder, recursive=True)
            self.temporary = posixpath.join(folder, uuid.uuid4().hex)
            self.stream, self.digest = self.fs.open_output_stream(self.temporary, compression=None), hashlib.sha256()
            self.size = self.records = 0
        self.stream.write(data)
        self.digest.update(data)
        self.size += len(data)
        self.records += 1
        if self.size >= self.file_bytes:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.stream is None:
            return
        self.stream.close()
        self.stream = None
        name = f"part-{self.shard:05d}-{self.files:05d}.warc.gz"
        self.fs.move(self.temporary, posixpath.join(self.root, name))
        self.files += 1
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([self.shard], pa.int32()), "path": [name], "records": pa.array([self.records], pa.int64()), "bytes": pa.array([self.size], pa.int64()), "sha256": [self.digest.hexdigest()]}
        )


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    held = b""
    while True:
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if not held and not (held := stream.read(chunk)):
                if out:
                    raise ValueError("a gzip member is cut short")
                return
            out.append(unpack.decompress(held))
            held = unpack.unused_data
        yield b"".join(out)


def parse(data: bytes) -> dict:
    """The fields of one record; digests are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha256:"):
        raise ValueError(f"{fields['WARC-Record-ID']}: the block does not have its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.lower().split(b"content-length: ")[1].split(b"\r\n")[0])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not have its digest")
    refers = fields.get("WARC-Refers-To")
    return {"page_id": _id_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": refers and _id_of(refers), "payload": payload if kind == "response" else None}


def read_warc(spark: SparkSession, out: str, with_payload: bool = True) -> DataFrame:
    """The records of the files that the manifest below ``out`` lists; whole files are checked by their digest."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{out}/manifest")
    schema = READ if with_payload else READ.removesuffix(", payload binary")

    def run(batches):
        where, root = fs.FileSystem.from_uri(out)
        target = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())][: 7 if with_payload else 6])
        for batch in batches:
            for path, sha256 in zip(batch.column("path").to_pylist(), batch.column("sha256").to_pylist(), strict=True):
                with where.open_input_stream(posixpath.join(root, path), compression=None) as stream:
                    seen, held, size = _Digested(stream), [], 0
                    for data in members(seen):
                        held.append(parse(data))
                        size += len(data)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, target)
                            held, size = [], 0
                    if seen.digest.hexdigest() != sha256:
                        raise ValueError(f"{path} does not have the manifest's digest")
                    if held:
                        yield pa.RecordBatch.from_pylist(held, target)

    return manifest.select("path", "sha256").repartition(width(spark)).mapInArrow(run, schema)


class _Digested:
    def __init__(self, stream) -> None:
        self.stream, self.digest = stream, hashlib.sha256()

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.digest.update(data)
        return data
