"""Removal of repeated byte strings by distributed prefix doubling over sampled positions.

A byte goes if a string of ``length`` bytes around it also starts in a document
with a smaller id. Prefix doubling names each position by the rank of its
prefix, doubles the prefix by pairing ranks at an offset, and drops positions
whose name is unique. Run on every position it would shuffle each byte of the
corpus as a pair of ranks several times over. Here the first round runs on
sampled positions only, chosen so that it loses nothing:

* The name of a window of ``length`` bytes is the least fingerprint of its
  grams of ``GRAM`` bytes. Neighbouring windows mostly share it, so a text is
  cut into runs of windows with one name, about one in sixteen bytes. Equal
  windows have equal names.
* Round one sorts (name, document) and drops names that one document alone has.
* Round two sends the bytes of the surviving runs to the place of their name.
  There the ranks of all windows are doubled, 8 to 16 to 25 to 50 bytes, by
  pairing ranks at offsets 8, 9 and 25, and sorted with their documents; each
  group's least document keeps its window. Matches are checked byte by byte.

Within a group of documents, runs that are equal as a whole go out once, for
the smallest id, so that copies in any number do not meet in one place.
Documents travel once, hashed into small groups; both rounds meet them there.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import pieces, runs, texts_of, width

LENGTH, GRAM = 50, 20
#: Windows in a run, bytes in a group of documents and in a stretch that is scanned at once.
LONGEST_RUN, GROUP_BYTES, STRETCH = 64, 16 << 20, 1 << 20
#: Bytes of text for each place where names, and where runs, are compared, and places for names at most; beyond, they hold more.
NAME_BYTES, RUN_BYTES, MOST_BUCKETS = 64 << 20, 8 << 20, 1 << 18

_U = np.uint64
_A, _B = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The name of a pair of names."""
    z = x * _A
    z ^= z >> _U(32)
    z += y
    z *= _B
    z ^= z >> _U(29)
    return z


def _loads(data: bytes) -> np.ndarray:
    """The eight bytes at each position."""
    return np.array(np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,)))


def _doubled(names: np.ndarray, offset: int) -> np.ndarray:
    return _pair(names[: max(0, len(names) - offset)], names[offset:])


def _sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    have = 1
    while 2 * have <= n:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


def _squeeze(x: np.ndarray) -> bytes:
    """Integers of at least 0, byte by byte of their places: empty places cost nothing."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unsqueeze(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


class Runs:
    """The runs of windows in texts: ``text`` (index), ``begin`` (in its text), ``windows``, ``name``."""

    def __init__(self, texts: list[bytes], length: int = LENGTH) -> None:
        parts: list[tuple] = []
        held, size = [], 0
        for i, text in enumerate(texts):
            for at in range(0, max(0, len(text) - length + 1), STRETCH):
                part = text[at : at + STRETCH + length - 1] if len(text) > STRETCH else text
                held.append((i, at, part))
                size += len(part)
                if size >= STRETCH:
                    parts.append(self._scan(held, length))
                    held, size = [], 0
        if held:
            parts.append(self._scan(held, length))
        columns = zip(*parts, strict=True) if parts else [[np.zeros(0, np.int64)]] * 3 + [[np.zeros(0, _U)]]
        self.text, self.begin, self.windows, self.name = (np.concatenate(x) for x in columns)

    @staticmethod
    def _scan(held: list[tuple[int, int, bytes]], length: int) -> tuple:
        sizes = np.array([len(x) for *_, x in held])
        starts = np.cumsum(sizes) - sizes
        sixteen = _doubled(_loads(b"".join(x for *_, x in held)), 8)
        names = _sliding_least(_doubled(sixteen, GRAM - 16), length - GRAM + 1)
        new = np.concatenate(([True], names[1:] != names[:-1]))
        new[starts] = True
        valid = np.zeros(len(names) + 1, np.int64)
        ends = starts + sizes - length + 1
        np.add.at(valid, starts, 1)
        np.add.at(valid, ends, -1)
        inside = np.cumsum(valid[:-1]) > 0
        first = np.flatnonzero(new & inside)
        at = np.searchsorted(starts, first, side="right") - 1
        n = np.minimum(np.append(first[1:], ends[-1]), ends[at]) - first
        cuts = -(-n // LONGEST_RUN)
        first, at, n = np.repeat(first, cuts), np.repeat(at, cuts), np.repeat(n, cuts)
        k = (np.arange(len(first)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * LONGEST_RUN
        first, n = first + k, np.minimum(n - k, LONGEST_RUN)
        which, base = (np.array(x) for x in zip(*((i, b) for i, b, _ in held), strict=True))
        return which[at], first - starts[at] + base[at], n, names[first]


def _split(names: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 further bits of a name, as one integer; what shares them may be, but need not be, the same name."""
    return (names & _U(0xFFFFFF)) % _U(buckets) << _U(32) | names >> _U(24) & _U(0xFFFFFFFF)


NAMED = "bucket int, docs binary, keys binary, which binary, ids binary"
FOUND = "grp int, docs binary, keys binary"


def _send_names(docs: DataFrame, buckets: int, length: int) -> DataFrame:
    """The names of each document, in one row for each bucket and some megabytes of documents."""

    def flush(held):
        docs, ids, which, keys = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(keys)
        which, keys = which[order], keys[order]
        cuts = np.searchsorted(keys >> _U(32), np.arange(buckets + 1, dtype=_U))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(cuts[b], cuts[b + 1])
            used, at = np.unique(which[part], return_inverse=True)
            yield pa.RecordBatch.from_pydict(
                {"bucket": pa.array([b], pa.int32()), "docs": [docs[used].tobytes()], "keys": [_squeeze(np.diff(keys[part] & _U(0xFFFFFFFF), prepend=_U(0)))], "which": [_squeeze(at)], "ids": [ids[used].tobytes()]}
            )

    def run(batches):
        held, docs_before, entries = [], 0, 0
        for batch in pieces(batches):
            found = Runs(texts_of(batch, "text"), length)
            key = _split(found.name, buckets)
            order = np.lexsort((key, found.text))
            which, key = found.text[order], key[order]
            first = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (key[1:] != key[:-1])))) if len(key) else order
            held.append((batch.column("doc").to_numpy(), batch.column("doc_id").to_numpy(), which[first] + docs_before, key[first]))
            docs_before += batch.num_rows
            entries += len(first)
            if entries > 2_000_000:
                yield from flush(held)
                held, docs_before, entries = [], 0, 0
        if held:
            yield from flush(held)

    return docs.select("doc", "doc_id", "text").mapInArrow(run, NAMED)


def _shared_names(named: DataFrame, groups: int) -> DataFrame:
    """Round one: what of a document's names another document has too, in rows for each group of documents."""

    def run(batches):
        now, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != now and held:
                    yield from _shared_in_bucket(now, held, groups)
                    held = []
                now = row["bucket"]
                held.append([np.frombuffer(row["docs"], "<i8"), np.frombuffer(row["ids"], "<i8"), np.cumsum(_unsqueeze(row["keys"])).astype(np.uint32), _unsqueeze(row["which"])])
        if held:
            yield from _shared_in_bucket(now, held, groups)

    # dealt by number, as a hash would put several in one task and none in another
    parts = width(named.sparkSession)
    return named.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket").mapInArrow(run, FOUND)


def _shared_in_bucket(bucket: int, held: list, groups: int):
    docs, ids, keys, which = zip(*held, strict=True)
    before = np.cumsum([0, *map(len, docs)])
    docs, ids, keys = np.concatenate(docs), np.concatenate(ids), np.concatenate(keys)
    which = np.concatenate([w + b for w, b in zip(which, before, strict=False)])
    order = np.argsort(keys)
    which, keys = which[order], keys[order]
    first = runs(keys)
    if not len(first):
        return
    own = ids[which]
    several = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
    kept = np.repeat(several, np.diff(np.append(first, len(keys))))
    which, keys = which[kept], keys[kept].astype(_U) | _U(bucket) << _U(32)
    docs = docs[which]
    grp = docs % groups
    order = np.lexsort((docs, grp))
    grp, docs, keys = grp[order], docs[order], keys[order]
    cuts = [*runs(grp).tolist(), len(grp)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield pa.RecordBatch.from_pydict({"grp": pa.array([grp[a]], pa.int32()), "docs": [docs[a:b].tobytes()], "keys": [keys[a:b].tobytes()]})


#: kind 0: spans of documents, for their group ``dest``; kind 1: runs of group ``grp``, for the place ``dest`` of
#: their names. Documents go by their rank among the group's. ``ids`` are relative to the least, ``base``.
SENT = "kind int, dest int, grp int, base long, ranks binary, ids binary, begins binary, sizes binary, bytes binary"


def _sent(kind: int, dest: int, grp: int, ranks, ids, begins, sizes, data: bytes = b"") -> pa.RecordBatch:
    base = int(ids.min()) if len(ids) else 0
    ints = (pa.array([x], pa.int32()) for x in (kind, dest, grp))
    wide = (ids - base).astype(np.uint64)
    return pa.RecordBatch.from_arrays([*ints, pa.array([base], pa.int64()), *(pa.array([_squeeze(x)], pa.binary()) for x in (ranks, wide, begins, sizes)), pa.array([data], pa.binary())], ["kind", "dest", "grp", "base", "ranks", "ids", "begins", "sizes", "bytes"])


def _send_runs(places: int, buckets: int, length: int):
    def run(key, docs: pa.Table, found: pa.Table) -> pa.Table:
        grp, out = key[0].as_py(), [_sent(0, key[0].as_py(), key[0].as_py(), *[np.zeros(0, np.int64)] * 4)]
        if not docs.num_rows or not found.num_rows:
            return pa.Table.from_batches(out)
        known = [np.concatenate([np.frombuffer(x, t) for x in found.column(c).to_pylist()]) for c, t in (("docs", "<i8"), ("keys", "<u8"))]
        texts, doc, ids = [], docs.column("doc").to_numpy(), docs.column("doc_id").to_numpy()
        cut: list[tuple] = []
        for batch in pieces(docs.to_batches()):
            part = texts_of(batch, "text")
            scan = Runs(part, length)
            own = batch.column("doc").to_numpy()
            names = np.unique(own)
            place = np.minimum(np.searchsorted(names, known[0]), len(names) - 1)
            here = names[place] == known[0]
            there = np.sort(place[here].astype(_U) << _U(48) | known[1][here])
            mine = np.searchsorted(names, own)[scan.text].astype(_U) << _U(48) | _split(scan.name, buckets)
            at = np.minimum(np.searchsorted(there, mine), max(0, len(there) - 1))
            kept = there[at] == mine if len(there) else np.zeros(len(mine), bool)
            cut.append((scan.text[kept] + len(texts), scan.begin[kept], scan.windows[kept], scan.name[kept]))
            texts += part
        which, begin, n, name = (np.concatenate(x) for x in zip(*cut, strict=True))
        rank = np.searchsorted(np.unique(doc), doc)
        strings = [texts[i][b:e] for i, b, e in zip(which.tolist(), begin.tolist(), (begin + n + length - 1).tolist(), strict=True)]
        owner = ids[which]
        least: dict[bytes, int] = {}
        for s, d in zip(strings, owner.tolist(), strict=True):
            if d < least.get(s, d + 1):
                least[s] = d
        later = owner > np.array([least[s] for s in strings], np.int64) if strings else np.zeros(0, bool)
        size = n + length - 1
        out.append(_sent(0, grp, grp, rank[which[later]], owner[later], begin[later], size[later]))
        dest = ((name >> _U(8)) % _U(places)).astype(np.int64)
        rest = np.flatnonzero(~later)
        rest = rest[np.lexsort((begin[rest], rank[which[rest]], dest[rest]))]
        cuts = [*runs(dest[rest]).tolist(), len(rest)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            k = rest[a:b]
            packed = zlib.compress(b"".join([strings[i] for i in k.tolist()]), 6)
            out.append(_sent(1, int(dest[k[0]]), grp, rank[which[k]], owner[k], begin[k], size[k], packed))
        return pa.Table.from_batches(out)

    return run


def _match(sent: DataFrame, length: int) -> DataFrame:
    """Round two: spans of documents, in rows for their groups."""

    def run(batches):
        now, held = None, []
        for batch in batches:
            for i, (kind, dest) in enumerate(zip(batch.column("kind").to_pylist(), batch.column("dest").to_pylist(), strict=True)):
                if kind == 0:
                    yield batch.slice(i, 1)
                    continue
                if dest != now and held:
                    yield from _matched(held, length)
                    held = []
                now = dest
                held += batch.slice(i, 1).to_pylist()
        if held:
            yield from _matched(held, length)

    parts = width(sent.sparkSession)
    return sent.repartitionById(parts, F.col("dest") % parts).sortWithinPartitions("kind", "dest").mapInArrow(run, SENT)


def _window_ranks(data: bytes, length: int) -> np.ndarray:
    """Ranks of the windows at all positions, by doubling."""
    have, names = 8, _loads(data)
    for more in (16, length // 2, length):
        names = _doubled(names, more - have)
        have = more
    return names


def _matched(held: list[dict], length: int):
    read = lambda k: np.concatenate([_unsqueeze(r[k]) for r in held])
    ranks, begins, sizes = read("ranks"), read("begins"), read("sizes")
    count = [len(_unsqueeze(r["ranks"])) for r in held]
    ids = np.concatenate([(_unsqueeze(r["ids"]).view(_U) + np.array(r["base"]).astype(_U)).view(np.int64) for r in held])
    grp = np.repeat([r["grp"] for r in held], count)
    data = b"".join(zlib.decompress(r["bytes"]) for r in held)
    n = sizes - length + 1
    run = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    place = (np.cumsum(sizes) - sizes)[run] + step
    rank = _window_ranks(data, length)[place]
    order = np.argsort(rank)
    first = runs(rank[order])
    owner = ids[run[order]]
    size = np.diff(np.append(first, len(order)))
    later = owner > np.repeat(np.minimum.reduceat(owner, first), size)
    if later.any():
        later &= _same_bytes(data, place[order], owner, first, size, length)
    gone = np.sort(order[later])
    if not len(gone):
        return
    new = np.concatenate(([True], (np.diff(gone) != 1) | (np.diff(run[gone]) != 0)))
    a, b = gone[new], gone[np.append(new[1:], True)]
    which = run[a]
    order = np.lexsort((begins[which] + step[a], ranks[which], grp[which]))
    a, b, which = a[order], b[order], which[order]
    cuts = [*runs(grp[which]).tolist(), len(which)]
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        k, to = which[x:y], int(grp[which[x]])
        yield _sent(0, to, to, ranks[k], ids[k], begins[k] + step[a[x:y]], step[b[x:y]] - step[a[x:y]] + length)


def _same_bytes(data: bytes, place: np.ndarray, owner: np.ndarray, first: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Whether a window equals one of a smaller document in its group: as a rule the one of the least document."""
    loads, same = _loads(data), np.ones(len(place), bool)
    least = first + _argmin_in_runs(owner, first, size)
    other = place[np.repeat(least, size)]
    for k in (*range(0, length - 8, 8), length - 8):
        same &= loads[place + k] == loads[other + k]
    for g in np.flatnonzero(~np.logical_and.reduceat(same, first)).tolist():  # two strings with one rank
        part = range(first[g], first[g] + size[g])
        strings = [data[place[i] : place[i] + length] for i in part]
        best: dict[bytes, int] = {}
        for s, i in zip(strings, part, strict=True):
            best[s] = min(best.get(s, owner[i]), owner[i])
        same[part.start : part.stop] = [owner[i] > best[s] for s, i in zip(strings, part, strict=True)]
    return same


def _argmin_in_runs(x: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    is_least = x == np.repeat(np.minimum.reduceat(x, first), size)
    at = np.flatnonzero(is_least)
    return at[np.searchsorted(at, first)] - first


def _merge(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans put together where they overlap or touch."""
    if not len(begins):
        return begins, ends
    order = np.argsort(begins)
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], begins[1:] > ends[:-1]))
    return begins[new], ends[np.append(new[1:], True)]


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digest(text: bytes, kept: bytes, spans: int) -> tuple:
    return len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest()


def _finish(clean: bool):
    def run(key, docs: pa.Table, spans: pa.Table) -> pa.Table:
        of, begins, sizes = (np.concatenate([np.zeros(0, np.int64), *map(_unsqueeze, spans.column(c).to_pylist())]) for c in ("ranks", "begins", "sizes"))
        order = np.argsort(of)
        of, begins, ends = of[order], begins[order], (begins + sizes)[order]
        ranked = np.unique(docs.column("doc").to_numpy())
        made = []
        for batch in docs.to_batches():
            rank = np.searchsorted(ranked, batch.column("doc").to_numpy())
            cut = np.searchsorted(of, np.stack((rank, rank + 1))).T.tolist()
            for (a, b), doc_id, text in zip(cut, batch.column("doc_id").to_pylist(), texts_of(batch, "text"), strict=True):
                low, high = _merge(begins[a:b], ends[a:b])
                edges = [0, *np.stack((low, high), axis=1).ravel().tolist(), len(text)]
                kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)) if len(low) else text
                made.append(kept.decode("utf-8", "ignore") if clean else (doc_id, *_digest(text, kept, len(low))))
        if clean:
            found = docs.select(["rest", "text"])
            old = found.column("text")
            whole = pa.array([None if o is None and not t else t for o, t in zip(old.to_pylist(), made, strict=True)], old.type)
            return found.set_column(1, "text", pa.chunked_array([whole]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array(x, k) for x, k in zip(zip(*made, strict=True) if made else [[]] * 5, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _repeats(docs: DataFrame, length: int, clean: bool) -> DataFrame:
    spark = docs.sparkSession
    # other columns go along as one, so that their names meet no others
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([rest.alias("rest")] if clean else []))
    size = whole.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = width(spark)
    groups = max(2 * parts, -(-size // GROUP_BYTES)) | 1
    buckets = min(MOST_BUCKETS, max(min(parts, 12), size // NAME_BYTES))
    places = max(parts, -(-size // RUN_BYTES))
    doc: Column = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit((1 << 62) - 57))
    keyed = whole.where("doc_id is not null").select("*", doc.alias("doc"), (doc % F.lit(groups)).cast("int").alias("grp"))
    found = _shared_names(_send_names(keyed, buckets, length), groups)
    by_group = keyed.groupBy("grp")
    sent = by_group.cogroup(found.groupBy("grp")).applyInArrow(_send_runs(places, buckets, length), SENT)
    spans = _match(sent, length)
    schema = whole.select("rest", "text").schema if clean else DIGEST
    done = by_group.cogroup(spans.groupBy("grp")).applyInArrow(_finish(clean), schema)
    none = whole.where("doc_id is null")
    if clean:
        kind = docs.schema["text"].dataType
        return done.unionByName(none.select("rest", "text")).select(*(F.col("text").cast(kind).alias("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns))
    text = F.coalesce("text", F.lit("")).cast("binary")
    zero = F.lit(0).cast("long")
    none = none.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"))
    return done.unionByName(none)


def repeat_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``, a row per row of ``docs``.

    Texts are taken as UTF-8 bytes, null as empty. Repeats are judged on the
    input, not on what is left; they may overlap. Rows without a doc_id
    neither lose bytes nor take any; rows that share one do not take bytes
    from each other. ``length`` is at least 36.
    """
    return _repeats(docs, length, clean=False)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs``, all columns, without the repeats in ``text``.

    What is left of a character that is cut goes too; a null text stays null.
    Other columns may have any names.
    """
    return _repeats(docs, length, clean=True)
