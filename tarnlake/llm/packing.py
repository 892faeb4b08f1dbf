"""Packing token sequences into windows of fixed capacity.

What a packing looks like depends on the lengths alone, of which there are at
most as many as the capacity: a histogram of lengths, counted by Spark, is the
whole instance, however many documents there are. On it, the driver

1. fixes sets that provably dominate all others, as in the Martello-Toth
   reduction, over and over until none is left;
2. packs the rest best-fit in decreasing order, whole groups of alike bins at
   a time.

The result is a list of ranges: the i-th to j-th pieces of a length go to such
bins at such offsets. Spark numbers the pieces of each length in two levels
(counts of salted shares, then ranks within a share), so that no task holds all
pieces of a frequent length, and each piece looks its place up.

Dominance used here: for an item j and bins of capacity c, a set F that holds j
dominates if any other feasible set with j can be mapped into F, each member of
F taking members whose sum it covers. Let r = c - w(j), s1 <= s2 <= ... the
smallest other items and b the largest other item that fits into r. Then
  * {j} dominates if s1 > r: nothing else fits;
  * {j, b} dominates if w(b) = r: any other company of j sums to at most w(b);
  * {j, b} dominates if s1 + s2 > r: the company of j is a single item, no larger than b;
  * {j, b} dominates if s1 + s2 + s3 > r and w(b) is no less than the best sum of two others within r.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from bisect import bisect_right, insort
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnlake.llm.common import SPACE, pieces, span_hashes, stage, strips, texts_of, width

CAPACITY = 4096
END = 1
#: Units of text whose ids a worker remembers, and the longest that is merged here.
REMEMBERED, LONGEST = 800_000, 64


@dataclass
class Plan:
    """Ranges ``(length, first, n, bin, per_bin, offset)`` and the number of bins.

    Pieces first..first+n-1 of a length go to the bins from ``bin`` on,
    ``per_bin`` to each, from ``offset`` on.
    """

    ranges: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    bins: int = 0
    fixed: int = 0
    used: dict[int, int] = field(default_factory=dict)

    def put(self, length: int, n: int, first_bin: int, per_bin: int, offset: int) -> None:
        at = self.used.get(length, 0)
        self.ranges.append((length, at, n, first_bin, per_bin, offset))
        self.used[length] = at + n


def _fix(plan: Plan, left: dict[int, int], members: list[int], times: int) -> None:
    offset = 0
    for w in members:
        plan.put(w, times, plan.bins, 1, offset)
        left[w] -= times
        offset += w
    plan.bins += times
    plan.fixed += times


def _smallest(left: dict[int, int], lengths: list[int], without: int, most: int) -> list[int]:
    """The smallest items, one of ``without`` taken away."""
    found: list[int] = []
    for w in lengths:
        n = left[w] - (w == without)
        found += [w] * min(max(n, 0), most - len(found))
        if len(found) == most:
            break
    return found


def _best_two(left: dict[int, int], lengths: list[int], without: int, room: int) -> int:
    """The largest sum of two items within ``room``, or 0; lengths ascend."""
    best, i, k = 0, 0, len(lengths) - 1
    have = lambda w: left[w] - (w == without)
    while i <= k:
        a, b = lengths[i], lengths[k]
        if have(a) < 1:
            i += 1
        elif have(b) < 1 or a + b > room or (i == k and have(a) < 2):
            k -= 1
        else:
            best = max(best, a + b)
            i += 1
    return best


def reduce_by_dominance(plan: Plan, left: dict[int, int], capacity: int) -> None:
    """Fix dominating sets until a pass over the lengths, longest first, finds none."""
    changed = True
    while changed:
        changed = False
        for w in sorted((x for x in left if left[x]), reverse=True):
            while left[w]:
                lengths = sorted(x for x in left if left[x])
                room = capacity - w
                small = _smallest(left, lengths, w, 3)
                if not small or small[0] > room:
                    _fix(plan, left, [w], left[w])
                    changed = True
                    continue
                b = next(x for x in reversed(lengths) if x <= room and left[x] - (x == w) > 0)
                pair = b == room or len(small) < 2 or small[0] + small[1] > room
                if not pair and (len(small) < 3 or sum(small) > room):
                    pair = b >= _best_two(left, lengths, w, room)
                if not pair:
                    break
                # all three conditions stay true as items leave, until w or b is used up
                _fix(plan, left, [w, b], left[w] // 2 if b == w else min(left[w], left[b]))
                changed = True


def best_fit(plan: Plan, left: dict[int, int], capacity: int) -> None:
    """Best fit in decreasing order; bins with the same contents are one group."""
    groups: dict[int, list[tuple[int, int]]] = {}  # room left: (first bin, bins)
    rooms: list[int] = []

    def keep(room: int, first: int, n: int) -> None:
        if not n:
            return
        if room not in groups:
            insort(rooms, room)
            groups[room] = []
        groups[room].append((first, n))

    for w in sorted((x for x in left if left[x]), reverse=True):
        n = left[w]
        while n:
            at = bisect_right(rooms, w - 1)
            if at == len(rooms):  # a new bin takes as many as go in, as it is then the best fit for the next
                per, room = capacity // w, capacity
                full, rest = divmod(n, per)
                bins = full + bool(rest)
                keep(room, plan.bins, bins)
                plan.bins += bins
                continue
            room = rooms[at]
            first, bins = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            per = room // w
            full = min(bins, n // per)
            if full:
                plan.put(w, full * per, first, per, capacity - room)
                n -= full * per
            keep(room - per * w, first, full)
            first, bins = first + full, bins - full
            if bins and n and n < per:
                plan.put(w, n, first, n, capacity - room)
                keep(room - n * w, first, 1)
                first, bins, n = first + 1, bins - 1, 0
            keep(room, first, bins)
        left[w] = 0


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Place a histogram of lengths (1..capacity) into as few bins as the method finds."""
    plan, left = Plan(), {w: n for w, n in histogram.items() if n}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("lengths must be 1 to the capacity")
    reduce_by_dominance(plan, left, capacity)
    best_fit(plan, left, capacity)
    return plan


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``items``, which has ``length`` (1..capacity) and keeps its columns.

    ``items`` is read several times; give a table or something cheap. Within a
    sequence the offsets have no gaps. An empty table gives an empty one; columns
    that have the two names already are replaced, any other names are left alone.
    """
    spark = items.sparkSession
    shares = max(1, width(spark))
    items = items.drop("sequence_id", "offset")
    salted = items.select(F.struct("*").alias("row")).select("row", F.col("row.length").alias("length"))
    salted = salted.withColumn("share", F.pmod(F.xxhash64("row"), F.lit(shares)))
    counts = salted.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1))
    counts = stage(counts.select("length", "share", F.coalesce(before, F.lit(0)).alias("before"), "n"), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_packing(histogram, capacity)
    table = np.array(sorted(plan.ranges), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(table)  # at most a few ranges for each length and bin pattern
    rank = F.row_number().over(Window.partitionBy("length", "share").orderBy("row"))
    # the counts grow with the shares; rows are by length and share already, so that they move no more
    ranked = salted.withColumn("rank", rank).join(counts.drop("n").hint("merge"), ["length", "share"])
    ranked = ranked.select((F.col("before") + F.col("rank") - 1).cast("long").alias("index"), F.col("length").cast("long").alias("length"), "row")
    names = [*items.columns, "sequence_id", "offset"]

    def run(batches):
        ranges = shared.value
        keys = ranges[:, 0] << 40 | ranges[:, 1]
        for batch in batches:
            index, length = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            row = ranges[np.searchsorted(keys, length << 40 | index, side="right") - 1]
            i = index - row[:, 1]
            to = [pa.array(row[:, 3] + i // row[:, 4]), pa.array(row[:, 5] + i % row[:, 4] * length)]
            yield pa.RecordBatch.from_arrays([*batch.column(2).flatten(), *to], names)

    schema = StructType([*items.schema, *StructType().add("sequence_id", "long").add("offset", "long")])
    return ranked.mapInArrow(run, schema)


_NEVER = np.int32(1 << 30)
#: Words that are merged at once, so that they stay in a CPU's cache.
_WORDS_AT_ONCE = 4096


class WordPieces:
    """Byte-pair merges of many words at once, for a tokenizer file of kind BPE with word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary, ending = model["vocab"], model["end_of_word_suffix"]
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        keys = np.array([vocabulary[a] << 16 | vocabulary[b] for a, b in pairs], np.uint32)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.uint32)
        # byte-level alphabet: printable Latin-1 stands for itself, other bytes for what follows U+0100
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        names = {x: chr(x) for x in shown} | {x: chr(0x100 + k) for k, x in enumerate(sorted(set(range(256)).difference(shown)))}
        self.plain, self.last = (np.array([vocabulary[names[x] + end] for x in range(256)], np.uint32) for end in ("", ending))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << np.uint32(16) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER)

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word."""
        return [x for i in range(0, len(words), _WORDS_AT_ONCE) for x in self._merged(words[i : i + _WORDS_AT_ONCE])]

    def _merged(self, words: list[bytes]) -> list[bytes]:
        """In a round, each unfinished word merges its first pair of the lowest rank."""
        out = [b""] * len(words)
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words], np.int64)
        ids = self.plain[data]
        ends = np.cumsum(size) - 1
        ids[ends] = self.last[data[ends]]
        which = np.arange(len(words))
        rank = self._rank(ids, np.append(ids[1:], ids[:1]))
        rank[ends] = _NEVER
        while len(which):
            first = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, first)
            done = least == _NEVER
            if done.any():
                raw = ids.astype("<u4").tobytes()
                for w, x, n in zip(which[done].tolist(), first[done].tolist(), size[done].tolist(), strict=True):
                    out[w] = raw[4 * x : 4 * (x + n)]
                left = np.repeat(~done, size)
                ids, rank, which, size, least = ids[left], rank[left], which[~done], size[~done], least[~done]
                if not len(which):
                    break
                first = np.cumsum(size) - size
            word = np.repeat(np.arange(len(size)), size)
            at = np.flatnonzero(rank == least[word])
            own = word[at]
            at = at[np.append(True, own[1:] != own[:-1])]
            ids[at] = self.made[least]
            rank[at] = rank[at + 1]
            kept = np.ones(len(ids), bool)
            kept[at + 1] = False
            ids, rank = ids[kept], rank[kept]
            at -= np.arange(len(at))
            size -= 1
            first = np.cumsum(size) - size
            more = at[at < first + size - 1]
            rank[more] = self._rank(ids[more], ids[more + 1])
            rank[first + size - 1] = _NEVER
            back = at[at > first] - 1
            rank[back] = self._rank(ids[back], ids[back + 1])
        return out


#: Kinds of bytes: white space, letters, digits, other ASCII; in what follows, a unit is one kind of byte but for digits, each on its own.
_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_KINDS = np.full(256, _ODD, np.uint8)
_KINDS[:0x80] = [_LETTER if chr(x).isalpha() else _DIGIT if chr(x).isdigit() else _OTHER for x in range(0x80)]
_KINDS[SPACE], _KINDS[ord("'")] = _SPACE, _ODD
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_SLOTS = 1 << 21


class Encoder:
    """Ids of texts, as little-endian 32-bit bytes, by ``word_bpe_49k``-like tokenizers.

    Their splits never cross white space. A chunk between white space of ASCII
    without apostrophes and of Latin-1 letters is cut into units as the
    tokenizer's pattern does; any other chunk is a unit as a whole. The ids of
    units are remembered, up to a bound, in a hash table that is probed for all
    units of some texts at once. Common new units are merged many at a time;
    the tokenizer encodes others itself, and texts that hold special tokens.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.special = [x["content"].encode() for x in json.load(file)["added_tokens"]]
        self.merge = WordPieces(path)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.int32)
        self.begin, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)  # ids of unit i are ids[begin[i]:begin[i + 1]]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _odd(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks without ASCII white space."""
        split = [None if len(c) > LONGEST or _RARE.search(c) else _WORDS.findall(unicodedata.normalize("NFC", c).lower()) for c in chunks]
        words = list(set().union(*filter(None, split)))
        ids = dict(zip(words, self.merge([w.encode() for w in words]), strict=True))
        rest = iter(self.whole([c for c, x in zip(chunks, split, strict=True) if x is None]))
        return [next(rest) if x is None else b"".join(map(ids.__getitem__, x)) for x in split]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each unit, -1 for those not known."""
        out = np.full(len(keys), -1, np.int32)
        left, slot = np.arange(len(keys)), (keys >> np.uint64(20)).astype(np.int64) % _SLOTS
        while len(left):
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.at[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + 1) % _SLOTS
        return out

    def _put(self, keys: np.ndarray, ids: list[bytes]) -> None:
        """Remember the ids of distinct new units."""
        number = np.arange(len(self.begin) - 1, len(self.begin) - 1 + len(keys), dtype=np.int32)
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        self.begin = np.append(self.begin, self.begin[-1] + np.cumsum(sizes))
        self.ids = np.append(self.ids, np.frombuffer(b"".join(ids), "<u4"))
        left, slot = np.arange(len(keys)), (keys >> np.uint64(20)).astype(np.int64) % _SLOTS
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[left[free]]  # of several in a slot one stays
            own = self.keys[slot] == keys[left]
            self.at[slot[own]] = number[left[own]]
            left, slot = left[~own], (slot[~own] + 1) % _SLOTS

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        holds = [any(x in t for x in self.special) for t in texts]
        special = [i for i, held in enumerate(holds) if held]
        plain = [b"" if held else t for t, held in zip(texts, holds, strict=True)]
        out: list[list[bytes]] = [[] for _ in texts]
        for first, parts in strips(plain):
            for i, ids in enumerate(self._strip(parts), first):
                out[i].append(ids)
        for i, ids in zip(special, self.whole([texts[i].decode() for i in special]), strict=True):
            out[i] = [ids]
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def _strip(self, texts: list[bytes]) -> list[bytes]:
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        kind, data = _KINDS[raw], _LOWER[raw]
        lead = np.flatnonzero(raw == 0xC3)  # U+00C0 to U+00FF: letters but for two, the capitals 32 below the others
        if len(lead):
            lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
            kind[lead] = kind[lead + 1] = _LETTER
            data[lead + 1] += np.where(raw[lead + 1] < 0x9F, np.uint8(0x20), np.uint8(0))
        space = kind == _SPACE
        edge = np.empty(len(raw), bool)
        edge[0] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        edge |= kind == _DIGIT
        odd = np.flatnonzero(kind == _ODD)
        is_odd = np.zeros(len(raw), bool)
        if len(odd):  # whole chunks, as they are
            gaps = np.flatnonzero(space)
            after = np.unique(np.searchsorted(gaps, odd))
            begins, ends = np.where(after > 0, gaps[after - 1] + 1, 0), gaps[after]
            mark = np.zeros(len(raw) + 1, np.int8)
            mark[begins] += 1
            mark[ends] -= 1
            is_odd = np.cumsum(mark[:-1], dtype=np.int8).view(bool)
            edge &= ~is_odd
            edge[begins] = True
            data = np.where(is_odd, raw, data)
        first = np.flatnonzero(edge)
        units = ~space[first]
        size = np.diff(np.append(first, len(raw)))[units]
        first = first[units]
        keys = span_hashes(data, first, size) << np.uint64(1) | np.uint64(1)
        keys ^= is_odd[first].astype(np.uint64) << np.uint64(7)
        number = self._find(keys)
        if len(new := np.flatnonzero(number < 0)):
            new_keys, at = np.unique(keys[new], return_index=True)
            if len(self.begin) + len(new_keys) > REMEMBERED:
                self._forget()
                new_keys, at = np.unique(keys, return_index=True)
                new = np.arange(len(keys))
            self._learn(new_keys, data, first[new[at]], size[new[at]], is_odd)
            number[new] = self._find(keys[new])
        begin = self.begin[number]
        n = self.begin[number + 1] - begin
        total = np.append(0, np.cumsum(n))
        ids = self.ids[np.repeat(begin - total[:-1], n) + np.arange(total[-1])].astype("<u4").tobytes()
        ends = np.cumsum([len(x) + 1 for x in texts])
        cuts = [0, *(4 * total[np.searchsorted(first, ends)]).tolist()]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _learn(self, keys: np.ndarray, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, is_odd: np.ndarray) -> None:
        flat = data.tobytes()
        odd = is_odd[begins] | (sizes > LONGEST)
        strings = [flat[a : a + n] for a, n in zip(begins.tolist(), sizes.tolist(), strict=True)]
        ids: list[bytes] = [b""] * len(strings)
        for which, found in (
            (np.flatnonzero(~odd).tolist(), lambda x: self.merge(x)),
            (np.flatnonzero(odd).tolist(), lambda x: self._odd([c.decode() for c in x])),
        ):
            for i, got in zip(which, found([strings[i] for i in which]), strict=True):
                ids[i] = got
        self._put(keys, ids)


#: The tokenizer's pattern.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Beyond Latin, lower-cased in a way of their own, or white space for str.split() alone.
_RARE = re.compile("[^\x00-\x1b\x20-\u012f\u0131-\u024f]")
_ENCODERS: dict[str, Encoder] = {}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of whole texts, and ``ids`` (uint32, little-endian) if asked.

    A document is its tokens and ``end``; null and empty texts are ``end``
    alone. Longer ones than ``capacity`` are cut. ``tokenizer_path`` is a file
    that all executors have.
    """

    def run(batches):
        encoder = _ENCODERS.get(tokenizer_path) or _ENCODERS.setdefault(tokenizer_path, Encoder(tokenizer_path))
        stop = np.array([end], "<u4").tobytes()
        for batch in pieces(batches):
            rows: list[list] = [[] for _ in range(6)]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(texts_of(batch, "text")), strict=True):
                ids += stop
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for to, x in zip(rows, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                        to.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows[: len(names)], kinds, strict=False)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` with their ``sequence_id`` and ``offset``.

    Rows with null or repeated doc_id are packed like any other.
    """
    return pack(stage(token_pieces(docs, tokenizer_path, capacity, with_ids=with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, length, ids)`` of pieces packed with their ids: whole sequences, each at most the capacity."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("_parts")).select(
        "sequence_id", "length", F.aggregate("_parts", F.lit(b""), lambda x, y: F.concat(x, y)).alias("ids")
    )
