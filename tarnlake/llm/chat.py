"""Chat transcripts to canonical turns.

A transcript is plain text, in which turns begin with a speaker's marker, in
one of many styles, or only with an empty line. A hidden Markov model reads it
line by line. Its states are a role that begins a turn or goes on with it, in a
transcript with markers or without; a
line's observation is its kind of marker, whether an empty line or nothing
stands before it, its length and how it ends. Starts, transitions and emissions
are smoothed counts over transcripts whose roles are known; the roles of others
are the Viterbi path. Turns are then written in one canonical form.

A conversation of many turns is dealt out in stretches. The best path through a
stretch is known for each pair of states before and at its end, a matrix, which
multiply to the path through all of them; each stretch is then decoded between
its own two states, so that the cuts leave no trace.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import fold, stage, width

ROLES = ("system", "user", "assistant")
#: Turns of one conversation that one task reads together.
STRETCH = 4096
#: Names of speakers that markers use.
SPEAKERS = {
    "system": ("system", "instruction", "instructions", "context"),
    "user": ("user", "human", "you", "q", "question", "customer", "prompter", "me"),
    "assistant": ("assistant", "ai", "bot", "a", "answer", "model", "agent", "gpt"),
}
#: Markers of system, user and assistant by style; the last style has none.
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("### System:\n", "### Human:\n", "### Assistant:\n"),
    ("[system] ", "Q: ", "A: "),
    ("<system> ", "<user> ", "<bot> "),
    ("**Context:** ", "**You:** ", "**AI:** "),
    ("", "", ""),
)
_KIND = {name: k + 1 for k, role in enumerate(ROLES) for name in SPEAKERS[role]}
_MARKER = re.compile(r"\s*(?:#{1,6}\s*|\*{1,2}|[<\[](?=[a-z]+[>\]]))?([a-z]{1,12})(?:\*{0,2}:\*{0,2}|[>\]]:?)(?:\s|$)", re.IGNORECASE)
#: A state is 2 * role, and one more if the line goes on with a turn; and GROUP more in transcripts without markers.
GROUP = 2 * len(ROLES)
STATES = 2 * GROUP
SYMBOLS = (len(ROLES) + 1) * 3 * 4 * 2
SMOOTH = 0.5


def marker(line: str) -> tuple[int, int]:
    """Kind of speaker (0 for none) and where the text after the marker begins."""
    found = _MARKER.match(line)
    kind = _KIND.get(found[1].lower(), 0) if found else 0
    return kind, found.end() if kind else 0


def observe(lines: list[str], before: int = 2) -> list[tuple[int, int]]:
    """For each line that is not empty its number and its symbol. ``before``: 2 at the start of a transcript, 1 after an empty line."""
    out = []
    for i, line in enumerate(lines):
        if not line.strip():
            before = max(before, 1)
            continue
        size = min(3, len(line).bit_length() // 3)
        ends = line.rstrip()[-1] in ".!?"
        out.append((i, ((marker(line)[0] * 3 + before) * 4 + size) * 2 + ends))
        before = 0
    return out


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def of_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        # no turn goes on before it began, nor in another role; a transcript has markers or has none
        allowed = np.array([[a // GROUP == b // GROUP and (b % 2 == 0 or b - 1 == a - a % 2) for b in range(STATES)] for a in range(STATES)])
        logs = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
        start = np.where(np.arange(STATES) % 2 == 0, start + SMOOTH, 1e-12)
        return cls(logs(start), np.where(allowed, logs(move + SMOOTH), -1e9), logs(emit + SMOOTH / SYMBOLS))

    def decode(self, symbols: list[int], entry: int | None = None, end: int | None = None) -> list[int]:
        """The most likely states, after the state ``entry`` and with ``end`` as the last if given; ties go to the lower state."""
        if not symbols:
            return []
        score, back = (self.start if entry is None else self.move[entry]) + self.emit[:, symbols[0]], []
        for s in symbols[1:]:
            all_ways = score[:, None] + self.move
            back.append(all_ways.argmax(axis=0))
            score = all_ways.max(axis=0) + self.emit[:, s]
        path = [int(score.argmax()) if end is None else end]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return path[::-1]

    def passage(self, symbols: list[int], start: bool) -> tuple[np.ndarray, np.ndarray]:
        """For each state before (rows; a single one if they ``start``) and at the end, the best path's score and the turns that begin in it."""
        first = self.start[None, :] if start else self.move
        score = first + self.emit[:, symbols[0]]
        begun = np.broadcast_to(_BEGINS, score.shape).copy()
        for s in symbols[1:]:
            all_ways = score[:, :, None] + self.move
            best = all_ways.argmax(axis=1)
            score = all_ways.max(axis=1) + self.emit[:, s]
            begun = np.take_along_axis(begun, best, axis=1) + _BEGINS
        return score, begun


#: 1 for states that begin a turn.
_BEGINS = 1 - np.arange(STATES) % 2


def parse_lines(lines: list[str], seen: list[tuple[int, int]], states: list[int], goes_on: bool = False) -> list[tuple[str, str]]:
    """``(role, text)`` of the turns in decoded lines. The first one ``goes_on`` with a turn, or begins one whatever its state."""
    turns: list[tuple[str, list[str]]] = []
    last = -1
    for (i, _), state in zip(seen, states, strict=True):
        if state % 2 == 0 or not turns:
            at = 0 if goes_on and not turns and state % 2 else marker(lines[i])[1]
            turns.append((ROLES[state % GROUP // 2], [lines[i][at:]] if lines[i][at:].strip() else []))
        else:
            own = turns[-1][1]
            own += [""] * (i - last - 1 if own else 0)
            own.append(lines[i])
        last = i
    return [(role, "\n".join(x)) for role, x in turns]


def parse(transcript: str, model: Model) -> list[tuple[str, str]]:
    """``(role, text)`` of the turns; markers and empty lines between turns are left out."""
    lines = transcript.split("\n")
    seen = observe(lines)
    return parse_lines(lines, seen, model.decode([s for _, s in seen]))


def render(role: str, text: str) -> str:
    """A turn in canonical form; what could be taken for its frame is escaped."""
    return f"<|{role}|>\n{text.replace('<|', '<\\|')}\n<|end|>\n"


def write_transcript(turns: list[tuple[str | None, str | None]], style: int, apart: bool = True) -> tuple[str, list[int]]:
    """A transcript in a style and the state of each line that is not empty. Turns of other roles have no marker; ``apart``: by empty lines."""
    lines: list[str] = []
    states: list[int] = []
    for role, text in turns:
        k = ROLES.index(role) if role in ROLES else None
        text = (text or "").strip("\n")
        begin = (STYLES[style][k] if k is not None else "") + text
        own = begin.split("\n")
        full = [x for x in own if x.strip()]
        if not full:
            continue
        states += [GROUP * (style == len(STYLES) - 1) + 2 * (1 if k is None else k) + (j > 0) for j in range(len(full))]
        lines += ([""] if lines and apart else []) + own
    return "\n".join(lines), states


def style_of(conv_id: int | None) -> int:
    return zlib.crc32(f"style {conv_id}".encode()) % len(STYLES)


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns by conversation and stretch, in order, a partition holding whole stretches."""
    rows = _rows(conversations)
    return _in_order(rows, width(conversations.sparkSession))


def _rows(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    return rows.withColumn("stretch", F.floor(F.coalesce("turn", F.lit(0)) / STRETCH).cast("long"))


def _in_order(rows: DataFrame, parts: int) -> DataFrame:
    keys = ("conv_id", "stretch")
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, F.col("turn").asc_nulls_first(), "role", "text")


def _stretches(batches, marked: bool = False) -> Iterator[tuple[tuple, list]]:
    """Conversation and stretch with the turns, ``(role, text)`` and, if ``marked``, what is known of the stretch."""
    now, held = None, []
    names = ["conv_id", "stretch", "role", "text", *(["mark"] if marked else [])]
    for batch in batches:
        for conv_id, stretch, *turn in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if (conv_id, stretch) != now:
                if held:
                    yield now, held
                now, held = (conv_id, stretch), []
            held.append(tuple(turn))
    if held:
        yield now, held


def learn(conversations: DataFrame, held_out: int = 0) -> Model:
    """Count over transcripts, in all styles, of the conversations outside a fold (crc32 of the id as text, modulo 5)."""

    def run(batches):
        counts = np.zeros((1 + STATES, max(STATES, SYMBOLS)), np.int64)
        emit = np.zeros((STATES, SYMBOLS), np.int64)
        for _, turns in _stretches(batches):
            loose = [(role, (text or "").replace("\n", "\n\n")) for role, text in turns]
            # with markers, an empty line may also stand within a turn, or none between turns
            marked = range(len(STYLES) - 1)
            for style, given, apart in [(i, turns, True) for i in range(len(STYLES))] + [(i, loose, True) for i in marked] + [(i, turns, False) for i in marked]:
                text, states = write_transcript(given, style, apart)
                symbols = [s for _, s in observe(text.split("\n"))]
                if not states:
                    continue
                counts[0, states[0]] += 1
                np.add.at(counts, ([1 + a for a in states[:-1]], states[1:]), 1)
                np.add.at(emit, (states, symbols), 1)
        both = np.concatenate((counts, np.pad(emit, ((0, 0), (0, counts.shape[1] - SYMBOLS)))))
        row, column = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(column, pa.int32()), pa.array(both[row, column])], ["row", "column", "n"])

    known = conversations.where((fold(F.col("conv_id")) != held_out) & F.col("conv_id").isNotNull() & F.col("role").isin(*ROLES))
    sums = _turns(known).mapInArrow(run, "row int, column int, n long").groupBy("row", "column").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((1 + 2 * STATES, max(STATES, SYMBOLS)))
    for row, column, n in sums:  # a cell of the model each
        both[row, column] = n
    return Model.of_counts(both[0, :STATES], both[1 : 1 + STATES, :STATES], both[1 + STATES :, :SYMBOLS])


PARSED = "id long, turn long, role string, text string, rendered string"


def parse_transcripts(transcripts: DataFrame, model: Model) -> DataFrame:
    """Turns of ``transcripts(id, transcript)``: ``(id, turn, role, text, rendered)``; null or blank ones have none."""
    shared = transcripts.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches):
        for batch in batches:
            rows = []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("transcript").to_pylist(), strict=True):
                rows += [(i, k, role, x, render(role, x)) for k, (role, x) in enumerate(parse(text or "", shared.value))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["id", "turn", "role", "text", "rendered"])

    return transcripts.select(F.col("id").cast("long").alias("id"), F.col("transcript").cast("string").alias("transcript")).mapInArrow(run, PARSED)


PASSAGES = "conv_id long, stretch long, n_given long, start_score array<double>, start_begun array<long>, score array<double>, begun array<long>"
PLACED = "conv_id long, stretch long, entry int, last int, before long, n_all long"
FORMATTED = "conv_id long, n_given long, turn long, role_pred string, text string, part long, edge boolean"


def _passages(rows: DataFrame, shared) -> DataFrame:
    """The matrices of each stretch that has text, as if it began the transcript and as if it did not."""

    def run(batches):
        model = shared.value
        for (conv_id, stretch), turns in _stretches(batches):
            lines = write_transcript(turns, style_of(conv_id))[0].split("\n")
            row = {"conv_id": conv_id, "stretch": stretch, "n_given": len(turns), "start_score": [], "start_begun": [], "score": [], "begun": []}
            for start, before in ((True, 2), (False, 1)):
                if symbols := [s for _, s in observe(lines, before)]:
                    score, begun = model.passage(symbols, start)
                    row["start_score" if start else "score"], row["start_begun" if start else "begun"] = score.ravel().tolist(), begun.ravel().tolist()
            yield pa.RecordBatch.from_pylist([row], _PASSAGES)

    return _in_order(rows, width(rows.sparkSession)).mapInArrow(run, PASSAGES)


_PASSAGES = pa.schema(
    [("conv_id", pa.int64()), ("stretch", pa.int64()), ("n_given", pa.int64()), ("start_score", pa.list_(pa.float64())), ("start_begun", pa.list_(pa.int64())), ("score", pa.list_(pa.float64())), ("begun", pa.list_(pa.int64()))]
)


def _place(key, table):
    """The states before and at the end of each stretch of a conversation, and the turns that began before it."""
    rows = sorted(table.to_pylist(), key=lambda r: r["stretch"])
    full = [r for r in rows if r["score"]]
    score, chosen = None, []
    for r in full:
        if score is None:
            score, chosen = np.array(r["start_score"]), [(None, np.array(r["start_begun"]))]
            continue
        all_ways = score[:, None] + np.array(r["score"]).reshape(STATES, STATES)
        chosen.append((all_ways.argmax(axis=0), np.array(r["begun"]).reshape(STATES, STATES)))
        score = all_ways.max(axis=0)
    placed, last = [], int(score.argmax()) if full else None
    for entry, begun in reversed(chosen):
        before = None if entry is None else int(entry[last])
        placed.append((before, last, int(begun[last] if entry is None else begun[before, last])))
        last = before
    placed.reverse()
    counts = np.cumsum([0, *(n for *_, n in placed)]).tolist()
    total = sum(r["n_given"] for r in rows)
    columns = ([r["conv_id"] for r in full], [r["stretch"] for r in full], [e for e, *_ in placed], [x for _, x, _ in placed], counts[:-1], [total] * len(full))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["conv_id", "stretch", "entry", "last", "before", "n_all"])


def format_conversations(conversations: DataFrame, held_out: int = 0) -> DataFrame:
    """Write each conversation as a transcript, in a style that its id picks, and recover its turns from that alone.

    ``(conv_id, n_given, turn, role_pred, rendered)``: a row per turn found;
    ``n_given`` counts the turns that went in. Turns without text leave no
    trace; roles that are null or unknown go without a marker; rows with a null
    conv_id are one conversation; turns without a number come first; repeated
    rows are turns of their own; other columns are left out.
    """
    spark = conversations.sparkSession
    shared = spark.sparkContext.broadcast(learn(conversations, held_out))  # of a fixed size
    rows = _rows(conversations)
    long = rows.groupBy("conv_id").agg(F.min("stretch").alias("a"), F.max("stretch").alias("b")).where("a <> b").select(F.col("conv_id").alias("long_id"))
    of_long = rows.join(long, F.col("conv_id").eqNullSafe(F.col("long_id")), "left_semi")
    placed = stage(_passages(of_long, shared).groupBy("conv_id").applyInArrow(_place, PLACED), "stretches")
    # what is known of a stretch comes before its turns
    marks = placed.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "stretch", F.struct("entry", "last", "before", "n_all").alias("mark"))
    both = rows.withColumn("mark", F.lit(None).cast(marks.schema["mark"].dataType)).unionByName(marks)
    keys = ("conv_id", "stretch")
    both = both.repartition(width(spark), *keys).sortWithinPartitions(*keys, F.col("mark").isNull(), F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches):
        model = shared.value
        out: list[tuple] = []
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
        names = ["conv_id", "n_given", "turn", "role_pred", "text", "part", "edge"]
        made = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names)
        for (conv_id, stretch), turns in _stretches(batches, marked=True):
            mark = turns.pop(0)[2] if turns[0][2] else None
            lines = write_transcript([t[:2] for t in turns], style_of(conv_id))[0].split("\n")
            goes_on = mark is not None and mark["entry"] is not None
            seen = observe(lines, 1 if goes_on else 2)
            states = model.decode([s for _, s in seen], mark["entry"] if goes_on else None, mark["last"] if mark else None)
            first = mark["before"] - (1 if goes_on and states[0] % 2 else 0) if mark else 0
            found = parse_lines(lines, seen, states, goes_on)
            out += [(conv_id, mark["n_all"] if mark else len(turns), first + k, role, x, stretch, mark is not None and k in (0, len(found) - 1)) for k, (role, x) in enumerate(found)]
            if len(out) > 5000:
                yield made()
                out = []
        yield made()

    turns = both.mapInArrow(run, FORMATTED)
    if not long.isEmpty():  # a turn that goes on in the next stretch is put together
        turns = stage(turns, "turns")
        parts = F.array_sort(F.collect_list(F.struct("part", "role_pred", "text")))
        whole = turns.where("edge").groupBy("conv_id", "n_given", "turn").agg(parts.alias("parts"))
        texts = F.array_join(F.transform(F.filter("parts", lambda x: x["text"] != ""), lambda x: x["text"]), "\n\n")
        whole = whole.select("conv_id", "n_given", "turn", F.col("parts")[0]["role_pred"].alias("role_pred"), texts.alias("text"))
        turns = turns.where("not edge").select(whole.columns).unionByName(whole)
    rendered = F.concat(F.lit("<|"), "role_pred", F.lit("|>\n"), F.replace("text", F.lit("<|"), F.lit("<\\|")), F.lit("\n<|end|>\n"))
    return turns.select("conv_id", "n_given", "turn", "role_pred", rendered.alias("rendered"))
