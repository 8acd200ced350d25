"""Roles of transcripts' lines by a hidden Markov model, and canonical rendering of the turns.

A transcript is a sequence of texts in the order of their positions; where a
speaker begins is not known. Hidden states say which role a line is of and
whether it begins a turn. What is seen of a line is one of a fixed number of
symbols: its speaker marker, whether a blank line or nothing is before it, its
length class and whether it ends in a question mark. Tables of the model are
counts over labelled transcripts, summed in Spark.

Viterbi: a transcript of more than PART rows is dealt to parts of PART rows at
most, in the order of position and text; equal rows may be parted. Each part first gives the best scores from any state before it to
any state at its end (six by six numbers); these are chained, which fixes the
states at the parts' ends, and then all parts are traced back independently. The
path is the one that a single pass would find, and no task reads a whole long
transcript.

A row of the result is a turn, or a part's share of one (continues says that it
goes on from the part before); its rendered texts, in order, are the canonical
transcript. Null text is an empty line. A row without id is a transcript of its
own, and is not dealt; rows without position come first. Rows that
repeat a position follow each other in the order of their texts. An empty table
gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import written

ROLES, PART = ("system", "user", "assistant"), 4096
N = 2 * len(ROLES)  # states: role, begins or goes on
MARKERS = {
    "system": ("system", "instruction", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q", "me", "prompt", "client"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "model", "agent", "response"),
}
_OF = {m: i + 1 for i, names in enumerate(MARKERS.values()) for m in names}
_MARKER = re.compile(r"\s{0,4}(?:#{1,6}\s{0,3}|\*\*|\[|<\|?)?([A-Za-z]{1,14})(?:\*\*|\]|\|?>)?\s{0,2}(?::(?:\*\*)?|>|$)\s?")
SYMBOLS = 5 * 2 * 3 * 2 + 1


def marker(line: str) -> tuple[int, int]:
    """(0 none, 1 to 3 a role, 4 another name; where the text after it begins)."""
    m = _MARKER.match(line)
    if not m or not (":" in m[0] or "#" in m[0] or ">" in m[0] or "*" in m[0] or "]" in m[0]):
        return 0, 0
    kind = _OF.get(m[1].lower(), 4 if m[1][0].isupper() and m[0].rstrip().endswith(":") else 0)
    return kind, m.end() if 0 < kind < 4 else 0


def symbol(line: str, fresh: bool) -> int:
    """What is seen of a line; fresh: a blank line or nothing is before it."""
    text = line.strip()
    if not text:
        return SYMBOLS - 1
    kind = marker(line)[0]
    size = 0 if len(text) < 80 else 1 if len(text) < 300 else 2
    return ((kind * 2 + fresh) * 3 + size) * 2 + text.endswith("?")


class Model:
    """Logarithms of starts, steps and symbols."""

    def __init__(self, first: np.ndarray, step: np.ndarray, seen: np.ndarray):
        allowed = np.array([[b % 2 == 0 or a // 2 == b // 2 for b in range(N)] for a in range(N)])
        with np.errstate(divide="ignore"):
            start = np.where(np.arange(N) % 2 == 0, first + 0.5, 0)
            self.start = np.log(start / start.sum())
            step = np.where(allowed, step + 0.1, 0)
            self.step = np.log(step / step.sum(1, keepdims=True))
        self.seen = np.log((seen + 0.05) / (seen + 0.05).sum(1, keepdims=True))

    def transfer(self, symbols: list[int], first: bool) -> np.ndarray:
        """Best scores from each state before to each state at the end. In a first part nothing is before: all rows start alike."""
        best = (np.tile(self.start, (N, 1)) if first else self.step) + self.seen[:, symbols[0]]
        for s in symbols[1:]:
            best = (best[:, :, None] + self.step[None]).max(1) + self.seen[:, s]
        return best

    def path(self, symbols: list[int], before: int | None = None, end: int | None = None) -> list[int]:
        """The best states, after the state before and to the state end where these are given. Of equals the lower state."""
        best, back = (self.start if before is None else self.step[before]) + self.seen[:, symbols[0]], []
        for s in symbols[1:]:
            every = best[:, None] + self.step
            back.append(every.argmax(0))
            best = every.max(0) + self.seen[:, s]
        state = int(best.argmax()) if end is None else end
        out = [state]
        for b in reversed(back):
            out.append(state := int(b[state]))
        return out[::-1]


def _symbols(lines: list[str], fresh: bool = True) -> list[int]:
    return [symbol(x, not lines[i - 1].strip() if i else fresh) for i, x in enumerate(lines)]


def _parts(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, its rows' other columns) for rows that are sorted by their first keys columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def _dealt(df: DataFrame, *more: str) -> DataFrame:
    return df.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "pos", "text").select("conv_id", "part", *more, "pos", "text")


def _input(rows: DataFrame, id_col: str, pos_col: str, text_col: str) -> DataFrame:
    return rows.select(F.col(id_col).cast("long").alias("conv_id"), F.col(pos_col).cast("long").alias("pos"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _parted(rows: DataFrame, long: DataFrame) -> DataFrame:
    """The rows of long transcripts with part, which rises with (pos, text): PART rows that follow each other in one range at most."""
    order = ["conv_id", "pos", "text", "salt"]  # the salt parts rows that are equal otherwise
    found = rows.join(F.broadcast(long), "conv_id").withColumn("salt", F.rand(7))
    found = found.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(found.select("conv_id", "pos", "text", F.expr(f"monotonically_increasing_id() div {PART}").alias("part")), "parts")


def trained(labelled: DataFrame, *, id_col: str = "conv_id", pos_col: str = "turn", text_col: str = "text", role_col: str = "role") -> Model:
    """A model of rows that are a turn each; rows of other roles are not used. The driver gets counts of a fixed number of kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, step, seen = np.zeros(N), np.zeros((N, N)), np.zeros((N, SYMBOLS))
        for batch in batches:
            for role, before, blank, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state = 2 * ROLES.index(role)
                lines = text.split("\n")
                for i, s in enumerate(_symbols(lines, before is None or blank)):
                    seen[state + (i > 0), s] += 1
                step[state, state + 1] += len(lines) > 1
                step[state + 1, state + 1] += max(0, len(lines) - 2)
                if before is None:
                    first[state] += 1
                else:  # the role before had one line, or more, as often as its turns do on the whole
                    step[2 * ROLES.index(before), state] += 0.5
                    step[2 * ROLES.index(before) + 1, state] += 0.5
        total = np.concatenate([first, step.ravel(), seen.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total != 0])], ["at", "n"])

    turns = labelled.where(F.col(role_col).isin(*ROLES)).select(F.col(id_col).alias("c"), F.col(pos_col).alias("p"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ended = F.struct("role", F.col("text").rlike(_BLANK_END).alias("blank"))
    earlier = turns.groupBy("c", "p").agg(F.min(ended).alias("e")).select("c", (F.col("p") + 1).alias("p"), F.col("e.role").alias("before"), "e.blank")
    counts = turns.join(earlier, ["c", "p"], "left").select("role", "before", "blank", "text").mapInArrow(run, "at long, n double")
    total = np.zeros(N + N * N + N * SYMBOLS)
    for r in counts.groupBy("at").agg(F.sum("n").alias("n")).collect():
        total[r["at"]] = r["n"]
    return Model(total[:N], total[N : N + N * N].reshape(N, N), total[N + N * N :].reshape(N, SYMBOLS))


_BLANK_END = r"(?:^|\n)\s*$"


def _ends(rows: DataFrame, model: Model) -> DataFrame:
    """conv_id, part, before, end, fresh, last: the states at the ends of the parts of transcripts with several, whether the line before is blank, and whether no part follows."""
    last = rows.groupBy("conv_id", "part").agg(F.max_by(F.col("text").rlike(_BLANK_END), F.struct("pos", "text")).alias("blank"))
    fresh = F.coalesce(F.lag("blank").over(Window.partitionBy("conv_id").orderBy("part")), F.lit(True))
    rows = rows.join(last.select("conv_id", "part", fresh.alias("fresh")), ["conv_id", "part"])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, part, first, fresh), found in _parts(batches, 4):
            symbols = _symbols([x for _, t in found for x in t.split("\n")], fresh)
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([part], pa.int64()), pa.array([model.transfer(symbols, part == first).tobytes()], pa.binary()), pa.array([fresh])], ["conv_id", "part", "best", "fresh"])

    def chain(key, table):
        table = table.sort_by("part")
        best = [np.frombuffer(x.as_buffer()).reshape(N, N) for x in table.column("best").combine_chunks()]
        score, back = best[0][0], []
        for m in best[1:]:
            every = score[:, None] + m
            back.append(every.argmax(0))
            score = every.max(0)
        ends = [int(score.argmax())]
        for b in reversed(back):
            ends.append(int(b[ends[-1]]))
        ends.reverse()
        return pa.table({"conv_id": table.column("conv_id"), "part": table.column("part"), "before": pa.array([None, *ends[:-1]], pa.int64()), "end": pa.array(ends, pa.int64()), "fresh": table.column("fresh"), "last": pa.array([i == len(ends) - 1 for i in range(len(ends))])})

    made = _dealt(rows, "first", "fresh").mapInArrow(matrices, "conv_id long, part long, best binary, fresh boolean")
    return made.groupBy("conv_id").applyInArrow(chain, "conv_id long, part long, before long, end long, fresh boolean, last boolean")


TURNS = "conv_id long, pos long, line long, role string, n_lines long, continues boolean, rendered string"


def parsed(transcripts: DataFrame, model: Model, *, id_col: str = "conv_id", pos_col: str = "turn", text_col: str = "text") -> DataFrame:
    """Turns of transcripts: where each begins (position, line there), its role, lines and rendered text."""
    rows = _input(transcripts, id_col, pos_col, text_col)
    named = rows.where("conv_id IS NOT NULL")
    # One row for PART of the input at most: small enough to broadcast.
    long = written(named.groupBy("conv_id").count().where(F.col("count") > PART).select("conv_id"), "long")

    def turns(conv, before, end, fresh, last, found) -> list[tuple]:
        lines = [(pos, i, x) for pos, t in found for i, x in enumerate(t.split("\n"))]
        states = model.path(_symbols([x for *_, x in lines], fresh is not False), before, end)
        starts = [i for i, s in enumerate(states) if i == 0 or s % 2 == 0]
        out = []
        for a, b in zip(starts, [*starts[1:], len(lines)], strict=True):
            role, goes_on = ROLES[states[a] // 2], states[a] % 2 == 1
            text = [x for *_, x in lines[a:b]]
            if not goes_on:
                text[0] = text[0][marker(text[0])[1] :]
            head = "" if goes_on else f"<|im_start|>{role}\n"
            out.append((conv, lines[a][0], lines[a][1], role, b - a, goes_on, head + "\n".join(text)))
        # A part's last turn stays open if a part follows; that one's first row goes on with it or closes it.
        for k, row in enumerate(out):
            head = ("\n" if row[5] else "<|im_end|>\n") if k == 0 and before is not None else ""
            out[k] = (*row[:6], head + row[6] + ("" if last is False and k == len(out) - 1 else "<|im_end|>\n"))
        return out

    def table(out: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["conv_id", "pos", "line", "role", "n_lines", "continues", "rendered"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, _, before, end, fresh, last), found in _parts(batches, 6):
            yield table(turns(conv, before, end, fresh, last, found))

    def run_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield table([x for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in turns(None, None, None, True, True, [row])])

    none = F.lit(None).cast("long")
    whole = named.select("*", F.lit(0).cast("long").alias("part"), none.alias("before"), none.alias("end"), F.lit(True).alias("fresh"), F.lit(True).alias("last"))
    if not long.isEmpty():
        parts = _parted(named, long)
        first = parts.groupBy("conv_id").agg(F.min("part").alias("first"))
        ended = parts.join(_ends(parts.join(F.broadcast(first), "conv_id"), model), ["conv_id", "part"])
        whole = whole.join(F.broadcast(long), "conv_id", "left_anti").unionByName(ended)
    alone = rows.where("conv_id IS NULL").select("pos", "text")
    return _dealt(whole, "before", "end", "fresh", "last").mapInArrow(run, TURNS).unionAll(alone.mapInArrow(run_alone, TURNS))


def transcript_lines(conversations: DataFrame) -> DataFrame:
    """conversations as transcripts: each turn's text behind a marker in its conversation's style; one style in four has blank lines only."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    named = lambda system, user, other: F.when(F.col("role") == "system", system).when(F.col("role") == "user", user).otherwise(other)
    mark = (
        F.when(style == 0, named("System: ", "User: ", "Assistant: "))
        .when(style == 1, named("[Instructions]: ", "Human: ", "AI: "))
        .when(style == 2, named("### System:\n", "### User:\n", "### Assistant:\n"))
        .otherwise(F.when(F.col("turn") > 0, "\n").otherwise(""))
    )
    return conversations.withColumn("text", F.concat(F.coalesce(mark, F.lit("")), F.coalesce("text", F.lit(""))))
