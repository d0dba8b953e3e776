"""Fill-in-the-middle: texts cut at lines and put in the order prefix, suffix, middle or suffix, prefix, middle.

The cuts come from a parallel scan with a finite automaton.  Its states tell whether a character
begins a line and how much of a sentinel has been read; a transition may begin a unit (a line)
or complete a sentinel.

1. A piece of text is read from every state at once.  What it gives is a function from the
   state before it to the state after it, with the units that begin and the sentinels that end
   in it for each state before.
2. Such functions compose associatively: those of blocks to that of a chunk, those of chunks to
   that of a text.  The composition tells the state in which each piece is entered, how many
   units begin before it, and how many the text has.
3. The unit at which a cut falls is then looked for only in the piece where it begins.

Texts of up to GIANT characters are scanned where they stand, all blocks of a batch side by
side.  A longer one is dealt out in chunks: each chunk is scanned in a task of its own, the
functions (a few numbers for each chunk, so at most a few 100,000 numbers for the longest text
that a row can hold) meet by text, and only chunks that hold a cut are read again.  Both ways
give the same cuts; equal long texts are scanned once.

Edge cases: null texts count as empty and stay plain; a text that holds a sentinel stays plain;
a null identifier is hashed as an empty string; rows that repeat are cut alike, each for itself;
whole texts are read, whatever their length; an empty table gives an empty result; other columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialise, partitions, shared_root, ship, small_or_shuffled

#: Characters of a block, of which many are scanned side by side.
BLOCK = 1024
#: Characters of a chunk of a long text.
CHUNK = 32 * BLOCK
#: Texts of more characters are dealt out in chunks.
GIANT = 2 * CHUNK
#: Characters scanned at once in a task.
AT_ONCE = 4_000_000
#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")


class Automaton:
    """Lines and sentinels: state 0 begins a line, state 1 is inside one, the others have read a part of a sentinel.

    Tables are flat, by class of character and state; the last class is that of padding, which changes nothing.
    """

    def __init__(self, sentinels: Sequence[str]) -> None:
        if not all(sentinels) or any("\n" in s for s in sentinels):
            raise ValueError("sentinels must not be empty or hold a line feed")
        heads = ["", *sorted({s[:k] for s in sentinels for k in range(1, len(s))}, key=lambda h: (len(h), h))]
        letters = sorted({c for s in sentinels for c in s})
        self.class_of = {c: 2 + i for i, c in enumerate(letters)}  # 0: any other, 1: line feed
        self.states, self.padding = len(heads) + 1, 2 + len(letters)
        shape = (self.padding + 1, self.states)
        step, begins, ends = np.zeros(shape, np.uint8), np.zeros(shape, np.uint8), np.zeros(shape, bool)
        begins[: self.padding, 0] = 1
        step[self.padding] = np.arange(self.states)
        for state in range(self.states):
            read = heads[max(state - 1, 0)]
            step[0, state], step[1, state] = 1, 0
            for c in letters:
                now = read + c
                ends[self.class_of[c], state] = any(now.endswith(s) for s in sentinels)
                step[self.class_of[c], state] = 1 + heads.index(next(now[k:] for k in range(len(now) + 1) if now[k:] in heads))
        self.step, self.begins, self.ends = step.ravel(), begins.ravel(), ends.ravel()
        self.low = np.zeros(max(map(ord, [*letters, "\n"])) + 2, np.uint8)
        self.low[10] = 1
        for c, k in self.class_of.items():
            self.low[ord(c)] = k

    def classes(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The classes of the texts' characters as rows of BLOCK, and how many rows each text has."""
        sizes = np.array([len(t) for t in texts], np.int64)
        rows = -(-sizes // BLOCK)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        out = np.full((int(rows.sum()), BLOCK), self.padding, np.uint8)
        begin = np.cumsum(rows * BLOCK) - rows * BLOCK
        places = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(points))
        out.ravel()[places] = self.low[np.minimum(points, len(self.low) - 1)]
        return out, rows

    def functions(self, classes: np.ndarray) -> Summary:
        """The function of each row of classes."""
        state = np.tile(np.arange(self.states, dtype=np.uint8), (len(classes), 1))
        units, marked = np.zeros(state.shape, np.int64), np.zeros(state.shape, bool)
        for column in np.ascontiguousarray(classes.T):
            at = column[:, None].astype(np.intp) * self.states + state
            units += self.begins[at]
            marked |= self.ends[at]
            state = self.step[at]
        return Summary(state, units, marked)

    def places(self, classes: np.ndarray, entered: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Where in each row unit number ``wanted`` (of those that begin in it) begins."""
        state, count = entered.astype(np.uint8), np.zeros(len(classes), np.int64)
        found = np.full(len(classes), -1, np.int64)
        for j, column in enumerate(np.ascontiguousarray(classes.T)):
            at = column.astype(np.intp) * self.states + state
            begins = self.begins[at] > 0
            found[begins & (count == wanted)] = j
            count += begins
            state = self.step[at]
        return found


@dataclass
class Summary:
    """Functions of pieces of text: for each state before, the state after, the units begun and whether a sentinel ended."""

    after: np.ndarray
    units: np.ndarray
    marked: np.ndarray

    def part(self, first: int, last: int) -> Summary:
        return Summary(self.after[first:last], self.units[first:last], self.marked[first:last])

    def composed(self) -> Summary:
        """One function for all pieces, neighbours first: composition is associative."""
        now = self
        while len(now.after) > 1:
            even = len(now.after) // 2 * 2
            one, two = now.part(0, even).every(0), now.part(0, even).every(1)
            through = one.after.astype(np.intp)
            pairs = [
                np.take_along_axis(two.after, through, 1),
                one.units + np.take_along_axis(two.units, through, 1),
                one.marked | np.take_along_axis(two.marked, through, 1),
            ]
            rest = now.part(even, len(now.after))
            now = Summary(*(np.concatenate(x) for x in zip(pairs, (rest.after, rest.units, rest.marked), strict=True)))
        return now

    def every(self, first: int) -> Summary:
        return Summary(self.after[first::2], self.units[first::2], self.marked[first::2])

    def entries(self, state: int = 0) -> tuple[list[int], list[int], bool]:
        """The state before each piece, the units before it (and in all), and whether a sentinel ends anywhere; state 0 begins a text."""
        units, marked, states, before = 0, False, [], [0]
        for after, begun, ended in zip(self.after.tolist(), self.units.tolist(), self.marked.tolist(), strict=True):
            states.append(state)
            units += begun[state]
            marked |= ended[state]
            before.append(units)
            state = after[state]
        return states, before, marked


@lru_cache(maxsize=4)
def automaton(sentinels: tuple[str, ...]) -> Automaton:
    return Automaton(sentinels)


def _cut_numbers(one: int, two: int, n: int) -> tuple[int, int]:
    a, b = one % (n + 1), two % (n + 1)
    return min(a, b), max(a, b)


def scanned(texts: Sequence[str], draws: Sequence[tuple[int, int]], machine: Automaton) -> list[tuple[int, bool, int, int]]:
    """For each text: units, whether it holds a sentinel, and where its prefix and its middle end."""
    classes, rows = machine.classes(texts)
    functions = machine.functions(classes)
    out: list[list] = []
    asked: list[tuple[int, int, int, int, int]] = []  # text, which cut, row, state, unit in the row
    first = 0
    for i, (text, count) in enumerate(zip(texts, rows.tolist(), strict=True)):
        states, before, marked = functions.part(first, first + count).entries()
        n = before[-1]
        out.append([n, marked, len(text), len(text)])
        for which, unit in enumerate(_cut_numbers(*draws[i], n)):
            if unit < n:
                block = int(np.searchsorted(before, unit, "right")) - 1
                asked.append((i, which, first + block, states[block], unit - before[block]))
        first += count
    if asked:
        _, _, at, states, units = (np.array(x) for x in zip(*asked, strict=True))
        first_row = np.cumsum(rows) - rows
        for (i, which, row, _, _), place in zip(asked, machine.places(classes[at], states, units).tolist(), strict=True):
            out[i][2 + which] = (row - int(first_row[i])) * BLOCK + place
    return [tuple(x) for x in out]


CUT = "n bigint, marked boolean, `start` bigint, `end` bigint"


def _scan_here(sentinels: tuple[str, ...]):
    """Rows of (doc_id, text, h1, h2) with their cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(sentinels)
        for batch in batches:
            texts, draws = batch.column(1).to_pylist(), list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            found, first, size = [], 0, 0
            for i, text in enumerate(texts):
                size += len(text)
                if size >= AT_ONCE or i + 1 == len(texts):
                    found += scanned(texts[first : i + 1], draws[first : i + 1], machine)
                    first, size = i + 1, 0
            n, marked, start, end = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(marked, pa.bool_()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                names=["doc_id", "text", "n", "marked", "start", "end"],
            )
        give_back()

    return run


def _deal(chunk: int):
    """Texts to (digest, number, chunk of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                parts = [text[k : k + chunk] for k in range(0, len(text), chunk)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], names=["digest", "number", "chunk"]
                )

    return run


def _chunk_functions(sentinels: tuple[str, ...]):
    """The function of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(sentinels)
        for batch in batches:
            whole = []
            for text in batch.column(2):
                classes, _ = machine.classes([text.as_py()])
                whole.append(machine.functions(classes).composed())
            columns = [[getattr(f, name)[0].tolist() for f in whole] for name in ("after", "units", "marked")]
            types = (pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["digest", "number", "after", "units", "marked"]
            )

    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The functions of a text's chunks, in order, to the state and the units before each."""
    for batch in batches:
        rows = []
        for digest, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            after, units, marked = (np.array([p[k] for p in pieces]) for k in ("after", "units", "marked"))
            rows.append((digest, *Summary(after, units, marked).entries()))
        digest, states, before, marked = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(digest, pa.string()), pa.array(states, pa.list_(pa.int32())), pa.array(before, pa.list_(pa.int64())), pa.array(marked, pa.bool_())],
            names=["digest", "states", "before", "marked"],
        )


def _select(sentinels: tuple[str, ...], chunk: int):
    """Cuts with the chunk that holds each to their places in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(sentinels)
        for batch in batches:
            places = []
            for text, number, state, unit in zip(batch.column(3), *(batch.column(k).to_pylist() for k in (4, 5, 6)), strict=True):
                classes, _ = machine.classes([text.as_py()])
                states, before, _ = machine.functions(classes).entries(state)
                block = int(np.searchsorted(before, unit, "right")) - 1
                place = machine.places(classes[block : block + 1], np.array([states[block]]), np.array([unit - before[block]]))[0]
                places.append(number * chunk + block * BLOCK + int(place))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(places, pa.int64())], names=["doc_id", "digest", "which", "place"])

    return run


def _giants(docs: DataFrame, sentinels: tuple[str, ...], chunk: int) -> DataFrame:
    """Cuts of long texts, scanned chunk by chunk in tasks of their own."""
    spark = docs.sparkSession
    root, width = shared_root(spark), partitions(spark)
    docs = docs.withColumn("digest", F.sha2("text", 256))
    dealt = docs.select("digest", "text").mapInArrow(_deal(chunk), "digest string, number int, chunk string")
    # equal texts come together here; chunks of one text go to different tasks
    chunks = materialise(dealt.repartition(width, "digest", "number").groupBy("digest", "number").agg(F.first("chunk").alias("chunk")), f"{root}/chunks")
    functions = chunks.mapInArrow(_chunk_functions(sentinels), "digest string, number int, after array<int>, units array<bigint>, marked array<boolean>")
    pieces = functions.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("number", "after", "units", "marked"))).alias("pieces"))
    entered = materialise(pieces.mapInArrow(_resolve, "digest string, states array<int>, before array<bigint>, marked boolean"), f"{root}/entered")

    asked = docs.select("doc_id", "digest", "h1", "h2").distinct().join(small_or_shuffled(entered), "digest").withColumn("n", F.element_at("before", -1))
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    asked = asked.select("doc_id", "digest", "n", "states", "before", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.least(one, two).alias("unit")), F.struct(F.lit(1).alias("which"), F.greatest(one, two).alias("unit")))).alias("c"))
    # the chunk in which the unit begins is the last with no more units before it, among those in which units begin
    number = F.size(F.filter("before", lambda x: x <= F.col("c.unit"))) - 1
    asked = asked.where("c.unit < n").select("doc_id", "digest", "c.which", number.alias("number"), "c.unit", "states", "before")
    asked = asked.select("doc_id", "digest", "which", "number", F.element_at("states", F.col("number") + 1).alias("state"), (F.col("unit") - F.element_at("before", F.col("number") + 1)).alias("unit"))
    held = asked.join(chunks.hint("merge"), ["digest", "number"]).select("doc_id", "digest", "which", "chunk", "number", "state", "unit")
    places = held.mapInArrow(_select(sentinels, chunk), "doc_id bigint, digest string, which int, place bigint")
    ends = places.groupBy("doc_id", "digest").agg(F.max(F.when(F.col("which") == 0, F.col("place"))).alias("start"), F.max(F.when(F.col("which") == 1, F.col("place"))).alias("end"))
    ends = small_or_shuffled(materialise(ends, f"{root}/ends"))
    scans = small_or_shuffled(entered.select("digest", F.element_at("before", -1).alias("n"), "marked"))
    same = (F.col("d.doc_id").eqNullSafe(F.col("e.doc_id"))) & (F.col("d.digest") == F.col("e.digest"))
    found = docs.join(scans, "digest").alias("d").join(ends.alias("e"), same, "left")
    size = F.length("d.text").cast("bigint")
    return found.select("d.doc_id", "d.text", "d.n", "d.marked", F.coalesce("e.start", size).alias("start"), F.coalesce("e.end", size).alias("end"))


def _draw(seed: int, k: int) -> Column:
    """The k-th group of eight hexadecimal digits of the hash of seed and identifier."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("bigint")


def cuts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, sentinels: Sequence[str] = SENTINELS, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id and text of every row with n (lines), marked (a sentinel stands in the text), and where prefix (start) and middle (end) end."""
    ship(docs.sparkSession)
    if chunk % BLOCK:
        raise ValueError(f"a chunk must be a multiple of {BLOCK} characters")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"h1": _draw(seed, 1), "h2": _draw(seed, 2)})
    here = rows.where(F.length("text") <= giant).mapInArrow(_scan_here(tuple(sentinels)), f"doc_id bigint, text string, {CUT}")
    return here.unionByName(_giants(rows.where(F.length("text") > giant), tuple(sentinels), chunk))


def restored(output: str, form: str, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text again, from the columns with output and form alone.

    No sentinel begins with what another, or itself, ends with, so the first place at which a
    sentinel is found after the one before is where it was put.
    """
    p, s, m = sentinels

    tail = lambda mark: F.expr(f"substr({output}, instr({output}, '{mark}') + {len(mark)})")
    between = lambda one, two: F.expr(f"substr({output}, instr({output}, '{one}') + {len(one)}, instr({output}, '{two}') - instr({output}, '{one}') - {len(one)})")
    psm, spm = F.concat(between(p, s), tail(m), between(s, m)), F.concat(between(p, m), tail(m), between(s, p))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50, sentinels: Sequence[str] = SENTINELS, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the transformed text (``output``) of every row.

    Of a hundred texts ``rate`` are transformed, and of a hundred of these ``spm_rate`` have the suffix first.
    """
    p, s, m = (F.lit(x) for x in sentinels)
    found = cuts(docs, id_col, text_col, seed, sentinels, giant, chunk)
    plain = (F.col("text") == "") | F.col("marked") | (_draw(seed, 3) % 100 >= rate)
    form = F.when(plain, "plain").when(_draw(seed, 4) % 100 < spm_rate, "spm").otherwise("psm")
    prefix, middle, suffix = F.expr("substr(text, 1, int(start))"), F.expr("substr(text, int(start) + 1, int(end - start))"), F.expr("substr(text, int(end) + 1)")
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("text"))
    found = found.withColumn("form", form)
    moved = F.col("form") != "plain"
    return found.select("doc_id", "n", "form", F.when(moved, F.col("start")).alias("prefix_chars"), F.when(moved, F.col("end") - F.col("start")).alias("middle_chars"), output.alias("output"))
