"""Fill-in-the-middle transformation by a parallel automaton scan.

One automaton reads the bytes of a text: it tells where a unit (a code point) begins and where a control string ends. A
stretch of bytes is a function: for each state that it may be entered in, the state it is left in, and the units and
control strings counted on the way. Functions of neighbouring stretches compose, and composition is associative, so
stretches of one text are read in parallel, whatever their entry states turn out to be: lanes of a text within a task,
chunks of a long text in many tasks. Composed from the left, they tell each stretch's entry state and the units before
it; a cut is then found in the one stretch that holds it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import keep, text_of
from marlstone.session import ship

#: Bytes of a lane, and of texts that are read at once: bound a worker's memory, never the result.
LANE, BATCH_BYTES = 512, 1 << 21
#: Symbol behind the last byte of a lane: leaves the state as it is and counts nothing.
END = 256
_UNITS, _MARKS = 1, 1 << 31


@dataclass(frozen=True)
class Form:
    """prefix, suffix, middle: control strings; plain: of 100 texts, those from this number on stay plain; spm: those
    below this number of the others are put suffix first; chunk_bytes: texts longer than this are read in chunks by
    many tasks (changes the work, not the result); seed: what is put before an id when it is hashed."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    plain: int = 90
    spm: int = 20
    chunk_bytes: int = 1 << 16
    seed: str = "1:"

    @property
    def marks(self) -> tuple[str, ...]:
        return self.prefix, self.suffix, self.middle


class Automaton:
    """Reads bytes: code points begin, and control strings end, in its steps.

    to[state, byte]: next state; adds[state, byte]: _UNITS where a code point begins, _MARKS where a control string ends.
    A state is how many bytes of a code point are still to come, and the longest beginning of a control string read.
    """

    def __init__(self, marks: tuple[str, ...]):
        strings = [m.encode() for m in marks]
        starts = sorted({s[:k] for s in strings for k in range(len(s) + 1)}, key=lambda s: (len(s), s))
        longest = lambda s: next(s[k:] for k in range(len(s) + 1) if s[k:] in starts)
        states: dict[tuple[int, bytes], int] = {(0, b""): 0}
        todo, steps = [(0, b"")], []
        while todo:
            left, read = todo.pop(0)
            row = []
            for byte in range(256):
                inside = left > 0 and byte & 0xC0 == 0x80
                more = left - 1 if inside else 3 if byte >= 0xF0 else 2 if byte >= 0xE0 else 1 if byte >= 0xC0 else 0
                now = longest(read + bytes([byte]))
                state = (more, now)
                if state not in states:
                    states[state] = len(states)
                    todo.append(state)
                row.append((states[state], (not inside) * _UNITS + any(now.endswith(s) for s in strings) * _MARKS))
            steps.append([*row, (len(steps), 0)])
        to, adds = (np.array([[x[k] for x in r] for r in steps], np.int64) for k in (0, 1))
        # States that no continuation tells apart are one: classes by what is counted, split until their steps agree.
        kind = np.unique(adds, axis=0, return_inverse=True)[1].ravel()
        while True:
            finer = np.unique(np.column_stack([kind, kind[to]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == kind.max():
                break
            kind = finer
        first = np.unique(kind, return_index=True)[1]
        order = np.argsort(first)  # the class of the state before any byte is state 0
        number = np.argsort(order)
        self.to, self.adds, self.size = number[kind[to[first[order]]]], adds[first[order]], len(first)
        self.to[:, END] = np.arange(self.size)

    def lanes(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Functions of lanes (one a row of symbols): end state and counts of each lane and entry state."""
        to, adds = (self.to * (END + 1)).ravel(), self.adds.ravel()
        at = np.tile(np.arange(self.size) * (END + 1), (len(symbols), 1))
        total = np.zeros(at.shape, np.int64)
        for column in symbols.T:
            step = at + column[:, None]
            total += adds[step]
            at = to[step]
        return at // (END + 1), total

    def place(self, symbols: np.ndarray, entry: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Of each lane with a known entry state, the place where its wanted-th code point (from 0) begins."""
        at, seen, out = entry * (END + 1), np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
        to, adds = (self.to * (END + 1)).ravel(), self.adds.ravel()
        for k, column in enumerate(symbols.T):
            step = at + column
            begins = adds[step] & (_MARKS - 1)
            out[(begins > 0) & (seen == wanted)] = k
            seen += begins
            at = to[step]
        return out


def composed(first: tuple, then: tuple) -> tuple:
    """Functions of two stretches, row by row, as one: end states and counts."""
    return np.take_along_axis(then[0], first[0], 1), first[1] + np.take_along_axis(then[1], first[0], 1)


def prefixes(end: np.ndarray, total: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each stretch its text's function up to its own end: composed over growing distances, log2 of a text's stretches
    times. text: number of each stretch's text, ascending."""
    d = 1
    while d < len(text) and (text[d:] == text[:-d]).any():
        same = np.flatnonzero(text[d:] == text[:-d])
        e, t = composed((end[same], total[same]), (end[same + d], total[same + d]))
        end, total = end.copy(), total.copy()
        end[same + d], total[same + d] = e, t
        d *= 2
    return end, total


def _lanes_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the lanes of stretches of data, each lane's stretch, and the place in it where the lane begins."""
    per = np.maximum(-(-sizes // LANE), 1)
    owner = np.repeat(np.arange(len(sizes)), per)
    begin = (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)) * LANE
    at = begin[:, None] + np.arange(LANE)
    inside = at < sizes[owner][:, None]
    symbols = np.full(at.shape, END, np.int64)
    symbols[inside] = data[(starts[owner][:, None] + at)[inside]]
    return symbols, owner, begin


def _last(owner: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(owner, np.arange(n), side="right") - 1


def _cuts(auto: Automaton, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, h: np.ndarray) -> dict[str, np.ndarray]:
    """n, marked, and the two cuts in code points and bytes of whole texts; h: two numbers of each text."""
    symbols, owner, begin = _lanes_of(data, starts, sizes)
    end, total = prefixes(*auto.lanes(symbols), owner)
    last = _last(owner, len(sizes))
    n = total[last, 0] & (_MARKS - 1)
    both = np.sort(h % (n + 1)[:, None], axis=1)
    out = {"n": n, "marked": total[last, 0] >= _MARKS, "a": both[:, 0], "b": both[:, 1]}
    # Lanes are entered in the state that their text's lanes before leave: state 0 leads into each text.
    new = np.append(True, owner[1:] != owner[:-1])
    entry = np.where(new, 0, np.append(0, end[:-1, 0]))
    before = np.where(new, 0, np.append(0, total[:-1, 0] & (_MARKS - 1)))
    key = owner * (1 << 32) + before
    for c in "ab":
        # The lane behind whose beginning the cut lies; lanes without a code point of their own are passed over.
        lane = np.searchsorted(key, np.arange(len(n)) * (1 << 32) + out[c], side="right") - 1
        found = begin[lane] + auto.place(symbols[lane], entry[lane], out[c] - before[lane])
        out[f"{c}_byte"] = np.where(out[c] == n, sizes, found)
    return out


def _batches(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """from, to, bytes, starts and sizes of the texts of a column, so many at once that bytes are bounded."""
    column = column.cast(pa.large_binary())
    size = np.array([0 if x is None else x for x in pa.compute.binary_length(column).to_pylist()], np.int64)
    i = 0
    while i < len(size):
        j, room = i, 0
        while j < len(size) and (j == i or room + size[j] <= BATCH_BYTES):
            room += size[j]
            j += 1
        raw = b"".join(x or b"" for x in column.slice(i, j - i).to_pylist())
        yield i, j, np.frombuffer(raw, np.uint8), np.cumsum(size[i:j]) - size[i:j], size[i:j]
        i = j


_CUT = ("n", "marked", "a", "b", "a_byte", "b_byte")
_KINDS = [T.StructField(c, T.BooleanType() if c == "marked" else T.LongType()) for c in _CUT]


def _whole(marks: tuple[str, ...], text: str):
    """Rows with __h (two longs) and a text -> the same and the cuts of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(marks)
        for b in batches:
            h = np.array(b.column(b.schema.get_field_index("__h")).to_pylist(), np.int64).reshape(-1, 2)
            for i, j, data, starts, sizes in _batches(b.column(b.schema.get_field_index(text))):
                c = _cuts(auto, data, starts, sizes, h[i:j])
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, *[pa.array(c[x]) for x in _CUT]], names=[*b.schema.names, *[f"__{x}" for x in _CUT]])

    return run


def _functions(marks: tuple[str, ...]):
    """__row, k, chunk -> __row, k, ends, totals: the chunk's function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(marks)
        for b in batches:
            for i, j, data, starts, sizes in _batches(b.column(2)):
                symbols, owner, _ = _lanes_of(data, starts, sizes)
                end, total = (x[_last(owner, j - i)] for x in prefixes(*auto.lanes(symbols), owner))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(end.tolist(), pa.list_(pa.int64())), pa.array(total.tolist(), pa.list_(pa.int64()))], names=["__row", "k", "ends", "totals"])

    return run


def _selected(f: pd.DataFrame) -> pd.DataFrame:
    """Functions of a text's chunks (a few numbers each) -> its counts, and of each cut the chunk that holds it."""
    f = f.sort_values("k")
    end, total = prefixes(np.stack(f["ends"].to_numpy()), np.stack(f["totals"].to_numpy()), np.zeros(len(f), np.int64))
    n, marked = int(total[-1, 0] & (_MARKS - 1)), bool(total[-1, 0] >= _MARKS)
    before = np.append(0, total[:-1, 0] & (_MARKS - 1))
    cuts = sorted(int(x) % (n + 1) for x in f["__h"].iloc[0])
    k = np.searchsorted(before, cuts, side="right") - 1
    return pd.DataFrame({"__row": f["__row"].iloc[0], "n": n, "marked": marked, "a": cuts[0], "b": cuts[1], "which": [0, 1], "k": k, "entry": np.append(0, end[:-1, 0])[k], "wanted": np.array(cuts) - before[k]})


def _placed(marks: tuple[str, ...]):
    """__row, which, k, entry, wanted, chunk -> __row, which, place of the cut in the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(marks)
        for b in batches:
            entry, wanted = (b.column(c).to_numpy(zero_copy_only=False) for c in (3, 4))
            for i, j, data, starts, sizes in _batches(b.column(5)):
                symbols, owner, begin = _lanes_of(data, starts, sizes)
                functions = auto.lanes(symbols)
                end, total = prefixes(*functions, owner)
                new = np.append(True, owner[1:] != owner[:-1])
                first = entry[i:j][owner]
                state = np.where(new, first, np.append(0, end[np.arange(len(owner) - 1), first[:-1]]))
                before = np.where(new, 0, np.append(0, total[np.arange(len(owner) - 1), first[:-1]] & (_MARKS - 1)))
                lane = np.searchsorted(owner * (1 << 32) + before, np.arange(j - i) * (1 << 32) + wanted[i:j], side="right") - 1
                at = begin[lane] + auto.place(symbols[lane], state[lane], wanted[i:j] - before[lane])
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(i, j - i) for c in range(3)], pa.array(at)], names=["__row", "which", "k", "place"])

    return run


def _number(digest: Column, k: int) -> Column:
    """The k-th group of eight digits (from 0) of a hex digest as a number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, form: Form | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output (which replace columns of these names).

    n: code points of the text. Prefix and middle end where two numbers hashed from the id say, modulo n + 1. form:
    plain (output is the text; no cuts), psm (prefix, suffix, middle behind their marks) or spm (suffix, prefix,
    middle). Empty texts, and those that hold a mark, are plain, as null ones are, whose output is empty. Null ids are
    hashed as if empty. Repeated rows get the same output each; all other columns stay. An empty table gives no rows.
    """
    f = form or Form()
    ship(docs.sparkSession)
    made = ("n", "form", "prefix_chars", "middle_chars", "output")
    names = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    digest = F.sha2(F.concat(F.lit(f.seed), F.coalesce(F.col(names[id_col]).cast("string"), F.lit(""))), 256)
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    own = own.select("*", text_of(F.col(names[text])).alias("__text"), digest.alias("__digest")).withColumn("__h", F.array(_number(F.col("__digest"), 0), _number(F.col("__digest"), 1)))
    long = F.octet_length("__text") > f.chunk_bytes
    kinds = T.StructType([*own.schema.fields, *[T.StructField(f"__{k.name}", k.dataType) for k in _KINDS]])
    short = own.filter(~long).mapInArrow(_whole(f.marks, "__text"), kinds)
    # Long texts are written once, with a row number of their own; their chunks are dealt to many tasks.
    big = keep(own.filter(long).withColumn("__row", F.monotonically_increasing_id()), "long")
    raw = F.col("__text").cast("binary")
    chunk = lambda k: F.substring(raw, (k * f.chunk_bytes + 1).cast("int"), F.lit(f.chunk_bytes))
    last = F.floor((F.octet_length("__text") - 1) / f.chunk_bytes).cast("int")
    chunks = big.select("__row", "__text", F.explode(F.sequence(F.lit(0), last)).alias("k")).select("__row", "k", chunk(F.col("k")).alias("chunk")).repartition("__row", "k")
    functions = chunks.mapInArrow(_functions(f.marks), "__row long, k int, ends array<long>, totals array<long>").join(big.select("__row", "__h"), "__row")
    told = functions.groupBy("__row").applyInPandas(_selected, "__row long, n long, marked boolean, a long, b long, which int, k int, entry long, wanted long")
    told = keep(told, "cuts")
    held = big.join(told, "__row").select("__row", "which", "k", "entry", "wanted", chunk(F.col("k")).alias("chunk"))
    place = held.mapInArrow(_placed(f.marks), "__row long, which int, k int, place long").select("__row", "which", (F.col("k").cast("long") * f.chunk_bytes + F.col("place")).alias("byte"))
    ends = told.join(place, ["__row", "which"]).groupBy("__row").agg(*[F.first(c).alias(f"__{c}") for c in ("n", "marked", "a", "b")], *[F.min(F.when(F.col("which") == w, F.col("byte"))).alias(f"__{c}_byte") for w, c in enumerate("ab")])
    size = F.octet_length("__text").cast("long")
    done = big.join(ends, "__row").withColumns({f"__{c}_byte": F.when(F.col(f"__{c}") == F.col("__n"), size).otherwise(F.col(f"__{c}_byte")) for c in "ab"})
    out = short.unionByName(done.select(*short.columns))
    plain = (F.col("__n") == 0) | F.col("__marked") | (_number(F.col("__digest"), 2) % 100 >= f.plain)
    kind = F.when(plain, "plain").when(_number(F.col("__digest"), 3) % 100 < f.spm, "spm").otherwise("psm")
    part = lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int"))
    a, b = F.col("__a_byte"), F.col("__b_byte")
    parts = {"p": part(F.lit(0), a), "m": part(a, b), "s": part(b, F.octet_length("__text").cast("long"))}
    mark = {"p": f.prefix, "s": f.suffix, "m": f.middle}
    put = lambda by: F.concat(*[x for c in by for x in (F.lit(mark[c]).cast("binary"), parts[c])]).cast("string")
    out = out.withColumn("__form", kind)
    return out.select(
        *[F.col(n).alias(c) for c, n in names.items() if c not in made],
        F.col("__n").alias("n"),
        F.col("__form").alias("form"),
        F.when(F.col("__form") != "plain", F.col("__a")).alias("prefix_chars"),
        F.when(F.col("__form") != "plain", F.col("__b") - F.col("__a")).alias("middle_chars"),
        F.when(F.col("__form") == "psm", put("psm")).when(F.col("__form") == "spm", put("spm")).otherwise(F.col("__text")).alias("output"),
    )


def restored(output: Column, kind: Column, form: Form | None = None) -> Column:
    """The text that output was made of: its parts hold no mark, so the marks tell where each of them ends."""
    f = form or Form()
    parts = F.split(output, "|".join(re.escape(m) for m in f.marks), -1)
    at = lambda k: F.get(parts, F.lit(k))
    return F.when(kind == "psm", F.concat(at(1), at(3), at(2))).when(kind == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)
