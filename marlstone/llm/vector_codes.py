"""Compression of vectors to codes: one codebook for each part of a vector, entries refined over rounds.

Components become integers, so sums are exact and in any order the same. Each round broadcasts a kd-tree for each
codebook (entries x dimensions numbers, whatever the table's size); tasks find every part's nearest entry by branch
and bound and sum parts up by entry before anything is shuffled.

A node is searched if its box may hold an entry as near as the best so far: also where the bound is equal, as an entry
of the same distance and a lower index may be in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cut
from marlstone.session import ship

#: Vectors that are searched for at once: bounds a worker's memory.
BATCH = 4096
#: Components are held within this: squared distances and sums then fit a long. In vectors, 2^26 / scale at scale 256.
LIMIT = 1 << 26


@dataclass(frozen=True)
class Coding:
    """parts of a vector, entries of a codebook, rounds of refinement, scale that components are multiplied by, and
    entries of a leaf of the tree (which changes the work, not the result)."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256
    leaf: int = 8


class Tree:
    """A kd-tree over the rows of entries (integers), split at the median of the dimension that spreads most."""

    def __init__(self, entries: np.ndarray, leaf: int):
        self.entries = entries
        self.nodes: list[tuple] = []  # low, high, rows of a leaf or None, left, right
        self._grow(np.arange(len(entries)), leaf)

    def _grow(self, rows: np.ndarray, leaf: int) -> int:
        own = self.entries[rows]
        low, high = own.min(axis=0), own.max(axis=0)
        at = len(self.nodes)
        self.nodes.append(())
        wide = int(np.argmax(high - low)) if own.shape[1] else 0
        if len(rows) <= leaf or not own.shape[1] or low[wide] == high[wide]:
            self.nodes[at] = (low, high, np.sort(rows), -1, -1)
        else:
            order = rows[np.argsort(own[:, wide], kind="stable")]
            half = len(rows) // 2
            self.nodes[at] = (low, high, None, self._grow(order[:half], leaf), self._grow(order[half:], leaf))
        return at

    def _bound(self, node: int, x: np.ndarray) -> np.ndarray:
        """Least squared distance of rows of x to the node's box."""
        low, high = self.nodes[node][:2]
        off = np.maximum(low - x, 0) + np.maximum(x - high, 0)
        return np.einsum("ij,ij->i", off, off)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each row's nearest entry, ties to the lower index."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        index = np.full(len(x), len(self.entries))
        self._search(0, np.arange(len(x)), x, index, best)
        return index, best

    def _search(self, node: int, rows: np.ndarray, x: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        _, _, held, left, right = self.nodes[node]
        if held is not None:
            off = x[rows][:, None, :] - self.entries[held][None]
            d = np.einsum("ijk,ijk->ij", off, off)
            k = np.argmin(d, axis=1)  # the first of equals: rows of a leaf ascend
            d, k = d[np.arange(len(rows)), k], held[k]
            won = (d < best[rows]) | ((d == best[rows]) & (k < index[rows]))
            best[rows[won]], index[rows[won]] = d[won], k[won]
            return
        own = x[rows]
        a, b = self._bound(left, own), self._bound(right, own)
        first = a <= b
        for side, bound, here in ((left, a, first), (right, b, ~first)):
            if here.any():
                self._search(side, rows[here], x, index, best)
        for side, bound, here in ((right, b, first), (left, a, ~first)):
            here = here & (bound <= best[rows])
            if here.any():
                self._search(side, rows[here], x, index, best)


def usable(vector: Column) -> Column:
    """Whether a vector isn't null and has no null or non-finite component."""
    bad = F.exists(vector.cast("array<double>"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def _whole(flat: np.ndarray, offsets: np.ndarray, c: Coding, width: int) -> np.ndarray:
    """Rows by parts by positions: integers of vectors, with zeros behind shorter ones."""
    size = np.diff(offsets)
    out = np.zeros((len(size), c.parts * width), np.int64)
    at = np.arange(out.shape[1])
    inside = at < size[:, None]
    out[inside] = np.clip(np.floor(flat[offsets[0] : offsets[-1]] * c.scale), -LIMIT, LIMIT)
    return out.reshape(len(size), c.parts, width)


def _vectors(column: pa.Array, c: Coding, width: int) -> Iterator[tuple[int, np.ndarray]]:
    column = column.cast(pa.list_(pa.float64()))
    for i in range(0, len(column), BATCH):
        part = column.slice(i, BATCH)
        yield i, _whole(part.values.to_numpy(zero_copy_only=False), part.offsets.to_numpy().astype(np.int64), c, width)


def _smallest(n: int):
    """id, v -> the rows of a task's n smallest ids, each once, with the smallest vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        kind = None
        for b in batches:
            kind = kind or b.schema
            ids = b.column(0)
            least = sorted({*kept, *(x for x in ids.unique().to_pylist() if x is not None)})[:n]
            kept = {k: v for k, v in kept.items() if least and k <= least[-1]}
            if not least:
                continue
            at = pa.compute.fill_null(pa.compute.less_equal(ids, pa.scalar(least[-1], ids.type)), False)
            rows = b.filter(at)
            for k, v in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                kept[k] = min(kept.get(k, v), v)
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(list(kept), kind.field(0).type), pa.array(list(kept.values()), kind.field(1).type)], names=["id", "v"])

    return run


def _trees(books: list[np.ndarray], c: Coding) -> list[Tree]:
    return [Tree(b, c.leaf) for b in books]


def _sums(shared, c: Coding, width: int):
    """v -> part, entry, n, sums: of a task's parts by their nearest entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(shared.value, c)
        most = max(len(t.entries) for t in trees)
        n, sums = np.zeros((c.parts, most), np.int64), np.zeros((c.parts, most, width), np.int64)
        for b in batches:
            for _, x in _vectors(b.column(0), c, width):
                for p, tree in enumerate(trees):
                    own = np.ascontiguousarray(x[:, p])
                    index, _ = tree.nearest(own)
                    n[p] += np.bincount(index, minlength=most)
                    np.add.at(sums[p], index, own)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return run


def _codes(shared, c: Coding, width: int):
    """id, label, v -> id, label, code, error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(shared.value, c)
        for b in batches:
            for i, x in _vectors(b.column(2), c, width):
                found = [tree.nearest(np.ascontiguousarray(x[:, p])) for p, tree in enumerate(trees)]
                digits = 2 if c.entries <= 256 else 4
                index = np.stack([f[0] for f in found], axis=1).astype(">u1" if digits == 2 else ">u2")
                code = [bytes(r).hex() for r in np.ascontiguousarray(index)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(x)), b.column(1).slice(i, len(x)), pa.array(code, pa.string()), pa.array(sum(f[1] for f in found))], names=["id", "label", "code", "error"])

    return run


def codebooks(vectors: DataFrame, c: Coding, width: int, first: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks after c.rounds rounds over vectors (v): each entry the floored mean of the parts nearest to it.

    Sums come from tasks ready-made, are added up in two steps, and reach the driver as one row for each entry.
    """
    books = first
    for _ in range(c.rounds):
        shared = vectors.sparkSession.sparkContext.broadcast(books)
        told = vectors.select("v").mapInArrow(_sums(shared, c, width), "part int, entry int, n long, sums array<long>")
        added = told.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(k))) for k in range(width)]).alias("sums"))
        books = [b.copy() for b in books]
        for r in added.collect():  # at most parts x entries rows
            books[r.part][r.entry] = np.array(r.sums, np.int64) // r.n
        shared.unpersist()
    return books


def encode(table: DataFrame, coding: Coding | None = None, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """id_col, label, code, error of every usable vector; and the final codebooks (entries by positions of each part).

    Components become floor(scale * x), held within LIMIT. The first codebooks are the parts of the usable vectors
    with the smallest distinct ids (null ids don't take part; of an id that repeats, the smallest vector), fewer where there
    are fewer. code: indexes in part order, two hex digits each (four beyond 256 entries). error: squared distances
    summed over parts. Vectors are as long as the longest of those first ones, rounded up to a multiple of the parts:
    shorter ones are filled up with zeros, longer ones left out, as are vectors that are null, or hold a null or
    non-finite component. Repeated rows get a row each. A table without usable ids has no codebooks, and gives no rows.
    """
    c = coding or Coding()
    spark = table.sparkSession
    ship(spark)
    own = table.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).filter(usable(F.col("v")))
    # Each task gives its smallest ids; of these few the smallest are taken.
    least = own.select("id", "v").mapInArrow(_smallest(c.entries), own.select("id", "v").schema)
    seeds = least.groupBy("id").agg(F.min("v").alias("v")).orderBy("id").limit(c.entries).collect()  # c.entries rows
    kind = f"id {dict(own.dtypes)['id']}, label {dict(own.dtypes)['label']}, code string, error long"
    if not seeds:
        return spark.createDataFrame([], kind).withColumnsRenamed({"id": id_col, "label": label}), []
    length = max(len(r.v) for r in seeds)
    width = max(1, -(-length // c.parts))
    whole = _whole(np.concatenate([np.asarray(r.v, np.float64) for r in seeds]), np.cumsum([0, *[len(r.v) for r in seeds]]), c, width)
    own = own.filter(F.size("v") <= c.parts * width)
    books = codebooks(own, c, width, [np.ascontiguousarray(whole[:, p]) for p in range(c.parts)])
    coded = own.mapInArrow(_codes(spark.sparkContext.broadcast(books), c, width), kind)
    return coded.withColumnsRenamed({"id": id_col, "label": label}), books


def label_errors(coded: DataFrame, label: str = "label", most: int = 100_000) -> DataFrame:
    """coded with label_error: the errors of all rows with an equal label (nulls together) summed up.

    Labels are summed up first and joined back: no label's rows meet in one task. Up to `most` labels, which are
    counted, are broadcast; more are joined by a shuffle.
    """
    per = cut(coded.groupBy(F.col(label).alias("__label")).agg(F.sum("error").alias("label_error")))
    hint = F.broadcast if per.count() <= most else (lambda d: d)
    return coded.join(hint(per), F.col(label).eqNullSafe(F.col("__label")), "left").drop("__label")


def decoded(code: str, books: list[np.ndarray]) -> np.ndarray:
    """The integers that a code stands for: its entries, one after another."""
    digits = len(code) // len(books)
    return np.concatenate([b[int(code[digits * p : digits * (p + 1)], 16)] for p, b in enumerate(books)])
