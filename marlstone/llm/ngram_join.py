"""N-gram Jaccard self-join by a grouped prefix join.

A document is its set of word shingles, held as sorted 64-bit hashes; documents with the same set (told by 128 bits)
are one set from the start. All shingles have one order, rarest first by a count sketch of fixed size, then by hash;
two sets that are similar enough share a shingle of their prefixes in that order. Sets with identical prefixes and
size form a group. Prefix shingles are dealt to slices by hash; what several groups of fitting sizes share makes a
place, and shingles that the same groups share make the same place. A group of several sets has a place of its own, as
it may share nothing with others. Only there do groups meet: pairs of groups are filtered by size and by what their
prefixes have in common, each pair is taken at the first place that both have, and then the members of the pairs that
stay are fetched and verified by counting common shingles. Large places are split into blocks of bounded size.

Any order that all sets agree on gives the same links: the sketch only decides how much there is to do.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import cut, leaving_nothing, text_of
from marlstone.llm.components import components
from marlstone.session import ship

#: Bytes of text hashed at once: bounds a worker's memory.
CHUNK_BYTES = 1 << 20
#: Parts that the sketch is summed up in, and sketches that are summed at once.
PARTS, FAN_IN = 16, 64
#: Steps of a count's binary logarithm by which shingles are ordered.
STEPS = 256

_U = np.uint64
_rng = np.random.default_rng(20240229)
_PLACES = _rng.integers(1, 1 << 63, (64, 2), dtype=np.uint64) * _U(2) + _U(1)
_SPACE = re.compile(rb"[ \t-\r]")
ENTRY = np.dtype([("t", "<u8"), ("g", "<u8"), ("n", "<u4")])
SET = np.dtype([("o", "V16"), ("g", "<u8"), ("n", "<u4"), ("end", "<u8")])


@dataclass(frozen=True)
class Join:
    """n: words of a shingle; percent: least Jaccard similarity, in hundredths."""

    n: int = 5
    percent: int = 80


@dataclass(frozen=True)
class Tuning:
    """Sizes that change the work, never the result.

    counters: of the sketch, which is broadcast (2 bytes each); slice_entries: prefix shingles of a slice, on average;
    hot: count from which a shingle's sets are dealt over slices (8 times the mean counter, if that is more);
    block_sets, block_shingles: sets, and shingles of sets, in a block; broadcast_rows: rows up to which a table of
    keys (two longs) is broadcast.
    """

    counters: int = 1 << 22
    slice_entries: int = 1 << 20
    hot: int = 1 << 18
    block_sets: int = 512
    block_shingles: int = 1 << 19
    broadcast_rows: int = 500_000


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _pieces(raw: bytes) -> Iterator[bytes]:
    """raw in pieces of about CHUNK_BYTES, cut at white space."""
    at = 0
    while at < len(raw):
        gap = _SPACE.search(raw, at + CHUNK_BYTES) if len(raw) - at > CHUNK_BYTES else None
        to = gap.start() if gap else len(raw)
        yield raw[at:to]
        at = to


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the words of all texts, and where the words of each text begin (one more entry at the end).

    Words are maximal runs of other than space and 9-13, with A-Z lower-cased: what bytes are split and lowered by.
    """
    number: dict[bytes, int] = defaultdict(itertools.count().__next__)
    found, first = [np.zeros(0, np.int32)], np.zeros(len(texts) + 1, np.int64)
    for i, raw in enumerate(texts):
        n = 0
        for piece in _pieces(raw):
            words = piece.lower().split()
            found.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
            n += len(words)
        first[i + 1] = first[i] + n
    told = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, number)), np.uint64).reshape(-1, 2)
    which = np.concatenate(found)
    return told[which, 0], told[which, 1], first


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """Of each text the hashes of its words, in order."""
    words, _, first = _words([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    return [words[first[i] : first[i + 1]] for i in range(len(texts))]


def shingle_sets(texts: list[bytes], n: int) -> list[tuple[np.ndarray, bytes]]:
    """Of each text the sorted distinct hashes of its n-word shingles (of the whole sequence, if it is shorter), and
    16 bytes that tell the set, from both hashes of every shingle."""
    low, high, first = _words(texts)
    whole = max(len(low) - n + 1, 0)
    rolled = [np.zeros(whole, np.uint64), np.zeros(whole, np.uint64)]
    for lane, words in enumerate((low, high)):
        for k in range(n if whole else 0):
            rolled[lane] += words[k : k + whole] * _PLACES[k, lane]
        rolled[lane] = _mixed(rolled[lane])
    out = []
    for i in range(len(texts)):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= n:
            h = rolled[0][a : b - n + 1]
            order = np.argsort(h)
            h = h[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            h, more = h[new], rolled[1][a : b - n + 1][order[new]].sum(dtype=np.uint64)
        elif b > a:
            # A sequence shorter than a shingle is unlike any shingle: its length takes part.
            k = b - a
            h, more = (_mixed((w[a:b] * _PLACES[:k, lane]).sum(keepdims=True, dtype=np.uint64) + _PLACES[n + k, lane]) for lane, w in enumerate((low, high)))
        else:
            h, more = np.zeros(0, np.uint64), _U(0)
        out.append((h, xxhash.xxh3_128_digest(h.tobytes() + more.tobytes())))
    return out


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK_BYTES):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _packed(at: np.ndarray, counts: np.ndarray) -> bytes:
    return zlib.compress(np.diff(at, prepend=0).astype("<u4").tobytes() + counts.astype("<u8").tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    m = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<u4", m).astype(np.int64)), np.frombuffer(raw, "<u8", m, 4 * m)


def _sweep(n: int, counters: int):
    """id, tkey, text -> id, tkey, owner (of the set), n; then a task's counts of shingles by part of the sketch."""
    names = ["id", "tkey", "owner", "n", "slot", "part", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.uint32)
        waiting: list[np.ndarray] = []
        room = 1 << 20

        def count() -> None:
            if waiting:
                total[:] += np.bincount((np.concatenate(waiting) & _U(counters - 1)).astype(np.int64), minlength=counters).astype(np.uint32)
                waiting.clear()

        for b in batches:
            texts = _bytes(b.column(2))
            for i, j in _chunks(texts):
                found = shingle_sets(texts[i:j], n)
                waiting += [s for s, _ in found]
                room -= sum(len(s) for s, _ in found)
                if room < 0:
                    count()
                    room = 1 << 20
                part = b.slice(i, j - i)
                none = pa.nulls(j - i, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([o for _, o in found], pa.binary()), pa.array([len(s) for s, _ in found], pa.int32()), none, none, pa.nulls(j - i, pa.binary())], names=names)
        count()
        width = counters // PARTS
        for p in range(PARTS):
            own = total[p * width : (p + 1) * width]
            at = np.flatnonzero(own)
            if len(at):
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([p], pa.int32()), pa.array([_packed(at, own[at])], pa.binary())], names=names)

    return run


def _levels(sketches: DataFrame, t: Tuning) -> np.ndarray:
    """Level of each counter: STEPS times the binary logarithm of 1 + its sum over all tasks.

    Tasks' sketches are summed FAN_IN at a time; the driver gets two bytes of each counter.
    """
    width = t.counters // PARTS

    def summed(f: pd.DataFrame) -> np.ndarray:
        out = np.zeros(width, np.uint64)
        for data in f["counts"]:
            at, c = _unpacked(data)
            out[at] += c
        return out

    def more(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        out = summed(f)
        at = np.flatnonzero(out)
        return pd.DataFrame({"slot": [key[0]], "part": [key[1]], "counts": [_packed(at, out[at])]})

    def last(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "level": [np.round(STEPS * np.log2(1 + summed(f).astype(np.float64))).astype("<u2").tobytes()]})

    rows = sketches.select("slot", "part", "counts")
    slots = (rows.agg(F.max("slot")).first()[0] or 0) + 1
    while slots > FAN_IN:
        rows = rows.withColumn("slot", F.floor(F.col("slot") / FAN_IN).cast("int")).groupBy("slot", "part").applyInPandas(more, "slot int, part int, counts binary")
        slots = -(-slots // FAN_IN)
    out = np.zeros(t.counters, np.uint16)
    for r in rows.groupBy("part").applyInPandas(last, "part int, level binary").collect():  # PARTS rows
        out[r.part * width : (r.part + 1) * width] = np.frombuffer(r.level, "<u2")
    return out


def _slice_of(h: np.ndarray, slices: int) -> np.ndarray:
    return (((h >> _U(32)) * _U(slices)) >> _U(32)).astype(np.int64)


def prefix_size(n, percent: int):
    """Shingles in the prefix of a set of n (or of an array of sizes)."""
    return n - -(-percent * n // 100) + 1


def prefix(s: np.ndarray, levels: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The first shingles of a sorted set, so many that a similar set must share one, and the place of the last in the order.

    The place leaves out the last bits of the hash, which the order (of a sorted set, by a stable sort) doesn't: of two
    prefixes with equal places either may end first, and the filter then takes the larger of both bounds.
    """
    key = (levels[s & _U(len(levels) - 1)].astype(np.uint64) << _U(48)) | (s >> _U(16))
    first = np.argsort(key, kind="stable")[: prefix_size(len(s), percent)]
    return s[first], int(key[first[-1]])


def _prefixes(j: Join, slices: int, levels, hot_level: int):
    """text -> slice, entries (shingle, group, size), sets (owner, group, size, end): prefixes dealt by ranges of the hash.

    A hot shingle's entries go to slices of their own (below 0), by group. levels: a broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        seen: set[bytes] = set()
        pre: list[np.ndarray] = []
        told: list[tuple[bytes, int, int, int]] = []

        def dealt() -> pa.RecordBatch:
            sets = np.array(told, SET)
            flat, lens = np.concatenate(pre), np.array([len(p) for p in pre])
            g, n = np.repeat(sets["g"], lens), np.repeat(sets["n"], lens)
            is_hot = level[flat & _U(len(level) - 1)] >= hot_level
            to = np.where(is_hot, -1 - _slice_of(g, slices), _slice_of(flat, slices))
            out: dict[int, list[bytes]] = {}
            for at in _runs(to):
                k = int(to[at[0]])
                e = np.empty(len(at), ENTRY)
                e["t"], e["g"], e["n"] = flat[at], g[at], n[at]
                out[k] = [e.tobytes(), b""]
            to = _slice_of(sets["g"], slices)
            for at in _runs(to):
                out.setdefault(int(to[at[0]]), [b"", b""])[1] = sets[at].tobytes()
            return pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([x[0] for x in out.values()], pa.binary()), pa.array([x[1] for x in out.values()], pa.binary())], names=["slice", "entries", "sets"])

        for b in batches:
            texts = _bytes(b.column(0))
            for i, k in _chunks(texts):
                for s, owner in shingle_sets(texts[i:k], j.n):
                    if len(s) and owner not in seen:
                        if len(seen) >= 1 << 18:
                            seen.clear()
                        seen.add(owner)
                        p, end = prefix(s, level, j.percent)
                        pre.append(p)
                        told.append((owner, xxhash.xxh3_64_intdigest(p.tobytes() + len(s).to_bytes(8, "little")), len(s), end))
                if sum(map(len, pre)) > 1 << 20:
                    yield dealt()
                    pre, told = [], []
        if pre:
            yield dealt()

    return run


def _runs(keys: np.ndarray) -> list[np.ndarray]:
    """Positions of equal keys, one array for each key."""
    if not len(keys):
        return []
    order = np.argsort(keys, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(keys[order])) + 1)


def _places(percent: int):
    """One slice -> rows of kind 0: a set's owner, group, size and end; of kind 1: a group, a place that it shares, and
    for how many shingles the place stands.

    Groups that share a shingle stand by size; where one is too large for the one before it, the list ends and
    another begins. The place of a list is a hash of its groups, so shingles with the same list have the same place.
    A group of several sets, which are all in its slice, has the place of a list of its own, which stands for its prefix.
    """

    def of_lists(g: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return _mixed(np.add.reduceat(_mixed(g), at) + size.astype(np.uint64)) if len(g) else np.zeros(0, np.uint64)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        hot = f["slice"].iloc[0] < 0
        e = np.frombuffer(b"".join(f["entries"]), ENTRY)
        s = np.frombuffer(b"".join(f["sets"]), SET)
        if len(s):  # a set found in several batches
            s = s[np.unique(np.frombuffer(s["o"].tobytes(), "<u8").reshape(-1, 2), axis=0, return_index=True)[1]]
        t, g, n = (np.ascontiguousarray(e[c]) for c in ("t", "g", "n"))
        if hot:
            place = _mixed(t)
        else:
            order = np.lexsort((g, n, t))
            t, g, n = t[order], g[order], n[order].astype(np.int64)
            new = np.ones(len(t), bool)  # a group found in several batches: equal in the whole shingle, as counts must not fall short
            new[1:] = (t[1:] != t[:-1]) | (g[1:] != g[:-1])
            t, g, n = t[new], g[new], n[new]
            head = np.ones(len(t), bool)
            head[1:] = (t[1:] != t[:-1]) | (n[:-1] * 100 < percent * n[1:])
            at = np.flatnonzero(head)
            size = np.diff(np.append(at, len(t)))
            place = of_lists(g, at, size)
            g, place = g[np.repeat(size > 1, size)], np.repeat(place[size > 1], size[size > 1])
        both, times = np.unique(np.stack([g, place], axis=1), axis=0, return_counts=True) if len(g) else (np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))
        own, head, sets = np.unique(s["g"], return_index=True, return_counts=True)
        own, head = own[sets > 1], head[sets > 1]
        both = np.concatenate([both, np.stack([own, of_lists(own, np.arange(len(own)), np.ones(len(own)))], axis=1)])
        times = np.concatenate([times, prefix_size(s["n"][head].astype(np.int64), percent)])
        return pd.DataFrame(
            {
                "kind": np.repeat([0, 1], [len(s), len(both)]).astype(np.int32),
                "owner": [x.tobytes() for x in s["o"]] + [None] * len(both),
                "g": np.concatenate([s["g"], both[:, 0]]).view(np.int64),
                "n": np.concatenate([s["n"], times]).astype(np.int32),
                "end": np.concatenate([s["end"], np.zeros(len(both), np.uint64)]).view(np.int64),
                "place": np.concatenate([np.zeros(len(s), np.uint64), both[:, 1]]).view(np.int64),
            }
        )

    return run


class _Groups:
    """Groups at a place: sizes, ends of prefixes, and of each the places that it has and how many shingles these stand for."""

    def __init__(self, f: pd.DataFrame, at: np.ndarray):
        part = f.iloc[at]
        self.n = part["n"].to_numpy(np.int64)
        self.end = part["end"].to_numpy().view(np.uint64)
        self.places = [np.asarray(p, np.int64) for p in part["places"]]
        self.times = [np.asarray(p, np.float32) for p in part["times"]]

    def matrix(self, some: np.ndarray) -> np.ndarray:
        """Groups by some places (sorted): how many shingles of the group each stands for."""
        out = np.zeros((len(self.n), len(some)), np.float32)
        for i, (p, t) in enumerate(zip(self.places, self.times, strict=True)):
            at = np.searchsorted(some, p)
            has = some[np.minimum(at, len(some) - 1)] == p
            out[i, at[has]] = t[has]
        return out


def _meet(a: _Groups, b: _Groups, place: int, percent: int) -> np.ndarray:
    """Which groups of a meet which of b at a place: none of the places before it is common, sizes fit, and prefixes
    have enough in common.

    All that two sets share up to where the first of their prefixes ends is in both prefixes, so their common shingles
    are those of the prefixes and, at most, what the one with that prefix has behind it.
    """
    ok = (a.n[:, None] * 100 >= percent * b.n[None]) & (b.n[None] * 100 >= percent * a.n[:, None])
    behind_a, behind_b = (-(-percent * x.n // 100) - 1 for x in (a, b))
    behind = np.where(a.end[:, None] < b.end[None], behind_a[:, None], np.where(a.end[:, None] > b.end[None], behind_b[None], np.maximum(behind_a[:, None], behind_b[None])))
    need = -(-percent * (a.n[:, None] + b.n[None]) // (100 + percent)) - behind
    common = np.intersect1d(np.concatenate(a.places), np.concatenate(b.places))
    shared = np.zeros(ok.shape, np.float64)
    for k in range(0, len(common), 4096):
        some = common[k : k + 4096]
        left, right = a.matrix(some), b.matrix(some) > 0
        shared += left @ right.T.astype(np.float32)
        before = int(np.searchsorted(some, place))
        if before:
            ok &= (left[:, :before] > 0).astype(np.float32) @ right[:, :before].T.astype(np.float32) == 0
    return ok & (shared >= need)


def _segments(f: pd.DataFrame) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """place, x, y and positions of each pair of blocks in f."""
    order = np.lexsort((f["y"], f["x"], f["place"]))
    place, x, y = (f[c].to_numpy()[order] for c in ("place", "x", "y"))
    new = np.flatnonzero((place[1:] != place[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
    for at in np.split(order, new) if len(order) else ():
        i = at[0]
        yield int(f["place"].iat[i]), int(f["x"].iat[i]), int(f["y"].iat[i]), at


def _filtered(percent: int):
    """Groups at pairs of blocks of places -> those that meet another there (or whose members meet)."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        block, c = f["block"].to_numpy(), f["c"].to_numpy()
        some = [np.zeros(0, np.int64)]
        for place, x, y, at in _segments(f):
            a, b = at[block[at] == x], at[block[at] == y]
            ok = _meet(_Groups(f, a), _Groups(f, b), place, percent)
            if x == y:
                ok[np.diag_indices(len(a))] &= c[a] > 1
                some.append(a[ok.any(axis=1) | ok.any(axis=0)])
            else:
                some += [a[ok.any(axis=1)], b[ok.any(axis=0)]]
        return f.iloc[np.concatenate(some)][["place", "x", "y", "block", "g"]]

    return run


class _Block:
    """Sets of a block, with their groups."""

    def __init__(self, f: pd.DataFrame):
        self.sid = f["sid"].to_numpy()
        self.weight = f["copies"].to_numpy()
        self.n = f["n"].to_numpy().astype(np.int64)
        self.sets = [np.frombuffer(x, np.uint64) for x in f["shingles"]]
        _, head, self.group = np.unique(f["g"].to_numpy(), return_index=True, return_inverse=True)
        self.groups = _Groups(f, head)


def _links(a: _Block, b: _Block, place: int, percent: int) -> tuple[list, dict]:
    """Edges that span the links between two blocks (or within one), and each set's number of linked documents."""
    same = a is b
    ok = _meet(a.groups, b.groups, place, percent)
    every = a.sets if same else [*a.sets, *b.sets]
    ends = np.cumsum([len(s) for s in every])
    number = np.unique(np.concatenate(every), return_inverse=True)[1]
    local = np.split(number, ends[:-1])
    to = 0 if same else len(a.sets)  # where b's sets begin
    flag = np.zeros(number.max() + 1, np.int32)
    label = np.arange(len(every))
    degree = np.zeros(len(every), np.int64)
    edges = []
    for g in range(len(a.groups.n)):
        wanted = np.flatnonzero(ok[g][b.group])
        if not len(wanted):
            continue
        mine = np.flatnonzero(a.group == g)
        # As many at once as a block has shingles.
        flat = np.concatenate([local[to + w] for w in wanted])
        cuts = np.concatenate([[0], np.cumsum(b.n[wanted])[:-1]])
        for m in mine:
            flag[local[m]] = 1
            common = np.add.reduceat(flag[flat], cuts).astype(np.int64)
            flag[local[m]] = 0
            hit = wanted[100 * common >= percent * (a.n[m] + b.n[wanted] - common)]
            hit = hit[b.sid[hit] != a.sid[m]]
            if not len(hit):
                continue
            degree[m] += b.weight[hit].sum()
            if not same:
                degree[to + hit] += a.weight[m]
            for other in np.unique(label[to + hit]):
                if other != label[m]:
                    w = hit[label[to + hit] == other][0]
                    edges.append((int(a.sid[m]), int(b.sid[w])))
                    label[label == other] = label[m]
    sid = a.sid if same else np.concatenate([a.sid, b.sid])
    return edges, {int(sid[i]): int(degree[i]) for i in np.flatnonzero(degree)}


def _verified(percent: int):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        edges, degree = [], []
        for place, x, y, at in _segments(f):
            rows = f.iloc[at]
            a = _Block(rows[rows["block"] == x])
            more, told = _links(a, a if x == y else _Block(rows[rows["block"] == y]), place, percent)
            edges += more
            degree += told.items()
        whole = {"a": [e[0] for e in edges] + [d[0] for d in degree], "b": [e[1] for e in edges] + [None] * len(degree), "links": [None] * len(edges) + [d[1] for d in degree]}
        # Nullable integers: as floats, long ids would lose their last digits.
        return pd.DataFrame({c: pd.array(v, dtype="Int64") for c, v in whole.items()})

    return run


def _dealt(rows: DataFrame, groups: int) -> DataFrame:
    """rows with key: pairs of blocks dealt to so many groups, as a task's call for each pair would cost more than the pair."""
    return rows.withColumn("key", F.pmod(F.xxhash64("place", "x", "y"), F.lit(max(1, groups))))


def _blocked(members: DataFrame, percent: int, t: Tuning) -> DataFrame:
    """members (place, sid, g, n) dealt to pairs of blocks: once for every block that their own block is to meet.

    Blocks are bounded in sets and in shingles. The block of a set counts the sets of its place in smaller size
    classes, by a window over the (few) size classes of a place; within a class, sets are dealt by hash.
    """
    weight = F.greatest(F.col("n"), F.lit(max(1, t.block_shingles // t.block_sets))).cast("long")
    per = members.groupBy("place", "n").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum(F.col("c") * weight).over(Window.partitionBy("place").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    m = members.join(per.withColumn("before", before), ["place", "n"])
    m = cut(m.select("place", "sid", "g", "n", F.floor((F.col("before") + F.pmod(F.xxhash64("sid"), "c") * weight) / t.block_shingles).cast("int").alias("block")))
    ranges = m.groupBy("place", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("m"))
    other = ranges.select("place", F.col("block").alias("other"), F.col("lo").alias("lo2"), F.col("m").alias("m2"))
    # Pairs of blocks whose sizes can be similar at all; a set alone meets nobody.
    meet = ranges.join(other, "place").filter((F.col("block") <= F.col("other")) & (F.col("hi") * 100 >= percent * F.col("lo2")) & ((F.col("block") != F.col("other")) | (F.col("m") > 1))).select("place", F.col("block").alias("x"), F.col("other").alias("y"))
    sides = meet.select("place", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    return m.join(sides, ["place", "block"]).select("place", "x", "y", "block", "sid", "g", "n")


def classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", join: Join | None = None, tuning: Tuning | None = None) -> DataFrame:
    """id, tkey, root, n_shingles, component_id, n_links of every document.

    tkey is xxhash64 of the text; root names the component (null without shingles).

    n_links: other documents whose similarity is at least percent / 100, copies counted one by one.
    component_id: smallest id that links reach, its own included. Null, empty or blank texts have no shingles, no
    links and their own id. Null ids stay null unless a linked document has one. Rows repeated with the same id
    and text are documents of their own, and copies of each other. Other columns are not read. An empty table
    gives no rows.
    """
    j, t = join or Join(), tuning or Tuning()
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_of(F.col(text))).alias("tkey"), F.col(text).cast("string").alias("t"))
    swept = cut(src.mapInArrow(leaving_nothing(_sweep(j.n, t.counters)), "id long, tkey long, owner binary, n int, slot int, part int, counts binary"))
    held = swept.filter("part is null").select("id", "tkey", "owner", "n")
    full = held.filter("n > 0")
    owners = cut(full.groupBy("owner").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.min(F.struct("id", "tkey")).alias("pick"), F.first("n").alias("n")).withColumn("sid", F.monotonically_increasing_id()))
    levels = _levels(swept.filter("part is not null"), t)
    total, everywhere = (owners.agg(F.sum("n"), F.sum(F.col("n") * F.col("copies"))).first()[i] or 0 for i in (0, 1))
    slices = max(16, -(-total * (100 - j.percent) // 100 // t.slice_entries))
    hot_level = int(STEPS * np.log2(1 + max(t.hot, 8 * everywhere // t.counters)))
    packed = src.select("t").mapInArrow(leaving_nothing(_prefixes(j, slices, spark.sparkContext.broadcast(levels), hot_level)), "slice int, entries binary, sets binary")
    found = cut(packed.groupBy("slice").applyInPandas(leaving_nothing(_places(j.percent)), "kind int, owner binary, g long, n int, end long, place long"))
    # Of each group the places where it meets others, sorted; of these groups the member sets.
    live = found.filter("kind = 1").groupBy("g", "place").agg(F.sum("n").cast("int").alias("k")).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("place", "k"))).alias("x"))
    live = live.select("g", F.transform("x", lambda y: y["place"]).alias("places"), F.transform("x", lambda y: y["k"]).alias("times"))
    members = cut(found.filter("kind = 0").select("owner", "g", "n", "end").join(live, "g").join(owners.select("owner", "sid", "pick", "copies"), "owner"))
    rows = cut(_blocked(members.select("sid", "g", "n", F.explode("places").alias("place")), j.percent, t))
    spot = ["place", "x", "y", "block", "g"]
    groups = rows.groupBy(*spot).agg(F.count("*").alias("c"), F.min("sid").alias("sid")).join(members.select("sid", "n", "end", "places", "times"), "sid")
    n_rows, n_shingles = (rows.agg(F.count("*"), F.sum(F.col("n").cast("long"))).first()[i] or 0 for i in (0, 1))
    needed = cut(_dealt(groups, n_rows // (4 * t.block_sets)).groupBy("key").applyInPandas(leaving_nothing(_filtered(j.percent)), "place long, x int, y int, block int, g long"))
    meeting = rows.join(needed, spot, "left_semi")
    wanted = cut(members.join(meeting.select("sid").distinct(), "sid", "left_semi").drop("owner", "g", "n"))
    # A text that stands twice with its id gives the same set twice.
    arrays = _texts_of(src, wanted, t).mapInArrow(leaving_nothing(_arrays(j.n)), "sid long, shingles binary").dropDuplicates(["sid"])
    full_rows = meeting.join(arrays.join(wanted.drop("pick"), "sid"), "sid")
    links = cut(_dealt(full_rows, n_shingles // t.block_shingles).groupBy("key").applyInPandas(leaving_nothing(_verified(j.percent)), "a long, b long, links long"))
    comp = components(links.filter("b is not null").select("a", "b"))
    roots = cut(owners.join(comp, owners["sid"] == comp["node"], "left").select("owner", "sid", F.coalesce("root", "sid").alias("root"), F.col("root").isNotNull().alias("linked"), "least", "copies"))
    least = roots.filter("linked").groupBy("root").agg(F.min("least").alias("component_id"))
    degree = links.filter("links is not null").groupBy(F.col("a").alias("sid")).agg(F.sum("links").alias("links"))
    told = roots.join(least, "root", "left").join(degree, "sid", "left")
    told = told.select("owner", "root", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = full.join(told, "owner").select("id", "tkey", "root", F.col("n").cast("long").alias("n_shingles"), "component_id", "n_links")
    none = held.filter("n = 0").select("id", "tkey", F.lit(None).cast("long").alias("root"), F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(none).withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id", join: Join | None = None, tuning: Tuning | None = None) -> DataFrame:
    """docs with one row of each component: that of the smallest id (of the smallest text hash, among null ids).

    Rows without words are components of their own. Of rows that repeat the kept id and text, one stays.
    """
    tune = tuning or Tuning()
    names = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    i, t = F.col(names[id_col]).cast("long"), text_of(F.col(names[text]))
    c = cut(classes(docs, text, id_col, join, tune).filter("root is not null").groupBy(F.col(id_col).alias("id"), "tkey", "root").agg(F.count("*").alias("rows")))
    first = c.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "tkey")).alias("f")).select("root", F.col("f.id").alias("fid"), F.col("f.tkey").alias("ftkey"))
    told = c.join(first, "root").withColumn("kept", F.col("id").eqNullSafe(F.col("fid")) & (F.col("tkey") == F.col("ftkey")))
    out = cut(told.filter("not kept or rows > 1").select("id", "tkey", "kept"))
    hint = F.broadcast if out.count() <= tune.broadcast_rows else (lambda d: d)
    match = lambda k: (F.xxhash64(t) == k["tkey"]) & i.eqNullSafe(k["id"])
    result = own.join(hint(out), match(out), "left_anti")
    again = out.filter("kept")
    if not again.isEmpty():
        result = result.unionByName(own.join(hint(again), match(again), "left_semi").dropDuplicates([names[id_col], names[text]]))
    return result.select(*[F.col(n).alias(c) for c, n in names.items()])


def _arrays(n: int):
    """sid, text -> sid, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _bytes(b.column(1))
            for i, k in _chunks(texts):
                found = shingle_sets(texts[i:k], n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, k - i), pa.array([s.tobytes() for s, _ in found], pa.binary())], names=["sid", "shingles"])

    return run


def _texts_of(src: DataFrame, members: DataFrame, t: Tuning) -> DataFrame:
    """sid and text of one document of each member set. Few keys are broadcast; more of them are joined by a shuffle."""
    keys = members.select("sid", F.col("pick.id").alias("kid"), F.col("pick.tkey").alias("ktkey"))
    hint = F.broadcast if keys.count() <= t.broadcast_rows else (lambda d: d)
    return src.join(hint(keys), (F.col("tkey") == F.col("ktkey")) & F.col("id").eqNullSafe(F.col("kid"))).select("sid", "t")
