"""Vector codes against brute force: nearest entries, rounds, ties, and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import vector_codes as vc

ROW = "vec_id long, embedding array<float>, label int"


def brute(rows, c):
    """All distances, in plain integers."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    first = {}
    for i, v, _ in rows:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    seeds = [first[i] for i in sorted(first)[: c.entries]]
    width = -(-max(map(len, seeds)) // c.parts)
    rows = [r for r in rows if len(r[1]) <= width * c.parts]
    ints = lambda v: ([math.floor(c.scale * x) for x in v] + [0] * (width * c.parts))[: width * c.parts]
    part = lambda v, p: v[p * width : (p + 1) * width]
    xs = [ints(v) for _, v, _ in rows]
    books = [[part(ints(v), p) for v in seeds] for p in range(c.parts)]
    near = lambda x, b: min((sum((p - q) ** 2 for p, q in zip(x, e, strict=True)), k) for k, e in enumerate(b))
    for _ in range(c.rounds):
        for p, book in enumerate(books):
            held = {}
            for x in xs:
                held.setdefault(near(part(x, p), book)[1], []).append(part(x, p))
            books[p] = [[sum(col) // len(held[k]) for col in zip(*held[k], strict=True)] if k in held else e for k, e in enumerate(book)]
    out = []
    for (i, _, label), x in zip(rows, xs, strict=True):
        found = [near(part(x, p), b) for p, b in enumerate(books)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, books


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize(("entries", "leaf", "levels"), [(64, 8, 4), (7, 1, 2), (20, 3, 100)])
def test_equal_to_brute_force_with_many_ties(spark, entries, leaf, levels):
    r = np.random.default_rng(entries)
    c = vc.Coding(parts=4, entries=entries, leaf=leaf)
    rows = [(int(i), [float(x) / 7 for x in r.integers(-levels, levels, 8)], int(i) % 3 if i % 5 else None) for i in r.permutation(150)]
    rows += rows[:10] + [(None, rows[3][1], 1), (0, rows[4][1], 2)]
    rows += [(200, None, 1), (201, [1.0, None] * 4, 1), (202, [float("nan")] * 8, 1), (203, [float("inf")] * 8, 1), (204, [1.0] * 3, 1), (205, [1.0] * 20, 1), (206, [], 1)]
    coded, books = vc.encode(spark.createDataFrame(rows, ROW).repartition(5), c)
    want, wanted = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], z) for i, v, z in rows], c)
    assert order(tuple(x) for x in coded.select("vec_id", "label", "code", "error").collect()) == order(want)
    assert [b.tolist() for b in books] == wanted
    x = vc.decoded(want[0][2], books)
    assert len(x) == 8
    sums = {}
    for _, label, _, e in want:
        sums[label] = sums.get(label, 0) + e
    for most in (100, 0):
        assert {(x.label, x.label_error) for x in vc.label_errors(coded, most=most).collect()} == set(sums.items())


def test_search_visits_boxes_of_equal_bound():
    # Both entries are as near; the lower index lies in the box that is searched last.
    tree = vc.Tree(np.array([[4, 0], [0, 0]]), 1)
    index, d = tree.nearest(np.array([[2, 0], [1, 0], [3, 0]]))
    assert index.tolist() == [0, 1, 0] and d.tolist() == [4, 1, 1]
    r = np.random.default_rng(1)
    for leaf in (1, 4, 50):
        e, x = r.integers(-3, 4, (40, 3)), r.integers(-4, 5, (500, 3))
        d = ((x[:, None] - e[None]) ** 2).sum(2)
        index, best = vc.Tree(e, leaf).nearest(x)
        assert (index == d.argmin(1)).all() and (best == d.min(1)).all()


def test_few_rows_empty_table_and_extreme_values(spark):
    d = spark.createDataFrame([(5, [3e38, -3e38], 1), (4, [0.0, 0.0], 1)], ROW).withColumn("code", F.lit("x"))
    coded, books = vc.encode(d, vc.Coding(parts=2))
    assert {x.vec_id: x.code for x in coded.collect()} == {4: "0000", 5: "0101"}
    assert [len(b) for b in books] == [2, 2]
    empty, none = vc.encode(d.limit(0))
    assert none == [] and empty.columns == ["vec_id", "label", "code", "error"] and vc.label_errors(empty).count() == 0
