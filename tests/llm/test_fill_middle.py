"""Fill-in-the-middle against brute force: the automaton, the scan over lanes and chunks, and edge cases."""

import hashlib
import random

import numpy as np
import pytest

from marlstone.llm import fill_middle as fm

ROW = "doc_id long, text string"
BITS = ["a", "é", "数", "🙂", "<", "P", "S", "M", ">", "\n", "<P", "word "]


def brute(doc, text, form):
    text = text or ""
    h = hashlib.sha256(f"{form.seed}{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, s, m = form.marks
    if not n or any(x in text for x in form.marks) or h[2] % 100 >= form.plain:
        return n, "plain", None, None, text
    if h[3] % 100 < form.spm:
        return n, "spm", a, b - a, s + text[b:] + p + text[:a] + m + text[a:b]
    return n, "psm", a, b - a, p + text[:a] + s + text[b:] + m + text[a:b]


def test_automaton_counts_from_every_state(monkeypatch):
    monkeypatch.setattr(fm, "LANE", 7)
    r, auto = random.Random(2), fm.Automaton(("<P>", "<S>", "<M>"))
    assert auto.size == 6
    texts = ["".join(r.choice(BITS) for _ in range(r.randint(0, 60))).encode() for _ in range(60)]
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    symbols, owner, _ = fm._lanes_of(data, np.cumsum(sizes) - sizes, sizes)
    end, total = fm.prefixes(*auto.lanes(symbols), owner)
    for i, t in enumerate(texts):
        for state in range(auto.size):
            at, units, marks = state, 0, 0
            for byte in t:
                units += auto.adds[at, byte] & 0x7FFFFFFF
                marks += auto.adds[at, byte] >> 31
                at = auto.to[at, byte]
            k = np.flatnonzero(owner == i)[-1]
            assert (end[k, state], total[k, state] & 0x7FFFFFFF, total[k, state] >> 31) == (at, units, marks)
        assert total[k, 0] & 0x7FFFFFFF == len(t.decode())
        assert total[k, 0] >> 31 == sum(t.count(m) for m in (b"<P>", b"<S>", b"<M>"))


@pytest.mark.parametrize("chunk", [5, 64, 1 << 16])
def test_equal_to_brute_force(spark, chunk):
    r = random.Random(chunk)
    form = fm.Form(chunk_bytes=chunk)
    texts = ["".join(r.choice(BITS) for _ in range(r.choice([0, 1, 3, 30, 200]))) for _ in range(120)]
    texts += [t.replace(">", "") for t in texts] + ["", None, "<P>", "x<M>", "ab", "🙂"]
    rows = [*enumerate(texts), (None, "no id"), (3, texts[3]), (3, texts[3])]
    out = fm.fill_in_middle(spark.createDataFrame(rows, ROW), form)
    got = sorted((tuple(x) for x in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fm.restored(out["output"], out["form"], form).alias("back")).collect()), key=repr)
    want = sorted(((d, *brute(d, t, form), t or "") for d, t in rows), key=repr)
    assert got == want
    assert {x[2] for x in got} == {"plain", "psm", "spm"}


def test_giant_text_and_other_marks(spark):
    form = fm.Form("<|pré|>", "<|suf|>", "<|mid|>", plain=100, chunk_bytes=1000)
    rows = [(i, "数é🙂x" * 100_000 + "." * i) for i in range(4)] + [(9, "a" * 300_000 + "<|pré|>" + "b" * 10)]
    out = fm.fill_in_middle(spark.createDataFrame(rows, ROW), form)
    got = {x.doc_id: tuple(x)[2:] for x in out.collect()}
    assert got == {d: brute(d, t, form) for d, t in rows}


def test_empty_table_clashing_columns_and_other_columns_stay(spark):
    d = spark.createDataFrame([(1, "abc", "f", 5, "k")], ROW + ", form string, n int, entry string")
    assert fm.fill_in_middle(d).columns == ["doc_id", "text", "entry", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert fm.fill_in_middle(d).first().entry == "k"
    assert fm.fill_in_middle(d.limit(0)).count() == 0
