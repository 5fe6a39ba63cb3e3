"""Decontamination against brute force: windows, short items, proximity, and edge cases."""

import random
import re

from marlstone.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ROW = "doc_id long, text string"
ITEM = "item_id long, text string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size, slack):
    out = []
    for doc, text in docs:
        d, hit, exact, near = words(text), set(), set(), set()
        for item, said in items:
            w = words(said)
            n = min(size, len(w))
            for s in range(len(w) - n + 1 if n else 0):
                for a in range(len(d)):
                    if d[a : a + n] == w[s : s + n]:
                        hit |= set(range(a, a + n))
                        exact.add(item)
                for a in range(-slack, len(d)):
                    if all(any(0 <= a + k + j < len(d) and d[a + k + j] == w[s + j] for k in range(slack + 1)) for j in range(n)):
                        near.add(item)
        listed = lambda x: sorted(str(i) for i in x if i is not None)
        out.append((doc, len(d), len(hit), listed(exact), listed(near)))
    return out


def run(spark, docs, items, match):
    rows = dc.decontaminate(spark.createDataFrame(docs, ROW), spark.createDataFrame(items, ITEM), match).collect()
    for r in rows:
        assert sum(s.end - s.begin + 1 for s in r.spans) == r.n_hit
        assert all(x.end + 1 <= y.begin for x, y in zip(r.spans, r.spans[1:], strict=False))
    return [(r.doc_id, r.n_words, r.n_hit, r["items"], r.near_items) for r in rows]


def order(rows):
    return sorted(rows, key=repr)


def test_equal_to_brute_force_on_few_words(spark):
    r = random.Random(3)
    gaps = [" ", ", ", "\n", "--", "\t_"]
    for size, slack, span, letters in ((3, 1, 4, "abc"), (4, 2, 8, "abcdE"), (10, 3, 64, "ab")):
        say = lambda n, a=letters: "".join(r.choice(a) + r.choice(gaps) for _ in range(n))  # noqa: E731, B023
        items = [(i % 9, say(r.randint(0, 12))) for i in range(14)] + [(None, say(6)), (20, None), (21, "!?"), (22, letters[0])]
        docs = [(i, say(r.randint(0, 40))) for i in range(40)] + [(40, None), (41, ""), (41, ""), (None, items[0][1]), (7, items[3][1])]
        docs += [(50, " ".join(words(items[5][1])[:2] + ["zz"] + words(items[5][1])[2:]))]
        match = dc.Match(size, slack, span)
        assert order(run(spark, docs, items, match)) == order(brute(docs, items, size, slack))


def test_long_repetition_hot_passage_and_letters_beyond_ascii(spark):
    passage = "The Élan of ÉTÉ 42 straße naïve ключ 数据 end of it all here now"
    docs = [(i, f"{passage} own{i}") for i in range(120)] + [(500, "echo " * 30_000), (501, passage.lower()), (502, passage.replace(" ", "  -- "))]
    items = [(1, passage), (2, "echo " * 12), (3, "end of it")]
    got = {r[0]: r for r in run(spark, docs, items, dc.Match())}
    assert all(got[i][2:4] == (15, ["1", "3"]) for i in range(120))
    assert got[500][1:4] == (30_000, 30_000, ["2"])
    # É isn't lowered: a text with é in its place shares only the eleven words behind it.
    assert got[501][2:4] == (11, ["1", "3"])
    assert got[502][2:4] == (15, ["1", "3"])


def test_beyond_the_broadcast_the_result_stays(spark):
    r = random.Random(4)
    items = [(i, " ".join(r.choice("pqrst") for _ in range(12))) for i in range(5)]
    docs = [(i, " ".join(r.choice("pqrst") for _ in range(30)) + " " + items[i % 5][1]) for i in range(20)]
    assert order(run(spark, docs, items, dc.Match(broadcast_rows=0))) == order(brute(docs, items, 10, 3))


def test_empty_tables_and_clashing_columns(spark):
    docs, items = spark.createDataFrame([(1, "a b c", "x", 1)], ROW + ", term string, place int"), spark.createDataFrame([(1, "a b", "y")], ITEM + ", row string")
    assert dc.decontaminate(docs.limit(0), items).count() == 0
    assert [(r.n_words, r.n_hit) for r in dc.decontaminate(docs, items.limit(0)).collect()] == [(3, 0)]
    assert [(r.n_words, r.n_hit, r["items"]) for r in dc.decontaminate(docs, items).collect()] == [(3, 2, ["1"])]
