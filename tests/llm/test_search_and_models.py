"""Nearest neighbours, the n-gram join, encoding, the classifier and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import ann, bpe, ngram_join, quality_classifier
from marlstone.llm import queries as q
from marlstone.session import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(t):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def classes_of(texts):
    """By position: set size, smallest position reachable, links."""
    s = [shingle_set(t) for t in texts]
    near = [[j for j in range(len(s)) if j != i and s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])] for i in range(len(s))]
    out = []
    for i in range(len(s)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((len(s[i]), min(seen), len(near[i])))
    return out


def families():
    r = random.Random(3)
    texts = [None, "", " \n", "one", "ONE", "one two", "a b c d e", "A b C d e", "É b c d e", "é b c d e"]
    for _ in range(25):
        base = [f"w{r.randint(0, 40)}" for _ in range(r.choice([6, 12, 40, 90]))]
        for _ in range(r.randint(1, 8)):
            t = list(base)
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = f"x{r.randint(0, 400)}"
            texts.append(r.choice([" ", "\t", "\n "]).join(t))
    common = " ".join(f"c{i}" for i in range(30))
    texts += [common] * 12 + [common + f" tail{i} more" for i in range(30)] + ["z " * 3000]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize(
    "tuning",
    [
        ngram_join.Tuning(),
        ngram_join.Tuning(counters=64, slice_entries=100, block_sets=4, block_shingles=200, broadcast_rows=0),
        ngram_join.Tuning(hot=3),
        ngram_join.Tuning(counters=1024, hot=0, slice_entries=100, block_sets=4, block_shingles=100, broadcast_rows=0),
    ],
)
def test_join_equals_all_pairs(spark, tuning):
    texts = families()
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, owner string").repartition(7)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.n_links) for x in ngram_join.classes(d, tuning=tuning).collect()}
    assert [got[i] for i in range(len(texts))] == classes_of(texts)


@pytest.mark.parametrize("tuning", [ngram_join.Tuning(), ngram_join.Tuning(counters=64, slice_entries=100, block_sets=4, block_shingles=200, broadcast_rows=0), ngram_join.Tuning(hot=3)])
def test_join_links_sets_of_one_prefix_that_no_other_shares(spark, tuning):
    """Sets that differ in frequent shingles only have one prefix, and no other set has any of it."""
    texts = []
    for body in ([f"{b}{i}" for i in range(12)] for b in "abc"):
        texts += [" ".join([h, *body]) for h in ("x", "y", "z")]
        texts += [" ".join([h, *body[:4], f"{h}{body[0]}{i}", f"q{body[0]}{i}"]) for h in ("x", "y", "z") for i in range(20)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.n_links) for x in ngram_join.classes(d, tuning=tuning).collect()}
    want = classes_of(texts)
    assert sum(w[2] for w in want) == 18
    assert [got[i] for i in range(len(texts))] == want


def test_join_tells_long_words_and_large_sets_apart(spark):
    def thue_morse(n):
        return "".join("ab"[bin(i).count("1") % 2] for i in range(n))

    texts = []
    for n in (1024, 2048, 4096):
        w = thue_morse(n)
        texts += [w, w.translate(str.maketrans("ab", "ba")), w + " one two three four", w.translate(str.maketrans("ab", "ba")) + " one two three four"]
    r = random.Random(8)
    long = [f"w{r.randint(0, 10**9)}" for _ in range(60_000)]
    near = list(long)
    for i in r.sample(range(len(near)), 500):
        near[i] = "other"
    far = long[:30_000] + [f"v{i}" for i in range(30_000)]
    texts += [" ".join(x) for x in (long, near, far)] + ["q" * 3_000_000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id, x.n_links) for x in ngram_join.classes(d, tuning=ngram_join.Tuning(block_shingles=10_000)).collect()}
    assert [got[i] for i in range(len(texts))] == classes_of(texts)


def test_sketches_sum_over_many_tasks(spark):
    r = np.random.default_rng(6)
    t = ngram_join.Tuning(counters=256)
    whole, rows = np.zeros(256, np.int64), []
    for slot in range(150):
        c = r.integers(0, 3, 256) * r.integers(0, 2, 256)
        whole += c
        rows += [(slot, p, ngram_join._packed(np.flatnonzero(x), x[x > 0])) for p, x in enumerate(c.reshape(16, 16)) if x.any()]
    got = ngram_join._levels(spark.createDataFrame(rows, "slot int, part int, counts binary"), t)
    assert got.tolist() == np.round(256 * np.log2(1 + whole)).astype(int).tolist()
    assert not ngram_join._levels(spark.createDataFrame([], "slot int, part int, counts binary"), t).any()


def test_keep_one_of_each_component(spark):
    texts = families()
    d = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, owner string, id long")
    kept = ngram_join.keep_one(d)
    assert kept.columns == d.columns
    assert sorted(x.doc_id for x in kept.collect()) == [i for i, c in enumerate(classes_of(texts)) if c[1] == i]
    again = ngram_join.keep_one(d.unionByName(d).unionByName(spark.createDataFrame([(None, texts[-1], "x", 0)], d.schema)))
    assert again.filter("text rlike '[^ \\\\s]'").count() == kept.filter("text rlike '[^ \\\\s]'").count()
    assert ngram_join.keep_one(d.limit(0)).count() == 0


def test_nearest_reaches_recall_and_gives_exact_scores(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(30, 32))
    v = (centres[r.integers(0, 30, 3000)] + 0.4 * r.normal(size=(3000, 32))) * r.uniform(0.5, 2, (3000, 1))
    v[2990:] = v[0]  # ties
    rows = [(i, [float(x) for x in v[i]], 0) for i in range(3000)]
    odd = [(4000, None, 0), (4020, [], 0), (4040, [0.0] * 32, 0), (4060, [float("nan")] * 32, 0), (4080, [float("inf")] + [1.0] * 31, 0), (4100, [None] + [1.0] * 31, 0), (None, [1.0] * 32, 0)]
    d = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank int")
    got = ann.nearest(d, F.col("vec_id") % 20 == 0, search=ann.Search(chunk=200, queries=40)).collect()
    score = v[::20] @ v.T
    hits = 0
    for i in range(150):
        own = sorted((x["rank"], x.vec_id, x.score) for x in got if x.query_id == 20 * i)
        assert [x[0] for x in own] == list(range(1, 21)) and 20 * i not in [x[1] for x in own]
        assert all(s == pytest.approx(score[i, j], rel=1e-9) for _, j, s in own)
        assert [(-s, j) for _, j, s in own] == sorted((-s, j) for _, j, s in own)
        s = score[i].copy()
        s[20 * i] = -np.inf
        hits += len({j for _, j, _ in own} & set(np.lexsort((np.arange(3000), -s))[:20].tolist()))
    assert {x.query_id for x in got} == set(range(0, 3000, 20))
    assert hits >= 0.9 * 3000
    assert ann.nearest(d.limit(0), F.lit(True)).count() == 0


def test_nearest_on_the_table(spark, sf):
    e = {x.vec_id: np.asarray(x.embedding, dtype=np.float64) for x in table(spark, sf, "embeddings").collect()}
    ids = np.array(sorted(e))
    m = np.stack([e[i] for i in ids])
    got = q.op1_ann(spark, sf).collect()
    hit = n = 0
    for i in (x for x in ids if x % 20 == 0):
        s = m @ e[i]
        s[ids == i] = -np.inf
        want = set(ids[np.lexsort((ids, -s))[: min(20, len(ids) - 1)]].tolist())
        hit, n = hit + len(want & {x.vec_id for x in got if x.query_id == i}), n + len(want)
    assert hit >= 0.9 * n


def test_encoding_equals_the_library_and_round_trips(spark):
    from tokenizers import Tokenizer

    path = q.tokenizer_path()
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    r = random.Random(5)
    bits = ["word", " ", "  ", "\n", "é", "🙂", "don't", "12345", "<|endoftext|>", "ａ", "a" * 90, " " * 70, "́", "!?", "\t", "x_y"]
    texts = [None, "", "<|endoftext|>", " "] + ["".join(r.choice(bits) for _ in range(r.randint(1, 400))) for _ in range(25)] + ["a" * 3000, " " * 3000, "🙂" * 1500]
    d = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    for piece in (64, 1 << 16):
        rows = bpe.decode(bpe.encode(d, path, piece_chars=piece), path).collect()
        assert len(rows) == len(texts)
        for x in rows:
            want = tok.encode(texts[x.doc_id] or "", add_special_tokens=False).ids
            assert list(x.ids) == want
            assert x.decoded == tok.decode(want, skip_special_tokens=False)
    assert bpe.encode(d.limit(0), path).count() == 0


def test_encoding_digests_on_the_table(spark, sf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(q.tokenizer_path())
    texts = {x.doc_id: x.text for x in table(spark, sf, "documents").collect()}
    for x in q.op7_bpe(spark, sf).collect():
        ids = tok.encode(texts[x.doc_id] or "", add_special_tokens=False).ids
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert x.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_classifier_on_held_out_documents(spark):
    r = random.Random(6)
    words = [f"good{i}" for i in range(200)], [f"bad{i}" for i in range(200)], [f"both{i}" for i in range(400)]
    rows = []
    for i in range(900):
        y = i % 2
        own = words[0] if y else words[1]
        t = " ".join(r.choice(own if r.random() < 0.4 else words[2]) for _ in range(60))
        rows.append((i, t, "en", ("a" if y else "b") if r.random() < 0.8 else "c", len(t)))
    rows += [(900, None, None, None, None), (900, "", "en", "a", 0), (None, "good1", "en", "a", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(d, labels).collect()
    assert len(got) == len(rows)
    right = sum(x.kept == bool(x.doc_id % 2) for x in got if x.doc_id is not None and 400 <= x.doc_id < 900)
    assert right >= 0.95 * 500
    none = quality_classifier.classify(d, labels.limit(0)).collect()
    assert all(x.score is None and x.kept for x in none)


def test_pipeline_takes_effect_stage_by_stage(spark, sf):
    import corpus_pipeline as cp
    from tokenizers import Tokenizer

    docs = table(spark, sf, "documents")
    good = cp.quality(spark, docs, sf)
    kept = {x.doc_id for x in q.op10_quality_rules(spark, sf).filter("kept").collect()}
    assert {x.doc_id for x in good.collect()} == kept and good.columns == docs.columns
    texts = {x.doc_id: x.text for x in good.collect()}
    order = sorted(texts)
    want = {order[i] for i, c in enumerate(classes_of([texts[i] for i in order])) if c[1] == i}
    one = cp.near_duplicates(spark, good, sf)
    assert {x.doc_id for x in one.collect()} == want and one.columns == docs.columns
    masked = cp.personal_data(spark, one, sf)
    assert masked.columns == docs.columns and masked.filter("text rlike '[A-Za-z0-9]@[A-Za-z0-9-]+[.][A-Za-z]'").count() == 0
    assert masked.filter("n_chars <> length(text)").count() == 0
    mixed = cp.source_mix(spark, masked, sf)
    copies = Counter(x.doc_id for x in mixed.collect())
    assert set(copies) <= want and max(copies.values()) <= 2 and mixed.columns == docs.columns
    tok = Tokenizer.from_file(q.tokenizer_path())
    out = cp.run(spark, sf).collect()
    assert Counter(x.doc_id for x in out) == copies
    final = {x.doc_id: x.text for x in masked.collect()}
    assert all(list(x.ids) == tok.encode(final[x.doc_id], add_special_tokens=False).ids and x.n_tokens == len(x.ids) for x in out)


def test_classifier_takes_the_surest_of_all_unlabelled_documents(spark, monkeypatch):
    r = random.Random(13)
    rows = []
    for i in range(1200):
        y, rare = i % 2, i >= 1000 and i % 20 == 0
        t = " ".join(r.choice("rare" if rare else ("good" if y else "bad") if r.random() < 0.4 else "both") + str(r.randint(0, 200)) for _ in range(40))
        lang = "zz" if rare or (i < 400 and not y and i % 5) else "en"
        rows.append((i, t, lang, "a" if y and r.random() < 0.7 else "c", len(t)))
    d = spark.createDataFrame(rows + rows[:1] * 300, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    seen, own = [], quality_classifier.co_train

    def spied(words, form, m, y, c, surest):
        def told(model):
            out = surest(model)
            seen.append(out[0])
            assert set(out[1]) == set(out[0][0]) | set(out[0][1])
            return out

        assert len(y) == 400
        return own(words, form, m, y, c, told)

    monkeypatch.setattr(quality_classifier, "co_train", spied)
    co = quality_classifier.CoTraining(given=6, sure=0.6)
    assert quality_classifier.classify(d, labels, co=co).count() == len(rows) + 300
    rare = {x[0] for x in rows if x[0] >= 1000 and x[2] == "zz"}
    bad = {i for i, label in seen[0][1].items() if label == 0}
    assert len(rare) == 10 and len(bad) == 6 and bad <= rare
    assert all(len(labels) <= 2 * 6 and min(labels, default=400) >= 400 for told in seen for labels in told)


def test_jaccard_places_count_shingles_with_equal_low_halves():
    """Two groups share two shingles that differ in their high halves only: both count."""
    import pandas as pd

    entries = np.array([(t, g, 10) for g in (7, 8) for t in ((1 << 40) + 5, (2 << 40) + 5)], ngram_join.ENTRY)
    told = ngram_join._places(80)(pd.DataFrame({"slice": [3, 3], "entries": [entries[:2].tobytes(), entries[2:].tobytes()], "sets": [b"", b""]}))
    assert told[told["kind"] == 1].groupby("g")["n"].sum().to_dict() == {7: 2, 8: 2}
    again = ngram_join._places(80)(pd.DataFrame({"slice": [3, 3], "entries": [entries.tobytes()] * 2, "sets": [b"", b""]}))
    assert again[again["kind"] == 1].groupby("g")["n"].sum().to_dict() == {7: 2, 8: 2}
