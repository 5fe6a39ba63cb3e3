"""Operators on literal frames and edge cases."""

from datetime import UTC, datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st_
from pyspark.sql import functions as F

from marlstone.functions import rules
from marlstone.functions import text as tx
from marlstone.operators import chunking as ch
from marlstone.operators import graph as g
from marlstone.operators import lifecycle as lc
from marlstone.operators import models as mo
from marlstone.operators import retrieval as r
from marlstone.operators import textindex as ti
from marlstone.sources import files
from marlstone.streaming import service as st


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_tokens_of_cjk_and_latin(spark):
    f = lambda s: one(spark, tx.tokens(F.lit(s)))
    assert f("存款保险") == ["存款", "款保", "保险"]
    assert f("R2") == ["r2"] and f("QDII基金") == ["qdii", "基金"] and f("金") == ["金"] and f("") == []


def test_similarities_of_empty_and_short_texts(spark):
    n = lambda s, k: tx.ngrams(F.lit(s), k)
    assert one(spark, tx.jaccard(n("a", 2), n("abc", 2))) == 0.0
    assert one(spark, tx.dice(n("abc", 2), n("abc", 2))) == 1.0
    assert one(spark, tx.contained(n("", 2), n("abc", 2))) is True


def test_cache_guards(spark):
    sim = lambda a, b: one(spark, tx.cache_similarity(F.lit(a), F.lit(b), [["buy", "purchase"]], ["foofund", "barfund"], {"in": ("buy",), "out": ("redeem",)}))
    assert sim("buy foofund today", "redeem foofund today") == 0.0
    assert sim("buy foofund today", "buy barfund today") == 0.0
    assert sim("fees 2023 foofund", "fees 2024 foofund") == 0.0
    assert sim("buy foofund today", "buy foofund today") == pytest.approx(1.0)


def test_bm25_ranks_and_ignores_absent_terms(spark):
    d = spark.createDataFrame([(1, "gold fund gold"), (2, "fund of funds"), (3, "")], "cid long, text string")
    q = spark.createDataFrame([(0, "gold"), (1, "nothing here"), (2, "fund")], "qid long, text string")
    got = [(x.qid, x.cid, x["rank"]) for x in r.bm25(r.index(d), q).orderBy("qid", "rank").collect()]
    assert got == [(0, 1, 1), (2, 2, 1), (2, 1, 2)] or got == [(0, 1, 1), (2, 1, 1), (2, 2, 2)]


def test_fusion_provenance_and_ties(spark):
    dense = spark.createDataFrame([(0, 1, 0.9, 1), (0, 2, 0.8, 2)], "qid long, cid long, score double, rank int")
    sparse = spark.createDataFrame([(0, 2, 5.0, 1), (0, 3, 4.0, 2)], "qid long, cid long, score double, rank int")
    assert [x.cid for x in r.rrf([dense, sparse]).orderBy("rank").collect()] == [2, 1, 3]
    assert {x.cid: x.found_by for x in r.provenance(dense, sparse).collect()} == {1: "dense", 2: "both", 3: "sparse"}


def test_mmr_prefers_what_is_new(spark):
    rows = [(0, 1, 1, [0.8, 0.6], [1.0, 0.0]), (0, 2, 2, [0.8, 0.6], [1.0, 0.0]), (0, 3, 3, [0.7, -0.714], [1.0, 0.0])]
    got = r.mmr(spark.createDataFrame(rows, "qid long, cid long, rank int, v array<double>, qv array<double>"), 2).orderBy("rank").collect()
    assert [x.cid for x in got] == [1, 3]


def test_children_keep_bounds_and_prefix(spark):
    t = "[A >> B] " + " ".join(f"Sentence number {i} is here." for i in range(40))
    kids = one(spark, ch.children(F.lit(t), 150, latin=True))
    assert len(kids) > 5 and all(k.startswith("[A >> B]") for k in kids)
    assert all(len(k) <= 150 + 30 for k in kids)
    assert one(spark, ch.children(F.lit("short."), latin=True)) == ["short."]
    assert one(spark, ch.children(F.lit(None).cast("string"))) == []


def test_sections_and_windows(spark):
    d = spark.createDataFrame([(1, "# Top\n" + "x" * 300 + "\n## Sub\n" + "y" * 300), (2, None), (3, "")], "doc_id long, text string")
    secs = ch.sections(ch.headings(d), d)
    assert [(x.path, x.start) for x in secs.orderBy("start").collect()] == [("# Top", 0), ("# Top >> ## Sub", 307)]
    assert ch.parents(d, secs).count() == 2
    assert {x.doc_id for x in ch.windows(d).collect()} == {1}


def test_paths_and_resolution(spark):
    e = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "d"), ("d", "r", "e"), ("a", "r", "c")], "head string, relation string, tail string")
    p = spark.createDataFrame([("a", "d"), ("a", "e"), ("b", "a")], "a string, b string")
    assert {(x.a, x.b): x.hops for x in g.shortest_paths(e, p).collect()} == {("a", "d"): 2, ("a", "e"): 3}
    assert {x.action for x in g.converge(e, e.limit(2)).collect()} == {"keep", "drop"}
    t = spark.createDataFrame([(1, "the Gold Fund rises"), (2, None)], "id long, text string")
    n = spark.createDataFrame([("Gold Fund", "GF"), ("gold fund", "lower"), ("silver", "S")], "alias string, entity string")
    assert [(x.id, x.entity) for x in g.resolve(t, n).collect()] == [(1, "GF")]


def test_rules_mask_and_route(spark):
    assert one(spark, rules.mask_pii(F.lit("call 13812345678 now"))) == "call 138****5678 now"
    assert one(spark, rules.emotion(F.lit("我要投诉"), F.lit(0), rules.REFERENCE)) == "complaint"
    assert one(spark, rules.fallback_intent(F.lit("???"), rules.REFERENCE)).intent == "unknown"
    assert one(spark, rules.mask_words(F.lit("abcabc"), ("abc",))) == "******"


def test_lifecycle(spark):
    store = spark.createDataFrame([("a", "h1", 1), ("b", "h2", 3)], "name string, content_hash string, version int")
    new = spark.createDataFrame([("a", "h9"), ("a", "h1"), ("c", "h9")], "name string, content_hash string")
    assert [(x.name, x.version) for x in lc.ingest(new, store).collect()] == [("a", 2)]
    assert sorted(x.change for x in lc.diff(store, store.filter("name = 'a'"), "name", "content_hash").collect()) == ["removed", "same"]
    moved = lc.move_tickets(spark.createDataFrame([(1, "open"), (2, "closed")], "id long, status string"), spark.createDataFrame([(1, "taken"), (2, "open")], "id long, to string"))
    assert {x.id: (x.status, x.moved) for x in moved.collect()} == {1: ("taken", True), 2: ("closed", False)}


@pytest.mark.parametrize("bad", [{"overlap": 400}, {"chunk_size": True}, {"mmr_lambda": float("inf")}, {"pool": 5}])
def test_settings_are_validated(bad):
    with pytest.raises(ValueError):
        files.validate(files.Settings(**bad))
    assert files.settings_diff(files.load_settings('{"top_k": 7, "unknown": 1}')) == ["top_k"]


def test_sources(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(x.a for x in files.read_lines(spark, str(tmp_path / "l.jsonl"), "a int").collect()) == [1, 2]
    up = tmp_path / "up"
    up.mkdir()
    (up / "x.txt").write_text("hello")
    (up / "y.txt").write_text("other")
    known = spark.createDataFrame([("hello",)], "t string").select(F.sha2("t", 256).alias("content_hash"))
    assert sorted(x.outcome for x in files.uploads(spark, str(up), known).collect()) == ["accepted", "duplicate"]


def test_swap_keeps_the_old_table_on_a_failed_check(spark, tmp_path):
    path = str(tmp_path / "t")
    assert files.swap(spark.range(5), path) == 5
    with pytest.raises(ValueError):
        files.swap(spark.range(3), path, equal_to={"vectors": 4})
    assert spark.read.parquet(path).count() == 5


def test_streams_equal_their_batch_twins(spark, tmp_path):
    rows = [(u, i, float(i * 7), (i * u) % 3 == 0) for i in range(40) for u in (1, 2, 3)]
    kinds = "user_id long, event_id long, at double, failed boolean"
    src = str(tmp_path / "in")
    for part in (rows[:60], rows[60:]):
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(src)
    got = st.run_once(st.circuit_breaker(stream, 2, 20.0), "breaker", str(tmp_path / "ck"))
    want = st.circuit_breaker(spark.createDataFrame(rows, kinds), 2, 20.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


TURN = "conv_id long, at timestamp, turn int, intent string, product string, negative boolean"


def at(seconds):
    return datetime.fromtimestamp(1_700_000_000 + seconds, UTC)


def test_dialog_state_carries_slots_and_topics(spark):
    rows = [(1, at(60), 1, "a", "p", False), (1, at(70), 2, "b", None, True), (1, at(80), 3, "b", None, True), (1, at(90), 4, "a", "q", False), (1, None, 5, "a", "q", False), (1, at(90 + 1801), 6, "a", None, None)]
    got = st.dialog_state(spark.createDataFrame(rows, TURN)).orderBy("turn").collect()
    assert [(x.product, x.negative_turns, x.turn_count, x.topics) for x in got] == [("p", 0, 1, ""), ("p", 1, 1, "a"), ("p", 2, 2, "a"), ("q", 0, 1, ""), ("", 0, 1, "")]


def test_dialog_stream_takes_turns_in_order_and_forgets_silent_sessions(spark, tmp_path):
    drops = [
        [(1, at(0), 1, "a", "p", False), (1, at(120), 3, "b", None, True), (2, at(5), 1, "a", "x", False)],
        [(1, at(60), 2, "a", None, True), (3, at(900), 1, "c", None, False)],  # turn 2 comes late, within the watermark
        [(1, at(4000), 4, "a", None, True), (3, at(8000), 2, "c", None, False)],  # sessions that were silent begin anew
        [(9, at(20_000), 1, "z", None, False), (1, at(10), 7, "late", None, False)],  # too late: left out
        [(9, at(40_000), 2, "z", None, False)],
    ]
    src, marks = tmp_path / "in", tmp_path / "marks"
    for i, rows in enumerate(drops):
        spark.createDataFrame(rows, TURN).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(TURN).parquet(str(src))
        done = st.dialog_state(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(marks)).trigger(availableNow=True).start()
        done.awaitTermination()
        progress = done.lastProgress or progress  # noqa: F821
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    every = [r for rows in drops for r in rows if r[3] != "late"]
    want = sorted(map(tuple, st.dialog_state(spark.createDataFrame(every, TURN)).filter("conv_id <> 9 or turn = 1").collect()))
    assert got == want and [x[4] for x in want if x[0] == 1] == [0, 1, 2, 1]
    # Only the session whose turns still wait is left.
    assert progress["stateOperators"][0]["numRowsTotal"] == 1


def test_gateway_cache_thresholds_and_guards(spark):
    c = [(1, "fund fees in 2024", [1.0, 0.0], 0), (2, "fund fees in 2024", [1.0, 0.0], 0), (3, "old rule", [0.0, 1.0], -100_000), (4, None, [0.0, 0.0], 0), (5, "zzz", [-1.0, 0.0], 0)]
    q = [(1, "fund fees in 2024", [1.0, 0.0], 9), (2, "fund fees in 2025", [1.0, 0.0], 9), (3, "old rule", [0.0, 1.0], 9), (4, "fund fees, 2024", [0.9, 0.436], 9), (5, "qwertyuiop 2024", [0.9, 0.436], 9), (6, " ", [1.0, 0.0], 9), (7, "x", None, 9)]
    got = r.gateway_lookup(spark.createDataFrame(q, "qid long, text string, qv array<double>, at long"), spark.createDataFrame(c, "key long, text string, v array<double>, created long"))
    assert sorted((x.qid, x.key, x.tier) for x in got.collect()) == [(1, 1, "same"), (4, 1, "near")]


def test_encoder_and_pair_scorer(spark):
    d = spark.createDataFrame([(1, "Buy funds", 0), (2, None, 0), (3, "funds buy", 0), (4, "", 0)], "id long, text string, v int")
    v = {x.id: x.v for x in mo.encode(d).collect()}
    assert v[1] == v[3] and len(v[1]) == 256 and abs(sum(a * a for a in v[1]) - 1) < 1e-5 and not any(v[2]) and not any(v[4])
    assert mo.encode(d.limit(0)).count() == 0
    pairs = spark.createDataFrame([(1, 7, "a b", "a b c"), (1, 5, "a b", "b a"), (1, 6, "a b", None), (2, 1, None, "a")], "qid long, cid long, query string, content string")
    assert sorted((x.qid, x["rank"], x.cid, x.score) for x in mo.rescore(pairs, k=2).collect()) == [(1, 1, 5, 1.0), (1, 2, 7, 1.0), (2, 1, 1, 0.0)]


def test_recursive_splitter_goes_from_coarse_to_fine():
    f = lambda s, size, overlap: ch.split_text(s, size, overlap)
    assert f("aaa\n\nbbb\n\nccc", 8, 0) == ["aaa\n\nbbb", "ccc"]
    assert f("aaa bbb ccc", 7, 3) == ["aaa bbb", "bbb ccc"]
    assert f("one two\n\nabcdefghij", 8, 0) == ["one two", "abcdefgh", "ij"]
    assert f("", 8, 2) == [] and f(" \n\n ", 8, 2) == []
    assert f("甲乙。丙丁。戊己", 6, 0) == ["甲乙。丙丁", "戊己"]


def _by_queue(pieces, sep, size, overlap):
    """The same packing, one piece after the other: a queue that is emptied from the front."""
    out, held = [], []
    for p in pieces:
        if held and len(sep.join([*held, p])) > size:
            out.append(sep.join(held))
            while held and (len(sep.join(held)) > overlap or len(sep.join([*held, p])) > size):
                held.pop(0)
        held.append(p)
    return out + ([sep.join(held)] if held else [])


@given(st_.lists(st_.text("ab", min_size=1, max_size=9), max_size=30), st_.sampled_from(["", " ", "\n\n"]), st_.integers(10, 25), st_.integers(0, 9))
def test_packing_equals_a_queue(pieces, sep, size, overlap):
    assert list(ch._packed(pieces, sep, size, overlap)) == _by_queue(pieces, sep, size, overlap)


@given(st_.text("ab .\n。", max_size=200), st_.integers(5, 40))
def test_recursive_pieces_fit_and_keep_every_letter(text, size):
    got = ch.split_text(text, size, 0)
    assert all(0 < len(x) <= size for x in got)
    assert [c for x in got for c in x if c in "ab"] == [c for c in text if c in "ab"]


def test_recursive_chunks_number_before_short_ones_go(spark):
    rows = [("d", "s", 2, "x\n\n" + "y" * 12 + "\n\n" + "z" * 12), ("e", None, None, None), ("f", None, None, "w" * 12)]
    d = spark.createDataFrame(rows, "chunk_id string, source string, page int, content string").withColumn("h", F.lit(1))
    got = [tuple(x) for x in ch.recursive_chunks(d, 13, 0, 12).orderBy("chunk_id").collect()]
    assert got == [("d_01", "s", 2, "y" * 12), ("d_02", "s", 2, "z" * 12), ("f_00", "", 0, "w" * 12)]
    assert ch.recursive_chunks(d.limit(0)).count() == 0


def test_canary_is_loud(spark, tmp_path):
    made = lambda x, n: ti.TextIndex.create(x, f"{tmp_path}/{n}")
    d = spark.createDataFrame([(1, "gold fund"), (2, "bond")], "cid long, text string")
    r.canary(made(d, "a"), "gold")
    with pytest.raises(RuntimeError, match="finds nothing"):
        r.canary(made(d, "b"), "silver")
    with pytest.raises(RuntimeError, match="no chunk"):
        r.canary(made(d.limit(0), "c"), "gold")


def test_hybrid_flags_graph_entries_and_parents(spark):
    ranked = "qid long, cid long, score double, rank int"
    dense = spark.createDataFrame([(0, 1, 0.9, 1), (0, 2, 0.8, 2), (1, 3, 0.5, 1)], ranked)
    sparse = spark.createDataFrame([(0, 2, 5.0, 1)], ranked)
    chunks = spark.createDataFrame([(1, "a", "gold"), (2, "b", "fund"), (3, "c", None), (9, "b", "whole")], "cid long, source string, content string")
    asked = spark.createDataFrame([(0, ["gold"], True), (1, ["x"], False), (2, ["y"], None)], "qid long, terms array<string>, relational boolean")
    entries = spark.createDataFrame([(0, i, s) for i, s in enumerate("gagxyz")] + [(1, 0, "g")], "qid long, pos int, source string")
    parents = spark.createDataFrame([(2, 9), (1, 9)], "cid long, parent long")
    got = [tuple(x) for x in r.hybrid(dense, sparse, chunks, asked, entries, parents).orderBy("qid", "rank").collect()]
    assert got == [(0, 1, 9, "b", "text", False), (0, 2, None, "g", "graph", False), (0, 3, None, "g", "graph", False), (0, 4, None, "x", "graph", False), (1, 1, 3, "c", "text", True)]
