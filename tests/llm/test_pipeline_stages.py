"""Each stage of the pipeline on nulls, empty texts, repeated rows, extra columns and an empty table."""

import corpus_pipeline as cp
import pytest

ROW = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, __h string"
GOOD = " ".join(f"word{i} of the text" for i in range(40))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, GOOD, "en", "a", 5, True, "x"), (1, GOOD, "en", "a", 5, True, "x"), (2, GOOD + " end", "en", None, None, None, None), (None, GOOD, None, None, None, None, None),
        (3, None, "en", "a", 0, None, None), (4, "", "de", "b", 0, None, None), (5, " \n\t", None, "b", 3, None, None), (6, "mail a@b.cd now " + " ".join(f"t{i}" for i in range(80)), "en", "b", 9, None, None),
    ]
    return spark.createDataFrame(rows, ROW)


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_a_stage_takes_odd_rows_and_an_empty_table(spark, sf, docs, name):
    stage = dict(cp.STAGES)[name]
    got = stage(spark, docs, sf)
    rows = got.collect()
    if name != "tokens":
        assert set(docs.columns) <= set(got.columns)
    ids = [r.doc_id for r in rows]
    if name == "quality_rules":
        assert 3 not in ids and 4 not in ids and 5 not in ids
    elif name == "near_duplicates":
        # The near copies 1, 1, 2 and the one without an id are one component; texts without words stay.
        assert sorted(ids) == [1, 3, 4, 5, 6]
    elif name == "personal_data":
        assert len(rows) == 8 and next(r.text for r in rows if r.doc_id == 6).startswith("mail <EMAIL> now") and next(r.text for r in rows if r.doc_id == 3) is None
    elif name == "source_mix":
        assert not {3, 4, 5} & set(ids) and {1, 2, 6} & set(ids)
    else:
        assert len(rows) == 8 and [r.n_tokens for r in rows if r.doc_id in (3, 4)] == [0, 0] and all(len(r.ids) == r.n_tokens for r in rows)
    assert stage(spark, docs.limit(0), sf).count() == 0
