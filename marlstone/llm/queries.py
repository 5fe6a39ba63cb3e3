"""One query per operator of this subpackage, over its whole table, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import ann, bpe, chat, decontaminate, fill_middle, licenses, mixing, ngram_join, pii, quality_classifier, quality_rules, secrets, vector_codes
from marlstone.llm.common import joined_spans, keep
from marlstone.session import table

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _span_digest(kinds: tuple[str, ...], found: str) -> list[Column]:
    base = F.concat(*[F.transform(k, lambda x: F.struct(x["s"], x["k"], x["e"], x["kind"])) for k in kinds])
    more = F.transform(found, lambda x: F.struct(x["s"], x["k"], x["e"], x["kind"]))
    return [*[F.size(k).cast("long").alias(f"n_{k}") for k in kinds], F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.concat(base, more)).alias("spans")]


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents: base patterns and spans found by bootstrapped contexts."""
    return pii.find_pii(table(spark, sf_dir, "documents")).select("doc_id", *_span_digest(pii.KINDS, "found"))


@query
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted; every digest is read back from the output."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    out = chat.parse_chats(chat.format_chats(turns.unionByName(own)))
    loss = chat.loss_text("formatted", F.col("segments"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "end_state",
    )


ORACLES["op8_chat"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *,
    length(replace(text, '\', '\\')) + length(regexp_replace(text, '<s>|</s>|<<SYS>>|<</SYS>>|<<ROLE>>|<<TEXT>>|<</ROLE>>|\[INST\]|\[/INST\]', chr(1) || '\0', 'g')) - length(text) AS escaped,
    length(replace(role, '\', '\\')) + length(regexp_replace(role, '<s>|</s>|<<SYS>>|<</SYS>>|<<ROLE>>|<<TEXT>>|<</ROLE>>|\[INST\]|\[/INST\]', chr(1) || '\0', 'g')) - length(role) AS escaped_role
  FROM t),
o AS (
  SELECT conv_id, role, row_number() OVER w AS i, lag(role) OVER w AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS back
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
m AS (
  SELECT conv_id,
    bool_and(CASE role WHEN 'system' THEN i = 1 WHEN 'user' THEN i = 1 OR before IN ('system', 'assistant') WHEN 'assistant' THEN i > 1 AND before = 'user' ELSE false END) AS legal,
    max(role) FILTER (back = 1) AS ends
  FROM o GROUP BY conv_id)
SELECT e.conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(escaped + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 25 + escaped_role END)::BIGINT AS formatted_chars,
  bool_and(legal AND ends = 'assistant') AS valid,
  max(CASE WHEN NOT legal THEN 'error' WHEN ends = 'system' THEN 'told' WHEN ends = 'user' THEN 'asked' ELSE 'answered' END) AS end_state
FROM e JOIN m ON e.conv_id IS NOT DISTINCT FROM m.conv_id GROUP BY e.conv_id
"""


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: base patterns and tokens that pass the randomness battery."""
    return secrets.find_secrets(table(spark, sf_dir, "documents")).select("doc_id", *_span_digest(secrets.KINDS[:3], "random"))


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150% of their words by source weights 5, 2, 1."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    path = tokenizer_path()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.decode(bpe.encode(docs, path).drop("text"), path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents; cutoffs are certified on all labelled documents."""
    out = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents under 5-word shingles and a Jaccard similarity of 0.8, with numbers of links."""
    return ngram_join.classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


@query
def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every vector whose id is divisible by 20."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


#: A tree of directories, as path and text: licence files at two depths, one without a licence, a root without.
LICENSE_TREE = (
    ("tree/LICENSE", "Released under the MIT License."),
    ("tree/main.py", "code"),
    ("tree/a/b/deep.py", "code"),
    ("tree/a/own.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
    ("tree/lib/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    ("tree/lib/x/y/z.py", None),
    ("tree/lib/n/NOTICE", "Names of those who helped."),
    ("tree/lib/n/w.py", "code"),
    ("tree/library/v.py", "code"),
    ("bare/u.py", "code"),
    ("u.py", "code"),
)


@query
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, whose paths are source and id, and of a tree with licence files (ids from -1 down)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text")
    tree = spark.createDataFrame([(-1 - i, p, t) for i, (p, t) in enumerate(LICENSE_TREE)], "doc_id long, path string, text string")
    return licenses.scan_licenses(docs.unionByName(tree)).select("doc_id", "path", "license", F.round("own_score", 6).alias("own_score"), "from_dir")


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by co-trained views of text and metadata."""
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents inside windows of benchmark items, and the items that occur, exactly and in proximity."""
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


ORACLES["op11_decontamination"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
b AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM benchmark),
p AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
q AS (SELECT item, item_id, len(ws) AS m, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM b),
a AS (SELECT r, item, item_id, m, i, p - i AS off FROM p JOIN q USING (w)),
s AS (SELECT DISTINCT r, item, item_id, m, i, off - t.k AS start, t.k = 0 AS exact FROM a, (VALUES (0), (1), (2), (3)) t(k)),
u AS (SELECT r, item, item_id, m, i, start, true AS exact FROM s WHERE exact UNION ALL SELECT DISTINCT r, item, item_id, m, i, start, false FROM s),
g AS (SELECT *, i - row_number() OVER (PARTITION BY r, item, start, exact ORDER BY i) AS run FROM u),
o AS (SELECT r, item, item_id, start, exact, min(i) AS lo, max(i) AS hi FROM g GROUP BY r, item, item_id, m, start, exact, run HAVING count(*) >= least(m, 10)),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(start + lo, start + hi + 1)) AS x FROM o WHERE exact) GROUP BY r),
n AS (SELECT r, count(DISTINCT item_id) FILTER (exact) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) FILTER (exact) AS ids, count(DISTINCT item_id) AS n_near FROM o GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
"""


@query
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut into prefix, middle and suffix, put in order, and rebuilt from the output."""
    out = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLES["op12_fill_middle"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, ('0x' || substr(h, 1, 8))::UBIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::UBIGINT % (n + 1) AS y,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::UBIGINT % 100 >= 90 THEN 'plain'
    WHEN ('0x' || substr(h, 25, 8))::UBIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
c AS (SELECT *, least(x, y)::BIGINT AS a, greatest(x, y)::BIGINT AS b FROM k)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    WHEN 'spm' THEN '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c
"""


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors by 16 codebooks of 64 entries after two rounds, with errors and a digest of the codebooks."""
    coded, books = vector_codes.encode(table(spark, sf_dir, "embeddings"))
    told = ",".join(str(x) for b in books for x in b.ravel())
    out = vector_codes.label_errors(keep(coded, "codes"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(told.encode()).hexdigest()).alias("codebooks_sha256"))


def _books_sql() -> str:
    """Two rounds of assignment and floored means after the first codebooks b0, then the last assignment a2."""
    near = """
a{n} AS MATERIALIZED (SELECT r, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM (
  SELECT r, part, entry, sum((x - c) * (x - c)) AS d FROM p JOIN b{n} USING (part, i) GROUP BY r, part, entry) GROUP BY r, part)"""
    means = """
b{m} AS MATERIALIZED (SELECT part, entry, i, coalesce((s - ((s % n) + n) % n) // n, c)::BIGINT AS c FROM b{n} LEFT JOIN (
  SELECT part, entry, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{n} JOIN p USING (r, part) GROUP BY part, entry, i) USING (part, entry, i))"""
    return ",".join(x.format(n=n, m=n + 1) for n in range(3) for x in (near, means)[: 1 if n == 2 else 2])


ORACLES["op13_vector_codes"] = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding AS e, len(embedding) // 16 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, (k - 1) // w AS part, (k - 1) % w AS i, floor(256 * e[k]::DOUBLE)::BIGINT AS x FROM (SELECT r, w, e, unnest(generate_series(1, len(e))) AS k FROM v)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, i, x AS c FROM p WHERE r <= 64),{_books_sql()},
o AS (SELECT r, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY r),
l AS (SELECT label, sum(error)::BIGINT AS label_error FROM o JOIN v USING (r) GROUP BY label)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, i)) FROM b2) AS codebooks_sha256
FROM o JOIN v USING (r) JOIN l ON v.label IS NOT DISTINCT FROM l.label
"""
