"""Reports, lists and keys over service and catalog tables: each an operator, with DuckDB SQL of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import ids
from marlstone.functions import rules as ru
from marlstone.functions import text as tx
from marlstone.operators import lifecycle as lc
from marlstone.operators import listing as li
from marlstone.operators import reports as re_
from marlstone.operators import strategies as st
from marlstone.plans.registry import plan
from marlstone.plans.retrieval import _BM, _Q, _lists, _queries, _two
from marlstone.session import table
from marlstone.sources import files

c = F.col


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


# --- sources ------------------------------------------------------------------------------------------------------


@plan("s7_product_triples", """SELECT n_name AS head, 'in' AS relation, r_name AS tail FROM nation JOIN region ON n_regionkey = r_regionkey
UNION SELECT p_name, 'is_type_of', CASE WHEN trim(split_part(p_type, '(', 1)) = 'STANDARD' THEN 'PLAIN' ELSE trim(split_part(p_type, '(', 1)) END FROM part
UNION SELECT p_name, 'risk_level', 'R' || (p_size % 5 + 1) FROM part UNION SELECT p_name, 'deposit_insured', CASE WHEN p_size % 2 = 0 THEN '是' ELSE '否' END FROM part""")
def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three triples of every part as a product, beside those of nations."""
    known = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey")).select(c("n_name").alias("head"), F.lit("in").alias("relation"), c("r_name").alias("tail"))
    part = _t(spark, sf_dir, "part").select(c("p_partkey").alias("id"), c("p_name").alias("name"), c("p_type").alias("type"), F.concat(F.lit("R"), c("p_size") % 5 + 1).alias("risk"), (c("p_size") % 2 == 0).alias("insured"))
    return li.product_triples(part, known, {"STANDARD": "PLAIN"})


@plan("s8_schema_evolution", """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, -1 AS nation FROM customer
UNION ALL SELECT s_suppkey, s_name, 'none', s_nationkey FROM supplier""")
def evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of different ages brought to one schema, twice, which changes nothing more."""
    want = {"segment": ("string", "none"), "nation": ("int", -1)}
    one = _t(spark, sf_dir, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("name"), c("c_mktsegment").alias("segment"))
    two = _t(spark, sf_dir, "supplier").select(c("s_suppkey").alias("id"), c("s_name").alias("name"), c("s_nationkey").alias("nation"))
    return li.migrate(li.migrate(one, want), want).unionByName(li.migrate(two, want))


@plan("s13_true_count", "SELECT count(*) AS stored, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS deleted, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS live FROM documents")
def live_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, those that labels stand for as tombstones, and the rest."""
    return li.true_count(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), "doc_id")


@plan("s17_upload_checks", """WITH f AS (SELECT doc_id, sha256(text) AS h, strlen(text) AS size FROM documents), k AS (SELECT DISTINCT h FROM f SEMI JOIN labels ON f.doc_id = labels.doc_id AND labels.toxic = 1),
a AS (SELECT h, min(lpad(doc_id::VARCHAR, 12, '0')) AS one FROM f WHERE size <= 4000 GROUP BY h)
SELECT doc_id, h AS content_hash, size, CASE WHEN size > 4000 THEN 'too_large' WHEN h IN (SELECT h FROM k) OR lpad(doc_id::VARCHAR, 12, '0') <> one THEN 'duplicate' ELSE 'accepted' END AS outcome FROM f LEFT JOIN a USING (h)""")
def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploaded files of at most 4,000 bytes; the toxic ones' contents are known."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.lpad(c("doc_id").cast("string"), 12, "0").alias("path"), F.sha2(c("text").cast("binary"), 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size"))
    known = d.join(_t(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id", "left_semi")
    return files.check_uploads(d.drop("doc_id"), known, 4000).select(c("path").cast("long").alias("doc_id"), "content_hash", "size", "outcome")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a structured log: some cut off, some with a message of another form, some with times to the first byte."""
    e = _t(spark, sf_dir, "events")
    n = c("event_id")
    path = F.concat(F.lit("/api/"), c("event_type"), F.when(n % 7 == 0, "/stream").otherwise(""))
    message = F.when(n % 17 == 0, F.lit("started")).otherwise(F.concat(F.lit("POST "), path, F.lit(" -> "), F.when(c("event_type") == "error", 500).otherwise(200).cast("string")))
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd").alias("timestamp"), message.alias("message"), n.cast("string").alias("trace_id"), F.when(n % 3 == 0, path).alias("path"), F.when(n % 11 == 0, 90_000_000).otherwise(n % 1000).alias("latency_ms"), F.when(n % 5 == 0, n % 50).alias("ttfb_ms")))
    return e.select(F.when(n % 13 == 0, F.left(line, F.lit(20))).otherwise(line).alias("value"))


_LOG = """WITH e AS (SELECT event_id AS n, strftime(ts, '%Y-%m-%d') AS day, event_type AS t, '/api/' || event_type || CASE WHEN event_id % 7 = 0 THEN '/stream' ELSE '' END AS path,
 CASE WHEN event_id % 11 = 0 THEN 90000000 ELSE event_id % 1000 END AS ms FROM events WHERE event_id % 13 <> 0)"""


@plan("s20_log_scan", _LOG + """ SELECT n::VARCHAR AS trace_id, day AS timestamp, CASE WHEN n % 17 = 0 THEN 'started' ELSE 'POST ' || path || ' -> ' || CASE WHEN t = 'error' THEN '500' ELSE '200' END END AS message,
CASE WHEN n % 3 = 0 THEN path END AS path, ms::DOUBLE AS latency_ms, CASE WHEN n % 5 = 0 THEN (n % 50)::DOUBLE END AS ttfb_ms FROM e""")
def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of structured log lines; lines that were cut off are left out."""
    return files.parse_logs(_lines(spark, sf_dir)).select("trace_id", "timestamp", "message", "path", "latency_ms", "ttfb_ms")


@plan("p20_log_samples", _LOG + """ SELECT n::VARCHAR AS trace_id, path, ms::BIGINT AS ms, CASE WHEN ms > 86400000 THEN 'suspect' WHEN n % 5 = 0 THEN 'stream' WHEN n % 7 = 0 THEN 'ignored' ELSE 'http' END AS kind
FROM e WHERE n % 17 <> 0 AND day >= '2024-01-10' AND (contains(path, 'i') OR contains(path, 'err')) AND (ms > 86400000 OR t <> 'error')""")
def log_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of answered requests on some paths since a day, by how they were timed."""
    return re_.latency_samples(files.parse_logs(_lines(spark, sf_dir)), "2024-01-10", ("i", "err"), True).select("trace_id", "path", "ms", "kind")


# --- predicates and joins -----------------------------------------------------------------------------------------


@plan("p1_chunk_browse", """SELECT doc_id, source, lang, md5(text) AS h, (SELECT count(*) FROM documents WHERE source = 'src3' AND contains(lang, 'e') AND contains(text, 'the')) AS total
FROM documents WHERE source = 'src3' AND contains(lang, 'e') AND contains(text, 'the') ORDER BY doc_id LIMIT 5 OFFSET 5""")
def browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a source's documents with some words, and how many there are."""
    return li.browse(_t(spark, sf_dir, "documents"), "doc_id", 2, 5, "src3", lang="e", text="the").select("doc_id", "source", "lang", F.md5(c("text").cast("binary")).alias("h"), "total")


@plan("p6_orders_by_status", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders that are open."""
    return li.in_states(_t(spark, sf_dir, "orders"), "o_orderstatus", ("O",)).select("o_orderkey", "o_orderstatus", "o_totalprice")


@plan("p10_cache_admissible", "SELECT event_id, event_type NOT IN ('error', 'signup') AND NOT contains(props, '\"k\": 7') AND NOT starts_with(props, '{\"k\": 1') AS admissible FROM events")
def admissible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the answer of an event may be kept: by its kind, by words, by how it begins."""
    return _t(spark, sf_dir, "events").select("event_id", li.cacheable(c("event_type"), c("props"), ("error", "signup"), ('"k": 7',), ('{"k": 1',)).alias("admissible"))


@plan("p13_subscribe_entry", """SELECT o_orderkey, o_custkey % 4 <> 0 AND ((o_orderstatus = 'F' AND o_totalprice > 1000) OR (o_orderstatus = 'O' AND o_orderkey % 3 = 0)) AS enters FROM orders""")
def subscribe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an order's turn is one to subscribe: bought with an amount, or asked for with a code."""
    s = F.struct(F.when(c("o_totalprice") > 1000, c("o_totalprice")).alias("amount"), F.when(c("o_custkey") % 4 != 0, F.lit("p")).alias("product"))
    intent = F.when(c("o_orderstatus") == "F", "buy_process").when(c("o_orderstatus") == "O", "product_consult").otherwise("complaint")
    text = F.when(c("o_orderkey") % 3 == 0, "code 123456.").otherwise("code 1234567")
    return _t(spark, sf_dir, "orders").select("o_orderkey", ru.enters_subscription(intent, text, s).alias("enters"))


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rating = F.when(c("l_returnflag") == "R", -1).otherwise(c("l_linenumber"))
    return _t(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("o_orderkey"), rating.alias("rating"))


@plan("j1_semi_downvoted", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def downvoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with an item that came back."""
    return li.with_downvote(_t(spark, sf_dir, "orders").select("o_orderkey"), _feedback(spark, sf_dir), "o_orderkey")


@plan("j2_scalar_min", "SELECT o_orderkey, (SELECT min(CASE WHEN l_returnflag = 'R' THEN -1 ELSE l_linenumber END) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS lowest FROM orders o")
def lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest rating of every order."""
    return li.with_lowest(_t(spark, sf_dir, "orders").select("o_orderkey"), _feedback(spark, sf_dir), "o_orderkey")


@plan("j3_equi_vectors", "SELECT d.doc_id, d.source, e.label FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id")
def with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their vectors' labels."""
    return li.vectors_of(_t(spark, sf_dir, "documents").select("doc_id", "source"), _t(spark, sf_dir, "embeddings").select(c("vec_id").alias("doc_id"), "label"), "doc_id")


@plan("j7_anti_known", """SELECT head, relation, tail, min(pos) AS pos FROM (SELECT 'c' || o_custkey AS head, o_orderpriority AS relation, o_orderstatus AS tail, o_orderkey AS pos FROM orders) x
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 0 AND x.head = 'c' || c_custkey AND x.tail = 'O') GROUP BY ALL""")
def new_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of orders, each once, without those known."""
    o = _t(spark, sf_dir, "orders")
    cand = o.select(F.concat(F.lit("c"), "o_custkey").alias("head"), c("o_orderpriority").alias("relation"), c("o_orderstatus").alias("tail"), c("o_orderkey").alias("pos"))
    rel = o.select(c("o_orderpriority").alias("relation")).distinct()
    heads = _t(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.concat(F.lit("c"), "c_custkey").alias("head"), F.lit("O").alias("tail"))
    return li.unknown(cand, heads.crossJoin(F.broadcast(rel)), ["head", "relation", "tail"], "pos")  # five priorities


@plan("j14_user_scope", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey")
def user_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's own orders, and of nobody else."""
    orders = _t(spark, sf_dir, "orders").select(c("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return li.scoped(orders, _t(spark, sf_dir, "customer"), "c_custkey")


@plan("j15_ownership", """SELECT l_orderkey AS o_orderkey, l_linenumber, l_partkey % 50 AS me, CASE WHEN o_orderkey IS NULL THEN 'missing' WHEN o_custkey <> l_partkey % 50 THEN 'denied' ELSE 'ok' END AS access
FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 6 <> 0) o ON l_orderkey = o_orderkey""")
def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether those who ask for orders may see them."""
    asked = _t(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("o_orderkey"), "l_linenumber", (c("l_partkey") % 50).alias("me"))
    return li.owned(asked, _t(spark, sf_dir, "orders").filter("o_orderkey % 6 <> 0"), "o_orderkey", "o_custkey")


@plan("j16_entity_join", """WITH e AS (SELECT doc_id, split_part(text, ' ', 1) AS question, CASE WHEN doc_id % 5 = 0 THEN 'no such name' ELSE split_part(text, ' ', 2) END AS name, doc_id % 2 = 0 AS keyed FROM documents)
SELECT question, min(doc_id) AS chunk_id FROM e JOIN documents d USING (doc_id) WHERE question <> '' AND length(trim(text)) >= 40 AND (NOT keyed OR contains(trim(text), name)) GROUP BY question""")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by documents' first words, where the document holds the entity asked for."""
    d = _t(spark, sf_dir, "documents")
    word = lambda i: F.split_part("text", F.lit(" "), F.lit(i))
    name = F.when(c("doc_id") % 5 == 0, "no such name").otherwise(word(2))
    kind = F.when(c("doc_id") % 2 == 0, "key").otherwise("other")
    e = d.select(c("doc_id").alias("chunk_id"), c("doc_id").alias("at"), word(1).alias("question"), F.array(F.struct(name.alias("name"), kind.alias("type"))).alias("entities"))
    return li.question_candidates(e, d.select(c("doc_id").alias("chunk_id"), c("text").alias("content")), ("key",))


@plan("j17_ticket_context", """WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role <> 'system')
SELECT c.conv_id, c.turn, coalesce((SELECT string_agg(r.turn || r.role, ',' ORDER BY r.turn) FROM r WHERE r.conv_id = c.conv_id AND rn <= 6), '') AS context FROM conversations c WHERE c.role = 'system'""")
def ticket_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six spoken turns of the conversations with a system's turn."""
    t = _t(spark, sf_dir, "conversations")
    turns = t.filter("role <> 'system'").select("conv_id", c("turn").alias("at"), "role")
    out = li.ticket_context(t.filter("role = 'system'").select("conv_id", "turn"), turns, "conv_id", "at", 6)
    return out.withColumn("context", F.array_join(F.transform("context", lambda x: F.concat(x["at"].cast("string"), x["role"])), ","))


@plan("j18_files_in_db", """WITH f AS (SELECT d.doc_id, l.doc_id IS NOT NULL AS in_db FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id)
SELECT doc_id || '.md' AS name, in_db, (SELECT count(*) FROM f WHERE NOT in_db) AS unprocessed FROM f""")
def in_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, and whether labels know them."""
    path = F.concat(F.lit("/kb/"), "source", F.lit("/"), c("doc_id").cast("string"), F.lit(".md"))
    stored = _t(spark, sf_dir, "labels").select(F.concat(c("doc_id").cast("string"), F.lit(".md")).alias("filename"))
    return li.on_disk(_t(spark, sf_dir, "documents").select(path.alias("path")), stored).select("name", "in_db", "unprocessed")


@plan("j19_append_new", "SELECT doc_id, 'label' AS origin FROM labels UNION ALL SELECT doc_id, 'document' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, and the documents that have none."""
    of = lambda n, o: _t(spark, sf_dir, n).select("doc_id", F.lit(o).alias("origin"))
    return li.append_new(of("labels", "label"), of("documents", "document"), "doc_id")


# --- aggregates ---------------------------------------------------------------------------------------------------


@plan("a1_intent_distribution", "SELECT event_type, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM events), 1)::DOUBLE AS share FROM events GROUP BY event_type")
def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each kind of event is."""
    return re_.distribution(_t(spark, sf_dir, "events"), "event_type")


@plan("a2_totals", "SELECT count(*) AS n, coalesce(sum(o_totalprice), 0) AS total, coalesce(sum(CASE WHEN o_orderstatus = 'none' THEN 1 END), 0)::BIGINT AS nothing FROM orders")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their prices; nothing to add is 0."""
    return re_.totals(_t(spark, sf_dir, "orders"), total=c("o_totalprice"), nothing=F.when(c("o_orderstatus") == "none", 1))


@plan("a3_status_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM orders), 1)::DOUBLE AS share FROM orders GROUP BY ALL")
def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status and priority."""
    return re_.distribution(_t(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@plan("a4_handoff_rate", "SELECT count(*) FILTER (WHERE event_type = 'error') AS part, count(*) FILTER (WHERE event_type <> 'error') AS whole, round(count(*) FILTER (WHERE event_type = 'error') * 100.0 / greatest(count(*) FILTER (WHERE event_type <> 'error'), 1), 1)::DOUBLE AS rate FROM events")
def handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors for a hundred other events."""
    e = _t(spark, sf_dir, "events")
    return re_.rate(e.filter("event_type = 'error'"), e.filter("event_type <> 'error'"))


@plan("a10_ticket_sla", """WITH t AS (SELECT epoch(o_orderdate) AS a, epoch(l_shipdate) AS b, epoch(l_shipdate) - l_quantity * 86400 AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <> 3)
SELECT count(*) AS tickets, round(avg(b - a) FILTER (WHERE b >= a), 6) AS mean_take, round(avg(d - a) FILTER (WHERE d >= a), 6) AS mean_close, round(avg((b - a <= 2592000)::INT) FILTER (WHERE b >= a), 6) AS within FROM t""")
def ticket_sla(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as tickets, created when ordered, taken when shipped, resolved some days earlier: times that are negative don't count."""
    x = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey"))
    resolved = F.expr("l_shipdate - make_dt_interval(CAST(l_quantity AS INT))")
    return re_.ticket_sla(x.select(c("o_orderdate").alias("created"), F.when(c("l_linenumber") != 3, c("l_shipdate")).alias("taken"), resolved.alias("resolved")), 2_592_000)


@plan("a12_duplicate_groups", "SELECT md5(text) AS h, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that more than one document has."""
    return re_.duplicate_groups(_t(spark, sf_dir, "documents").select("doc_id", F.md5(c("text").cast("binary")).alias("h")), "h", "doc_id")


@plan("a24_version_history", "SELECT props AS version, max(event_id) AS at, arg_max(value, event_id) AS value FROM events GROUP BY props")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last snapshot of each version."""
    return lc.latest(_t(spark, sf_dir, "events").select(c("props").alias("version"), c("event_id").alias("at"), "value"), "version", "at").orderBy("at")


@plan("a26_asset_overview", """WITH o AS (SELECT o_custkey AS id, sum(o_totalprice * 2) FILTER (WHERE o_orderstatus = 'F') AS held, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS owed FROM orders GROUP BY 1)
SELECT c_custkey AS id, round(c_acctbal, 2) AS total_deposit, round(coalesce(held, 0), 2) AS total_investment, round(coalesce(owed, 0), 2) AS total_liabilities, round(c_acctbal + coalesce(held, 0), 2) AS total_assets,
round(c_acctbal + coalesce(held, 0) - coalesce(owed, 0), 2) AS net_assets FROM customer LEFT JOIN o ON o.id = c_custkey""")
def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' balances, filled orders as holdings and open ones as loans."""
    k, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    id_ = c("o_custkey").alias("id")
    out = re_.asset_overview(k.select(c("c_custkey").alias("id")), k.select(c("c_custkey").alias("id"), c("c_acctbal").alias("total_deposit")), o.filter("o_orderstatus = 'F'").select(id_, c("o_totalprice").alias("amount")), o.filter("o_orderstatus = 'O'").select(id_, c("o_totalprice").alias("remaining")), unit=2)
    return out.select("id", *[F.round(x, 2).alias(x) for x in out.columns if x != "id"])


@plan("a27_cluster_profile", """WITH k AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT user_id, unnest(CASE WHEN event_id % 3 = 0 THEN ['slow', event_type] ELSE [event_type] END) AS reason FROM events),
s AS (SELECT user_id, reason, count(*) AS n FROM r GROUP BY ALL)
SELECT user_id, count(*) AS size, round(count(*) * 100.0 / (SELECT count(*) FROM events), 1)::DOUBLE AS share, (SELECT event_type FROM k WHERE k.user_id = e.user_id ORDER BY n DESC, event_type LIMIT 1) AS dominant_type,
arg_min(props, event_id) AS representative, (SELECT string_agg(reason || n, ',' ORDER BY n DESC, reason) FROM s WHERE s.user_id = e.user_id) AS reasons FROM events e GROUP BY user_id""")
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as clusters of their events."""
    reasons = F.when(c("event_id") % 3 == 0, F.array(F.lit("slow"), "event_type")).otherwise(F.array("event_type"))
    out = re_.cluster_profiles(_t(spark, sf_dir, "events").select("user_id", c("event_id").alias("id"), c("event_type").alias("type"), c("props").alias("query"), reasons.alias("reasons")), "user_id")
    return out.withColumn("reasons", F.array_join(F.transform("reasons", lambda x: F.concat(x["reason"], x["n"].cast("string"))), ","))


_N = "count(*) FILTER (WHERE event_type = '{}')"
_C1, _C2, _C3 = (_N.format(x) for x in ("click", "view", "purchase"))


@plan("a28_cache_stats", f"""SELECT count(*) AS lookups, {_C1} AS l1_hits, count(*) - {_C1} AS l1_misses, round({_C1} * 100.0 / count(*), 1)::DOUBLE AS l1_hit_ratio, {_C2} AS l2_hits, count(*) - {_C1} - {_C2} AS l2_misses,
round({_C2} * 100.0 / (count(*) - {_C1}), 1)::DOUBLE AS l2_hit_ratio, {_C3} AS l3_hits, count(*) - {_C1} - {_C2} - {_C3} AS l3_misses, round({_C3} * 100.0 / (count(*) - {_C1} - {_C2}), 1)::DOUBLE AS l3_hit_ratio,
{_C1} + {_C2} + {_C3} AS hits, count(*) - {_C1} - {_C2} - {_C3} AS misses, round(({_C1} + {_C2} + {_C3}) * 100.0 / count(*), 1)::DOUBLE AS hit_ratio FROM events""")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lookups that three tiers answer, or none."""
    t = c("event_type")
    return re_.cache_stats(_t(spark, sf_dir, "events").select(F.when(t == "click", 1).when(t == "view", 2).when(t == "purchase", 3).alias("tier")))


@plan("a29_worker_stats", """SELECT user_id AS worker, count(*) AS submitted, count(*) FILTER (WHERE event_type <> 'view') AS completed, count(*) FILTER (WHERE event_type = 'view') AS active, round(coalesce(avg(value) FILTER (WHERE event_type <> 'view'), 0), 6) AS mean,
coalesce(max(value) FILTER (WHERE event_type <> 'view'), 0) AS longest, count(*) FILTER (WHERE event_type = 'click') AS timeouts, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY user_id""")
def workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as workers: views are still running, clicks timed out, errors failed."""
    t = c("event_type")
    out = re_.worker_stats(_t(spark, sf_dir, "events").select(c("user_id").alias("worker"), c("value").alias("seconds"), F.when(t == "click", "timeout").when(t == "error", "error").when(t != "view", "ok").alias("outcome")), "worker")
    return out.withColumn("mean", F.round("mean", 6))


@plan("a30_cumulative_documents", "SELECT day, n, sum(n) OVER (ORDER BY day)::BIGINT AS total FROM (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1) x")
def cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each day and up to it."""
    return re_.cumulative(_t(spark, sf_dir, "orders"), F.to_date("o_orderdate"))


@plan("a31_document_types", "SELECT lower(regexp_extract(url, '([^./]*)$', 1)) AS kind, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM pages), 1)::DOUBLE AS share FROM pages GROUP BY 1")
def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by what their address ends in."""
    return re_.distribution(_t(spark, sf_dir, "pages").select(F.lower(F.regexp_extract("url", "([^./]*)$", 1)).alias("kind")), "kind")


@plan("a32_mean_latency", _LOG + """ SELECT kind, count(*) AS n, round(avg(ms), 6) AS mean FROM (SELECT ms, CASE WHEN n % 5 = 0 THEN 'stream' WHEN n % 7 = 0 THEN 'ignored' ELSE 'http' END AS kind
FROM e WHERE n % 17 <> 0 AND ms <= 86400000) x GROUP BY kind""")
def mean_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean times of the requests of a log, by how they were timed."""
    return re_.mean_latency(re_.latency_samples(files.parse_logs(_lines(spark, sf_dir))))


@plan("a33_upload_outcomes", "SELECT count(*) AS total, count(*) FILTER (WHERE n_chars > 500) AS accepted, count(*) FILTER (WHERE n_chars BETWEEN 101 AND 500) AS skipped, count(*) FILTER (WHERE n_chars BETWEEN 51 AND 100) AS rejected FROM documents")
def upload_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of a batch of documents, by their length."""
    n = c("n_chars")
    return re_.outcomes(_t(spark, sf_dir, "documents").select(F.when(n > 500, "accepted").when(n > 100, "skipped").when(n > 50, "rejected").otherwise("pending").alias("status")), "status", ("accepted", "skipped", "rejected"))


@plan("a34_uncovered", "SELECT count(*) AS total, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS uncovered FROM documents")
def uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label."""
    return re_.uncovered(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels"), "doc_id")


@plan("a35_parent_children", "SELECT 'order_' || o_custkey AS parent_id, count(*) AS children, sum(length(o_orderpriority))::BIGINT AS chars FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY o_custkey")
def family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chunks of their customers; every third isn't a child."""
    name = F.concat(F.lit("order_"), c("o_custkey").cast("string"), F.when(c("o_orderkey") % 3 != 0, F.concat(F.lit("_c"), c("o_orderkey").cast("string"))).otherwise(""))
    return re_.family_sizes(_t(spark, sf_dir, "orders"), ids.parent_id(name), c("o_orderpriority"))


# --- lists and sets -----------------------------------------------------------------------------------------------


@plan("l1_top_k", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 events of the highest value."""
    return li.top_k(_t(spark, sf_dir, "events").select("event_id", "value"), "value", "event_id", 25)


@plan("l2_page", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 20 OFFSET 40")
def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of orders, newest first."""
    return li.page_of(_t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 20, 40)


@plan("l3_queue", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 newest orders that wait."""
    return li.queue(_t(spark, sf_dir, "orders"), "o_orderstatus", ("O", "P"), 50, "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


@plan("l8_last_ascending", "SELECT event_id FROM (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 20) x ORDER BY event_id")
def last_ascending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 20 events, oldest first."""
    return li.tail(_t(spark, sf_dir, "events").select("event_id"), 20, "event_id")


@plan("u1_jaccard_sizes", """WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-zA-Z0-9_]+')) AS ws FROM documents)
SELECT a.doc_id, b.doc_id AS next_id, len(list_intersect(a.ws, b.ws)) AS inter, len(list_distinct(list_concat(a.ws, b.ws))) AS uni FROM w a JOIN w b ON b.doc_id = a.doc_id + 1""")
def set_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common and all words of every document and the one of the next id."""
    w = _t(spark, sf_dir, "documents").select("doc_id", F.array_distinct(tx.tokens(c("text"))).alias("ws"))
    nxt = w.select((c("doc_id") - 1).alias("doc_id"), c("doc_id").alias("next_id"), c("ws").alias("other"))
    return w.join(nxt, "doc_id").select("doc_id", "next_id", tx.set_sizes(c("ws"), c("other")).alias("x")).select("doc_id", "next_id", "x.inter", "x.uni")


@plan("u2_union_triples", """SELECT n_name AS head, 'in' AS relation, r_name AS tail FROM nation JOIN region ON n_regionkey = r_regionkey
UNION SELECT s_name, 'in', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT n_name, 'in', r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def union_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of nations, of suppliers, and of customers' nations, which are there already."""
    t = lambda n: _t(spark, sf_dir, n)
    of = lambda h, x: F.struct(c(h).alias("head"), F.lit("in").alias("relation"), c(x).alias("tail")).alias("t")
    nation = t("nation").join(t("region"), F.expr("n_regionkey = r_regionkey"))
    frames = (nation.select(of("n_name", "r_name")), t("supplier").join(t("nation"), F.expr("s_nationkey = n_nationkey")).select(of("s_name", "n_name")), t("customer").join(nation, F.expr("c_nationkey = n_nationkey")).select(of("n_name", "r_name")))
    return li.union_distinct(*[f.select("t.*") for f in frames])


@plan("u3_except_keys", "SELECT doc_id, 'removed' AS change FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'added' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
def key_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that only documents have, and that only embeddings have."""
    return li.key_changes(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "embeddings").select(c("vec_id").alias("doc_id")), "doc_id")


@plan("u5_merge_distinct", """WITH x AS (SELECT lang AS qid, 0 AS list, doc_id AS pos, CASE WHEN doc_id % 3 <> 0 THEN doc_id END AS cid, text AS content FROM documents
UNION ALL SELECT lang, 1, doc_id, doc_id, text FROM documents SEMI JOIN labels ON documents.doc_id = labels.doc_id)
SELECT qid, coalesce(cid::VARCHAR, substring(content, 1, 50)) AS key, min(list * 1000000000000 + pos) AS at FROM x GROUP BY ALL""")
def merge_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists for each language, all documents (every third without an id) and the labelled ones, merged."""
    d = _t(spark, sf_dir, "documents")
    one = d.select(c("lang").alias("qid"), F.lit(0).alias("list"), c("doc_id").alias("pos"), F.when(c("doc_id") % 3 != 0, c("doc_id")).alias("cid"), c("text").alias("content"))
    two = d.join(_t(spark, sf_dir, "labels"), "doc_id", "left_semi").select(c("lang").alias("qid"), F.lit(1).alias("list"), c("doc_id").alias("pos"), c("doc_id").alias("cid"), c("text").alias("content"))
    out = li.merge_distinct(one.unionByName(two))
    return out.select("qid", "key", (c("at.list").cast("long") * 1_000_000_000_000 + c("at.pos")).alias("at"))


@plan("u6_graph_injection", """SELECT o_custkey AS qid, o_orderkey AS pos, o_orderpriority AS source, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders o
WHERE o_orderstatus <> 'F' AND NOT EXISTS (SELECT 1 FROM orders i WHERE i.o_custkey = o.o_custkey AND i.o_orderpriority = o.o_orderpriority AND i.o_orderstatus = 'F') QUALIFY n <= 3""")
def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer's orders that aren't filled three whose priority none of the filled ones has."""
    o = _t(spark, sf_dir, "orders").select(c("o_custkey").alias("qid"), c("o_orderkey").alias("pos"), c("o_orderpriority").alias("source"), "o_orderstatus")
    return li.injected(o.filter("o_orderstatus <> 'F'").drop("o_orderstatus"), o.filter("o_orderstatus = 'F'"))


# --- keys and formats ---------------------------------------------------------------------------------------------


def _chunk() -> Column:
    """Ids of orders as chunks, children and chunks of files."""
    n = c("o_custkey").cast("string")
    return F.concat(F.lit("doc_"), c("o_orderkey").cast("string"), F.when(c("o_orderkey") % 2 == 0, F.concat(F.lit("_c"), n)).otherwise(F.concat(F.lit(".md_"), n)))


@plan("f27_parent_id", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'told' WHEN o_orderkey % 2 = 0 THEN 'doc_' || o_orderkey END AS parent FROM orders")
def parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of chunks: told, by name, or none."""
    return _t(spark, sf_dir, "orders").select("o_orderkey", ids.parent_id(_chunk(), F.when(c("o_orderkey") % 5 == 0, "told")).alias("parent"))


@plan("f28_strip_suffix", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN replace(o_orderpriority, ' ', '') WHEN o_orderkey % 2 = 0 THEN 'doc_' || o_orderkey ELSE 'doc_' || o_orderkey || '.md_' || o_custkey END AS stem,
'doc_' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '_c' || o_custkey ELSE '.md' END AS file FROM orders""")
def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What chunks of a document share, and the files they are of."""
    none = F.when(c("o_orderkey") % 7 != 0, _chunk())
    return _t(spark, sf_dir, "orders").select("o_orderkey", ids.document_key(none, c("o_orderpriority")).alias("stem"), ids.file_of(_chunk()).alias("file"))


@plan("f29_triple_id", "SELECT s_suppkey, substring(md5(concat(s_name, '|in|', coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN n_name END, ''))), 1, 12) AS id FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def triple_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of triples, some without a tail."""
    x = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey"))
    return x.select("s_suppkey", ids.triple_id(c("s_name"), F.lit("in"), F.when(c("s_suppkey") % 3 != 0, c("n_name"))).alias("id"))


@plan("f30_json", "SELECT event_id, CASE WHEN event_id % 5 <> 4 THEN CAST(json_extract_string(props, '$.k') AS INT) END AS k FROM events")
def json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first JSON value in replies: as it is, fenced, within words, before another, and none."""
    n, p = c("event_id") % 5, c("props")
    reply = F.when(n == 0, p).when(n == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(n == 2, F.concat(F.lit("see {this} there: "), p, F.lit(" ok"))).when(n == 3, F.concat(p, F.lit('{"k": 0}'))).otherwise(F.concat(F.lit("{"), F.substring(p, 2, 3)))
    return _t(spark, sf_dir, "events").select("event_id", F.get_json_object(ids.lenient_json(reply), "$.k").cast("int").alias("k"))


@plan("f31_ctime", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END AS at FROM orders")
def ctimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as C writes them, read back; others are null."""
    day = F.lpad(F.date_format("o_orderdate", "d"), 2, " ")
    text = F.concat(F.date_format("o_orderdate", "EEE MMM "), day, F.date_format("o_orderdate", " HH:mm:ss yyyy"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", ids.ctime(F.when(c("o_orderkey") % 9 == 0, c("o_orderpriority")).otherwise(text)).alias("at"))


@plan("f36_next_id", "SELECT 'bc' || lpad((max(doc_id) + 1)::VARCHAR, greatest(3, length((max(doc_id) + 1)::VARCHAR))::INT, '0') AS next_id FROM documents WHERE doc_id % 3 <> 0")
def next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next id of bad cases; ids of another form don't count."""
    name = F.concat(F.when(c("doc_id") % 3 != 0, "bc").otherwise("g"), c("doc_id").cast("string"))
    return _t(spark, sf_dir, "documents").select(name.alias("id")).agg(ids.next_id(c("id"), "bc").alias("next_id"))


# --- strategies ---------------------------------------------------------------------------------------------------
_KNOWN = (("thing", "leads to", "threads"), ("edhe", "is like", "edout"), ("ungen", "ends", "die"), ("Zzz", "is", "nowhere"))
_DOT = "list_dot_product({}::DOUBLE[], {}::DOUBLE[])"


@plan("r15_strategies", _BM + _lists(10) + f""",
g AS (SELECT qid, cid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, seen, cid) AS rank FROM f QUALIFY rank <= 10),
m AS (SELECT qid, cid, rank, e.embedding AS v, {_DOT.format("e.embedding", "a.embedding")} AS rel FROM g JOIN embeddings e ON e.vec_id = cid JOIN embeddings a ON a.vec_id = 20 * qid + 1),
m1 AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rel DESC, rank) = 1),
m2 AS (SELECT m.qid, m.cid FROM m JOIN m1 ON m.qid = m1.qid AND m.cid <> m1.cid QUALIFY row_number() OVER (PARTITION BY m.qid ORDER BY 0.5 * m.rel - 0.5 * {_DOT.format("m.v", "m1.v")} DESC, m.rank) = 1),
dv AS (SELECT qid, cid, 1 AS rank FROM m1 UNION ALL SELECT qid, cid, 2 FROM m2),
kn AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{h}', '{r}', '{t}')" for i, (h, r, t) in enumerate(_KNOWN))}) v(pos, h, r, t)),
w AS (SELECT qid, '【关系推理】' || string_agg(h || ' ' || r || ' ' || t, '；' ORDER BY pos) AS sentence FROM ({_Q}) z, kn WHERE contains(text, h) OR contains(text, t) GROUP BY qid)
SELECT 'vector' AS strategy, qid, rank, cid, NULL AS sentence FROM o WHERE rank <= 2 UNION ALL SELECT 'audited', qid, rank, cid, NULL FROM o WHERE rank <= 2
UNION ALL SELECT 'hybrid', qid, rank, cid, NULL FROM g WHERE rank <= 2 UNION ALL SELECT 'agentic', qid, rank, cid, NULL FROM g WHERE rank <= 3
UNION ALL SELECT 'hybrid_mmr', qid, rank, cid, NULL FROM dv UNION ALL SELECT 'graph', qid, rank, cid, NULL FROM dv
UNION ALL SELECT 'graph', qid, 1 + (SELECT count(*) FROM dv WHERE dv.qid = w.qid), NULL, sentence FROM w""")
def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What six strategies answer the questions from; those of the diverse ones are by the vector after that of the lists, which would tie them all."""
    e = _t(spark, sf_dir, "embeddings")
    asked = e.filter(c("vec_id") % 20 == 1).select(((c("vec_id") - 1) / 20).cast("long").alias("qid"), c("embedding").alias("qv"))
    known = spark.createDataFrame([(i, *x) for i, x in enumerate(_KNOWN)], "pos int, head string, relation string, tail string")
    return st.contexts(*_two(spark, sf_dir, 10), e.select(c("vec_id").alias("cid"), c("embedding").alias("v")), asked, st.evidence(_queries(spark), known))


@plan("r15_audited", """WITH i AS (SELECT l_orderkey AS qid, max(l_partkey) AS part, string_agg('part ' || l_partkey, ' ') AS text FROM lineitem GROUP BY 1),
a AS (SELECT qid, text, k AS attempt, CASE k WHEN 0 THEN CASE WHEN qid % 3 = 0 THEN 'it is 7' ELSE 'it is 99999999' END WHEN 1 THEN CASE WHEN qid % 3 = 1 THEN 'part ' || part ELSE 'part 88888888' END ELSE 'none of 77777777' END AS answer FROM i, range(4) r(k) WHERE qid % 4 <> 0 OR k < 2)
SELECT qid, CASE qid % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE CASE WHEN qid % 4 = 0 THEN 1 ELSE 2 END END AS attempt, (SELECT answer FROM a b WHERE b.qid = i.qid AND b.attempt = CASE i.qid % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE CASE WHEN i.qid % 4 = 0 THEN 1 ELSE 2 END END) AS answer,
qid % 3 <> 2 AS passed, CASE WHEN qid % 3 = 2 THEN CASE WHEN qid % 4 = 0 THEN '88888888' ELSE '77777777' END END AS strange FROM i""")
def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of up to three attempts to answer about an order the first whose numbers its items hold, or the last."""
    i = _t(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("qid")).agg(F.max("l_partkey").alias("part"), F.array_join(F.collect_list(F.concat(F.lit("part "), c("l_partkey").cast("string"))), " ").alias("text"))
    m = c("qid") % 3
    tries = F.array(F.when(m == 0, "it is 7").otherwise("it is 99999999"), F.when(m == 1, F.concat(F.lit("part "), c("part").cast("string"))).otherwise("part 88888888"), F.lit("none of 77777777"), F.lit("none of 77777777"))
    a = i.select("qid", F.posexplode(tries).alias("attempt", "answer")).filter("qid % 4 <> 0 or attempt < 2")
    return st.audited(a, i.select("qid", "text"))
