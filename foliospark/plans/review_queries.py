"""Queries over the review log, the correction memory and text context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import scalars
from foliospark.operators import memory, review, scan
from foliospark.plans.tables import LOG, keep, query, read, review_log


@query("q_corrections_join", LOG + "SELECT c.id, c.item, c.field, c.v corrected, '/in/doc-' || c.item || '.pdf' path FROM c JOIN it USING (item)")
def corrections_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = review_log(spark, sf_dir)
    c, items = review.corrections(log), review.items(log).select(F.col("id").alias("review_item_id"), "source_path")
    return c.join(items, "review_item_id").select("id", F.col("review_item_id").alias("item"), F.col("field_name").alias("field"), F.col("corrected_value").alias("corrected"), F.col("source_path").alias("path"))


HISTORY = LOG + ", h AS (SELECT c.*, lpad(CAST(c.item % 50 AS VARCHAR), 7, '0') || 'KBM000' seller, v0 FROM c JOIN it USING (item) WHERE c.item % 10 <> 0)"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = review_log(spark, sf_dir)
    return review.correction_history(review.corrections(log), review.items(log))


@query("q_seller_history", HISTORY + " SELECT seller, field, count(*) n, string_agg(v, ',' ORDER BY ts, id) vals FROM h GROUP BY 1, 2")
def seller_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = history(spark, sf_dir).groupBy("seller", F.col("field_name").alias("field")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("corrected_at", "id", "corrected_value"))).alias("list"))
    return grouped.select("seller", "field", "n", F.array_join(F.transform("list", lambda x: x["corrected_value"]), ",").alias("vals"))


@query("q_latest_correction", HISTORY + " SELECT seller, field, arg_max(v, (ts, id)) latest FROM h GROUP BY 1, 2")
def latest_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.latest(history(spark, sf_dir), ["seller", "field_name"], "corrected_value", ["corrected_at", "id"]).select("seller", F.col("field_name").alias("field"), F.col("corrected_value").alias("latest"))


@query("q_exact_reuse", HISTORY + """, k AS (SELECT seller, arg_max(v, (ts, id)) FILTER (field = 'seller.name') nm, arg_max(v, (ts, id)) FILTER (field = 'seller.rc_number') rc FROM h GROUP BY 1),
d AS (SELECT c_custkey id, lpad(CAST(c_custkey % 50 AS VARCHAR), 7, '0') || 'KBM000' seller, CASE WHEN c_custkey % 2 = 0 THEN 'own' END own, 'No ' || c_custkey || ' / ' || c_nationkey t FROM customer)
SELECT id, CASE WHEN own IS NULL AND nm IS NOT NULL AND contains(t, nm) THEN nm ELSE own END name, CASE WHEN rc IS NOT NULL AND contains(t, rc) THEN rc END rc,
CASE WHEN own IS NULL AND nm IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN rc IS NOT NULL THEN 1 ELSE 0 END notes FROM d LEFT JOIN k USING (seller)""")
def exact_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    fields = F.struct(F.when(key % 2 == 0, F.lit("own")).alias("seller_name"), F.lit(None).cast("string").alias("seller_rc_number"))
    text = F.concat(F.lit("No "), key.cast("string"), F.lit(" / "), F.col("c_nationkey").cast("string"))
    docs = read(spark, sf_dir, "customer").select(key.alias("id"), F.concat(F.lpad((key % 50).cast("string"), 7, "0"), F.lit("KBM000")).alias("seller"), fields.alias("fields"), text.alias("source_text"))
    return memory.reuse(docs, history(spark, sf_dir)).select("id", F.col("fields.seller_name").alias("name"), F.col("fields.seller_rc_number").alias("rc"), F.size("notes").alias("notes"))


@query("q_overlay", LOG + """, s AS (SELECT item, unnest(['seller_name', 'total_ttc', 'currency']) "key", v0 FROM it), o AS (SELECT item, CASE field WHEN 'buyer.tax_id' THEN 'buyer_tax_id' WHEN 'seller.name' THEN 'seller_name' WHEN 'seller.rc_number' THEN 'seller_rc_number' ELSE field END "key", arg_max(v, (ts, id)) v FROM c GROUP BY 1, 2)
SELECT item, "key", coalesce(v, v0) AS "value" FROM s FULL JOIN o USING (item, "key")""")
def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = review_log(spark, sf_dir)
    value = F.regexp_extract("source_text", r"Total (\d+)", 1)
    fields = review.items(log).select("id", F.explode(F.array(*(F.lit(k) for k in ("seller_name", "total_ttc", "currency")))).alias("key"), value.alias("value"))
    return review.overlay(fields, review.corrections(log)).select(F.col("id").alias("item"), "key", "value")


@query("q_status_machine", LOG + "SELECT item, status FROM it")
def status_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.items(review_log(spark, sf_dir)).select(F.col("id").alias("item"), "status")


@query("q_delete_cascade", LOG + "SELECT (SELECT count(*) FROM it) items, (SELECT count(*) FROM c) corrections, (SELECT count(DISTINCT item) FROM ev WHERE kind = 'deleted') deleted")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = review_log(spark, sf_dir)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    one = count(review.items(log), "items").crossJoin(count(review.corrections(log), "corrections"))  # one row each
    return one.crossJoin(log.where("kind = 'deleted'").agg(F.count_distinct("item_id").alias("deleted")))


@query("q_queue_listing", LOG + "SELECT item id, '/in/doc-' || item || '.pdf' source_path, status FROM it WHERE status = 'corrected' ORDER BY created DESC, item DESC LIMIT 50")
def queue_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.listing(review.items(review_log(spark, sf_dir)), "corrected").drop("created_at").limit(50)  # a page of the queue


@query("q_gate_json", LOG + """SELECT item, CASE item % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END problems, CASE WHEN item % 10 <> 0 THEN lpad(CAST(item % 50 AS VARCHAR), 7, '0') || 'KBM000' END seller FROM it""")
def gate_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = review.gate_problems(F.col("gate_json"))
    return review.items(review_log(spark, sf_dir)).select(F.col("id").alias("item"), F.when(found.isNotNull(), F.size(found)).alias("problems"), F.get_json_object("invoice_json", "$.seller.tax_id").alias("seller"))


@query("q_mode_label", "WITH g AS (SELECT user_id seller, event_type label, count(*) n, min(event_id) f FROM events GROUP BY 1, 2) SELECT seller, arg_max(label, (n, -f)) label, max(n) n FROM g GROUP BY 1")
def mode_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = read(spark, sf_dir, "events").select(F.col("user_id").alias("seller"), F.col("event_type").alias("label"), F.col("event_id").alias("at"))
    return memory.common_label(seen, ["seller"])


@query("q_hint_sentence", """WITH g AS (SELECT user_id % 50 s, event_type label, count(*) n, min(event_id) f FROM events GROUP BY 1, 2), b AS (SELECT s, arg_max(label, (n, -f)) label, max(n) n FROM g GROUP BY 1)
SELECT CAST(s AS VARCHAR) seller, n, 'Corrections of this seller: ' || n || '. The value stood ' || CASE WHEN n >= 2 THEN 'each time' ELSE 'once' END || ' beside ''' || label || '''. Take a value from there only if this document shows it.' hint FROM b""")
def hint_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("event_id").cast("string")
    past = read(spark, sf_dir, "events").select((F.col("user_id") % 50).cast("string").alias("seller"), F.lit("buyer.tax_id").alias("field_name"), F.col("event_id").alias("id"), F.col("event_id").alias("corrected_at"), value.alias("corrected_value"), F.concat(F.lit("7\n"), value, F.lit(" "), "event_type", F.lit("\n9")).alias("source_text"))
    return memory.hints(past).select("seller", "n", "hint")


@query("q_line_context", """SELECT o_orderkey k, CASE o_orderkey % 3 WHEN 0 THEN 'Code' WHEN 1 THEN 'Ligne avant' ELSE 'Total' END AS before, CASE o_orderkey % 3 WHEN 0 THEN 'TND' WHEN 1 THEN 'Ligne suivante' ELSE 'apres' END AS after FROM orders""")
def line_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    value = F.concat(F.lit("#"), k.cast("string"), F.lit("#"))
    text = F.when(k % 3 == 0, F.concat(F.lit("x\n Code : "), value, F.lit(" | TND \ny"))).when(k % 3 == 1, F.concat(F.lit("a\nLigne avant \n"), value, F.lit("\n Ligne suivante\nb"))).otherwise(F.concat(F.lit("Total :\t"), value, F.lit("\napres\n"), value))
    seen = scalars.line_context(text, value)
    return read(spark, sf_dir, "orders").select(k.alias("k"), seen["before"].alias("before"), seen["after"].alias("after"))


@query("q_label_suffix", """WITH w AS (SELECT p_partkey, string_split(p_partkey || ' ' || p_type || CASE WHEN p_partkey % 5 = 0 THEN ' 9' ELSE '' END, ' ') w FROM part), t AS (SELECT p_partkey, n, array_to_string(w[len(w) - n + 1:], ' ') s FROM w, range(1, 5) r(n) WHERE n <= len(w))
SELECT p_partkey k, arg_max(s, n) label FROM t WHERE regexp_full_match(s, '[A-Za-zÀ-ÿ .:''/-]{2,40}') GROUP BY 1""")
def label_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    snippet = F.concat_ws(" ", key.cast("string"), "p_type", F.when(key % 5 == 0, F.lit("9")))
    return read(spark, sf_dir, "part").select(key.alias("k"), scalars.label_suffix(snippet).alias("label")).where("label is not null")


@query("q_filename_stem", "SELECT page_id, regexp_replace(regexp_extract(url || '/scan.v2.pdf', '[^/]+$'), '[.][^.]*$', '') stem, regexp_replace(regexp_extract(url, '[^/]+$'), '[.][^.]*$', '') own FROM pages")
def filename_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", scalars.stem(F.concat("url", F.lit("/scan.v2.pdf"))).alias("stem"), scalars.stem(F.col("url")).alias("own"))


@query("q_text_splice", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, role, text) AS whole FROM conversations WHERE text <> '' GROUP BY 1")
def text_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.operators.geometry import join_parts

    parts = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role", F.col("text").alias("part"))
    return join_parts(parts, ["turn", "role"]).select(F.col("doc_id").alias("conv_id"), F.col("text").alias("whole"))


@query("q_asof_join", HISTORY + """, d AS (SELECT ev.id, ts, lpad(CAST(item % 50 AS VARCHAR), 7, '0') || 'KBM000' seller FROM ev), n AS (SELECT seller, ts, id correction, v FROM h WHERE field = 'seller.name')
SELECT d.id, n.correction, n.v known FROM d ASOF LEFT JOIN n ON d.seller = n.seller AND d.ts >= n.ts""")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a document of its seller, with the last correction of the seller's name until then."""
    seller = F.concat(F.lpad((F.col("item_id") % 50).cast("string"), 7, "0"), F.lit("KBM000"))
    docs = review_log(spark, sf_dir).select(F.col("event_id").alias("id"), seller.alias("seller"), "ts")
    past = history(spark, sf_dir).where("field_name = 'seller.name'").select("seller", F.col("corrected_at").alias("ts"), F.col("id").alias("correction"), F.col("corrected_value").alias("known"))
    return scan.asof(docs, past, ["seller"], "ts", ["correction", "known"], lambda df: keep(spark, df), ["correction"]).select("id", "correction", "known")


@query("q_memory_as_of", HISTORY + """, d AS (SELECT item id, lpad(CAST(item % 50 AS VARCHAR), 7, '0') || 'KBM000' seller, created ts, 'No ' || item || ' / ' || v0 t FROM it),
a AS (SELECT d.*, n.v nm FROM d ASOF LEFT JOIN (SELECT * FROM h WHERE field = 'seller.name') n ON d.seller = n.seller AND d.ts >= n.ts),
b AS (SELECT a.*, n.v rc FROM a ASOF LEFT JOIN (SELECT * FROM h WHERE field = 'seller.rc_number') n ON a.seller = n.seller AND a.ts >= n.ts)
SELECT id, CASE WHEN contains(t, nm) THEN nm END AS name, CASE WHEN contains(t, rc) THEN rc END rc, CASE WHEN nm IS NULL THEN 0 ELSE 1 END + CASE WHEN rc IS NULL THEN 0 ELSE 1 END notes FROM b""")
def memory_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a document's seller was known by when the document came; later corrections are not seen."""
    kept = lambda df: keep(spark, df)
    seller = F.concat(F.lpad((F.col("id") % 50).cast("string"), 7, "0"), F.lit("KBM000"))
    none = F.lit(None).cast("string")
    text = F.concat(F.lit("No "), F.col("id").cast("string"), F.lit(" / "), F.regexp_extract("source_text", r"Total (\d+)", 1))
    docs = review.items(review_log(spark, sf_dir)).select(F.col("id").alias("doc_id"), seller.alias("seller"), F.col("created_at").alias("received_at"), F.struct(none.alias("seller_name"), none.alias("seller_rc_number")).alias("fields"), text.alias("source_text"))
    return memory.reuse(docs, history(spark, sf_dir), keep=kept).select(F.col("doc_id").alias("id"), F.col("fields.seller_name").alias("name"), F.col("fields.seller_rc_number").alias("rc"), F.size("notes").alias("notes"))


@query("q_hints_as_of", """WITH e AS (SELECT event_id id, user_id % 5 s, event_type label, ts FROM events),
c AS (SELECT s, id, ts, label, count(*) OVER (PARTITION BY s, label ORDER BY ts, id) n, min(ts) OVER (PARTITION BY s, label) f FROM e),
m AS (SELECT s, id, ts, max({'n': n, 'f': -epoch_us(f), 'label': label}) OVER (PARTITION BY s ORDER BY ts, id ROWS UNBOUNDED PRECEDING) best FROM c)
SELECT id, CAST(best.n AS BIGINT) n, 'Corrections of this seller: ' || best.n || '. The value stood ' || CASE WHEN best.n >= 2 THEN 'each time' ELSE 'once' END || ' beside ''' || best.label || '''. Take a value from there only if this document shows it.' hint FROM m""")
def hints_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hint that every event would have been given, had it been a document; five sellers have all the corrections."""
    value = F.col("event_id").cast("string")
    e = read(spark, sf_dir, "events").withColumn("seller", (F.col("user_id") % 5).cast("string")).withColumn("ts", F.col("ts").cast("timestamp"))
    past = e.select("seller", F.lit("buyer.tax_id").alias("field_name"), F.col("event_id").alias("id"), F.col("ts").alias("corrected_at"), value.alias("corrected_value"), F.concat(F.lit("7\n"), value, F.lit(" "), "event_type", F.lit("\n9")).alias("source_text"))
    docs = e.select(F.col("event_id").alias("doc_id"), "seller", F.col("ts").alias("received_at"))
    return memory.hints_as_of(docs, past, lambda df: keep(spark, df)).select(F.col("doc_id").alias("id"), "n", "hint")
