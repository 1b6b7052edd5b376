"""The driver tables as documents: orders are invoices, line items their lines, events the correction log."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.codes import LINE_FIELDS
from foliospark.session import work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query and, if SQL can express it, its DuckDB text."""
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder; the shuffle files go as soon as it is written."""
    path = f"{work_dir(spark)}/kept-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


class Keeper:
    """``keep`` for a chain of steps, which drops the tables that no later step reads."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __call__(self, df: DataFrame) -> DataFrame:
        return keep(self.spark, df)

    def drop(self, df: DataFrame) -> None:
        context = self.spark.sparkContext
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def money(c: Column) -> Column:
    return c.cast("decimal(18,3)")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``k, n, p, s, quantity, price, rate, total``: line items with exact amounts."""
    price, discount = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(4,2)")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
        money(F.col("l_quantity")).alias("quantity"), money(price).alias("price"), F.col("l_tax").cast("decimal(4,2)").alias("rate"), money(price * (1 - discount)).alias("total"),
    )


def line_structs() -> Column:
    """A line as the flat record holds it: all strings, a zero or missing rate left as it is."""
    values = {
        "code": F.col("p").cast("string"), "description": F.when(F.col("p") % 29 == 0, F.lit(None)).otherwise(F.concat(F.lit("Part "), F.col("p").cast("string"))),
        "unit_price_ht": F.col("price").cast("string"), "quantity": F.col("quantity").cast("string"),
        "vat_rate_percent": F.when(F.col("n") == 3, F.lit(None)).otherwise((F.col("rate") * 100).cast("int").cast("string")),
        "line_total_ht": F.when(F.col("p") % 31 == 0, F.lit(None)).otherwise(F.col("total").cast("string")),
    }
    return F.struct(*(values[k].alias(k) for k in LINE_FIELDS))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order: header values and totals, some of them wrong or missing by the order's key; ``line_items`` in line order.

    The aggregation is keyed like the join, so lines are shuffled once.
    """
    own = lines(spark, sf_dir)
    grouped = own.groupBy("k").agg(
        F.sum("total").cast("decimal(18,3)").alias("ht"), F.sum(money(F.col("total") * F.col("rate"))).cast("decimal(18,3)").alias("tva"),
        F.min_by("s", F.struct("n", "p", "s")).alias("seller"), F.array_sort(F.collect_list(F.struct("n", "p", "s", line_structs().alias("line")))).alias("sorted"),
    )
    k = F.col("o_orderkey")
    joined = read(spark, sf_dir, "orders").join(grouped, F.col("o_orderkey") == F.col("k"), "left")
    stamp = F.when(k % 5 != 0, F.lit("1.000").cast("decimal(18,3)"))
    zero = F.lit(0).cast("decimal(18,3)")
    ttc = money(F.col("ht") + F.col("tva") + F.coalesce(stamp, zero) + F.when(k % 7 == 0, F.lit("0.500").cast("decimal(18,3)")).otherwise(zero))
    buyer = F.concat(F.lpad(F.col("o_custkey").cast("string"), 7, "0"), F.lit("CAP000"))
    seller = F.concat(F.lpad(F.col("seller").cast("string"), 7, "0"), F.lit("KBM000"))
    return joined.select(
        k.alias("k"), F.when(k % 11 != 0, F.concat(F.lit("INV-"), k.cast("string"))).alias("invoice_number"), F.to_date("o_orderdate").alias("issue_date"),
        F.when(k % 17 == 0, F.concat(F.lit("C"), F.col("seller").cast("string"))).when(k % 19 == 0, buyer).otherwise(seller).alias("seller_tax_id"),
        F.when(k % 13 != 0, buyer).alias("buyer_tax_id"), F.col("seller"), F.col("o_custkey").alias("buyer"), "ht", "tva", stamp.alias("stamp"), ttc.alias("ttc"),
        F.coalesce(F.transform("sorted", lambda x: x["line"]), F.array().cast("array<struct<code:string,description:string,unit_price_ht:string,quantity:string,vat_rate_percent:string,line_total_ht:string>>")).alias("line_items"),
    )


#: The same in SQL: ``l`` (lines) and ``inv`` (invoices).
INV = """
WITH l AS (SELECT l_orderkey k, l_linenumber n, l_partkey p, l_suppkey s, CAST(l_quantity AS DECIMAL(18,3)) quantity, CAST(l_extendedprice AS DECIMAL(18,2)) price, CAST(l_tax AS DECIMAL(4,2)) rate,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,3)) total FROM lineitem),
g AS (SELECT k, CAST(sum(total) AS DECIMAL(18,3)) ht, CAST(sum(CAST(total * rate AS DECIMAL(18,3))) AS DECIMAL(18,3)) tva, arg_min(s, (n, p, s)) seller, count(*) lines,
  count(CASE WHEN p % 31 <> 0 THEN 1 END) known, sum(CASE WHEN p % 31 <> 0 THEN total END) known_sum FROM l GROUP BY k),
inv AS (SELECT o_orderkey k, CASE WHEN o_orderkey % 11 <> 0 THEN 'INV-' || o_orderkey END invoice_number, CAST(o_orderdate AS DATE) issue_date,
  CASE WHEN o_orderkey % 17 = 0 THEN 'C' || seller WHEN o_orderkey % 19 = 0 THEN lpad(CAST(o_custkey AS VARCHAR), 7, '0') || 'CAP000' ELSE lpad(CAST(seller AS VARCHAR), 7, '0') || 'KBM000' END seller_tax_id,
  CASE WHEN o_orderkey % 13 <> 0 THEN lpad(CAST(o_custkey AS VARCHAR), 7, '0') || 'CAP000' END buyer_tax_id, seller, o_custkey buyer, ht, tva,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(1 AS DECIMAL(18,3)) END stamp, coalesce(lines, 0) lines, coalesce(known, 0) known, known_sum,
  CAST(ht + tva + CASE WHEN o_orderkey % 5 <> 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 7 = 0 THEN 0.5 ELSE 0 END AS DECIMAL(18,3)) ttc
  FROM orders LEFT JOIN g ON g.k = o_orderkey)
"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invoices as flat extraction records with their source text, which lacks the total where the key is a multiple of 23."""
    inv = invoices(spark, sf_dir)
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    fields = {
        "invoice_number": F.col("invoice_number"), "issue_date": F.date_format("issue_date", "dd/MM/yyyy"), "seller_name": F.concat(F.lit("Supplier "), text("seller")), "seller_tax_id": F.col("seller_tax_id"),
        "seller_address": none, "seller_rc_number": none, "seller_capital": none, "buyer_name": F.concat(F.lit("Customer "), text("buyer")), "buyer_tax_id": F.col("buyer_tax_id"), "buyer_address": none,
        "currency": F.lit("TND"), "total_ht": text("ht"), "tva_amount": text("tva"), "stamp_duty": text("stamp"), "total_ttc": text("ttc"), "delivery_note_number": none, "other_references": F.array().cast("array<string>"),
    }
    shown = ("invoice_number", "issue_date", "seller_name", "seller_tax_id", "buyer_name", "buyer_tax_id", "total_ht", "tva_amount", "stamp_duty")
    total = F.when(F.col("k") % 23 != 0, F.concat(F.lit("total_ttc: "), text("ttc")))
    source = F.concat_ws("\n", *(F.concat(F.lit(f"{c}: "), fields[c]) for c in shown), total)
    reported = F.when(F.col("k") % 37 == 0, F.array(F.lit("total is blurred"))).otherwise(F.array().cast("array<string>"))
    return inv.select(F.col("k").alias("doc_id"), F.struct(*(v.alias(c) for c, v in fields.items())).alias("fields"), "line_items", source.alias("source_text"), reported.alias("reported"))


def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a review log: one item a user, its first event submits it, the kinds of the rest follow from the event id."""
    e = read(spark, sf_dir, "events")
    first = e.groupBy("user_id").agg(F.min("event_id").alias("first_id"))
    kind = F.when(F.col("event_id") == F.col("first_id"), F.lit("submitted")).when(F.col("event_id") % 97 == 0, F.lit("deleted")).when(F.col("event_id") % 3 == 0, F.lit("approved")).otherwise(F.lit("corrected"))
    names = F.element_at(F.array(*(F.lit(x) for x in ("buyer.tax_id", "seller.name", "total_ttc", "seller.rc_number"))), (F.col("event_id") % 4 + 1).cast("int"))
    # the seller in the invoice JSON; every tenth item's JSON is broken
    seller = F.lpad((F.col("user_id") % 50).cast("string"), 7, "0")
    invoice = F.when(F.col("user_id") % 10 == 0, F.lit("{broken")).otherwise(F.concat(F.lit('{"seller":{"tax_id":"'), seller, F.lit('KBM000"}}')))
    gate = F.when(F.col("user_id") % 3 == 0, F.lit("[]")).when(F.col("user_id") % 3 == 1, F.lit('{"problems":[{"severity":"error","field":"totals","message":"m"}],"fields":{}}')).otherwise(F.lit("nonsense"))
    is_first, value = F.col("kind") == "submitted", F.floor(F.col("value")).cast("long").cast("string")
    joined = e.join(first, "user_id").withColumn("kind", kind)
    return joined.select(
        "event_id", F.col("user_id").alias("item_id"), "kind", "ts", F.when(is_first, F.concat(F.lit("/in/doc-"), F.col("user_id").cast("string"), F.lit(".pdf"))).alias("source_path"),
        F.when(is_first, F.concat(F.lit("Code TVA : 7\nTotal "), value, F.lit("\n42\nNet a payer"))).alias("source_text"), F.when(is_first, invoice).alias("invoice_json"), F.when(is_first, gate).alias("gate_json"),
        F.when(F.col("kind") == "corrected", names).alias("field_name"), F.lit(None).cast("string").alias("original_value"), F.when(F.col("kind") == "corrected", value).alias("corrected_value"),
    )


#: The same in SQL: ``ev`` (all events), ``live`` (of items not deleted), ``c`` (corrections), ``it`` (items).
LOG = """
WITH f AS (SELECT user_id, min(event_id) first_id FROM events GROUP BY 1),
ev AS (SELECT e.event_id id, e.user_id item, ts, CAST(CAST(floor(e.value) AS BIGINT) AS VARCHAR) v, CASE WHEN e.event_id = first_id THEN 'submitted' WHEN e.event_id % 97 = 0 THEN 'deleted' WHEN e.event_id % 3 = 0 THEN 'approved' ELSE 'corrected' END kind,
  CASE e.event_id % 4 WHEN 0 THEN 'buyer.tax_id' WHEN 1 THEN 'seller.name' WHEN 2 THEN 'total_ttc' ELSE 'seller.rc_number' END field FROM events e JOIN f USING (user_id)),
live AS (SELECT * FROM ev WHERE item NOT IN (SELECT item FROM ev WHERE kind = 'deleted')),
c AS (SELECT id, item, field, v, ts FROM live WHERE kind = 'corrected'),
it AS (SELECT item, max(CASE WHEN kind = 'submitted' THEN v END) v0, min(CASE WHEN kind = 'submitted' THEN ts END) created, arg_max(CASE kind WHEN 'submitted' THEN 'pending' ELSE kind END, (ts, id)) status FROM live GROUP BY 1)
"""
