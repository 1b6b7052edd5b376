"""Queries over the field rules, scalar functions and record assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import scalars
from foliospark.operators import assemble, occur, rules
from foliospark.plans.tables import INV, invoices, keep, lines, money, query, read, records

# What the rules find, in SQL: p(doc_id, rule, severity, field)
PROBLEMS = INV + """,
m AS (SELECT *, CASE WHEN k % 23 <> 0 THEN ttc END shown FROM inv),
p AS (
  SELECT k doc_id, 'V1' rule, 'error' severity, unnest(list_filter([CASE WHEN invoice_number IS NULL THEN 'invoice_number' END, CASE WHEN issue_date IS NULL THEN 'issue_date' END,
    CASE WHEN seller_tax_id IS NULL THEN 'seller_tax_id' END, CASE WHEN buyer_tax_id IS NULL THEN 'buyer_tax_id' END, CASE WHEN ttc IS NULL THEN 'total_ttc' END], lambda x: x IS NOT NULL)) field FROM m
  UNION ALL SELECT k, 'V2', 'error', 'seller_tax_id' FROM m WHERE NOT regexp_matches(seller_tax_id, '^[0-9]{6,7}[A-Z]{2,3}[0-9]{3}$')
  UNION ALL SELECT k, 'V3', 'error', 'buyer_tax_id' FROM m WHERE seller_tax_id = buyer_tax_id
  UNION ALL SELECT k, 'V4', 'warning', 'totals' FROM m WHERE ht IS NULL
  UNION ALL SELECT k, 'V5', 'error', 'totals' FROM m WHERE abs(ht + tva + coalesce(stamp, 0) - ttc) > 0.01
  UNION ALL SELECT k, 'V6', 'warning', 'line_items' FROM m WHERE known > 0 AND known < lines
  UNION ALL SELECT k, 'V7', 'warning', 'line_items' FROM m WHERE known > 0 AND known = lines AND abs(known_sum - ht) > 0.05
  UNION ALL SELECT k, 'V8', 'warning', '_verification' FROM m WHERE k % 37 = 0
  UNION ALL SELECT k, 'V9', 'warning', 'total_ttc' FROM m WHERE k % 23 = 0 AND ttc IS NOT NULL
    AND NOT contains(replace(concat_ws(chr(10), 'invoice_number: ' || invoice_number, 'issue_date: ' || strftime(issue_date, '%d/%m/%Y'), 'seller_name: Supplier ' || seller, 'seller_tax_id: ' || seller_tax_id,
      'buyer_name: Customer ' || buyer, 'buyer_tax_id: ' || buyer_tax_id, 'total_ht: ' || ht, 'tva_amount: ' || tva, 'stamp_duty: ' || stamp), ' ', ''), CAST(ttc AS VARCHAR)))
"""


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verify(records(spark, sf_dir))


def _field(key: str) -> Column:
    return F.col("fields")[key]


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their totals (``numbers``) and line sums (``summary``) parsed once."""
    return records(spark, sf_dir).select("doc_id", "fields", "line_items", rules.parsed_totals(_field).alias("numbers"), rules.line_summary(F.col("line_items")).alias("summary"))


@query("q_problems", PROBLEMS + "SELECT doc_id, rule, severity, field FROM p")
def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(spark, sf_dir).select("doc_id", F.inline("problems")).select("doc_id", "rule", "severity", "field")


@query("q_line_sum", INV + "SELECT k doc_id, CASE WHEN known = lines THEN 'V7' ELSE 'V6' END rule FROM inv WHERE known > 0 AND (known < lines OR abs(known_sum - ht) > 0.05)")
def line_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _parsed(spark, sf_dir)
    found = rules.line_sum(_field, F.col("line_items"), number=lambda k: F.col("numbers")[k], summary=F.col("summary"))
    return parsed.select("doc_id", F.explode(found).alias("p")).select("doc_id", "p.rule")


@query("q_totals", INV + """SELECT k doc_id, CASE WHEN ht IS NULL THEN 'V4' ELSE 'V5' END rule, CAST(abs(ht + tva + coalesce(stamp, 0) - ttc) AS DECIMAL(18,3)) off
FROM inv WHERE ht IS NULL OR abs(ht + tva + coalesce(stamp, 0) - ttc) > 0.01""")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda k: F.col("numbers")[k]
    off = F.abs(number("total_ht") + number("tva_amount") + F.coalesce(number("stamp_duty"), F.lit(0)) - number("total_ttc"))
    return _parsed(spark, sf_dir).select("doc_id", money(off).alias("off"), F.explode(rules.totals(_field, number=number)).alias("p")).select("doc_id", "p.rule", "off")


@query("q_required", INV + """SELECT k doc_id, unnest(list_filter([CASE WHEN invoice_number IS NULL THEN 'invoice_number' END, CASE WHEN buyer_tax_id IS NULL THEN 'buyer_tax_id' END,
CASE WHEN seller_tax_id IS NULL THEN 'seller_tax_id' END, CASE WHEN ttc IS NULL THEN 'total_ttc' END], lambda x: x IS NOT NULL)) field FROM inv""")
def required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc_id", F.explode(rules.required(lambda k: F.col("fields")[k])).alias("p")).select("doc_id", "p.field")


@query("q_tax_id_shape", """WITH x AS (SELECT c_custkey id, CASE c_custkey % 4 WHEN 0 THEN lpad(CAST(c_custkey AS VARCHAR), 7, '0') || 'KBM000' WHEN 1 THEN lpad(CAST(c_custkey AS VARCHAR), 7, '0') || '/k.b-m 000'
  WHEN 2 THEN CAST(c_custkey AS VARCHAR) ELSE '' END raw FROM customer), y AS (SELECT id, upper(regexp_replace(raw, '[\\s/\\-.]', '', 'g')) compacted FROM x)
SELECT id, compacted, CASE WHEN compacted <> '' AND NOT regexp_matches(compacted, '^[0-9]{6,7}[A-Z]{2,3}[0-9]{3}$') THEN true ELSE false END bad FROM y""")
def tax_id_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    number = F.lpad(key.cast("string"), 7, "0")
    raw = F.when(key % 4 == 0, F.concat(number, F.lit("KBM000"))).when(key % 4 == 1, F.concat(number, F.lit("/k.b-m 000"))).when(key % 4 == 2, key.cast("string")).otherwise(F.lit(""))
    found = rules.tax_ids(lambda k: raw if k == "seller_tax_id" else F.lit(None).cast("string"))
    return read(spark, sf_dir, "customer").select(key.alias("id"), scalars.compact(raw).alias("compacted"), (F.size(found) > 0).alias("bad"))


@query("q_occurrence", """WITH d AS (SELECT doc_id, replace(lower(regexp_replace(text, '\\s', '', 'g')), 'ß', 'ss') t FROM documents), b AS (SELECT item_id, replace(lower(regexp_replace(text, '\\s', '', 'g')), 'ß', 'ss') v FROM benchmark)
SELECT item_id, doc_id FROM b JOIN d ON contains(t, v)""")
def occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark items that stand in whole texts, by their rarest grams."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), scalars.fold(F.col("text")).alias("text"))
    values = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), scalars.fold(F.col("text")).alias("value"))
    return occur.occurrences(values, docs, lambda df: keep(spark, df)).select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id"))


@query("q_parse_decimal", """SELECT o_orderkey k, s style, CASE WHEN s = 4 THEN -CAST(o_totalprice AS DECIMAL(18,3)) WHEN s = 5 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,3)) END parsed FROM orders, range(6) r(s)""")
def parse_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    text, grouped = amount.cast("string"), F.format_number(amount, 2)
    styles = [text, grouped, F.translate(grouped, ",.", " ,"), F.concat(F.translate(grouped, ",.", ".,"), F.lit(" TND")), F.concat(F.lit("-"), text), F.concat(F.lit("TD\n"), text)]
    raw = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("style"), s.alias("raw")) for i, s in enumerate(styles)))).alias("x")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), raw).select("k", "x.style", money(scalars.parse_decimal(F.col("x.raw"))).alias("parsed"))


@query("q_parse_date", """SELECT o_orderkey k, s style, CASE WHEN s = 5 THEN NULL ELSE CAST(o_orderdate AS DATE) END parsed FROM orders, range(6) r(s)
WHERE s <> 0 OR year(o_orderdate) >= 2000 UNION ALL SELECT o_orderkey, 0, CAST(o_orderdate AS DATE) + INTERVAL 100 YEAR FROM orders WHERE year(o_orderdate) < 2000""")
def parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    months = F.array(*(F.lit(m) for m in ("janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "août", "Septembre", "octobre", "novembre", "décembre")))
    spelled = F.concat_ws(" ", F.dayofmonth(day).cast("string"), F.element_at(months, F.month(day)), F.year(day).cast("string"))
    styles = [F.date_format(day, "ddMMyy"), F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "d/M/yyyy"), F.date_format(day, "dd.MM.yyyy"), spelled, F.concat(F.lit("31/02/"), F.year(day).cast("string"))]
    raw = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("style"), s.alias("raw")) for i, s in enumerate(styles)))).alias("x")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), raw).select("k", "x.style", scalars.parse_date(F.col("x.raw")).alias("parsed"))


@query("q_format_amount", """WITH x AS (SELECT o_orderkey k, CAST(o_totalprice AS DECIMAL(18,2)) a, CAST(o_orderdate AS DATE) d FROM orders)
SELECT k, CAST(CAST(a AS DECIMAL(18,3)) AS VARCHAR) amount, regexp_replace(regexp_replace(CAST(CAST(a AS DECIMAL(18,3)) AS VARCHAR), '0+$', ''), '[.]$', '') AS quantity, strftime(d, '%d%m%y') AS "day" FROM x""")
def format_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), scalars.format_amount(amount).alias("amount"), scalars.format_quantity(amount).alias("quantity"), scalars.format_ddmmyy(F.to_date("o_orderdate")).alias("day"))


@query("q_compact_fold", """SELECT p_partkey k, upper(regexp_replace(p_name || '/' || p_brand || '-x.y', '[\\s/\\-.]', '', 'g')) compacted, lower(regexp_replace(p_name || ' ' || p_type, '\\s', '', 'g')) folded FROM part""")
def compact_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("p_name"), F.lit("/"), F.col("p_brand"), F.lit("-x.y"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), scalars.compact(name).alias("compacted"), scalars.fold(F.concat_ws(" ", "p_name", "p_type")).alias("folded"))


@query("q_problems_union", PROBLEMS + "SELECT severity, field, count(*) n, count(DISTINCT doc_id) documents FROM p GROUP BY 1, 2")
def problems_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return problems(spark, sf_dir).groupBy("severity", "field").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


_ABSENT = "list_filter([CASE WHEN ht IS NULL THEN 'total_ht' END, CASE WHEN tva IS NULL THEN 'tva_amount' END, CASE WHEN stamp IS NULL THEN 'stamp_duty' END, CASE WHEN ttc IS NULL THEN 'total_ttc' END], lambda x: x IS NOT NULL)"


@query("q_deficient", PROBLEMS + f""", w AS (SELECT k doc_id, unnest(list_filter([CASE WHEN invoice_number IS NULL THEN 'invoice_number' END, CASE WHEN seller IS NULL THEN 'seller_name' END, CASE WHEN seller_tax_id IS NULL THEN 'seller_tax_id' END,
  CASE WHEN buyer_tax_id IS NULL THEN 'buyer_tax_id' END] || {_ABSENT}, lambda x: x IS NOT NULL)) field FROM inv
  UNION SELECT doc_id, field FROM p WHERE field NOT IN ('_verification', 'totals')
  UNION SELECT doc_id, unnest(CASE WHEN len({_ABSENT}) > 0 THEN {_ABSENT} ELSE ['total_ht', 'tva_amount', 'stamp_duty', 'total_ttc'] END) FROM p JOIN inv ON k = doc_id WHERE field = 'totals')
SELECT doc_id, string_agg(field, ',' ORDER BY field) fields FROM w GROUP BY 1""")
def deficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = rules.deficient(lambda k: F.col("fields")[k], F.col("problems"))
    return verified(spark, sf_dir).withColumn("wanted", wanted).where(F.size("wanted") > 0).select("doc_id", F.array_join(F.array_sort("wanted"), ",").alias("fields"))


@query("q_blocking_except", PROBLEMS + """, b AS (SELECT doc_id, unnest(CASE WHEN field = 'totals' THEN ['total_ht', 'tva_amount', 'stamp_duty', 'total_ttc'] ELSE [field] END) field FROM p WHERE severity = 'error')
SELECT doc_id, field, 'blocking' kind FROM (SELECT DISTINCT * FROM b)
UNION ALL SELECT doc_id, field, 'warning' FROM (SELECT doc_id, field FROM p WHERE severity = 'warning' AND field NOT IN ('_verification', 'totals') EXCEPT SELECT * FROM b)""")
def blocking_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = rules.blocking(lambda k: F.col("fields")[k], F.col("problems"))
    warned = F.array_distinct(F.transform(F.filter("problems", lambda p: (p["severity"] == "warning") & ~p["field"].isin("_verification", "totals")), lambda p: p["field"]))
    both = verified(spark, sf_dir).select("doc_id", block.alias("block"), warned.alias("warned"))
    rows = lambda c, kind: both.select("doc_id", F.explode(c).alias("field"), F.lit(kind).alias("kind"))
    return rows(F.col("block"), "blocking").unionByName(rows(F.array_except("warned", "block"), "warning"))


@query("q_vat_fill", INV + """, x AS (SELECT *, CASE WHEN n = 3 THEN NULL ELSE CAST(rate * 100 AS INTEGER) END r FROM l), y AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, p, s) pos, first_value(r IGNORE NULLS) OVER (PARTITION BY k ORDER BY n, p, s ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) doc FROM x)
SELECT k doc_id, pos, CAST(coalesce(nullif(r, 0), doc) AS DECIMAL(18,3)) rate FROM y""")
def vat_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = assemble.document_rate(F.col("line_items"))
    filled = records(spark, sf_dir).select("doc_id", F.posexplode(assemble.invoice_lines(F.col("line_items"), rate)).alias("i", "x"))
    return filled.select("doc_id", (F.col("i") + 1).cast("long").alias("pos"), money(F.col("x.vat_rate_percent")).alias("rate"))


@query("q_line_number", INV + "SELECT k doc_id, row_number() OVER (PARTITION BY k ORDER BY n, p, s) pos, p part FROM l")
def line_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = invoices(spark, sf_dir).select(F.col("k").alias("doc_id"), F.posexplode("line_items").alias("i", "x"))
    return numbered.select("doc_id", (F.col("i") + 1).cast("long").alias("pos"), F.col("x.code").cast("long").alias("part"))


@query("q_invoice_struct", INV + """SELECT k doc_id, invoice_number, issue_date, seller_tax_id, 'Customer ' || buyer buyer_name, 'TND' currency, ht total_ht, ttc total_ttc, lines, CASE WHEN stamp IS NULL THEN 0 ELSE 1 END + CASE WHEN tva IS NULL THEN 0 ELSE 1 END taxes, 0 unmapped, false has_payment FROM inv""")
def invoice_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = assemble.to_invoice(records(spark, sf_dir))
    i = F.col("invoice")
    return made.select(
        "doc_id", i["invoice_number"].alias("invoice_number"), i["issue_date"].alias("issue_date"), i["seller"]["tax_id"].alias("seller_tax_id"), i["buyer"]["name"].alias("buyer_name"), i["currency"].alias("currency"),
        money(i["total_ht"]).alias("total_ht"), money(i["total_ttc"]).alias("total_ttc"), F.size(i["line_items"]).cast("long").alias("lines"), F.size(i["taxes"]).alias("taxes"), F.size(F.map_keys(i["unmapped_entities"])).alias("unmapped"), i["payment"].isNotNull().alias("has_payment"),
    )


@query("q_tax_lines", INV + """SELECT k doc_id, 1 pos, 'I-1601' code, CAST(NULL AS DECIMAL(18,3)) base, stamp amount FROM inv WHERE stamp IS NOT NULL
UNION ALL SELECT k, CASE WHEN stamp IS NULL THEN 1 ELSE 2 END, 'I-1602', ht, tva FROM inv WHERE tva IS NOT NULL""")
def tax_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    taxes = assemble.tax_lines(lambda k: F.col("fields")[k], assemble.document_rate(F.col("line_items")))
    return records(spark, sf_dir).select("doc_id", F.posexplode(taxes).alias("i", "t")).select("doc_id", (F.col("i") + 1).alias("pos"), "t.code", money(F.col("t.base")).alias("base"), money(F.col("t.amount")).alias("amount"))


@query("q_provenance_map", INV + """SELECT k doc_id, array_to_string(list_sort(list_filter([CASE WHEN invoice_number IS NOT NULL THEN 'invoice_number' END, 'issue_date', CASE WHEN seller IS NOT NULL THEN 'seller_name' END, CASE WHEN seller_tax_id IS NOT NULL THEN 'seller_tax_id' END, 'buyer_name',
CASE WHEN buyer_tax_id IS NOT NULL THEN 'buyer_tax_id' END, 'currency', CASE WHEN ht IS NOT NULL THEN 'total_ht' END, CASE WHEN tva IS NOT NULL THEN 'tva_amount' END, CASE WHEN stamp IS NOT NULL THEN 'stamp_duty' END,
CASE WHEN ttc IS NOT NULL THEN 'total_ttc' END, CASE WHEN lines > 0 THEN 'line_items' END], lambda x: x IS NOT NULL)), ',') keys FROM inv""")
def provenance_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = assemble.to_invoice(records(spark, sf_dir), F.lit("engine:replay"))
    return made.select("doc_id", F.array_join(F.array_sort(F.map_keys("invoice.field_provenance")), ",").alias("keys"))


@query("q_implied_stamp", INV + """, x AS (SELECT k, CAST(ttc - ht - tva AS DECIMAL(18,3)) implied FROM inv WHERE stamp IS NULL)
SELECT k doc_id, regexp_replace(regexp_replace(CAST(implied AS VARCHAR), '0+$', ''), '[.]$', '') implied FROM x WHERE implied > 0""")
def implied_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    hint = F.try_element_at(rules.hints(lambda k: F.col("fields")[k]), F.lit("stamp_duty"))
    return records(spark, sf_dir).select("doc_id", F.regexp_extract(hint, r"about ([0-9.]+) \(", 1).alias("implied"), hint.alias("h")).where("h is not null").drop("h")


@query("q_line_amounts", INV + "SELECT k doc_id, CAST(sum(total) AS DECIMAL(18,3)) total, count(*) n FROM l GROUP BY 1")
def line_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy(F.col("k").alias("doc_id")).agg(money(F.sum("total")).alias("total"), F.count("*").alias("n"))
