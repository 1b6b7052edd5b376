"""Queries over single parts: spliced pages, bands, keyed values, payment, replies, hints, attempts, proposed lines, labels and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.config import DEFAULT
from foliospark.functions import codes, scalars
from foliospark.operators import assemble, einvoice, geometry, highlights, repair, rules, xmlcheck
from foliospark.plans.page_queries import GEO, merged_boxes, page_tables
from foliospark.plans.rule_queries import PROBLEMS
from foliospark.plans.tables import INV, query, read, records


@query("q_page_splice", """WITH b AS (SELECT l_orderkey d, l_linenumber % 2 pg, (l_partkey % 20) * 10 top, l_linenumber x0, 'P' || l_partkey t FROM lineitem),
parts AS (SELECT d, pg, CASE WHEN pg = 1 OR d % 4 = 0 OR top + 8 <= 60 THEN 0 WHEN top >= 120 THEN 3 ELSE 2 END slot, top, x0, t FROM b
  UNION ALL SELECT o_orderkey, 0, 1, 0, 0, 'Body ' || o_orderkey FROM orders WHERE o_orderkey % 4 <> 0),
marked AS (SELECT d, pg, slot, top, x0, CASE WHEN slot = 2 THEN '[over the text]' || chr(10) || t ELSE t END t FROM parts)
SELECT d doc_id, string_agg(t, chr(10) ORDER BY pg, slot, top, x0, t) AS "text" FROM marked GROUP BY 1""")
def page_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages a document; the first has body text between 60 and 120 unless the key is a multiple of four."""
    li, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    d = lambda c: c.cast("double")
    top = d((F.col("l_partkey") % 20) * 10)
    bands = li.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).cast("int").alias("page_no"), d(F.col("l_linenumber")).alias("x0"), top.alias("top"), F.lit(500.0).alias("x1"), (top + 8).alias("bottom"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("band_text"))
    key, there = F.col("o_orderkey"), F.col("o_orderkey") % 4 != 0
    pages = orders.select(key.alias("doc_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("page_no")).withColumn("text", F.when((F.col("page_no") == 0) & (F.col("doc_id") % 4 != 0), F.concat(F.lit(" Body "), F.col("doc_id").cast("string"), F.lit("\n"))))
    chars = orders.where(there).select(key.alias("doc_id"), F.lit(0).alias("page_no"), F.explode(F.array(F.lit(60.0), F.lit(112.0))).alias("top")).withColumn("bottom", F.col("top") + 8)
    return geometry.splice(pages, bands, chars)


@query("q_text_bands", GEO + ", " + merged_boxes("SELECT DISTINCT d, pg, x0, y0, x1, y1 FROM ar WHERE share <= 0.6 AND d % 5 <> 0") + """,
s AS (SELECT *, greatest(0, x1 - x0) * greatest(0, y1 - y0) / (600.0 * 800.0) share, (x1 - x0) / 600.0 wide FROM merged)
SELECT s.d doc_id, s.pg page_no, s.x0, s.y0 top, s.x1, s.y1 bottom FROM s WHERE share <= 0.6 AND (share >= 0.04 OR wide >= 0.5)
AND (SELECT count(*) FROM chr c WHERE c.d = s.d AND c.pg = s.pg AND c.x0 >= s.x0 - 1.5 AND c.x1 <= s.x1 + 1.5 AND c.y0 >= s.y0 - 1.5 AND c.y1 <= s.y1 + 1.5) <= 3""")
def text_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of every fifth document have no area and therefore no bands."""
    pages, images, chars = page_tables(spark, sf_dir)
    return geometry.text_bands(pages.withColumn("width", F.when(F.col("doc_id") % 5 == 0, F.lit(0.0)).otherwise(F.col("width"))), images, chars)


@query("q_keyed_values", INV + """, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, p, s) - 1 i FROM l JOIN (SELECT k FROM inv) USING (k)),
v AS (SELECT k, unnest(['invoice_number=' || invoice_number, 'issue_date=' || strftime(issue_date, '%d/%m/%Y'), 'seller_name=Supplier ' || seller, 'seller_tax_id=' || seller_tax_id, 'buyer_name=Customer ' || buyer, 'buyer_tax_id=' || buyer_tax_id,
  'currency=TND', 'total_ht=' || ht, 'tva_amount=' || tva, 'stamp_duty=' || stamp, 'total_ttc=' || ttc]) kv FROM inv
UNION ALL SELECT k, unnest([i || '.code=' || p, CASE WHEN p % 29 <> 0 THEN i || '.description=Part ' || p END, i || '.unit_price_ht=' || CAST(price AS DECIMAL(18,3)), i || '.quantity=' || quantity,
  CASE WHEN n <> 3 THEN i || '.vat_rate_percent=' || CAST(rate * 100 AS INT) END, CASE WHEN p % 31 <> 0 THEN i || '.line_total_ht=' || total END]) FROM (SELECT * REPLACE ('line_items[' || i || ']' AS i) FROM r))
SELECT k doc_id, string_agg(kv, ';' ORDER BY kv) AS "values" FROM v WHERE kv IS NOT NULL GROUP BY 1""")
def keyed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = highlights.keyed_values(records(spark, sf_dir)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.concat_ws("=", "key", "value"))).alias("all"))
    return found.select("doc_id", F.array_join("all", ";").alias("values"))


@query("q_payment", """WITH o AS (SELECT o_orderkey k, CASE WHEN o_orderkey % 2 = 0 THEN 'Net ' || o_orderkey END terms, CASE o_orderkey % 3 WHEN 0 THEN 'La POSTE' WHEN 1 THEN 'Banque ' || o_orderkey END bank,
CASE WHEN o_orderkey % 5 = 0 THEN 'R' || o_orderkey END rib, CASE WHEN o_orderkey % 7 = 0 THEN 'I' || o_orderkey END iban FROM orders)
SELECT k doc_id, CASE WHEN terms IS NOT NULL THEN 'I-116:' || terms ELSE '' END || CASE WHEN coalesce(bank, rib, iban) IS NOT NULL THEN '|I-114:' || CASE WHEN lower(bank) LIKE '%poste%' THEN 'I-141' ELSE 'I-142' END || ':' || coalesce(rib, iban, '') || ':' || coalesce(bank, '') ELSE '' END section
FROM o WHERE coalesce(terms, bank, rib, iban) IS NOT NULL OR k % 11 = 0""")
def payment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payment section: its terms, then branch kind, account and bank of a transfer; documents without any of these have none."""
    k = F.col("o_orderkey")
    own = lambda cond, *parts: F.when(cond, F.concat(*parts))
    text = k.cast("string")
    given = {
        "payment_terms": own(k % 2 == 0, F.lit("Net "), text), "bank_name": F.when(k % 3 == 0, F.lit("La POSTE")).when(k % 3 == 1, F.concat(F.lit("Banque "), text)),
        "rib": own(k % 5 == 0, F.lit("R"), text), "iban": own(k % 7 == 0, F.lit("I"), text), "swift_bic": F.when(k % 11 == 0, F.lit("TUNX")).otherwise(F.lit("")),
    }
    orders = read(spark, sf_dir, "orders").select(k.alias("doc_id"), *(v.alias(c) for c, v in given.items()))
    made = orders.select("doc_id", einvoice._payment(assemble.payment(F.col))["PytSectionDetails"].alias("parts")).where("parts is not null")
    code, fii = (lambda x: x["Pyt"]["PaymentTearmsTypeCode"]), (lambda x: x["PytFii"])
    shown = F.transform("parts", lambda x: F.when(fii(x).isNull(), F.concat(code(x), F.lit(":"), x["Pyt"]["PaymentTearmsDescription"])).otherwise(
        F.concat(F.lit("|"), code(x), F.lit(":"), fii(x)["_functionCode"], F.lit(":"), fii(x)["AccountHolder"]["AccountNumber"], F.lit(":"), F.coalesce(fii(x)["InstitutionIdentification"]["InstitutionName"], F.lit("")))))
    return made.select("doc_id", F.array_join(shown, "").alias("section"))


@query("q_currency_code", "SELECT event_type raw, coalesce(nullif(substr(upper(trim(CASE WHEN event_id % 5 = 0 THEN '  ' ELSE '  ' || event_type END)), 1, 3), ''), 'TND') code, count(*) n FROM events GROUP BY 1, 2")
def currency_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit("  "), "event_type"))
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("raw"), einvoice.currency_code(raw).alias("code")).agg(F.count("*").alias("n"))


@query("q_tax_id_hints", INV + """SELECT k doc_id, CASE WHEN buyer_tax_id IS NULL THEN '''' || seller_tax_id || ''' is the seller''s number; the buyer has one of its own, of the same shape, near the client''s name.' END buyer_hint,
CASE WHEN seller_tax_id IS NULL THEN '''' || buyer_tax_id || ''' is the buyer''s number; the seller has one of its own, of the same shape, in the letterhead or at the foot.' END seller_hint FROM inv""")
def tax_id_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = rules.hints(lambda k: F.col("fields")[k])
    return records(spark, sf_dir).select("doc_id", F.try_element_at(said, F.lit("buyer_tax_id")).alias("buyer_hint"), F.try_element_at(said, F.lit("seller_tax_id")).alias("seller_hint"))


@query("q_reply_parse", """SELECT o_orderkey doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'x' || o_orderkey WHEN 2 THEN 'y' END AS "value", CASE WHEN o_orderkey % 3 = 1 THEN substr('no json ' || repeat('z', CAST(1970 + o_orderkey % 50 AS INT)), 1, 2000) END raw_reply,
CASE o_orderkey % 3 WHEN 1 THEN 'model did not return valid JSON' WHEN 2 THEN 'blur ' || o_orderkey ELSE '' END reported FROM orders""")
def reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies by the key: an object, a text that is no JSON, an object that reports a problem of its own."""
    from foliospark.sources.providers import parse_replies

    k = F.col("o_orderkey")
    text = k.cast("string")
    bad = F.concat(F.lit("no json "), F.repeat(F.lit("z"), (1970 + k % 50).cast("int")))
    reply = F.when(k % 3 == 0, F.concat(F.lit('{"a": "x'), text, F.lit('"}'))).when(k % 3 == 1, bad).otherwise(F.concat(F.lit('{"a": "y", "_verification": {"problems_found": ["blur '), text, F.lit('"]}}')))
    read_ = parse_replies(read(spark, sf_dir, "orders").select(k.alias("doc_id"), reply.alias("reply")))
    return read_.select("doc_id", F.try_element_at("fields", F.lit("a")).alias("value"), "raw_reply", F.array_join("reported", ",").alias("reported"))


@query("q_attempt_cap", INV + "SELECT k doc_id, buyer_tax_id IS NULL AND k % 4 < 2 buyer_wanted, invoice_number IS NULL number_wanted, k % 4 + CASE WHEN buyer_tax_id IS NULL AND k % 4 < 2 THEN 1 ELSE 0 END buyer_attempts, CASE WHEN invoice_number IS NULL THEN 1 END number_attempts FROM inv WHERE seller_tax_id <> buyer_tax_id OR buyer_tax_id IS NULL")
def attempt_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing buyer's tax id that was asked for up to three times before, and a missing number that never was."""
    get = lambda k: F.col("fields")[k]
    checked = rules.verify(records(spark, sf_dir)).where("fields.seller_tax_id <> fields.buyer_tax_id or fields.buyer_tax_id is null")
    before = checked.select("doc_id", "fields", "problems", F.create_map(F.lit("buyer_tax_id"), (F.col("doc_id") % 4).cast("int")).alias("attempts"))
    asked = before.withColumn("wanted", repair.wanted_fields(get, F.col("problems"), F.col("attempts"), DEFAULT.attempts_per_field)).withColumn("after", repair.count_attempts(F.col("attempts"), F.col("wanted")))
    return asked.select("doc_id", F.array_contains("wanted", "buyer_tax_id").alias("buyer_wanted"), F.array_contains("wanted", "invoice_number").alias("number_wanted"), F.element_at("after", "buyer_tax_id").alias("buyer_attempts"), F.try_element_at("after", F.lit("invoice_number")).alias("number_attempts"))


@query("q_line_proposals", INV + """, f AS (SELECT k, arg_min(p, (n, p, s)) first_part, count(CASE WHEN p % 29 <> 0 THEN 1 END) described FROM l GROUP BY 1)
SELECT inv.k doc_id, inv.lines > 0 AND (inv.k % 3 = 0 OR inv.k % 3 = 1 AND first_part % 29 = 0) accepted, CASE WHEN inv.lines = 0 THEN 0 WHEN inv.k % 3 = 0 THEN inv.lines ELSE described END described FROM inv LEFT JOIN f USING (k)""")
def line_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines proposed anew: with every description filled in, with the first one blanked, or none at all."""
    described = lambda c: F.size(F.filter(c, lambda x: F.coalesce(x["description"], F.lit("")) != ""))
    k, lines = F.col("doc_id"), F.col("line_items")
    whole = F.transform(lines, lambda x: x.withField("description", F.coalesce(x["description"], F.lit("Row"))))
    blanked = F.transform(lines, lambda x, i: x.withField("description", F.when(i > 0, x["description"])))
    state = rules.verify(records(spark, sf_dir)).withColumn("new_lines", F.when(k % 3 == 0, whole).when(k % 3 == 1, blanked).otherwise(F.array().cast(repair.LINES)))
    state = state.withColumn("wanted", F.array(F.lit("line_items"))).withColumn("proposed", F.create_map().cast("map<string,string>"))
    return repair.judge(state, keys=("invoice_number",)).select("doc_id", F.array_contains("accepted", "line_items").alias("accepted"), described(F.col("line_items")).alias("described"))


@query("q_error_relevance", PROBLEMS + ", e AS (SELECT * FROM p WHERE severity = 'error') SELECT k doc_id, k IN (SELECT doc_id FROM e WHERE field IN ('total_ht', 'totals')) about_total, k IN (SELECT doc_id FROM e WHERE field = 'buyer_tax_id') about_buyer FROM inv")
def error_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an error concerns a total, by its own name or as one of the totals, and the buyer's tax id."""
    found = rules.verify(records(spark, sf_dir))
    return found.select("doc_id", repair._about(F.col("problems"), F.lit("total_ht")).alias("about_total"), repair._about(F.col("problems"), F.lit("buyer_tax_id")).alias("about_buyer"))


@query("q_line_colours", "WITH c AS (SELECT [" + ", ".join(f"'{c}'" for c in codes.COLOURS) + "] list) SELECT l_linenumber, l_partkey % 40 i, list[(l_partkey % 40 + len(list) // 2) % len(list) + 1] colour, count(*) n FROM lineitem, c GROUP BY ALL")
def line_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("l_partkey") % 40
    key = F.concat(F.lit("line_items["), i.cast("string"), F.lit("].code"))
    return read(spark, sf_dir, "lineitem").groupBy("l_linenumber", i.alias("i"), codes.colour_of(key).alias("colour")).agg(F.count("*").alias("n"))


@query("q_labelled", "SELECT conv_id, turn, '[' || upper(role) || '] turn ' || turn || ': ' || \"text\" line FROM conversations")
def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = scalars.labelled(F.col("role"), F.concat(F.lit("turn "), F.col("turn").cast("string")), F.col("text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line"))


@query("q_findings_report", """SELECT l_orderkey doc_id, count(*) FILTER (l_suppkey % 2 = 0) || ' error(s), ' || count(*) FILTER (l_suppkey % 2 = 1) || ' warning(s)' || chr(10)
|| string_agg('  [' || CASE WHEN l_suppkey % 2 = 0 THEN 'ERROR' ELSE 'WARNING' END || '] /Lin[' || l_linenumber || ']: part ' || l_partkey, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) report FROM lineitem GROUP BY 1
UNION ALL SELECT o_orderkey, 'no issues found' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def findings_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    one = xmlcheck.finding("N19", "error", F.concat(F.lit("/Lin["), text("l_linenumber"), F.lit("]")), "")
    one = one.withField("message", F.concat(F.lit("part "), text("l_partkey"))).withField("severity", F.when(F.col("l_suppkey") % 2 == 0, F.lit("error")).otherwise(F.lit("warning")))
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", one.alias("f")))).alias("s"))
    joined = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")).join(rows, F.col("doc_id") == F.col("l_orderkey"), "left")
    found = F.coalesce(F.transform("s", lambda x: x["f"]), F.array().cast(xmlcheck.FINDING))
    return joined.select("doc_id", xmlcheck.report(found).alias("report"))
