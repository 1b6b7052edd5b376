from __future__ import annotations

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from foliospark.functions import codes, scalars
from foliospark.operators import assemble, einvoice, geometry, memory, repair, review, rules, tiers, xmlcheck

TEXT = "Facture R-7781 du 03/11/2025\nMF 4410092KBM000 Nordlicht\nClient 778120CAP000 Vela\nHT 240.000 TVA 45.600 timbre 1.000 TTC 286.600"
FULL = {"invoice_number": "R-7781", "issue_date": "03/11/2025", "seller_name": "Nordlicht", "seller_tax_id": "4410092KBM000", "buyer_name": "Vela", "buyer_tax_id": "778120CAP000", "total_ht": "240.000", "tva_amount": "45.600", "stamp_duty": "1.000", "total_ttc": "286.600"}
LINE = {"code": "A1", "description": "Widget", "unit_price_ht": "240.000", "quantity": "1", "vat_rate_percent": "19", "line_total_ht": "240.000"}


def record(spark, changes=None, lines=(LINE,), text=TEXT, doc_id=1):
    fields = {k: None for k in codes.FIELDS} | FULL | (changes or {})
    fields["other_references"] = fields["other_references"] or []
    schema = "doc_id long, fields struct<" + ", ".join(f"{k}:{'array<string>' if k == 'other_references' else 'string'}" for k in codes.FIELDS) + f">, line_items {repair.LINES}, source_text string, reported array<string>"
    return spark.createDataFrame([(doc_id, tuple(fields[k] for k in codes.FIELDS), [tuple(x[k] for k in codes.LINE_FIELDS) for x in lines], text, [])], schema)


def found(df):
    return [(p.rule, p.field) for p in rules.verify(df).first().problems]


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("812.306", "812.306"), ("2 905,118", "2905.118"), ("x\n12\n3", None), ("730 000", "730000"), ("4.567,8", "4567.8"), ("4,567.8", "4567.8"), ("-6", "-6"), ("3-4", None), (".", None), ("5.", "5"), (".5", "0.5"), ("", None), (None, None), ("--7", "-7")])
def test_parse_decimal(spark, raw, want):
    got = one(spark, scalars.parse_decimal(F.lit(raw).cast("string")))
    assert got == (None if want is None else Decimal(want))


@pytest.mark.parametrize(("raw", "want"), [("2024-07-09", (2024, 7, 9)), ("09/07/2024", (2024, 7, 9)), ("9.7.24", (2024, 7, 9)), ("090724", (2024, 7, 9)), ("5 Août 2023", (2023, 8, 5)), ("31/04/2025", None), ("1er mai 2024", None), ("", None), (None, None)])
def test_parse_date(spark, raw, want):
    assert one(spark, scalars.parse_date(F.lit(raw).cast("string"))) == (want and datetime.date(*want))


def test_formats(spark):
    values = [one(spark, f(F.lit(v).cast("decimal(20,6)"))) for f, v in ((scalars.format_amount, "50"), (scalars.format_amount, "0.0005"), (scalars.format_amount, "0.0015"), (scalars.format_quantity, "12.900"), (scalars.format_quantity, "100"), (scalars.format_quantity, "0"))]
    assert values == ["50.000", "0.000", "0.002", "12.9", "100", "0"]


def test_complete_record_has_no_problem(spark):
    assert found(record(spark)) == []


@pytest.mark.parametrize(("changes", "want"), [
    ({"buyer_tax_id": None}, [("V1", "buyer_tax_id")]),
    ({"buyer_tax_id": None, "stamp_duty": None}, [("V1", "buyer_tax_id"), ("V5", "totals")]),
    ({"buyer_tax_id": "90417735"}, [("V2", "buyer_tax_id"), ("V9", "buyer_tax_id")]),
    ({"buyer_tax_id": "4410092 KBM/000"}, [("V3", "buyer_tax_id"), ("V9", "buyer_tax_id")]),
    ({"total_ht": "none"}, [("V4", "totals"), ("V9", "total_ht")]),
    ({"seller_capital": "240.00 0"}, []),
])
def test_field_rules(spark, changes, want):
    assert found(record(spark, changes)) == want


def test_line_rules(spark):
    assert found(record(spark, lines=(LINE, LINE | {"line_total_ht": None}))) == [("V6", "line_items")]
    assert found(record(spark, lines=(LINE, LINE))) == [("V7", "line_items")]
    assert found(record(spark, lines=())) == []


def test_hints_and_blocking(spark):
    df = rules.verify(record(spark, {"buyer_tax_id": None, "stamp_duty": None}))
    get = lambda k: F.col("fields")[k]
    row = df.select(rules.hints(get).alias("h"), rules.blocking(get, F.col("problems")).alias("b"), rules.deficient(get, F.col("problems")).alias("d")).first()
    assert "about 1 (" in row.h["stamp_duty"] and row.h["buyer_tax_id"].count("4410092KBM000") == 1
    assert row.b == ["buyer_tax_id", "total_ht", "tva_amount", "stamp_duty", "total_ttc"]
    assert row.d == ["buyer_tax_id", "stamp_duty"]


def test_einvoice_round_trip(spark):
    made = einvoice.build(assemble.to_invoice(record(spark)))
    row = xmlcheck.validate(made.select("doc_id", "xml", "build_warnings")).first()
    assert [f.rule for f in row.findings] == [] and row.build_warnings == ["seller: no address", "buyer: no address"]
    assert 'controlingAgency="TTN"' in row.xml and "<Amount currencyIdentifier=\"TND\">286.600</Amount>" in row.xml


@pytest.mark.parametrize(("xml", "want"), [("<TEIF>", ["N0"]), (None, ["N0"]), ('<FOO version="1" controlingAgency="TTN"><InvoiceHeader><MessageSenderIdentifier type="I-01">1</MessageSenderIdentifier></InvoiceHeader></FOO>', ["N1", "N7"]), ("<TEIF/>", ["N2", "N3", "N4", "N7"])])
def test_xml_root(spark, xml, want):
    row = xmlcheck.validate(spark.createDataFrame([(xml,)], "xml string")).first()
    assert [f.rule for f in row.findings] == want


def brute_merge(boxes):
    out = list(boxes)
    while True:
        hit = next(((i, j) for i in range(len(out)) for j in range(i) if geometry.touch(out[i], out[j])), None)
        if hit is None:
            return sorted(out, key=lambda b: (b[1], b[0], b[2], b[3]))
        a, b = out.pop(hit[0]), out.pop(hit[1])
        out.append((min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])))


def test_findings_are_made_once(spark):
    """A filter that is inferred from the findings' rows would hold the check again."""
    rows = xmlcheck.finding_rows(spark.range(1).select(F.col("id").alias("doc_id"), F.concat(F.lit("<FOO>"), F.col("id").cast("string"), F.lit("</FOO>")).alias("xml")))
    assert rows._jdf.queryExecution().optimizedPlan().toString().lower().count("from_xml") == 1
    assert [r.rule for r in rows.collect()] == ["N1", "N4", "N7"]


def test_amounts_are_written_once_and_only_what_is_checked_is_parsed(spark):
    """Catalyst would copy what makes an invoice's fields into each of their uses."""
    made = einvoice.build(assemble.to_invoice(record(spark)), pretty=False)
    plan = made.select("xml")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bround") <= 12
    text = made.first().xml
    assert "\n<TEIF" in text and "\n" not in text.split("\n", 1)[1].strip() and len(text) < 0.8 * len(einvoice.build(assemble.to_invoice(record(spark))).first().xml)
    odd = [text, text.replace("I-180", "X").replace('"I-62"', '"Z"'), text.replace("<ItemDescription>", "<ItemDescription/><X>").replace("</ItemDescription>", "</X>"), text[:-3], "<TEIF><InvoiceHeader><X>1</X></InvoiceHeader><InvoiceBody/></TEIF>"]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, xml string")
    both = texts.select("i", *(xmlcheck.findings_of(xmlcheck.parse(F.col("xml"), s), xmlcheck.root_name(F.col("xml"), xmlcheck.parse(F.col("xml"), s))).alias(n) for n, s in (("whole", xmlcheck.SCHEMA), ("checked", xmlcheck.CHECKED)))).orderBy("i").collect()
    assert all(r.whole == r.checked for r in both) and [len(r.checked) > 0 for r in both] == [False, True, True, True, True]


def test_merge_boxes():
    rng = random.Random(3)
    for _ in range(200):
        boxes = [(x, y, x + rng.randint(0, 30), y + rng.randint(0, 30)) for x, y in ((rng.randint(0, 150), rng.randint(0, 150)) for _ in range(rng.randint(0, 9)))]
        assert geometry.merge_boxes(boxes) == brute_merge(boxes)


def test_review_and_memory(spark):
    at = lambda h: F.lit(f"2026-01-01 0{h}:00:00").cast("timestamp")
    invoice = '{"seller":{"tax_id":"4410092KBM000"}}'
    log = spark.createDataFrame([(1, 7, "submitted", datetime.datetime(2026, 1, 1), "/in/a.pdf", "RC B1234\nCapital 9 000", invoice, "[]", None, None, None)], review.EVENTS)
    log = log.unionByName(review.event(spark, 7, "corrected", at(1), "seller_rc_number", None, "B1234")).unionByName(review.event(spark, 7, "approved", at(2)))
    assert review.items(log).first().status == "approved"
    history = review.correction_history(review.corrections(log), review.items(log))
    assert history.first().field_name == "seller.rc_number"
    docs = record(spark, text="RC B1234 again").unionByName(record(spark, text="no such number", doc_id=2)).withColumn("seller", F.lit("4410092KBM000"))
    rows = {r.doc_id: r for r in memory.reuse(docs, history).collect()}
    assert rows[1].fields.seller_rc_number == "B1234" and rows[2].fields.seller_rc_number is None and len(rows[2].notes) == 1
    hint = memory.hints(history).first().hint
    assert "stood once beside" in hint and "B1234" not in hint
    gone = log.unionByName(review.event(spark, 7, "deleted", at(3)))
    assert review.items(gone).isEmpty() and review.corrections(gone).isEmpty()


def test_line_context(spark):
    for text, value, want in (("Code : 12 | TND", "12", ("Code", "TND")), ("a\nlabel\n12\nnext", "12", ("label", "next")), ("x", "12", None)):
        got = one(spark, scalars.line_context(F.lit(text), F.lit(value)))
        assert (got and tuple(got)) == want


def test_repair_accepts_only_what_the_text_shows(spark, tmp_path):
    docs = record(spark, {"buyer_tax_id": None}).unionByName(record(spark, {"buyer_tax_id": None}, doc_id=2, text=TEXT.replace("778120CAP000", "")))
    count = iter(range(100))

    def keep(df):
        path = str(tmp_path / str(next(count)))
        df.write.parquet(path)
        return spark.read.parquet(path)

    def ask(asked):
        return asked.select("doc_id", F.lit('{"buyer_tax_id": "778120CAP000"}').alias("reply"))

    rows = {r.doc_id: r for r in repair.repair(docs, ask, keep, max_rounds=1).select("doc_id", "fields.buyer_tax_id", "still_deficient", "rounds").collect()}
    assert rows[1].buyer_tax_id == "778120CAP000" and rows[1].still_deficient == []
    assert rows[2].buyer_tax_id is None and rows[2].still_deficient == ["buyer_tax_id"] and rows[2].rounds[0].rejected == ["buyer_tax_id"]


def test_sinks_are_exclusive(spark):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None)], "doc_id long, needs_review boolean")
    clean, held = tiers.split_sinks(rows)
    assert [r.doc_id for r in clean.collect()] == [2] and sorted(r.doc_id for r in held.collect()) == [1, 3]


def test_colours(spark):
    got = [one(spark, codes.colour_of(F.lit(k))) for k in ("invoice_number", "line_items[0].code", "other_references")]
    assert got == [codes.COLOURS[0], codes.COLOURS[8], codes.COLOURS[0]]
