from __future__ import annotations

import datetime
import re

import pytest
from pyspark.sql import functions as F

from foliospark.functions import codes, scalars
from foliospark.operators import assemble, einvoice, geometry, highlights, repair, rules, xmlcheck
from foliospark.sources import files, providers
from foliospark.streaming import jobs
from tests.test_engine import FULL, LINE, TEXT, record

# what each change of a sound e-invoice must be found for, and how severe it is
CHANGES = [
    ("N8", "error", r"<Bgm>.*</Bgm>", ""), ("N8", "error", r"R-7781", " "), ("N9", "warning", r'(<DocumentType) code="I-11"', r"\1"),
    ("N10", "error", r"<DateText.*?</DateText>", ""), ("N11", "warning", r'functionCode="I-31"', 'functionCode="I-99"'), ("N11", "error", r"(<DateText[^>]*>)\d+", r"\1 "),
    ("N12", "error", r"<PartnerSection>.*</PartnerSection>", ""), ("N12", "error", r"<PartnerSection>.*</PartnerSection>", "<PartnerSection><x/></PartnerSection>"),
    ("N13", "warning", r'functionCode="I-64"', 'functionCode="I-00"'), ("N14", "error", r"<Nad>.*?</Nad>", ""), ("N15", "error", r"(<PartnerIdentifier[^>]*>)4410092KBM000", r"\1"),
    ("N15", "warning", r'(<PartnerIdentifier type=)"I-01"', r'\1"I-77"'), ("N16", "warning", r"(</Nad>)", r"\1<CtaSection><Communication><ComMeansType>I-999</ComMeansType></Communication></CtaSection>"),
    ("N17", "warning", r'functionCode="I-62"', 'functionCode="I-64"'), ("N17", "warning", r'functionCode="I-64"', 'functionCode="I-62"'), ("N18", "error", r"<LinSection>.*</LinSection>", ""),
    ("N19", "warning", r"<ItemDescription>.*?</ItemDescription>", "<ItemDescription/>"), ("N19", "warning", r"(<Quantity[^>]*>)1<", r"\1<"), ("N19", "warning", r"(<LinTax>.*?)<TaxRate>.*?</TaxRate>", r"\1"),
    ("N19", "warning", r'(<LinMoa>.*?)"I-171"', r'\1"I-183"'), ("N20", "error", r"<InvoiceMoa>.*</InvoiceMoa>", "<InvoiceMoa/>"), ("N21", "warning", r'"I-182"', '"I-555"'),
    ("N21", "warning", r'"I-180"', '"I-179"'), ("N21", "warning", r'"I-176"', '"I-179"'), ("N22", "error", r"<InvoiceTax>.*</InvoiceTax>", "<InvoiceTax/>"),
    ("N23", "warning", r'code="I-1601"', 'code="I-1699"'), ("N23", "error", r"<InvoiceTaxDetails><Tax>.*?</Tax>", "<InvoiceTaxDetails>"), ("N24", "warning", r'("I-171".*?>)240\.000<', r"\g<1>240.021<"),
    ("N25", "warning", r'("I-180".*?>)286\.600<', r"\g<1>286.621<"), ("N26", "warning", r'("I-181".*?>)45\.600<', r"\g<1>45.621<"),
]
# within the tolerance, or not the rule's business
QUIET = [("N24", r'("I-171".*?>)240\.000<', r"\g<1>240.019<"), ("N25", r'("I-180".*?>)286\.600<', r"\g<1>286.619<"), ("N26", r'("I-181".*?>)45\.600<', r"\g<1>45.619<"), ("N25", r"<InvoiceTax>.*</InvoiceTax>", "<InvoiceTax/>")]


def test_every_finding_fires_on_its_own_fault(spark):
    made = einvoice.build(assemble.to_invoice(record(spark))).first().xml
    flat = re.sub(r">\s+<", "><", made)

    def changed(pattern, to):
        out = re.sub(pattern, to, flat, count=0 if pattern.startswith("<DateText") else 1, flags=re.S)
        assert out != flat, pattern
        return out

    rows = [(-1, flat)] + [(i, changed(p, to)) for i, (_, _, p, to) in enumerate(CHANGES)] + [(100 + i, changed(p, to)) for i, (_, p, to) in enumerate(QUIET)]
    got = {r.doc_id: [(f.rule, f.severity) for f in r.findings] for r in xmlcheck.validate(spark.createDataFrame(rows, "doc_id long, xml string")).collect()}
    assert got[-1] == []
    for i, (rule, severity, pattern, _) in enumerate(CHANGES):
        assert (rule, severity) in got[i], (rule, pattern, got[i])
    for i, (rule, _, _) in enumerate(QUIET):
        assert rule not in {r for r, _ in got[100 + i]}
    assert {r for r, _, _, _ in CHANGES} == {f"N{i}" for i in range(8, 27)}
    said = spark.createDataFrame([(flat,), (changed(r"R-7781", " "),)], "xml string").transform(xmlcheck.validate).select(xmlcheck.report(F.col("findings")).alias("r")).collect()
    assert said[0].r == "no issues found" and said[1].r.startswith("1 error(s), 0 warning(s)\n  [ERROR] InvoiceBody/Bgm")


def test_every_builder_warning_fires(spark):
    nothing = record(spark, dict.fromkeys(FULL), lines=())
    bare = record(spark, dict.fromkeys(FULL), lines=(dict.fromkeys(LINE),), doc_id=2)
    rows = [r.w for r in assemble.to_invoice(nothing.unionByName(bare)).orderBy("doc_id").select(einvoice.warnings_of(F.col("invoice")).alias("w")).collect()]
    head = ["sender identifier left out", "receiver identifier left out", "number unknown, a stand-in was written", "issue date left out"]
    party = lambda who: [f"{who}: no tax number, the partner identifier is empty", f"{who}: no name", f"{who}: no address"]
    tail = ["no total is known, InvoiceMoa is empty", "no tax is known, InvoiceTax is empty"]
    assert rows[0] == [*head, *party("seller"), *party("buyer"), "no line, LinSection left out", *tail]
    assert rows[1] == [*head, *party("seller"), *party("buyer"), "line 1: no description", "line 1: neither price nor total, LinMoa left out", *tail]


def test_payment_contacts_and_dates_reach_the_document(spark):
    made = assemble.to_invoice(record(spark))
    party = F.col("invoice.seller")
    for k, v in (("phone", "71 000"), ("email", "a@b"), ("rc_number", "B1")):
        party = party.withField(k, F.lit(v))
    day = lambda s: F.lit(s).cast("date")
    invoice = F.col("invoice").withField("seller", party).withField("due_date", day("2025-12-01")).withField("period_start", day("2025-10-01")).withField("period_end", day("2025-10-31"))
    kind = made.schema["invoice"].dataType["payment"].dataType.simpleString()
    values = F.struct(*(F.lit(v).alias(k) for k, v in zip([f.split(":")[0] for f in kind[7:-1].split(",")], ["Banque Poste", "RIB1", None, None, "in 30 days"], strict=True)))
    xml = einvoice.build(made.withColumn("invoice", invoice.withField("payment", values.cast(kind)))).first().xml
    for part in ('functionCode="I-32">011225', 'functionCode="I-36">011025-311025', "<ComMeansType>I-101</ComMeansType>", "<ComMeansType>I-103</ComMeansType>", 'refID="I-815">B1', "in 30 days", 'functionCode="I-141"', "<AccountNumber>RIB1</AccountNumber>", "<PaymentTearmsTypeCode>I-114"):
        assert part in re.sub(r">\s+", ">", xml), part


def test_lines_are_taken_over_only_if_they_do_no_harm(spark):
    better = [LINE | {"description": "Chair"}]
    cases = {1: (dict(LINE, line_total_ht=None), better, True), 2: (LINE, [dict(LINE, description=None)], False), 3: (LINE, [], False), 4: (dict(LINE, description=None, line_total_ht=None), [dict(LINE, description="", line_total_ht="240.000")], True)}
    docs = None
    for i, (own, offered, _) in cases.items():
        lines = F.array(*(F.struct(*(F.lit(x[k]).cast("string").alias(k) for k in codes.LINE_FIELDS)) for x in offered)).cast(repair.LINES)
        one = rules.verify(record(spark, lines=(own,), doc_id=i)).withColumn("wanted", F.array(F.lit("line_items"))).withColumn("proposed", F.create_map().cast("map<string,string>")).withColumn("new_lines", lines)
        docs = one if docs is None else docs.unionByName(one)
    got = {r.doc_id: r.accepted == ["line_items"] for r in repair.judge(docs).collect()}
    assert got == {i: want for i, (_, _, want) in cases.items()}


def test_a_proposal_must_not_add_an_error_or_keep_its_own(spark):
    def turn(changes, proposed, doc_id, text=TEXT):
        return rules.verify(record(spark, changes, text=text, doc_id=doc_id)).withColumn("wanted", F.array(*map(F.lit, proposed))).withColumn("proposed", F.create_map(*(F.lit(x) for kv in proposed.items() for x in kv))).withColumn("new_lines", F.lit(None).cast(repair.LINES))

    docs = turn({"buyer_tax_id": None}, {"buyer_tax_id": "4410092KBM000"}, 1)  # the seller's own
    docs = docs.unionByName(turn({"stamp_duty": None}, {"stamp_duty": "1.000"}, 2)).unionByName(turn({"stamp_duty": None}, {"stamp_duty": "45.600"}, 3))
    docs = docs.unionByName(turn({"total_ht": "1"}, {"total_ht": "240.000", "currency": "Vela"}, 4))
    got = {r.doc_id: (r.accepted, r.rejected) for r in repair.judge(docs).collect()}
    assert got == {1: ([], ["buyer_tax_id"]), 2: (["stamp_duty"], []), 3: ([], ["stamp_duty"]), 4: (["currency", "total_ht"], [])}


def test_a_model_is_asked_once_whatever_reads_the_result(spark, tmp_path):
    count = spark.sparkContext.accumulator(0)

    def keep(df):
        path = f"{tmp_path}/{len(list(tmp_path.iterdir()))}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    def ask(asked):
        def run(rows):
            for r in rows:
                count.add(1)
                yield (r.doc_id, '{"buyer_tax_id": "778120CAP000"}')

        return spark.createDataFrame(asked.select("doc_id").rdd.mapPartitions(run), "doc_id long, reply string")

    heard = []
    done = repair.repair(record(spark, {"buyer_tax_id": None}), ask, keep, on_round=lambda n, size: heard.append((n, size)))
    for _ in range(3):
        assert done.first().fields.buyer_tax_id == "778120CAP000"
    assert count.value == 1 and heard == [(1, 1)]


def test_replies(spark):
    calls = spark.createDataFrame([(1, '{"total_ttc": 5, "line_items": [{"code": "x"}], "_verification": {"problems_found": ["cut"]}}'), (2, "x" * 3000), (3, None), (4, "[1]")], "doc_id long, reply string")
    rows = {r.doc_id: r for r in providers.parse_replies(calls).collect()}
    assert rows[1].fields["total_ttc"] == "5" and rows[1].reported == ["cut"] and rows[1].raw_reply is None
    assert len(rows[2].raw_reply) == providers.RAW_CHARS and rows[2].reported and rows[3].reported == [] and rows[3].raw_reply is None and rows[4].raw_reply == "[1]"


def test_search_in_page_text(spark):
    words = spark.createDataFrame([(1, 0, "Grand", 0.0, 10.0, 5.0, 20.0), (1, 0, "TOTAL:", 6.0, 10.0, 9.0, 21.0), (1, 0, "286.600", 10.0, 10.0, 19.0, 20.0), (1, 1, "total", 0.0, 5.0, 3.0, 8.0), *((1, 2, "x", float(i), 1.0, float(i) + 1, 2.0) for i in range(9))], "doc_id long, page_no int, text string, x0 double, top double, x1 double, bottom double")
    values = spark.createDataFrame([(1, "a", "grand total"), (1, "b", "86.6"), (1, "c", "Total"), (1, "d", "none"), (1, "e", "x"), (2, "a", "total"), (1, "f", " ")], "doc_id long, key string, value string")
    bands = spark.createDataFrame([(1, 3, 0.0, 0.0, 9.0, 9.0)], "doc_id long, page_no int, x0 double, top double, x1 double, bottom double")
    rows = highlights.find(values, words, bands).collect()
    assert {(r.key, r.page_no, r.x0, r.x1, r.bottom) for r in rows if r.precise and r.key != "e"} == {("a", 0, 0, 9, 21), ("b", 0, 10, 19, 20), ("c", 0, 6, 9, 21), ("c", 1, 0, 3, 8)}
    assert sum(r.key == "e" for r in rows) == 4 and {(r.key, r.page_no) for r in rows if not r.precise} == {("d", 3), ("f", 3)}
    keyed = {r.key: r.value for r in highlights.keyed_values(record(spark)).collect()}
    assert keyed["line_items[0].description"] == LINE["description"] and keyed["total_ttc"] == "286.600" and "seller_address" not in keyed


def test_classes_of_documents(spark):
    box = "x0 double, top double, x1 double, bottom double"
    pages = spark.createDataFrame([(d, p, 100.0, 100.0, "") for d in range(1, 7) for p in (0, 1)] + [(7, 0, 0.0, 0.0, "")], "doc_id long, page_no int, width double, height double, text string")
    chars = spark.createDataFrame([(d, p, "x", 50.0, 90.0, 51.0, 91.0) for d in range(2, 8) for p in (0, 1) for _ in range(15)], f"doc_id long, page_no int, ch string, {box}")
    images = spark.createDataFrame([(2, 0, 0.0, 0.0, 99.0, 99.0), (3, 0, 0.0, 0.0, 99.0, 20.0), (4, 0, 0.0, 0.0, 99.0, 20.0), (4, 1, 0.0, 0.0, 99.0, 99.0), (5, 0, 0.0, 80.0, 99.0, 99.0), (6, 0, 0.0, 0.0, 10.0, 10.0)], f"doc_id long, page_no int, {box}")
    got = {r.doc_id: r["class"] for r in geometry.classify(pages, images, chars).collect()}
    assert got == {1: "scanned", 2: "scanned", 3: "mixed", 4: "mixed", 5: "text", 6: "text", 7: "text"}


def test_files(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "x.PDF").write_bytes(b"1")
    (tmp_path / "b" / "y.pdf").write_bytes(b"22")
    (tmp_path / "note.txt").write_text("a\nb")
    (tmp_path / "labels.json").write_text('[{"file": "x.pdf", "issue_date_iso": "2025-11-03", "total_ht": 240.0, "line_items": [{"description": "Chair", "quantity": 1}]}]')
    assert [r.name for r in files.browse(spark, str(tmp_path)).collect()] == ["b", "x.PDF"]
    with pytest.raises(NotADirectoryError):
        files.browse(spark, f"{tmp_path}/none")
    assert sorted(r.length for r in files.scan_pdfs(spark, str(tmp_path)).collect()) == [1, 2]
    assert files.read_texts(spark, f"{tmp_path}/note.txt").first().text == "a\nb" and files.read_einvoices(spark, f"{tmp_path}/note.txt").columns == ["path", "xml"]
    row = files.read_labels(spark, f"{tmp_path}/labels.json").first()
    assert row.issue_date_iso == datetime.date(2025, 11, 3) and row.line_items[0].description == "Chair"


def test_repeats_in_a_stream_are_dropped_only_on_request(spark, tmp_path):
    spark.createDataFrame([(1, datetime.datetime(2026, 1, 1)), (1, datetime.datetime(2026, 1, 1, 0, 5)), (2, datetime.datetime(2026, 1, 1))], "doc_id long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    for name, change, want in (("all", lambda s: s, 3), ("once", lambda s: jobs.drop_repeats(s, "doc_id", "ts"), 2)):
        seen = []
        jobs.process(change(jobs.stream_parquet(spark, f"{tmp_path}/in")), lambda batch, n, seen=seen: seen.append(batch.count()), f"{tmp_path}/{name}").awaitTermination()
        assert sum(seen) == want


def test_labels_and_paths(spark):
    row = spark.range(1).select(scalars.labelled(F.lit("error"), F.lit("a"), F.lit("b")).alias("l"), codes.nested_name(F.lit("buyer_tax_id")).alias("n"), codes.flat_name(F.lit("capital_social")).alias("f"), codes.nested_name(F.lit("other")).alias("o"), scalars.stem(F.lit("/x/y.scan.pdf")).alias("s")).first()
    assert tuple(row) == ("[ERROR] a: b", "buyer.tax_id", "seller_capital", "other", "y.scan")
