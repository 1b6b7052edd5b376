from __future__ import annotations

import http.server
import json
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from foliospark import cli
from foliospark.api import Engine
from foliospark.config import Config
from foliospark.functions import codes
from foliospark.operators import process, review, rules, tiers
from foliospark.sources import files, pages, providers
from foliospark.sources.providers import LabelProvider, ReplayProvider

LINES = ["invoice_number: R-7781", "issue_date: 03/11/2025", "seller_name: Nordlicht", "seller_tax_id: 4410092KBM000", "buyer_name: Vela", "buyer_tax_id: 778120CAP000", "total_ht: 240.000", "tva_amount: 45.600", "stamp_duty: 1.000", "total_ttc: 286.600", "line: A1|Chair|240.000|1|19|240.000"]
TEXT = "\n".join(LINES)


def without(*keys):
    return "\n".join(x for x in LINES if x.split(":")[0] not in keys)


@pytest.fixture
def keep(spark, tmp_path):
    def write(df):
        path = f"{tmp_path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return write


def documents(spark, *texts):
    return spark.createDataFrame([(i, f"/in/doc-{i}.pdf", t) for i, t in enumerate(texts)], "doc_id long, source_path string, source_text string")


def test_documents_are_filed_repaired_or_held(spark, keep, tmp_path):
    docs = documents(spark, TEXT, without("buyer_tax_id"), None, without("line"), TEXT.replace("286.600", "287.600")).withColumn("low_confidence", F.lit(False))
    docs = docs.unionByName(documents(spark, TEXT).withColumn("doc_id", F.lit(9).cast("long")).withColumn("source_path", F.lit("/in/scan.pdf")).withColumn("low_confidence", F.lit(True)))
    said = []
    done = process.process(docs, LabelProvider(skips=("seller_name",)), keep, config=Config(tier_rounds=2), progress=lambda step, n: said.append(step))
    rows = {r.doc_id: r for r in done.collect()}
    assert {i: r.needs_review for i, r in rows.items()} == {0: False, 1: True, 2: True, 3: True, 4: True, 9: True}
    assert all((r.xml is not None) == (not r.needs_review) for r in rows.values())
    assert rows[0].fields.seller_name == "Nordlicht" and rows[0].rounds[0].accepted == ["seller_name"] and [c.kind for c in rows[0].calls] == ["extraction", "repair"]
    assert rows[1].still_deficient == ["buyer_tax_id"] and len(rows[1].rounds) == 2 and rows[2].rounds == []
    assert [f.rule for f in rows[3].findings if f.severity == "error"] == ["N18"] and "total_ttc" in rows[4].still_deficient
    assert any("scan" in n for n in rows[9].notes) and said[0].startswith("extract with") and said[1].endswith("round 1")
    files.write_results(done, f"{tmp_path}/out")
    assert [r.name for r in spark.read.parquet(f"{tmp_path}/out/xml").collect()] == ["doc-0"]
    reports = {r.name: r.report for r in spark.read.parquet(f"{tmp_path}/out/reports").collect()}
    assert "verdict: OK" in reports["doc-0"] and "1: asked seller_name, accepted seller_name" in reports["doc-0"] and "NEEDS REVIEW" in reports["scan"]
    clean, held = tiers.split_sinks(done)
    assert clean.count() + held.count() == 6 and clean.join(held, "doc_id").isEmpty()


def test_documents_are_made_once_and_meet_their_replies_once(spark, keep):
    plans = []

    def spy(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df)

    docs = documents(spark, TEXT, "no field").withColumn("source_text", F.concat("source_text", F.lit("\nmade-here")))
    done = process.extract(docs, LabelProvider(), spy)
    last = done._jdf.queryExecution().optimizedPlan().toString()
    assert sum("made-here" in p for p in (*plans, last)) == 1 and last.count("Join ") == 1
    assert [(r.doc_id, r.extract_error, len(r.calls)) for r in done.orderBy("doc_id").collect()] == [(0, None, 1), (1, None, 1)]


def test_second_tier_sees_failing_documents_only_and_must_be_better(spark, keep):
    docs = documents(spark, TEXT, TEXT.replace("286.600", "287.600"), without("seller_name"), without("total_ttc"))
    primary, second = LabelProvider(("total_ttc",), repairs=False, model="small"), LabelProvider(model="large")
    rows = {r.doc_id: r for r in process.cascade(docs, primary, second, keep).collect()}
    assert {i: r.tier for i, r in rows.items()} == {0: "escalated", 1: "primary", 2: "escalated", 3: "primary"}
    assert [(t.tier, t.errors) for t in rows[1].tiers_tried] == [("primary", 1), ("escalated", 1)]
    alone = process.cascade(documents(spark, TEXT), LabelProvider(model="small"), second, keep).first()
    assert alone.tier == "primary" and len(alone.tiers_tried) == 1 and {c.model for c in alone.calls} == {"small"}


def test_failed_calls_hold_their_own_document_only(spark, keep):
    provider = ReplayProvider(((r"TEXT\n[^$]*BROKEN", None), (r"TEXT\n[^$]*ODD", "no json"), (r".", json.dumps({"invoice_number": "R-1"}))))
    rows = {r.doc_id: r for r in process.process(documents(spark, "BROKEN", "ODD", "R-1"), provider, keep).collect()}
    assert rows[0].extract_error == "scripted failure" and rows[0].needs_review and rows[0].rounds[0].accepted == []
    assert rows[1].raw_reply == "no json" and rows[1].reported == ["model did not return valid JSON"]
    assert rows[2].fields.invoice_number == "R-1" and all(r.xml is None for r in rows.values())


def test_second_opinion_is_asked_and_kept_by_self_report(spark, keep):
    reply = lambda n, *said: json.dumps({"invoice_number": n, "_verification": {"problems_found": list(said)}})
    first = ReplayProvider((("good", reply("1")), ("bad", reply("1", "blurred", "cut")), ("hard", reply("1", "blurred"))), "first")
    second = ReplayProvider((("bad", reply("2", "cut")), ("hard", reply("2", "blurred"))), "second")
    rows = {r.doc_id: r for r in process.second_opinion(process.extract(documents(spark, "good", "bad", "hard"), first, keep), second, keep).collect()}
    assert {i: (r.fields.invoice_number, r.escalated, len(r.calls)) for i, r in rows.items()} == {0: ("1", False, 1), 1: ("2", True, 2), 2: ("1", False, 2)}


def test_memory_reaches_the_documents_of_its_seller(spark, keep):
    history = spark.createDataFrame([("4410092KBM000", "seller.rc_number", "B55", 1, 1, "Register: B55"), ("4410092KBM000", "buyer.tax_id", "99", 2, 2, "Client no: 99")], "seller string, field_name string, corrected_value string, id long, corrected_at long, source_text string")
    row = process.run_tier(documents(spark, without("buyer_tax_id") + "\nRegister: B55"), LabelProvider(), "primary", keep, history).first()
    assert row.fields.seller_rc_number == "B55" and len(row.memory_notes) == 1
    said = process.hint_map(history).first().history_hints
    assert "Client no" in said["buyer_tax_id"] and "99" not in said["buyer_tax_id"]


def test_models_side_by_side(spark, keep):
    got = process.compare_models(documents(spark, TEXT), [LabelProvider(("total_ttc",), model="a"), LabelProvider(model="b")], keep)
    row = got.where("key = 'total_ttc'").first()
    assert (row.a, row.b) == (None, "286.600") and got.count() == len(codes.FIELDS) - 1


def test_checks_can_be_added_and_dropped(spark, keep):
    own = {"required": rules.CHECKS["required"], "house": lambda f: rules.when_all((f.get("seller_name") != "Vela", rules.problem("H1", "warning", "seller_name", "not our house")))}
    record = process.extract(documents(spark, without("total_ttc").replace("45.600", "1")), LabelProvider(), keep)
    assert [p.rule for p in rules.verify(record, checks=own).first().problems] == ["V1", "H1"]


def page(text="", words=(), images=(), seen="", chars=None):
    marks = chars if chars is not None else [["x", 10, 200 + 3 * i, 14, 203 + 3 * i] for i in range(len(text))]
    return {"width": 600, "height": 800, "text": text, "chars": marks, "words": list(words), "images": list(images), "seen": seen}


def pdf(tmp_path, name, *content):
    path = tmp_path / "in" / name
    path.parent.mkdir(exist_ok=True)
    path.write_text(content[0] if isinstance(content[0], str) else json.dumps(list(content)))
    return f"file:{path}"


def test_ingest_reads_text_mixed_and_scanned_files(spark, keep, tmp_path):
    body = "body text of some length " * 3
    band = lambda y, t: [0, y, 500, y + 60, t]
    names = {
        "text.pdf": [page(" first page here, long enough \n"), page(""), page("last")], "scan.pdf": [page(seen="seen one"), page(seen=" seen two ")],
        "mixed.pdf": [page(body, images=[band(20, "letterhead"), band(300, "across"), band(700, "footer")], chars=[["x", 10, y, 14, y + 3] for y in (200, 500) for _ in range(30)])], "broken.pdf": "{no json",
    }
    for name, content in names.items():
        pdf(tmp_path, name, *([content] if isinstance(content, str) else content))
    listed = files.scan_pdfs(spark, f"{tmp_path}/in").withColumn("doc_id", F.xxhash64("path"))
    rows = {r.source_path.rsplit("/", 1)[1]: r for r in pages.ingest(listed, pages.JsonPages(), pages.ReplayVision(), keep).collect()}
    assert rows["text.pdf"].source_text == "first page here, long enough\nlast" and rows["text.pdf"].classification == "text" and rows["text.pdf"].vision_calls == 0
    assert rows["scan.pdf"].source_text == "seen one\nseen two" and rows["scan.pdf"].low_confidence and rows["scan.pdf"].vision_calls == 2
    assert rows["mixed.pdf"].source_text == f"letterhead\n{body.strip()}\n[over the text]\nacross\nfooter" and not rows["mixed.pdf"].low_confidence
    assert rows["broken.pdf"].source_text is None and "JSONDecodeError" in rows["broken.pdf"].read_error


def test_engine_from_file_to_review_and_back(spark, tmp_path):
    words = [["Total", 10, 50, 40, 60], ["286.600", 50, 50, 90, 60], ["vela", 10, 70, 40, 80]]
    good, held = pdf(tmp_path, "good.pdf", page(TEXT, words)), pdf(tmp_path, "held.pdf", page(without("seller_tax_id"), words))
    broken = pdf(tmp_path, "broken.pdf", "{no json")
    engine, out = Engine(spark, f"{tmp_path}/store"), f"{tmp_path}/out"
    assert engine.queue().isEmpty() and engine.jobs().isEmpty()
    with pytest.raises(FileNotFoundError):
        engine.process([good, f"{tmp_path}/none.pdf"], pages.JsonPages(), pages.ReplayVision(), LabelProvider())
    job = engine.process([good, held, broken], pages.JsonPages(), pages.ReplayVision(), LabelProvider(), out=out)
    state = {r.file.rsplit("/", 1)[1]: r for r in engine.job(job).collect()}
    assert {k: (r.status, r.needs_review, r.has_xml) for k, r in state.items()} == {"good.pdf": ("done", False, True), "held.pdf": ("done", True, False), "broken.pdf": ("failed", True, False)}
    assert "JSONDecodeError" in state["broken.pdf"].error and state["good.pdf"].item_id is None
    assert [(r.job_id, r.status, r.done, r.total) for r in engine.jobs().collect()] == [(job, "done", 3, 3)]
    assert [r.name for r in spark.read.parquet(f"{out}/xml").collect()] == ["good"]

    queued = {r.source_path.rsplit("/", 1)[1]: r.id for r in engine.queue("pending").collect()}
    item = state["held.pdf"].item_id
    assert queued == {"held.pdf": item, "broken.pdf": state["broken.pdf"].item_id}
    one = engine.item(item).first()
    assert one.status == "pending" and one.fields["total_ttc"] == "286.600" and [p.field for p in one.problems] == ["seller_tax_id"] and one.corrections is None
    engine.correct(item, "seller_tax_id", "1111111KBM000")
    engine.correct(item, "seller_tax_id", "4410092KBM000")
    engine.correct(item, "total_ttc", "300.000")
    made = engine.corrections(item).collect()
    assert [(c.field_name, c.original_value, c.corrected_value) for c in made] == [("seller.tax_id", None, "1111111KBM000"), ("seller.tax_id", "1111111KBM000", "4410092KBM000"), ("total_ttc", "286.600", "300.000")]
    engine.correct(item, "line_items[0].description", "Stool")
    one = engine.item(item).first()
    assert one.status == "corrected" and one.fields["seller_tax_id"] == "4410092KBM000" and len(one.corrections) == 4
    xml = engine.xml(item).first()
    assert "4410092KBM000" in xml.xml and "300.000" in xml.xml and "Stool" in xml.xml and "Chair" not in xml.xml and not xml.verified
    places = {r.key: r for r in engine.highlights(item, pages.JsonPages()).collect()}
    assert places["buyer_name"].precise and (places["buyer_name"].x0, places["buyer_name"].bottom) == (10, 80) and "total_ttc" not in places
    assert engine.pdf(item).first().length > 100
    engine.approve(item)
    assert [r.id for r in engine.queue("approved").collect()] == [item]
    engine.delete(item)
    for verb in (engine.item, engine.approve, engine.delete, engine.corrections, engine.xml, engine.pdf, lambda i: engine.correct(i, "currency", "x"), lambda i: engine.highlights(i, pages.JsonPages())):
        with pytest.raises(KeyError):
            verb(item)
    with pytest.raises(KeyError):
        engine.job("none")
    assert engine.field_spec().count() == 23 and [r.name for r in engine.browse(f"{tmp_path}/in").collect()] == ["broken.pdf", "good.pdf", "held.pdf"] and engine.pick_folder(f"{tmp_path}/in").count() == 3


def test_a_watched_folder_is_processed_file_by_file_once(spark, tmp_path):
    pdf(tmp_path, "one.pdf", page(TEXT))
    engine = Engine(spark, f"{tmp_path}/store")
    for _ in range(2):
        engine.watch(f"{tmp_path}/in", pages.JsonPages(), pages.ReplayVision(), LabelProvider(), out=f"{tmp_path}/out").awaitTermination()
    assert [(r.status, r.total) for r in engine.jobs().collect()] == [("done", 1)] and spark.read.parquet(f"{tmp_path}/out/batch-0/xml").count() == 1


def test_what_is_corrected_last_counts_whatever_its_id(spark):
    at = lambda n: F.timestamp_seconds(F.lit(1_700_000_000 + n))
    log = review.empty_log(spark)
    for i in range(12):
        for n, value in enumerate(("old", "new")):
            log = log.unionByName(review.event(spark, i, "corrected", at(10 * i + n), "currency", None, value))
    fields = spark.createDataFrame([(i, "currency", "first") for i in range(13)], "id long, key string, value string")
    got = {r.id: r.value for r in review.overlay(fields, review.corrections(log)).collect()}
    assert got == {**dict.fromkeys(range(12), "new"), 12: "first"}
    assert [r.corrected_value for r in review.correction_list(review.corrections(log), 3).collect()] == ["old", "new"]
    items = spark.createDataFrame([(5, "a", "pending", 1), (1, "b", "pending", 3), (9, "c", "pending", 2)], "id long, source_path string, status string, created_at long")
    assert [r.id for r in review.listing(items).collect()] == [1, 9, 5]


def test_command_line(spark, tmp_path, capsys):
    common = ["--store", f"{tmp_path}/store", "--out", f"{tmp_path}/out"]
    good, held, broken = pdf(tmp_path, "good.pdf", page(TEXT)), pdf(tmp_path, "held.pdf", page(without("buyer_tax_id"))), pdf(tmp_path, "broken.pdf", "{")
    assert cli.main(["run", f"{tmp_path}/none.pdf", *common], spark) == 1 and "no such file" in capsys.readouterr().err
    assert cli.main(["run", good, *common], spark) == 0 and "verdict: OK" in capsys.readouterr().out
    assert cli.main(["run", held, "--quiet", *common], spark) == 2 and "verdict" not in capsys.readouterr().out
    assert cli.main(["run", broken, *common], spark) == 1 and "JSONDecodeError" in capsys.readouterr().err
    names = {p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")}
    assert {f"good{e}" for _, e in files.ENDINGS} <= names and "held.xml" not in names and "held.report.txt" in names
    assert json.loads((tmp_path / "out/good.fields.json").read_text())["total_ttc"] == "286.600" and (tmp_path / "out/good.source.txt").read_text() == TEXT
    (tmp_path / "t.txt").write_text(TEXT)
    assert cli.main(["compare", f"{tmp_path}/t.txt", "labels", "--store", f"{tmp_path}/store"], spark) == 0 and "286.600" in capsys.readouterr().out


def test_http_provider_maps_replies_and_failures():
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(500 if self.path == "/bad" else 200)
            self.end_headers()
            self.wfile.write(b"oops" if self.path == "/odd" else json.dumps({"message": {"content": "{}"}, "prompt_eval_count": 7, "eval_count": 2}).encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    ok = providers.HttpProvider(f"{url}/", "qwen3:14b").answer("hello", b"img")
    assert (ok.text, ok.error, ok.prompt_tokens, ok.output_tokens) == ("{}", None, 7, 2)
    assert seen[0]["think"] is False and seen[0]["messages"][0]["images"] == ["aW1n"] and seen[0]["options"]["num_ctx"] == 8192
    for path in ("/bad", "/odd"):
        got = providers.HttpProvider(url + path, "m").answer("x")
        assert got.text is None and got.error
    server.shutdown()
    assert providers.HttpProvider(url, "m", timeout_s=1).answer("x").error


def test_settings_from_the_environment():
    got = Config.from_env({"FOLIO_MAX_ROUNDS": "5", "FOLIO_TOTALS_TOLERANCE": "0.5", "FOLIO_STABLE_FIELDS": "a,b", "OTHER": "x"})
    assert (got.max_rounds, str(got.totals_tolerance), got.stable_fields, got.text_model) == (5, "0.5", ("a", "b"), Config().text_model)


def test_prompts_name_what_is_asked(spark):
    asked = spark.createDataFrame([(1, ["total_ttc"], {"total_ttc": "look below"}, {"currency": "TND"}, "the text")], "doc_id long, wanted array<string>, hints map<string,string>, known map<string,string>, source_text string")
    prompt = providers.repair_prompt(asked).first().prompt
    assert prompt.startswith(providers.AGAIN + "total_ttc\n") and "- total_ttc: look below" in prompt and '{"currency":"TND"}' in prompt and prompt.endswith("TEXT\nthe text")
    assert [f.name for f in providers.reply_schema(("total_ttc", "line_items"))] == ["total_ttc", "line_items"] and "_verification" in providers.reply_schema().names
    assert providers.shrink_box(3200, 800) == (1600, 400) and providers.shrink_box(100, 50) == (100, 50)


def test_tables_that_nothing_reads_any_more_go(spark):
    from pathlib import Path

    from foliospark.operators.repair import Held
    from foliospark.plans.tables import Keeper

    held = Held(Keeper(spark))
    first = held(spark.range(3).toDF("x"))
    second = held(first.where("x > 0"))
    one, two = (Path(f.inputFiles()[0].removeprefix("file:").replace("///", "/")).parent for f in (first, second))
    held.drop(first)
    assert not one.exists() and two.exists() and second.count() == 2
    held.drop_all()
    assert not two.exists() and not held.frames
