"""One file a document from the executors, and replies held against the keys that were asked for."""

from __future__ import annotations

import json
import os
import uuid

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from foliospark.functions import codes
from foliospark.sources import files
from foliospark.sources.docfiles import DocumentFiles, DocumentFilesWriter
from foliospark.sources.providers import ModelProvider, Reply, answers_log, reply_problems, reply_shape, run_once


def below(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f)).read() for d, _, names in os.walk(folder) for f in names}


def test_writer_publishes_committed_attempts_only(tmp_path):
    w = DocumentFilesWriter(str(tmp_path), False, False)

    def failing():
        yield Row(name="a.xml", content="half")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        w.write(failing())
    speculative = w.write(iter([Row(name="a.xml", content="A"), Row(name="b/c.xml", content="é")]))
    kept = w.write(iter([Row(name="a.xml", content="A"), Row(name="b/c.xml", content="é"), Row(name="d.xml", content=None), Row(name=None, content="x")]))
    assert speculative.files == kept.files == 2
    w.commit([kept, w.write(iter([])), None])
    found = below(tmp_path)
    assert {k.split("/")[1]: v for k, v in found.items()} == {"a.xml": "A", "b_c.xml": "é"} and len(found) == 2
    again = DocumentFilesWriter(str(tmp_path), False, False)
    again.write(iter([Row(name="z.xml", content="Z")]))
    again.abort([None])
    assert below(tmp_path) == found and not (tmp_path / ".staging").exists()


@pytest.mark.parametrize("flat", ["true", "false"])
def test_jobs_write_append_overwrite_and_fail(spark, tmp_path, flat):
    spark.dataSource.register(DocumentFiles)
    rows = spark.createDataFrame([(f"d{i}.txt", f"text {i}") for i in range(40)], "name string, content string").repartition(5)

    def write(df, mode):
        df.write.format("document_files").option("flat", flat).mode(mode).save(f"{tmp_path}/out")
        return {k.split("/")[-1]: v for k, v in below(tmp_path / "out").items()}

    assert write(rows, "append") == {f"d{i}.txt": f"text {i}" for i in range(40)}
    assert len(write(spark.createDataFrame([("more.txt", "m")], "name string, content string"), "append")) == 41
    broken = rows.withColumn("content", F.when(F.col("name") == "d39.txt", F.raise_error(F.lit("no"))).otherwise(F.lit("new")))
    with pytest.raises(Exception):
        write(broken, "append")
    assert len(below(tmp_path / "out")) == 41 and "new" not in below(tmp_path / "out").values() and not (tmp_path / "out/.staging").exists()
    assert write(rows.limit(3), "overwrite").keys() <= {f"d{i}.txt" for i in range(40)} and len(below(tmp_path / "out")) == 3


def test_documents_of_one_name_and_held_ones(spark, tmp_path):
    fields = F.struct(F.lit("x").alias("invoice_number"))
    made = spark.createDataFrame([("/a/f.pdf", False, "<a/>"), ("/b/f.pdf", False, "<b/>"), ("/c/held.pdf", True, "<c/>"), ("/d/g.pdf", None, "<d/>")], "source_path string, needs_review boolean, xml string")
    none = F.array().cast("array<struct<severity:string,field:string,message:string>>")
    files.export_files(made.select("*", F.lit("t").alias("source_text"), fields.alias("fields"), none.alias("problems"), F.array().cast("array<string>").alias("still_deficient")), f"{tmp_path}/out")
    xml = {k: v for k, v in below(tmp_path / "out").items() if k.endswith(".xml")}
    assert xml["f.xml"] == "<a/>" and sorted(xml.values()) == ["<a/>", "<b/>"] and len(below(tmp_path / "out")) == 4 * 3 + 2


def problems(spark, reply, wanted=None):
    df = spark.createDataFrame([(reply, wanted)], "reply string, wanted array<string>")
    found = df.select(reply_problems(F.col("reply"), F.col("wanted")).alias("p")).first().p
    return None if found is None else [tuple(p) for p in found]


def test_replies_against_their_own_requests(spark):
    assert problems(spark, None, ["currency"]) is None
    assert problems(spark, "nonsense", ["currency"]) == [("$", "not an object", None)] and problems(spark, "[1]", ["currency"]) == [("$", "not an object", "ARRAY<BIGINT>")]
    assert problems(spark, '{"currency":"TND"}', ["currency"]) == [] and problems(spark, '{"currency":null}', ["currency"]) == []
    assert problems(spark, '{"currency":5,"total_ht":"1"}', ["currency", "total_ttc"]) == [("currency", "mistyped", "BIGINT"), ("total_ht", "additional", "STRING"), ("total_ttc", "missing", None)]
    assert problems(spark, '{"other_references":["a",null]}', ["other_references"]) == [] and problems(spark, '{"other_references":"a"}', ["other_references"]) == [("other_references", "mistyped", "STRING")]
    lines = '{"line_items":[{"code":"1","quantity":2},{"code":"x","extra":{"a":1}},"loose"],"_verification":{"problems_found":[]}}'
    assert problems(spark, lines, ["line_items"]) == [("line_items[0].quantity", "mistyped", "BIGINT"), ("line_items[1].extra", "additional", "OBJECT<a: BIGINT>"), ("line_items[2]", "mistyped", "STRING")]
    assert problems(spark, '{"line_items":{"code":"1"}}', ["line_items"]) == [("line_items", "mistyped", "OBJECT<code: STRING>")]
    whole = {k: "x" for k in codes.FIELDS} | {"other_references": [], "line_items": []}
    assert problems(spark, json.dumps(whole)) == [] and [p[1] for p in problems(spark, "{}")] == ["missing"] * len(whole)


def test_shape_of_all_replies(spark):
    calls = spark.createDataFrame([('{"a":1}',), ('{"a":"x","b":[1]}',), ("broken",), (None,)], "reply string")
    assert reply_shape(calls).first().schema == "OBJECT<a: VARIANT, b: ARRAY<BIGINT>>"


class Counting(ModelProvider):
    """Notes every call in a folder; prompts with "fail" are not answered while the folder has no file "mended"."""

    model, at_once = "counting", 4

    def __init__(self, folder):
        self.folder = folder

    def answer(self, prompt, image=None):
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(prompt)
        if "fail" in prompt and not os.path.exists(f"{self.folder}/mended"):
            return Reply(None, "down", self.model)
        return Reply(f"<{prompt}>", None, self.model)


def test_answered_questions_are_not_asked_again(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    asked = lambda: sorted(p.read_text() for p in calls.iterdir() if p.name != "mended")
    log, provider = answers_log(spark, f"{tmp_path}/answers"), Counting(str(calls))
    prompts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "fail")], "doc_id long, prompt string")
    got = {r.doc_id: r.reply for r in run_once(prompts, provider, log, 2).collect()}
    assert got == {1: "<a>", 2: "<b>", 3: "<a>"} and asked() == ["a", "b", "fail"]
    (calls / "mended").write_text("")
    got = {r.doc_id: r.reply for r in run_once(prompts, provider, log, 3).collect()}
    assert got == {1: "<a>", 2: "<b>", 3: "<a>", 4: "<fail>"} and asked() == ["a", "b", "fail", "fail"]
    assert sorted(r.reply for r in provider.run(prompts).collect()) == ["<a>", "<a>", "<b>", "<fail>"]
