"""File scans and sinks."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.scalars import labelled, stem
from foliospark.operators.tiers import split_sinks
from foliospark.sources.docfiles import DocumentFiles


def scan_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """All PDF files below a folder: ``path, length, content``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]")
    return reader.load(folder).select("path", "length", "content")


def browse(spark: SparkSession, folder: str) -> DataFrame:
    """One directory's subfolders and PDF files, folders first, then by name regardless of case."""
    top = Path(folder)
    if not top.is_dir():
        raise NotADirectoryError(folder)
    rows = [(p.name, str(p), p.is_file()) for p in top.iterdir() if p.is_dir() or p.suffix.lower() == ".pdf"]
    return spark.createDataFrame(rows, "name string, path string, is_file boolean").orderBy("is_file", F.lower("name"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: ``path, text``."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


LABELS = (
    "file string, invoice_number string, issue_date string, issue_date_iso date, seller_name string, seller_tax_id string, seller_address string, buyer_name string, buyer_tax_id string, buyer_address string, "
    "line_items array<struct<description:string,quantity:decimal(18,3),unit:string,unit_price:decimal(18,3),line_total:decimal(18,3)>>, total_ht decimal(18,3), tva_rate_percent decimal(5,2), tva_amount decimal(18,3), total_ttc decimal(18,3), currency string"
)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A labelled corpus in one JSON array."""
    return spark.read.schema(LABELS).option("multiLine", "true").json(path)


def read_einvoices(spark: SparkSession, path: str) -> DataFrame:
    """Whole XML files as text: ``path, xml``."""
    return read_texts(spark, path).withColumnRenamed("text", "xml")


def results_as_text(results: DataFrame, *more: str) -> DataFrame:
    """``name, source, fields, report, xml`` of processed documents, each a text, and the columns in ``more``; ``xml`` is null where a person must look first."""
    return results.select(
        *more, stem(F.col("source_path")).alias("name"), F.coalesce("source_text", F.lit("")).alias("source"),
        F.to_json(F.col("fields").withField("line_items", F.col("line_items")) if "line_items" in results.columns else F.col("fields"), {"ignoreNullFields": "false"}).alias("fields"),
        report(results.columns).alias("report"), F.when(~F.coalesce("needs_review", F.lit(True)), F.col("xml")).alias("xml"),
    )


def write_results(results: DataFrame, folder: str, partitions: int | None = None) -> None:
    """Source text, fields and report of every document; XML only of those that need no review."""
    texts = results_as_text(results if partitions is None else results.repartition(partitions))
    texts.drop("xml").write.mode("overwrite").parquet(f"{folder}/reports")
    clean, _ = split_sinks(results)
    clean.where("xml is not null").select(stem(F.col("source_path")).alias("name"), "xml").write.mode("overwrite").parquet(f"{folder}/xml")


#: What ``export_files`` writes of a document: column and file ending.
ENDINGS = (("source", ".source.txt"), ("fields", ".fields.json"), ("report", ".report.txt"), ("xml", ".xml"))


def document_rows(results: DataFrame) -> DataFrame:
    """``name, content``: a row for each file of each document; of documents whose sources have one name all but the first by path get a mark of path and content."""
    texts = results_as_text(results.withColumn("_path", F.coalesce("source_path", F.lit(""))), "_path")
    texts = texts.withColumn("_mark", F.lower(F.hex(F.xxhash64("_path", "source", "fields", "report"))))
    first = texts.groupBy("name").agg(F.min(F.struct("_path", "_mark")).alias("_first"))
    named = texts.join(first, "name").withColumn("name", F.when(F.col("_first") == F.struct("_path", "_mark"), F.col("name")).otherwise(F.concat("name", F.lit("~"), "_mark")))
    files = F.array(*(F.struct(F.concat("name", F.lit(ending)).alias("name"), F.col(column).alias("content")) for column, ending in ENDINGS))
    return named.select(F.inline(files)).where("content is not null")


def export_files(results: DataFrame, folder: str, flat: bool = True) -> None:
    """One file for each text of each document, written by the executors and published at once; without ``flat`` in a folder for each partition, which is what many documents need. XML only of documents that need no review."""
    results.sparkSession.dataSource.register(DocumentFiles)
    document_rows(results).write.format("document_files").option("flat", str(flat).lower()).mode("append").save(folder)


def report(columns: list[str]) -> Column:
    """A readable summary of one document, of as many sections as there are columns for."""
    parts = [F.concat(F.lit("document: "), F.coalesce("source_path", F.lit("?"))), F.concat(F.lit("verdict: "), F.when(F.col("needs_review"), F.lit("NEEDS REVIEW")).otherwise(F.lit("OK")))]
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))

    def section(title: str, lines: Column, none: str) -> Column:
        listed = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("  "), x)), "\n")
        return F.concat(F.lit(f"{title}:\n"), F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, listed).otherwise(F.lit(f"  {none}")))

    if "classification" in columns:
        parts.append(F.concat(F.lit("read as: "), text(F.col("classification")), F.when(F.col("low_confidence"), F.lit(" (low confidence)")).otherwise(F.lit(""))))
    if "tiers_tried" in columns:
        parts.append(section("tiers", F.transform("tiers_tried", lambda t: F.format_string("%s (%s): %d error(s), unresolved: %s", t["tier"], t["model"], t["errors"], F.array_join(t["still_deficient"], ", "))), "none"))
    if "calls" in columns:
        parts.append(section("model calls", F.transform("calls", lambda c: F.format_string("%s %s: %s s, %s in, %s out%s", c["kind"], text(c["model"]), text(F.round(c["duration_s"], 1)), text(c["prompt_tokens"]), text(c["output_tokens"]), F.coalesce(F.concat(F.lit(", "), c["error"]), F.lit("")))), "none"))
        parts.append(F.concat(F.lit("model time: "), text(F.round(F.aggregate("calls", F.lit(0.0), lambda a, c: a + F.coalesce(c["duration_s"], F.lit(0.0))), 1)), F.lit(" s")))
    if "rounds" in columns:
        parts.append(section("repair rounds", F.transform("rounds", lambda r: F.format_string("%d: asked %s, accepted %s, rejected %s", r["round_no"], *(F.array_join(r[k], ", ") for k in ("asked", "accepted", "rejected")))), "none was needed"))
    parts.append(section("checks", F.transform("problems", lambda p: labelled(p["severity"], p["field"], p["message"])), "all passed"))
    parts.append(F.concat(F.lit("unresolved: "), F.coalesce(F.array_join("still_deficient", ", "), F.lit(""))))
    if "findings" in columns:
        parts.append(section("e-invoice", F.transform("findings", lambda f: labelled(f["severity"], f["path"], f["message"])), "no finding"))
    if "build_warnings" in columns:
        parts.append(section("builder", F.coalesce("build_warnings", F.array().cast("array<string>")), "no warning"))
    if "notes" in columns:
        parts.append(section("notes", F.col("notes"), "none"))
    return F.concat_ws("\n", *parts)
