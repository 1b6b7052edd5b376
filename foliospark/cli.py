"""Command line: ``run`` takes files through the engine, ``compare`` sets models side by side on one text.

Exit codes of ``run``: 0 all clean, 2 some need review (their XML is withheld), 1 a failure.
"""

from __future__ import annotations

import argparse
import importlib.util
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from foliospark.api import Engine
from foliospark.config import Config
from foliospark.operators import process, review
from foliospark.session import session
from foliospark.sources.files import document_rows, export_files, read_texts, results_as_text
from foliospark.sources.pages import JsonPages, PageProvider, PlumberPages, ReplayVision, ingest
from foliospark.sources.providers import HttpProvider, LabelProvider, ModelProvider


def provider(name: str, url: str | None, config: Config) -> ModelProvider:
    """``labels`` reads labelled lines without a model; any other name is a model behind the endpoint."""
    if name == "labels":
        return LabelProvider()
    if not url:
        raise ValueError(f"model {name} needs --url")
    return HttpProvider(url, name, config.timeout_s, config.temperature, config.context_tokens)


def page_provider() -> PageProvider:
    """Real PDF files where their library is installed, else pages described in JSON."""
    return PlumberPages() if importlib.util.find_spec("pdfplumber") else JsonPages()


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    config = Config.from_env()
    engine = Engine(spark, args.store, config)
    missing = [p for p in args.files if not engine._exists(p)]
    if missing:
        print(f"no such file: {', '.join(missing)}", file=sys.stderr)
        return 1
    try:
        files = spark.read.format("binaryFile").load(args.files).select("path", "content").withColumn("doc_id", F.xxhash64("path"))
        vision = ReplayVision() if args.model == "labels" else provider(config.vision_model, args.url, config)
        docs = engine.keep(ingest(files, page_provider(), vision, engine.keep, config))
        events = engine.events()
        history = review.correction_history(review.corrections(events), review.items(events))
        second = provider(args.escalation, args.url, config) if args.escalation else None
        done = process.process(docs, provider(args.model, args.url, config), engine.keep, second, history, config)
        held = done.where("needs_review")
        engine.submit(held)
        export_files(done, args.out)
        if done.where("read_error is not null or extract_error is not null").count():
            print("\n".join(r.e for r in done.select(F.coalesce("read_error", "extract_error").alias("e")).where("e is not null").collect()), file=sys.stderr)
            return 1
        code = 0 if held.isEmpty() else 2
        if not args.quiet:
            for row in results_as_text(done).toLocalIterator():
                print(row.report)
        print("wrote:", *(f"{args.out}/{r.name}" for r in document_rows(done).select("name").toLocalIterator()), sep="\n  ")
        return code
    except Exception as e:  # noqa: BLE001  the boundary to the shell
        print(f"failed: {type(e).__name__}: {e}", file=sys.stderr)
        return 1


def compare(spark: SparkSession, args: argparse.Namespace) -> int:
    config = Config.from_env()
    docs = read_texts(spark, args.text).select(F.xxhash64("path").alias("doc_id"), F.col("text").alias("source_text"))
    engine = Engine(spark, args.store, config)
    process.compare_models(docs, [provider(m, args.url, config) for m in args.models], engine.keep).orderBy("doc_id", "key").show(200, truncate=60)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = argparse.ArgumentParser(prog="foliospark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    verbs = top.add_subparsers(dest="verb", required=True)
    one = verbs.add_parser("run")
    one.add_argument("files", nargs="+")
    one.add_argument("--out", default="out")
    one.add_argument("--model", default="labels")
    one.add_argument("--escalation")
    one.add_argument("--quiet", action="store_true")
    two = verbs.add_parser("compare")
    two.add_argument("text")
    two.add_argument("models", nargs="+")
    for verb in (one, two):
        verb.add_argument("--store", default="review-store")
        verb.add_argument("--url")
    args = top.parse_args(argv)
    return {"run": run, "compare": compare}[args.verb](spark or session(), args)


if __name__ == "__main__":
    sys.exit(main())
