"""The engine's verbs as methods; each returns a DataFrame, there is no web server."""

from __future__ import annotations

import contextlib
import datetime
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliospark.config import DEFAULT, Config
from foliospark.functions import codes
from foliospark.operators import assemble, einvoice, geometry, highlights, process, review
from foliospark.operators.repair import LINES
from foliospark.sources.bucketlog import BucketLog, ConflictError
from foliospark.sources.files import browse, scan_pdfs, write_results
from foliospark.sources.pages import PageProvider, ingest
from foliospark.sources.providers import ModelProvider
from foliospark.streaming import jobs

FILES = "job_id string, file string, status string, phase string, error string, needs_review boolean, item_id long, tier string, has_xml boolean, ts timestamp, seq long"


class Engine:
    """A review store (events in a bucketed log) and what can be asked of it. Jobs and intermediate tables lie in folders beside it, which all executors must see.

    Verbs on one item or job read its bucket only; an append is visible whole or not at all, and concurrent ones all survive.
    """

    def __init__(self, spark: SparkSession, store: str, config: Config = DEFAULT):
        self.spark, self.store, self.config = spark, store.rstrip("/"), config
        self.log = BucketLog(spark, self.store, review.EVENTS, "item_id", ("ts", "event_id"))
        self.job_log = BucketLog(spark, f"{self.store}-jobs", FILES, "job_id", ("file", "seq"))

    def _exists(self, path: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write a frame to the work folder and reread it."""
        path = f"{self.store}-work/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def events(self) -> DataFrame:
        return self.log.read()

    def append(self, events: DataFrame, tag: tuple[str, str] | None = None) -> None:
        self.log.append(events, tag)
        self.compact()

    def compact(self) -> None:
        """Merge the runs of buckets that have gathered many; where another writer does so at the same time, its result stands."""
        for log in (self.log, self.job_log):
            with contextlib.suppress(ConflictError):
                log.compact()

    def field_spec(self) -> DataFrame:
        return codes.field_spec(self.spark)

    def pick_folder(self, folder: str) -> DataFrame:
        return scan_pdfs(self.spark, folder).select("path").orderBy("path")

    def browse(self, folder: str) -> DataFrame:
        return browse(self.spark, folder)

    # -- batches -------------------------------------------------------

    def _report(self, job_id: str, files: DataFrame, seq: int) -> None:
        """Append states of files (``file, status, phase`` and whatever else is known) to the job log."""
        known = {f.split(" ")[0]: f.split(" ")[1] for f in FILES.split(", ")}
        more = {"job_id": F.lit(job_id), "ts": F.current_timestamp(), "seq": F.lit(seq).cast("long")}
        row = [(more[c] if c in more else F.col(c) if c in files.columns else F.lit(None)).cast(t).alias(c) for c, t in known.items()]
        self.job_log.append(files.select(*row))

    def process(
        self, files: DataFrame | list[str], pages: PageProvider, vision: ModelProvider, primary: ModelProvider, escalation: ModelProvider | None = None, out: str | None = None,
        tag: tuple[str, str] | None = None,
    ) -> str:
        """Run files (paths, or a frame of ``path, content``) as one job and give its id.

        Clean documents' XML and all reports go to ``out``, held documents to the review queue. A file that
        cannot be opened or extracted fails for itself alone. Paths that do not exist are refused before anything runs.
        With ``tag`` (a source and the number of its batch) the ids of the job and of held documents follow from it, and a repeated batch is held once.
        """
        if isinstance(files, list):
            missing = [p for p in files if not self._exists(p)]
            if missing:
                raise FileNotFoundError(", ".join(missing))
            files = self.spark.read.format("binaryFile").load(files).select("path", "content")
        name = uuid.uuid4().hex if tag is None else hashlib.sha256("/".join(tag).encode()).hexdigest()
        job_id, seq = name[:12], iter(range(1, 1_000_000))
        files = files.dropDuplicates(["path"]).withColumn("doc_id", F.xxhash64("path"))
        names = files.select(F.col("path").alias("file"))
        self._report(job_id, names.select("file", F.lit("queued").alias("status"), F.lit("waiting").alias("phase")), 0)

        def tell(phase: str, size: int) -> None:
            self._report(job_id, names.select("file", F.lit("running").alias("status"), F.lit(phase).alias("phase")), next(seq))

        try:
            tell("read pages", -1)
            docs = ingest(files, pages, vision, self.keep, self.config)
            events = self.events()
            history = review.correction_history(review.corrections(events), review.items(events))
            done = process.process(self.keep(docs), primary, self.keep, escalation, history, self.config, tell)
            now = F.lit(datetime.datetime.now(datetime.UTC))
            named = now if tag is None else F.lit(name)
            held = done.where("needs_review")
            self.append(review.submit(held, now, named), tag)
            if out is not None:
                write_results(done, out)
        except Exception as e:
            self._report(job_id, names.select("file", F.lit("failed").alias("status"), F.lit("failed").alias("phase"), F.lit(f"{type(e).__name__}: {e}"[:500]).alias("error")), next(seq))
            raise
        error = F.coalesce("read_error", "extract_error")
        last = done.select(
            F.col("source_path").alias("file"), F.when(error.isNull(), F.lit("done")).otherwise(F.lit("failed")).alias("status"), F.when(error.isNull(), F.lit("done")).otherwise(F.lit("failed")).alias("phase"),
            error.alias("error"), "needs_review", F.when(F.col("needs_review"), review.item_id(named)).alias("item_id"), "tier", F.col("xml").isNotNull().alias("has_xml"),
        )
        self._report(job_id, last, next(seq))
        return job_id

    def watch(self, folder: str, pages: PageProvider, vision: ModelProvider, primary: ModelProvider, escalation: ModelProvider | None = None, out: str | None = None) -> StreamingQuery:
        """Process the files that came into a folder since the last call, a job for each micro-batch; the checkpoint lies beside the store."""
        stream = self.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)

        def each(batch: DataFrame, number: int) -> None:
            rows = self.keep(batch.select("path", "content"))
            if not rows.isEmpty():
                self.process(rows, pages, vision, primary, escalation, None if out is None else f"{out}/batch-{number}", (f"{self.store}-stream", str(number)))

        return jobs.process(stream, each, f"{self.store}-stream")

    def jobs(self) -> DataFrame:
        """``job_id, status, done, total, changes``, higher ids first."""
        rows = self.job_log.read()
        state = jobs.progress(rows.withColumn("seq", F.struct("seq", "ts")))
        status = F.when(F.col("done") == F.col("total"), F.lit("done")).otherwise(F.lit("running"))
        return state.withColumn("status", status).select("job_id", "status", "done", "total", "changes").orderBy(F.desc("job_id"))

    def job(self, job_id: str) -> DataFrame:
        """The last state of each file of a job."""
        rows = self.job_log.lookup(job_id)
        if rows.isEmpty():
            raise KeyError(job_id)
        return jobs.latest_state(rows, ["job_id", "file"], ["seq", "ts"]).orderBy("file")

    # -- review queue --------------------------------------------------

    def submit(self, records: DataFrame) -> None:
        self.append(review.submit(records, F.current_timestamp()))

    def queue(self, status: str | None = None) -> DataFrame:
        return review.listing(review.items(self.events()), status)

    def _one(self, item_id: int) -> DataFrame:
        found = review.items(self.log.lookup(item_id))
        if found.isEmpty():
            raise KeyError(item_id)
        return found

    def corrections(self, item_id: int) -> DataFrame:
        """An item's corrections in the order in which they were made."""
        self._one(item_id)
        return review.correction_list(review.corrections(self.log.lookup(item_id)), item_id)

    def fields(self, item_id: int) -> DataFrame:
        """``id, key, value`` of one item with its corrections laid over."""
        fields = F.from_json(F.get_json_object("gate_json", "$.fields"), "map<string,string>")
        submitted = self._one(item_id).select("id", F.explode(fields).alias("key", "value"))
        return review.overlay(submitted, review.corrections(self.log.lookup(item_id)))

    def item(self, item_id: int) -> DataFrame:
        """``id, source_path, status, created_at, fields`` (a map), ``problems, corrections`` of one item."""
        one = self._one(item_id).select("id", "source_path", "status", "created_at", F.coalesce(review.gate_problems(F.col("gate_json")), F.array().cast("array<struct<severity:string,field:string,message:string>>")).alias("problems"))
        fields = self.fields(item_id).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("fields"))
        made = self.corrections(item_id).groupBy(F.col("review_item_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("corrected_at", "id", "field_name", "original_value", "corrected_value"))).alias("corrections"))
        return one.join(fields, "id", "left").join(made, "id", "left")

    def pdf(self, item_id: int) -> DataFrame:
        """``path, length, content`` of the item's source file."""
        path = self._one(item_id).first().source_path
        if not path or not self._exists(path):
            raise KeyError(f"no source file of item {item_id}")
        return self.spark.read.format("binaryFile").load(path).select("path", "length", "content")

    def correct(self, item_id: int, field: str, value: str) -> None:
        """Record a correction with the value that it replaces, under the field's nested name."""
        before = self.fields(item_id).where(F.col("key") == field).first()
        self.append(review.event(self.spark, item_id, "corrected", F.current_timestamp(), field, before and before.value, value))

    def approve(self, item_id: int) -> None:
        self._one(item_id)
        self.append(review.event(self.spark, item_id, "approved", F.current_timestamp()))

    def delete(self, item_id: int) -> None:
        self._one(item_id)
        self.append(review.event(self.spark, item_id, "deleted", F.current_timestamp()))

    def records(self, item_id: int) -> DataFrame:
        """``doc_id, fields, line_items`` of one item as a flat record, corrections laid over, those of single line values too."""
        wide = self.fields(item_id).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
        lines = F.coalesce(F.from_json(F.try_element_at("m", F.lit("line_items")), LINES), F.array().cast(LINES))
        at = lambda i, k: F.try_element_at("m", F.concat(F.lit("line_items["), i.cast("string"), F.lit(f"].{k}")))
        lines = F.transform(lines, lambda x, i: F.struct(*(F.coalesce(at(i, k), x[k]).alias(k) for k in codes.LINE_FIELDS)))
        return wide.select(F.col("id").alias("doc_id"), process.as_fields(F.col("m")).alias("fields"), lines.alias("line_items"))

    def xml(self, item_id: int) -> DataFrame:
        """``xml, verified``: rebuilt from the overlaid fields; it is not checked again and says so."""
        return einvoice.build(assemble.to_invoice(self.records(item_id))).select("xml", F.lit(False).alias("verified"))

    def highlights(self, item_id: int, pages: PageProvider) -> DataFrame:
        """Where the item's values stand in its source file; without the file, nothing."""
        path = self._one(item_id).first().source_path
        kind = "doc_id long, key string, page_no int, x0 double, top double, x1 double, bottom double, precise boolean, rank int, colour string"
        if not path or not self._exists(path):
            return self.spark.createDataFrame([], kind)
        file = self.spark.read.format("binaryFile").load(path).select(F.lit(item_id).cast("long").alias("doc_id"), "content")
        read = self.keep(pages.read(file)).where("error is null")
        boxes = [F.inline(c) for c in ("words", "images", "chars")]
        words, images, chars = (read.select("doc_id", "page_no", b) for b in boxes)
        bands = geometry.text_bands(read.select("doc_id", "page_no", "width", "height"), images, chars, self.config)
        return highlights.find(highlights.keyed_values(self.records(item_id)), words, bands)
