"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model (character trigrams, see ``ngram_blocks``) is trained on every document
that the labels call good and not toxic. A document is rejected if its perplexity
exceeds its language's threshold: the given quantile of the trusted documents'
perplexities in that language, times a slack. So that a few odd characters of a
short text don't decide, its loss is averaged with ``prior`` tokens of the
language's mean loss. A window of three characters cannot see that a document says one
word over and over, and word trigrams score such text low too, so a document is also
rejected if more than ``repeated`` of its words equal the word before. A language without trusted text takes the threshold of all.

Null and empty texts consist of the end token alone; they have the prior's
perplexity and are kept. Without any trusted document
only repeated words are rejected.
Very long texts are one document each, held with their trigrams in one block. Repeated rows are scored alike, an empty table gives no row, rows without an id are never trusted;
columns other than ``doc_id``, ``text`` and ``lang`` are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm._common import Scratch, checked_side, table
from foliospark.llm.ngram_blocks import count_trigrams, document_losses, log_probabilities, make_blocks

QUANTILE, SLACK, PRIOR, REPEATED = 0.99, 1.15, 50, 0.2


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, prior: int = PRIOR, repeated: float = REPEATED) -> DataFrame:
    """``doc_id, lang, n_tokens, perplexity, threshold, repeated, keep`` for each row."""
    scratch, trusted = Scratch(docs.sparkSession, "quality-lm"), trusted_ids(labels)
    blocks = make_blocks(docs, scratch)
    counts = count_trigrams(blocks, trusted, scratch)
    answers = log_probabilities(counts.select("k3"), counts.select("k3", F.col("chosen").alias("c")), scratch, "loss")
    losses = scratch.write(document_losses(blocks, answers, ["loss"]).withColumn("lang", F.coalesce("lang", F.lit(""))), "losses")
    good = losses.join(trusted, "doc_id", "left_semi")
    means = scratch.write(good.groupBy("lang").agg((F.sum("loss") / F.sum("n")).alias("mean")), "means")
    overall = good.agg((F.sum("loss") / F.sum("n")).alias("mean")).first()["mean"]

    def smooth(df: DataFrame) -> DataFrame:
        mean = F.coalesce("mean", F.lit(overall).cast("double"))
        score = F.exp((F.col("loss") + prior * mean) / (F.col("n") + prior))
        return df.join(checked_side(means), "lang", "left").withColumn("perplexity", score)

    limits = scratch.write(smooth(good).groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("q")), "limits")
    top = limits.agg(F.max("q").alias("q")).first().q
    limit = F.coalesce("q", F.lit(top).cast("double")) * slack
    return (
        smooth(losses).join(checked_side(limits), "lang", "left")
        .select("doc_id", "lang", F.col("n").alias("n_tokens"), "perplexity", limit.alias("threshold"), "repeated")
        .withColumn("keep", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)) & (F.col("repeated") <= repeated))
    )


def op10_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op10_quality_lm": op10_quality_lm}
ORACLE: dict[str, str] = {}
