"""Source divergence audit: how the vocabulary of every source differs from the other sources of its language.

Terms are runs of ASCII letters (A-Z lower-cased) and characters from U+0080 on. A language
keeps the terms that stand in at least ``LEAST`` of its documents.

Two passes over blocks of a bounded amount of text (a block is of one language):
(1) Every block is written with its normalised text and the distinct terms of its
documents with their exact document frequencies; frequencies are summed by (language, term).
(2) The kept terms go back to the blocks that hold them, so a block's automaton has no
term that the block lacks and stays bounded however large the vocabulary is. A
pyahocorasick automaton of the kept terms, padded with the delimiter, recounts the occurrences of
each source; a term inside a longer word cannot match. Terms and groups are numbered, so counts are rows of three numbers.

Counts per (language, term) are then sparse postings ``[(source, p, p of a count of 0)]``. Divergence of two
sources over all V terms needs only postings: a constant for terms that neither holds, a sum over the terms
that one holds (from the histogram of its p), and a correction for the terms that both hold. Pairs of a posting list are added up
inside a task and never become rows. All arithmetic is on integers.

Null text, language and source read as ''. Rows that share a ``doc_id`` are documents of their own; the
id is not read. A group without terms has every kept term with count 0; a language that keeps nothing gives pairs of
value 0 and no terms. An empty table gives no row. Columns other than ``text``, ``lang`` and ``source`` are
not read. Memory grows with a block, the longest text and the number of sources of a language, as the result's pairs do.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.llm._common import Scratch, bound_batches, byte_list, checked_side, chunks, table, trim

LEAST = 3
#: Ranks of part ``term``.
RANKS = 200
SCALE = 1_000_000_000
#: Bytes of text in the blocks that a task holds at a time.
BLOCK_BYTES = 32 << 20
#: Pairs of posting entries that a task holds before it adds them up, and sums that it holds before it gives them out.
PAIRS, SUMS = 1 << 20, 1 << 20
#: Parts in which the terms of a source are ranked first, so that one source's terms do not meet in one task.
SALTS = 64
#: Letters lower-cased, other ASCII a space, higher bytes as they are.
_FOLD = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BLOCKS = "block long, lang string, sources array<string>, sizes array<long>, text binary, terms array<string>, freqs array<long>"


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def _lists(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pass: normalised texts by language and source, distinct terms with their document frequencies."""
    from pyspark import TaskContext

    task, seq, held = TaskContext.get().partitionId(), 0, 0
    texts: dict[str, dict[str, list[bytes]]] = defaultdict(lambda: defaultdict(list))
    freqs: dict[str, Counter] = defaultdict(Counter)
    names = [f.split(" ")[0] for f in _BLOCKS.split(", ")]

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal seq, held
        press = zstandard.ZstdCompressor(level=1)
        for lang, by_source in texts.items():
            joined = [b" ".join(parts) for parts in by_source.values()]
            kept, seen = freqs[lang], list(by_source)
            cols = [pa.array([task << 32 | seq], pa.int64()), pa.array([lang], pa.string()), pa.array([seen], pa.list_(pa.string())), pa.array([[len(x) for x in joined]], pa.list_(pa.int64()))]
            cols += [pa.array([press.compress(b"".join(joined))], pa.binary()), _lists(_strings(list(kept))), _lists(pa.array(list(kept.values()), pa.int64()))]
            yield pa.record_batch(cols, names=names)
            seq += 1
        texts.clear()
        freqs.clear()
        held = 0

    for batch in chunks(batches, BLOCK_BYTES):
        for lang, source, raw in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), byte_list(batch.column("text")), strict=True):
            words = raw.translate(_FOLD).split()
            freqs[lang].update(set(words))
            texts[lang][source].append(b" ".join(words))
            held += len(raw) + 1
        if held >= BLOCK_BYTES:
            yield from flush()
    yield from flush()
    trim()


def _recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Second pass: occurrences of the block's kept terms in each of its groups, by automaton; terms and groups by their numbers."""
    inflate = zstandard.ZstdDecompressor()
    for batch in batches:
        for i in range(batch.num_rows):
            terms, groups = batch.column("terms")[i].values, batch.column("groups")[i].values
            numbers = terms.field("id").to_numpy()
            automaton = ahocorasick.Automaton()
            for at, term in enumerate(terms.field("term").to_pylist()):
                automaton.add_word(f" {term} ", at)
            automaton.make_automaton()
            blob, at = inflate.decompress(batch.column("text")[i].as_py()), 0
            for group, size in zip(groups.field("gid").to_pylist(), batch.column("sizes")[i].as_py(), strict=True):
                text = f" {blob[at : at + size].decode()} "
                at += size
                counts = np.bincount(np.fromiter((v for _, v in automaton.iter(text)), np.int64), minlength=len(numbers))
                held = np.flatnonzero(counts)
                yield pa.record_batch([pa.array(numbers[held]), pa.array(np.full(len(held), group, np.int64)), pa.array(counts[held], pa.int64())], names=["id", "gid", "n"])
            automaton.clear()
    trim()


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q) of whole numbers up to 10^9 + 1."""
    return (p - q) * (p - q) // q


def _common_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections for the terms that two sources of a language both hold, added up in the task."""
    known: dict[tuple[str, str], int] = {}
    sums: dict[int, int] = {}
    keys: list[np.ndarray] = []
    values: list[np.ndarray] = []
    held = 0

    def settle() -> None:
        nonlocal held
        if keys:
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, back, np.concatenate(values))
            for k, v in zip(key.tolist(), total.tolist(), strict=True):
                sums[k] = sums.get(k, 0) + v
        keys.clear()
        values.clear()
        held = 0

    def give() -> Iterator[pa.RecordBatch]:
        settle()
        names = list(known)
        if sums:
            ends = [divmod(k, 1 << 31) for k in sums]
            cols = [[names[a][0] for a, _ in ends], [names[a][1] for a, _ in ends], [names[b][1] for _, b in ends]]
            yield pa.record_batch([*(pa.array(c, pa.string()) for c in cols), pa.array(sums.values(), pa.int64())], names=["lang", "source", "other", "value"])
        sums.clear()

    for batch in batches:
        posts = batch.column("posts")
        entries, sizes = posts.flatten(), np.diff(posts.offsets.to_numpy())
        langs = np.repeat(np.array(batch.column("lang").to_pylist(), object), sizes)
        group = np.fromiter((known.setdefault(x, len(known)) for x in zip(langs, entries.field("source").to_pylist(), strict=True)), np.int64, len(langs))
        p, p0 = (entries.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("p", "p0"))
        starts = np.cumsum(sizes) - sizes
        for k in np.unique(sizes[sizes > 1]).tolist():
            rows = starts[sizes == k]
            step, turns = max(1, PAIRS // (k * k)), max(1, PAIRS // k)
            for at in range(0, len(rows), step):
                first = rows[at : at + step, None]
                for turn in range(1, k, turns):  # every entry with the one that many places on, round the list
                    here = np.arange(k)
                    there = (here + np.arange(turn, min(k, turn + turns))[:, None]) % k
                    a, b = (first + np.broadcast_to(here, there.shape).ravel()).ravel(), (first + there.ravel()).ravel()
                    keys.append(group[a] << 31 | group[b])
                    values.append(divergence(p[a], p[b]) - divergence(p[a], p0[b]) - divergence(p0[a], p[b]) + divergence(p0[a], p0[b]))
                    held += len(a)
                    if held >= PAIRS:
                        settle()
                    if len(sums) >= SUMS:
                        yield from give()
    yield from give()


def _single_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each source: the sum over all V terms as if no other source shared its terms, and what its own terms add to the others' sums."""
    for batch in batches:
        for i in range(batch.num_rows):
            lang, source, v, p0 = (batch.column(c)[i].as_py() for c in ("lang", "source", "v", "p0"))
            hist, others = batch.column("hist")[i].values, batch.column("others")[i].values
            names, q0 = others.field("source").to_pylist(), others.field("p0").to_numpy(zero_copy_only=False).astype(np.int64)
            p, n = (hist.field(c).to_numpy(zero_copy_only=False).astype(np.int64) if hist is not None and len(hist) else np.zeros(0, np.int64) for c in ("p", "n"))
            rest = v * divergence(np.int64(p0), q0)
            own, theirs = np.zeros(len(q0), np.int64), np.zeros(len(q0), np.int64)
            for at in range(0, len(p), 4096):  # a source may have many different counts
                ps, ns = p[at : at + 4096, None], n[at : at + 4096, None]
                own += (ns * (divergence(ps, q0) - divergence(np.int64(p0), q0))).sum(0)
                theirs += (ns * (divergence(q0, ps) - divergence(q0, np.int64(p0)))).sum(0)
            keep = np.array([x != source for x in names], bool)
            other = [x for x in names if x != source]
            cols = [[lang] * (2 * len(other)), [source] * len(other) + other, other + [source] * len(other)]
            yield pa.record_batch([*(pa.array(c, pa.string()) for c in cols), pa.array(np.concatenate([(own + rest)[keep], theirs[keep]]), pa.int64())], names=["lang", "source", "other", "value"])


def _share(count: Column, total: Column, kept: Column) -> Column:
    """p = 1 + floor(10^9 (count + 1) / (total + kept)), by whole numbers; 1 where nothing is kept."""
    exact = (F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")).cast("decimal(30,0)")
    return F.when(kept > 0, F.call_function("div", exact, (total + kept).cast("decimal(19,0)")) + 1).otherwise(F.lit(1)).cast("long")


def audit(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank``: for every source its divergence from each other source of the language (part ``pair``) and the terms it overuses most (part ``term``)."""
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "divergence")
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    blocks = scratch.write(texts.mapInArrow(_blocks, _BLOCKS), "blocks")

    held = blocks.select("block", "lang", F.explode(F.arrays_zip("terms", "freqs")).alias("x")).select("block", "lang", F.col("x.terms").alias("term"), F.col("x.freqs").alias("freq"))
    kept = held.groupBy("lang", "term").agg(F.sum("freq").alias("freq")).where(F.col("freq") >= LEAST).select("lang", "term")
    kept = scratch.write(kept.withColumn("id", F.monotonically_increasing_id()), "kept")
    asked = scratch.write(held.select("block", "lang", "term").join(kept, ["lang", "term"]).groupBy("block").agg(F.collect_list(F.struct("term", "id")).alias("terms")), "asked")
    here = blocks.select("block", "lang", F.posexplode("sources").alias("at", "source"))
    groups = scratch.write(here.select("lang", "source").distinct().withColumn("gid", F.monotonically_increasing_id()), "groups")
    named = here.join(checked_side(groups), ["lang", "source"]).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "gid"))).alias("groups"))
    found = blocks.select("block", "sizes", "text").join(asked, "block").join(named, "block").select("sizes", "text", "terms", "groups").mapInArrow(_recount, "id long, gid long, n long")
    counts = scratch.write(found.groupBy("id", "gid").agg(F.sum("n").alias("n")), "counts")
    scratch.drop(asked)

    totals = groups.join(counts.groupBy("gid").agg(F.sum("n").alias("total")), "gid", "left").join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left")
    totals = totals.select("gid", "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    totals = scratch.write(totals.select("*", _share(F.lit(0), F.col("total"), F.col("v")).alias("p0")), "totals")
    langs = scratch.write(totals.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.max("v").alias("lang_v"), F.collect_list(F.struct("source", "p0")).alias("others")), "langs")

    shares = counts.join(checked_side(totals), "gid").select("id", "source", "n", "p0", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    posts = shares.groupBy("id").agg(F.sum("n").alias("n"), F.collect_list(F.struct("source", "p", "p0")).alias("posts")).join(kept, "id")
    posts = posts.join(checked_side(langs.select("lang", "lang_total", "lang_v")), "lang").select("lang", "term", "posts", _share(F.col("n"), F.col("lang_total"), F.col("lang_v")).alias("q"))
    posts = scratch.write(posts, "postings")
    scratch.drop(counts)

    over = posts.select("lang", "term", "q", F.explode("posts").alias("x")).where("x.p > q")
    over = over.select("lang", F.col("x.source").alias("source"), F.col("term").alias("item"), F.expr("((x.p - q) * (x.p - q)) div q").alias("value"))
    first = Window.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(SALTS))).orderBy(F.desc("value"), "item")
    over = over.select("*", F.row_number().over(first).alias("place")).where(F.col("place") <= RANKS).drop("place")

    hist = posts.select("lang", F.explode("posts").alias("x")).groupBy("lang", F.col("x.source").alias("source"), F.col("x.p").alias("p")).agg(F.count("*").alias("n"))
    hist = hist.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("hist"))
    single = totals.join(hist, ["lang", "source"], "left").join(langs.select("lang", "others"), "lang")
    single = single.select("lang", "source", "v", "p0", "hist", "others").mapInArrow(_single_terms, "lang string, source string, other string, value long")
    both = posts.select("lang", "posts").mapInArrow(_common_terms, "lang string, source string, other string, value long")
    pairs = single.unionByName(both).groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))

    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    out = [x.select("lang", "source", F.lit(part).alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked)) for part, x in (("pair", pairs), ("term", over))]
    return out[0].unionByName(out[1].where(F.col("rank") <= RANKS))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


QUERIES = {"op11_source_divergence": op11_source_divergence}
ORACLE = {"op11_source_divergence": r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    unnest(list_concat(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), [NULL])) AS term
  FROM documents),
kept AS (SELECT lang, term FROM docs WHERE term IS NOT NULL GROUP BY lang, term HAVING count(DISTINCT d) >= 3),
occurs AS (SELECT lang, source, term, count(*) AS n FROM docs JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) AS total, coalesce(max(v), 0) AS v
  FROM (SELECT DISTINCT lang, source FROM docs) AS g LEFT JOIN occurs USING (lang, source) LEFT JOIN sizes ON sizes.lang = g.lang GROUP BY ALL),
langs AS (SELECT lang, sum(total) AS total FROM groups GROUP BY lang),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, (1 + 1000000000 * (coalesce(o.n, 0) + 1)::HUGEINT // (g.total + g.v))::HUGEINT AS p
  FROM groups AS g JOIN kept AS k ON k.lang = g.lang LEFT JOIN occurs AS o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
whole AS (
  SELECT s.lang, s.term, (1 + 1000000000 * (sum(s.n) + 1)::HUGEINT // (l.total + v))::HUGEINT AS q
  FROM shares AS s JOIN langs AS l USING (lang) JOIN sizes USING (lang) GROUP BY s.lang, s.term, l.total, v),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value
  FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
    FROM shares AS x JOIN shares AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) AS f
  ON f.lang = a.lang AND f.source = a.source AND f.other = b.source),
terms AS (SELECT s.lang, s.source, s.term AS item, (p - q) * (p - q) // q AS value FROM shares AS s JOIN whole AS w USING (lang, term) WHERE s.n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""}
