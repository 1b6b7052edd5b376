"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order (largest inner product with the pivots, which have unit
length; the first ``places`` of them). Vectors are dealt to the files of their first pivots, in chunks of a bounded size, and
inside a chunk each vector is posted, with its place, in the inverted list of every pivot of its representation. A query visits the
files in the order of its own pivots. In each chunk the lists of the query's pivots give the footrule distance to
all of the chunk (pivots outside a representation count as the place after the last), the best by footrule are
ranked again by the inner product on the original vectors, in double precision, added up from the first component to the
last; the best of all visited chunks are merged.

How many files a query visits and how many rows of a chunk are ranked again is found out for the data at hand:
``PROBES`` query rows, a fixed number, are compared with every vector, and the smallest numbers are taken with which these queries
find ``COVERED`` and ``FOUND`` of their true neighbours, copies of their own vectors among these, and nearly each of them at least ``LEAST`` of its own. Pivots are a bounded sample of the distinct vectors (those with the smallest hashes,
about the square root of their number, ``PIVOTS`` at most, ``PIVOT_BYTES`` at most); every vector is indexed.

Equal vectors are one entry with their smallest ids, no more than a result can show, so a vector that stands in a third of
all rows is searched and compared once; the queries among its rows share the result and leave out themselves. The entry of a
query's own vector is always ranked again, however many others have its representation, and its file is visited first.
Chunks bound what one task sees of a file, slices bound the queries that meet a chunk. Pairs of all queries and all vectors are
never rows: what leaves a chunk is one row a query with its best.

Vectors that are null, zero, of length 0 or hold null or non-finite components take no part, nor do rows without id and
rows whose vectors differ in length from most. Equal rows count once. Where one id has several vectors, each is a candidate, and a query with several has a list for
each; rows of the query's own id are never among its neighbours. Fewer candidates than asked for are all returned. An empty
table gives no row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from foliospark.llm._common import Scratch, shuffle_partitions, table

NEAREST = 20
#: A row in this many is a query.
EVERY = 20
PIVOTS, PIVOT_BYTES = 4096, 64 << 20
#: Places of a representation: a quarter of the pivots, within these bounds.
PLACES = (8, 64)
#: Rows of a chunk, and queries that meet it in one task.
CHUNK_ROWS, SLICE_ROWS = (256, 8192), 4096
#: Queries whose true neighbours are looked up, and the shares of these that visited files must hold and that must be found.
PROBES, COVERED, FOUND = 128, 0.97, 0.955
#: What a single one of these must find, and the shares of them for which visited files must hold, and give, so much.
LEAST, HELD, SURE = 0.9, 0.98, 0.95
#: Numbers that a task holds at a time while it compares queries with a chunk.
CELLS = 2 << 20


def pivot_count(n: int, width: int) -> int:
    """A power of two near the square root of ``n``."""
    return max(1, min(n, max(16, 1 << round(np.log2(max(n, 2)) / 2)), PIVOTS, PIVOT_BYTES // (8 * width)))


def matrix(col: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products over the last axis, added up from the first component to the last, so that every run gives the same double."""
    return np.cumsum(a * b, axis=-1)[..., -1] + 0.0


def ordered_pivots(vectors: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """The nearest pivots of each vector in order; ties go to the smaller number."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :places]


def footrule(queries: np.ndarray, rows: np.ndarray, n_pivots: int) -> np.ndarray:
    """How near each query's representation is to each row's: ``places * (places + 1)`` minus the footrule distance, halved.

    A pivot that both hold adds the places that are left after the later of its two places; others add nothing.
    The rows' inverted lists are walked pivot by pivot.
    """
    places = rows.shape[1]
    out = np.zeros((len(queries), len(rows)), np.int32)
    lists = []
    for x in (queries, rows):
        order = np.argsort(x.ravel(), kind="stable")
        lists.append((order // places, order % places, np.searchsorted(x.ravel()[order], np.arange(n_pivots + 1))))
    (q_row, q_place, q_cut), (r_row, r_place, r_cut) = lists
    for p in np.flatnonzero((np.diff(q_cut) > 0) & (np.diff(r_cut) > 0)).tolist():
        a, b = slice(q_cut[p], q_cut[p + 1]), slice(r_cut[p], r_cut[p + 1])
        out[np.ix_(q_row[a], r_row[b])] += (places - np.maximum(q_place[a, None], r_place[None, b])).astype(np.int32)
    return out


class Chunk:
    """A chunk of a pivot's file: vectors, representations, and the ids of each distinct vector in order."""

    def __init__(self, batch: pa.RecordBatch, i: int, places: int):
        self.first = batch.column("firsts")[i].values.to_numpy()
        self.vectors = np.frombuffer(batch.column("vectors")[i].as_py(), np.float64).reshape(len(self.first), -1)
        self.pivots = np.frombuffer(batch.column("pivots")[i].as_py(), np.uint16).reshape(-1, places)
        self.ids = batch.column("ids")[i].values
        self.at = {v.tobytes(): r for r, v in enumerate(self.vectors)}

    def keys(self, queries: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Keys that are largest for the rows nearest by footrule: a query's own vector first, ties go to the row that comes first."""
        n = len(self.first)
        key = near.astype(np.int64) * n + np.arange(n - 1, -1, -1)
        for q, v in enumerate(queries):
            own = self.at.get(v.tobytes())
            if own is not None:
                key[q, own] = 1 << 62
        return key

    def best(self, queries: np.ndarray, near: np.ndarray, again: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and inner products of the ``NEAREST + 1`` best among the ``again`` rows nearest by footrule."""
        n = len(self.first)
        key, again = self.keys(queries, near), min(n, again)
        rows = np.argpartition(-key, again - 1, axis=1)[:, :again] if again < n else np.broadcast_to(np.arange(n), key.shape)
        score = inner(self.vectors[rows], queries[:, None, :])
        order = np.lexsort((self.first[rows], -score), axis=-1)[:, : NEAREST + 1]
        return np.take_along_axis(rows, order, 1), np.take_along_axis(score, order, 1)

    def hits(self, rows: np.ndarray, scores: np.ndarray) -> list[dict]:
        """The first ids of one query's rows: score descending, id ascending."""
        out = [(-s, i) for r, s in zip(rows.tolist(), scores.tolist(), strict=True) for i in self.ids[r].as_py()]
        return [{"away": a + 0.0, "id": i} for a, i in sorted(out)[: NEAREST + 1]]


_CHUNKS = "file int, chunk int, firsts array<long>, vectors binary, pivots binary, ids array<array<long>>"
_HITS = "class long, hits array<struct<away: double, id: long>>"
_HIT_TYPE = pa.list_(pa.struct([("away", pa.float64()), ("id", pa.int64())]))


def _code(pivots: np.ndarray, places: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = ordered_pivots(matrix(b.column("embedding")), pivots, places).astype(np.uint16)
                cols = [*b.columns, pa.array([x.tobytes() for x in near], pa.binary()), pa.array(near[:, 0], pa.int32())]
                yield pa.record_batch(cols, names=[*b.schema.names, "pivots", "file"])

    return run


def _pack(key: tuple, group: pa.Table) -> pa.Table:
    """A chunk as one row, its vectors in the order of their first ids."""
    group = group.sort_by([("first", "ascending"), ("h", "ascending")]).combine_chunks()
    vectors = matrix(group.column("embedding").combine_chunks())
    row = [key[0].as_py(), key[1].as_py(), group.column("first").to_pylist(), vectors.tobytes(), b"".join(group.column("pivots").to_pylist()), group.column("ids").to_pylist()]
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
    return pa.table([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=[f.split(" ")[0] for f in _CHUNKS.split(", ")])


def _visit(pivots: np.ndarray, rows_in: np.ndarray, visits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The files that each query visits: ``visits`` of those that have rows, and as many more as hold the neighbours asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                order = ordered_pivots(matrix(b.column("embedding")), pivots, len(pivots))
                files = []
                for x, coded in zip(order, b.column("pivots").to_pylist(), strict=True):
                    own = np.frombuffer(coded, np.uint16, 1)
                    x = np.concatenate((own, x[(rows_in[x] > 0) & (x != own)])).astype(np.int64)
                    enough = int(np.searchsorted(np.cumsum(rows_in[x]), NEAREST + 1)) + 1
                    files.append(x[: max(visits, enough)].tolist())
                yield pa.record_batch([*b.columns, pa.array(files, pa.list_(pa.int32()))], names=[*b.schema.names, "files"])

    return run


def _scan(places: int, n_pivots: int, again: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, chunks: pa.Table) -> pa.Table:
        found: list[list[dict]] = []
        if queries.num_rows and chunks.num_rows:
            chunk = Chunk(chunks.combine_chunks().to_batches()[0], 0, places)
            vectors = matrix(queries.column("embedding").combine_chunks())
            near = np.frombuffer(b"".join(queries.column("pivots").to_pylist()), np.uint16).reshape(-1, places)
            step = max(1, CELLS // max(len(chunk.first), min(again, len(chunk.first)) * vectors.shape[1]))
            for at in range(0, len(vectors), step):
                some = vectors[at : at + step]
                rows, scores = chunk.best(some, footrule(near[at : at + step], chunk.pivots, n_pivots), again)
                found += map(chunk.hits, rows, scores)
        asked = queries.column("class") if found else pa.array([], pa.int64())
        return pa.table([asked, pa.array(found, _HIT_TYPE)], names=["class", "hits"])

    return run


def _probe(queries: np.ndarray, own: list[int], near: np.ndarray, turn: np.ndarray, places: int, n_pivots: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each probe and chunk: the true best of the chunk, the turn at which the probe visits its file, and their ranks by footrule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                chunk, out = Chunk(b, i, places), []
                for q in range(len(queries)):
                    foot = footrule(near[q : q + 1], chunk.pivots, n_pivots)
                    rows, scores = chunk.best(queries[q : q + 1], foot, len(chunk.first))
                    rank = np.empty(len(chunk.first), np.int64)
                    rank[np.argsort(-chunk.keys(queries[q : q + 1], foot)[0])] = np.arange(len(rank))
                    when = int(turn[q, b.column("file")[i].as_py()])
                    hits = [(-s, i, when, int(rank[r])) for r, s in zip(rows[0].tolist(), scores[0].tolist(), strict=True) for i in chunk.ids[r].as_py() if i != own[q]]
                    out.append([dict(zip(("away", "id", "turn", "rank"), x, strict=True)) for x in sorted(hits)[:NEAREST]])
                kind = pa.list_(pa.struct([("away", pa.float64()), ("id", pa.int64()), ("turn", pa.int32()), ("rank", pa.int32())]))
                yield pa.record_batch([pa.array(range(len(queries)), pa.int32()), pa.array(out, kind)], names=["probe", "hits"])

    return run


def _merged(best: DataFrame, key: str) -> DataFrame:
    return best.groupBy(key).agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, NEAREST + 1).alias("hits"))


def _enough(needed: np.ndarray, probe: np.ndarray, all_of: float, most: float) -> int:
    """The smallest number at which ``all_of`` the neighbours are reached, and ``LEAST`` of each probe's own for ``most`` of the probes; ``needed`` says from which number on one is."""
    each = [np.sort(needed[probe == p]) for p in np.unique(probe)]
    each = np.sort([x[int(np.ceil(LEAST * len(x))) - 1] for x in each])
    quantile = lambda x, share: x[int(np.ceil(share * len(x))) - 1]
    return int(max(quantile(np.sort(needed), all_of), quantile(each, most)))


def _tuned(probed: DataFrame) -> tuple[int, int]:
    """Visits and rows ranked again; the fixed number of probes keeps what comes to the driver small."""
    true = _merged(probed, "probe").select("probe", F.explode(F.slice("hits", 1, NEAREST)).alias("x"))
    seen = np.array([tuple(r) for r in true.select("probe", "x.turn", "x.rank").collect()], np.int64).reshape(-1, 3)
    if not len(seen):
        return 1, NEAREST + 1
    probe, turn, rank = seen.T
    visits = _enough(turn + 1, probe, COVERED, HELD)
    return visits, max(NEAREST + 1, _enough(np.where(turn < visits, rank + 1, 1 << 40), probe, FOUND, SURE))


def nearest(vectors: DataFrame, is_query: Column, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``NEAREST`` rows with the largest inner product, for each row where ``is_query`` holds."""
    spark = vectors.sparkSession
    scratch, parts = Scratch(spark, "permutation-index"), shuffle_partitions(spark)
    x = F.col("embedding")
    usable = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("embedding"), is_query.alias("asks")).where(F.col("vec_id").isNotNull() & usable)
    width = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = width.width
    kind = vectors.schema[column].dataType.elementType
    rows = rows.where(F.size("embedding") == width).withColumn("embedding", F.transform("embedding", lambda v: (v + F.lit(0).cast(kind)).cast(kind)))  # no negative zero
    rows = scratch.write(rows.dropDuplicates(["vec_id", "embedding"]).withColumn("h", F.xxhash64("embedding")), "rows")

    equal = Window.partitionBy("h", "embedding").orderBy("vec_id")
    few = rows.select("vec_id", "embedding", "h", F.row_number().over(equal).alias("n")).where(F.col("n") <= NEAREST + 1)
    classes = scratch.write(few.groupBy("h", "embedding").agg(F.min("vec_id").alias("first"), F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("class", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("h"), "first", "h").limit(pivot_count(n, width)).select("embedding").collect()
    pivots = np.array([r.embedding for r in sample], np.float64)
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    n_pivots = len(pivots)
    places = min(n_pivots, max(PLACES[0], min(PLACES[1], n_pivots // 4)))
    element = kind.simpleString()
    named = classes.select("class", "first", "h", "ids", "embedding")
    coded = scratch.write(named.mapInArrow(_code(pivots, places), f"class long, first long, h long, ids array<long>, embedding array<{element}>, pivots binary, file int"), "coded")

    size = max(CHUNK_ROWS[0], min(CHUNK_ROWS[1], n // (2 * parts)))
    rows_in = np.zeros(n_pivots, np.int64)
    for r in coded.groupBy("file").count().collect():  # a row for each pivot
        rows_in[r.file] = r["count"]
    in_file = -(-rows_in // size)
    dealt = spark.createDataFrame([(p, int(c)) for p, c in enumerate(in_file) if c], "file int, chunks int")
    chunked = coded.join(F.broadcast(dealt), "file").withColumn("chunk", F.pmod(F.col("h"), F.col("chunks")).cast("int"))
    chunks = scratch.write(chunked.select("file", "chunk", "first", "h", "ids", "embedding", "pivots").groupBy("file", "chunk").applyInArrow(_pack, _CHUNKS), "chunks")

    members = scratch.write(rows.where("asks").select("vec_id", "h", "embedding").join(classes.select("h", "embedding", "class"), ["h", "embedding"]).select(F.col("vec_id").alias("query_id"), "class"), "members")
    asked = scratch.write(coded.join(members.select("class").distinct(), "class", "left_semi").select("class", "first", "h", "embedding", "pivots"), "asked")
    drawn = members.orderBy(F.xxhash64("query_id"), "query_id", "class").limit(PROBES)
    probes = asked.join(drawn, "class").orderBy("query_id", "class").collect()
    if not probes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tried, near = np.array([r.embedding for r in probes], np.float64), np.frombuffer(b"".join(r.pivots for r in probes), np.uint16).reshape(-1, places)
    order, turn = ordered_pivots(tried, pivots, n_pivots), np.zeros((len(probes), n_pivots), np.int64)
    for q, files in enumerate(order):
        files = files[(rows_in[files] > 0) & (files != near[q, 0])]
        turn[q, files] = np.arange(1, len(files) + 1)
    probed = chunks.mapInArrow(_probe(tried, [r.query_id for r in probes], near, turn, places, n_pivots), "probe int, hits array<struct<away: double, id: long, turn: int, rank: int>>")
    visits, again = _tuned(probed)

    routed = asked.mapInArrow(_visit(pivots, rows_in, visits), f"class long, first long, h long, embedding array<{element}>, pivots binary, files array<int>")
    routed = scratch.write(routed, "routed")
    visited = routed.select("class", "embedding", "pivots", F.explode("files").alias("file"))
    slices = [(r.file, int(in_file[r.file]), -(-r["count"] // SLICE_ROWS)) for r in visited.groupBy("file").count().collect()]  # a row for each pivot
    slices = F.broadcast(spark.createDataFrame(slices, "file int, chunks int, slices int"))
    visited = visited.join(slices, "file").withColumn("slice", F.pmod(F.xxhash64("class"), F.col("slices")).cast("int"))
    visited = visited.select("file", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "slice", "class", "embedding", "pivots")
    ready = chunks.join(slices.select("file", "slices"), "file").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    best = visited.groupBy("file", "chunk", "slice").cogroup(ready.groupBy("file", "chunk", "slice")).applyInArrow(_scan(places, n_pivots, again), _HITS)
    best = scratch.write(_merged(best, "class"), "best")

    own = members.join(best, "class").select("query_id", F.slice(F.filter("hits", lambda v: v["id"] != F.col("query_id")), 1, NEAREST).alias("hits"))
    return own.select("query_id", F.posexplode("hits").alias("place", "x")).select("query_id", (F.col("place") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.away") + F.lit(0.0)).alias("score"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


QUERIES = {"op13_nearest_neighbours": op13_nearest_neighbours}
#: Approximate, so SQL does not give its rows; ``tests/llm/test_selection.py`` measures recall against brute force.
ORACLE: dict[str, str] = {}
