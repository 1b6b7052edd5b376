"""Near duplicates by a Jaccard join on word shingles with adaptive multi-match prefixes.

A document's set holds its distinct 5-word shingles. Sets are similar when
``100 * |intersection| >= 80 * |union|``; then each shares all but a fifth of its own
shingles with the other. With any fixed order of shingles, two similar sets therefore
share at least ``l`` shingles among the first ``size // 5 + l`` of each, for every ``l``.

Steps, none of which holds one key's rows in a task:

1. One pass over the texts writes blocks: each document's set size, set fingerprint and
   those shingles whose hash lies below a fixed bound (a quarter of all; the smallest
   hashes of short documents beyond it). Each block sends its distinct shingles once,
   already counted, and learns which of them occur in other documents too. A document
   stays only if enough of its quarter does, which few do.
2. For the documents that stay, whole sets are counted in the same way, and the order
   is by document frequency: the rarest shingles come first.
3. Each document picks its own prefix length ``l`` by estimated cost: longer prefixes
   read longer lists, but candidates must then share ``l`` shingles before they are verified.
4. Links are needed only between components. Rounds of verified pairs with one leader
   per shingle list join large groups of near copies in linear work, as long as they
   save pairs. Then the pairs of different components that are left are tested: within
   groups of long lists by an inverted index, block by block, without a row for each
   pair; from short lists by a join with the multi-match test. Nothing is capped.

Equal sets are one node from the start. Null or blank texts have no shingle and are linked
with nothing; with fewer than five words the whole sequence is the one shingle. Repeated
rows get the same component. Rows without an id are counted; they share the component of equal texts
that have one and are held against no other text. A very long text is one set, held in memory whole. An empty table gives no row; other columns are
not read. Nodes are 64-bit fingerprints of sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm._common import Scratch, byte_list, checked_side, chunks, doc_text, freed, shuffle_partitions, table
from foliospark.llm.components import connected_components

WORDS = 5
FRONT = np.uint64(1 << 62)  # the first pass looks at the shingles below
BLOCK_TOKENS = 250_000
PART_SHINGLES = 2_000_000  # of blocks, that one part counts, at most about
VERIFY_COST = 30  # verifying a pair costs so many list entries
MAX_ROUNDS = 3
#: Longer shingle lists are settled in groups, without a row for each pair.
LONG_LIST = 64
#: Shingles of a block of such a group; a task holds two blocks.
GROUP_TOKENS = 400_000
_PRIME, _ODD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.arange(1, 65, dtype=np.uint64) * _ODD


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
            self.up, self.down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, b)))) for b in (_PRIME, inverse))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, split at ASCII white space) and the number of words of each text."""
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).view(np.int8)))
    start, stop = edge[::2], edge[1::2]
    up, down = _POWERS.upto(len(data) + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)))
    words = _mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64) * _ODD)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return words, np.diff(np.concatenate(([0], np.searchsorted(start, ends))))


def shingle_sets(texts: list[bytes], width: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    if not texts:
        return []
    words, counts = word_hashes(texts)
    grams = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        grams = _mix(grams + words[k : k + len(grams)] + _STEPS[k])
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            g = np.sort(grams[at : at + n - width + 1])
            out.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
        elif n:
            h = np.zeros(1, np.uint64)
            for k in range(n):
                h = _mix(h + words[at + k : at + k + 1] + _STEPS[k])
            out.append(_mix(h + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def fingerprint(sets: np.ndarray) -> int:
    """Signed 64-bit fingerprint of a sorted set."""
    return int.from_bytes(hashlib.blake2b(sets.tobytes(), digest_size=8).digest(), "little", signed=True)


def _spare(n: int) -> int:
    """Shingles of a set of n that a similar set may lack."""
    return n // 5


def _make_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, seq = TaskContext.get().partitionId(), 0
    names = ["block", "ids", "nodes", "n", "first", "kept", "grams"]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.large_binary()]

    def flush() -> pa.RecordBatch:
        row = [task << 32 | seq, ids, nodes, sizes, first, kept, np.concatenate(grams).tobytes() if grams else b""]
        return pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=names)

    ids, nodes, sizes, first, kept, grams, seen, held = [], [], [], [], [], [], set(), 0
    for b in chunks(batches, 1 << 20):
        ids += b.column("doc_id").to_pylist()
        for s in shingle_sets(byte_list(b.column("text"))):
            node, n = fingerprint(s), len(s)
            if n > 3 and node not in seen:  # smaller sets are similar to equal ones only
                seen.add(node)
                k = min(n, max(int(np.searchsorted(s, FRONT)), _spare(n) + 1))
                first.append(len(nodes))
                kept.append(k)
                grams.append(s[:k])
                held += k
            nodes.append(node)
            sizes.append(n)
        if held > BLOCK_TOKENS or len(ids) > 10_000:
            yield flush()
            seq += 1
            ids, nodes, sizes, first, kept, grams, seen, held = [], [], [], [], [], [], set(), 0
    if ids:
        yield flush()


def _frequencies(blocks: DataFrame) -> DataFrame:
    """``block, grams, df``: for each block those of its shingles that occur in two sets or more; the number of parts grows with the shingles."""
    held = F.aggregate("kept", F.lit(0).cast("long"), lambda total, k: total + k)
    parts = max(shuffle_partitions(blocks.sparkSession), int(blocks.agg(F.coalesce(F.sum(held), F.lit(0)).alias("n")).first().n) // PART_SHINGLES + 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, raw in zip(b.column("block").to_pylist(), b.column("grams").to_pylist(), strict=True):
                grams, counts = np.unique(np.frombuffer(raw, np.uint64), return_counts=True)
                part = ((grams & np.uint64(0xFFFFFFFF)) * np.uint64(parts)) >> np.uint64(32)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
                grams, counts = grams[order], counts[order].astype(np.uint32)
                for at in range(0, parts, 256):
                    some = [p for p in range(at, min(parts, at + 256)) if cuts[p] < cuts[p + 1]]
                    cols = [[block] * len(some), some, [grams[cuts[p] : cuts[p + 1]].tobytes() for p in some], [counts[cuts[p] : cuts[p + 1]].tobytes() for p in some]]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "part", "grams", "counts"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(b.column("block")[i].as_py(), np.frombuffer(b.column("grams")[i].as_py(), np.uint64), np.frombuffer(b.column("counts")[i].as_py(), np.uint32)) for b in batches for i in range(b.num_rows)]
        if not rows:
            return
        every, counts = np.concatenate([g for _, g, _ in rows]), np.concatenate([c for _, _, c in rows])
        order = np.argsort(every, kind="stable")
        every, counts = every[order], counts[order].astype(np.int64)
        head = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        df = np.add.reduceat(counts, head)
        often = df > 1
        shared, df = every[head[often]], df[often]
        del every, counts, order
        for block, grams, _ in rows:
            at = np.searchsorted(shared, grams)
            at[at == len(shared)] = 0
            hit = np.flatnonzero(shared[at] == grams) if len(shared) else np.zeros(0, np.int64)
            if len(hit):
                yield pa.record_batch([pa.array([block], pa.int64()), pa.array([grams[hit].tobytes()], pa.binary()), pa.array([np.minimum(df[at[hit]], 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], names=["block", "grams", "df"])

    sent = blocks.select("block", "grams").mapInArrow(freed(send), "block long, part int, grams binary, counts binary")
    back = sent.repartitionById(parts, F.col("part")).mapInArrow(freed(add_up), "block long, grams binary, df binary")
    return back.groupBy("block").agg(F.collect_list(F.struct("grams", "df")).alias("shared"))


def choose_prefix(df: np.ndarray, spare: int) -> int:
    """The number l of shared shingles to ask for: list entries of the prefix, and candidates (at most entries / l) to verify."""
    lists = np.cumsum(df - 1.0)[spare:]
    level = np.arange(1, len(lists) + 1)
    return int(np.argmin(lists * (1 + VERIFY_COST / level))) + 1


def _with_frequencies(blocks: DataFrame, shared: DataFrame, each: Callable, schema: str) -> DataFrame:
    """Runs ``each(row, frequencies of the row's shingles)``, which gives rows, over the blocks that share any shingle."""
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = KINDS[schema]
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i] for c in b.schema.names}
                grams = np.frombuffer(row["grams"].as_buffer(), np.uint64)
                told = row["shared"].as_py()
                often = np.concatenate([np.frombuffer(x["grams"], np.uint64) for x in told])
                times = np.concatenate([np.frombuffer(x["df"], np.uint32) for x in told]).astype(np.int64)
                order = np.argsort(often)
                often, times = often[order], times[order]
                at = np.minimum(np.searchsorted(often, grams), len(often) - 1)
                df = np.where(often[at] == grams, times[at], 1)
                out, stop = [], 0
                for place, k in zip(row["first"].as_py(), row["kept"].as_py(), strict=True):
                    got = each(row["nodes"][place].as_py(), row["n"][place].as_py(), grams[stop : stop + k], df[stop : stop + k])
                    out += [got] if got else []
                    stop += k
                for start in range(0, len(out), 2000):
                    cols = list(zip(*out[start : start + 2000], strict=True))
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return blocks.select("block", "nodes", "n", "first", "kept", "grams").join(shared, "block").mapInArrow(freed(run), schema)


KINDS = {
    "node long": (pa.int64(),),
    "node long, n int, l int, grams array<long>, levels array<int>": (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())),
}


def _stays(node: int, n: int, grams: np.ndarray, df: np.ndarray) -> tuple | None:
    return (node,) if (df > 1).sum() >= len(grams) - _spare(n) else None


def _prefix(node: int, n: int, grams: np.ndarray, df: np.ndarray) -> tuple | None:
    """Node, size, l, and the shingles of the prefix that occur elsewhere with the smallest l whose prefix holds them."""
    spare = _spare(n)
    if (df > 1).sum() < n - spare:
        return None
    by = np.lexsort((grams, df))
    grams, df = grams[by], df[by]
    want = choose_prefix(df.astype(float), spare)
    use = np.flatnonzero(df[: spare + want] > 1)
    return node, n, want, grams[use].view(np.int64), np.maximum(1, use + 1 - spare)


def _full_blocks(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Blocks with the whole sets of the wanted documents (``doc_id, node``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seq, nodes, sizes, grams, held = TaskContext.get().partitionId(), 0, [], [], [], 0
        for b in chain(chunks(batches, 1 << 20), [None]):
            for node, s in zip(b.column("node").to_pylist(), shingle_sets(byte_list(b.column("text"))), strict=True) if b else ():
                if fingerprint(s) == node:
                    nodes.append(node)
                    sizes.append(len(s))
                    grams.append(s)
                    held += len(s)
            if nodes and (b is None or held > BLOCK_TOKENS):
                row = [task << 32 | seq, nodes, sizes, list(range(len(nodes))), sizes, np.concatenate(grams).tobytes()]
                kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3, pa.binary()]
                yield pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["block", "nodes", "n", "first", "kept", "grams"])
                seq, nodes, sizes, grams, held = seq + 1, [], [], [], 0

    return doc_text(docs).join(checked_side(wanted), "doc_id").select("node", "text").mapInArrow(freed(run), "block long, nodes array<long>, n array<int>, first array<int>, kept array<int>, grams binary")


def _sets_of(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, grams``: the sets of the given nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                raw, ends = b.column("grams")[i].as_buffer(), np.cumsum([0, *b.column("n")[i].as_py()]) * 8
                ids = b.column("nodes")[i].values
                for at in range(0, len(ids), 1000):
                    cut = ends[at : at + 1001]
                    yield pa.record_batch([ids.slice(at, 1000), pa.array([raw[x:y].to_pybytes() for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["node", "grams"])

    return blocks.select("nodes", "n", "grams").mapInArrow(freed(run), "node long, grams binary").join(checked_side(nodes), "node", "left_semi")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (``u, v``) whose whole sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("gu"), b.column("gv"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                common = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                ok.append(100 * common >= 80 * (len(p) + len(q) - common))
            yield pa.record_batch([b.column("u"), b.column("v")], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    left = sets.select(F.col("node").alias("u"), F.col("grams").alias("gu"))
    right = sets.select(F.col("node").alias("v"), F.col("grams").alias("gv"))
    return pairs.join(left, "u").join(right, "v").mapInArrow(freed(run), "u long, v long")


def _settle_group(rows: pa.Table) -> pa.Table:
    """Links that join the components among the rows (``node, label, grams``), found by an inverted index over their sets."""
    order = np.argsort(rows.column("node").to_numpy())
    rows = rows.take(pa.array(order))
    nodes, raw = rows.column("node").to_numpy(), rows.column("grams").combine_chunks()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in raw]
    n = np.array([len(x) for x in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), n)
    by = np.argsort(every, kind="stable")
    every, owner = every[by], owner[by]
    _, label = np.unique(rows.column("label").to_numpy(), return_inverse=True)
    largest = np.bincount(label).argmax()
    out = []
    for x in np.flatnonzero(label != largest):  # of any pair to be tested one at least is outside the largest component
        reach = (100 * np.minimum(n, n[x]) >= 80 * np.maximum(n, n[x])) & (label != label[x])
        if not reach.any():
            continue
        lo, hi = np.searchsorted(every, sets[x], "left"), np.searchsorted(every, sets[x], "right")
        common = np.bincount(np.concatenate([owner[a:b] for a, b in zip(lo, hi, strict=True)]), minlength=len(n))
        for y in np.flatnonzero(reach & (100 * common >= 80 * (n + n[x] - common))):
            if label[y] != label[x]:
                out.append((nodes[x], nodes[y]))
                label[label == label[y]] = label[x]
    return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})


def _long_lists(own: DataFrame, sets: DataFrame, scratch: Scratch, rows: int) -> tuple[DataFrame, DataFrame]:
    """Links from the long lists, and ``node, hot`` (the group of lists that a node is in).

    Lists that share a document form a group. A group's sets are dealt into blocks of
    bounded size, each pair of blocks is one task, and a task returns only links that
    join components, so no pair becomes a row.
    """
    long = own.where(F.col("k") > LONG_LIST)
    member = long.join(long.groupBy("gram").agg(F.min("node").alias("head")), "gram").select(F.col("node").alias("u"), F.col("head").alias("v")).distinct()
    hot = scratch.write(connected_components(member, scratch, rows).withColumnRenamed("label", "hot"), "hot", rows)
    inside = hot.join(own.groupBy("node").agg(F.first("label").alias("label"), F.first("n").alias("n")), "node")
    size = inside.groupBy("hot").agg(F.ceil(F.sum("n") / GROUP_TOKENS).cast("long").alias("blocks"), F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("hot", "blocks")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: (F.col("blocks") == 1) | (j != F.col("block"))))
    dealt = inside.join(size, "hot").withColumn("block", block).withColumn("j", other)
    dealt = dealt.select("hot", F.least("block", "j").alias("i"), F.greatest("block", "j").alias("j"), "node", "label").join(sets, "node")
    return dealt.groupBy("hot", "i", "j").applyInArrow(lambda t: _settle_group(t.select(["node", "label", "grams"])), "u long, v long"), hot


_LENGTHS = "100 * least(n, n2) >= 80 * greatest(n, n2)"


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row; the component is the smallest ``doc_id`` reachable by links."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shingle-join")
    blocks = scratch.write(doc_text(docs).mapInArrow(freed(_make_blocks), "block long, ids array<long>, nodes array<long>, n array<int>, first array<int>, kept array<int>, grams binary"), "blocks")
    rows = blocks.select(F.explode(F.arrays_zip("ids", "nodes", "n")).alias("d")).select(F.col("d.ids").alias("doc_id"), F.col("d.nodes").alias("node"), F.col("d.n").alias("n"))
    classes = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    staying = _with_frequencies(blocks, _frequencies(blocks), _stays, "node long").distinct()
    wanted = scratch.write(classes.join(staying, "node", "left_semi").select("doc_id", "node"), "staying")
    full = scratch.write(_full_blocks(docs, wanted), "full")
    prefixes = scratch.write(_with_frequencies(full, _frequencies(full), _prefix, "node long, n int, l int, grams array<long>, levels array<int>").dropDuplicates(["node"]), "prefixes")
    post = prefixes.select("node", "n", "l", F.explode(F.arrays_zip("grams", "levels")).alias("g")).select("node", "n", "l", F.col("g.grams").alias("gram"), F.col("g.levels").alias("level"))
    lists = post.groupBy("gram").agg(F.count("*").alias("held")).where("held > 1")
    post = scratch.write(post.join(lists.select("gram"), "gram", "left_semi"), "post")
    size = post.count()
    sets = scratch.write(_sets_of(full, scratch.write(post.select("node").distinct(), "nodes", size)), "sets")
    scratch.drop(full)

    links, labels, cost = spark.createDataFrame([], "u long, v long"), None, None
    for turn in range(MAX_ROUNDS + 1):
        own = post.withColumn("label", F.col("node")) if labels is None else post.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        open_ = own.groupBy("gram", "label").agg(F.count("*").alias("c")).groupBy("gram").agg(F.sum("c").alias("k"), F.sum(F.col("c") * F.col("c")).alias("same")).where("k * k > same")
        own = scratch.write(own.join(open_, "gram"), "own", size)
        left = own.agg(F.coalesce(F.sum((F.col("k") - F.col("same") / F.col("k")) / 2), F.lit(0.0)).alias("pairs")).first().pairs  # each of a list's k rows has its share
        if not left:
            break
        settle = turn == MAX_ROUNDS or left <= 2 * size or (cost is not None and left > 0.8 * cost)
        cost = left
        if settle:
            joined, hot = _long_lists(own, sets, scratch, size)
            links = scratch.write(links.unionByName(joined), "links", size)
            own = own.join(hot, "node", "left")
            spare = own.where(F.col("k") > LONG_LIST).groupBy("node").agg(F.count("*").alias("long"))  # lists that the count below leaves out
            short = own.where(F.col("k") <= LONG_LIST).join(spare, "node", "left").select("gram", "node", "n", "l", "level", "label", F.coalesce("hot", "node").alias("hot"), F.coalesce("long", F.lit(0)).alias("long"))
            short = scratch.write(short, "short", size)
            other = short.select("gram", *(F.col(c).alias(f"{c}2") for c in ("node", "n", "l", "level", "label", "hot", "long")))
            match = short.join(other, "gram").where("node < node2 and label <> label2 and hot <> hot2 and level <= l2 and level2 <= l").where(_LENGTHS)
            pairs = match.groupBy(F.col("node").alias("u"), F.col("node2").alias("v")).agg(F.count("*").alias("c"), F.min(F.least("l", "l2")).alias("want"), F.min(F.least("long", "long2")).alias("long")).where(F.col("c") + F.col("long") >= F.col("want")).select("u", "v")
        else:
            lead = own.groupBy("gram").agg(F.min_by(F.struct("node", "n", "label"), F.xxhash64(F.lit(turn), "node")).alias("h")).select("gram", F.col("h.node").alias("node2"), F.col("h.n").alias("n2"), F.col("h.label").alias("label2"))
            met = own.join(lead, "gram").where("node <> node2 and label <> label2").where(_LENGTHS).groupBy("node", "node2").agg(F.count("*").alias("c"))
            pairs = met.groupBy(F.col("node").alias("u")).agg(F.max_by("node2", F.struct("c", "node2")).alias("v"))
        links = scratch.write(links.unionByName(_verify(pairs, sets)), "links", size)
        labels = scratch.write(connected_components(links, scratch, size), "labels", size)
        if settle:
            break
    named = classes if labels is None else classes.join(labels, "node", "left")
    named = named.withColumn("label", F.coalesce("label", "node") if labels is not None else F.col("node"))
    named = scratch.write(named, "named")
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "label").select("node", "component_id")
    return rows.join(named, "node", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op1_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op1_shingle_join": op1_shingle_join}
ORACLE: dict[str, str] = {}
