"""Each stage of the corpus pipeline, and the whole of it, against plain Python."""

from __future__ import annotations

import random

import pytest
import sentencepiece

import corpus_pipeline
from foliospark.llm import _common, decontaminate, piece_codec, quality_lm, shingle_join
from tests.llm.test_llm import WORDS, brute_repeats, brute_sets, edit_distance_within, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts, ids=None):
    return [(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts, strict=True)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with junk, repeated passages, near copies and benchmark items, as a table folder."""
    rng, folder = random.Random(21), str(tmp_path_factory.mktemp("tables"))
    good = [prose(rng, rng.randint(30, 60)) for _ in range(30)]
    passage = "\n".join(prose(rng, 9) for _ in range(4))
    item = " ".join(f"item{i}" for i in range(12))
    texts = [*good, "w3 " * 200, "%% @@ ## " * 40, "own start\n" + passage, "other start here\n" + passage + "\nown end", good[3] + " more", good[4], None, "", f"{good[5]} {item} {prose(rng, 9)}", f"{prose(rng, 8)} {item.replace('item7', 'itemx')}"]
    spark.createDataFrame(rows_of(texts), SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 25)] + [(30, 0, 0), (2, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "  ")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts


def kept(df):
    return {r.doc_id: r.text for r in df.collect()}


def brute_copies(texts):
    """Ids of documents whose group of near duplicates has an earlier one."""
    sets = {i: brute_sets(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in texts if find(i) != i}


def leaks(text, item):
    item = decontaminate.normalise(item)
    return edit_distance_within(item, decontaminate.normalise(text or "")) <= int(decontaminate.RATE * len(item))


def test_quality_stage_drops_what_the_classifier_rejects(spark, tables):
    folder, texts = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.quality(spark, docs, folder)
    rejected = {r.doc_id for r in quality_lm.classify(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect() if not r.keep}
    assert out.columns == docs.columns and kept(out) == {i: t for i, t in enumerate(texts) if i not in rejected} and {30, 31} <= rejected and not rejected & set(range(30))


def test_line_stage_against_brute_force(spark, tables):
    folder, texts = tables
    gone = brute_repeats(texts, 20)
    want = {}
    for i, t in enumerate(texts):
        left = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) if gone[i] else t
        if not gone[i] or left.strip():
            want[i] = left
    out = corpus_pipeline.lines(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert kept(out) == want and any(gone.values()) and all(r.n_chars == len(r.text or "") for r in out.collect())


def test_line_stage_drops_documents_of_which_nothing_is_left(spark, tables):
    passage = "\n".join(" ".join(f"p{i}{j}" for j in range(9)) for i in range(4))
    docs = spark.createDataFrame(rows_of([passage, "\t\n" + passage + "\n \n", passage, "\n", None]), SCHEMA)
    assert kept(corpus_pipeline.lines(spark, docs, "")) == {0: passage, 3: "\n", 4: None}


def test_near_copy_stage_against_brute_force(spark, tables):
    folder, texts = tables
    gone = brute_copies(dict(enumerate(texts)))
    out = corpus_pipeline.near_copies(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert kept(out) == {i: t for i, t in enumerate(texts) if i not in gone} and gone


def test_near_copy_stage_where_rows_share_ids(spark):
    rng = random.Random(4)
    a, b, c = (prose(rng, 40) for _ in range(3))
    docs = spark.createDataFrame(rows_of([a, a, b, c, c + " tail", None, None, "", b], [1, 1, 1, 2, 2, 3, None, None, 9]), SCHEMA)
    out = corpus_pipeline.near_copies(spark, docs, "")
    assert sorted((r.text or "")[:20] for r in out.collect()) == sorted([a[:20], b[:20], c[:20], "", "", ""]) and out.columns == docs.columns


def test_leak_stage_against_brute_force(spark, tables):
    folder, texts = tables
    item = spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 1").first().text
    out = corpus_pipeline.leaks(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    want = {i: t for i, t in enumerate(texts) if not leaks(t, item)}
    assert kept(out) == want and len(want) == len(texts) - 2


def test_piece_stage_against_the_library(spark, tables):
    folder, texts = tables
    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_path())
    rows = corpus_pipeline.pieces(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()
    assert {r.doc_id: r.ids for r in rows} == {i: library.encode(t or "") for i, t in enumerate(texts)} and all(r.restored and r.agreed for r in rows)


def test_whole_pipeline_against_brute_force(spark, tables):
    folder, texts = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, item = spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 1").first().text
    left = {r.doc_id: texts[r.doc_id] for r in quality_lm.classify(docs, labels).collect() if r.keep}
    ids = sorted(left)
    gone = brute_repeats([left[i] for i in ids], 20)
    cut = {i: "\n".join(x for n, x in enumerate(left[i].split("\n")) if n not in gone[k]) if gone[k] else left[i] for k, i in enumerate(ids)}
    cut = {i: t for k, (i, t) in enumerate(cut.items()) if not gone[k] or t.strip()}
    alone = {i: t for i, t in cut.items() if i not in brute_copies(cut)}
    want = {i: t for i, t in alone.items() if not leaks(t, item)}
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == set(want) and 0 < len(want) < len(texts)
    got = {r.doc_id: r.text for r in piece_codec.decode_ids(spark.createDataFrame([(r.doc_id, r.ids) for r in rows], "doc_id long, ids array<int>"), piece_codec.model_path()).collect()}
    assert got == {i: t or "" for i, t in want.items()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_copies", "decontaminate", "pieces"] and len(WORDS) == 60 and shingle_join.WORDS == 5


def test_stages_of_an_empty_table(spark, tables):
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, tables[0]).count() == 0


def test_stages_give_memory_back_and_read_few_long_rows(spark, tables, monkeypatch):
    frame, given = type(spark.range(0)), []
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, func, *more, **named: given.append(func) or plain(self, func, *more, **named))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "4096")
    corpus_pipeline.run(spark, tables[0]).count()
    assert len(given) > 5 and all(f.__qualname__ == f.__wrapped__.__qualname__ for f in given)
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 256
    seen = []
    monkeypatch.setattr(_common, "trim", lambda: seen.append("trimmed"))
    assert [*_common.freed(lambda rows: (seen.append(x) or x for x in rows))([1, 2])] == [1, 2] and seen == [1, 2, "trimmed"]
