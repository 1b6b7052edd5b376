"""Sweep line, dominance counts and the gram index against brute force."""

from __future__ import annotations

import random
import time
import uuid

import numpy as np
import pytest

from foliospark.operators import geometry, occur


def all_pairs_merge(boxes, pad=2.0):
    boxes = [tuple(map(float, b)) for b in boxes]
    while True:
        for i, a in enumerate(boxes):
            j = next((j for j in range(i + 1, len(boxes)) if geometry.touch(a, boxes[j], pad)), None)
            if j is not None:
                b = boxes.pop(j)
                boxes[i] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
                break
        else:
            return sorted(set(boxes), key=lambda b: (b[1], b[0], b[2], b[3]))


def test_sweep_against_all_pairs():
    rng = random.Random(1)
    for _ in range(600):
        side, most, step = rng.choice([60, 300, 1000]), rng.choice([3, 20, 60]), rng.choice([1, 0.1])
        boxes = [(x * step, y * step, (x + rng.randrange(most)) * step, (y + rng.randrange(most)) * step) for x, y in ((rng.randrange(side), rng.randrange(side)) for _ in range(rng.randrange(30)))]
        assert geometry.merge_boxes(boxes) == all_pairs_merge(boxes), boxes


def test_a_page_of_many_boxes_takes_seconds():
    rng = random.Random(2)
    boxes = [(x, y, x + 15 * rng.random(), y + 15 * rng.random()) for x, y in ((10_000 * rng.random(), 10_000 * rng.random()) for _ in range(50_000))]
    began = time.perf_counter()
    merged = geometry.merge_boxes(boxes)
    assert time.perf_counter() - began < 20 and 10_000 < len(merged) < 50_000


def rectangles(rng, n, side, most):
    at, size = np.round(rng.random((n, 2)) * side), np.round(rng.random((n, 2)) * most)
    return np.column_stack([at, at + size])


def direct_counts(boxes, chars):
    return [int(((chars[:, :2] >= b[:2]).all(axis=1) & (chars[:, 2:] <= b[2:]).all(axis=1)).sum()) for b in boxes]


def test_dominance_counts_against_direct_ones():
    rng = np.random.default_rng(3)
    for _ in range(500):
        boxes, chars = rectangles(rng, rng.integers(0, 20), 30, rng.choice([3, 20])), rectangles(rng, rng.integers(0, 60), 30, rng.choice([0, 2, 6]))
        assert list(geometry.inside_counts(boxes, chars)) == direct_counts(boxes, chars)
    chars = np.array([[5.0, 5, 4, 6], [0, 0, 1, 1]])  # one that ends before it begins
    assert list(geometry.inside_counts(np.array([[0.0, 0, 9, 9]]), chars)) == direct_counts(np.array([[0.0, 0, 9, 9]]), chars)


@pytest.mark.parametrize("few", [0, 4096])
def test_count_chars_by_page(spark, monkeypatch, few):
    monkeypatch.setattr(geometry, "FEW_PAIRS", few)
    rng = np.random.default_rng(4)
    kind = "doc_id long, page_no int, x0 double, top double, x1 double, bottom double"
    boxes = [(d, p, *map(float, b)) for d in range(4) for p in range(2) for b in rectangles(rng, 12, 40, 25)] + [(9, 0, 0.0, 0.0, 50.0, 50.0), (0, 0, None, 0.0, 50.0, 50.0)]
    chars = [(d, p, *map(float, c)) for d in range(3) for p in range(2) for c in rectangles(rng, 50, 40, 3)] + [(0, 0, 1.0, 1.0, None, 2.0), (77, 0, 1.0, 1.0, 2.0, 2.0)]
    made = geometry.count_chars(spark.createDataFrame(boxes, kind), spark.createDataFrame(chars, kind))
    assert not any("Join" in line and "BroadcastNestedLoop" in line for line in made._jdf.queryExecution().toString().splitlines())
    got = {tuple(r)[:6]: r.n_chars for r in made.collect()}
    for b in boxes:
        own = np.array([c[2:] for c in chars if c[:2] == b[:2] and None not in c]).reshape(-1, 4)
        want = 0 if None in b else direct_counts([np.array(b[2:]) + [-1.5, -1.5, 1.5, 1.5]], own)[0]
        assert got[b] == want, b


@pytest.mark.parametrize("hot", [10_000, 3])
def test_occurrences_against_brute_force(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(occur, "HOT_TEXTS", hot)

    def keep(df):
        path = f"{tmp_path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    rng = random.Random(5)
    letters = "abcdé日"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(60)] + [None, "", "a" * 3000, "common prefix here", "common prefix there"]
    values = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(40)] + [t[i : i + 40] for t in texts[:20] if t for i in (0, 30)] + [None, "", "a", "é", "common prefix", "nowhere at all", "x" * 5000, "common prefix"]
    made = occur.occurrences(spark.createDataFrame(list(enumerate(values)), "item long, value string"), spark.createDataFrame(list(enumerate(texts)), "doc long, text string"), keep)
    plan = made._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = sorted((i, d) for i, v in enumerate(values) if v for d, t in enumerate(texts) if t is not None and v in t)
    assert sorted(map(tuple, made.collect())) == want and len(want) > 300
