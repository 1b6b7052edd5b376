"""Case folding against Python's own, over every character."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from foliospark.functions import scalars


def test_every_character_folds_completely(spark):
    chars = [chr(i) for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    lines = ["".join(chars[i : i + 997]) for i in range(0, len(chars), 997)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i long, t string").select("i", scalars.casefold(F.col("t")).alias("f")).orderBy("i").collect()
    assert [r.f for r in got] == [t.casefold() for t in lines]


def test_words(spark):
    words = ["STRASSE Straße STRAẞE", "ΟΔΟΣ ὀδός", "ﬁnance ﬀ ﬆ", "İstanbul ısı I", "Ǆ ǅ ǆ", "é É", "ŉ ǰ ΐ", "plain ASCII 42", "", None]
    got = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i long, w string").select("i", scalars.casefold(F.col("w")).alias("f"), scalars.occurs(F.lit("strasse"), scalars.fold(F.col("w"))).alias("o")).orderBy("i").collect()
    assert [r.f for r in got] == [w if w is None else w.casefold() for w in words]
    assert [r.o for r in got] == [True, *[False] * 9]
