"""Folding in the JVM against the standard library."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from gridspark.functions import scalars as N


def folded(spark, rows, of):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").repartition(8)
    return [r[1] for r in sorted(df.select("i", of(F.col("t"))).collect())]


def test_every_assigned_character(spark):
    chars = [c for c in map(chr, range(1, 0x110000)) if unicodedata.category(c) not in ("Cn", "Co", "Cs")]
    rows = ["".join(chars[i : i + 40]) for i in range(0, len(chars), 40)]
    rows = [" ".join(r) for r in rows]  # apart, so that neighbours do not compose
    assert folded(spark, rows, N.fold_compat) == [unicodedata.normalize("NFKC", r) for r in rows]


def test_letters_with_marks(spark):
    draw = random.Random(3)
    marks = [c for c in map(chr, range(0x300, 0x370)) if unicodedata.combining(c)]
    rows = ["".join(draw.choice("aeÉoǘxкиЙ ﬁἄ가½") + "".join(draw.choices(marks, k=draw.randint(0, 3))) for _ in range(12)) for _ in range(600)]
    rows += ["́lone", "é", "q̣̇", "ḍ̇", "à֮̕b", "", "plain"]
    assert folded(spark, rows, N.fold_compat) == [unicodedata.normalize("NFKC", r) for r in rows]


def test_names(spark):
    def name(value):
        text = re.sub(r"^\d+[_\-\s]+", "", value.strip().lower()).replace("_", " ").replace("-", " ").replace("ё", "е")
        text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")
        return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", text)).strip()

    rows = ["ﬁne Æsir", "½ Mile", "12_Ⅷ King-Street", "ǆ ŉ", "São Paulo", "㎏ ①⑩", "Ü̈x"]
    assert folded(spark, rows, N.norm_name) == [name(r) for r in rows]
    question = lambda t: re.sub(r"\s+", " ", re.sub(r"[^\w\-/]+", " ", unicodedata.normalize("NFKC", t).lower().strip())).strip()
    assert folded(spark, rows, N.norm_question) == [question(r) for r in rows]


def test_plain_letters_are_not_looked_up(spark):
    """One ligature and one marked letter in a long text: the time goes by these two, not by the letters around them."""
    import time

    row = "plain words " * 200 + "ﬁ e\u0301" + " of a text" * 200
    rows = [f"{i} {row}" for i in range(1600)]
    folded(spark, rows[:8], N.fold_compat)
    start = time.monotonic()
    assert folded(spark, rows, N.fold_compat) == [unicodedata.normalize("NFKC", r) for r in rows]
    assert time.monotonic() - start < 22
