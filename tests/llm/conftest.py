import pytest

SF = "/root/testdata/sf0.001"

#: Nulls, empty and blank texts, ties, repeated texts, one word, odd spaces, long words, special tokens, many languages.
EDGE = [
    (0, "the quick brown fox jumps over the lazy dog and runs away from it all again today " * 3),
    (1, None),
    (2, ""),
    (3, " \t\n\r\x0b\x0c "),
    (4, "one"),
    (5, "One"),
    (6, "a  b\tc\nd"),
    (7, "a b c d"),
    (8, "a b c d \u0085 e\x1cf"),
    (9, "z" * 3000),
    (10, "a " * 700),
    (11, "a " * 701),
    (12, "<|endoftext|> it's WE'LL 123 4567 é́ ẞ \U0001f600 中文 <s> </s> ▁x ▁▁"),
    (13, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"),
    (14, "x w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 y"),
    (15, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"),
    (16, "line one\nline one\n\nline two\r\nline one \nline one"),
    (17, "SHOUT!! SHOUT!! SHOUT!! SHOUT!! SHOUT!! SHOUT!! SHOUT!! SHOUT!! SHOUT!! SHOUT!!"),
    (18, "the quick brown fox jumps over the lazy dog and runs away from it all again today " * 3),
    (19, "  leading and   inner   spaces \n\n and trailing   "),
    (20, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 " * 40),
]


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest table, with the edge cases after it."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    return rows + [(100_000 + i, t) for i, t in EDGE]


@pytest.fixture(scope="session")
def documents(spark, sample):
    """The same as a table of several partitions with columns whose names clash with results."""
    df = spark.createDataFrame([(i, t, "x", 1, None, "n") for i, t in sample], "doc_id long, text string, kept string, mark int, lang string, component string")
    return df.repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, n_chars long")


@pytest.fixture(scope="session")
def twice(spark):
    """Repeated rows, repeated identifiers with other texts, and null identifiers."""
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long), (1, long), (1, "other text here"), (None, long), (None, long), (None, None), (2, long + " end")]
    return spark.createDataFrame(rows, "doc_id long, text string")
