"""Near copies of the pipeline: planted copies at 0.8 to 0.95, a long list of copies, and all pairs of a small table."""

import random
from itertools import combinations

import corpus_pipeline
from gridspark.llm.near_copies import PAIRWISE, drop_alike

SF = "/root/testdata/sf0.01"


def shingles(text):
    ws = (text or "").lower().split()
    k = min(5, len(ws))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if ws else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def kept(sets):
    """The smallest identifier of each component of pairs at 0.8 or more."""
    name = {i: i for i in sets}

    def find(v):
        while name[v] != v:
            v = name[v]
        return v

    for a, b in combinations(sorted(sets), 2):
        if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and similarity(sets[a], sets[b]) >= 0.8:
            x, y = find(a), find(b)
            name[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


def test_planted_copies(spark):
    rng, rows = random.Random(3), []
    for group in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 200, 900]))]
        rows.append((len(rows), " ".join(words)))
        for edits in (0.004, 0.01, 0.02, 0.04, 0.08):
            other = [f"x{rng.randrange(5000)}" if rng.random() < edits else w for w in words]
            rows.append((len(rows), " ".join(other)))
    rows += [(9001, None), (9002, ""), (9003, "one two"), (9004, "One  two"), (9005, "one two three"), (None, "w " * 9 + "end"), (9006, "w " * 9 + "end")]
    sets = {i: shingles(t) for i, t in rows if i is not None}
    assert sum(0.8 <= similarity(sets[a], sets[a - a % 6]) < 0.95 for a in range(360)) > 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id for r in drop_alike(docs).collect()} == kept(sets)


def test_long_list(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(4 * PAIRWISE):
        other = list(words)
        for _ in range(rng.randrange(1, 6)):
            other[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(other)))
    assert [r.doc_id for r in drop_alike(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_long_lists_equal_all_pairs(spark):
    """Groups whose members are at 0.75 to 0.95 of each other: some pairs of a list qualify, most do not."""
    rng, rows = random.Random(11), []
    for group, (size, low, high) in enumerate([(150, 4, 10), (150, 6, 9), (90, 2, 12)]):
        words = [f"g{group}w{i}" for i in range(400)]
        for _ in range(size):
            other = list(words)
            for at in rng.sample(range(400), rng.randint(low, high)):
                other[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(other), "clash", 1))
    sets = {r[0]: shingles(r[1]) for r in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, key int").repartition(4)
    want = kept(sets)
    assert 20 < len(want) < len(rows) - 20
    assert {r.doc_id for r in drop_alike(docs).collect()} == want


def test_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (1, text), (2, text + " end"), (2, "other words here"), (None, text)]
    out = drop_alike(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, text), (1, text), (2, "other words here")]


def test_stage_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = corpus_pipeline.exact_dedup(spark, docs, SF).persist()
    after = corpus_pipeline.near_dedup(spark, before, SF)
    assert after.columns == before.columns
    assert {r.doc_id for r in after.collect()} == kept({r.doc_id: shingles(r.text) for r in before.collect()})


def test_empty_table(spark, empty):
    assert drop_alike(empty).collect() == []


def test_links_of_long_lists_come_from_the_list(spark):
    """A list of texts that are near by bits but under 0.8: the links that leave it are fewer than its entries, whatever its pairs."""
    from pyspark.sql import functions as F

    from gridspark.llm import near_copies as N

    rng, rows = random.Random(7), []
    for _ in range(200):
        other = [f"w{i}" for i in range(300)]
        for at in rng.sample(range(300), rng.randint(5, 9)):
            other[at] = f"x{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(other)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = N.sketches(docs).localCheckpoint()
    long = own.select(F.lit(1).cast("long").alias("key"), "node", "n", *N.WORDS)
    sets = N._sets_of(docs, own, own.select("node"))
    alone = own.select("node", F.col("node").alias("component"))
    want = kept({i: shingles(t) for i, t in rows})
    for block in (1 << 21, 20_000):
        N.BLOCK, before = block, N.BLOCK
        links = [(r.a, r.b) for r in N._list_pairs(long, alone, sets).collect()]
        N.BLOCK = before
        assert len(links) < len(rows) * (1 if block > 20_000 else 6)
        node = {r.node: r.doc_id for r in own.collect()}
        name = {i: i for i, _ in rows}
        find = lambda v: v if name[v] == v else find(name[v])  # noqa: B023
        for a, b in links:
            x, y = find(node[a]), find(node[b])
            name[max(x, y)] = min(x, y)
        assert {i for i in name if find(i) == i} == want


def test_index_of_bytes_gives_candidates(spark):
    """The stage's first way is the positional-byte index over SimHash bits: texts that it links are among its pairs."""
    from gridspark.llm import near_copies as N

    words = [f"w{i}" for i in range(3000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join(f"y{i}" for i in range(3000)))]
    own = N.sketches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    node = {r.doc_id: r.node for r in own}
    assert 0 < bin((own[0].m0 ^ own[1].m0) & (2**64 - 1)).count("1") <= 4 or own[0].m0 == own[1].m0
    pairs = N.index_pairs(spark.createDataFrame(own)).collect()
    assert {(r.a, r.b) for r in pairs} == {tuple(sorted((node[1], node[2])))}
