"""The prefix trie against a plain trie of tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from gridspark.llm import prefix_trie as P

SCHEMA = "conv_id long, turn int, role string, text string, depth string, shard int"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        ends[whole].append(c)
        for d in range(len(whole) + 1):
            members[whole[:d]].add(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        kids = [below(k) for k in children[p]]
        return sum(k[0] for k in kids) or 1, sum(k[1] for k in kids) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)

    name = lambda p: hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), *below(p), name(p)) for p, m in list(members.items()))


def got(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)


def corpus(seed, convs, copies=0, longest=9):
    draw = random.Random(seed)
    out = []
    for c in range(convs):
        state, n = draw.choice("abc"), draw.randint(1, longest)
        for t in range(n):
            state = draw.choice([state, "hello é\U0001f600", "", None, "x y"])
            out.append((c, t, draw.choice(["user", None]), state))
    for c in range(convs, convs + copies):
        out += [(c, t, "user", f"same {t}") for t in range(7)]
    draw.shuffle(out)
    return out


@pytest.mark.parametrize(("least", "fan"), [(5_000, 64), (20, 64), (20, 2), (7, 3)])
def test_equals_the_plain_trie(spark, monkeypatch, least, fan):
    monkeypatch.setattr(P, "LEAST_TURNS", least)
    monkeypatch.setattr(P, "FAN", fan)
    rows = corpus(least + fan, 60, copies=40)
    df = table(spark, rows)
    found = P.write_table(P.rebuilt(P.sequences(df)))
    assert got(P.trie_of(found, 40)) == plain(rows)


def test_copies_over_many_shards(spark, monkeypatch):
    """One conversation's copies fill most shards; their node's identifiers are hashed in order over shard borders."""
    monkeypatch.setattr(P, "LEAST_TURNS", 30)
    monkeypatch.setattr(P, "HEADS", 1)
    rows = [(c, t, "user", f"t{t}") for c in range(300) for t in range(3)] + [(500, 0, "user", "t0")]
    out = got(P.trie_of(P.write_table(P.rebuilt(P.sequences(table(spark, rows)))), 16))
    assert [r[3] for r in sorted(out, key=lambda r: r[1])] == [301, 301, 300, 300]
    name = hashlib.sha256(",".join(map(str, range(300))).encode()).hexdigest()
    assert [r[7] for r in out if r[1] == 3] == [name]


def test_null_turns_and_identifiers_and_turnless(spark):
    # crc32("101") % 6 leaves its single turn out if the opening conversation 100 does not exist
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 1)
    rows = [(0, None, "user", "first"), (0, 0, "user", "second"), (None, 0, "user", "nobody's"), (lone, 3, None, None)]
    want = plain(rows)
    assert got(P.prefix_trie(table(spark, rows))) == want
    assert want[0][3] == 2 and any(r[7] == hashlib.sha256(str(lone).encode()).hexdigest() for r in want)
    only = [(lone, 0, "user", "gone")]
    assert got(P.prefix_trie(table(spark, only))) == plain(only)


def test_long_conversations_and_texts(spark, monkeypatch):
    monkeypatch.setattr(P, "LEAST_TURNS", 100)
    rows = [(c, t, "u", f"{t}" * (5_000 if t == 3 else 1)) for c in (0, 1, 2) for t in range(16 * c + 150)] + [(300, t, "u", f"{t}") for t in range(16)]
    assert got(P.trie_of(P.write_table(P.rebuilt(P.sequences(table(spark, rows)))), 4)) == plain(rows)


def test_empty(spark):
    assert P.prefix_trie(table(spark, [])).count() == 0
    assert P.prefix_trie(table(spark, [(None, 1, "user", "x")])).count() == 0


def test_equal_turn_numbers_and_repeated_rows(spark):
    rows = [(0, 1, "user", "x"), (0, 1, "user", "x"), (0, 1, "bot", "y"), (1, 1, "bot", "y"), (1, 1, "user", "x"), (1, 1, "user", "x")]
    out = got(P.prefix_trie(table(spark, rows)))
    assert max(r[1] for r in out) == 3
    assert got(P.prefix_trie(table(spark, rows[::-1]))) == out
