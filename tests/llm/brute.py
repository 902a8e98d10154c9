"""Plain versions of the operators over lists of (doc_id, text), to compare with."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def exact(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    return {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm}


def fingerprint(text):
    low = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(low[i : i + 4]) for i in range(len(low) - 3)] or ([" ".join(low)] if low else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(rows):
    marks = [(i, fingerprint(t)) for i, t in rows]
    parent = {i: i for i, _ in marks}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for k, (i, m) in enumerate(marks):
        for j, n in marks[:k]:
            if (m ^ n).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (f"{m:016x}", find(i)) for i, m in marks}


def base_counts(text):
    ws = words(text)
    seen = defaultdict(list)
    for i in range(len(ws) - 4):
        seen[tuple(ws[i : i + 5])].append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(ws) < 10 or 100 * len(covered) > 20 * len(ws)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def substrings(rows, size=13):
    split = {i: words(t) for i, t in rows}
    first = {}
    for i in sorted(split):
        for k in range(len(split[i]) - size + 1):
            first.setdefault(tuple(split[i][k : k + size]), i)
    out = {}
    for i, ws in split.items():
        gone = {k + j for k in range(len(ws) - size + 1) if first[tuple(ws[k : k + size])] < i for j in range(size)}
        kept = [w for k, w in enumerate(ws) if k not in gone]
        out[i] = (len(ws), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def pieces(rows, length=4096):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = {}
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for p, low in enumerate(range(0, len(ids), length)):
            part = ids[low : low + length]
            out[i, p] = (low, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    return out


def check_sequences(rows, length=4096):
    """Pieces lie without gaps from 0 in sequences of at most ``length`` tokens; the number of sequences."""
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    return len(by_sequence)
