"""Answer store, similarity lookup, lexical retrieval and snippets.

Similarity uses the longest-matching-block ratio of ``difflib``. It has no SQL form, so pairs are scored
in Arrow batches, but Spark decides which pairs meet. Stored answers: a request meets the entries of its context whose length
and character counts can reach the threshold, tested inside the join; common subsequences drop nearly all others before
they are scored. Retrieval: token postings and lower bounds leave few pairs. Only the best per request leaves a task.
"""

from __future__ import annotations

import difflib
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.scalars import norm_question
from gridspark.operators.textaudit import STORE_VERSION, check_responses
from gridspark.scope import Scope, materialize, spread, top_k, unsent

SIMILARITY = 0.86
CONTEXT = ("area_norm", "mode", "language", "evidence_hash")

# Key parts that mark a secret.
SECRET_TERMS = ("api_key", "secret", "environment", "raw_text", "authorization")


def no_secrets(df: DataFrame) -> Column:
    """No field name (at any depth) may carry a secret term; map keys are tested per row."""
    from pyspark.sql import types as T

    def names(dtype, path):
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                yield path + (f.name,)
                yield from names(f.dataType, path + (f.name,))
        elif isinstance(dtype, T.ArrayType):
            yield from names(dtype.elementType, path)

    if any(term in n[-1].lower() for n in names(df.schema, ()) for term in SECRET_TERMS):
        return F.lit(False)
    ok = F.lit(True)
    for f in df.schema.fields:
        if isinstance(f.dataType, T.MapType):
            bad = F.exists(F.map_keys(F.col(f.name)), lambda k: F.lower(k).rlike("|".join(SECRET_TERMS)))
            ok = ok & ~F.coalesce(bad, F.lit(False))
    return ok


def store_answers(new: DataFrame, store: DataFrame | None) -> DataFrame:
    """X08. Accept safe, non-empty, evidence-backed answers; the last write per ``cache_id`` wins.

    ``new`` has the response fields, ``area, mode, language, question, evidence_hash, cache_id,
    created_at``. Duplicates are resolved by a mergeable ``max_by``, then the store keeps its other keys.
    """
    checked = check_responses(new)
    good = checked.where(
        F.col("passed")
        & F.col("severity").isin("none", "low")
        & (F.coalesce("answer", F.lit("")) != "")
        & F.coalesce(F.size("evidence_used") > 0, F.lit(False))
        & no_secrets(new)
    )
    columns = ["answer", "evidence_used", "claim_boundary_notes", "missing_artifacts", "structured_sections", "fallback_used"]
    entry = good.select(
        "cache_id",
        "created_at",
        norm_question(F.col("area")).alias("area_norm"),
        F.lower("mode").alias("mode"),
        F.lower("language").alias("language"),
        "evidence_hash",
        norm_question(F.col("question")).alias("question_norm"),
        *columns,
    )
    rest = [c for c in entry.columns if c != "cache_id"]
    latest = entry.groupBy("cache_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", "answer")).alias("_e")).select("cache_id", "_e.*")
    if store is None:
        return latest
    return store.join(latest.select("cache_id"), "cache_id", "left_anti").unionByName(latest, allowMissingColumns=True)


def store_status(store: DataFrame) -> DataFrame:
    return store.agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("area_norm").alias("areas"), F.max("created_at").alias("last_write"))


def _char_counts(texts: pd.Series) -> np.ndarray:
    """Character histogram over 64 hashed buckets; merging buckets can only raise the matching bound."""
    out = np.zeros((len(texts), 64), dtype=np.int32)
    for i, t in enumerate(texts):
        codes = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) % 64
        out[i] = np.bincount(codes, minlength=64)
    return out


BLOCK = 8192  # texts of one length band that meet another block in one task
FOLDED = 32  # buckets of characters in a signature


def _signatures(texts: pd.Series) -> np.ndarray:
    """Eight longs per text. A bucket of characters has 16 bits, of which each occurrence turns the next one, in a circle: texts whose counts
    differ by ``d`` in all differ in ``d`` bits at most, and in just as many while no bucket differs by over 16."""
    turned = np.array([(1 << r) - 1 if r <= 16 else 0xFFFF & ~((1 << (r - 16)) - 1) for r in range(32)], dtype=np.uint16)
    counts = _char_counts(texts).reshape(len(texts), 64 // FOLDED, FOLDED).sum(axis=1)
    return np.ascontiguousarray(turned[counts % 32]).view(np.int64)


def _codes(texts: Sequence[str]) -> np.ndarray:
    """Characters modulo 64, one row a text, filled up with 64."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.full((len(texts), max(int(sizes.max()), 1)), 64, dtype=np.uint8)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32) % 64
    return out


def _matchable(left: Sequence[str], right: Sequence[str], pairs: int = 4096, bits: int = 1 << 28) -> np.ndarray:
    """Most characters that each pair of texts can match in order: longest common subsequences, bit-parallel over many pairs at a time.

    Characters count as equal if they are so modulo 64, which can only raise the length. Where a text of ``left`` has a character stands once
    for all its pairs.
    """
    out = np.zeros(len(left), dtype=np.int64)
    need = np.array([(len(a) + 63) // 64 or 1 for a in left])
    own, texts = pd.factorize(np.array([*left, None], dtype=object)[:-1])
    order, start = np.lexsort(([len(b) for b in right], need)), 0
    while start < len(order):
        words = int(need[order[start]])
        same = order[start : start + max(1, min(pairs, bits // (65 * 64 * words)))]
        same = same[need[same] == words]
        start += len(same)
        held, row = np.unique(own[same], return_inverse=True)
        a, b = _codes([texts[i] for i in held]), _codes([right[i] for i in same])
        place, rows = np.zeros((words, len(held), 65), dtype=np.uint64), np.arange(len(held))
        for i in range(a.shape[1]):
            place[i // 64, rows, a[:, i]] |= np.uint64(1 << (i % 64))
        place[:, :, 64] = 0  # what fills up a shorter text meets nothing
        place, at = place.reshape(words, -1), row * 65
        free = np.full((words, len(same)), ~np.uint64(0))
        for j in range(b.shape[1]):
            spot, carry = at + b[:, j], None
            for w in range(words):
                old = free[w]
                hit = old & place[w].take(spot)
                total = old + hit
                over = total < old
                if carry is not None:
                    total += carry
                    over |= (total == 0) & carry
                carry = over
                free[w] = total | (old ^ hit)
        out[same] = np.bitwise_count(~free).sum(axis=0)
    return out


def _best_pairs(threshold: float):
    """Rows of pairs ``(a, asked, b, stored)``: ratios at ``threshold`` or above that are the best of their ``a`` so far."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[str, float] = {}
        for rows in batches:
            asked, stored, a, b = rows["asked"].tolist(), rows["stored"].tolist(), rows["a"].tolist(), rows["b"].tolist()
            both = rows["asked"].str.len().to_numpy() + rows["stored"].str.len().to_numpy()
            cap, out = 2.0 * _matchable(asked, stored) / np.maximum(both, 1), []
            for i in np.argsort(-cap, kind="stable"):
                if cap[i] < threshold:
                    break
                if cap[i] < best.get(a[i], threshold):
                    continue
                ratio = difflib.SequenceMatcher(None, asked[i], stored[i]).ratio()
                if ratio >= best.get(a[i], threshold):
                    best[a[i]] = ratio
                    out.append((a[i], b[i], ratio))
            yield pd.DataFrame(out, columns=["request_id", "cache_id", "similarity"])

    return score


def _asked(requests: DataFrame) -> DataFrame:
    return requests.select(
        "request_id",
        norm_question(F.col("area")).alias("area_norm"),
        F.lower("mode").alias("mode"),
        F.lower("language").alias("language"),
        "evidence_hash",
        norm_question(F.col("question")).alias("question_norm"),
    )


def _gram_size(threshold: float) -> int:
    return next(q for q in (3, 2, 1) if (2 * q - 1) * threshold / 2 - (q - 1) >= 0.1 or q == 1)


def _least_shared(length: Column, q: int, threshold: float) -> Column:
    """Grams that a text of ``length`` shares at least with any other one at ``threshold``.

    With ``m`` matched characters each of the ``length - m`` unmatched ones breaks at most ``q`` grams and each of the partner's
    at most ``q - 1``; ``m`` is at least ``threshold / 2`` of both lengths, and the partner has at least ``threshold / (2 - threshold)``
    of this length.
    """
    both = length * (1 + threshold / (2 - threshold))
    return F.ceil(both * ((2 * q - 1) * threshold / 2 - (q - 1)) - (q - 1) - 1e-9)


def _grams(texts: DataFrame, threshold: float) -> DataFrame:
    """``_ctx, id, n, q, gram, c``: a text's length, and its grams of ``q`` characters with their number. What is too short for a
    guarantee with the usual size is also cut to single characters."""
    q, n, text = _gram_size(threshold), F.length("text"), F.col("text")
    cut = lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.struct(F.lit(size).alias("q"), F.substring(text, i, F.lit(size)).alias("gram")))
    none = F.array().cast("array<struct<q:int,gram:string>>")
    usual = F.when(n >= q, cut(q)).otherwise(none)
    short = F.when((_least_shared(n, q, threshold) < 1) & (n > 0), cut(1)).otherwise(none) if q > 1 else none
    return texts.select("_ctx", "id", n.alias("n"), F.inline(F.concat(usual, short))).groupBy("_ctx", "id", "n", "q", "gram").agg(F.count(F.lit(1)).alias("c"))


def gram_counts(texts: DataFrame, threshold: float) -> DataFrame:
    """``gram, df``: texts that hold a gram."""
    return _grams(texts, threshold).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))


def prefix_grams(texts: DataFrame, rare: DataFrame, threshold: float) -> DataFrame:
    """``_ctx, gram, k, id, n``: the rarest grams of texts ``(_ctx, id, text)``, ``k`` numbering a gram's repeats in its text.

    Two texts that share ``t`` grams share one among the first ``grams - t + 1`` of each in any common order. The order is from rare to
    common, ``t`` the least of ``_least_shared``, so texts that meet in no gram cannot reach the threshold.
    """
    q = _gram_size(threshold)
    each = _grams(texts, threshold).join(rare, "gram").groupBy("_ctx", "id", "n", "q").agg(F.sort_array(F.collect_list(F.struct("df", "gram", "c"))).alias("g"))
    every = F.flatten(F.transform("g", lambda x: F.transform(F.sequence(F.lit(1).cast("bigint"), x["c"]), lambda k: F.struct(x["gram"].alias("gram"), k.alias("k")))))
    least = F.greatest(F.when(F.col("q") == q, _least_shared(F.col("n"), q, threshold)).otherwise(_least_shared(F.col("n"), 1, threshold)), F.lit(1))
    first = each.withColumn("g", every).withColumn("g", F.slice("g", F.lit(1), F.greatest(F.size("g") - least + 1, F.lit(0)).cast("int")))
    return first.select("_ctx", F.inline("g"), "id", "n")


def similar_candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: pairs that share a prefix gram and whose lengths allow the threshold, each once."""
    a = left.select("_ctx", "gram", "k", F.col("id").alias("a"), F.col("n").alias("_na"))
    b = right.select("_ctx", "gram", "k", F.col("id").alias("b"), F.col("n").alias("_nb"))
    fits = 2 * F.least("_na", "_nb") >= threshold * (F.col("_na") + F.col("_nb")) - 1e-9
    return a.join(b, ["_ctx", "gram", "k"]).where(fits).select("a", "b").distinct()


def _signed(texts: DataFrame) -> DataFrame:
    """``texts`` with their length ``n`` and the longs of ``_signatures``."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            longs = _signatures(rows["text"])
            yield rows.assign(n=rows["text"].str.len(), **{f"s{i}": longs[:, i] for i in range(longs.shape[1])})

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields)
    return texts.mapInPandas(sign, f"{fields}, n int, " + ", ".join(f"s{i} long" for i in range(FOLDED // 4)))


def close_texts(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``a, asked, b, stored``: pairs of texts ``(_ctx, id, text)`` whose lengths and characters allow the threshold, each once.

    A ratio of ``threshold`` leaves at most ``1 - threshold`` of all characters of a pair unmatched, so neither lengths nor counts of
    characters differ by more. Texts meet in bands of length, each with its neighbours. A band of a context is dealt in
    blocks of about ``BLOCK`` texts a side, so a context that holds most texts is many keys. Pairs are made and tested inside
    the join; what fails is neither shuffled nor written.
    """
    step = float(np.log((2 - threshold) / threshold))
    band = F.floor(F.log(F.col("n")) / step).cast("int")
    a = _signed(left).select("*", F.explode(F.array(*[band + i for i in (-1, 0, 1)])).alias("band"))
    a, b = materialize(a), materialize(_signed(right).withColumn("band", band))
    blocks = lambda df, name: df.groupBy("_ctx", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    grid = materialize(blocks(a, "_ka").join(blocks(b, "_kb"), ["_ctx", "band"]))
    own = lambda k: F.pmod(F.xxhash64("id"), F.col(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    marks = [f"s{i}" for i in range(FOLDED // 4)]
    keys = ["_ctx", "band", "_i", "_j"]
    a = a.join(grid, ["_ctx", "band"]).select("_ctx", "band", own("_ka").alias("_i"), each("_kb").alias("_j"), F.col("id").alias("a"), F.col("text").alias("asked"), F.col("n").alias("_na"), *[F.col(m).alias(f"_a{m}") for m in marks])
    b = b.join(grid, ["_ctx", "band"]).select("_ctx", "band", each("_ka").alias("_i"), own("_kb").alias("_j"), F.col("id").alias("b"), F.col("text").alias("stored"), F.col("n").alias("_nb"), *[F.col(m).alias(f"_b{m}") for m in marks])
    both = F.col("_na") + F.col("_nb")
    fits = 2 * F.least("_na", "_nb") >= threshold * both - 1e-9
    apart = sum((F.bit_count(F.col(f"_a{m}").bitwiseXOR(F.col(f"_b{m}"))) for m in marks), F.lit(0))
    return a.join(unsent(b), keys).where(fits & (apart <= (1 - threshold) * both + 1e-9)).select("a", "asked", "b", "stored")


def lookup_answers(requests: DataFrame, store: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """X09. Best safe stored answer per request in the same area, mode, language and evidence hash.

    ``requests`` has ``request_id, area, mode, language, question, evidence_hash``. Exact questions are
    an equi-join. The rest meet the store entries of their context whose length and characters can reach the threshold
    (``close_texts``): no other entry can. Longest common subsequences bound the ratio of these pairs from above, and only pairs whose
    bound can be their question's best are scored. Of equally similar entries the smallest ``cache_id`` is taken.
    Identical questions of a context are scored once.
    """
    ctx = list(CONTEXT)
    store = materialize(store)  # read by the exact join, the blocks, and the final check
    req = materialize(_asked(requests))

    # entries of the same context and question: the most recent one stands for all
    distinct = store.groupBy(*ctx, "question_norm").agg(F.max_by("cache_id", F.struct("created_at", "cache_id")).alias("cache_id"))
    exact = req.join(unsent(distinct), [*ctx, "question_norm"]).select("request_id", "cache_id", F.lit(1.0).alias("similarity"), F.lit("exact").alias("match_type"))
    open_q = req.where(F.col("question_norm") != "").join(unsent(exact.select("request_id")), "request_id", "left_anti")
    asked = open_q.select(*ctx, "question_norm").distinct().withColumn("request_id", F.sha2(F.concat_ws("\x1f", *ctx, "question_norm"), 256))

    context = F.sha2(F.concat_ws("\x1f", *ctx), 256)
    asked = materialize(asked.dropna(subset=ctx))  # a context with a null equals none
    held = distinct.where(F.col("question_norm") != "").dropna(subset=ctx)
    left = asked.select(context.alias("_ctx"), F.col("request_id").alias("id"), F.col("question_norm").alias("text"))
    right = held.select(context.alias("_ctx"), F.col("cache_id").alias("id"), F.col("question_norm").alias("text"))
    scored = close_texts(left, right, threshold).mapInPandas(_best_pairs(threshold), "request_id string, cache_id string, similarity double")
    best = scored.groupBy("request_id").agg(F.min_by("cache_id", F.struct(-F.col("similarity"), F.col("cache_id"))).alias("cache_id"), F.max("similarity").alias("similarity"))
    similar = (
        open_q.join(
            unsent(asked.withColumnRenamed("request_id", "_ask").join(unsent(best.withColumnRenamed("request_id", "_ask")), "_ask")),
            [*ctx, "question_norm"],
        )
        .select("request_id", "cache_id", F.round("similarity", 4).alias("similarity"), F.lit("similarity").alias("match_type"))
    )
    hits = exact.unionByName(similar)
    # stored answers are checked again with the rules of today before they are handed out
    body = check_responses(store).where(F.col("passed") & F.col("severity").isin("none", "low"))
    fields = ["answer", "evidence_used", "claim_boundary_notes", "missing_artifacts", "structured_sections", "fallback_used"]
    safe = hits.join(unsent(body.select("cache_id", *fields)), "cache_id")
    found = safe.withColumn("hit", F.lit(True))
    return req.select("request_id").join(unsent(found), "request_id", "left").withColumns(
        {
            "hit": F.coalesce("hit", F.lit(False)),
            "match_type": F.coalesce("match_type", F.lit("none")),
            "similarity": F.coalesce("similarity", F.lit(0.0)),
        }
    )


# -------------------------------------------------------------------------------------------- retrieval

CORPUS_COLUMNS = ("entry_id", "title", "text", "source", "area", "category")


def build_corpus(facts: DataFrame | None, docs: DataFrame | None, max_chars: int | None = None) -> DataFrame:
    """X10. One corpus from fact rows (as JSON) and whole documents, blanks squeezed.

    ``facts`` has ``entry_id, title, source, area, category`` and any number of fact columns; ``docs`` has
    ``CORPUS_COLUMNS``. Texts stay whole unless ``max_chars`` asks for the short form.
    """
    parts = []
    if facts is not None:
        head = ("entry_id", "title", "source", "area", "category")
        body = F.to_json(F.struct(*[c for c in facts.columns if c not in head]))
        parts.append(facts.select("entry_id", "title", body.alias("text"), "source", "area", "category"))
    if docs is not None:
        parts.append(docs.select(*CORPUS_COLUMNS))
    corpus = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    clean = F.trim(F.regexp_replace("text", r"\s+", " "))
    return corpus.withColumn("text", F.substring(clean, 1, max_chars) if max_chars else clean)


SEQUENCE = 0.25
PROBES = 6  # rarest terms of a query whose entries give the first lower bound
FEW_TERMS = 200_000  # terms of all queries up to which they are sent to every task
SPLITS = 16  # parts that a query's pairs are scored in


def _band(size: Column) -> Column:
    return F.floor(F.log2(size)).cast("int")


def _once(c: Column) -> Column:
    """The same value, computed once a row: what reads it is not given a copy of the expression."""
    return F.explode(F.array(c))


def _ratio_cap(a: Column, low: Column, high: Column) -> Column:
    """Most that the ratio of a text of ``a`` characters to one of ``low`` to ``high`` characters can be."""
    most = lambda n: 2.0 * F.least(a, n) / (a + n)
    return F.when(low > a, most(low)).when(high < a, most(high)).otherwise(1.0)


def _pair_scores(k: int, sequence: float):
    """Rows sorted by query: scores that can be among the query's ``k`` best, best character bound first. Keeps k scores a query."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, best = None, []
        for rows in batches:
            out = []
            for qid, own in rows.groupby("query_id", sort=False):
                if qid != now:
                    now, best = qid, []
                q, floor = own.query_norm.iloc[0], own.floor.iloc[0]
                value = (1.0 - sequence) * own.share.to_numpy()
                size = own["head"].str.len().to_numpy()
                ratio = 2.0 * np.minimum(_char_counts(own["head"]), _char_counts(own.query_norm.iloc[:1])).sum(axis=1) / (size + len(q))
                cap = np.where(own.is_exact, 1.0, np.minimum(0.99, value + sequence * ratio))
                for i in np.argsort(-cap, kind="stable"):
                    least = (max(floor, best[0]) if len(best) == k else floor) - 1e-9
                    if cap[i] < least:
                        break
                    exact = bool(own.is_exact.iloc[i])
                    found = 1.0 if exact else min(0.99, value[i] + sequence * difflib.SequenceMatcher(None, q, own["head"].iloc[i]).ratio())
                    if found > 0 and found >= least:
                        out.append((qid, own.entry_id.iloc[i], found, exact))
                        heapq.heappush(best, found)
                        if len(best) > k:
                            heapq.heappop(best)
            yield pd.DataFrame(out, columns=["query_id", "entry_id", "score", "is_exact"])

    return score


def _gram_pairs(short: DataFrame, entries: DataFrame) -> DataFrame:
    """``(query_id, entry_id)`` of queries of one or two words that may stand inside an entry though its tokens differ.

    The longer word is part of a token (alone), its end (first of two) or its start (second of two). Tokens of the
    corpus' vocabulary are found by the word's rarest gram of up to three letters, entries by those tokens.
    """
    words = F.split("query_norm", " ")
    one = F.size(words) == 1
    first = F.length(words[0]) >= F.length(F.coalesce(F.get(words, F.lit(1)), F.lit("")))
    slot = short.select("query_id", F.when(one | first, words[0]).otherwise(F.get(words, F.lit(1))).alias("word"), F.when(one, "any").when(first, "end").otherwise("start").alias("place"))
    grams = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, n)))
    size = F.least(F.length("word"), F.lit(3))
    asked = slot.select("*", F.explode(grams(F.col("word"), size)).alias("gram"))
    vocabulary = entries.select(F.explode("tokens").alias("token")).distinct()
    every = F.concat(*[F.when(F.length("token") >= n, grams(F.col("token"), F.lit(n))).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)])
    known = materialize(vocabulary.select("token", F.explode(every).alias("gram")).join(asked.select("gram").distinct(), "gram", "left_semi"))
    often = known.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = asked.join(often, "gram").groupBy("query_id", "word", "place").agg(F.min_by("gram", F.struct("_n", "gram")).alias("gram"))
    fits = F.when(F.col("place") == "any", F.col("token").contains(F.col("word"))).when(F.col("place") == "end", F.col("token").endswith(F.col("word"))).otherwise(F.col("token").startswith(F.col("word")))
    tokens = rarest.join(known, "gram").where(fits).select("query_id", "token")
    return entries.select("entry_id", F.explode("tokens").alias("token")).join(tokens, "token").select("query_id", "entry_id").distinct()


def retrieve(queries: DataFrame, corpus: DataFrame, k: int = 5, sequence: float = SEQUENCE) -> DataFrame:
    """X11. Top k (1 to 10) corpus entries per query.

    Score: 1 for an exact substring, else ``min(.99, .75 * token overlap + .25 * sequence ratio)``; the
    ratio sees the first ``max(200, 4 * query length)`` characters, the overlap and the substring test see
    the whole text. Entries of another area are skipped. ``queries`` has ``query_id, query, area``; ``sequence`` is the
    ratio's weight (0: overlap alone, without Python).

    Exact, by postings and bounds:

    * Entries are cut into bands of length. Band and query length bound the ratio.
    * Entries under a query's ``PROBES`` rarest terms give the first lower bound of the k-th best score, by overlap alone.
    * From the bound follows how many terms an entry of a band must share. Postings lie with their entries, so up to
      ``FEW_TERMS`` (measured) terms of queries go to every task and pairs are counted before the shuffle; beyond, terms
      and postings are joined by a shuffle that adaptive execution splits at frequent terms. Pairs under the count go.
    * Of the pairs left, each query's best overlaps are compared in full; their k-th best is the second lower bound.
    * Inner words of an exact substring are tokens, so these entries come through the same join; queries of one or two
      words come through grams of the vocabulary (``_gram_pairs``).
    * Where a bound leaves no term to ask for (fewer than k entries share a token), that query meets the entries of that band.

    Only pairs that can still be among the k best meet their texts and are compared in Python.
    """
    k = max(1, min(int(k), 10))
    q = queries.select(F.col("query_id").cast("string").alias("query_id"), norm_question(F.col("query")).alias("query_norm"), F.coalesce(norm_question(F.col("area")), F.lit("")).alias("area"))
    words = F.split("query_norm", " ")
    inner = F.size(F.array_distinct(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))))
    q = materialize(q.where(F.col("query_norm") != "").withColumns({"terms": F.array_distinct(words), "inner": inner, "words": F.size(words)}))
    c = spread(corpus.select("entry_id", "title", "text", "area"))
    c = c.select(F.col("entry_id").cast("string").alias("entry_id"), _once(F.concat_ws(" ", "title", "text")).alias("_text"), F.col("area").alias("_area"))
    c = c.select("entry_id", F.coalesce(norm_question(F.col("_area")), F.lit("")).alias("_area"), _once(norm_question(F.col("_text"))).alias("searchable"))
    c = c.where(F.col("searchable") != "")
    size = F.length("searchable")
    entries = materialize(c.select("entry_id", "_area", size.alias("_len"), _band(size).alias("band"), F.array_distinct(F.split("searchable", " ")).alias("tokens"), "searchable"))
    bands = [r[0] for r in entries.select("band").distinct().collect()]  # at most 31
    same_area = (F.col("area") == "") | (F.col("_area") == "") | (F.col("area") == F.col("_area"))
    postings = entries.select("entry_id", "_area", "_len", "band", F.explode("tokens").alias("term"))

    terms = q.select(F.explode("terms").alias("term")).distinct()
    often = postings.join(terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    rare = q.select("query_id", F.explode("terms").alias("term")).join(often, "term", "left").groupBy("query_id")
    by_rarity = rare.agg(F.sort_array(F.collect_list(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), "term"))).alias("_sorted"))
    q = materialize(q.drop("terms").join(by_rarity, "query_id").withColumn("terms", F.transform("_sorted", lambda x: x["term"])).withColumn("met", F.transform(F.filter("_sorted", lambda x: x["df"] > 0), lambda x: x["term"])).drop("_sorted"))
    own = q.select("query_id", F.col("area"), F.size("terms").alias("n"), "inner", F.length("query_norm").alias("_a"))
    limit = F.greatest(F.lit(200), 4 * F.col("_a"))
    floored = lambda df, floor: df.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))

    n_terms = q.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]

    def shared(asked: DataFrame) -> DataFrame:
        """How many of the terms asked for an entry has; one row a pair, counted before the shuffle."""
        few = F.broadcast(asked) if n_terms <= FEW_TERMS else asked
        return postings.join(few, "term").where(same_area).groupBy("query_id", "entry_id").agg(F.count(F.lit(1)).cast("int").alias("both"), F.first("_len").alias("_len"))

    def compared(pairs: DataFrame, floor: DataFrame) -> DataFrame:
        """Scores of ``(query_id, entry_id, both, gram, _len)`` that may reach the query's floor."""
        full = floored(pairs.join(own, "query_id"), floor).withColumn("share", F.col("both") / F.col("n"))
        seen = F.least(F.col("_len"), limit)
        may = F.col("gram") | ((F.col("inner") > 0) & (F.col("both") >= F.col("inner")))
        bound = F.when(may, 1.0).otherwise(F.least(F.lit(0.99), (1 - sequence) * F.col("share") + sequence * _ratio_cap(F.col("_a"), seen, seen)))
        left = full.where((bound > 0) & (bound >= F.col("floor") - 1e-9)).select("query_id", "entry_id", "share", "floor")
        texts = left.join(entries.select("entry_id", "searchable"), "entry_id").join(q.select("query_id", "query_norm"), "query_id")
        texts = texts.withColumn("is_exact", F.col("searchable").contains(F.col("query_norm")))
        if not sequence:
            value = F.when(F.col("is_exact"), 1.0).otherwise(F.least(F.lit(0.99), F.col("share")))
            return texts.select("query_id", "entry_id", value.alias("score"), "is_exact").where("score > 0")
        part = F.pmod(F.xxhash64("entry_id"), F.lit(SPLITS))
        rows = texts.select("query_id", "entry_id", "query_norm", F.expr("substring(searchable, 1, greatest(200, 4 * length(query_norm)))").alias("head"), "share", "is_exact", "floor", part.alias("_part"))
        dealt = rows.repartition("query_id", "_part").sortWithinPartitions("query_id").drop("_part")
        return dealt.mapInPandas(_pair_scores(k, sequence), "query_id string, entry_id string, score double, is_exact boolean")

    scope = Scope(("query_id",), ("entry_id",), None, None)
    kth = lambda best: best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(0.0).alias("floor"))
    asking = q.select("query_id", "area", F.explode(F.slice("met", 1, PROBES)).alias("term"))
    probed = top_k(shared(asking), scope, [("both", False)], 4 * k).select("query_id", "entry_id")
    whole = lambda pairs: pairs.join(entries.select("entry_id", "_area", "_len", "band", "tokens"), "entry_id").join(q.select("query_id", "area", "terms"), "query_id").where(same_area).withColumn("both", F.size(F.array_intersect("terms", "tokens")))
    known = whole(probed).select("query_id", "entry_id", ((1 - sequence) * F.col("both") / F.size("terms")).alias("score"))
    probed = top_k(known, scope, [("score", False)], k)
    floor = materialize(kth(probed))

    band = F.explode(F.array(*[F.lit(b) for b in bands])) if bands else F.lit(0)
    asked = floored(own, floor).withColumn("band", band)
    low, high = F.least(F.pow(F.lit(2), F.col("band")), limit), F.least(F.pow(F.lit(2), F.col("band") + 1) - 1, limit)
    need = F.ceil((F.col("floor") - 1e-9 - sequence * _ratio_cap(F.col("_a"), low, high)) * F.col("n") / (1 - sequence) - 1e-9)
    need = F.greatest(F.when(F.col("inner") > 0, F.least(need, F.col("inner"))).otherwise(need), F.lit(0 if sequence else 1))
    asked = asked.withColumn("need", F.least(need, F.col("n")).cast("int")).select("query_id", "band", "need")
    counted = shared(q.select("query_id", "area", F.explode("met").alias("term"))).withColumn("band", _band(F.col("_len")))
    pairs = counted.join(asked, ["query_id", "band"]).where((F.col("need") > 0) & (F.col("both") >= F.col("need"))).select("query_id", "entry_id", "both", F.lit(False).alias("gram"), "_len")
    rest = asked.where("need = 0")
    more = [entries.select("entry_id", "band").join(rest, "band").select("query_id", "entry_id", F.lit(False).alias("gram"))] if sequence and not rest.isEmpty() else []
    short = q.where("words <= 2")
    if not short.isEmpty():
        more.append(_gram_pairs(short, entries).withColumn("gram", F.lit(True)))
    for extra in more:  # pairs that need not share a term: the overlap is taken from the token sets
        pairs = pairs.unionByName(whole(extra).select("query_id", "entry_id", "both", "gram", "_len"))
    pairs = materialize(pairs.groupBy("query_id", "entry_id").agg(F.max("both").alias("both"), F.max("gram").alias("gram"), F.first("_len").alias("_len")))
    if sequence:
        tried = top_k(pairs, scope, [("both", False)], 2 * k).drop("rank")
        floor = materialize(kth(top_k(compared(tried, floor), scope, [("score", False)], k)))
    best = top_k(materialize(compared(pairs, floor)), scope, [("score", False), ("is_exact", False)], k, "position")
    return best.withColumn("score", F.round("score", 4))


SNIPPET = 420
LEAD = 80


def snippet(text: Column, query: Column, limit: int = SNIPPET, lead: int = LEAD) -> Column:
    """X12. Window of the text from ``lead`` characters before the first query term (terms over 2 letters)."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    low = F.lower(clean)
    terms = F.filter(F.split(norm_question(query), " "), lambda t: F.length(t) > 2)
    places = F.filter(F.transform(terms, lambda t: F.instr(low, t)), lambda p: p > 0)
    start = F.greatest(F.coalesce(F.array_min(places), F.lit(1)) - 1 - lead, F.lit(0))
    cut = F.substring(clean, start + 1, F.lit(limit))
    framed = F.concat(
        F.when(start > 0, "...").otherwise(""), cut, F.when(start + limit < F.length(clean), "...").otherwise("")
    )
    return F.when(F.length(clean) <= limit, clean).otherwise(framed)


def augment(packs: DataFrame, hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """X13. Attach the snippets and their sources (at most ten per request) to evidence packs."""
    # corpus ids are unique, hits are few per query: an equi-join that aggregates per query afterwards
    joined = hits.join(corpus.select(F.col("entry_id").cast("string").alias("entry_id"), "title", "text", "source", "category"), "entry_id")
    asked = packs.select(F.col("query_id").cast("string").alias("query_id"), "query")
    item = F.struct("position", "entry_id", "title", snippet(F.col("text"), F.col("query")).alias("snippet"), "source", "score", "category")
    per = joined.join(asked, "query_id").groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("retrieved_snippets"))
    out = packs.withColumn("query_id", F.col("query_id").cast("string")).join(per, "query_id", "left")
    return out.withColumns(
        {
            "retrieval_sources": F.array_distinct(F.transform("retrieved_snippets", lambda s: s["source"])),
            "retrieval_note": F.lit("Local deterministic retrieval; no internet or external evidence was used."),
        }
    )
