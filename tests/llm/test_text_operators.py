import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from gridspark.llm import packing, quality
from gridspark.llm.html import article_text, extract_pages
from gridspark.llm.packing import best_fit, pack_documents, piece_ids
from gridspark.llm.quality import keep_good
from gridspark.llm.sentencepieces import PieceModel, decode_documents, encode_and_decode, encode_documents
from gridspark.llm.token_counts import cut_totals, length_histogram, quantiles, token_lengths
from gridspark.llm.words import WordIds
from tests.llm import brute

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def odd_texts(letters, n, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(letters) for _ in range(rnd.randrange(50))) for _ in range(n)]


# --- packing -------------------------------------------------------------------------------------------------------


def test_best_fit_takes_the_fullest_bin():
    assert best_fit(np.array([6, 5, 4, 3, 2]), 10).tolist() == [0, 1, 0, 1, 1]


def test_word_ids_equal_the_tokenizer():
    texts = odd_texts("aeiotTK.,,..'s İẞß̈́K<|>1x \n\t\u0085 中", 3000) + ["<|endoftext|>", "THE. The, the.,", "A.B. C,D"]
    texts += odd_texts("aeétTKÀº.,,..'s12²½&-_  \n\t", 3000) + odd_texts("abTK.,,1'&  \n\v", 2000) + ["", "\ue000 x \ue000.", "½. ². º. _. -., 1.,", "x" * 5000 + "."]
    encode = WordIds(WORDS)
    got = [np.frombuffer(x, "<u4").tolist() for x in encode.together([t.encode() for t in texts])]
    assert got == [e.ids for e in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_word_ids_change_generation(monkeypatch):
    monkeypatch.setattr("gridspark.llm.words.KEPT_WORDS", 3)
    encode = WordIds(WORDS)
    texts = ["one two, three.", "two four", "one two", "five six seven", "two"]
    got = [np.frombuffer(x, "<u4").tolist() for t in texts for x in encode.together([t.encode()])]
    assert got == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize(("length", "node"), [(4096, packing.NODE), (64, 40)])
def test_packing_matches_the_tokenizer(documents, sample, length, node):
    rows = pack_documents(documents, WORDS, length, slack=length // 512, node=node).collect()
    want = brute.pieces(sample, length)
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    used, least = brute.check_sequences(rows, length), -(-sum(x[1] for x in want.values()) // length)
    assert used <= 1.03 * least + 1


def test_packing_of_pieces_that_do_not_fit_together(spark):
    df = spark.range(0, 300, 1, 20).selectExpr("id doc_id", "repeat('word ', 40) text")
    rows = pack_documents(df, WORDS, 64, node=30).collect()
    assert brute.check_sequences(rows, 64) == 300


def test_packing_of_nothing(empty):
    assert pack_documents(empty, WORDS).count() == 0


def test_packing_repeated_rows_and_piece_ids(twice):
    assert Counter(r.doc_id for r in pack_documents(twice, WORDS).collect()) == {1: 3, None: 3, 2: 1}
    ids = [r.ids for r in piece_ids(twice.where("doc_id = 2"), WORDS, 50).orderBy("piece").collect()]
    assert len(ids) > 1 and len(ids[0]) == 50 and ids[-1][-1] == 1


# --- quality rules -------------------------------------------------------------------------------------------------


def test_base_counts_match_brute_force(documents, sample):
    got = {r.doc_id: tuple(r)[1:] for r in quality.quality(documents).select("doc_id", *quality.COUNTS[:5], "base_failed").collect()}
    assert got == {i: brute.base_counts(t) for i, t in sample}


def test_repeated_words_by_tuples():
    rnd = random.Random(8)
    for _ in range(300):
        ws = [rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randrange(40))]
        assert quality.repeated_words(ws) == brute.base_counts(" ".join(w.decode() for w in ws))[4]


def test_model_recovers_planted_accuracies():
    rng = np.random.default_rng(1)
    k, n = len(quality.RULES), 200_000
    good = rng.random(n) < 0.85
    right_good, right_bad = np.linspace(0.9, 0.98, k), np.linspace(0.4, 0.7, k)
    right = rng.random((n, k)) < np.where(good[:, None], right_good, right_bad)
    vote = np.where(right, 1, -1) * np.where(good, 1, -1)[:, None]
    vote[rng.random((n, k)) < 0.1] = 0
    pattern, count = np.unique((vote + 1) @ quality.PLACES, return_counts=True)
    model = quality.fit(pattern, count.astype(float))
    assert abs(model.share - 0.85) < 0.02 and np.abs(model.good - right_good).max() < 0.03 and np.abs(model.bad - right_bad).max() < 0.05
    assert ((model.posterior((vote + 1) @ quality.PLACES) >= 0.5) == good).mean() > 0.97


def test_verdicts_against_labels(spark):
    """The labels are no input of the model: they are held-out truth."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = quality.quality(docs).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05


def test_quality_stage_keeps_rows_as_they_are(documents, sample):
    kept = {r.doc_id for r in quality.quality(documents).where("kept").collect()}
    out = keep_good(documents)
    assert out.columns == documents.columns
    rows = out.collect()
    assert {r.doc_id for r in rows} == kept and all(r.text == dict(sample)[r.doc_id] for r in rows)


def test_quality_of_rows_without_words(twice, empty):
    assert [r.kept for r in quality.quality(twice.where("text is null")).collect()] == [False]
    assert quality.quality(empty).collect() == [] and keep_good(empty).collect() == []


# --- SentencePiece -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_equal_the_library(library, sample):
    model = PieceModel(PIECES)
    texts = odd_texts("aeiotnshr  ▁\né中1.", 3000) + [t or "" for _, t in sample] + [" " * k + "x" + " " * k for k in range(20)]
    ids = [model.encode(t) for t in texts]
    assert ids == library.encode(texts)
    assert [model.decode([*x, 2]) for x in ids] == [library.decode([*x, 2]) for x in ids]


def test_decoding_of_any_ids(library):
    model, rnd = PieceModel(PIECES), random.Random(4)
    for _ in range(2000):
        ids = [rnd.randrange(0, 700) for _ in range(rnd.randrange(12))]
        assert model.decode(ids) == library.decode(ids)


def test_pieces_with_small_memories(library, monkeypatch):
    for name in ("KEPT_WORDS", "KEPT_PAIRS", "KEPT_CHARS"):
        monkeypatch.setattr(f"gridspark.llm.sentencepieces.{name}", 3)
    model = PieceModel(PIECES)
    for t in ["one two two. two, the end, ends.", "z" * 300, "the theme thematic themes"]:
        assert model.encode(t) == library.encode(t)


def test_encode_and_decode(documents, sample, library, twice, empty):
    got = {r.doc_id: tuple(r)[1:] for r in encode_and_decode(documents, PIECES).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in sample:
        ids = library.encode(t or "", add_eos=True)
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
    assert encode_and_decode(twice, PIECES).count() == 7 and encode_and_decode(empty, PIECES).collect() == []


def test_real_ids_and_texts_round_trip(documents, sample):
    texts = {r.doc_id: r.text for r in decode_documents(encode_documents(documents, PIECES), PIECES).collect()}
    assert texts == {i: (t or "").replace("▁", " ") for i, t in sample}


# --- token counts --------------------------------------------------------------------------------------------------


def test_token_counts_match_brute_force(documents, sample, empty):
    import base64

    import tiktoken

    with open(RANKS, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    sizes = [len(encoding.encode_ordinary(t or "")) for _, t in sample]
    hist = length_histogram(token_lengths(documents, RANKS, public_tokenizers.PATTERN)).persist()
    assert {r.length: tuple(r)[1:5] for r in hist.collect()} == {
        k: (n, sum(s >= k for s in sizes), sum(s for s in sizes if s >= k), sum(min(s, k) for s in sizes)) for k, n in Counter(sizes).items()
    }
    assert {r.limit: (r.tokens, r.docs_cut) for r in cut_totals(hist, [0, 100, 5000]).collect()} == {
        k: (sum(min(s, k) for s in sizes), sum(s > k for s in sizes)) for k in (0, 100, 5000)
    }
    order = sorted(sizes)
    assert {r.share: r.length for r in quantiles(hist, [0.1, 0.5, 1.0]).collect()} == {q: order[int(np.ceil(q * len(order) - 1e-9)) - 1] for q in (0.1, 0.5, 1.0)}
    assert length_histogram(token_lengths(empty, RANKS, public_tokenizers.PATTERN)).collect() == []


# --- HTML ----------------------------------------------------------------------------------------------------------

PARAGRAPH = "A sentence with some words, and a comma, that is long enough to be taken for a paragraph of an article."
CASES = {
    "article": (f"<nav><a href=/x>Menu</a></nav><article><h1>Title</h1><p>{PARAGRAPH}</article><footer>&copy; all</footer>", f"Title {PARAGRAPH}"),
    "short article": ("<body><div class=ad>Buy now, buy here, buy all of this.</div><article><h1>T</h1><p>Two words.</p></article></body>", "T Two words."),
    "plain divs": (
        f"<div id=sidebar><p>{PARAGRAPH}</p></div><div id=content><h2>Head</h2><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div><div class='cookie-notice'>ok</div>",
        f"Head {PARAGRAPH} {PARAGRAPH}",
    ),
    "link list beside": (
        "<div>" + "".join(f"<p><a href=/{i}>A linked line, with commas, of some length {i}</a></p>" for i in range(9)) + f"</div><div><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div>",
        f"{PARAGRAPH} {PARAGRAPH}",
    ),
    "sibling joins": (f"<div><div><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div><div><p>{PARAGRAPH}</p></div></div>", " ".join([PARAGRAPH] * 3)),
    "headers": (
        f"<header><p>{PARAGRAPH}</p></header><div class=page-header><p>{PARAGRAPH}</p></div><div><div class=entry-header><h1>Title</h1></div><p>{PARAGRAPH}</p></div>",
        f"Title {PARAGRAPH}",
    ),
    "header of an article": (f"<article><header><h1>Title</h1></header><p>{PARAGRAPH}</p></article>", f"Title {PARAGRAPH}"),
    "comments": (f"<article><p>{PARAGRAPH}</p><section id=comments><p>{PARAGRAPH}</p></section></article>", PARAGRAPH),
    "entities and space": ("<article><p> a&nbsp;&amp;\n\t b <b>c</b>d<br>e&#233; &lt;p&gt; </p><script>var x='<p>no</p>'</script><style>p{}</style></article>", "a & b cd eé <p>"),
    "unclosed": ("<article><p><b>one<br><p>two<ul><li>three<li>four", "one two three four"),
    "form": (f"<main><p>{PARAGRAPH}</p><form><label>Name</label><input><button>Go</button></form></main>", PARAGRAPH),
    "comment node": (f"<article><!-- no --><p>{PARAGRAPH}</p></article>", PARAGRAPH),
    "empty": ("", ""),
    "blank": (" \n ", ""),
    "text only": ("just text", "just text"),
    "all left out": ("<nav>menu</nav><footer>foot</footer>", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_article_text(name):
    page, want = CASES[name]
    assert article_text(page) == want


def test_deep_and_long_pages():
    assert article_text("<div>" * 3000 + f"<p>{PARAGRAPH}</p>") == PARAGRAPH
    assert article_text("<article>" + f"<p>{PARAGRAPH}</p>" * 3000 + "</article>") == " ".join([PARAGRAPH] * 3000)


def test_pages_of_the_table(spark):
    """The table's pages have one article each, so its text can be cut out plainly."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in extract_pages(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(</article>|<footer>|$)", r.html, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?p>|</?h1>|<br>", inside)]
        want = " ".join(b for b in blocks if b)
        assert got[r.page_id] == (want, len(want))


def test_pages_with_nulls_and_repeats(spark):
    rows = [(1, None, None, "x"), (1, None, None, "x"), (None, "u", "<p>text</p>", None)]
    out = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in out) == [("1", "None", "", 0), ("1", "None", "", 0), ("None", "u", "text", 4)]
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
