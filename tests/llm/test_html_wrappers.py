"""Pages without </head>, and pages wrapped in a form or in an element with a name that is usually left out."""

import pytest

from gridspark.llm.html import article_text

TEXTS = [f"Paragraph number {i} of the article, with a comma, and enough words to count as text of its own." for i in range(5)]
BODY = "".join(f"<p>{t}</p>" for t in TEXTS)
WANT = " ".join(TEXTS)
NOISE = '<div class="sidebar"><p>Aside words, that nobody wants to read here.</p></div><form><p>Sign up, now, for the letter.</p></form>'


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title><meta charset=x><body>{BODY}</body></html>",
        f"<html><head><title>t</title><style>p {{}}</style><div>{BODY}</div></html>",
        f"<html><head><title>t</title><noscript><img src=x></noscript><title>u</title></head><body>{BODY}</body></html>",
        f"<html><head><noscript><body>{BODY}</body></html>",
        f"<html><body><form id=aspnet>{NOISE.replace('form', 'section class=signup')}<div>{BODY}</div></form></body></html>",
        f'<html><body><div class="content has-sidebar"><div>{BODY}</div>{NOISE}</div></body></html>',
        f'<html><body><div class="post-share-enabled">{BODY}</div></body></html>',
    ],
)
def test_the_article_is_found(page):
    assert article_text(page) == WANT


def test_what_is_named_still_goes():
    assert article_text(f"<body><div>{BODY}</div>{NOISE}</body>") == WANT
    comments = '<div class="comments">' + "<p>I think so, too, and much more, of course, as ever.</p>" * 20 + "</div>"
    assert article_text(f"<body><article>{BODY}</article>{comments}</body>") == WANT
    assert article_text(f"<body><div>{BODY}</div>{comments}</body>") == WANT


WORDS = [f"Part {i} has words enough, as an article would, and says what it has to say." for i in range(3)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("".join(f"<div class='elementor-widget text'><p>{w}</p></div>" for w in WORDS), " ".join(WORDS)),
        (f"<h1>Title</h1><div class='widget-content'>{WORDS[0]}</div><div class='widget-content'>{WORDS[1]}</div>", f"Title {WORDS[0]} {WORDS[1]}"),
        (f"<article>{BODY}<div id='social-history'><p>{WORDS[0]}</p><p>{WORDS[1]}</p></div></article>", f"{WANT} {WORDS[0]} {WORDS[1]}"),
        (f"<body><aside><p>Some teaser here</p><article>{BODY}</article></body>", WANT),
        (f"<body><nav><a href=x>Home</a><h1>T</h1><article>{BODY}<footer>By me</footer></article></body>", WANT),
        (f"<body><nav><a href=x>Home</a><main>{BODY}</main></body>", WANT),
        (f"<body><article>{BODY}</article><!-- open <p>more", WANT),
        (f"<body><article>{BODY}</article><div class='x", WANT),
        (f"<body><article>{BODY}</article>a < b", f"{WANT}"),
        (f"<div class='post-body'>{BODY}<div class='post-share'>Share this</div><div class='x-related'><a href=a>One more of these pages, to read</a></div></div>", WANT),
        (f"<div class='post-body'>{BODY}<div class='site-search'><p>{WORDS[0]}</p></div><div class='notice'>{WORDS[1]}</div></div>", WANT),
        (f"<div class='post-body'>{BODY}</div><aside><article><p>{WORDS[0]}</p></article></aside>", WANT),
        ("<body><nav><a href=x>Home</a></nav><footer>All rights are with the owner, as ever, of course.</footer></body>", ""),
        (f"<div id=page><div class='elementor-widget'><h2>Head</h2></div><div class='elementor-widget'><p>{WORDS[2]}</p></div></div>", f"Head {WORDS[2]}"),
    ],
)
def test_names_weigh_and_unclosed_elements_lose_nothing(page, want):
    assert article_text(page) == want
