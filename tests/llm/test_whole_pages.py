"""Noise ends where its element ends, also without an end tag."""

import random

import pytest

from foliant.llm.html_main import main_text

REAL = "The river ran past the quiet garden, under the stone bridge, and out to the winter sea."
MORE = "A letter came in the morning, with copper ink, and nobody knew whose hand had written it."


@pytest.mark.parametrize(
    "html",
    [
        f'<article><p class="ad">Advert<p>{REAL}</p><p>{MORE}</p></article>',
        f'<article><ul><li class="share">Share<li>{REAL}<li>{MORE}</ul></article>',
        f'<div><section><div class="notice">Notice</section><p>{REAL}</p><p>{MORE}</p></div>',
        f'<article><p>{REAL}</p><div class="ad">Advert<div>Inner</div></div><p>{MORE} <span class="share">Share<br><b>it</b></span></p></article>',
        f'<main><nav><p>Menu<ul><li>One<li>Two</ul></nav><p>{REAL}</p><svg><g/><text>x</text></svg><p>{MORE}</p></main>',
    ],
)
def test_only_the_noise_is_left_out(html):
    assert main_text(html) == f"{REAL}\n{MORE}"


SHORT = "Closing note."


@pytest.mark.parametrize(
    "html, blocks",
    [
        # both parts of an article, also a short one
        (f"<article><div><p>{REAL}</p><p>{MORE}</p></div><div>{SHORT}</div></article>", [REAL, MORE, SHORT]),
        (f"<main><div><p>{REAL}</p><p>{MORE}</p></div><p>{SHORT}</p><pre>a  b</pre><table><tr><td>One<td>Two</table></main>", [REAL, MORE, SHORT, "a b", "One", "Two"]),
        (f'<article><p>{REAL}</p><p class="ad-hoc related">{MORE}</p></article>', [REAL, MORE]),
        # names with and without a header or an advert in them
        (f'<article><div class="section-header"><h2>Part</h2></div><p>{REAL}</p><div class="ad-slot">{MORE}</div><div class="adSlot">{MORE}</div></article>', ["Part", REAL]),
        (f'<div id="site-header"><p>{MORE}</p></div><div class="post"><p>{REAL}</p><p>{REAL}</p></div><div class="commentList"><p>{MORE}</p></div>', [REAL, REAL]),
        # nothing is marked as an article: the ancestor that gathers the paragraphs
        (f"<body><div><section><p>{REAL}</p><p>{MORE}</p></section><section><p>{MORE}</p><p>{REAL}</p></section><section><p>{REAL}</p></section></div></body>", [REAL, MORE, MORE, REAL, REAL]),
        (f'<div role="main"><h1>Head</h1><section><p>{REAL}</p></section><p>{SHORT}</p></div><div role="complementary"><p>{MORE}</p></div>', ["Head", REAL, SHORT]),
        # lists of links
        (f'<article><p>{REAL}</p><div class="related"><a href=1>One page</a> <a href=2>Another page</a></div><ul class="related"><li>{MORE}</li></ul></article>', [REAL, MORE]),
        (f'<article><p>{REAL}</p><article class="comment"><p>{MORE}</p></article></article>', [REAL]),
        (f"<body><p>{REAL}<p>{SHORT}<form><p>{MORE}</form><!-- <p>{MORE} --><footer><p>{MORE}</footer>", [REAL, SHORT]),
        ("<p>a &lt;b&gt; &amp;&nbsp;c&#x41; &eacute;", ["a <b> & cA é"]),
        ("<nav>Only a menu</nav>", ["Only a menu"]),
        ("  \n ", []),
    ],
)
def test_the_whole_article(html, blocks):
    assert main_text(html) == "\n".join(blocks)


def test_generated_pages_against_their_parts():
    """Random articles inside random templates, their blocks known: whatever the wrapping, the blocks and nothing else."""
    r = random.Random(4)
    words = "river stone letter morning quiet garden number open value house under water follow line copper ladder winter paper silver".split()
    sentence = lambda: " ".join(r.choices(words, k=r.randint(6, 14))).capitalize() + ", " + " ".join(r.choices(words, k=r.randint(4, 9))) + "."
    noise = [lambda: f"<nav><ul><li><a href=/>{sentence()}</a></ul></nav>", lambda: f'<div class="cookie-consent"><p>{sentence()} {sentence()}</p></div>', lambda: f"<aside><p>{sentence()}</p><p>{sentence()}</p></aside>", lambda: f"<form><label>{sentence()}</label><input></form>", lambda: f"<script>var x = '<p>{sentence()}</p>'</script>", lambda: f'<section id="comments"><p>{sentence()}<p>{sentence()}</section>', lambda: f'<div class="ad">{sentence()}</div>', lambda: f"<!-- {sentence()} -->", lambda: f"<style>p{{}}</style><footer>{sentence()}</footer>"]
    for _ in range(400):
        blocks, body = [], []
        for _ in range(r.randint(3, 12)):
            text = " ".join(sentence() for _ in range(r.randint(1, 4)))
            kind = r.choice(["p", "p", "p", "h2", "blockquote", "ul", "pre"])
            if kind == "ul":
                items = [sentence() for _ in range(r.randint(1, 4))]
                blocks += items
                body.append("<ul>" + "".join(f"<li>{x}" + r.choice(["", "</li>"]) for x in items) + "</ul>")
            else:
                blocks.append(text)
                marked = text.replace(" ", r.choice([" ", "  ", "\n", "&#32;"]), 3).replace("river", "<b>river</b>", 1)
                body.append(f"<{kind}>{marked}" + ("" if kind == "p" and r.random() < 0.4 else f"</{kind}>"))
            if r.random() < 0.25:
                body.append(r.choice(noise)())
        inner = "".join(body)
        if r.random() < 0.4:
            inner = "".join(f"<div>{x}</div>" for x in (inner,)) if r.random() < 0.5 else f"<section>{inner}</section>"
        holder = r.choice(["article", "main", 'div role="main"', 'div class="post-body"', "article"])
        page = f"<html><head><title>{sentence()}</title></head><body>{r.choice(noise)()}<{holder}>{inner}</{holder.split()[0]}>{r.choice(noise)()}{r.choice(noise)()}</body></html>"
        assert main_text(page) == "\n".join(blocks), page


LONG = "A long paragraph with commas, words, and enough text to be taken for the article. " * 3


def test_words_inside_attributes_values_are_no_names():
    for value in ("hidden", "role=form", "class=comment", "id=nav", "style=display:none", "aria-hidden=true", "hidden gems of the town"):
        for attr in ("title", "href", "data-x", "onclick", "alt"):
            for quote in ('"', "'"):
                page = f"<body><nav>menu</nav><article {attr}={quote}{value}{quote}><p>{LONG}</p><p {attr}={quote}{value}{quote}>The second, which stays.</p></article></body>"
                assert main_text(page) == f"{LONG.strip()}\nThe second, which stays.", (attr, value)
    assert main_text(f'<article><p>{LONG}see <a href="/go?role=form">linked phrase</a>.</p></article>').endswith("see linked phrase.")
    assert main_text(f"<article><p>{LONG}</p><p onclick=\"x=style='display:none'\">Stays.</p><p hidden>Goes.</p><p class=ad>Goes.</p></article>") == f"{LONG.strip()}\nStays."


def test_parts_of_names_within_an_article():
    kept = "".join(f'<div class="{c}">Of {c}, text that stays.</div>' for c in ("form-of-government", "market-share-report", "comment-on-the-text", "menu-of-the-day"))
    gone = "".join(f'<div class="{c}">Words of {c}</div>' for c in ("share-buttons", "comment-list", "newsletter-signup", "ad-slot", "sidebar-left", "cookie-banner", "post-comments", "reply-form"))
    text = main_text(f"<body><article><p>{LONG}</p>{kept}{gone}</article></body>")
    assert text.count("text that stays") == 4 and "Words of" not in text


def test_a_short_division_beside_a_long_one_stays():
    assert main_text(f"<body><div class=content><div>{LONG}</div><div>Short second, one.</div></div></body>") == f"{LONG.strip()}\nShort second, one."
