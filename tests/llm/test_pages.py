"""Main texts of pages made from known blocks, and pages on which class words and windows decide."""

import random

import pytest

from ferrule.llm.extract import main_text

SENTENCE = "This is a sentence of the article that goes on for a while. "
BODY = f"<p>{SENTENCE * 5}</p>"
TOLD = (SENTENCE * 5).strip()
MENU = '<div class="main-menu"><a href="/1">Home</a> <a href="/2">About us</a></div>'


def made_page(r):
    """(html, text): blocks of an article in random containers, and around them what is no part of it."""
    words = lambda n: " ".join(r.choice(["alpha", "beta", "gamma &amp; delta", "épsilon", "x &lt; y", "zeta&nbsp;eta", "it&#39;s", "&#x65;nd"]) for _ in range(n))
    plain = lambda s: s.replace("&amp;", "&").replace("&lt;", "<").replace("&nbsp;", " ").replace("&#39;", "'").replace("&#x65;", "e")
    blocks, text = [], []
    for _ in range(r.randrange(2, 9)):
        said = words(r.randrange(14, 60))
        tag = r.choice(["p", "p", "div", "li", "blockquote", "section"])
        inner = said.replace(" ", r.choice([" ", "\n  ", " <b>", " <!-- x --> "]), 1) if r.random() < 0.5 else said
        inner += "</b>" if "<b>" in inner else ""
        name = r.choice(["", "", ' class="sharing-economy"', ' id="the-subscription-model"'] if tag in ("p", "li", "blockquote") else ["", ' class="has-menu intro"'])
        blocks.append(f"<{tag}{name}>{inner}</{tag}>")
        text.append(" ".join(plain(said).split()))
        if r.random() < 0.3:
            blocks.append(r.choice([
                '<div class="ad-slot">Buy two and get one free today only</div>', "<script>var a = '<p>no</p>';</script>", "<style>p { x: y }</style>", "<form><p>Your name</p><input></form>",
                '<aside><p>More about this</p></aside>', "<figure><svg><text>no</text></svg></figure>", '<div class="share-buttons"><a href="/f">Share</a></div>',
            ]))
    body = "".join(blocks)
    wrap = r.choice(["<article>{}</article>", "<main><article>{}</article></main>", '<div id="content">{}</div>', '<form action="/"><div class="text">{}</div></form>'])
    before = r.choice([f"<header><h1>Site</h1>{MENU}</header>", f"<nav>{MENU}</nav>", MENU])
    after = "".join(r.sample([
        '<div class="sidebar"><p>' + "All about this site and its makers. " * 3 + "</p></div>", '<div class="comments"><p>' + "I like this text a lot, thank you. " * 4 + "</p></div>",
        "<footer><p>All rights reserved 2026</p></footer>", '<div class="cookie-notice"><p>We use cookies. Accept them all?</p></div>', '<section id="disqus"><p>' + "Me too. " * 20 + "</p></section>",
    ], r.randrange(1, 4)))
    outer = r.choice(["{}", '<div class="page-nav-open">{}</div>', '<div class="wrapper">{}</div>'])
    return f"<html><head><title>T</title></head><body>{outer.format(before + wrap.format(body) + after)}</body></html>", " ".join(text)


@pytest.mark.parametrize("seed", range(6))
def test_pages_give_back_what_they_were_made_from(seed):
    r = random.Random(seed)
    for _ in range(250):
        page, text = made_page(r)
        assert main_text(page) == text, page


def test_a_form_around_a_page_is_no_form():
    assert main_text(f'<body><form id="aspnetForm">{MENU}<div>{BODY}</div></form></body>') == TOLD
    assert main_text(f"<article>{BODY}<form><p>Write to us, leave your name and address here please.</p></form></article>") == TOLD


def test_class_words_count_as_whole_tokens():
    assert main_text(f'<body><div class="page-nav-open">{MENU}<div>{BODY}</div><div class="sidebar"><p>{SENTENCE}</p></div></div></body>') == TOLD
    assert main_text(f'<div class="page-nav-open"><h2>Site</h2><article>{BODY}</article></div>') == TOLD
    assert main_text(f'<div>{BODY}{BODY}</div><div class="left-sidebar">{BODY}</div>') == f"{TOLD} {TOLD}"
    short = '<p class="sharing-economy">A short line.</p><p id="the-subscription-model">And one more.</p>'
    assert main_text(f"<article>{BODY}{short}</article>") == f"{TOLD} A short line. And one more."


def test_marks_inside_an_article_are_weighed():
    for mark in ("menu", "share", "newsletter", "promo-box"):
        assert main_text(f'<article>{BODY}<section class="{mark}">{BODY}</section></article>') == f"{TOLD} {TOLD}", mark
        assert main_text(f'<article>{BODY}<section class="{mark}"><p>Tell all your friends</p></section></article>') == TOLD, mark
    for mark in ("comments", "comment-list", "advertisement", "cookie-notice"):
        assert main_text(f'<article>{BODY}<section class="{mark}">{BODY * 4}</section></article>') == TOLD, mark


def test_doubtful_elements_by_their_windows():
    """Long text under a doubtful mark stays, short text goes; a doubt inside another is judged by itself."""
    inner = f'<div class="widget"><p>Short thing</p></div><div class="notice">{BODY}</div>'
    assert main_text(f'<article>{BODY}<div class="related">{BODY}{inner}</div></article>') == f"{TOLD} {TOLD} {TOLD}"
    assert main_text(f'<article>{BODY}<div class="related"><p>See also</p>{inner}</div></article>') == f"{TOLD} {TOLD}"


def test_short_articles_stay_and_teasers_go():
    assert main_text(f"<article><p>Short note.</p></article><article>{BODY}</article>") == f"Short note. {TOLD}"
    assert main_text(f'<article>{BODY}</article><article><h3><a href="/x">Another text</a></h3><p>It tells</p></article>') == TOLD


def test_windows_part_link_lists_from_text():
    """No element says what is text here: three lines that are links part the lines before from those behind."""
    links = "".join(f'<div><a href="/{i}">Somewhere else, number {i}, with a long name</a></div>' for i in range(5))
    lines = "".join(f"<div>{SENTENCE * 2}</div>" for _ in range(4))
    assert main_text(f"<body>{links}<section>{lines}</section>{links}</body>") == " ".join([(SENTENCE * 2).strip()] * 4)
