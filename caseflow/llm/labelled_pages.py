"""Labelled pages for the main-text model, built from a few layouts by a seeded rule.

Blocks of main text have a `data-main` attribute. Layouts differ in how they mark the
article (by element, by class, or not at all) and in which boilerplate stands around and
inside it.
"""

from __future__ import annotations

import random

PAGES = 120
SEED = 11
_WORDS = (
    "river market early window letter morning stone garden paper winter little answer bridge "
    "story number travel summer yellow engine street coffee family music doctor island simple"
).split()


def _sentence(r: random.Random, low: int, high: int) -> str:
    words = [r.choice(_WORDS) for _ in range(r.randint(low, high))]
    return " ".join(words).capitalize() + "."


def _text(r: random.Random, sentences: int) -> str:
    return " ".join(_sentence(r, 3, 16) for _ in range(sentences))


def _links(r: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/{w}">{w}</a></li>' for w in r.choices(_WORDS, k=n))


def _boilerplate(r: random.Random) -> dict[str, str]:
    """One block of each kind of boilerplate."""
    short = _sentence(r, 2, 9)
    return {
        "nav": r.choice(["<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', '<div id="navbar"><ul>{}</ul></div>']).format(_links(r, r.randint(3, 8))),
        "crumbs": f'<div class="breadcrumb"><a href="/">home</a> / <a href="/x">{r.choice(_WORDS)}</a></div>',
        "header": r.choice(["<header><div>{}</div></header>", '<div class="header"><p>{}</p></div>', '<div id="masthead">{}</div>']).format(short),
        "footer": r.choice(["<footer>&copy; {}</footer>", '<div class="footer"><p>&copy; {}</p></div>', "<footer><p>{}</p><ul>" + _links(r, 3) + "</ul></footer>"]).format(short),
        "side": r.choice(["<aside><h3>{0}</h3><ul>{1}</ul></aside>", '<div class="sidebar"><p>{0}</p><ul>{1}</ul></div>', '<div class="related"><h3>{0}</h3><ul>{1}</ul></div>']).format(short, _links(r, 4)),
        "ad": r.choice(['<div class="ad">{}</div>', '<div class="ads"><p>{}</p></div>', '<div class="sponsored">{}</div>', '<div id="banner">{}</div>']).format(_text(r, r.randint(1, 2))),
        "notice": r.choice(['<div class="cookie-notice"><p>{}</p></div>', '<div class="newsletter">{}</div>', '<div role="alert">{}</div>', '<div class="notice">{}</div>']).format(_text(r, r.randint(1, 3))),
        "form": r.choice(["<form><label>{}</label><input><button>go</button></form>", '<form class="search"><p>{}</p><input></form>']).format(short),
        "comments": r.choice(['<div class="comments"><h3>{0}</h3><div class="comment"><p>{1}</p></div><div class="comment"><p>{2}</p></div></div>',
                              '<section id="comments"><p>{0}</p><ul><li><p>{1}</p></li><li><p>{2}</p></li></ul></section>']).format(short, _text(r, r.randint(1, 4)), _text(r, 2)),
        "share": f'<div class="share"><a href="#">{r.choice(_WORDS)}</a> <a href="#">{r.choice(_WORDS)}</a></div>',
    }


def _article(r: random.Random) -> str:
    """The blocks of an article, all marked."""
    blocks = [f"<h1 data-main>{_sentence(r, 2, 9)[:60]}</h1>"] if r.random() < 0.8 else []
    for _ in range(r.randint(1, 8)):
        kind = r.random()
        text = _text(r, r.randint(1, 7))
        if kind < 0.6:
            blocks.append(f"<p data-main>{text}</p>")
        elif kind < 0.68:
            blocks.append(f'<p data-main>{text} <a href="/a">{r.choice(_WORDS)}</a> {_sentence(r, 3, 9)}</p>')
        elif kind < 0.74:
            blocks.append(f"<p data-main><b>{text}<br>")
        elif kind < 0.80:
            blocks.append(f"<h2 data-main>{_sentence(r, 2, 6)}</h2><p data-main>{text}</p>")
        elif kind < 0.85:
            items = "".join(f"<li data-main>{_sentence(r, 3, 12)}</li>" for _ in range(3))
            blocks.append(f"<ul data-main>{items}</ul>")
        elif kind < 0.89:
            blocks.append(f"<blockquote data-main><p data-main>{text}</p></blockquote>")
        elif kind < 0.93:
            blocks.append(f"<pre data-main>{text}</pre>")
        elif kind < 0.97:
            cells = "".join(f"<td data-main>{w}</td>" for w in r.choices(_WORDS, k=3))
            blocks.append(f"<table data-main><tr data-main>{cells}</tr></table>")
        else:
            blocks.append(f"<figure data-main><figcaption data-main>{_sentence(r, 3, 9)}</figcaption></figure>")
    return "".join(blocks)


def labelled_pages(pages: int = PAGES, seed: int = SEED) -> list[str]:
    """Pages in whose HTML the blocks of main text have a `data-main` attribute."""
    out = []
    for i in range(pages):
        r = random.Random(seed * 1_000 + i)
        other = _boilerplate(r)
        inner = _article(r)
        if r.random() < 0.3:  # boilerplate inside the article
            at = inner.find("<p", len(inner) // 2)
            extra = other[r.choice(["ad", "share", "side", "notice"])]
            inner = inner[:at] + extra + inner[at:] if at > 0 else inner + extra
        if r.random() < 0.25:
            inner += other["comments"]
        wrap = r.choice([
            "<article data-main>{}</article>", "<main data-main><article data-main>{}</article></main>", "<main data-main>{}</main>",
            '<div class="content" data-main>{}</div>', '<div class="post" data-main><div class="entry-body" data-main>{}</div></div>',
            '<div id="story" data-main>{}</div>', "<div data-main>{}</div>", "<section data-main>{}</section>", "<article data-main><div data-main>{}</div></article>",
        ])
        before = [other[k] for k in ("header", "nav", "crumbs", "notice", "ad", "form") if r.random() < 0.5]
        after = [other[k] for k in ("share", "side", "comments", "ad", "form", "notice") if r.random() < 0.4]
        tail = other["footer"] if r.random() < 0.85 else ""
        body = "".join(before) + wrap.format(inner) + "".join(after) + tail
        if r.random() < 0.3:
            body = f'<div class="{r.choice(["wrapper", "page", "container"])}" data-main>{body}</div>'
        out.append(f"<!DOCTYPE html><html><head><title>x</title></head><body>{body}</body></html>")
    return out
