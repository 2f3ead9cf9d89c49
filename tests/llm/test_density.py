"""Composite densities against a plain tree walk, and pages on which only they can choose."""

import math
import random

import pytest

from tidemark.llm import main_text as mt


def walk(page, dropped, texts):
    """Density, sum and least-on-path core of every kept node, written out recursively."""
    def kids(k):
        return [x for x in texts[k] if isinstance(x, int) and not dropped[x]]

    def below(k, in_link):
        """(characters, tags, characters in links, link tags) under k."""
        in_link = in_link or page.tag[k] == "a"
        c = sum(len(" ".join(x.split())) for x in texts[k] if isinstance(x, str))
        t, lc, lt = 0, 0, 0
        for x in kids(k):
            a, b, d, e = below(x, in_link)
            c, t, lc, lt = c + a, t + b + 1, lc + d, lt + e + (page.tag[x] == "a")
        return c, t, c if in_link else lc, lt

    def links_above(k):
        return k > 0 and (page.tag[k] == "a" or links_above(page.parent[k]))

    found = {k: below(k, links_above(page.parent[k]) if k else False) for k in range(len(page.tag)) if not dropped[k]}
    body = next((k for k in found if page.tag[k] == "body" and found[k][0]), 0)
    share = found[body][2] / max(found[body][0], 1)

    def density(c, t, lc, lt):
        if c == 0:
            return 0.0
        weight = max(1.0, (c / max(1, lc)) * (max(1, t) / max(1, lt)))
        # The logarithm's base is one itself; base 1 stands for a page without links.
        base = math.log(c * lc / max(1, c - lc) + share * c + math.e)
        return c / max(1, t) * (math.log(weight, base) if base > 1 else math.log(weight + 1))

    dense = {k: density(*v) for k, v in found.items()}
    sums = {}
    for k in found:
        own = [len(" ".join(x.split())) for x in texts[k] if isinstance(x, str) and x.strip()]
        linked = links_above(k)
        sums[k] = sum(dense[x] for x in kids(k)) + sum(density(c, 1, c if linked else 0, int(linked)) for c in own)
    under, todo = [], [body]
    while todo:
        k = todo.pop()
        under.append(k)
        todo += kids(k)
    return dense, sums, body, max(under, key=lambda k: (sums[k], -k))


def test_densities_equal_a_plain_walk(spark, sf_dir):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]
    assert len(pages) > 20
    for source in pages:
        page = mt.Page(source or "")
        dropped, texts = mt.kept_texts(page)
        d = mt.Densities(page, dropped, texts)
        dense, sums, body, core = walk(page, dropped, texts)
        assert d.body == body
        for k in dense:
            assert math.isclose(d.dense[k], dense[k], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(d.sums[k], sums[k], rel_tol=1e-9, abs_tol=1e-9)
        if d.chars[d.body]:
            assert mt.select(page, d)[0] == core


def paragraphs(n, seed, words=40):
    rng = random.Random(seed)
    texts = [" ".join(f"{rng.choice('bcdfg')}o{rng.choice('rstv')}e{k}" for k in range(words)) + "." for _ in range(n)]
    return "".join(f"<p>{t}</p>" for t in texts), " ".join(texts)


LINKS = "<ul>" + "".join(f"<li><a href='/{k}'>Entry number {k}</a></li>" for k in range(40)) + "</ul>"
BODY, BODY_TEXT = paragraphs(5, 1)
MORE, MORE_TEXT = paragraphs(3, 2)
FOOT = "<div class=c3><p>About this site <a href=/a>x</a></p></div>"
BARE = {
    "menu, text, foot": (f"<div class=w><div class=c1>{LINKS}</div><div class=c2>{BODY}</div>{FOOT}</div>", BODY_TEXT),
    "text, menu": (f"<div><div>{BODY}</div><div>{LINKS}</div></div>", BODY_TEXT),
    "menu inside the text's own block": (f"<div>{BODY}<div>{LINKS}</div>{MORE}</div>", f"{BODY_TEXT} {MORE_TEXT}"),
    "two parts around a menu": (f"<div>{BODY}</div><div>{LINKS}</div><div>{MORE}</div>{FOOT}", f"{BODY_TEXT} {MORE_TEXT}"),
    "deep": (f"<table><tr><td>{LINKS}</td><td><div><div>{BODY}</div></div></td></tr></table>", BODY_TEXT),
    "a paragraph with links stays": (
        f"<div><div>{LINKS}</div><div>{BODY}<p>See <a href=/1>one thing</a> and <a href=/2>another thing</a> for more on it.</p></div></div>",
        f"{BODY_TEXT} See one thing and another thing for more on it."),
    "a short paragraph stays": (f"<div><div>{LINKS}</div><div>{BODY}<p>So.</p>{MORE}</div></div>", f"{BODY_TEXT} So. {MORE_TEXT}"),
}


@pytest.mark.parametrize("name", BARE)
def test_bare_pages(name):
    """Elements without telling names: the densities alone tell the text from menus and footers."""
    source, text = BARE[name]
    assert mt.main_text(f"<html><body>{source}</body></html>") == text


def test_bare_pages_need_the_densities(monkeypatch):
    monkeypatch.setattr(mt.Densities, "of", lambda *_: 0.0)
    wrong = [name for name, (source, text) in BARE.items() if mt.main_text(f"<html><body>{source}</body></html>") != text]
    assert len(wrong) == len(BARE)
