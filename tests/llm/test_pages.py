"""Page text: the density decides, checked against a recursive version, and time in proportion to the page."""

import html.parser
import math
import random
import time

import pytest

from solidframe.llm import html_text
from solidframe.llm.html_text import BLOCKS, Densities, Page, main_text

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


#: No element says what it is by its tag or class.
NEUTRAL = """<html><body><div class=a1><div class=a2>%s</div><div class=a3><h1>On density</h1><p>%s</p><p>Short one.</p><p>%s</p>
<div><p>%s</p><p>Tiny.</p></div></div><div class=a4>%s</div></div></body></html>"""


def neutral(rng):
    links = "".join(f"<div><a href=/{k}>{prose(rng, 2)}</a></div>" for k in range(12))
    long = [prose(rng, n) for n in (60, 40, 50)]
    return NEUTRAL % (links, *long, links), "\n".join(["On density", long[0], "Short one.", long[1], long[2], "Tiny."])


def test_density_finds_an_article_without_a_name(monkeypatch):
    page, want = neutral(random.Random(1))
    assert main_text(page) == want
    for constant in (0.0, 1.0):
        monkeypatch.setattr(html_text, "_density", lambda *_, c=constant: c)
        assert main_text(page) != want


def test_threshold_takes_other_parts_and_headings():
    rng = random.Random(2)
    one, two, three = (prose(rng, n) for n in (80, 70, 60))
    page = f"<body><div><a href=x>menu</a> <a href=y>more</a></div><h2>Head</h2><div><p>{one}</p><p>{two}</p></div><p>in between</p><div><p>{three}</p></div><div><a href=z>next</a></div></body>"
    assert main_text(page) == "\n".join(["Head", one, two, "in between", three])
    wrapped = page.replace("<div><p>", "<article><p>").replace("</p></div>", "</p></article>")
    assert main_text(wrapped) == main_text(page)


def test_links_in_a_body_without_blocks():
    assert main_text("<body>Plain <a href=x>with a rather long link</a> text</body>") == "Plain with a rather long link text"
    assert main_text("<body><a href=x>only a link</a></body>") == "only a link"


class Tree(html.parser.HTMLParser):
    def __init__(self, source):
        super().__init__()
        self.root = self.now = ["body", None, []]
        self.feed(source)

    def handle_starttag(self, tag, attrs):
        node = [tag, self.now, []]
        self.now[2].append(node)
        self.now = node

    def handle_endtag(self, tag):
        self.now = self.now[1]

    def handle_data(self, data):
        self.now[2].append(data)


def count(node, linked=False):
    """Characters, tags, characters and tags in links, as the paper counts them."""
    linked = linked or node[0] == "a"
    c = t = lc = lt = 0
    for x in node[2]:
        if isinstance(x, str):
            c += len(x.strip())
            lc += len(x.strip()) * linked
        else:
            a, b, d, e = count(x, linked)
            c, t, lc, lt = c + a, t + b + 1, lc + d, lt + e + (x[0] == "a")
    return c, t, lc, lt


def nodes(node):
    yield node
    for x in node[2]:
        if not isinstance(x, str):
            yield from nodes(x)


def density(node, body):
    c, t, lc, lt = count(node)
    bc, _, blc, _ = count(body)
    if not blc:
        return c / max(t, 1)
    lt += node[0] == "a"
    base = math.log(c / max(c - lc, 1) * lc + blc / bc * c + math.e)
    return c / max(t, 1) * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0)) / max(math.log(base), 1e-3)


def random_tree(rng, depth):
    if not depth or rng.random() < 0.2:
        return prose(rng, rng.randrange(1, 20))
    tag = rng.choice(["div", "section", "p", "a", "b", "div"])
    inner = "".join(random_tree(rng, 0 if tag in ("p", "a", "b") else depth - 1) for _ in range(1 if tag in ("p", "a", "b") else rng.randrange(1, 5)))
    return f"<{tag}>{inner}</{tag}>"


@pytest.mark.parametrize("seed", range(20))
def test_densities_match_a_recursive_version(seed):
    rng = random.Random(seed)
    source = "".join(random_tree(rng, 4) for _ in range(4))
    page = Page(source)
    found = Densities(page, page.dropped(), page.events)
    body = Tree(source).root
    own = list(nodes(body))
    assert [x[0] for x in own] == page.tags
    want = [density(x, body) for x in own]
    assert found.density == pytest.approx(want)
    sums = [sum(density(c, body) for c in x[2] if not isinstance(c, str) and c[0] in BLOCKS) or d for x, d in zip(own, want, strict=True)]
    assert found.sums == pytest.approx(sums) and found.sums[found.best[0]] == pytest.approx(max(s for s, x in zip(sums, own, strict=True) if x[0] in BLOCKS))


@pytest.mark.parametrize("page", ["<span>" * 20_000 + "</i>" * 20_000, "<i><div>" + "<span>" * 20_000 + "</i>" * 20_000, "<p>" + "<b>" * 20_000 + "<p>x" * 20_000, "<div>" * 20_000 + "<li>x" * 20_000])
def test_time_in_proportion(page):
    began = time.time()
    main_text(page)
    assert time.time() - began < 2


@pytest.mark.parametrize("name", ["article", "div"])
def test_query_nine_finds_articles_whatever_their_tag(spark, sf_dir, name):
    """The pages of the synthetic tables, their article under another tag too, against the text between its tags."""
    import html as entities
    import re

    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<br>", " ", x).replace("<b>", "").replace("</b>", "")).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        got = main_text(r.html.replace("<article>", f"<{name}>").replace("</article>", f"</{name}>"))
        assert got == "\n".join(x for x in blocks if x)
