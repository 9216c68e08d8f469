"""Mixing, URL filter, quality rules: against brute force, the awkward cases, and plans without Python."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from solidframe.llm.mixing import mix_sources, targets
from solidframe.llm import quality_rules as rules_of
from solidframe.llm.quality_rules import quality_rules, text_statistics
from solidframe.llm.queries import QUERIES
from solidframe.llm.url_filter import host_of, path_of, url_filter


def fill(sizes, weights, total, cap):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = total * sum(sizes.values()), set(names), {}
    while open_:
        each = left / sum(w[s] for s in open_)
        over = {s for s in open_ if each * w[s] > cap * sizes[s]}
        if not over:
            return out | {s: each * w[s] for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 10, "d": 500, None: 3}, {"a": 5}, {"a": 0, "b": 7}, {"a": 0}, {"é": 9, "Z": 900, "": 1, None: 2}])
def test_targets(spark, sizes):
    rows = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (3, 1, 2), 1.5, 2.0).collect()
    assert {r.source: pytest.approx(r.target) for r in rows} == fill(sizes, (3, 1, 2), 1.5, 2.0)


def test_mixing(docs_of):
    rows = [(k, "w " * (k * 37 % 90), "en", [None, "a", "b", "c", "hot", "hot", "hot"][k % 7]) for k in range(400)] + [(1000, None, "en", "a"), (1001, "", "en", "empty")]
    rows += rows[:5]  # repeated rows
    docs = docs_of(rows)
    out = mix_sources(docs).collect()
    again = {r.doc_id: r.taken for r in mix_sources(docs.repartition(7)).collect()}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.repeats * r.size + r.fraction_words
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(out) == len(rows) and all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert {s: pytest.approx(t) for s, t in target.items()} == fill(sizes, (3, 1, 2), 1.5, 2.0)
    once = {r.doc_id: r.taken for r in out}
    assert sum(once[k] != again[k] for k in once if k > 4) == 0
    assert mix_sources(docs_of([]).filter("false")).count() == 0
    assert mix_sources(docs_of([(None, "a b")])).first().taken in (2, 3, 4)


URLS = ["http://a.example.com/en/x", "http://www.example.com/en/x?q", "HTTP://WWW.Example.COM/en/", "http://example.com/fr/", "https://x.net/es/1#f", "https://net/fr/", "http://notexample.com", "ftp://b.org/en/", "no url", None, "", "://", "http://example.com?x=/en/", "http://exämple.com/en/", "http://example.com:80/en/"]
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fit = [(len(h + p), a == "allow", h + p, a) for h, p, a in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, _, rule, action = max(fit) if fit else (0, 0, None, "allow")
    return host, path, rule, action


@pytest.fixture
def rules(spark):
    return spark.createDataFrame(RULES, "host string, path string, action string")


def test_url_rules(spark, rules):
    pages = spark.createDataFrame([(k, u, None, "x") for k, u in enumerate(URLS)] + [(0, URLS[0], "", "x")], "page_id long, url string, html string, host string")
    out = url_filter(pages, rules).collect()
    assert len(out) == len(URLS) + 1 and all((r.host, r.path, r.rule, r.verdict) == judge(r.url) for r in out)
    assert url_filter(pages.filter("false"), rules).count() == 0
    assert {r.verdict for r in url_filter(pages, rules.filter("false")).collect()} == {"allow"}


def test_url_aliases(spark, rules):
    canonical = lambda to: f'<html><LINK href="{to}" rel=canonical></html>'
    refresh = lambda to: f"<meta http-equiv='Refresh' content='0; url={to}'>"
    rows = [
        (1, "http://alias.org/1", refresh("http://bad.net/es/1")), (2, "https://bad.net/es/1#top", None), (3, "http://far.org/x", canonical("//alias.org/1")),
        (4, "http://mixed.org/", canonical("http://www.example.com/en/ok")), (5, "http://mixed2.org/a/b", refresh("/c")), (6, "http://mixed2.org/c", canonical("http://mixed.org/")), (7, "http://mixed.org/d", refresh("http://x.net/fr/")),
        (8, "http://mixed.org/d2", canonical("d")), (9, "http://alone.org/", "<link rel=stylesheet href=x>"), (10, "http://outside.org/", refresh("http://y.net/fr/none")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.by_alias) for r in url_filter(pages, rules).collect()}
    assert got == {1: ("block", True), 2: ("block", False), 3: ("block", True), 4: ("allow", True), 5: ("allow", True), 6: ("allow", True), 7: ("block", True), 8: ("block", True), 9: ("allow", False), 10: ("block", True)}
    more = spark.createDataFrame([("http://alone.org/", "http://z.net/es/q"), (None, "http://z.net/es/q")], "a string, b string")
    assert {r.page_id: r.verdict for r in url_filter(pages, rules, more).collect()}[9] == "block"


def test_many_rules_and_depths(spark):
    """A host with many rules, and rule hosts of more than a hundred depths, against all rules tried on each URL."""
    deep = [(".".join(["a"] * k), "/", "block") for k in range(1, 140)]
    many = [("hot.org", f"/path/{k}/" + "x" * (k % 5), ["allow", "block"][k % 2]) for k in range(300)] + [("hot.org", "", "allow"), ("hot.org", "/p", "block"), ("hot.org", "/p", "block")]
    urls = [f"http://www.hot.org/path/{k}/{'x' * (k % 7)}" for k in range(40)] + ["http://hot.org/p", "http://hot.org", "http://" + ".".join(["a"] * 139) + "/", "http://b.a.a/"]
    for own in (deep[::23] + deep[-1:], many):
        pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], "page_id long, url string, html string")
        out = url_filter(pages, spark.createDataFrame(own, "host string, path string, action string")).collect()
        for r in out:
            fit = [(len(h + p), a == "allow", h + p, a) for h, p, a in own if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
            assert (r.rule, r.verdict) == (max(fit)[2:] if fit else (None, "allow"))


def statistics(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, cover = defaultdict(list), set()
    for k in range(len(w) - 4):
        seen[tuple(w[k : k + 5])].append(k)
    for at in seen.values():
        if len(at) > 1:
            for k in at:
                cover.update(range(k, k + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_statistics(docs_of, texts):
    rows = [*texts, (80, "a b c d e a b c d e f a b c d e"), (81, "x\nx\n\nx \ny\n y\nx"), (82, "#*$%&|<> é#"), (83, "a a a a a a a"), (84, "w1 w2 w3 w4")]
    out = text_statistics(docs_of(rows).drop("size", "n")).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out} == {i: statistics(t) for i, t in rows}


def test_quality_rules(docs_of):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 8)))
    clean = [(k, ". ".join(" ".join(word() for _ in range(rng.randrange(4, 12))) for _ in range(rng.randrange(3, 30))), ["en", "de"][k % 2], ["hot", "s1"][k % 5 == 0]) for k in range(400)]
    junk = [(1000 + k, " ".join(word() + "###" for _ in range(60)), "en", "hot") for k in range(30)] + [(1100 + k, " ".join(word().upper() for _ in range(60)), "de", "hot") for k in range(20)]
    failed = [(2000, "too short", "en", "hot"), (2001, "a b c d e f g h i j " * 4, "en", "hot"), (2002, None, None, None), (2003, " \n", "en", None)]
    lone = [(3000, " ".join(word() for _ in range(50)), None, None)]
    out = {r.doc_id: r for r in quality_rules(docs_of(clean + junk + failed + lone)).collect()}
    assert all(out[k].kept for k, *_ in clean) and not any(out[k].kept or out[k].base_failed for k, *_ in junk)
    assert all(out[k].base_failed and not out[k].kept for k, *_ in failed) and out[3000].kept
    assert quality_rules(docs_of([]).filter("false")).count() == 0
    assert [r.kept for r in quality_rules(docs_of([(None, " ".join(map(str, range(20)))), (1, "x")])).orderBy("doc_id").collect()] == [True, False]


def scatter(x, scale):
    return scale * np.cov(x.T, bias=True) + np.diag(np.square(rules_of.FLOORS))


def squared(x, mean, cov):
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)


def concentrate(x, distance):
    """The h nearest rows, until the determinant stays."""
    scale, last = rules_of.consistency(rules_of.SUBSET), None
    while True:
        near = x[distance <= np.sort(distance)[math.ceil(rules_of.SUBSET * len(x)) - 1]]
        mean, cov = near.mean(0), scatter(near, scale)
        now = np.linalg.slogdet(cov)[1]
        if last is not None and abs(now - last) < 1e-9:
            return now, mean, cov
        last, distance = now, squared(x, mean, cov)


def mcd(x, starts):
    """Squared distances by the minimum covariance determinant, reweighted, from the best of some starts."""
    _, mean, cov = min((concentrate(x, d) for d in starts), key=lambda f: f[0])
    near = x[squared(x, mean, cov) <= rules_of.chi_square_quantile(rules_of.REWEIGHTED, 5)]
    return squared(x, near.mean(0), scatter(near, rules_of.consistency(rules_of.REWEIGHTED)))


def test_outliers_against_a_plain_estimate(docs_of):
    """Distances equal those of the same estimate in numpy; hundreds of random starts find no other outliers."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 9)))
    rows = [(k, "\n".join(" ".join(word() + "#" * (rng.random() < 0.02) for _ in range(rng.randrange(3, 12))) for _ in range(rng.randrange(2, 12))), "en", "s") for k in range(120)]
    rows += [(200 + k, " ".join(word() + "%%" for _ in range(40)), "en", "s") for k in range(9)] + [(220 + k, " ".join(word().upper() for _ in range(40)), "en", "s") for k in range(9)]
    stats = text_statistics(docs_of(rows).select("doc_id", "text", "lang", "source")).drop("text").withColumn("base_failed", F.lit(False))
    found = rules_of._vectors(rules_of.robust_outliers(stats)).orderBy("doc_id").collect()
    x = np.array([[r[f"x{i}"] for i in range(5)] for r in found])
    gap = x - np.sort(x, 0)[math.ceil(len(x) / 2) - 1]
    spread = np.sort(np.abs(gap), 0)[math.ceil(len(x) / 2) - 1]
    own = mcd(x, [(gap**2).sum(1), (gap**2 / ((1.4826 * spread) ** 2 + np.square(rules_of.FLOORS))).sum(1)])
    assert np.allclose([r.distance2 for r in found], own, rtol=1e-3)
    draw = np.random.default_rng(0)
    parts = [x[draw.choice(len(x), 6, replace=False)] for _ in range(300)]
    best = mcd(x, [squared(x, p.mean(0), scatter(p, 1.0)) for p in parts])
    limit = rules_of.chi_square_quantile(1 - rules_of.REJECTED, 5)
    assert [r.outlier for r in found] == (best > limit).tolist() and {r.doc_id for r in found if r.outlier} == set(range(200, 209)) | set(range(220, 229))


def test_small_groups_are_judged(docs_of):
    """By their language, or by all; only with hardly any documents there is no estimate."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 9)))
    text = lambda end="": " ".join(word() + end for _ in range(60))
    rows = [(k, text(), "en", f"s{k % 4}") for k in range(100)] + [(200 + k, text(), "de", "x") for k in range(3)]
    junk = [(300, text("##"), "en", "s1"), (301, text("$$$"), "de", "x"), (302, text().upper(), None, None)]
    got = {r.doc_id: r.kept for r in quality_rules(docs_of(rows + junk)).collect()}
    assert got == {k: k < 300 for k in got} and len(got) == 106
    assert all(r.kept and r.distance2 is None for r in quality_rules(docs_of([(1, text()), (2, text("##"))])).collect())


def test_chi_square():
    # fixed values: quantiles of the chi-square distribution from tables
    for p, k, q in ((0.95, 1, 3.841), (0.75, 5, 6.626), (0.975, 5, 12.833), (0.99, 7, 18.475)):
        assert rules_of.chi_square_quantile(p, k) == pytest.approx(q, abs=1e-3)


@pytest.mark.parametrize("name", ["op2_mixing", "op6_url_filter", "op8_quality_rules"])
def test_no_python_in_the_plan(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


def test_host_and_path_of_columns(spark):
    rows = spark.createDataFrame([(u,) for u in URLS], "url string").select("url", host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p")).collect()
    assert all((r.h, r.p) == judge(r.url)[:2] for r in rows)
