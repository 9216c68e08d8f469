"""Chat windows, language ID, page text, quality classifier, and the pipeline."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from solidframe.llm.chat import format_conversations, format_turn, parse_turns, read_back, unescape
from solidframe.llm.html_text import extract_text, main_text
from solidframe.llm.language_id import FLOOR, Unigrams, fit_unigrams, identify_language
from solidframe.llm.quality_classifier import NAMES, fit_quality, fit_trees, score_quality, statistics
from solidframe.llm.queries import QUERIES

CONV = "conv_id long, turn long, role string, text string, window long"


@given(st.lists(st.tuples(st.text(alphabet="a:\\# \n", max_size=6), st.text(alphabet="</turn>#\\ ab\n:é", max_size=30)), max_size=5))
def test_turns_read_back(turns):
    written = [format_turn(r, t) for r, t in turns]
    text = "".join(x for x, _, _ in written)
    assert [(r, t) for r, t, _, _ in parse_turns(text)] == turns
    assert all(unescape(x[a:b]) == t for (x, a, b), (_, t) in zip(written, turns, strict=True))


def digests(rows):
    out = {}
    for c, own in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")), key=lambda r: r[0]):
        own = list(own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        out[c] = (len(own), hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("budget", "history"), [(1024, 256), (40, 20), (1, 1), (60, 0)])
def test_chat(spark, budget, history):
    rows = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"), (1, 0, "system", "be brief"), (1, 1, "user", None), (1, 2, "assistant", "")]
    rows += [(2, k, ["user", "assistant"][k % 2], f"turn {k} " * (k % 9)) for k in range(200)]
    rows += [(3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (3, None, None, "first"), (None, 0, "assistant", "x"), (4, 0, "assistant", "word " * 5000), (5, 0, "system", "s " * 50), (5, 1, "assistant", "a")]
    turns = spark.createDataFrame([(*r, 9) for r in rows], CONV)
    windows = format_conversations(turns, budget, history).cache()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(windows).collect()}
    assert got == digests(rows)
    for w in windows.collect():
        parsed = parse_turns(w.text)
        assert len(parsed) == w.n_turns > w.n_repeated
        assert w.n_tokens <= budget or w.n_turns - w.n_repeated == 1
        if w.n_tokens > budget:  # the one turn, alone or beside the system turn
            assert w.n_repeated == 0 or w.n_repeated == 1 and parsed[0][0] == "system"
        if w.conv_id == 5 and w.window:
            assert parsed[0][0] == "system"
        spans = {(s.start, s.end) for s in w.loss}
        assert spans == {(a, b) for r, _, a, b in parsed[w.n_repeated :] if r == "assistant"}
    assert read_back(format_conversations(turns.filter("false"))).count() == 0


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "bab"]
    shares = np.random.default_rng(0).random((len(pieces), 2))
    model = Unigrams(["x", "y"], pieces, shares)
    place = {p: k for k, p in enumerate(pieces)}

    def total(text):
        if not text:
            return np.ones(2)
        out = np.zeros(2)
        for n in range(1, len(text) + 1):
            if text[:n] in place:
                out = out + shares[place[text[:n]]] * total(text[n:])
            elif n == 1:
                out = out + FLOOR * total(text[1:])
        return out

    words = ["a", "ab", "abab", "zabz", "b", "aaaabbbb", "z"]
    assert np.allclose(model.log_words(words), np.log([total("▁" + w) for w in words]))
    long = model.log_words(["ab" * 5000, "a"])
    assert np.isfinite(long).all() and np.allclose(long[1], model.log_words(["a"])[0])
    assert math.isclose(sum(model.predict(["ab a", None, "12 #"])[1][1:]), 0.0)


def test_language_cases(docs_of):
    rows = [(k, ["the house of the man and the dog", "das haus und der mann mit dem hund", "la maison de la dame et le chien"][k % 3] + f" {k}", ["en", "de", "fr"][k % 3]) for k in range(60)]
    odd = [(100, None, "en"), (101, "", "en"), (102, "123 !? ---", "de"), (103, "the dog " * 20_000, "de"), (104, "漢字 かな", "xx"), (105, "der hund", None)]
    docs = docs_of(rows + odd)
    model = fit_unigrams(docs.filter("doc_id < 50"), max_docs=10)
    got = {r.doc_id: r for r in identify_language(docs, model).collect()}
    assert all(got[i].lang_pred == lang and got[i].score > 0.9 for i, _, lang in rows)
    assert [got[k].lang_pred for k in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0.0
    assert got[103].lang_pred == "en" and got[105].lang_pred == "de" and 0 <= got[104].score <= 1
    none = fit_unigrams(docs.filter("false"))
    assert {r.lang_pred for r in identify_language(docs, none).collect()} == {"und"}
    assert identify_language(docs.filter("false"), model).count() == 0


def test_language_model_by_hand(docs_of):
    """Counts of pieces, shares, sums over segmentations and the largest posterior, recomputed plainly."""
    import sentencepiece

    from solidframe.llm.language_id import MODEL, SMOOTH, words_of

    rows = [(1, "The cat, the dog!", "en"), (2, "cats and dogs", "en"), (3, "der Hund und die Katze", "de"), (4, "das Haus", "de")]
    model = fit_unigrams(docs_of(rows))
    split = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    known = [split.id_to_piece(k) for k in range(split.get_piece_size()) if not (split.is_control(k) or split.is_unknown(k) or split.is_byte(k))]
    counts = {lang: dict.fromkeys(known, SMOOTH) for lang in ("de", "en")}
    for _, text, lang in rows:
        for w in words_of(text):
            for piece in split.encode(w, out_type=str):
                counts[lang][piece] += 1
    shares = {lang: {p: n / sum(own.values()) for p, n in own.items()} for lang, own in counts.items()}

    def log_sum(lang, word):
        ways = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(end):
                piece = word[start:end]
                ways[end] += ways[start] * shares[lang].get(piece, FLOOR if end - start == 1 else 0.0)
        return math.log(ways[-1])

    for text in ("the house", "die Katze und der Hund", "cat Haus", "zebra"):
        logs = {lang: sum(log_sum(lang, "▁" + w) for w in words_of(text)) for lang in shares}
        want = max(sorted(logs), key=logs.get)
        (name,), (score,) = model.predict([text])
        assert name == want and math.isclose(score, 1 / (1 + math.exp(min(logs.values()) - max(logs.values()))), rel_tol=1e-6)


def test_language_accuracy(spark, sf_dir):
    got = QUERIES["op7_language_id"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="with-sidebar"><header><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id=wrap><%s><h1>The   title</h1><p>First &amp; best<br>line &eacute;&#233; with <a href=x>a link</a>.<p>Second <b>bold<p>Third</b> one
<ul><li>item one<li>item two</ul><div class="ad">Buy</div><blockquote>Quoted words here</blockquote><form><input value=x>Name</form><script>var x = "<p>no</p>";</script></%s>
<aside>Side</aside><section id="comments"><p>Nice post, I read it all and liked every line of it</p></section></div><footer>End &copy;</footer></body></html>"""
MAIN = "The title\nFirst & best line éé with a link.\nSecond bold\nThird one\nitem one\nitem two\nQuoted words here"


@pytest.mark.parametrize("tag", ["article", "main", "div class=post"])
def test_page_text(tag):
    assert main_text(PAGE % (tag, tag.split()[0])) == MAIN
    split = MAIN.split("\n")
    two = "<body><div><p>%s</p><p>%s</p></div><div class=menu><a>x</a></div></body>" % (split[1] * 3, split[6] * 3)
    assert main_text(two).count("\n") == 1


@pytest.mark.parametrize(
    "page",
    [
        "<head><title>T</title><body>%s",
        "<html><head><title>T</title><meta charset=utf-8>\n<div>%s</div></html>",
        "<head><noscript><p>no script</noscript><script>x</script><body>%s",
        "<head><bgsound src=x>%s",
        "<head><title>T</title></body>%s",
        "<body><head><meta name=x>%s",
        "<body><div><select><option>a<option>b</select>%s</div>",
        "<body><div><select><optgroup label=x><option>a</select>%s</div>",
        "<body><div><noscript><p>no script</noscript>%s</div>",
        "<body><div><noscript><table><tr><td>no script</noscript>%s</div>",
        "<body><div><datalist><option>a<option>b</datalist>%s</div>",
        "<body><div><object data=x><param name=y><p>none</object>%s</div>",
    ],
)
def test_page_text_with_omitted_tags(page):
    assert main_text(page % "<p>First line of the text</p><p>Second line of the text</p>") == "First line of the text\nSecond line of the text"
    assert main_text(page % "Plain text") == "Plain text"


def test_page_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", " \n"), (4, "u", "plain text"), (5, "u", "<p>one<p>two <im"), (6, "u", "<!-- x --><body><script>a</script></body>"), (7, "u", "<p>a < b &lt;i&gt; &nbsp; c"), (8, "u", "<div>" * 3000 + "deep"), (None, "u", "<p>x"), (4, "u", "plain text")]
    out = extract_text(spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert [r.text for r in out] == ["", "", "", "plain text", "one\ntwo", "", "a < b <i> c", "deep", "x", "plain text"] and all(r.n_chars == len(r.text) for r in out)
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_trees():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = fit_trees(x[:400], y[:400])
    assert ((model.score(x[400:]) > 0.5) == y[400:]).mean() > 0.95
    one = model.score(x[:1])
    walked = model.bias
    for f, b, leaf in zip(model.feature, model.bound, model.leaf, strict=True):
        node = 0
        for _ in range(model.depth):
            node = 2 * node + (2 if x[0, f[node]] > b[node] else 1)
        walked += leaf[node - (2**model.depth - 1)]
    assert math.isclose(one[0], 1 / (1 + math.exp(-walked)))
    assert fit_trees(x, np.ones(600)).score(x).min() > 0.99 and fit_trees(x[:0], y[:0]).score(x).tolist() == [0.5] * 600


def test_statistics_of_texts():
    texts = ["", "Aa bb bb\nAa bb bb\n12 #|.", "one two three four five one two three four five", "é"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = {n: c for n, c in zip(NAMES, statistics(np.frombuffer(data, np.uint8), offsets).T, strict=True)}
    assert np.allclose(np.expm1(got["log_words"]), [0, 8, 10, 1]) and np.allclose(got["repeated_windows"], [0, 0, 1, 0])
    assert np.allclose(got["upper"][1], 2 / 24) and np.allclose(got["repeated_lines"], [0, 1 / 3, 0, 0]) and got["symbols"][1] == 2 / 24 and np.isfinite(list(got.values())).all()


def test_classifier_cases(spark, docs_of):
    docs = docs_of([(k, ("good words of a text " if k % 2 else "### $$$ ") * (k % 9 + 1)) for k in range(200)] + [(900, None), (901, ""), (None, "x")])
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 150)] + [(5, None), (None, 1), (99999, 1), (7, 1)], "doc_id long, label int")
    got = {r.doc_id: r.score for r in score_quality(docs, fit_quality(docs, labels)).collect()}
    assert len(got) == 203 and all(0 <= s <= 1 for s in got.values()) and all((got[k] > 0.5) == (k % 2 == 1) for k in range(150, 200))
    assert {r.score for r in score_quality(docs, fit_quality(docs, labels.filter("false"))).collect()} == {0.5}
    assert score_quality(docs.filter("false"), fit_quality(docs, labels)).count() == 0
    assert np.allclose(sorted(got.values()), sorted(r.score for r in score_quality(docs, fit_quality(docs.repartition(5), labels)).collect()))


def test_histogram_fit_against_all_splits():
    """One tree of one level: the split with the largest gain among all bounds between bins, and its leaves, by brute force."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (300, 4)).astype(float)
    y = (x[:, 2] + rng.normal(0, 3, 300) > 6).astype(float)
    model = fit_trees(x, y, trees=1, depth=1, rate=0.5, least=10, shrink=2.0)
    p = y.mean()
    g, h = y - p, np.full(300, p * (1 - p))
    part = lambda at: g[at].sum() ** 2 / (h[at].sum() + 2.0)
    every = [(part(x[:, f] <= b) + part(x[:, f] > b) - part(np.ones(300, bool)), f, b) for f in range(4) for b in range(12) if 10 <= (x[:, f] <= b).sum() <= 290]
    best = max(every, key=lambda s: s[0])
    assert (model.feature[0, 0], model.bound[0, 0]) == best[1:]
    left = x[:, best[1]] <= best[2]
    want = [0.5 * g[at].sum() / (h[at].sum() + 2.0) for at in (left, ~left)]
    assert np.allclose(model.leaf[0], want) and math.isclose(model.bias, math.log(p / (1 - p)))


def test_classifier_takes_one_of_the_documents_of_an_id(spark, docs_of):
    some = [(k, f"text number {k} " * (k + 1)) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, label int")
    many = docs_of(some + [(k, t + "more " * j) for k, t in some for j in range(1, 9)])
    one, two = (fit_quality(d, labels, max_rows=60) for d in (many, many.repartition(7)))
    assert np.array_equal(one.leaf, two.leaf) and np.array_equal(one.bound, two.bound)
    plain = fit_quality(docs_of(some), labels, max_rows=60)
    assert np.array_equal(one.leaf, plain.leaf)  # the shortest has the smallest statistics


def test_classifier_accuracy(spark, sf_dir):
    rows = QUERIES["op10_quality_classifier"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.8 * len(rows)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, docs = first.count(), first
    for k, (name, stage) in enumerate(p.STAGES[:-1]):
        out = stage(spark, docs, sf_dir).cache()
        assert out.columns == first.columns and 0 < out.count() <= before, name
        before, docs = out.count(), out
    rows = p.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    assert all(r.taken <= 2 * r.size for r in rows)
    texts = [r.text.split() for r in docs.collect()]
    seen = {}
    for k, w in enumerate(texts):  # no passage of 50 words is left in two places
        for i in range(len(w) - 49):
            assert seen.setdefault(tuple(w[i : i + 50]), (k, i)) == (k, i)


def test_pipeline_with_repeated_ids(spark, docs_of, tmp_path):
    import random

    import corpus_pipeline as p

    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, leak = text(60), text(12)
    one, two, three = text(80), text(90), text(70)
    rows = [(1, one), (1, one), (1, two + " " + passage), (2, text(30) + " " + leak + " " + text(30)), (2, three), (None, one), (None, text(40)), (3, passage + " " + text(50)), (4, "short"), (4, text(45))]
    rows += [(100 + k, text(60)) for k in range(60)]
    docs = docs_of(rows).drop("size", "n", "extra").withColumn("n_chars", F.length("text").cast("long"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = docs
    for name, stage in p.STAGES[:-1]:
        path = f"{tmp_path}/{name}"
        stage(spark, got, str(tmp_path)).write.parquet(path)
        got = spark.read.parquet(path)
    out = sorted(((r.doc_id if r.doc_id is not None else -1), r.text) for r in got.collect() if (r.doc_id or 0) < 100)
    want = [(-1, one), (-1, rows[6][1]), (1, two + " " + passage), (2, three), (3, rows[7][1][len(passage) + 1 :]), (4, rows[9][1])]
    assert out == sorted(want) and got.filter("doc_id >= 100").count() == 60
