"""Importance resampling, source divergence and page extraction against plain versions, with odd rows."""

from __future__ import annotations

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from assayframe.llm import divergence, importance, markup, templates

DDL = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "The of and Tion ing café naïve größe 日本 don't x1 42 ÄÖ".split()


def _docs(spark, n=60, seed=5):
    rnd = random.Random(seed)
    rows = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.choice([0, 1, 2, 19, 20, 21, 60]))), rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "ü", None]), 1) for i in range(n)]
    rows += [(1000, None, None, None, None), (1001, "", "fr", "lonely", 0), (1002, "... --- !!!", "en", "no terms", 0), (1003, "\x00one\x00two\x7fthree " * 10, "en", "a", 0), (1004, "word " * 200_000, "en", "a", 0), rows[3], rows[3], (None, "the of and " * 9, "en", "b", 0), (None, "the of and " * 9, "en", "b", 0)]
    df = spark.createDataFrame(rows, DDL)
    clash = df.select("*", *[F.lit("x").alias(c) for c in ("buckets", "score", "rank", "n_words", "weight", "term", "n", "part", "item", "value", "p", "_range", "size", "v", "bucket")])
    return rows, clash.repartition(3)


# importance resampling


def _features(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def _resampled(rows, target, percent, least, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(bucket(f) for r in rows for f in _features(r[1])[1])
    t = Counter(bucket(f) for x in target for f in _features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    out = []
    for doc_id, text, *_ in rows:
        words, features = _features(text)
        weight = sum(gain(bucket(f)) for f in features)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is not None, x[0] or 0))
    drawn = able[: len(able) * percent // 100]
    return Counter((*x, None) for x in able[len(drawn) :]) + Counter((*x, None) for x in out if x[1] < least) + Counter((*x, i) for i, x in enumerate(drawn, 1))


@pytest.mark.parametrize("percent", [5, 50, 100])
def test_resampling(spark, percent):
    rows, docs = _docs(spark)
    target = ["the of and the", None, "Café naïve größe", ""]
    got = importance.resample(docs, spark.createDataFrame([(x, 7) for x in target], "text string, buckets int"), percent=percent)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == _resampled(rows, target, percent, 20, 42)


def test_resampling_of_empty_tables(spark):
    rows, docs = _docs(spark, 20)
    target = spark.createDataFrame([], "text string")
    assert importance.resample(docs.limit(0), target).count() == 0
    assert Counter(tuple(r) for r in importance.resample(docs, target, percent=10).collect()) == _resampled(rows, [], 10, 20, 42)


def test_no_feature_becomes_a_row(spark):
    lists = importance.bucketed(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "text")
    plan = importance.score(lists, [0] * 10000, 42)._jdf.queryExecution().toString()
    assert not re.search(r"Generate|Exchange|Python|Arrow", plan)


# divergence


def _audited(rows, least, top):
    terms = lambda text: [w for w in re.split(r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text)) if w]
    docs = [(r[2] or "", r[3] or "", Counter(terms(r[1] or ""))) for r in rows]
    n_docs, counts, langs = Counter(), defaultdict(Counter), defaultdict(Counter)
    for lang, source, c in docs:
        n_docs.update((lang, t) for t in c)
    for lang, source, c in docs:
        counts[lang, source].update({t: n for t, n in c.items() if n_docs[lang, t] >= least})
        langs[lang].update({t: n for t, n in c.items() if n_docs[lang, t] >= least})
    out = []
    share = lambda c, t, v: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + v)
    for (lang, source), c in counts.items():
        kept = langs[lang]
        v = len(kept)
        f = lambda p, q: (p - q) ** 2 // q
        pairs = [(sum(f(share(c, t, v), share(counts[x], t, v)) for t in kept), x[1]) for x in counts if x[0] == lang and x[1] != source]
        found = [(f(share(c, t, v), share(kept, t, v)), t) for t in kept if c[t] > 0 and share(c, t, v) > share(kept, t, v)]
        for part, items, n in (("pair", pairs, None), ("term", found, top)):
            out += [(lang, source, part, item, value, i) for i, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:n], 1)]
    return Counter(out)


@pytest.mark.parametrize(("least", "top", "chunk"), [(3, 200, 1 << 24), (2, 2, 100), (1000, 5, 1 << 24)])
def test_divergence(spark, monkeypatch, least, top, chunk):
    monkeypatch.setattr(divergence, "CHUNK_BYTES", chunk)
    rows, docs = _docs(spark)
    got = divergence.audit(docs, least_docs=least, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == _audited(rows, least, top)


def test_divergence_of_an_empty_table(spark):
    assert divergence.audit(_docs(spark, 4)[1].limit(0)).count() == 0


def test_shares_are_exact(spark):
    cases = [(1, 1), (3, 7), (10**13, 10**13), (9 * 10**12 + 1, 9 * 10**13), (10**13 - 1, 10**13)]
    got = spark.createDataFrame(cases, "n long, size long").select("n", "size", divergence.share(F.col("n"), F.col("size")).alias("s")).collect()
    assert {(r.n, r.size, r.s) for r in got} == {(n, m, 1 + 10**9 * n // m) for n, m in cases}


# pages


def _page(rnd, i, body="article"):
    word = lambda: "".join(rnd.choice("abcdefgh&<>é") for _ in range(rnd.randint(1, 9)))
    blocks = [" ".join(word() for _ in range(rnd.randint(3, 40))) for _ in range(rnd.randint(2, 6))]
    inner = f"<h1>{html.escape(blocks[0])}</h1>" + "".join(f"<p>{html.escape(b)}" + "</p>" * rnd.randint(0, 1) for b in blocks[1:])
    opened, closed = {"article": ("<article>", "</article>"), "main": ("<main><div class=x>", "</div></main>"), "div": ('<div class="c7">', "</div>")}[body]
    menu = "".join(f'<li><a href="/{n}">{html.escape(word())}</a></li>' for n in range(rnd.randint(2, 5)))
    text = (
        f'<!DOCTYPE html><html><head><title>{html.escape(blocks[0])}</title><style>p > b {{}}</style><script>var s = "</p><article>no";</script></head><body>'
        f'<div class="c1"><ul>{menu}</ul></div><div class="c3">Our site of many things</div><!-- <article>not this</article> --><div class="ad">{html.escape(word())}</div>{opened}{inner}{closed}'
        f'<div class="c9"><p>All rights reserved</p></div><footer>&copy; {html.escape(word())}</footer>' + "</body></html>" * rnd.randint(0, 1)
    )
    return text, "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


@pytest.mark.parametrize("body", ["article", "main", "div"])
def test_pages_of_a_host(spark, body):
    rnd = random.Random(3)
    made = [_page(rnd, i, body) for i in range(30)]
    rows = [(i, f"https://Site.example/{i}", t) for i, (t, _) in enumerate(made)] + [(0, "https://site.example/0", made[0][0])] * 40
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("host"), F.lit(2).alias("text"), F.lit(3).alias("keys")).repartition(4)
    got = templates.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = {i: x for i, (_, x) in enumerate(made)}
    seen = got.collect()
    assert len(seen) == 70
    assert all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in seen)


def test_template_of_a_host(spark):
    """The classes, furniture and menus of pages without a main element: what all pages share goes, a block of only some stays unless its markup repeats too."""
    rnd = random.Random(4)
    pages = [("h", _page(rnd, i, "div")[0]) for i in range(12)]
    found = templates.deduce(spark.createDataFrame(pages, "host string, html string")).collect()
    assert len(found) == 1 and found[0].host == "h"
    page = markup.tokens(pages[0][1])
    gone = {t for k, t in zip(templates.signed(page.keys).tolist(), page.texts) if t and k in set(found[0].furniture)}
    assert {"Our site of many things", "All rights reserved"} <= gone
    assert len(found[0].menus) >= 1
    few = templates.deduce(spark.createDataFrame(pages[: templates.LEAST_PAGES - 1], "host string, html string"))
    assert few.count() == 0


def test_a_phrase_on_all_pages_of_an_article_goes_and_versions_of_one_article_stay(spark):
    rnd = random.Random(8)
    say = lambda n: " ".join(rnd.choice(["stone", "river", "cloud", "tree", "bird"]) + str(rnd.randint(0, 99)) for _ in range(n))
    frame = lambda x: f"<html><body><article><h1>{say(3)}</h1>{x}</article></body></html>"
    shared = [f"https://one.example/{i}" for i in range(20)], [frame(f"<p>{say(60)}</p><div class='k'><p>Tell your friends</p></div>") for _ in range(20)]
    same = say(80)
    versions = [f"https://two.example/{i}" for i in range(20)], [frame(f"<p>{same}</p><p>{say(5)}</p>") for _ in range(20)]
    rows = [*zip(*shared), *zip(*versions)]
    got = templates.extract(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id int, url string, html string")).collect()
    for r in got:
        if "one.example" in r.url:
            assert "Tell your friends" not in r.text and len(r.text.split("\n")) == 2
        else:
            assert same in r.text


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain < text &amp; &#233;&nbsp;x", "plain < text & é x"),
        ("<p>a<br>b<p>c<b>d</b>e", "a b\ncde"),
        ("<article><nav>n</nav><header><h2>t</h2></header><p>x<aside>y</aside>z</p><form>f<p>g</form><section class='comments'><p>c</p></section></article><p>after", "t\nx\nz"),
        ("<main><p>m</p><article><p>a</p></article></main>", "a"),
        ("<div id=cookie-notice>c</div><main>m <i>n</i></main><article class='comment'>c</article>", "m n"),
        ("<article><div></section></div></div><p>still in</article>out", "still in"),
        ("<article><p title='a > b'>x</p><p it's>don't</p><!-- <p>no</p> --><script>if (a<b) '</p>'</script><style>x", "x\ndon't"),
        ("<head><title>t</title><meta charset=utf-8><div>d</div>", "d"),
        ("<ul><li>one<li>two <ul><li>deep</ul></ul>", "one\ntwo\ndeep"),
        ("<table><tr><td>a<td>b<tr><th>c</table>", "a\nb\nc"),
        ("<article><p>cut <b", "cut"),
        ("<article><!-- never closed <p>x", ""),
    ],
)
def test_markup(page, want):
    assert markup.article(markup.tokens(page), frozenset(), frozenset(), frozenset()) == want


def test_odd_pages(spark):
    long = "<article><p>" + "word &amp; " * 300_000 + "</p></article>"
    rows = [("a", None, None), (None, "not a url", "<p>x</p>"), ("b", "http://u@h.example:80/", ""), ("b", "http://h.example", "<p>y</p>"), ("c", "http://h.example/long", long)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = Counter(tuple(r) for r in templates.extract(pages).collect())
    text = " ".join(["word &"] * 300_000)
    assert got == Counter([("a", None, "", 0), (None, "not a url", "x", 1), ("b", "http://u@h.example:80/", "", 0), ("b", "http://h.example", "y", 1), ("c", "http://h.example/long", text, len(text))])
    assert templates.extract(pages.limit(0)).count() == 0


def test_classes_keep_order_and_nest():
    import numpy as np

    order = lambda keys, of: {c: (o != 0, n) for c, (o, n) in templates.order_and_nesting(np.array(keys, np.int64), of).items()}
    of = {1: 10, 2: 10, 3: 10, 4: 20, 5: 20}
    assert order([1, 2, 4, 5, 4, 5, 3], of) == {10: (True, True), 20: (True, True)}
    assert order([1, 4, 2, 5, 4, 5, 3], of) == {10: (True, True), 20: (True, False)}
    assert order([1, 2, 4, 5, 5, 4, 3], of)[20] == (False, True)
