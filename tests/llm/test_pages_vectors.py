"""Operators over pages and vectors against brute force."""
import html
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from tidemill.llm import embeddings, hamming, html_extract, url_rules
from tidemill.llm.html_tree import parse

PAGES = "page_id bigint, url string, html string, URL string, host int, text double"


def _article(page):
    """The article of a page of the test tables, by its only <article> element."""
    body = page[page.index("<article>") + 9 : page.index("</article>")]
    body = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", body))
    return " ".join(html.unescape(body).split())


def test_articles_of_the_test_table(spark, data):
    table = spark.read.parquet(f"{data}/pages.parquet")
    want = {r["page_id"]: _article(r["html"]) for r in table.collect()}
    out = html_extract.extract_pages(table).collect()
    assert len(out) == len(want)
    assert sum(r["text"] == want[r["page_id"]] for r in out) >= 0.99 * len(out)
    assert all(r["n_chars"] == len(r["text"]) for r in out)


CASES = {
    "references end at tags": ("<article><p>Use &<b>amp;</b> here, and &am<!-- x -->p; there, really it is. A &lt;b&gt; stays.</p></article>",
        "Use &amp; here, and &amp; there, really it is. A <b> stays."),
    "layout": ("""<html><body><header><h1>Site</h1><nav><a href=x>Home</a> <a href=y>About</a></nav></header><div class="cookie-notice">We use
        cookies. Accept them please.</div><div id="content"><h1>Title here</h1><p>First paragraph with some words, and more. It
        continues.</p><p>Short.</p><ul><li>point one</li><li>point two</li></ul></div><div class="sidebar"><h3>Related</h3><ul><li><a href=1>One
        link</a></li></ul></div><section id="comments"><h2>Comments</h2><div class="comment"><p>I really liked this article, thank you! It was
        great.</p></div></section><form><label>Email</label><input><button>Go</button></form><footer>&copy; 2024 Company.</footer></body></html>""",
        "Title here First paragraph with some words, and more. It continues. Short. point one point two"),
    "aside": ("""<article><header><h1>Big title</h1></header><p>Para one is here, it is good.</p><aside class="promo">Subscribe to our
        newsletter today!</aside><p>Para &amp; two&hellip; caf&eacute;.</p></article>""", "Big title Para one is here, it is good. Para & two\u2026 caf\u00e9."),
    "inline": ("<article><p>One <b>bo</b>ld and<br>broken &lt;tag&gt; here, it is.</p></article>", "One bold and broken <tag> here, it is."),
    "plain": ("Only some text, without any element. It is short.", "Only some text, without any element. It is short."),
    "raw": ("<article><script>if (a < b) { document.write('<p>no</p>'); }</script><style>p > b {}</style><p>Real text is here, really.</p></article>", "Real text is here, really."),
    "attributes": ("""<article data-x='a > b' title="<p>no</p>"><p>Real text is here, really.</p></article>""", "Real text is here, really."),
    "script with an unquoted address": ("<article><p>Real text is here, really.</p><script src=https://cdn.x/y/>var a=1;</script><p>More of it, indeed.</p></article>",
        "Real text is here, really. More of it, indeed."),
    "hidden and advert inside a paragraph": ("""<article><p>Real text<span style='display:none'>hidden words here</span> is here, really.</p><p>Some more of it
        <span class='ad'>Buy now, cheap!</span> and the end.</p></article>""", "Real text is here, really. Some more of it and the end."),
    "inline elements with names": ("<article><p>One <span class=hl>bo</span>ld word <a class='link' href=x>and a link</a>, really it is.</p></article>",
        "One bold word and a link, really it is."),
    "math and noscript": ("""<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> here, it is known.</p><noscript><p>Text without scripts is
        here, too.</p></noscript></article>""", "Energy is E=m here, it is known. Text without scripts is here, too."),
    "svg": ("<article><p>An icon <svg width=1><title>Icon</title><path d='x'/></svg> is here, really.</p><p>Next one.</p></article>", "An icon is here, really. Next one."),
    "unclosed svg": ("<article><p>An icon <svg><g> is here, really.</p><p>Next one.</p></article><footer>Legal</footer>", "An icon is here, really. Next one."),
    "remarks without names": ("""<html><body><div><div><h1>Some title of it</h1><p>First paragraph with some words, and more. It continues.</p><p>And a second
        paragraph of text, with words. It goes on and on here.</p></div><div><h3>Comments</h3><div><div>Anna</div><p>I really liked this, thank you! It was
        great.</p></div><div><div>Bob</div><p>Me too. It was very good indeed.</p></div></div></div><footer>(c) x</footer></body></html>""",
        "Some title of it First paragraph with some words, and more. It continues. And a second paragraph of text, with words. It goes on and on here."),
    "remarks beside an article": ("""<html><body><article><h1>Some title of it</h1><p>First paragraph with some words, and more. It continues.</p></article>
        <div><div><div>Anna</div><p>I really liked this, thank you! It was great.</p></div><div><div>Bob</div><p>Me too. It was very good indeed.</p></div></div></body></html>""",
        "Some title of it First paragraph with some words, and more. It continues."),
    "noscript at the top": ("""<html><body><noscript>Please enable JavaScript to read this page.</noscript><div id=content><h1>Some title of it</h1><p>First paragraph
        with some words, and more. It continues.</p></div></body></html>""", "Some title of it First paragraph with some words, and more. It continues."),
    "only a menu": ("<html><body><nav><ul><li><a href=x>Home</a></li><li><a href=y>About us</a></li></ul></nav></body></html>", ""),
    "empty": ("", ""),
    "null": (None, ""),
    "cut": ("<article><p>It stops in the middle of a sentence, and of a <a href='x", "It stops in the middle of a sentence, and of a"),
}


@pytest.mark.parametrize("case", CASES)
def test_page_cases(case):
    page, want = CASES[case]
    assert html_extract.page_model().text(page) == want


def test_long_and_hostile_pages():
    model = html_extract.page_model()
    long = "<article>" + "<p>Some words of a sentence, and more of it.</p>" * 20_000 + "</article>"
    assert model.text(long).count("sentence") == 20_000
    for page in ("<" * 20_000, '<p title="' * 2_000, "<div>" * 20_000 + "deep", "&" * 20_000, "<p>" * 50_000):
        assert isinstance(model.text(page), str)


@pytest.mark.parametrize("page", [
    "<div>" * 10 + "</section>" * 100_000 + "x", "<div>" * 30_000 + "</section>" * 30_000, '<p ">"' * 50_000, "<!" * 200_000, "<title>" * 50_000,
    "<" + "a" * 200_000 + '"', "<dl><dd><dl>" + "<div>" * 20_000 + "<dt></dt>" * 20_000, "<i>" * 30_000 + "<b>" * 30_000 + "</i>" * 30_000,
    "<span class=a>" * 20_000 + "<div></div>" * 20_000, "<p " + "style=" * 30_000 + ">x", "<p " + "class    " * 30_000 + ">x",
])
def test_time_of_hostile_pages_is_linear(page):
    began = time.process_time()
    parse(page)
    assert time.process_time() - began < 2  # any step that is quadratic takes minutes


def _joint(model, nodes, i):
    """P(content) of node i by summing over all states."""
    n = len(nodes)
    own = [math.prod(model.odds.get(w, 1.0) for w in html_extract.observations(nodes, k)) for k in range(n)]
    total = [0.0, 0.0]
    for bits in range(1 << (n - 1)):
        state = [0] + [bits >> k & 1 for k in range(n - 1)]
        p = 1.0
        for k in range(1, n):
            step = model.steps.get(model._step(nodes, k), model.plain_step)
            p *= step[state[nodes[k].parent]][state[k]] * (own[k] if state[k] else 1.0)
        total[state[i]] += p
    return total[1] / sum(total)


def test_marginals_are_exact():
    model = html_extract.page_model()
    for page in ("<body><nav><a>Home</a></nav><div class=content><p>Text here, it is.</p><p>x</p></div></body>", "<ul><li>a</li></ul><article>b. c, d</article>"):
        nodes = parse(page)
        assert len(nodes) <= 14
        got = model.marginals(nodes)
        for i in range(1, len(nodes)):
            assert got[i] == pytest.approx(_joint(model, nodes, i), rel=1e-6, abs=1e-9)


def test_pages_with_nulls_copies_and_clashing_columns(spark):
    rows = [(1, "u", CASES["aside"][0], "x", 1, 1.0), (1, "u", CASES["aside"][0], "x", 1, 1.0), (None, None, None, None, None, None)]
    out = html_extract.extract_pages(spark.createDataFrame(rows, PAGES)).collect()
    assert Counter((r["page_id"], r["text"]) for r in out) == Counter([(1, CASES["aside"][1])] * 2 + [(None, "")])
    assert html_extract.extract_pages(spark.createDataFrame([], PAGES)).collect() == []


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
         ("a.example.net", "/", "block"), ("", "/any", "block"), ("example.com", "", "block"), ("xcom", "/", "block")]


def _judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in RULES if host and (r[0] == "" or host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_url_rules_by_brute_force(spark, monkeypatch):
    r = random.Random(6)
    urls = [None, "", "no scheme", "://", "http://", "http:///x", "HTTP://WWW.Example.COM/en/A", "http://example.com?x", "http://com/", "http://example.com./en/", "http://É.com/x"]
    part = lambda options: r.choice(options)
    urls += ["http://" + ".".join(part(["www", "a", "example", "x", "xcom"]) for _ in range(r.randint(0, 2))) + part([".", ""]) + part(["com", "net", "example.com", "example.net", "org"])
             + part(["", "/", "/en/", "/es/x", "/fr", "/fr/?q", "#f", "/any/1", "?a://b"]) for _ in range(1500)]
    rows = [(i // 2, u, None, "x", 1, 1.0) for i, u in enumerate(urls)]
    monkeypatch.setattr(url_rules, "RANGE", 100)
    out = url_rules.judge(spark.createDataFrame(rows, PAGES), RULES).collect()
    assert Counter(map(tuple, out)) == Counter((i, *_judged(u)) for i, u, *_ in rows)
    assert url_rules.judge(spark.createDataFrame([], PAGES), RULES).collect() == []
    assert {x["verdict"] for x in url_rules.judge(spark.createDataFrame(rows[:50], PAGES), []).collect()} == {"allow"}


VECTORS = "vec_id bigint, embedding array<float>, label int, mark string, code int, cls int"


def _vectors():
    rng = np.random.default_rng(3)
    rows = []
    for label in (1, 2):
        for centre in rng.standard_normal((25, 32)):
            for _ in range(rng.integers(1, 8)):
                rows.append([centre + rng.standard_normal(32) * rng.choice([0.0, 0.05, 0.2, 0.35]), label])
    rows = [[len(rows) - i, [float(np.float32(v)) for v in x], label] for i, (x, label) in enumerate(rows)]
    same = rows[0]
    odd = [None, [], [0.0] * 32, [float("nan")] + [1.0] * 31, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31]
    rows += [[1000 + i, same[1], same[2]] for i in range(6)] + [[2000 + i, x, 1] for i, x in enumerate(odd)]
    rows += [[3000, same[1], None], [3001, same[1], None], [3002, [1.0, 2.0], 1], [3003, [2.0, 4.0], 1], [3004, [5.0], 1]]
    return [(*x, "m", 1, 2) for x in rows]


def test_vectors_by_brute_force(spark, monkeypatch):
    rows = _vectors()
    sound = [(i, np.array(v, float), g) for i, v, g, *_ in rows if v and g is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, root = Counter(), {i: i for i, *_ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, x, g) in enumerate(sound):
        for j, y, h in sound[:k]:
            if g == h and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    frame = spark.createDataFrame(rows, VECTORS).repartition(3)
    for block in (2048, 2):
        monkeypatch.setattr(embeddings, "BLOCK", block)
        out = embeddings.near_vectors(frame).collect()
        assert len(out) == len(rows)
        assert all(r["n_links"] <= links[r["vec_id"]] for r in out)
        assert sum(r["n_links"] for r in out) >= 0.97 * sum(links.values())
        exact = [r for r in out if r["n_links"] == links[r["vec_id"]] and r["component_id"] == find(r["vec_id"])]
        assert len(exact) >= 0.97 * len(out)
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)
    assert embeddings.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []


@pytest.mark.parametrize("n", [50, 500, 5000])
def test_vector_recall_of_any_number(spark, monkeypatch, n):
    monkeypatch.setattr(embeddings, "ROWS", 700)
    rng = np.random.default_rng(n)
    middles = rng.standard_normal((max(3, n // 12), 64))
    x = middles[rng.integers(0, len(middles), n)] + rng.choice([0.2, 0.27, 0.33], (n, 1)) * rng.standard_normal((n, 64))
    rows = [(i, [float(v) for v in x[i]], int(i % 2), "m", 1, 2) for i in range(n)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.arange(n)[:, None] % 2 == np.arange(n)[None, :] % 2)
    want = near.sum(axis=1) - 1
    learned = []
    monkeypatch.setattr(embeddings, "_rotations", lambda *a, f=embeddings._rotations: learned.append(f(*a)) or learned[-1])
    out = {r["vec_id"]: r["n_links"] for r in embeddings.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()}
    assert len(out) == n and all(out[i] <= want[i] for i in range(n))
    assert want.sum() > n / 10 and sum(out.values()) >= 0.9 * want.sum()
    assert learned[0].count() == 1


def test_vectors_of_seventy_lengths(spark):
    rng = np.random.default_rng(31)
    rows = []
    for d in range(2, 72):
        for label in (1, 2):
            x = rng.standard_normal(d)
            rows += [(len(rows) + i, [float(v) for v in x * (i + 1) + rng.standard_normal(d) * 1e-3], label, "m", 1, 2) for i in range(2)]
    frame = spark.createDataFrame(rows, VECTORS)
    assert [r["n_links"] for r in embeddings.near_vectors(frame).collect()] == [1] * len(rows)
    # Lengths with few classes beside one with more.
    x = rng.standard_normal((6, 80))
    more = [(1000 + i, [float(v) for v in x[i % 6] * (1 + i // 6)], 1, "m", 1, 2) for i in range(12)]
    out = {r["vec_id"]: r for r in embeddings.near_vectors(spark.createDataFrame(rows + more, VECTORS)).collect()}
    assert all(out[i]["n_links"] == 1 for i in out)
    assert all(out[1000 + i]["component_id"] == 1000 + i % 6 for i in range(12))


def test_vector_recall_at_the_threshold():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((2000, 64))
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    mean, axes = embeddings.learn_rotations(x)
    for cosine, least in ((0.931, 0.92), (0.95, 0.97), (0.98, 0.99)):
        y = cosine * x + math.sqrt(1 - cosine**2) * side
        met = (embeddings.codes_of(x, mean, axes) == embeddings.codes_of(y, mean, axes)).any(axis=1)
        assert met.mean() >= least


def test_vector_recall_with_wider_segments():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((1500, 64))
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.931 * x + math.sqrt(1 - 0.931**2) * side
    assert embeddings.layout(50_000) == embeddings.layout(1 << 20) == (16, 6)
    for classes in (1 << 24, 1 << 31):
        bits, rotations = embeddings.layout(classes)
        assert bits > 16 and classes / 2**bits <= embeddings.CHANCE
        mean, axes = embeddings.learn_rotations(x, rotations=rotations, rounds=3)
        a, b = embeddings.codes_of(x, mean, axes, bits), embeddings.codes_of(y, mean, axes, bits)
        assert a.shape == (1500, rotations * (64 // bits))
        assert (a == b).any(axis=1).mean() >= 0.9


def test_hamming_top_k(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, [float(v) for v in rng.standard_normal(40)], 1, "m", 1, 2) for i in range(300)]
    rows += [(300 + i, rows[i][1], 1, "m", 1, 2) for i in range(60)] + [(50, rows[50][1], 1, "m", 1, 2)]
    rows += [(400, None, 1, "m", 1, 2), (450, [], 1, "m", 1, 2), (None, rows[0][1], 1, "m", 1, 2), (500, [None] * 40, 1, "m", 1, 2), (550, [1.0, -1.0], 1, "m", 1, 2)]
    code = {}
    for i, v, *_ in rows:
        if i is not None and v and None not in v:
            code[i] = tuple(x > 0 for x in v)
    held = [i for i, v, *_ in rows if i in code]
    want = Counter()
    for q in {i for i in held if i % 50 == 0}:
        far = sorted((sum(a != b for a, b in zip(code[q], code[i])), i) for i in held if i != q and len(code[i]) == len(code[q]))
        want.update((q, n, i, d) for n, (d, i) in enumerate(far[:10], 1))
    for rows_at_once, queries in ((1 << 15, 1 << 11), (64, 3)):
        monkeypatch.setattr(hamming, "ROWS", rows_at_once)
        monkeypatch.setattr(hamming, "QUERIES", queries)
        assert Counter(map(tuple, hamming.nearest(spark.createDataFrame(rows, VECTORS)).collect())) == want
    assert hamming.nearest(spark.createDataFrame([], VECTORS)).collect() == []


def test_steps_of_a_search_grow_with_the_rows_met():
    rng = np.random.default_rng(10)
    codes, steps = rng.integers(0, 256, (80_000, 8)).astype(np.uint8), []
    for n in (40_000, 80_000):
        tables = hamming.SegmentTables(codes[:n])
        for q in range(50):
            tables.search(codes[q], 10, np.array([q]), np.arange(n), 64)
        steps.append(tables.steps)
    assert steps[1] <= 2.1 * steps[0]
    # A bound from elsewhere ends a search that finds nothing within it.
    tables.steps = 0
    at, far = tables.search(codes[0] ^ np.uint8(255), 10, np.zeros(0, np.int64), np.arange(80_000), 3)
    assert len(at) == 0 and tables.steps < 100
