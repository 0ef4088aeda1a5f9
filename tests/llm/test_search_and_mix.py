"""Top-k search, mixing, extraction, the pipeline."""

import math
import random
import time
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessella.llm import mixing, style_tree, topk


def brute_top(rows, k=20):
    """Scores in Python's integers, whatever the size of a component."""
    ok = [(i, [math.floor(64 * Fraction(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for r, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("block", "asked"), [(640, 160), (1 << 18, 1 << 14)])
def test_top_k_matches_brute_force(spark, monkeypatch, block, asked):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", asked)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, 16).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000, None), (1001, [1.0, None] + [0.0] * 14), (1002, [math.nan] * 16), (1003, [math.inf] * 16), (1020, []), (None, [0.5] * 16), (1040, [1.0, 2.0]), (1041, [2.0, 2.0]), (1060, [0.0] * 16), (1061, rows[5][1]), (1062, rows[5][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumns({"rank": F.lit(0), "task": F.lit(0), "a.b": F.lit(0)})
    assert sorted(map(tuple, topk.exact_top_k(table).collect())) == brute_top(rows)
    assert topk.exact_top_k(table.limit(0)).count() == 0


@pytest.mark.parametrize("block", [24, 1 << 18])
def test_large_components_count(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rows = [(20, [1.0, 1.0]), (1, [20000.0, 1.0]), (2, [1.0, 2.0]), (3, [-1e9, 3.0]), (40, [2.0**50, 0.5]), (4, [3e12, -2e12]), (5, [0.25, 1e5]), (60, [-7e7, 2e8])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.exact_top_k(table).collect()))
    assert got == brute_top(rows)
    assert [r[2] for r in got if r[0] == 20][:2] == [40, 4]


def test_huge_components_give_the_nearest_long(spark):
    rows = [(20, [1e300, 1.0]), (1, [1e10, 0.0]), (2, [-1e300, 5.0]), (3, [0.0, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.exact_top_k(table).collect()))
    assert got == [(20, 1, 1, (1 << 63) - 1), (20, 2, 3, 64 * 192), (20, 3, 2, -(1 << 63))]


def test_few_vectors(spark):
    for n in (1, 2, 30, 79):
        rows = [(i, [float(i % 7), float(i % 3)]) for i in range(n)]
        table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert sorted(map(tuple, topk.exact_top_k(table).collect())) == brute_top(rows)


@pytest.mark.parametrize("scale", [1, 1 << 24, 1 << 40])
def test_bounds_hold_at_every_step(scale):
    """Against bounds worked out entry by entry; reading stops early and loses nothing."""
    rng = np.random.default_rng(3)
    values = rng.integers(-30, 30, (400, 6)).astype(object if scale > 1 << 30 else np.int64) * scale
    lists = topk.Lists.of(np.arange(400), values)
    kind = {1: np.float64, 1 << 24: np.int64}.get(scale, object)
    query = values[7]
    pull = np.concatenate((np.maximum(query, 0), np.minimum(query, 0))).astype(kind)
    upper = np.full(400, np.concatenate((lists.values[:, -1], lists.values[:, 0])) @ pull)
    lower = np.full(400, np.concatenate((lists.values[:, 0], lists.values[:, -1])) @ pull)
    for step, depth in enumerate(topk.DEPTHS):
        gain, sure = lists.read(kind, step)
        upper, lower = upper + gain @ pull, lower + sure @ pull
        n = math.ceil(400 * depth)
        for i in range(0, 400, 37):
            high = low = 0
            for d, c in enumerate(query.tolist()):
                order = lists.order[d][::-1] if c > 0 else lists.order[d]
                read = set(order[:n].tolist())
                high += c * int(values[i, d] if i in read else values[order[n - 1], d])
                low += c * int(values[i, d] if i in read else values[order[-1], d])
            assert (int(upper[i]), int(lower[i])) == (high, low)
    assert (upper == lower).all() and [int(x) for x in upper] == [int(x) for x in values @ query]
    small = lists.part(100, 300)
    assert (np.sort(small.order, axis=1) == np.arange(200)).all() and (small.values == np.sort(values[100:300], axis=0).T).all()


def test_reading_stops_early():
    rng = np.random.default_rng(3)
    values = rng.integers(-30, 30, (3000, 24))
    lists = topk.Lists.of(np.arange(3000), values)
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            found = super().__getitem__(key)
            seen.append(len(found))
            return found
    for step in range(len(topk.DEPTHS)):
        gain, sure = lists.read(np.float64, step)
        lists.steps[np.float64, step] = gain.view(Counted), sure
    queries = values[:200:20]
    first = [(np.arange(3000)[np.lexsort((np.arange(3000), -(values @ q)))][:20] + 10_000, np.sort(values @ q)[::-1][:20]) for q in queries]
    lists.search(queries, np.arange(0, 200, 20), 20, first)
    assert seen and max(seen) < 3000 / 4


def brute_mix(rows):
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left = {}, 1.5 * sum(sizes.values())
    open_ = list(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[z] for z in open_) for s in open_}
        full = [s for s in open_ if share[s] >= 2 * sizes[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return sizes, target


def test_mix(spark, documents, clashing, no_documents):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.randint(0, 30)) for i in range(600)]
    table = spark.createDataFrame([(i, s, "w " * n if n else None) for i, s, n in rows], "doc_id long, source string, text string")
    sizes, target = brute_mix(rows)
    got = mixing.mix_sources(table).collect()
    assert len(got) == 600 and sorted(map(tuple, mixing.mix_sources(table.repartition(7)).collect())) == sorted(map(tuple, got))
    by = {i: (s, n) for i, s, n in rows}
    taken = defaultdict(int)
    for r in got:
        source, n = by[r.doc_id]
        assert r.size == n and r.source_size == sizes[source] and math.isclose(r.target, target[source])
        assert r.taken in {0, n, 2 * n}
        taken[source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 60 for s in sizes) and sum(taken.values()) <= 1.5 * sum(sizes.values())
    assert mixing.mix_sources(documents).count() == mixing.mix_sources(clashing.drop("target")).count() == 14
    assert mixing.mix_sources(no_documents).count() == mixing.mixed_documents(no_documents).count() == 0
    # rows without an id aren't one another's neighbours
    nameless = table.withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat("text", F.lit(" x"), F.rand(1).cast("string")))
    assert mixing.mix_sources(nameless).count() == 600
    blank = spark.createDataFrame([(1, "a", " "), (2, None, None)], "doc_id long, source string, text string")
    assert [r.taken for r in mixing.mix_sources(blank).collect()] == [0, 0]


def test_mixed_documents_repeat_rows(clashing):
    mixed = mixing.mixed_documents(clashing)
    assert mixed.columns == clashing.columns
    plan = {(r.doc_id, r.size): r for r in mixing.mix_sources(clashing).collect()}
    words = mixed.select(F.sum(mixing.word_count("text"))).first()[0]
    assert words == sum(r.taken for r in mixing.mix_sources(clashing).collect()) and plan


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav>
<!-- c --><div class="ad">buy</div><article><h1>Head &amp; more</h1><p><b>One<br>two  three<p>Four &lt;4&gt; &am</p><aside>side</aside><div class="comments"><p>me too</p></div></article><form>f</form><footer>&copy; foot</footer></body></html>"""


WORDS = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]


def say(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_pages(spark):
    rng = random.Random(0)
    body = "<html><body><div class='top'>Same banner on all pages, page {}</div><div class='main'><p>{}</p></div></body></html>"
    rows = [(1, "http://a.com/1", PAGE), (2, None, None), (3, "http://a.com/2", ""), (4, "no url", "just text"), (4, "no url", "just text"), (5, "http://a.com/3", "<p>broken <b>markup <div class=notice>no</div> tail"), (6, "http://A.com/4", "<script>x"), (7, "http://a.com/5", "<p>" + "long word " * 50_000), (8, None, PAGE)]
    own = {100 + i: say(rng, 12) for i in range(20)}
    rows += [(i, f"https://b.org/{i}", body.format(i, own[i])) for i in own]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("clash"), "removed": F.lit("clash"), "text": F.lit("clash"), "a.b": F.lit("clash")}).repartition(3)
    got = {r.page_id: r for r in style_tree.extract_text(table).collect()}
    assert len(style_tree.extract_text(table).collect()) == len(rows)
    assert got[1].text == got[8].text == "Head & more\nOne two three\nFour <4> &am"
    assert got[2].text == got[3].text == got[6].text == "" and got[4].text == "just text"
    assert got[5].text == "broken markup\ntail"
    assert got[7].n_chars == 499_999
    # the branch that all pages of a host share goes, what differs stays
    assert all(got[i].text == own[i] for i in own)
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert style_tree.extract_text(table.limit(0)).count() == 0


def test_importance_never_empties_a_page(spark):
    rows = [(i, f"http://c.net/{i}", "<body><nav>go</nav><article><p>The same article</p></article></body>") for i in range(30)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in style_tree.extract_text(table).collect()} == {"The same article"}


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_importance_decides_inside_articles(spark, broadcast, monkeypatch):
    """Unnamed menus with other words on every page, and lines that all pages share, within articles."""
    monkeypatch.setattr(style_tree, "BROADCAST_PATHS", broadcast)
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(40):
        links = "".join(f"<li><a href='/{j}'>{say(rng, 1)}</a></li>" for j in range(rng.randint(3, 8)))
        paragraphs = [say(rng, rng.randint(5, 60)) for _ in range(rng.randint(2, 9))]
        title = say(rng, 5)
        html = f"<body><div class='rail'><ul>{links}</ul></div><article><h1>{title}</h1>" + "".join(f"<p>{x}</p>" for x in paragraphs[:1]) + f"<div class='pager'>Read on, part {i} of 40</div><div class='toc'><ul>{links}</ul></div>" + "".join(f"<p>{x}</p>" for x in paragraphs[1:]) + "</article></body>"
        rows.append((i, f"http://e.io/{i}", html))
        want[i] = "\n".join([title, *paragraphs])
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in style_tree.extract_text(table).collect()} == want
    assert all(style_tree.page_text(html) != want[i] for i, _, html in rows)


def brute_tree(pages):
    """Importance by the definitions, with trees of tags as nested paths."""
    shown, texts, chars, linked, named, parent = defaultdict(dict), defaultdict(list), defaultdict(int), defaultdict(int), {}, {}
    for k, page in enumerate(pages):
        for node in style_tree.read_page(page)[0]:
            shown[node.path].setdefault(k, []).append(node.shape())
            named[node.path], parent[node.path] = node.named, node.parent
            for text, inside in node.blocks:
                texts[node.path] += [(f, k) for f in style_tree.features_of(text)]
                chars[node.path] += len(text)
                linked[node.path] += inside
    on = defaultdict(set)
    for path, found in texts.items():
        for f, k in found:
            on[path, f].add(k)

    def entropy(groups, m):
        return -sum(n / m * math.log(n / m) for n in groups) / math.log(m) if m > 1 else 1.0

    def value(path):
        m = len(shown[path])
        shapes = defaultdict(int)
        for own in shown[path].values():
            shapes["/".join(own)] += 1
        presentation = entropy(shapes.values(), m)
        under = sorted(p for p in shown if parent[p] == path and p != path)
        parts = [value(p)[0] for p in under]
        if chars[path]:
            spread = sum(entropy([1] * len(on[path, f]), len(on[path, f])) * math.log(len(on[path, f])) / math.log(m) if m > 1 and len(on[path, f]) > 1 else 0 for f, _ in texts[path]) / len(texts[path])
            parts.append((1 - spread) * (1 - linked[path] / chars[path]) * (1 + presentation) / 2)
        g = 0.9 ** len(under)
        own = (1 - g) * presentation + g * sum(parts) / len(parts) if parts else presentation
        drawn = (own * (m - 1) + 1) / (m + 1) * (0.2 if named[path] else 1)
        return own, drawn, max([drawn, *(value(p)[2] for p in under)])

    return {path: value(path)[1:] for path in shown}


@pytest.mark.parametrize("seed", range(3))
def test_tree_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    shared = [say(rng, rng.randint(1, 8)) for _ in range(4)]
    text = lambda: rng.choice(shared) if rng.random() < 0.4 else say(rng, rng.randint(0, 30)) + rng.choice(["", " 7", " 19"])

    def branch(depth):
        tag = rng.choice(["div", "div class=x", "section", "p", "ul", "nav", "div class=ad", "article"])
        inner = "".join(branch(depth - 1) for _ in range(rng.randint(0, 3))) if depth else ""
        return f"<{tag}>{text()}<a href=u>{text()}</a>{inner}{text()}</{tag.split()[0]}>"

    pages = [f"<body>{branch(3)}{branch(2)}</body>" for _ in range(rng.choice([1, 6, 12]))]
    table = spark.createDataFrame([(i, "http://f.org", p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    got = {r.path: r for r in style_tree.style_tree(table).collect()}
    want = brute_tree(pages)
    assert set(got) == set(want)
    for path, (importance, best) in want.items():
        assert math.isclose(got[path].importance, importance, abs_tol=1e-9) and math.isclose(got[path].best, best, abs_tol=1e-9)
    low = {p for p, (_, best) in want.items() if best < style_tree.LOW}
    texts = {r.page_id: r.text for r in style_tree.extract_text(table).collect()}
    for i, page in enumerate(pages):
        nodes = {id(n): n for n in style_tree.read_page(page)[0]}
        up = {}
        for n in nodes.values():
            up.setdefault(n.path, n.parent)
        gone = lambda p: p > 0 and (p in low or gone(up[p]))
        blocks = style_tree.read_page(page)[1]
        assert texts[i] == "\n".join([t for t, n in blocks if not gone(n.path)] or [t for t, _ in blocks])


@pytest.mark.parametrize("bad", ["<a " * 300_000, "<a \"" * 300_000, "<a \">\" " * 100_000, "<div>" * 50_000 + "</p>" * 50_000, "<span class=ad>" * 50_000 + "<p></p>" * 50_000, "<" * 300_000, "<" + "a" * 300_000])
def test_broken_markup_takes_linear_time(bad):
    began = time.process_time()
    style_tree.page_text(bad)
    assert time.process_time() - began < 3


def test_unclosed_tags_are_text():
    assert style_tree.page_text("<p>one <b two") == "one <b two"
    assert style_tree.page_text('<p>one <a href="x>two</a> 3 < 4') == "one two 3 < 4"
    assert style_tree.page_text("<div>a <span class=ad>buy <span>it</span> now</span> b</div>") == "a\nb"


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    shared = " ".join(rng.choice(words) for _ in range(30))
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(words) for _ in range(80)) + (". " + shared if i % 9 == 0 else "")
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    rows += [(100 + i, rows[i][1], "en", "s1", 5) for i in range(10)] + [(200, "spam " * 100, "en", "s2", 5), (201, None, "en", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, function in corpus_pipeline.STAGES[:3]:
        docs = function(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = docs.collect()
    assert sorted(r.doc_id for r in kept) == list(range(60))
    assert sum(shared in r.text for r in kept) == 1 and all(r.n_chars == len(r.text) for r in kept)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(len(r.ids) == r.n_tokens for r in out)
    assert {r.doc_id for r in out} <= set(range(60)) and len(out) > 60
