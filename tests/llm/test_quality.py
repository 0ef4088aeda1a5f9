"""Repetition rules and toxicity."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F
from tessella.llm import repetition, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def dup_chars(words, n):
    windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(n)}
    return sum(len(words[i]) for i in inside)


def run_chars(words):
    inside = {i + k for n in range(1, 6) for i in range(n, len(words) - n + 1) if words[i : i + n] == words[i - n : i] for k in range(n)}
    return sum(len(words[i]) for i in inside)


def test_measures_match_brute_force(documents, clashing):
    rows = [r for r in documents.collect() if r.doc_id != 6]
    for table in (documents, clashing):
        got = {r.doc_id: r for r in repetition.repetition_rules(table).collect()}
        assert len(repetition.repetition_rules(table).collect()) == 14
        for r in rows:
            g = got[r.doc_id]
            assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == brute(r.text)
            for n in repetition.NGRAM_LIMITS:
                assert g[f"dup_chars_{n}"] == dup_chars(WORD.findall(r.text or ""), n)
            assert g.run_chars == run_chars(WORD.findall(r.text or ""))
            assert not (g.base_failed and g.kept)


def test_random_texts_match_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        words = [f"w{x}" for x in rng.integers(0, rng.integers(2, 40), rng.integers(0, 120))]
        text = "".join(w + rng.choice([" ", "\n", "\t", "  "]) for w in words)
        m = repetition.measure(text)
        assert m[:6] == brute(text)
        assert list(m[8:]) == [run_chars(words), *[dup_chars(words, n) for n in repetition.NGRAM_LIMITS]]


def test_verdicts():
    clean = " ".join(f"word{i} and thing{i * 7 % 50}" for i in range(100))
    assert repetition.measure(clean)[6]
    assert not repetition.measure("spam spam spam " * 50)[6]
    assert not repetition.measure(" ".join(f"{w} " * 7 for w in ("alpha", "beta", "gamma", "delta")))[6]
    assert not repetition.measure("too short")[6]
    # each limit bites below the base rule: 29 % of the words in windows of 8 and 6, 33 % in windows of 5
    rng = np.random.default_rng(1)
    fresh = iter(f"{a}{b}{c}{d}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst" for d in "aeiou")
    for n in (8, 6, 5):
        part = [next(fresh) for _ in range(n)]
        times = 4 if n == 8 else 6
        room = round(n * times / (0.33 if n == 5 else 0.29)) - n * times
        text = []
        for _ in range(times):
            text += part + [next(fresh) for _ in range(room // times)]
        m = repetition.measure(" ".join(text))
        assert not m[5] and not m[6] and rng, n


def test_sql_gives_the_same(spark, documents, tmp_path):
    import duckdb

    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, rng.integers(2, 60), rng.integers(0, 150)))) for i in range(150)]
    table = documents.filter("doc_id <> 6").select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    table.coalesce(1).write.parquet(f"{tmp_path}/documents")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    got = repetition.repetition_rules(table)
    want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({repetition.RULES_SQL})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_keep_documents(documents, no_documents):
    kept = repetition.keep_documents(documents)
    assert kept.schema == documents.schema
    assert {10, 11, 3, 4}.isdisjoint(r.doc_id for r in kept.collect())
    assert repetition.keep_documents(no_documents).count() == repetition.repetition_rules(no_documents).count() == 0


def test_short_repeats_go(spark):
    rng = np.random.default_rng(3)
    names = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    rows = []
    for size in range(1, 6):
        for times in range(2, 8):
            phrases = rng.permutation(names)[: 8 * size].reshape(8, size)
            phrases = np.concatenate([phrases] * (1 + 20 // (8 * size * times)))
            rows.append((len(rows), " ".join(" ".join([" ".join(p)] * times) for p in phrases)))
    n_bad = len(rows)
    zipf = 1 / np.arange(1, len(names) + 1)
    for size in (30, 200, 1000):
        rows.append((len(rows), " ".join(rng.choice(names, size, p=zipf / zipf.sum()))))
    rows.append((len(rows), "It is very very good that we had had a walk before the rain, though nobody said so so far today."))
    assert not any(repetition.measure(t)[6] for _, t in rows[:n_bad])
    kept = repetition.keep_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows[n_bad:]}


def labelled(spark, n=400):
    rng = np.random.default_rng(5)
    plain, bad = [f"w{chr(97 + i)}{chr(97 + j)}{chr(97 + i)}" for i in range(12) for j in range(12)], ["idiot", "scum", "moron", "vermin"]
    rows, labels = [], []
    for i in range(n):
        toxic = int(i % 7 == 0)
        words = list(rng.choice(plain, 60))
        for _ in range(3 * toxic):
            words[rng.integers(60)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    got = toxicity.toxicity_scores(docs, toxicity.train(docs, labels)).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_toxicity_takes_any_table(spark, documents, clashing, no_documents):
    docs, labels = labelled(spark, 150)
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, 1, None), (5, 1, 7), (7, 0, 1), (7, 0, 1)], labels.schema))
    model = toxicity.train(docs, odd)
    assert toxicity.toxicity_scores(documents, model).count() == toxicity.toxicity_scores(clashing, model).count() == 14
    assert toxicity.toxicity_scores(no_documents, model).count() == 0
    none = toxicity.train(no_documents, labels)
    scores = {r.score for r in toxicity.toxicity_scores(documents, none).collect()}
    assert scores == {0.5}
    texts = documents.filter("doc_id in (1, 2)").collect()
    assert model.score(texts[0].text) == model.score(texts[1].text)


def test_ratios_and_scores_match_brute_force(spark):
    docs, labels = labelled(spark, 120)
    model = toxicity.train(docs, labels, max_features=500, min_docs=3)
    texts = {r.doc_id: r.text for r in docs.collect()}
    learnt = [(texts[r.doc_id], r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]

    def grams(text):
        padded = " " + text.lower() + " "
        return {padded[i : i + n] for n in (3, 4, 5) for i in range(len(padded) - n + 1)}

    def bucket(gram):
        rolled = 0
        for c in map(ord, gram):
            rolled = (rolled * 0x100000001B3 + c) % 2**64
        return ((rolled + len(gram)) * 0x9E3779B97F4A7C15) % 2**64 >> 45

    counts = {}
    for text, toxic in learnt:
        for b in {bucket(g) for g in grams(text)}:
            counts.setdefault(b, [0, 0])[toxic] += 1
    enough = {b: c for b, c in counts.items() if sum(c) >= 3}
    totals = [sum(c[k] + 1 for c in enough.values()) for k in (0, 1)]
    n = [sum(t == k for _, t in learnt) for k in (0, 1)]

    def telling(c):
        df, expected = sum(c), sum(c) * n[1] / sum(n)
        return (c[1] - expected) ** 2 / max(expected * (1 - df / (sum(n) + 1)), 1e-9)

    best = sorted(enough, key=lambda b: (-telling(enough[b]), b))[:500]
    assert [model.column[b] for b in best] == list(range(500)) and (model.column >= 0).sum() == 500
    ratio = [np.log((enough[b][1] + 1) / totals[1]) - np.log((enough[b][0] + 1) / totals[0]) for b in best]
    rows = [np.array(sorted({best.index(b) for b in {bucket(g) for g in grams(t)} if b in set(best)})) for t, _ in learnt[:5]]
    assert [model.kept(t).tolist() for t, _ in learnt[:5]] == [r.tolist() for r in rows]
    _, own = toxicity.select(*(np.array(x) for x in zip(*[(b, c[1], c[0]) for b, c in counts.items()])), n[1], n[0], 500, 3)
    assert np.allclose(own, ratio)
    for text, _ in learnt[:20]:
        z = model.intercept + sum(model.weights[best.index(b)] for b in {bucket(g) for g in grams(text)} if b in set(best))
        assert abs(model.score(text) - 1 / (1 + np.exp(-z))) < 1e-9


def test_a_repeated_doc_id_teaches_once(spark):
    docs, labels = labelled(spark, 60)
    again = docs.filter("doc_id = 1").withColumn("text", F.concat("text", F.lit("!"))).unionByName(docs.filter("doc_id = 1"))
    a = toxicity.train(docs.unionByName(again), labels)
    assert len(a.weights) and a.score("x") == toxicity.train(docs.unionByName(again).repartition(5), labels).score("x")
