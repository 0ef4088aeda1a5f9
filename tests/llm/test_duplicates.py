"""SimHash components and repeated passages against brute force."""

import hashlib
import random

import numpy as np
import pyarrow.compute  # noqa: F401
import pytest
import xxhash
from pyspark.sql import functions as F
from tessella.llm import bwt, repeats, simhash


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [(d, brute_fingerprint(t)) for d, t in rows]
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, p - (1 << 64) if p >= 1 << 63 else p, least[find(i)]) for i, (d, p) in enumerate(prints))


def test_fingerprints():
    for text in (None, "", " \n", "one", "Two WORDS", "A b c", "Über straße ÄÖ x y", "a " * 9000):
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_components_match_brute_force(spark, documents, clashing):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = brute_components(rows)
    for table in (documents, clashing):
        assert sorted(map(tuple, simhash.simhash_components(table).collect())) == want
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(150)]
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, simhash.simhash_components(table).collect())) == brute_components(rows)


def test_rows_without_ids_link_others(spark):
    """Texts whose fingerprints differ by 3, 1 and 4 bits: the middle one has no id."""
    rng = random.Random(1)
    prints = {9: 0, None: 0b111, 1: 0b1111}
    found = spark.createDataFrame([(d, b) for d, b in prints.items()], "doc_id long, bits long")
    real = simhash._fingerprints
    try:
        simhash._fingerprints = lambda batches: iter(batches)
        got = simhash.simhash_components(found.withColumnRenamed("bits", "text")).collect()
    finally:
        simhash._fingerprints = real
    assert {r.doc_id: r.component_id for r in got} == {1: 1, None: 1, 9: 1} and rng
    alone = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (4, "")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.simhash_components(alone).collect()} == {(None, None), (4, 4)}


@pytest.mark.parametrize("distance", [2, 3])
@pytest.mark.parametrize("seed", range(4))
def test_balls_meet_at_every_pair(seed, distance, monkeypatch):
    import pyarrow as pa

    rng = random.Random(seed)
    found = {rng.getrandbits(64) for _ in range(40)}
    for x in list(found):
        for _ in range(rng.randint(0, 10)):
            for i in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4])):
                x ^= 1 << i
            found.add(x)
    prints = np.array(sorted(found), np.uint64)
    bits = np.unpackbits((prints[:, None] ^ prints[None]).view(np.uint8).reshape(len(prints), len(prints), 8), axis=2).sum(2)
    i, j = np.nonzero((bits > 0) & (bits <= distance))
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "SPLIT", 3000)
    rounds = pa.array([0, 2] * len(prints), pa.int32())
    batch = pa.RecordBatch.from_arrays([rounds, pa.array(np.repeat(prints, 2).view(np.int64))], names=["round", "bits"])
    rows = pa.Table.from_batches(list(simhash._emit(5, distance)([batch])))
    for finer in (1, 3):
        if finer > 1:
            rows = pa.Table.from_batches(list(simhash._split(finer, distance)(rows.sort_by("bucket").to_batches())))
        out = pa.Table.from_batches(list(simhash._collide(5 * finer, distance)(rows.sort_by("bucket").to_batches())))
        for r in (0, 2):
            mine = out.filter(pa.compute.equal(out["round"], r))
            a, b = (mine[k].to_numpy().view(np.uint64) for k in ("a", "b"))
            assert [x.tolist() for x in simhash.forest(a, b)] == [x.tolist() for x in simhash.forest(prints[i], prints[j])]
            assert all(bin(int(p) ^ int(q)).count("1") <= distance for p, q in zip(a, b)) or finer
        assert set(out["round"].to_pylist()) <= {0, 2}


def test_emission_grows_with_the_input():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    rows = []
    for n in (simhash.BLOCK, 2 * simhash.BLOCK, 4 * simhash.BLOCK):
        batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(n), pa.int32()), pa.array(rng.integers(0, 1 << 62, n), pa.int64())], names=["round", "bits"])
        rows.append(sum(x.num_rows for x in simhash._emit(simhash.COARSE, 2)([batch])))
    assert rows == [simhash.COARSE, 2 * simhash.COARSE, 4 * simhash.COARSE]


@pytest.mark.parametrize("held", [3_000_000, 2000])
def test_second_shuffle_changes_nothing(spark, held, monkeypatch):
    monkeypatch.setattr(simhash, "HELD", held)
    rng = random.Random(5)
    found = {rng.getrandbits(63) for _ in range(60)}
    for x in list(found):
        for _ in range(3):
            x ^= 1 << rng.randrange(63)
            found.add(x)
    rows = spark.createDataFrame([(r, b) for b in found for r in (0, 1)], "round int, bits long").repartition(4)
    links = simhash.near_pairs(rows, 2 * len(found), 2, 2).collect()
    prints = np.array(sorted(found), np.uint64)
    bits = np.unpackbits((prints[:, None] ^ prints[None]).view(np.uint8).reshape(len(prints), len(prints), 8), axis=2).sum(2)
    i, j = np.nonzero((bits > 0) & (bits <= 2))
    want = [x.tolist() for x in simhash.forest(prints[i], prints[j])]
    for r in (0, 1):
        a, b = (np.array([x[k] for x in links if x["round"] == r], np.int64).view(np.uint64) for k in ("a", "b"))
        assert [x.tolist() for x in simhash.forest(a, b)] == want


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_components_in_one_task_and_by_rounds(spark, most, monkeypatch):
    monkeypatch.setattr(simhash, "ONE_TASK_LINKS", most)
    rng = random.Random(most)
    links = [(rng.randrange(-100, 100), rng.randrange(-100, 100)) for _ in range(90)]
    root = {n: n for n in range(-100, 100)}
    for _ in range(200):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = simhash.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    named = {n for a, b in links if a != b for n in (a, b)}
    assert {r.node: r.root for r in got} == {n: root[n] for n in named} and len(got) == len(named)


def test_near_dedup_keeps_one_of_each(documents, no_documents):
    kept = simhash.near_dedup(documents)
    assert kept.columns == documents.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids))
    texts = {r.doc_id: r.text for r in documents.collect()}
    words = lambda i: frozenset((texts[i] or "").lower().split())
    assert {words(i) for i in ids} == {words(i) for i in texts} and set(ids) == {min(j for j in texts if words(j) == words(i)) for i in texts}
    nameless = documents.filter("doc_id IN (1, 3, 6)").dropDuplicates(["doc_id"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert simhash.near_dedup(nameless).count() == 3 and simhash.simhash_components(nameless.unionByName(documents)).count() == 17
    # copies without an id stand behind those with one
    assert sorted(r.doc_id for r in simhash.near_dedup(nameless.unionByName(documents)).collect()) == sorted(ids)
    assert simhash.near_dedup(no_documents).count() == simhash.simhash_components(no_documents).count() == 0


def test_near_dedup_of_clashing_columns_and_shared_ids(spark, documents, clashing):
    ids = sorted(r.doc_id for r in simhash.near_dedup(documents).collect())
    kept = simhash.near_dedup(clashing)
    assert kept.columns == clashing.columns and sorted(r.doc_id for r in kept.collect()) == ids
    rows = [(1, " ".join(f"a{i}" for i in range(40))), (1, " ".join(f"b{i}" for i in range(40))), (1, " ".join(f"b{i}" for i in range(40))), (2, " ".join(f"B{i}" for i in range(40)))]
    got = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text[:2]) for r in got) == [(1, "a0"), (1, "b0")]


def brute_repeats(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - 49) if d is not None else ():
            first[b[j : j + 50]] = min(first.get(b[j : j + 50], d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 49) if d is not None else ():
            if first[b[j : j + 50]] < d:
                gone[j : j + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(30, 160))) for _ in range(20)]
    rows = [(rng.choice([i, i, i, i // 2]), "".join(rng.choice(parts) if rng.random() < 0.6 else "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 100))) for _ in range(rng.randint(0, 5)))) for i in range(100)]
    rows += [(200 + i, rows[3][1]) for i in range(15)] + [(None, rows[5][1]), (5, None), (300, ""), (301, "ab" * 300), (302, "ab" * 200), (303, "x" * 49), (304, "x" * 49), (2, "x" * 60), (305, "x" * 500)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, common", [(0, 2000), (1, 2000), (2, 2000), (0, 0), (1, 3)])
def test_repeats_match_brute_force(spark, seed, common, monkeypatch):
    rows = passages(seed)
    monkeypatch.setattr(repeats, "PACK", 3000)
    monkeypatch.setattr(repeats, "BUCKETS", 5)
    monkeypatch.setattr(repeats, "COMMON", common)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(repr, map(tuple, repeats.repeated_passages(table).collect()))) == sorted(map(repr, brute_repeats(rows)))


def test_repeats_of_any_table(documents, clashing, no_documents):
    want = sorted(map(repr, brute_repeats([(r.doc_id, r.text) for r in documents.collect()])))
    for table in (documents, clashing):
        assert sorted(map(repr, map(tuple, repeats.repeated_passages(table).collect()))) == want
    assert repeats.repeated_passages(no_documents).count() == 0
    cut = repeats.without_repeats(clashing)
    assert cut.columns == clashing.columns
    rows = {r.doc_id: r for r in cut.collect()}
    assert rows[2].text == "" and rows[2].n_chars == 0 and rows[6].n_chars == 1 and rows[3].text is None


def test_cuts_keep_genuine_replacement_characters(spark):
    shared = "é" * 40
    rows = [(1, "a" + shared), (2, "\ufffd one " + shared + "b two \ufffd"), (3, "x\ufffd" + shared[:-1] + "\u00ea tail")]
    got = {r.doc_id: r.text for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "a" + shared, 2: "\ufffd one b two \ufffd", 3: "x\ufffd tail"}


def test_long_texts_go_in_segments(monkeypatch):
    rng = np.random.default_rng(0)
    text = rng.integers(97, 100, 5000).astype(np.uint8)
    whole = repeats.runs(text)
    monkeypatch.setattr(repeats, "_SEGMENT", 700)
    parts = repeats.runs(text)
    anchors = lambda r: np.repeat(r[0], r[2]).tolist()
    assert anchors(whole) == anchors(parts) and len(anchors(whole)) == 4951


def test_distribution_is_the_stable_order():
    rng = np.random.default_rng(0)
    for most in (1, 300, 1 << 16, 1 << 20):
        x = rng.integers(0, most, 5000)
        assert (bwt.distribute(x) == np.argsort(x, kind="stable")).all()
    assert len(bwt.distribute(np.zeros(0, np.int64))) == 0


@pytest.mark.parametrize("shard", [200, 900, 100_000])
def test_merged_intervals(shard):
    rng = random.Random(shard)
    bases = [bytes(rng.choice(b"ab\x00c") for _ in range(200)) for _ in range(3)]
    parts = []
    for _ in range(40):
        base, i = rng.choice(bases), rng.randint(0, 120)
        own = bytearray(base[i : i + rng.randint(50, 80)])
        if rng.random() < 0.5:
            own[rng.randrange(len(own))] = 97
        parts.append(bytes(own))
    strings = bwt.Strings(parts)
    suffixes, fresh = bwt.merge_intervals(strings, shard)
    windows = [bytes(strings.text[p : p + 50]) for p in suffixes]
    assert windows == sorted(windows) and len(windows) == sum(len(p) - 49 for p in parts)
    assert fresh.tolist() == [i == 0 or windows[i] != windows[i - 1] for i in range(len(windows))]


def test_near_copies_go_and_clean_texts_stay(spark):
    rng = random.Random(6)
    words = [f"{a}{b}{c}{d}" for a in "bcdfgt" for b in "aeiou" for c in "lmnrst" for d in "aeo"]
    rows, copies = [], 0
    for _ in range(60):
        base = [rng.choice(words) for _ in range(250)]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randint(0, 2)):
            own = list(base)
            for _ in range(2):
                own[rng.randrange(250)] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
            copies += 1
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.near_dedup(table).count()
    assert 60 <= kept <= 60 + 0.15 * copies


def brute_copies(texts):
    """The least number of each text's component of pairs with a Jaccard similarity of 0.8 or more."""
    sets = []
    for text in texts:
        w = text.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def copy_families(seed):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}{d}" for a in "bcdfgt" for b in "aeiou" for c in "lmnrst" for d in "aeo"]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 250))]
        texts.append(base)
        for _ in range(4):
            own = list(base)
            for _ in range(rng.randint(0, len(base) // 20)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts += [own, own[: int(len(own) * rng.uniform(0.7, 1))]]
    # the same few words in another order are no copies
    few = [f"n{i}" for i in range(12)]
    texts += [[rng.choice(few) for _ in range(200)] for _ in range(30)]
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("seed", [0, 1])
def test_only_copies_by_shingles_go(spark, seed):
    texts = copy_families(seed)
    want = {i for i, r in enumerate(brute_copies(texts)) if r == i}
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.near_dedup(table).collect()} == want


def test_large_groups_are_compared_in_blocks(spark):
    texts = copy_families(2)
    sets = [simhash.shingle_set(simhash.word_hashes(t)) for t in texts]
    nodes = {simhash._name(s): s for s in sets}
    root = min(nodes)
    rows = [(root, n, bytearray(s.astype("<u8").tobytes())) for n, s in nodes.items()]
    members = spark.createDataFrame(rows, "root long, node long, shingles binary").cache()
    groups = []
    for together in (1000, 16):
        found = simhash.components(simhash.verified(members, together), "x", "y").collect()
        groups.append(sorted((r.node, r.root) for r in found))
    assert groups[0] == groups[1] and groups[0]
