"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints link at 3 or fewer differing bits. Two fingerprints at that distance
meet at a variant that lies one flipped bit from one and two flipped bits from the
other, or nearer. Three arguments keep the balls small without losing a pair:

* At an odd distance one of the two has an even number of set bits. Even ones emit
  themselves and their 64 one-bit variants; odd ones also two-bit variants.
* Of three differing bits two lie in the same half of the 64, so pairs of flipped
  bits within a half are enough: 992 of 2,016.
* Two odd ones differ in 0 or 2 bits and meet at one-bit variants.

Within one variant's group, members at radius 0 or 1 are linked to each other (at
most 2 bits apart) and, if one of them is even, to those at radius 2 (at most 3).
So a star from one member gives a whole group's connection, never all its pairs.
At a distance of 2 or less the one-bit variants are enough for all.

Only distinct fingerprints emit. Their variants are dealt to a fixed number of buckets,
so a block of fingerprints always makes the same number of rows, each with the
fingerprints that fall in the bucket and the numbers of their flips; where buckets
would be too large for a task, a second shuffle splits each into finer ones. A task
joins its links into a forest before they leave it. Components are those of
fingerprints; the least doc_id of one names it afterwards.

Null and empty texts and texts without words have fingerprint zero and link like any
other. Fewer than three words are one shingle. Repeated rows have equal fingerprints
and share a component. Rows without doc_id get a row, and their fingerprints link
others; a component without any doc_id has component_id null. Ties can't arise, as only
a least doc_id is asked for. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import only, partitions, release_shuffles, remove, stage

SEED = 42
#: Fingerprints that a task unfolds at once, and buckets that their variants are dealt to (an eighth for each of several rounds).
BLOCK, COARSE = 4096, 64
#: Variants of one bucket that a task holds, and those that are split together.
HELD, SPLIT = 3_000_000, 4_000_000
#: Independent fingerprints by which candidates for copies are found, and their distance.
ROUNDS, NEAR = 8, 2
#: Candidates also agree in one of BANDS groups of MINIMA least hashes of shingles, which cut texts do.
BANDS, MINIMA = 24, 6
#: Copies share this part of their distinct shingles of SHINGLE words, as a fraction.
SHINGLE, SIMILAR = 5, (4, 5)
#: Candidates that one task compares; larger groups go block against block.
TOGETHER = 512
#: Candidates and dropped rows are broadcast to the texts up to this number.
BROADCAST_IDS = 1_000_000
#: Links up to this number (16 bytes each) are joined in one task, more by star rounds.
ONE_TASK_LINKS = 2_000_000


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of a text's word shingles in order, repeats included; fewer words than that are one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of a text's word shingles, repeats included."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * counts > len(hashes)).astype(np.uint64)).sum(dtype=np.uint64))


def flips(distance: int = 3) -> tuple[np.ndarray, int]:
    """Masks of all flips that the distance needs, radius 0 and 1 first, and how many those are."""
    one = [1 << i for i in range(64)]
    two = [(1 << i) | (1 << j) for half in (0, 32) for i in range(half, half + 32) for j in range(i + 1, half + 32)]
    return np.array([0, *one, *(two if distance > 2 else [])], np.uint64), 1 + len(one)


def _parity(x: np.ndarray) -> np.ndarray:
    for shift in (32, 16, 8, 4, 2, 1):
        x = x ^ (x >> np.uint64(shift))
    return (x & np.uint64(1)).astype(bool)


def _spread(variants: np.ndarray, buckets: int, finer: bool = False) -> np.ndarray:
    x = (variants ^ (variants >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    if finer:
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=["doc_id", "bits"])


def _bundle(keys: np.ndarray, own: np.ndarray, who: np.ndarray, flip: np.ndarray, kind: str) -> pa.RecordBatch:
    """A row for each key: its fingerprints, how many flips each has, and the flips."""
    order = np.lexsort((who, keys))
    keys, who, flip = keys[order], who[order], flip[order].astype(kind)
    fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (who[1:] != who[:-1]))) if len(keys) else np.zeros(0, bool)
    first = np.flatnonzero(fresh)
    counts = np.diff(np.concatenate((first, [len(keys)]))).astype("<u2")
    owners, owner_keys = own[who[first]].astype("<u8"), keys[first]
    cut = np.flatnonzero(np.concatenate(([True], owner_keys[1:] != owner_keys[:-1]))) if len(first) else np.zeros(0, np.int64)
    names, blobs = [], []
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(first)]):
        x, y = int(first[a]), int(first[b]) if b < len(first) else len(keys)
        names.append(int(owner_keys[a]))
        blobs.append(np.array([b - a], "<u4").tobytes() + owners[a:b].tobytes() + counts[a:b].tobytes() + flip[x:y].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def _unbundle(raw: pa.Scalar, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and flip of every variant of a row."""
    buffer = raw.as_buffer()
    n = int(np.frombuffer(buffer, "<u4", 1)[0])
    counts = np.frombuffer(buffer, "<u2", n, 4 + 8 * n)
    return np.repeat(np.frombuffer(buffer, "<u8", n, 4), counts), np.frombuffer(buffer, kind, -1, 4 + 10 * n).astype(np.int64)


def _kind(distance: int) -> str:
    return "<u2" if distance > 2 else "u1"


def _emit(buckets: int, distance: int = 3):
    """Rows (round, bits) to the variants of their fingerprints, ``buckets`` for each round."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, near = flips(distance)
        held: dict[int, list[np.ndarray]] = {}

        def unfold(r: int, own: np.ndarray) -> pa.RecordBatch:
            odd = np.flatnonzero(_parity(own)) if len(masks) > near else np.zeros(0, np.int64)
            variants = np.concatenate(((own[:, None] ^ masks[None, :near]).ravel(), (own[odd][:, None] ^ masks[None, near:]).ravel()))
            who = np.concatenate((np.repeat(np.arange(len(own)), near), np.repeat(odd, len(masks) - near)))
            flip = np.concatenate((np.tile(np.arange(near), len(own)), np.tile(np.arange(near, len(masks)), len(odd))))
            return _bundle(r * buckets + _spread(variants, buckets), own, who, flip, _kind(distance))

        for batch in batches:
            rounds, bits = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for r in np.unique(rounds).tolist():
                own = np.concatenate((*held.pop(r, ()), bits[rounds == r]))
                for at in range(0, len(own), BLOCK):
                    if len(own) - at >= BLOCK:
                        yield unfold(r, own[at : at + BLOCK])
                    else:
                        held[r] = [own[at:].copy()]
        for r, parts in held.items():
            yield unfold(r, np.concatenate(parts))

    return each


def _keyed(batches: Iterator[pa.RecordBatch], kind: str, most: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each bucket's fingerprints and flips from rows in order of bucket, in parts of ``most`` variants if given."""
    now, owners, flip, size = None, [], [], 0
    for batch in batches:
        for key, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if owners and (key != now or (most and size >= most)):
                yield now, np.concatenate(owners), np.concatenate(flip)
                owners, flip, size = [], [], 0
            now = key
            x, y = _unbundle(blob, kind)
            owners.append(x)
            flip.append(y)
            size += len(x)
    if owners:
        yield now, np.concatenate(owners), np.concatenate(flip)


def _split(finer: int, distance: int):
    """Buckets to ``finer`` ones each, many blocks' variants together."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, _ = flips(distance)
        for key, owners, flip in _keyed(batches, _kind(distance), SPLIT):
            own, who = np.unique(owners, return_inverse=True)
            yield _bundle(key * finer + _spread(owners ^ masks[flip], finer, True), own, who, flip, _kind(distance))

    return each


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest links with the same components: every node to its component's least."""
    if not len(a):
        return a, b
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        differ = p != q
        if not differ.any():
            break
        x, y, p, q = x[differ], y[differ], p[differ], q[differ]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while True:  # shorten paths
            up = root[root]
            if (up == root).all():
                break
            root = up
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def meet(variants: np.ndarray, owners: np.ndarray, near: np.ndarray, distance: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Links between distinct owners of equal variants, one star for each variant, verified."""
    odd = _parity(owners)
    # the centre of a star comes first: even, then near, then far
    order = np.lexsort((odd.astype(np.int8) + ~near, variants))
    variants, owners, odd, near = variants[order], owners[order], odd[order], near[order]
    start = np.concatenate(([True], variants[1:] != variants[:-1]))
    centre = np.flatnonzero(start)[np.cumsum(start) - 1]
    linked = (owners != owners[centre]) & near[centre] & (near | ~odd[centre])
    a, b = owners[linked], owners[centre[linked]]
    if len(a):
        differ = a ^ b
        bits = np.unpackbits(differ.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1)
        a, b = a[bits <= distance], b[bits <= distance]
    return a, b


def _collide(buckets: int, distance: int = 3):
    """Links (round, a, b) of the buckets' variants; ``buckets`` for each round."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, n_near = flips(distance)
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for key, owners, flip in _keyed(batches, _kind(distance), None):
            links = forest(*meet(owners ^ masks[flip], owners, flip < n_near, distance))
            if len(links[0]):
                found.setdefault(key // buckets, []).append(links)
        for r, links in found.items():
            a, b = forest(*(np.concatenate(x) for x in zip(*links)))
            for at in range(0, len(a), 100_000):
                x, y = (v[at : at + 100_000].view(np.int64) for v in (a, b))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), r), pa.int32()), pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["round", "a", "b"])

    return each


def near_pairs(distinct: DataFrame, size: int, rounds: int = 1, distance: int = 3) -> DataFrame:
    """Links (round, a, b) whose components are those of all pairs of a round within ``distance`` bits.

    ``distinct`` holds rows (round, bits), each once; ``size`` is their number.
    """
    spark = distinct.sparkSession
    masks, near = flips(distance)
    variants = size * (near + (len(masks) - near) // 2)
    own = COARSE if rounds == 1 else COARSE // 8
    packed = distinct.select("round", "bits").mapInArrow(_emit(own, distance), "bucket long, blob binary")
    finer = -(-variants // (HELD * own * rounds))
    if finer > 1:
        # several tasks share a bucket: each splits the rows of some blocks
        tasks = max(partitions(spark), -(-variants // (4 * SPLIT)))
        dealt = packed.withColumn("lot", F.pmod(F.xxhash64("blob"), F.lit(-(-tasks // (own * rounds)) or 1))).repartition(tasks, "bucket", "lot")
        packed = dealt.select("bucket", "blob").sortWithinPartitions("bucket").mapInArrow(_split(finer, distance), "bucket long, blob binary")
    buckets = own * finer
    tasks = max(partitions(spark), min(buckets * rounds, -(-variants // HELD)))
    dealt = packed.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_collide(buckets, distance), "round int, a long, b long").distinct()


def _one_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if parts:
        node, root = forest(*(np.concatenate(x) for x in zip(*parts)))
        own = np.unique(root)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((node, own)), pa.int64()), pa.array(np.concatenate((root, own)), pa.int64())], names=["node", "root"])


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, root): the least node of each node's component, for all nodes in the stored table ``links``.

    Links of a checked small number are joined in one task. Beyond it, alternating large-star and small-star rounds run, each written to the shared folder; a hub's
    least neighbour is a map-side minimum, and its links are a plain join that adaptive
    execution may split.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")
    if edges.count() <= ONE_TASK_LINKS:
        return edges.repartition(1).mapInArrow(_one_forest, "node long, root long")
    edges, path = stage(edges.distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large, large_path = stage(large, "large-star")
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = small.unionByName(own.select("u", F.col("m").alias("v"))).distinct()
        small, small_path = stage(small, "small-star")
        # done when every node has one root and no root hangs on another
        loose = small.groupBy("u").count().filter("count > 1").limit(1).count() or small.join(small.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        remove(spark, path, large_path)
        edges, path = small, small_path
        if not loose:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def simhash_components(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, bits, component_id) of all documents; bits is the fingerprint as a signed long."""
    prints, _ = stage(only(docs, "doc_id", "text").mapInArrow(_fingerprints, "doc_id long, bits long"), "fingerprints")
    classes, _ = stage(prints.groupBy("bits").agg(F.min("doc_id").alias("first_id")), "classes", few=True)
    links, links_path = stage(near_pairs(classes.withColumn("round", F.lit(0)), classes.count()), "near-pairs", few=True)
    roots = components(links, "a", "b").withColumnRenamed("node", "bits")
    rooted = classes.join(roots, "bits", "left").select("bits", "first_id", F.coalesce("root", "bits").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # plain tables on both sides, so that adaptive execution can split a fingerprint of very many rows
    named, _ = stage(rooted.join(least, "root").select("bits", "component_id"), "named-classes", few=True)
    remove(docs.sparkSession, links_path)
    return prints.join(named, "bits").select("doc_id", "bits", "component_id")


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word in order."""
    words = (text or "").encode().lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(words: np.ndarray) -> np.ndarray:
    """The distinct shingles by which copies are judged, in ascending order, from a text's word hashes."""
    if not len(words):
        return np.zeros(0, np.uint64)
    # fewer words are one shingle, told apart by their number
    n = min(SHINGLE, len(words))
    rolled = words + np.uint64(n)
    for i in range(1, n):
        rolled = rolled[:-1] * _MULTIPLIER + words[i:]
    return np.unique(_mixed(rolled))


_ROUND_KEYS = [np.uint64(r * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for r in range(64)]


def several_fingerprints(words: np.ndarray, rounds: int) -> np.ndarray:
    """Independent SimHashes of a text's words, each counting 1 + ln of its number, from the word hashes."""
    if not len(words):
        return np.zeros(rounds, np.uint64)
    distinct, numbers = np.unique(words, return_counts=True)
    weights = np.floor(1024 * (1 + np.log(numbers)) + 0.5)
    counts = np.zeros(rounds * 64)
    for at in range(0, len(distinct), 1024):
        mixed = np.stack([_mixed((distinct[at : at + 1024] ^ _ROUND_KEYS[r]) * _MULTIPLIER) for r in range(rounds)], axis=1)
        bits = np.unpackbits(mixed.astype("<u8").view(np.uint8).reshape(len(mixed), -1), axis=1, bitorder="little")
        counts += weights[at : at + 1024] @ bits.astype(np.float64)
    return np.packbits(2 * counts > weights.sum(), bitorder="little").view("<u8").astype(np.uint64)


_ORDERS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(shingles: np.ndarray) -> np.ndarray:
    """A key for each band: the least hashes under MINIMA orders; none without shingles."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    least = np.full(len(_ORDERS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[at : at + 1024, None] * _ORDERS).min(axis=0), out=least)
    key = np.zeros(BANDS, np.uint64)
    for column in least.reshape(BANDS, MINIMA).T:
        key = _mixed(key * _MULTIPLIER + column)
    return key


def _name(shingles: np.ndarray) -> int:
    """The number of all texts with these shingles, as a signed long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.astype("<u8").tobytes(), SEED)).astype(np.int64))


def _several(rounds: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, prints = [], []
            for text in batch.column(2):
                words = word_hashes(text.as_py())
                shingles = shingle_set(words)
                names.append(_name(shingles))
                prints.append(np.concatenate((several_fingerprints(words, rounds), bands(shingles))).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.int64()), pa.array(prints, pa.binary())], names=["doc_id", "digest", "node", "prints"])

    return each


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = batch.column(0).to_numpy()
        bits = [np.frombuffer(x.as_buffer(), "<i8") for x in batch.column(1)]
        sizes = np.fromiter(map(len, bits), np.int64, len(bits))
        rounds = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        yield pa.RecordBatch.from_arrays([pa.array(rounds, pa.int32()), pa.array(np.concatenate(bits) if bits else [], pa.int64()), pa.array(np.repeat(nodes, sizes), pa.int64())], names=["round", "bits", "node"])


def candidates(classes: DataFrame, rounds: int, distance: int = NEAR) -> DataFrame:
    """Links (x, y) between nodes whose fingerprints of one round lie within ``distance`` bits, or that agree in a band.

    ``classes`` holds rows (node, prints) with the fingerprints of all rounds, then the bands' keys.
    """
    entries = classes.select("node", "prints").mapInArrow(_entries, "round int, bits long, node long")
    firsts, firsts_path = stage(entries.groupBy("round", "bits").agg(F.min("node").alias("first"), F.max("node").alias("last")), "several-firsts", few=True)
    balls = firsts.filter(F.col("round") < rounds)
    pairs, pairs_path = stage(near_pairs(balls, balls.count(), rounds, distance), "near-pairs", few=True)
    one = lambda c, name: balls.select("round", F.col("bits").alias(c), F.col("first").alias(name))
    between = pairs.join(one("a", "x"), ["round", "a"]).join(one("b", "y"), ["round", "b"]).select("x", "y")
    # nodes with the same fingerprint or key
    same = firsts.filter("first <> last").select("round", "bits", "first")
    inside = entries.join(same, ["round", "bits"]).select(F.col("node").alias("x"), F.col("first").alias("y"))
    found, _ = stage(between.unionByName(inside).filter("x <> y").distinct(), "candidate-links", few=True)
    remove(classes.sparkSession, firsts_path, pairs_path)
    release_shuffles(classes.sparkSession)
    return found


def alike(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links whose components are those of all pairs that share SIMILAR of their shingles.

    Whoever is found to be a copy is compared with all that are not yet, so a family of
    copies costs a comparison each and only strangers are compared all with all.
    """
    part, whole = SIMILAR
    sizes = np.array([len(s) for s in sets], np.int64)
    left, links = np.arange(len(sets)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            own = queue.pop()
            fits = (whole * sizes[left] >= part * sizes[own]) & (whole * sizes[own] >= part * sizes[left])
            others = left[fits]
            if not len(others):
                continue
            values = np.concatenate([sets[i] for i in others])
            found = sets[own][np.minimum(np.searchsorted(sets[own], values), sizes[own] - 1)] == values
            common = np.add.reduceat(found, np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)
            copies = others[whole * common >= part * (sizes[own] + sizes[others] - common)]
            links += [(own, int(i)) for i in copies]
            queue += copies.tolist()
            left = left[~np.isin(left, copies)]
    return links


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(word_hashes(x.as_py())) for x in batch.column(2)]
        blobs = pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())
        # texts without words are one node already
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), blobs], names=["root", "node", "shingles"]).filter(pa.array([len(s) > 0 for s in sets], pa.bool_()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: tuple | None = None
    nodes: list[int] = []
    sets: list[np.ndarray] = []

    def links() -> pa.RecordBatch:
        found = alike(sets)
        return pa.RecordBatch.from_arrays([pa.array([nodes[p[i]] for p in found], pa.int64()) for i in (0, 1)], names=["x", "y"])

    for batch in batches:
        for root, part, node, blob in zip(*(batch.column(i) for i in range(4))):
            key = (root.as_py(), part.as_py())
            if key != now:
                if nodes:
                    yield links()
                now, nodes, sets = key, [], []
            nodes.append(node.as_py())
            sets.append(np.frombuffer(blob.as_buffer(), "<u8").copy())
    if nodes:
        yield links()


def _compare(rows: DataFrame, size: int) -> DataFrame:
    """Verified links within each (root, part) of rows (root, part, node, shingles)."""
    spark = rows.sparkSession
    tasks = max(partitions(spark), spark.sparkContext.defaultParallelism, -(-size // 20_000))
    dealt = rows.select("root", "part", "node", "shingles").repartition(tasks, "root", "part").sortWithinPartitions("root", "part")
    return dealt.mapInArrow(_verify, "x long, y long")


def verified(members: DataFrame, together: int = TOGETHER) -> DataFrame:
    """Links (x, y) between members (root, node, shingles) of a group that are copies.

    Their components are those of all pairs of a group that share SIMILAR of their
    shingles. A larger group is dealt in blocks: each is compared with the group's
    root, then those that aren't its copies are compared with every block.
    """
    size = members.count()
    sizes = members.groupBy("root").count()
    blocks = F.ceil(F.col("count") / together).cast("int")
    large, _ = stage(sizes.filter(F.col("count") > together).select("root", blocks.alias("blocks")), "large-groups", few=True)
    small = members.join(large, "root", "left_anti").withColumn("part", F.lit(0))
    links, _ = stage(_compare(small, size), "copy-links", few=True)
    if not large.limit(1).count():
        return links
    dealt = members.join(large, "root").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    heads = dealt.filter("node = root").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = dealt.unionByName(heads).withColumn("part", F.col("block"))
    first, _ = stage(_compare(own, size), "block-links", few=True)
    # whose component in a block holds the root needs no more comparison with its like
    linked = components(first, "x", "y").select("node", F.col("root").alias("least"))
    of_root = linked.join(large.select(F.col("root").alias("node")), "node").select("least").distinct()
    loose, _ = stage(dealt.join(linked.join(of_root, "least").select("node"), "node", "left_anti").filter("node <> root"), "loose", few=True)
    n_loose = loose.groupBy("root").count().select("root", F.ceil(F.col("count") / together).cast("int").alias("lots"))
    lot = F.pmod(F.xxhash64(F.col("node"), F.lit(1)), F.col("lots")).cast("int")
    ours = loose.join(n_loose, "root").withColumn("lot", lot).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    theirs = dealt.join(n_loose, "root").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    across = ours.select("root", "node", "shingles", "lot", "block", "blocks").unionByName(theirs.select("root", "node", "shingles", "lot", "block", "blocks"))
    second, _ = stage(_compare(across.withColumn("part", F.col("lot") * F.col("blocks") + F.col("block")), size), "loose-links", few=True)
    return links.unionByName(first).unionByName(second)


def _free(names: list[str], wanted: str) -> str:
    while wanted in names:
        wanted += "_"
    return wanted


def near_dedup(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The documents that stand first among their copies, with all their columns.

    Copies share four fifths or more of their distinct shingles of five words. Candidates
    are found by ball hashing of several fingerprints of their words and, for cut texts,
    whose words differ more, by bands of least shingle hashes; groups of candidates are
    then compared by their texts, and only links between copies count. Texts with the
    same shingles are one node throughout.

    The first of a group is the row of least doc_id, of those with equal ones the one whose
    text has the least digest; a row without doc_id stands behind all others. Rows with
    another text under the same doc_id are documents of their own. Of wholly equal
    (doc_id, text) one row stays.
    """
    spark = docs.sparkSession
    digest = F.xxhash64(F.coalesce(F.col("`text`"), F.lit("")))
    keyed = docs.select(F.col("`doc_id`").alias("doc_id"), digest.alias("digest"), F.col("`text`").alias("text"))
    prints, prints_path = stage(keyed.mapInArrow(_several(rounds), "doc_id long, digest long, node long, prints binary"), "several-fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")
    classes, classes_path = stage(prints.groupBy("node").agg(F.min(order).alias("first"), F.first("prints").alias("prints"), F.count("*").alias("n")), "classes", few=True)
    groups, _ = stage(components(candidates(classes, rounds), "x", "y"), "candidate-groups", few=True)
    # one text a node: that of its first row
    asked = groups.join(classes, "node").select("root", "node", F.col("first.doc_id").alias("own_id"), F.col("first.digest").alias("own_digest"))
    asked = F.broadcast(asked) if groups.count() <= BROADCAST_IDS else asked
    meets = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest"))
    texts = keyed.join(asked, meets).select("root", "node", "text")
    members, members_path = stage(texts.mapInArrow(_members, "root long, node long, shingles binary").dropDuplicates(["root", "node"]), "candidate-texts", few=True)
    copies, _ = stage(components(verified(members), "x", "y"), "copies", few=True)
    group = F.coalesce("root", classes.node)
    whole = classes.join(copies, "node", "left").select("node", group.alias("group"), "first", "n")
    firsts = whole.groupBy("group").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    # what goes: rows of groups of two and more that aren't their group's first, and rows that repeat a first
    several, _ = stage(whole.join(firsts.filter("n > 1").withColumnRenamed("first", "stays").drop("n"), "group").select("node", "stays"), "several-rows", few=True)
    rows = prints.join(several, "node").withColumn("first", order == F.col("stays"))
    keys, _ = stage(rows.groupBy("doc_id", "digest", "first").agg(F.count("*").alias("n")), "row-keys", few=True)
    remove(spark, members_path)
    names = docs.columns
    extra = [_free(names, x) for x in ("key_id", "own_digest", "key_digest")]
    named = docs.withColumn(extra[1], digest)

    def keys_of(condition: str) -> DataFrame:
        found = keys.filter(condition).select(F.col("doc_id").alias(extra[0]), F.col("digest").alias(extra[2]))
        return F.broadcast(found) if found.count() <= BROADCAST_IDS else found

    same = F.col("`doc_id`").eqNullSafe(F.col(extra[0])) & (F.col(extra[1]) == F.col(extra[2]))
    own = lambda df: df.select(*[F.col(f"`{c}`") for c in names])
    stay = own(named.join(keys_of("NOT first OR n > 1"), same, "left_anti"))
    if keys.filter("first AND n > 1").limit(1).count():
        again = named.join(keys_of("first AND n > 1"), same, "left_semi")
        places = again.toDF(*[f"c{i}" for i in range(len(again.columns))])
        once = places.dropDuplicates([f"c{names.index('doc_id')}", f"c{len(names)}"])
        stay = stay.union(once.select(*[f"c{i}" for i in range(len(names))]).toDF(*names))
    remove(spark, prints_path, classes_path)
    return stay
