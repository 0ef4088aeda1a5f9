"""Removal of passages that repeat across documents, by merged Burrows-Wheeler transforms.

A byte goes if a 50-byte string that covers it also starts in a document with a
smaller doc_id. Work is split so that equal 50-byte strings always meet:

1. Equal texts are one text, kept by the least doc_id that has it. Texts lie in packs.
2. Every 50-byte window has an anchor, its 25-byte substring of least hash, the leftmost
   of equal ones. Consecutive windows with the same anchor occurrence form a string of
   at most 75 bytes. Anchors of a single document drop out.
3. Strings of the anchors that are left are dealt by anchor, so a bucket has all
   occurrences of its windows. A bucket's distinct strings, each with the least doc_id
   that has it, form shards; the shards' transforms are merged by interleave refinement
   (see bwt), and the intervals of suffixes with 50 common bytes are the repeated
   windows. An interval's least doc_id goes back to the packs.
4. A pack removes what windows of larger doc_ids cover.

Anchors only decide where windows meet, and every window with a shared anchor is
compared byte by byte in the transforms, so hash collisions cost time, not results. A
passage in a third of all documents is one distinct string a pack inside, and at its
edges, where strings differ from document to document, an anchor in very many packs
deals its windows one by one, so no bucket gathers them.

Null and empty texts have no bytes. Rows without doc_id are kept whole and remove
nothing. Rows with the same doc_id don't remove from each other. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.bwt import Strings, merge_intervals
from tessella.llm.common import only, release_shuffles, remove, stage

LENGTH, ANCHOR = 50, 25
#: Bytes of a pack of texts, of the strings merged at once, and of a shard.
PACK, CELL, SHARD = 2 << 20, 512 << 10, 128 << 10
#: Buckets that a pack deals to at least; more only where the bytes of one would be too many for a task.
BUCKETS = 64
#: Window starts that anchors are found for at once; positions take 20 bits.
_SEGMENT = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_POWERS = {n: np.uint64(pow(_BASE, n, 1 << 64)) for n in (1, 2, 4, 8, 16)}
_PLACE = np.uint64((1 << 20) - 1)
#: An anchor in more packs than this deals its windows one by one, by their own hash.
COMMON = 2000
#: An anchor's number takes 55 bits of its hash; the top bit of 7 bytes says it is in two documents of a pack.
_NUMBER, _TWICE, _COMMON = np.uint64(9), np.uint64(1 << 55), np.uint64(1 << 56)


def _minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


def _segment(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = text.astype(np.uint64) + np.uint64(1)
    rolled, n = codes, 1
    while n < 16:
        rolled = rolled[:-n] * _POWERS[n] + rolled[n:]
        if n == 4:
            eight = rolled
        n *= 2
    grams = rolled[: -9 or None] * _POWERS[8]
    grams = (grams + eight[16 : 16 + len(grams)]) * _POWERS[1] + codes[24 : 24 + len(grams)]
    grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    grams = (grams ^ (grams >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    grams ^= grams >> np.uint64(31)
    placed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    least = _minima(placed, LENGTH - ANCHOR + 1)
    starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    return grams[(least[starts] & _PLACE).astype(np.int64)], starts


def runs(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows of each run with one anchor."""
    windows = len(text) - LENGTH + 1
    if windows < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes, starts, counts = [], [], []
    for at in range(0, windows, _SEGMENT):
        own = min(_SEGMENT, windows - at)
        h, s = _segment(text[at : at + own + LENGTH - 1])
        hashes.append(h)
        starts.append(s + at)
        counts.append(np.diff(np.concatenate((s, [own]))))
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(counts)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)


def _squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _swell(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def _pack(most: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        digests: list[str] = []
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"pack": pa.array([number], pa.int64()), "digests": pa.array([digests], pa.list_(pa.string())), "ids": pa.array([ids], pa.list_(pa.int64())), "sizes": pa.array([list(map(len, texts))], pa.list_(pa.int64())), "text": pa.array([_squeeze(b"".join(texts))], pa.binary())})

        for batch in batches:
            for digest, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                digests.append(digest)
                ids.append(doc_id)
                texts.append(text.as_py().encode())
                size += len(texts[-1])
                if size >= most:
                    yield row()
                    number += 1
                    digests, ids, texts, size = [], [], [], 0
        if ids:
            yield row()

    return each


def _texts(sizes: pa.Scalar, text: pa.Scalar) -> list[np.ndarray]:
    whole = np.frombuffer(_swell(text.as_py()), np.uint8)
    ends = np.cumsum(np.array(sizes.as_py(), np.int64))
    return [whole[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _cuts(sorted_keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, from, to) of each run of equal keys."""
    if not len(sorted_keys):
        return []
    at = np.concatenate(([0], np.flatnonzero(np.diff(sorted_keys)) + 1, [len(sorted_keys)]))
    return [(int(sorted_keys[a]), int(a), int(b)) for a, b in zip(at[:-1], at[1:])]


def _anchors(buckets: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, sizes, text in zip(*(batch.column(i) for i in range(3))):
                found = [np.unique(runs(t)[0]) for t in _texts(sizes, text)]
                hashes, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                bucket = _bucket(hashes, buckets)
                order = np.argsort(bucket, kind="stable")
                packed = ((hashes >> _NUMBER) | np.where(n > 1, _TWICE, np.uint64(0)))[order]
                raw = packed.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
                cut = _cuts(bucket[order])
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in cut], pa.int32()), pa.array([pack.as_py()] * len(cut), pa.int64()), pa.array([raw[a:b].tobytes() for _, a, b in cut], pa.binary())], names=["bucket", "pack", "blob"])

    return each


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(bucket, its packs and blobs) of rows in order of bucket."""
    now, held = None, []
    for batch in batches:
        for bucket, pack, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if bucket != now:
                if held:
                    yield now, held
                now, held = bucket, []
            held.append((pack, blob))
    if held:
        yield now, held


def _shared(common_packs: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _whole_buckets(batches):
            parts = []
            for _, blob in rows:
                wide = np.zeros((len(blob) // 7, 8), np.uint8)
                wide[:, :7] = np.frombuffer(blob, np.uint8).reshape(-1, 7)
                parts.append(wide.view("<u8").ravel())
            every = np.concatenate(parts)
            twice = (every & _TWICE) != 0
            every &= ~_TWICE
            order = np.argsort(every)
            ordered = every[order]
            same = np.concatenate(([False], ordered[1:] == ordered[:-1]))
            shared = np.zeros(len(every), bool)
            shared[order] = same | np.concatenate((same[1:], [False]))
            shared |= twice
            first = np.flatnonzero(~same)
            packs_with = np.diff(np.concatenate((first, [len(every)])))
            common = np.empty(len(every), bool)
            common[order] = np.repeat(packs_with > common_packs, packs_with)
            every |= np.where(common, _COMMON, np.uint64(0))
            # a number flagged in one pack is shared in all: it is there twice or alone
            packs, blobs, at = [], [], 0
            for (pack, _), part in zip(rows, parts):
                own = every[at : at + len(part)][shared[at : at + len(part)]]
                at += len(part)
                if len(own):
                    packs.append(pack)
                    blobs.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(packs, pa.int64()), pa.array(blobs, pa.binary())], names=["pack", "shared"])

    return each


def _one_by_one(raw: bytes, begin: np.ndarray, size: np.ndarray, key: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs with those of common anchors cut into single windows under their own hash."""
    n = size[many]
    singles = np.repeat(begin[many] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    own = np.array([xxhash.xxh64_intdigest(raw[a : a + LENGTH]) for a in singles.tolist()], np.uint64)
    return np.concatenate((begin[~many], singles)), np.concatenate((size[~many], np.ones(len(singles), np.int64))), np.concatenate((key[~many], own))


def _strings(buckets: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, ids, sizes, text, blobs in zip(*(batch.column(i) for i in range(5))):
                pack = pack.as_py()
                shared = np.concatenate([np.frombuffer(b, "<u8") for b in blobs.as_py()])
                shared = shared[np.argsort(shared & ~_COMMON)]
                common, shared = (shared & _COMMON) != 0, shared & ~_COMMON
                number: dict[bytes, int] = {}
                least: list[int] = []
                anchors: list[int] = []
                docs, starts, which = [], [], []
                for local, (doc_id, own) in enumerate(zip(ids.as_py(), _texts(sizes, text))):
                    hashes, first, count = runs(own)
                    if not len(hashes):
                        continue
                    short = hashes >> _NUMBER
                    at = np.minimum(np.searchsorted(shared, short), len(shared) - 1)
                    hit = np.flatnonzero(shared[at] == short)
                    raw = own.tobytes()
                    begin, size, key = first[hit], count[hit], hashes[hit]
                    many = common[at[hit]]
                    if many.any():
                        begin, size, key = _one_by_one(raw, begin, size, key, many)
                    for a, n, h in zip(begin.tolist(), size.tolist(), key.tolist()):
                        string = raw[a : a + n + LENGTH - 1]
                        k = number.get(string)
                        if k is None:
                            k = number[string] = len(least)
                            least.append(doc_id)
                            anchors.append(h)
                        elif doc_id < least[k]:
                            least[k] = doc_id
                        which.append(k)
                    docs.append(np.full(len(begin), local, np.uint32))
                    starts.append(begin)
                if not number:
                    continue
                hashes = np.array(anchors, np.uint64)
                bucket = _bucket(hashes, buckets)
                order = np.argsort(bucket, kind="stable")
                place = np.empty(len(order), np.uint32)
                place[order] = np.arange(len(order), dtype=np.uint32)
                strings = list(number)
                lows = np.array(least, np.int64)
                occurrences = np.concatenate(docs).tobytes() + np.concatenate(starts).astype("<i8").tobytes() + place[np.array(which)].tobytes()
                out = [(-1, occurrences)]
                for k, a, b in _cuts(bucket[order]):
                    mine = order[a:b]
                    some = [strings[i] for i in mine.tolist()]
                    lengths = np.fromiter(map(len, some), np.uint8, len(some))
                    out.append((k, _squeeze(np.array([len(some)], "<u4").tobytes() + hashes[mine].astype("<u8").tobytes() + lows[mine].astype("<i8").tobytes() + lengths.tobytes() + b"".join(some))))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([pack] * len(out), pa.int64()), pa.array([b for _, b in out], pa.binary())], names=["bucket", "pack", "blob"])

    return each


def least_by_window(strings: list[bytes], anchors: np.ndarray, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window of the strings the least doc_id that has it, and where each string's windows begin."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings)) - LENGTH + 1
    begins = np.cumsum(sizes) - sizes
    found = np.empty(int(sizes.sum()), np.int64)
    order = np.argsort(anchors, kind="stable")
    ends = np.cumsum(sizes[order] + LENGTH - 1)
    keys = anchors[order]
    a = 0
    while a < len(order):
        # whole anchors up to a cell's bytes, one at least
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CELL, "right"))
        b = min(max(b, a + 1), len(order))
        b = int(np.searchsorted(keys, keys[b - 1], "right")) if b == a + 1 else max(int(np.searchsorted(keys, keys[b], "left")), a) if b < len(order) else b
        if b == a:
            b = int(np.searchsorted(keys, keys[a], "right"))
        own = order[a:b]
        cell = Strings([strings[i] for i in own.tolist()])
        suffixes, fresh = merge_intervals(cell, SHARD, LENGTH)
        owner = own[cell.owner[suffixes]]
        interval = np.flatnonzero(fresh)
        least = np.minimum.reduceat(lows[owner], interval)
        found[begins[owner] + cell.within[suffixes]] = least[np.cumsum(fresh) - 1]
        a = b
    return found, begins


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, rows in _whole_buckets(batches):
        number: dict[bytes, int] = {}
        anchors: list[int] = []
        lows: list[int] = []
        members: list[np.ndarray] = []
        for _, packed in rows:
            blob = _swell(packed)
            n = int(np.frombuffer(blob, "<u4", 1)[0])
            hashes = np.frombuffer(blob, "<u8", n, 4).tolist()
            least = np.frombuffer(blob, "<i8", n, 4 + 8 * n).tolist()
            lengths = np.frombuffer(blob, np.uint8, n, 4 + 16 * n).astype(np.int64)
            at = 4 + 17 * n
            mine = []
            for h, low, size in zip(hashes, least, lengths.tolist()):
                string = blob[at : at + size]
                at += size
                k = number.get(string)
                if k is None:
                    k = number[string] = len(lows)
                    anchors.append(h)
                    lows.append(low)
                elif low < lows[k]:
                    lows[k] = low
                mine.append(k)
            members.append(np.array(mine, np.int64))
        found, begins = least_by_window(list(number), np.array(anchors, np.uint64), np.array(lows, np.int64))
        sizes = np.diff(np.concatenate((begins, [len(found)])))
        packs, blobs = [], []
        for (pack, _), mine in zip(rows, members):
            # runs of equal verdicts of each string: how many, then their lengths and doc_ids
            size = sizes[mine]
            ends = np.cumsum(size)
            values = found[np.repeat(begins[mine] - (ends - size), size) + np.arange(int(size.sum()))]
            new = np.concatenate(([True], values[1:] != values[:-1]))
            new[(ends - size)] = True
            at = np.flatnonzero(new)
            per = np.diff(np.concatenate((np.searchsorted(at, ends - size), [len(at)]))).astype(np.uint8)
            blobs.append(np.array([len(mine), len(at)], "<u4").tobytes() + per.tobytes() + np.diff(np.concatenate((at, [len(values)]))).astype(np.uint8).tobytes() + values[at].astype("<i8").tobytes())
            packs.append(pack)
        yield pa.RecordBatch.from_arrays([pa.array(packs, pa.int64()), pa.array([bucket] * len(packs), pa.int32()), pa.array(blobs, pa.binary())], names=["pack", "bucket", "verdicts"])


def _covered(ids: np.ndarray, sizes: np.ndarray, occurrences: bytes, verdicts: list[bytes]) -> np.ndarray:
    """Which bytes of a pack go."""
    lengths, values, strings = [], [], []
    for blob in verdicts:
        n, m = np.frombuffer(blob, "<u4", 2).tolist()
        per = np.frombuffer(blob, np.uint8, n, 8).astype(np.int64)
        lengths.append(np.frombuffer(blob, np.uint8, m, 8 + n).astype(np.int64))
        values.append(np.frombuffer(blob, "<i8", m, 8 + n + m))
        strings.append(per)
    per, length, value = map(np.concatenate, (strings, lengths, values))
    first_run = np.cumsum(per) - per
    run_begin = np.cumsum(length) - length
    n = len(occurrences) // 16
    doc = np.frombuffer(occurrences, "<u4", n).astype(np.int64)
    start = np.frombuffer(occurrences, "<i8", n, 4 * n)
    which = np.frombuffer(occurrences, "<u4", n, 12 * n).astype(np.int64)
    # every occurrence's runs
    runs_of = per[which]
    total = int(runs_of.sum())
    again = np.repeat(np.arange(n), runs_of)
    run = first_run[which][again] + np.arange(total) - np.repeat(np.cumsum(runs_of) - runs_of, runs_of)
    gone = value[run] < ids[doc[again]]
    again, run = again[gone], run[gone]
    base = np.cumsum(sizes) - sizes
    begin = base[doc[again]] + start[again] + run_begin[run] - run_begin[first_run[which[again]]]
    edge = np.zeros(int(sizes.sum()) + 1, np.int32)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + length[run] + LENGTH - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _remove(with_text: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digests, ids, sizes, text, occurrences, verdicts in zip(*(batch.column(i) for i in range(6))):
                whole = np.frombuffer(_swell(text.as_py()), np.uint8)
                lengths = np.array(sizes.as_py(), np.int64)
                gone = None
                if occurrences.is_valid and verdicts.is_valid:
                    order = sorted(verdicts.as_py(), key=lambda v: v["bucket"])
                    gone = _covered(np.array(ids.as_py(), np.int64), lengths, occurrences.as_py(), [v["verdicts"] for v in order])
                removed, spans, shas, texts = [], [], [], []
                at = 0
                for digest, n in zip(digests.as_py(), lengths.tolist()):
                    own = gone[at : at + n] if gone is not None else None
                    if own is None or not own.any():
                        removed.append(0)
                        spans.append(0)
                        shas.append(digest)
                        kept = whole[at : at + n].tobytes() if with_text else b""
                    else:
                        kept = whole[at : at + n][~own].tobytes()
                        removed.append(n - len(kept))
                        spans.append(int(own[0]) + int(np.count_nonzero(own[1:] & ~own[:-1])))
                        shas.append(hashlib.sha256(kept).hexdigest())
                    # a cut within a character leaves bytes that are no character's
                    texts.append(kept.decode("utf-8", "ignore") if with_text else None)
                    at += n
                yield pa.RecordBatch.from_arrays([digests.values, ids.values, pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())], names=["digest", "first_id", "n_removed", "n_spans", "kept_sha256", "kept"])

    return each


def digest_of(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def distinct_removals(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per distinct text: digest, first_id, n_removed, n_spans, kept_sha256 and kept (what is left, or null)."""
    spark = docs.sparkSession
    rows = only(docs, "doc_id", "text").filter("doc_id IS NOT NULL").withColumn("text", F.coalesce("text", F.lit("")))
    once = rows.groupBy(digest_of("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
    packs, packs_path = stage(once.mapInArrow(_pack(PACK), "pack long, digests array<string>, ids array<long>, sizes array<long>, text binary"), "packs")
    del once
    release_shuffles(spark)
    size = packs.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0

    # near 7 bytes for each of 13 bytes of text; a bucket takes some 16 MB
    buckets = max(BUCKETS, -(-size * 6 // 10 // (16 << 20)))
    blobs = packs.select("pack", "sizes", "text").mapInArrow(_anchors(buckets), "bucket int, pack long, blob binary")
    found = blobs.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared(COMMON), "pack long, shared binary")
    shared, shared_path = stage(found, "shared-anchors")
    del blobs, found
    release_shuffles(spark)
    n_shared = (shared.agg(F.sum(F.octet_length("shared"))).first()[0] or 0) // 8

    # near 80 bytes a string; a bucket takes some 8 MB
    buckets = max(BUCKETS, -(-n_shared * 80 // (8 << 20)))
    wanted = shared.groupBy("pack").agg(F.collect_list("shared").alias("shared"))
    made = packs.select("pack", "ids", "sizes", "text").join(wanted, "pack").mapInArrow(_strings(buckets), "bucket int, pack long, blob binary")
    strings, strings_path = stage(made, "strings")
    remove(spark, shared_path)
    del made, wanted
    release_shuffles(spark)

    dealt = strings.filter("bucket >= 0").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    judged, judged_path = stage(dealt.mapInArrow(_judge, "pack long, bucket int, verdicts binary"), "verdicts")
    del dealt
    release_shuffles(spark)

    verdicts = judged.groupBy("pack").agg(F.collect_list(F.struct("bucket", "verdicts")).alias("verdicts"))
    where = strings.filter("bucket = -1").select("pack", F.col("blob").alias("occurrences"))
    joined = packs.join(where, "pack", "left").join(verdicts, "pack", "left").select("digests", "ids", "sizes", "text", "occurrences", "verdicts")
    result, _ = stage(joined.mapInArrow(_remove(with_text), "digest string, first_id long, n_removed long, n_spans long, kept_sha256 string, kept string"), "removals")
    remove(spark, packs_path, strings_path, judged_path)
    del joined, verdicts, where, packs, strings, judged
    release_shuffles(spark)
    return result


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256) of all documents."""
    found = distinct_removals(docs).drop("kept")
    keyed = docs.select("doc_id", digest_of("text").alias("digest"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return _settle(keyed.join(found, "digest", "left")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _settle(joined: DataFrame) -> DataFrame:
    """What a document loses: as its text's first document, or all of it as a later copy."""
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)) & (F.col("n_bytes") >= LENGTH)
    own = F.col("doc_id") == F.col("first_id")
    return joined.select(
        "*",
        F.when(copy, F.col("n_bytes")).when(own, F.col("n_removed")).otherwise(0).alias("removed_"),
        F.when(copy, 1).when(own, F.col("n_spans")).otherwise(0).cast("long").alias("spans_"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).when(own, F.col("kept_sha256")).otherwise(F.col("digest")).alias("sha_"),
        copy.alias("copy_"),
    ).drop("n_removed", "n_spans", "kept_sha256").withColumnsRenamed({"removed_": "n_removed", "spans_": "n_spans", "sha_": "kept_sha256"})


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages cut out of ``text``, and ``n_chars`` to match.

    A cut within a character leaves bytes that aren't UTF-8; those are dropped.
    """
    names = docs.columns
    found = distinct_removals(docs, with_text=True).select("digest", "first_id", F.col("kept").alias("clean"), "n_removed", "n_spans", "kept_sha256")
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    wide = docs.select(row, F.col("`doc_id`").alias("doc_id"), digest_of("text").alias("digest"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    joined = _settle(wide.join(found, "digest", "left"))
    text = F.when(F.col("copy_"), F.lit("")).when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.col("clean"))
    joined = joined.withColumn("clean", text)
    changed = {"text": F.col("clean"), "n_chars": F.char_length("clean").cast("long")}
    return joined.select(*[F.when(F.col("n_removed") > 0, changed[c]).otherwise(F.col(f"row.`{c}`")).alias(c) if c in changed else F.col(f"row.`{c}`").alias(c) for c in names])
