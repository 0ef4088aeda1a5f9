"""Token ids in files coded by a static range asymmetric numeral system.

A store is a folder: ``table`` holds the shared frequency table, ``blocks`` one row per
block. The rows lie in Parquet so that any store Spark writes to will do and its
committer guards against lost executors; a payload is this format's own bytes:

    magic "TANS", version, lanes, checkpoint interval, symbols, words,
    checkpoints (steps * lanes states and word positions), lane states, words, CRC-32

Symbol i goes to lane i mod lanes; one step codes a symbol of every lane with numpy.
States are 64-bit and renormalised by 32-bit words, which the lanes share in one
stream. Blocks are independent, and a checkpoint holds all lane states at a step, so
decoding can also begin inside a block. Frequencies come from all documents' ids and
add up to 2**20. The checksum covers the payload and is verified before decoding.

Blocks follow ascending doc_id (null first, then a digest of the ids for repeated
rows), hold whole documents and close at ``BLOCK`` ids. Null and empty texts have the
end id alone. An empty table gives a store without blocks.
"""

from __future__ import annotations

import gc
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.bpe import LONGEST, pretokens
from tessella.llm.common import fresh_path, only, partitions, release_shuffles, remove, stage
from tessella.llm.token_counts import load_tokenizer

END = 2
BITS, LOW = 20, 1 << 31
LANES, BLOCK, CHECKPOINT = 4096, 1 << 20, 64
#: Pretokens that one generation of a worker's memory holds.
REMEMBERED = 700_000
#: Characters of texts whose new pretokens go to the library together.
GROUP = 1 << 20
#: Words that the library gets as one text.
JOINED = 512
_HEAD = struct.Struct("<4sHHIIQI")


def _bytes_of(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder != "little":
        found.byteswap()
    return found.tobytes()


class LibraryEncoder:
    """Ids of whole texts by the tokenizers library.

    With a plain byte-level split, a text's ids are those of its pretokens, so the
    library encodes each distinct pretoken once and the worker remembers it; with any
    other tokenizer it gets whole texts.
    """

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        split = repr(self.tokenizer.pre_tokenizer)
        self.by_pretoken = self.tokenizer.normalizer is None and split.startswith("ByteLevel(") and "add_prefix_space=False" in split and "use_regex=True" in split
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            self.by_pretoken = False
        self.split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.find = pretokens
        # a byte-level token has a character for each byte
        self.lengths = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.lengths[i] = len(token)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        """The ids of pretokens that aren't in the younger generation, by one call of the library."""
        known = {p: self.old[p] for p in missing if p in self.old}
        new = [p for p in missing if p not in known]
        # words after a space stay apart when they are joined, so the library gets many as one text
        words: list[str] = []
        others: list[str] = []
        for p in new:
            (words if p[0] == " " and p[1:].isalpha() else others).append(p)
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            reach = np.cumsum(self.lengths[ids])
            ends = np.cumsum(np.fromiter((len(p.encode()) for p in group), np.int64, len(group)))
            at = np.searchsorted(reach, ends)
            if at[-1] >= len(reach) or (reach[at] != ends).any():
                others += group
                continue
            raw, cut = ids.tobytes(), (4 * (at + 1)).tolist()
            known.update(zip(group, (raw[i:j] for i, j in zip([0, *cut], cut))))
        known.update((p, _bytes_of(x.ids)) for p, x in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)))
        if len(self.young) + len(known) > REMEMBERED:
            self.old, self.young = self.young, {}
        self.young.update(known if all(len(p) <= LONGEST for p in known) else {p: x for p, x in known.items() if len(p) <= LONGEST})
        return known

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if not self.by_pretoken:
            return [_bytes_of(self.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
        found: list[list] = []
        gaps: list[tuple[list, int, str]] = []
        get = self.young.get
        for text in texts:
            if self.split and any(a in text for a in self.added):
                own: list = []
                for i, part in enumerate(self.split.split(text)):
                    if i % 2:
                        own.append(struct.pack("<I", self.added[part]))
                    else:
                        pretokens = self.find(part)
                        gaps += [(own, len(own) + k, p) for k, p in enumerate(pretokens)]
                        own += [b""] * len(pretokens)
            else:
                pretokens = self.find(text)
                own = list(map(get, pretokens))
                k = -1
                try:
                    while True:
                        k = own.index(None, k + 1)
                        gaps.append((own, k, pretokens[k]))
                except ValueError:
                    pass
            found.append(own)
        if gaps:
            wanted = {p for _, _, p in gaps}
            known = {p: self.young[p] for p in wanted if p in self.young} | self._learn({p for p in wanted if p not in self.young})
            for own, k, p in gaps:
                own[k] = known[p]
        return [b"".join(own) for own in found]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


class Table:
    """Frequencies of the used symbols, scaled to 2**BITS, and lookups for both directions."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        order = np.argsort(symbols)
        self.symbols, counts = symbols[order].astype(np.int64), counts[order].astype(np.float64)
        if len(self.symbols) > 1 << BITS:
            raise ValueError("more symbols than the table has places")
        scaled = np.maximum(1, np.floor(counts / max(counts.sum(), 1) * (1 << BITS))).astype(np.int64)
        excess = int(scaled.sum()) - (1 << BITS)
        while excess and len(scaled):
            # what rounding left goes to the frequent ones, what it took comes from them
            by = np.argsort(-scaled, kind="stable")
            if excess < 0:
                scaled[by[0]] -= excess
                break
            spare = np.minimum(scaled[by] - 1, np.maximum(scaled[by] // 64, 1))
            take = np.minimum(spare, np.maximum(excess - np.concatenate(([0], np.cumsum(spare)[:-1])), 0))
            scaled[by] -= take
            excess -= int(take.sum())
        size = int(self.symbols[-1]) + 1 if len(self.symbols) else 1
        self.frequency = np.zeros(size, np.uint64)
        self.frequency[self.symbols] = scaled
        self.start = np.zeros(size, np.uint64)
        self.start[self.symbols] = np.concatenate(([0], np.cumsum(scaled)[:-1])) if len(scaled) else 0
        self.at = np.repeat(self.symbols, scaled).astype(np.uint16 if size <= 1 << 16 else np.uint32)


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    """The payload of one block."""
    n = len(ids)
    lanes = LANES
    while lanes > 1 and n < 64 * lanes:
        lanes //= 2
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    limit, low, shift, bits = np.uint64(63 - BITS), np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(BITS)
    frequency, start = table.frequency[ids], table.start[ids]
    words: list[np.ndarray] = []
    emitted, points = 0, []
    for step in range(steps - 1, -1, -1):
        f, c = frequency[step * lanes : (step + 1) * lanes], start[step * lanes : (step + 1) * lanes]
        x = state[: len(f)]
        full = x >= f << limit
        if full.any():
            out = x[full]
            words.append((out & low).astype("<u4"))
            emitted += len(out)
            x[full] = out >> shift
        q, r = np.divmod(x, f)
        state[: len(f)] = (q << bits) + r + c
        if step and step % CHECKPOINT == 0:
            points.append((step, emitted, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    marks = b"".join(struct.pack("<IQ", step, emitted_all) + x.astype("<u8").tobytes() for step, emitted_all, x in ((s, emitted - e, x) for s, e, x in points[::-1]))
    body = _HEAD.pack(b"TANS", 1, len(points), lanes, CHECKPOINT, n, emitted) + marks + state.astype("<u8").tobytes() + stream.tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(payload: bytes, table: Table, checkpoint: int | None = None) -> np.ndarray:
    """The ids of a block, or those from its checkpoint of that number to the next."""
    body, (crc,) = memoryview(payload)[:-4], struct.unpack("<I", payload[-4:])
    if zlib.crc32(body) != crc:
        raise ValueError("a block's checksum is wrong")
    magic, version, n_points, lanes, every, n, n_words = _HEAD.unpack(body[: _HEAD.size])
    if magic != b"TANS" or version != 1:
        raise ValueError("not a block of this format")
    mark = 12 + 8 * lanes
    at = _HEAD.size + n_points * mark
    state = np.frombuffer(body[at : at + 8 * lanes], "<u8").copy()
    words = np.frombuffer(body[at + 8 * lanes :], "<u4").astype(np.uint64)
    steps, first, place = -(-n // lanes), 0, 0
    if checkpoint is not None:
        where = _HEAD.size + checkpoint * mark
        first, place = struct.unpack("<IQ", body[where : where + 12])
        state = np.frombuffer(body[where + 12 : where + mark], "<u8").copy()
        steps = min(steps, first + every)
    out = np.empty(min(n, steps * lanes) - first * lanes, np.uint32)
    slots, bits, low, shift = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(LOW), np.uint64(32)
    for step in range(first, steps):
        x = state[: min(lanes, n - step * lanes)]
        slot = x & slots
        symbol = table.at[slot]
        out[(step - first) * lanes : (step - first) * lanes + len(x)] = symbol
        x = table.frequency[symbol] * (x >> bits) + slot - table.start[symbol]
        short = x < low
        k = int(np.count_nonzero(short))
        if k:
            x[short] = (x[short] << shift) | words[place : place + k]
            place += k
        state[: len(x)] = x
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str]]]:
    """Ids and texts of rows, some ``GROUP`` characters at once."""
    ids: list[int | None] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(doc_id)
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= GROUP:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _tokenise(path: str, end: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = library_encoder(path), TaskContext.get().partitionId()
        last = struct.pack("<I", end)
        docs: list[int | None] = []
        counts: list[int] = []
        parts: list[bytes] = []
        size = block = 0
        total = np.zeros(1, np.int64)

        def emit(docs, counts, planes, symbols) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "docs": pa.array([docs], pa.list_(pa.int64())), "counts": pa.array([counts], pa.list_(pa.int64())), "planes": pa.array([planes], pa.binary()), "symbols": pa.array([symbols], pa.list_(pa.int64()))})

        def row() -> pa.RecordBatch:
            nonlocal total
            ids = np.frombuffer(b"".join(parts), "<u4")
            found = np.bincount(ids)
            if len(found) > len(total):
                found, total = total, found
            total[: len(found)] += found
            if not len(ids) or ids.max() < 65536:
                ids = ids.astype("<u2")
            # high and low bytes apart, which the staged table's codec likes better
            planes = ids.view(np.uint8).reshape(-1, ids.itemsize).T.tobytes()
            return emit(docs, counts, planes, None)

        for doc_ids, texts in _groups(batches):
            gc.disable()  # no cycles are made, and there are many objects to look through
            try:
                encoded = encoder.encode_all(texts)
            finally:
                gc.enable()
            for doc_id, own in zip(doc_ids, encoded):
                docs.append(doc_id)
                counts.append(len(own) // 4 + 1)
                parts += (own, last)
                size += counts[-1]
                if size >= BLOCK:
                    yield row()
                    block += 1
                    docs, counts, parts, size = [], [], [], 0
        if docs:
            yield row()
        # the shard's counts, as pairs of symbol and number
        used = np.flatnonzero(total)
        block = -1
        yield emit(None, None, None, np.stack((used, total[used]), axis=1).ravel())

    return each


def _ids(planes: pa.Scalar, n: int) -> np.ndarray:
    raw = np.frombuffer(planes.as_buffer(), np.uint8)
    width = len(raw) // n if n else 2
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(f"<u{width}").ravel()


def _code(table: Table):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [encode_block(_ids(planes, sum(own)), table) for planes, own in zip(batch.column(4), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(payloads, pa.binary())], names=["shard", "block", "docs", "counts", "payload"])

    return each


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Encode every whole text, append ``end`` and write the store at ``path``."""
    spark = docs.sparkSession
    rows = only(docs, "doc_id", "text")
    ordered = rows.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    raw, raw_path = stage(ordered.mapInArrow(_tokenise(tokenizer, end), "shard int, block int, docs array<long>, counts array<long>, planes binary, symbols array<long>"), "token-blocks")
    del ordered
    release_shuffles(spark)
    # at most one row for each id of the vocabulary
    pairs = raw.filter("block = -1").select(F.explode(F.sequence(F.lit(1), (F.size("symbols") / 2).cast("int"))).alias("i"), "symbols").filter("i > 0 AND size(symbols) > 0")
    pairs.groupBy(F.element_at("symbols", 2 * F.col("i") - 1).alias("symbol")).agg(F.sum(F.element_at("symbols", 2 * F.col("i"))).alias("n")).write.parquet(f"{path}/table")
    raw.filter("block >= 0").drop("symbols").mapInArrow(_code(read_table(spark, path)), "shard int, block int, docs array<long>, counts array<long>, payload binary").write.option("compression", "none").parquet(f"{path}/blocks")
    remove(spark, raw_path)


def read_table(spark: SparkSession, path: str) -> Table:
    found = spark.read.schema("symbol long, n long").parquet(f"{path}/table").toArrow()
    return Table(found.column("symbol").to_numpy(), found.column("n").to_numpy())


def _each_document(table: Table):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, block, docs, counts, payload in zip(*(batch.column(i) for i in range(5))):
                ids, sizes = decode_block(payload.as_py(), table).astype("<u4", copy=False), np.array(counts.as_py(), np.int64)
                ends = np.cumsum(sizes)
                n = len(sizes)
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([shard.as_py()] * n, pa.int32()),
                        "block": pa.array([block.as_py()] * n, pa.int32()),
                        "doc_id": pa.array(docs.as_py(), pa.int64()),
                        "offset": pa.array(ends - sizes, pa.int64()),
                        "n_tokens": pa.array(sizes, pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip((ends - sizes).tolist(), ends.tolist())], pa.int64()),
                    }
                )

    return each


def _texts_of_ids(table: Table):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, counts, payload in zip(*(batch.column(i) for i in range(3))):
                ids = decode_block(payload.as_py(), table)
                offsets = np.concatenate(([0], np.cumsum(np.array(counts.as_py(), np.int64))))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int64()))
                yield pa.RecordBatch.from_arrays([docs.values, lists], names=["doc_id", "ids"])

    return each


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("shard int, block int, docs array<long>, counts array<long>, payload binary").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, ids) of the store at ``path``."""
    return _blocks(spark, path).select("docs", "counts", "payload").mapInArrow(_texts_of_ids(read_table(spark, path)), "doc_id long, ids array<long>")


def token_file_index(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) decoded from the store's blocks.

    Starts add up shards (one row each), the blocks of a shard and documents of a block.
    """
    sizes = _blocks(spark, path).select("shard", "block", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    blocks = sizes.withColumn("block_start", F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).join(shards, "shard")
    found = _blocks(spark, path).mapInArrow(_each_document(read_table(spark, path)), "shard int, block int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    starts = blocks.select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("before"))
    return found.join(starts, ["shard", "block"]).select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the store and read it back: rows (doc_id, start, n_tokens, ids_crc32)."""
    path = path or fresh_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer)
    return token_file_index(docs.sparkSession, path)
