"""Token-ID output: blocks of ids shuffled into planes, compressed by plane, with an index.

Format of a chunk (little-endian):

    magic "IDPL", u8 version 1, u8 planes P (4 byte planes or 32 bit planes), u16 0, u32 ids of a block, u64 ids, u32 blocks
    index: for each block P sizes, u32; 0 is a plane of zeros
    the planes, each compressed with zstandard, in the order of the index

A block's ids are taken as unsigned 32-bit integers; byte plane k holds byte k of each, bit plane k holds bit k of each,
eight ids a byte. The last block may be shorter. A shard is a run of chunks in ascending doc_id order, each of whole
documents. Chunks are rows of a Parquet table (shard, chunk, first, n_ids, doc_ids, sizes, payload), for Spark's writers
are what reaches every store and commits only whole tasks; (shard, chunk, first, n_ids) is the index of the chunks.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.llm.common import lists, pieces, ragged, shared_folder, table, text_bytes, tidy

END_ID, BLOCK_IDS, CHUNK_IDS, LEVEL = 2, 1 << 15, 1 << 18, 3
HEAD = struct.Struct("<4sBBHIQI")
#: Segments whose ids a worker remembers between pieces (those used most), segments encoded in one call, text of a piece.
REMEMBERED, GROUP, ENCODED_BYTES = 1_000_000, 2000, 8 << 20
#: Shards up to which the table of their first ids (16 bytes each) is broadcast.
BROADCAST_SHARDS = 100_000


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if planes == 4:
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes | None], n: int) -> np.ndarray:
    if len(planes) == 4:
        raw = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            if p is not None:
                raw[:, k] = np.frombuffer(p, np.uint8)
        return raw.reshape(-1).view("<u4")
    bits = np.zeros((n, 32), np.uint8)
    for k, p in enumerate(planes):
        if p is not None:
            bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


def pack(ids: np.ndarray, planes: int = 4, block: int = BLOCK_IDS, level: int = LEVEL) -> bytes:
    import zstandard

    press = zstandard.ZstdCompressor(level=level)
    sizes, data = [], []
    for at in range(0, len(ids), block):
        for plane in to_planes(ids[at : at + block], planes):
            own = press.compress(plane) if plane.strip(b"\0") else b""
            sizes.append(len(own))
            data.append(own)
    head = HEAD.pack(b"IDPL", 1, planes, 0, block, len(ids), len(sizes) // planes)
    return b"".join([head, np.array(sizes, "<u4").tobytes(), *data])


def unpack(payload: bytes) -> np.ndarray:
    import zstandard

    magic, version, planes, _, block, n, blocks = HEAD.unpack_from(payload)
    if magic != b"IDPL" or version != 1:
        raise ValueError("not a chunk of token ids")
    sizes = np.frombuffer(payload, "<u4", blocks * planes, HEAD.size)
    at, out, open_ = HEAD.size + sizes.nbytes, [], zstandard.ZstdDecompressor()
    for b in range(blocks):
        own = []
        for size in sizes[b * planes : (b + 1) * planes].tolist():
            own.append(open_.decompress(payload[at : at + size]) if size else None)
            at += size
        out.append(from_planes(own, min(block, n - b * block)))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Encodes texts by their distinct segments.

    A segment begins at each space that follows a visible ASCII character or a letter U+00C0 to U+00FF. The tokenizer's
    splitting rule never joins such a character with the space after it and looks back at nothing, so the ids of a text
    are those of its segments, one after another.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        tokens = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(tokens.values()) + 1, np.int64)
        for token, i in tokens.items():
            self.bytes_of[i] = len(token)  # byte-level: a character of a token is a byte
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.used, self.sizes, self.starts, self.flat = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _keep(self, most: int) -> None:
        """Forget all but the `most` segments that were in most pieces."""
        if len(self.used) > most:
            at = np.sort(np.argpartition(-self.used, most)[:most])
            self.known, self.used, sizes = self.known.take(pa.array(at)), self.used[at], self.sizes[at]
            self.flat = self.flat[ragged(self.starts[at], sizes)]
            self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes

    def _learn(self, new: pa.Array) -> None:
        """Encode segments: many at once where each begins with a space, so that the tokenizer splits there."""
        data, offsets = text_bytes(new)
        first, last = data[offsets[:-1]], data[offsets[1:] - 1]
        letter = (last >= 0x80) & (data[np.maximum(0, offsets[1:] - 2)] == 0xC3)
        begin = np.zeros(len(new), bool)
        begin[::GROUP] = True
        begin[1:] |= (first[1:] != 0x20) | ~((last > 0x20) & (last < 0x7F) | letter)[:-1]
        bounds = offsets[np.append(np.flatnonzero(begin), len(new))].tolist()
        text = data.tobytes()
        encoded = self.tokenizer.encode_batch_fast([text[a:b].decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in encoded])
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), offsets[1:]) + 1
        starts = np.concatenate([[0], ends[:-1]])
        self.known = pa.concat_arrays([self.known, new])
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int32)])
        self.starts = np.concatenate([self.starts, starts + len(self.flat)])
        self.sizes = np.concatenate([self.sizes, ends - starts])
        self.flat = np.concatenate([self.flat, ids])

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        return _ENCODERS[path]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and the number of ids of each text."""
        data, offsets = text_bytes(texts)
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        cut = np.zeros(len(data), bool)
        visible = (data > 0x20) & (data < 0x7F)
        letter = np.zeros(len(data), bool)
        letter[1:] = (data[1:] >= 0x80) & (data[:-1] == 0xC3)
        cut[1:] = (data[1:] == 0x20) & (visible | letter)[:-1]
        firsts = offsets[:-1][np.diff(offsets) > 0]
        cut[firsts] = True
        at = np.append(np.flatnonzero(cut), len(data))
        coded = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        names, codes = coded.dictionary, np.asarray(coded.indices)
        if len(self.known) > REMEMBERED:
            self._keep(REMEMBERED // 2)
        place = pc.index_in(names, value_set=self.known)
        if place.null_count:
            new = names.filter(pc.is_null(place))
            place = np.array(pc.fill_null(place, -1), np.int64)
            place[place < 0] = np.arange(len(self.known), len(self.known) + len(new))
            self._learn(new)
        place = np.asarray(place, np.int64)
        self.used[place] += 1
        which = place[codes]
        sizes = self.sizes[which]
        ids = self.flat[ragged(self.starts[which], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(ends[np.searchsorted(at, offsets)])


def _with_ends(ids: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    out = np.full(len(ids) + len(sizes), end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
    return out


def _chunks(path: str, end: int, planes: int, block: int, chunk_ids: int):
    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, chunk, first = Encoder.of(path), TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        n = 0

        def row() -> pa.RecordBatch:
            ids = np.concatenate([h[2] for h in held])
            doc_ids = pa.concat_arrays([h[0] for h in held])
            sizes = np.concatenate([h[1] for h in held])
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([chunk], pa.int32()), pa.array([first]), pa.array([n]), pa.ListArray.from_arrays([0, len(doc_ids)], doc_ids), lists(sizes, [len(sizes)]), pa.array([pack(ids, planes, block)], pa.binary())],
                names=["shard", "chunk", "first", "n_ids", "doc_ids", "sizes", "payload"],
            )

        for batch in pieces(batches, limit=ENCODED_BYTES):
            ids, sizes = encoder.encode(batch["text"])
            ids, sizes = _with_ends(ids, sizes, end), sizes + 1
            ends, at = np.cumsum(sizes), 0
            while at < len(sizes):
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + chunk_ids - n, side="right")))
                held.append((batch["doc_id"].slice(at, to - at), sizes[at:to], ids[before : int(ends[to - 1])]))
                n += int(ends[to - 1]) - before
                at = to
                if n >= chunk_ids or at < len(sizes):
                    yield row()
                    chunk, first, n, held = chunk + 1, first + n, 0, []
        if held:
            yield row()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end: int = END_ID, planes: int = 4, block: int = BLOCK_IDS, chunk_ids: int = CHUNK_IDS, shards: int | None = None) -> None:
    """Encode docs (doc_id, text) and write their ids, in ascending doc_id order, to path.

    A null text is empty (its end id alone); a null doc_id comes last; of rows with one doc_id the smaller text comes
    first. tokenizer: the file of the tokenizer, there on each executor.
    """
    spark = docs.sparkSession
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shards, order[0]).sortWithinPartitions(*order)
    schema = "shard int, chunk int, first long, n_ids long, doc_ids array<long>, sizes array<long>, payload binary"
    cut.mapInArrow(_chunks(tokenizer, end, planes, block, chunk_ids), schema).write.mode("overwrite").option("compression", "none").parquet(path)


def read_chunks(spark, path: str) -> DataFrame:
    """The chunks with `start`: the number of ids before each in all shards."""
    chunks = spark.read.parquet(path)
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = totals.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    few = totals.count() <= BROADCAST_SHARDS
    return chunks.join(F.broadcast(base) if few else base, "shard").withColumn("start", F.col("base") + F.col("first"))


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, doc_ids, sizes, payload in zip(*(batch[c].to_pylist() for c in ("start", "doc_ids", "sizes", "payload")), strict=True):
            ids, ends = unpack(payload), np.cumsum(sizes)
            starts = ends - sizes
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts + start), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_ids, sizes, payload in zip(*(batch[c].to_pylist() for c in ("doc_ids", "sizes", "payload")), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), lists(unpack(payload).astype(np.int64), sizes)], names=["doc_id", "ids"])


def read_ids(spark, path: str) -> DataFrame:
    """(doc_id, ids) of all documents in the files."""
    return spark.read.parquet(path).select("doc_ids", "sizes", "payload").mapInArrow(_ids, "doc_id long, ids array<long>")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Writes the ids of docs and returns, read from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/token_ids_{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer or default_tokenizer())
    chunks = read_chunks(spark, path).select("start", "doc_ids", "sizes", "payload")
    return chunks.mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_ids(spark, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
