"""Token-ID output: patched frame-of-reference blocks of token ids, written in document order and read back."""

from __future__ import annotations

import functools
import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import equal_runs, hashed_runs, long_id, padded, shared_folder, slices, table, text_of, written

MAGIC, SEGMENT, BLOCK, HEAD, PERCENTILE = b"PFR1", b"PFS1", 256, 7, 90


def encode_ids(ids: np.ndarray) -> bytes:
    """ids (below 2**32) as: magic, count (u64), block starts (u64, one more than blocks), blocks.

    A block of 256 values is: minimum (u32), width (u8), exceptions (u16), the values less the minimum packed in width bits, the exceptions' places (u16 each) and full values (u32 each).
    The width holds the 90th percentile of the block; wider values are exceptions, packed as zero. A last short block is filled with its minimum.
    """
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    values = np.zeros(blocks * BLOCK, np.uint32)
    values[:n] = ids
    values = values.reshape(blocks, BLOCK)
    if n % BLOCK:
        values[-1, n % BLOCK :] = values[-1, : n % BLOCK].min()
    low = values.min(1, keepdims=True, initial=2**32 - 1)
    rest = values - low
    kth = BLOCK * PERCENTILE // 100
    width = np.ceil(np.log2(np.partition(rest, kth, axis=1)[:, kth].astype(np.float64) + 1)).astype(np.int64) if blocks else np.zeros(0, np.int64)
    wide = rest.astype(np.uint64) >> width[:, None].astype(np.uint64) != 0
    extra = wide.sum(1)
    rest[wide] = 0
    packed = BLOCK * width // 8
    starts = np.concatenate([[0], np.cumsum(HEAD + packed + 6 * extra)])
    body = np.zeros(starts[-1], np.uint8)
    at = starts[:-1, None]
    body[at + np.arange(4)] = low.astype("<u4").view(np.uint8)
    body[starts[:-1] + 4] = width
    body[at + np.arange(5, 7)] = extra.astype("<u2").reshape(-1, 1).view(np.uint8)
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        bits = np.unpackbits(rest[own].astype(">u4").view(np.uint8).reshape(len(own), BLOCK, 4), axis=2)[:, :, 32 - w :]
        body[at[own] + HEAD + np.arange(BLOCK * w // 8)] = np.packbits(bits.reshape(len(own), -1), axis=1)
    block, place = np.nonzero(wide)
    nth = np.arange(len(block)) - (np.cumsum(extra) - extra)[block]
    tail = starts[block] + HEAD + packed[block]
    body[(tail + 2 * nth)[:, None] + np.arange(2)] = place.astype("<u2").reshape(-1, 1).view(np.uint8)
    body[(tail + 2 * extra[block] + 4 * nth)[:, None] + np.arange(4)] = values[wide].astype("<u4").reshape(-1, 1).view(np.uint8)
    return b"".join([MAGIC, np.uint64(n).tobytes(), starts.astype("<u8").tobytes(), body.tobytes()])


def decode_ids(data: bytes, first_block: int = 0, n_blocks: int | None = None) -> np.ndarray:
    """The ids (u32) of all blocks, or of n_blocks from first_block on, which the index finds without reading others."""
    if data[:4] != MAGIC:
        raise ValueError("not a file of token-id blocks")
    n = int(np.frombuffer(data, "<u8", 1, 4)[0])
    blocks = -(-n // BLOCK)
    starts = np.frombuffer(data, "<u8", blocks + 1, 12).astype(np.int64)
    body = np.frombuffer(data, np.uint8, offset=12 + 8 * (blocks + 1))
    stop = blocks if n_blocks is None else min(blocks, first_block + n_blocks)
    starts, count = starts[first_block:stop], stop - first_block
    at = starts[:, None]
    low = body[at + np.arange(4)].reshape(-1).view("<u4")
    width, extra = body[starts + 4].astype(np.int64), body[at + np.arange(5, 7)].reshape(-1).view("<u2").astype(np.int64)
    values = np.zeros((count, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        bits = np.zeros((len(own), BLOCK, 32), np.uint8)
        bits[:, :, 32 - w :] = np.unpackbits(body[at[own] + HEAD + np.arange(BLOCK * w // 8)], axis=1).reshape(len(own), BLOCK, w)
        values[own] = np.packbits(bits, axis=2).reshape(len(own), -1).view(">u4")
    values += low[:, None]
    block = np.repeat(np.arange(count), extra)
    nth = np.arange(len(block)) - (np.cumsum(extra) - extra)[block]
    tail = starts[block] + HEAD + BLOCK * width[block] // 8
    place = body[(tail + 2 * nth)[:, None] + np.arange(2)].reshape(-1).view("<u2")
    values[block, place] = body[(tail + 2 * extra[block] + 4 * nth)[:, None] + np.arange(4)].reshape(-1).view("<u4")
    return values.reshape(-1)[: max(0, n - first_block * BLOCK)]


class ChunkHasher:
    """Cuts UTF-8 texts where the tokenizer's pieces always part, and hashes each chunk to 64 bits.

    Cuts lie before a space or line feed that a visible character follows, and between a Latin letter and an ASCII mark. Where the next character may be rarer white space there is none, which makes a longer chunk only.
    """

    def __init__(self):
        byte = np.arange(256)
        self.visible = (byte > 32) & (byte != 127) & ~np.isin(byte, [0xC2, 0xE1, 0xE2, 0xE3])
        self.letter = ((byte >= 65) & (byte <= 90)) | ((byte >= 97) & (byte <= 122))
        self.mark = ((byte > 32) & (byte < 127)) & ~self.letter & ~((byte >= 48) & (byte <= 57))
        self.latin = (byte >= 0x80) & (byte <= 0xBF) & (byte != 0x97) & (byte != 0xB7)  # after 0xC3

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(all bytes, padded; starts and lengths of the chunks, their hashes, and for each text the index of its first, with the end)."""
        whole = padded(b"\0".join([b"", *texts, b""]))
        buffer = whole[:-8]
        cut = np.zeros(len(buffer), bool)
        cut[1:-1] = ((buffer[1:-1] == 32) | (buffer[1:-1] == 10)) & self.visible[buffer[2:]]
        cut[2:] |= self.mark[buffer[2:]] & (self.letter[buffer[1:-1]] | ((buffer[:-2] == 0xC3) & self.latin[buffer[1:-1]]))
        lengths = np.array([len(t) for t in texts], np.int64)
        begins = 1 + np.cumsum(lengths + 1) - lengths - 1
        cut[begins[lengths > 0]] = True
        starts = np.flatnonzero(cut)
        first = np.searchsorted(starts, np.append(begins, len(buffer)))
        ends = np.append(starts[1:], 0)
        last = first[1:][lengths > 0] - 1
        ends[last] = (begins + lengths)[lengths > 0]
        return whole, starts, ends - starts, hashed_runs(whole, starts, ends), first


class _Store:
    """A growing array."""

    def __init__(self, dtype: type):
        self.data, self.used = np.zeros(1 << 20, dtype), 0

    def add(self, values: np.ndarray) -> int:
        """The place of the values, once stored; eight zeros follow the last."""
        while self.used + len(values) + 8 > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        place = self.used
        self.data[place : place + len(values)] = values
        self.used += len(values)
        return place


class ChunkEncoder:
    """Ids of whole texts by the tokenizers library, which is asked once for each chunk that isn't remembered.

    New chunks that begin with a space or line feed before a visible character are asked many in one text, as the library's pieces part there whatever comes before; its answer is dealt back by the tokens' lengths in bytes. Where these don't end with each chunk, and for other chunks, each is asked alone.
    Chunks are looked up by their 64-bit hashes and then compared byte by byte; a text with a chunk that only shares another one's hash is encoded whole, as are texts with special strings. So the ids are always the library's.
    """

    CHUNKS, RECENT = 1_000_000, 100_000  # remembered, and of these kept apart until they are merged into the sorted rest
    ASKED, JOINED = 10_000, 100  # of the library at once, as its answers take much memory, and of these in one text

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(vocabulary)
        self.encode = functools.partial(tokenizer.encode_batch_fast, add_special_tokens=False)
        self.specials = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
        named = tokenizer.get_vocab()
        self.sizes = np.zeros(1 + max(named.values(), default=0), np.int64)  # bytes of each token: a byte-level vocabulary spells each as one character
        self.sizes[list(named.values())] = [len(token) for token in named]
        self.hasher = ChunkHasher()
        self.visible = self.hasher.visible.tolist()
        self.forget()

    def forget(self) -> None:
        self.known = self.recent = (np.zeros(0, np.uint64), *[np.zeros(0, np.int32)] * 4)  # ascending hashes; place and number of their ids, place and number of their bytes
        self.ids, self.bytes = _Store(np.uint32), _Store(np.uint8)

    def _find(self, where: tuple, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(where[0], hashes), max(0, len(where[0]) - 1))
        return np.where(where[0][at] == hashes, at, -1) if len(where[0]) else np.full(len(hashes), -1)

    def _asked(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(array("I", e.ids), np.uint32) for e in self.encode([t.decode() for t in texts])]

    def _separate(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks one after the other, and how many each has."""
        found = self._asked(chunks)
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(f) for f in found], np.int64)

    def _together(self, chunks: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As _separate, of chunks whose pieces part from those before."""
        texts = [b"".join(chunks[at : at + self.JOINED]) for at in range(0, len(chunks), self.JOINED)]
        ids = np.concatenate([np.zeros(0, np.uint32), *self._asked(texts)])
        ends, stops = np.cumsum(self.sizes[ids]), np.cumsum(sizes)
        last = np.searchsorted(ends, stops)
        if any(s in t for t in texts for s in self.specials) or not len(ids) or ends[-1] != stops[-1] or (ends[last] != stops).any():
            return self._separate(chunks)
        return ids, np.diff(last, prepend=-1)

    def _learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        sizes = np.array([len(c) for c in chunks], np.int64)
        joins = np.array([len(c) > 1 and c[0] in b" \n" and self.visible[c[1]] for c in chunks], bool)
        order = np.argsort(~joins, kind="stable")
        hashes, sizes, chunks, joined = hashes[order], sizes[order], [chunks[i] for i in order.tolist()], int(joins.sum())
        found = [self._together(chunks[at : (stop := min(at + self.ASKED, joined))], sizes[at:stop]) for at in range(0, joined, self.ASKED)]
        found += [self._separate(chunks[at : at + self.ASKED]) for at in range(joined, len(chunks), self.ASKED)]
        ids, counts = (np.concatenate(x) for x in zip(*found, strict=True))
        place = self.ids.add(ids)
        bytes_place = self.bytes.add(np.frombuffer(b"".join(chunks), np.uint8))
        new = (place + np.cumsum(counts) - counts, counts, bytes_place + np.cumsum(sizes) - sizes, sizes)
        self.recent = self._merged(self.recent, (hashes, *(x.astype(np.int32) for x in new)))
        if len(self.recent[0]) > self.RECENT:
            self.known, self.recent = self._merged(self.known, self.recent), tuple(x[:0] for x in self.recent)

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        order = np.argsort(hashes := np.concatenate([a[0], b[0]]))
        return hashes[order], *(np.concatenate(x)[order] for x in zip(a[1:], b[1:], strict=True))

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each text its ids."""
        if len(self.known[0]) > self.CHUNKS or max(self.ids.used, self.bytes.used) > 1 << 28:
            self.forget()
        alone = np.array([any(s in t for s in self.specials) for t in texts], bool)
        buffer, starts, lengths, hashes, first = self.hasher([b"" if s else t for t, s in zip(texts, alone.tolist(), strict=True)])
        order = np.argsort(hashes)
        ordered = hashes[order]
        new = np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]])
        distinct, example = ordered[new], order[new]
        missing = np.flatnonzero((self._find(self.known, distinct) < 0) & (self._find(self.recent, distinct) < 0))
        if len(missing):
            some, data = example[missing], buffer.tobytes()
            self._learn(distinct[missing], [data[a : a + n] for a, n in zip(starts[some].tolist(), lengths[some].tolist(), strict=True)])
        found = np.zeros((4, len(distinct)), np.int64)
        for where in (self.known, self.recent):
            at = self._find(where, distinct)
            for row, values in zip(found, where[1:], strict=True):
                row[at >= 0] = values[at[at >= 0]]
        place, count, bytes_place, size = found
        which = np.empty(len(hashes), np.int64)
        which[order] = np.cumsum(new) - 1
        # one comparison with what is remembered for each different hash, and one with that chunk for each occurrence
        right = (size == lengths[example]) & equal_runs(buffer, starts[example], self.bytes.data, bytes_place, np.minimum(size, lengths[example]))
        model = example[which]
        right = right[which] & (lengths == lengths[model]) & equal_runs(buffer, starts, buffer, starts[model], np.minimum(lengths, lengths[model]))
        alone |= np.add.reduceat(np.append(~right, False), first[:-1]).astype(bool) & (np.diff(first) > 0) if len(texts) else False
        counts = count[which]
        stops = np.cumsum(counts)
        ids = self.ids.data[np.repeat(place[which] - stops + counts, counts) + np.arange(stops[-1] if len(stops) else 0)]
        bounds = np.concatenate([[0], stops])[first]
        return [np.array(self.encode([t.decode()])[0].ids, np.uint32) if s else ids[a:b] for t, s, (a, b) in zip(texts, alone.tolist(), pairwise(bounds.tolist()), strict=True)]


@functools.lru_cache(1)
def _encoder(vocabulary: str) -> ChunkEncoder:
    """One for each Python worker, so that what it remembers serves its later tasks."""
    return ChunkEncoder(vocabulary)


@dataclass
class Segment:
    """The bytes of one file of whole documents: magic, number of documents (u64), the ends of their ids (u64 each), which ids are null (a byte each), their ids (i64 each), and encode_ids of all token ids."""

    data: bytes

    @classmethod
    def of(cls, names: list[int | None], ids: list[np.ndarray]) -> Segment:
        ends = np.cumsum([len(x) for x in ids])
        parts = [SEGMENT, np.uint64(len(names)).tobytes(), ends.astype("<u8").tobytes(), np.array([n is None for n in names], np.uint8).tobytes(), np.array([n or 0 for n in names], "<i8").tobytes()]
        return cls(b"".join([*parts, encode_ids(np.concatenate(ids))]))

    def documents(self, window: int = 64) -> Iterator[tuple[int | None, int, int, int]]:
        """(id, place of its first token id, number of token ids, their CRC-32) of each document. Token ids are unpacked some blocks at a time, which the block index finds, so a long document takes no more memory."""
        if self.data[:4] != SEGMENT:
            raise ValueError("not a segment of token ids")
        n = int(np.frombuffer(self.data, "<u8", 1, 4)[0])
        ends = np.frombuffer(self.data, "<u8", n, 12).astype(np.int64)
        null, names = np.frombuffer(self.data, np.uint8, n, 12 + 8 * n), np.frombuffer(self.data, "<i8", n, 12 + 9 * n)
        blocks = memoryview(self.data)[12 + 17 * n :]
        held, at, upto = None, 0, 0
        for i, (start, end) in enumerate(pairwise([0, *ends.tolist()])):
            crc, place = 0, start
            while place < end:
                if place >= upto:
                    at = place // BLOCK
                    held = decode_ids(blocks, at, window).astype("<u4", copy=False)
                    at, upto = at * BLOCK, at * BLOCK + len(held)
                    if not len(held):
                        raise ValueError(f"{end} ids are named, {place} written")
                stop = min(end, upto)
                crc, place = zlib.crc32(held[place - at : stop - at], crc), stop
            yield None if null[i] else int(names[i]), start, end - start, crc


def write_ids(docs: DataFrame, vocabulary_path: str, path: str, *, end_id: int = 0, segment_tokens: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all texts in ascending id order, an end id after each, and returns the written table.

    A row is one file of whole documents (Segment) with its place: shard, segment, start (token ids before it in its shard), n_ids, payload. Shards follow each other in id order, segments in a shard too.
    Null ids come first, rows of one id in the order of their texts' hashes, then their texts, so rows of one id are split over tasks as others are; a null text is empty, so it has only the end id. Ids must be integers or null.
    The texts are shuffled once, by ranges; a task holds one segment, of one document where that is longer. Files are committed by Spark's writer, so a lost executor's part is written again and never twice.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Path(vocabulary_path).read_text("utf-8"))
    end = np.array([end_id], np.uint32)
    schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, number, start = _encoder(vocabulary.value), TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        held = 0

        def flushed():
            nonlocal number, start, held
            row = {"shard": shard, "segment": number, "start": start, "n_ids": held, "payload": Segment.of(names, ids).data}
            number, start, held = number + 1, start + held, 0
            ids.clear()
            names.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        for part, texts in slices(batches, "__text", 1 << 20):
            for name, found in zip(part.column("__id").to_pylist(), encoder(texts), strict=True):
                ids.append(np.concatenate([found, end]))
                names.append(name)
                held += len(found) + 1
                if held >= segment_tokens:
                    yield flushed()
        if names:
            yield flushed()

    keyed = docs.select(long_id(docs, id_col).alias("__id"), text_of(text_col).alias("__text"), F.xxhash64(text_of(text_col)).alias("__hash"), F.monotonically_increasing_id().alias("__row"))
    # __row only tells equal rows apart for the ranges; any order of them gives the same files
    ordered = keyed.repartitionByRange("__id", "__hash", "__row").select("__id", "__text", "__hash").sortWithinPartitions("__id", "__hash", "__text")
    return written(ordered.select("__id", "__text").mapInArrow(segments, "shard int, segment int, start long, n_ids long, payload binary"), path)


def read_ids(segments: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, from the payloads of a table of write_ids.

    Only one row for each shard is gathered, to turn places in a shard into places in all files; the payloads aren't shuffled. An empty table has no documents.
    """
    sizes = segments.groupBy("shard").agg(F.sum("n_ids").alias("size"))
    bases = sizes.select("shard", (F.sum("size").over(Window.orderBy("shard")) - F.col("size")).alias("base"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                before = batch.column("base")[row].as_py() + batch.column("start")[row].as_py()
                found = [(name, before + start, n, crc) for name, start, n, crc in Segment(batch.column("payload")[row].as_py()).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=[id_col, "start", "n_tokens", "ids_crc32"])

    joined = segments.join(F.broadcast(bases), "shard")  # one row for each partition of the writing stage
    return joined.mapInArrow(documents, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, vocabulary_path: str, path: str | None = None, **more) -> DataFrame:
    """write_ids to path (a new shared folder, if none) and read_ids from there; nulls, empty and long texts, repeated rows and empty tables as there, other columns are dropped."""
    return read_ids(write_ids(docs, vocabulary_path, path or shared_folder(docs.sparkSession), **more))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
