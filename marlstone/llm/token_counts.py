"""Token counts: byte-pair merging with a heap over a linked list of symbols; only the count is made, no identifiers."""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

# The pre-tokenizer's pattern of byte-level vocabularies, with its white space written out.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: A run of white space and the characters up to the next one. No piece crosses its borders, so its count depends on nothing else.
CHUNKS = re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
#: The same, but Latin letters are cut off from ASCII punctuation after them: no piece has a letter before a mark, and fewer different chunks remain.
FINE_CHUNKS = re.compile(rf"[{SPACE}]*[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+(?=[!-/:-@\[-`{{-~{SPACE}]|\Z)|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall


def chunks_of(text: str, special: tuple[str, ...]) -> list[str]:
    """Parts of the text that are tokenised independently; special strings stay whole."""
    return (CHUNKS if any(s in text for s in special) else FINE_CHUNKS)(text)


class Remembered(dict):
    """Values made once for each key, as long as they are remembered: when `most` new ones have come, those not used since the last time go. Results don't depend on it."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class MergeCounter:
    """Counts of a byte-level byte-pair vocabulary in the tokenizers library's JSON form."""

    CHUNKS, PIECES = 200_000, 200_000  # remembered

    def __init__(self, vocabulary: str):
        import regex

        spec = json.loads(vocabulary)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("only byte-level byte-pair vocabularies without a normaliser or prefix space are known here")
        ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: (left, right) -> (rank, merged)
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = iter(range(256, 512))
        shown = {b: chr(b) for b in printable}
        self.symbols = [ids[shown.get(b) or chr(next(others))] for b in range(256)]
        self.specials = tuple(t["content"] for t in spec["added_tokens"])
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.split = regex.compile(PIECES).findall
        self.pieces, self.chunks = Remembered(lambda p: self.merged(p.encode()), self.PIECES), Remembered(self.of_chunk, self.CHUNKS)

    def merged(self, piece: bytes) -> int:
        """Symbols left after all merges of one piece."""
        n = len(piece)
        if n < 2:
            return n
        merges = self.merges
        symbol = [self.symbols[b] for b in piece]
        right, left = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0] << 40) | i for i in range(n - 1) if (m := merges.get((symbol[i], symbol[i + 1])))]
        heapq.heapify(heap)
        count = n
        while heap:
            entry = heapq.heappop(heap)
            i = entry & 0xFFFFFFFFFF
            j = right[i]
            if symbol[i] < 0 or j < 0 or not (m := merges.get((symbol[i], symbol[j]))) or m[0] != entry >> 40:
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = m[1], -1
            k = right[i] = right[j]
            count -= 1
            if k >= 0:
                left[k] = i
                if m := merges.get((symbol[i], symbol[k])):
                    heapq.heappush(heap, (m[0] << 40) | i)
            if (h := left[i]) >= 0 and (m := merges.get((symbol[h], symbol[i]))):
                heapq.heappush(heap, (m[0] << 40) | h)
        return count

    def of_chunk(self, chunk: str) -> int:
        if self.special and (parts := self.special.split(chunk))[1:]:
            return len(parts) - 1 + sum(self.pieces[p] for part in parts for p in self.split(part))
        return sum(map(self.pieces.__getitem__, self.split(chunk)))

    def count(self, text: str) -> int:
        return sum(map(self.chunks.__getitem__, chunks_of(text, self.specials)))


@functools.lru_cache(1)
def _counter(vocabulary: str) -> MergeCounter:
    """One for each Python worker, so that what it remembers serves its later tasks."""
    return MergeCounter(vocabulary)


def count_tokens(docs: DataFrame, vocabulary_path: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row; vocabulary_path is read by the driver and sent to the executors.

    Null and empty texts count 0. Special strings inside texts count as one token each, as the library's default. Repeated rows and null ids are kept; other columns are dropped.
    Nothing is shuffled; an executor holds a batch of texts and a bounded memory of counted chunks.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Path(vocabulary_path).read_text("utf-8"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary.value)
        for part, texts in slices(batches, text_col, 1 << 20):
            n = [counter.count(t.decode()) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    narrow = docs.select(id_col, F.col(text_col).cast("string").alias(text_col))
    return narrow.mapInArrow(counted, narrow.select(id_col).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
