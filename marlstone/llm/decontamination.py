"""Benchmark decontamination: an FM-index over each shard of training texts, searched backward for the benchmark's phrases."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

#: A-Z lower-cased; all ASCII but letters and digits separates words; other bytes are parts of words.
_AS_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_AS_WORDS).split()


class WaveletMatrix:
    """Ranks of symbols in a sequence, by one packed bit vector for each bit of a symbol."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels, current = [], values
        for level in reversed(range(bits)):
            ones = (current >> level & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(len(ones) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            counts = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=counts[1:])
            self.levels.append((level, words, counts, len(ones) - int(counts[-1])))
            current = np.concatenate([current[~ones], current[ones]])
        self.first = np.searchsorted(_ordered(current, bits), np.arange(1 << bits)) if bits else np.zeros(1, np.int64)
        self.place = _bit_reversed(bits)

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its end."""
        at = end
        for level, words, counts, zeros in self.levels:
            block = at >> 6
            ones = counts[block] + np.bitwise_count(words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> level & 1 == 1, zeros + ones, at - ones)
        return at - self.first[self.place[symbol]]


def _bit_reversed(bits: int) -> np.ndarray:
    """Where the matrix's last level puts each symbol: its lowest bit was sorted by last, so it counts most."""
    symbols = np.arange(1 << bits)
    out = np.zeros_like(symbols)
    for i in range(bits):
        out |= (symbols >> i & 1) << (bits - 1 - i)
    return out


def _ordered(last: np.ndarray, bits: int) -> np.ndarray:
    return _bit_reversed(bits)[last]


class FMIndex:
    """Index of a sequence of symbols from 0 to size - 1, in which 0 is a gap that no pattern holds; it begins and ends with one.

    Gaps count as different from each other, in the order of their places, so suffixes are compared to the next gap only.
    """

    SAMPLED = 32

    def __init__(self, sequence: np.ndarray, size: int):
        suffixes = _suffix_array(sequence)
        self.last = np.where(suffixes > 0, sequence[suffixes - 1], 0)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=size))])
        self.ranks = WaveletMatrix(self.last, int(size - 1).bit_length())
        self.sampled = (self.last == 0) | (suffixes % self.SAMPLED == 0)
        self.samples, self.sample = suffixes[self.sampled], np.cumsum(self.sampled) - 1

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of equally long patterns (rows): those that occur, with the first and the end row of their suffixes."""
        alive = np.arange(len(patterns))
        first, end = self.before[patterns[:, -1]], self.before[patterns[:, -1] + 1]
        for column in range(patterns.shape[1] - 2, -2, -1):
            found = first < end
            alive, first, end = alive[found], first[found], end[found]
            if column >= 0 and len(alive):
                symbol = patterns[alive, column]
                first, end = self.before[symbol] + self.ranks.rank(symbol, first), self.before[symbol] + self.ranks.rank(symbol, end)
        return alive, first, end

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of the suffixes in these rows: each walks to the next sampled one before it."""
        places, going, rows, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(going):
            there = self.sampled[rows]
            places[going[there]] = self.samples[self.sample[rows[there]]] + steps
            going, rows = going[~there], rows[~there]
            symbol = self.last[rows]
            rows, steps = self.before[symbol] + self.ranks.rank(symbol, rows), steps + 1
        return places


def _suffix_array(sequence: np.ndarray) -> np.ndarray:
    """By doubling; only suffixes that aren't told apart yet are sorted again. A rank is the place of the first suffix of its group."""
    n, gaps = len(sequence), sequence == 0
    keys = np.where(gaps, np.cumsum(gaps) - 1, sequence + gaps.sum())
    rank, active, group = np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int64)
    length = 0
    while len(active):
        order = np.argsort(keys)
        active, keys, group = active[order], keys[order], group[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        old = np.concatenate([[True], group[1:] != group[:-1]])
        at = np.arange(len(keys))
        begins, outer = np.maximum.accumulate(np.where(new, at, 0)), np.maximum.accumulate(np.where(old, at, 0))
        group = group + begins - outer
        rank[active] = group
        alone = new & np.concatenate([new[1:], [True]])
        active, group = active[~alone], group[~alone]
        length = 2 * length or 1
        keys = group * n + rank[active + length] if len(active) else keys
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes


class Phrases:
    """The windows of benchmark items: distinct word sequences, by length, each with the items that hold it."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.ids: dict[bytes, int] = {}
        holders: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for name, text in items:
            own = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            for i in range(max(1, len(own) - window + 1) if own else 0):
                holders[tuple(own[i : i + window])].add(name)
        by_length: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for phrase in holders:
            by_length[len(phrase)].append(phrase)
        self.groups = [(np.array(group, np.int64), [sorted(holders[p]) for p in group]) for _, group in sorted(by_length.items())]

    def hits(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text its number of words, the merged spans of words that lie in an occurrence of a phrase, and the items found, by an index over all texts together."""
        split = [words_of(t) for t in texts]
        counts = np.array([len(s) for s in split])
        begins = np.cumsum([1, *(counts + 1)])  # a gap before each text and after the last
        symbols = np.zeros(begins[-1], np.int64)
        for words, at in zip(split, begins, strict=False):
            symbols[at : at + len(words)] = np.fromiter(map(self.ids.get, words, repeat(0)), np.int64, len(words))
        kept = np.flatnonzero((symbols != 0) | (np.concatenate([[1], symbols[:-1]]) != 0))  # a run of words that no phrase has is one gap
        covered, items = np.zeros(len(symbols) + 1, np.int64), [set() for _ in texts]
        if self.groups and symbols.any():
            index = FMIndex(symbols[kept], len(self.ids) + 1)
            for patterns, names in self.groups:
                alive, first, end = index.search(patterns)
                number = end - first
                rows = np.repeat(first - (np.cumsum(number) - number), number) + np.arange(number.sum())
                places = kept[index.locate(rows)]
                np.add.at(covered, places, 1)
                np.add.at(covered, places + patterns.shape[1], -1)
                pairs = np.unique(np.stack([np.searchsorted(begins, places, "right") - 1, np.repeat(alive, number)]), axis=1)
                for text, phrase in pairs.T.tolist():
                    items[text].update(names[phrase])
        edges = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(covered) > 0, [False]]).astype(np.int8)))
        spans = [[] for _ in texts]
        for text, first, end in zip((np.searchsorted(begins, edges[::2], "right") - 1).tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            spans[text].append((first - int(begins[text]), end - int(begins[text])))
        return [(int(n), s, i) for n, s, i in zip(counts, spans, items, strict=True)]


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def contaminated(n_words: int, n_hit: int, percent: int) -> bool:
    return n_hit > 0 and 100 * n_hit >= percent * n_words


def phrase_blocks(benchmark: DataFrame, window: int, block_bytes: int, *, item_col: str, text_col: str) -> list:
    """Broadcast Phrases of parts of the benchmark, each of about block_bytes of text, whatever the size of the whole: one part for a benchmark below that."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = -(-total // block_bytes) or 1
    block = F.pmod(F.xxhash64("text"), F.lit(parts))
    return [spark.sparkContext.broadcast(Phrases([(r.item, r.text.encode()) for r in items.where(block == i).collect()], window)) for i in range(parts)]


SPANS = "n_words long, spans array<struct<first:long,end:long>>, items array<string>"
_SPANS = [("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))]


def _searched(phrases, text_col: str, shard_bytes: int, more: bool) -> Callable:
    """Adds the spans and items of one block to those of the blocks before; the text goes on only if more blocks follow."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text_col, shard_bytes):
            rows = phrases.value.hits(texts)
            if "spans" in part.schema.names:
                old = zip(part.column("spans").to_pylist(), part.column("items").to_pylist(), strict=True)
                rows = [(n, merged_spans([*spans, *((x["first"], x["end"]) for x in s)]), items | {*i}) for (n, spans, items), (s, i) in zip(rows, old, strict=True)]
            kept = [c for c in part.schema.names if c not in ("n_words", "spans", "items") and (more or c != text_col)]
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([[{"first": a, "end": b} for a, b in r[1]] for r in rows], _SPANS[1][1]), pa.array([sorted(r[2]) for r in rows], _SPANS[2][1])]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *columns], names=[*kept, "n_words", "spans", "items"])

    return search


def find_spans(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, block_bytes: int = 2 << 20, shard_bytes: int = 2 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, spans, items) of each document: merged spans of words to remove, counted from 0, and the items found in it, sorted as strings.

    Null and empty texts have no words and no spans; items without words are in no text; equal item ids count once, a null one as "null". Repeated rows and null ids are kept; other columns are dropped.
    Nothing is shuffled: each task indexes its texts in shards of about shard_bytes (a longer text is a shard of its own) and searches one broadcast block of the benchmark after the other.
    """
    blocks = phrase_blocks(benchmark, window, block_bytes, item_col=item_col, text_col=item_text_col)
    out = docs.select(id_col, F.col(text_col).cast("string").alias("__text"))
    named = out.select(id_col).schema[0].simpleString().split(":", 1)
    ids = f"`{id_col}` {named[1]}"
    for i, block in enumerate(blocks):
        more = i + 1 < len(blocks)
        out = out.mapInArrow(_searched(block, "__text", shard_bytes, more), f"{ids}, {'__text string, ' * more}{SPANS}")
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, percent: int = 5, window: int = 13, block_bytes: int = 2 << 20, shard_bytes: int = 2 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, of whose words less than percent lie in occurrences of the benchmark's windows. Rows without words stay; texts aren't changed."""
    blocks = phrase_blocks(benchmark, window, block_bytes, item_col=item_col, text_col=item_text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text_col, shard_bytes):
            spans, counts = [[] for _ in texts], [0] * len(texts)
            for block in blocks:
                for i, (n, own, _) in enumerate(block.value.hits(texts)):
                    counts[i] = n
                    spans[i] += own
            yield part.filter(pa.array([not contaminated(n, sum(b - a for a, b in merged_spans(s)), percent) for n, s in zip(counts, spans, strict=True)]))

    return docs.mapInArrow(clean, docs.schema)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated")
    )


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item, least(len(w), 13) AS n, array_to_string(w[k : k + least(len(w), 13) - 1], ' ') AS phrase
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM i),
x AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS phrase
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lengths WHERE len(w) >= n)),
h AS (SELECT doc_id, k, x.n, item FROM x JOIN i ON x.n = i.n AND x.phrase = i.phrase),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
