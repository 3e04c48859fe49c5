"""MinHash near-dedup: SetSketch registers, banded to find candidates, weighed by a joint likelihood, and confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHasher, long_id, mixed, removed, shared_folder, slices, table, written

_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
#: Nodes of a group that one task compares with each other, or with one center.
BLOCK = 512
#: Estimates lie below the similarity by at most this, but for one pair in ten thousand at 120 registers.
MARGIN = 0.15
#: Lists up to so many rows are broadcast to keep texts where they are; longer ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


class Shingles:
    """The distinct shingles of texts, as ascending 64-bit hashes; a text of fewer words is one shingle, one without words has none."""

    def __init__(self, words: int):
        self.words, self.hasher = words, WordHasher()

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        hashes, begins = self.hasher(texts)
        n = self.words
        if len(hashes) >= n:
            chains = np.zeros(len(hashes) - n + 1, np.uint64)
            for i in range(n):
                chains = mixed(chains + hashes[i : len(hashes) - n + 1 + i] * _PLACES[i % 5])
        out = []
        for a, b in pairwise(begins.tolist()):
            if b - a >= n:
                own = np.sort(chains[a : b - n + 1])
                out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            elif b > a:
                whole = np.array([b - a], np.uint64)
                for i in range(a, b):
                    whole = mixed((whole + hashes[i : i + 1]) * _PLACES[0])
                out.append(whole)
            else:
                out.append(hashes[:0])
        return out


class SetSketch:
    """m registers of a set. A register is the truncated exponent, to base, of the least of its elements' exponential values: 0 to limit, greater for smaller values, so a union's register is the greater one."""

    def __init__(self, m: int, base: float = 1.001, rate: float = 20.0, limit: int = 65_534, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(1, 2**63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.m, self.base, self.rate, self.limit = m, base, rate, limit

    def __call__(self, elements: np.ndarray) -> np.ndarray:
        if not len(elements):
            return np.zeros(self.m, np.uint16)
        least = np.full(self.m, 2**64 - 1, np.uint64)
        for at in range(0, len(elements), 4096):
            x = elements[None, at : at + 4096] * self.factors[:, None]
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x9FB21C651E98DF25)
            least = np.minimum(least, x.min(1))
        value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / self.rate
        return np.clip(np.floor(1 - np.log(value) / np.log(self.base)), 0, self.limit + 1).astype(np.uint16)

    @staticmethod
    def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum(a, b)

    def jaccard(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        """Most likely similarity of the pairs in rows of a and b, by how many registers are greater, less or equal, given the sets' sizes."""
        more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
        equal = self.m - more - less
        u = (size_a / (size_a + size_b))[:, None]
        v = 1 - u
        j = np.minimum(u / v, v / u) * np.linspace(0, 1, 101)[None]
        chance = lambda x: -np.log1p(-np.maximum(x, 0) * (self.base - 1) / self.base) / np.log(self.base)
        up, down = np.maximum(chance(u - v * j), 1e-12), np.maximum(chance(v - u * j), 1e-12)
        likelihood = more * np.log(up) + less * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-12))
        return j[np.arange(len(j)), likelihood.argmax(1)]


def _sketched(words: int, bands: int, rows: int, extra: tuple[str, ...] = ()):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, sketcher = Shingles(words), SetSketch(bands * rows)
        for part, texts in slices(batches, "__text", 1 << 20):
            sets = shingles(texts)
            registers = np.array([sketcher(s) for s in sets])
            yield pa.RecordBatch.from_arrays([part.column("__id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(_node, sets), pa.string()), pa.array([r.tobytes() for r in registers], pa.binary()), *(part.column(c) for c in extra)], names=["id", "n", "node", "registers", *extra])

    return sketch


def _node(elements: np.ndarray) -> str | None:
    """128 bits that name the set; none for an empty one."""
    return f"{int(mixed(elements).sum()):016x}{int(mixed(elements ^ _PLACES[0]).sum()):016x}" if len(elements) else None


def _banded(bands: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(batch.num_rows, bands, -1).astype(np.uint64)
            key = np.arange(bands, dtype=np.uint64)[None] + np.zeros((batch.num_rows, 1), np.uint64)
            for i in range(values.shape[2]):
                key = mixed(key * _PLACES[0] + values[:, :, i])
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(key.view(np.int64).tolist(), pa.list_(pa.int64()))], names=["node", "bands"])

    return keys


def _alike(m: int, least: float):
    """The pairs (center, node) whose estimated similarity reaches least."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = SetSketch(m)
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, m) for c in ("ra", "rb"))
            estimate = sketcher.jaccard(a, b, *(batch.column(c).to_numpy().astype(np.float64) for c in ("na", "nb")))
            yield batch.select(["center", "node"]).filter(pa.array(estimate >= least))

    return judge


def _met(m: int, bands: int, least: float, percent: int):
    """Rows of a band follow each other, those of one pair of blocks too: links (a, b) that join nodes of different components which meet there and in no earlier band.

    Pairs whose estimated similarity reaches least are confirmed on their full sets, but for those that the links found here join already, so at most one link for each node leaves a task.
    """

    def links(rows: list[dict]) -> Iterator[tuple[str, str]]:
        sketcher, rows = SetSketch(m), sorted(rows, key=lambda r: (r["n"], r["node"]))
        sizes, own = np.array([r["n"] for r in rows], np.float64), np.array([r["block"] for r in rows])
        sets = [np.frombuffer(r["elements"], np.uint64) for r in rows]
        flat = np.frombuffer(b"".join(r["registers"] for r in rows), np.uint16).reshape(len(rows), -1)
        registers, parts = flat.reshape(len(rows), bands, -1), np.unique([r["component"] for r in rows], return_inverse=True)[1]
        band, i, j = rows[0]["place"], rows[0]["i"], rows[0]["j"]
        for a in range(len(rows) - 1):
            end = np.searchsorted(sizes, sizes[a] * 100 / percent + 1e-6, "right")  # similarity is at most the sizes' ratio
            b = np.arange(a + 1, end)
            b = b[(parts[b] != parts[a]) & ((own[b] != own[a]) if i != j else True)]
            if len(b):
                same = (registers[b] == registers[a]).all(2)
                b = b[same[:, band] & ~same[:, :band].any(1)]
            if len(b):
                b = b[sketcher.jaccard(np.broadcast_to(flat[a], (len(b), m)), flat[b], np.full(len(b), sizes[a]), sizes[b]) >= least]
            for x in b.tolist():
                if parts[x] != parts[a]:
                    common = len(np.intersect1d(sets[a], sets[x], assume_unique=True))
                    if 100 * common >= percent * (len(sets[a]) + len(sets[x]) - common):
                        parts[parts == parts[x]] = parts[a]
                        yield rows[a]["node"], rows[x]["node"]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out():
            found = list(links(held))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for row in batch.to_pylist():
                if (row["band"], row["i"], row["j"]) != key:
                    if held:
                        yield out()
                    key, held = (row["band"], row["i"], row["j"]), []
                held.append(row)
        if held:
            yield out()

    return met


def _confirmed(percent: int):
    """Rows (center, block, first, node, elements) in this order, the center's own first: the links (a, b) of the center with nodes at or above the threshold, by exact intersections."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for row in batch.to_pylist():
                elements = np.frombuffer(row["elements"], np.uint64)
                if row["first"] == 0:
                    center, own = row["node"], elements
                    continue
                common = len(np.intersect1d(own, elements, assume_unique=True))
                if row["center"] == center and 100 * common >= percent * (len(own) + len(elements) - common):
                    a.append(center)
                    b.append(row["node"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])

    return confirm


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, component) of all nodes of (a, b): the least node that can be reached.

    Each round points every node at its least neighbour, follows pointers to their ends and keeps only edges between different ends, so the edges shrink from round to round. Tables of a round are written to the folder.
    """
    spark = edges.sparkSession
    edges = written(edges.select("a", "b"), f"{folder}/edges")
    mapping = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), f"{folder}/nodes")

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()

    pairs, turn = written(ordered(edges), f"{folder}/pairs-0"), 0
    while not pairs.isEmpty():
        turn += 1
        both = pairs.union(pairs.select("b", "a"))
        ends, step = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("end")).select("node", F.least("node", "end").alias("end")), f"{folder}/ends-{turn}-0"), 0
        while True:
            step += 1
            further = ends.select(F.col("node").alias("end"), F.col("end").alias("further"))
            jumped = written(ends.join(further, "end").select("node", F.col("further").alias("end"), (F.col("further") != F.col("end")).alias("moved")), f"{folder}/ends-{turn}-{step}")
            ends = jumped.select("node", "end")
            if jumped.where("moved").isEmpty():
                break
        of = lambda name: ends.select(F.col("node").alias(name), F.col("end").alias(f"end_{name}"))
        left = ordered(pairs.join(of("a"), "a").join(of("b"), "b").select(F.col("end_a").alias("a"), F.col("end_b").alias("b")))
        mapping = written(mapping.join(of("component"), "component", "left").select("node", F.coalesce("end_component", "component").alias("component")), f"{folder}/mapping-{turn}")
        pairs = written(left, f"{folder}/pairs-{turn}")
    removed(spark, f"{folder}/edges")
    return mapping


def near_classes(docs: DataFrame, *, words: int = 5, percent: int = 80, bands: int = 30, rows: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row: the least id reachable by links, which join texts whose shingle sets have 100 * intersection >= percent * union.

    Rows of equal sets are one node. Nodes that agree in all registers of one of the bands meet; a pair at the threshold misses all 30 with probability 1e-7. First each node of a meeting is compared with the one of most meetings there:
    if the likelihood estimate of their similarity is within MARGIN of the threshold (a pair at the threshold falls below with probability 1e-4), on their full sets. That makes most links of a group in work that grows with its size. Then only
    meetings whose nodes are still in different components are looked at again, in blocks: there pairs of different components are estimated on registers and, if near, confirmed on full sets; pairs within a component can't change it.
    No pairs are listed: a task gives a link for each node at most. A center's nodes are dealt to tasks by blocks of BLOCK, and no group is sampled or cut.
    Null, empty and blank texts have no shingles and are linked with nothing; a null id counts as greater than all others, and a component of null ids only has a null id; kept is id = component_id, for null ids too.
    Ids must be integers or null. Other columns are dropped. Words and shingles are told apart by 64 bits, sets by 128.
    """
    out = _classes(docs, words, percent, bands, rows, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _classes(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 30, rows: int = 4, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """(id, n, node, component, component_id) of each row, with the extra columns (long): its set's name and the component's, both null without shingles, and the least id in the component."""
    extra, m, least = extra or {}, bands * rows, max(0.05, percent / 100 - MARGIN)
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    narrow = docs.select(long_id(docs, id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), *(c.alias(x) for x, c in extra.items()))
    schema = ", ".join(["id long, n long, node string, registers binary", *(f"{x} long" for x in extra)])
    sketches = written(narrow.mapInArrow(_sketched(words, bands, rows, tuple(extra)), schema), f"{folder}/sketches")
    nodes = written(sketches.where("n > 0").groupBy("node").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.max("registers").alias("registers")), f"{folder}/nodes")

    met = nodes.select("node", "registers").mapInArrow(_banded(bands), "node string, bands array<long>").select("node", F.posexplode("bands").alias("place", "band"))
    busy = met.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    met = written(met.join(busy, "band"), f"{folder}/met")
    degree = met.groupBy("node").agg(F.sum("size").alias("degree"))
    ranked = met.join(degree, "node")
    centers = ranked.groupBy("band").agg(F.max(F.struct("degree", "node")).alias("most")).select("band", F.col("most.node").alias("center"))
    pairs = met.join(centers, "band").where("node != center").select("center", "node").distinct()
    one, two = (nodes.select(F.col("node").alias(x), F.col("registers").alias(f"r{y}"), F.col("n").alias(f"n{y}")) for x, y in (("center", "a"), ("node", "b")))
    judged = written(pairs.join(one, "center").join(two, "node").mapInArrow(_alike(m, least), "center string, node string"), f"{folder}/judged")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for _, part in slices(batches, "__text", 1 << 20):
            sets = shingles(part)
            yield pa.RecordBatch.from_arrays([pa.array(map(_node, sets), pa.string()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "elements"])

    def sets_of(wanted: DataFrame, path: str) -> DataFrame:
        """(node, elements) of the nodes, each once: rows of one id may have other sets too, and a set more than one row."""
        wanted = written(wanted.join(nodes.select("node", "rep"), "node"), f"{path}/wanted")
        few = wanted.count() <= BROADCAST_ROWS
        reps = wanted.select("rep").distinct()
        texts = narrow.select("__id", "__text").join(F.broadcast(reps) if few else reps, F.col("__id").eqNullSafe(F.col("rep")), "left_semi")
        return written(texts.mapInArrow(full, "node string, elements binary").join(F.broadcast(wanted.select("node")) if few else wanted.select("node"), "node").dropDuplicates(["node"]), f"{path}/sets")

    # each center's own set, and the nodes', once for each block of nodes
    sets = sets_of(judged.select(F.explode(F.array("center", "node")).alias("node")).distinct(), f"{folder}/first")
    counts = judged.groupBy("center").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = judged.join(counts, "center").select("center", "node", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    heads = counts.select("center", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).select("center", "block", F.lit(0).alias("first"), F.col("center").alias("node"))
    both = heads.union(dealt.select("center", "block", F.lit(1).alias("first"), "node")).join(sets, "node")
    ordered = both.select("center", "block", "first", "node", "elements").repartition("center", "block").sortWithinPartitions("center", "block", "first")
    first = written(ordered.mapInArrow(_confirmed(percent), "a string, b string"), f"{folder}/links")
    linked = components(first, f"{folder}/linked")
    # meetings of which some nodes, the center apart, which all were compared with, are in different components
    named = met.join(linked.withColumnRenamed("component", "own"), "node", "left").withColumn("component", F.coalesce("own", "node"))
    apart = named.join(centers.withColumnRenamed("center", "node"), ["band", "node"], "left_anti").groupBy("band").agg(F.count("*").alias("others"), F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    again = named.join(apart.select("band", F.ceil(F.col("others") / BLOCK).cast("int").alias("blocks")), "band").join(centers.withColumnRenamed("center", "node"), ["band", "node"], "left_anti").join(nodes.select("node", "n", "registers"), "node")
    again = again.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    again = written(again.select("band", "place", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "component", "n", "registers"), f"{folder}/again")
    if not again.isEmpty():
        whole = again.join(sets_of(again.select("node").distinct(), f"{folder}/second"), "node")
        second = written(whole.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(_met(m, bands, least, percent), "a string, b string"), f"{folder}/links-2")
        linked = components(first.union(second), f"{folder}/relinked")

    named = nodes.select("node", "rep").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_id = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least_id, "component").select("node", "component", "component_id")
    return sketches.select("id", "n", "node", *extra).join(named, "node", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, with all their columns whatever their names, without the copies and near copies: of each component one row stays, that with the smallest id (null is greatest), and of several with that id the one whose text has the smallest hash.

    Rows are told apart by id and text, by 128 bits of both, so a row goes only if its own text is linked to the one that stays; of rows equal in both any one stays. Rows without shingles all stay; an empty table stays empty. Ids must be integers or null.
    The rows that go, or those that repeat, are broadcast up to BROADCAST_ROWS of them, else joined by a shuffle.
    """
    spark, plain = docs.sparkSession, docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    id_col, text_col = at[id_col], at[text_col]
    own = [F.col(id_col).cast("string"), F.col(text_col).cast("string")]
    names = {"__a": F.xxhash64(*own), "__b": F.xxhash64(F.lit(1), *own)}
    found = _classes(plain, id_col=id_col, text_col=text_col, extra=names, **options).where("n > 0")
    folder = shared_folder(spark)
    rows = written(found.groupBy("component", *names).agg(F.min("id").alias("id"), F.count("*").alias("rows")), f"{folder}/rows")
    staying = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", *names)).alias("least")).select("least.__a", "least.__b")
    gone = written(rows.join(staying, list(names), "left_anti").select(*names), f"{folder}/gone")
    again = written(rows.where("rows > 1").join(staying, list(names), "left_semi").select(*names), f"{folder}/again")

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, list(names), how)

    left = joined(plain.withColumns(names), gone, "left_anti")
    if not again.isEmpty():
        left = joined(left, again, "left_anti").unionByName(joined(left, again, "left_semi").dropDuplicates(list(names)))
    return left.select(*(F.col(v).alias(k) for k, v in at.items()))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"), words=4)


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""
