"""Document fingerprints: SpotSigs, the set of chains of content words that follow common words."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHasher, mixed, shared_folder, slices, table, written

# Very common words of English, German, French and Spanish, the anchors; all other words are content words.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "auf das dem den der des die ein eine für ist mit nicht sich sie und von zu "
    "au ce dans de du en est et il la le les par pas pour que qui un une "
    "con del el lo los las no por se su y"
).split()

_NOT_WORDS = bytes(b for b in range(128) if not chr(b).isalnum())
_CHAIN = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


class SpotSigs:
    """Signatures of texts: for each anchor, the hash of it and the chain of up to `length` content words after it, `distance` content words apart.

    A chain that the text's end cuts short counts if it has a word. A text without any such chain has its content words, or else all its words, as signatures; one without words its whole text, if any.
    """

    def __init__(self, anchors: tuple[str, ...] = tuple(ANCHORS), distance: int = 1, length: int = 3):
        self.hasher = WordHasher(_NOT_WORDS)
        self.anchors = np.sort(self.hasher([a.encode() for a in anchors])[0])
        self.distance, self.length = distance, length

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each text its distinct signatures, ascending 32-bit values."""
        words, begins = self.hasher(texts)
        at = np.minimum(np.searchsorted(self.anchors, words), len(self.anchors) - 1)
        anchor = self.anchors[at] == words if len(self.anchors) else np.zeros(len(words), bool)
        spots, content = np.flatnonzero(anchor), np.flatnonzero(~anchor)
        ends = np.searchsorted(content, begins[1:])  # of each text's content words
        text_of = np.searchsorted(begins, spots, "right") - 1
        first, end = np.searchsorted(content, spots), ends[text_of]
        signatures = words[spots] * _CHAIN[0]
        for i in range(self.length):
            place = first + i * self.distance
            inside = place < end
            signatures[inside] += mixed(words[content[place[inside]]] + _CHAIN[1 + i % 3])
            signatures *= _CHAIN[0]
        some = first < end
        signatures, text_of = (mixed(signatures[some]) >> np.uint64(32)).astype(np.uint32), text_of[some]
        bounds = np.searchsorted(text_of, np.arange(len(texts) + 1))
        out = []
        for i, text in enumerate(texts):
            own = signatures[bounds[i] : bounds[i + 1]]
            if not len(own) and text:
                all_words = words[begins[i] : begins[i + 1]]
                plain = all_words[~anchor[begins[i] : begins[i + 1]]] if len(all_words) else all_words
                own = (mixed(plain if len(plain) else all_words) >> np.uint64(32)).astype(np.uint32)
                if not len(own):
                    own = np.frombuffer(hashlib.sha256(text).digest()[:4], np.uint32)
            out.append(np.unique(own))
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending sets; 1 of two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(both) - common)


def fingerprint(signatures: np.ndarray) -> str:
    """The whole set as text: its size, and its 32-bit values in base64."""
    return f"{len(signatures)}:{base64.b64encode(signatures.astype('<u4').tobytes()).decode()}"


def in_order(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """Rows (bucket, extra, id, text), each bucket whole in one partition, in descending id order (null last; equal ids by text).

    A bucket is a range of ids, about one for each shuffle partition. The first row of the next bucket stands at a bucket's end once more, as extra; after the last comes the first.
    So a task finds each document's successor in its own rows. Only ids are looked at to find the ranges: one percentile and one largest id for each bucket reach the driver.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("key"), F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text_col))
    bounds = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)] or [0.5], max(10_000, 10 * parts))).first()[0]
    bounds = np.unique(np.array(bounds if parts > 1 and bounds else [], np.int64))

    @F.pandas_udf("int")
    def bucket(key: pd.Series) -> pd.Series:
        return pd.Series(len(bounds) - np.searchsorted(bounds, key.to_numpy(np.int64), "left")).astype("int32")

    firsts = {r.bucket: r.key for r in rows.select("key").withColumn("bucket", bucket("key")).groupBy("bucket").agg(F.max("key").alias("key")).collect()}
    used = sorted(firsts)
    tails = np.array([firsts[b] for b in used], np.int64)  # descending, as the buckets ascend
    before = {firsts[b]: used[i - 1] for i, b in enumerate(used)}

    @F.pandas_udf("int")
    def ended(key: pd.Series) -> pd.Series:
        """The bucket that a row ends, -1 if none."""
        keys = key.to_numpy(np.int64)
        out = np.full(len(keys), -1, np.int32)
        for i in np.flatnonzero(np.isin(keys, tails)):
            out[i] = before[int(keys[i])]
        return pd.Series(out)

    placed = rows.withColumn("own", bucket("key")).withColumn("tail", ended("key"))
    placed = placed.withColumn("bucket", F.explode(F.when(F.col("tail") >= 0, F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("extra")), F.struct(F.col("tail").alias("bucket"), F.lit(1).alias("extra")))).otherwise(F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("extra"))))))
    placed = placed.select("bucket.bucket", "bucket.extra", "key", id_col, text_col)
    return placed.repartitionById(parts, F.pmod("bucket", F.lit(parts))).sortWithinPartitions("bucket", "extra", F.desc("key"), text_col).select("bucket", "extra", id_col, text_col)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each document.

    The edited text's last half is the beginning of the next document's text, in descending id order; the last one's next is the first, a single one's itself. Null ids come last, equal ids in the order of their texts; null texts are empty.
    An empty text has an empty fingerprint, like only to another empty one. The texts are shuffled once, by ranges of ids; other columns are dropped.
    """
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def spotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots = SpotSigs()
        held = None  # the row before, which waits for its successor: (bucket, extra, id, text)
        for part, texts in slices(batches, text_col, 1 << 20):
            rows = [*([held] if held else []), *zip(part.column("bucket").to_pylist(), part.column("extra").to_pylist(), part.column(id_col).to_pylist(), texts, strict=True)]
            held = rows[-1]
            chars = [r[3].decode() for r in rows]
            pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
            edited = [(chars[i][: len(chars[i]) - len(chars[i]) // 2] + chars[i + 1][: len(chars[i]) // 2]).encode() for i in pairs]
            sets, edited_sets = spots([r[3] for r in rows]), spots(edited)
            yield pa.RecordBatch.from_arrays([
                pa.array([rows[i][2] for i in pairs], pa.int64()), pa.array([len(chars[i]) for i in pairs], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                pa.array([fingerprint(sets[i]) for i in pairs], pa.string()), pa.array([fingerprint(e) for e in edited_sets], pa.string()),
                pa.array([likeness(sets[i], e) for i, e in zip(pairs, edited_sets, strict=True)], pa.float64()), pa.array([likeness(sets[i], sets[i + 1]) for i in pairs], pa.float64()),
            ], names=names)

    ordered = in_order(docs, id_col=id_col, text_col=text_col)
    return ordered.mapInArrow(spotted, f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def signature_sets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, signatures) of each document: its ascending signatures as longs."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots = SpotSigs()
        for part, texts in slices(batches, "__text", 1 << 20):
            yield pa.RecordBatch.from_arrays([part.column("__id"), pa.array([s.astype(np.int64) for s in spots(texts)], pa.list_(pa.int64()))], names=[id_col, "signatures"])

    return docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text")).mapInArrow(sets, f"{id_col} long, signatures array<long>")


def near_pairs(docs: DataFrame, *, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (id, class_id) with the smallest id of equal signature sets as class, and (a, b, likeness) of all pairs of classes at or above the threshold, a < b.

    Two sets can reach the threshold only if the smaller has threshold times the larger's size and both hold one of the rarest few signatures of the other.
    So sets are posted under their rarest signatures and their length's partition (lengths grow by 1 / threshold, so partners lie in the same or the next), met by a join on both, and compared in full.
    Documents without signatures are in no pair; null ids are left out.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    sets = written(signature_sets(docs, id_col=id_col, text_col=text_col).where(F.col(id_col).isNotNull()), f"{folder}/sets")
    keyed = sets.withColumn("key", F.sha2(F.array_join("signatures", ",").cast("binary"), 256))
    classes = written(keyed.groupBy("key").agg(F.min(id_col).alias("class_id"), F.first("signatures").alias("signatures")), f"{folder}/classes")
    members = keyed.select(id_col, "key").join(classes.select("key", "class_id"), "key").select(id_col, "class_id")

    size = F.size("signatures")
    posted = classes.where(size > 0).select("class_id", size.alias("n"), F.floor(F.log(size.cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9).cast("int").alias("band"), F.explode("signatures").alias("s"))
    often = posted.groupBy("s").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("class_id").orderBy("often", "s"))
    kept = written(posted.join(often, "s").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).select("class_id", "n", "band", "s"), f"{folder}/posted")
    left, right = kept.withColumn("meet", F.explode(F.array("band", F.col("band") + 1))), kept.withColumnRenamed("band", "meet")
    l, r = left.alias("l"), right.alias("r")
    within = (F.col("r.n") * threshold <= F.col("l.n") + 1e-9) & (F.col("l.n") * threshold <= F.col("r.n") + 1e-9) & (F.col("l.class_id") != F.col("r.class_id"))
    met = l.join(r, (F.col("l.s") == F.col("r.s")) & (F.col("l.meet") == F.col("r.meet")) & within).select(F.least("l.class_id", "r.class_id").alias("a"), F.greatest("l.class_id", "r.class_id").alias("b")).distinct()
    one, two = classes.select(F.col("class_id").alias("a"), F.col("signatures").alias("x")), classes.select(F.col("class_id").alias("b"), F.col("signatures").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    pairs = met.join(one, "a").join(two, "b").select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("likeness")).where(F.col("likeness") >= threshold)
    return members, written(pairs, f"{folder}/pairs")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
