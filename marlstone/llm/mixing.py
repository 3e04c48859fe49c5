"""Mixing sources to target weights: Pareto order sampling after whole copies; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import removed, shared_folder, table, text_of, written

WORD = r"[^\x20\x09-\x0D]+"
BINS = 4096
#: Source tables up to so many rows are broadcast; larger ones are joined by a shuffle that splits hot sources.
BROADCAST_SOURCES = 100_000


def _measured(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, priority: Column | None) -> DataFrame:
    """docs with __source (null apart from all others), __size, __u in (0, 1) from the id and the text, and __priority."""
    digest = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text_of(text_col).cast("binary"))).cast("binary"))
    return docs.withColumns({
        "__source": F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("t")),  # null last: 't' follows every 's...'
        "__size": F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long"),
        "__u": (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48)),
        "__priority": F.lit(1.0) if priority is None else F.greatest(F.coalesce(priority.cast("double"), F.lit(0.0)), F.lit(0.0)),
    })


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_copies: int) -> DataFrame:
    """Adds weight and target to (__source, source_size): shares of the total by weight, none above max_copies of its source.

    Sources in order of cap / weight: those before the first whose weighted share of what the earlier caps leave is within its cap stop at their caps, which is where resharing ends.
    Windows over all sources handle one row for each source.
    """
    by_name, by_ratio = Window.orderBy("__source"), Window.orderBy("ratio", "__source")
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * max_copies).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", level).withColumn("at", F.row_number().over(by_ratio))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("at", "level"))).over(everything)
    return rows.withColumn("first", first).select("__source", "source_size", "weight", F.when(F.col("at") < F.col("first.at"), F.col("cap").cast("double")).otherwise(F.coalesce(F.col("weight") * F.col("first.level"), F.col("cap").cast("double"))).alias("target"))


def _ranked(rows: DataFrame, max_copies: int) -> DataFrame:
    """Adds __whole (certain copies) and __key: the document's odds u / (1 - u) over its inclusion odds p / (1 - p), as odds / (1 + odds) in 0 to 1."""
    expected = F.least(F.lit(float(max_copies)), F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")) * F.col("__priority") * F.col("__scale"), F.lit(0.0)))
    rows = rows.withColumn("__expected", expected).withColumn("__whole", F.floor("__expected"))
    p = F.col("__expected") - F.col("__whole")
    up, down = F.col("__u") * (1 - p), p * (1 - F.col("__u"))
    return rows.withColumn("__key", F.when(F.col("__whole") < max_copies, up / (up + down)))


def _joined(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(sources) if few else sources, "__source")


def mixed(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3, priority: Column | None = None, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with __size, source_size, target and __copies: how often the mix takes the document, 0 to max_copies.

    A document's expected copies are its source's target over its size, times its priority (an own column, 1 if none, scaled to keep the source's total; null and negative count as 0).
    Its whole copies are certain. The fraction is its inclusion probability in a Pareto sample of the source, which is as many words long as the whole copies leave to the target: it ends with the document that brings it nearest.
    Random numbers come from the seed, id and text, so reruns and retried tasks agree, and rows with equal id and text are taken alike. Sources rank by code point, null last. Null text has size 0, is an empty document. An empty table gives an empty mix.
    Words and sources of all rows are counted; a source is never gathered: its sample's end is found by sums over 4,096 bins of the key, then in the one bin that holds it.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    narrow = docs.select(id_col, text_col, source_col, *([] if priority is None else [priority.alias("__own")]))
    measured = _measured(narrow, seed, id_col, text_col, source_col, None if priority is None else F.col("__own"))
    rows = written(measured.select("__source", "__size", "__u", "__priority"), f"{folder}/rows")
    sizes = rows.groupBy("__source").agg(F.sum("__size").alias("source_size"), F.sum(F.col("__priority") * F.col("__size")).alias("weighed"))
    scales = sizes.select("__source", F.coalesce(F.try_divide(F.col("source_size").cast("double"), F.col("weighed")), F.lit(0.0)).alias("__scale"))
    sources = written(source_targets(sizes.drop("weighed"), weights, max_copies).join(scales, "__source"), f"{folder}/sources")
    few = sources.count() <= BROADCAST_SOURCES

    ranked = _ranked(_joined(rows, sources, few), max_copies)
    bins = ranked.withColumn("bin", F.least(F.floor(F.col("__key") * BINS), F.lit(BINS - 1))).groupBy("__source", "bin").agg(F.sum("__size").alias("words"), F.sum(F.col("__size") * F.col("__whole")).alias("certain"), F.first("target").alias("target"))
    by_bin = Window.partitionBy("__source").orderBy(F.col("bin").asc_nulls_last())
    bins = bins.withColumn("wanted", F.col("target") - F.sum("certain").over(Window.partitionBy("__source"))).withColumn("before", F.sum("words").over(by_bin) - F.col("words"))
    ends = written(bins.where("bin is not null and wanted > before").groupBy("__source").agg(F.max(F.struct("bin", "before", "wanted")).alias("end")), f"{folder}/ends")
    inside = _joined(ranked, ends, few).where(F.least(F.floor(F.col("__key") * BINS), F.lit(BINS - 1)) == F.col("end.bin"))
    reached = F.col("end.before") + F.sum("__size").over(Window.partitionBy("__source").orderBy("__key", "__size").rowsBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("fits", reached - F.col("__size") / 2 <= F.col("end.wanted")).groupBy("__source").agg(F.max(F.when(F.col("fits"), F.col("__key"))).alias("last"), F.first("end.bin").alias("bin"))
    # no document of the bin fits: the sample ends with the bin before
    last = last.select("__source", F.coalesce("last", F.col("bin") / F.lit(float(BINS)) - F.lit(2.0**-53)).alias("__last"))
    cuts = written(sources.join(last, "__source", "left"), f"{folder}/cuts")
    removed(spark, f"{folder}/rows")

    out = _ranked(_joined(_measured(docs, seed, id_col, text_col, source_col, priority), cuts, few), max_copies)
    copies = F.col("__whole") + F.when(F.col("__key") <= F.col("__last"), 1).otherwise(0)
    return out.withColumn("__copies", copies.cast("int")).drop("__source", "__u", "__priority", "__scale", "__expected", "__whole", "__key", "__last", "weight")


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, each as often as the mix takes it."""
    renamed = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])
    at = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    chosen = {k: at[options.pop(k, v)] for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    repeated = mixed(renamed, **chosen, **options).where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return repeated.select(*[F.col(v).alias(k) for k, v in at.items()])


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mix.select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * F.col("__copies")).alias("taken"), F.col("__copies").alias("copies"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce('s' || source, 't') AS s, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  (CAST('0x' || substr(md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u FROM documents),
a AS (SELECT s, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY s) - 1) % 3 + 1 AS weight FROM d GROUP BY s),
r AS (SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / weight AS ratio FROM a),
l AS (SELECT *, row_number() OVER o AS pos,
             CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
      FROM r WINDOW o AS (ORDER BY ratio, s)),
f AS (SELECT pos AS first_pos, level AS first_level FROM l WHERE level <= ratio ORDER BY pos LIMIT 1),
t AS (SELECT s, source_size, CASE WHEN pos < first_pos THEN CAST(cap AS DOUBLE) ELSE coalesce(weight * first_level, CAST(cap AS DOUBLE)) END AS target FROM l LEFT JOIN f ON true),
e AS (SELECT doc_id, s, size, u, source_size, target, least(3.0::DOUBLE, coalesce(CASE WHEN source_size > 0 THEN target / source_size * 1.0 * 1.0 END, 0)) AS expected FROM d JOIN t USING (s)),
k AS (SELECT *, floor(expected) AS whole, CASE WHEN floor(expected) < 3 THEN u * (1 - (expected - floor(expected))) / (u * (1 - (expected - floor(expected))) + (expected - floor(expected)) * (1 - u)) END AS key FROM e),
c AS (SELECT *, target - sum(size * whole) OVER (PARTITION BY s) AS wanted, sum(size) OVER (PARTITION BY s ORDER BY key NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS reached FROM k),
m AS (SELECT s, max(CASE WHEN reached - size / 2 <= wanted AND wanted > 0 THEN key END) AS last FROM c GROUP BY s)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN key <= last THEN 1 ELSE 0 END) AS BIGINT) AS taken, CAST(whole + CASE WHEN key <= last THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM k JOIN m USING (s)
"""
