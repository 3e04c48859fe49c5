"""A training corpus from documents: toxic ones go, of near copies one stays, contaminated ones go, sources are mixed to their targets, and token ids are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontamination, mixing, near_dedup, token_ids, toxicity
from marlstone.llm.common import remainder, shared_folder, table, written


def clean_speech(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labels of these documents whose ids aren't held out.

    Null and empty texts, null ids and sources stay; rows that repeat go or stay alike; texts are read whole. Without labels, or with labels of one kind, nothing goes.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.coalesce(remainder("doc_id", 3) != 1, F.lit(False)))
    return toxicity.drop_toxic(docs, model)


def one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the document with the smallest id stays.

    Rows without words all stay; a null id is greater than all others; of rows equal in id and text one stays. Texts are read whole.
    """
    return near_dedup.drop_near_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least 5 percent of the words lie in windows of benchmark items go.

    Rows without words stay; rows that repeat go or stay alike; texts are read whole, and an empty benchmark takes nothing.
    """
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it.

    A null source is a source of its own, the last; documents without words take no part of a target; rows equal in id and text are taken alike.
    """
    return mixing.take_mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of all documents, written and read back: doc_id, start, n_tokens, ids_crc32.

    A null text has only its end; null ids come first, rows of one id in the order of their texts' hashes.
    """
    import public_tokenizers

    return token_ids.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", clean_speech),
    ("near_dedup", one_of_copies),
    ("decontamination", decontaminated),
    ("source_mix", mixed_sources),
    ("token_ids", token_output),
]
#: Training a lexicon, sketches and a tokenizer aren't SQL; the tests check the stages one by one on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written as Parquet and read again. Empty documents give an empty result."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for number, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{number}-{name}")
    return docs
