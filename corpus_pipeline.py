"""Corpus pipeline: toxicity, quality rules, line dedup, near duplicates, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Stages work on all rows they get; null and empty texts go
through toxicity as clean, fail the quality rules for want of words, and may arise in line dedup, where an emptied
document keeps its row until near-duplicate removal leaves one of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, minhash, packing, quality, simhash, toxicity
from tessera.llm.common import columns_of, crc_mod, cut, free_name, table
from tessera.llm.graph import connected_components

#: Documents that score so high are rejected.
TOXIC_FROM = 0.5
#: Words of a shingle, and the Jaccard similarity, as a fraction, from which texts are near duplicates.
SHINGLE, SIMILAR = 5, (4, 5)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on the labelled documents of the training part, as op5_toxicity is."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(crc_mod(F.col("doc_id"), 3) != 1)
    score = free_name(docs, "score")
    scored = toxicity.score_texts(docs, toxicity.train(docs, labels), keep=tuple(docs.columns), name=score)
    return scored.filter(F.col(score) < TOXIC_FROM).select(*columns_of(docs))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = line_dedup.drop_repeated_lines(docs, removed=free_name(docs, "lines_removed"))
    kind = dict(docs.dtypes).get("n_chars")
    return made.select(*[F.length("text").cast(kind).alias(c) if c == "n_chars" else col for c, col in zip(docs.columns, columns_of(docs), strict=True)])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row with the least doc_id stays (null last; of equal ids the first read).

    SimHash, as in op2_simhash, names for every text the first one that its fingerprint's links reach, which counts if both
    are similar by their shingles; min-hash finds what fingerprints miss."""
    row = free_name(docs, "row_")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    at = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col(row).alias("r")).alias("at")
    ids = rows.select(at, "text")
    linked = lambda found: cut(found.select(F.col("doc_id.r").alias("a"), F.col("component_id.r").alias("b")).filter("a <> b"), "same")
    alike = minhash.confirm(linked(simhash.near_duplicates(ids, doc_id="at")), rows.select(F.col(row).alias("node"), "text"), SHINGLE, SIMILAR)
    links = alike.unionByName(linked(minhash.near_duplicates(ids, doc_id="at", shingle=SHINGLE, similar=SIMILAR)))
    roots = connected_components(links).select(F.col("node").alias(row), "root")
    reach = rows.select(row, at).join(roots, row, "left").groupBy(F.coalesce("root", row).alias("root")).agg(F.min("at").alias("at"))
    return rows.join(reach.select(F.col("at.r").alias(row)), row, "left_semi").select(*columns_of(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: SQL can express neither the compression distances nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
