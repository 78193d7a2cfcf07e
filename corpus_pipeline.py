"""A training corpus from the table documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept: documents
that score as toxic go; of each group of near duplicates one stays; personal data is
replaced; sources are mixed to their target weights, with repeats; what is left is packed
into token sequences. All but the last return the columns of documents.

Nulls, empty and repeated rows follow the operators' rules. An empty table gives an empty
result. Very long texts are taken whole by every stage, columns beside those of documents are
carried along, whatever their names, and each stage settles ties as its operator does: by the
least doc_id, or by hashes of the rows, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefuse.llm import mixing, neardup, packing, pii, toxicity
from lodefuse.llm.common import saved, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; a null or empty text has no signal and stays, a long one is scored whole."""
    return toxicity.Model(docs, table(spark, sf_dir, "labels")).keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group of near duplicates: 5-word shingles, similarity 0.8 or more.

    SimHash on bit planes gives the first candidates, a prefix filter those beyond its radius; all are held against their sets.

    Of repeated rows one stays; a null doc_id only where its group has no other.
    """
    return neardup.representatives(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose personal data is replaced by its kind; null texts stay null, spans that overlap become one."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights, with repeats; a null source is a source, a part of a text is its first words."""
    return mixing.mixed_documents(docs, mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its place in a token sequence; a null or empty text is one end token."""
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has no word for a learned model or the tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
