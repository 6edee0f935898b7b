"""A training corpus in five stages: quality, near-duplicates, decontamination, privacy, mixing.

Every stage takes the documents that the one before has kept, works on all of them, and returns the
columns of `documents`; the last one adds the columns of the mixture.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samebytes.llm import decontamination, mixing, near_duplicates, pii, quality
from samebytes.llm.common import remove_folder, table
from samebytes.operators.scale import lookup_join, shared_folder

#: SQL cannot express the classifier, the sketches and the parsers.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Extra columns pass through.

    Null and empty texts are judged by features of their own, null sources and languages are one
    site each, and every repeated row is judged alike. Without labels nothing is known against any text.
    """
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"))
    return scored.filter("accepted").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group over five-word shingles.

    Documents without id or without words belong to no group and stay, and so do repeated rows
    of an id that is kept.
    """
    found = near_duplicates.near_duplicates(docs, size=5, percent=80)
    dropped = found.filter("NOT kept").select(F.col("doc_id").alias("_dropped")).distinct()
    return lookup_join(docs, dropped, F.col("doc_id") == F.col("_dropped"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item.

    Null and empty texts hold none and stay, and so does everything without items. Repeated rows stay
    or go together; ids do not matter.
    """
    found = decontamination.find_passages(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("passages") == 0).select(*docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by placeholders and `n_chars` counted anew.

    Null texts stay null, and every row stays, whatever its id.
    """
    clean = pii.add_pii(docs, clean="text")
    columns = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return clean.withColumns(columns).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture by source, once per pass, with the columns of the mixture.

    A null source is the source ``; documents without words have no tokens and come with their
    block, repeated rows are documents of their own, and sources without tokens do not appear.
    """
    return mixing.mix_sources(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_pii),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`, each written to the shared folder and read again.

    What a stage has written goes as soon as the next one is done; the last table stays, for the
    result is read from it.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove_folder(spark, before)
        before = path
    return docs
