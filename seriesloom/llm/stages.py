"""Operators as stages over documents: each returns the documents it keeps, with their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, jaccard_join, language, packing, pii
from .common import cut, id_crc, read_table, scratch, small

#: Names that documents' own columns don't have.
KEY, SPANS = "_seriesloom_key", "_seriesloom_spans"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key that rows share only if id and text are equal."""
    return docs.withColumn(KEY, F.sha2(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))), 256))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: those without a letter, and those under the calibrated bar.

    Null, empty and letterless texts go. Rows with a null id or lang are judged by their text like others. Equal texts are
    judged alike, so repeated rows stay or go together. An empty table stays empty. docs may have columns of any name.
    """
    model = language.train(docs, id_crc(F.col("doc_id")) % 4 != 2)
    into = tuple(KEY + x for x in ("_lang", "_score", "_rejected"))
    return language.identify(docs, model, into=into).where(~F.col(into[2])).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group that hangs together by similarity, once.

    Null and empty texts are copies of each other; texts without words are copies only where equal. Rows with a null id stay.
    Rows repeated with id and text stay once. Where one id has different texts, these rows are not known apart by their id: they
    stay, once each, and are no one's copies. An empty table stays empty. docs may have columns of any name.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    once = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64(text)).alias("a"), F.max(F.xxhash64(text)).alias("b"), F.count("*").alias("n"))
    again = cut(once.where("n > 1").select("doc_id", (F.col("a") != F.col("b")).alias(KEY)))
    if not again.isEmpty():
        rows = docs.join(small(again), "doc_id", "left")
        rows = rows.where(F.col(KEY).isNull()).unionByName(rows.where(F.col(KEY).isNotNull()).withColumn(KEY + "_once", text).dropDuplicates(["doc_id", KEY + "_once"]).drop(KEY + "_once"))
        docs = cut(rows.select(*docs.columns, F.coalesce(KEY, F.lit(False)).alias(KEY)))
    else:
        docs = docs.withColumn(KEY, F.lit(False))
    with scratch(spark):
        classes = jaccard_join.similar_classes(docs.where(~F.col(KEY)))
        dropped = cut(classes.where("class_id <> doc_id").select("doc_id", F.lit(False).alias(KEY)), keep=True)
    return docs.join(small(dropped), ["doc_id", KEY], "left_anti").select([c for c in docs.columns if c != KEY])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words a twentieth or more lies in benchmark windows.

    Null and empty texts have no words and stay, as do rows with a null id that are clean. Rows repeated with id and text stay
    or go together. An empty table stays empty. docs may have columns of any name.
    """
    keyed = _keyed(docs)
    with scratch(spark):
        found = decontamination.contamination(keyed, read_table(spark, sf_dir, "benchmark"), id_col=KEY)
        bad = cut(decontamination.verdicts(found).where("contaminated").select(F.col("doc_id").alias(KEY)).distinct(), keep=True)
    return keyed.join(small(bad), KEY, "left_anti").select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every span of personal data by its kind in brackets; n_chars follows.

    All rows stay. Null texts stay null; texts without spans, and their n_chars, stay as they are. Repeated rows are redacted
    each. An empty table stays empty. docs may have columns of any name, and n_chars may be missing.
    """
    keyed = _keyed(docs)
    with scratch(spark):
        found = pii.detect(keyed, id_col=KEY).where(F.size("spans") > 0)
        found = cut(found.select(F.col("doc_id").alias(KEY), F.col("spans").alias(SPANS)).dropDuplicates([KEY]), keep=True)
    told = keyed.join(small(found), KEY, "left")
    text = F.when(F.col(SPANS).isNotNull(), pii.redact(F.col("text"), F.col(SPANS))).otherwise(F.col("text"))
    told = told.withColumn("text", text)
    if "n_chars" in docs.columns:
        told = told.withColumn("n_chars", F.when(F.col(SPANS).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return told.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their token ids, each placed in a sequence.

    Null and empty texts are a piece of one id each. Rows with a null id, and repeated rows, are packed each. An empty table has no
    pieces. Columns other than doc_id and text are left out.
    """
    return packing.pack(docs)
