"""Corpus pipeline over documents: quality rules, language, near copies, benchmark passages, packing.

``STAGES`` lists (name, function); each takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last keep the columns of ``docs``; rows only ever go, they don't change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.llm.common import few_files, shared_path, table, written
from mediasift.llm.decontamination import decontaminate, small
from mediasift.llm.language_id import held_out, identify, train
from mediasift.llm.ngram_jaccard import similarity_classes
from mediasift.llm.packing import pack_documents
from mediasift.llm.q_packing import tokenizer_path
from mediasift.llm.quality_rules import quality_rules

# Stages on word shingles: five words, a similarity of 0.8 or more.
WORDS, PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no base rule and no rule of the threshold table."""
    return quality_rules(docs, into="_quality").filter("_quality.kept").drop("_quality")


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier tells with an accepted score.

    It learns from the same rows of the whole table as query op8; what it rejects goes.
    """
    known = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(known.filter(~held_out(F.col("doc_id"), 4, 2)))
    return identify(docs, model, into="_lid").filter("_lid.accepted").drop("_lid")


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key ``_row`` of id and text: an id may repeat or be null, and then says nothing of the text."""
    c = F.col
    return docs.withColumn("_row", F.xxhash64(c("doc_id").isNull(), c("doc_id"), c("text").isNull(), c("text")))


def keep_one_of_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id (null ids last), and one of rows equal in id and text."""
    rows = _keyed(docs)
    classes = written(similarity_classes(rows.select("_row", "text"), ident="_row", k=WORDS, percent=PERCENT).select("_row", "component_id"), "classes")
    several = classes.groupBy("component_id").agg(F.min("_row").alias("lo"), F.max("_row").alias("hi")).filter("lo <> hi").select("component_id")
    several = written(few_files(several), "several")
    members = written(few_files(classes.join(small(several), "component_id").select("_row", "component_id").distinct()), "members")
    named = rows.select("_row", "doc_id").join(small(members), "_row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_row"))
    kept = written(few_files(named.groupBy("component_id").agg(first.alias("f")).select("component_id", F.col("f._row").alias("kept"))), "kept")
    others = written(members.join(small(kept), "component_id").filter("_row <> kept").select("_row"), "copies")
    # rows equal in id and text share a key; only their texts are shuffled
    again = small(written(few_files(classes.groupBy("_row").count().filter("count > 1").select("_row")), "repeated"))
    stay = rows.join(small(others), "_row", "left_anti")
    return stay.join(again, "_row", "left_anti").select(*docs.columns).unionByName(stay.join(again, "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, each row by its own text."""
    return decontaminate(_keyed(docs), table(spark, sf_dir, "benchmark"), doc_id="_row", k=WORDS, threshold=PERCENT / 100).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in a sequence."""
    return pack_documents(docs, tokenizer_path())


# Rows in an Arrow batch, Spark's setting while the stages run: a task holds a batch of whole texts several times,
# in the JVM and in Python workers, which keep their memory from one stage to the next.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000

STAGES = [
    ("quality rules", keep_quality),
    ("language ID", keep_language),
    ("n-gram Jaccard join", keep_one_of_class),
    ("benchmark decontamination", drop_benchmark),
    ("best-fit packing", pack),
]

# A classifier and a tokenizer decide; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        for name, stage in STAGES:
            out = stage(spark, docs, sf_dir)
            path = shared_path(spark, name.replace(" ", "-"))
            out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    return docs
