"""A training-data pipeline of five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a table; all but the last return the
columns of ``documents``. Each works on all that its predecessor kept:

1. quality rules: failing lines are removed from the texts, rejected documents go;
2. n-gram Jaccard join: of each group of near copies (five-word n-grams, 80 percent) the
   document of the least id stays; documents without any word are no copies of each other
   and all stay; rows that share an id are documents of their own, rows without one come last;
3. benchmark decontamination: documents holding a window of a benchmark item go;
4. mixing: documents are drawn so that the labelled domains' token shares meet their targets;
   rates above one give a document as several rows, also after stage 2 left one of its group;
5. sharding: the slot and shard of each document are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lifeline.llm import decontaminate, mixing, ngram_join, quality_rules, sharding
from lifeline.llm.queries import DOMAINS, HEADROOM, SHARDS, SHARES
from lifeline.llm.store import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No SQL states the classifier and the rates of stage 4; tests check run() stage by stage.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(docs.select(*COLUMNS)).where("kept")
    return judged.select("doc_id", F.col("clean_text").alias("text"), "lang", "source",
                         F.length("clean_text").cast("long").alias("n_chars"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # A row is known by its id and 128 bits of its text's hashes, so rows that share an id are told apart.
    place = ["_none", "_id", "_hash", "_more"]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*COLUMNS, F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("_id"),
                       F.xxhash64(text).alias("_hash"), F.xxhash64(F.lit("more"), text).alias("_more"))
    groups = ngram_join.similar_groups(rows, n=5, percent=80, carry=tuple(place))
    least = groups.where("group IS NOT NULL").groupBy("group").agg(F.min(F.struct(*place)).alias("first")).select("first.*")
    stays = Scratch(spark, "groups").keep(least, "stays")
    # What stays grows with the documents: never a broadcast, at any size.
    worded = text.rlike(r"[^\x20\x09-\x0D]")
    kept = rows.where(worded).join(stays.hint("merge"), place, "left_semi")
    # Equal rows (id and text) are one document; the join has brought them together.
    kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy(*place).orderBy("n_chars"))).where("_n = 1")
    return kept.select(*COLUMNS).unionByName(rows.where(~worded).select(*COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_items(docs.select(*COLUMNS), benchmark, n=10).where("n_hit = 0").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = mixing.train(docs, labels, ("quality", "toxic"), DOMAINS)
    return mixing.drawn(mixing.mix(docs.select(*COLUMNS), model, SHARES, headroom=HEADROOM, keep_text=True)).select(*COLUMNS)


def placed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.place(docs.select(*COLUMNS), SHARDS)


STAGES = [
    ("quality_rules", clean),
    ("ngram_join", one_of_each_group),
    ("decontaminate", without_benchmark),
    ("mixing", mixed),
    ("sharding", placed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's rows are written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
