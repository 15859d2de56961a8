"""A corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing to target weights, and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. run()
writes each stage's result as Parquet and reads it again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import line_dedup, mixing, near_dedup, packing, quality_rules
from weftline.llm.shared import documents, dropped, written


def _apart(docs: DataFrame, *used: str) -> DataFrame:
    """docs with all columns but the used ones under names that no operator gives, so that none is taken for a result."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in used else f"__wl_{i}") for i, c in enumerate(docs.columns)])


def _back(df: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of docs again, from a frame derived from _apart()."""
    return df.select(*[F.col(c if c in used else f"__wl_{i}").alias(c) for i, c in enumerate(docs.columns)])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the quality model stay; null and empty texts fail. Repeated rows and null
    ids are judged by their texts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    scored = quality_rules.score(_apart(docs, "doc_id", "text"), quality_rules.fit(docs, labels))
    return _back(scored.where("kept"), docs, "doc_id", "text")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source, and n_chars in step with them; all documents stay. A null text
    stays null, with n_chars null; one that loses all its lines becomes empty. A null source is a source; repeated rows
    count as pages each."""
    used = ("source", "text", "n_chars")
    out = line_dedup.drop_lines(_apart(docs, *used), "source", "text")
    return _back(out.withColumn("n_chars", F.char_length("text").cast("long")), docs, *used)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): the one with the least doc_id.

    Rows with one doc_id are one document: the row whose text has the least hash. Rows without a doc_id can't be told
    apart and are passed on.
    """
    found = near_dedup.near_components(docs, "doc_id", "text")
    by_id = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    apart = written(by_id.where("NOT kept OR n > 1").select("doc_id", "kept"), "not-kept-or-repeated")
    few = F.broadcast(apart) if apart.count() <= near_dedup.MOST_BROADCAST else apart
    out = docs.join(few.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    repeated = apart.where("kept").select("doc_id")
    if repeated.isEmpty():
        return out
    again, columns = docs.join(repeated, "doc_id", "left_semi"), [F.col(f"`{c}`") for c in docs.columns]
    hashed = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    first = again.groupBy("doc_id").agg(F.min_by(F.struct(*columns), F.struct(F.xxhash64("text"), "text", hashed)).alias("__wl_row"))
    return out.union(first.select("__wl_row.*"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (0 to 2 times, a part of one rounded); null and wordless texts go.

    Each row counts by itself: rows of one id, or without one, are taken each by their own source's quota.
    """
    mixed = mixing.mixed_rows(docs, "doc_id", mixing.n_words(F.col("text")), F.array("source"))
    times = F.floor(F.col("__taken") / F.col("__size") + 0.5).cast("int")
    used = mixed.where("__size > 0").withColumn("__times", times).where("__times > 0")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return used.select(*columns, F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__use")).select(*columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 1024 ids, in document order, null ids first. A null or empty text is its end
    id; repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_stage), ("line dedup", line_stage), ("near dedup", near_stage), ("mixing", mix_stage), ("packing", pack_stage)]

#: A learned model, sketches and a tokenizer can't be put in SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if last is not None:
            dropped(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
