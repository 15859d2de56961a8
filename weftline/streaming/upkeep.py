"""Snapshots and decisions that arrive over time, kept as tables by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Parts of a table, by hash of the key: a micro-batch rewrites those that its keys lie in.
PARTS = 64


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of each key with the highest version; of equal ones the greatest content. Partial maxima are combined."""
    best = F.max_by(F.struct(*rows.columns), F.struct(version, F.to_json(F.struct(*rows.columns))))
    return rows.groupBy(F.col(key).alias("__key")).agg(best.alias("__row")).select("__row.*")


def _names(spark: SparkSession, pattern: str) -> list:
    """Paths on the table's store that fit a pattern."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(str(s.getPath()) for s in store.globStatus(where) or [])


def _places(spark: SparkSession, path: str, below: int | None = None) -> dict[int, list[str]]:
    """Folders of each part, oldest first, of finished batches (before batch `below`, if given)."""
    done = [x.rsplit("/", 1)[0] for x in _names(spark, f"{path}/v=*/_SUCCESS")]
    done = {x for x in done if below is None or int(x.rsplit("=", 1)[1]) < below}
    out: dict[int, list[str]] = {}
    for place in _names(spark, f"{path}/v=*/part=*"):
        batch, part = place.rsplit("/", 1)
        if batch in done:
            out.setdefault(int(part[5:]), []).append(place)
    return out


def upsert(batch: DataFrame, path: str, batch_id: int, key: str, version: str) -> None:
    """Merges a micro-batch into the table at path: the parts that its keys lie in are written anew, in the batch's folder.

    A batch that comes again after a failure writes the same folder again. Readers use current(). Of a part that was
    written again, the state before the last one stays, for readers at work; older ones go.
    """
    spark = batch.sparkSession
    part = F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int").alias("part")
    batch = batch.select("*", part)
    touched = sorted(r["part"] for r in batch.select("part").distinct().collect())
    places = _places(spark, path, below=batch_id)
    held = [places[p][-1] for p in touched if p in places]
    rows = batch.drop("part")
    if held:
        rows = rows.unionByName(spark.read.schema(rows.schema).parquet(*held))
    out = latest(rows, key, version).select("*", part)
    out.repartition(max(1, min(len(touched), PARTS)), "part").write.partitionBy("part").mode("overwrite").parquet(f"{path}/v={batch_id:012d}")
    for p in touched:
        for old in places.get(p, [])[:-1]:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def current(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """The table's latest finished state (before batch `below`, if given), or None before the first row."""
    places = [found[-1] for found in _places(spark, path, below).values()]
    return spark.read.parquet(*places) if places else None


def keep_latest(stream: DataFrame, path: str, checkpoint: str, key: str, version: str, **trigger) -> StreamingQuery:
    """Starts a query that keeps the latest row of each key (of decisions, or of snapshot items)."""
    write = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, i: upsert(batch, path, i, key, version))
    return (write.trigger(**trigger) if trigger else write).start()
