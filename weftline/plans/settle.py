"""Tables that several steps of a plan read are computed once and cut off from what they were made of."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Tables of so many rows at most are sent to all tasks.
FEW = 1 << 15


def settled(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder that the session names in spark.checkpoint.dir.

    Later steps plan and read from there, so that neither plans nor recomputation pile up, and lost executors cost no
    more than the files' reading. Where the session names no folder, a local master gets a temporary one of its machine
    and a cluster one in the warehouse, which its executors share.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        alone = context.master.split("[")[0] == "local"
        context.setCheckpointDir(named or (tempfile.mkdtemp(prefix="weftline-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/weftline-checkpoints"))
    return df.checkpoint()


def few(df: DataFrame) -> DataFrame:
    """df settled, and marked to be sent to all tasks if it turns out to have FEW rows: joins then deal out no other rows
    by keys that many of them share."""
    out = settled(df)
    return F.broadcast(out) if out.count() <= FEW else out


def local_rows(spark: SparkSession, rows: Iterable[tuple], ddl: str) -> DataFrame:
    """The driver's own rows as a table of known size, so that joins send it to all tasks; no Python worker reads it."""
    schema, rows = T.StructType.fromDDL(ddl), list(rows)
    kinds = to_arrow_schema(schema)
    arrays = [pa.array([r[i] for r in rows], type=kinds.field(i).type) for i in range(len(schema.fields))]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=kinds), schema)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores: a small file of many rows is a task or two, whatever is computed of them."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)
