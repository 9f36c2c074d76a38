"""Reading, caching and checking panel tables."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.schema import FEATURES, INDEX, RESPONDERS, SERVICE_COLUMNS


def scan_panel(
    spark: SparkSession, path: str, schema: T.StructType | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """Lazy, column-pruned scan. Pass the schema so that partition columns keep their width."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def read_small_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def table_is_complete(spark: SparkSession, path: str) -> bool:
    """A folder counts as written only once its job has committed."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker))


def _refuse_foreign(spark: SparkSession, path: str, partition: str) -> None:
    """Stop before overwriting a folder with anything but partitions of the same column and files of an unfinished write."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    foreign = [n for n in names if not n.startswith((f"{partition}=", "_", "."))]
    if foreign:
        raise FileExistsError(f"{path} holds {foreign[0]}, which is no part of this table; not overwritten")


def write_partitioned_cache(df: DataFrame, path: str, partition: str = "date_id", level: int = 11) -> DataFrame:
    """Write once, partitioned by date and zstd-compressed, and return a scan of the table.

    Rebalancing keeps each date in few files and splits a date that holds too many rows for
    one task. A folder left by a job that died is overwritten; a finished one is kept. A folder
    that holds anything else stops the write.
    """
    spark = df.sparkSession
    schema = df.schema
    if not table_is_complete(spark, path):
        _refuse_foreign(spark, path, partition)
        (
            df.hint("rebalance", partition)
            .write.mode("overwrite")
            .partitionBy(partition)
            .option("compression", "zstd")
            .option("parquet.compression.codec.zstd.level", str(level))
            .parquet(path)
        )
    return scan_panel(spark, path, schema).select(*schema.names)


def write_bucketed_cache(
    df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], buckets: int, level: int = 11
) -> DataFrame:
    """Write once, hashed by ``keys`` into ``buckets`` sorted files, and return a table that knows it.

    Aggregates, windows and joins on the keys then need no shuffle of this side. The table is registered in the session's
    catalog under a name made from the folder; a folder that another session has finished is registered as it is.
    The number of buckets is part of the folder, so that a different number is a different table.
    """
    spark, schema = df.sparkSession, df.schema
    where = f"{path.rstrip('/')}-{buckets}-buckets"
    name = f"tickloom_{hashlib.sha256(where.encode()).hexdigest()[:16]}"
    quoted = lambda names: ", ".join(f"`{c}`" for c in names)
    if not table_is_complete(spark, where):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        (
            df.repartition(buckets, *keys)
            .write.mode("overwrite")
            .format("parquet")
            .bucketBy(buckets, *keys)
            .sortBy(*order)
            .option("compression", "zstd")
            .option("parquet.compression.codec.zstd.level", str(level))
            .option("path", where)
            .saveAsTable(name)
        )
    elif not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({quoted(keys)}) SORTED BY ({quoted(order)}) INTO {buckets} BUCKETS LOCATION '{where}'")
    return spark.table(name)


def schema_contract(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """One row per position where the ordered column list differs from the expected one."""
    actual, expected = df.columns, list(expected)
    n = max(len(actual), len(expected))
    at = lambda names, i: names[i] if i < len(names) else None
    rows = [(i, at(expected, i), at(actual, i)) for i in range(n) if at(actual, i) != at(expected, i)]
    return df.sparkSession.createDataFrame(rows, "position int, expected string, actual string")


def assert_contract(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    if df.columns != list(expected):
        raise ValueError(f"columns differ: {df.columns} instead of {list(expected)}")
    return df


def drop_service_columns(df: DataFrame, columns: Sequence[str] = SERVICE_COLUMNS) -> DataFrame:
    return df.drop(*columns)


def column_families(
    df: DataFrame, index: bool = True, features: Sequence[str] = FEATURES, responders: Sequence[str] = RESPONDERS
) -> DataFrame:
    return df.select(*(INDEX if index else []), *features, *responders)


def served_test(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Rows as they are served for prediction, numbered inside each (date, time) batch."""
    from tickloom.operators.select import row_index

    return row_index(df.withColumn("is_scored", F.lit(True)), ["date_id", "time_id"], "symbol_id").select(
        "row_id", *INDEX, "weight", "is_scored", *features
    )


def served_lags(df: DataFrame, responders: Sequence[str] = RESPONDERS) -> DataFrame:
    """All responders of calendar date d−1 relabelled as d, for each d that has a slot 0."""
    from tickloom.operators.select import in_dates

    day_type = df.schema["date_id"].dataType
    previous = df.select(
        (F.col("date_id") + 1).cast(day_type).alias("date_id"),
        "time_id",
        "symbol_id",
        *[F.col(c).alias(f"{c}_lag_1") for c in responders],
    )
    return in_dates(previous, df.where(F.col("time_id") == 0).select("date_id"))
