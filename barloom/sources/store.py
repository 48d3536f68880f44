"""The canonical store: one partitioned dataset with a metadata table, an append-only registry and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_SCHEMA = T.StructType([T.StructField("series_id", T.StringType()), T.StructField("date", T.DateType())]
                          + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "adj_close", "volume", "dollar_volume")])


def write_dataset(df: DataFrame, root: str, kind: str, provider: str, key: str = "series_id", mode: str = "append") -> None:
    """Write rows clustered by series (so a key read touches few row groups) and append one metadata row per series."""
    df.repartition(key).sortWithinPartitions(key, "date").withColumn("kind", F.lit(kind)).write.mode(mode).partitionBy("kind").parquet(f"{root}/data")
    cols = [c for c in df.columns if c not in (key,)]
    meta = df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"),
                                                   F.hex(F.bit_xor(F.xxhash64(*cols))).alias("digest"))
    meta.withColumns({"kind": F.lit(kind), "provider": F.lit(provider)}).write.mode(mode).parquet(f"{root}/meta")


def read_dataset(spark: SparkSession, root: str, kind: str, schema: T.StructType, keys: list[str] | None = None, key: str = "series_id") -> DataFrame:
    """One kind of the store, optionally for named keys; a missing key fails the query."""
    df = spark.read.schema(T.StructType([*schema.fields, T.StructField("kind", T.StringType())])).parquet(f"{root}/data").where(F.col("kind") == kind).drop("kind")
    if keys is None:
        return df
    have = available(spark, root, kind)
    asked = F.array(*[F.lit(k) for k in keys])
    gone = have.agg(F.collect_set(F.when(F.col("key").isin(keys), F.col("key"))).alias("_h")).select(F.array_except(asked, "_h").alias("_g"))
    guard = gone.select(F.when(F.size("_g") > 0, F.raise_error(F.concat(F.lit("missing datasets: "), F.array_join("_g", ","))).cast("boolean")).otherwise(F.lit(True)).alias("_ok"))
    return df.where(F.col(key).isin(keys)).join(F.broadcast(guard)).where("_ok").drop("_ok")


def available(spark: SparkSession, root: str, kind: str) -> DataFrame:
    return spark.read.parquet(f"{root}/meta").where(F.col("kind") == kind).select("key").distinct()


def coverage_summary(spark: SparkSession, root: str) -> DataFrame:
    """Span, rows and provider per kind and key."""
    return spark.read.parquet(f"{root}/meta").groupBy("kind", "key").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("rows").alias("rows"), F.min("provider").alias("provider"))


def dataset_fingerprint(coverage: DataFrame, length: int = 16) -> DataFrame:
    """A hash over the coverage that does not depend on row order: per-row digests combined by count, sum and exclusive or."""
    h = F.xxhash64("kind", "key", "first", "last", "rows")
    c = coverage.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(2**31 - 1))).alias("s"))
    return c.select(F.substring(F.sha2(F.concat_ws("|", "n", "x", "s"), 256), 1, length).alias("fingerprint"), F.col("n").alias("datasets"))


def append_registry(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def load_registry(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_curves(curves: DataFrame, path: str) -> None:
    """One curve table partitioned by family, clustered by strategy."""
    curves.repartition("family", "strategy").sortWithinPartitions("strategy", "date").write.mode("append").partitionBy("family").parquet(path)


def load_curves(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    return spark.read.parquet(path).join(ids.select("strategy").distinct(), "strategy", "left_semi")


def write_report(df: DataFrame, path: str) -> None:
    """Small result tables as one CSV (with header) and as Parquet."""
    # A shuffle into one file: only the finished rows meet in one task, not the work that makes them.
    df.repartition(1).write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
    df.write.mode("overwrite").parquet(f"{path}/parquet")
