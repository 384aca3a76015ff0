"""Duplicate secrets and clusters of detections that share something."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivet.functions.text import value_hash
from trivet.graph import components


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where that is unset one in the warehouse, unless that
    is local to each machine of a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        house = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if house.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = house + "/trivet-scratch"
    return base.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/core-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark_duplicates(detections: DataFrame, order_col: str, value_col: str = "matched_value") -> DataFrame:
    """``value_hash`` and ``is_duplicate``: whether an earlier row of the run has the value. The first row of each value
    is found by aggregation over a written table of two columns, so the values are made once more only where rows are marked, and a
    value of very many rows is no window of one task."""
    light = written(detections.select(value_hash(F.col(value_col)).alias("value_hash"), F.col(order_col).alias("_at")).filter("value_hash IS NOT NULL"))
    first = light.groupBy("value_hash").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    rows = detections.withColumn("value_hash", value_hash(F.col(value_col)))
    return rows.join(first, "value_hash", "left").withColumn("is_duplicate", F.coalesce(F.col(order_col) > F.col("_first"), F.lit(False))).drop("_first")


def duplicate_groups(detections: DataFrame, value_col: str = "matched_value") -> DataFrame:
    """``value_hash, n, owners, files`` of values that occur more than once."""
    rows = detections.withColumn("value_hash", value_hash(F.col(value_col))).filter("value_hash IS NOT NULL")
    out = rows.groupBy("value_hash").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("owner").alias("owners"), F.countDistinct("file_path").alias("files"))
    return out.filter("n > 1")


def entity_clusters(detections: DataFrame, id_col: str, keys: tuple[str, ...]) -> DataFrame:
    """``id, cluster``: the smallest id among detections that are joined by equal values of any of ``keys`` (nulls join
    nothing). Each detection is linked with the smallest id that has its value, and links are contracted until every
    cluster has come to rest, however long its chains are."""
    pairs = None
    for k in keys:
        part = detections.filter(F.col(id_col).isNotNull() & F.col(k).isNotNull()).select(F.col(id_col).alias("id"), F.concat(F.lit(f"{k}="), F.col(k).cast("string")).alias("value"))
        pairs = part if pairs is None else pairs.unionByName(part)
    pairs = written(pairs.distinct())
    least = pairs.groupBy("value").agg(F.min("id").alias("least"))
    found = components(pairs.join(least, "value").select(F.col("id").alias("a"), F.col("least").alias("b")), written)
    ids = detections.select(F.col(id_col).alias("id")).distinct()
    return ids.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
