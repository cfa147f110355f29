"""Sinks. All of them can be replayed: a second run with the same input changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.dates import month_key
from tidemark.functions.ids import content_hash
from tidemark.operators import history

#: Rows of one file of a month, about.
FILE_ROWS = 5_000_000
VOLATILE = ("run_id", "run_status", "quality_gate", "generated_at", "build_id")


class NotFiniteError(ValueError):
    pass


def assert_finite(df: DataFrame) -> DataFrame:
    """``df``, if none of its floating columns has a NaN or an infinity; raises before anything is written."""
    columns = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    if columns:
        bad = df.agg(*[F.count_if(F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).alias(c) for c in columns]).first()
        if found := [c for c in columns if bad[c]]:
            raise NotFiniteError(f"not finite: {', '.join(found)}")
    return df


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_months(rows: DataFrame, path: str) -> list[str]:
    """Merge ``rows`` into the month-partitioned history at ``path`` and rewrite only the months that gain rows; returns those months. A
    conflict or a value that is not finite raises before any write. An identity has a date, so only the months of ``rows`` are read."""
    spark = rows.sparkSession
    incoming = assert_finite(rows.select(*history.OBSERVATION))
    if not exists(spark, path):
        existing = spark.createDataFrame([], incoming.schema)
    else:
        mine = [r["month"] for r in incoming.select(month_key(F.col("obs_date")).alias("month")).distinct().collect()]  # a row per month
        existing = spark.read.parquet(path).where(F.col("month").isin(mine)).select(*history.OBSERVATION)
    # one aggregate by identity finds conflicts and what is new; it is written beside the history, as it is asked for several times
    side = lambda df, n: df.select(*history.OBSERVATION, F.lit(n).alias("side"), history.payload_hash().alias("payload"))
    groups = side(existing, 0).unionByName(side(incoming, 1)).groupBy(*history.IDENTITY).agg(
        F.min("side").alias("least_side"), (F.min("payload") != F.max("payload")).alias("conflict"), *[F.first(c).alias(c) for c in history.PAYLOAD]
    )
    judged = f"{path.rstrip('/')}_fresh"
    groups.where("conflict or least_side = 1").write.mode("overwrite").parquet(judged)
    judged = spark.read.parquet(judged)
    if found := judged.where("conflict").select(*history.IDENTITY).first():
        raise history.ConflictError(f"identity with several payloads: {found.asDict()}")
    fresh = judged.select(*history.OBSERVATION)
    months = [r["month"] for r in fresh.select(month_key(F.col("obs_date")).alias("month")).distinct().collect()]  # a row per touched month
    if months:
        whole = existing.unionByName(fresh).withColumn("month", month_key(F.col("obs_date"))).where(F.col("month").isin(months))
        # the touched months are read and replaced at once, so what replaces them is written beside them first
        staged = f"{path.rstrip('/')}_staged"
        # a month of many rows is dealt to several tasks and files by its series, which stay together
        parts = {r["month"]: -(-r["count"] // FILE_ROWS) for r in whole.groupBy("month").count().collect()}  # a row per touched month
        dealt = F.pmod(F.xxhash64("entity", "period"), F.create_map(*[F.lit(x) for m in parts.items() for x in m])[F.col("month")])
        whole = whole.repartition(sum(parts.values()), "month", dealt)
        whole.sortWithinPartitions("month", "obs_date", "entity", "period", "update_time").write.mode("overwrite").parquet(staged)
        spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    return sorted(months)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def moved(spark: SparkSession, source: str, target: str) -> None:
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    if not a.getFileSystem(spark._jsc.hadoopConfiguration()).rename(a, b):
        raise OSError(f"{source} could not be renamed to {target}")


def materialize(rows: DataFrame, path: str) -> None:
    """Write a runtime table in canonical order after all of it was validated: beside the table there is, which is swapped for it at the end. A run that
    failed leaves the table as it was, or, between the two renames, beside its place, from where the next run takes it back."""
    spark, place = rows.sparkSession, path.rstrip("/")
    following, previous = f"{place}_next", f"{place}_previous"
    if exists(spark, previous):
        if exists(spark, place):
            remove(spark, previous)
        else:
            moved(spark, previous, place)
    assert_finite(rows).sortWithinPartitions(*history.canonical_order(rows)).write.mode("overwrite").parquet(following)
    if exists(spark, place):
        moved(spark, place, previous)
    moved(spark, following, place)
    remove(spark, previous)


def append_events(events: DataFrame, path: str) -> int:
    """Append the events whose ``event_id`` isn't there yet, once each; returns how many. The log is kept by the day of ``update_time``, which is part of an
    event's identity, so that only the days of the batch are read; events without a time have a day of their own."""
    spark = events.sparkSession
    day = F.lit("none")
    if "update_time" in events.columns:
        day = F.coalesce(F.date_format(F.try_to_timestamp(F.col("update_time").cast("string")), "yyyy-MM-dd"), day)
    fresh = events.dropDuplicates(["event_id"]).withColumn("day", day)
    if exists(spark, path):
        days = [r["day"] for r in fresh.select("day").distinct().collect()]  # a row per day of the batch
        there = spark.read.schema(fresh.schema).parquet(path).where(F.col("day").isin(days)).select("event_id", "day")
        fresh = fresh.join(there, ["event_id", "day"], "left_anti")
    fresh = fresh.cache()
    try:
        n = fresh.count()
        if n:
            fresh.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)
        return n
    finally:
        fresh.unpersist()


def stripped(df: DataFrame, volatile: tuple[str, ...] = VOLATILE) -> DataFrame:
    """``df`` without the volatile fields at any depth: in structs, arrays and maps inside each other, also as keys of maps. A struct that has no other
    fields goes as a whole."""

    def emptied(kind) -> bool:
        if isinstance(kind, T.ArrayType):
            return emptied(kind.elementType)
        return isinstance(kind, T.StructType) and all(f.name in volatile or emptied(f.dataType) for f in kind)

    def nested(kind) -> bool:
        return isinstance(kind, T.StructType | T.MapType) or isinstance(kind, T.ArrayType) and nested(kind.elementType)

    def rebuilt(column, kind):
        if isinstance(kind, T.StructType):
            return F.when(column.isNotNull(), F.struct(*[rebuilt(column[f.name], f.dataType).alias(f.name) for f in kept(kind)]))
        if isinstance(kind, T.ArrayType) and nested(kind.elementType):
            return F.transform(column, lambda x: rebuilt(x, kind.elementType))
        if isinstance(kind, T.MapType):
            if isinstance(kind.keyType, T.StringType):
                column = F.map_filter(column, lambda k, _: ~k.isin(*volatile))
            if nested(kind.valueType) and not emptied(kind.valueType):
                return F.transform_values(column, lambda _, v: rebuilt(v, kind.valueType))
        return column

    kept = lambda fields: [f for f in fields if f.name not in volatile and not emptied(f.dataType)]
    return df.select(*[rebuilt(F.col(f.name), f.dataType).alias(f.name) for f in kept(df.schema)])


def quarantine(rejected: DataFrame, path: str) -> int:
    """Keep rejected snapshots under the hash of their content: identical ones collapse, different ones never overwrite each other."""
    spark = rejected.sparkSession
    keyed = stripped(rejected).withColumn("content_hash", content_hash(*stripped(rejected).columns)).dropDuplicates(["content_hash"])
    if exists(spark, path):
        keyed = keyed.join(spark.read.parquet(path).select("content_hash"), "content_hash", "left_anti")
    n = keyed.count()
    if n:
        keyed.write.mode("append").parquet(path)
    return n


def export(datasets: dict[str, DataFrame], path: str, build_id: str, form: str = "parquet") -> None:
    """Write each dataset below ``path``, every row stamped with the build it belongs to."""
    for name, df in datasets.items():
        assert_finite(df).withColumn("build_id", F.lit(build_id)).write.mode("overwrite").format(form).save(f"{path}/{name}")


def nested_export(rows: DataFrame) -> DataFrame:
    """Chart series per entity as slot to points, for export only."""
    points = rows.groupBy("entity", "slot").agg(F.array_sort(F.collect_list(F.struct("obs_date", "value"))).alias("points"))
    return points.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("slot", "points"))).alias("series"))


def daily_summary(entities: DataFrame, day: str) -> DataFrame:
    """One row per entity and day: fresh values, or flagged ones of the last known good."""
    return entities.select(F.to_date(F.lit(day)).alias("day"), "entity", *[c for c in entities.columns if c not in ("entity", "badge")], F.coalesce("badge", F.lit("FRESH")).alias("state"))
