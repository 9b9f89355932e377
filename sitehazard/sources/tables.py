"""Stored tables: Parquet folders, snapshots, per-location scans, loads."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from sitehazard.config import DEFAULT_SIZING, WEATHER_PROVIDER
from sitehazard.functions.text import refresh_stamp, slug
from sitehazard.operators.skew import HotKeys, join_few
from sitehazard.schemas import align_to_table
from sitehazard.session import settle_measured

BUCKETS = 256
#: What ``store`` adds by name to each row.
LAYOUT = ["location_slug", "location_hash", "location_bucket"]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a folder, wherever the path points."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def bucket_of(location_slug: Column) -> Column:
    return F.pmod(F.xxhash64(location_slug), F.lit(BUCKETS)).cast("int")


def store(
    df: DataFrame,
    path: str,
    snapshot: int | str,
    name: str | None = "location_name",
    finish: Callable[[DataFrame], DataFrame] | None = None,
) -> str:
    """Write one snapshot of a table, laid out for per-location reads.

    A folder per location would mean millions of folders, so locations share a fixed number of
    bucket folders by a hash of their slug. Within one, files are sorted by that hash, so the
    statistics of their row groups, each a narrow range of it, skip all but a location's own.
    ``rebalance`` splits the bucket of a very large location over several files and keeps small
    ones whole. Writing the same snapshot again replaces it, so a retried job is harmless.

    ``finish`` adds what follows from each row alone once the rows lie in order, so that it is
    neither moved nor sorted; it keeps the ``LAYOUT`` columns.
    """
    target = f"{path}/snapshot={snapshot}"
    if name is None:
        df.write.mode("overwrite").parquet(target)
        return target
    slugged = df.withColumn("location_slug", slug(F.col(name)))
    laid = slugged.withColumn("location_hash", F.xxhash64("location_slug")).withColumn(
        "location_bucket", bucket_of(F.col("location_slug"))
    )
    ordered = laid.hint("rebalance", "location_bucket").sortWithinPartitions("location_bucket", "location_hash")
    whole = ordered if finish is None else finish(ordered)
    whole.write.mode("overwrite").partitionBy("location_bucket").parquet(target)
    return target


def latest_snapshot(
    df: DataFrame, key: str | None = None, snapshot: str = "snapshot", hot: HotKeys | None = None
) -> DataFrame:
    """Rows of the newest snapshot: of the whole table, or of each key's own newest."""
    if key is None:
        newest = df.agg(F.max(snapshot).alias(snapshot))
        return df.join(F.broadcast(newest), snapshot, "left_semi")
    newest = df.groupBy(key).agg(F.max(snapshot).alias("_newest"))
    return join_few(df, newest, [key], hot).where(F.col(snapshot) == F.col("_newest")).drop("_newest")


def scan_location(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """A location's rows, reading only its bucket folder and hash; without a name the whole table.

    The name's slug and hash are constants that the optimizer folds, so both filters reach the scan.
    """
    table = spark.read.parquet(path)
    if name is None:
        return table
    wanted = F.lit(name.lower().replace(" ", "_").translate(str.maketrans("", "", ",()")))
    return table.where(
        (F.col("location_bucket") == bucket_of(wanted))
        & (F.col("location_hash") == F.xxhash64(wanted))
        & (F.col("location_slug") == wanted)
    )


def newest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a stored table's newest snapshot, found by its folders' names alone.

    Numbers compare as numbers, other names (dates) as text. Folders without a snapshot are left out.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/snapshot=*")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in files.globStatus(folder) or []]
    values = [unquote(name.split("=", 1)[1]) for name in names]
    table = spark.read.parquet(path)
    if not values:
        return table
    newest = max(values, key=lambda v: (v.lstrip("-").isdigit(), int(v) if v.lstrip("-").isdigit() else 0, v))
    kind = table.schema["snapshot"].dataType
    return table.where(F.col("snapshot") == F.lit(newest).cast(kind))


def load(df: DataFrame, path: str, table: str) -> int:
    """Replace a table's rows by the given ones in its schema; gives their number.

    The rows are written beside the table and counted as they are, in one job. If there are any,
    they take its place; empty input changes nothing.
    """
    spark, beside = df.sparkSession, f"{path}.loading"
    counted = Observation()
    rows = align_to_table(df, table).observe(counted, F.count(F.lit(1)).alias("rows"))
    rows.write.mode("overwrite").parquet(beside)
    loaded = counted.get["rows"]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target, source = hadoop.Path(path), hadoop.Path(beside)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if loaded:
        files.delete(target, True)
        files.rename(source, target)
    else:
        files.delete(source, True)
    return loaded


def enrich(df: DataFrame, provider: str = WEATHER_PROVIDER) -> DataFrame:
    """Columns a load adds. The location id of the rows is kept where they have one."""
    added = {"source_name": F.lit(provider), "ingestion_ts": F.current_timestamp()}
    if "location_id" not in df.columns:
        added["location_id"] = F.lit(1).cast("bigint")
    return df.withColumns(added)


def insert_missing(existing: DataFrame, new: DataFrame, key: str = "location_id") -> DataFrame:
    """The existing rows and those new ones whose key is not there yet."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"))


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def query(spark: SparkSession, sql: str) -> DataFrame:
    """Ad-hoc SQL over the registered tables."""
    return spark.sql(sql)


def last_refresh(spark: SparkSession, path: str) -> DataFrame:
    """When each location's rows were last written."""
    table = spark.read.parquet(path).select(
        "location_slug", F.col("_metadata.file_modification_time").alias("at")
    )
    return table.groupBy("location_slug").agg(F.max("at").alias("at")).select(
        "location_slug", "at", refresh_stamp(F.col("at")).alias("formatted")
    )


def newest_first(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.orderBy(F.col(ts).desc())


def latest_per(df: DataFrame, key: str, ts: str, tie: str | None = None) -> DataFrame:
    """The last row of every key by time; pre-ranked before the shuffle."""
    order = [F.col(ts).desc()] + ([F.col(tie).desc()] if tie else [])
    ranked = df.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("_nth = 1").drop("_nth")


def newest_rows(
    df: DataFrame, key: str, ts: str, most: int, limit: int = DEFAULT_SIZING.rows_per_task
) -> DataFrame:
    """The last rows of every key by time, ``most`` at most.

    Only keys and times are ranked, which gives the time that the newest rows of each key with
    more than ``most`` begin at. Whole rows are kept by that and stay where they are. They are
    ranked themselves, and cut before the shuffle as well, where some of a key have the very time
    that it is cut at, or where more than ``limit`` keys are to be cut.
    """
    newest = Window.partitionBy(key).orderBy(F.col(ts).desc())

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_nth", F.row_number().over(newest)).where(F.col("_nth") <= most).drop("_nth")

    times = df.select(key, ts).withColumn("_nth", F.row_number().over(newest))
    ends = times.where(F.col("_nth").between(most, most + 1)).groupBy(F.col(key).alias("_key"))
    cuts = ends.agg(
        F.max(F.when(F.col("_nth") == most, F.col(ts))).alias("_from"),
        F.max(F.when(F.col("_nth") > most, F.col(ts))).alias("_after"),
        F.count("*").alias("_ends"),
    ).where("_ends = 2")
    cuts = cuts.select("_key", "_from", F.expr("_from <=> _after").alias("_tied"))
    cuts, size = settle_measured(cuts, "newest-from", keys=F.count(F.lit(1)), tied=F.count_if("_tied"))
    if not size["keys"]:
        return df
    if size["keys"] > limit:
        return ranked(df)
    met = df.join(F.broadcast(cuts), F.col(key).eqNullSafe(F.col("_key")), "left")
    kept = met.where(F.col("_tied").isNull() | F.col("_from").isNull() | (F.col(ts) >= F.col("_from")))
    kept = kept.select(*[F.col(f"`{c}`") for c in df.columns])
    return ranked(kept) if size["tied"] else kept
