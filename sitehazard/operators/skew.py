"""Keys too large for one task: finding them, joining on them, cutting their series."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from sitehazard.session import settle


@dataclass(frozen=True)
class HotKeys:
    """Keys holding more than ``limit`` rows, with their row counts.

    There are at most rows / limit of them, so ``table`` is always small enough to broadcast.
    """

    keys: tuple[str, ...]
    limit: int
    table: DataFrame


def hot_keys(df: DataFrame, keys: str | list[str], limit: int) -> HotKeys | None:
    """Measure the key sizes with one pre-aggregated pass; None when every key is small."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    large = df.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > limit)
    if large.isEmpty():
        return None
    return HotKeys(tuple(keys), limit, settle(large, "hot-keys"))


def join_spread(
    many: DataFrame, few: DataFrame, hot: HotKeys | None, how: str = "inner"
) -> DataFrame:
    """Join a skewed side with a side that has few rows per key, on ``hot.keys``.

    The rows of a hot key are dealt over as many parts as the key needs, and its few partners
    are repeated once per part. Every other key keeps a single part.
    """
    keys = list(hot.keys)
    parts = F.broadcast(
        hot.table.select(*keys, F.ceil(F.col("_rows") / hot.limit).cast("int").alias("_parts"))
    )
    row = F.xxhash64(*[F.col(f"`{c}`") for c in many.columns if c not in keys])
    dealt = (
        many.join(parts, keys, "left")
        .withColumn("_part", F.coalesce(F.pmod(row, F.col("_parts")).cast("int"), F.lit(0)))
        .drop("_parts")
    )
    repeated = (
        few.join(parts, keys, "left")
        .withColumn(
            "_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts") - 1, F.lit(0))))
        )
        .drop("_parts")
    )
    return dealt.join(repeated, [*keys, "_part"], how).drop("_part")


def join_few(
    many: DataFrame, few: DataFrame, keys: list[str], hot: HotKeys | None, how: str = "inner"
) -> DataFrame:
    """Plain equi-join when no key is hot (strategy left to the optimizer), else spread."""
    return many.join(few, keys, how) if hot is None else join_spread(many, few, hot, how)


# --- series -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Series:
    """Rows ordered by ``ts`` within ``key``, with the cuts of the series that need some.

    ``cuts`` holds one row (key, start, width) per series with more rows than one task should
    take, so at most rows / limit rows. None means that every series fits one task. ``hot`` are
    the same keys, for joins on the key. ``parts`` is how many tasks the rows are dealt to; None
    leaves it to the session.
    """

    key: str
    ts: str
    cuts: DataFrame | None = None
    hot: HotKeys | None = None
    parts: int | None = None

    @property
    def group(self) -> list[str]:
        """What a window over this series partitions by."""
        return [self.key] if self.cuts is None else [self.key, "_chunk"]

    def window(self, *order: Column) -> Window:
        return Window.partitionBy(*self.group).orderBy(*order)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, for zoned and unzoned timestamps alike (UTC session)."""
    return F.unix_micros(ts.cast("timestamp"))


def parts_for(rows: int, limit: int) -> int | None:
    """How many tasks take at most so many rows each, as a power of two; None for few rows.

    The session goes by the bytes of what is shuffled, not by the rows that become of it later.
    Two counts of nearly the same rows mostly give the same number, so the second shuffle is none.
    """
    return None if rows <= 8 * limit else 1 << math.ceil(math.log2(rows / limit))


def measure_series(df: DataFrame, key: str, ts: str, limit: int) -> Series:
    """Find the series with more than ``limit`` rows and cut them into time chunks.

    Chunks are narrowed until no chunk of a series exceeds the limit, so bursts are cut as well.
    Chunk numbers are integer arithmetic on the timestamp: any re-run of a
    task finds the same ones.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("_rows"))
    most, rows = sizes.agg(F.max("_rows"), F.sum("_rows")).first()
    if (most or 0) <= limit:
        return Series(key, ts, parts=parts_for(rows or 0, limit))
    hot = hot_keys(df, key, limit)
    stamps = (
        df.join(F.broadcast(hot.table.select(key)), key, "left_semi")
        .where(F.col(ts).isNotNull())
        .select(key, micros(F.col(ts)).alias("_at"))
    )
    cuts = (
        stamps.groupBy(key)
        .agg(
            F.min("_at").alias("_start"),
            F.max("_at").alias("_end"),
            F.count("*").alias("_rows"),
        )
        .select(
            key,
            "_start",
            F.greatest(
                F.lit(1),
                F.floor((F.col("_end") - F.col("_start") + 1) / F.ceil(F.col("_rows") / limit)),
            ).alias("_width"),
        )
    )
    cuts = settle(cuts, "series-cuts")
    while True:
        number = F.floor((F.col("_at") - F.col("_start")) / F.col("_width"))
        fullest = (
            stamps.join(F.broadcast(cuts), key)
            .where(F.col("_width") > 1)
            .groupBy(key, number.alias("_chunk"))
            .agg(F.count("*").alias("_rows"))
            .groupBy(key)
            .agg(F.max("_rows").alias("_rows"))
            .where(F.col("_rows") > limit)
        )
        times = fullest.agg(F.max("_rows")).first()[0]
        if times is None:
            return Series(key, ts, cuts, hot)
        finer = fullest.select(key, F.ceil(F.col("_rows") / limit).alias("_times"))
        narrower = F.floor(F.col("_width") / F.coalesce("_times", F.lit(1)))
        cuts = settle(
            cuts.join(F.broadcast(finer), key, "left").select(
                key, "_start", F.greatest(F.lit(1), narrower).alias("_width")
            ),
            "series-cuts",
        )


def bring_together(df: DataFrame, series: Series) -> DataFrame:
    """Shuffle by the series' key at once, where no series is too long for a task.

    Deduplication by (key, time) and all windows by key then run on that one shuffle. With
    long series the rows stay as they are: copies are thinned out before they are moved.
    """
    if series.cuts is not None:
        return df
    return df.repartition(series.parts, series.key) if series.parts else df.repartition(series.key)


def dealt(df: DataFrame, series: Series) -> DataFrame:
    """The rows in the series' parts if it names a number, so that they meet others without a shuffle."""
    return bring_together(df, series) if series.parts else df


def mark_chunks(df: DataFrame, series: Series) -> DataFrame:
    """Add ``_chunk``: 0 for a whole series, the time chunk's number for a cut one."""
    if series.cuts is None:
        return df
    number = F.floor((micros(F.col(series.ts)) - F.col("_start")) / F.col("_width"))
    return (
        df.join(F.broadcast(series.cuts), series.key, "left")
        .withColumn("_chunk", F.coalesce(number, F.lit(0)))
        .withColumn("_cut", F.col("_width").isNotNull())
        .drop("_start", "_width")
    )


def with_neighbour_rows(
    df: DataFrame, series: Series, before: int = 0, after: int = 0
) -> DataFrame:
    """Give every chunk the rows around it that a row-based frame can reach.

    Adds ``_borrowed``; the caller drops those rows once its windows are computed. Each chunk
    contributes its last (first) rows to a small table with one row per chunk; a chunk borrows
    from as many chunks as there are rows to borrow, which is enough because none is empty.
    """
    if series.cuts is None:
        return df.withColumn("_borrowed", F.lit(False))
    marked = mark_chunks(df, series)
    result = marked.withColumn("_borrowed", F.lit(False))
    for rows, latest in ((before, True), (after, False)):
        if rows:
            result = result.unionByName(_borrow(marked, series, rows, latest))
    return result


def _borrow(marked: DataFrame, series: Series, rows: int, latest: bool) -> DataFrame:
    columns = [c for c in marked.columns if c not in ("_chunk", "_cut")]
    in_time = F.col(series.ts).desc() if latest else F.col(series.ts).asc()
    ends = (
        marked.where("_cut")
        .withColumn("_nth", F.row_number().over(series.window(in_time)))
        .where(F.col("_nth") <= rows)
        .groupBy(series.key, "_chunk")
        .agg(F.collect_list(F.struct(series.ts, F.struct(*columns).alias("_row"))).alias("_end"))
        .withColumn("_end", F.array_sort("_end"))
    )
    order = F.col("_chunk").asc() if latest else F.col("_chunk").desc()
    earlier = Window.partitionBy(series.key).orderBy(order).rowsBetween(-rows, -1)
    near = F.array_sort(F.flatten(F.collect_list("_end").over(earlier)))
    # Both slices take everything when there is less than asked for.
    nearest = F.reverse(F.slice(F.reverse(near), 1, rows)) if latest else F.slice(near, 1, rows)
    return (
        ends.withColumn("_near", nearest)
        .select("_chunk", F.explode("_near").alias("_item"))
        .select("_item._row.*", "_chunk", F.lit(True).alias("_cut"), F.lit(True).alias("_borrowed"))
    )


def chunk_carry(
    marked: DataFrame, series: Series, values: dict[str, Column], order: Column
) -> DataFrame:
    """Per chunk of a cut series, the nearest non-null value before it and after it.

    ``values`` are structs that are null where a row has nothing to carry. One pre-aggregated
    row per chunk is all that is ordered across the series.
    """
    per_chunk = (
        marked.where("_cut")
        .groupBy(series.key, "_chunk")
        .agg(
            *[F.max_by(v, F.when(v.isNotNull(), order)).alias(f"_last_{n}") for n, v in values.items()],
            *[F.min_by(v, F.when(v.isNotNull(), order)).alias(f"_first_{n}") for n, v in values.items()],
        )
    )
    before = Window.partitionBy(series.key).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    after = Window.partitionBy(series.key).orderBy(F.col("_chunk").desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return per_chunk.select(
        series.key,
        "_chunk",
        *[F.last(f"_last_{n}", True).over(before).alias(f"_before_{n}") for n in values],
        *[F.last(f"_first_{n}", True).over(after).alias(f"_after_{n}") for n in values],
    )

