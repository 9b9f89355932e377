"""Time-series operators: trends, hourly grid, nearest-in-time match, horizon labels.

Each takes a ``Series`` saying how rows are grouped. A series that fits one task is a plain
window. One that does not is cut into time chunks, and every chunk borrows from its
neighbours exactly what its frames reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sitehazard.config import AIR_MATCH_HOURS
from sitehazard.operators.skew import (
    Series,
    chunk_carry,
    dealt,
    mark_chunks,
    micros,
    with_neighbour_rows,
)

HOUR_US = 3_600_000_000


def time_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Hour, weekday with Monday 0, weekend flag."""
    day = F.weekday(F.col(ts))
    return df.withColumns(
        {
            "hour": F.hour(ts),
            "day_of_week": day,
            "weekend": day.isin(5, 6).cast("int"),
        }
    )


def trend_features(weather: DataFrame, series: Series) -> DataFrame:
    """Rolling means and sums over rows, and differences to earlier rows, in time order."""
    now = series.window(F.col(series.ts))
    last3, last6 = now.rowsBetween(-2, 0), now.rowsBetween(-5, 0)

    def change(name: str, rows: int) -> Column:
        return F.col(name) - F.lag(name, rows).over(now)

    trended = with_neighbour_rows(weather, series, before=5).withColumns(
        {
            "temp_3h_avg": F.avg("temperature").over(last3),
            "temp_6h_avg": F.avg("temperature").over(last6),
            "temp_1h_change": change("temperature", 1),
            "temp_3h_change": change("temperature", 3),
            "wind_3h_avg": F.avg("wind_speed").over(last3),
            "wind_1h_change": change("wind_speed", 1),
            "precip_3h_sum": F.sum("precipitation").over(last3),
        }
    )
    return trended.where(~F.col("_borrowed")).drop("_borrowed", "_chunk", "_cut")


def horizon_labels(
    df: DataFrame, series: Series, value: str, horizons: dict[str, int], direction: str = "lead"
) -> DataFrame:
    """The value some rows later (``lead``, a forecast label) or earlier (``lag``)."""
    if direction not in ("lead", "lag"):
        raise ValueError(direction)
    now = series.window(F.col(series.ts))
    shift = F.lead if direction == "lead" else F.lag
    reach = max(horizons.values())
    wide = with_neighbour_rows(
        df,
        series,
        before=reach if direction == "lag" else 0,
        after=reach if direction == "lead" else 0,
    )
    labels = {name: shift(value, rows).over(now) for name, rows in horizons.items()}
    return wide.withColumns(labels).where(~F.col("_borrowed")).drop("_borrowed", "_chunk", "_cut")


def _hour_at_or_after(ts: Column) -> Column:
    floor = F.date_trunc("hour", ts)
    return F.when(floor == ts, floor).otherwise(floor + F.expr("interval 1 hour"))


def hourly_grid(
    observations: DataFrame, series: Series, numeric: list[str], text: list[str]
) -> DataFrame:
    """One row per full hour between the first and the last observation of a series.

    Numbers are interpolated linearly in time between the nearest observations that have one;
    before the first they are null, after the last they keep its value. Text keeps the latest
    value. Every observation opens the hours up to the next one, so there is no list of all
    hours and nothing to join it with.
    """
    key, ts = series.key, series.ts
    kind = dict(observations.dtypes)[ts]
    marked = mark_chunks(observations.where(F.col(ts).isNotNull()), series)
    # Times are turned into numbers here, once per observation, not once per hour and column.
    at = micros(F.col(ts)).alias("at")
    point = {
        name: F.when(F.col(name).isNotNull(), F.struct(at, F.col(name).alias("v")))
        for name in numeric + text
    }
    # Frames that look ahead are written as frames that look back in descending order: Spark
    # re-reads the rest of the partition for every row of a forward-growing frame.
    forward = series.window(F.col(ts)).rowsBetween(Window.unboundedPreceding, 0)
    backward = series.window(F.col(ts).desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = marked.withColumns({f"_p_{n}": F.last(p, True).over(forward) for n, p in point.items()})
    rows = rows.withColumns(
        {f"_n_{n}": F.last(point[n], True).over(backward) for n in numeric}
        | {"_next": F.lag(ts).over(series.window(F.col(ts).desc()))}
    )
    if series.cuts is not None:
        carried = {**point, "_row": F.struct(F.col(ts).alias("ts"))}
        carry = chunk_carry(marked, series, carried, F.col(ts))
        rows = rows.join(carry, [key, "_chunk"], "left").withColumns(
            {f"_p_{n}": F.coalesce(f"_p_{n}", f"_before_{n}") for n in point}
            | {f"_n_{n}": F.coalesce(f"_n_{n}", f"_after_{n}") for n in numeric}
            | {"_next": F.coalesce("_next", "_after__row.ts")}
        )
    rows = rows.withColumns({"_first": _hour_at_or_after(F.col(ts))})
    first = F.col("_first")
    stop = F.coalesce(_hour_at_or_after(F.col("_next")), F.col(ts) + F.expr("interval 1 microsecond"))
    last = F.date_trunc("hour", stop - F.expr("interval 1 microsecond"))
    # A gap is opened in two steps, days and then their hours, so that no row holds a list of all
    # hours of a long gap. Times are zoned either way.
    day, hour = F.expr("interval 1 day"), F.expr("interval 1 hour")
    opened = rows.withColumns({"_first": first, "_last": last}).where(first <= last)
    days = F.sequence(F.date_trunc("day", "_first"), F.date_trunc("day", "_last"), day)
    opened = opened.withColumn("_day", F.explode(days))
    start = F.greatest(F.col("_first").cast("timestamp"), F.col("_day"))
    end = F.least(F.col("_last").cast("timestamp"), F.col("_day") + F.expr("interval 23 hours"))
    spread = opened.withColumn("_hour", F.explode(F.sequence(start, end, hour)))

    def at_hour(name: str) -> Column:
        before, after = F.col(f"_p_{name}"), F.col(f"_n_{name}")
        now = F.unix_micros("_hour")
        share = (now - before["at"]) / (after["at"] - before["at"])
        between = before["v"] + (after["v"] - before["v"]) * share
        return F.when(after.isNull() | (before["at"] == now), before["v"]).otherwise(between)

    return spread.select(
        key,
        F.col("_hour").cast(kind).alias(ts),
        *[at_hour(n).alias(n) for n in numeric],
        *[F.col(f"_p_{n}.v").alias(n) for n in text],
    )


def _ends_of_instants(stamped: DataFrame, key: str, ts: str) -> DataFrame:
    """Of the rows of a key at one time the first and the last by turn; no other can be matched.

    They are combined before they are moved, however many share the time.
    """
    row = F.struct("_turn", "_right")
    ends = stamped.groupBy(key, ts).agg(F.min(row).alias("a"), F.max(row).alias("b"))
    both = ends.select(key, ts, F.explode(F.array_distinct(F.array("a", "b"))).alias("_end"))
    return both.select(key, ts, "_end._turn", "_end._right")


def match_nearest(
    left: DataFrame,
    right: DataFrame,
    series: Series,
    right_ts: str,
    columns: list[str],
    tolerance_us: int = AIR_MATCH_HOURS * HOUR_US,
    right_order: str = "seq",
) -> DataFrame:
    """Add to every left row the columns of the right row nearest in time, same key.

    At most ``tolerance_us`` apart, ends included; nulls otherwise. Of two equally near rows
    the earlier one counts; of right rows at the same time the last when looking back, the
    first when looking ahead.

    Every right row is first told its successor, and the first of a series gets a twin that
    sorts before everything. Then one ordered pass over both sides finds, as the latest right
    row, both neighbours of a left row: the row itself and its successor.
    """
    key, ts = series.key, series.ts
    entry = F.struct(
        micros(F.col(right_ts)).alias("at"), F.col(right_order).alias("turn"), *[F.col(c) for c in columns]
    )
    stamped = right.where(F.col(right_ts).isNotNull()).select(
        key, F.col(right_ts).alias(ts), F.col(right_order).cast("bigint").alias("_turn"), entry.alias("_right")
    )
    if series.cuts is not None:  # a burst at one instant can't be cut
        stamped = _ends_of_instants(stamped, key, ts)
    known = mark_chunks(dealt(stamped, series), series)
    in_order = series.window(F.col(ts), F.col("_turn"))
    linked = known.withColumns(
        {"_next": F.lead("_right").over(in_order), "_nth": F.row_number().over(in_order)}
    )
    nobody = F.lit(None)
    pair = F.struct(F.lit(False).alias("start"), F.col("_right").alias("back"), F.col("_next").alias("ahead"))
    start = F.struct(
        F.lit(True).alias("start"),
        nobody.cast(known.schema["_right"].dataType).alias("back"),
        F.col("_right").alias("ahead"),
    )
    twins = F.when(F.col("_nth") == 1, F.array(start, pair)).otherwise(F.array(pair))
    right_rows = linked.withColumn("_pair", F.explode(twins)).select(
        *series.group,
        # Nulls sort first, so the twin precedes every row of its group.
        F.when(~F.col("_pair.start"), F.col(ts)).alias(ts),
        F.lit(0).alias("_side"),
        "_turn",
        "_pair",
    )
    rest = [c for c in left.columns if c not in (key, ts)]
    left_rows = mark_chunks(left.where(F.col(ts).isNotNull()), series).select(
        *series.group,
        ts,
        F.lit(1).alias("_side"),
        nobody.cast("bigint").alias("_turn"),
        F.struct(*[F.col(c) for c in rest] or [F.lit(0).alias("none")]).alias("_left"),
    )
    merged = left_rows.unionByName(right_rows, allowMissingColumns=True)
    so_far = series.window(F.col(ts), F.col("_side"), F.col("_turn")).rowsBetween(
        Window.unboundedPreceding, 0
    )
    paired = merged.withColumn("_found", F.last("_pair", True).over(so_far)).where("_side = 1")
    paired = paired.withColumns({"_back": F.col("_found.back"), "_ahead": F.col("_found.ahead")})
    if series.cuts is not None:
        # Chunks with left rows only need their neighbours too.
        chunks = left_rows.select(*series.group).distinct().withColumn("_cut", F.lit(True))
        everywhere = known.where("_cut").unionByName(chunks, allowMissingColumns=True)
        order = F.struct(F.col("_right.at"), F.col("_right.turn"))
        carry = chunk_carry(everywhere, series, {"right": F.col("_right")}, order)
        paired = paired.join(carry, [key, "_chunk"], "left").withColumns(
            {
                "_back": F.coalesce("_back", "_before_right"),
                "_ahead": F.coalesce("_ahead", "_after_right"),
            }
        )
    now = micros(F.col(ts))
    nearer = paired.withColumns(
        {"_gap_back": now - F.col("_back.at"), "_gap_ahead": F.col("_ahead.at") - now}
    ).withColumn("_later", F.col("_gap_back").isNull() | (F.col("_gap_ahead") < F.col("_gap_back")))
    chosen = F.when(F.col("_later"), F.col("_ahead")).otherwise(F.col("_back"))
    gap = F.when(F.col("_later"), F.col("_gap_ahead")).otherwise(F.col("_gap_back"))
    matched = nearer.withColumn("_match", F.when(gap <= tolerance_us, chosen))
    return matched.select(
        key,
        ts,
        *[F.col(f"_left.{c}").alias(c) for c in rest],
        *[F.col(f"_match.{c}").alias(c) for c in columns],
    )
