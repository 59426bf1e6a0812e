"""Raw (date, value) rows to regular series.

A series is (keys..., step, ts, value, observed): ``step`` counts calendar
steps from the series' own first date and every step has a value. All rows
of a time slot are averaged before anything is ordered, so windows see at
most one row per calendar slot of a series, and that number is checked.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.durable import written
from tablewright.functions.coerce import day_of, number, ref, require_columns, timestamp
from tablewright.functions.joins import join_null_safe

MIN_OBSERVATIONS = 5
VALID_SHARE = 0.5
# Steps that one task lists and interpolates at a time; longer series are cut into such slices.
SLICE_STEPS = 50_000
ALL = "_all"
# Calendar slots of which a task orders the observed ones at a time, to find their gaps.
GAP_SLOTS = 50_000
GRAIN_SECONDS = {"day": 86_400, "hour": 3_600, "minute": 60}


@dataclass(frozen=True)
class Prepared:
    """``series`` as above; ``info`` has one row per series with its frequency."""

    series: DataFrame
    info: DataFrame
    keys: list[str]


def check_input(df: DataFrame, date_column: str, metric_column: str) -> None:
    """At least half of the dates and of the values must be readable."""
    require_columns(df, [date_column, metric_column])
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(timestamp(df, date_column)).alias("dates"),
        F.count(number(df, metric_column)).alias("values"),
    ).first()
    rows = max(row["rows"], 1)
    if row["dates"] / rows < VALID_SHARE:
        raise ValueError(f"'{date_column}' is no date/time column: most values do not parse")
    if row["values"] / rows < VALID_SHARE:
        raise ValueError(
            f"'{metric_column}' is not numeric: most values do not parse"
        )


def slot_means(
    df: DataFrame,
    date_column: str,
    metric_column: str,
    keys: Sequence[str],
    grain: str = "day",
) -> DataFrame:
    """keys, slot, ts, value, rows: the mean of each time slot of each series."""
    seconds = GRAIN_SECONDS[grain]
    ts = _slot_start(F.col("_ts"), grain)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    rows = df.select(
        *[ref(k) for k in keys],
        timestamp(df, date_column).alias("_ts"),
        number(df, metric_column).alias("_value"),
    ).na.drop(subset=["_ts", "_value"])
    days = F.date_diff(F.col("ts").cast("date"), epoch.cast("date"))
    of_day = F.hour("ts") * 3600 + F.minute("ts") * 60
    return (
        rows.select(*[ref(k) for k in keys], ts.alias("ts"), "_value")
        .groupBy(*[ref(k) for k in keys], "ts")
        .agg(F.avg("_value").alias("value"), F.count(F.lit(1)).alias("rows"))
        .withColumn(
            "slot",
            F.floor((days.cast("long") * 86_400 + of_day) / F.lit(seconds)).cast("long"),
        )
    )


def _slot_start(ts: Column, grain: str) -> Column:
    """Start of the time slot, by interval arithmetic that knows no time zone."""
    day = day_of(ts)
    if grain == "day":
        return day
    minute = F.minute(ts) if grain == "minute" else F.lit(0)
    return day + F.make_dt_interval(F.lit(0), F.hour(ts), minute)


def _slice_facts(slots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Facts of the slices of each series, and rows that count its gaps (gap, month_gap, n).

    A slice is ``GAP_SLOTS`` of the calendar. Gaps inside slices are counted
    where they are found; those between slices come from one row per slice, of
    which the calendar allows some 100,000 for a series of minutes.
    """
    by = [ref(k) for k in keys]
    rows = slots.select(
        *by,
        "slot",
        "ts",
        "rows",
        (F.year("ts") * 12 + F.month("ts")).alias("month"),
        F.dayofmonth("ts").alias("day"),
        F.floor(F.col("slot") / F.lit(GAP_SLOTS)).alias("cut"),
    )
    ordered = Window.partitionBy(*by, "cut").orderBy("slot")
    inside = (
        rows.select(
            *by,
            (F.col("slot") - F.lag("slot").over(ordered)).alias("gap"),
            (F.col("month") - F.lag("month").over(ordered)).alias("month_gap"),
        )
        .where("gap is not null")
        .groupBy(*by, "gap", "month_gap")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    slices = rows.groupBy(*by, "cut").agg(
        F.count(F.lit(1)).alias("observed"),
        F.sum("rows").alias("rows"),
        F.min("slot").alias("first_slot"),
        F.max("slot").alias("last_slot"),
        F.min("ts").alias("first_ts"),
        F.min("month").alias("first_month"),
        F.max("month").alias("last_month"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
    )
    in_turn = Window.partitionBy(*by).orderBy("cut")
    between = slices.withColumns(
        {
            "gap": F.col("first_slot") - F.lag("last_slot").over(in_turn),
            "month_gap": F.col("first_month") - F.lag("last_month").over(in_turn),
            "n": F.lit(1).cast("long"),
        }
    )
    return between.drop("cut").unionByName(inside, allowMissingColumns=True)


def frequencies(slots: DataFrame, keys: Sequence[str], grain: str = "day") -> DataFrame:
    """Per series: first slot, unit (slot or month), stride and number of steps.

    Constant gaps give their own stride. Otherwise the median gap decides:
    up to 1 day, up to 8 a week, up to 32 a month, above that a year.
    """
    facts = _slice_facts(slots, keys).groupBy(*[ref(k) for k in keys]).agg(
        F.sum("observed").alias("observed"),
        F.sum("rows").alias("rows"),
        F.min("first_slot").alias("first_slot"),
        F.max("last_slot").alias("last_slot"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_month").alias("last_month"),
        F.min("first_month").alias("first_month"),
        F.percentile("gap", F.lit(0.5), F.col("n")).alias("median_gap"),
        F.min("gap").alias("min_gap"),
        F.max("gap").alias("max_gap"),
        F.min("month_gap").alias("min_month_gap"),
        F.max("month_gap").alias("max_month_gap"),
        (F.min("first_day") == F.max("last_day")).alias("same_day"),
    )
    monthly = (
        F.col("same_day")
        & (F.col("min_month_gap") == F.col("max_month_gap"))
        & (F.col("min_month_gap") >= 1)
    )
    constant = F.col("min_gap") == F.col("max_gap")
    gap = F.col("median_gap")
    if grain == "day":
        irregular_unit = F.when(gap <= 8, "slot").otherwise("month")
        irregular_stride = (
            F.when(gap <= 1, 1).when(gap <= 8, 7).when(gap <= 32, 1).otherwise(12)
        )
    else:
        irregular_unit = F.lit("slot")
        irregular_stride = F.greatest(F.lit(1), F.round(gap))
    with_unit = facts.select(
        "*",
        F.when(monthly, "month").when(constant, "slot").otherwise(irregular_unit).alias("unit"),
        F.when(monthly, F.col("min_month_gap"))
        .when(constant, F.col("min_gap"))
        .otherwise(irregular_stride)
        .cast("long")
        .alias("stride"),
    )
    last = _step(F.col("last_slot"), F.col("last_month"))
    return with_unit.withColumn("steps", last + 1)


def _step(slot: Column, month: Column) -> Column:
    """Calendar step of a slot, relative to the series' first one."""
    distance = F.when(F.col("unit") == "month", month - F.col("first_month")).otherwise(
        slot - F.col("first_slot")
    )
    return F.floor(distance / F.col("stride")).cast("long")


def step_time(step: Column, grain: str) -> Column:
    """Timestamp of a step; needs the frequency columns beside it."""
    moved = step * F.col("stride")
    clock = F.col("first_ts") - F.col("first_ts").cast("date").cast("timestamp_ntz")
    in_months = (
        F.add_months(F.col("first_ts").cast("date"), moved.cast("int")).cast("timestamp_ntz")
        + clock
    )
    in_slots = F.col("first_ts") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (moved * GRAIN_SECONDS[grain]).cast("decimal(18,6)")
    )
    return F.when(F.col("unit") == "month", in_months).otherwise(in_slots)


def _point(position: str, value: str) -> Column:
    return F.struct(ref(position).alias("at"), ref(value).alias("v"))


def interpolate(
    df: DataFrame,
    value: str,
    position: str,
    partition_by: Sequence[str],
    outer: tuple[str, str] | None = None,
) -> DataFrame:
    """Linear interpolation of NULLs by ``position``; the ends repeat their neighbour.

    One window per partition. Where a partition is a slice of a series,
    ``outer`` names the columns with the nearest known (at, v) before and after
    it; both are dropped.
    """
    by = [ref(k) for k in partition_by]
    point = F.when(ref(value).isNotNull(), _point(position, value))
    order = Window.partitionBy(*by).orderBy(ref(position))
    before = F.last(point, ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, 0)
    )
    # Backwards, as a frame that ends at the last row is computed anew for each row.
    backwards = Window.partitionBy(*by).orderBy(ref(position).desc())
    after = F.last(point, ignorenulls=True).over(
        backwards.rowsBetween(Window.unboundedPreceding, 0)
    )
    if outer:
        before, after = F.coalesce(before, ref(outer[0])), F.coalesce(after, ref(outer[1]))
    placed = df.select("*", before.alias("_before"), after.alias("_after"))
    lo, hi = F.col("_before"), F.col("_after")
    share = (ref(position) - lo["at"]) / (hi["at"] - lo["at"])
    between = lo["v"] + (hi["v"] - lo["v"]) * share
    estimate = F.when(lo.isNull(), hi["v"]).when(hi.isNull(), lo["v"]).otherwise(between)
    return placed.withColumn(
        value, F.when(ref(value).isNull(), estimate).otherwise(ref(value))
    ).drop("_before", "_after", *(outer or ()))


def prepare(
    df: DataFrame,
    date_column: str,
    metric_column: str,
    keys: Sequence[str] = (),
    grain: str = "day",
    max_steps: int | None = None,
) -> Prepared:
    """Regular, gap-free series of any length.

    Series below five observations have no rows in ``series``. Only if the
    caller sets ``max_steps``, the same holds for series whose calendar is
    longer; they are marked in ``info`` (``too_long``). A table without keys is
    one series, and either case raises.
    """
    if grain not in GRAIN_SECONDS:
        raise ValueError(f"grain must be one of {', '.join(GRAIN_SECONDS)}")
    require_columns(df, keys)
    check_input(df, date_column, metric_column)
    by = list(keys) or [ALL]
    source = df if keys else df.withColumn(ALL, F.lit(0))
    # The only pass over the rows; what follows has one row per slot.
    slots = written(slot_means(source, date_column, metric_column, by, grain))
    too_long = F.lit(False) if max_steps is None else F.col("steps") > max_steps
    info = written(frequencies(slots, by, grain).withColumn("too_long", too_long))
    size = info.agg(F.max("steps"), F.max("rows")).first()
    if not keys and (size[1] or 0) < MIN_OBSERVATIONS:
        raise ValueError(
            f"a forecast needs {MIN_OBSERVATIONS} observations, found {size[1] or 0}"
        )
    if not keys and max_steps is not None and (size[0] or 0) > max_steps:
        raise ValueError(
            f"the series spans {size[0]} steps, more than {max_steps}; "
            "use a coarser grain or a larger max_steps"
        )
    usable = info.where((F.col("rows") >= MIN_OBSERVATIONS) & ~F.col("too_long"))
    columns = [ref(k) for k in by]
    shape = usable.select(
        *columns, "first_slot", "first_month", "first_ts", "unit", "stride", "steps"
    )
    month = F.year("ts") * 12 + F.month("ts")
    observed = written(
        join_null_safe(slots, shape, by)
        .withColumn("step", _step(F.col("slot"), month))
        .groupBy(*columns, "step")
        .agg((F.sum(F.col("value") * F.col("rows")) / F.sum("rows")).alias("value"))
    )
    calendar = _calendar(shape, observed, by, grain, size[0] or 0)
    joined = join_null_safe(calendar, observed, [*by, "step"], "left").select(
        *columns,
        "step",
        "ts",
        "steps",
        "value",
        F.col("value").isNotNull().alias("observed"),
        "_slice",
        "_earlier",
        "_later",
    )
    filled = interpolate(joined, "value", "step", [*by, "_slice"], ("_earlier", "_later"))
    return Prepared(written(filled.drop("_slice")), info, by)


def _calendar(
    shape: DataFrame, observed: DataFrame, keys: Sequence[str], grain: str, longest: int
) -> DataFrame:
    """Every step of every series, with its slice and the known points nearest to the slice.

    Only windows over slices, one row each, see a whole series.
    """
    by = [ref(k) for k in keys]
    size = F.lit(SLICE_STEPS).cast("long")
    of_slice = observed.groupBy(*by, F.floor(F.col("step") / size).alias("_slice")).agg(
        F.min(_point("step", "value")).alias("_first"),
        F.max(_point("step", "value")).alias("_last"),
    )
    slices = shape.select(
        "*",
        F.explode(
            F.sequence(F.lit(0).cast("long"), F.floor((F.col("steps") - 1) / size))
        ).alias("_slice"),
    )
    whole = Window.partitionBy(*by)
    upwards, backwards = whole.orderBy("_slice"), whole.orderBy(F.desc("_slice"))
    known = join_null_safe(slices, of_slice, [*keys, "_slice"], "left").select(
        *[ref(c) for c in slices.columns],
        F.last("_last", ignorenulls=True)
        .over(upwards.rowsBetween(Window.unboundedPreceding, -1))
        .alias("_earlier"),
        F.last("_first", ignorenulls=True)
        .over(backwards.rowsBetween(Window.unboundedPreceding, -1))
        .alias("_later"),
    )
    if longest > SLICE_STEPS:
        # A fixed number, as slices are few small rows that grow a lot in the next step.
        parts = int(shape.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        known = known.repartition(parts, *by, "_slice")
    start = F.col("_slice") * size
    last = F.least(start + size, F.col("steps")) - 1
    return known.select("*", F.explode(F.sequence(start, last)).alias("step")).withColumn(
        "ts", step_time(F.col("step"), grain)
    )
