"""Windows over runs of any length.

One run may hold a third of all rows, so no operator sorts a whole run in one task. A run is cut into
slices of ``SLICE`` consecutive steps and every row-level window is partitioned by ``(run, slice)``:

* ``neighbours``: bounded frames. Rows near a slice border are also copied into the next slice.
* ``running`` / ``carry``: unbounded frames. Local result plus what the earlier slices add up to; only
  the slice summaries (1/SLICE of the rows) are windowed per run.
* ``dense_index``: row numbers. Long runs are split by their order value first.
* ``nearest_rank``: exact percentiles. Equal values collapse to counts before anything is ranked.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = 4096
HOT_ROWS = 1_000_000


def with_slice(df: DataFrame, size: int = SLICE, idx: str = "step_idx") -> DataFrame:
    return df.withColumn("slice", F.floor(F.col(idx) / size).cast("bigint"))


def dense_index(
    df: DataFrame,
    key: str,
    position: Column,
    ties: Sequence[str],
    name: str = "step_idx",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Zero-based row number per ``key`` in (position, ties) order; ``position`` is numeric.

    Keys above ``hot_rows`` rows are split into stripes by position. There are at most
    rows/hot_rows such keys, which is what bounds the broadcast. A stripe is offset by the counts of
    the stripes before it, so the largest sort is one stripe.
    """
    df = df.withColumn("_pos", position.cast("double"))
    hot = (
        df.groupBy(key)
        .agg(F.count("*").alias("_n"), F.min("_pos").alias("_lo"), F.max("_pos").alias("_hi"))
        .filter(F.col("_n") > hot_rows)
        .withColumn("_k", F.ceil(F.col("_n") * 4 / F.lit(hot_rows)))
    )
    striped = df.join(F.broadcast(hot), key, "left").withColumn(
        "_stripe",
        F.when(F.col("_k").isNull(), F.lit(0)).otherwise(
            F.floor((F.col("_pos") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * F.col("_k"))
        ).cast("bigint"),
    )
    local = Window.partitionBy(key, "_stripe").orderBy("_pos", *ties)
    ranked = striped.withColumn("_rn", F.row_number().over(local) - 1)
    before = (
        Window.partitionBy(key).orderBy("_stripe").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        striped.filter(F.col("_k").isNotNull())
        .groupBy(key, "_stripe")
        .agg(F.count("*").alias("_c"))
        .select(key, "_stripe", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    )
    return (
        ranked.join(offsets, [key, "_stripe"], "left")
        .withColumn(name, (F.col("_rn") + F.coalesce(F.col("_off"), F.lit(0))).cast("bigint"))
        .drop("_pos", "_n", "_lo", "_hi", "_k", "_stripe", "_rn", "_off")
    )


def neighbours(
    df: DataFrame,
    make: Callable[[Window], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    keys: Sequence[str] = ("traj_id",),
    idx: str = "step_idx",
    size: int = SLICE,
    order: Sequence[Column | str] = (),
) -> DataFrame:
    """Add columns computed over frames reaching ``before`` / ``after`` index positions.

    ``make`` gets the window (partitioned, ordered by ``idx``) and returns the new columns.
    ``idx`` is dense or sparse, but every frame must stay within the stated distance in ``idx``.
    """
    if before >= size or after >= size:
        raise ValueError("a frame must be shorter than a slice")
    home = F.floor(F.col(idx) / size)
    offset = F.col(idx) - home * size
    copies = F.array_compact(
        F.array(
            home,
            F.when(offset >= size - before, home + 1),
            F.when((offset < after) & (home > 0), home - 1),
        )
    )
    spread = df.withColumn("_at", F.explode(copies))
    window = Window.partitionBy(*keys, "_at").orderBy(idx, *order)
    columns = make(window)
    return spread.withColumns(columns).filter(F.col("_at") == home).drop("_at")


def running(
    df: DataFrame,
    sums: dict[str, Column],
    keys: Sequence[str] = ("traj_id",),
    order: Sequence[str] = ("step_idx",),
    strict: bool | Sequence[str] = False,
    how: str = "sum",
    piece: str = "slice",
) -> DataFrame:
    """Running sum or max of each column, up to (``strict``, all or the named ones: before) the row."""
    function = {"sum": F.sum, "max": F.max}[how]
    join = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest}[how]
    keys = list(keys)
    df = df.withColumns({f"_v_{n}": c for n, c in sums.items()})
    before = set(sums if strict is True else strict or ())
    base = Window.partitionBy(*keys, piece).orderBy(*order)
    local = {n: base.rowsBetween(Window.unboundedPreceding, -1 if n in before else 0) for n in sums}
    earlier = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, piece).agg(*[function(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    totals = totals.select(*keys, piece, *[function(f"_s_{n}").over(earlier).alias(f"_o_{n}") for n in sums])
    totals = totals.filter(" or ".join(f"_o_{n} is not null" for n in sums))
    out = df.withColumns({f"_l_{n}": function(f"_v_{n}").over(local[n]) for n in sums})
    out = out.join(totals, [*keys, piece], "left")
    out = out.withColumns({n: join(F.col(f"_l_{n}"), F.col(f"_o_{n}")) for n in sums})
    return out.drop(*[f"{p}{n}" for n in sums for p in ("_v_", "_l_", "_o_")])


def carry(
    df: DataFrame,
    values: dict[str, Column],
    keys: Sequence[str] = ("traj_id",),
    order: Sequence[str] = ("step_idx",),
    strict: bool = True,
    back: dict[str, Column] | None = None,
    piece: str = "slice",
) -> DataFrame:
    """Last non-null value before (``strict=False``: at or before) the row; ``back`` likewise looks ahead."""
    keys, back = list(keys), back or {}
    edge = 1 if strict else 0
    both = {**values, **back}
    df = df.withColumns({f"_v_{n}": c for n, c in both.items()})
    base = Window.partitionBy(*keys, piece).orderBy(*order)
    line = Window.partitionBy(*keys).orderBy(piece)
    at = F.struct(*order)

    def pick(name: str, column: str, window, gap: int) -> Column:
        if name in back:
            return F.first(column, ignorenulls=True).over(window.rowsBetween(gap, Window.unboundedFollowing))
        return F.last(column, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -gap))

    def end(name: str) -> Column:
        value = F.col(f"_v_{name}")
        side = F.min_by if name in back else F.max_by
        return side(value, F.when(value.isNotNull(), at)).alias(f"_s_{name}")

    ends = df.groupBy(*keys, piece).agg(*[end(n) for n in both])
    ends = ends.select(*keys, piece, *[pick(n, f"_s_{n}", line, 1).alias(f"_o_{n}") for n in both])
    ends = ends.filter(" or ".join(f"_o_{n} is not null" for n in both))
    out = df.withColumns({f"_l_{n}": pick(n, f"_v_{n}", base, edge) for n in both})
    out = out.join(ends, [*keys, piece], "left")
    out = out.withColumns({n: F.coalesce(F.col(f"_l_{n}"), F.col(f"_o_{n}")) for n in both})
    return out.drop(*[f"{p}{n}" for n in both for p in ("_v_", "_l_", "_o_")])


def islands(
    df: DataFrame,
    same: Sequence[str],
    keys: Sequence[str] = ("traj_id",),
    idx: str = "step_idx",
    name: str = "island",
    adjacent: bool = False,
    piece: str = "slice",
) -> DataFrame:
    """Name the maximal runs of consecutive rows that agree on ``same`` by the index they start at.

    Consecutive means next to each other among the rows of ``df``; with ``adjacent`` also in ``idx``.
    Islands are found within slices; an island that goes on in the next slice takes over the start of
    the last one before it, which needs only the first and last row of every slice.
    """
    keys = list(keys)

    def goes_on(before: str, at: str) -> Column:
        check = F.lit(True)
        for column in same:
            check = check & F.col(f"{before}.{column}").eqNullSafe(F.col(f"{at}.{column}"))
        if adjacent:
            check = check & (F.col(f"{before}._i") == F.col(f"{at}._i") - 1)
        return F.coalesce(check, F.lit(False))

    row = F.struct(*same, F.col(idx).alias("_i"))
    local = Window.partitionBy(*keys, piece).orderBy(idx)
    df = df.withColumn("_row", row).withColumn("_before", F.lag("_row").over(local))
    df = df.withColumn("_mark", F.when(~goes_on("_before", "_row"), F.col(idx)))
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_start", F.last("_mark", ignorenulls=True).over(upto)).drop("_before", "_mark")
    ends = df.groupBy(*keys, piece).agg(
        F.min_by("_row", idx).alias("_first"),
        F.max_by("_row", idx).alias("_last"),
        F.max("_start").alias("_tail"),
    )
    across = Window.partitionBy(*keys).orderBy(piece)
    ends = ends.withColumn("_prior", F.lag("_last").over(across))
    ends = ends.withColumn("_joined", goes_on("_prior", "_first"))
    whole = F.col("_joined") & (F.col("_tail") == F.col("_first._i"))
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn(
        "_origin", F.last(F.when(~whole, F.col("_tail")), ignorenulls=True).over(earlier)
    ).filter("_joined").select(*keys, piece, F.col("_first._i").alias("_head"), "_origin")
    out = df.join(ends, [*keys, piece], "left")
    island = F.when(F.col("_start") == F.col("_head"), F.col("_origin")).otherwise(F.col("_start"))
    return out.withColumn(name, island).drop("_row", "_start", "_head", "_origin")


def nearest_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    quantiles: dict[str, float],
    median: str | None = None,
) -> DataFrame:
    """Exact percentiles per key: element ceil(q*n) of the sorted values; ``median`` averages the middle two.

    Equal values collapse to (value, count) first. The counts are cut into bands of about one percent
    relative width, a monotone function of the value, so no task ranks all values of a key.
    """
    keys = list(keys)
    band = F.when(F.col("_v") == 0, F.lit(0)).otherwise(
        F.signum("_v") * (F.lit(100_000) + F.floor(F.log2(F.abs("_v")) * 64))
    )
    counts = (
        df.select(*keys, value.cast("double").alias("_v"))
        .filter(F.col("_v").isNotNull())
        .groupBy(*keys, "_v")
        .agg(F.count("*").alias("_c"))
        .withColumn("_band", band)
    )
    inside = Window.partitionBy(*keys, "_band").orderBy("_v")
    counts_in = counts.withColumn("_cum", F.sum("_c").over(inside))
    run = Window.partitionBy(*keys).orderBy("_band")
    bands = (
        counts.groupBy(*keys, "_band")
        .agg(F.sum("_c").alias("_b"))
        .withColumn("_below", F.sum("_b").over(run) - F.col("_b"))
        .withColumn("_n", F.sum("_b").over(Window.partitionBy(*keys)))
        .drop("_b")
    )
    ranked = counts_in.join(bands, [*keys, "_band"]).withColumn("_hi", F.col("_below") + F.col("_cum"))
    ranked = ranked.withColumn("_first", F.col("_hi") - F.col("_c") + 1)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_first") <= rank) & (F.col("_hi") >= rank), F.col("_v")))

    picks = [
        at(F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("_n")))).alias(name) for name, q in quantiles.items()
    ]
    if median:
        low, high = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
        picks.append(((at(low) + at(high)) / 2).alias(median))
    return ranked.groupBy(*keys).agg(*picks)
