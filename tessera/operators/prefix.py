"""Prefix sums, ranks, folds and percentiles of groups that no task could hold.

Rows are range-partitioned once by group and order and written with the number of their slice. What a slice knows of itself
is worked out in the slice; borders and totals are a table of one row per group and slice, whose running values are the
offsets that slices add. A group with all rows thus spreads over as many tasks as its rows need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import materialize

#: Rows of a slice, about; values of a group above which percentiles are selected instead of sorted; points of a sketch.
SLICE_ROWS, LARGE_GROUP, POINTS = 50_000, 1_000_000, 1000


def sliced(rows: DataFrame, keys: list[str], order: list[str], slice_rows: int = SLICE_ROWS, name: str = "slices") -> DataFrame:
    """rows in a written table with `_slice`: within a group, all rows of a slice come before those of the next."""
    parts = max(1, -(-rows.count() // slice_rows))
    ranged = rows.repartitionByRange(parts, *keys, *order)
    return materialize(ranged.withColumn("_slice", F.spark_partition_id()), name)


def offsets(slices: DataFrame, keys: list[str], totals: dict[str, Column]) -> DataFrame:
    """keys, _slice, of each total its sum over the group's earlier slices and, as {name}_all, over the whole group."""
    own = slices.groupBy(*keys, "_slice").agg(*[c.alias(n) for n, c in totals.items()])
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in totals]
    return own.select(*keys, "_slice", *sums, *[F.sum(n).over(group).alias(f"{n}_all") for n in totals])


def _met(slices: DataFrame, told: DataFrame, keys: list[str]) -> DataFrame:
    same = [slices[k].eqNullSafe(told[k]) for k in keys] + [slices["_slice"] == told["_slice"]]
    joined = slices.join(told, same)
    for k in [*keys, "_slice"]:
        joined = joined.drop(told[k])
    return joined


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str = "running", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """rows with the sum of value up to and with each row, in order within its group; a null adds nothing, a sum of nothing is null."""
    slices = sliced(rows, keys, order, slice_rows)
    told = offsets(slices, keys, {"_sum": F.sum(value), "_seen": F.count(value)})
    within = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own, seen = F.sum(value).over(within), F.col("_seen") + F.count(value).over(within)
    out = _met(slices, told, keys).withColumn(name, F.when(seen > 0, F.coalesce(own, F.lit(0)) + F.col("_sum")))
    return out.drop("_slice", "_sum", "_seen", "_sum_all", "_seen_all")


def numbered(rows: DataFrame, keys: list[str], order: list[str], number: str, total: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """rows with their number within their group, from 1, and the group's size."""
    slices = sliced(rows, keys, order, slice_rows)
    told = offsets(slices, keys, {"_before": F.count("*")})
    within = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order))
    out = _met(slices, told, keys).withColumn("_number", within + F.col("_before")).withColumnRenamed("_before_all", "_total")
    return out.drop("_slice", "_before").withColumnsRenamed({"_number": number, "_total": total})


def at_ranks(rows: DataFrame, keys: list[str], value: str, ranks: DataFrame, few: int = LARGE_GROUP) -> DataFrame:
    """ranks (keys, name, rank, n) with `value`: the value at that rank, from 1, of the group's n non-null values in order.

    Distributed selection. A round takes a quantile sketch of what is left of each group, of which the two points around the
    rank are pivots, counts the values below, at, between and above these, and goes on between them with the rest of the rank.
    Each round leaves about a three-hundredth; what fits a task is sorted there. The sketch only steers: counts are exact."""
    own = [f"_k{i}" for i in range(len(keys))]
    held = [*own, "name", "rank", "n", "_lo", "_hi"]
    kept = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    none = F.lit(None).cast("double")
    state = materialize(ranks.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], "name", "rank", "n", none.alias("_lo"), none.alias("_hi")), "ranks")

    def near(asked: DataFrame) -> DataFrame:
        inside = (F.col("_lo").isNull() | (F.col("_v") > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") < F.col("_hi")))
        return kept.join(asked, [*[F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)], inside])

    told = []
    while True:
        sort = Window.partitionBy(*own, "name").orderBy("_v")
        told.append(near(state.filter(F.col("n") <= few)).withColumn("_i", F.row_number().over(sort)).filter("_i = rank").select(*own, "name", F.col("_v").alias("value")))
        large = state.filter(F.col("n") > few)
        if large.isEmpty():
            break
        grid = near(large).groupBy(*held).agg(F.percentile_approx("_v", [i / POINTS for i in range(POINTS + 1)], 10 * POINTS).alias("_grid"))
        at = F.floor(F.col("rank") / F.col("n") * POINTS).cast("int")
        pivots = materialize(grid.select(*held, F.get("_grid", F.greatest(at - 1, F.lit(0))).alias("_p"), F.get("_grid", F.least(at + 2, F.lit(POINTS))).alias("_q")), "pivots")
        v, p, q = F.col("_v"), F.col("_p"), F.col("_q")
        counts = {"_below": v < p, "_low": v == p, "_between": (v > p) & (v < q), "_high": (v == q) & (q > p)}
        met = near(pivots).groupBy(*held, "_p", "_q").agg(*[F.count_if(c).alias(c_name) for c_name, c in counts.items()])
        low, mid, high = (F.col("_below") + F.col("_low"), F.col("_below") + F.col("_low") + F.col("_between"), F.col("_below") + F.col("_low") + F.col("_between") + F.col("_high"))
        rank, where = F.col("rank"), lambda below, is_low, between, is_high, above: F.when(F.col("rank") <= F.col("_below"), below).when(F.col("rank") <= low, is_low).when(F.col("rank") <= mid, between).when(F.col("rank") <= high, is_high).otherwise(above)
        found = where(none, p, none, q, none)
        met = materialize(met.select(*own, "name", where(rank, rank, rank - low, rank, rank - high).alias("rank"), where(F.col("_below"), F.col("n"), F.col("_between"), F.col("n"), F.col("n") - high).alias("n"), where(F.col("_lo"), p, p, q, q).alias("_lo"), where(p, p, q, q, F.col("_hi")).alias("_hi"), found.alias("value")), "ranks")
        told.append(met.filter("value IS NOT NULL").select(*own, "name", "value"))
        state = met.filter("value IS NULL").select(*held)
    out = told[0]
    for more in told[1:]:
        out = out.unionByName(more)
    return out.select(*[F.col(o).alias(k) for k, o in zip(keys, own, strict=True)], "name", "value")


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, points: dict[str, float], linear: bool = False, large: int = LARGE_GROUP) -> DataFrame:
    """Keys and a column per point: nearest rank (the value at rank ceil(p n)), or linear interpolation.

    Groups of up to `large` values are sorted by a task each; the others are told from their counts and selected from in rounds.
    Values are finite; nulls are left out, and a group of nulls has null."""
    counts = rows.groupBy(*keys).agg(F.count(value).alias("_n"))
    if linear:
        sort = [F.percentile(value, p).alias(n) for n, p in points.items()]
    else:
        sort = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(n) for n, p in points.items()]
    hot = materialize(counts.filter(F.col("_n") > large), "large_groups")
    if hot.isEmpty():
        return rows.groupBy(*keys).agg(*sort)
    same = [F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(keys)]
    names = hot.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)])
    cool = rows.join(names, same or F.lit(True), "left_anti").groupBy(*keys).agg(*sort)
    if not keys:
        cool = cool.limit(0)
    exact = lambda n, p: n.cast("decimal(20,0)") * F.lit(str(p)).cast("decimal(12,10)")  # noqa: E731  a product of doubles may miss a whole rank
    at = {n: exact(F.col("_n") - 1, p) if linear else F.greatest(F.ceil(exact(F.col("_n"), p)) - 1, F.lit(0)) for n, p in points.items()}
    wanted = [F.struct(F.lit(f"{n}/{end}").alias("name"), (F.floor(x) if end == "low" else F.ceil(x)).cast("long").alias("at")) for n, x in at.items() for end in ("low", "high")]
    ranks = hot.select(*keys, F.explode(F.array(*wanted)).alias("w"), "_n").select(*keys, "w.name", (F.col("w.at") + 1).alias("rank"), F.col("_n").alias("n"))
    large_rows = rows.join(names, same or F.lit(True), "left_semi")
    found = at_ranks(large_rows, keys, value, ranks, max(1, large))
    ends = found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == f"{n}/{end}", F.col("value"))).alias(f"_{n}_{end}") for n in points for end in ("low", "high")])
    sized = hot.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], "_n")
    both = ends.join(sized, same or F.lit(True))
    share = {n: (at[n] - F.floor(at[n])).cast("double") for n in points}
    told = both.select(*keys, *[(F.col(f"_{n}_low") + share[n] * (F.col(f"_{n}_high") - F.col(f"_{n}_low"))).alias(n) for n in points])
    return cool.unionByName(told)
