"""Order within groups of any size: rows dealt by ranges of the order, running sums, carried rows, order statistics.

A group may hold most rows of a table, so no window here is over a group. Rows are dealt by ranges of (group, order);
what a range needs of those before or after it is a row for each group and range. Order statistics are not sorted for at
all: counts tell in which stretch of values the wanted rank lies, and only the different values of that stretch are
ordered.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: The accuracy of the sketch that proposes a stretch of values. It decides how long the stretch is, not the result.
ACCURACY = 10_000
#: Rows between which a window over rows of a group is split.
SEGMENT = 1 << 16


def same(left: str, right: str, columns: list[str]) -> Column:
    """Equal columns of two aliases, nulls included."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def settled(df: DataFrame, what: str) -> DataFrame:
    """df, which is to be read several times: as a stored table if making it deals rows out, else as it is."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return stored(df, what) if re.search(r"^\W*(?:Window|Join|Aggregate|Repartition|Sort)", plan, re.M) else df


def laid(df: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """df with _part, the number of a row's range of (by, order), as a stored table.

    The order must be total. It is stored because Spark samples the ranges' bounds anew each time it deals by them.
    """
    dealt = df.repartitionByRange(*[F.col(c) for c in by], *[F.col(c) if isinstance(c, str) else c for c in order])
    return stored(dealt.withColumn("_part", F.spark_partition_id()), "ranges")


def running_sum(df: DataFrame, value: str, order: list[str], name: str, inclusive: bool = True, by: list[str] | None = None) -> DataFrame:
    """df with running sums over each group (or the whole table): within ranges, then over the ranges' totals."""
    by = list(by or [])
    rows = laid(df, by, order)
    inner = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "_part").agg(F.sum(value).alias("_total"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")
    summed = rows.withColumn("_sum", F.sum(value).over(inner))
    joined = summed.alias("d").join(before.alias("b"), same("d", "b", [*by, "_part"])).select("d.*", "b._before")
    total = F.col("_sum") + F.col("_before")
    return joined.withColumn(name, total if inclusive else total - F.coalesce(F.col(value), F.lit(0))).drop("_part", "_sum", "_before")


def numbered(df: DataFrame, order: list[str], name: str, by: list[str] | None = None) -> DataFrame:
    """df with 0, 1, ... in a total order of each group."""
    return running_sum(df.withColumn("_one", F.lit(1).cast("long")), "_one", order, name, inclusive=False, by=by).drop("_one")


def carried(df: DataFrame, by: list[str], order: list[Column], at: Column, value: Column, back: str | None = None, fore: str | None = None) -> DataFrame:
    """df with the last value (column `back`) up to each row in order and the first one (`fore`) from it on.

    Rows whose value is null are passed over. `at` orders the values as `order` orders their rows. Ranges that hold no
    value get that of the nearest range that does.
    """
    rows = laid(df.withColumn("_value", value).withColumn("_at", F.when(value.isNotNull(), at)), by, order)
    inner = Window.partitionBy("_part", *by).orderBy(*order)
    outer = Window.partitionBy(*by).orderBy("_part")
    edges = rows.groupBy(*by, "_part").agg(F.max_by("_value", "_at").alias("_l"), F.min_by("_value", "_at").alias("_f"))
    edges = edges.withColumn("_l", F.last("_l", ignorenulls=True).over(outer.rowsBetween(Window.unboundedPreceding, -1)))
    edges = edges.withColumn("_f", F.first("_f", ignorenulls=True).over(outer.rowsBetween(1, Window.unboundedFollowing)))
    if back:
        rows = rows.withColumn("_back", F.last("_value", ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    if fore:
        rows = rows.withColumn("_fore", F.first("_value", ignorenulls=True).over(inner.rowsBetween(0, Window.unboundedFollowing)))
    out = rows.alias("d").join(edges.alias("e"), same("d", "e", [*by, "_part"]))
    got = [F.coalesce(F.col(f"d.{local}"), F.col(f"e.{far}")).alias(name) for name, local, far in ((back, "_back", "_l"), (fore, "_fore", "_f")) if name]
    return out.select(*[F.col(f"d.{c}") for c in df.columns], *got)


def moving(df: DataFrame, by: list[str], order: list[str], size: int, columns: dict[str, Column]) -> DataFrame:
    """df with aggregates over the last `size` rows of each group, and _n, the row's number in its group (from 0).

    Groups are cut into segments of SEGMENT rows by number; a segment also gets the last size - 1 rows of the one before.
    """
    segment = max(SEGMENT, size)
    rows = numbered(df, order, "_n", by)
    own, place = F.floor(F.col("_n") / segment), F.col("_n") % segment
    ahead = F.when(place > segment - size, F.array(own, own + 1)).otherwise(F.array(own))
    rows = rows.withColumn("_segment", F.explode(ahead))
    w = Window.partitionBy(*by, "_segment").orderBy("_n").rowsBetween(1 - size, 0)
    return rows.withColumns({k: c.over(w) for k, c in columns.items()}).where(own == F.col("_segment")).drop("_segment")


def order_statistics(df: DataFrame, by: list[str], value: str, wanted: list[tuple[float, list[Column]]], *aggs: Column) -> tuple[DataFrame, DataFrame]:
    """(groups, found): of each group n, its rows with a value, and aggs; and by, point, rank, x, the values of wanted ranks.

    wanted: for each point about which share of the values lies below it, and exact ranks (from 0) in terms of column n.
    A sketch proposes the stretch of values in which a point lies, then values below and in it are counted. The rank is
    looked up there, or in what is below or above if the sketch was wrong: the result is exact either way.
    """
    near, x = 2 / ACCURACY, F.col(value)
    ends = [e for share, _ in wanted for e in (max(0.0, share - near), min(1.0, share + near))]
    some = df.where(x.isNotNull())
    groups = df.groupBy(*by).agg(F.count(x).alias("n"), F.percentile_approx(x, ends, ACCURACY).alias("_ends"), *aggs)

    bounds = groups.where("n > 0").select(*by, "n", "_ends")  # a row for each group
    below = [F.count_if(x < F.col("_ends")[2 * i]).alias(f"_b{i}") for i in range(len(wanted))]
    upto = [F.count_if(x <= F.col("_ends")[2 * i + 1]).alias(f"_u{i}") for i in range(len(wanted))]
    counts = some.alias("d").join(bounds.alias("b"), same("d", "b", by)).select(*[f"d.{c}" for c in by], f"d.{value}", "b._ends").groupBy(*by).agg(*below, *upto)
    counts = counts.alias("c").join(bounds.alias("b"), same("c", "b", by)).select("c.*", "b.n", "b._ends")
    points = []
    for i, (_, ranks) in enumerate(wanted):
        lo, hi, b, u = F.col("_ends")[2 * i], F.col("_ends")[2 * i + 1], F.col(f"_b{i}"), F.col(f"_u{i}")
        for rank in ranks:
            r = rank.cast("long")
            zone = F.when(r < b, -1).when(r < u, 0).otherwise(1)
            points.append(F.struct(F.lit(i).alias("point"), r.alias("rank"), zone.alias("zone"), lo.alias("lo"), hi.alias("hi"), F.when(r < b, F.lit(0)).when(r < u, b).otherwise(u).alias("before")))
    points = counts.select(*by, F.explode(F.array_distinct(F.array(*points))).alias("_p")).select(*by, "_p.*")

    # each row beside the few stretches of its group in which it lies
    stretches = points.groupBy(*by).agg(F.collect_set(F.struct("point", "zone", "lo", "hi")).alias("_z"))
    near_rows = some.alias("d").join(stretches.alias("z"), same("d", "z", by)).select(*[f"d.{c}" for c in by], F.col(f"d.{value}").alias("x"), "z._z")
    v = F.col("x")
    near_rows = near_rows.select(*by, "x", F.explode(F.filter("_z", lambda z: F.when(z["zone"] < 0, v < z["lo"]).when(z["zone"] > 0, v > z["hi"]).otherwise((v >= z["lo"]) & (v <= z["hi"])))).alias("_z"))
    held = near_rows.groupBy(*by, F.col("_z.point").alias("point"), F.col("_z.zone").alias("zone"), "x").agg(F.count(F.lit(1)).alias("_c"))
    held = held.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*by, "point", "zone").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)))
    found = held.alias("h").join(points.alias("p"), same("h", "p", [*by, "point", "zone"])).select(*[f"h.{c}" for c in by], "h.point", "p.rank", "h.x", "h._c", (F.col("p.rank") - F.col("p.before")).alias("_r"), "h._upto")
    return groups.drop("_ends"), found.where((F.col("_r") < F.col("_upto")) & (F.col("_r") >= F.col("_upto") - F.col("_c"))).select(*by, "point", "rank", "x")


def quantiles(df: DataFrame, by: list[str], value: str, points: dict[str, float], *aggs: Column) -> DataFrame:
    """by, n (rows with a value), aggs and exact quantiles by linear interpolation; null for a group without values."""
    keys, src = (by, df) if by else (["_all"], df.withColumn("_all", F.lit(0)))
    at = {k: (F.lit(p) * (F.col("n") - 1)) for k, p in points.items()}
    groups, found = order_statistics(src, keys, value, [(p, [F.floor(at[k]), F.ceil(at[k])]) for k, p in points.items()], *aggs)
    if not by:
        groups = df.agg(F.count(value).alias("n"), *aggs).withColumn("_all", F.lit(0))  # a row for an empty table, too
    pairs = found.groupBy(*keys, "point").agg(F.min(F.struct("rank", "x"))["x"].alias("lo"), F.max(F.struct("rank", "x"))["x"].alias("hi"))
    wide = pairs.groupBy(*keys).agg(*[F.max(F.when(F.col("point") == i, F.struct("lo", "hi"))).alias(f"_q{i}") for i in range(len(points))])
    out = groups.alias("g").join(wide.alias("w"), same("g", "w", keys), "left").select("g.*", *[f"w._q{i}" for i in range(len(points))])
    for i, k in enumerate(points):
        part = at[k] - F.floor(at[k])
        lo, hi = F.col(f"_q{i}.lo"), F.col(f"_q{i}.hi")
        out = out.withColumn(k, F.when(part == 0, lo.cast("double")).otherwise(lo * (1 - part) + hi * part))
    return out.drop(*[f"_q{i}" for i in range(len(points))], *(["_all"] if not by else []))
