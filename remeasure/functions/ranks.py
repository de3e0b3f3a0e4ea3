"""Places and quantiles within groups, without gathering a large group in one task."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remeasure.functions.columns import finite
from remeasure.session import stored

#: Groups of up to so many values are aggregated whole; in larger ones sketches say where to look.
WHOLE_GROUP = 100_000
#: From so many rows a group on average, groups are sorted as arrays; the built-in aggregate holds each value as an object.
ARRAY_GROUP = 200
#: Values of a sketch, four times as fine as the narrowest margin, and the shares of a group that are searched on each side of a quantile.
_SKETCH, _MARGINS = 4_000, (0.001, 0.02, 1.0)


def same(left: str, right: str, columns: list[str]) -> Column:
    """Null-safe equality of two aliased tables on ``columns``."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns], F.lit(True))


def numbered(df: DataFrame, keys: list[str], slot: Column, order: list[Column]) -> DataFrame:
    """``df`` with group_size and place (from 0) of each row in its group by (slot, order).

    slot must rise with the order. Rows are numbered within (keys, slot) and the sizes of earlier
    slots are added, so a group is spread over as many tasks as it has slots.
    """
    marked = df.withColumn("_slot", slot)
    slots = marked.groupBy(*keys, "_slot").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)
    before = group.orderBy(F.col("_slot").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    starts = slots.select(*keys, "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(group).alias("group_size"))
    place = F.row_number().over(Window.partitionBy(*keys, "_slot").orderBy(*order)) - 1
    joined = marked.withColumn("_place", place).alias("r").join(starts.alias("s"), same("r", "s", [*keys, "_slot"]))
    return joined.select("r.*", "s.group_size", (F.col("s._start") + F.col("r._place")).alias("place")).drop("_slot", "_place")


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], whole: int = WHOLE_GROUP, kept: bool = False) -> DataFrame:
    """(keys..., one column for each of ``quantiles``): exact, linearly interpolated quantiles of the finite values."""
    return column_quantiles(df, keys, {value: quantiles}, whole, kept)


def column_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, dict[str, float]], whole: int = WHOLE_GROUP, kept: bool = False) -> DataFrame:
    """(keys..., one column for each name in ``wanted``), where wanted is {column: {name: quantile}}.

    Quantiles are exact, linearly interpolated and taken over the finite values of their column,
    null where a group has none there. Groups without any finite value have no row; null keys are
    a group. Rows are written once, unless ``kept`` says that they can be read again as they are.

    Groups of up to ``whole`` rows use the built-in aggregate, all columns at once. For larger ones
    sketches give bounds around each quantile, values below them are counted, and those between them
    alone are sorted.
    """
    columns = list(wanted)
    rows = df.select(*keys, *[finite(F.col(c).cast("double")).alias(f"_v{i}") for i, c in enumerate(columns)])
    rows = rows.where(reduce(lambda a, b: a | b, [F.col(f"_v{i}").isNotNull() for i in range(len(columns))]))
    rows = rows if kept else stored(rows)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    aggregates = [F.percentile(f"_v{i}", F.array(*[F.lit(float(q)) for q in wanted[c].values()])).alias(f"_q{i}") for i, c in enumerate(columns)]
    picked = [F.col(f"_q{i}")[k].alias(name) for i, c in enumerate(columns) for k, name in enumerate(wanted[c])]
    small = lambda some: some.groupBy(*keys).agg(*aggregates).select(*keys, *picked)
    groups, total, largest = sizes.agg(F.count("*"), F.sum("_n"), F.max("_n")).first()
    if groups and total >= ARRAY_GROUP * groups and total > 10_000:
        small = lambda some: _array_quantiles(some, keys, list(wanted.values()))
    if (largest or 0) <= whole:
        return small(rows)
    large = stored(sizes.where(F.col("_n") > whole).select(*keys, F.lit(True).alias("_large")))
    marked = rows.alias("r").join(large.alias("l"), same("r", "l", keys), "left").select("r.*", "_large")
    return small(marked.where("_large is null").drop("_large")).unionByName(_long_quantiles(marked.where("_large").drop("_large"), keys, list(wanted.values())))


def interpolated(values: np.ndarray, quantiles: Iterable[float]) -> list[float | None]:
    """Linearly interpolated quantiles of the finite ``values``, None without any."""
    values = np.sort(values[np.isfinite(values)])
    found = []
    for q in quantiles:
        x = None
        if len(values):
            at = q * (len(values) - 1)
            low = int(at)
            a, b = values[low], values[min(low + 1, len(values) - 1)]
            x = float(a if a == b else (low + 1 - at) * a + (at - low) * b)
        found.append(x)
    return found


def _array_quantiles(rows: DataFrame, keys: list[str], wanted: list[dict[str, float]]) -> DataFrame:
    """The quantiles of groups that fit a task; ``rows`` has the keys and a column _v0, _v1, ... for each of ``wanted``."""
    schema = ", ".join([*[f"`{k}` {kind}" for k, kind in rows.dtypes if k in keys], *[f"`{n}` double" for names in wanted for n in names]])

    def quantiles(group: pa.Table) -> pa.Table:
        out = {k: group.column(k).slice(0, 1) for k in keys}
        for i, names in enumerate(wanted):
            for name, x in zip(names, interpolated(group.column(f"_v{i}").drop_null().to_numpy(), names.values())):
                out[name] = pa.array([x], pa.float64())
        return pa.table(out)

    return rows.select(*keys, *[f"_v{i}" for i in range(len(wanted))]).groupBy(*keys).applyInArrow(quantiles, schema)


def _long_quantiles(rows: DataFrame, keys: list[str], wanted: list[dict[str, float]], margins: tuple[float, ...] = _MARGINS) -> DataFrame:
    """The quantiles of groups of any size; ``rows`` has the keys and a column _v0, _v1, ... for each of ``wanted``.

    A sketch's bounds only say where to look: ranks are counted exactly, and groups whose rank lies
    beyond them are searched again with wider ones.
    """
    names = [(i, n, float(q)) for i, columns in enumerate(wanted) for n, q in columns.items()]
    edges = [[e for _, q in columns.items() for e in (max(q - margins[0], 0.0), min(q + margins[0], 1.0))] for columns in wanted]
    sketches = [c for i, e in enumerate(edges) for c in (F.count(f"_v{i}").alias(f"_n{i}"), F.percentile_approx(f"_v{i}", e, _SKETCH).alias(f"_e{i}"))]
    bounds = stored(rows.groupBy(*keys).agg(*sketches))
    bound = [(i, 2 * list(wanted[i]).index(n)) for i, n, _ in names]
    flat = bounds.select(*keys, *[F.col(f"_e{i}")[k + up].alias(f"_{end}{w}") for w, (i, k) in enumerate(bound) for up, end in enumerate(("lo", "hi"))])
    met = rows.alias("r").join(F.broadcast(flat).alias("e"), same("r", "e", keys)).select("r.*", *[f"e.{c}" for c in flat.columns if c not in keys])
    inside = [(F.col(f"_v{i}") >= F.col(f"_lo{w}")) & (F.col(f"_v{i}") <= F.col(f"_hi{w}")) for w, (i, _, _) in enumerate(names)]
    below = met.groupBy(*keys).agg(*[F.count_if(F.col(f"_v{i}") < F.col(f"_lo{w}")).alias(f"_b{w}") for w, (i, _, _) in enumerate(names)])
    found = [F.when(c, F.struct(F.lit(w).alias("_w"), F.col(f"_v{i}").alias("_v"))) for w, ((i, _, _), c) in enumerate(zip(names, inside))]
    near = met.where(reduce(lambda a, b: a | b, inside)).select(*keys, F.inline(F.array_compact(F.array(*found)))).groupBy(*keys, "_w", "_v").agg(F.count("*").alias("_m"))
    each = F.inline(F.array(*[F.struct(F.lit(w).alias("_w"), (F.lit(q) * (F.col(f"_n{i}") - 1)).alias("_at"), F.col(f"_n{i}").alias("_n"), F.col(f"_b{w}").alias("_b")) for w, (i, _, q) in enumerate(names)]))
    ranks = bounds.alias("n").join(below.alias("b"), same("n", "b", keys)).select("n.*", *[f"b._b{w}" for w in range(len(names))]).select(*keys, each).where("_n > 0")
    run = Window.partitionBy(*keys, "_w").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_to", F.sum("_m").over(run))
    holds = lambda rank: (rank < F.col("b._b") + F.col("r._to")) & (rank >= F.col("b._b") + F.col("r._to") - F.col("r._m"))
    ends = ranks.alias("b").join(near.alias("r"), same("b", "r", [*keys, "_w"]), "left").groupBy(*[F.col(f"b.{k}").alias(k) for k in keys], F.col("b._w").alias("_w"), F.col("b._at").alias("_at")).agg(
        F.max(F.when(holds(F.floor("b._at")), F.col("r._v"))).alias("_low"),
        F.max(F.when(holds(F.least(F.floor("b._at") + 1, F.col("b._n") - 1)), F.col("r._v"))).alias("_high"),
    )
    ends = stored(ends)
    x = F.col("_low") + (F.col("_at") - F.floor("_at")) * (F.col("_high") - F.col("_low"))
    missed = ends.where("_low is null or _high is null").select(*keys).distinct()
    if len(margins) == 1 or missed.isEmpty():
        return ends.groupBy(*keys).agg(*[F.max(F.when(F.col("_w") == w, x)).alias(n) for w, (_, n, _) in enumerate(names)])
    missed = stored(missed)
    again = rows.alias("r").join(missed.alias("m"), same("r", "m", keys), "left_semi")
    known = ends.alias("e").join(missed.alias("m"), same("e", "m", keys), "left_anti")
    done = known.groupBy(*keys).agg(*[F.max(F.when(F.col("_w") == w, x)).alias(n) for w, (_, n, _) in enumerate(names)])
    return done.unionByName(_long_quantiles(again, keys, wanted, margins[1:]))
