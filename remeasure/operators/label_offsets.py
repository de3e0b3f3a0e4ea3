"""Offsets of program-and-night labels from pairs, tested on held-out sources.

All models of an experiment go through each step together. A pair is kept once for each run (the
experiment itself, or one shuffle of nights); which of the run's models (folds, halves) use it, and
the weights it has there, are arrays with one place for each model. A pair of labels enters a fit
by its weighted sums only. Sums of a model of up to LOCAL_SUMS rows are solved in one task, models
in parallel; larger ones by the same conjugate gradients in rounds of joins and sums. Shuffles of up
to LOCAL_PAIRS pairs go through all steps in one task for some of the models, on one copy of the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remeasure.functions.columns import is_finite
from remeasure.functions.ranks import column_quantiles, grouped_quantiles, interpolated, numbered, same
from remeasure.session import stored

#: Shuffles of a null distribution.
DEFAULT_PERMUTATIONS = 20
#: Rows of sums (pairs of labels) of one run that are solved in one task; a row takes about 60 bytes there.
LOCAL_SUMS = 10_000_000
#: Pairs of shuffles that one task holds; a pair takes about 200 bytes there.
LOCAL_PAIRS = 5_000_000
#: Rows of sums that are gone through at a time.
_CHUNK = 1_000_000
#: Rows that a product with the matrix goes through at a time; they stay in the processor's cache.
_PIECE = 50_000
#: A solution's residual relative to the right side, and the most rounds to reach it.
TOLERANCE, MOST_ROUNDS = 1e-11, 2_000


@dataclass(frozen=True)
class OffsetRules:
    min_delta_days: float = 1.0
    min_pairs_per_label: int = 200
    max_abs_z: float = 5.0
    clip: float = 3.5
    clip_rounds: int = 3
    damp: float = 0.2
    folds: int = 5
    #: Weigh a pair by the number of pairs of its group.
    balance_groups: bool = True
    #: Centre the offsets of each component on its mean; else all on their median.
    center_components: bool = True


def hashed(c: Column, k: int) -> Column:
    """A number from 0 to k - 1 from the text of ``c``; the same in any engine with md5."""
    return (F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint") % k).cast("int")


def _label_part(c: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(F.trim(c.cast("string"))), F.lit("")), F.lit("UNKNOWN"))


def label_of(program: Column, night: Column) -> Column:
    return F.concat_ws(":", _label_part(program), _label_part(night))


def _usable(pairs: DataFrame, rules: OffsetRules) -> DataFrame:
    d, err, formal = F.col("DELTA_VRAD"), F.col("PAIR_ERROR"), F.col("PAIR_ERROR_FORMAL")
    return pairs.where(F.col("GROUP_ID").isNotNull() & is_finite(d) & is_finite(err) & is_finite(formal) & (err > 0) & (formal > 0) & (F.col("DELTA_DAYS") > rules.min_delta_days))


def _narrow(pairs: DataFrame) -> list[Column]:
    kind = F.col("GROUP_KIND") if "GROUP_KIND" in pairs.columns else F.lit("UNKNOWN")
    return [F.col("GROUP_ID"), kind.alias("GROUP_KIND"), F.col("PROGRAM_PAIR"), F.col("DELTA_VRAD").alias("d"), F.col("PAIR_ERROR").alias("err"), F.col("PAIR_ERROR_FORMAL").alias("formal")]


def prepare(pairs: DataFrame, rules: OffsetRules = OffsetRules()) -> DataFrame:
    """(run, GROUP_ID, GROUP_KIND, PROGRAM_PAIR, d, err, formal, L1, L2) of the pairs that can be used; run is 0.

    Group known, difference and both errors finite, errors above 0, more than ``min_delta_days``
    apart, and two different labels.
    """
    labels = [label_of(F.col(f"PROGRAM_{k}"), F.col(f"NIGHT_{k}")).alias(f"L{k}") for k in (1, 2)]
    return _usable(pairs, rules).select(F.lit(0).alias("run"), *_narrow(pairs), *labels).where("L1 <> L2")


def _each(k: int, f) -> Column:
    """An array with f(m) for each of k models."""
    return F.array(*[f(m) for m in range(k)])


def with_use(rows: DataFrame, models: int, used: str) -> DataFrame:
    """``rows`` with fold (by hash of the group) and use: for 'others' model m trains on all folds but m, for 'own' on fold m alone."""
    if "fold" not in rows.columns:
        rows = rows.withColumn("fold", hashed(F.col("GROUP_ID"), models))
    return rows.withColumn("use", _each(models, lambda m: (F.col("fold") == m) if used == "own" else (F.col("fold") != m)))


def endpoint_counts(rows: DataFrame, models: int) -> DataFrame:
    """(run, label, n): how often each label ends a pair, for each model."""
    ends = rows.select("run", F.explode(F.array("L1", "L2")).alias("label"), "use")
    counts = ends.groupBy("run", "label").agg(*[F.count_if(F.col("use")[m]).alias(f"n{m}") for m in range(models)])
    return counts.select("run", "label", _each(models, lambda m: F.col(f"n{m}")).alias("n"))


def kept_pairs(rows: DataFrame, models: int, rules: OffsetRules) -> DataFrame:
    """``rows`` with use only where both labels have enough endpoints and the pair is within ``max_abs_z`` errors; without rows that no model uses."""
    enough = stored(endpoint_counts(rows, models).select("run", "label", F.transform("n", lambda n: n >= rules.min_pairs_per_label).alias("enough")).where(F.exists("enough", lambda x: x)))
    for k in (1, 2):
        rows = rows.join(enough.select("run", F.col("label").alias(f"L{k}"), F.col("enough").alias(f"e{k}")), ["run", f"L{k}"])
    near = F.abs(F.col("d") / F.col("err")) <= rules.max_abs_z
    use = _each(models, lambda m: F.col("use")[m] & F.col("e1")[m] & F.col("e2")[m])
    return rows.where(near).withColumn("use", use).drop("e1", "e2").where(F.exists("use", lambda x: x))


def pair_sums(work: DataFrame, models: int, balance_groups: bool = True) -> DataFrame:
    """(run, m, L1, L2, s0, s1, s2, n): weighted sums of the pairs in ``kept`` for each model and two labels in order.

    Labels joined only by pairs that a model uses but doesn't keep have sums of 0 there, so its graph
    stays as it was.
    """
    rows, size = work, lambda m: F.lit(1.0)
    if balance_groups:
        sizes = work.groupBy("run", "GROUP_ID").agg(*[F.count_if(F.col("kept")[m]).alias(f"g{m}") for m in range(models)])
        rows, size = work.join(sizes, ["run", "GROUP_ID"]), lambda m: F.col(f"g{m}")
    w = lambda m: F.when(F.col("kept")[m], 1 / (F.col("err") * F.col("err") * size(m))).otherwise(F.lit(0.0))
    d = F.when(F.col("L1") <= F.col("L2"), F.col("d")).otherwise(-F.col("d"))
    sums = [F.struct(F.sum(w(m)).alias("s0"), F.sum(w(m) * d).alias("s1"), F.sum(w(m) * d * d).alias("s2"), F.count_if(F.col("kept")[m]).alias("n"), F.max(F.col("use")[m]).alias("used")).alias(f"m{m}") for m in range(models)]
    found = rows.groupBy("run", F.least("L1", "L2").alias("a"), F.greatest("L1", "L2").alias("b")).agg(*sums)
    long = found.select("run", "a", "b", F.posexplode(_each(models, lambda m: F.col(f"m{m}"))).alias("m", "s")).where("s.used")
    return long.select("run", "m", F.col("a").alias("L1"), F.col("b").alias("L2"), "s.s0", "s.s1", "s.s2", "s.n")


def _chunks(*arrays: np.ndarray):
    for k in range(0, len(arrays[0]), _CHUNK):
        yield tuple(x[k : k + _CHUNK] for x in arrays)


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers from 0 of the connected parts of n labels, by their smallest label."""
    low = np.arange(n)
    while True:
        before = low.copy()
        for i, j in _chunks(a, b):
            least = np.minimum(low[i], low[j])
            np.minimum.at(low, i, least)
            np.minimum.at(low, j, least)
        low = low[low]
        if (low == before).all():
            return np.unique(low, return_inverse=True)[1]


def _by_label(n: int, at: np.ndarray, other: np.ndarray, w: np.ndarray, order: np.ndarray | None = None) -> list[tuple[np.ndarray, ...]]:
    """Rows ordered by the label ``at`` (by ``order``, where that is known), in pieces of whole labels: (labels, where each begins, other, w)."""
    order = np.argsort(at, kind="stable") if order is None else order
    count = np.bincount(at, minlength=n)
    labels = np.flatnonzero(count)
    ends = np.cumsum(count[labels])
    starts = ends - count[labels]
    other, w = other[order].astype(np.intp), w[order]
    cuts = [*np.unique(starts // min(_PIECE, _CHUNK), return_index=True)[1], len(labels)]
    return [(labels[i:j], starts[i:j] - starts[i], other[starts[i] : ends[j - 1]], w[starts[i] : ends[j - 1]]) for i, j in zip(cuts, cuts[1:])]


def conjugate_gradients(n: int, a: np.ndarray, b: np.ndarray, s0: np.ndarray, s1: np.ndarray, damp: float, orders: tuple = (None, None)) -> np.ndarray:
    """x with (A + damp^2) x = right, where A and right are the normal equations of the sums of n labels; nothing of size n x n is made.

    ``orders`` are those of the rows by a and by b, where they are known.
    """
    diagonal, right = np.full(n, damp**2), np.zeros(n)
    for i, j, w, v in _chunks(a, b, s0, s1):
        diagonal += np.bincount(i, w, n) + np.bincount(j, w, n)
        right += np.bincount(i, v, n) - np.bincount(j, v, n)
    pieces = [*_by_label(n, a, b, s0, orders[0]), *_by_label(n, b, a, s0, orders[1])]
    inverse = np.divide(1.0, diagonal, out=np.zeros(n), where=diagonal > 0)
    room = np.empty(max((len(piece[3]) for piece in pieces), default=0))
    x, r = np.zeros(n), right.copy()
    z = r * inverse
    p, rz = z.copy(), float(r @ z)
    goal = TOLERANCE**2 * rz
    for _ in range(MOST_ROUNDS):
        if rz <= goal or rz == 0:
            break
        product = diagonal * p
        for labels, starts, other, w in pieces:
            rows = np.take(p, other, out=room[: len(w)], mode="clip")
            rows *= w
            product[labels] -= np.add.reduceat(rows, starts)
        step = rz / float(p @ product)
        x += step * p
        r -= step * product
        z = r * inverse
        rz, before = float(r @ z), rz
        p = z + rz / before * p
    return x


def _solve(n: int, a: np.ndarray, b: np.ndarray, s0: np.ndarray, s1: np.ndarray, damp: float, center_components: bool) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and components of n labels, all of which a row holds."""
    x, part = conjugate_gradients(n, a, b, s0, s1, damp), _components(n, a, b)
    return _centred(x, part) if center_components or damp == 0 else x, part


def _centred(x: np.ndarray, part: np.ndarray) -> np.ndarray:
    return x - (np.bincount(part, x) / np.bincount(part))[part]


def solve_sums(sums: pd.DataFrame, damp: float, center_components: bool) -> pd.DataFrame:
    """Damped least squares of one model: label, offset and component."""
    labels = np.unique(np.concatenate([sums["L1"], sums["L2"]]))
    a, b = np.searchsorted(labels, sums["L1"]), np.searchsorted(labels, sums["L2"])
    x, part = _solve(len(labels), a, b, sums["s0"].to_numpy(float), sums["s1"].to_numpy(float), damp, center_components)
    return pd.DataFrame({"label": labels, "offset": x, "component": part.astype("int64")})


_MODEL = ["run", "m"]


def _coded(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, list[np.ndarray], object]:
    """The sorted labels of a run's sums, its rows as numbers (m, L1, L2, s0, s1) and its name; texts live no longer than their batch."""
    known: dict[str, int] = {}
    kinds, found, run = (np.int16, np.int32, np.int32, np.float64, np.float64), [[], [], [], [], []], None
    for batch in batches:
        if not batch.num_rows:
            continue
        run = batch.column("run")[0].as_py()
        row = [batch.column("m"), *[batch.column(c).dictionary_encode() for c in ("L1", "L2")], batch.column("s0"), batch.column("s1")]
        for k in (1, 2):
            codes = np.array([known.setdefault(x, len(known)) for x in row[k].dictionary.to_pylist()], np.int32)
            row[k] = codes[row[k].indices.to_numpy()]
        for to, kind, x in zip(found, kinds, row):
            to.append(np.asarray(x).astype(kind))
    rows = []
    while found:
        rows.append(np.concatenate(found.pop(0)))
    labels = np.array(list(known), object)
    order = np.argsort(labels)
    rank = np.empty(len(labels), np.int32)
    rank[order] = np.arange(len(labels), dtype=np.int32)
    rows[1], rows[2] = rank[rows[1]], rank[rows[2]]
    return labels[order], rows, run


def _run_solver(models: int, rules: OffsetRules, kind: str):
    """The offsets of all models of a run, side by side: one row for each label."""
    kinds = {"int": pa.int32(), "bigint": pa.int64()}
    schema = pa.schema([("run", kinds.get(kind, pa.string())), ("label", pa.string()), ("o", pa.list_(pa.float64())), ("c", pa.list_(pa.int64()))])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, (m, *rows), run = _coded(batches)
        offset, component = np.full((len(labels), models), np.nan), np.full((len(labels), models), -1)
        for model in range(models):
            a, b, s0, s1 = [x[m == model] for x in rows] if models > 1 else rows
            if not len(a):
                continue
            there = np.zeros(len(labels), bool)
            there[a] = there[b] = True
            at = (np.cumsum(there) - 1).astype(np.int32)
            offset[there, model], component[there, model] = _solve(int(there.sum()), at[a], at[b], s0, s1, rules.damp, rules.center_components)
        for k in range(0, len(labels), 10_000):
            some = slice(k, k + 10_000)
            n = len(labels[some])
            lists = [pa.ListArray.from_arrays(np.arange(0, n * models + 1, models, dtype=np.int32), pa.array(x[some].ravel(), mask=component[some].ravel() < 0)) for x in (offset, component)]
            yield pa.RecordBatch.from_arrays([pa.array([run] * n, schema.field("run").type), pa.array(labels[some], pa.string()), *lists], schema=schema)

    return solve


def _solved(sums: DataFrame, models: int, rules: OffsetRules, largest: int) -> DataFrame:
    """(run, label, o, c): the offset and component of each label in every model, null where the model lacks it.

    Component 0 is that of the smallest label, and so on. ``largest`` is the most rows of sums of a run.
    """
    if largest <= LOCAL_SUMS:
        kind = dict(sums.dtypes)["run"]
        return stored(sums.select("run", "m", "L1", "L2", "s0", "s1").groupBy("run").applyInArrow(_run_solver(models, rules, kind), f"run {kind}, label string, o array<double>, c array<bigint>"))
    column = lambda c: _each(models, lambda m: F.max(F.when(F.col("m") == m, F.col(c))))
    return stored(_solved_in_rounds(sums, rules).groupBy("run", "label").agg(column("offset").alias("o"), column("component").alias("c")))


def _long(wide: DataFrame) -> DataFrame:
    """(run, m, label, offset, component)."""
    rows = wide.select("run", "label", F.posexplode(F.arrays_zip("o", "c")).alias("m", "x"))
    return rows.where("x.o is not null").select("run", "m", "label", F.col("x.o").alias("offset"), F.col("x.c").alias("component"))


def _sizes(sums: DataFrame, models: int) -> tuple[int, list[tuple]]:
    """The most rows of a run, and the (run, m) of which nothing is kept; one row for each model comes to the driver."""
    rows = sums.groupBy(*_MODEL).agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()
    runs: dict = {}
    for r in rows:
        runs[r["run"]] = runs.get(r["run"], 0) + r["rows"]
    return max(runs.values(), default=0), [(r["run"], r["m"]) for r in rows if not r["n"]]


def _graph_parts(edges: DataFrame) -> DataFrame:
    """(run, m, label, component) of models whose graph is too large for a task: least labels over edges, with pointer jumping.

    ``edges`` has both directions (label, other). Components are numbered by their smallest label.
    """
    own = [*_MODEL, "label"]
    state = stored(edges.groupBy(*own).agg(F.min("other").alias("low")).withColumn("low", F.least("label", "low")))
    while True:
        heard = edges.join(state.select(*_MODEL, F.col("label").alias("other"), "low"), [*_MODEL, "other"]).groupBy(*own).agg(F.min("low").alias("heard"))
        jump = state.select(*_MODEL, F.col("label").alias("low"), F.col("low").alias("further"))
        fresh = state.join(heard, own).join(jump, [*_MODEL, "low"]).select(*own, F.least("low", "heard", "further").alias("fresh"), "low")
        fresh = stored(fresh.select(*own, F.col("fresh").alias("low"), (F.col("fresh") != F.col("low")).alias("moved")))
        state = fresh.drop("moved")
        if fresh.where("moved").isEmpty():
            break
    roots = numbered(state.where("label = low").select(*own), _MODEL, F.col("label"), [F.col("label")]).select(*_MODEL, F.col("label").alias("low"), F.col("place").alias("component"))
    return state.join(roots, [*_MODEL, "low"]).select(*own, "component")


def _solved_in_rounds(sums: DataFrame, rules: OffsetRules) -> DataFrame:
    """The same solution as ``solve_sums`` for models of any size: each product with the matrix is a join and a sum.

    Only whether all models have reached the tolerance comes to the driver.
    """
    own = [*_MODEL, "label"]
    forth = sums.select(*_MODEL, F.col("L1").alias("label"), F.col("L2").alias("other"), "s0", "s1")
    edges = stored(forth.unionByName(sums.select(*_MODEL, F.col("L2").alias("label"), F.col("L1").alias("other"), "s0", (-F.col("s1")).alias("s1"))))
    diagonal = F.sum("s0") + F.lit(rules.damp**2)
    state = edges.groupBy(*own).agg(diagonal.alias("diagonal"), F.sum("s1").alias("r"))
    scaled = lambda r: F.when(F.col("diagonal") > 0, r / F.col("diagonal")).otherwise(0.0)
    state = stored(state.select(*own, "diagonal", F.lit(0.0).alias("x"), "r", scaled(F.col("r")).alias("p")))
    rz = lambda: F.sum(F.col("r") * scaled(F.col("r")))
    goal = stored(state.groupBy(*_MODEL).agg((rz() * TOLERANCE**2).alias("goal")))
    for _ in range(MOST_ROUNDS):
        given = edges.join(state.select(*_MODEL, F.col("label").alias("other"), F.col("p").alias("q")), [*_MODEL, "other"])
        given = given.groupBy(*own).agg(F.sum(F.col("s0") * F.col("q")).alias("given"))
        state = stored(state.join(given, own).withColumn("product", F.col("diagonal") * F.col("p") - F.col("given")).drop("given"))
        step = stored(state.groupBy(*_MODEL).agg(rz().alias("rz"), F.sum(F.col("p") * F.col("product")).alias("curve")))
        along = F.when(F.col("curve") > 0, F.col("rz") / F.col("curve")).otherwise(0.0)
        moved = state.join(step, _MODEL).select(*own, "diagonal", (F.col("x") + along * F.col("p")).alias("x"), (F.col("r") - along * F.col("product")).alias("r"), "p", "rz")
        moved = stored(moved)
        after = stored(moved.groupBy(*_MODEL).agg(rz().alias("after")))
        turn = F.when(F.col("rz") > 0, F.col("after") / F.col("rz")).otherwise(0.0)
        state = stored(moved.join(after, _MODEL).select(*own, "diagonal", "x", "r", (scaled(F.col("r")) + turn * F.col("p")).alias("p")))
        if after.join(goal, _MODEL).where("after > goal").isEmpty():
            break
    solved = state.join(_graph_parts(edges.select(*own, "other").distinct()), own).select(*own, F.col("x").alias("offset"), "component")
    if rules.center_components or rules.damp == 0:
        means = solved.groupBy(*_MODEL, "component").agg(F.avg("offset").alias("mean"))
        solved = solved.join(means, [*_MODEL, "component"]).select(*own, (F.col("offset") - F.col("mean")).alias("offset"), "component")
    return stored(solved)


def with_offsets(rows: DataFrame, wide: DataFrame, models: int) -> DataFrame:
    """``rows`` with change (offset of L1 less that of L2, null without them) and together (one component) for each model.

    A label has one row with its offsets in all models, so a pair is joined twice, whatever the number of models.
    """
    for k in (1, 2):
        rows = rows.join(wide.select("run", F.col("label").alias(f"L{k}"), F.col("o").alias(f"o{k}"), F.col("c").alias(f"c{k}")), ["run", f"L{k}"], "left")
    both = F.expr("o1 is not null and o2 is not null")
    # place by place, not by lambdas, which aren't compiled
    change = _each(models, lambda m: F.when(both, F.col("o1")[m] - F.col("o2")[m]))
    together = _each(models, lambda m: F.coalesce(both & (F.col("c1")[m] == F.col("c2")[m]), F.lit(False)))
    return rows.withColumns({"change": change, "together": together}).drop("o1", "o2", "c1", "c2")


def fit_offsets(rows: DataFrame, models: int, rules: OffsetRules = OffsetRules()) -> tuple[DataFrame, DataFrame]:
    """(offsets, fits): (run, label, o, c) as ``_solved`` gives them, and one row for each model with what its fit is like.

    After each fit all pairs are judged again by their residual, so one may come back; a round
    that would keep nothing of a model leaves it as it was. Models without usable pairs have no rows.
    fits has n_labels, n_components, n_train_pairs, r1norm and the largest component's share of labels
    and of the pairs in the graph.
    """
    work = stored(kept_pairs(rows, models, rules).withColumn("kept", F.col("use")))
    sums = whole = stored(pair_sums(work, models, rules.balance_groups))
    largest, _ = _sizes(sums, models)
    wide = _solved(sums, models, rules, largest)
    near = _each(models, lambda m: F.coalesce(F.col("use")[m] & (F.abs((F.col("d") - F.col("change")[m]) / F.col("err")) <= rules.clip), F.lit(False)))
    for _ in range(max(rules.clip_rounds, 1)):
        judged = with_offsets(work, wide, models).withColumn("kept", near)
        fresh = stored(pair_sums(judged, models, rules.balance_groups))
        _, dead = _sizes(fresh, models)
        if dead:
            gone = F.struct("run", "m").isin([F.struct(F.lit(run), F.lit(m)) for run, m in dead])
            fresh = stored(fresh.where(~gone).unionByName(sums.where(gone)))
        sums, wide = fresh, _solved(fresh, models, rules, largest)
    return wide, _fits(_long(wide), sums, whole)


def solved_offsets(sums: DataFrame, rules: OffsetRules) -> DataFrame:
    """(run, label, offset) of runs with one model each."""
    return _long(_solved(sums, 1, rules, _sizes(sums, 1)[0])).select("run", "label", "offset")


def _fits(offsets: DataFrame, sums: DataFrame, whole: DataFrame) -> DataFrame:
    ends = sums
    for k in (1, 2):
        ends = ends.join(offsets.select(*_MODEL, F.col("label").alias(f"L{k}"), F.col("offset").alias(f"o{k}")), [*_MODEL, f"L{k}"])
    step = F.col("o1") - F.col("o2")
    rest = F.sum(F.col("s2") - 2 * F.col("s1") * step + F.col("s0") * step * step)
    errors = ends.groupBy(*_MODEL).agg(F.sum("n").alias("n_train_pairs"), F.sqrt(F.greatest(rest, F.lit(0.0))).alias("r1norm"))
    parts = offsets.groupBy(*_MODEL, "component").agg(F.count("*").alias("n"))
    labels = parts.groupBy(*_MODEL).agg(F.sum("n").alias("n_labels"), F.count("*").alias("n_components"), (F.max("n") / F.sum("n")).alias("largest_component_label_fraction"))
    there = whole.join(offsets.select(*_MODEL, F.col("label").alias("L1"), "component"), [*_MODEL, "L1"]).groupBy(*_MODEL, "component").agg(F.sum("n").alias("n"))
    pairs = there.groupBy(*_MODEL).agg((F.max("n") / F.sum("n")).alias("largest_component_pair_fraction"))
    return labels.join(errors, _MODEL).join(pairs, _MODEL)


def robust_metrics(rows: DataFrame, keys: list[str], residuals: dict[str, Column], variance: Column) -> DataFrame:
    """(keys..., n, then raw_width, median, median_z, width_z, tail_3, tail_5 and loss of each residual) where the variance is above 0.

    residuals is {ending of the column names: residual}; they are finite in the same rows.
    """
    columns = {f"r{i}": r for i, r in enumerate(residuals.values())}
    valid = rows.select(*keys, variance.alias("v"), *[c.alias(n) for n, c in columns.items()])
    valid = valid.where((F.col("v") > 0) & is_finite(F.col("r0"))).select("*", *[(F.col(n) / F.sqrt("v")).alias(f"z{n}") for n in columns])
    valid = stored(valid)
    tail = lambda n, k: F.avg((F.abs(f"z{n}") > k).cast("int"))
    each = {end: n for n, end in zip(columns, residuals)}
    base = [c for end, n in each.items() for c in (tail(n, 3).alias(f"tail_3{end}"), tail(n, 5).alias(f"tail_5{end}"), F.avg(0.5 * (F.col(f"z{n}") ** 2 + F.log(2 * np.pi * F.col("v")))).alias(f"loss{end}"))]
    counts = valid.groupBy(*keys).agg(F.count("*").alias("n"), *base)
    wanted = {c: {f"{c}_16": 0.16, f"{c}_50": 0.5, f"{c}_84": 0.84} for n in columns for c in (n, f"z{n}")}
    quantiles = column_quantiles(valid, keys, wanted, kept=True)
    width = lambda c: (F.col(f"{c}_84") - F.col(f"{c}_16")) / 2
    shown = [c for end, n in each.items() for c in (width(n).alias(f"raw_width{end}"), F.col(f"{n}_50").alias(f"median{end}"), F.col(f"z{n}_50").alias(f"median_z{end}"), width(f"z{n}").alias(f"width_z{end}"), F.col(f"tail_3{end}"), F.col(f"tail_5{end}"), F.col(f"loss{end}"))]
    both = counts.alias("b").join(quantiles.alias("q"), same("b", "q", keys))
    return both.select(*[F.col(f"b.{k}").alias(k) for k in keys], "b.n", *shown)


def pair_floors(judged: DataFrame, models: int, rules: OffsetRules) -> DataFrame:
    """(run, m, PROGRAM_PAIR, floor): what a pair's formal error lacks to explain the width of the training residuals.

    ``judged`` has use and change. Strata with too few pairs have the floor of the whole model.
    """
    residual = lambda m: F.when(F.col("use")[m], F.col("d") - F.col("change")[m])
    rows = judged.select("run", "PROGRAM_PAIR", F.col("formal") ** 2, *[residual(m).alias(f"r{m}") for m in range(models)]).toDF("run", "PROGRAM_PAIR", "formal2", *[f"r{m}" for m in range(models)])
    rows = rows.select("*", *[F.when(F.col(f"r{m}").isNotNull(), F.col("formal2")).alias(f"f{m}") for m in range(models)])
    wanted = {f"r{m}": {f"lo{m}": 0.16, f"hi{m}": 0.84} for m in range(models)} | {f"f{m}": {f"mid{m}": 0.5} for m in range(models)}
    floor = lambda m: F.sqrt(F.greatest(((F.col(f"hi{m}") - F.col(f"lo{m}")) / 2) ** 2 - F.col(f"mid{m}"), F.lit(0.0)))

    def floors(keys: list[str]) -> DataFrame:
        return column_quantiles(rows, keys, wanted, kept=True).select(*keys, _each(models, floor).alias("floor"))

    counts = rows.groupBy("run", "PROGRAM_PAIR").agg(*[F.count(f"r{m}").alias(f"n{m}") for m in range(models)]).select("run", "PROGRAM_PAIR", _each(models, lambda m: F.col(f"n{m}")).alias("n"))
    own = floors(["run", "PROGRAM_PAIR"]).alias("o").join(counts.alias("c"), same("o", "c", ["run", "PROGRAM_PAIR"])).select("o.*", "c.n")
    both = own.join(floors(["run"]).withColumnRenamed("floor", "overall"), "run")
    value = _each(models, lambda m: F.when(F.col("n")[m] >= rules.min_pairs_per_label, F.col("floor")[m]).when(F.col("n")[m] > 0, F.col("overall")[m]))
    return both.select("run", "PROGRAM_PAIR", F.posexplode(value).alias("m", "floor")).where("floor is not null").select("run", "m", "PROGRAM_PAIR", "floor")


def run_folds(prepared: DataFrame, rules: OffsetRules = OffsetRules()) -> dict[str, DataFrame]:
    """Cross-validation over sources: {'summary', 'by_program', 'offsets'}, with the columns run and fold.

    ``prepared`` comes from ``prepare``; its runs are separate experiments that go through the same
    jobs. A source is in one fold. Only held-out pairs whose two labels are in one component of the
    training graph are scored, before and after the offsets. A fold in which nothing can be scored
    has its counts and nulls for the rest, and no rows in by_program.
    """
    k = rules.folds
    rows = stored(with_use(prepared, k, "others"))
    wide, fits = fit_offsets(rows, k, rules)
    offsets = _long(wide)
    judged = stored(with_offsets(rows, wide, k).select("run", "fold", "PROGRAM_PAIR", "d", "formal", "use", "change", F.element_at("together", F.col("fold") + 1).alias("same")))
    floors = stored(pair_floors(judged, k, rules).withColumnRenamed("m", "fold"))
    usual = floors.groupBy("run", "fold").agg(F.percentile("floor", 0.5).alias("usual"))
    scored = judged.where("same").select("run", "fold", "PROGRAM_PAIR", "formal", F.col("d").alias("before"), (F.col("d") - F.element_at("change", F.col("fold") + 1)).alias("after"))
    scored = scored.alias("s").join(floors.alias("f"), same("s", "f", ["run", "fold", "PROGRAM_PAIR"]), "left").select("s.*", "f.floor").join(usual, ["run", "fold"], "left")
    scored = stored(scored.withColumn("floor", F.coalesce("floor", "usual", F.lit(0.0))))
    variance = F.col("formal") ** 2 + F.col("floor") ** 2
    sides = {"_before": F.col("before"), "_after": F.col("after")}
    fold = ["run", "fold"]
    here = [*fold, "PROGRAM_PAIR"]
    by_program = stored(robust_metrics(scored, here, sides, variance))
    stratum = scored.groupBy(*here).agg(F.max("floor").alias("train_pair_floor"))
    by_program = by_program.alias("p").join(stratum.alias("f"), same("p", "f", here)).select("p.*", "f.train_pair_floor")
    macro = by_program.groupBy(*fold).agg(*[F.avg(c).alias(f"macro_{c}") for c in ("width_z_before", "width_z_after", "loss_before", "loss_after")])
    every = judged.select("run").distinct().withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    held = judged.groupBy(*fold).agg(F.count("*").alias("n_holdout_pairs"), F.count_if("same").alias("n_holdout_same_component"))
    summary = every.join(held, fold, "left").join(fits.withColumnRenamed("m", "fold"), fold, "left")
    none = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_holdout_pairs", "n_holdout_same_component", "n_labels", "n_components", "n_train_pairs")}
    summary = summary.withColumns(none).withColumn("n_holdout_cross_component", F.col("n_holdout_pairs") - F.col("n_holdout_same_component"))
    summary = summary.join(robust_metrics(scored, fold, sides, variance).drop("n"), fold, "left").join(macro, fold, "left")
    scorable = summary.where("n_holdout_same_component > 0").select(*fold)
    return {"summary": summary, "by_program": by_program, "offsets": offsets.withColumnRenamed("m", "fold").join(scorable, fold, "left_semi")}


def half_reproducibility(prepared: DataFrame, rules: OffsetRules = OffsetRules()) -> DataFrame:
    """One row: how far offsets from two halves of the sources agree, over the commonest pair of components.

    No rows if the halves have no label in common.
    """
    offsets = _long(fit_offsets(stored(with_use(prepared.drop("fold"), 2, "own")), 2, rules)[0])
    side = lambda k: offsets.where(F.col("m") == k).select("label", F.col("offset").alias("xy"[k]), F.col("component").alias(f"c{k}"))
    joined = stored(side(0).join(side(1), "label"))
    common = joined.groupBy("c0", "c1").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c0", "c1").limit(1)
    rows = stored(joined.join(common.select("c0", "c1"), ["c0", "c1"], "left_semi").withColumn("g", F.lit(0)))
    shift = grouped_quantiles(rows.select("g", (F.col("y") - F.col("x")).alias("s")), ["g"], "s", {"shift": 0.5}, kept=True)
    moved = rows.join(shift, "g").select("g", "x", (F.col("y") - F.col("shift")).alias("y"), "shift", F.concat_ws("/", "c0", "c1").alias("pair"))
    moved = stored(moved.withColumns({"d": F.col("x") - F.col("y"), "a": F.abs(F.col("x") - F.col("y"))}))
    spread = column_quantiles(moved, ["g"], {"d": {"q16": 0.16, "q84": 0.84}, "a": {"median_abs_difference": 0.5}}, kept=True)
    several = F.count("*") > 1
    slope = F.sum(F.col("x") * F.col("y")) / F.greatest(F.sum(F.col("x") ** 2), F.lit(1e-12))
    base = moved.groupBy("g").agg(F.count("*").alias("n_labels"), F.max("pair").alias("component_pair"), F.max("shift").alias("shift"), F.when(several, F.corr("x", "y")).alias("correlation"), F.when(several, slope).alias("slope"))
    return base.join(spread, "g").select("n_labels", "component_pair", "shift", "correlation", "slope", "median_abs_difference", ((F.col("q84") - F.col("q16")) / 2).alias("difference_width"))


#: Rows of a slot in which exposures are numbered.
SLOT = 100_000


def exposure_nights(pairs: DataFrame, seeds: list[int]) -> DataFrame:
    """(seed, EXPOSURE_KEY, NIGHT): the nights of a program's exposures dealt out anew for each seed.

    Exposures are numbered once by the md5 of the key and once by that of seed and key, and take the
    night of the exposure with the same number. If that leaves every exposure of a program where it
    is, each takes the night of the one before. A program with one exposure keeps its night. If an
    exposure has several nights, the smallest counts. A program is numbered in slots of about SLOT rows.
    """
    exposures = _exposures(pairs).groupBy("EXPOSURE_KEY").agg(F.min("PROGRAM").alias("PROGRAM"), F.min("NIGHT").alias("NIGHT"))
    exposures = stored(exposures.where("PROGRAM is not null"))
    slots = max(1, -(-exposures.count() // SLOT))
    seeded = exposures.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    by = ["seed", "PROGRAM"]

    def placed(rows: DataFrame, name: Column, place: str) -> DataFrame:
        rows = rows.withColumn("_mixed", F.md5(name))
        slot = F.floor(F.conv(F.substring("_mixed", 1, 8), 16, 10).cast("double") / (2**32 / slots))
        return numbered(rows, by, slot, [F.col("_mixed"), F.col("EXPOSURE_KEY")]).withColumnRenamed("place", place).drop("_mixed")

    both = placed(seeded, F.col("EXPOSURE_KEY"), "a").drop("group_size")
    both = stored(placed(both, F.concat_ws("|", F.col("seed").cast("string"), F.col("EXPOSURE_KEY")), "b"))
    still = stored(both.groupBy(*by).agg((F.max((F.col("a") != F.col("b")).cast("int")) == 0).alias("still")))
    wanted = F.when(F.col("still"), F.pmod(F.col("a") - 1 + F.col("group_size"), F.col("group_size"))).otherwise(F.col("a"))
    takes = both.join(still, by).select(*by, "EXPOSURE_KEY", wanted.alias("b"))
    return takes.join(both.select(*by, "b", "NIGHT"), [*by, "b"]).select("seed", "EXPOSURE_KEY", "NIGHT")


def _exposures(pairs: DataFrame) -> DataFrame:
    ends = [pairs.select(F.trim(f"EXPOSURE_KEY_{k}").alias("EXPOSURE_KEY"), F.col(f"PROGRAM_{k}").alias("PROGRAM"), F.col(f"NIGHT_{k}").cast("string").alias("NIGHT")) for k in (1, 2)]
    return ends[0].unionByName(ends[1])


def exposure_conflicts(pairs: DataFrame) -> DataFrame:
    """(EXPOSURE_KEY, N_NIGHTS) of exposures with more than one night; null counts as one."""
    ends = _exposures(pairs).select("EXPOSURE_KEY", F.coalesce("NIGHT", F.lit("")).alias("NIGHT")).distinct()
    return ends.groupBy("EXPOSURE_KEY").agg(F.count("*").alias("N_NIGHTS")).where("N_NIGHTS > 1")


def _unlabelled(pairs: DataFrame, permutations: int, rules: OffsetRules) -> tuple[DataFrame, DataFrame]:
    """The usable pairs with fold and each end's program p and exposure x, and (EXPOSURE_KEY, nights): an exposure's nights in all shuffles."""
    nights = exposure_nights(pairs, list(range(permutations)))
    wide = stored(nights.groupBy("EXPOSURE_KEY").agg(_each(permutations, lambda s: F.max(F.when(F.col("seed") == s, F.col("NIGHT")))).alias("nights")))
    rows = _usable(pairs, rules).select(*_narrow(pairs), *[c for k in (1, 2) for c in (F.col(f"PROGRAM_{k}").alias(f"p{k}"), F.trim(f"EXPOSURE_KEY_{k}").alias(f"x{k}"))])
    return rows.withColumn("fold", hashed(F.col("GROUP_ID"), rules.folds)), wide


def shuffled_pairs(pairs: DataFrame, permutations: int, rules: OffsetRules = OffsetRules()) -> DataFrame:
    """The result of ``prepare`` with nights shuffled among a program's exposures; run numbers the shuffles.

    An exposure has one row with its nights in all shuffles, so pairs are joined before they are multiplied.
    """
    rows, wide = _unlabelled(pairs, permutations, rules)
    for k in (1, 2):
        rows = rows.join(wide.select(F.col("EXPOSURE_KEY").alias(f"x{k}"), F.col("nights").alias(f"n{k}")), f"x{k}", "left")
    runs = rows.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    labels = [label_of(F.col(f"p{k}"), F.element_at(f"n{k}", F.col("run") + 1)).alias(f"L{k}") for k in (1, 2)]
    return runs.select("run", "GROUP_ID", "GROUP_KIND", "PROGRAM_PAIR", "d", "err", "formal", "fold", *labels).where("L1 <> L2")


_SIDE = ("raw_width", "median", "median_z", "width_z", "tail_3", "tail_5", "loss")
#: Columns of a fold's summary, in the order of ``run_folds``.
_COUNTS = ("n_holdout_pairs", "n_holdout_same_component", "n_labels", "n_components")
_SUMMARY = {
    **dict.fromkeys(("run", "fold"), "int"), **dict.fromkeys(_COUNTS, "bigint"), "largest_component_label_fraction": "double", "n_train_pairs": "bigint",
    "r1norm": "double", "largest_component_pair_fraction": "double", "n_holdout_cross_component": "bigint", **{f"{c}_{end}": "double" for end in ("before", "after") for c in _SIDE},
    **{f"macro_{c}_{end}": "double" for c in ("width_z", "loss") for end in ("before", "after")},
}


@dataclass
class _Pairs:
    """Usable pairs as arrays, ordered by stratum; each end is the number of a program and an exposure."""

    d: np.ndarray
    err: np.ndarray
    formal: np.ndarray
    fold: np.ndarray
    group: np.ndarray
    stratum: np.ndarray
    ends: tuple[np.ndarray, np.ndarray]
    #: The program's part of the label of each end, and its night's part in each run.
    programs: list[str]
    nights: np.ndarray
    night_names: list[str]

    def labels(self, run: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The labels of both ends as numbers, and how many there are."""
        known: dict[str, int] = {}
        code = np.array([known.setdefault(f"{p}:{self.night_names[k]}", len(known)) for p, k in zip(self.programs, self.nights[:, run].tolist())], np.int32)
        return code[self.ends[0]], code[self.ends[1]], len(known)


def _boxed(rows: DataFrame, kind: str) -> DataFrame:
    """(kind, box): ``rows`` as compressed batches."""

    def box(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(batch)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["box"])

    return rows.mapInArrow(box, "box binary").select(F.lit(kind).alias("kind"), "box")


def _codes(column: pa.Array, known: dict) -> np.ndarray:
    """The numbers of a column's values, null among them; ``known`` has those seen so far."""
    coded = column.dictionary_encode(null_encoding="encode")
    return np.array([known.setdefault(x, len(known)) for x in coded.dictionary.to_pylist()], np.int32)[coded.indices.to_numpy()]


def _unboxed(boxes: Iterator[tuple[str, bytes]], runs: int) -> _Pairs | None:
    """The pairs of the boxes; texts live no longer than their box."""
    groups, strata, programs, exposures, kinds = {}, {}, {}, {}, {}
    plain = {"d": np.float64, "err": np.float64, "formal": np.float64, "fold": np.int16}
    found: dict[str, list] = {c: [] for c in (*plain, "PROGRAM_PAIR", "GROUP_ID", "end1", "end2")}
    late = []
    for kind, box in boxes:
        if kind == "nights":
            late.append(box)
            continue
        for batch in pa.ipc.open_stream(box):
            for c, t in plain.items():
                found[c].append(batch.column(c).to_numpy(zero_copy_only=False).astype(t))
            found["PROGRAM_PAIR"].append(_codes(batch.column("PROGRAM_PAIR"), strata))
            for k in (1, 2):
                ends, at = np.unique(_codes(batch.column(f"p{k}"), programs).astype(np.int64) << 32 | _codes(batch.column(f"x{k}"), exposures), return_inverse=True)
                found[f"end{k}"].append(np.array([kinds.setdefault(x, len(kinds)) for x in ends.tolist()], np.int32)[at])
            ids = batch.column("GROUP_ID")
            found["GROUP_ID"].append(ids.to_numpy() if pa.types.is_integer(ids.type) else _codes(ids, groups))
    if not found["d"]:
        return None
    order = np.argsort(np.concatenate(found["PROGRAM_PAIR"]), kind="stable")
    whole = lambda c: np.concatenate(found.pop(c))[order]
    group = np.unique(whole("GROUP_ID"), return_inverse=True)[1].astype(np.int32)
    names = {"UNKNOWN": 0}
    nights = np.zeros((len(exposures), runs), np.int32)
    for box in late:
        for batch in pa.ipc.open_stream(box):
            codes = _codes(batch.column("nights").flatten(), names).reshape(-1, runs)
            for key, row in zip(batch.column("EXPOSURE_KEY").to_pylist(), codes):
                if key is not None and key in exposures:
                    nights[exposures[key]] = row
    texts, both = list(programs), np.array(list(kinds), np.int64)
    return _Pairs(
        *[whole(c) for c in plain], group, whole("PROGRAM_PAIR"), (whole("end1"), whole("end2")),
        [texts[k] for k in both >> 32], nights[both & (2**32 - 1)], list(names),
    )


def _width(values: np.ndarray) -> float | None:
    low, high = interpolated(values, (0.16, 0.84))
    return None if low is None else (high - low) / 2


def _side(r: np.ndarray, v: np.ndarray) -> dict[str, float | None]:
    """The metrics of ``robust_metrics`` for residuals ``r`` of variance ``v``."""
    z = r / np.sqrt(v)
    width, (middle,), (middle_z,), size = _width(r), interpolated(r, (0.5,)), interpolated(z, (0.5,)), np.abs(z)
    return dict(zip(_SIDE, (width, middle, middle_z, _width(z), float((size > 3).mean()), float((size > 5).mean()), float((0.5 * (z * z + np.log(2 * np.pi * v))).mean()))))


def _strata(stratum: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The strata of ordered rows, and where each lies."""
    if len(stratum):
        cuts = [0, *(np.flatnonzero(np.diff(stratum)) + 1).tolist(), len(stratum)]
        yield from ((int(stratum[i]), slice(i, j)) for i, j in zip(cuts, cuts[1:]))


def _fit_arrays(p: _Pairs, a: np.ndarray, b: np.ndarray, n: int, work: np.ndarray, rules: OffsetRules) -> tuple[np.ndarray, np.ndarray, dict]:
    """``fit_offsets`` of one model whose usable pairs are the rows ``work``: offset (nan) and component (-1) of n labels, and its fits."""
    x, component, fits = np.full(n, np.nan), np.full(n, -1), {}
    if not len(work):
        return x, component, fits
    low, high = a[work], b[work]
    d, err, group = p.d[work], p.err[work], p.group[work]
    d[low > high] *= -1
    low, high = np.minimum(low, high), np.maximum(low, high)
    there = np.zeros(n, bool)
    there[low] = there[high] = True
    size = int(there.sum())
    at = np.cumsum(there) - 1
    key = at[low] * size + at[high]
    del low, high
    order = np.argsort(key)
    key, d, err, group = key[order], d[order], err[order], group[order]
    first = np.diff(key, prepend=-1) > 0
    links, link = key[first], np.cumsum(first, dtype=np.int32) - 1
    del key, order
    i, j = (links // size).astype(np.int32), (links % size).astype(np.int32)
    orders, part = (slice(None), np.argsort(j, kind="stable")), _components(size, i, j)
    square, starts = err * err, np.flatnonzero(first)
    if not square.all():
        raise ZeroDivisionError("The square of a pair's error is 0")
    kept = np.ones(len(work), bool)
    for k in range(1 + max(rules.clip_rounds, 1)):
        if k:
            near = np.abs(rest / err) <= rules.clip
            if not near.any():
                break
            kept = near
        w = kept / square
        if rules.balance_groups:
            w /= np.maximum(np.bincount(group, kept), 1)[group]
        solved = conjugate_gradients(size, i, j, np.add.reduceat(w, starts), np.add.reduceat(w * d, starts), rules.damp, orders)
        if rules.center_components or rules.damp == 0:
            solved = _centred(solved, part)
        rest = d - (solved[i] - solved[j])[link]
    x[there], component[there] = solved, part
    labels, pairs = np.bincount(part), np.bincount(part[i], np.diff(starts, append=len(link)))
    fits = {"n_labels": size, "n_components": len(labels), "largest_component_label_fraction": labels.max() / size, "n_train_pairs": int(kept.sum())}
    return x, component, fits | {"r1norm": float(np.sqrt((w * rest * rest).sum())), "largest_component_pair_fraction": pairs.max() / len(work)}


def _floor_arrays(r: np.ndarray, formal2: np.ndarray) -> float:
    (middle,) = interpolated(formal2, (0.5,))
    return float(np.sqrt(max((_width(r) or 0.0) ** 2 - (middle or 0.0), 0.0)))


def _fold_arrays(p: _Pairs, a: np.ndarray, b: np.ndarray, n: int, fold: int, rules: OffsetRules) -> dict:
    """The summary of one fold of a run, whose pairs have the labels a and b, numbers below n; the same steps as in ``run_folds``."""
    own = (p.fold == fold) & (a != b)
    train = (p.fold != fold) & (a != b)
    enough = np.bincount(a[train], minlength=n) + np.bincount(b[train], minlength=n) >= rules.min_pairs_per_label
    work = np.flatnonzero(train & enough[a] & enough[b] & (np.abs(p.d / p.err) <= rules.max_abs_z))
    x, component, fits = _fit_arrays(p, a, b, n, work, rules)
    out = dict.fromkeys(_SUMMARY) | dict.fromkeys(("n_labels", "n_components", "n_train_pairs"), 0) | fits
    held = np.flatnonzero(own)
    there = component[a[held]]
    held = held[(there >= 0) & (there == component[b[held]])]
    total = int(own.sum())
    out |= {"fold": fold, "n_holdout_pairs": total, "n_holdout_same_component": len(held), "n_holdout_cross_component": total - len(held)}
    if not len(held):
        return out
    train = np.flatnonzero(train & (component[a] >= 0) & (component[b] >= 0))
    r, formal2, stratum = p.d[train] - (x[a[train]] - x[b[train]]), p.formal[train] ** 2, p.stratum[train]
    overall = _floor_arrays(r, formal2) if len(train) else None
    floors = {k: _floor_arrays(r[s], formal2[s]) if s.stop - s.start >= rules.min_pairs_per_label else overall for k, s in _strata(stratum)}
    (usual,) = interpolated(np.array(list(floors.values()), float), (0.5,))
    before, stratum, v = p.d[held], p.stratum[held], p.formal[held] ** 2
    after = before - (x[a[held]] - x[b[held]])
    for k, s in _strata(stratum):
        v[s] += floors.get(k, usual or 0.0) ** 2
    valid = v > 0
    before, after, stratum, v = before[valid], after[valid], stratum[valid], v[valid]
    if not len(v):
        return out
    for end, y in (("before", before), ("after", after)):
        out |= {f"{c}_{end}": value for c, value in _side(y, v).items()}
        each = [_side(y[s], v[s]) for _, s in _strata(stratum)]
        out |= {f"macro_{c}_{end}": float(np.mean([m[c] for m in each])) for c in ("width_z", "loss")}
    return out


def local_summaries(rows: DataFrame, nights: DataFrame, runs: int, rules: OffsetRules) -> DataFrame:
    """The 'summary' of ``run_folds`` for the shuffles of ``_unlabelled``, whose pairs one task can hold.

    Each task gets all pairs once, compressed and without labels, and makes some of the runs' folds from
    them, which need nothing of each other. So pairs aren't multiplied by runs, but by tasks.
    """
    units = runs * rules.folds
    tasks = max(1, min(units, rows.sparkSession.sparkContext.defaultParallelism))
    pairs = rows.select("GROUP_ID", "PROGRAM_PAIR", "d", "err", "formal", "fold", *[c for k in (1, 2) for c in (_label_part(F.col(f"p{k}")).alias(f"p{k}"), f"x{k}")])
    nights = nights.select("EXPOSURE_KEY", _each(runs, lambda s: _label_part(F.col("nights")[s])).alias("nights"))
    boxes = _boxed(pairs, "pairs").unionByName(_boxed(nights, "nights")).withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    schema = ", ".join(f"{c} {kind}" for c, kind in _SUMMARY.items())
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []

        def boxes() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                seen[:] = [batch.column("task")[0].as_py()] if batch.num_rows else seen
                for kind, box in zip(batch.column("kind"), batch.column("box")):
                    yield kind.as_py(), box.as_buffer()

        found = _unboxed(boxes(), runs)
        if found is None:
            return
        last, out = None, []
        with np.errstate(all="ignore"):
            for unit in range(seen[0] * units // tasks, (seen[0] + 1) * units // tasks):
                run, fold = divmod(unit, rules.folds)
                if run != last:
                    last, (a, b, n) = run, found.labels(run)
                    some = bool((a != b).any())
                if some:
                    out.append(_fold_arrays(found, a, b, n, fold, rules) | {"run": run})
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kinds[kind]) for c, kind in _SUMMARY.items()], list(_SUMMARY))

    # by number, so that no two tasks' boxes are put together
    return stored(boxes.repartitionById(tasks, F.col("task")).mapInArrow(summaries, schema))


def permutation_control(pairs: DataFrame, permutations: int = DEFAULT_PERMUTATIONS, rules: OffsetRules = OffsetRules(), strict: bool = True) -> DataFrame:
    """The fold summaries of ``permutations`` shuffles of nights among a program's exposures, all in the same jobs.

    An exposure with several nights raises a ValueError; with strict=False its smallest night counts.
    """
    if strict:
        examples = [str(r[0]) for r in exposure_conflicts(pairs).orderBy("EXPOSURE_KEY").limit(5).collect()]
        if examples:
            raise ValueError(f"Exposures with several nights, for example {', '.join(examples)}")
    if _usable(pairs, rules).count() <= LOCAL_PAIRS:
        summary = local_summaries(*_unlabelled(pairs, permutations, rules), permutations, rules)
    else:
        summary = run_folds(shuffled_pairs(pairs, permutations, rules), rules)["summary"]
    summary = summary.withColumnRenamed("run", "permutation")
    return summary.withColumn("CONTROL", F.lit("SHUFFLED_EXPOSURE_NIGHT_WITHIN_PROGRAM"))


def run_experiment(pairs: DataFrame, rules: OffsetRules = OffsetRules(), permutations: int = DEFAULT_PERMUTATIONS, strict: bool = True) -> dict[str, DataFrame]:
    """{'summary', 'by_program', 'offsets', 'reproducibility', 'permutations'} of one pair table."""
    prepared = stored(prepare(pairs, rules))
    out = run_folds(prepared, rules)
    gaia = F.count_if(F.col("GROUP_KIND") == "GAIA_SOURCE_ID")
    counts = prepared.groupBy("run").agg(F.count("*").alias("n_label_pairs"), gaia.alias("n_gaia_group_pairs"), (gaia / F.count("*")).alias("gaia_group_pair_fraction"))
    out["summary"] = out["summary"].join(counts, "run", "left")
    out = {name: df.drop("run") for name, df in out.items()}
    out["reproducibility"] = half_reproducibility(prepared, rules)
    if permutations > 0:
        out["permutations"] = permutation_control(pairs, permutations, rules, strict)
    return out
