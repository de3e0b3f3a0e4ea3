"""Problem 1: implausible readings, flagged against what is normal for their own source.

Method: a robust autoregression of order one is fitted once to all of a source's readings in
their order, whatever their number. Residuals are tested for additive outliers and level shifts;
the strongest effects are taken out and the tests repeated until nothing stands out. Runs of equal
readings (stuck) and physically impossible readings are told apart from spikes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from remeasure.functions.columns import is_finite, is_reading
from remeasure.functions.ranks import grouped_quantiles, same
from remeasure.session import stored


@dataclass(frozen=True)
class SpikeRules:
    """critical: test size of the autoregression; the others define a case (see ``flag_readings``)."""

    critical: float = 3.5
    spreads: float = 10.0
    least_readings: int = 8
    stuck_run: int = 4
    max_abs_vrad: float = 2000.0


#: (code, table, field); the code stands for the field inside the job.
FIELDS = ((0, "rvtab", "vrad"), (1, "rvtab", "vrad_err"), (2, "pairs", "pair_z"))
#: A source with more readings than this is tested in pieces that overlap by CONTEXT readings; what
#: is normal for it (median, spread, autoregression, residual scale) is that of the whole source all the same.
PIECE, CONTEXT = 20_000, 16
#: The autoregression is fitted to readings clipped at so many spreads, and stays below 1.
CLIP, MOST_PHI = 2.5, 0.95
MAD_TO_SIGMA = 1.4826
_NORMAL = ("center", "spread", "phi", "scale")
_FLAGGED = "field tinyint, rec_id bigint, is_outlier boolean, is_shifted boolean, is_spike boolean, is_stuck boolean, is_impossible boolean"


def readings(rvtab: DataFrame, pairs: DataFrame, rules: SpikeRules = SpikeRules()) -> DataFrame:
    """(field, source, slot, at, rec_id, value, is_impossible): every reading once.

    A record delivered again counts once, as first delivered; rows without a record id are left
    out. slot is a coarse form of the order (at, rec_id) within a source.
    """
    columns = ["ingested_at", "targetid", "mjd", "vrad", "vrad_err"]
    obs = rvtab.where("obs_id is not null").groupBy(F.col("obs_id").alias("rec_id")).agg(F.min(F.struct(*columns)).alias("f")).select("rec_id", "f.*")
    values = F.inline(F.array(*[F.struct(F.lit(code).cast("tinyint").alias("field"), F.col(name).cast("double").alias("value")) for code, table, name in FIELDS if table == "rvtab"]))
    ours = obs.select(F.col("targetid").alias("source"), F.floor("mjd").alias("slot"), F.col("mjd").alias("at"), "rec_id", values)
    firsts = pairs.where("pair_id is not null").groupBy(F.col("pair_id").alias("rec_id")).agg(F.min(F.struct("group_id", "pair_z")).alias("f"))
    theirs = firsts.select(F.col("f.group_id").alias("source"), F.expr("rec_id div 1048576").alias("slot"), F.lit(0.0).alias("at"), "rec_id", F.lit(2).cast("tinyint").alias("field"), F.col("f.pair_z").cast("double").alias("value"))
    v = F.col("value")
    impossible = (F.abs(v) == F.lit(float("inf"))) | ((F.col("field") == 0) & (F.abs(v) > rules.max_abs_vrad)) | ((F.col("field") == 1) & (v <= 0))
    return ours.unionByName(theirs).where(is_reading(v)).withColumn("is_impossible", impossible)


def _in_pieces(known: DataFrame) -> DataFrame:
    """``known`` with piece, own, n_finite and what is normal for the source; these are null for sources in one piece, whose task finds them.

    Long sources are numbered through (start of the slot plus place in it) and cut by number;
    neighbours share CONTEXT readings, of which each belongs to one piece only. The same statistics
    as in ``_judge`` are made of the whole source here: exact quantiles, products of neighbours and
    the median size of the residuals.
    """
    key = ["field", "source"]
    sizes = known.groupBy(*key).agg(F.count("*").alias("n"))
    long = stored(sizes.where(F.col("n") > PIECE).select(*key, F.lit(True).alias("is_long")))
    none = {"piece": F.lit(0).cast("bigint"), "own": F.lit(True), "n_finite": F.lit(None).cast("bigint"), **{c: F.lit(None).cast("double") for c in _NORMAL}}
    if long.isEmpty():
        return known.withColumns(none)
    marked = known.join(long, key, "left")
    whole = marked.where("is_long is null").drop("is_long").withColumns(none)
    cut = stored(marked.where("is_long").drop("is_long"))
    slots = cut.groupBy(*key, "slot").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*key).orderBy(F.col("slot").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = slots.select(*key, "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy(*key, "slot").orderBy("at", "rec_id")) - 1
    numbered = cut.withColumn("place", place).alias("c").join(starts.alias("s"), same("c", "s", [*key, "slot"])).select("c.*", (F.col("place") + F.col("start")).alias("index"))
    piece, rest = F.expr(f"index div {PIECE}"), F.col("index") % PIECE
    pieces = F.array_compact(F.array(piece, F.when((rest < CONTEXT) & (piece > 0), piece - 1), F.when(rest >= PIECE - CONTEXT, piece + 1)))
    spread = stored(numbered.withColumn("mine", piece).withColumn("piece", F.explode(pieces)).withColumn("own", F.col("piece") == F.col("mine")))
    normal = _normal(spread, key)
    return whole.unionByName(spread.join(normal, key, "left").select(whole.columns))


def _normal(pieces: DataFrame, key: list[str]) -> DataFrame:
    """(key..., center, spread, phi, scale, n_finite) of the finite readings of sources in pieces; null where a source has none."""
    finite = pieces.where(is_finite(F.col("value")))
    own = finite.where("own")
    counts = own.groupBy(*key).agg(F.count("*").alias("n_finite"))
    quantiles = grouped_quantiles(own, key, "value", {"low": 0.16, "center": 0.5, "high": 0.84}, kept=True)
    usual = stored(counts.join(quantiles, key).select(*key, "n_finite", "center", ((F.col("high") - F.col("low")) / 2).alias("spread")))
    before = F.lag("value").over(Window.partitionBy(*key, "piece").orderBy("at", "rec_id"))
    # the first reading of a source has none before it; that of a piece is not its own
    pairs = finite.withColumn("before", before).where("own").join(usual, key)
    z, back = F.col("value") - F.col("center"), F.col("before") - F.col("center")
    clip = lambda x: F.when(x.isNotNull(), F.greatest(F.least(x, CLIP * F.col("spread")), -CLIP * F.col("spread")))
    pairs = stored(pairs.select(*key, z.alias("z"), back.alias("back"), (clip(z) * clip(back)).alias("product"), (clip(back) ** 2).alias("square")))
    raw = F.sum("product") / F.sum("square")
    phi = F.when(F.sum("square") > 0, F.greatest(F.least(raw, F.lit(MOST_PHI)), F.lit(-MOST_PHI))).otherwise(0.0)
    fits = stored(pairs.groupBy(*key).agg(phi.alias("phi")))
    residual = F.when(F.col("back").isNull(), F.col("z") * F.sqrt(1 - F.col("phi") ** 2)).otherwise(F.col("z") - F.col("phi") * F.col("back"))
    sizes = grouped_quantiles(pairs.join(fits, key).select(*key, F.abs(residual).alias("size")), key, "size", {"size": 0.5})
    joined = usual.join(fits, key).join(sizes, key)
    return joined.select(*key, "center", "spread", "phi", F.least(MAD_TO_SIGMA * F.col("size"), F.col("spread")).alias("scale"), "n_finite")


def _segment_quantiles(v: np.ndarray, seg: np.ndarray, count: np.ndarray, probs: tuple[float, ...]) -> list[np.ndarray]:
    """Linearly interpolated quantiles of each segment; seg is sorted, empty segments give nan."""
    order = v[np.lexsort((v, seg))]
    start = np.concatenate([[0], np.cumsum(count)[:-1]])
    out = []
    for p in probs:
        at = p * (count - 1)
        low = np.floor(at).clip(0).astype(np.int64)
        high = np.minimum(low + 1, np.maximum(count - 1, 0))
        some = count > 0
        q = np.full(len(count), np.nan)
        a, b = order[(start + low)[some]], order[(start + high)[some]]
        q[some] = a + (at[some] - low[some]) * (b - a)
        out.append(q)
    return out


def _autoregression(x: np.ndarray, seg: np.ndarray, count: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phi, scale) of the centred readings ``x`` of sorted segments: phi from readings clipped at CLIP spreads, the
    residual scale from the median size of the residuals, at most the spread."""
    n = len(count)
    if not len(x):
        return np.zeros(n), np.zeros(n)
    first = np.concatenate([[True], seg[1:] != seg[:-1]])
    back = np.where(first, 0.0, np.concatenate([[0.0], x[:-1]]))
    bound = CLIP * spread[seg]
    b = np.clip(back, -bound, bound)
    product, square = np.bincount(seg, np.clip(x, -bound, bound) * b, n), np.bincount(seg, b * b, n)
    phi = np.divide(product, square, out=np.zeros(n), where=square > 0).clip(-MOST_PHI, MOST_PHI)
    size = np.abs(np.where(first, x * np.sqrt(1 - phi[seg] ** 2), x - phi[seg] * back))
    return phi, np.fmin(MAD_TO_SIGMA * _segment_quantiles(size, seg, count, (0.5,))[0], spread)


def _robust_ar_outliers(x: np.ndarray, seg: np.ndarray, spread: np.ndarray, phi: np.ndarray, scale: np.ndarray, critical: float) -> tuple[np.ndarray, np.ndarray]:
    """(outlier, shifted) marks for centred readings ``x`` of sorted segments with autoregressions (phi, scale).

    In every pass the segments in which something exceeds ``critical`` either lose their strongest
    level shift or all additive outliers that are local maxima, whichever is stronger, and are tested
    again, until nothing stands out. A reading is taken for an outlier, and a level for shifted at a
    reading, only once, so there are at most twice as many passes as readings.
    """
    n = len(x)
    outlier, shifted, moved_at = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    active = np.arange(n)
    y = x.copy()
    while len(active):
        s, z = seg[active], y[active]
        # segments of this pass, numbered from 0
        first = np.concatenate([[True], s[1:] != s[:-1]])
        k = np.cumsum(first) - 1
        of, start = s[first], np.flatnonzero(first)
        size = np.diff(np.append(start, len(z)))
        last = np.append(first[1:], True)
        f = phi[of][k]
        sigma = np.maximum(scale[of], 1e-9 * (1 + spread[of]))[k]
        r = z - f * np.where(first, 0.0, np.concatenate([[0.0], z[:-1]]))
        r[first] *= np.sqrt(1 - f[first] ** 2)
        ahead = np.where(last, 0.0, np.append(r[1:], 0.0))
        gain = np.where(last, 1.0, 1 + f**2)
        effect = (r - np.where(last, 0.0, f) * ahead) / gain
        additive = np.where(outlier[active], 0.0, np.abs(effect) * np.sqrt(gain) / sigma)
        total = np.cumsum(r)
        ends = start + size - 1
        after = total[ends][k] - total
        later = (ends[k] - np.arange(len(z))).astype(float)
        level_gain = 1 + later * (1 - f) ** 2
        level = (r + (1 - f) * after) / level_gain
        # a shift needs readings on both sides
        shift = np.where((later >= 2) & ~first & ~moved_at[active], np.abs(level) * np.sqrt(level_gain) / sigma, 0.0)
        top_a, top_s = np.maximum.reduceat(additive, start), np.maximum.reduceat(shift, start)
        by_shift = (top_s > critical) & (top_s > top_a)
        by_outlier = (top_a > critical) & ~by_shift
        left = np.where(first, 0.0, np.concatenate([[0.0], additive[:-1]]))
        right = np.where(last, 0.0, np.append(additive[1:], 0.0))
        peak = by_outlier[k] & (additive > critical) & (additive >= left) & (additive >= right)
        outlier[active[peak]] = True
        y[active[peak]] -= effect[peak]
        if by_shift.any():
            at = np.flatnonzero(by_shift[k] & (shift == top_s[k]))
            at = at[np.concatenate([[True], k[at][1:] != k[at][:-1]])]
            moved_at[active[at]] = True
            jump = np.zeros(len(z))
            jump[at] = level[at]
            run = np.cumsum(jump)
            base = np.concatenate([[0.0], run[start[1:] - 1]])[k]
            run = np.where(by_shift[k], run - base, 0.0)
            moved = np.zeros(len(z), bool)
            moved[at] = True
            moved = (np.cumsum(moved) - np.concatenate([[0], np.cumsum(moved)[start[1:] - 1]])[k]) > 0
            shifted[active[moved & by_shift[k]]] = True
            y[active] -= run
        active = active[(by_shift | by_outlier)[k]]
    return outlier, shifted


def _judge(pdf: pd.DataFrame, rules: SpikeRules) -> pd.DataFrame:
    """Flags of a chunk of whole pieces, sorted by piece and order."""
    value = pdf["value"].to_numpy(float)
    key = [pdf[c].to_numpy() for c in ("field", "source", "piece")]
    new = np.concatenate([[True], reduce(np.logical_or, [k[1:] != k[:-1] for k in key])])
    seg = np.cumsum(new) - 1
    # runs of equal readings
    start = np.flatnonzero(new | np.concatenate([[True], value[1:] != value[:-1]]))
    length = np.diff(np.append(start, len(value)))
    stuck = np.repeat(length >= rules.stuck_run, length)
    # spikes among the finite readings
    finite = np.isfinite(value)
    v, s, segments = value[finite], seg[finite], seg[-1] + 1
    count = np.bincount(s, minlength=segments)
    low, center, high = _segment_quantiles(v, s, count, (0.16, 0.5, 0.84))
    given = pdf.loc[new, [*_NORMAL, "n_finite"]].to_numpy(float)
    own = np.isnan(given[:, 4])
    center, spread, total = np.where(own, center, given[:, 0]), np.where(own, (high - low) / 2, given[:, 1]), np.where(own, count, given[:, 4])
    phi, scale = _autoregression(v - center[s], s, count, spread)
    phi, scale = np.where(own, phi, given[:, 2]), np.where(own, scale, given[:, 3])
    enough = (total >= rules.least_readings)[s]
    v, s = v[enough], s[enough]
    outlier, shifted = _robust_ar_outliers(v - center[s], s, spread, phi, scale, rules.critical)
    # the exact definition of a case, on what the tests have marked
    spike = (outlier | shifted) & (np.abs(v - center[s]) > rules.spreads * spread[s])
    at = np.flatnonzero(finite)[enough]
    flags = {name: np.zeros(len(value), bool) for name in ("is_outlier", "is_shifted", "is_spike")}
    for name, marks in zip(flags, (outlier, shifted, spike)):
        flags[name][at] = marks
    flags |= {"is_stuck": stuck, "is_impossible": pdf["is_impossible"].to_numpy(bool)}
    keep = pdf["own"].to_numpy(bool) & reduce(np.logical_or, flags.values())
    return pd.DataFrame({"field": key[0], "rec_id": pdf["rec_id"].to_numpy(), **flags})[keep]


def _judge_partition(rules: SpikeRules, chunk: int = 60_000):
    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for pdf in frames:
            held.append(pdf)
            rows += len(pdf)
            if rows < chunk:
                continue
            pdf = pd.concat(held, ignore_index=True)
            end = pdf.iloc[-1]
            open_ = (pdf["source"] == end["source"]) & (pdf["field"] == end["field"]) & (pdf["piece"] == end["piece"])
            if not open_.all():
                yield _judge(pdf[~open_], rules)
                pdf = pdf[open_]
            held, rows = [pdf], len(pdf)
        if rows:
            yield _judge(pd.concat(held, ignore_index=True), rules)

    return judge


def flag_readings(rvtab: DataFrame, pairs: DataFrame, rules: SpikeRules = SpikeRules()) -> DataFrame:
    """One row for every reading of which something is wrong or conspicuous.

    Columns rec_table, field_name, rec_id and the flags is_outlier and is_shifted (what the
    tests of the autoregression say), is_spike (an outlier or shifted reading of a source with at
    least ``least_readings`` finite readings, further from its median than ``spreads`` times half
    the width of the middle 68 %), is_stuck (one of ``stuck_run`` or more successive equal
    readings) and is_impossible (infinite, a vrad beyond ``max_abs_vrad``, a vrad_err of 0 or
    less). Null and NaN are no readings. Readings without a source can only be impossible. Equal
    times are ordered by rec_id. No rows give no rows; other columns don't matter.

    Sources are hashed over tasks; one with more than PIECE readings is tested in pieces, so none
    of them fills a task. What is normal for it is found from all its readings, as for any other.
    """
    rows = stored(readings(rvtab, pairs, rules))
    known = _in_pieces(rows.where("source is not null"))
    columns = ["field", "source", "piece", "rec_id", "value", "is_impossible", "own", *_NORMAL, "n_finite"]
    ordered = known.repartition("field", "source", "piece").sortWithinPartitions("field", "source", "piece", "at", "rec_id").select(*columns)
    flagged = ordered.mapInPandas(_judge_partition(rules), _FLAGGED)
    no: Column = F.lit(False)
    nowhere = rows.where("source is null and is_impossible").select("field", "rec_id", no.alias("is_outlier"), no.alias("is_shifted"), no.alias("is_spike"), no.alias("is_stuck"), "is_impossible")
    name = F.element_at(F.array(*[F.struct(F.lit(t).alias("rec_table"), F.lit(f).alias("field_name")) for _, t, f in FIELDS]), F.col("field").cast("int") + 1)
    flags = flagged.unionByName(nowhere)
    return flags.select(name.alias("n"), *flags.columns[1:]).select("n.rec_table", "n.field_name", *flags.columns[1:])


def cases(rvtab: DataFrame, pairs: DataFrame, rules: SpikeRules = SpikeRules()) -> DataFrame:
    """(rec_table, field_name, rec_id) of spikes, stuck and impossible readings."""
    return flag_readings(rvtab, pairs, rules).where("is_spike or is_stuck or is_impossible").select("rec_table", "field_name", "rec_id")
