"""Problem 2: train, validation and test splits that keep all records of one entity together.

Method: component swap search. Entities are connected components of the records' keys. They
start in the split that a hash of their name picks, in proportion to the targets. Then blocks
of whole entities are annealed in parallel tasks: single entities move to another split or two
entities change places, so that size and label shares come close to the targets. Every chain's
best state is kept, and rounds go on with what deviation is left over all blocks. Labels are
sparse rows (entity, label, n), so that all of them count, however many there are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remeasure.functions.columns import clean_pair_label
from remeasure.llm.components import connected_components
from remeasure.session import stored

#: Spaces of keys in pairs: columns of one space name the same thing.
PAIR_KEYS = {"g": ("group_id",), "t": ("targetid_1", "targetid_2")}


def _nodes(spaces: dict[str, tuple[str, ...]]) -> list:
    return [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{space}:"), F.col(c).cast("string"))) for space, columns in spaces.items() for c in columns]


def entity_keys(records: DataFrame, spaces: dict[str, tuple[str, ...]] = PAIR_KEYS) -> tuple[DataFrame, DataFrame]:
    """(keys, entities): the distinct key rows, each with its first key, and (node, entity) of all keys.

    A row's keys tie each other; null keys tie nothing. Rows are reduced to distinct keys before
    anything else, so a hot key costs one row for each partner, not for each record.
    """
    columns = [c for group in spaces.values() for c in group]
    nodes = _nodes(spaces)
    keys = records.select(*columns).distinct().withColumn("node", F.coalesce(*nodes)).where("node is not null")
    keys = stored(keys)
    edges = reduce(DataFrame.unionByName, [keys.select(F.col("node").alias("a"), other.alias("b")) for other in nodes])
    return keys, connected_components(edges.where("b is not null").distinct())


class _Block:
    """The entities of one block as sparse rows: an entity has its size (feature 0) and the labels it has, no others."""

    def __init__(self, pdf: pd.DataFrame, k: int, weight: float):
        pdf = pdf.sort_values(["entity", "label"], kind="stable")
        self.entities, first = np.unique(pdf["entity"].to_numpy(object), return_index=True)
        labels, one, feature = np.unique(pdf["label"].to_numpy(object), return_index=True, return_inverse=True)
        n = pdf["n"].to_numpy(float)
        sizes = np.add.reduceat(n, first)
        self.at = pdf["at"].to_numpy(np.int64)[first]
        # feature 0 goes before the labels of its entity
        self.index = np.split(np.insert(feature + 1, first, 0), first[1:] + np.arange(1, len(first)))
        self.value = np.split(np.insert(n, first, sizes), first[1:] + np.arange(1, len(first)))
        self.sizes, self.scale, self.root = sizes, max(sizes.sum(), 1.0), np.sqrt(np.append(1.0, np.full(len(labels), weight)))
        whole = np.zeros(len(labels) + 1)
        for index, value in zip(self.index, self.value):
            whole[index] += value
        # this block sets right its part of what is out of proportion over all blocks, by its share of each label
        over = np.vstack([pdf["size_over"].iloc[0], np.stack(list(pdf["label_over"].iloc[one]))])
        self.gap = (over.astype(float).T * whole) * self.root / self.scale
        self.value = [value * self.root[index] / self.scale for index, value in zip(self.index, self.value)]
        self.norms = np.array([value @ value for value in self.value])
        assert self.gap.shape == (k, len(labels) + 1)


def _anneal(block: _Block, steps: int, seed: int) -> tuple[np.ndarray, float]:
    """The best split of each entity of a block that one chain finds, and its energy: the squared deviation of sizes and weighted labels.

    A step proposes to move an entity or to exchange two of different splits; the energy is
    quadratic, so a proposal's change needs only the labels of these entities in two splits.
    """
    random = np.random.default_rng(seed)
    gap, index, value, norms = block.gap.copy(), block.index, block.value, block.norms
    k, n = len(gap), len(index)
    full = np.zeros(gap.shape[1])
    state, best = block.at.copy(), block.at.copy()
    energy = lowest = float((gap**2).sum())
    heat = max(energy, 1e-12) / 10
    cooling = (1e-6) ** (1.0 / max(steps, 1))
    # half of the proposals prefer large entities, which matter most for the sizes
    order = np.argsort(-block.sizes, kind="stable")
    draws = random.integers(0, n, (steps, 2))
    heavy = order[(random.random((steps, 2)) ** 3 * n).astype(int)]
    draws = np.where(random.random((steps, 1)) < 0.5, draws, heavy)
    kinds, luck, aside = random.random(steps), random.random(steps), random.integers(1, max(k, 2), steps)
    for step in range(steps):
        i, j = draws[step]
        a, exchange = state[i], kinds[step] >= 0.5
        b = state[j] if exchange else (a + aside[step]) % k
        heat *= cooling
        if a == b:
            continue
        near, own = index[i], value[i]
        change = own @ (gap[b, near] - gap[a, near]) + norms[i]
        if exchange:
            far, its = index[j], value[j]
            full[near] = own
            change += norms[j] - 2 * (its @ full[far]) - its @ (gap[b, far] - gap[a, far])
            full[near] = 0.0
        change = 2 * float(change)
        if change < 0 or luck[step] < np.exp(-change / heat):
            gap[a, near] -= own
            gap[b, near] += own
            state[i] = b
            if exchange:
                gap[a, far] += its
                gap[b, far] -= its
                state[j] = a
            energy += change
            if energy < lowest:
                lowest, best = energy, state.copy()
    return best, lowest


def _block_search(k: int, steps: int, chains: int, weight: float, turn: int):
    """The annealing of one block, whose rows are (entity, label, n, at) with what splits have too much, for each record."""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        block = _Block(pdf, k, weight)
        tried = [_anneal(block, steps, 1000 * turn + chain) for chain in range(chains)]
        best = min(tried, key=lambda x: x[1])[0].astype("int32")
        return pdf[["entity", "label", "n"]].assign(at=best[np.searchsorted(block.entities, pdf["entity"].to_numpy(object))])

    return search


def assign_splits(
    records: DataFrame,
    shares: dict[str, float],
    spaces: dict[str, tuple[str, ...]] = PAIR_KEYS,
    record_id: str = "pair_id",
    label: str | None = None,
    *,
    named: Callable[[Column], Column] = lambda c: c,
    rounds: int = 3,
    block: int = 2000,
    chains: int = 2,
    steps: int = 4000,
    label_weight: float = 0.25,
) -> DataFrame:
    """``records`` with the columns entity and split; every entity lies in one split.

    shares gives each split's target share of the records (they are scaled to sum to 1; one of 0
    gets nothing). label is an optional column whose values, as ``named`` names them, should have the
    same shares in every split. Records
    without any key are tied to nothing but records with the same record_id; where that is null
    too, they count as one entity. Repeated rows count as often as they occur. No rows give no
    rows. An existing column named entity or split is replaced.

    Every label counts. Entities are spread by hash over blocks of about ``block``; a block is one
    task, which runs ``chains`` annealing chains from different seeds and keeps the best. It holds
    one row for each label of each of its entities. Between rounds labels are totalled in Spark;
    only the totals of the splits and the energy come to the driver.
    """
    names = sorted(s for s, share in shares.items() if share > 0)
    parts = np.array([shares[s] for s in names], dtype=float)
    parts = parts / parts.sum()
    columns = [c for group in spaces.values() for c in group]
    records = records.drop("entity", "split")
    raw = F.col(label).cast("string") if label is not None else F.lit("?")
    _, keys = entity_keys(records, spaces)
    node = F.coalesce(*_nodes(spaces), F.concat(F.lit("r:"), F.coalesce(F.col(record_id).cast("string"), F.lit(""))))
    marked = records.withColumn("_node", node)
    counts = marked.groupBy(F.col("_node").alias("node"), raw.alias("label")).agg(F.count("*").alias("n"))
    counts = stored(counts.withColumn("label", F.coalesce(named(F.col("label")), F.lit("?"))))
    sized = counts.join(keys, "node", "left").withColumn("entity", F.coalesce("component", "node")).groupBy("entity", "label").agg(F.sum("n").cast("double").alias("n"))
    draw = F.pmod(F.xxhash64("entity", F.lit("split")), F.lit(1_000_000)) / 1_000_000.0
    edges = np.cumsum(parts)[:-1]
    first = reduce(lambda c, i: c + (draw >= float(edges[i])).cast("int"), range(len(edges)), F.lit(0))
    state = stored(sized.withColumn("at", first))
    shares_of = [float(p) for p in parts]

    def totals(df: DataFrame) -> tuple[np.ndarray, DataFrame, float]:
        """What each split has too much for each record; the same of each label (label, label_over); the energy."""
        held = [F.sum(F.when(F.col("at") == s, F.col("n")).otherwise(0.0)).alias(f"n{s}") for s in range(len(names))]
        each = df.groupBy("label").agg(F.sum("n").alias("n"), *held)
        gaps = [F.col(f"n{s}") - F.lit(p) * F.col("n") for s, p in enumerate(shares_of)]
        each = stored(each.select("label", *[f"n{s}" for s in range(len(names))], F.array(*[g / F.col("n") for g in gaps]).alias("label_over"), sum((g * g for g in gaps), F.lit(0.0)).alias("squares")))
        row = each.agg(F.sum("squares").alias("squares"), *[F.sum(f"n{s}").alias(f"n{s}") for s in range(len(names))]).first()
        sizes = np.array([row[f"n{s}"] or 0.0 for s in range(len(names))])
        over = (sizes - parts * sizes.sum()) / max(sizes.sum(), 1.0)
        return over, each.select("label", "label_over"), float((over**2).sum() + label_weight * (row["squares"] or 0.0) / max(sizes.sum(), 1.0) ** 2)

    n = state.agg(F.approx_count_distinct("entity")).first()[0]
    blocks = max(1, -(-n // block))
    best = state
    over, label_over, lowest = totals(state)
    for turn in range(rounds if n else 0):
        search = _block_search(len(names), steps, chains, label_weight, turn)
        # another hash each round: entities meet other entities
        spread = best.join(label_over, "label").withColumns({"block": F.pmod(F.xxhash64("entity", F.lit(turn)), F.lit(blocks)), "size_over": F.array(*[F.lit(float(x)) for x in over])})
        state = stored(spread.groupBy("block").applyInPandas(search, best.select("entity", "label", "n", "at").schema))
        now, label_now, energy = totals(state)
        if energy >= lowest:
            break
        best, over, label_over, lowest = state, now, label_now, energy
    name = F.element_at(F.array(*[F.lit(s) for s in names]), F.col("at") + 1)
    places = best.select("entity", name.alias("split")).distinct()
    nodes = counts.select("node").distinct().join(keys, "node", "left").select("node", F.coalesce("component", "node").alias("entity"))
    placed = nodes.join(places, "entity").withColumnRenamed("node", "_node")
    return marked.join(placed, "_node").select(*records.columns, "entity", "split")


def target_shares(summary: DataFrame) -> dict[str, float]:
    """The total target_share of every split of ``summary``; all records train where none is above 0.

    There is a value for each split, however many rows the table has; null shares count as 0.
    """
    rows = summary.where("split_name is not null").groupBy("split_name").agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("share")).collect()
    shares = {r["split_name"]: r["share"] for r in rows}
    return shares if any(share > 0 for share in shares.values()) else {"train": 1.0}


def pair_splits(pairs: DataFrame, summary: DataFrame) -> DataFrame:
    """Every row of pairs with its entity and split, by the total target_share of each split in summary."""
    return assign_splits(pairs, target_shares(summary), label="program_pair", named=clean_pair_label)


def fold_conflicts(pairs: DataFrame, summary: DataFrame) -> DataFrame:
    """group_id of every entity that an earlier run has torn apart, one row each.

    The rows with a group_id get their entity, and the one split that it should be in, from
    ``pair_splits``; an entity is torn if its rows carry more than one non-null fold. Nulls in
    other columns tie nothing; no rows give no rows.
    """
    assigned = pair_splits(pairs.where("group_id is not null"), summary)
    groups = stored(assigned.groupBy("entity", "group_id").agg(F.min("fold").alias("low"), F.max("fold").alias("high")))
    torn = groups.groupBy("entity").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    return groups.join(torn.select("entity"), "entity", "left_semi").select("group_id").distinct()


def split_balance(pairs: DataFrame, summary: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """(split, target_share, n_rows, within_tolerance, n_entities_apart): how well ``pair_splits`` meets its targets.

    n_rows counts all rows, n_entities_apart the entities with rows in more than one split.
    """
    shares = target_shares(summary)
    whole = sum(shares.values())
    targets = pairs.sparkSession.createDataFrame([(s, x / whole) for s, x in shares.items()], "split string, target double")
    cells = stored(pair_splits(pairs, summary).groupBy("entity", "split").agg(F.count("*").alias("n")))
    apart = cells.groupBy("entity").agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n_entities_apart"))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    held = targets.join(cells.groupBy("split").agg(F.sum("n").alias("n")), "split", "left")
    shared = apart.withColumn("k", F.lit(1)).join(total.withColumn("k", F.lit(1)), "k")
    near = F.abs(F.coalesce("n", F.lit(0)) / F.greatest("n_rows", F.lit(1)) - F.col("target")) <= tolerance
    return held.withColumn("k", F.lit(1)).join(shared, "k").select("split", F.round("target", 4).alias("target_share"), "n_rows", near.alias("within_tolerance"), "n_entities_apart")
