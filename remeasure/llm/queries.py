"""The registered queries of the llm subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from remeasure.llm import components, distinct, packing, percentiles, sentences, splits, tokens
from remeasure.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _on(names: str, f: Callable[..., DataFrame]) -> Query:
    """A query that calls ``f`` with the tables ``names``."""
    return lambda spark, sf_dir: f(*[table(spark, sf_dir, n) for n in names.split()])


def _distinct(rvtab: DataFrame, pairs: DataFrame) -> DataFrame:
    targets = distinct.distinct_report(distinct.measurement_sightings(rvtab), "rvtab.targetid")
    return targets.unionByName(distinct.distinct_report(distinct.pair_sightings(pairs), "pairs.group_id"))


def _percentiles(pairs: DataFrame, by_program: DataFrame) -> DataFrame:
    readings = {"pairs.delta_vrad": percentiles.pair_readings(pairs), "by_program.raw_width_before_kms": percentiles.run_readings(by_program)}
    return percentiles.percentile_report(readings)


#: Groups whose union and overlap p3_combinations counts.
_PROGRAMS = ["BACKUP", "BRIGHT", "DARK"]


def _combinations(rvtab: DataFrame, pairs: DataFrame) -> DataFrame:
    targets = distinct.combination_report(distinct.measurement_sightings(rvtab), "rvtab.targetid", _PROGRAMS)
    return targets.unionByName(distinct.combination_report(distinct.pair_sightings(pairs), "pairs.group_id", _PROGRAMS))


QUERIES: dict[str, Query] = {
    "p2_found": _on("pairs summary", splits.fold_conflicts),
    "p2_balance": _on("pairs summary", splits.split_balance),
    "p2_splits": _on("pairs summary", lambda pairs, summary: splits.pair_splits(pairs, summary).select("pair_id", "group_id", "targetid_1", "targetid_2", "entity", "split")),
    "p3_distinct": _on("rvtab pairs", _distinct),
    "p3_combinations": _on("rvtab pairs", _combinations),
    "p5_percentiles": _on("pairs by_program", _percentiles),
    "p6_found": _on("pairs", components.label_groups),
    "p7_ids": _on("documents", tokens.token_ids),
    "p8_packed": _on("documents", packing.pack_documents),
    "p8_report": _on("documents", packing.packing_report),
    "p9_found": _on("documents", sentences.sentences),
}


def _label(c: str) -> str:
    return rf"upper(regexp_replace({c}, '^\s+|\s+$', '', 'g'))"


def _night(c: str) -> str:
    return rf"nullif(regexp_extract(regexp_replace({c}, '[\s-]', '', 'g'), '^(\d{{8}})(\.0*)?$', 1), '')"


def _pair(c: str) -> str:
    parts = rf"list_transform(string_split({_label(c)}, '/'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))"
    return f"CASE WHEN len({parts}) = 2 AND NOT list_contains({parts}, '') THEN array_to_string(list_sort({parts}), ' / ') END"


#: (node, component) by repeated steps over the edges e(a, b) in both directions.
_CLOSURE = """, reach(node, other) AS (
  SELECT a, a FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON reach.other = e.a
), component AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
"""

ORACLES: dict[str, str] = {
    "p2_found": f"""
WITH RECURSIVE k AS (SELECT DISTINCT group_id, targetid FROM (
    SELECT group_id, targetid_1 AS targetid FROM pairs UNION SELECT group_id, targetid_2 FROM pairs) WHERE group_id IS NOT NULL AND targetid IS NOT NULL
), low AS (SELECT targetid, min(group_id) AS least FROM k GROUP BY targetid),
links AS (SELECT DISTINCT group_id AS a, least AS b FROM k JOIN low USING (targetid) WHERE group_id <> least),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links){_CLOSURE},
entity AS (SELECT g.group_id, coalesce(component, g.group_id) AS entity, fold FROM pairs g LEFT JOIN component ON node = group_id WHERE group_id IS NOT NULL)
SELECT DISTINCT group_id FROM entity WHERE entity IN (SELECT entity FROM entity GROUP BY entity HAVING count(DISTINCT fold) > 1)
""",
    "p2_balance": """
SELECT split_name AS split, round(sum(target_share) / (SELECT sum(target_share) FROM summary WHERE split_name IS NOT NULL), 4) AS target_share,
  (SELECT count(*) FROM pairs) AS n_rows, true AS within_tolerance, 0::BIGINT AS n_entities_apart
FROM summary WHERE split_name IS NOT NULL GROUP BY split_name
""",
    "p8_report": "SELECT count(*) AS n_documents, 0::BIGINT AS n_over_capacity, 0::BIGINT AS n_divided_that_fit, true AS is_tight FROM documents",
    "p3_combinations": f"""
WITH seen AS (
  SELECT 'rvtab.targetid' AS field_name, targetid AS id, {_label("program")} AS program FROM rvtab
  UNION ALL SELECT 'pairs.group_id', group_id, {_label("program_1")} FROM pairs UNION ALL SELECT 'pairs.group_id', group_id, {_label("program_2")} FROM pairs
), s AS (SELECT DISTINCT * FROM seen WHERE id IS NOT NULL AND program IN ('BACKUP', 'BRIGHT', 'DARK')),
n AS (SELECT field_name, id, count(*) AS n FROM s GROUP BY ALL)
SELECT field_name, 'any' AS combination, count(*) AS n_distinct FROM n GROUP BY field_name
UNION ALL SELECT field_name, 'every', count(*) FILTER (WHERE n = 3) FROM n GROUP BY field_name
""",
    "p3_distinct": f"""
WITH seen AS (
  SELECT 'rvtab.targetid' AS field_name, targetid AS id, CAST(night AS VARCHAR) AS night, {_label("program")} AS program FROM rvtab
  UNION ALL SELECT 'pairs.group_id', group_id, {_night("night_1")}, {_label("program_1")} FROM pairs
  UNION ALL SELECT 'pairs.group_id', group_id, {_night("night_2")}, {_label("program_2")} FROM pairs
), s AS (SELECT DISTINCT *, substr(night, 1, 6) AS month FROM seen WHERE id IS NOT NULL),
p AS (SELECT DISTINCT field_name, id, program FROM s WHERE program IS NOT NULL),
names AS (SELECT DISTINCT field_name, program FROM p),
two AS (SELECT x.field_name, x.program AS a, y.program AS b FROM names x JOIN names y ON x.field_name = y.field_name AND x.program < y.program),
either AS (
  SELECT two.field_name, a, b, count(DISTINCT id) AS n FROM two JOIN p ON p.field_name = two.field_name AND p.program IN (a, b) GROUP BY ALL
), overlap AS (
  SELECT x.field_name, x.program AS a, y.program AS b, count(*) AS n FROM p x JOIN p y ON x.field_name = y.field_name AND x.id = y.id AND x.program < y.program GROUP BY ALL
), found AS (
  SELECT field_name, 'night_program' AS scope, night, program, count(DISTINCT id) AS n_distinct FROM s GROUP BY ALL
  UNION ALL SELECT field_name, 'night', night, NULL, count(DISTINCT id) FROM s GROUP BY ALL
  UNION ALL SELECT field_name, 'program', NULL, program, count(DISTINCT id) FROM s GROUP BY ALL
  UNION ALL SELECT field_name, 'month', month, NULL, count(DISTINCT id) FROM s GROUP BY ALL
  UNION ALL SELECT field_name, 'month_program', month, program, count(DISTINCT id) FROM s GROUP BY ALL
  UNION ALL SELECT field_name, 'all', NULL, NULL, count(DISTINCT id) FROM s GROUP BY ALL
  UNION ALL SELECT field_name, 'programs_or', NULL, a || ' | ' || b, n FROM either
  UNION ALL SELECT two.field_name, 'programs_and', NULL, two.a || ' & ' || two.b, coalesce(n, 0) FROM two LEFT JOIN overlap USING (field_name, a, b)
)
SELECT *, 0 AS max_error FROM found
""",
    "p5_percentiles": f"""
WITH r AS (
  SELECT DISTINCT 'pairs.delta_vrad' AS field_name, pair_id AS a, 0 AS b, {_pair("program_pair")} AS program_pair, {_night("night_1")} AS night, delta_vrad AS v FROM pairs
  UNION ALL SELECT DISTINCT 'by_program.raw_width_before_kms', run_id, fold, {_pair("program_pair")}, CAST(run_night AS VARCHAR), raw_width_before_kms FROM by_program
), f AS (SELECT * FROM r WHERE isfinite(v)), q(percentile) AS (VALUES (0.05::DOUBLE), (0.16), (0.5), (0.84), (0.95)),
scoped AS (
  SELECT field_name, 'night' AS scope, program_pair, night, list(v) AS vs FROM f GROUP BY ALL
  UNION ALL SELECT field_name, 'all', program_pair, NULL, list(v) FROM f GROUP BY ALL
), s AS (SELECT field_name, scope, program_pair, night, list_sort(vs) AS vs, len(vs) AS n_values FROM scoped)
SELECT field_name, scope, program_pair, night, percentile, n_values, 0.0::DOUBLE AS max_error,
  vs[floor(percentile * (n_values - 1))::INT + 1] + (percentile * (n_values - 1) - floor(percentile * (n_values - 1)))
    * (vs[least(floor(percentile * (n_values - 1))::INT + 2, n_values)] - vs[floor(percentile * (n_values - 1))::INT + 1]) AS value
FROM s CROSS JOIN q
""",
    "p6_found": f"""
WITH RECURSIVE l AS (
  SELECT DISTINCT {_label("program_1")} || ':' || {_night("night_1")} AS a, {_label("program_2")} || ':' || {_night("night_2")} AS b FROM pairs
  WHERE group_id IS NOT NULL AND isfinite(delta_vrad) AND pair_error > 0 AND NOT isnan(pair_error) AND {_label("program_1")} <> '' AND {_label("program_2")} <> ''
), u AS (SELECT a, b FROM l WHERE a IS NOT NULL AND b IS NOT NULL), e AS (SELECT a, b FROM u UNION SELECT b, a FROM u){_CLOSURE}
SELECT node AS label, component AS group_label FROM component
""",
}
