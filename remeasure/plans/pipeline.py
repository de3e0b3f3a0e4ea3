"""The whole audit: from input files to tables, report and manifest."""

from __future__ import annotations

import json
import os
import platform
import subprocess
import sys
import time
from dataclasses import asdict, dataclass, field
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession

import remeasure
from remeasure.operators import calibration, correction, label_offsets, pairs, quality, summary
from remeasure.operators.label_offsets import OffsetRules
from remeasure.operators.quality import QualityRules
from remeasure.session import stored
from remeasure.sources.download import digest


@dataclass
class Audit:
    """The tables of a run by name, and the seconds of its stages."""

    tables: dict[str, DataFrame]
    timings: dict[str, float] = field(default_factory=dict)


def run_audit(
    epochs: DataFrame,
    offsets: DataFrame | None = None,
    rules: QualityRules = QualityRules(),
    cap: int = pairs.DEFAULT_CAP,
    label_rules: OffsetRules | None = None,
    permutations: int = label_offsets.DEFAULT_PERMUTATIONS,
) -> Audit:
    """Every table of an audit of ``epochs``; stages that others build on are written once and timed."""
    timings: dict[str, float] = {}
    began = time.perf_counter()

    def timed(name: str, df: DataFrame) -> DataFrame:
        start = time.perf_counter()
        out = stored(df)
        timings[name] = time.perf_counter() - start
        return out

    judged = timed("apply_velocity_calibration", quality.with_quality(correction.apply_velocity_calibration(epochs, offsets), rules))
    sources = timed("summarize_sources", summary.summarize_sources(judged))
    made = timed("build_pair_table", pairs.epoch_pairs(judged, cap))
    tables = {
        "source_summary": sources, "pairs": made, "correction_summary": correction.correction_coverage(judged), "epoch_quality": quality.epoch_quality(judged, rules),
        "rejection_counts": quality.rejection_counts(judged, rules), "source_classification_counts": summary.classification_counts(sources),
        "candidate_sources": summary.ranked(summary.candidates(sources)), "candidate_sources_strict": summary.ranked(summary.candidates(sources, strict=True)),
        "program_pair_counts": calibration.program_pair_counts(made), "residual_histogram": calibration.residual_histogram(made), **calibration.calibration_tables(made),
    }
    if label_rules is not None:
        start = time.perf_counter()
        tables |= {f"label_{name}": df for name, df in label_offsets.run_experiment(made, label_rules, permutations).items()}
        timings["label_experiment"] = time.perf_counter() - start
    timings["total"] = time.perf_counter() - began
    return Audit(tables, timings)


#: Tables that grow with the input; the rest are small reports.
LARGE = ("source_summary", "pairs", "candidate_sources", "candidate_sources_strict")


def save(audit: Audit, folder: str, lite: bool = False) -> list[str]:
    """Writes every table below ``folder``: large ones as Parquet, reports as one CSV file each.

    lite leaves out source_summary and pairs. Returns the names written.
    """
    written = []
    for name, df in audit.tables.items():
        if lite and name in ("source_summary", "pairs"):
            continue
        if name in LARGE:
            df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        else:
            df.coalesce(1).write.mode("overwrite").csv(f"{folder}/{name}.csv", header=True)
        written.append(name)
    return written


def manifest(inputs: list[str], parameters: dict, rules: QualityRules = QualityRules(), argv: list[str] | None = None) -> dict:
    """What is needed to repeat a run: versions, inputs with digests, rules and parameters."""
    revision = os.environ.get("REMEASURE_REVISION")
    if revision is None:
        found = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, cwd=Path(__file__).parent)
        revision = found.stdout.strip() or None
    files = [{"path": Path(p).as_posix(), "bytes": Path(p).stat().st_size, "sha256": digest(Path(p), "sha256")} for p in inputs if Path(p).is_file()]
    versions = {"remeasure": remeasure.__version__, "pyspark": pyspark.__version__, "python": platform.python_version()}
    return {"revision": revision, "command": argv if argv is not None else sys.argv, "platform": platform.platform(), "versions": versions, "inputs": files, "quality_rules": asdict(rules), "parameters": parameters}


def write_manifest(content: dict, path: str) -> None:
    Path(path).write_text(json.dumps(content, indent=2, sort_keys=True, default=str) + "\n")


def read_saved(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A table that ``save`` wrote, or None."""
    if Path(f"{folder}/{name}.parquet").exists():
        return spark.read.parquet(f"{folder}/{name}.parquet")
    if Path(f"{folder}/{name}.csv").exists():
        return spark.read.csv(f"{folder}/{name}.csv", header=True, inferSchema=True)
    return None
