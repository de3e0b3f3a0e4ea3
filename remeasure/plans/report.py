"""A Markdown report and, where matplotlib is there, plots, from the small tables of an audit."""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import DataFrame

SECTIONS = (
    ("source_classification_counts", "Sources by class", 10), ("candidate_sources_strict", "Strict candidates", 10), ("epoch_quality", "Epoch quality", 36), ("rejection_counts", "Rejections", 12),
    ("correction_summary", "Correction coverage", 1), ("calibration_overall", "Pair residuals", 1), ("calibration_overall_formal", "Pair residuals with formal errors", 1),
    ("calibration_by_program", "By program", 36), ("calibration_interday", "By program, beyond a day", 36), ("calibration_by_sn", "By signal-to-noise", 12),
    ("label_summary", "Label offsets on held-out sources", 12), ("label_reproducibility", "Two halves of the sources", 1), ("label_permutations", "Shuffled nights", 10),
)
FEW_PAIRS = 30


def shown(value, column: str = "") -> str:
    """A cell: counts with thousands marks, fractions with five digits, other numbers with three, n/a for what isn't finite."""
    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return "n/a"
    if isinstance(value, float):
        return f"{int(value):,}" if column.lower().startswith("n_") else f"{value:.{5 if 'FRACTION' in column.upper() else 3}f}"
    if isinstance(value, int) and column.lower().startswith("n_"):
        return f"{value:,}"
    return str(value)


def markdown_table(df: DataFrame, rows: int) -> str:
    """The first ``rows`` rows of a report table."""
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(shown(v, c) for c, v in zip(df.columns, r)) + " |" for r in df.limit(rows).collect()]
    return "\n".join(lines)


def build_report(tables: dict[str, DataFrame], title: str = "Audit of repeated measurements") -> str:
    """The report of those tables that are there; a note says how far backup pairs carry."""
    parts = [f"# {title}", ""]
    for name, heading, rows in SECTIONS:
        if name in tables:
            parts += [f"## {heading}", "", markdown_table(tables[name], rows), ""]
    if "program_pair_counts" in tables:
        n = tables["program_pair_counts"].first()["N_CROSS_PROGRAM_PAIRS"]
        note = "No pairs join backup with other programs." if n == 0 else f"Only {n} pairs join backup with other programs; read their rows with care." if n < FEW_PAIRS else f"{n:,} pairs join backup with other programs."
        parts += ["## Backup pairs", "", note, ""]
    return "\n".join(parts)


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    Path(path).write_text(build_report(tables))


def write_plots(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """The histogram of residuals and widths by program; nothing where matplotlib is missing."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        import matplotlib.pyplot as plt
    except ImportError:
        return []
    written = []
    if "residual_histogram" in tables:
        figure, axes = plt.subplots()
        bins = tables["residual_histogram"].orderBy("BIN_LOW").collect()
        for column in sorted({r["Z_COLUMN"] for r in bins}):
            own = [r for r in bins if r["Z_COLUMN"] == column]
            axes.step([r["BIN_LOW"] for r in own], [r["DENSITY"] for r in own], where="post", label=column)
        axes.legend()
        figure.savefig(f"{folder}/residual_histogram.png")
        written.append("residual_histogram.png")
    if "calibration_interday" in tables:
        figure, axes = plt.subplots()
        rows = tables["calibration_interday"].orderBy("PROGRAM_PAIR").limit(60).collect()
        axes.barh([str(r["PROGRAM_PAIR"]) for r in rows], [r["ROBUST_WIDTH_Z"] for r in rows])
        figure.savefig(f"{folder}/interday_widths.png")
        written.append("interday_widths.png")
    return written
