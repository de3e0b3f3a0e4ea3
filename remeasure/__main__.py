"""python -m remeasure analyze INPUT... --output DIR | report DIR | download URL... --output DIR"""

from __future__ import annotations

import argparse
import csv
from pathlib import Path

from pyspark.sql import SparkSession

from remeasure.operators import pairs
from remeasure.operators.label_offsets import DEFAULT_PERMUTATIONS, OffsetRules
from remeasure.operators.quality import QualityRules
from remeasure.plans import pipeline, report
from remeasure.session import drop_stored
from remeasure.sources import download, readers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="remeasure", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    analyze = commands.add_parser("analyze")
    analyze.add_argument("inputs", nargs="+")
    analyze.add_argument("--output", required=True)
    analyze.add_argument("--correction")
    analyze.add_argument("--correction-md5", default="")
    analyze.add_argument("--max-rows", type=int)
    analyze.add_argument("--cap", type=int, default=pairs.DEFAULT_CAP)
    analyze.add_argument("--strict", action="store_true")
    analyze.add_argument("--lite", action="store_true")
    analyze.add_argument("--labels", action="store_true", help="test label offsets on held-out sources")
    analyze.add_argument("--permutations", type=int, default=DEFAULT_PERMUTATIONS, help="shuffles of nights with --labels")
    analyze.add_argument("--min-sn-r", type=float, default=QualityRules.min_sn_r)
    label = OffsetRules()
    analyze.add_argument("--min-pairs-per-label", type=int, default=label.min_pairs_per_label)
    analyze.add_argument("--folds", type=int, default=label.folds)
    analyze.add_argument("--max-abs-z", type=float, default=label.max_abs_z)
    analyze.add_argument("--clip", type=float, default=label.clip)
    analyze.add_argument("--clip-rounds", type=int, default=label.clip_rounds)
    analyze.add_argument("--damp", type=float, default=label.damp)
    analyze.add_argument("--min-delta-days", type=float, default=label.min_delta_days)
    again = commands.add_parser("report")
    again.add_argument("folder")
    fetch = commands.add_parser("download")
    fetch.add_argument("urls", nargs="+")
    fetch.add_argument("--output", required=True)
    fetch.add_argument("--no-resume", action="store_true")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "download":
        files = [download.RemoteFile(u, u.rsplit("/", 1)[-1]) for u in args.urls]
        download.fetch_all(files, Path(args.output), resume=not args.no_resume)
        return
    spark = SparkSession.builder.appName("remeasure").getOrCreate()
    if args.command == "report":
        names = {name for name, _, _ in report.SECTIONS} | {"program_pair_counts"}
        found = {n: df for n in names if (df := pipeline.read_saved(spark, args.folder, n)) is not None}
        report.write_report(found, f"{args.folder}/report.md")
        return
    if args.correction and args.correction_md5 and download.digest(Path(args.correction)) != args.correction_md5:
        raise ValueError("The correction's MD5 mismatches the expected one")
    epochs = readers.read_many(spark, args.inputs, args.max_rows, args.strict)
    offsets = readers.read_correction(spark, args.correction) if args.correction else None
    names = ("min_pairs_per_label", "folds", "max_abs_z", "clip", "clip_rounds", "damp", "min_delta_days")
    rules = OffsetRules(**{n: getattr(args, n) for n in names}) if args.labels else None
    audit = pipeline.run_audit(epochs, offsets, QualityRules(min_sn_r=args.min_sn_r), args.cap, rules, args.permutations)
    Path(args.output).mkdir(parents=True, exist_ok=True)
    pipeline.save(audit, args.output, args.lite)
    with open(f"{args.output}/stage_timings.csv", "w", newline="") as f:
        csv.writer(f).writerows([("stage", "elapsed_seconds"), *audit.timings.items()])
    pipeline.write_manifest(pipeline.manifest(args.inputs, vars(args)), f"{args.output}/run_manifest.json")
    report.write_report(audit.tables, f"{args.output}/report.md")
    report.write_plots(audit.tables, args.output)
    drop_stored(spark)


if __name__ == "__main__":
    main()
