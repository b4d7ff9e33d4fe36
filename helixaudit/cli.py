"""Command line: ``python -m helixaudit.cli evaluate-classes|evaluate-splits ...``."""

from __future__ import annotations

import argparse
import logging
import sys


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="helixaudit", description="Quality control of labelled sequence collections on Spark.")
    commands = top.add_subparsers(dest="command", required=True)
    classes = commands.add_parser("evaluate-classes", help="compare all pairs of classes")
    classes.add_argument("--input", nargs="+", required=True)
    classes.add_argument("--label-column", default="label")
    classes.add_argument("--label-list", nargs="+", default=["infer"])
    classes.add_argument("--regression", action="store_true")
    classes.add_argument("--report-types", nargs="+", default=["html", "simple"])
    classes.add_argument("--end-position", type=int)
    classes.add_argument("--min-coverage", type=float, default=0.25)
    classes.add_argument("--plot-type", default="boxen", help="boxen or violin")
    splits = commands.add_parser("evaluate-splits", help="measure leakage of a test half into a training half")
    splits.add_argument("--train-input", nargs="+", required=True)
    splits.add_argument("--test-input", nargs="+", required=True)
    splits.add_argument("--report-types", nargs="+", default=["html", "simple"])
    splits.add_argument("--similarity-threshold", type=float, default=90.0)
    splits.add_argument("--hits", help="a hit table to use instead of the similarity join")
    for command in (classes, splits):
        command.add_argument("--sequence-column", nargs="+", default=["sequence"])
        command.add_argument("--out-folder", default=".")
        command.add_argument("--log-level", default="INFO")
        command.add_argument("--log-file")
    return top


def main(arguments: list[str] | None = None, spark=None) -> int:
    options = parser().parse_args(arguments)
    logging.basicConfig(level=options.log_level.upper(), filename=options.log_file, format="%(levelname)s %(message)s")
    from pyspark.sql import SparkSession

    from .plans import runs
    from .session import ship
    from .sources.tables import infer_format

    try:
        if options.command == "evaluate-classes" and infer_format(options.input) == "fasta" and len(options.input) < 2:
            raise ValueError("FASTA input needs at least two files, one per class")
        spark = spark or SparkSession.builder.appName("helixaudit").getOrCreate()
        ship(spark)
        if options.command == "evaluate-classes":
            labels = None if options.label_list == ["infer"] else options.label_list
            runs.evaluate_classes(spark, options.input, options.out_folder, options.sequence_column, options.label_column, labels, options.regression, tuple(options.report_types), options.end_position, options.min_coverage, plot_type=options.plot_type)
        else:
            runs.evaluate_splits(spark, options.train_input, options.test_input, options.out_folder, options.sequence_column, tuple(options.report_types), options.similarity_threshold, options.hits)
    except ValueError as error:
        logging.error("%s", error)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
