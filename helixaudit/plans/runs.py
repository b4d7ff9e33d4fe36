"""The two commands as functions: read files, run the checks in Spark, write the reports.

Only report rows reach the driver: flags and metrics per feature and position, histograms, and
at most ``leakage.LISTED`` alignments. Sequences and hits stay in Spark.
"""

from __future__ import annotations

import csv
import json
import logging
import math
import re
from itertools import combinations
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming
from ..operators import composition, distribution, duplicates, features, leakage, metrics, positions, similarity
from ..session import forget, marked, spread, write_once
from ..sources import fasta, tables
from ..sources.hits import read_hits
from . import class_report, drawings, html

log = logging.getLogger(__name__)
#: Report types of either command, and file names (fixed values).
CLASS_REPORTS, SPLIT_REPORTS = ("json", "html", "simple"), ("html", "simple")
SIMPLE_FILE, HTML_FILE, DUPLICATES_FILE, HITS_FILE, PER_CLASS = "report.csv", "report.html", "duplicates.txt", "leaked_hits.tsv", "per-class"
#: Cells of drawn histograms.
CELLS = 50
TEST_FASTA, TRAIN_FASTA = "test_sequences.fasta", "train_sequences.fasta"
HEADER = ("Check", "Flag", "AU-ROC", "AU-PR", "Accuracy")


def check_report_types(wanted: tuple[str, ...], known: tuple[str, ...]) -> None:
    """Raise for an unknown report type, before any work is done."""
    if unknown := [t for t in wanted if t not in known]:
        raise ValueError(f"unknown report type {', '.join(unknown)}; known are {', '.join(known)}")


def _write_csv(path: Path, header, rows) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="", encoding="utf-8") as file:
        out = csv.writer(file)
        out.writerow(header)
        out.writerows(["" if v is None else v for v in r] for r in rows)


def class_inputs(spark: SparkSession, inputs: list[str], sequence_columns: list[str], label_column: str, label_list: list[str] | None, regression: bool) -> list[tuple[str, DataFrame, list[str], list[str]]]:
    """(column folder, (label, seq), labels, their slugs) of each analysis of the inputs."""
    kind = tables.infer_format(inputs)
    if kind == "fasta":
        names = [naming.stem(p) for p in inputs]
        slugs = naming.unique_slugs(names, [Path(p).resolve().parent.name for p in inputs])
        rows = None
        for path, slug in zip(inputs, slugs):
            part = fasta.read_fasta(spark, path).select(F.lit(slug).alias("label"), "seq")
            if part.isEmpty():
                raise ValueError(f"{path}: no sequences")
            rows = part if rows is None else rows.unionByName(part)
        return [(naming.NO_COLUMN, rows, slugs, slugs)]
    df = tables.read_table(spark, inputs, kind)
    if regression and label_list:
        log.warning("a list of labels has no use with a regression target and is ignored")
    out = []
    for folder, columns in zip(naming.column_folders(sequence_columns), tables.column_sets(sequence_columns)):
        s = tables.median_split(df, columns, label_column, ", ".join(inputs)) if regression else tables.labelled(df, columns, label_column, ", ".join(inputs))
        labels = ["high", "low"] if regression else tables.resolve_labels(s, label_list)
        out.append((folder, s.where(F.col("label").isin(*labels)), labels, naming.unique_slugs(labels)))
    return out


def evaluate_classes(spark: SparkSession, inputs: list[str], out_folder: str = ".", sequence_columns: list[str] | None = None, label_column: str = "label", label_list: list[str] | None = None, regression: bool = False, report_types: tuple[str, ...] = ("html", "simple"), end_position: int | None = None, min_coverage: float = 0.25, extra: tuple[features.Feature, ...] = (), plot_type: str = drawings.KINDS[0]) -> list[Path]:
    """Compare all pairs of classes of the inputs and write their reports; returns the folders written.

    All pairs of an analysis are scored in one job. ``extra`` adds user features to the checks; ``plot_type`` is one of ``drawings.KINDS``.
    """
    check_report_types(report_types, CLASS_REPORTS)
    if plot_type not in drawings.KINDS:
        raise ValueError(f"unknown plot type {plot_type}; known are {', '.join(drawings.KINDS)}")
    if end_position is not None and end_position < 1 or not 0 <= min_coverage <= 1:
        raise ValueError("end_position must be positive and min_coverage between 0 and 1")
    folders, since = [], marked(spark)
    for column, s, labels, slugs in class_inputs(spark, inputs, sequence_columns or ["sequence"], label_column, label_list, regression):
        slug_of = dict(zip(labels, slugs))
        ordered = sorted(labels, key=slug_of.get)
        s = spread(s).persist()
        try:
            if "json" in report_types:
                folders.append(_write_class_json(s, naming.comparison_folder(out_folder, "class", column) / PER_CLASS, slug_of))
            if len(ordered) < 2:
                continue
            checks = features.FEATURES + extra
            hist = write_once(features.histograms(s, checks), "histograms")
            rows = class_report.class_report(s, end_position, min_coverage, features=checks, order={x: i for i, x in enumerate(ordered)}, hist=hist)
            by_pair: dict[tuple[str, str], list] = {}
            for r in rows.orderBy("label_1", "label_2", "row").toLocalIterator():
                by_pair.setdefault((r["label_1"], r["label_2"]), []).append(r)
            shared = duplicates.shared(s).persist()
            drawn = drawing_rows(s, hist, checks, end_position, min_coverage, plot_type) if "html" in report_types else None
            for one, two in combinations(ordered, 2):
                folder = naming.comparison_folder(out_folder, "class", column, slug_of[one], slug_of[two])
                folder.mkdir(parents=True, exist_ok=True)
                own = by_pair.get((one, two), [])
                if "simple" in report_types:
                    _write_csv(folder / SIMPLE_FILE, HEADER, [[r[c] for c in ("check", "flag", "auroc", "aupr", "accuracy")] for r in own])
                both = shared.where(F.least("label_1", "label_2").eqNullSafe(min(one, two)) & F.greatest("label_1", "label_2").eqNullSafe(max(one, two)))
                _write_duplicates(both, folder / DUPLICATES_FILE)
                if "html" in report_types:
                    (folder / HTML_FILE).write_text(_class_page(s, one, two, own, both, drawn), encoding="utf-8")
                folders.append(folder)
            shared.unpersist()
        finally:
            s.unpersist()
            forget(spark, since)
    return folders


def position_payload(s: DataFrame, end_position: int | None, min_coverage: float) -> dict[str, dict]:
    """By class: the share of each base at each reported position in both directions, and the coverage, to three decimals.

    Its size is positions times bases of the classes, whatever the number of sequences.
    """
    lengths = positions.length_counts(s)
    window = positions.windows(lengths, end_position, min_coverage)
    last = {r["label"]: r["end_position"] for r in window.collect()}
    out = {label: {"coverage": [0.0] * n, "forward": {}, "reversed": {}} for label, n in last.items()}
    reach: dict[tuple[str, int], int] = {}
    for r in positions.cohorts(lengths).join(F.broadcast(window.select("label", "end_position")), "label").where(F.col("pos") <= F.col("end_position")).toLocalIterator():
        out[r["label"]]["coverage"][r["pos"] - 1] = round(r["coverage"], 3)
        reach[r["label"], r["pos"]] = r["cohort"]
    for r in positions.both_counts(s, window.select("label", F.col("end_position").alias("last"))).toLocalIterator():
        line = out[r["label"]]["reversed" if r["reverse"] else "forward"].setdefault(r["base"], [0.0] * last[r["label"]])
        line[r["pos"] - 1] = round(r["n"] / reach[r["label"], r["pos"]], 3)
    return out


def _write_duplicates(both: DataFrame, path: Path) -> None:
    """Sequences of both classes in order, one a line; no file without any. They stream through the driver, partition by partition."""
    rows = both.select("seq").orderBy("seq").toLocalIterator()
    first = next(rows, None)
    if first is not None:
        with path.open("w", encoding="utf-8") as file:
            file.write(first["seq"] + "\n")
            file.writelines(r["seq"] + "\n" for r in rows)


def _write_class_json(s: DataFrame, folder: Path, slug_of: dict[str, str]) -> Path:
    """One file per class with its summary, lengths, and counts by position; and two folders of JSON lines, which Spark writes.

    ``<class>-sequences`` has the values of each sequence (its length, GC content, and shares of characters and pairs), ``<class>-duplicates``
    the sequences that occur again, most copies first.
    """
    folder.mkdir(parents=True, exist_ok=True)
    lengths = positions.length_counts(s)
    summary = {r["label"]: r.asDict() for r in features.class_summary(s).collect()}
    spread: dict[str, dict] = {}
    for r in lengths.orderBy("label", "len").toLocalIterator():
        spread.setdefault(r["label"], {})[r["len"]] = r["n"]
    window = positions.windows(lengths).select("label", F.col("end_position").alias("last"))
    places: dict[tuple, dict] = {}
    for r in positions.both_counts(s, window).orderBy("label", "reverse", "base", "pos").toLocalIterator():
        places.setdefault((r["label"], r["reverse"]), {}).setdefault(r["base"], {})[r["pos"]] = r["n"]
    for label, slug in slug_of.items():
        held = summary.get(label, {"label": label, "sequences": 0}) | {"lengths": spread.get(label, {}), "positions": places.get((label, False), {}), "positions_reversed": places.get((label, True), {})}
        (folder / f"{slug}.json").write_text(json.dumps(held, indent=1), encoding="utf-8")
    # Numbers only tell sequences apart and order them; both are read from one written table, so they agree.
    numbered = write_once(s.select(F.monotonically_increasing_id().alias("no"), "label", "seq"), "numbered")
    frames = composition.frames(numbered)
    copies = duplicates.ranked_levels(numbered)
    for label, slug in slug_of.items():
        frames.where(F.col("label").eqNullSafe(label)).drop("label").write.mode("overwrite").json(str(folder / f"{slug}-sequences"))
        copies.where(F.col("label").eqNullSafe(label)).orderBy("place").drop("label").write.mode("overwrite").json(str(folder / f"{slug}-duplicates"))
    return folder


def drawing_rows(s: DataFrame, hist: DataFrame, checks: tuple[features.Feature, ...], end_position: int | None, min_coverage: float, kind: str) -> dict:
    """What the pages of an analysis draw: letter values and cells of every feature of every class, shares by position, and the kind of drawing.

    Its size is features and positions times classes, whatever the number of sequences.
    """
    sizes = s.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    filled = write_once(distribution.with_zeros(hist, features.alphabets(s), sizes, checks), "distributions")
    values = {(r["check"], r["label"], r["feature"]): (r["low"], r["high"], r["letters"]) for r in distribution.letter_values(filled).collect()}
    cells: dict[tuple, dict[int, int]] = {}
    for r in distribution.grid(filled, CELLS).collect():
        cells.setdefault((r["check"], r["label"], r["feature"]), {})[r["cell"]] = r["n"]
    return {"values": values, "cells": cells, "places": position_payload(s, end_position, min_coverage), "kind": kind, "sizes": {r["label"]: r["n"] for r in sizes.collect()}, "coverage": min_coverage}


def not_scored(head: list, one: str, two: str, sizes: dict[str, int], min_coverage: float) -> str:
    """A note on the checks that were not scored and why, or nothing."""
    names = [r["check"] for r in head if r["flag"] == "Unknown"]
    if not names:
        return ""
    smaller = min(sizes.get(c, 0) for c in (one, two))
    by_place = [n for n in names if n in (features.FORWARD, features.REVERSED)]
    lines = []
    if whole := [n for n in names if n not in by_place]:
        lines.append(f"{', '.join(whole)}: the smaller class has {smaller:,} sequences. Below {metrics.FLOOR}, chance alone makes differences that these checks would report.")
    if by_place:
        share = max((max(metrics.FLOOR, math.ceil(min_coverage * n)) / n for n in (sizes.get(c, 0) for c in (one, two)) if n), default=0.0)
        lines.append(f"{', '.join(by_place)}: no position is reached by enough sequences of both classes (at least {metrics.FLOOR}, and {100 * min(share, 1):.1f} % of a class here).")
    items = "".join(f"<li>{html.escaped(line)}</li>" for line in lines)
    return f'<div class="Unknown"><strong>{len(names)} checks were not scored.</strong> Unknown is not a pass: the comparison was not made.<ul>{items}</ul></div>'


def _class_page(s: DataFrame, one: str, two: str, rows: list, both: DataFrame, drawn: dict) -> str:
    head = [r for r in rows if r["headline"]]
    summary = {r["label"]: r for r in features.class_summary(s.where(F.col("label").isin(one, two))).collect()}
    names = ("sequences", "bases", "unique_bases", "gc", "distinct_sequences", "empty_sequences", "min_length", "mean_length", "max_length")
    tally = {f: sum(r["flag"] == f for r in head) for f in ("Fail", "Warning", "Pass", "Unknown")}
    metrics_of = lambda r: [r["check"], r["flag"], *map(html.number, (r["auroc"], r["aupr"], r["accuracy"]))]
    sections = [
        ("Verdict", html.table(["Flag", "Checks"], [[k, v] for k, v in tally.items()], 0) + not_scored(head, one, two, drawn["sizes"], drawn["coverage"])),
        ("Checks", html.table(list(HEADER), [metrics_of(r) for r in head], 1)),
        ("Classes", html.table(["", one, two], [[n, *(summary[c][n] if c in summary else 0 for c in (one, two))] for n in names])),
    ]
    for r in head:
        sections.append((r["check"], _check_section(r["check"], r["flag"], one, two, rows, both, drawn, metrics_of)))
    data = {"positions": {c: drawn["places"].get(c, {}) for c in (one, two)}, "rows": [[r["check"], r["flag"], None if r["auroc"] is None else round(r["auroc"], 3)] for r in rows]}
    return html.page(f"{one} and {two}", sections).replace("</body>", f'<script type="application/json" id="rows">{html.payload(data)}</script></body>')


def _check_section(check: str, flag: str, one: str, two: str, rows: list, both: DataFrame, drawn: dict, metrics_of) -> str:
    """The flag of a check, its drawing, and its sub-checks that are a warning or a failure."""
    own = {r["check"].removeprefix(f"{check} - "): r for r in rows if r["check"].startswith(f"{check} - ")}
    out = [f'<p class="{html.escaped(flag)}">{html.escaped(flag)}</p>']
    if check in (features.FORWARD, features.REVERSED):
        flags = {(m[1], int(m[2])): r["flag"] for name, r in own.items() if (m := re.fullmatch(r"(?s)(.+) position (\d+)", name))}
        side = "forward" if check == features.FORWARD else "reversed"
        out += [drawings.shares_by_position(drawn["places"].get(c, {}).get(side, {}), flags, f"{c}: shares by position") for c in (one, two)]
    elif any(k[0] == check for k in drawn["values"]):
        names = sorted({f for c, label, f in drawn["values"] if c == check and label in (one, two)})
        pick = lambda of: {(label, f): v for (c, label, f), v in of.items() if c == check}
        out.append(drawings.spread_of_features(names, (one, two), pick(drawn["values"]), pick(drawn["cells"]), CELLS, drawn["kind"], {n: r["flag"] for n, r in own.items()}, check))
    if check == features.BETWEEN and flag == "Fail":
        first = [r["seq"] for r in both.orderBy("seq").limit(10).collect()]
        out.append("<pre>" + "\n".join(html.escaped(x if len(x) <= 100 else x[:97] + "...") for x in first) + "</pre>")
    if flagged := [r for r in own.values() if r["flag"] in ("Fail", "Warning")]:
        out.append(html.table(list(HEADER), [metrics_of(r) for r in flagged], 1))
    return "".join(out)


def split_half(spark: SparkSession, inputs: list[str], columns: list[str], half: str) -> DataFrame:
    """(no, id, seq) of one half of a split, numbered in the order of the input; raises if it is empty."""
    kind = tables.infer_format(inputs)
    if kind == "fasta":
        rows = fasta.read_fasta(spark, inputs, placed=True)
    else:
        df = tables.read_table(spark, inputs, kind, placed=True)
        tables.require_columns(df, {c: "sequence column" for c in columns}, ", ".join(inputs))
        rows = df.select("file", "start", "at", tables.sequence(columns).alias("seq"))
    rows = fasta.in_input_order(rows, half, inputs)
    if rows.isEmpty():
        raise ValueError(f"no {half} sequences in {', '.join(inputs)}")
    return rows


def evaluate_splits(spark: SparkSession, train_input: list[str], test_input: list[str], out_folder: str = ".", sequence_columns: list[str] | None = None, report_types: tuple[str, ...] = ("html", "simple"), similarity_threshold: float = 90.0, hits_path: str | None = None) -> Path:
    """Report how much of the test half is, by similarity, among the training half; returns the folder written.

    The hits come from the similarity join, or from a given hit table, which must name the sequences ``seq_<n>_test`` and
    ``seq_<n>_train``, n counting from 0 in the order of the input.
    """
    check_report_types(report_types, SPLIT_REPORTS)
    if not 0 <= similarity_threshold <= 100:
        raise ValueError("similarity_threshold must be between 0 and 100")
    columns = sequence_columns or ["sequence"]
    since = marked(spark)
    test, train = (split_half(spark, p, columns, h).persist() for p, h in ((test_input, "test"), (train_input, "train")))
    hits = None
    try:
        n_test, n_train = test.count(), train.count()
        hits = read_hits(spark, hits_path) if hits_path else similarity.similarity_join(test, train, leak=similarity_threshold)
        hits = leakage.known_hits(hits, n_test, n_train, hits_path or "similarity join")
        stats = leakage.threshold_stats(hits, n_test, n_train, similarity_threshold).persist()
        fasta_only = tables.infer_format(test_input) == "fasta"
        column = naming.NO_COLUMN if fasta_only else naming.MERGED if len(columns) > 1 else naming.slug(columns[0])
        folder = naming.comparison_folder(out_folder, "split", column)
        folder.mkdir(parents=True, exist_ok=True)
        if "simple" in report_types:
            check = leakage.split_check(stats)
            _write_csv(folder / SIMPLE_FILE, check.columns, check.collect())
        if "html" in report_types:
            page = _split_page(hits, test, train, stats, similarity_threshold)
            leakage.export(hits, str(folder / HITS_FILE), similarity_threshold)
            leaked = leakage.leaked_hits(hits, similarity_threshold)
            for side, rows, name in (("query", test, TEST_FASTA), ("target", train, TRAIN_FASTA)):
                own = fasta.select_records(rows, leaked.select(F.col(side).alias("id")))
                fasta.write_fasta(own.orderBy("no"), str(folder / name))
            (folder / HTML_FILE).write_text(page, encoding="utf-8")
        return folder
    finally:
        for held in filter(None, (hits, test, train)):
            held.unpersist()
        forget(spark, since)


def _split_page(hits: DataFrame, test: DataFrame, train: DataFrame, stats: DataFrame, threshold: float) -> str:
    row = stats.first().asDict()
    bins = {side: dict(leakage.histogram(hits, half, side).collect()) for side, half in (("query", test), ("target", train))}
    # At most LISTED rows; their sequences are looked up by a join on them.
    listed = leakage.listing(hits, threshold)
    texts = listed.join(test.select(F.col("id").alias("query"), F.col("seq").alias("q")), "query", "left").join(train.select(F.col("id").alias("target"), F.col("seq").alias("t")), "target", "left")
    shown = sorted(texts.collect(), key=lambda r: (-r["similarity"], r["query_no"], r["target_no"], r["qstart"], r["qend"], r["tstart"], r["tend"]))
    if lost := [f"{r['query']} {r['target']}" for r in shown if r["q"] is None or r["t"] is None]:
        raise ValueError(f"{len(lost)} hits have no sequence, such as {lost[0]}")
    blocks = []
    for r in shown:
        html.checked_alignment(r.asDict(), r["q"], r["t"])
        blocks.append(f"<h3>{html.escaped(r['query'])} and {html.escaped(r['target'])}: {r['similarity']:.1f}</h3><pre>{html.escaped(html.alignment(r.asDict()))}</pre>")
    sections = [("Leakage", html.table(["", ""], [[k, v] for k, v in row.items()]))]
    for side, title in (("query", "Best similarity of test sequences"), ("target", "Best similarity of training sequences")):
        sections.append((title, html.bars([(f"{10 * b}-{10 * b + 10}", bins[side].get(b, 0)) for b in range(10)])))
    sections.append((f"Leaked hits (at most {leakage.LISTED})", "".join(blocks) or "<p>none</p>"))
    return html.page("Leakage of test sequences into training", sections)
