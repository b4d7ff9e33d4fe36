"""Class checks against brute force, on hand-made and seeded random inputs."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from helixaudit.operators import duplicates, features, metrics, positions
from helixaudit.plans import class_report


def frame(spark, rows):
    return spark.createDataFrame(rows, "label string, seq string")


def brute(pos, neg):
    """AU-ROC, average precision and best accuracy by their definitions, direction ignored."""
    u = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    if u < 0.5:
        pos, neg, u = [-x for x in pos], [-x for x in neg], 1 - u
    cuts = sorted(set(pos) | set(neg), reverse=True)
    ap, before, best = 0.0, 0.0, len(neg)
    for c in cuts:
        tp, fp = sum(x >= c for x in pos), sum(x >= c for x in neg)
        ap += (tp / len(pos) - before) * tp / (tp + fp)
        before = tp / len(pos)
        best = max(best, tp + len(neg) - fp)
    return u, ap, best / (len(pos) + len(neg))


def test_tie_groups_match_definitions(spark):
    rng = random.Random(1)
    cases = {f"c{i}": ([rng.randrange(k) for _ in range(rng.randint(1, 30))], [rng.randrange(k) for _ in range(rng.randint(1, 30))]) for i, k in enumerate((1, 2, 3, 5, 9, 40) * 6)}
    rows = [(name, float(v), pos.count(v), neg.count(v)) for name, (pos, neg) in cases.items() for v in set(pos) | set(neg)]
    got = {r["k"]: (r["auroc"], r["aupr"], r["accuracy"]) for r in metrics.tie_group_metrics(spark.createDataFrame(rows, "k string, value double, a bigint, b bigint"), ["k"]).collect()}
    for name, (pos, neg) in cases.items():
        assert got[name] == pytest.approx(brute(pos, neg), abs=1e-12), name


def test_two_by_two_matches_definitions(spark):
    rows = [(m1, c1, m2, c2) for c1, c2 in product(range(1, 6), repeat=2) for m1 in range(c1 + 1) for m2 in range(c2 + 1)]
    df = spark.createDataFrame(rows, "m1 int, c1 int, m2 int, c2 int")
    cols = metrics.two_by_two(*(F.col(c) for c in ("m1", "c1", "m2", "c2")))
    for r in df.select("*", *[c.alias(n) for c, n in zip(cols, ("x", "y", "z"))]).collect():
        pos, neg = ([1] * r[m] + [0] * (r[c] - r[m]) for m, c in (("m1", "c1"), ("m2", "c2")))
        assert (r["x"], r["y"], r["z"]) == pytest.approx(brute(pos, neg), abs=1e-12)


def test_composition_of_small_sequences(spark):
    s = frame(spark, [("x", "ACGT"), ("x", "AC"), ("x", "AAAA"), ("x", ""), ("x", "a.+\\E"), ("x", "äöää")])
    base, pair = (next(f for f in features.FEATURES if f.check == c) for c in (features.NUCLEOTIDES, features.DINUCLEOTIDES))
    got = sorted((r["feature"], round(r["value"], 6)) for r in base.values(s).collect())
    want = sorted((c, round(t.count(c) / len(t), 6)) for t in ("ACGT", "AC", "AAAA", "a.+\\E", "äöää") for c in set(t))
    assert got == want
    got = sorted((r["feature"], round(r["value"], 6)) for r in pair.values(s).collect())
    two = lambda t: [t[i : i + 2] for i in range(len(t) - 1)]
    assert got == sorted((p, round(two(t).count(p) / (len(t) - 1), 6)) for t in ("ACGT", "AC", "AAAA", "a.+\\E", "äöää") for p in set(two(t)))


def random_classes(rng, sizes, lengths=(0, 12), letters="ACGT"):
    return [(label, "".join(rng.choice(letters if i % 2 else "ACG") for _ in range(rng.randint(*lengths)))) for label, n in sizes.items() for i in range(n)]


def test_features_of_all_pairs_match_brute_force(spark):
    rng = random.Random(2)
    rows = random_classes(rng, {"b": 40, "a": 30, "c": 25}) + [("c", "TTN")]
    by = {k: [t for label, t in rows if label == k] for k in "abc"}
    two = lambda t: [t[i : i + 2] for i in range(len(t) - 1)]
    got = {(r["label_1"], r["label_2"], r["check"], r["feature"]): (r["auroc"], r["aupr"], r["accuracy"]) for r in metrics.feature_metrics(frame(spark, rows), floor=0).collect()}
    want = {}
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        put = lambda check, feature, f: want.__setitem__((x, y, check, feature), brute([f(t) for t in by[x]], [f(t) for t in by[y]]))  # noqa: B023, E731
        put(features.LENGTHS, "", len)
        put(features.GC, "", lambda t: 100 * sum(c in "GC" for c in t) / len(t) if t else 0)
        alphabets = [set("".join(by[k])) for k in (x, y)]
        for c in alphabets[0] | alphabets[1]:
            put(features.NUCLEOTIDES, c, lambda t: t.count(c) / len(t) if t else 0)  # noqa: B023
        for p in {a + b for alphabet in alphabets for a in alphabet for b in alphabet}:
            put(features.DINUCLEOTIDES, p, lambda t: two(t).count(p) / (len(t) - 1) if len(t) > 1 else 0)  # noqa: B023
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-9), key


def test_floor_makes_metrics_unknown(spark):
    rows = random_classes(random.Random(3), {"a": 250, "b": 249, "c": 250}, (3, 6))
    flags = {(r["label_1"], r["label_2"]): (r["flag"], r["auroc"]) for r in metrics.feature_metrics(frame(spark, rows), features.FEATURES[:1]).collect()}
    assert flags["a", "b"] == flags["b", "c"] == ("Unknown", None) and flags["a", "c"][0] != "Unknown"


def test_flag_edges(spark):
    rows = spark.createDataFrame([(0.6,), (0.6000001,), (0.7,), (0.7000001,), (None,)], "x double")
    assert [r[0] for r in rows.select(metrics.flag(F.col("x"))).collect()] == ["Pass", "Warning", "Warning", "Fail", "Unknown"]


def test_positions_match_brute_force(spark):
    rng = random.Random(4)
    rows = random_classes(rng, {"a": 80, "b": 70}, (0, 9), "ACGTN")
    by = {k: [t for label, t in rows if label == k] for k in "ab"}
    for reverse in (False, True):
        got = {(r["base"], r["pos"]): (r["auroc"], r["aupr"], r["accuracy"]) for r in positions.position_metrics(frame(spark, rows), reverse, min_coverage=0.25, floor=20).collect()}
        ends = {}
        for k, texts in by.items():
            lengths = sorted(map(len, texts), reverse=True)
            required = max(20, -(-len(texts) // 4))
            ends[k] = (max(lengths[49], lengths[required - 1]), lengths[required - 1])
        end, scored = (min(ends[k][i] for k in "ab") for i in (0, 1))
        want = {}
        for base, pos in product(set("".join(by["a"] + by["b"])), range(1, end + 1)):
            cohort = {k: [(t[::-1] if reverse else t)[pos - 1] == base for t in by[k] if len(t) >= pos] for k in "ab"}
            ok = pos <= scored and min(map(len, cohort.values())) >= 20
            want[base, pos] = brute(*([int(x) for x in cohort[k]] for k in "ab")) if ok else (None,) * 3
        assert got.keys() == want.keys()
        for key in want:
            assert got[key] == (want[key] if want[key][0] is None else pytest.approx(want[key], abs=1e-9)), key


def test_windows_of_small_and_cut_classes(spark):
    lengths = positions.length_counts(frame(spark, [("few", "A" * n) for n in (3, 9, 4)] + [("many", "A" * (n % 20)) for n in range(400)] + [("void", "")]))
    got = {r["label"]: tuple(r)[1:] for r in positions.windows(lengths).collect()}
    assert got["few"] == (3, 9, 0) and got["void"] == (1, 0, 0)
    assert got["many"] == (400, 17, 7)
    assert {r["label"]: tuple(r)[2:] for r in positions.windows(lengths, end_position=5).collect()} == {"few": (5, 0), "many": (5, 5), "void": (0, 0)}
    assert {r["label"]: r["end_position"] for r in positions.windows(lengths, end_position=99).collect()}["many"] == 19
    reach = {(r["label"], r["pos"]): r["cohort"] for r in positions.cohorts(lengths).collect()}
    assert reach["few", 3] == 3 and reach["few", 4] == 2 and reach["few", 9] == 1 and ("few", 10) not in reach


def test_duplicates_and_alphabets(spark):
    rows = [("a", "ACGT")] * 3 + [("a", "")] * 2 + [("b", "ACGT"), ("b", ""), ("b", "GG")] + [("c", "GGN")] * 60
    s = frame(spark, rows)
    assert {(r["label"], r["seq"]): r["extra"] for r in duplicates.levels(s).collect()} == {("a", "ACGT"): 2, ("a", ""): 1, ("c", "GGN"): 59}
    assert {(r["label_1"], r["label_2"], r["seq"]) for r in duplicates.shared(s).collect()} == {("a", "b", "ACGT"), ("a", "b", "")}
    between = {(r["label_1"], r["label_2"]): (r["shared"], r["flag"]) for r in duplicates.between_check(s).collect()}
    assert between == {("a", "b"): (2, "Fail"), ("a", "c"): (0, "Pass"), ("b", "c"): (0, "Pass")}
    within = {(r["label_1"], r["label_2"]): (round(r["remaining"], 6), r["flag"]) for r in duplicates.within_check(s).collect()}
    assert within["a", "b"] == (0.625, "Fail")
    bins = {(r["label_1"], r["label_2"], r["label"], r["bin"]): r["extra"] for r in duplicates.bins(s).collect()}
    assert bins["a", "c", "c", ">50"] == 59 and bins["a", "b", "a", "2"] == 2
    flags = {(r["label_1"], r["label_2"]): r["flag"] for r in duplicates.alphabet_check(s, features.alphabets(s)).collect()}
    assert flags == {("a", "b"): "Pass", ("a", "c"): "Fail", ("b", "c"): "Fail"}


def test_report_order_and_user_feature(spark):
    rng = random.Random(5)
    rows = [("plain", "".join(rng.choice("ACGT") for _ in range(40))) for _ in range(300)] + [("rich", "CG" * 6 + "".join(rng.choice("ACGT") for _ in range(28))) for _ in range(300)]
    extra = features.scalar_feature("CpG count", F.regexp_count(F.col("seq"), F.lit("CG")))
    report = class_report.class_report(frame(spark, rows), features=(*features.FEATURES, extra), order={"rich": 0, "plain": 1}).orderBy("row").collect()
    assert {(r["label_1"], r["label_2"]) for r in report} == {("rich", "plain")}
    assert [r["row"] for r in report] == list(range(1, len(report) + 1))
    heads = [r["check"] for r in report if r["headline"]]
    assert heads == [*features.CHECKS[:7], "CpG count", *features.CHECKS[7:]] and heads == [r["check"] for r in report[: len(heads)]]
    assert next(r["flag"] for r in report if r["check"] == "CpG count") == "Fail"
    names = [r["check"] for r in report]
    start = names.index(f"{features.FORWARD} - A position 1")
    assert names[start : start + 41] == [f"{features.FORWARD} - A position {i}" for i in range(1, 41)] + [f"{features.FORWARD} - A"]
    worst = max(r["auroc"] for r in report if r["check"].startswith(f"{features.FORWARD} - ") and r["auroc"] is not None)
    assert next(r["auroc"] for r in report if r["check"] == features.FORWARD) == worst
    assert sum(r["checks"] for r in class_report.verdict(class_report.class_report(frame(spark, rows))).collect()) == 9


def test_empty_input_gives_empty_report(spark):
    assert class_report.class_report(frame(spark, [])).count() == 0
    assert class_report.class_report(frame(spark, [("only", "ACGT")])).count() == 0
    two = class_report.class_report(frame(spark, [("a", ""), ("b", "")])).collect()
    assert {r["check"] for r in two if r["headline"]} == {features.BASES, features.WITHIN, features.BETWEEN, features.LENGTHS, features.GC}


def test_distribution_of_values(spark):
    from helixaudit.operators import distribution

    rows = [("a", "A" * n + "C" * (n % 3)) for n in range(1, 20)] + [("b", "GG"), ("b", "")]
    s = frame(spark, rows)
    sizes = s.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    filled = distribution.with_zeros(features.histograms(s), features.alphabets(s), sizes).cache()
    assert {(r["label"], r["n"]) for r in filled.groupBy("label", "check", "feature").agg(F.sum("n").alias("n")).collect()} == {("a", 19), ("b", 2)}
    got = {(r["label"], r["check"], r["feature"]): r for r in distribution.letter_values(filled, 2).collect()}
    share = sorted((n % 3) / (n + n % 3) for n in range(1, 20))
    own = got["a", features.NUCLEOTIDES, "C"]
    assert own["letters"][0] == pytest.approx(share[9]) and (own["low"], own["high"]) == pytest.approx((share[0], share[-1]))
    assert got["b", features.LENGTHS, ""]["letters"] == [1.0, 0.5, 1.5]
    cells = distribution.grid(filled, 4).where(F.col("check") == features.LENGTHS).groupBy("label").agg(F.sum("n").alias("n"), F.max("cell").alias("top")).collect()
    assert {(r["label"], r["n"], r["top"]) for r in cells} == {("a", 19, 3), ("b", 2, 0)}
