"""Readers, raw rows with rejects, hits, names, and the two commands end to end."""

import csv
import gzip
import json
import random
import re
from collections import Counter
from decimal import Decimal

import pyarrow as pa
import pytest

from helixaudit import cli
from helixaudit.functions import naming
from helixaudit.operators import leakage, similarity
from helixaudit.plans import html, runs
from helixaudit.sources import fasta, raw_rows, tables
from helixaudit.sources.hits import HIT_SCHEMA, complete_hits


def reason(line):
    """The rules for raw rows as a state machine over characters."""
    line = (line or "")[:-1] if (line or "").endswith("\r") else line or ""
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            end = i + 1
            while True:
                end = line.find('"', end)
                if end < 0:
                    return "broken_quoting"
                if line[end + 1 : end + 2] != '"':
                    break
                end += 2
            if line[end + 1 : end + 2] not in ("", ","):
                return "broken_quoting"
            fields.append(line[i + 1 : end].replace('""', '"'))
            i = end + 1
        else:
            end = line.find(",", i)
            end = len(line) if end < 0 else end
            if '"' in line[i:end]:
                return "broken_quoting"
            fields.append(line[i:end])
            i = end
        if i >= len(line):
            break
        i += 1
    if len(fields) != 4:
        return "column_count"
    number = re.fullmatch(r"(?=.*[0-9])[0-9]*\.?[0-9]*", fields[3])
    if not re.fullmatch("[ACGTNacgtn]+", fields[0]) or fields[1] not in ("0", "1") or fields[3] and not (number and Decimal("0" + fields[3].rstrip(".")) <= 1):
        return "invalid_value"
    return None


def test_raw_rows_match_a_state_machine(spark):
    rng = random.Random(1)
    lines = ["".join(rng.choice('"",,AC1\r\n0.x\\é') for _ in range(rng.randint(0, 14))) for _ in range(20000)]
    lines += [f'{rng.choice(("ACGT", "acgn", "", "ACX"))},{rng.choice("012")},"a""b{rng.choice(("", ",", "x", chr(34), chr(10)))}",{s}{rng.choice(("", chr(13)))}' for s in ("", "0", "1", "1.0", "1.000000000000000000001", ".", ".5", "1.", "1e0", "+1", "01", "2", "٣", " 1") for _ in range(40)]
    lines += [None, "", "\r", '"' * 7, "A" * 200_000 + ",1,s,0.5"]
    df = spark.createDataFrame([(i, "f", t, "x") for i, t in enumerate(lines)], "line_no bigint, file_name string, line string, reason string")
    got = {r["line_no"]: r for r in raw_rows.parse_rows(df).collect()}
    assert len(got) == len(lines)
    wrong = [(t, got[i]["reason"]) for i, t in enumerate(lines) if got[i]["reason"] != reason(t)]
    assert not wrong
    valid = raw_rows.valid_rows(df).collect()
    assert {r["line_no"] for r in valid} == {i for i, t in enumerate(lines) if reason(t) is None}
    assert all(r["sequence"] == r["sequence"].upper() for r in valid)
    assert raw_rows.rejected_rows(df).count() + len(valid) == len(lines)
    assert raw_rows.parse_rows(df.limit(0)).count() == 0


def test_quoted_values_are_unquoted(spark):
    df = spark.createDataFrame([(1, "f", '"acgt","1","say ""hi"", twice\nline","0.25"\r'), (2, "f", "ACGT,0,,")], "line_no bigint, file_name string, line string")
    one, two = sorted(raw_rows.valid_rows(df).collect())
    assert tuple(one) == (1, "f", "ACGT", "1", 'say "hi", twice\nline', 0.25) and tuple(two) == (2, "f", "ACGT", "0", "", None)


def test_tables_and_missing_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sequence,label,more\nacgt,0,x\n,1,x\nNA,1,x\nGG,NA,x\nTT,,x\n\"A\nC\",b,x\n")
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("sequence,label,more\nnan,1,y\n")
    df = tables.read_table(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv.gz")])
    got = sorted(map(tuple, tables.labelled(df, ["sequence"], "label").collect()))
    assert got == [("0", "ACGT"), ("1", ""), ("1", ""), ("1", ""), ("b", "A\nC")]
    with pytest.raises(ValueError, match="'seq'.*sequence column.*available: sequence, label, more"):
        tables.labelled(df, ["seq"], "label")
    assert tables.resolve_labels(tables.labelled(df, ["sequence"], "label")) == ["0", "1", "b"]
    with pytest.raises(ValueError, match="no rows with label 7"):
        tables.resolve_labels(tables.labelled(df, ["sequence"], "label"), ["0", "7"])
    assert tables.infer_format(["x.FA.gz", "y.fasta"]) == "fasta"
    for bad in (["x.fa", "y.csv"], ["x.txt"], []):
        with pytest.raises(ValueError):
            tables.infer_format(bad)


def test_many_labels_need_names(spark):
    s = spark.createDataFrame([(f"l{i}", "A") for i in range(51)], "label string, seq string")
    with pytest.raises(ValueError, match="more than 50"):
        tables.resolve_labels(s)
    with pytest.raises(ValueError, match="no labelled rows"):
        tables.resolve_labels(s.limit(0))


def test_median_split(spark):
    df = spark.createDataFrame([("AC", "1"), ("GT", "2"), ("TT", "3"), ("GG", "10"), ("A", "1.0d"), ("C", "nan"), ("G", None), ("T", "x")], "sequence string, target string")
    got = sorted((r["label"], r["seq"]) for r in tables.median_split(df, ["sequence"], "target").collect())
    assert got == [("high", "GG"), ("high", "TT"), ("low", "AC"), ("low", "GT")]
    with pytest.raises(ValueError, match="nothing to compare"):
        tables.median_split(df.where("target = '1'"), ["sequence"], "target")
    with pytest.raises(ValueError, match="no number"):
        tables.median_split(df.where("target = 'x'"), ["sequence"], "target")


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">one first\nacg\nt\n\n>two\r\nGG\r\n>three\n")
    with gzip.open(tmp_path / "y.fa.gz", "wt") as f:
        f.write(">four\nTT\nTT")
    rows = fasta.read_fasta(spark, [str(tmp_path / "x.fa"), str(tmp_path / "y.fa.gz")])
    assert {(r["id"], r["seq"]) for r in rows.collect()} == {("one", "ACGT"), ("two", "GG"), ("three", ""), ("four", "TTTT")}
    assert {r["id"] for r in fasta.select_records(rows, spark.createDataFrame([("two",), ("two",), ("nine",)], "id string")).collect()} == {"two"}
    numbered = fasta.staged(rows, "test", ["id"]).collect()
    assert [(r["no"], r["id"], r["seq"]) for r in sorted(numbered)] == [(0, "seq_0_test", "TTTT"), (1, "seq_1_test", "ACGT"), (2, "seq_2_test", ""), (3, "seq_3_test", "GG")]
    fasta.write_fasta(rows, str(tmp_path / "out"))
    assert {(r["id"], r["seq"]) for r in fasta.read_fasta(spark, str(tmp_path / "out")).collect()} == {(r["id"], r["seq"]) for r in rows.collect()}
    assert tuple(fasta.length_summary(rows).first()) == (4, 0, 2.5, 4) and tuple(fasta.length_summary(rows.limit(0)).first())[0] == 0


def test_names():
    assert [naming.slug(x) for x in ("5' UTR", "  ", "CON", "a--b", "Ä", "x" * 90)] == ["5-utr", "unnamed", "unnamed", "a-b", "unnamed", "x" * 80]
    assert naming.unique_slugs(["A", "a", "b"]) == ["a", "a-2", "b"]
    assert naming.unique_slugs(["pos", "pos", "test-pos"], ["train", "test", "x"]) == ["train-pos", "test-pos-2", "test-pos"]
    assert naming.column_folders(["gene", "merged"]) == ["gene", "merged", "merged-2"]
    assert [naming.stem(p) for p in ("d/hg38.chr1.fa.gz", "x.tsv", "y.txt")] == ["hg38.chr1", "x", "y.txt"]


HIT = dict(query="seq_0_test", target="seq_0_train", qcov=1.0, tcov=1.0, pident=95.0, evalue=0.1, qstart=1, qend=4, tstart=1, tend=4, alnlen=4, qaln="ACGT", taln="ACGT")


def hits(spark, *rows):
    return spark.createDataFrame([tuple((HIT | r)[f.name] for f in HIT_SCHEMA) for r in rows], HIT_SCHEMA)


def test_hits_and_leaks(spark):
    table = hits(spark, {}, dict(query="seq_1_test", target="seq_1_train", tcov=0.5), dict(query="seq_2_test", target="seq_2_train", pident=89.9), dict(query=" SEQ_3_test", pident=90.0, qstart=4, qend=1), dict(evalue=None), dict(pident=float("nan")))
    assert complete_hits(table).count() == 4
    row = leakage.threshold_stats(table, 200, 0).first()
    assert (row["queries_leaked"], row["queries_hit"], row["targets_leaked"], row["targets_hit"], row["hits_reversed"], row["leaked_reversed"]) == (2, 4, 1, 3, 1, 1)
    assert (row["queries_leaked_percent"], row["targets_leaked_percent"], row["queries_without_hits"], row["flag"]) == (1.0, 0.0, 196, "Warning")
    assert leakage.threshold_stats(table, 100, 100).first()["flag"] == "Fail"
    assert leakage.threshold_stats(hits(spark), 100, 100).first()["flag"] == "Pass"
    assert tuple(leakage.split_check(leakage.threshold_stats(table, 200, 300)).first()) == ("Data Leakage", "Warning", "1.00%", "0.33%")
    assert [r["query"] for r in leakage.listing(table).collect()] == ["seq_0_test", "seq_3_test"]
    ids = spark.createDataFrame([(f"seq_{i}_test",) for i in range(6)], "id string")
    assert {r["bin"]: r["sequences"] for r in leakage.histogram(table, ids).collect()} == {0: 2, 4: 1, 8: 1, 9: 2}
    with pytest.raises(Exception, match="unknown sequence"):
        leakage.checked_ids(leakage.with_similarity(table), 2, 9).count()


def test_listing_does_not_depend_on_arrival(spark):
    rows = [dict(query=f"seq_{i % 7}_test", target=f"seq_{i}_train", pident=float(90 + i % 3)) for i in range(130)]
    random.Random(1).shuffle(rows)
    want = sorted(((-r["pident"], int(r["query"][4]), int(r["target"].split("_")[1])) for r in rows))[:100]
    got = [(-r["similarity"], r["query_no"], r["target_no"]) for r in leakage.listing(hits(spark, *rows).repartition(5)).collect()]
    assert got == want


def test_similarity_join_recall(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    train = [text(rng.randint(60, 200)) for _ in range(40)]
    test = [t[:30] + rng.choice("ACGT") + t[31:] for t in train[:10]] + [t[:40] + t[42:] for t in train[10:15]] + train[15:18] + [text(100) for _ in range(10)] + ["", train[20][:20]]
    pair = lambda rows: spark.createDataFrame(list(enumerate(rows)), "no bigint, seq string")
    rows = similarity.similarity_join(pair(test), pair(train)).collect()
    for r in rows:
        q, t = test[int(r["query"].split("_")[1])], train[int(r["target"].split("_")[1])]
        html.checked_alignment(r.asDict(), q, t)
        assert r["alnlen"] == len(r["qaln"]) == len(r["taln"]) and 0 < r["qcov"] <= 1 and r["evalue"] is not None
    leaked = {r["query"]: r["target"] for r in leakage.leaked_hits(similarity.similarity_join(pair(test), pair(train))).collect()}
    assert {f"seq_{i}_test": f"seq_{i}_train" for i in range(18)} == leaked
    only = similarity.similarity_join(pair(test), pair(train), leaks_only=90.0)
    assert {r["query"] for r in leakage.leaked_hits(only).collect()} == set(leaked)


def best_score(a, b):
    """Score of the best local alignment, cell by cell."""
    before, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(max(0, before[j - 1] + (similarity.MATCH if x == y else similarity.MISMATCH), before[j] + similarity.GAP, row[-1] + similarity.GAP))
        best, before = max(best, max(row)), row
    return best


def test_alignment_is_the_best_of_the_whole_texts():
    rng = random.Random(21)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    pairs = [(text(rng.randint(1, 60)), text(rng.randint(1, 60))) for _ in range(40)]
    for n, cut in ((400, 25), (400, 30), (600, 45), (800, 60)):
        a = text(n)
        pairs += [(a, a[: n // 2] + a[n // 2 + cut :]), (a[: n // 3] + text(cut) + a[n // 3 :], a)]
    pairs += [("ÄC" * 9, "C" + "ÄC" * 8), ("A" * 30, "A" * 20)]
    want = [best_score(a, b) for a, b in pairs]
    # All rows held, and computed again from some of them.
    for cells in (similarity.CELLS, 0):
        for chosen in similarity.blocks(pairs, similarity.CELLS // 8):
            for k, (score, a0, a1, b0, b1, top, low) in zip(chosen, similarity.align([pairs[k] for k in chosen], cells)):
                a, b = pairs[k]
                assert score == want[k]
                assert (top.replace("-", ""), low.replace("-", "")) == (a[a0:a1], b[b0:b1]) and len(top) == len(low)
                assert score == sum(similarity.GAP if "-" in (x, y) else similarity.MATCH if x == y else similarity.MISMATCH for x, y in zip(top, low))


def test_similarity_join_finds_leaks_with_long_gaps(spark):
    rng = random.Random(22)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    train = [text(n) for n in (400, 400, 500, 600, 800, 800)]
    cuts = (30, 25, 40, 45, 60, 60)
    test = [t[: len(t) // 2] + t[len(t) // 2 + c :] for t, c in zip(train[:5], cuts)] + [train[5][:300] + text(60) + train[5][300:]]
    pair = lambda rows: spark.createDataFrame(list(enumerate(rows)), "no bigint, seq string")
    rows = {r["query"]: r for r in leakage.leaked_hits(similarity.similarity_join(pair(test), pair(train))).collect()}
    assert {q: r["target"] for q, r in rows.items()} == {f"seq_{i}_test": f"seq_{i}_train" for i in range(6)}
    assert round(rows["seq_0_test"]["similarity"], 1) == 92.5


@pytest.mark.parametrize("least", [90.0, 80.0])
def test_similarity_join_misses_no_leak_on_short_sequences(spark, least):
    """Against the alignment of every pair: random errors of all kinds up to the threshold, most without two common seeds."""
    rng = random.Random(23)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    train = [text(n) for n in (1, 2, 4, 8, 9, 13, 14, 15, 16, 19, 20, 28, 31, 39, 40, 40, 47, 60, 75, 90, 100, 120, 128) for _ in range(4)]
    test = []
    for t in train:
        s, errors = list(t), int(len(t) * (1 - least / 100))
        evenly = rng.random() < 0.5
        for e in range(rng.randint(0, 1) if errors == 0 else errors):
            at = min(len(s) - 1, (e + 1) * len(s) // (errors + 1) if evenly else rng.randrange(len(s)))
            kind = rng.random()
            if kind < 0.8 or len(s) < 2:
                s[at] = rng.choice("ACGT")
            elif kind < 0.9:
                s.insert(at, rng.choice("ACGT"))
            else:
                del s[at]
        test.append("".join(s))
    want, every = set(), [(i, j) for i in range(len(test)) for j in range(len(train)) if least / 100 <= len(test[i]) / len(train[j]) <= 100 / least]
    for (i, j), (_, a0, a1, b0, b1, top, low) in zip(every, similarity.align([(test[i], train[j]) for i, j in every])):
        if top and min((a1 - a0) / len(test[i]), (b1 - b0) / len(train[j])) * (100.0 * sum(x == y for x, y in zip(top, low)) / len(top)) >= least:
            want.add((f"seq_{i}_test", f"seq_{j}_train"))
    pair = lambda rows: spark.createDataFrame(list(enumerate(rows)), "no bigint, seq string").repartition(3)
    got = [tuple(r) for r in leakage.leaked_hits(similarity.similarity_join(pair(test), pair(train), leak=least), least).select("query", "target").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60
    seeds = lambda s: {s[i : i + similarity.SEED] for i in range(len(s) - similarity.SEED + 1)}
    assert sum(len(seeds(test[int(q.split("_")[1])]) & seeds(train[int(t.split("_")[1])])) < 2 for q, t in want) > 10


def test_similarity_join_in_blocks_shuffles_texts_only(spark, monkeypatch):
    """Several blocks on either side, copies in several rows, repeated records, a number with two texts; pairs by brute force."""
    monkeypatch.setattr(similarity, "BLOCK_LETTERS", 1500)
    monkeypatch.setattr(similarity, "CARRIED", 3)
    rng = random.Random(24)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    base = [text(rng.randint(130, 200)) for _ in range(25)]
    test = [(i, t[:60] + text(70)) for i, t in enumerate(base)] + [(30 + i, "ACGTTGCA" * 18) for i in range(7)] + [(0, base[1]), (0, base[1])]
    train = list(enumerate(base)) + [(40 + i, "ACGTTGCA" * 17) for i in range(4)] + [(2, base[2])]
    parts = lambda t: Counter(t[i : i + similarity.SEED] for i in range(len(t) - similarity.SEED + 1))
    common = lambda a, b: sum(n * parts(b)[x] for x, n in parts(a).items())
    want = sorted((f"seq_{i}_test", f"seq_{j}_train") for i, q in set(test) for j, t in set(train) if common(q, t) > 1)
    frame = lambda rows: spark.createDataFrame(rows, "no bigint, seq string").repartition(3)
    found = similarity.similarity_join(frame(test), frame(train))
    assert sorted((r["query"], r["target"]) for r in found.collect()) == want and len(want) > 50
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_pairs_of_a_block_agree_with_all_windows(monkeypatch):
    from helixaudit.operators import candidates

    rng = random.Random(25)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    shared = [text(30) for _ in range(6)] + ["A" * 40, "AC" * 25, "Ä" + "CA" * 12, "ACGTACGTACGTACG"]
    made = lambda: [text(rng.randint(0, 60)) + rng.choice(shared)[rng.randint(0, 9) :] + text(rng.randint(0, 60)) for _ in range(50)] + ["A", "ACGT", "A" * 14, "A" * 15, *shared]
    test, train = made(), made()
    parts = lambda t: Counter(t[i : i + 14] for i in range(len(t) - 13))
    want = sorted(j * len(test) + i for i, q in enumerate(test) for j, t in enumerate(train) if sum(n * parts(t)[x] for x, n in parts(q).items()) > 1)
    for most in (candidates.MATCHES, 20):
        monkeypatch.setattr(candidates, "MATCHES", most)
        block, texts = candidates.Block(pa.array(test), 14), candidates.Texts(pa.array(train))
        assert block.seeded(texts, 0, 30).tolist() + block.seeded(texts, 30, len(train)).tolist() == want
        # One text at a time, in slices of few places.
        assert [k for n in range(len(train)) for k in block.seeded(texts, n, n + 1).tolist()] == want


def test_alignments_beyond_a_byte_and_with_many_letters():
    rng = random.Random(26)
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    pairs = []
    for letters in ("ACGT", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(map(chr, range(0x100, 0x150)))):
        for n in (40, 61, 62, 63, 64, 65, 90, 150):
            a = text(n, letters)
            pairs += [(a, a), (a, a[: n // 2] + text(1, letters) + a[n // 2 :]), (a, text(n, letters))]
    for chosen in (range(24), range(48), range(72)):
        own = [pairs[k] for k in chosen]
        assert [r[0] for r in similarity.align(own)] == [best_score(*p) for p in own]
        # Together or apart, the alignments are the same.
        assert similarity.align(own) == [similarity.align([p], cells)[0] for p, cells in zip(own, [similarity.CELLS, 0] * 36)]


def test_alignment_text():
    hit = HIT | dict(qaln="AC-GT", taln="ACTGA", qstart=3, tstart=1, qend=6, tend=5)
    assert html.midline("AC-GT", "ACTGA") == "|| |."
    assert html.alignment(hit, 3).splitlines()[0].split() == ["query", "3", "AC-"]
    with pytest.raises(ValueError):
        html.checked_alignment(HIT | dict(qaln="ACGG"), "ACGT", "ACGT")
    assert html.escaped("<{x}>") == "&lt;&#123;x&#125;&gt;" and json.loads(html.payload({"a": "</script>&"})) == {"a": "</script>&"}


def write_classes(tmp_path, n=260):
    rng = random.Random(9)
    rows = [("".join(rng.choice("ACGT") for _ in range(20)), "x") for _ in range(n)] + [("".join(rng.choice("AACGT") for _ in range(20)), "Y!") for _ in range(n)]
    path = tmp_path / "in.csv"
    with path.open("w", newline="") as f:
        csv.writer(f).writerows([("sequence", "label"), *rows, (rows[0][0], "Y!")])
    return path


def test_evaluate_classes_writes_reports(spark, tmp_path):
    path = write_classes(tmp_path)
    assert cli.main(["evaluate-classes", "--input", str(path), "--out-folder", str(tmp_path / "out"), "--report-types", "html", "simple", "json"], spark) == 0
    folder = tmp_path / "out/class/sequence/x_vs_y"
    with (folder / runs.SIMPLE_FILE).open() as f:
        rows = list(csv.reader(f))
    assert tuple(rows[0]) == runs.HEADER and len({r[0] for r in rows[1:]}) == len(rows) - 1
    flags = {r[0]: r[1] for r in rows}
    assert flags["Duplicate Sequences between Labels"] == "Fail" and flags["Sequence lengths"] == "Pass"
    assert len((folder / runs.DUPLICATES_FILE).read_text().splitlines()) == 1
    assert "Verdict" in (folder / runs.HTML_FILE).read_text()
    own = json.loads((tmp_path / "out/class/sequence/per-class/x.json").read_text())
    assert own["sequences"] == 260 and sum(own["lengths"].values()) == 260


def test_evaluate_classes_of_fasta_and_errors(spark, tmp_path):
    for name, text in (("a.fa", ">1\nAC\n>2\nGT\n"), ("b.fa", ">1\nAC\n")):
        (tmp_path / name).write_text(text)
    folders = runs.evaluate_classes(spark, [str(tmp_path / "a.fa"), str(tmp_path / "b.fa")], str(tmp_path / "o"), report_types=("simple",))
    assert [f.name for f in folders] == ["a_vs_b"]
    assert cli.main(["evaluate-classes", "--input", str(tmp_path / "a.fa")], spark) == 1
    with pytest.raises(ValueError, match="unknown report type"):
        runs.evaluate_classes(spark, ["nothing.csv"], report_types=("pdf",))


def test_evaluate_splits_writes_reports(spark, tmp_path):
    rng = random.Random(10)
    train = ["".join(rng.choice("ACGT") for _ in range(80)) for _ in range(30)]
    for name, rows in (("train.csv", train), ("test.csv", train[:2] + ["".join(rng.choice("ACGT") for _ in range(80)) for _ in range(20)])):
        (tmp_path / name).write_text("\n".join(["sequence", *rows]) + "\n")
    assert cli.main(["evaluate-splits", "--train-input", str(tmp_path / "train.csv"), "--test-input", str(tmp_path / "test.csv"), "--out-folder", str(tmp_path / "out")], spark) == 0
    folder = tmp_path / "out/split/sequence"
    rows = list(csv.reader((folder / runs.SIMPLE_FILE).open()))
    assert rows[1] == ["Data Leakage", "Fail", "9.09%", "6.67%"]
    assert "<h3>" in (folder / runs.HTML_FILE).read_text()
    exported = [p for p in (folder / runs.HITS_FILE).iterdir() if p.suffix == ".csv"]
    assert len(exported) == 1 and exported[0].read_text().startswith("query\ttarget")
    (tmp_path / "void.csv").write_text("sequence\n")
    assert cli.main(["evaluate-splits", "--train-input", str(tmp_path / "void.csv"), "--test-input", str(tmp_path / "test.csv")], spark) == 1


def test_splits_number_sequences_as_the_input_has_them(spark, tmp_path):
    """A hit table of an outside search, for unsorted files of several blocks and formats."""
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    train, test = [text(60) for _ in range(9)], [text(60) for _ in range(4)]
    (tmp_path / "b.csv").write_text("\n".join(["x,sequence", *(f"1,{t}" for t in train[:5])]) + "\n")
    (tmp_path / "a.csv").write_text("\n".join(["x,sequence", *(f'"2\n",{t}' for t in train[5:])]) + "\n")
    (tmp_path / "t.fa").write_text("".join(f">{9 - i}\n{t[:30]}\n{t[30:]}\n" for i, t in enumerate(test)))
    halves = runs.split_half(spark, [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")], ["sequence"], "train"), runs.split_half(spark, [str(tmp_path / "t.fa")], ["sequence"], "test")
    for half, want, name in zip(halves, (train, test), ("train", "test")):
        assert [tuple(r) for r in sorted(half.collect())] == [(i, f"seq_{i}_{name}", t) for i, t in enumerate(want)]
    table = tmp_path / "hits.tsv"
    columns = [f.name for f in HIT_SCHEMA]

    def write(*rows):
        table.write_text("\n".join("\t".join(map(str, r)) for r in [columns, *rows]) + "\n")

    row = lambda q, t: (f"seq_{q}_test", f"seq_{t}_train", 1.0, 1.0, 95.0, 0.1, 1, 4, 1, 4, 4, test[q % 4][:4], train[t % 9][:4])
    write(row(3, 7), row(1, 0))
    ask = ["evaluate-splits", "--train-input", str(tmp_path / "b.csv"), str(tmp_path / "a.csv"), "--test-input", str(tmp_path / "t.fa"), "--hits", str(table), "--out-folder", str(tmp_path / "out")]
    assert cli.main(ask, spark) == 0
    folder = tmp_path / "out/split/sequence"
    held = {r["id"]: r["seq"] for name in (runs.TEST_FASTA, runs.TRAIN_FASTA) for r in fasta.read_fasta(spark, str(folder / name)).collect()}
    assert held == {"seq_3_test": test[3], "seq_1_test": test[1], "seq_7_train": train[7], "seq_0_train": train[0]}
    # Numbers beyond the input and ids of another kind are errors, not hits less.
    for bad in (row(4, 0), row(0, 9), ("control", *row(1, 0)[1:])):
        write(row(3, 7), bad)
        assert cli.main(ask[:-1] + [str(tmp_path / "bad")], spark) == 1
    with pytest.raises(ValueError, match="unknown sequence: control seq_0_train"):
        leakage.known_hits(hits(spark, dict(query="control")), 9, 9)


def test_intermediate_tables(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from helixaudit import session

    before = session.marked(spark)
    held = session.write_once(spark.range(5), "five")
    path = Path(session._WRITTEN[-1][1].removeprefix("file://"))
    assert held.count() == 5 and path.exists()
    session.forget(spark, before)
    assert not path.exists() and session.marked(spark) == before

    class Far:
        class sparkContext:
            master = "spark://far:7077"
            getConf = staticmethod(lambda: {})

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Far)


def test_user_family_of_features(spark):
    from pyspark.sql import functions as F

    from helixaudit.operators import features
    from helixaudit.plans import class_report

    rows = [("plain", "ACGT" * 5)] * 260 + [("rich", "CGCG" * 5)] * 260
    family = features.column_features("Steps", {"CG": F.regexp_count(F.col("seq"), F.lit("CG")), "none": F.lit(None)})
    report = {r["check"]: r["flag"] for r in class_report.class_report(spark.createDataFrame(rows, "label string, seq string"), features=(*features.FEATURES, family)).collect()}
    assert report["Steps"] == report["Steps - CG"] == "Fail" and report["Steps - none"] == "Pass"


@pytest.mark.parametrize("kind", ["boxen", "violin"])
def test_class_page_draws_every_check(spark, tmp_path, kind):
    rows = [("ACGT" * 5, "x")] * 130 + [("AACG" * 5 + "T", "x")] * 130 + [("AAGG" * 5, "y<")] * 20
    with (tmp_path / "in.csv").open("w", newline="") as f:
        csv.writer(f).writerows([("sequence", "label"), *rows])
    (folder,) = runs.evaluate_classes(spark, [str(tmp_path / "in.csv")], str(tmp_path / "out"), report_types=("html",), plot_type=kind)
    page = (folder / runs.HTML_FILE).read_text()
    for check in ("Sequence lengths", "Per sequence dinucleotide content", "Per position reversed nucleotide content"):
        assert f"<title>{check}</title>" in page or f"</h2><p class=" in page and f">{check}</h2>" in page
    assert page.count("<polyline") >= 8 and page.count("<svg") >= 8
    # Twenty sequences are too few: the page says so.
    assert "checks were not scored" in page and "has 20 sequences" in page and "y&lt;" in page and "<script>y<" not in page
    with pytest.raises(ValueError, match="plot type"):
        runs.evaluate_classes(spark, [str(tmp_path / "in.csv")], plot_type="pie")


def test_class_json_has_frames_and_duplicates(spark, tmp_path):
    rows = [("ACGT", "x"), ("GG", "x"), ("ACGT", "x"), ("GG", "x"), ("GG", "x"), ("", "x"), ("AÄ", "y")]
    with (tmp_path / "in.csv").open("w", newline="") as f:
        csv.writer(f).writerows([("sequence", "label"), *rows])
    runs.evaluate_classes(spark, [str(tmp_path / "in.csv")], str(tmp_path / "out"), report_types=("json",))
    folder = tmp_path / "out/class/sequence/per-class"
    lines = lambda name: [json.loads(line) for part in sorted((folder / name).glob("part-*")) for line in part.read_text(encoding="utf-8").splitlines()]
    assert [(r["place"], r["seq"], r["extra"]) for r in lines("x-duplicates")] == [(1, "GG", 2), (2, "ACGT", 1)] and lines("y-duplicates") == []
    own = sorted(lines("x-sequences"), key=lambda r: r["length"])
    assert len(own) == 6 and own[0] | {"no": 0} == {"no": 0, "length": 0, "gc": 0.0, "bases": {}, "pairs": {}}
    assert own[-1]["bases"] == dict.fromkeys("ACGT", 0.25) and own[-1]["pairs"] == dict.fromkeys(("AC", "CG", "GT"), 1 / 3) and own[1]["gc"] == 100.0
    assert lines("y-sequences")[0]["bases"] == {"A": 0.5, "Ä": 0.5}
