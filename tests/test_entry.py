"""The driver's entry points, with and without the subpackage for training data."""

import importlib
import sys

import pytest


def fresh_entry():
    sys.modules.pop("__spark_entry__", None)
    return importlib.import_module("__spark_entry__")


def test_every_sql_belongs_to_a_query():
    entry = fresh_entry()
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p7_found", "class_report", "similarity_join"} <= set(entry.queries())


def test_entry_without_the_subpackage(monkeypatch):
    with_it = set(fresh_entry().queries())
    package = importlib.import_module("helixaudit")
    monkeypatch.delattr(package, "llm", raising=False)
    for name in [n for n in sys.modules if n.startswith("helixaudit.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "helixaudit.llm", None)
    without = fresh_entry()
    assert set(without.queries()) == {n for n in with_it if n[0] != "p" or n.startswith(("p7_", "pos"))}
    assert set(without.oracle_sql()) <= set(without.queries())
    sys.modules.pop("__spark_entry__", None)


def test_flagship_query(spark, small):
    rows = fresh_entry().entry(spark)
    assert {"label_1", "label_2", "row", "check", "flag"} <= set(rows.columns)
    flags = {r["check"]: r["flag"] for r in rows.collect()}
    # Two hundred records a class are too few to be scored, rules are decided all the same.
    assert flags["Sequence lengths"] == "Unknown" and flags["Unique bases"] in ("Pass", "Fail")


@pytest.mark.parametrize("name", ["p7_found", "class_summary", "leak_check"])
def test_queries_agree_with_their_sql(spark, small, name):
    import duckdb
    from pathlib import Path

    entry = fresh_entry()
    db = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from '{path}'").fetchall()
    got = entry.queries()[name](spark, small)
    result = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(tuple(map(str, (r[names.index(c)] for c in sorted(names)))) for r in result.fetchall())
    assert sorted(tuple(map(str, (r[c] for c in sorted(names)))) for r in got.collect()) == want


def test_leak_queries_cover_sequences_of_all_lengths(spark, tmp_path):
    import duckdb

    base = "ACGTTGCA" * 40
    tables = {"enhancers_train": ["ACGTACG", "ACG TACGTACGTACGTACGT", base, "", None], "enhancers_test": ["acgtacg", "ACGTACGTACGTACGTACGT", base[:150], "-", None]}
    db = duckdb.connect()
    for name, rows in tables.items():
        df = spark.createDataFrame(list(enumerate(rows)), "seq_no bigint, sequence string")
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        db.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'").fetchall()
    entry = fresh_entry()
    got = sorted(tuple(r) for r in entry.queries()["leak_exact_all"](spark, str(tmp_path)).select("first_test_no", "n_test", "n_train").collect())
    assert got == sorted(db.execute(entry.oracle_sql()["leak_exact_all"]).fetchall()) == [(0, 1, 1), (1, 1, 1)]
    hits = {(r["query"], r["target"]) for r in entry.queries()["similarity_join"](spark, str(tmp_path)).collect()}
    # The last is half as long as its target: a hit, though no leak.
    assert hits >= {("seq_0_test", "seq_0_train"), ("seq_1_test", "seq_1_train"), ("seq_2_test", "seq_2_train")}


def test_leak_copies_are_joined_without_a_search(spark, tmp_path, monkeypatch):
    import duckdb

    from helixaudit.operators import similarity

    base = "ACGTTGCA" * 40
    tables = {"enhancers_train": ["A", "acg t", base, base + "A", base, "ACGT" * 9, "", None], "enhancers_test": ["a", "ACGT", base, base, "ACGT" * 9 + "C", "-", None, ""]}
    db = duckdb.connect()
    for name, rows in tables.items():
        # Each record twice, and one more text under a number that is taken.
        df = spark.createDataFrame([*enumerate(rows), *enumerate(rows), (0, base)], "seq_no bigint, sequence string")
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        db.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'").fetchall()
    entry = fresh_entry()
    found = entry.queries()["similarity_join"](spark, str(tmp_path)).where("qcov = 1 and tcov = 1 and pident = 100").select("query", "target").collect()
    want = sorted(db.execute(entry.oracle_sql()["leak_copies"]).fetchall())
    assert sorted(tuple(int(x.split("_")[1]) for x in r) for r in found) == want and len(want) == 11

    def searched(*args, **options):
        raise AssertionError("copies were searched for by alignments")

    monkeypatch.setattr(similarity, "similarity_join", searched)
    assert sorted(tuple(r) for r in entry.queries()["leak_copies"](spark, str(tmp_path)).collect()) == want
