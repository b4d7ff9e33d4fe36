"""Sequence operators against brute force, on random families with edits and on edge cases."""

import random
import re
from collections import defaultdict

import pytest

from helixaudit.llm import components, cross_split, format_duplicates, near_duplicates, seeds, shared_spans, top_n
from helixaudit.sources.hits import HIT_SCHEMA

SCHEMA = "seq_no bigint, sequence string, label string, text string, rep bigint, d bigint"


def clean(s):
    return re.sub("[^A-Z]", "", (s or "").upper())


def windows(s):
    return {s[i : i + 12] for i in range(len(s) - 11)}


def edited(rng, s, edits):
    s = list(s)
    for _ in range(edits):
        at = rng.randrange(len(s))
        kind = rng.random()
        if kind < 0.5:
            s[at] = rng.choice("ACGT")
        elif kind < 0.7:
            s.insert(at, rng.choice("ACGT"))
        elif kind < 0.9:
            del s[at]
        else:
            cut = rng.randrange(len(s))
            s = s[cut:] + s[:cut]
    return "".join(s)


@pytest.fixture(scope="module")
def collection():
    """Families with edits, copies in other layouts, repeats inside one record, low complexity, dirt."""
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        base = "".join(rng.choice("ACGT") for _ in range(rng.choice((40, 60, 100, 200, 400))))
        texts.append(base)
        texts += [edited(rng, base, rng.choice((1, 2, 4, 8, 12))) for _ in range(rng.choice((0, 0, 1, 3)))]
    texts += ["A" * n for n in (40, 41, 60, 200)] + ["AC" * 30, "AC" * 45, "ACG" * 40, "CGA" * 41]
    texts += [texts[0].lower(), " ".join(texts[0]), texts[0], texts[1][:70] * 3]
    texts += [None, "", "  ", "NA", "ACGT", "ACGTN" * 8, "-" * 100, "ß" + texts[2]]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + rows[:5] + rows[:2]


def frame(spark, rows):
    """Rows with columns beside that clash with names the operators use."""
    return spark.createDataFrame([(n, t, "1", "x", 7, 9) for n, t in rows], SCHEMA)


def test_near_duplicates_match_brute_force(spark, collection):
    first = {}
    for n, t in sorted((n, clean(t)) for n, t in collection):
        if len(t) >= 40:
            first.setdefault(t, n)
    items = sorted((n, windows(t)) for t, n in first.items())
    want = {(a, b) for i, (a, x) in enumerate(items) for b, y in items[i + 1 :] if len(x & y) / len(x | y) >= 0.5}
    got = [tuple(r) for r in near_duplicates.near_duplicate_pairs(frame(spark, collection)).select("seq_a", "seq_b").collect()]
    assert len(got) == len(set(got))
    assert set(got) == want and want


def test_families_are_the_components_of_the_pairs(spark, collection):
    pairs = near_duplicates.near_duplicate_pairs(frame(spark, collection)).select("seq_a", "seq_b").collect()
    rows = {r["seq_no"]: r for r in near_duplicates.families(frame(spark, collection)).collect()}
    for a, b in pairs:
        assert rows[a]["family"] == rows[b]["family"] <= min(a, b)
    assert sum(r["links"] for r in rows.values()) == 2 * len(pairs)


def test_families_have_every_record_once(spark, collection):
    rows = [(100_000 + n, collection[4][1]) for n in range(30)] + [(200_000, "ACGTTGCAAC" * 9 + "TTGAC"), (200_001, "acgttgcaac" * 9 + "ttgac")] + collection
    first = {}
    for n, t in sorted((n, clean(t)) for n, t in rows):
        if len(t) >= 40:
            first.setdefault(t, n)
    parent = {n: n for n in first.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = [tuple(r) for r in near_duplicates.near_duplicate_pairs(frame(spark, rows)).select("seq_a", "seq_b").collect()]
    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {(n, first[t], find(first[t]), sum(n in p for p in pairs)) for n, t in ((n, clean(t)) for n, t in rows) if len(t) >= 40}
    got = [tuple(r) for r in near_duplicates.families(frame(spark, rows)).select("seq_no", "first_no", "family", "links").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # Copies, a family of copies alone, and records on their own.
    assert (200_001, 200_000, 200_000, 0) in want and sum(n >= 100_000 for n, *_ in want) == 32 and len({f for *_, f, _ in want}) > 20


def joined_lists(seed, rep, size):
    """Seeds in common of every pair of the lists of a bucket, as the operator counts them."""
    import numpy as np

    lists = near_duplicates.posting_lists(np.array(seed), np.array(rep), 2 * np.array(size))
    found = defaultdict(int)
    for a, b, common, _ in near_duplicates.join_lists(*lists, 0.5):
        for x, y, n in zip(a.tolist(), b.tolist(), common.tolist()):
            found[x, y] += n
    return {p: n for p, n in found.items() if n}


def test_equal_lists_and_size_blocks():
    # Sizes 50 and 90 are too far apart, and equal lists count twice though they are joined once.
    found = joined_lists([1, 1, 1, 2, 2, 2, 3, 3], [7, 8, 9, 7, 8, 9, 7, 10], [50, 52, 90, 50, 52, 90, 50, 51])
    assert found == {(7, 8): 2, (7, 10): 1}


def test_answers_derived_from_similar_lists(monkeypatch):
    import numpy as np

    rng = random.Random(19)
    size_of = [rng.randrange(40, 70) for _ in range(60)]
    lists = []
    for _ in range(25):
        base = set(rng.sample(range(60), rng.choice((2, 3, 8, 20))))
        for _ in range(rng.choice((1, 4, 9))):
            lists.append(base)
            base = set(base)
            for x in rng.sample(range(60), rng.choice((0, 0, 1, 2))):
                base ^= {x}
    postings = [(seed, rep) for seed, members in enumerate(lists) for rep in members] * 2
    rng.shuffle(postings)
    want = defaultdict(int)
    for members in lists:
        for a in members:
            for b in members:
                if a < b and abs(size_of[a] - size_of[b]) <= seeds.class_span(0.5):
                    want[a, b] += 1
    for block in (3, 500_000):
        monkeypatch.setattr(near_duplicates, "PAIR_BLOCK", block)
        assert joined_lists([s for s, _ in postings], [r for _, r in postings], [size_of[r] for _, r in postings]) == want
    arrays = near_duplicates.posting_lists(*(np.array(x) for x in zip(*[(s, r, 2 * size_of[r]) for s, r in postings])))
    tables = near_duplicates.list_tables(*arrays)
    # Most lists are much like another one: fewer pairs are made than the lists have.
    made = sum(len(i) for i, _ in near_duplicates.table_pairs(tables, seeds.class_span(0.5)))
    assert made < 0.7 * sum(want.values()) and (tables.weight < 0).any() and (tables.weight > 2).any()


def test_a_seed_of_very_many_texts_is_cut_short_before_the_exchange():
    import numpy as np

    out = seeds.Exchange(4, longest=3)
    seed = np.array([5] * 100 + [1 << 39] * 2 + [9] * 40)
    number = np.concatenate([np.arange(100), [1, 2], [7] * 40])
    parts = list(out.add(seed, number)) + list(out.flush())
    rows = [(b, p) for part in parts for b, p in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
    alone = np.concatenate([seeds.unpacked(memoryview(p))[0] for b, p in rows if b < 0])
    got_seed, got_number = seeds.gathered([p for b, p in rows if b >= 0])
    assert (got_seed == 5).sum() == 4 and sorted(alone.tolist() + got_number[got_seed == 5].tolist()) == list(range(100))
    # One text that repeats a seed is no frequent seed.
    assert (got_seed == 9).sum() == 40 and (got_seed == 1 << 39).sum() == 2
    assert all(b == -1 - n % 4 for b, p in rows if b < 0 for n in seeds.unpacked(memoryview(p))[0].tolist())


def test_blocks_of_a_frequent_seed_meet_once(spark, monkeypatch):
    from helixaudit.llm import hot_seeds

    assert [hot_seeds.blocks_of(k, 3) for k in range(6)] == [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    monkeypatch.setattr(hot_seeds, "FREQUENT", 6)
    monkeypatch.setattr(hot_seeds, "BLOCK_MEMBERS", 15)
    rng = random.Random(23)
    family = "".join(rng.choice("ACGT") for _ in range(200))
    rows = list(enumerate(edited(rng, family, 3) for _ in range(70)))
    sets = {n: windows(t) for n, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    texts = near_duplicates.distinct_texts(frame(spark, rows), 40).cache()
    assert hot_seeds.blocks_for(texts) == 5
    got = [tuple(r) for r in near_duplicates.near_duplicate_pairs(frame(spark, rows)).select("seq_a", "seq_b").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000


def test_packed_integers_survive_a_round_trip():
    import numpy as np

    for values in ([], [5], [0, 255], [-3, 1 << 40], [7, 7 + (1 << 20)]):
        got, rest = seeds.unpacked(memoryview(seeds.packed(np.array(values, np.int64)) + b"x"))
        assert got.tolist() == values and bytes(rest) == b"x"


HIT = dict(query="seq_1_test", target="seq_2_train", qcov=1.0, tcov=1.0, pident=95.0, evalue=0.1, qstart=1, qend=9, tstart=1, tend=9, alnlen=9, qaln="A", taln="A")


def hits(spark, *rows):
    return spark.createDataFrame([tuple((HIT | r)[f.name] for f in HIT_SCHEMA) for r in rows], HIT_SCHEMA)


def test_cross_split_matches_brute_force(spark, collection):
    train = [(n, t) for n, t in collection if n % 3]
    test = [(1000 + n, t) for n, t in collection if not n % 3]
    want = set()
    for a, x in test:
        for b, y in train:
            x_, y_ = clean(x), clean(y)
            if min(len(x_), len(y_)) >= 40 and len(windows(x_) & windows(y_)) / len(windows(x_) | windows(y_)) >= 0.5:
                want.add((a, b))
    table = hits(
        spark,
        dict(query=" SEQ_1000_test ", target="seq_1_TRAIN"),
        dict(query="seq_1000_test", target="seq_1_train"),
        dict(query="seq_1003_test", target="seq_2_train", qcov=0.5),
        dict(query="seq_1003_test", target="seq_4_train", pident=float("nan")),
        dict(query="seq_1003_test", target="seq_5_train", qaln=None),
        dict(query="seq_0_test", target="seq_5_train"),
    )
    got = [tuple(r) for r in cross_split.cross_split_overlaps(frame(spark, test), frame(spark, train), table).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want | {(1000, 1)} and len(want) > 5


def test_a_number_with_two_texts_overlaps_by_each(spark, monkeypatch):
    rng = random.Random(29)
    one, two = ("".join(rng.choice("ACGT") for _ in range(120)) for _ in range(2))
    test, train = frame(spark, [(1, one), (2, two), (2, two)]), frame(spark, [(5, one), (5, two), (5, one)])
    got = [tuple(r) for r in cross_split.overlaps_by_text(test, train).collect()]
    assert sorted(got) == [(1, 5), (2, 5)]
    assert sorted(tuple(r) for r in cross_split.overlap_classes(test, train).collect()) == [(1, 5, 1, 1), (2, 5, 1, 1)]


def test_texts_that_share_a_short_digest_are_all_verified(spark, collection, monkeypatch):
    train, test = [(n, t) for n, t in collection if n % 3], [(1000 + n, t) for n, t in collection if not n % 3]
    want = {tuple(r) for r in cross_split.overlaps_by_text(frame(spark, test), frame(spark, train)).collect()}
    monkeypatch.setattr(cross_split, "SHORT", 31)
    got = [tuple(r) for r in cross_split.overlaps_by_text(frame(spark, test), frame(spark, train)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_rare_shingles_and_spared_ones(spark):
    """A motif of most training records comes last in every order, and is spared unless the training record repeats itself."""
    import numpy as np

    assert (cross_split.spared(0.5) < cross_split.needed_seeds(0.5).diagonal()).all() and cross_split.spared(0.5)[40:80].max() > 3
    rng = random.Random(41)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    motif = text(40)
    bases = [text(260) for _ in range(40)]
    train = [(n, b[:100] + motif + b[100:]) for n, b in enumerate(bases)]
    # Similar to the first test record by what it repeats, which the record itself has once.
    train += [(100, bases[0][:100] + motif * 3 + bases[0][100:] + bases[0][:60])]
    test = [(1000 + n, edited(rng, t, 3)) for n, t in train[:20]] + [(2000, motif + text(200))]
    sets = {n: windows(t) for n, t in train + test}
    want = {(a, b) for a, _ in test for b, _ in train if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    got = {tuple(r) for r in cross_split.overlaps_by_text(frame(spark, test), frame(spark, train)).collect()}
    assert got == want and len(want) >= 20 and (1000, 100) in want
    left, right = (cross_split.written(frame(spark, rows), 40) for rows in (test, train))
    assert cross_split.candidates(left, right, 0.5).count() < 2 * len(want)


def test_overlaps_in_ranges_of_seeds_and_blocks_of_members(spark, collection, monkeypatch):
    """With a bitmap too small for all seeds at once, and frequent seeds split, the pairs are the same."""
    from helixaudit.llm import hot_seeds

    rng = random.Random(31)
    family = "".join(rng.choice("ACGT") for _ in range(200))
    rows = collection + [(5000 + n, edited(rng, family, 3)) for n in range(60)]
    test, train = [(1000 + n, t) for n, t in rows if not n % 3], [(n, t) for n, t in rows if n % 3]
    want = {tuple(r) for r in cross_split.overlaps_by_text(frame(spark, test), frame(spark, train)).collect()}
    monkeypatch.setattr(cross_split, "LEAST_BITS", 12)
    monkeypatch.setattr(cross_split, "MOST_BITS", 16)
    monkeypatch.setattr(hot_seeds, "FREQUENT", 5)
    monkeypatch.setattr(hot_seeds, "BLOCK_MEMBERS", 30)
    got = [tuple(r) for r in cross_split.overlaps_by_text(frame(spark, test), frame(spark, train)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500


def test_top_n_with_ties_and_few_items(spark):
    rng = random.Random(2)
    rows = [dict(query=f"seq_{q}_test", target=f"seq_{rng.randrange(40)}_train", pident=float(rng.choice((70, 80, 80, 90, 95)))) for q in (1, 1, 1, 2, 3) for _ in range(30)]
    rows += [dict(query="seq_9_test", target="seq_10_train"), dict(query="seq_9_test", target="seq_9_train"), dict(query=None), dict(query="seq_8_test", pident=float("nan"))]
    best = {}
    for r in rows:
        r = HIT | r
        if r["query"] and r["pident"] == r["pident"]:
            key = r["query"], r["target"]
            best[key] = max(best.get(key, 0), r["pident"])
    groups = defaultdict(list)
    for (q, t), p in best.items():
        groups[q].append((-p, int(t.split("_")[1]), t))
    want = {(q, t, k + 1) for q, x in groups.items() for k, (_, _, t) in enumerate(sorted(x)[:5])}
    for bands in ((0.1, 0.4), (0.5,), (0.01, 0.02, 0.9)):
        table = hits(spark, *rows).repartition(3).where("query is not null and not isnan(pident)")
        from helixaudit.sources.hits import id_number

        got = top_n.top_n_by_bands(table, 5, "query", "target", "pident", [id_number("target", "train").asc_nulls_last()], bands)
        assert {(r["query"], r["target"], r["rank"]) for r in got.collect()} == want
    assert {(r["query"], r["target"], r["rank"]) for r in top_n.top_targets(hits(spark, *rows)).collect()} == want


def test_shared_spans_match_brute_force(spark, collection):
    texts = {n: clean(t) for n, t in collection}
    holders = defaultdict(set)
    for n, t in texts.items():
        for i in range(len(t) - 59):
            holders[t[i : i + 60]].add(n)
    want = set()
    for n, t in texts.items():
        spans = []
        for i in range(len(t) - 59):
            if len(holders[t[i : i + 60]]) > 1:
                if spans and i + 1 <= spans[-1][1] + 1:
                    spans[-1][1] = i + 60
                else:
                    spans.append([i + 1, i + 60])
        want |= {(n, a, b) for a, b in spans}
    got = [tuple(r) for r in shared_spans.shared_spans(frame(spark, collection)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want and want
    share = {r["seq_no"]: (r["spans"], r["shared"]) for r in shared_spans.shared_letters(frame(spark, collection)).collect()}
    for n, (spans, shared) in share.items():
        own = [(a, b) for m, a, b in want if m == n]
        assert (spans, shared) == (len(own), sum(b - a + 1 for a, b in own))


def test_shared_spans_in_ranges_of_keys_and_small_flushes(spark, collection, monkeypatch):
    """A stretch of very many records, a bitmap too small for all keys at once and chunks sent bit by bit: the spans are the same."""
    rng = random.Random(37)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    stretch = text(90)
    rows = collection + [(7000 + n, text(rng.randrange(5, 40)) + stretch + text(20)) for n in range(80)]
    want = {tuple(r) for r in shared_spans.shared_spans(frame(spark, rows)).collect()}
    assert all(any(m == 7000 + n and b - a >= 89 for m, a, b in want) for n in range(80))
    monkeypatch.setattr(shared_spans, "LEAST_BITS", 12)
    monkeypatch.setattr(shared_spans, "MOST_BITS", 15)
    monkeypatch.setattr(shared_spans, "HELD_LETTERS", 2000)
    got = [tuple(r) for r in shared_spans.shared_spans(frame(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_format_copies_match_brute_force(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("ACGT") for _ in range(30))
    other = base[::-1]
    texts = [base, base.lower(), f" {base[:9]}-{base[9:]}\n", f"{base}|{other}", f"{other};{base}", f"{other}/ /{base}|", f"{other}|{base}|{base}", "ACGT", "acgt", "AC|GT" * 5, None, "", "N/A", base, base]
    rows = list(enumerate(texts)) + [(0, base)]
    groups = defaultdict(set)
    for n, t in rows:
        parts = tuple(sorted(p for p in map(clean, re.split("[|;/]", t or "")) if p))
        if sum(map(len, parts)) >= 20:
            groups[parts].add(n)
    want = {(min(g), n) for g in groups.values() for n in g if n != min(g)}
    got = [tuple(r) for r in format_duplicates.format_copies(frame(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    counts = {r["kept_no"]: r["copies"] for r in format_duplicates.format_groups(frame(spark, rows)).collect()}
    assert counts == {min(g): len(g) for g in groups.values() if len(g) > 1}


def test_components_of_chains_stars_and_loops(spark):
    links = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("hub", f"leaf{i}") for i in range(40)] + [("solo", "solo"), ("x", "y"), ("y", "x"), (None, "x"), ("z", None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a and b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = [tuple(r) for r in components.components(spark.createDataFrame(links * 2, "a string, b string"), "a", "b").collect()]
    assert len(got) == len(set(got)) and dict(got) == {x: find(x) for x in parent}


def test_empty_tables(spark):
    none, no_hits = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], HIT_SCHEMA)
    assert near_duplicates.near_duplicate_pairs(none).count() == 0
    assert cross_split.cross_split_overlaps(none, none, no_hits).count() == 0
    assert top_n.top_targets(no_hits).count() == 0
    assert shared_spans.shared_spans(none).count() == 0
    assert format_duplicates.format_copies(none).count() == 0
    assert components.hit_groups(no_hits).count() == 0


def test_frequent_seeds_take_the_second_index(spark, monkeypatch):
    """A motif in most records makes no candidates, and families among them are found all the same."""
    from helixaudit.llm import hot_seeds

    monkeypatch.setattr(hot_seeds, "FREQUENT", 6)
    rng = random.Random(11)
    motif = "".join(rng.choice("ACGT") for _ in range(40))
    rows = []
    for _ in range(60):
        base = "".join(rng.choice("ACGT") for _ in range(rng.choice((150, 250))))
        base = base[:70] + motif + base[70:]
        rows += [base] + [edited(rng, base, 4) for _ in range(rng.choice((0, 0, 1)))]
    family = "".join(rng.choice("ACGT") for _ in range(200))
    rows += [edited(rng, family, 2) for _ in range(12)]
    rows = list(enumerate(rows))
    sets = {n: windows(t) for n, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(frame(spark, rows)).select("seq_a", "seq_b").collect()}
    assert got == want and len(want) > 60
    texts = near_duplicates.distinct_texts(frame(spark, rows), 40).cache()
    pairs = {tuple(r) for r in near_duplicates.candidates(texts, 4, 0.5).collect()}
    # Some 75 records hold the motif: joined by it they would make thousands of candidates.
    assert want <= pairs and len(pairs - want) < 75 * 74 / 2 / 10
    test, train = [(1000 + n, t) for n, t in rows if n % 2], [(n, t) for n, t in rows if n % 2 == 0]
    found = {tuple(r) for r in cross_split.overlaps_by_text(frame(spark, test), frame(spark, train)).collect()}
    assert found == {(1000 + (a if a % 2 else b), b if a % 2 else a) for a, b in want if (a + b) % 2}


def test_buckets_of_fewer_postings_than_a_frequent_seed(spark):
    """One family of 60 with the production bound, over so many buckets that most hold fewer than 48 postings."""
    from helixaudit.llm import hot_seeds

    rng = random.Random(13)
    family = "".join(rng.choice("ACGT") for _ in range(300))
    rows = list(enumerate(edited(rng, family, 6) for _ in range(60)))
    sets = {n: windows(t) for n, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    texts = near_duplicates.distinct_texts(frame(spark, rows), 40).cache()
    assert hot_seeds.FREQUENT == 48
    assert hot_seeds.frequent_seeds(texts, 200)[0].any()
    assert want <= {tuple(r) for r in near_duplicates.candidates(texts, 200, 0.5).collect()}


def test_records_that_share_nothing_and_groups_of_one(spark):
    rng = random.Random(17)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    base = text(100)
    rows = list(enumerate([base, base[20:] + text(30), text(90), text(30), "", None, base.lower()]))
    got = {tuple(r) for r in shared_spans.shared_letters(frame(spark, rows), every=True).collect()}
    assert {r for r in got if r[0] in (2, 3, 4, 5)} == {(2, 90, 0, 0), (3, 30, 0, 0), (4, 0, 0, 0), (5, 0, 0, 0)}
    assert len(got) == 7 and {r for r in got if r[3]} == {tuple(r) for r in shared_spans.shared_letters(frame(spark, rows)).collect()}
    groups = {tuple(r) for r in format_duplicates.format_groups(frame(spark, rows), fewest=1).collect()}
    assert groups == {(0, 2), (1, 1), (2, 1), (3, 1)}
