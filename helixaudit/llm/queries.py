"""Queries of this subpackage and, where SQL can express them, the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import components, cross_split, format_duplicates, languages, mixing, near_duplicates, shared_spans, tokenizer, top_n


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(_table(spark, folder, "enhancers_train")).select("seq_a", "seq_b")


def p1_families(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record with 40 letters or more: the first record with its text, its family and number of links."""
    return near_duplicates.families(_table(spark, folder, "enhancers_train"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    test, train, hits = (_table(spark, folder, t) for t in ("enhancers_test", "enhancers_train", "mmseqs2_search_result"))
    return cross_split.cross_split_overlaps(test, train, hits)


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    test, train = (_table(spark, folder, t) for t in ("enhancers_test", "enhancers_train"))
    return cross_split.overlap_report(p2_found(spark, folder), test, train)


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps by text between classes of equal texts; p2_members has the records of the classes."""
    return cross_split.overlap_classes(*(_table(spark, folder, t) for t in ("enhancers_test", "enhancers_train")))


def p2_members(spark: SparkSession, folder: str) -> DataFrame:
    sides = [cross_split.class_members(_table(spark, folder, t)).select(F.lit(side).alias("side"), "seq_no", "first_no") for side, t in (("test", "enhancers_test"), ("train", "enhancers_train"))]
    return sides[0].unionAll(sides[1])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return top_n.top_targets(_table(spark, folder, "mmseqs2_search_result")).select("query", "target")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.shared_spans(_table(spark, folder, "enhancers_train"))


def p4_shared(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.shared_letters(_table(spark, folder, "enhancers_train"))


def p4_letters(spark: SparkSession, folder: str) -> DataFrame:
    """Shared letters of every record, 0 for those that share nothing; p4_shared has only the others."""
    return shared_spans.shared_letters(_table(spark, folder, "enhancers_train"), every=True)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return format_duplicates.format_copies(_table(spark, folder, "enhancers_train"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return format_duplicates.format_groups(_table(spark, folder, "enhancers_train"))


def p5_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """The collapsed collection with counts, groups of one included; p5_groups has only larger ones."""
    return format_duplicates.format_groups(_table(spark, folder, "enhancers_train"), fewest=1)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return components.hit_groups(_table(spark, folder, "mmseqs2_search_result"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encoded(_table(spark, folder, "documents"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return languages.corrections(_table(spark, folder, "documents")).select("doc_id", "cell_no", "lang")


def p10_languages(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document (cell 0) and every markdown cell, with its confidence."""
    return languages.all_languages(_table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_families, p2_found, p2_report, p2_classes, p2_members, p3_found, p4_found, p4_shared, p4_letters, p5_found, p5_groups, p5_collapsed, p6_found, p8_ids, p9_mix, p9_shares, p10_found, p10_languages)}


def _cleaned(c: str) -> str:
    return f"regexp_replace(upper(coalesce({c}, '')), '[^A-Z]', '', 'g')"


_COMPLETE = "\n    AND ".join(f"{c} IS NOT NULL" for c in ("query", "target", "qstart", "qend", "tstart", "tend", "alnlen", "qaln", "taln")) + "".join(f"\n    AND {c} IS NOT NULL AND NOT isnan({c})" for c in ("qcov", "tcov", "pident", "evalue"))
_HITS = f"hits AS (SELECT lower(trim(query)) AS query, lower(trim(target)) AS target, qcov, tcov, pident FROM mmseqs2_search_result WHERE {_COMPLETE})"


def _windows(name: str, rows: str) -> str:
    """Distinct 12-letter windows of (no, s), and their number."""
    return f"{name}_w AS (SELECT DISTINCT no, substr(s, i, 12) AS w FROM {rows}, unnest(generate_series(1, length(s) - 11)) AS g(i)), {name}_n AS (SELECT no, count(*) AS n FROM {name}_w GROUP BY no)"


def _similar(a: str, b: str, on: str) -> str:
    return f"SELECT a.no AS a, b.no AS b, count(*) AS c FROM {a}_w a JOIN {b}_w b ON a.w = b.w{on} GROUP BY a.no, b.no"


_P1 = f"""WITH r AS (SELECT min(seq_no) AS no, s FROM (SELECT seq_no, {_cleaned("sequence")} AS s FROM enhancers_train) WHERE length(s) >= 40 GROUP BY s),
{_windows("r", "r")},
p AS ({_similar("r", "r", " AND a.no < b.no")})
SELECT p.a AS seq_a, p.b AS seq_b FROM p JOIN r_n x ON x.no = p.a JOIN r_n y ON y.no = p.b WHERE c / (x.n + y.n - c) >= 0.5"""

_P2 = f"""WITH {_HITS},
t AS (SELECT DISTINCT seq_no AS no, {_cleaned("sequence")} AS s FROM enhancers_test WHERE length({_cleaned("sequence")}) >= 40),
r AS (SELECT DISTINCT seq_no AS no, {_cleaned("sequence")} AS s FROM enhancers_train WHERE length({_cleaned("sequence")}) >= 40),
{_windows("t", "t")}, {_windows("r", "r")},
p AS ({_similar("t", "r", "")})
SELECT p.a AS test_no, p.b AS train_no FROM p JOIN t_n x ON x.no = p.a JOIN r_n y ON y.no = p.b WHERE c / (x.n + y.n - c) >= 0.5
UNION
SELECT test_no, train_no FROM (SELECT try_cast(regexp_extract(query, '^seq_([0-9]+)_test$', 1) AS bigint) AS test_no, try_cast(regexp_extract(target, '^seq_([0-9]+)_train$', 1) AS bigint) AS train_no FROM hits WHERE least(qcov, tcov) * pident >= 90)
WHERE test_no IN (SELECT seq_no FROM enhancers_test) AND train_no IN (SELECT seq_no FROM enhancers_train)"""

_CLASSES = f"""WITH a AS (SELECT min(seq_no) AS no, count(DISTINCT seq_no) AS k, s FROM (SELECT seq_no, {_cleaned("sequence")} AS s FROM enhancers_test) WHERE length(s) >= 40 GROUP BY s),
b AS (SELECT min(seq_no) AS no, count(DISTINCT seq_no) AS k, s FROM (SELECT seq_no, {_cleaned("sequence")} AS s FROM enhancers_train) WHERE length(s) >= 40 GROUP BY s),
{_windows("a", "a")}, {_windows("b", "b")},
p AS ({_similar("a", "b", "")})
SELECT p.a AS test_first, p.b AS train_first, a.k AS n_test, b.k AS n_train FROM p JOIN a_n x ON x.no = p.a JOIN b_n y ON y.no = p.b JOIN a ON a.no = p.a JOIN b ON b.no = p.b WHERE c / (x.n + y.n - c) >= 0.5"""

_MEMBERS = " UNION ALL ".join(f"""SELECT '{side}' AS side, seq_no, min(seq_no) OVER (PARTITION BY s) AS first_no FROM (SELECT DISTINCT seq_no, {_cleaned("sequence")} AS s FROM enhancers_{side}) WHERE length(s) >= 40""" for side in ("test", "train"))

_CANON = "array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(upper(sequence), '[|;/]'), lambda p: regexp_replace(p, '[^A-Z]', '', 'g')), lambda p: p <> '')), '|')"
_GROUPS = f"SELECT c, seq_no, min(seq_no) OVER (PARTITION BY c) AS kept_no FROM (SELECT DISTINCT seq_no, {_CANON} AS c FROM enhancers_train WHERE sequence IS NOT NULL) WHERE length(replace(c, '|', '')) >= 20"

_SPANS = f"""WITH r AS (SELECT DISTINCT seq_no, {_cleaned("sequence")} AS s FROM enhancers_train),
k AS (SELECT seq_no, i, substr(s, i, 60) AS w FROM r, unnest(generate_series(1, length(s) - 59)) AS g(i)),
x AS (SELECT w FROM k GROUP BY w HAVING count(DISTINCT seq_no) > 1),
m AS (SELECT seq_no, i, lag(i) OVER (PARTITION BY seq_no ORDER BY i) AS before FROM k WHERE w IN (SELECT w FROM x)),
g AS (SELECT seq_no, i, sum(CASE WHEN before IS NULL OR i > before + 60 THEN 1 ELSE 0 END) OVER (PARTITION BY seq_no ORDER BY i) AS span FROM m),
f AS (SELECT seq_no, min(i) AS span_start, max(i) + 59 AS span_end FROM g GROUP BY seq_no, span)"""


def oracle_sql() -> dict[str, str]:
    """No SQL for tokenising, mixing and language models: their tests hold them against brute force."""
    return {
        "p1_found": _P1,
        "p2_found": _P2,
        "p2_report": f"""SELECT split, test_source, train_source, count(*) AS n_pairs, count(DISTINCT test_no) AS n_test, count(DISTINCT train_no) AS n_train FROM ({_P2}) p
JOIN (SELECT seq_no AS test_no, min(split) AS split, min(source) AS test_source FROM enhancers_test GROUP BY seq_no) a USING (test_no)
JOIN (SELECT seq_no AS train_no, min(source) AS train_source FROM enhancers_train GROUP BY seq_no) b USING (train_no) GROUP BY split, test_source, train_source""",
        "p2_classes": _CLASSES,
        "p2_members": _MEMBERS,
        "p1_families": f"""WITH RECURSIVE t AS (SELECT DISTINCT seq_no, {_cleaned("sequence")} AS s FROM enhancers_train), m AS (SELECT seq_no, min(seq_no) OVER (PARTITION BY s) AS first_no FROM t WHERE length(s) >= 40),
e AS (SELECT * FROM ({_P1})), l AS (SELECT seq_a AS x, seq_b AS y FROM e UNION ALL SELECT seq_b, seq_a FROM e),
f AS (SELECT x AS id, x AS root FROM l UNION SELECT l.y, f.root FROM f JOIN l ON l.x = f.id),
g AS (SELECT id, min(root) AS family FROM f GROUP BY id), k AS (SELECT x AS id, count(*) AS n FROM l GROUP BY x)
SELECT m.seq_no, m.first_no, coalesce(g.family, m.first_no) AS family, CASE WHEN m.seq_no = m.first_no THEN coalesce(k.n, 0) ELSE 0 END AS links FROM m LEFT JOIN g ON g.id = m.first_no LEFT JOIN k ON k.id = m.first_no""",
        "p6_found": f"""WITH RECURSIVE {_HITS}, e AS (SELECT query AS a, target AS b FROM hits UNION SELECT target, query FROM hits),
r AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT id AS record_id, min(root) AS group_id FROM r GROUP BY id""",
        "p3_found": f"""WITH {_HITS},
b AS (SELECT query, target, max(pident) AS pident FROM hits GROUP BY query, target)
SELECT query, target FROM b QUALIFY row_number() OVER (PARTITION BY query ORDER BY pident DESC, try_cast(regexp_extract(target, '^seq_([0-9]+)_train$', 1) AS bigint) NULLS LAST, target) <= 5""",
        "p4_found": f"{_SPANS} SELECT seq_no, span_start, span_end FROM f",
        "p4_shared": f"{_SPANS} SELECT f.seq_no, any_value(length(s))::int AS letters, count(*) AS spans, sum(span_end - span_start + 1)::bigint AS shared FROM f JOIN r USING (seq_no) GROUP BY f.seq_no",
        "p5_found": f"SELECT kept_no, seq_no AS copy_no FROM ({_GROUPS}) WHERE seq_no <> kept_no",
        "p5_groups": f"SELECT kept_no, count(*) AS copies FROM ({_GROUPS}) GROUP BY kept_no HAVING count(*) > 1",
        "p4_letters": f"{_SPANS} SELECT r.seq_no, any_value(length(s))::int AS letters, count(span_end) AS spans, coalesce(sum(span_end - span_start + 1), 0)::bigint AS shared FROM r LEFT JOIN f USING (seq_no) GROUP BY r.seq_no",
        "p5_collapsed": f"SELECT kept_no, count(*) AS copies FROM ({_GROUPS}) GROUP BY kept_no",
    }
