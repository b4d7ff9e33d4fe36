"""Mixing sources to target shares of all tokens, with a cap on repeats.

The size of the mix is the largest that no source's cap forbids. Each source then needs its
documents ``r`` times on average: all of them floor(r) times, and a balanced sample of them once more.
The sample is drawn by the cube method: inclusion probabilities move at random inside the null
space of the balancing constraints (number of documents, number of tokens) until all but two of a
block are 0 or 1; so counts and tokens of the sample are those wanted, up to the landing of a few
documents per source. Blocks of a few thousand documents fly in parallel, what each leaves undecided
is put into new blocks, until one small landing problem per source remains.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_once
from .tokenizer import VOCABULARY, encoded

#: Documents of a block of the flight phase.
BLOCK = 2000


def fly(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Inclusion probabilities after the flight phase: at most two stay between 0 and 1.

    Both sum(p) and sum(p * size) keep their values, up to rounding.
    """
    p = p.astype(float).tolist()
    x = size.astype(float).tolist()
    dice = rng.random(len(p) * 2 + 16).tolist()
    active = []
    queue = [i for i in range(len(p) - 1, -1, -1) if 0 < p[i] < 1]
    while True:
        while len(active) < 3 and queue:
            active.append(queue.pop())
        if len(active) < 2:
            break
        if len(active) == 3:
            i, j, k = active
            move = [x[k] - x[j], x[i] - x[k], x[j] - x[i]]
            if not any(move):
                move = [1.0, -1.0, 0.0]
        elif x[active[0]] == x[active[1]]:
            move = [1.0, -1.0]
        else:
            break
        up = min(((1 - p[a]) / m if m > 0 else -p[a] / m) for a, m in zip(active, move) if m)
        down = min((p[a] / m if m > 0 else (p[a] - 1) / m) for a, m in zip(active, move) if m)
        step = up if dice.pop() * (up + down) < down else -down
        rest = []
        for a, m in zip(active, move):
            q = p[a] + step * m
            q = 0.0 if q < 1e-9 else 1.0 if q > 1 - 1e-9 else q
            p[a] = q
            if 0 < q < 1:
                rest.append(a)
        active = rest
    return np.array(p)


def land(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decide what the last flight left: the token constraint is given up first, then the count.

    Every document keeps its inclusion probability in this, so tokens are off by a part of the last documents' sizes, whatever the order of the
    flight. (Flying the largest first, or exchanging documents afterwards to come nearer, was tried: the first leaves larger
    ones to the end, the second makes inclusion unfair.)
    """
    p = fly(p, size, rng)
    p = fly(p, np.zeros(len(p)), rng)
    return np.where((p > 0) & (p < 1), (rng.random(len(p)) < p).astype(float), p)


def _flights(rows: DataFrame, last: bool, seed: int) -> DataFrame:
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["doc_id", "tokens"], kind="stable")
        rng = np.random.default_rng([seed, int(block["block"].iloc[0]) & 0x7FFFFFFF, sum(map(ord, block["source"].iloc[0]))])
        block["p"] = (land if last else fly)(block["p"].to_numpy(), block["tokens"].to_numpy(), rng)
        return block[["doc_id", "source", "tokens", "base", "p"]]

    return rows.groupBy("source", "block").applyInPandas(run, "doc_id bigint, source string, tokens bigint, base int, p double")


def plan_mix(targets: list[dict]) -> dict[str, float]:
    """Average copies of each document by source, from rows with source, share, repeats, tokens.

    Sources without tokens, share or repeats are left out, and the shares of the others count in
    proportion.
    """
    usable = [t for t in targets if (t["tokens"] or 0) > 0 and (t["share"] or 0) > 0 and (t["repeats"] or 0) > 0]
    if not usable:
        return {}
    size = min(t["repeats"] * t["tokens"] / t["share"] for t in usable)
    return {t["source"]: min(float(t["repeats"]), t["share"] * size / t["tokens"]) for t in usable}


def _target():
    """A row of the targets, so that the least of several rows of a source is the same on every run."""
    return F.struct("target_share", "max_repeats")


def token_sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of every document; null and empty texts have no tokens."""
    rows = documents.select(F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source")).alias("of"), "text")
    return encoded(rows, key="of", vocabulary=vocabulary, counts_only=True).select("of.doc_id", "of.source", "tokens")


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = 11, sizes: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, tokens, copies): the documents of the mix, each used ``copies`` times.

    ``copies`` is at least 1 and at most ``max_repeats``. Documents of null or unlisted sources and
    those without tokens are not used; sources listed twice count by their row of least share (then of fewest repeats); empty tables
    give no rows. The same input and seed give the same mix on every run.
    """
    sizes = write_once(token_sizes(documents, vocabulary), "tokens") if sizes is None else sizes
    used = sizes.where(F.col("source").isNotNull() & (F.col("tokens") > 0))
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.min(_target()).alias("t")).select("source", F.col("t.target_share").alias("share"), F.col("t.max_repeats").alias("repeats"))
    # One row per source of the targets, a table of fixed size.
    totals = wanted.join(used.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "source", "left").collect()
    rates = plan_mix([r.asDict() for r in totals])
    schema = "source string, base int, p double, blocks int"
    plan = [(s, int(math.floor(r + 1e-9)), max(0.0, r - math.floor(r + 1e-9)), max(1, -(-next(t["docs"] for t in totals if t["source"] == s) // BLOCK))) for s, r in rates.items()]
    spark = documents.sparkSession
    rows = used.join(F.broadcast(spark.createDataFrame(plan, schema)), "source")
    whole = rows.where(F.col("p") <= 1e-9).select("doc_id", "source", "tokens", F.col("base").alias("copies"))
    rows = rows.where(F.col("p") > 1e-9).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks").cast("bigint")))
    most, decided = max([p[3] for p in plan if p[2] > 1e-9], default=1), []
    while True:
        flown = write_once(_flights(rows.select("doc_id", "source", "tokens", "base", "p", "block"), most == 1, seed), "flight")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        decided.append(flown.where(~open_).select("doc_id", "source", "tokens", (F.col("base") + F.col("p").cast("int")).alias("copies")))
        if most == 1:
            break
        # Two of each block are left at most.
        most = -(-most * 2 // BLOCK)
        rows = flown.where(open_).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(most).cast("bigint")))
    for part in decided:
        whole = whole.unionByName(part)
    return whole.where(F.col("copies") > 0).select("doc_id", "source", "tokens", F.col("copies").cast("int").alias("copies"))


def shares(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = 11) -> DataFrame:
    """(source, target_share, actual_share, documents, tokens, mix_documents, mix_tokens, most_copies) of every source wanted."""
    sizes = write_once(token_sizes(documents, vocabulary), "tokens")
    chosen = mix(documents, targets, vocabulary, seed, sizes)
    mixed = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mix_tokens"), F.sum("copies").alias("mix_documents"), F.max("copies").alias("most_copies"))
    held = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))
    rows = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.min(_target())["target_share"].alias("target_share")).join(held, "source", "left").join(mixed, "source", "left")
    rows = rows.na.fill(0, ["documents", "tokens", "mix_documents", "mix_tokens", "most_copies"])
    # One row per source of the targets: a single small partition.
    every = F.sum("mix_tokens").over(Window.partitionBy(F.lit(1))).cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("source", "target_share", F.coalesce(F.try_divide(F.col("mix_tokens").cast("double"), every), F.lit(0.0)).alias("actual_share"), *map(zero, ("documents", "tokens", "mix_documents", "mix_tokens", "most_copies")))
