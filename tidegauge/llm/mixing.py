"""Records of several sources mixed to target shares of the total size.

Per source the documents are counted by exact token length. Whole passes over a source come first; the rest of its
budget takes an even part of every length and closes the remaining gap by a bounded-knapsack over lengths (a subset-sum
bitset). Which documents of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidegauge import model
from tidegauge.llm import tokens


def source_key(col: str = "source") -> Column:
    """A source's name without blanks around and in lower case."""
    return F.lower(F.regexp_replace(col, r"^\s+|\s+$", ""))


def count_tokens(documents: DataFrame, tokenizer: str = tokens.DEFAULT_FILE) -> DataFrame:
    """``(doc_id, source, n_tokens)`` of each document, the source in its normal form; NULL texts have 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(tokens.encode(t, tokenizer)) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["source"], pa.array(n, type=pa.int64())], names=["doc_id", "source", "n_tokens"])

    model.utc(documents.sparkSession)
    tokens.share(documents.sparkSession, tokenizer)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_key().alias("source"), "text")
    return model.spread(texts).mapInArrow(run, "doc_id long, source string, n_tokens long")


def fit_subset(lengths: np.ndarray, counts: np.ndarray, budget: int, largest_gap: int = 65_536) -> np.ndarray:
    """How many documents of each length to take so that their sum comes closest to ``budget`` from below.

    An even part of each length is taken first, then one more of each while the gap is above ``largest_gap``; the gap left is
    closed by a bounded knapsack over what remains, exactly where a combination exists.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = (counts.astype(np.float64) * (max(0, budget) / total)).astype(np.int64)
    taken = np.minimum(taken, counts)
    gap = budget - int((taken * lengths).sum())
    while gap < 0:  # only by rounding of very large counts
        j = int(np.argmax(taken))
        taken[j] -= 1
        gap += int(lengths[j])
    order = np.argsort(-lengths, kind="stable")
    while gap > largest_gap:
        before = gap
        for j in order:
            more = min(int(counts[j] - taken[j]), (gap - largest_gap) // int(lengths[j]), 1)
            if more > 0:
                taken[j] += more
                gap -= more * int(lengths[j])
        if gap == before:
            break
    # Bounded knapsack: bit s of `reach` says that some choice sums to s; each length counts up to its number left.
    reach, trail, mask = 1, [], (1 << (gap + 1)) - 1
    for j in order:
        left, step = min(int(counts[j] - taken[j]), gap // int(lengths[j])), 1
        while left > 0 and not reach >> gap & 1:
            k = min(step, left)
            new = (reach | reach << (k * int(lengths[j]))) & mask
            if new != reach:
                trail.append((j, k, reach))
                reach = new
            left, step = left - k, step * 2
        if reach >> gap & 1:
            break
    at = (reach & mask).bit_length() - 1
    for j, k, before in reversed(trail):
        if not before >> at & 1:
            taken[j] += k
            at -= k * int(lengths[j])
    return taken


def plan_budgets(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, int]:
    """Tokens of each source. Without ``total``, as many as the scarcest source allows with its repeats.

    Sources without a token can't reach their share: they get 0 and the others keep their shares of the total.
    """
    able = {s: sizes[s] * r / share for s, (share, r) in targets.items() if share > 0 and r > 0 and sizes.get(s, 0) > 0}
    most = min(able.values(), default=0.0)
    total = most if total is None else min(total, most)
    return {s: (min(int(round(share * total)), sizes[s] * r) if s in able else 0) for s, (share, r) in targets.items()}


def mix(counted: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, docs_per_salt: int = 100_000) -> DataFrame:
    """``(doc_id, source, n_tokens, copies, target_share, reached_share)`` of the documents used at least once.

    ``counted`` comes from :func:`count_tokens` (checkpoint it: it is read three times), ``targets`` has ``source``,
    ``target_share`` and ``max_repeats``, how often a document may be used in all. Documents of other sources, without
    source, without ``doc_id`` or without a token take no part, nor do targets with a NULL or no positive share. Repeated
    targets of one source count once (largest share). ``reached_share`` is the source's share of the tokens chosen.

    Only (source, length) counts leave the executors' groups, one group per source for the knapsack; the documents of a
    length are ranked in parts by a hash, one for each ``docs_per_salt`` documents of all, so that a length that a third of
    the documents have is no single task.
    """
    model.utc(counted.sparkSession)
    t = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy(source_key().alias("source"))
    t = t.agg(F.max("target_share").alias("target_share"), F.max_by("max_repeats", "target_share").alias("max_repeats"))
    t = model.broadcast_if_small(t)
    docs = counted.where("doc_id is not null and n_tokens > 0").join(t.select("source"), "source", "left_semi")
    salts = max(1, math.ceil(counted.count() / docs_per_salt))
    docs = docs.withColumn("order__", F.xxhash64(F.lit(seed), "doc_id")).withColumn("salt__", F.pmod("order__", F.lit(salts)))
    by_salt = docs.groupBy("source", "n_tokens", "salt__").agg(F.count("*").alias("docs"))
    counts = by_salt.groupBy("source", "n_tokens").agg(F.sum("docs").alias("docs"))
    sizes = {r["source"]: r["s"] for r in counts.groupBy("source").agg(F.sum(F.col("docs") * F.col("n_tokens")).alias("s")).collect()}
    wanted = {r["source"]: (r["target_share"], r["max_repeats"]) for r in t.collect()}
    budgets = plan_budgets(sizes, wanted, total)

    def plan(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("n_tokens")
        whole, rest = divmod(budgets[key[0]], sizes[key[0]])
        more = fit_subset(g["n_tokens"].to_numpy(), g["docs"].to_numpy(), int(rest)) if rest else np.zeros(len(g), dtype=np.int64)
        return pd.DataFrame({"source": key[0], "n_tokens": g["n_tokens"].to_numpy(), "whole": whole, "more": more, "docs": g["docs"].to_numpy()})

    chosen = counts.groupBy("source").applyInPandas(plan, "source string, n_tokens long, whole long, more long, docs long")
    reached = {r["source"]: r["s"] for r in chosen.groupBy("source").agg(F.sum(F.expr("(whole * docs + more) * n_tokens")).alias("s")).collect()}
    everything = max(1, sum(reached.values()))
    spark = counted.sparkSession
    shares = spark.createDataFrame([(s, wanted[s][0], reached.get(s, 0) / everything) for s in wanted] or [("", 0.0, 0.0)], "source string, target_share double, reached_share double")

    w = W.partitionBy("source", "n_tokens").orderBy("salt__").rowsBetween(W.unboundedPreceding, -1)
    quota = by_salt.withColumn("before", F.coalesce(F.sum("docs").over(w), F.lit(0))).join(chosen.drop("docs"), ["source", "n_tokens"])
    quota = quota.select("source", "n_tokens", "salt__", "whole", F.greatest(F.lit(0), F.least("docs", F.col("more") - F.col("before"))).alias("quota"))
    ranked = docs.join(quota, ["source", "n_tokens", "salt__"])
    rank = F.row_number().over(W.partitionBy("source", "n_tokens", "salt__").orderBy("order__", "doc_id"))
    used = ranked.withColumn("copies", F.col("whole") + F.when(rank <= F.col("quota"), 1).otherwise(0)).where("copies > 0")
    return used.join(model.broadcast_if_small(shares), "source").select("doc_id", "source", "n_tokens", "copies", "target_share", "reached_share")
