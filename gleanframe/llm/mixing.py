"""Mixing sources to target shares of the total size by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import materialize
from .repeats import site_of
from .tokens import VOCABULARY, token_counts

#: Tokens of a block: the unit in which sources are given their shares.
BLOCK_TOKENS = 256
#: Tokens of a shard of one source, the unit of work of one task; shards grow once there are MAX_SHARDS of them.
SHARD_TOKENS = 64_000_000
MAX_SHARDS = 4096
#: Most rows of the table of targets; it is a setting, not data.
MAX_TARGETS = 100_000


def apportion(weights: Sequence[float], caps: Sequence[int], seats: int) -> list[int]:
    """Sainte-Laguë quotas: seats go to the highest quotients weight/(2k+1), no one gets more than its cap.

    Ties go to the earlier entry. All quotas are found by one divisor, up to ties and rounding, so the time doesn't
    depend on the number of seats. Entries without weight get nothing; if all caps are reached, seats stay free.
    """
    w, cap = np.asarray(weights, float), np.asarray(caps, np.int64)
    cap = np.where(w > 0, np.maximum(cap, 0), 0)
    seats = int(min(seats, cap.sum()))
    if seats <= 0:
        return [0] * len(w)
    low, high = 0.0, float(w.max()) * 4  # divisors: too small gives too many seats
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        got = np.minimum(cap, np.floor(w / mid + 0.5))
        low, high = (low, mid) if got.sum() <= seats else (mid, high)
    quota = np.minimum(cap, np.floor(w / high + 0.5)).astype(np.int64)
    # Some seats may be left to ties at the divisor: they go one by one, at most one round of the entries.
    heap = [(-w[i] / (2 * int(quota[i]) + 1), i) for i in range(len(w)) if quota[i] < cap[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(quota.sum())):
        _, i = heapq.heappop(heap)
        quota[i] += 1
        if quota[i] < cap[i]:
            heapq.heappush(heap, (-w[i] / (2 * int(quota[i]) + 1), i))
    return quota.tolist()


def read_targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """source -> (weight, max_repeats); rows without source, weight or repeats are left out, equal sources add up."""
    rows = targets.select("source", "weight", "max_repeats").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    out: dict[str, tuple[float, int]] = {}
    for source, weight, repeats in rows:
        if source and weight and weight > 0 and repeats and repeats > 0:
            w, r = out.get(source, (0.0, 0))
            out[source] = (w + weight, max(r, repeats))
    return out


def block_quotas(held: dict[str, int], wanted: dict[str, tuple[float, int]], total: int, block_tokens: int = BLOCK_TOKENS) -> dict[str, int]:
    """Blocks of each source: ``held`` tokens by source, ``wanted`` weights and repeats, ``total`` tokens to give out."""
    names = sorted(s for s in held if s in wanted and held[s] > 0)
    caps = [-(-wanted[s][1] * held[s] // block_tokens) for s in names]
    return dict(zip(names, apportion([wanted[s][0] for s in names], caps, int(total / block_tokens + 0.5))))


def attainable_shares(held: dict[str, int], wanted: dict[str, tuple[float, int]], total: int) -> dict[str, float]:
    """The shares of a mixture without rounding: in proportion to the weights, but no source above its repeats."""
    left, out = float(total), dict.fromkeys(wanted, 0.0)
    open_ = {s for s in wanted if held.get(s, 0) > 0}
    while open_:
        unit = left / sum(wanted[s][0] for s in open_)
        full = {s for s in open_ if wanted[s][1] * held[s] <= unit * wanted[s][0]}
        for s in full or open_:
            out[s] = float(wanted[s][1] * held[s]) if full else unit * wanted[s][0]
            left -= out[s]
        open_ = open_ - full if full else set()
    reached = sum(out.values())
    return {s: x / reached if reached else 0.0 for s, x in out.items()}


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", url_col: str = "url", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The documents of a mixture: ``doc_id``, ``source``, ``n_tokens``, ``copies`` (at least 1).

    ``source`` is the document's own or, where null, the host of its url. The mixture has about ``total_tokens`` (by
    default what the targeted sources hold). Each source's documents, in seeded order within its shards, are a row of
    tokens cut into blocks of ``block_tokens``. Blocks are the seats: they go to sources by weight up to ``max_repeats``
    times what they hold, then to a source's shards by their tokens. A shard's quota of blocks is as many whole rounds
    of its documents as fit, and from the beginning of the row the documents whose middle lies in the blocks that are
    left: so a shard is off its quota by half a document at most. Sources without target, targets without documents,
    texts without tokens and null texts give no rows. Repeated rows are separate documents. No step holds more than a
    shard's narrow rows in order; one source may hold any share of all documents.
    """
    wanted = read_targets(targets)
    spark = docs.sparkSession
    sizes = token_counts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), site_of(F.col(source_col), F.col(url_col)).alias("source")), {"doc_id": "doc_id", "source": "source"}, "text", vocabulary)
    sizes = materialize(sizes.where(F.col("n_tokens") > 0), "mix-sizes")
    goal = spark.createDataFrame([(s, w, r) for s, (w, r) in wanted.items()], "source string, weight double, max_repeats int")
    # At most MAX_TARGETS rows.
    sizes = sizes.join(F.broadcast(goal.select("source")), "source", "left_semi")
    held = {r["source"]: r["t"] for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    total_held = sum(held.values())
    quotas = block_quotas(held, wanted, total_held if total_tokens is None else total_tokens, block_tokens)
    per_shard = max(SHARD_TOKENS, -(-total_held // MAX_SHARDS))
    shards = spark.createDataFrame([(s, max(1, -(-t // per_shard))) for s, t in held.items()], "source string, shards long")
    own = F.xxhash64(F.lit(seed), F.col("doc_id"))
    rows = sizes.join(F.broadcast(shards), "source").withColumn("shard", F.pmod(own, F.col("shards"))).withColumn("at", F.xxhash64(F.lit(seed + 1), F.col("doc_id"))).drop("shards")
    order = Window.partitionBy("source", "shard").orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = materialize(rows.withColumn("end", F.sum("n_tokens").over(order)).select("doc_id", "source", "shard", "n_tokens", "end"), "mix-places")
    # One row a shard: at most MAX_SHARDS and the number of targets.
    per = placed.groupBy("source", "shard").agg(F.max("end").alias("tokens")).orderBy("source", "shard").collect()
    by_source: dict[str, list] = {}
    for r in per:
        by_source.setdefault(r["source"], []).append(r)
    plan = []
    for s, own_shards in by_source.items():
        caps = [-(-r["tokens"] * wanted[s][1] // block_tokens) for r in own_shards]
        for r, q in zip(own_shards, apportion([float(r["tokens"]) for r in own_shards], caps, quotas[s])):
            given = min(q * block_tokens, r["tokens"] * wanted[s][1])
            plan.append((s, r["shard"], given // r["tokens"], given % r["tokens"]))
    quota = F.broadcast(spark.createDataFrame(plan, "source string, shard long, rounds long, rest long"))
    extra = (F.col("end") - F.col("n_tokens") / 2 < F.col("rest")).cast("int")
    rows = placed.join(quota, ["source", "shard"]).select("doc_id", "source", "n_tokens", (F.col("rounds") + extra).cast("int").alias("copies"))
    return rows.where(F.col("copies") > 0)


def mix_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """What a mixture reached: per target ``source``, ``weight``, ``max_repeats``, ``docs``, ``tokens`` (with copies), ``share``, ``most_copies``."""
    wanted = read_targets(targets)
    spark = mixed.sparkSession
    goal = spark.createDataFrame([(s, w, r) for s, (w, r) in wanted.items()], "source string, weight double, max_repeats int")
    reached = mixed.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    # One row a target on both sides.
    joined = goal.join(reached, "source", "left").na.fill(0, ["docs", "tokens", "most_copies"])
    total = F.sum("tokens").over(Window.partitionBy())
    return joined.select("source", "weight", "max_repeats", "docs", "tokens", F.when(total > 0, F.round(F.col("tokens") / total, 6)).otherwise(0.0).alias("share"), "most_copies")
