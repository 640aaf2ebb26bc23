"""Filling containers of fixed capacity with items, never splitting one that fits.

Only the number of items of each length, at most one entry a length up to the capacity, reaches the driver. It is
packed there by exact complements into patterns with multiplicities; items then find their place by their exact
position among items of equal length. So the plan of packing doesn't grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialize, running_positions

#: Largest capacity for which a histogram of lengths is packed on the driver; its plan then takes about ten seconds.
MAX_CAPACITY = 1 << 17


@dataclass
class Plan:
    """Patterns of lengths that fill containers, each with its number of containers."""

    capacity: int
    patterns: list[tuple[tuple[int, ...], int]] = field(default_factory=list)

    @property
    def containers(self) -> int:
        return sum(m for _, m in self.patterns)

    def slots(self) -> dict[int, list[tuple[int, int, int]]]:
        """Per length the runs of its items in order: (first position, first container, items a container)."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        filled: dict[int, int] = {}
        base = 0
        for pattern, times in self.patterns:
            lengths, per = np.unique(np.array(pattern), return_counts=True)
            for s, k in zip(lengths.tolist(), per.tolist()):
                out.setdefault(s, []).append((filled.get(s, 0), base, k))
                filled[s] = filled.get(s, 0) + k * times
            base += times
        return out


class _Sums:
    """Which sums single, pair and triple lengths still available can make; refreshed when an entry proves stale."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.refresh()

    def refresh(self) -> None:
        have = (self.counts > 0).astype(np.float64)
        size = len(have)
        n = 1 << (2 * size - 1).bit_length()
        f = np.fft.rfft(have, n)
        pairs = np.fft.irfft(f * f, n)[:size] > 0.5
        self.pairs = pairs
        self.triples = np.fft.irfft(np.fft.rfft(pairs.astype(np.float64), n) * f, n)[:size] > 0.5

    def _pair(self, gap: int) -> tuple[int, int] | None:
        c = self.counts
        b = np.arange(gap // 2 + 1, gap) if gap > 1 else np.arange(0)
        ok = np.flatnonzero((c[b] > 0) & (c[gap - b] > 0))
        if len(ok):
            return int(b[ok[-1]]), int(gap - b[ok[-1]])
        half = gap // 2
        return (half, half) if gap % 2 == 0 and half > 0 and c[half] > 1 else None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that make ``gap`` exactly, the fewest, the longest first."""
        c = self.counts
        if gap <= 0 or gap >= len(c):
            return None
        if c[gap] > 0:
            return (gap,)
        if self.pairs[gap]:
            if (found := self._pair(gap)) is not None:
                return found
            self.refresh()
        if self.triples[gap]:
            for a in np.flatnonzero((c[:gap] > 0) & self.pairs[gap:0:-1])[::-1].tolist():
                c[a] -= 1
                found = self._pair(gap - a)
                c[a] += 1
                if found is not None:
                    return (a, *found)
            self.refresh()
        return None


def plan_packing(histogram: dict[int, int], capacity: int) -> Plan:
    """Patterns for ``histogram`` (length -> items, lengths from 1 to ``capacity``).

    From the longest length down, an exact complement of one, two or three lengths is sought in the index of sums and
    used as often as the available counts allow; what has no exact complement is then filled best-fit. Every step
    uses up a length for good, so there are at most twice as many patterns as lengths.
    """
    if any(not 1 <= s <= capacity for s in histogram):
        raise ValueError("lengths must lie between 1 and the capacity")
    counts = np.zeros(capacity + 1, np.int64)
    for s, n in histogram.items():
        counts[s] += n
    plan = Plan(capacity)

    def use(pattern: tuple[int, ...]) -> None:
        lengths, per = np.unique(np.array(pattern), return_counts=True)
        times = int((counts[lengths] // per).min())
        counts[lengths] -= times * per
        plan.patterns.append((pattern, times))

    sums = _Sums(counts)
    residual: list[int] = []
    for s in np.flatnonzero(counts)[::-1].tolist():
        while counts[s] > 0:
            if s == capacity:
                use((s,))
                continue
            counts[s] -= 1
            found = sums.exact(capacity - s)
            counts[s] += 1
            if found is None:
                residual.append(s)
                break
            use((s, *found))
    while (left := np.flatnonzero(counts)).size:
        s = int(left[-1])
        counts[s] -= 1
        pattern, gap = [s], capacity - s
        while gap > 0 and (fit := np.flatnonzero(counts[: gap + 1])).size:
            best = int(fit[-1])
            k = int(min(counts[best], gap // best))
            counts[best] -= k
            pattern += [best] * k
            gap -= k * best
        for x in pattern:
            counts[x] += 1
        use(tuple(pattern))
    return plan


_PLACES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("n_pieces", T.IntegerType()),
    T.StructField("size", T.LongType()), T.StructField("container_no", T.LongType()),
])


def _place(slots: dict[int, list[tuple[int, int, int]]], base: int):
    table = {s: tuple(np.array(c, np.int64) for c in zip(*runs)) for s, runs in slots.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column(3).to_numpy(zero_copy_only=False)
            pos = b.column(4).to_numpy(zero_copy_only=False)
            out = np.zeros(len(size), np.int64)
            for s in np.unique(size).tolist():
                first, container, per = table[s]
                rows = np.flatnonzero(size == s)
                at = np.searchsorted(first, pos[rows], side="right") - 1
                out[rows] = base + container[at] + (pos[rows] - first[at]) // per[at]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out)], names=_PLACES.fieldNames())

    return run


def pack(sizes: DataFrame, capacity: int, name: str = "pack") -> DataFrame:
    """Containers for the items of ``sizes`` (doc_id, n_tokens): one row per piece.

    Columns: ``doc_id``, ``piece`` (from 0), ``n_pieces``, ``size``, ``container_no``. An item above the capacity is
    cut into full containers and one rest; no other item is split. Items of size 0, negative or null take no room and
    have a null ``container_no``. Repeated rows are separate items. ``sizes`` should be materialised (it is read twice).
    """
    if not 1 <= capacity <= MAX_CAPACITY:
        raise ValueError(f"capacity must lie between 1 and {MAX_CAPACITY}")
    n = F.greatest(F.coalesce(F.col("n_tokens"), F.lit(0)), F.lit(0))
    pieces = F.greatest(F.ceil(n / F.lit(capacity)), F.lit(1)).cast("int")
    items = sizes.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n"), pieces.alias("n_pieces"))
    rest = items.select(
        "doc_id", (F.col("n_pieces") - 1).alias("piece"), "n_pieces",
        (F.col("n") - (F.col("n_pieces") - 1) * F.lit(capacity).cast("long")).alias("size"),
    )
    full = items.where(F.col("n_pieces") > 1).select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 2)).alias("piece"), "n_pieces", F.lit(capacity).cast("long").alias("size"))
    parts = full.unionByName(rest)
    # At most one row a length up to the capacity.
    histogram = {r["size"]: r["n"] for r in parts.where("size > 0").groupBy("size").agg(F.count("*").alias("n")).collect()}
    plan = plan_packing(histogram, capacity)
    placed = running_positions(parts.where("size > 0"), ["size"], ["doc_id", "piece"], name)
    placed = placed.select("doc_id", "piece", "n_pieces", "size", "_before").mapInArrow(_place(plan.slots(), 0), _PLACES)
    empty = parts.where("size <= 0").withColumn("container_no", F.lit(None).cast("long"))
    return placed.unionByName(empty)


def fill_report(placed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, unused share and the number of split documents of a packing."""
    used = placed.where(F.col("container_no").isNotNull())
    return used.agg(
        F.coalesce(F.max("container_no") + 1, F.lit(0)).alias("containers"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("tokens"),
        F.count_if((F.col("n_pieces") > 1) & (F.col("piece") == 0)).alias("split_docs"),
    ).withColumn("unused_share", F.when(F.col("containers") > 0, F.round(1 - F.col("tokens") / (F.col("containers") * F.lit(capacity)), 6)).otherwise(0.0))


def pack_documents(docs: DataFrame, capacity: int, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``pack`` of documents measured in tokens of the vocabulary's tokenizer."""
    from .tokens import VOCABULARY, token_counts

    sizes = materialize(token_counts(docs, {"doc_id": id_col}, text_col, vocabulary or VOCABULARY), "token-sizes")
    return pack(sizes, capacity)
