"""Lines that one site puts into many of its documents: masked, clustered by locality-sensitive hashing, counted, removed."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import site as url_site
from ..runtime import BROADCAST_ROWS, materialize, small_or_plain

#: Documents of one site in which a line must occur to count as repeated.
MIN_DOCS = 5
#: Smallest Jaccard similarity of the shingle sets of two masked lines in one cluster, and the words of a shingle.
SIMILARITY, SHINGLE = 0.8, 5
#: Bands and minima a band: a pair at a similarity of 0.8 meets in one with a probability of 0.986, at 0.84 with 0.995.
BANDS, MINIMA = 6, 3
#: Different lines of one bucket that a task compares at once; in larger buckets HEADS lines are compared with all others first.
GROUP, HEADS = 1000, 64
#: Words of 64 bits in the filter that keeps most lines without partners at home; its size is fixed (8 MB), what it lets pass by chance is joined away.
FILTER_WORDS = 1 << 20
#: Keys of repeated lines (8 bytes each) that are sent to where the texts are.
SENT_KEYS = 500_000
#: Characters of text that a task turns into numbers at a time; a longer text is one chunk.
CHUNK = 1_000_000


def site_of(source: Column, url: Column) -> Column:
    """``source``, or the host of ``url`` where that is null or blank; null where neither tells a site."""
    own = F.trim(source)
    return F.coalesce(F.when(own != "", own), url_site(url))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, url_col: str) -> DataFrame:
    site = site_of(F.col(source_col), F.col(url_col))
    rows = docs.where(site.isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(site).alias("site"), F.col(text_col).alias("text"))


def _mix(x: np.ndarray) -> np.ndarray:
    """A well-spread permutation of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _orders(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@functools.cache
def _alphabet() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point up to 0xFFFF: its kind (1 letter or mark, 2 capital, 3 line break), its form without case, and a
    random number for that form."""
    kind, plain = np.zeros(1 << 16, np.uint8), np.arange(1 << 16, dtype=np.uint16)
    for cp in range(1 << 16):
        c = chr(cp)
        category = unicodedata.category(c)
        if category[0] in "LM":
            kind[cp] = 2 if category in ("Lu", "Lt") else 1
            if len(low := c.upper().lower()) == 1:
                plain[cp] = ord(low)
    kind[10] = 3
    return kind, plain, _mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[plain]


_EXPANDED = re.compile("[ßŉǰΐΰևẖẗẘẙẚﬀ-ﬆﬓ-ﬗ]")


def _points(texts: list[str]) -> np.ndarray:
    """Code points of the texts, a line break after each. Letters whose capitals are several letters are written so;
    those beyond 0xFFFF are folded into the private area, letters among them as letters."""
    joined = "\n".join(texts) + "\n"
    joined = _EXPANDED.sub(lambda m: m[0].upper().lower(), joined)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if points.max(initial=0) > 0xFFFF:
        points = points.copy()
        for cp in np.unique(points[points > 0xFFFF]).tolist():
            letter = unicodedata.category(chr(cp))[0] in "LM"
            # Letters of the plane of rare ideographs stand for them, two or three of which may then look alike.
            points[points == cp] = 0x3400 + (ord(chr(cp).lower()) & 0x3FFF) if letter else 0x20
    return points.astype(np.uint16)


def _runs(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of equal numbers, and each place's distance from its run's start."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    return starts, np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))


def _orderly(numbers: np.ndarray, starts: np.ndarray, places: np.ndarray, seed: int) -> np.ndarray:
    """One hash a run, in which the order of its numbers counts."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    by_place = _mix(np.arange(1, int(places.max()) + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)
    return _mix(np.add.reduceat(numbers * by_place[places], starts))


class Lines:
    """The lines of some texts, all at once: ``doc`` and ``place`` of each, ``key`` (a hash of its site and letters,
    case aside; ``has`` tells where there are letters), ``line`` (of its masked words: numbers, dates, signs and
    capitalised words, which are names, left out; a line of one masked word or none stands for itself), and the hashes
    ``words`` of all masked words with their number a line, ``sizes``."""

    def __init__(self, texts: list[str], sites: np.ndarray):
        points = _points(texts)
        kinds, _, random = _alphabet()
        kind = kinds[points]
        broken = kind == 3
        line_of = np.cumsum(broken) - broken
        n = int(line_of[-1]) + 1 if len(line_of) else 0
        per = np.array([t.count("\n") + 1 for t in texts], np.int64)
        self.doc = np.repeat(np.arange(len(texts)), per)
        self.per, self.place = per, np.arange(n) - np.repeat(np.cumsum(per) - per, per)
        site = sites.view(np.uint64)[self.doc]
        at = np.flatnonzero((kind == 1) | (kind == 2))
        numbers, of = random[points[at]], line_of[at]
        starts, places = _runs(of)
        self.key, self.has = np.zeros(n, np.uint64), np.zeros(n, bool)
        self.has[of[starts]] = True
        self.key[of[starts]] = _mix(_orderly(numbers, starts, places, 1) + site[of[starts]])
        starts, places = _runs(at - np.arange(len(at)))  # letters in a row
        words = _orderly(numbers, starts, places, 2)
        common = kind[at[starts]] == 1
        self.words, of = words[common], of[starts][common]
        self.sizes = np.bincount(of, minlength=n)
        starts, places = _runs(of)
        self.line = self.key.copy()
        masked = _mix(_orderly(self.words, starts, places, 3) + site[of[starts]])
        several = self.sizes[of[starts]] > 1
        self.line[of[starts][several]] = masked[several]
        self.site = site

    def shingles(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of SHINGLE words in a row of the lines numbered ``which`` (each of SHINGLE words at least), and how many each has."""
        sizes = self.sizes[which]
        first = (np.cumsum(self.sizes) - self.sizes)[which]
        counts = sizes - SHINGLE + 1
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = np.repeat(first, counts) + inner
        total = np.zeros(len(at), np.uint64)
        for j, p in enumerate(_orders(SHINGLE)):
            total += self.words[at + j] * p
        return _mix(total), counts


def band_buckets(shingles: np.ndarray, counts: np.ndarray, sites: np.ndarray, bands: int) -> np.ndarray:
    """lines x bands: hashes of MINIMA minima each."""
    starts = np.cumsum(counts) - counts
    orders = _orders(SHINGLE + bands * MINIMA)[SHINGLE:]
    out = np.zeros((len(counts), bands), np.uint64)
    for b in range(bands if len(counts) else 0):
        total = sites + np.uint64(b + 1)
        for o in orders[b * MINIMA : (b + 1) * MINIMA]:
            total = _mix(total + np.minimum.reduceat(_mix(shingles ^ o), starts))
        out[:, b] = total
    return out


def _chunks(b: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A batch in parts of about CHUNK characters."""
    texts = b.column(text).to_pylist()
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK or i == len(texts) - 1:
            yield b.slice(start, i + 1 - start), texts[start : i + 1]
            start, size = i + 1, 0


_LONGS = T.ArrayType(T.LongType())
_HASHED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("keys", _LONGS), T.StructField("lines", _LONGS), T.StructField("bands", _LONGS)])


def _lists(values: np.ndarray, sizes: list[int] | np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _hashed(bands: int):
    """Per document its lines' keys and masked lines (null without letters), and the band buckets of each masked line
    of more than SHINGLE words, once a document: BANDS at a time, the line's first place ahead of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, texts in _chunks(batch, 2):
                x = Lines(texts, b.column(1).to_numpy())
                long = np.flatnonzero(x.sizes > SHINGLE)
                order = np.lexsort((x.place[long], x.line[long], x.doc[long]))
                once = np.ones(len(long), bool)
                once[1:] = (x.line[long][order][1:] != x.line[long][order][:-1]) | (x.doc[long][order][1:] != x.doc[long][order][:-1])
                long = np.sort(long[order[once]])
                found = band_buckets(*x.shingles(long), x.site[long], bands).view(np.int64)
                flat = np.concatenate([x.place[long][:, None], found], axis=1)
                columns = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(x.per)]).astype(np.int32)), pa.array(v.view(np.int64), mask=~x.has)) for v in (x.key, x.line)]
                per = np.bincount(x.doc[long], minlength=b.num_rows) * (bands + 1)
                yield pa.RecordBatch.from_arrays([b.column(0), *columns, _lists(flat.reshape(-1), per)], names=_HASHED.fieldNames())

    return run


def _banded(b: pa.RecordBatch, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line with bands in a batch of _HASHED: its key, its masked line, its buckets."""
    flat = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, bands + 1)
    starts = b.column(2).offsets.to_numpy()
    per = np.diff(b.column(3).offsets.to_numpy()) // (bands + 1)
    at = np.repeat(starts[:-1] - starts[0], per) + flat[:, 0]
    keys, lines = (b.column(c).flatten().fill_null(0).to_numpy(zero_copy_only=False)[at] if len(at) else np.zeros(0, np.int64) for c in (1, 2))
    return keys, lines, flat[:, 1:]


def _buckets(bands: int):
    """(bucket, tag): every band bucket with 32 bits of the line in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, lines, found = _banded(b, bands)
            yield pa.RecordBatch.from_arrays([pa.array(found.reshape(-1)), pa.array(np.repeat((lines >> 16).astype(np.int32), bands))], names=["bucket", "tag"])

    return run


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_WORDS words in which each of the ``ids`` (long) has set one bit; built where the ids are."""
    x = ids.toDF("id").select(F.shiftrightunsigned(F.col("id"), 7).alias("id"))
    bits = x.groupBy((F.shiftrightunsigned("id", 6) % F.lit(FILTER_WORDS)).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(id % 64 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_WORDS, np.uint64)
    out[bits.column("w").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    return out


def _may_be_in(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    x = ids.view(np.uint64) >> np.uint64(7)
    return (bits[(x >> np.uint64(6)) % np.uint64(FILTER_WORDS)] >> (x & np.uint64(63))) & np.uint64(1) != 0


def _members(bands: int, bits: np.ndarray):
    """(bucket, line, key) in the buckets of the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, lines, found = _banded(b, bands)
            line, band = np.nonzero(_may_be_in(found.reshape(-1), bits).reshape(found.shape))
            yield pa.RecordBatch.from_arrays([pa.array(found[line, band]), pa.array(lines[line]), pa.array(keys[line])], names=["bucket", "line", "key"])

    return run


def _shingled(bits: np.ndarray):
    """(line, shingles) of the masked lines of the filter; each once a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, texts in _chunks(batch, 1):
                x = Lines(texts, b.column(0).to_numpy())
                long = np.flatnonzero(x.sizes > SHINGLE)
                hit = long[_may_be_in(x.line[long].view(np.int64), bits)]
                lines, first = np.unique(x.line[hit], return_index=True)
                shingles, counts = x.shingles(hit[first])
                yield pa.RecordBatch.from_arrays([pa.array(lines.view(np.int64)), _lists(shingles.view(np.int64), counts)], names=["line", "shingles"])

    return run


#: A line's side in a bucket whose lines are all compared; lines of side 0 are compared with those of side 1 only.
BOTH = 2


def _joined(similarity: float):
    """(a, b) keys of similar lines of a bucket, one link for each two parts they join; rows come by bucket.

    A line is compared with each earlier one until they are known to hang together, by a link or by the cluster they
    were given, so nothing is missed, and equal or similar lines cost one comparison each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []
        for batch in batches:
            a, b = [], []
            for bucket, key, cluster, side, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != last:
                    last, parts = bucket, []
                own, apart = set(shingles), []
                names: set[int] = set() if cluster is None else {cluster}
                mine: list[tuple[int, int, set[int]]] = [(key, side, own)]
                for others, part in parts:
                    near = cluster in others
                    for other_key, other_side, other in () if near else part:
                        if side != other_side or side == BOTH:
                            common = len(own & other)
                            if common >= similarity * (len(own) + len(other) - common):
                                a.append(key)
                                b.append(other_key)
                                near = True
                                break
                    if near:
                        names = names | others
                        mine = part + mine if len(part) >= len(mine) else mine + part
                    else:
                        apart.append((others, part))
                parts = [*apart, (names, mine)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _similar(similarity: float):
    common = F.size(F.array_intersect("shingles", "_head"))
    return common >= F.lit(similarity) * (F.size(F.array_distinct("shingles")) + F.size(F.array_distinct("_head")) - common)


def _rare(lines: DataFrame, similarity: float) -> DataFrame:
    """(bucket, line, key, cluster) in buckets of one shingle each: every two similar lines of a bucket share one.

    Two sets with a similarity of t share t of the larger at least, so, in any order that is the same for both, one of
    the first n - ceil(t n) + 1 of each. The rarest in the bucket go first, so few lines meet that aren't similar.
    """
    tokens = materialize(lines.select("bucket", "line", F.explode(F.array_distinct("shingles")).alias("token")), "bucket-shingles")
    counts = tokens.groupBy("bucket", "token").agg(F.count("*").alias("c"))
    listed = tokens.join(counts, ["bucket", "token"]).groupBy("bucket", "line").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("t"))
    n = F.size("t")
    first = F.slice("t", F.lit(1), n - F.ceil(F.lit(similarity) * n - F.lit(1e-6)).cast("int") + 1)
    rare = listed.select("bucket", "line", F.explode(first).alias("t")).where("t.c > 1")
    own = lines.select("bucket", "line", "key", "cluster")
    return rare.join(own, ["bucket", "line"]).select(F.xxhash64("bucket", "t.token").alias("bucket"), "line", "key", "cluster")


def _blocks(members: DataFrame) -> DataFrame:
    """(bucket, line, key, cluster, side): members in buckets of two blocks of about GROUP lines each, or of one block,
    so that each two that aren't of one cluster meet. Lines of a cluster that is larger than a block are kept apart."""
    sizes = members.where(F.col("cluster").isNotNull()).groupBy(F.col("bucket").alias("_b"), F.col("cluster").alias("pure")).agg(F.count("*").alias("_n"))
    large = materialize(sizes.where(F.col("_n") > GROUP).select("_b", "pure"), "large-clusters")
    rows = members.join(small_or_plain(large), (F.col("bucket") == F.col("_b")) & (F.col("cluster") == F.col("pure")), "left").drop("_b")
    parts = rows.groupBy("bucket", "pure").agg(F.count("*").alias("_n")).select(F.col("bucket").alias("_b"), F.col("pure").alias("_p"), F.ceil(F.col("_n") / GROUP).alias("_of"))
    parts = materialize(parts, "rare-parts")
    numbered = rows.join(small_or_plain(parts), (F.col("bucket") == F.col("_b")) & F.col("pure").eqNullSafe(F.col("_p")))
    numbered = numbered.select("bucket", "line", "key", "cluster", F.struct("pure", F.pmod(F.xxhash64("line"), F.col("_of")).alias("no")).alias("block"))
    every = parts.select("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_of") - 1)).alias("no"), F.col("_p").alias("pure")).select("_b", F.struct("pure", "no").alias("x"))
    pairs = every.join(every.select(F.col("_b").alias("_c"), F.col("x").alias("y")), (F.col("_b") == F.col("_c")) & (F.col("x") <= F.col("y")))
    pairs = pairs.where(F.col("x.pure").isNull() | ~F.col("x.pure").eqNullSafe(F.col("y.pure"))).select("_b", "x", "y")
    same = F.col("x") == F.col("y")
    sides = pairs.select("_b", "x", "y", F.explode(F.when(same, F.array(F.struct(F.col("x").alias("block"), F.lit(BOTH).alias("side")))).otherwise(F.array(F.struct(F.col("x").alias("block"), F.lit(0).alias("side")), F.struct(F.col("y").alias("block"), F.lit(1).alias("side"))))).alias("s"))
    sides = materialize(sides.select("_b", F.xxhash64("_b", "x", "y").alias("pair"), F.xxhash64("s.block").alias("_block"), "s.side"), "block-pairs")
    met = numbered.withColumn("_own", F.xxhash64("block")).join(small_or_plain(sides), (F.col("bucket") == F.col("_b")) & (F.col("_own") == F.col("_block")))
    return met.select(F.col("pair").alias("bucket"), "line", "key", "cluster", "side")


def _large_links(lines: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Links of similar lines in buckets of any size, as those with HEADS lines of the bucket and all others.

    The first join most lines of a bucket whose lines are all much alike into few clusters. Lines of different
    clusters, or of none, are then compared where they share a rare shingle (``_rare``, ``_blocks``).
    """
    slot = F.pmod(F.xxhash64("line"), F.lit(HEADS)).alias("slot")
    heads = lines.groupBy("bucket", slot).agg(F.max(F.struct("n", "line", "key", "shingles")).alias("h")).select("bucket", F.col("h.key").alias("b"), F.col("h.shingles").alias("_head"))
    near = lines.join(small_or_plain(materialize(heads, "heads"), HEADS * 100), "bucket").where(_similar(similarity)).select(F.col("key").alias("a"), "b")
    near = materialize(near, "near-heads")
    lines = materialize(lines.join(small_or_plain(components(near)), "key", "left").select("bucket", "line", "key", "cluster", "shingles"), "large-lines")
    members = materialize(_rare(lines, similarity), "rare-shingles")
    some = members.groupBy("bucket").agg(F.count("*").alias("_n"), F.count("cluster").alias("_in"), F.min("cluster").alias("_low"), F.max("cluster").alias("_high"))
    some = materialize(some.where((F.col("_n") > 1) & ((F.col("_in") < F.col("_n")) | (F.col("_low") != F.col("_high")))).select("bucket"), "rare-buckets")
    met = _blocks(materialize(members.join(small_or_plain(some), "bucket", "left_semi"), "rare-members"))
    texts = lines.groupBy("line").agg(F.any_value("shingles").alias("shingles"))
    return near, met.join(texts, "line").select("bucket", "line", "key", "cluster", "side", "shingles")


def band_links(rows: DataFrame, hashed: DataFrame, similarity: float, bands: int) -> list[DataFrame]:
    """(a, b) keys of similar lines that share a band bucket, in parts: each two such lines hang together by them.

    Buckets with one line only, nearly all, are counted away by 12 bytes a line and band. Lines of the others are read
    again with their shingles. Buckets of up to GROUP lines are joined whole in one pass over sorted rows (``_joined``),
    larger ones are split so that no two similar lines are parted (``_large_links``).
    """
    seen = hashed.mapInArrow(_buckets(bands), "bucket long, tag int").groupBy("bucket").agg(F.min("tag").alias("low"), F.max("tag").alias("high"))
    hot = materialize(seen.where("low != high").select("bucket"), "hot-buckets")
    members = hashed.mapInArrow(_members(bands, id_filter(hot)), "bucket long, line long, key long")
    members = members.groupBy("bucket", "line").agg(F.min("key").alias("key"), F.count("*").alias("n")).join(small_or_plain(hot), "bucket", "left_semi")
    members = materialize(members, "bucket-members")
    wanted = materialize(members.select("line").distinct(), "bucket-lines")
    texts = rows.select("site", "text").mapInArrow(_shingled(id_filter(wanted)), T.StructType([T.StructField("line", T.LongType()), T.StructField("shingles", _LONGS)]))
    texts = texts.groupBy("line").agg(F.any_value("shingles").alias("shingles")).join(small_or_plain(wanted), "line", "left_semi")
    lines = materialize(members.join(texts, "line"), "band-lines")
    large = materialize(lines.groupBy("bucket").agg(F.count("*").alias("_n")).where(F.col("_n") > GROUP).select("bucket"), "large-buckets")
    links = []
    whole = lines.withColumns({"cluster": F.lit(None).cast("long"), "side": F.lit(BOTH)})
    parts = [(whole, F.desc("n"))]
    if not large.isEmpty():
        near, met = _large_links(lines.join(small_or_plain(large), "bucket", "left_semi"), similarity)
        links.append(near)
        parts = [(whole.join(small_or_plain(large), "bucket", "left_anti"), F.desc("n")), (met, F.asc("side"))]
    for part, first in parts:
        ordered = part.repartition("bucket").sortWithinPartitions("bucket", first, "line").select("bucket", "key", "cluster", "side", "shingles")
        links.append(ordered.mapInArrow(_joined(similarity), "a long, b long"))
    return links


def components(links: DataFrame) -> DataFrame:
    """(key, cluster) of every key in ``links`` (a, b): the least key reachable from it, by iterated minimum labels."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = materialize(both, "links")
    labels = materialize(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("b")).select("key", F.least("key", "b").alias("cluster")), "labels")
    while True:
        named = small_or_plain(labels)
        least = both.join(named.select(F.col("key").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("key")).agg(F.min("cluster").alias("_near"))
        step = materialize(labels.join(least, "key").select("key", "cluster", F.least("cluster", "_near").alias("_new")), "labels-step")
        # A label's own label is nearer to the least: long chains end in few rounds.
        ahead = small_or_plain(step.select(F.col("key").alias("_new"), F.col("_new").alias("_ahead")))
        moved = materialize(step.join(ahead, "_new").select("key", F.least("_new", "_ahead").alias("cluster"), (F.least("_new", "_ahead") != F.col("cluster")).alias("moved")), "labels-moved")
        labels = moved.select("key", "cluster")
        if moved.where("moved").isEmpty():
            return labels


def clustered_keys(rows: DataFrame, hashed: DataFrame, min_docs: int, similarity: float, bands: int) -> DataFrame:
    """(key, cluster) of the line keys in clusters with at least ``min_docs`` occurrences (documents, each line of them).

    A line is in a cluster with lines of equal letters (its key), with lines that are equal when masked, and with lines
    that are similar (``band_links``); clusters are the components of these links, so they are whole however their
    members spread over buckets. Lines of different sites never meet, since all hashes carry the site.
    """
    pairs = hashed.select(F.explode(F.array_distinct(F.arrays_zip("keys", "lines"))).alias("p")).select("p.keys", "p.lines").toDF("key", "line")
    pairs = materialize(pairs.where(F.col("key").isNotNull()).groupBy("key", "line").agg(F.count("*").alias("n")), "line-pairs")
    firsts = pairs.groupBy("line").agg(F.min("key").alias("b"), F.max("key").alias("_last")).where(F.col("b") != F.col("_last")).select("line", "b")
    same = pairs.join(small_or_plain(materialize(firsts, "masked-firsts")), "line").select(F.col("key").alias("a"), "b")
    joined = small_or_plain(components(functools.reduce(DataFrame.unionByName, [same, *band_links(rows, hashed, similarity, bands)])))
    sums = pairs.groupBy("key").agg(F.sum("n").alias("n"))
    sums = sums.join(joined, "key", "left").select("key", "n", F.coalesce("cluster", "key").alias("cluster"))
    sums = materialize(sums, "key-sums")
    enough = sums.groupBy("cluster").agg(F.sum("n").alias("_n")).where(F.col("_n") >= min_docs).select("cluster")
    return sums.join(small_or_plain(materialize(enough, "frequent-clusters")), "cluster", "left_semi").select("key", "cluster")


def _counted(docs: DataFrame, min_docs: int, similarity: float, bands: int, id_col: str, text_col: str, source_col: str, url_col: str) -> tuple[DataFrame, DataFrame]:
    """Occurrences (doc_id, line_no, key) of lines in frequent clusters, and (key, cluster_docs, line_docs) of their keys."""
    rows = _rows(docs, id_col, text_col, source_col, url_col)
    hashed = materialize(rows.mapInArrow(_hashed(bands), _HASHED), "line-hashes")
    keys = small_or_plain(materialize(clustered_keys(rows, hashed, min_docs, similarity, bands), "clustered-keys"), max_rows=5 * BROADCAST_ROWS)
    lines = hashed.select("doc_id", F.posexplode("keys").alias("line_no", "key")).where(F.col("key").isNotNull())
    found = materialize(lines.join(keys, "key").distinct(), "clustered-lines")
    per_key = found.groupBy("key", "cluster", "doc_id").agg(F.lit(1).alias("one")).groupBy("key", "cluster").agg(F.count("*").alias("line_docs"))
    sizes = found.groupBy("cluster", "doc_id").agg(F.lit(1).alias("one")).groupBy("cluster").agg(F.count("*").alias("cluster_docs"))
    counts = per_key.join(small_or_plain(materialize(sizes, "cluster-docs"), max_rows=5 * BROADCAST_ROWS), "cluster")
    return found.select("doc_id", "line_no", "key"), materialize(counts.select("key", "cluster_docs", "line_docs"), "key-docs")


def line_frequencies(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", url_col: str = "url") -> DataFrame:
    """Every occurrence of a line that belongs to a frequent cluster of its site.

    Columns: ``doc_id``, ``line_no`` (from 0, split at ``\\n``), ``cluster_docs`` (different documents with a line of the
    cluster) and ``line_docs`` (different documents with this very line, letter case, white space, punctuation, symbols
    and digits aside), both exact. Clusters (``clustered_keys``) of less than ``min_docs`` documents may be left out.
    Lines without a letter, null texts, null ids and documents without a site give nothing. Equal rows under one id
    count once. Other columns are ignored.
    """
    found, counts = _counted(docs, min_docs, similarity, bands, id_col, text_col, source_col, url_col)
    return found.join(small_or_plain(counts, max_rows=5 * BROADCAST_ROWS), "key").select("doc_id", "line_no", "cluster_docs", "line_docs")


def repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, **options) -> DataFrame:
    """(doc_id, line_no) of lines that occur in at least ``min_docs`` different documents of the same site."""
    found = line_frequencies(docs, min_docs=min_docs, **options)
    return found.where(F.col("line_docs") >= min_docs).select("doc_id", F.col("line_no").cast("int").alias("line_no"))


def _without(keys: np.ndarray):
    """(doc_id, text, removed): texts without the lines whose keys are in the sorted array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, texts in _chunks(batch, 2):
                x = Lines(texts, b.column(1).to_numpy())
                ids = x.key.view(np.int64)
                gone = x.has & (keys[np.minimum(np.searchsorted(keys, ids), len(keys) - 1)] == ids) if len(keys) else np.zeros(len(ids), bool)
                removed = np.bincount(x.doc[gone], minlength=len(texts))
                starts = np.cumsum(x.per) - x.per
                out = list(texts)
                for d in np.flatnonzero(removed).tolist():
                    drop = gone[starts[d] : starts[d] + x.per[d]]
                    out[d] = "\n".join([s for s, bad in zip(texts[d].split("\n"), drop.tolist()) if not bad])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(removed.astype(np.int32))], names=["doc_id", "text", "removed"])

    return run


def without_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, near: bool = True, **options) -> DataFrame:
    """Each row of ``docs`` as (doc_id, text, removed): the text without its repeated lines, all else as it is.

    With ``near`` a line also goes if its cluster of near-duplicates, not the line alone, reaches ``min_docs``.
    Null texts stay null and rows without id or site stay unchanged (``removed`` is 0). What goes is told by a line's
    key alone: up to SENT_KEYS keys go to where the texts are, so no text moves; more are joined by document.
    """
    given = {"similarity": SIMILARITY, "bands": BANDS, "id_col": "doc_id", "text_col": "text", "source_col": "source", "url_col": "url"} | options
    id_col, text_col = given["id_col"], given["text_col"]
    found, counts = _counted(docs, min_docs, **given)
    bad = counts.where((F.greatest("line_docs", "cluster_docs") if near else F.col("line_docs")) >= min_docs).select("key")
    if bad.limit(SENT_KEYS + 1).count() <= SENT_KEYS:
        keys = np.sort(bad.toArrow().column("key").to_numpy())
        site = site_of(F.col(given["source_col"]), F.col(given["url_col"]))
        read = site.isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()
        rows = _rows(docs, id_col, text_col, given["source_col"], given["url_col"])
        kept = docs.where(~read).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(0).alias("removed"))
        return rows.mapInArrow(_without(keys), "doc_id long, text string, removed int").unionByName(kept)
    gone = found.join(bad, "key").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("line_no").alias("_gone"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(gone, F.col("doc_id") == F.col("_id"), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("_gone", i)), "\n")
    return rows.select("doc_id", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept).alias("text"), F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).alias("removed"))
