"""Sources: the corpus of pages as the web, bodies as bytes, and a Python data source over a fetcher."""

from __future__ import annotations

import gzip
import io
import time
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Most bytes a compressed body may unfold to.
MAX_UNZIPPED = 50 * 1024 * 1024


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def decode_text(body: Column) -> Column:
    """UTF-8 without its mark, else Latin-1."""
    text = F.try_validate_utf8(body.cast("string"))
    return F.regexp_replace(F.coalesce(text, F.decode(body, "ISO-8859-1")), "^\\ufeff", "")


def unzip(data: bytes | None, limit: int = MAX_UNZIPPED) -> bytes | None:
    """The unfolded bytes; the bytes as they are if they aren't gzip or unfold to more than ``limit``."""
    if data is None:
        return None
    try:
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
            out = f.read(limit + 1)
    except (OSError, EOFError, zlib.error):
        return data
    return data if len(out) > limit else out


def unzipped(rows: DataFrame, url_col: str = "url", body_col: str = "body", encoding_col: str | None = None) -> DataFrame:
    """(url, body) with bodies unfolded whose address ends in ``.gz`` or whose content encoding is gzip."""
    packed = F.lower(url_col).endswith(".gz") if encoding_col is None else F.lower(url_col).endswith(".gz") | (F.lower(F.coalesce(encoding_col, F.lit(""))) == "gzip")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([unzip(x) for x in b.column(1).to_pylist()], pa.binary())], names=["url", "body"])

    picked = rows.select(F.col(url_col).alias("url"), F.col(body_col).alias("body"), packed.alias("packed"))
    return picked.where("packed").select("url", "body").mapInArrow(run, "url string, body binary").unionByName(picked.where("packed IS NULL OR NOT packed").select("url", "body"))


def fetch(queue: DataFrame, corpus: DataFrame, url_col: str = "url", payload: str = "html") -> DataFrame:
    """(url, payload) of the addresses that the corpus holds; the others are misses and drop out. Repeats repeat."""
    held = corpus.select(F.col("url").alias("_url"), F.col(payload))
    return queue.select(F.col(url_col).alias("url")).join(held, F.col("url") == F.col("_url")).select("url", payload)


def misses(queue: DataFrame, corpus: DataFrame, url_col: str = "url") -> DataFrame:
    """Addresses that the corpus doesn't hold; null ones among them."""
    held = corpus.select(F.col("url").alias("_url"))
    return queue.select(F.col(url_col).alias("url")).join(held, F.col("url") == F.col("_url"), "left_anti")


class Response(NamedTuple):
    """What a fetcher may give instead of bytes: a status, the body, and the encoding the server names for it."""

    status: int
    body: bytes | None = None
    encoding: str | None = None


Fetcher = Callable[[str], "bytes | Response | None"]


def get(url: str, fetcher: Fetcher, retries: int = 2, delay: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> bytes | None:
    """The body of an address, or None.

    Status 200 gives the body, unfolded if the address ends in ``.gz`` or the encoding is gzip; 404 gives None at once;
    any other status, and any error, is tried again, ``retries`` times in all, after ``delay`` seconds, twice that, and
    so on. A fetcher that gives bytes or None means 200 or 404.
    """
    for attempt in range(1, max(1, retries) + 1):
        try:
            found = fetcher(url)
            if not isinstance(found, Response):
                found = Response(404 if found is None else 200, found)
            if found.status == 200:
                body = found.body or b""
                return unzip(body) if url.endswith(".gz") or (found.encoding or "").lower() == "gzip" else body
            if found.status == 404:
                return None
        except Exception:  # any error of the network counts as a try
            pass
        if attempt < max(1, retries):
            sleep(delay * attempt)
    return None


def fetched(queue: DataFrame, fetcher: Fetcher, url_col: str = "url", retries: int = 2, delay: float = 0.0, parts: int | None = None) -> DataFrame:
    """(url, body) of the addresses of ``queue``, fetched where they are; those that give none drop out, null ones too.

    ``parts`` spreads a small queue over that many tasks. Repeated addresses are fetched again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = b.column(0).to_pylist()
            bodies = [get(u, fetcher, retries, delay) for u in urls]
            ok = [i for i, x in enumerate(bodies) if x is not None]
            yield pa.RecordBatch.from_arrays([pa.array([urls[i] for i in ok], pa.string()), pa.array([bodies[i] for i in ok], pa.binary())], names=["url", "body"])

    rows = queue.select(F.col(url_col).alias("url")).where(F.col("url").isNotNull())
    return (rows.repartition(parts) if parts else rows).mapInArrow(run, "url string, body binary")


class _Range(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], fetcher: Fetcher, retries: int, parts: int, delay: float):
        self.urls, self.fetcher, self.retries, self.parts, self.delay = urls, fetcher, retries, parts, delay

    def partitions(self):
        n = max(1, min(self.parts, len(self.urls)))
        return [_Range(self.urls[i::n]) for i in range(n)]

    def read(self, partition):
        for url in partition.urls:
            body = get(url, self.fetcher, self.retries, self.delay)
            if body is not None:
                yield (url, bytes(body))


def fetcher_source(fetcher: Fetcher, name: str = "fetched", retries: int = 2, parts: int = 8, delay: float = 0.0) -> type[DataSource]:
    """A data source class whose rows are (url, body) of the addresses in its ``urls`` option (one a line), by ``get``.

    The option is for the seeds of a person; a table of addresses goes through ``fetched``.
    """

    class Fetched(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "url string, body binary"

        def reader(self, schema) -> DataSourceReader:
            return _Reader([u for u in self.options.get("urls", "").split("\n") if u], fetcher, retries, parts, delay)

    return Fetched
