"""Writers of results: one JSON document, JSON lines, text, CSV."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict, is_dataclass
from datetime import date, datetime
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def plain(value: Any) -> Any:
    """Values as JSON can hold them: rows, dataclasses and models as objects, sets as lists, paths and dates as text."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, (set, frozenset)):
        return sorted((plain(v) for v in value), key=repr)
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, Path):
        return str(value)
    if is_dataclass(value) and not isinstance(value, type):
        return plain(asdict(value))
    if hasattr(value, "model_dump"):
        return plain(value.model_dump())
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    raise TypeError(f"{type(value).__name__} can't be written as JSON")


def _rows(data: DataFrame | Iterable[Any] | Any) -> Iterator[Any]:
    """Rows one partition at a time, never all at once."""
    if isinstance(data, DataFrame):
        yield from map(plain, data.toLocalIterator())
    else:
        yield from map(plain, data if isinstance(data, (list, tuple)) else [data])


def dump_json(data: Any, file: str | Path, indent: int = 2, ensure_ascii: bool = False) -> None:
    """One JSON document in a local file, written row by row for a DataFrame."""
    with open(file, "w", encoding="utf-8") as f:
        if not isinstance(data, DataFrame):
            json.dump(plain(data), f, indent=indent, ensure_ascii=ensure_ascii)
            return
        first = True
        for row in _rows(data):
            body = json.dumps(row, indent=indent, ensure_ascii=ensure_ascii)
            pad = " " * indent
            f.write(("[\n" if first else ",\n") + "\n".join(pad + line for line in body.split("\n")))
            first = False
        f.write("[]" if first else "\n]")


def dump_jsonl(data: Any, file: str | Path, ensure_ascii: bool = False) -> None:
    """One JSON object a line in a local file; a single value is one line."""
    with open(file, "w", encoding="utf-8") as f:
        for row in _rows(data):
            f.write(json.dumps(row, ensure_ascii=ensure_ascii) + "\n")


def dump_txt(text: Any, file: str | Path) -> None:
    Path(file).write_text(str(text), encoding="utf-8")


def dump_csv(rows: list[dict] | DataFrame, file: str | Path) -> None:
    """A local CSV file with the columns of all rows in order of first appearance, missing ones empty; no rows, no file."""
    import csv

    found = list(_rows(rows)) if not isinstance(rows, DataFrame) else None
    source: Iterable[dict] = found if found is not None else _rows(rows)
    names = list(dict.fromkeys(k for r in found for k in r)) if found is not None else rows.columns
    f = writer = None
    try:
        for r in source:
            if writer is None:
                f = open(file, "w", encoding="utf-8", newline="")  # noqa: SIM115
                writer = csv.DictWriter(f, fieldnames=names, restval="")
                writer.writeheader()
            writer.writerow({k: "" if v is None else v for k, v in r.items()})
    finally:
        if f is not None:
            f.close()


def union_keys(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames with the columns of any, missing ones as empty strings."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return both.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in both.columns])


def write_jsonl(df: DataFrame, path: str) -> None:
    """Distributed JSON lines, nulls kept, earlier output replaced."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Distributed CSV with a header; nothing is written for no rows."""
    if not df.isEmpty():
        df.write.mode("overwrite").option("header", True).csv(path)


def print_jsonl(df: DataFrame) -> None:
    """JSON lines on standard output, ASCII only, as partitions come in."""
    for row in _rows(df):
        print(json.dumps(row))
