"""Shared-folder materialisation, size-checked broadcasts and distributed positions.

Lineage is cut by writing a table into the folder that the cluster names in ``spark.checkpoint.dir``;
executors may be lost afterwards without losing rows. Nothing here uses a local checkpoint.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows up to which a materialised side is broadcast (at most a few dozen bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 100_000

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in local mode where none is configured."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="gleanframe-")
    return "file://" + _own_dir


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, unless they see the same files."""
    sc = spark.sparkContext
    if getattr(sc, "_gleanframe_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="gleanframe-code-")) / "gleanframe.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._gleanframe_shipped = True


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone; the folder is then the cluster's to clean
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/gleanframe-{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back, so that later jobs don't repeat its work."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_or_plain(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already materialised) with a broadcast hint if it has at most ``max_rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def _sorted_positions(group: Sequence[str], weight: str | None, schema: pa.Schema):
    """Partition-local running sums of ``weight`` within contiguous groups; carries state over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last, carry = None, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            w = np.ones(n, np.int64) if weight is None else b.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            change = np.zeros(n, bool)
            for g in group:
                codes = b.column(g).dictionary_encode().indices
                c = codes.fill_null(-1).to_numpy(zero_copy_only=False)
                change[1:] |= c[1:] != c[:-1]
            first = tuple(b.column(g)[0].as_py() for g in group)
            run_start = np.maximum.accumulate(np.where(change, np.arange(n), 0))
            total = np.cumsum(w)
            before = total - w
            local = before - before[run_start]
            if last is not None and first == last:
                head = run_start == 0
                local[head] += carry
            out = local + w
            last, carry = tuple(b.column(g)[n - 1].as_py() for g in group), int(out[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, pid, np.int32)), pa.array(local), pa.array(w)], schema=schema)

    return run


def running_positions(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, weight: str | None = None) -> DataFrame:
    """Exact running position of each row within its group, for groups of any size.

    ``df`` must be cheap to read (materialised): it is range-partitioned by group and order, each partition
    sums locally, and the partitions' offsets are added afterwards. A group that holds most rows is spread
    over many partitions; no task sees more than its range. Adds ``_before`` (sum of ``weight``, or row count,
    of all rows ahead of this one in its group) and ``_total`` (the group's sum). Null group values form a group.
    ``order`` should make rows distinct, or positions among equal rows are arbitrary but still a permutation.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = df.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
    fields = [*df.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_local", T.LongType()), T.StructField("_w", T.LongType())]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    local = materialize(ordered.mapInArrow(_sorted_positions(list(group), weight, to_arrow_schema(schema)), schema), name)
    sums = local.groupBy(*group, "_pid").agg(F.sum("_w").alias("_sum"))
    ahead = Window.partitionBy(*group).orderBy("_pid")
    offsets = sums.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_pid").alias("_p"),
        (F.sum("_sum").over(ahead) - F.col("_sum")).alias("_offset"),
        F.sum("_sum").over(Window.partitionBy(*group)).alias("_total"),
    )
    offsets = small_or_plain(materialize(offsets, name + "-offsets"))
    on = F.col("_pid") == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = local.join(offsets, on)
    return joined.withColumn("_before", F.col("_local") + F.col("_offset")).drop("_pid", "_p", "_local", "_w", "_offset", *[f"_g{i}" for i in range(len(group))])
