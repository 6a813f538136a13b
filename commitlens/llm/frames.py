"""Shared plumbing: Arrow mapping in bounded slices, shared-folder tables, id hashing."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows, and bytes of strings, handled at once inside an Arrow batch, so that work arrays stay small whatever the batch
#: size; a longer text is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 256, 8_000_000
#: Bytes of an Arrow batch, about.
BATCH_BYTES = 4 << 20


def arrow_schema(schema: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)


def slices(batch: pa.RecordBatch, rows: int, size: int):
    """batch in slices of at most `rows` rows and, unless one row is longer, `size` bytes of strings."""
    n = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
            n += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    upto, at = np.cumsum(n), 0
    while at < batch.num_rows:
        end = int(np.searchsorted(upto, size + (upto[at - 1] if at else 0), side="right"))
        end = min(at + rows, max(at + 1, end))
        yield batch.slice(at, end - at)
        at = end


def bounded(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes too, where the session names no bound of its own: texts may be long."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Hands freed memory back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(own := ctypes.CDLL(None), "malloc_trim"):
        own.malloc_trim(0)


def map_slices(df: DataFrame, make, schema: str | StructType, slice_rows: int = SLICE_ROWS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """df through fn = make(), called in each task: fn(a slice as slices() cuts them) gives a dict of columns or None.

    A fn with an attribute `end` is asked for end() once its partition is over.
    """
    out = arrow_schema(schema)
    bounded(df.sparkSession)

    def run(batches):
        fn = make()
        for b in batches:
            for part in slices(b, slice_rows, slice_bytes):
                if (got := fn(part)) is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in ((f, got[f.name]) for f in out)], schema=out)
        if hasattr(fn, "end") and (got := fn.end()) is not None:
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)
        del fn
        give_back()

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Whole texts; a null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is named, a local one in local mode, as in tests, and an error on a cluster."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        at = tempfile.mkdtemp(prefix="commitlens-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def written(df: DataFrame) -> DataFrame:
    """df written as a Parquet table of its own in the shared folder, and read back: its lineage is cut there.

    Unlike a checkpoint, the table carries no constraints of the plan that made it, which grow in loops.
    """
    path = os.path.join(shared_dir(df.sparkSession), f"commitlens-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._commitlens_path = path
    return out


#: Small tables between the steps of a loop.
cut = written


def discard(table: DataFrame) -> None:
    """Removes the files of a table that written() made; nothing may read it any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._commitlens_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_text(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def fold(doc_id: Column, n: int) -> Column:
    """crc32(id as text) mod n; a null id counts as empty text."""
    return F.crc32(id_text(doc_id).cast("binary")) % F.lit(n)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def heaviest(df: DataFrame, by: str, n: int) -> DataFrame:
    """At most n rows of largest `by` (whole numbers from 1): all rows beyond a limit that a histogram of fixed size gives, so that no task sorts and none sends more than it must."""
    bucket = F.when(F.col(by) < 4096, F.col(by)).otherwise(4096 + F.floor(F.log2(by) * 64)).cast("long")
    df = df.withColumn("_bucket", bucket)
    left, limit = n, None
    for r in sorted(df.groupBy("_bucket").agg(F.count("*").alias("k")).collect(), key=lambda r: -r._bucket):
        if r.k > left:
            break
        left, limit = left - r.k, r._bucket
    return df.where(F.col("_bucket") >= F.lit(limit)).drop("_bucket")
