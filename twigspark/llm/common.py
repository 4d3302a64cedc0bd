"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twigspark.functions.durable import cut, shared_dir

__all__ = ["cut", "shared_dir"]

#: The characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"

#: Bytes of an Arrow batch between Spark and Python, and rows at most: with texts of thousands of characters, Spark's own limits come to
#: hundreds of MB for the batches of an executor's tasks.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 5000

#: A side of a join is broadcast only if its measured size is at most this many bytes.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches bounded; results don't depend on them."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes of text that one task of a shuffle is to take.
TASK_BYTES = 64 << 20


def parts_for(df: DataFrame, *texts: str) -> int:
    """Partitions for a shuffle of these columns: as many as the session sets, more where the columns measure more than TASK_BYTES a partition."""
    size = df.agg(F.sum(sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)).cast("long") for c in texts), F.lit(16).cast("long")))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


_HELD: dict = {}


def held(key, make: Callable):
    """make(), kept in a worker process for the tasks to come; what other operators kept there goes, and freed memory goes back to the system."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Frees what earlier operators left in this worker: workers live on between stages, and their memory counts against the executor's."""
    import pyarrow as pa

    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once and only where the result is asked for (a lambda variable bound through a one-element array)."""
    return F.transform(F.array(value), body).getItem(0)


def crc_mod(column: Column, n: int) -> Column:
    return F.pmod(F.crc32(column.cast("string")), F.lit(n))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as tell it from the columns of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out
