"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import materialize, shared_dir  # noqa: F401  re-exported

#: Rows in one Arrow batch. Texts are long, so batches are kept short to bound a Python worker's memory.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KEPT: dict = {}
_USED: set = set()


def kept[T](key: tuple, make: Callable[[], T]) -> T:
    """A large value that a Python worker keeps for later tasks, until one of ``arrow_map`` doesn't use it."""
    _USED.add(key)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def begin(make: Callable[[], Callable[[dict], dict]]) -> Callable[[dict], dict]:
    """``make()``'s function; what it doesn't use of what the worker kept is freed, also to the system."""
    _USED.clear()
    f = make()
    idle = _KEPT.keys() - _USED
    if idle:
        for key in idle:
            del _KEPT[key]
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
            ctypes.CDLL(None).malloc_trim(0)
    return f


def arrow_map(
    df: DataFrame,
    make: Callable[[], Callable[[dict], dict]],
    schema: str,
) -> DataFrame:
    """Map batches of columns, as Python lists, through ``make()``'s function.

    ``make`` runs once in each Python worker's task, so models and tables are set up once and not
    for every batch. The function takes and returns a dict of equally long lists (or arrays).
    """
    out = _arrow_schema(df.sparkSession, schema)
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = begin(make)
        for batch in batches:
            if not batch.num_rows:
                continue
            got = f({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(got[x.name], type=x.type) for x in out], schema=out)

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone; a column that the table lacks reads as null.

    Extra columns never reach an operator's inner frames, so their names can't clash there.
    """
    return df.select(*[F.col(f"`{n}`") if n in df.columns else F.lit(None).alias(n) for n in names])


#: Bits of the bitmap that sifts keys before their join: a fixed 1 MiB, whatever the input.
BITS = 23


def bitmap(keys: DataFrame, key: str) -> DataFrame:
    """At most 2^(BITS-6) rows: a word's number and its 64 bits."""
    low = F.col(key).bitwiseAND((1 << BITS) - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), low.bitwiseAND(63).cast("int"))
    return keys.groupBy(F.shiftright(low, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def sift(df: DataFrame, key: str, bitmap: DataFrame) -> DataFrame:
    """Rows whose key may be among the bitmap's; none of those that are is lost."""
    low = F.col(key).bitwiseAND((1 << BITS) - 1)
    bit = F.call_function("shiftright", F.col("bits"), low.bitwiseAND(63).cast("int")).bitwiseAND(1)
    return df.join(F.broadcast(bitmap), F.shiftright(low, 6) == F.col("word")).where(bit == 1).drop("word", "bits")


def matching(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key is among the distinct ``keys``: most others are sifted out before the join shuffles.

    The join is an inner one: a semi join would be moved below the sifting.
    """
    return sift(df, key, bitmap(keys, key)).join(keys, key)
