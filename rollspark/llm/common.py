"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from rollspark.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and return a scan of it.

    Used where an operator reads an intermediate result more than once: the plan
    runs once, lineage is cut, and a lost executor costs only the tasks it ran.
    """
    path = os.path.join(checkpoint_dir(df.sparkSession), "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def widened(schema: StructType, **fields: str) -> StructType:
    """``schema`` with further fields, given as name=DDL type."""
    more = StructType.fromDDL(", ".join(f"{k} {v}" for k, v in fields.items()))
    return StructType([*schema.fields, *more.fields])


#: DuckDB has no crc32: a CTE ``crc`` with the byte table of the polynomial 0xEDB88320, and the fold over a blob with it.
CRC_TABLE = """crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t)"""


def crc32_sql(blob: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex({blob}), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]::BIGINT)), 4294967295::BIGINT)"""


_KEPT: dict = {}


def kept(name, make):
    """What ``make()`` gave, kept in this Python worker for the operator's next tasks.

    Workers serve one operator after another; only the last one's is kept, so
    what the others remember does not add up.
    """
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def forget() -> None:
    """Drops what :func:`kept` holds; for functions that use none of it."""
    _KEPT.clear()


def trim() -> None:
    """Memory that was freed goes back to the system, where the C library can do so: a worker lives on, and so would the most it ever used."""
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def lean(run, rows: int = 1000):
    """``run``, a function for ``mapInArrow``, on slices of at most ``rows`` rows (0: whole batches).

    So no whole batch is held as Python objects, results come in small batches, and freed memory is given back.
    """
    def slices(batches):
        for batch in batches:
            for k in range(0, len(batch), rows or max(1, len(batch))):
                yield batch.slice(k, rows or len(batch))
            trim()

    def on_slices(batches):
        yield from run(slices(batches))
        trim()

    return on_slices
