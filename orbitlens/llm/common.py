"""Small helpers for the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, saved, scratch, scratch_path, shared_dir

__all__ = ["blocks_of", "discard", "partitions", "remainder", "saved", "scratch", "scratch_path", "shared_dir", "sliced", "table"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null doc_id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Gives a worker's free memory back to the system: its process outlives the task and shares the executor's memory with the next one's."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def sliced(batches, text: str, limit: int = 1 << 20):
    """The same rows in record batches of about `limit` bytes of text (one longer text makes its own)."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < batch.num_rows:
            before = int(sizes[at - 1]) if at else 0
            stop = max(int(sizes.searchsorted(before + limit, "right")), at + 1)
            yield batch.slice(at, stop - at)
            at = stop
        release()


def blocks_of(batches, columns: tuple[str, ...], text: str, limit: int):
    """Joins record batches to runs of whole rows of about `limit` bytes of text; yields lists of record batches."""
    kept, size = [], 0
    for batch in batches:
        batch = batch.select(list(columns))
        at, rows = 0, batch.num_rows
        data = batch.column(batch.schema.get_field_index(text))
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False).cumsum()
        while at < rows:
            before = int(sizes[at - 1]) if at else 0
            stop = max(int(sizes.searchsorted(before + limit - size, "right")), at + (not kept))
            if stop > at:
                part = batch.slice(at, stop - at)
                kept.append(part)
                size += int(sizes[stop - 1]) - before
                at = stop
            if at < rows:
                yield kept
                kept, size = [], 0
                release()
    if kept:
        yield kept
    release()
