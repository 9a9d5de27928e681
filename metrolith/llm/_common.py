"""Helpers shared by the corpus operators: shared scratch tables and batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrolith.functions.scratch import materialize, scratch_path, shared_dir  # noqa: F401

#: Rows of an Arrow batch are processed in slices of about this many characters,
#: so that a worker's memory does not follow the number of rows in a batch.
SLICE_CHARS = 4_000_000


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def parts(batch: pa.RecordBatch, text_column: int, most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch into parts of about ``most`` bytes of text, one row at least."""
    lengths = pa.compute.binary_length(batch.column(text_column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(lengths), 0
    while start < len(ends):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def slices(batch: pa.RecordBatch, text_column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut a batch into slices of bounded text and give the texts as str (null: '')."""
    for part in parts(batch, text_column):
        yield part, [x or "" for x in part.column(text_column).to_pylist()]


def release() -> None:
    """Give the memory that a worker freed back to the machine; idle workers are kept for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def per_document(
    docs: DataFrame,
    rows: Callable[[list[str]], dict[str, pa.Array]],
    schema: str,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Apply a function of texts to each document, batch by batch, without a shuffle.

    ``rows`` gets a list of texts and returns one array per output column after
    the id.  Only the id and the text are read, so other columns of ``docs``,
    whatever their names, never clash with the result.
    """
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 1):
                made = rows(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(made[n] for n in names)], names=[id_column, *names]
                )
        release()

    kind = dict(docs.dtypes)[id_column]
    return docs.select(id_column, text_column).mapInArrow(run, f"{id_column} {kind}, {schema}")


def keep_rows(docs: DataFrame, keep: Callable[[list[str]], list[bool]], text_column: str = "text") -> DataFrame:
    """The rows whose text ``keep`` accepts, with all their columns; one pass, without a join or a shuffle."""
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, at):
                yield part.filter(pa.array(keep(texts), pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)


def held_out(id_column: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(
        F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False)
    )


#: A table of ids is broadcast up to this many rows (some 16 MB) and joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000


def checked(ids: DataFrame, name: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Write a table of ids, count it, and mark it for broadcast only within the bound."""
    written = materialize(ids, name)
    return F.broadcast(written) if written.count() <= most else written
