"""Shared helpers: words of Arrow string columns, batches of bounded bytes, plain column maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one step of a Python worker holds; a single longer text is one step.
STEP_BYTES = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of each piece have at most so many bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        step = np.cumsum(sizes, dtype=np.int64) // most
        starts = np.flatnonzero(np.diff(step, prepend=step[0] - 1))
        for start, stop in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(start, stop - start)


def words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text: offsets per text, word numbers, and the distinct words.

    Null and empty texts have no words. `lower` folds A-Z only.
    """
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = pc.fill_null(texts, "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    real = pc.greater(pc.binary_length(parts.values), 0).to_numpy(zero_copy_only=False)
    offsets = np.asarray(parts.offsets).astype(np.int64)
    counted = np.concatenate([[0], np.cumsum(real, dtype=np.int64)])
    coded = parts.values.filter(pa.array(real)).dictionary_encode()
    return counted[offsets], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def listed(strings: pa.Array | pa.ChunkedArray) -> list:
    """The strings as Python's. Much faster than to_pylist, which makes a scalar of each."""
    return strings.to_numpy(zero_copy_only=False).tolist() if isinstance(strings, pa.Array) else strings.to_numpy().tolist()


def owners(offsets: np.ndarray) -> np.ndarray:
    """For each item of consecutive runs, the number of its run."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array without nulls."""
    wide = texts.cast(pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def gather(offsets: np.ndarray, values: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of values, picked and joined: offsets of the picked runs, and their values."""
    sizes = np.diff(offsets)[which]
    out = np.concatenate([[0], np.cumsum(sizes)])
    return out, values[np.arange(out[-1]) + np.repeat(offsets[:-1][which] - out[:-1], sizes)]


def nested(counts, inner: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of so many inner numbers each; every number stands for a run of values. Offsets of the rows, values."""
    runs, flat = gather(offsets, values, inner)
    return runs[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])], flat


def held_out(column: str, parts: int, part: int):
    """Whether crc32 of the id as text leaves this remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts == part


def wider(df: DataFrame, added: str) -> StructType:
    """df's schema with more columns, given as DDL."""
    return StructType(df.schema.fields + StructType.fromDDL(added).fields)


def map_texts(df: DataFrame, column: str, added: str, step: Callable[[pa.Array], list[pa.Array]], most: int = STEP_BYTES, end: Callable[[], None] = lambda: None) -> DataFrame:
    """df with columns that `step` computes from the texts; `added` is their DDL. `most` bytes at a time; `end` ends a task.

    Columns of df with a clashing name are replaced. No shuffle: a lost task is computed again
    from its input alone.
    """
    fields = StructType.fromDDL(added)
    kept = df.drop(*fields.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in pieces(batches, column, most):
                arrays = step(batch.column(column))
                yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *fields.fieldNames()])
        finally:
            end()

    return kept.mapInArrow(run, wider(kept, added))
