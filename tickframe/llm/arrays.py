"""Texts of an Arrow batch as flat NumPy arrays, so that tasks work on whole batches at a time.

A word is a run of characters other than space and the controls 09 to 0D.
Words, shingles and characters become 64-bit integers; documents are slices
of the flat arrays, given by their lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Texts are worked on in slices of about so many bytes: what a task holds does not follow the batch.
SLICE_BYTES = 1 << 20
#: What Spark may put into one Arrow batch.
BATCH_BYTES = 8 << 20

_U64 = np.uint64


def bounded_batches(df: DataFrame) -> DataFrame:
    """Let Spark cut Arrow batches by bytes too, for tables of very long texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of SplitMix64)."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def random_odd(n: int, seed: int) -> np.ndarray:
    """``n`` odd multipliers that depend on the seed alone."""
    return mix(np.arange(1, n + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15) + _U64(seed)) | _U64(1)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(_U64, copy=False).view(np.int64)


def starts(lengths: np.ndarray) -> np.ndarray:
    """Where each slice begins."""
    return np.cumsum(lengths) - lengths


def within(lengths: np.ndarray) -> np.ndarray:
    """The position of each element inside its slice."""
    return np.arange(int(lengths.sum())) - np.repeat(starts(lengths), lengths)


def segment_sum(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each slice; 0 for an empty one."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    end = np.cumsum(lengths)
    return total[end] - total[end - lengths]


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about SLICE_BYTES of text each; one text is never cut."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // SLICE_BYTES
    cuts = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def hash_strings(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of every string, the same in every process."""
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    if not len(values):
        return np.zeros(0, _U64)
    lengths = np.diff(offsets)
    data = values.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    factor = random_odd(int(lengths.max()) if len(lengths) else 0, 11)
    terms = mix(raw.astype(_U64) + _U64(1)) * factor[within(lengths)]
    return mix(segment_sum(terms, lengths) + lengths.astype(_U64) * _U64(0x9E3779B97F4A7C15))


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each text, and the hashes of all words. Only A-Z are lower-cased; null has no words."""
    texts = pc.fill_null(texts, "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = parts.flatten()
    lengths = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    encoded = flat.dictionary_encode()
    hashes = hash_strings(encoded.dictionary)[encoded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, _U64)
    empty = pc.equal(flat, "").to_numpy(zero_copy_only=False)
    if empty.any():
        lengths = lengths - segment_sum(empty.astype(np.int64), lengths)
        hashes = hashes[~empty]
    return lengths, hashes


def shingles(lengths: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words; fewer words make one run, no words make none."""
    count = np.where(lengths >= n, lengths - n + 1, np.minimum(lengths, 1))
    at = np.repeat(starts(lengths), count) + within(count)
    end = np.repeat(np.cumsum(lengths), count)
    factor = random_odd(n, 23)
    out = np.zeros(len(at), _U64)
    for k in range(n):
        inside = at + k < end
        out += np.where(inside, hashes[np.minimum(at + k, max(len(hashes) - 1, 0))] * factor[k], _U64(0)) if len(at) else out
    return count, mix(out)


def distinct(lengths: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each slice in ascending order."""
    values = values.copy()
    first = np.ones(len(values), bool)
    lo = 0
    for n in lengths.tolist():
        values[lo : lo + n].sort()
        lo += n
    first[1:] = values[1:] != values[:-1]
    first[starts(lengths)[lengths > 0]] = True
    return segment_sum(first.astype(np.int64), lengths), values[first]


def lists(lengths: np.ndarray, values: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of code points of each text, and all of them."""
    texts = pc.fill_null(texts, "")
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = "".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass")
    return lengths, np.frombuffer(flat, np.uint32)
