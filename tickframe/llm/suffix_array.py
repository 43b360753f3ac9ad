"""Passages that repeat across documents, by a sparse suffix array over words.

Of the suffixes of all documents only those at minimisers are retained: of
every ``window`` consecutive ``gram``-word hashes of a document the smallest
marks its position. Two equal passages of ``gram + window - 1`` words have a
retained position in common. Suffixes whose first ``gram`` words stand in other
documents as well are sorted by those and by the ``window`` words that follow,
and once more by the words before; in either order a suffix is compared with its
neighbours and with the nearest suffix of another document on either side,
however many of its own document lie between, and their match is extended to the left and
right over the carried words. Matches on one diagonal of two documents that
touch are joined. What reaches ``least_words`` is a repeated passage; a
document's overlapping passages are reported as one.

Sorting splits a passage's occurrences over tasks however many there are, and
each is compared with its neighbours only, so work and memory follow the number
of retained suffixes. Words beside an anchor are compared by 16-bit hashes: a
passage's end may be wrong by a word once in 65536 times.

Words are compared in lower case (A-Z). Null and empty texts and texts of fewer
words than a passage have none. Texts are read whole. Equal texts repeat each
other; rows equal in id and text as well are one document. A null id is an id.
Where the same words stand often in one document, all their places are found.
An empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm import arrays
from tickframe.llm.ordering import neighbours
from tickframe.llm.shared import tidy, written

LEAST_WORDS = 50
GRAM, WINDOW = 25, 26
#: Places along either order at which suffixes are compared, besides the nearest of another document.
WIDTH = 2
#: Bits of the map that says which anchors are looked at again.
MAP_BITS = 1 << 26

_U64 = np.uint64
_WORD = np.dtype(">u2")


def _inverse(odd: int) -> int:
    x = odd
    for _ in range(6):
        x = x * (2 - odd * x) & (2**64 - 1)
    return x


_RADIX = 0x9E3779B97F4A7C15 | 1
_UNDO = _inverse(_RADIX)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U64)
    out[:1] = 1
    return np.cumprod(out, dtype=_U64)


def retained(lengths: np.ndarray, words: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, position in the flat words, and gram hash of every retained suffix."""
    total = len(words)
    long = np.maximum(lengths - gram + 1, 0)
    at = np.repeat(arrays.starts(lengths), long) + arrays.within(long)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(_U64)
    powers = _powers(_RADIX, total)
    sums = np.concatenate([np.zeros(1, _U64), np.cumsum(words * powers, dtype=_U64)])
    grams = arrays.mix((sums[at + gram] - sums[at]) * _powers(_UNDO, total)[at])
    # Smallest hash of every window, by doubling; a document with fewer grams than a window has one window.
    size = np.minimum(long, window)
    owner = np.repeat(np.arange(len(lengths)), long)
    place = arrays.within(long)
    is_window = place + size[owner] <= long[owner]
    low = grams.copy()
    reach = 1
    while reach < window:
        step = min(reach, window - reach)
        moved = low.copy()
        moved[: len(low) - step] = low[step:]
        same = np.zeros(len(low), bool)
        same[: len(low) - step] = owner[step:] == owner[: len(low) - step]
        low = np.where(same, np.minimum(low, moved), low)
        reach += step
    # A gram is retained if it is the smallest of any window that covers it.
    low = np.where(is_window, low, _U64(0))
    high = low.copy()
    reach = 1
    while reach < window:
        step = min(reach, window - reach)
        moved = np.zeros_like(high)
        moved[step:] = high[: len(high) - step]
        same = np.zeros(len(high), bool)
        same[step:] = owner[step:] == owner[: len(high) - step]
        high = np.where(same, np.maximum(high, moved), high)
        reach += step
    kept = np.flatnonzero(grams == high)
    return owner[kept], at[kept], grams[kept]


def _anchors(gram: int, window: int, least_words: int):
    """Each document's anchor hashes, once each."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                lengths, words = arrays.words(part.column("text"))
                lengths, words = _long_enough(lengths, words, least_words)
                owner, _, grams = retained(lengths, words, gram, window)
                n, grams = arrays.distinct(np.bincount(owner, minlength=len(lengths)).astype(np.int64), grams)
                row = part.column("row").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(arrays.signed(grams)), pa.array(np.repeat(row, n))], ["gram", "row"])

    return anchors


def _long_enough(lengths: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    keep = lengths >= least
    return np.where(keep, lengths, 0), words[np.repeat(keep, lengths)]


def _suffixes(shared, gram: int, window: int, least_words: int):
    """The suffixes whose anchor is in the map, with the words around the anchor: nearest first on either side."""

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                lengths, words = arrays.words(part.column("text"))
                lengths, words = _long_enough(lengths, words, least_words)
                owner, at, grams = retained(lengths, words, gram, window)
                bit = grams & _U64(MAP_BITS - 1)
                own = (wanted[bit >> _U64(6)] >> (bit & _U64(63)) & _U64(1)).astype(bool)
                owner, at, grams = owner[own], at[own], grams[own]
                begin, end = arrays.starts(lengths)[owner], np.cumsum(lengths)[owner]
                short = np.maximum((words >> _U64(48)).astype(_WORD), 1)
                k = np.arange(window)
                right, left = at[:, None] + gram + k, at[:, None] - 1 - k
                # 0 stands for no word: beyond a text's ends nothing is equal.
                after = np.where(right < end[:, None], short[np.minimum(right, max(len(words) - 1, 0))], 0).astype(_WORD) if len(at) else np.zeros((0, window), _WORD)
                before = np.where(left >= begin[:, None], short[np.maximum(left, 0)], 0).astype(_WORD) if len(at) else np.zeros((0, window), _WORD)
                row = part.column("row").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(arrays.signed(grams)), pa.array(row[owner], pa.int64()), pa.array((at - begin).astype(np.int32)),
                        pa.array([x.tobytes() for x in after], pa.binary()), pa.array([x.tobytes() for x in before], pa.binary()),
                    ],
                    ["gram", "row", "position", "after", "before"],
                )

    return suffixes


def _matches(gram: int, window: int):
    """For neighbours of one anchor and two documents: the matched words in each, at all the places that look alike there."""

    def emit(rows: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.Table:
        out: list[np.ndarray] = [np.zeros((5, 0), np.int64)]
        if len(i):
            anchor, row = rows.column("gram").to_numpy(), rows.column("row").to_numpy()
            keep = (anchor[i] == anchor[j]) & (row[i] != row[j])
            i, j = i[keep], j[keep]
        if len(i):
            sides = []
            for name in ("after", "before"):
                flat = np.frombuffer(b"".join(rows.column(name).to_pylist()), _WORD).reshape(rows.num_rows, window)
                differs = (flat[i] != flat[j]) | (flat[i] == 0)
                sides.append(np.where(differs.any(axis=1), differs.argmax(axis=1), window))
            right, left = sides
            places = rows.column("positions").combine_chunks()
            places = places if isinstance(places, pa.Array) else pa.concat_arrays(places.chunks)
            n = np.diff(places.offsets.to_numpy())
            flat, first = places.flatten().to_numpy(), places.offsets.to_numpy()[:-1] - places.offsets[0].as_py()
            for x, y in ((i, j), (j, i)):
                each = np.repeat(np.arange(len(x)), n[x])
                at = flat[first[x][each] + arrays.within(n[x])].astype(np.int64)
                partner_at = flat[first[y]][each].astype(np.int64)
                out.append(np.stack([row[x][each], row[y][each], at - partner_at, at - left[each], at + gram + right[each]]))
        found = np.concatenate(out, axis=1)
        return pa.table(dict(zip(("row", "partner", "diagonal", "start", "end"), map(pa.array, found))))

    return emit


def _merged(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of equal keys that touch or overlap, as one, with the smallest partner."""
    ordered = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(before >= F.col("start"), 0).otherwise(1)).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("island", island).groupBy(*keys, "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("partner").alias("least_partner")
    )


@tidy
def repeated_passages(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, gram: int = GRAM, window: int = WINDOW
) -> DataFrame:
    """One row per document and repeated passage: ``doc_id``, ``start_word``, ``end_word`` (exclusive), ``n_words``, ``first``.

    ``first`` says that no neighbouring copy comes before this one, in the order of the hashes of id and text: removing
    the other passages leaves one copy of each.
    """
    if gram + window - 1 > least_words:
        raise ValueError("gram + window - 1 must not exceed least_words")
    spark = documents.sparkSession
    row = F.xxhash64(doc_id, text)
    rows = arrays.bounded_batches(documents.select(row.alias("row"), F.col(text).alias("text")))
    found = rows.mapInArrow(_anchors(gram, window, least_words), "gram long, row long")
    shared_by = found.groupBy("gram").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).where("lo <> hi")
    anchors = written(shared_by.select("gram"))

    bit = F.col("gram").bitwiseAND(F.lit(MAP_BITS - 1))
    bits = anchors.groupBy(F.shiftright(bit, 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(gram & 63 as int))")).alias("bits")
    ).toArrow()
    bit_map = np.zeros(MAP_BITS // 64, np.int64)
    bit_map[bits.column("word").to_numpy()] = bits.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(bit_map.view(_U64))
    suffixes = rows.mapInArrow(_suffixes(shared, gram, window, least_words), "gram long, row long, position int, after binary, before binary")
    array = written(
        suffixes.join(anchors, "gram", "left_semi")
        .groupBy("gram", "after", "before", "row").agg(F.sort_array(F.collect_set("position")).alias("positions"))
    )
    schema = "row long, partner long, diagonal long, start long, end long"
    pairs = neighbours(array, ["gram", "after", "before", "row"], WIDTH, _matches(gram, window), schema, ["gram", "row"]).unionByName(
        neighbours(array, ["gram", "before", "after", "row"], WIDTH, _matches(gram, window), schema, ["gram", "row"])
    )
    joined = _merged(pairs.distinct().withColumn("of", F.col("partner")), ["row", "of", "diagonal"])
    passages = joined.where(F.col("end") - F.col("start") >= least_words).select("row", "start", "end", F.col("least_partner").alias("partner"))
    spans = written(_merged(passages, ["row"]).drop("island"))
    ids = documents.select(F.col(doc_id).alias("doc_id"), row.alias("row"))
    return ids.join(spans, "row").distinct().select(
        "doc_id",
        F.col("start").alias("start_word"),
        F.col("end").alias("end_word"),
        (F.col("end") - F.col("start")).alias("n_words"),
        (F.col("row") < F.col("least_partner")).alias("first"),
    )
