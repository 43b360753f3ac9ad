"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment over words.

The word n-grams of the benchmark items are counted over the training
documents. In every ``cover`` consecutive n-grams of an item the one in the
fewest documents, but in some, is a seed, so any ``seed + cover - 1`` words in a row that an
item shares with a document contain a seed, while n-grams of frequent words are
passed over wherever a rarer one is next to them. A document's passage around
a seed is aligned with the item: equal words score 2, other pairs and gaps -1.
An item's score in a document is its best local alignment over its
perfect score; from ``threshold`` on, and ``least`` matched words (or all words of
a shorter item), the document is reported for that item.
An alignment cannot score more than the words that both sides have in common
allow, so passages below that bound are not aligned. Passages of a document are
never cut or skipped otherwise.

The benchmark's n-grams and words go to every task where they are small, which
is checked (``broadcast_grams``); a larger benchmark is worked on in parts of
that size, each of which reads the documents again.

Words are runs of characters other than white space, lower-cased, with
leading and trailing ASCII punctuation ignored. Null or empty texts and items
match nothing; items with fewer words than an n-gram are seeds as a whole, and
are found wherever their words stand in a row. ``clean`` passes over those: a word or
two say nothing about where a document comes from.
Items with equal texts are reported each under its id, in the order of the ids;
null ids and repeated rows give rows like others. Documents are read whole. An
empty table on either side gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm import arrays
from tickframe.llm.shared import written

SEED, COVER, THRESHOLD = 3, 3, 0.4
#: Benchmark n-grams that go to every task at once.
BROADCAST_GRAMS = 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words that must match whatever the share; of an item with fewer, all.
LEAST = 6
#: Pairs of a seed hit and an item that are looked at together.
PORTION = 1 << 19

_ITEM = "item_key long, item_id {id}, words array<long>, grams array<long>"
_EDGE = r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$"


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words without the punctuation at their ends; a word of punctuation alone is itself."""
    parts = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    flat = parts.flatten()
    lengths = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(flat):
        return lengths, np.zeros(0, np.uint64)
    encoded = flat.dictionary_encode()
    bare = pc.replace_substring_regex(encoded.dictionary, _EDGE, "")
    bare = pc.if_else(pc.equal(bare, ""), encoded.dictionary, bare)
    at = encoded.indices.to_numpy(zero_copy_only=False)
    empty = pc.equal(encoded.dictionary, "").to_numpy(zero_copy_only=False)[at]
    hashes = arrays.hash_strings(bare)[at]
    if empty.any():
        lengths = lengths - arrays.segment_sum(empty.astype(np.int64), lengths)
    return lengths, hashes[~empty]


def _items(seed: int):
    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, words = _words(batch.column("text"))
            counts, grams = arrays.shingles(lengths, words, seed)
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_key"), batch.column("item_id"), arrays.lists(lengths, arrays.signed(words)), arrays.lists(counts, arrays.signed(grams))],
                ["item_key", "item_id", "words", "grams"],
            )

    return items


def _document_counts(shared, seed: int):
    """In how many documents each benchmark n-gram stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = shared.value
        total = np.zeros(len(grams), np.int64)
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                owner, _, at = _hits(*_words(part.column("text")), grams, seed)
                total += np.bincount(np.unique(owner * len(grams) + at) % max(len(grams), 1), minlength=len(grams))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(arrays.signed(grams[some])), pa.array(total[some])], ["gram", "documents"])

    return count


def _hits(lengths: np.ndarray, words: np.ndarray, grams: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, word position and index in the sorted ``grams`` of every run of ``seed`` words, or fewer, that is among them.

    Shorter runs are those of items that are shorter than a seed. A run's hash does not depend on ``seed``.
    """
    out = []
    for n in range(1, seed + 1):
        long = np.where(lengths >= n, lengths, 0)
        counts, own = arrays.shingles(long, words if n == 1 else words[np.repeat(lengths >= n, lengths)], n)
        at = np.searchsorted(grams, own)
        found = np.flatnonzero(grams[np.minimum(at, len(grams) - 1)] == own) if len(grams) else np.zeros(0, np.int64)
        ends = np.cumsum(counts)
        owner = np.searchsorted(ends, found, "right")
        out.append((owner, found - (ends - counts)[owner], at[found]))
    owner, position, at = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(owner, kind="stable")
    return owner[order], position[order], at[order]


def _portions(at: np.ndarray, entries: np.ndarray, lo: int, hi: int, n_items: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hits with the entries of items ``lo`` to ``hi`` that have their seed, as (hit, entry) pairs, about PORTION at a time.

    ``entries`` are the seeds and items of all entries as one number, in order. The items are halved until a portion
    is small enough, so a hit of a seed that very many items share is expanded step by step; all are.
    """
    first, last = np.searchsorted(entries, at * n_items + lo), np.searchsorted(entries, at * n_items + hi)
    n = last - first
    if int(n.sum()) > PORTION and hi - lo > 1:
        middle = (lo + hi) // 2
        yield from _portions(at, entries, lo, middle, n_items)
        yield from _portions(at, entries, middle, hi, n_items)
    elif n.any():
        yield np.repeat(np.arange(len(at)), n), np.repeat(first, n) + arrays.within(n)


def _needed(n_words: int, threshold: float, least: int) -> float:
    """The score from which an item of so many words is found: a share of its perfect one, but ``least`` words, or all."""
    return MATCH * max(threshold * n_words, min(n_words, least))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best Smith-Waterman score of two word sequences, and the passage's slice that it covers."""
    n = len(passage)
    score = np.zeros(n + 1, np.int64)
    begin = np.arange(n + 1)
    step = -GAP * np.arange(n + 1)
    best, lo, hi = 0, 0, 0
    for word in item:
        take = np.where(passage == word, MATCH, MISMATCH)
        here = np.zeros(n + 1, np.int64)
        source = np.arange(n + 1)
        diagonal, above = score[:-1] + take, score[1:] + GAP
        here[1:] = np.maximum(np.maximum(diagonal, above), 0)
        source[1:] = np.where(here[1:] == 0, source[1:], np.where(diagonal >= above, begin[:-1], begin[1:]))
        # Gaps along the passage: the best of all earlier cells, less the words between.
        raised = here + step
        lead = np.maximum.accumulate(raised)
        from_cell = np.maximum.accumulate(np.where(raised == lead, np.arange(n + 1), 0))
        along = lead - step
        source = np.where(along > here, source[from_cell], source)
        score, begin = np.maximum(here, along), source
        top = int(score.argmax())
        if score[top] > best:
            best, lo, hi = int(score[top]), int(begin[top]), top
    return best, lo, hi


def _spans(shared, seed: int, threshold: float, least: int):
    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, gram_items, gram_offsets, gram_first, items = shared.value
        sorted_items = [np.sort(x) for x in items]
        entries = np.repeat(np.arange(len(grams)), np.diff(gram_offsets)) * max(len(items), 1) + gram_items
        known: dict[tuple, tuple[int, int, int]] = {}

        def aligned(key: tuple[int, bytes], passage: np.ndarray) -> tuple[int, int, int]:
            if key not in known:
                if len(known) > 20_000:
                    known.clear()
                known[key] = align(items[key[0]], passage)
            return known[key]

        for batch in batches:
            for part in arrays.slices(batch, "text"):
                lengths, words = _words(part.column("text"))
                begin = arrays.starts(lengths)
                owner, position, at = _hits(lengths, words, grams, seed)
                best: dict[tuple[int, int], tuple[float, int, int]] = {}
                for hit, entry in _portions(at, entries, 0, len(items), max(len(items), 1)):
                    # The place where the item would begin.
                    doc, item, origin = owner[hit], gram_items[entry], position[hit] - gram_first[entry]
                    order = np.lexsort((origin, item, doc))
                    doc, item, origin = doc[order], item[order], origin[order]
                    lo = 0
                    while lo < len(doc):
                        target = items[item[lo]]
                        reach = max(2, len(target) // 2)
                        # Hits of one item at nearby places are one passage.
                        hi = lo + 1
                        while hi < len(doc) and doc[hi] == doc[lo] and item[hi] == item[lo] and origin[hi] - origin[hi - 1] <= reach:
                            hi += 1
                        d, i = int(doc[lo]), int(item[lo])
                        a = max(0, int(origin[lo]) - reach)
                        z = min(int(lengths[d]), int(origin[hi - 1]) + len(target) + reach)
                        lo = hi
                        passage = words[begin[d] + a : begin[d] + z]
                        needed = _needed(len(target), threshold, least)
                        own = sorted_items[i]
                        place = np.searchsorted(own, passage)
                        inside = own[np.minimum(place, len(own) - 1)] == passage
                        if MATCH * int(inside.sum()) < needed:
                            continue
                        score, s, e = aligned((i, passage.tobytes()), passage)
                        share = score / (MATCH * len(target))
                        if score >= needed and share > best.get((d, i), (0.0,))[0]:
                            best[d, i] = (share, a + s, a + e)
                ids = part.column("doc_id")
                rows = sorted(best.items())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array([d for (d, _), _ in rows], pa.int64())), part.column("row").take(pa.array([d for (d, _), _ in rows], pa.int64())),
                        pa.array([i for (_, i), _ in rows], pa.int64()), pa.array([x for _, (x, _, _) in rows], pa.float64()),
                        pa.array([s for _, (_, s, _) in rows], pa.int64()), pa.array([e for _, (_, _, e) in rows], pa.int64()),
                    ],
                    ["doc_id", "row", "item", "score", "start_word", "end_word"],
                )

    return spans


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    seed: int = SEED,
    cover: int = COVER,
    threshold: float = THRESHOLD,
    least: int = LEAST,
    broadcast_grams: int = BROADCAST_GRAMS,
) -> DataFrame:
    """One row per document and item found in it: ids, score, the passage's word positions, and ``row``, a hash of id and text."""
    spark = documents.sparkSession
    id_type = benchmark.schema[item_id].dataType.simpleString()
    doc_type = documents.schema[doc_id].dataType.simpleString()
    rows = arrays.bounded_batches(documents.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("row"), F.col(text).alias("text")))
    items = written(
        benchmark.select(F.xxhash64(item_id, item_text).alias("item_key"), F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
        .mapInArrow(_items(seed), _ITEM.format(id=id_type))
        .where("size(words) > 0")
    )
    # Parts by hash of the item, each with about so many n-grams as may go to every task.
    parts = max(1, -(-(items.agg(F.sum(F.size("grams"))).first()[0] or 0) // broadcast_grams))
    found = None
    for k in range(parts):
        own = items.where(F.pmod("item_key", F.lit(parts)) == k).orderBy("item_key", "item_id").toArrow()
        grams = np.unique(_flat(own, "grams"))
        counted = rows.mapInArrow(_document_counts(spark.sparkContext.broadcast(grams), seed), "gram long, documents long")
        frequency = counted.groupBy("gram").agg(F.sum("documents").alias("documents")).toArrow()
        seeds = _seeds(own, grams, frequency, cover)
        hits = rows.mapInArrow(
            _spans(spark.sparkContext.broadcast(seeds), seed, threshold, least),
            f"doc_id {doc_type}, row long, item long, score double, start_word long, end_word long",
        )
        names = spark.createDataFrame(
            pa.table({"item": pa.array(range(own.num_rows), pa.int64()), "item_id": own.column("item_id")})
        )
        named = hits.join(names, "item").drop("item")
        found = named if found is None else found.unionByName(named)
    return found.select("doc_id", "item_id", "score", "start_word", "end_word", "row")


def clean(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``documents`` without those in which an item of at least SEED words was found."""
    words = F.size(F.regexp_extract_all(F.col(options.get("item_text", "text")), F.lit(r"(\S+)"), F.lit(1)))
    benchmark = benchmark.where(words >= options.get("seed", SEED))
    found = written(contaminated(documents, benchmark, doc_id, text, **options).select(F.col("row").alias("__row")).distinct())
    return documents.withColumn("__row", F.xxhash64(doc_id, text)).join(found, "__row", "left_anti").select(*documents.columns)


def _flat(items: pa.Table, column: str) -> np.ndarray:
    values = items.column(column).combine_chunks()
    values = values if isinstance(values, pa.Array) else pa.concat_arrays(values.chunks)
    return values.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def _seeds(items: pa.Table, grams: np.ndarray, frequency: pa.Table, cover: int) -> tuple:
    """The seeds in order, and for each its items and the places where it stands in them; and the words of every item."""
    documents = np.zeros(len(grams), np.int64)
    counted = frequency.column("gram").to_numpy().view(np.uint64)
    documents[np.searchsorted(grams, counted)] = frequency.column("documents").to_numpy()
    chosen: set[tuple[int, int, int]] = set()
    words = []
    for i in range(items.num_rows):
        words.append(np.array(items.column("words")[i].as_py(), np.int64).view(np.uint64))
        own = np.array(items.column("grams")[i].as_py(), np.int64).view(np.uint64)
        at = np.searchsorted(grams, own)
        rare = documents[at]
        for lo in range(max(1, len(own) - cover + 1)):
            # An n-gram in no document is no seed; of the others the rarest is.
            window = [x for x in range(lo, min(lo + cover, len(own))) if rare[x]]
            if window:
                k = min(window, key=lambda x: (rare[x], int(own[x])))
                chosen.add((int(at[k]), i, k))
    rows = np.array(sorted(chosen), np.int64).reshape(-1, 3)
    kept, first = np.unique(rows[:, 0], return_index=True)
    return grams[kept], rows[:, 1], np.append(first, len(rows)), rows[:, 2], words
