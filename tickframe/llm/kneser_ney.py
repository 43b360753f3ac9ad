"""Quality by perplexity under an interpolated modified Kneser-Ney model trained on trusted text.

The model is over characters, four to a gram, packed into 64 bits. Tasks count
the grams of the trusted texts; the shards of counts are summed by gram, and
the lower orders' continuation counts, discounts and interpolation weights are
aggregates and joins of those tables. Characters rather than words keep the
number of distinct grams far below the text's size, and they see what low
quality looks like here: markup debris, shouting, symbols, lists of fragments.

A document's perplexity is that of its characters, white space of any kind
counting as one space each. ``score`` is the perplexity after ``PRIOR`` more
characters of the language's median, since that of a few words says little. A
document is kept if its score is at most its language's threshold, a quantile
of the scores of trusted documents that the model has not seen: one in
``HELD_OUT``, by a hash of the id, is left out of training. A language with
fewer than ``LEAST_TRUSTED`` of them takes the figures of all languages.

Finished probabilities go to every task where they are few, which is checked
(``broadcast_grams``); a larger model is joined to the documents' gram counts
instead, with the same result. So do up to ``BROADCAST_IDS`` trusted ids.

Null and empty texts have a null perplexity and are not kept. Without trusted
text, and so without a model, every other document is kept, with a null
perplexity. A null language is a language of its own, and null ids are never trusted. Texts are counted and
scored whole; repeated rows count as often as they occur. Ties at a threshold
are kept. An empty table gives an empty table; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.llm import arrays
from tickframe.llm.shared import tidy, written

ORDER, BITS = 4, 16
QUANTILE, LEAST_TRUSTED = 0.995, 20
HELD_OUT, PRIOR = 5, 50
BROADCAST_GRAMS = 4_000_000
BROADCAST_IDS = 4_000_000

_BEGIN = 1


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each character of each text; a text is preceded by begin marks."""
    lengths, points = arrays.code_points(texts)
    points = points.astype(np.uint64)
    # Code points beyond 16 bits fold onto unused ones; every kind of white space is a space.
    points = np.where(points > 0xFFFF, np.uint64(0xE000) + points % np.uint64(0x1900), points)
    points[((points >= 9) & (points <= 13)) | (points == 0xA0)] = 32
    mark = ORDER - 1
    padded = np.full(len(points) + mark * len(lengths), _BEGIN, np.uint64)
    own = np.arange(len(points)) + mark * (1 + np.repeat(np.arange(len(lengths)), lengths))
    padded[own] = points
    out = np.zeros(len(points), np.uint64)
    for k in range(ORDER):
        out |= padded[own - k] << np.uint64(BITS * k)
    return lengths, out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in arrays.slices(batch, "text"):
            codes, found = pd.factorize(arrays.signed(grams(part.column("text"))[1]))
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.bincount(codes, minlength=len(found)))], ["gram", "n"])


def _suffix(order: int) -> Column:
    return F.col("gram").bitwiseAND(F.lit((1 << (BITS * order)) - 1))  # order is below ORDER here


def _context() -> Column:
    return F.shiftrightunsigned("gram", BITS)


def counts(trusted: DataFrame) -> dict[int, DataFrame]:
    """Counts of the full grams, and for each lower order the number of different characters seen before a gram."""
    parts = arrays.bounded_batches(trusted.select("text").dropna()).mapInArrow(_count, "gram long, n long")
    tables = {ORDER: written(parts.groupBy("gram").agg(F.sum("n").alias("n")))}
    for order in range(ORDER - 1, 0, -1):
        tables[order] = written(tables[order + 1].groupBy(_suffix(order).alias("gram")).agg(F.count("*").alias("n")))
    return tables


def _discounts(table: DataFrame) -> list[float]:
    """Chen and Goodman's discounts of grams seen once, twice, and three times or more."""
    row = table.agg(*[F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in range(1, 5)]).first()
    n1, n2, n3, n4 = row
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [k - (k + 1) * y * (b / a) if a else k * y for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]


def probabilities(tables: dict[int, DataFrame]) -> tuple[dict[int, DataFrame], dict[int, DataFrame]]:
    """``gram, p`` of the seen grams of each order, and ``context, weight`` of what each context leaves to the lower order."""
    seen, left = {}, {}
    alphabet = tables[1].count() + 1
    for order in range(1, ORDER + 1):
        table = tables[order].withColumn("context", _context())
        once, twice, more = _discounts(tables[order])
        discount = F.when(F.col("n") == 1, once).when(F.col("n") == 2, twice).otherwise(more)
        per_context = table.groupBy("context").agg(F.sum("n").alias("total"), F.sum(discount).alias("freed"))
        left[order] = written(per_context.select("context", (F.col("freed") / F.col("total")).alias("weight"), "total"))
        joined = table.join(left[order], "context").withColumn("own", (F.col("n") - discount) / F.col("total"))
        if order == 1:
            seen[order] = written(joined.select("gram", (F.col("own") + F.col("weight") / alphabet).alias("p")))
        else:
            lower = seen[order - 1].select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            joined = joined.withColumn("suffix", _suffix(order - 1)).join(lower, "suffix")
            seen[order] = written(joined.select("gram", (F.col("own") + F.col("weight") * F.col("lower")).alias("p")))
    left[0] = alphabet
    return seen, left


def _scored(shared):
    """Sum of log probabilities and length of each text, from a model in memory."""

    def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), default)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], default)

    def score(texts: pa.Array) -> pa.Array:
        seen, left, alphabet = shared.value
        lengths, found = grams(texts)
        codes, unique = pd.factorize(found)
        p = np.full(len(unique), 1.0 / alphabet)
        for order in range(1, ORDER + 1):
            own = unique & np.uint64((1 << (BITS * order)) - 1)
            rest = p * look_up(*left[order], own >> np.uint64(BITS), 1.0)
            known = look_up(*seen[order], own, -1.0)
            p = np.where(known >= 0, known, rest)
        return pa.StructArray.from_arrays(
            [pa.array(arrays.segment_sum(np.log(p)[codes], lengths)), pa.array(lengths)], names=["log_p", "n_chars"]
        )

    @F.arrow_udf("log_p double, n_chars long")
    def scored(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        parts = [score(part.column(0)) for part in arrays.slices(batch, "text")]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("log_p", pa.float64()), ("n_chars", pa.int64())]))

    return scored


def _arrays(table: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    rows = table.select(key, value).toArrow()
    keys = rows.column(key).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows.column(value).to_numpy()[order]


def _document_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in arrays.slices(batch, "text"):
            lengths, found = grams(part.column("text"))
            end = np.cumsum(lengths)
            rows = part.column("row").to_numpy(zero_copy_only=False)
            for i, n in enumerate(lengths.tolist()):
                own, times = np.unique(found[end[i] - n : end[i]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), rows[i])), pa.array(arrays.signed(own)), pa.array(times)], ["row", "full", "times"])


def _joined_scores(rows: DataFrame, seen: dict, left: dict) -> DataFrame:
    """``row, log_p, n_chars`` by joins of the documents' gram counts with the model's tables."""
    counted = arrays.bounded_batches(rows.select("row", "text").dropDuplicates(["row"])).mapInArrow(_document_grams, "row long, full long, times long")
    scored = counted.withColumn("p", F.lit(1.0 / left[0]))
    for order in range(1, ORDER + 1):
        own = F.col("full").bitwiseAND(F.lit((1 << (BITS * order)) - 1)) if order < ORDER else F.col("full")
        known = seen[order].select(F.col("gram").alias("own"), F.col("p").alias("known"))
        weight = left[order].select("context", "weight")
        scored = (
            scored.withColumn("own", own).withColumn("context", F.shiftrightunsigned("own", BITS))
            .join(known, "own", "left").join(weight, "context", "left")
            .withColumn("p", F.coalesce("known", F.col("p") * F.coalesce("weight", F.lit(1.0))))
            .drop("own", "context", "known", "weight")
        )
    return scored.groupBy("row").agg(F.sum(F.log("p") * F.col("times")).alias("log_p"), F.sum("times").alias("n_chars"))


@tidy
def judge(
    documents: DataFrame,
    trusted_ids: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    language: str = "lang",
    quantile: float = QUANTILE,
    broadcast_grams: int = BROADCAST_GRAMS,
) -> DataFrame:
    """One row per document: ``doc_id``, ``lang``, ``perplexity``, ``score``, ``threshold``, ``trusted``, ``kept``.

    ``trusted_ids`` has the ``doc_id`` of the documents to learn from.
    """
    spark = documents.sparkSession
    trusted = trusted_ids.select(F.col("doc_id").alias("id")).dropna().distinct()
    rows = documents.select(
        F.col(doc_id).alias("doc_id"), F.col(language).alias("lang"), F.xxhash64(doc_id, text).alias("row"), F.col(text).alias("text")
    )
    unseen = F.pmod(F.xxhash64(F.lit("held out"), "id"), F.lit(HELD_OUT)) == 0
    learnt = written(trusted.where(~unseen))
    # Few enough ids go to every task, which is checked, so that the texts are not shuffled for them.
    side = F.broadcast(learnt) if learnt.count() <= BROADCAST_IDS else learnt
    tables = counts(rows.join(side, rows["doc_id"] == side["id"], "left_semi"))
    size = tables[ORDER].count()
    seen, left = probabilities(tables) if size else ({}, {})
    if not size:
        scores = rows.select("doc_id", "lang", F.lit(None).cast("double").alias("perplexity"), F.length("text").cast("long").alias("n"))
    elif size <= broadcast_grams:
        model = (
            {k: _arrays(seen[k], "gram", "p") for k in seen},
            {k: _arrays(left[k], "context", "weight") for k in seen},
            left[0],
        )
        score = _scored(spark.sparkContext.broadcast(model))
        scores = arrays.bounded_batches(rows).select("doc_id", "lang", score("text").alias("score"))
        scores = scores.select("doc_id", "lang", F.col("score.log_p").alias("log_p"), F.col("score.n_chars").alias("n"))
        scores = scores.select("doc_id", "lang", F.when(F.col("n") > 0, F.exp(-F.col("log_p") / F.col("n"))).alias("perplexity"), "n")
    else:
        by_row = _joined_scores(rows.where(F.length("text") > 0), seen, left)
        scores = rows.drop("text").join(by_row, "row", "left")
        scores = scores.select("doc_id", "lang", F.exp(-F.col("log_p") / F.col("n_chars")).alias("perplexity"), F.col("n_chars").alias("n"))
    scores = written(scores)

    flagged = scores.join(trusted.withColumn("unseen", unseen), F.col("doc_id") == F.col("id"), "left").drop("id")
    flagged = written(flagged.withColumn("trusted", F.col("unseen").isNotNull()))

    def by_language(rows: DataFrame, value: str, share: float, name: str) -> DataFrame:
        """``rows`` with a quantile of ``value`` among the unseen trusted documents of their language."""
        good = rows.where(F.col("unseen") & F.col(value).isNotNull())
        quantile_of = F.percentile_approx(value, share, 10_000).alias(name)
        overall = good.agg(quantile_of).first()[name]
        each = good.groupBy("lang").agg(quantile_of, F.count("*").alias("of")).where(F.col("of") >= LEAST_TRUSTED)
        each = each.select(F.col("lang").alias("language"), name)
        joined = rows.join(each, F.col("lang").eqNullSafe(F.col("language")), "left").drop("language")
        return joined.withColumn(name, F.coalesce(name, F.lit(overall).cast("double")))

    flagged = by_language(flagged, "perplexity", 0.5, "median")
    middle = F.log(F.coalesce("median", "perplexity"))
    flagged = flagged.withColumn("score", F.exp((F.log("perplexity") * F.col("n") + middle * PRIOR) / (F.col("n") + PRIOR)))
    judged = by_language(written(flagged), "score", quantile, "threshold")
    kept = (F.col("n") > 0) & F.coalesce(F.col("score") <= F.col("threshold"), F.col("threshold").isNull())
    return judged.select("doc_id", "lang", "perplexity", "score", "threshold", "trusted", F.coalesce(kept, F.lit(False)).alias("kept"))
