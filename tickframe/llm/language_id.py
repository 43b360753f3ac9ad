"""Language identification with error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over
hashed character trigrams says on which side a text lies: its weights are the
log ratios of the trigrams' frequencies in the languages with a 1 and in those
with a 0. Decoding adds up, for each codeword, the losses of the bits, each
scaled by how far the bit's two sides lie apart, and takes the codeword of the
least loss. Texts whose two nearest codewords are close are flagged.

A text that is null or has no letter is ``und`` with score 0 and is not flagged;
so is every text if there was nothing to learn from. Rows with a null language
or text are not learned from. Texts are read whole. Ties between codewords go to
the language first in code-point order. Repeated rows count as often as they
occur; columns named like the results are replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm import arrays

UNKNOWN = "und"
BUCKETS = 1 << 14
#: Bits of a codeword where languages are too many for the exhaustive code.
BITS = 31
#: Languages up to which every split into two sides is a bit.
EXHAUSTIVE = 5
SMOOTHING = 0.5
STEEPNESS = 4.0
#: Least distance of the two best codewords' scores of a clear text.
CLEAR = 0.05

_FLUSH = 64


@dataclass(frozen=True)
class Model:
    """Languages in code-point order, their codewords of -1 and 1, and the bits' weights by trigram bucket."""

    languages: tuple[str, ...]
    codes: np.ndarray
    weights: np.ndarray


_letters: list[np.ndarray] = []


def _folded(points: np.ndarray) -> np.ndarray:
    """Letters in lower case; everything else is a space."""
    if not _letters:
        table = np.full(0x10000, 32, np.uint16)
        for p in range(0x10000):
            c = chr(p)
            if c.isalpha():
                low = c.lower()
                table[p] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else p
        _letters.append(table)
    out = _letters[0][np.minimum(points, 0xFFFF)]
    for at in np.flatnonzero(points > 0xFFFF).tolist():
        if chr(int(points[at])).isalpha():
            out[at] = 0xFFFF - int(points[at]) % 1024
    return out


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams of each text, their buckets, and whether each text has a letter. Runs of other characters are one space."""
    lengths, points = arrays.code_points(texts)
    own = _folded(points).astype(np.uint64)
    letter = own != 32
    has = arrays.segment_sum(letter.astype(np.int64), lengths) > 0
    first = arrays.starts(lengths)[lengths > 0]
    before = np.empty(len(own), bool)
    before[1:] = letter[:-1]
    before[first] = True
    kept = letter | before
    own, lengths = own[kept], arrays.segment_sum(kept.astype(np.int64), lengths)
    # A text is read as if a space stood on both sides.
    padded = np.full(len(own) + 2 * len(lengths), 32, np.uint64)
    padded[np.arange(len(own)) + 1 + 2 * np.repeat(np.arange(len(lengths)), lengths)] = own
    factor = arrays.random_odd(3, 5)
    key = padded[:-2] * factor[0] + padded[1:-1] * factor[1] + padded[2:] * factor[2] if len(padded) > 2 else np.zeros(0, np.uint64)
    at = np.repeat(arrays.starts(lengths + 2), lengths) + arrays.within(lengths)
    return lengths, (arrays.mix(key[at]) % np.uint64(BUCKETS)).astype(np.int64), has


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts by language, one row of counts for each language and task."""
    counts: dict[str, np.ndarray] = {}

    def rows() -> pa.RecordBatch:
        languages = list(counts)
        width = np.full(len(languages), BUCKETS)
        values = np.concatenate([counts[x] for x in languages]) if languages else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(languages, pa.string()), arrays.lists(width, values)], ["language", "counts"])

    for batch in batches:
        for part in arrays.slices(batch, "text"):
            lengths, buckets, _ = trigrams(part.column("text"))
            end = np.cumsum(lengths)
            for i, language in enumerate(part.column("language").to_pylist()):
                if language not in counts:
                    if len(counts) >= _FLUSH:
                        yield rows()
                        counts.clear()
                    counts[language] = np.zeros(BUCKETS, np.int64)
                counts[language] += np.bincount(buckets[end[i] - lengths[i] : end[i]], minlength=BUCKETS)
    yield rows()


def codewords(n: int) -> np.ndarray:
    """A codeword of -1 and 1 for each of ``n`` languages: all splits of few, balanced random splits of many."""
    if n <= EXHAUSTIVE:
        splits = [[1] + [1 if bits >> k & 1 else -1 for k in range(n - 1)] for bits in range(2 ** (n - 1) - 1)]
        return np.array(splits or [[1] * n]).T
    best, distance = None, -1
    for seed in range(200):
        rng = np.random.default_rng(seed)
        code = np.stack([rng.permutation(np.where(np.arange(n) % 2, 1, -1)) for _ in range(max(BITS, 4 * n.bit_length()))], axis=1)
        apart = (code.shape[1] - code @ code.T) // 2 + np.eye(n, dtype=int) * code.shape[1]
        if apart.min() > distance:
            best, distance = code, int(apart.min())
    return best


def train(df: DataFrame, text: str = "text", language: str = "lang") -> Model:
    """Learn from every row with a text and a language. The driver gets BUCKETS numbers for each language."""
    rows = df.select(F.col(text).alias("text"), F.col(language).alias("language")).dropna()
    parts = arrays.bounded_batches(rows).mapInArrow(_count, "language string, counts array<long>")
    summed = (
        parts.select("language", F.posexplode("counts").alias("bucket", "n")).where("n > 0")
        .groupBy("language", "bucket").agg(F.sum("n").alias("n"))
        .toArrow().to_pandas()
    )
    languages = tuple(sorted(summed["language"].unique()))
    counts = np.zeros((len(languages), BUCKETS))
    counts[[languages.index(x) for x in summed["language"]], summed["bucket"]] = summed["n"]
    if not languages:
        return Model((), np.zeros((0, 1)), np.zeros((BUCKETS, 1), np.float32))
    share = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    codes = codewords(len(languages))
    weights = np.zeros((BUCKETS, codes.shape[1]), np.float32)
    for bit in range(codes.shape[1]):
        one, zero = share[codes[:, bit] > 0], share[codes[:, bit] < 0]
        if len(one) and len(zero):
            ratio = np.log(one.mean(axis=0)) - np.log(zero.mean(axis=0))
            # On this scale the two sides' mean texts lie at about 1 and -1.
            ones, zeros = (one @ ratio).mean(), (zero @ ratio).mean()
            weights[:, bit] = (ratio - (ones + zeros) / 2) / max((ones - zeros) / 2, 1e-9)
    return Model(languages, codes, weights)


def decode(margins: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest codeword of each row of bit margins, its share of the weight, and the lead over the next."""
    loss = np.logaddexp(0, -STEEPNESS * margins[:, None, :] * codes[None, :, :]).sum(axis=2)
    weight = np.exp(loss.min(axis=1, keepdims=True) - loss)
    share = weight / weight.sum(axis=1, keepdims=True)
    ordered = np.sort(share, axis=1)
    lead = ordered[:, -1] - (ordered[:, -2] if share.shape[1] > 1 else 0)
    return share.argmax(axis=1), share.max(axis=1), lead


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` between 0 and 1, and ``ambiguous``."""
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.codes, model.weights))
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def guess(texts: pa.Array) -> pa.Array:
        languages, codes, weights = shared.value
        lengths, buckets, has = trigrams(texts)
        end = np.cumsum(lengths)
        margins = np.zeros((len(lengths), weights.shape[1]), np.float64)
        for i in np.flatnonzero(has).tolist():
            own = buckets[end[i] - lengths[i] : end[i]]
            if len(own) < BUCKETS // 8:
                margins[i] = weights[own].mean(axis=0)
            else:
                margins[i] = np.bincount(own, minlength=BUCKETS) @ weights / len(own)
        if not languages:
            n = len(lengths)
            return pa.StructArray.from_arrays([pa.array([UNKNOWN] * n), pa.array(np.zeros(n)), pa.array(np.zeros(n, bool))], fields=list(kind))
        best, score, lead = decode(margins, codes)
        names = np.where(has, np.array(languages, object)[best], UNKNOWN)
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(np.where(has, score, 0.0)), pa.array(has & (lead < CLEAR))], fields=list(kind)
        )

    @F.arrow_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        parts = [guess(part.column(0)) for part in arrays.slices(batch, "text")]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    # Marked so that a filter on the result does not make Spark predict twice.
    predict = predict.asNondeterministic()
    out = arrays.bounded_batches(df).withColumn("__language", predict(F.col(text)))
    for name in ("lang_pred", "score", "ambiguous"):
        out = out.withColumn(name, F.col("__language")[name])
    return out.drop("__language")
