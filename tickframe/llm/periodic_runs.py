"""Periodic runs in texts: stretches of words that repeat with a short period, found in a grammar-compressed form.

A run is a stretch of words, all equal to those ``period`` words on, that holds
at least ``exponent`` periods and ``least_words`` words, has no smaller period,
and cannot be extended by a word on either side.

Each text's word ids are compressed by Re-Pair in rounds: of all neighbouring
pairs that stand at least ``exponent`` - 1 times in the text, as every pair in a
run does, the more frequent ones win over those they overlap, and each winner
becomes a nonterminal. What is left of a text is halved over and over, so that
every run lies across the boundary of two parts of a node: a nonterminal, or a
half. For each nonterminal, once, and each half, all periods that fit are tried
at the boundary: the match there is followed to both sides, as far as the node
goes, by comparing hashes of prefixes. What is found in a nonterminal is then
translated to all places where it stands in the derivation; intervals of one
period that touch are merged, compared word by word, and kept where they are
runs.

A batch's texts are compressed and searched together in flat arrays; periods
are tried in portions of fixed size. Work is n log n in a text's words.

Words are runs of characters other than space and 09 to 0D; they are compared
as they are. Null and empty texts have no words and no runs. Texts are read
whole, whatever their length. Every row has its own result, so repeated rows and
ties are alike; an empty table gives an empty table. Columns named like the
results are replaced, others stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.llm import arrays

EXPONENT, LEAST_WORDS = 4, 6
#: Periods tried at once.
PORTION = 1 << 19

_U64 = np.uint64
_RADIX = int(arrays.random_odd(1, 77)[0])
_UNDO = pow(_RADIX, -1, 1 << 64)

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,n_words:bigint,collapsed:string>"
_FOUND = pa.struct([("runs", pa.list_(_RUN)), ("n_words", pa.int64()), ("collapsed", pa.string())])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U64)
    out[:1] = 1
    return np.cumprod(out, dtype=_U64)


class Words:
    """Flat words of several texts, with hashes of any stretch."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        values = arrays.mix(ids.astype(_U64) + _U64(1))
        self.sums = np.concatenate([np.zeros(1, _U64), np.cumsum(values * _powers(_RADIX, len(ids)), dtype=_U64)])
        self.undo = _powers(_UNDO, len(ids) + 1)

    def hashed(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.undo[start]

    def ahead(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from ``a`` on equal those from ``b`` on, ``most`` at most."""
        return self._longest(most, lambda n: self.hashed(a, n) == self.hashed(b, n))

    def behind(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before ``a`` equal those before ``b``."""
        return self._longest(most, lambda n: self.hashed(a - n, n) == self.hashed(b - n, n))

    @staticmethod
    def _longest(most: np.ndarray, equal) -> np.ndarray:
        lo, hi = np.zeros_like(most), most.copy()
        while (lo < hi).any():
            middle = (lo + hi + 1) >> 1
            same = equal(middle)
            lo = np.where(same, middle, lo)
            hi = np.where(same, hi, middle - 1)
        return lo


class Grammar:
    """The nonterminals of a batch of texts, where they stand, and what is left of each text."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, least: int):
        self.low = self.cut = self.high = np.zeros(0, np.int64)
        self._keys = self._ids = np.zeros(0, np.int64)
        self._next = int(ids.max()) + 1 if len(ids) else 0
        self._events: list[tuple[np.ndarray, np.ndarray]] = []
        first = self._next
        at, owner = np.arange(len(ids)), np.repeat(np.arange(len(lengths)), lengths)
        ends = np.cumsum(lengths)
        symbols = ids.astype(np.int64)
        left_at, left_owner = [], []
        while len(at):
            chosen, keys = _winners(symbols, owner, least)
            active = np.zeros(len(lengths), bool)
            active[owner[chosen]] = True
            # Texts without a frequent pair are done.
            done = ~active[owner]
            left_at.append(at[done])
            left_owner.append(owner[done])
            if not len(chosen):
                break
            end = np.append(at[1:], 0)
            end[np.append(owner[1:] != owner[:-1], True)] = ends[owner[np.append(owner[1:] != owner[:-1], True)]]
            named = self._name(keys[chosen], at[chosen], at[chosen + 1], end[chosen + 1])
            self._events.append((named - first, at[chosen]))
            symbols = symbols.copy()
            symbols[chosen] = named
            stays = ~done
            stays[chosen + 1] = False
            symbols, at, owner = symbols[stays], at[stays], owner[stays]
        self.at, self.owner = np.concatenate([np.zeros(0, np.int64), *left_at]), np.concatenate([np.zeros(0, np.int64), *left_owner])
        order = np.argsort(self.at, kind="stable")
        self.at, self.owner = self.at[order], self.owner[order]

    def _name(self, keys: np.ndarray, low: np.ndarray, cut: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The nonterminals of pairs: those named in an earlier round, or new ones with the place where they first stand."""
        unique, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
        slot = np.searchsorted(self._keys, unique)
        old = np.zeros(len(unique), bool)
        inside = slot < len(self._keys)
        old[inside] = self._keys[slot[inside]] == unique[inside]
        ids = np.zeros(len(unique), np.int64)
        ids[old] = self._ids[slot[old]]
        n_new = int((~old).sum())
        ids[~old] = self._next + np.arange(n_new)
        self._next += n_new
        new = where[~old]
        self.low, self.cut, self.high = (np.concatenate([x, y[new]]) for x, y in ((self.low, low), (self.cut, cut), (self.high, high)))
        keys = np.concatenate([self._keys, unique[~old]])
        order = np.argsort(keys, kind="stable")
        self._keys, self._ids = keys[order], np.concatenate([self._ids, ids[~old]])[order]
        return ids[inverse]

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Every place in the derivation: the nonterminal, and where it begins; by nonterminal."""
        names, at = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*self._events)) if self._events else (np.zeros(0, np.int64),) * 2
        order = np.argsort(names, kind="stable")
        return names[order], at[order]

    def halves(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, boundary and end of the nodes that halve what is left of each text, over and over."""
        n = np.bincount(self.owner, minlength=len(lengths))
        first = np.cumsum(n) - n
        place = np.arange(len(self.at)) - first[self.owner]
        text_end = np.cumsum(lengths)[self.owner]
        bounds = np.append(self.at, 0)
        low, cut, high = [], [], []
        step = 1
        while step < (n.max() if len(n) else 0):
            here = np.flatnonzero(place % (2 * step) == step)
            inside = place[here] + step < n[self.owner[here]]
            low.append(self.at[here - step])
            cut.append(self.at[here])
            high.append(np.where(inside, bounds[np.where(inside, here + step, 0)], text_end[here]))
            step *= 2
        return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (low, cut, high))


def _winners(symbols: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a frequent pair begins that is more frequent than those it overlaps, and all pairs as keys.

    Ties are broken by a hash. Of a pair that overlaps itself every second place is taken.
    """
    n = len(symbols) - 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = symbols[:-1] << 32 | symbols[1:]
    inside = owner[:-1] == owner[1:]
    # Counted for each text, under hashes: a chance collision would only change which pairs win.
    counted = arrays.mix(keys[inside].astype(_U64)) ^ arrays.mix(owner[:-1][inside].astype(_U64) + _U64(1) << _U64(32))
    _, inverse, counts = np.unique(counted, return_inverse=True, return_counts=True)
    frequent = np.zeros(n, np.int64)
    frequent[inside] = counts[inverse]
    weight = np.where(frequent >= least, (frequent.astype(_U64) << _U64(32)) | (arrays.mix(keys.astype(_U64)) >> _U64(32)), _U64(0))
    before, after = np.append(_U64(0), weight[:-1]), np.append(weight[1:], _U64(0))
    same_before = np.append(False, (keys[1:] == keys[:-1]) & inside[1:] & inside[:-1])
    same_after = np.append(same_before[1:], False)
    places = np.arange(n)
    stretch = np.maximum.accumulate(np.where(same_before, 0, places))
    wins = (weight > 0) & ((places - stretch) % 2 == 0) & (same_before | (weight > before)) & (same_after | (weight > after))
    return np.flatnonzero(wins), keys


def _is_power(words: Words, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether a stretch with a period has a smaller one that divides it: a prime part of the period is tried at a time."""
    out = np.zeros(len(period), bool)
    if not len(period):
        return out
    rest, least = period.copy(), _least_factors(int(period.max()))
    while (open_ := (rest > 1) & ~out).any():
        at = np.flatnonzero(open_)
        prime = least[rest[at]]
        part = period[at] // prime
        n = length[at] - part
        out[at] = words.hashed(start[at], n) == words.hashed(start[at] + part, n)
        rest[at] //= prime
    return out


def _least_factors(n: int) -> np.ndarray:
    out = np.arange(n + 1)
    for k in range(2, int(n**0.5) + 1):
        if out[k] == k:
            multiples = np.arange(k * k, n + 1, k)
            out[multiples] = np.minimum(out[multiples], k)
    return out


def _at_boundaries(words: Words, low: np.ndarray, cut: np.ndarray, high: np.ndarray, exponent: int, least_words: int) -> np.ndarray:
    """Rows of (node, first word, end of the words that equal those a period on, period) for the stretches at the nodes' boundaries."""
    most = (high - low) // exponent
    most[high - low < least_words] = 0
    nodes = np.flatnonzero(most)
    ends = np.cumsum(most[nodes])
    found = [np.zeros((4, 0), np.int64)]
    total, ids = int(ends[-1]) if len(ends) else 0, words.ids
    for lo in range(0, total, PORTION):
        # The periods lo to hi of all (node, period) laid end to end.
        k = np.arange(lo, min(lo + PORTION, total))
        own = np.searchsorted(ends, k, "right")
        node = nodes[own]
        q = k - (ends[own] - most[node]) + 1
        a, b, c = low[node], cut[node], high[node]
        for side in (0, 1):
            # Either the word a period before the boundary equals the one on it, or the one before it that a period on.
            x = b - q if side == 0 else b - 1
            fits = (x >= a) & (x + q < c)
            x = np.where(fits, x, 0)
            y = np.where(fits, x + q, 0)
            fits &= ids[x] == ids[y]
            # So does one beside it, in a stretch of at least three words.
            near, far = np.minimum(y + 1, len(ids) - 1), np.maximum(x - 1, 0)
            fits &= ((y + 1 < c) & (ids[np.minimum(x + 1, len(ids) - 1)] == ids[near])) | ((x > a) & (ids[far] == ids[np.maximum(y - 1, 0)]))
            at = np.flatnonzero(fits)
            if not len(at):
                continue
            x, y, q_at = x[at], y[at], q[at]
            first = x - words.behind(x, y, x - a[at])
            end = x + words.ahead(x, y, c[at] - y)
            long = (end - first >= (exponent - 1) * q_at) & (end - first + q_at >= least_words)
            at, first, end, q_at = at[long], first[long], end[long], q_at[long]
            own_period = ~_is_power(words, first, end - first + q_at, q_at)
            found.append(np.stack([node[at], first, end, q_at])[:, own_period])
    return np.concatenate(found, axis=1)


def _merged(first: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of one period that touch, as one. Those of different texts never touch: a stretch ends a period before its text."""
    if not len(first):
        return first, end, period
    order = np.lexsort((first, period))
    first, end, period = first[order], end[order], period[order]
    # Periods are laid apart, so that one running maximum serves all.
    apart = int(end.max()) + 2
    lane = period * apart
    reach = np.maximum.accumulate(end + lane)
    new = np.append(True, (first + lane)[1:] > reach[:-1])
    begin = np.flatnonzero(new)
    return first[begin], np.maximum.reduceat(end, begin), period[begin]


def _compared(words: Words, first: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches word by word: where hashes were equal by chance, what is left of them."""
    out = [[first], [end], [period]]
    wrong = np.zeros(len(first), bool)
    n = end - first
    totals = np.cumsum(n)
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(totals, (totals[lo - 1] if lo else 0) + PORTION, "right")))
        size = n[lo:hi]
        at = np.repeat(first[lo:hi], size) + arrays.within(size)
        differs = words.ids[at] != words.ids[at + np.repeat(period[lo:hi], size)]
        wrong[lo:hi] = arrays.segment_sum(differs.astype(np.int64), size) > 0
        for k in lo + np.flatnonzero(wrong[lo:hi]):
            same = words.ids[first[k] : end[k]] == words.ids[first[k] + period[k] : end[k] + period[k]]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
            out[0].append(first[k] + edge[::2])
            out[1].append(first[k] + edge[1::2])
            out[2].append(np.full(len(edge) // 2, period[k]))
        lo = hi
    first, end, period = (np.concatenate([x[0][~wrong], *x[1:]]) for x in out)
    return first, end, period


def find(ids: np.ndarray, lengths: np.ndarray, exponent: int = EXPONENT, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start in the text, length and period of all runs, by text, start and period.

    ``ids`` are the word ids of all texts, laid end to end.
    """
    words, grammar = Words(ids), Grammar(ids, lengths, max(2, exponent - 1))
    once = _at_boundaries(words, grammar.low, grammar.cut, grammar.high, exponent, least_words)
    names, at = grammar.places()
    # Each nonterminal's stretches at all its places.
    begin, stop = np.searchsorted(names, once[0], "left"), np.searchsorted(names, once[0], "right")
    times = stop - begin
    each = np.repeat(np.arange(once.shape[1]), times)
    moved = at[begin[each] + arrays.within(times)] - grammar.low[once[0][each]] if len(each) else np.zeros(0, np.int64)
    halves = _at_boundaries(words, *grammar.halves(lengths), exponent, least_words)
    first, end, period = (np.concatenate([once[k][each] + (moved if k < 3 else 0), halves[k]]) for k in (1, 2, 3))
    first, end, period = _compared(words, *_merged(first, end, period))
    keep = (end - first >= (exponent - 1) * period) & (end - first + period >= least_words)
    first, end, period = first[keep], end[keep], period[keep]
    order = np.lexsort((period, first))
    first, length, period = first[order], (end - first + period)[order], period[order]
    text = np.searchsorted(np.cumsum(lengths), first, "right")
    return text, first - arrays.starts(lengths)[text], length, period


def _found(texts: pa.Array, exponent: int, least_words: int) -> pa.StructArray:
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = parts.flatten()
    lengths = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    held = pc.not_equal(flat, "").to_numpy(zero_copy_only=False).astype(bool)
    # White space at the ends of a text makes empty parts.
    flat, lengths = flat.filter(pa.array(held)), arrays.segment_sum(held.astype(np.int64), lengths)
    ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    text, start, length, period = find(ids, lengths, exponent, least_words)
    cover = np.zeros(len(flat) + 1, np.int64)
    first = arrays.starts(lengths)[text] + start
    np.add.at(cover, first + period, 1)
    np.add.at(cover, first + length, -1)
    kept = np.cumsum(cover)[:-1] == 0
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(_RUN))
    left = arrays.segment_sum(kept.astype(np.int64), lengths)
    words = pa.ListArray.from_arrays(_offsets(left), flat.filter(pa.array(kept)))
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(_offsets(np.bincount(text, minlength=len(lengths))), runs), pa.array(lengths), pc.binary_join(words, " ").cast(pa.string())],
        fields=list(_FOUND),
    )


def _offsets(n: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))


def periodic(text: Column, exponent: int = EXPONENT, least_words: int = LEAST_WORDS) -> Column:
    """``runs`` (start, length, period, in words, by start and period), ``n_words``, and the ``collapsed`` text.

    The collapsed text has its words joined by a space, without those that any run holds after its first period.
    """

    @F.arrow_udf(FOUND)
    def search(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        parts = [_found(part.column(0), exponent, least_words) for part in arrays.slices(batch, "text")]
        return pa.concat_arrays(parts) if parts else pa.array([], _FOUND)

    return search(text)


def find_runs(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """``df`` with ``runs``, ``n_words`` and ``collapsed`` of each text."""
    found = arrays.bounded_batches(df).withColumn("__found", periodic(F.col(text), **options))
    return found.withColumns({c: F.col(f"__found.{c}") for c in ("runs", "n_words", "collapsed")}).drop("__found")
