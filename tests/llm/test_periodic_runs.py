from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.data import documents, rows_of, with_clashes
from tickframe.llm import catalog, periodic_runs


def runs_by_brute_force(words, exponent=4, least_words=6):
    """Maximal stretches for every period, without those that have a smaller period."""
    out = []
    for q in range(1, len(words) // exponent + 1):
        same = [words[k] == words[k + q] for k in range(len(words) - q)] + [False]
        start = None
        for k, equal in enumerate(same):
            if equal and start is None:
                start = k
            elif not equal and start is not None:
                run = words[start : k + q]
                smaller = any(all(run[i] == run[i + p] for i in range(len(run) - p)) for p in range(1, q))
                if len(run) >= max(least_words, exponent * q) and not smaller:
                    out.append((start, len(run), q))
                start = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed_by_brute_force(words, runs):
    dropped = {k for start, length, period in runs for k in range(start + period, start + length)}
    return " ".join(w for k, w in enumerate(words) if k not in dropped)


def found(texts, **options):
    return periodic_runs._found(pa.array(texts, pa.string()), options.get("exponent", 4), options.get("least_words", 6)).to_pylist()


def tangled(seed):
    """Words of a small vocabulary, with stretches that repeat, some inside others."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(rng.choice([1, 2, 3, 5, 40]))}" for _ in range(rng.randrange(150))]
    for _ in range(rng.randrange(4) if len(words) > 8 else 0):
        a = rng.randrange(len(words))
        period, end = rng.randrange(1, (len(words) - a) // 3 + 2), rng.randrange(a, len(words) + 1)
        words[a:end] = [words[a + k % min(period, end - a)] for k in range(end - a)]
    return words


@pytest.mark.parametrize("exponent,least_words", [(4, 6), (3, 4), (6, 10)])
def test_equals_brute_force(exponent, least_words):
    for seed in range(0, 300, 10):
        texts = [tangled(k) for k in range(seed, seed + 10)]
        for words, row in zip(texts, found([" ".join(w) for w in texts], exponent=exponent, least_words=least_words)):
            want = runs_by_brute_force(words, exponent, least_words)
            assert [tuple(r.values()) for r in row["runs"]] == want
            assert row["collapsed"] == collapsed_by_brute_force(words, want) and row["n_words"] == len(words)


def test_small_portions_change_nothing(monkeypatch):
    texts = [" ".join(tangled(k)) for k in range(40)]
    whole = found(texts)
    monkeypatch.setattr(periodic_runs, "PORTION", 7)
    assert found(texts) == whole


def test_grammar_derives_the_texts():
    texts = [tangled(k) for k in range(30)]
    lengths = np.array([len(t) for t in texts])
    ids = np.unique([w for t in texts for w in t], return_inverse=True)[1]
    grammar = periodic_runs.Grammar(ids, lengths, 3)
    names, at = grammar.places()
    size = grammar.high - grammar.low
    for name, start in zip(names, at):
        # A nonterminal stands for the same words wherever it stands, and for more than one.
        low = grammar.low[name]
        assert size[name] >= 2 and (ids[start : start + size[name]] == ids[low : low + size[name]]).all()
        assert low < grammar.cut[name] < grammar.high[name]
    assert len(grammar.low) and (np.diff(grammar.at) > 0).all()


def test_chance_collisions_of_hashes_are_undone():
    """Stretches that claim too much are cut to the words that are equal."""
    ids = np.array([0, 1] * 6 + [2] + [0, 1] * 6)
    words = periodic_runs.Words(ids)
    first, end, period = periodic_runs._compared(words, np.array([0]), np.array([23]), np.array([2]))
    assert list(zip(first, end, period)) == [(0, 10, 2), (13, 23, 2)]


def test_texts_of_all_kinds(spark):
    texts = [None, "", " \t\n\x0b\x0c\r ", "a", "a " * 5, "a " * 6, "A a " * 3, "é x " * 8, "a b " * 100_000, "x " + "a b c " * 4 + "a b y"]
    df = with_clashes(documents(spark, [*enumerate(texts), (8, texts[8]), (None, texts[5])]), "runs", "n_words", "collapsed")
    got = rows_of(periodic_runs.find_runs(df).select("doc_id", "runs", "n_words", "collapsed"))
    want = []
    for k, text in [*enumerate(texts), (8, texts[8]), (None, texts[5])]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = [(0, 200_000, 2)] if k == 8 else runs_by_brute_force(words)
        want.append((k, runs, len(words), collapsed_by_brute_force(words, runs)))
    assert [(i, [tuple(r) for r in runs], n, c) for i, runs, n, c in got] == sorted(want, key=repr)
    assert [len(r) for _, r, _, _ in got if r] == [1] * 6
    assert periodic_runs.find_runs(documents(spark, [])).count() == 0


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    out = {r.doc_id: r for r in catalog.QUERIES["op13_periodic_runs"](spark, sf_dir).collect()}
    assert out.keys() == rows.keys()
    for doc_id, text in rows.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + k % p] for k in range(n - a)]
        runs, r = runs_by_brute_force(words), out[doc_id]
        longest = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *longest)
        assert r.exponent_milli == (1000 * longest[1] // longest[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed_by_brute_force(words, runs).encode()).hexdigest()
    assert any(r.n_runs for r in out.values())
