from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.data import documents, prose, with_clashes
from tickframe.llm import catalog, decontamination, kneser_ney, mixing, suffix_array
from tickframe.llm.ordering import neighbours
from tickframe.llm.shared import written

ITEM = "item_id long, text string"


def test_edited_items_are_found_and_clean_texts_left(spark):
    rng = random.Random(7)
    items = [(k, " ".join(prose(500 + k, 30, 100_000))) for k in range(30)]
    clean = [(k, " ".join(prose(k, 200))) for k in range(60)]
    dirty = []
    for k, text in items:
        words = [w if rng.random() > 0.15 else "changed" for w in text.split()]
        dirty.append((1000 + k, " ".join(prose(2000 + k, 80) + words + prose(3000 + k, 80))))
    rows = clean + dirty + [(1, None), (2, ""), (None, items[0][1]), (3000, items[1][1].upper() + "."), (3000, items[1][1].upper() + ".")]
    df = with_clashes(documents(spark, rows), "item_id", "score", "row", "item")
    bench = with_clashes(spark.createDataFrame(items + [(98, None), (99, ""), (None, "a b")], ITEM), "doc_id", "words")
    for at_once in (2_000_000, 200):
        got = Counter((r.doc_id, r.item_id) for r in decontamination.contaminated(df, bench, broadcast_grams=at_once).collect())
        assert got == Counter([(1000 + k, k) for k in range(30)] + [(None, 0), (3000, 1), (3000, 1)])
    assert sorted(r.doc_id for r in decontamination.clean(df, bench).collect()) == sorted([k for k, _ in clean] + [1, 2])
    assert decontamination.contaminated(documents(spark, []), bench).count() == 0
    assert decontamination.clean(df, spark.createDataFrame([], ITEM)).count() == df.count()


def test_short_items_and_common_phrases(spark):
    bench = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "we go home at the end of the"), (4, "it is late now")], ITEM)
    texts = {10: "so alpha beta it is", 11: "Gamma! rays", 12: "by the end of the day we sat down", 13: "alpha and beta", 14: "and then we go home at the end of the week",
             15: "it is late", 16: "he said it is late now", 17: "alpha", 18: "and we go home at the start of the day"}
    df = documents(spark, list(texts.items()))
    got = sorted((r.doc_id, r.item_id) for r in decontamination.contaminated(df, bench).collect())
    assert got == [(10, 1), (11, 2), (14, 3), (16, 4), (18, 3)]
    # A word or two are no reason to drop a document.
    assert {r.doc_id for r in decontamination.clean(df, bench).collect()} == set(texts) - {14, 16, 18}


def test_seeds_of_very_many_items_are_expanded_in_steps(spark, monkeypatch):
    stem = " ".join(prose(1, 12))
    bench = spark.createDataFrame([(k, f"{stem} {' '.join(prose(100 + k, 3))}") for k in range(60)], ITEM)
    df = documents(spark, [(k, f"{' '.join(prose(500 + k, 20))} {stem} {' '.join(prose(100 + k, 3))} {stem}") for k in range(8)])

    def found():
        return sorted(map(tuple, decontamination.contaminated(df, bench).collect()))

    whole = found()
    assert len(whole) == 8 * 60 and {(r[0], r[1]) for r in whole if r[2] == 1.0} == {(k, k) for k in range(8)}
    monkeypatch.setattr(decontamination, "PORTION", 10)
    assert found() == whole


def test_alignment_equals_the_full_table():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 20)), rng.integers(0, 6, rng.integers(0, 30))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = max(0, table[i, j] + (2 if a[i] == b[j] else -1), table[i, j + 1] - 1, table[i + 1, j] - 1)
        score, lo, hi = decontamination.align(a, b)
        assert score == table.max()
        assert decontamination.align(a, b[lo:hi])[0] == score


def targets_by_brute_force(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, out, still = share * sum(sizes.values()), {}, set(names)
    while still:
        level = left / sum(weight[s] for s in still)
        over = {s for s in still if weight[s] * level > most * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in still}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        still -= over
    return out


def test_mix_meets_its_targets(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for k in range(400):
        source = rng.choice(["a", "a", "a", "a", "b", "B", "é", None, "tiny"]) if k else "tiny"
        rows.append((k, " ".join(["w"] * rng.randrange(0, 50)), None, source))
    rows += [(9, "same text", None, "dup")] * 3 + [(None, None, None, "empty"), (None, "\x1c \x85", None, "b")]
    df = with_clashes(documents(spark, rows), "size", "taken", "key", "range", "target")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = targets_by_brute_force(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert taken[s] == math.floor(want[s] + 0.5)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df.repartition(7)).collect()))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 2)
    monkeypatch.setattr(mixing, "BLOCK_RANGES", 3)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df).collect()))
    assert mixing.mix(documents(spark, [])).count() == 0
    assert mixing.mix(df, carry=["text", "key"]).where("taken > 0").columns[-2:] == ["text", "key"]


def passages_by_brute_force(rows, least):
    words = [(text or "").split() for _, text in rows]
    where = defaultdict(set)
    for k, w in enumerate(words):
        for i in range(len(w) - least + 1):
            where[tuple(w[i : i + least])].add(k)
    out = defaultdict(set)
    for k, w in enumerate(words):
        for i in range(len(w) - least + 1):
            if len(where[tuple(w[i : i + least])]) > 1:
                out[rows[k][0]] |= set(range(i, i + least))
    return out


def test_repeated_passages_equal_brute_force(spark):
    rows = [(900, None), (901, ""), (902, "short"), (903, " ".join(["again"] * 300))]
    shared = [prose(100 + k, n) for k, n in enumerate((49, 50, 51, 80, 200, 700))]
    for k in range(60):
        rows.append((k, " ".join(prose(k, 40 + k) + shared[k % 6] + prose(k + 5000, 30))))
    rows += [(70, " ".join(shared[4][:120])), (71, " ".join(shared[4][60:])), (72, " ".join(shared[5])), (73, " ".join(shared[5])), (None, " ".join(shared[3]))]
    df = with_clashes(documents(spark, rows), "row", "gram", "start", "partner", "first")
    got = defaultdict(set)
    for r in suffix_array.repeated_passages(df).collect():
        assert r.n_words == r.end_word - r.start_word >= 50
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    assert got == passages_by_brute_force(rows, 50)
    assert suffix_array.repeated_passages(documents(spark, [])).count() == 0


def test_passages_that_stand_often_in_one_document(spark):
    passage = prose(9, 60)
    often = [w for k in range(200) for w in passage + prose(100 + k, 12, 10**6)]
    rows = [(1, " ".join(often)), (2, " ".join(prose(1, 30) + passage + prose(2, 30)))]
    want = passages_by_brute_force(rows, 50)
    assert len(want[1]) == 200 * 60
    for parts in ("3", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = defaultdict(set)
        try:
            for r in suffix_array.repeated_passages(documents(spark, rows)).collect():
                got[r.doc_id] |= set(range(r.start_word, r.end_word))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == want


@pytest.mark.parametrize("parts,size", [(1, 7), (4, 3), (9, 10_000)])
def test_neighbours_of_other_runs_equal_brute_force(spark, parts, size):
    rng = random.Random(parts)
    rows = sorted({(rng.randrange(6), rng.randrange(10**6), rng.choice([1, 1, 1, 1, 1, 1, 2, 3])) for _ in range(400)})
    rows = sorted({*rows, *((7, k, 1) for k in range(150)), (7, 200, 2)})

    def emit(table, i, j):
        at = table.column("at").to_numpy()
        return pa.table({"a": pa.array(at[i], pa.int64()), "b": pa.array(at[j], pa.int64())})

    want = {(k - d, k) for d in (1, 2) for k in range(d, len(rows))}
    key = [(g, r) for g, _, r in rows]
    for k in range(len(rows)):
        want |= {(j, k) for j in range(k - 1, -1, -1) if key[j] != key[k] and all(x == key[k] for x in key[j + 1 : k])}
        want |= {(k, j) for j in range(k + 1, len(rows)) if key[j] != key[k] and all(x == key[k] for x in key[k + 1 : j])}
    before = {name: spark.conf.get(name) for name in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled")}
    for name, value in zip(before, (parts, size, "false")):
        spark.conf.set(name, str(value))
    try:
        df = spark.createDataFrame([(g, v, r, k) for k, (g, v, r) in enumerate(rows)], "g long, v long, r long, at long").repartition(3)
        got = [tuple(r) for r in neighbours(written(df), ["g", "v", "r"], 2, emit, "a long, b long", ["g", "r"]).collect()]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert set(got) == want and len(got) == len(want)


def test_one_copy_of_a_passage_comes_first(spark):
    text = " ".join(prose(1, 90))
    found = suffix_array.repeated_passages(documents(spark, [(k, text) for k in range(30)])).collect()
    assert len(found) == 30 and sum(r.first for r in found) == 1


def kneser_ney_by_hand(trusted, text):
    """Perplexity of ``text`` under the model, from the formulas."""
    order = kneser_ney.ORDER
    full = Counter()
    for t in trusted:
        padded = "\x01" * (order - 1) + t
        full.update(padded[k : k + order] for k in range(len(t)))
    tables = {order: full}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    discounts = {}
    for k, table in tables.items():
        n = [sum(1 for c in table.values() if c == x) for x in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        raw = [x - (x + 1) * y * n[x] / n[x - 1] if n[x - 1] else x * y for x in (1, 2, 3)]
        discounts[k] = [min(max(d, 0.05), x - 0.05) for x, d in enumerate(raw, 1)]

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (len(tables[1]) + 1)
        same = [(g, c) for g, c in tables[k].items() if g[:-1] == gram[:-1]]
        total = sum(c for _, c in same)
        if not total:
            return p(gram[1:])
        cut = [discounts[k][min(c, 3) - 1] for _, c in same]
        own = next((c - d for (g, c), d in zip(same, cut) if g == gram), 0)
        return own / total + sum(cut) / total * p(gram[1:])

    padded = "\x01" * (order - 1) + text
    return math.exp(-sum(math.log(p(padded[k : k + order])) for k in range(len(text))) / len(text))


def test_perplexity_equals_the_formulas(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcab d") for _ in range(60)) for _ in range(30)]
    rows = [(k, t, "aa") for k, t in enumerate(texts)] + [(100, "zzzz!", "aa"), (101, None, "aa"), (102, "", None), (None, "abc abc", None)]
    df = with_clashes(documents(spark, rows), "perplexity", "row", "trusted", "median", "n")
    trusted = spark.createDataFrame([(k,) for k in [*range(25), 3, None, 4000]], "doc_id long")
    learnt = [r.doc_id for r in spark.range(25).selectExpr("id AS doc_id").where(F.pmod(F.xxhash64(F.lit("held out"), "doc_id"), F.lit(kneser_ney.HELD_OUT)) != 0).collect()]
    for at_once in (4_000_000, 0):
        got = {r.doc_id: r for r in kneser_ney.judge(df, trusted, broadcast_grams=at_once).collect()}
        assert len(got) == len(rows)
        for k in (0, 27, 100, None):
            text = next(t for i, t, *_ in rows if i == k)
            assert got[k].perplexity == pytest.approx(kneser_ney_by_hand([texts[i] for i in learnt], text), rel=1e-6)
        assert got[101].perplexity is None and not got[101].kept and not got[102].kept and not got[100].kept and got[27].kept
    nothing = kneser_ney.judge(df, trusted.limit(0)).collect()
    assert {r.doc_id: r.kept for r in nothing if r.doc_id in (0, 101)} == {0: True, 101: False}
    assert kneser_ney.judge(documents(spark, []), trusted).count() == 0


def test_pipeline_on_small_tables(spark, tmp_path):
    long = " ".join(prose(1, 60))
    rows = [
        (1, long, "en", "a"), (2, long + " end", "en", "a"), (3, " ".join(prose(2, 60)), None, None), (4, None, "en", "a"), (5, "123", "en", "b"),
        (6, " ".join(prose(9, 40)), "en", "b"), (7, "token=abcdef and more words here", "en", "b"), (8, "", "en", "b"),
    ]
    with_clashes(documents(spark, rows), "row", "extra", "taken").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(prose(9, 40)))], ITEM).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids.append(sorted(r.doc_id for r in docs.collect()))
        if name == "secrets":
            seven = docs.where("doc_id = 7").first()
            assert seven.text == "[SECRET] and more words here" and seven.n_chars == len(seven.text)
    assert ids[:4] == [[1, 2, 3, 6, 7], [1, 3, 6, 7], [1, 3, 7], [1, 3, 7]]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {1, 3, 7}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], ITEM).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_run_on_the_tables(spark, name):
    df = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.columns and df.count() >= 0
