from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.data import documents, prose, with_clashes
from tickframe.llm import embedding_dedup, minhash_forest
from tickframe.llm.components import components


def groups_by_brute_force(rows, shingle, percent=80):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        grams = {tuple(words[k : k + shingle]) for k in range(len(words) - shingle + 1)}
        sets.append(grams or ({tuple(words)} if words else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for k, (doc_id, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(doc_id)
    return {k: (len(sets[k]), min((x for x in ids[find(k)] if x is not None), default=None)) for k in range(len(rows))}


def edited(words, rate, rng):
    return [f"e{rng.randrange(99999)}" if rng.random() < rate else w for w in words]


@pytest.mark.parametrize("shingle", [4, 5])
def test_groups_equal_brute_force(spark, shingle):
    rng = random.Random(3)
    rows = [(None, "a null id"), (900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, "two words"), (906, "É é")]
    for k in range(40):
        base = prose(k, rng.randrange(30, 300))
        rows += [(len(rows), " ".join(edited(base, rate, rng))) for rate in (0, 0, 0.01, 0.02, 0.03, 0.04, 0.06)]
    hub = prose(999, 120)
    rows += [(5000 + k, " ".join(edited(hub, 0.02, rng))) for k in range(60)]
    rows += [(7000, " ".join(prose(1, 30_000))), (7001, " ".join(prose(1, 30_000)) + " more")]
    df = with_clashes(documents(spark, rows), "row", "node", "component", "group", "signature", "first")
    found = minhash_forest.near_duplicates(df, shingle=shingle).collect()
    want = groups_by_brute_force(rows, shingle)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found], key=repr) == sorted(
        [(rows[k][0], n, c, rows[k][0] is not None and rows[k][0] == c) for k, (n, c) in want.items()], key=repr
    )


def test_crowded_regions_take_longer_prefixes(spark):
    rng = random.Random(8)
    hub = prose(5, 100)
    rows = [(k, " ".join(edited(hub, 0.02 + 0.04 * rng.random(), rng))) for k in range(80)]
    found = minhash_forest.near_duplicates(documents(spark, rows), region_pairs=5, trees=30).collect()
    want = groups_by_brute_force(rows, 5)
    assert {r.doc_id: r.component_id for r in found} == {rows[k][0]: c for k, (_, c) in want.items()}


def template_crowd(n, seed):
    """Texts that share a template and do not link, but each with one other."""
    rng = random.Random(seed)
    template, rows = prose(5, 80), []
    for k in range(n):
        both = prose(1000 + k, 3, 10**6)
        rows += [" ".join(template + both + prose(3000 + 2 * k + own, 9, 10**6)) for own in (0, 1)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_overfull_regions_are_compared_whole(spark):
    rows = template_crowd(150, 1)
    want = groups_by_brute_force(rows, 5)
    assert len({c for _, c in want.values()}) == 150
    found = minhash_forest.near_duplicates(documents(spark, rows), region_pairs=5).collect()
    assert {r.doc_id: r.component_id for r in found} == {rows[k][0]: c for k, (_, c) in want.items()}


def test_candidates_do_not_rely_on_an_earlier_tree():
    signature = np.arange(120, dtype=">u2").tobytes()
    rows = pa.table({
        "bucket": [1, 1], "x": [0, 0], "y": [0, 0], "side": [0, 1], "node": [1, 2], "component": [1, 2], "tree": [7, 7],
        "n_shingles": [10, 10], "signature": pa.array([signature, signature], pa.binary()),
    })
    cell = next(minhash_forest._meeting(percent=80, least_equal=74)(rows.to_batches()))
    assert cell.num_rows == 2


def test_one_of_each_keeps_a_row_of_every_group(spark):
    text = " ".join(prose(1, 50))
    rows = [(1, text), (1, text), (2, text), (None, "alone here"), (None, "alone here"), (4, None), (4, None), (5, "")]
    kept = minhash_forest.one_of_each(documents(spark, rows))
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr) == sorted([(1, text), (None, "alone here"), (4, None), (4, None), (5, "")], key=repr)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert minhash_forest.one_of_each(documents(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 301)]
    random.Random(1).shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 160)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def linked_by_brute_force(rows, cosine=0.95):
    ids = [i for i, _ in rows]
    valid = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in valid:
        for b in valid:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], np.float32).astype(float), np.array(rows[b][1], np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[a] += 1
                    links[b] += 1
                    root[find(b)] = find(a)
    least = {}
    for k in range(len(rows)):
        least.setdefault(find(k), []).append(ids[k])
    return [(ids[k], links[k], min((i for i in least[find(k)] if i is not None), default=None)) for k in range(len(rows))]


def near_vectors(rng, base, cosine):
    other = rng.normal(size=base.shape)
    other -= (other @ base) * base
    return cosine * base + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other)


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(1000, None), (1001, []), (1002, [0.0] * 64), (1003, [float("nan")] * 64), (1004, [float("inf")] + [0.0] * 63), (1005, [None] + [1.0] * 63)]
    for k in range(120):
        base = rng.normal(size=64)
        base /= np.linalg.norm(base)
        rows += [(len(rows), base.tolist())] + [(len(rows) + 1 + j, near_vectors(rng, base, c).tolist()) for j, c in enumerate((0.955, 0.97, 0.94))]
    crowd = rng.normal(size=64)
    crowd /= np.linalg.norm(crowd)
    rows += [(2000 + k, near_vectors(rng, crowd, 0.99).tolist()) for k in range(70)] + [(2000, crowd.tolist()), (None, crowd.tolist()), (2300, (2 * crowd).tolist())]
    rows += [(3000, [1.0, 0.0]), (3001, [1.0, 0.01]), (3002, [0.0, 1.0]), (3003, [1.0])]
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "node", "component", "n_links")
    for block in (16, 512):
        found = embedding_dedup.near_duplicates(df, block=block).collect()
        got = sorted([(r.vec_id, r.n_links, r.component_id) for r in found], key=repr)
        assert got == sorted(linked_by_brute_force(rows), key=repr)
        assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in found)


def test_embeddings_empty_and_single(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in embedding_dedup.near_duplicates(one).collect()] == [(1, 0, 1, True)]


def test_recall_at_the_least_cosine(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(400):
        base = rng.normal(size=64)
        base /= np.linalg.norm(base)
        rows += [(2 * k, base.tolist()), (2 * k + 1, near_vectors(rng, base, 0.951).tolist())]
    found = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sum(r.n_links for r in found) >= 0.99 * len(rows)


@pytest.mark.parametrize("bits", [10, 17, 23, 27, 30])
def test_pairs_meet_at_every_number_of_bits(bits):
    rng = np.random.default_rng(bits)
    tables = embedding_dedup.tables_for(bits, 0.95, embedding_dedup.TABLES, embedding_dedup.PROBE_BITS)
    unit = rng.normal(size=(2000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    model = embedding_dedup.learn(unit, bits, tables, steps=5)
    met = 0
    for v in unit[:400]:
        pair = [v.tolist(), near_vectors(rng, v, 0.95).tolist()]
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(pair)], ["node", "vector"])
        out = next(embedding_dedup._entries(model, bits, tables, embedding_dedup.PROBE_BITS)(iter([batch])))
        bucket, side, node = (out.column(c).to_numpy() for c in ("bucket", "side", "node"))
        met += any(np.isin(bucket[(side == 0) & (node == a)], bucket[(side == 1) & (node == b)]).any() for a, b in ((1, 2), (2, 1)))
    assert met >= 396
