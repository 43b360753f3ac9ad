from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from tests.compare import connect, differences
from tests.llm.data import documents, with_clashes
from tickframe.llm import catalog, merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[c] for c in FIELDS)))


def tree(row):
    rows = [row]
    while len(rows[-1]) > 1:
        rows.append([sha("".join(rows[-1][k : k + 3])) for k in range(0, len(rows[-1]), 3)])
    return rows


def siblings(rows, slot):
    out = []
    for row in rows[:-1]:
        first = slot // 3 * 3
        out.append(("".join(row[first:slot]), "".join(row[slot + 1 : first + 3])))
        slot //= 3
    return out


def by_brute_force(rows):
    """Sorted (doc_id, position, leaf, subroot, root, proof digest) of all rows."""
    groups = {}
    for row in rows:
        groups.setdefault(row.source, []).append((row.doc_id is not None, row.doc_id or 0, leaf_of(row)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s])]) for s in order}
    whole = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for slot, (has_id, doc_id, leaf) in enumerate(sorted(groups[s])):
            steps = siblings(trees[s], slot) + siblings(whole, k)
            out.append((doc_id if has_id else None, slot, leaf, trees[s][-1][0], whole[-1][0], sha("".join(a + b for a, b in steps))))
    return sorted(out, key=repr)


def found(df, **options):
    out = merkle.verify(df, merkle.digest(*map(F.col, FIELDS)), **options).collect()
    assert all(r.verified and r.folded_root == r.root for r in out)
    return sorted(((r.doc_id, r.position, r.leaf, r.subroot, r.root, r.proof_sha256) for r in out), key=repr)


@pytest.fixture
def small_blocks(monkeypatch):
    """Trees of several rounds on small tables."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "SLOTS", 9)


IDS = [-(2**63), -(2**40), -65, -64, -1, 0, 62, 63, 64, 2**24 - 1, 2**24, 2**44 + 1, 2**63 - 1]


def test_equals_brute_force_over_several_rounds(spark, small_blocks):
    rows = [(k, f"text {k}", "en", "s") for k in range(200)] + [(k * 7, f"other {k}", None, None) for k in range(28)]
    rows += [(k, "one", "en", f"lone{k}") for k in range(11)] + [(k, "é\n\U0001F600" * 5, "", "wide") for k in IDS]
    df = with_clashes(documents(spark, rows), "key", "word", "digest", "claimed", "position", "n", "slots")
    assert found(df) == by_brute_force(df.collect())


def test_repeated_and_missing_ids_texts_and_groups(spark, small_blocks):
    rows = [(5, "a", None, "s")] * 30 + [(5, f"b{k}", None, "s") for k in range(30)] + [(None, None), (None, "x"), (None, ""), (None, "", None, "s")]
    rows += [(k, None, None, "s") for k in range(20)] + [(1, "long " * 200_000, "en", "t"), (2, "", "en", "")]
    df = documents(spark, rows)
    assert found(df) == by_brute_force(df.collect())


@pytest.mark.parametrize("rows", [[(1, "x")], [(1, "x", None, "a"), (1, "x", None, "b")], [(k, "x", None, "a") for k in range(4)]])
def test_small_trees(spark, rows):
    df = documents(spark, rows)
    assert found(df) == by_brute_force(df.collect())


def test_no_rows(spark):
    assert found(documents(spark, [])) == []


def test_tampering_is_found_and_proofs_are_whole(spark):
    df = documents(spark, [(k, f"line\n{k}" if k % 3 else f"line {k}", "en", "s") for k in range(50)])
    fields = [F.col(c) for c in FIELDS[:-1]]
    claimed = F.when(F.col("doc_id") % 2 == 0, merkle.digest(*fields, F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    for r in merkle.verify(df, merkle.digest(*fields, F.col("text")), claimed, with_proofs=True).collect():
        assert r.verified == (r.doc_id % 2 != 0 or r.doc_id % 3 == 0)
        assert merkle.fold(r.leaf, [tuple(s) for s in r.proof]) == r.root
        assert r.proof_sha256 == sha("".join(s.left + s.right for s in r.proof))


def test_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    theirs = connect(sf_dir).execute(catalog.ORACLE_SQL["op11_merkle_manifest"]).df()
    assert len(theirs) and differences(catalog.QUERIES["op11_merkle_manifest"](spark, sf_dir).toPandas(), theirs) == []
