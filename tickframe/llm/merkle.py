"""Merkle manifest of a table: a digest for every row, a root for all, and proofs that tie one to the other.

Rows are grouped (say by source) and ordered by an integer id. Their places
come from bitmaps, not from a sort: per group, the ids are set in a bitmap of
which the non-empty 64-bit words are kept, merged over all tasks. A popcount
directory, running counts of rows on three levels of id prefixes, says how many
ids lie before each word; that number and the bits of the own word below the id
are an id's rank. Each level of the directory counts within one prefix of the
level above, so a task holds at most a fixed number of its entries, however
sparse or dense the ids are.

By its rank a digest goes to a slot of a block of 3**6 slots. Inside a block,
runs of three become their digest, six levels at once; the blocks' digests are
the nodes of the next round. The groups' roots, in the order of the groups, make
one more tree of the same kind. Proofs are handed down the same way: a block
gets the path above it once, and adds its own six levels for each slot.

A null id is an id, before all others; a null group comes first. Ids that repeat
inside a group leave more rows than bits in a word: the rows of such words, and
only those, are numbered by id, digest and place in the written table, over many
tasks. Null and empty texts have digests like others; long ones are read whole.
An empty table gives an empty table. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm import arrays
from tickframe.llm.shared import tidy, written
from tickframe.operators.numbering import numbered

RUN, LEVELS = 3, 6
SLOTS = RUN**LEVELS
#: Bits of an id inside a word of the bitmap, and of a word's number inside the directory's two lower levels.
WORD_BITS, MIDDLE_BITS, TOP_BITS = 6, 18, 20
#: The word of null ids, before all others.
NULL_WORD = -(1 << 60)

STEPS = "array<struct<left:string,right:string>>"


def digest(*values: Column) -> Column:
    """SHA-256 over the values, each ``-`` if null, else its number of UTF-8 bytes, a colon, and itself."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(part, values)), 256)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def levels(digests: list[str], whole: bool) -> list[list[str]]:
    """The digests of a block, level by level: LEVELS of them for a block among others, else up to the one that remains."""
    out = [digests]
    while len(out) <= LEVELS if whole else len(out[-1]) > 1:
        row = out[-1]
        out.append([_sha("".join(row[k : k + RUN])) for k in range(0, len(row), RUN)])
    return out


def path(rows: list[list[str]], slot: int) -> list[tuple[str, str]]:
    """What stands left and right of a slot's node in its run, from its own level to the one below the block's digest."""
    out = []
    for row in rows[:-1]:
        first = slot - slot % RUN
        out.append(("".join(row[first:slot]), "".join(row[slot + 1 : first + RUN])))
        slot //= RUN
    return out


def fold(leaf: str, steps: list[tuple[str, str]]) -> str:
    """The root that a leaf and the siblings of its path lead to."""
    for left, right in steps:
        leaf = _sha(left + leaf + right)
    return leaf


def _ordered(slots: list[dict]) -> list[dict]:
    out: list = [None] * len(slots)
    for slot in slots:
        out[slot["slot"]] = slot
    return out


def _block_digest() -> Column:
    @F.arrow_udf("string")
    def top(slots: pa.Array, n: pa.Array) -> pa.Array:
        out = [levels([s["digest"] for s in _ordered(own)], size > SLOTS)[-1][0] for own, size in zip(slots.to_pylist(), n.to_pylist())]
        return pa.array(out, pa.string())

    return top("slots", "n")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of blocks with their whole paths."""
    for batch in batches:
        for block in batch.to_pylist():
            rows = levels([s["digest"] for s in _ordered(block["slots"])], block["n"] > SLOTS)
            above = [(s["left"], s["right"]) for s in block["steps"]]
            steps = [[{"left": a, "right": b} for a, b in path(rows, k) + above] for k in range(len(rows[0]))]
            yield pa.RecordBatch.from_pydict(
                {
                    "key": [block["key"]] * len(steps),
                    "position": [block["block"] * SLOTS + k for k in range(len(steps))],
                    "steps": steps,
                    "subroot": [block["subroot"]] * len(steps),
                },
                pa.schema([("key", pa.string()), ("position", pa.int64()), ("steps", _STEPS), ("subroot", pa.string())]),
            )


_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _checked(with_proofs: bool):
    """The rows of blocks with the digest of their proof and the root that the claimed leaf leads to."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                slots = _ordered(block["slots"])
                rows = levels([s["digest"] for s in slots], block["n"] > SLOTS)
                above = [(s["left"], s["right"]) for s in block["steps"]]
                siblings = hashlib.sha256
                out: dict[str, list] = {c: [] for c in ("doc_id", "position", "leaf", "subroot", "proof_sha256", "folded_root", "proof")}
                for k, slot in enumerate(slots):
                    steps = path(rows, k) + above
                    out["doc_id"].append(slot["doc_id"])
                    out["position"].append(block["block"] * SLOTS + k)
                    out["leaf"].append(slot["digest"])
                    out["subroot"].append(block["subroot"])
                    out["proof_sha256"].append(siblings("".join(a + b for a, b in steps).encode("ascii")).hexdigest())
                    out["folded_root"].append(fold(slot["claimed"] or slot["digest"], steps))
                    out["proof"].append([{"left": a, "right": b} for a, b in steps] if with_proofs else None)
                types = [pa.int64(), pa.int64(), *[pa.string()] * 4, _STEPS]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))

    return checked


def _word() -> Column:
    return F.coalesce(F.shiftright("doc_id", WORD_BITS), F.lit(NULL_WORD))


def _bit() -> Column:
    """An id's place inside its word."""
    return F.coalesce(F.col("doc_id").bitwiseAND(F.lit((1 << WORD_BITS) - 1)), F.lit(0)).cast("int")


def _running(*keys: str, order: str) -> Column:
    """Rows before the own entry among those of the same prefix."""
    return F.sum("n").over(Window.partitionBy(*keys).orderBy(order)) - F.col("n")


def ranked(leaves: DataFrame) -> DataFrame:
    """``leaves`` (key, doc_id, digest, ...) with ``n``, the size of their group, and ``position`` from 0 by id."""
    leaves = leaves.withColumn("word", _word())
    set_bit = F.call_function("shiftleft", F.lit(1).cast("long"), _bit())
    words = written(leaves.groupBy("key", "word").agg(F.count("*").alias("n"), F.bit_or(set_bit).alias("bits")))
    middle = words.groupBy("key", F.shiftright("word", MIDDLE_BITS).alias("middle")).agg(F.sum("n").alias("n"))
    top = middle.groupBy("key", F.shiftright("middle", TOP_BITS).alias("top")).agg(F.sum("n").alias("n"))
    top = top.select("key", "top", F.sum("n").over(Window.partitionBy("key")).alias("size"), _running("key", order="top").alias("before_top"))
    middle = middle.withColumn("top", F.shiftright("middle", TOP_BITS))
    middle = middle.withColumn("before_middle", _running("key", "top", order="middle")).drop("n").join(top, ["key", "top"])
    words = words.withColumn("middle", F.shiftright("word", MIDDLE_BITS))
    words = words.withColumn("before_word", _running("key", "middle", order="word")).join(middle, ["key", "middle"])
    before = F.col("before_word") + F.col("before_middle") + F.col("before_top")
    directory = written(
        words.select("key", "word", F.col("size").alias("n"), "bits", before.alias("before"), (F.col("n") > F.bit_count("bits")).alias("repeats"))
    )
    placed = leaves.join(directory, ["key", "word"])
    below = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), _bit()))
    once = placed.where(~F.col("repeats")).withColumn("position", F.col("before") + F.bit_count(F.col("bits").bitwiseAND(below)))
    again = directory.where("repeats")
    if not again.isEmpty():
        rows = leaves.withColumn("place", F.monotonically_increasing_id()).join(again, ["key", "word"])
        in_order = written(numbered(rows, ["key", "word", "doc_id", "digest", "place"], "number", written))
        first = in_order.groupBy("key", "word").agg(F.min("number").alias("first"))
        position = F.col("before") + F.col("number") - F.col("first")
        once = once.unionByName(in_order.join(first, ["key", "word"]).withColumn("position", position).drop("place", "number", "first"))
    return once.drop("word", "bits", "before", "repeats")


def _blocks(nodes: DataFrame, *carry: str) -> DataFrame:
    """The slot arrays of all blocks; ``nodes`` has key, n, position and digest."""
    slot = F.struct((F.col("position") % SLOTS).cast("int").alias("slot"), "digest", *carry)
    block = F.expr(f"position div {SLOTS}").alias("block")
    return arrays.bounded_batches(written(nodes.groupBy("key", "n", block).agg(F.collect_list(slot).alias("slots"))))


def _rounds(nodes: DataFrame, *carry: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round, and the digest that remains of each key."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    out = [_blocks(nodes, *carry)]
    while True:
        most = -(-most // SLOTS)
        tops = written(
            out[-1].select(
                "key", F.expr(f"(n + {SLOTS - 1}) div {SLOTS}").alias("n"), F.col("block").alias("position"), _block_digest().alias("digest")
            )
        )
        if most <= 1:
            return out, tops.select("key", "digest")
        out.append(_blocks(tops))


def _joined(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Blocks with the path above them."""
    return arrays.bounded_batches(blocks.join(above.withColumnRenamed("position", "block"), ["key", "block"]))


def _lowered(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """``key, position, steps, subroot`` for the blocks of the first round, from those of whole trees."""
    for blocks in reversed(rounds[1:]):
        above = written(_joined(blocks, above).mapInArrow(_opened, f"key string, position long, steps {STEPS}, subroot string"))
    return above


@tidy
def verify(
    documents: DataFrame, leaf: Column, claimed: Column | None = None, doc_id: str = "doc_id", group: str = "source", with_proofs: bool = False
) -> DataFrame:
    """One row per document: ``doc_id``, ``position`` in its group, ``leaf``, ``subroot`` of the group, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``.

    ``leaf`` is a row's digest (see ``digest``). ``claimed``, where not null, is the digest of what a reader was given:
    ``folded_root`` is what it leads to with the siblings of the row's path, and ``verified`` says if that is the root.
    ``proof_sha256`` is the digest of those siblings, from the leaf to the root; ``with_proofs`` adds them as ``proof``.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit(""))
    given = F.lit(None).cast("string") if claimed is None else claimed
    leaves = written(documents.select(key.alias("key"), F.col(doc_id).cast("long").alias("doc_id"), leaf.alias("digest"), given.alias("claimed")))
    rounds, subroots = _rounds(ranked(leaves), "doc_id", "claimed")

    n_groups = subroots.count()
    groups = numbered(subroots, ["key"], "position", written).withColumnRenamed("key", "group")
    groups = written(groups.withColumn("key", F.lit("")).withColumn("n", F.lit(n_groups).cast("long")))
    over_groups, roots = _rounds(groups, "group")
    root = roots.first()
    start = roots.select("key", F.lit(0).cast("long").alias("position"), F.array().cast(STEPS).alias("steps"), F.col("digest").alias("subroot"))
    paths = _joined(over_groups[0], _lowered(over_groups, start)).mapInArrow(_opened, f"key string, position long, steps {STEPS}, subroot string")
    of_group = paths.select("position", "steps").join(groups.select("position", "group", "digest"), "position")
    above = written(of_group.select(F.col("group").alias("key"), F.lit(0).cast("long").alias("position"), "steps", F.col("digest").alias("subroot")))

    schema = f"doc_id long, position long, leaf string, subroot string, proof_sha256 string, folded_root string, proof {STEPS}"
    found = _joined(rounds[0], _lowered(rounds, above)).mapInArrow(_checked(with_proofs), schema)
    found = found.withColumn("root", F.lit(root.digest if root else None).cast("string")).withColumn("verified", F.col("folded_root") == F.col("root"))
    return found if with_proofs else found.drop("proof")


def oracle_sql() -> str:
    """The same manifest of ``documents`` as DuckDB SQL, tampering included: trees level by level, paths folded step by step."""

    def part(value: str) -> str:
        return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(map(part, ('doc_id', 'source', 'lang', 'n_chars', text)))})"

    bit = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, k: {bit})"
    codes = "list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT))"
    crc = f"xor(list_reduce({codes}, lambda c, b: {byte}), 4294967295)"

    def tree(name: str, leaves: str) -> str:
        """``name``: every node with its siblings to the left and right, and how many nodes its level has."""
        counted = "SELECT *, count(*) OVER (PARTITION BY key) AS n"
        run = f"OVER (PARTITION BY key, level, i // {RUN} ORDER BY i ROWS BETWEEN"
        return f"""
        {name}_nodes AS (
            SELECT 0 AS level, key, i, h FROM {leaves}
            UNION ALL
            SELECT level + 1, key, i // {RUN}, sha256(string_agg(h, '' ORDER BY i))
            FROM ({counted} FROM {name}_nodes) WHERE n > 1 GROUP BY level, key, i // {RUN}
        ),
        {name} AS (
            SELECT level, key, i, h, count(*) OVER (PARTITION BY key, level) AS n,
                coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lefts,
                coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rights
            FROM {name}_nodes
        )"""

    def folded(name: str, start: str, of: str) -> str:
        """``name``: every step of every document's path through a tree."""
        return f"""
        {name} AS (
            SELECT doc_id, 0 AS level, key, i, h, proof FROM {start}
            UNION ALL
            SELECT f.doc_id, f.level + 1, f.key, f.i // {RUN}, sha256(t.lefts || f.h || t.rights), f.proof || t.lefts || t.rights
            FROM {name} f JOIN {of} t ON t.key = f.key AND t.level = f.level AND t.i = f.i AND t.n > 1
        ),
        {name}_end AS (SELECT doc_id, arg_max(h, level) AS h, arg_max(proof, level) AS proof, any_value(key) AS key FROM {name} GROUP BY doc_id)"""

    return f"""
    WITH RECURSIVE
        leaves AS (
            SELECT coalesce('=' || source, '') AS key, doc_id, {leaf('text')} AS h,
                row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS i,
                CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} END AS tampered
            FROM documents
        ),
        {tree("inner_tree", "leaves")},
        groups AS (SELECT '' AS key, row_number() OVER (ORDER BY key) - 1 AS i, h, key AS source_key FROM inner_tree WHERE n = 1),
        {tree("outer_tree", "groups")},
        whole AS (SELECT h FROM outer_tree WHERE n = 1),
        given AS (SELECT doc_id, key, i, coalesce(tampered, h) AS h, '' AS proof FROM leaves),
        {folded("inner_fold", "given", "inner_tree")},
        entered AS (SELECT doc_id, g.key, g.i, f.h, f.proof FROM inner_fold_end f JOIN groups g ON g.source_key = f.key),
        {folded("outer_fold", "entered", "outer_tree")}
    SELECT l.doc_id, l.i AS position, l.h AS leaf, g.h AS subroot, (SELECT h FROM whole) AS root, sha256(f.proof) AS proof_sha256,
        f.h AS folded_root, f.h = (SELECT h FROM whole) AS verified
    FROM leaves l JOIN groups g ON g.source_key = l.key JOIN outer_fold_end f ON f.doc_id = l.doc_id
    """
