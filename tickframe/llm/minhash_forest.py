"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document is the set of its distinct word shingles. Documents with equal sets
form one class; classes are compared. A forest of several trees orders the
classes by their labels: a tree's label is a sequence of min-hashes, and two
classes agree on each of them with the probability of their similarity.
Neighbours in a sorted order with a common prefix of at least ``least_depth``
min-hashes are candidates. How deep the prefix is that neighbours share
depends on the region: where many classes crowd below a prefix, sorting puts
those next to each other that agree on further min-hashes.

The first round compares direct neighbours, confirms links on the full sets and
joins them to components. The second round compares the classes below a common
prefix that are still in different components: all of them where that makes at
most ``region_pairs`` pairs. The classes of regions with more are compared by
their rarest shingles instead, over all such regions at once: of two sets that
are similar enough, the shingles beyond the number that they must have in
common, taken from the rare end of one order for all, have one in common too. A
group of copies is one component by then, so it costs its size times the few
classes beside it. Two classes of similarity 0.8 share a prefix of three
min-hashes in none of 20 trees with probability 6e-7.

Candidates whose signatures agree on far fewer hashes than the similarity asks
for (by more than five standard deviations) are not confirmed. Links themselves
come from the exact sizes of intersection and union alone.

Null and empty texts and texts without words have an empty set and link with
nothing. Documents with a null id take part; a component's id is its smallest
non-null id. Repeated rows are members like others. Very long texts are read
whole. An empty table gives an empty table. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tickframe.llm import arrays, cells
from tickframe.llm.components import components
from tickframe.llm.ordering import neighbours
from tickframe.llm.shared import tidy, written

TREES, DEPTH, LEAST_DEPTH = 20, 6, 3
REGION_PAIRS = 20_000_000
SHINGLE, SIMILARITY = 5, 0.8

#: Bits of the map that says which texts are read for their sets.
MAP_BITS = 1 << 24

#: Shingles are counted by so many remainders of their hash, to put them in order of rarity.
REMAINDERS = 1 << 20

_HASH = np.dtype(">u2")


def _signatures(shingle: int, trees: int, depth: int):
    n_hashes = trees * depth

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = arrays.random_odd(2 * n_hashes, 41)
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                lengths, values = arrays.distinct(*arrays.shingles(*arrays.words(part.column("text")), shingle))
                full = lengths > 0
                begin = arrays.starts(lengths)[full]
                low = np.zeros((len(lengths), n_hashes), _HASH)
                for k in range(n_hashes):
                    if len(values):
                        hashed = (values + factor[2 * k + 1]) * factor[2 * k]
                        low[full, k] = (arrays.mix(np.minimum.reduceat(hashed, begin)) >> np.uint64(48)).astype(_HASH)
                key = arrays.mix(arrays.segment_sum(arrays.mix(values + np.uint64(7)), lengths) + lengths.astype(np.uint64))
                check = arrays.segment_sum(arrays.mix(values ^ factor[0]), lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("row"), pa.array(lengths), pa.array(arrays.signed(key)),
                        pa.array(arrays.signed(check)), pa.array([x.tobytes() for x in low], pa.binary()),
                    ],
                    ["doc_id", "row", "n_shingles", "node", "check", "signature"],
                )

    return sign


def _sets(shared, shingle: int):
    """The shingle sets of the rows in a bit map of wanted rows; others that share a bit come along and are joined away."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            row = batch.column("row").to_numpy(zero_copy_only=False)
            bit = (row & (MAP_BITS - 1)).astype(np.uint64)
            own = batch.filter(pa.array((wanted[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)))
            for part in arrays.slices(own, "text"):
                lengths, values = arrays.distinct(*arrays.shingles(*arrays.words(part.column("text")), shingle))
                yield pa.RecordBatch.from_arrays([part.column("row"), arrays.lists(lengths, arrays.signed(values))], ["row", "shingles"])

    return sets


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of the sets fall to each remainder: at most REMAINDERS rows a task."""
    total = np.zeros(REMAINDERS, np.int64)
    for batch in batches:
        _, values = cells.flat(pa.chunked_array([batch.column("shingles")]))
        total += np.bincount(values & (REMAINDERS - 1), minlength=REMAINDERS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["remainder", "n"])


def _rarest(shared, percent: int):
    """Of every set so many of its rarest shingles that two similar sets have one of them in common."""

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            begin, values = cells.flat(pa.chunked_array([batch.column("shingles")]))
            lengths = np.diff(begin).astype(np.int64)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            order = np.lexsort((values, counts[values & (REMAINDERS - 1)], owner))
            # Similar sets have at least this share of the larger one in common.
            n = lengths - (lengths * percent + 99) // 100 + 1
            kept = order[arrays.within(lengths) < np.repeat(n, lengths)]
            node, component = (batch.column(c).to_numpy(zero_copy_only=False)[owner[kept]] for c in ("node", "component"))
            yield pa.RecordBatch.from_arrays([pa.array(values[kept]), pa.array(node), pa.array(component)], ["bucket", "node", "component"])

    return rarest


def _bit_map(rows: DataFrame, bits: int = MAP_BITS) -> np.ndarray:
    """One bit for each remainder of a wanted row, however many rows there are."""
    bit = F.col("row").bitwiseAND(F.lit(bits - 1))
    words = rows.groupBy(F.shiftright(bit, 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(row & 63 as int))")).alias("bits")
    ).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def _sharing(least_depth: int):
    """Neighbours of one tree that share the prefix and are not joined yet."""

    def emit(rows: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.Table:
        if len(i):
            tree, node, component = (rows.column(c).to_numpy() for c in ("tree", "node", "component"))
            label = np.frombuffer(b"".join(rows.column("label").to_pylist()), _HASH).reshape(rows.num_rows, -1)
            keep = (tree[i] == tree[j]) & (component[i] != component[j])
            keep[keep] = (label[i[keep], :least_depth] == label[j[keep], :least_depth]).all(axis=1)
            a, b = node[i[keep]], node[j[keep]]
        else:
            a = b = np.zeros(0, np.int64)
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return emit


def _candidates(rows: pa.Table, percent: int, least_equal: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs of classes in a cell that may be similar enough, and on how many hashes they agree."""
    component, n = (rows.column(c).to_numpy() for c in ("component", "n_shingles"))
    signature = cells.fixed(rows.column("signature"), _HASH, rows.num_rows).astype(np.uint16)
    for i, j in cells.pairs(rows):
        keep = (component[i] != component[j]) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent)
        i, j = i[keep], j[keep]
        for lo in range(0, len(i), 20_000):
            a, b = i[lo : lo + 20_000], j[lo : lo + 20_000]
            same = signature[a] == signature[b]
            agree = same.sum(axis=1)
            keep = agree >= least_equal
            yield a[keep], b[keep], agree[keep]


def _meeting(percent: int, least_equal: int):
    """The entries of a cell that may be similar enough to another."""

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in cells.whole_cells(batches):
            own = np.zeros(rows.num_rows, bool)
            for i, j, _ in _candidates(rows, percent, least_equal):
                own[i] = own[j] = True
            yield from rows.filter(pa.array(own)).to_batches()

    return meeting


def _crossing(percent: int, least_equal: int):
    """Links confirmed on full sets; those within what a cell has already joined are not looked for."""

    def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in cells.whole_cells(batches):
            node, component = rows.column("node").to_numpy(), rows.column("component").to_numpy()
            begin, values = cells.flat(rows.column("shingles"))
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while (up := root.setdefault(x, x)) != x:
                    root[x] = root[up] if up in root else up
                    x = up
                return x

            found: list[tuple[int, int]] = []
            for i, j, agree in _candidates(rows, percent, least_equal):
                for k in np.argsort(-agree, kind="stable").tolist():
                    a, b = int(i[k]), int(j[k])
                    x, y = find(int(component[a])), find(int(component[b]))
                    if x == y:
                        continue
                    s, t = values[begin[a] : begin[a + 1]], values[begin[b] : begin[b + 1]]
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if both * 100 >= (len(s) + len(t) - both) * percent:
                        root[max(x, y)] = min(x, y)
                        found.append((int(node[a]), int(node[b])))
            at = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(at.min(axis=1) if len(at) else at[:, 0]), pa.array(at.max(axis=1) if len(at) else at[:, 0])], ["a", "b"])

    return crossing


@F.arrow_udf(IntegerType())
def _agreeing(a: pa.Array, b: pa.Array) -> pa.Array:
    """On how many hashes two signatures agree."""
    x, y = (np.frombuffer(b"".join(s.to_pylist()), _HASH).reshape(len(s), -1) for s in (a, b))
    return pa.array((x == y).sum(axis=1), pa.int32())


@tidy
def near_duplicates(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    trees: int = TREES,
    depth: int = DEPTH,
    least_depth: int = LEAST_DEPTH,
    region_pairs: int = REGION_PAIRS,
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``; ``row``, a hash of id and text, and ``first``, if that row stands for its group."""
    rows = arrays.bounded_batches(
        documents.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("row"), F.col(text).alias("text"))
    )
    signed = written(
        rows.mapInArrow(
            _signatures(shingle, trees, depth),
            f"doc_id {documents.schema[doc_id].dataType.simpleString()}, row long, n_shingles long, node long, check long, signature binary",
        )
    )
    classes = written(
        signed.where("n_shingles > 0").groupBy("node", "check", "n_shingles")
        .agg(F.min("row").alias("row"), F.max("signature").alias("signature"))
        .drop("check")
    )
    n_hashes = trees * depth
    least_equal = int(n_hashes * (similarity - 5 * (similarity * (1 - similarity) / n_hashes) ** 0.5))
    bytes_each = _HASH.itemsize * depth
    percent = round(similarity * 100)

    def forest(labelled: DataFrame) -> DataFrame:
        """Every class once for each tree."""
        tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
        label = F.substring("signature", F.col("tree") * bytes_each + 1, F.lit(bytes_each)).alias("label")
        return written(labelled.select("node", "component", "signature", tree).select("node", "component", "tree", label))

    def crossing(trees_of: DataFrame) -> DataFrame:
        """Links of classes that share a prefix but no component."""
        mixed = trees_of.withColumn("prefix", F.substring("label", 1, least_depth * _HASH.itemsize))
        lo_hi = mixed.groupBy("tree", "prefix").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        rows = written(mixed.join(lo_hi.where("lo <> hi").drop("lo", "hi"), ["tree", "prefix"]))
        here = in_regions(rows, ["tree", "prefix"])
        few = F.col("n") * (F.col("n") - F.col("most.n")) <= region_pairs
        regions_of = here.where(few).select(F.xxhash64("tree", "prefix").alias("bucket"), F.explode(looks).alias("side"), "node", "component")
        crowded = written(here.where(~few).select("node", "component").distinct())
        if not crowded.isEmpty():
            alike = in_regions(rarest(crowded), ["bucket"])
            regions_of = regions_of.unionByName(alike.select("bucket", F.explode(looks).alias("side"), "node", "component"))
        signed_rows = written(regions_of).join(classes.select("node", "n_shingles", "row", "signature"), "node")
        signed_rows = signed_rows.select("bucket", "side", "node", "component", "n_shingles", "row", "signature")
        entry = "bucket long, side int, node long, component long, n_shingles long, row long, signature binary, x int, y int"
        meeting = written(cells.by_cell(cells.dealt(written(signed_rows), cells.BLOCK)).mapInArrow(_meeting(percent, least_equal), entry))
        shipped = meeting.join(sets_of(written(meeting.select("row").distinct())), "row")
        return cells.by_cell(shipped).mapInArrow(_crossing(percent, least_equal), "a long, b long")

    # Those outside the region's largest component look at all.
    looks = F.when(F.col("component") != F.col("most.component"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))

    def in_regions(rows: DataFrame, keys: list[str]) -> DataFrame:
        """The rows of regions of more than one component, with their size and their largest component."""
        sizes = rows.groupBy(*keys, "component").agg(F.count("*").alias("n"))
        regions = sizes.groupBy(*keys).agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most")).where("n > most.n")
        return written(rows.join(regions, keys))

    def rarest(crowded: DataFrame) -> DataFrame:
        """``bucket, node, component``: the classes below their rarest shingles."""
        named = written(crowded.join(classes.select("node", "row"), "node"))
        sets = written(named.join(sets_of(written(named.select("row").distinct())), "row").drop("row"))
        counted = sets.select("shingles").mapInArrow(_counts, "remainder long, n long").groupBy("remainder").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(REMAINDERS, np.int64)
        counts[counted.column("remainder").to_numpy()] = counted.column("n").to_numpy()
        shared = documents.sparkSession.sparkContext.broadcast(counts)
        return written(sets.mapInArrow(_rarest(shared, percent), "bucket long, node long, component long"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """``row, shingles`` of the wanted rows."""
        shared = documents.sparkSession.sparkContext.broadcast(_bit_map(wanted))
        sets = rows.drop("doc_id").mapInArrow(_sets(shared, shingle), "row long, shingles array<long>")
        return written(sets.join(wanted, "row", "left_semi").groupBy("row").agg(F.first("shingles").alias("shingles")))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs of classes whose full sets are similar enough."""
        own = classes.select("node", "n_shingles", "row", "signature")
        a, b = (own.toDF(x, f"n_{x}", f"row_{x}", f"signature_{x}") for x in "ab")
        pairs = written(
            pairs.distinct().join(a, "a").join(b, "b")
            .where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
            .where(_agreeing("signature_a", "signature_b") >= least_equal)
            .drop("signature_a", "signature_b")
        )
        wanted = written(pairs.select(F.col("row_a").alias("row")).union(pairs.select("row_b")).distinct())
        sets = sets_of(wanted)
        left, right = (sets.toDF(f"row_{x}", f"set_{x}") for x in "ab")
        both = F.size(F.array_intersect("set_a", "set_b"))
        return written(
            pairs.join(left, "row_a").join(right, "row_b")
            .where(both * 100 >= (F.col("n_a") + F.col("n_b") - both) * percent)
            .select("a", "b")
        )

    order = ["tree", "label", "node"]
    first = forest(classes.withColumn("component", F.col("node")))
    links = confirmed(neighbours(first, order, 1, _sharing(least_depth), "a long, b long"))
    found = written(components(links))
    placed = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    further = crossing(forest(placed))
    reached = written(components(links.unionByName(further)))

    members = signed.select("doc_id", "row", "n_shingles", "node").join(reached, "node", "left")
    # Documents without words are in no group.
    members = members.withColumn("group", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")))
    # The smallest id, null last; of a group without ids, the smallest hash.
    first_of = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")).alias("first")
    least = written(members.where("group IS NOT NULL").groupBy("group").agg(first_of))
    linked = members.join(least, "group", "left")
    own = F.col("group").isNull()
    component_id = F.when(own, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return linked.select(
        "doc_id",
        "n_shingles",
        component_id.alias("component_id"),
        F.coalesce(F.col("doc_id") == component_id, F.lit(False)).alias("kept"),
        "row",
        (own | (F.col("row") == F.col("first.row"))).alias("first"),
    )


def _marked(shared, bits: int):
    """Whether a row's bit is set in a map of ``bits`` bits."""

    @F.arrow_udf("boolean")
    def marked(rows: pa.Array) -> pa.Array:
        bit = (rows.to_numpy(zero_copy_only=False) & (bits - 1)).astype(np.uint64)
        return pa.array((shared.value[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool))

    return marked


def _map_bits(rows: int) -> int:
    """Eight bits a row, a power of two between 2**20 and 2**30: 128 MB at most."""
    return 1 << min(max((8 * rows).bit_length(), 20), 30)


def one_of_each(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``documents`` with one row of every group of near-duplicates; rows without words all stay.

    Only the hashes of rows to drop, or to keep once of several, are looked at: a bit map of them is tested where the
    rows are, and those whose bit is set go through an exact join. All others pass on without a shuffle.
    """
    name = "__row"
    rows = documents.withColumn(name, F.xxhash64(doc_id, text))
    found = near_duplicates(documents, doc_id, text, **options)
    by_row = found.groupBy("row").agg(F.max("first").alias("stays"), F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles"))
    repeated = (F.col("copies") > 1) & (F.col("n_shingles") > 0)
    touched = written(by_row.where(~F.col("stays") | repeated).select(F.col("row").alias(name), "stays"))
    bits = _map_bits(touched.count())
    bit_map = documents.sparkSession.sparkContext.broadcast(_bit_map(touched.withColumnRenamed(name, "row"), bits))
    marked = arrays.bounded_batches(rows).withColumn("__marked", _marked(bit_map, bits)(name))
    looked_at = marked.where("__marked").join(touched, name, "left")
    once = looked_at.where("stays").dropDuplicates([name])
    kept = marked.where("NOT __marked").select(*documents.columns)
    for part in (looked_at.where("stays IS NULL"), once):
        kept = kept.unionByName(part.select(*documents.columns))
    return kept
