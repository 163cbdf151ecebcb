"""Near-duplicate documents by SimHash, searched with Burkhard-Keller trees.

A fingerprint has a bit for each of the 64 that more than half of the text's shingle hashes have set. In a tree, a node's
children are keyed by their Hamming distance to it, so that a search within a radius follows only the edges within the
radius of the query's own distance. One tree of everything would be one task's, and its searches reach most of it: 64-bit
codes of unlike texts are all about 32 bits apart. So the codes are cut into more blocks than the radius: two codes within
it agree on some blocks, hence meet in the bucket of these. A shard is a run of buckets with a tree each, its codes are its
queries, and shards hold at most ``SHARD`` codes: those of a larger bucket are split, and each part's tree is sent to every
other part's queries. Shards pass on links that span what they found, not all of it, and nothing passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from trackmotif.llm.components import components
from trackmotif.llm.memory import release
from trackmotif.llm.words import _LOWER
from trackmotif.session import materialise, ship_package

BITS, SEED = 64, 42
RADIUS, SIZE = 3, 3
#: Codes of a shard, and (query, node) pairs that are looked at together.
SHARD, FRONTIER = 1 << 16, 1 << 20
#: Codes that a bucket has on average, beyond which more of the blocks make its key.
CROWD = 256
CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = SIZE) -> int:
    """The text's fingerprint; without words it is zero."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    line, width = b" ".join(words), min(size, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(starts), CHUNK):
        h = np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[k : k + CHUNK], ends[k : k + CHUNK], strict=True)), "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(k) for k in np.flatnonzero(2 * ones > len(starts)))


class Forest:
    """Trees over codes: codes with one value of ``tree`` (sorted) are a tree, whose root is the first of them."""

    def __init__(self, tree: np.ndarray, codes: np.ndarray):
        self.codes = codes
        self.trees, first, of = np.unique(tree, return_index=True, return_inverse=True)
        self.roots = first
        left = np.setdiff1d(np.arange(len(codes)), first, assume_unique=True)
        at = first[of[left]]
        keys, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(left):  # all codes go down one level: the first at a distance from a node is its child, the others go below that
            key = at * (BITS + 1) + np.bitwise_count(codes[left] ^ codes[at])
            edges, head, mine = np.unique(key, return_index=True, return_inverse=True)
            keys.append(edges)
            nodes.append(left[head])
            at = left[head][mine]
            rest = np.ones(len(left), bool)
            rest[head] = False
            left, at = left[rest], at[rest]
        edges, nodes = np.concatenate(keys), np.concatenate(nodes)
        order = np.argsort(edges)
        self.edges, self.nodes = edges[order], nodes[order]

    def search(self, tree: np.ndarray, codes: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs within the radius, some at a time; queries go to their tree, which must exist."""
        waiting = [(np.arange(len(codes)), self.roots[np.searchsorted(self.trees, tree)])]
        while waiting:
            query, node = waiting.pop()
            if len(query) > FRONTIER:
                waiting.append((query[FRONTIER:], node[FRONTIER:]))
                query, node = query[:FRONTIER], node[:FRONTIER]
            apart = np.bitwise_count(codes[query] ^ self.codes[node]).astype(np.int64)
            near = apart <= radius
            if near.any():
                yield query[near], node[near]
            low = np.searchsorted(self.edges, node * (BITS + 1) + np.maximum(apart - radius, 0))
            n = np.searchsorted(self.edges, node * (BITS + 1) + np.minimum(apart + radius, BITS), "right") - low
            if n.any():
                places = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
                waiting.append((np.repeat(query, n), self.nodes[places]))


def spanned(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the ends of the pairs the smallest label of their component, in place; label[k] <= k leads to a root."""
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for side in (before[a], before[b], a, b):
            np.minimum.at(label, side, low)
        while (label != label[label]).any():
            label[:] = label[label]
        if (label == before).all():
            return


def _shard_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links that span what a tree finds; rows (cell, fp, query) come sorted by cell, whose nodes have query 0 or 1."""

    def links(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        cell, fp, role = (rows.column(k).to_numpy() for k in range(3))
        codes = fp.view(np.uint64)
        nodes, queries = np.flatnonzero(role < 2), np.flatnonzero(role > 0)
        found = np.arange(len(codes))
        if len(nodes) and len(queries):
            forest = Forest(cell[nodes], codes[nodes])
            queries = queries[np.isin(cell[queries], forest.trees)]
            for q, n in forest.search(cell[queries], codes[queries], radius):
                spanned(found, queries[q], nodes[n])
        ends = np.flatnonzero(found != np.arange(len(found)))
        return pa.RecordBatch.from_arrays([pa.array(fp[ends]), pa.array(fp[found[ends]])], names=["a", "b"])

    held, n, last = [], 0, None
    for batch in batches:
        cells = batch.column(0).to_numpy()
        other = np.flatnonzero(cells != last)
        if n >= SHARD and len(other):
            yield links([*held, batch.slice(0, other[0])])
            held, n, batch = [], 0, batch.slice(other[0])
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
            last = cells[-1]
    if held:
        yield links(held)
    release()


def _keys(fp: Column, radius: int, n: int) -> list[Column]:
    """Bucket keys of a code, so that codes within the radius share one; the more codes there are, the longer keys."""
    for chosen in range(1, BITS - radius):
        blocks = radius + chosen
        bounds = [BITS * k // blocks for k in range(blocks + 1)]
        if n <= CROWD << (BITS * chosen // blocks) or chosen == 4:
            break
    tables = []
    for number, picked in enumerate(combinations(range(blocks), chosen)):
        key, width = F.lit(number).cast("long"), 0
        for k in picked:
            size = bounds[k + 1] - bounds[k]
            key = F.shiftleft(key, size).bitwiseOR(F.shiftrightunsigned(fp, bounds[k]).bitwiseAND(F.lit((1 << size) - 1)))
        tables.append(key)
    return tables


def links(codes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) whose components are those of all pairs of codes ``fp`` (distinct, signed 64-bit) within the radius."""
    if radius < 1:
        raise ValueError("a radius is 1 at least")
    entries = codes.select("fp", F.explode(F.array(*_keys(F.col("fp"), radius, codes.count()))).alias("bucket"))
    crowded = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    half = SHARD // 2
    parts = F.ceil(F.col("n") / half).cast("long")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts"))
    both = entries.join(crowded, "bucket").withColumn("parts", parts).withColumn("mine", mine)
    # Part i's tree meets the queries of part j >= i in cell (i, j): 0 is a node, 2 a query, 1 is both.
    role = F.when(F.col("mine") == F.col("other"), 1).when(F.col("mine") < F.col("other"), 0).otherwise(2)
    cells = both.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    single = F.col("parts") == 1
    cell = F.when(single, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")))
    rows = cells.select(cell.alias("cell"), "fp", role.cast("int").alias("role"))
    return rows.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(lambda batches: _shard_links(batches, radius), "a long, b long")


def fingerprints(df: DataFrame, size: int = SIZE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed 64-bit number) of every row."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), size) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])
        release()

    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def near_duplicates(df: DataFrame, size: int = SIZE, radius: int = RADIUS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id for every row of ``df``.

    Rows are linked whose fingerprints differ in ``radius`` bits or fewer; component_id is the smallest identifier
    reachable, itself included. Equal fingerprints are one node. Null, empty and blank texts have fingerprint zero and are
    linked like any other. Rows with one identifier but several texts link their groups. A null identifier is no
    candidate for component_id: its row gets the smallest of its group, null if the group has no other. Other columns are
    left out; an empty table gives no rows.
    """
    rows = materialise(fingerprints(df, size, id_column, text_column), "fingerprints")
    codes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "codes")
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top")
    own = rows.join(several.select("doc_id", "b"), "doc_id").select(F.col("fp").alias("a"), "b")
    found = components(links(codes.select("fp"), radius).union(own))
    linked = codes.join(found.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "low", F.coalesce("component_id", "fp").alias("label"))
    linked = materialise(linked, "labels")
    least = linked.groupBy("label").agg(F.min("low").alias("component_id"))
    of = linked.select("fp", "label").join(least, "label").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
