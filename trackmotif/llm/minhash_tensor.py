"""Near-duplicate documents by MinHash with tensored banding.

Two collections of sub-keys, each of a few minima, take the place of independent tables: table (i, j) has the key
(a_i, b_j), so that m * m tables of 2 * rows minima each need only 2 * m * rows minima. With m = 16 and 4 minima a sub-key,
256 tables are made from 128 minima where independent ones take 2048. Two sets of similarity 0.8 share a table with
probability (1 - (1 - 0.8**4)**16)**2 > 0.9995, of 0.85 with > 0.9999.

Equal sets are one node. A sub-key that only one set has can't be part of a shared table and goes before the tables
are formed. In each bucket every set is first compared with the bucket's smallest identifier; only sets that are then
still in different components are compared further, and links are always confirmed on the full sets.

Sets hold 64-bit hashes of shingles: two sets of n and m shingles have a pair of different shingles with one hash with a
probability below n * m / 2**64, so below 1e-9 for sets of 100,000, and only one of many would turn a link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmotif.llm.components import components
from trackmotif.llm.memory import release
from trackmotif.llm.words import BASE, mix, spaced
from trackmotif.session import materialise, ship_package

COLLECTION, MINIMA, SEED = 16, 4, 20_261
BLOCK, RARE = 1024, 8
#: Sets of one component that make it a class of its own under a sub-key.
LARGE = 32
#: Similarity, as a percentage, from which two documents are linked.
PERCENT = 80

def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``size``-word shingles; of the whole if it has fewer words."""
    w = spaced(text).hashes
    if len(w) == 0:
        return w
    width = min(size, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for k in range(width):
        h = h * BASE + w[k : len(w) - width + 1 + k]
    return np.unique(mix(h))


@lru_cache(maxsize=2)
def _parameters(minima: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers and summands of the hash functions, and room for a block of their values."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 64, minima, np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, minima, np.uint64), np.empty((BLOCK, minima), np.uint64)


def subkeys(h: np.ndarray, collection: int = COLLECTION, minima: int = MINIMA) -> np.ndarray:
    """2 * collection sub-keys of a set of hashes, as signed 64-bit: even ones are of collection a, odd ones of b."""
    a, b, room = _parameters(2 * collection * minima)
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(h), BLOCK):
        part = room[: len(h[k : k + BLOCK])]
        np.multiply(h[k : k + BLOCK, None], a, out=part)
        np.add(part, b, out=part)
        np.minimum(low, part.min(axis=0), out=low)
    key = np.arange(2 * collection, dtype=np.uint64)
    for part in low.reshape(2 * collection, minima).T:
        key = mix(key * BASE + part)
    side = (np.arange(2 * collection) >= collection).astype(np.uint64)
    return ((key << np.uint64(1)) | side).view(np.int64)


def _signatures(df: DataFrame, size: int, collection: int, minima: int) -> DataFrame:
    """doc_id, n_shingles, set_key (of the whole set) and sub-keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("subkeys", pa.list_(pa.int64()))])
        for batch in batches:
            counts, keys, subs = [], [], []
            for text in batch.column(1):
                h = shingles(text.as_py(), size)
                counts.append(len(h))
                keys.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                subs.append(subkeys(h, collection, minima) if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(subs, pa.list_(pa.int64()))], schema=schema)
        release()

    return df.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, subkeys array<long>")


def _sets(df: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("set", pa.list_(pa.int64()))])
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py(), size).view(np.int64) for t in part.column(1)], pa.list_(pa.int64()))], schema=schema)
        release()

    return df.mapInArrow(run, "id long, set array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("sa").cast("long") + F.size("sb") - both)).select("a", "b")


def near_duplicates(df: DataFrame, size: int = 5, percent: int = PERCENT, collection: int = COLLECTION, minima: int = MINIMA, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``df``.

    Documents whose sets of ``size``-word shingles have a similarity of ``percent`` / 100 or more are linked;
    component_id is the smallest identifier reachable. Null or empty texts have no shingles and are linked with nothing.
    Rows with one identifier count as one document, linked by any of them. A row with a null identifier gets the
    component of its set, null if no other row has it, and is not kept. Other columns are left out.
    """
    spark = df.sparkSession
    ship_package(spark)
    docs = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    rows = materialise(_signatures(docs, size, collection, minima), "signatures")
    named = rows.where("doc_id is not null and set_key is not null")
    classes = named.groupBy("set_key").agg(F.min("doc_id").alias("id"))
    nodes = named.join(classes.withColumnRenamed("set_key", "k"), (F.col("set_key") == F.col("k")) & (F.col("doc_id") == F.col("id"))).select("id", "n_shingles", "subkeys")

    # Sub-keys that at least two sets have, then the tables' keys of each set.
    keys = nodes.select("id", F.explode("subkeys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
    parts = keys.join(shared, "key", "left_semi").groupBy("id").agg(F.collect_set("key").alias("keys"))
    odd = lambda k: k.bitwiseAND(F.lit(1)) == 1
    halves = materialise(parts.select("id", F.filter("keys", lambda k: ~odd(k)).alias("ka"), F.filter("keys", odd).alias("kb")), "halves")
    table = halves.select("id", "kb", F.explode("ka").alias("x")).select("id", "x", F.explode("kb").alias("y")).select("id", F.xxhash64("x", "y").alias("bucket"))
    buckets = table.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    entries = materialise(table.join(buckets, "bucket").select("bucket", "id", "low"), "buckets")

    stars = materialise(entries.where("id <> low").groupBy("id", "low").agg(F.lit(1).alias("one")).select(F.col("id").alias("a"), F.col("low").alias("b")), "stars")
    needed = entries.select("id").distinct()
    texts = docs.where("doc_id is not null").withColumnRenamed("doc_id", "id").join(needed, "id", "left_semi")
    sets = materialise(_sets(texts, size), "sets")

    # Each set with the smallest identifier it meets; then with other buckets' smallest, where components still differ.
    links = materialise(_confirmed(stars.groupBy("a").agg(F.min("b").alias("b")), sets, percent), "confirmed")
    for pairs in (lambda of: _apart(stars, of), lambda of: _rest(entries, halves, sets, of, percent)):
        of = materialise(components(links), "components")
        links = materialise(links.union(_confirmed(pairs(of), sets, percent)), "confirmed")
    # An identifier with several sets links the classes of these.
    several = named.select("doc_id", "set_key").distinct().join(classes, "set_key").groupBy("doc_id").agg(F.min("id").alias("low"), F.collect_set("id").alias("ids")).where(F.size("ids") > 1)
    own = several.select(F.explode("ids").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
    of = components(links.select("a", "b").union(own))

    found = classes.join(of, "id", "left").select("set_key", F.coalesce("component_id", "id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "set_key").join(found, "set_key", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _labelled(df: DataFrame, of: DataFrame, column: str, name: str) -> DataFrame:
    labels = of.select(F.col("id").alias(column), F.col("component_id").alias(f"_{name}"))
    return df.join(labels, column, "left").withColumn(name, F.coalesce(f"_{name}", column)).drop(f"_{name}")


def _apart(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The pairs whose sides are in different components."""
    return _labelled(_labelled(pairs, of, "a", "ca"), of, "b", "cb").where("ca <> cb").select("a", "b")


def _fits(percent: int) -> Column:
    """Whether sets of n and n2 shingles, of which s and s2 can be common, can be similar enough."""
    m = F.least("s", "s2")
    return 100 * m >= percent * (F.col("n") + F.col("n2") - m)


def _twin(rows: DataFrame, *same: str) -> DataFrame:
    return rows.select(*same, *(F.col(x).alias(f"{x}2") for x in rows.columns if x not in same))


def _classes(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (key, c, n, s and others) with a class, and the pairs class, class2 of which rows can be similar enough.

    Rows of a key are of one class if they agree in n and s and are of one component of more than ``LARGE`` rows there, or
    of any smaller ones. So the rows of a large component never meet each other, and those that no row of the key fits, as
    in a family whose members all lie below the limit, meet none: only their classes are compared.
    """
    large = rows.groupBy("key", "c").agg(F.count("*").alias("f")).where(F.col("f") > LARGE).select("key", "c", F.col("c").alias("d"))
    of = F.xxhash64("key", F.col("d").isNull(), "d", "n", "s")
    named = rows.join(large, ["key", "c"], "left").withColumn("class", of)
    each = named.select("key", "d", "n", "s", "class").distinct()
    apart = F.col("d").isNull() | F.col("d2").isNull() | (F.col("d") < F.col("d2"))
    return named.drop("d"), each.join(_twin(each, "key"), "key").where(_fits(percent) & apart).select("class", "class2").distinct()


def _rest(entries: DataFrame, halves: DataFrame, sets: DataFrame, of: DataFrame, percent: int) -> DataFrame:
    """The pairs that share a table, are in different components, and can be similar enough.

    Of the sets in buckets of several components, a shingle that at most ``RARE`` have is rare. Pairs with a rare shingle
    in common are found by it: no shingle makes more than RARE * RARE / 2. All others have at most m = min(s, s') shingles
    in common, where s of a set's n are not rare, so their similarity is at most m / (n + n' - m): what falls short is
    never formed (see ``_classes``). Each other pair is formed once, under the smallest sub-key of the first collection that
    it shares.
    """
    labelled = _labelled(entries, of, "id", "c")
    mixed = labelled.groupBy("bucket").agg(F.min("c").alias("lc"), F.max("c").alias("hc")).where("lc < hc").select("bucket")
    nodes = materialise(labelled.join(mixed, "bucket", "left_semi").select("id", "c").distinct(), "mixed")
    # An identifier may have several sets: each is ruled by its own size.
    own = sets.join(nodes, "id").select("id", F.xxhash64("set").alias("of"), "c", "set", F.size("set").cast("long").alias("n")).dropDuplicates(["id", "of"])
    own = materialise(own, "mixed-sets")
    shingles_of = own.select("id", "of", F.explode("set").alias("shingle"))
    few = shingles_of.groupBy("shingle").agg(F.count("*").alias("f")).where(F.col("f") <= RARE)
    rare = materialise(shingles_of.join(few, "shingle"), "rare")
    less = rare.groupBy("id", "of").agg(F.count("*").alias("rare"), F.sum((F.col("f") == 1).cast("long")).alias("alone"))
    sized = own.select("id", "of", "c", "n").join(less, ["id", "of"], "left").na.fill(0, ["rare", "alone"])

    fits = (F.col("c") < F.col("c2")) & _fits(percent)
    could = lambda common: 100 * F.col(common) >= percent * F.col("n")
    by_rare = sized.withColumn("s", F.col("n") - F.col("alone")).where(could("s")).join(rare.where("f > 1").drop("f"), ["id", "of"]).select("shingle", "id", "c", "n", "s")
    first = by_rare.join(_twin(by_rare, "shingle"), "shingle").where(fits).select("id", "id2")
    by_key = sized.withColumn("s", F.col("n") - F.col("rare")).where(could("s")).join(halves, "id").withColumn("key", F.explode("ka"))
    named, meet = _classes(by_key.select("key", "id", "c", "n", "s", "ka", "kb"), percent)
    once = (F.array_min(F.array_intersect("ka", "ka2")) == F.col("key")) & F.arrays_overlap("kb", "kb2")
    second = named.join(meet, "class").join(_twin(named), "class2").where((F.col("key") == F.col("key2")) & fits & once).select("id", "id2")
    return first.unionByName(second).select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct()
