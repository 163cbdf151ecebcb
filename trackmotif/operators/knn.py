"""Nearest neighbours: a sparse self-join on words, then a finer similarity for the pairs that are left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmotif.session import materialise, ship_package

#: Of each row, so many words lead to the neighbours that it is compared with first.
LEADS = 4
#: Similarities that differ by less may tie.
SLACK = 1e-8
#: Rows of a block at most; blocks for work in parallel, of so many rows at least; runs of rows for each neighbour wanted.
BLOCK, SPREAD, FEW, RUNS = 65_536, 5, 2_000, 8
#: Words of a row on average, up to which at most ``BLOCK`` rows meet all others.
SHORT = 32


def normalised(df: DataFrame, key: str, value: str = "value") -> DataFrame:
    """Values divided by the Euclidean length of their row; all-zero rows go."""
    length = F.sqrt(F.sum(F.col(value) * F.col(value)).over(Window.partitionBy(key)))
    return df.withColumn(value, F.try_divide(F.col(value), length)).where(F.col(value).isNotNull())


def sparse_dot(a: DataFrame, b: DataFrame, key: str, word: str = "word", value: str = "value") -> DataFrame:
    """i, j, dot of every pair of rows with a word in common.

    A sort-merge join on the word and a sum that starts before the shuffle by pair; a word that n rows have makes n * n
    products. ``nearest`` does without most of them where only the best are wanted.
    """
    left = a.select(F.col(key).alias("i"), word, F.col(value).alias("_a"))
    right = b.select(F.col(key).alias("j"), word, F.col(value).alias("_b"))
    return left.join(right, word).groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("dot"))


def _vectors(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, words (sorted numbers, hashes where they are none) and values of each row."""
    number = F.col("word") if rows.schema["word"].dataType.simpleString() == "bigint" else F.xxhash64("word")
    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(number.alias("word"), F.col("value").cast("double").alias("value")))).alias("v"))
    return held.select(*keys, F.col("v.word").alias("words"), F.col("v.value").alias("values"))


def _dots(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """i, j, sim: the products of whole rows of ``pairs`` (i, j, part)."""
    both = pairs.join(left.withColumnsRenamed({"words": "wa", "values": "va"}), "i").join(right.withColumnsRenamed({"words": "wb", "values": "vb"}), ["j", "part"]).select("i", "j", "wa", "va", "wb", "vb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [[x.values.to_numpy() for x in batch.column(c)] for c in ("wa", "va", "wb", "vb")]
            out = []
            for wa, va, wb, vb in zip(*parts, strict=True):
                _, x, y = np.intersect1d(wa, wb, assume_unique=True, return_indices=True)
                out.append(float(va[x] @ vb[y]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["i", "j", "sim"])

    kind = lambda c: both.schema[c].dataType.simpleString()
    return both.mapInArrow(run, f"i {kind('i')}, j {kind('j')}, sim double")


def bounded_words(left: DataFrame, right: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The words of each row of ``left`` that can lead to one of its ``k`` nearest: i, word, value, n (rows of ``right`` with
    the word), bar and slack; and the similarities i, j, sim that are known by then.

    A row's bar is its k-th best similarity with the rows that hold most of its ``LEADS`` weightiest words. What its words
    give with any row at most, |value| times the word's largest, is summed up from the commonest word on: while the sum, its
    slack, stays below the bar, a row that shares no other word can't be among the nearest, so these words join nothing.
    """
    stats = right.groupBy("word").agg(F.count("*").alias("n"), F.max(F.abs("value")).alias("top"))
    own = materialise(left.join(stats, "word").select("i", "word", "value", "n", (F.abs("value") * F.col("top")).alias("most")), "weighed")
    lead = own.withColumn("_k", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("most"), "word"))).where(F.col("_k") <= LEADS).select("i", "word")
    strong = right.withColumn("_k", F.row_number().over(Window.partitionBy("word").orderBy(F.desc(F.abs("value")), "j"))).where(F.col("_k") <= k + 1)
    first = lead.join(strong, "word").select("i", "j", "part").distinct()
    known = _dots(first, _vectors(left, "i"), _vectors(right, "j", "part")).groupBy("i", "j").agg(F.max("sim").alias("sim"))
    known = materialise(known, "known")
    bar = known.withColumn("_k", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("sim")))).where(F.col("_k") == k).select("i", F.col("sim").alias("bar"))
    common = Window.partitionBy("i").orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, 0)
    rows = own.withColumn("rest", F.sum("most").over(common)).join(bar, "i", "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf"))))
    idle = F.col("rest") < F.col("bar") - SLACK
    slack = F.coalesce(F.max(F.when(idle, F.col("rest"))).over(Window.partitionBy("i")), F.lit(0.0))
    return rows.withColumn("slack", slack).where(~idle).select("i", "word", "value", "n", "bar", "slack"), known


def nearest(left: DataFrame, right: DataFrame, k: int, score: Column | str = "sim") -> DataFrame:
    """i, j, sim, rank: the ``k`` rows j of ``right`` (j, part, word, value) most similar to each row of ``left`` (i, word,
    value) by the largest product of any part, among those with a word in common; ties as ``score`` has them: smallest j.

    Equal to ranking all products, but words too common or light to matter to a row aren't joined (see ``bounded_words``), and
    of the pairs that the others make only those whose sum so far can reach the bar are multiplied out.
    """
    ship_package(left.sparkSession)
    left, right = materialise(left.select("i", "word", "value"), "left-words"), materialise(right.select("j", "part", "word", "value"), "right-words")
    needed, known = bounded_words(left, right, k)
    products = needed.join(right.withColumnRenamed("value", "_b"), "word").groupBy("i", "j", "part", "bar", "slack").agg(F.sum(F.col("value") * F.col("_b")).alias("sim"))
    could = materialise(products.where(F.col("sim") + F.col("slack") >= F.col("bar") - SLACK), "could")
    whole = could.where("slack = 0").select("i", "j", "sim")
    rest = _dots(could.where("slack > 0").select("i", "j", "part"), _vectors(left, "i"), _vectors(right, "j", "part"))
    found = known.unionByName(whole).unionByName(rest).groupBy("i", "j").agg(F.max("sim").alias("sim"))
    return top_k(found, k, score)


class _Rows:
    """The rows of a block by word: for each word the rows that have it, with their values."""

    def __init__(self, parts: list[pa.RecordBatch]):
        held = pa.Table.from_batches(parts).combine_chunks()
        lists = held.column("words").combine_chunks()
        words, values = lists.flatten().to_numpy(), held.column("values").combine_chunks().flatten().to_numpy()
        rows = np.repeat(np.arange(held.num_rows), lists.value_lengths().to_numpy())
        order = np.argsort(words, kind="stable")
        self.words, starts = np.unique(words[order], return_index=True)
        self.ends = np.append(starts, len(words))
        self.rows, self.values, self.n = rows[order], values[order], held.num_rows
        j = held.column("j").combine_chunks().to_numpy(zero_copy_only=False)
        self.first = np.flatnonzero(np.append(True, j[1:] != j[:-1]))
        self.j = held.column("j").combine_chunks().take(pa.array(self.first))

    def best(self, batch: pa.RecordBatch, k: int, digits: int) -> pa.RecordBatch:
        """i, j, sim: the ``k`` best of these rows for each of ``batch``; ties, rounded to ``digits``, in the order of rows."""
        words, values = (batch.column(c).flatten().to_numpy() for c in ("words", "values"))
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        lows, highs = self.ends[at], np.where(self.words[at] == words, self.ends[at + 1], self.ends[at])
        cuts = np.append(0, np.cumsum(batch.column("words").value_lengths().to_numpy()))
        lows, highs, values, cuts = lows.tolist(), highs.tolist(), values.tolist(), cuts.tolist()
        mine, found, sims = [], [], []
        for r in range(batch.num_rows):
            spans = [n for n in range(cuts[r], cuts[r + 1]) if lows[n] < highs[n]]
            if not spans:
                continue
            rows = np.concatenate([self.rows[lows[n] : highs[n]] for n in spans])
            products = np.bincount(rows, np.concatenate([self.values[lows[n] : highs[n]] * values[n] for n in spans]), self.n)
            near, sim = self._top(rows, products, k, digits)
            mine.append(np.full(len(near), r))
            found.append(near)
            sims.append(sim)
        mine, found, sims = (np.concatenate(x) if x else np.array([], "int64") for x in (mine, found, sims))
        return pa.RecordBatch.from_arrays([batch.column("i").take(pa.array(mine)), self.j.take(pa.array(found)), pa.array(sims.astype("float64"))], names=["i", "j", "sim"])

    def _top(self, rows: np.ndarray, products: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``j`` and products of the best: a bar that k runs of rows reach leaves few to rank. Rows without a word
        in common have the product 0, so that a bar which isn't above 0 won't do."""
        several = len(self.first) < self.n
        sims = np.maximum.reduceat(products, self.first) if several else products
        runs, width = RUNS * k, len(sims) // (RUNS * k)
        bar = np.partition(sims[: runs * width].reshape(runs, width).max(axis=1), runs - k)[runs - k] if width else 0.0
        if bar > 0:
            near = np.flatnonzero(sims >= bar - 2 * 10.0**-digits)
        else:
            shared = np.zeros(self.n, bool)
            shared[rows] = True
            sims = np.where(shared, products, -np.inf)
            sims = np.maximum.reduceat(sims, self.first) if several else sims
            near = np.flatnonzero(sims > -np.inf)
        near = near[np.argsort(-np.round(sims[near], digits), kind="stable")[:k]]
        return near, sims[near]


def _blocks(n: int) -> int:
    """Blocks of at most ``BLOCK`` rows, and ``SPREAD`` of them where they have ``FEW`` rows or more."""
    return max(-(-n // BLOCK), min(SPREAD, n // FEW), 1)


def of_all(left: DataFrame, right: DataFrame | None, k: int, digits: int = 9) -> DataFrame:
    """i, j, sim, rank: what ``nearest`` gives, from all products, where rows have few words and these are common. Without
    ``right``, rows of ``left`` among themselves.

    Both sides are dealt to blocks and a task has a block of each. It adds up a row's products by the postings of its words
    and gives its ``k`` best, so that no pair of rows is shuffled but these. ``digits`` rounds for ties: smallest j.
    """
    ship_package(left.sparkSession)
    mine = materialise(_vectors(left, "i"), "left-vectors")
    theirs = mine.select(F.col("i").alias("j"), F.lit(0).alias("part"), "words", "values") if right is None else materialise(_vectors(right, "j", "part"), "right-vectors")
    p, q = _blocks(mine.count()), _blocks(theirs.count())
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda side, c: F.lit(None).cast(side.schema[c].dataType).alias(c)
    a = mine.select(dealt("i", p).alias("_a"), every(q).alias("_b"), F.lit(1).alias("side"), "i", none(theirs, "j"), none(theirs, "part"), "words", "values")
    b = theirs.select(every(p).alias("_a"), dealt("j", q).alias("_b"), F.lit(0).alias("side"), none(mine, "i"), "j", "part", "words", "values")
    pairs = a.unionByName(b).withColumn("pair", F.col("_a") * q + F.col("_b")).repartitionById(p * q, "pair")
    sorted_ = pairs.sortWithinPartitions("pair", "side", "j", "part").select("pair", "side", "i", "j", "words", "values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, now = [], None, None
        for batch in batches:
            pair, side = (batch.column(c).to_numpy() for c in ("pair", "side"))
            cuts = [0, *(np.flatnonzero(np.diff(pair * 2 + side)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                if pair[low] != now:
                    held, rows, now = [], None, pair[low]
                if side[low] == 0:
                    held.append(part)
                    continue
                if held:
                    rows, held = _Rows(held), []
                if rows is not None:
                    yield rows.best(part, k, digits)

    kind = lambda side, c: side.schema[c].dataType.simpleString()
    found = sorted_.mapInArrow(run, f"i {kind(mine, 'i')}, j {kind(theirs, 'j')}, sim double")
    return top_k(found, k, F.round("sim", digits))


def by_words(left: DataFrame, right: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """i, j, sim, rank: what ``nearest`` and ``of_all`` both give, by all products where at most ``BLOCK`` rows have few words
    each, which are common then, and by those that can matter elsewhere."""
    n = left.agg(F.count("*").alias("words"), F.countDistinct("i").alias("rows")).first()
    short = n.rows <= BLOCK and n.words <= SHORT * n.rows
    return of_all(left, right, k, digits) if short else nearest(left, right, k, F.round("sim", digits))


def larger_of(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """i, j, sim: the larger of two strands, where a pair that is missing counts 0."""
    both = forward.withColumn("f", F.col("dot")).withColumn("r", F.lit(0.0)).select("i", "j", "f", "r").unionByName(reverse.withColumn("f", F.lit(0.0)).withColumn("r", F.col("dot")).select("i", "j", "f", "r"))
    summed = both.groupBy("i", "j").agg(F.sum("f").alias("f"), F.sum("r").alias("r"))
    return summed.select("i", "j", F.greatest("f", "r", F.lit(0.0)).alias("sim"))


def top_k(pairs: DataFrame, k: int, score: Column | str = "sim") -> DataFrame:
    """The k best j of each i (ties: smallest j), with rank from 1; limited within each task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc(score), "j"))
    return pairs.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def filled(pairs: DataFrame, ids: DataFrame, k: int, group: str) -> DataFrame:
    """group, i, j, sim, rank: ``pairs`` (group, i, j, sim) that are above 0, and for rows short of k of these the group's
    smallest other ids at similarity 0. ``ids`` has (group, id)."""
    real = pairs.where(F.col("sim") > 0).select(group, "i", "j", "sim")
    place = F.row_number().over(Window.partitionBy(group).orderBy("id"))
    first = ids.withColumn("_n", place).where(F.col("_n") <= k).select(group, F.col("id").alias("j"))
    had = real.groupBy(group, "i").agg(F.count("*").alias("_n"))
    short = ids.select(group, F.col("id").alias("i")).join(had, [group, "i"], "left").where(F.coalesce("_n", F.lit(0)) < k).select(group, "i")
    fill = short.join(first, group).join(real.select(group, "i", "j"), [group, "i", "j"], "left_anti").withColumn("sim", F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy(group, "i").orderBy(F.desc(F.round("sim", 12)), "j"))
    return real.unionByName(fill).withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def spearman(pairs: DataFrame, x: str, y: str, by: str = "i") -> DataFrame:
    """by, rho: correlation of average ranks; null where a side is constant."""
    from trackmotif.operators.thresholds import ranks

    ranked = pairs.select(by, ranks(x, by).alias("rx"), ranks(y, by).alias("ry"))
    rho = F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry"))
    return ranked.groupBy(by).agg(rho.alias("rho"))


def correlated(pairs: DataFrame, x: str, y: str, least: float = 0.15) -> DataFrame:
    """Pairs of the rows whose similarities x (where not 0) and y agree in rank; both ends must be such rows."""
    kept = spearman(pairs.where(F.abs(x) > 0), x, y).where(F.col("rho") > least).select("i")
    return pairs.join(kept, "i", "left_semi").join(kept.select(F.col("i").alias("j")), "j", "left_semi")
