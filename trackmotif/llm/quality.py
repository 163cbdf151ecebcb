"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters (UTF-16 units), of order 4, so that a gram is exactly one 64-bit key: the unit predicted in
its low 16 bits, the ones before above. Counts are summed up by task, then sharded by key; each order's probabilities come
from joins of the count table with those of its contexts and of the next lower order.

Scoring is a join as well. Documents are in blocks; a block's distinct grams are joined, sharded by key, with each
order's probabilities and backoffs, and come back to the block with one log-probability each, where every text's units are
summed up. A document's perplexity is that of its whole text, and it is rejected where that is above a fence of its
language's quantiles over trusted documents that the model was not trained on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from trackmotif.llm.memory import release
from trackmotif.operators.ranking import quantiles
from trackmotif.session import materialise, ship_package

#: Order, and what stands before a text: a high surrogate that nothing completes, which no text has in such a place.
ORDER, PAD = 4, 0xDBFF
#: A document is rejected where its log-perplexity is above q75 + FENCE * (q75 - q25) of its language; languages of fewer
#: trusted documents use the quantiles of all.
FENCE, LEAST_TRUSTED = 3.5, 30
#: One of so many trusted documents isn't trained on, but fences the others.
HELD_OUT = 3
#: Units that a task looks at together, and that a block of documents has on average.
CHUNK_UNITS, BLOCK_UNITS = 1 << 18, 40_000_000
#: Distinct grams that a task holds before it hands them on.
HELD_GRAMS = 4_000_000
#: Trusted identifiers that are broadcast at most, 8 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def units(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-16-le", "surrogatepass"), "<u2")


def grams(u: np.ndarray) -> np.ndarray:
    """The 64-bit key of each unit with the three before it; before the start stand pads."""
    x = np.concatenate([np.full(ORDER - 1, PAD, np.uint64), u.astype(np.uint64)])
    n = len(u)
    return (x[:n] << np.uint64(48)) | (x[1 : n + 1] << np.uint64(32)) | (x[2 : n + 2] << np.uint64(16)) | x[3 : n + 3]


def _count(df: DataFrame) -> DataFrame:
    """gram, n: counts of order 4 over all texts."""

    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        size = 0

        def settle() -> None:
            nonlocal keys, counts, held, size
            k, n = np.unique(np.concatenate(held), return_counts=True) if held else (keys[:0], counts[:0])
            both = np.concatenate([keys, k])
            keys, at = np.unique(both, return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)
            held, size = [], 0

        for batch in batches:
            for text in batch.column(0):
                held.append(grams(units(text.as_py())))
                size += len(held[-1])
                if size > CHUNK_UNITS:
                    settle()
        settle()
        for k in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000].view(np.int64)), pa.array(counts[k : k + 100_000])], names=["gram", "n"])
        del keys, counts
        release()

    return df.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _low(order: int) -> Column:
    """The key of the last ``order`` units."""
    return F.col("gram").bitwiseAND(F.lit((1 << 16 * order) - 1)) if order < 4 else F.col("gram")


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2 and D3+ from how many grams have counts 1 to 4; held to [0, count] where there are too few."""
    found = {r.n: r.k for r in counts.where("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()}
    n = [float(found.get(k, 0)) for k in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return [min(max(k - (k + 1) * y * (n[k] / n[k - 1] if n[k - 1] else 1.0), 0.1 * k), float(k)) for k in (1, 2, 3)]


def model(trusted: DataFrame) -> DataFrame:
    """order, gram, p (null for those that are contexts alone), backoff (null for those that are no context).

    Orders are 0 (the empty context) to 4. Probabilities are interpolated: a gram that is not in the table has the product
    of its contexts' backoffs, as far as they are in it, and the probability of its longest end that is.
    """
    level = materialise(_count(trusted), "grams")
    counts = {ORDER: level}
    for order in range(ORDER - 1, 0, -1):
        level = level.select(_low(order).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
        counts[order] = level = materialise(level, "grams")
    lower: DataFrame | None = None
    out: DataFrame | None = None
    for order in range(1, ORDER + 1):
        # The context of pads alone is never predicted; contexts of order 0 are one.
        d1, d2, d3 = _discounts(counts[order])
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        rows = counts[order].withColumn("context", F.shiftrightunsigned("gram", 16))
        contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum(discount).alias("left"))
        contexts = contexts.select("context", "total", (F.col("left") / F.col("total")).alias("backoff"))
        joined = rows.join(contexts, "context")
        if lower is None:
            base = 1.0 / (counts[1].count() + 1)
            p = (F.col("n") - discount) / F.col("total") + F.col("backoff") * base
            table = joined.select("gram", p.alias("p"))
        else:
            ends = lower.select(F.col("gram").alias("end"), F.col("p").alias("p_end"))
            p = (F.col("n") - discount) / F.col("total") + F.col("backoff") * F.col("p_end")
            table = joined.withColumn("end", _low(order - 1)).join(ends, "end").select("gram", p.alias("p"))
        lower = table = materialise(table, "orders")
        part = table.select(F.lit(order).alias("order"), "gram", "p", F.lit(None).cast("double").alias("backoff"))
        back = contexts.select(F.lit(order - 1).alias("order"), F.col("context").alias("gram"), F.lit(None).cast("double").alias("p"), "backoff")
        out = part.unionByName(back) if out is None else out.unionByName(part).unionByName(back)
    found = out.groupBy("order", "gram").agg(F.max("p").alias("p"), F.max("backoff").alias("backoff"))
    return materialise(found.select("order", "gram", F.log("p").alias("p"), F.log("backoff").alias("backoff")), "model")



class Lookup:
    """Positions of 64-bit keys in an open-addressed table."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):  # each free slot takes the first that comes; the others move on
            free = self.slots[at[todo]] < 0
            first, where = np.unique(at[todo[free]], return_index=True)
            placed = todo[free][where]
            self.slots[first] = placed
            rest = np.ones(len(keys), bool)
            rest[placed] = False
            todo = todo[rest[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Of keys that are all there."""
        at = self._home(keys)
        out = self.slots[at]
        todo = np.flatnonzero(self.keys[out] != keys)
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            out[todo] = self.slots[at[todo]]
            if (out[todo] < 0).any():
                raise KeyError("a gram without a probability")
            todo = todo[self.keys[out[todo]] != keys[todo]]
        return out


def _chunks(texts: Iterator[str | None]) -> Iterator[list[np.ndarray]]:
    """Grams of texts, some ``CHUNK_UNITS`` at a time; a longer text is a chunk of its own."""
    held: list[np.ndarray] = []
    size = 0
    for text in texts:
        held.append(grams(units(text)))
        size += len(held[-1])
        if size > CHUNK_UNITS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, gram: the distinct grams of each block, as far as the task has it; a full hand is given on."""
    held: dict[int, pa.Array] = {}
    none = pa.array([], pa.int64())

    def settled() -> Iterator[pa.RecordBatch]:
        for block, found in held.items():
            for k in range(0, len(found), 200_000):
                part = found.slice(k, 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block, np.int64)), part], names=["_block", "gram"])
        held.clear()

    for batch in batches:
        blocks = batch.column(0).to_numpy(zero_copy_only=False)
        for block in np.unique(blocks).tolist():
            texts = batch.column(1).filter(pa.array(blocks == block))
            for chunk in _chunks(x.as_py() for x in texts):
                fresh = pc.unique(pa.array(np.concatenate(chunk).view(np.int64)))
                held[block] = pc.unique(pa.concat_arrays([held.get(block, none), fresh]))
        if sum(map(len, held.values())) > HELD_GRAMS:
            yield from settled()
    yield from settled()
    release()


def _bytes(size: str) -> int:
    """Of a setting such as 128m."""
    found = re.fullmatch(r"\s*(\d+)\s*([kmgt]?)i?b?\s*", size.lower())
    if not found:
        raise ValueError(f"not a size: {size}")
    return int(found[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[found[2]]


def blocked(df: DataFrame, block_units: int = BLOCK_UNITS) -> DataFrame:
    """``df`` and _block. Rows of a file's split are a few blocks, so that a task finds a block's grams by itself; other
    rows are dealt by a hash of their plain columns, to as many blocks as their texts need."""
    spark = df.sparkSession
    plain = F.xxhash64(*(f.name for f in df.schema if isinstance(f.dataType, AtomicType)))
    parts = max(1, -(-3 * _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")) // block_units))  # texts are about three times their files
    # Behind a shuffle or where rows come from no file, Spark still lists the files but names none: no column is read here.
    unnamed = df.select(F.input_file_name().alias("f")).agg(F.max((F.col("f") == "").cast("int"))).first()[0] if df.inputFiles() else 1
    if unnamed == 0:
        of = F.xxhash64(F.input_file_name(), F.input_file_block_start(), F.pmod(plain, F.lit(parts)))
        return df.withColumn("_block", of.bitwiseAND(F.lit((1 << 31) - 1)))  # a number that is shuffled small; two blocks may share it
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return df.withColumn("_block", F.pmod(plain, F.lit(max(spark.sparkContext.defaultParallelism, -(-size // block_units)))))


def _log_p(grams_: DataFrame, found: DataFrame) -> DataFrame:
    """gram, s: the log-probability of each distinct gram. From the order 1 up, a gram has its own probability where the
    model has it, else that of its end, times the backoff of its context where the model has that."""
    n1 = found.where("order = 1 and p is not null").count()
    empty = found.where("order = 0 and backoff is not null").select("backoff").first()
    keys_of = {ORDER: grams_}
    for order in range(ORDER - 1, 0, -1):
        keys_of[order] = keys_of[order + 1].select(_low(order).alias("gram")).distinct()
    below: DataFrame | None = None
    for order, keys in sorted(keys_of.items()):
        own = found.where(F.col("order") == order).select("gram", "p")
        rows = keys.join(own, "gram", "left")
        if below is None:
            unknown = empty.backoff - float(np.log(n1 + 1)) if empty else 0.0
            rows = rows.select("gram", F.coalesce("p", F.lit(unknown)).alias("s"))
        else:
            back = found.where(F.col("order") == order - 1).select(F.col("gram").alias("context"), "backoff")
            rows = rows.withColumn("context", F.shiftrightunsigned("gram", 16)).join(back, "context", "left")
            rows = rows.withColumn("end", _low(order - 1)).join(below.select(F.col("gram").alias("end"), F.col("s").alias("s_end")), "end")
            rows = rows.select("gram", F.coalesce("p", F.coalesce("backoff", F.lit(0.0)) + F.col("s_end")).alias("s"))
        below = rows
    return below


def _packed(df: DataFrame) -> DataFrame:
    """``df`` with the column text as compressed bytes: texts are most of what goes through the shuffle by block."""
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = [None if t is None else pack(t) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield batch.set_column(at, "text", pa.array(texts, pa.binary()))
        release()

    kind = lambda f: "binary" if f.name == "text" else f.dataType.simpleString()
    return df.mapInArrow(run, ",".join(f"`{f.name}` {kind(f)}" for f in df.schema))


def _unpacked(texts: pa.ChunkedArray) -> Iterator[str | None]:
    unpack = zstandard.ZstdDecompressor().decompress
    for t in texts:
        yield None if not t.is_valid else unpack(t.as_py()).decode()


def log_perplexity(df: DataFrame, found: DataFrame, block_units: int = BLOCK_UNITS, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``df`` (all of them unless told), which has a column text, and n_units, log_ppl (mean of -log p;
    null for texts without characters), in the place of columns with these names.

    A task holds a block's texts (see ``blocked``, which ``df`` may have gone through), and the log-probabilities of its
    distinct grams. A text longer than a block makes its block longer. Rows come back in any order.
    """
    spark = df.sparkSession
    ship_package(spark)
    columns = [c for c in columns or df.columns if c not in ("_block", "n_units", "log_ppl")]
    dealt = df if "_block" in df.columns else blocked(df, block_units)
    needed = materialise(dealt.select("_block", "text").mapInArrow(_wanted, "_block long, gram long"), "wanted")
    every = materialise(_log_p(materialise(needed.select("gram").distinct(), "grams"), found), "log-p")
    scored = needed.join(every, "gram")
    schema = ",".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema)

    def score(docs: pa.Table, rows: pa.Table) -> pa.Table:
        table = Lookup(rows["gram"].to_numpy().view(np.uint64))
        logs = rows["s"].to_numpy()
        counts, sums = [], []
        for held in _chunks(_unpacked(docs["text"])):
            p = logs[table.find(np.concatenate(held))]
            ends = np.cumsum([len(h) for h in held])
            total = np.concatenate([[0.0], np.cumsum(p)])
            counts += [len(h) for h in held]
            sums += (total[ends] - total[np.concatenate([[0], ends[:-1]])]).tolist()
        mean = [-s / n if n else None for n, s in zip(counts, sums, strict=True)]
        if "text" in columns:
            docs = docs.set_column(docs.column_names.index("text"), "text", pa.array(_unpacked(docs["text"]), pa.string()))
        out = docs.select(columns).append_column("n_units", pa.array(counts, pa.int64())).append_column("log_ppl", pa.array(mean, pa.float64()))
        del table, logs, rows
        release()
        return out

    packed = _packed(dealt.select("_block", *dict.fromkeys([*columns, "text"])))
    return packed.groupBy("_block").cogroup(scored.groupBy("_block")).applyInArrow(score, f"{schema},n_units bigint,log_ppl double")


def fences(known: DataFrame) -> tuple[dict, float | None]:
    """The fence of each language of ``known`` (lang, log_ppl) with trusted documents enough, and that of all."""
    fence = lambda q: q[1] + FENCE * (q[1] - q[0])
    by_lang = {k: fence(q) for k, (n, q) in quantiles(known, "log_ppl", [0.25, 0.75], "lang").items() if n >= LEAST_TRUSTED}
    overall = quantiles(known, "log_ppl", [0.25, 0.75])
    return by_lang, fence(overall[None][1]) if None in overall else None


def classify(docs: DataFrame, labels: DataFrame, trusted_label: str = "quality", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all of them unless told) and n_units, log_ppl, fence (of its language) and accepted.

    Documents whose label is 1 are trusted; of several labels of a document, one such is enough. A third of them, by a hash
    of doc_id, is held out: the model is trained on the others, the fences are those of the texts it has not seen. Texts
    without characters have no perplexity and are not accepted; without any trusted text all others are. A null language
    is a language. Rows and all other columns stay as they are; columns of docs with the new names are replaced, whatever
    ``columns`` leaves out doesn't matter.
    """
    spark = docs.sparkSession
    ship_package(spark)
    own = {"_known", "_block", "_trusted", "n_units", "log_ppl", "fence", "accepted"}
    columns = [c for c in columns or docs.columns if c not in own]
    docs = docs.select(*dict.fromkeys([*columns, "doc_id", "lang", "text"]))
    ids = labels.where(F.col(trusted_label) == 1).select(F.col("doc_id").alias("_trusted")).distinct()
    held_out = F.pmod(F.xxhash64(F.col("_trusted").cast("string")), F.lit(HELD_OUT)) == 0
    ids = ids.withColumn("_known", F.when(held_out, "fence").otherwise("model"))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    marked = blocked(docs).join(ids, F.col("doc_id") == F.col("_trusted"), "left").drop("_trusted")
    found = model(marked.where("_known = 'model' and text is not null and text <> ''"))
    kept = [c for c in dict.fromkeys([*columns, "lang", "_known", "_block"]) if c != "text"]
    scored = materialise(log_perplexity(marked.select(*kept, "text"), found, columns=list(dict.fromkeys([*columns, "lang", "_known"]))), "scored")
    by_lang, overall = fences(scored.where("_known = 'fence' and log_ppl is not null").select("lang", "log_ppl"))
    rows = spark.createDataFrame([(k, v) for k, v in by_lang.items()], "_lang string, _fence double")
    out = scored.join(F.broadcast(rows), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    out = out.select(*columns, "n_units", "log_ppl", F.coalesce(F.col("_fence"), F.lit(overall).cast("double")).alias("fence"))
    return out.withColumn("accepted", F.coalesce(F.col("log_ppl").isNotNull() & (F.col("log_ppl") <= F.coalesce("fence", F.lit(float("inf")))), F.lit(False)))
