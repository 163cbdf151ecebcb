"""Ranked lexical search: an impact-ordered index, read score-at-a-time.

A posting's impact is what its term adds to a document's score, but for the term's weight, which is the same for all
documents. The index keeps a term's postings by exact impact, largest first, in shards of documents. A search takes the
groups of its terms' postings from the largest weighted impact down and adds them to the documents' scores. The largest
impacts still to come bound what any score can gain: once a document that has not been met can't reach the k-th best, only
those that can are completed, from the postings that are left. A task keeps the best k of each query over all its shards,
so that later ones stop sooner; the tasks' best are merged.

All is in integers but the weight's logarithm, and exact. Queries are taken in blocks of a bounded size, whose terms are
sent to every task; more queries are more blocks, each a pass over the index that reads its own terms' postings.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmotif.llm.memory import release
from trackmotif.llm.words import joined, lettered
from trackmotif.session import materialise, ship_package

TOP = 10
#: Bytes of text of a shard, of a block of queries, and postings that are searched together.
SHARD, BLOCK, POSTINGS = 8 << 20, 4 << 20, 1 << 21
#: Groups of postings that are added before the bound is looked at; twice as many each time.
STEP = 1024
SCALE, LENGTH_PERCENT = 1_000_000_000, 90
INDEX = "shard long, term string, df int, impacts array<int>, sizes array<int>, docs array<int>, ids array<long>"
_INT = pa.list_(pa.int32())


@dataclass(frozen=True)
class Index:
    """``rows``: a row for each shard and term, and one a shard with a null term, which holds its identifiers."""

    rows: DataFrame
    n_docs: int
    n_terms: int


def _texts(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def corpus_size(df: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and all their terms with repeats, of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = terms = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                owner = joined(_bytes(batch.column(0).slice(k, 256)))[1]
                docs += len(np.unique(owner))
                terms += len(owner)
        yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([terms])], names=["docs", "terms"])
        release()

    r = df.select("text").mapInArrow(run, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return r.docs or 0, r.terms or 0


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values.astype(np.int32)))


def _shard(number: int, ids: list, texts: list[bytes], n_docs: int, n_terms: int) -> pa.RecordBatch:
    words, owner = joined(texts)
    length = 100 - LENGTH_PERCENT + LENGTH_PERCENT * np.bincount(owner, minlength=len(texts)) * n_docs // max(n_terms, 1)
    order = np.argsort(words.hashes, kind="stable")  # by term, then by document
    term, doc = words.hashes[order], owner[order]
    new_term = np.ones(len(term), bool)
    new_term[1:] = term[1:] != term[:-1]
    new = new_term.copy()
    new[1:] |= doc[1:] != doc[:-1]
    first = np.flatnonzero(new)
    tf, doc, of = np.diff(np.append(first, len(term))), doc[first], np.cumsum(new_term)[first] - 1
    impact = SCALE * tf // (1000 * tf + 8 * length[doc])
    by_impact = np.argsort((of << 21) - impact, kind="stable")  # an impact is below 1,000,000
    of, impact, doc = of[by_impact], impact[by_impact], doc[by_impact]
    head = np.ones(len(of), bool)
    head[1:] = (of[1:] != of[:-1]) | (impact[1:] != impact[:-1])
    group = np.flatnonzero(head)
    n = int(new_term.sum())
    group_ends, doc_ends = np.cumsum(np.bincount(of[group], minlength=n)), np.cumsum(df := np.bincount(of, minlength=n))
    names = [words.word(k).decode() for k in order[new_term].tolist()]
    columns = [
        pa.array([None, *names], pa.string()),
        pa.array(np.append(len(ids), df), pa.int32()),
        *(pa.concat_arrays([pa.array([None], _INT), _lists(x, ends)]) for x, ends in ((impact[group], group_ends), (np.diff(np.append(group, len(of))), group_ends), (doc, doc_ends))),
        pa.array([ids] + [None] * n, pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n + 1, number)), *columns], names=["shard", "term", "df", "impacts", "sizes", "docs", "ids"])


def build(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Index:
    """The index of all rows and all their terms: runs of ASCII letters, as lower case, digits and what is beyond ASCII.

    Every row is a document of its own, with a repeated or a null identifier too; null and empty texts have no term and
    don't count. A shard is made where its rows are read, and written once in the shared folder.
    """
    ship_package(df.sparkSession)
    texts = _texts(df, id_column, text_column)
    n_docs, n_terms = corpus_size(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, held, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), strict=True):
                if held and size + len(text) > SHARD:
                    yield from _pieces(_shard(number, ids, held, n_docs, n_terms))
                    number, ids, held, size = number + 1, [], [], 0
                ids.append(doc_id)
                held.append(text)
                size += len(text)
        if held:
            yield from _pieces(_shard(number, ids, held, n_docs, n_terms))
        release()

    return Index(materialise(texts.mapInArrow(run, INDEX), "impacts"), n_docs, n_terms)


def _pieces(rows: pa.RecordBatch, n: int = 20_000) -> Iterator[pa.RecordBatch]:
    for k in range(0, rows.num_rows, n):
        yield rows.slice(k, n)


class Postings:
    """Shards that are searched together; a term's groups are those of all of them."""

    def __init__(self):
        self.ids, self.known, self.docs, self.n_docs, self.n_postings = [], [], [], 0, 0
        self.groups: dict[str, list[tuple[np.ndarray, np.ndarray, int]]] = {}

    def add(self, rows: pa.RecordBatch) -> None:
        """Rows of one shard; the one with its identifiers comes first of all."""
        _, term, _, impacts, sizes, docs, ids = rows.columns
        for k, name in enumerate(term.to_pylist()):
            if name is None:
                self.first, x = self.n_docs, ids[k].values
                self.ids.append(x.fill_null(0).to_numpy(zero_copy_only=False))
                self.known.append(x.is_valid().to_numpy(zero_copy_only=False))
                self.n_docs += len(x)
            else:
                held = docs[k].values.to_numpy() + self.first
                self.groups.setdefault(name, []).append((impacts[k].values.to_numpy().astype(np.int64), sizes[k].values.to_numpy().astype(np.int64), self.n_postings))
                self.docs.append(held)
                self.n_postings += len(held)

    def close(self) -> None:
        self.ids, self.known = np.concatenate(self.ids), np.concatenate(self.known)
        self.docs = np.concatenate([np.zeros(0, np.int64), *self.docs])
        for name, parts in self.groups.items():
            starts = [np.cumsum(sizes) - sizes + at for _, sizes, at in parts]
            self.groups[name] = tuple(np.concatenate(x) for x in (*zip(*((i, s) for i, s, _ in parts), strict=True), starts))

    def postings(self, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents of groups, and the number of each one's group."""
        ends = np.cumsum(sizes)
        return self.docs[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)], np.repeat(np.arange(len(sizes)), sizes)

    def best(self, terms: list[tuple[str, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that hold the k best of those with a score of ``least`` or more, and above 0."""
        parts = [(w, self.groups[t]) for t, w in terms if w > 0 and t in self.groups]
        if not parts or sum(w * int(g[0].max()) for w, g in parts) < max(least, 1):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        impact = np.concatenate([w * g[0] for w, g in parts])
        sizes, starts = (np.concatenate([g[x] for _, g in parts]) for x in (1, 2))
        owner = np.repeat(np.arange(len(parts)), [len(g[0]) for _, g in parts])
        order = np.lexsort((-impact, owner))
        of_term = impact[order]  # each term's impacts, largest first
        counts = np.bincount(owner)
        last, at = np.cumsum(counts), np.cumsum(counts) - counts
        order = order[np.argsort(-of_term, kind="stable")]
        scores = np.zeros(self.n_docs, np.int64)
        done, step = 0, STEP
        while True:
            part = order[done : done + step]
            docs, group = self.postings(starts[part], sizes[part])
            np.add.at(scores, docs, impact[part][group])
            done += len(part)
            step *= 2
            at = at + np.bincount(owner[part], minlength=len(parts))
            coming = int(np.where(at < last, np.append(of_term, 0)[np.minimum(at, len(of_term))], 0).sum())
            bar = max(least, 1)
            if self.n_docs >= k:
                bar = max(bar, int(np.partition(scores, -k)[-k]))
            if done == len(order) or coming < bar:  # no document with nothing yet can be among the best
                break
        could = scores + np.where(scores > 0, coming, 0) >= bar
        rest = order[done:]
        docs, group = self.postings(starts[rest], sizes[rest])
        mine = could[docs]
        np.add.at(scores, docs[mine], impact[rest][group[mine]])
        found = np.flatnonzero(could)
        return found, scores[found]


def _leading(rows: list[tuple], k: int) -> list[tuple]:
    """The k best (-score, without identifier, identifier)."""
    return sorted(rows)[:k]


def _search_block(index: Index, items: list[tuple], k: int) -> DataFrame:
    """item (number), doc_id, score: the best k of each task for each of the items (number, {term})."""
    spark = index.rows.sparkSession
    names = sorted({t for _, terms in items for t in terms})
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in names], "term string"))  # of a block, which is bounded
    mine = index.rows.join(wanted, "term", "left_semi")
    held = {r.term: r.df for r in mine.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * n + 1))) for t, n in held.items()}
    sent = spark.sparkContext.broadcast([(number, [(t, weight[t]) for t in terms if t in weight]) for number, terms in items])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}

        def search(found: Postings) -> None:
            found.close()
            for number, terms in sent.value:
                kept = best.get(number, [])
                docs, scores = found.best(terms, k, -kept[-1][0] if len(kept) == k else 1)
                if len(docs) > 4 * k:  # ties stay
                    near = scores >= np.partition(scores, -k)[-k]
                    docs, scores = docs[near], scores[near]
                if len(docs):
                    best[number] = _leading([*kept, *zip((-scores).tolist(), (~found.known[docs]).tolist(), found.ids[docs].tolist(), strict=True)], k)

        found, last = Postings(), None
        for batch in batches:
            shards = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    if shards[a] != last and found.n_postings >= POSTINGS:
                        search(found)
                        found = Postings()
                    last = shards[a]
                    found.add(batch.slice(a, b - a))
        if found.ids:
            search(found)
        rows = [(number, None if unknown else doc_id, -score) for number, kept in best.items() for score, unknown, doc_id in kept]
        columns = [pa.array([r[x] for r in rows], pa.int64()) for x in range(3)]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])
        release()

    rows = index.rows.where("term is null").unionByName(mine.select(*index.rows.columns))
    ordered = rows.repartition("shard").sortWithinPartitions("shard", F.asc_nulls_first("term"))
    return ordered.mapInArrow(run, "item long, doc_id long, score long")


def search(index: Index, items: DataFrame, k: int = TOP, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` documents of the highest score above 0 (all, if there are fewer).

    The score is the sum of w * (10^9 tf div (1000 tf + 8 m)) over the item's distinct terms, with w = floor(1000 ln((2N +
    2) / (2df + 1))) and m = 10 + 90 n N div L. Equal scores rank by doc_id, null ones last. Every row of ``items`` is an
    item of its own, with a repeated identifier too; null texts and those without terms have no rows.
    """
    spark = index.rows.sparkSession
    parts, block, size, n = [], [], 0, 0

    def close() -> None:
        nonlocal block, size
        if block:
            found = _search_block(index, [(number, terms) for number, _, terms in block], k)
            place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
            ids = spark.createDataFrame([(number, item_id) for number, item_id, _ in block], "item long, item_id long")
            parts.append(ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))
        block, size = [], 0

    for r in _texts(items, id_column, text_column).toLocalIterator():  # a block of queries at a time
        w = lettered(r.text)
        terms = sorted(Counter(w.word(x).decode() for x in range(len(w))))
        if terms:
            block.append((n, r.doc_id, terms))
            size += len(r.text.encode())
            n += 1
        if size >= BLOCK:
            close()
    close()
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
c AS (SELECT count(*) AS n_docs, sum(len(words))::BIGINT AS n_terms FROM d WHERE len(words) > 0),
t AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(words) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM t, c GROUP BY term, n_docs),
q AS (SELECT DISTINCT i, item_id, unnest(words) AS term FROM (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark)),
s AS (SELECT i, item_id, k, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(words) * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN t USING (term) JOIN d USING (k), c GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
