"""Ranked search against scores of all documents, and where it stops."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from trackmotif.llm import lexical

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def _brute(docs, items, k=10):
    """Rows (item_id, rank, doc_id, score), each item's by the scores of all documents."""
    counts = [Counter(_terms(t)) for _, t in docs]
    df = Counter(t for c in counts for t in c)
    n_docs, n_terms = sum(bool(c) for c in counts), sum(sum(c.values()) for c in counts)
    out = []
    for item_id, text in items:
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(_terms(text)) if df[t]}
        scored = []
        for (doc_id, _), c in zip(docs, counts, strict=True):
            m = 10 + 90 * sum(c.values()) * n_docs // max(n_terms, 1)
            if score := sum(w * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, w in weights.items() if c[t]):
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank + 1, None if unknown else doc_id, -score) for rank, (score, unknown, doc_id) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def _rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def _corpus(seed, n, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    text = lambda least, most: " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(words)], k=rng.randrange(least, most)))
    return [(k, text(1, 80)) for k in range(n)], [(k, text(1, 12)) for k in range(12)]


@pytest.mark.parametrize(("shard", "postings", "step"), [(lexical.SHARD, lexical.POSTINGS, lexical.STEP), (600, 200, 2), (4000, 1, 16)])
def test_equals_scores_of_all_documents(spark, monkeypatch, shard, postings, step):
    for name, value in (("SHARD", shard), ("POSTINGS", postings), ("STEP", step)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = _corpus(3, 300)
    docs += [(1000 + k, docs[k % 4][1]) for k in range(30)]  # ties
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    found = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), 7)
    assert _rows(found) == _brute(docs, items, 7)


def test_nulls_repeats_and_names(spark):
    docs = [(1, "Apple pear"), (1, "apple apple"), (None, "apple pear plum"), (None, "apple"), (4, None), (5, ""), (6, "...?!"), (7, "ÉPLUM éplum plum"), (8, "x" * 100_000 + " pear")]
    items = [(1, "apple, PEAR"), (1, "apple, PEAR"), (2, None), (3, ""), (4, "nowhere"), (None, "éplum plum"), (6, "apple apple")]
    rows = [(*r, "a", "b", 3) for r in docs]
    index = lexical.build(spark.createDataFrame(rows, "doc_id long, text string, term string, impacts string, shard int"))
    found = lexical.search(index, spark.createDataFrame([(*r, 1, "t") for r in items], "item_id long, text string, rank int, term string"))
    expected = _brute(docs, items)
    assert _rows(found) == expected and len([r for r in expected if r[0] == 1]) == 10


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, "?")])])
def test_empty_tables(spark, docs, items):
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string"))
    found = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"))
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_queries_in_blocks(spark, monkeypatch):
    docs, items = _corpus(5, 60)
    monkeypatch.setattr(lexical, "BLOCK", 40)
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string"))
    assert _rows(lexical.search(index, spark.createDataFrame(items, "item_id long, text string"))) == _brute(docs, items)


def test_index_has_postings_by_exact_impact(spark):
    docs, _ = _corpus(7, 200)
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    rows = index.rows.collect()
    ids = next(r.ids for r in rows if r.term is None)
    counts = {i: Counter(_terms(t)) for i, t in docs}
    expected = defaultdict(lambda: defaultdict(list))
    for i, c in counts.items():
        m = 10 + 90 * sum(c.values()) * index.n_docs // index.n_terms
        for t, tf in c.items():
            expected[t][10**9 * tf // (1000 * tf + 8 * m)].append(i)
    assert len(rows) == len(expected) + 1
    for r in rows:
        if r.term is not None:
            groups = expected[r.term]
            assert r.impacts == sorted(groups, reverse=True) and r.sizes == [len(groups[x]) for x in r.impacts] and r.df == sum(r.sizes)
            assert [ids[d] for d in r.docs] == [i for x in r.impacts for i in sorted(groups[x])]


def test_stops_where_the_bound_proves_the_best(spark, monkeypatch):
    """One term decides: of the other's many postings the first groups do, and the rest are read for candidates alone."""
    docs = [(k, "rare " * 5 + f"common x{k}") for k in range(10)] + [(10 + k, "common " + "y " * (k % 97)) for k in range(5000)]
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    found = lexical.Postings()
    import pyarrow as pa

    schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int32()), *((n, pa.list_(pa.int32())) for n in ("impacts", "sizes", "docs")), ("ids", pa.list_(pa.int64()))])
    for b in pa.Table.from_pylist([r.asDict() for r in index.rows.orderBy("shard", index.rows.term.asc_nulls_first()).collect()], schema=schema).to_batches():
        found.add(b)
    found.close()
    read = []
    take = found.postings
    monkeypatch.setattr(found, "postings", lambda starts, sizes: read.append(int(sizes.sum())) or take(starts, sizes))
    monkeypatch.setattr(lexical, "STEP", 4)
    docs_found, scores = found.best([("rare", 6000), ("common", 20)], 10, 1)
    assert set(found.ids[docs_found]) == set(range(10)) and len(read) >= 2 and sum(read[:-1]) < 200
