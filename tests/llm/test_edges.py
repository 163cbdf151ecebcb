"""Every operator over nulls, empty and very long texts, repeated rows, clashing names and empty tables."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trackmotif.llm import avi_mjpeg, bpe_lexicon, decontam, line_dedup, minhash_tensor, pii, quality, sstable, toxicity, warc

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LONG = "word " * 40_000 + "a" * 50_000
ROWS = [
    (1, "the cat sat on the mat and then it slept all day", "en", "s1", 5, "x"),
    (2, None, None, None, None, None),
    (3, "", "en", "s1", 0, "x"),
    (None, "the cat sat on the mat and then it slept all day", "en", None, 5, "x"),
    (4, LONG, "de", "s2", 9, "x"),
    (1, "the cat sat on the mat and then it slept all day", "en", "s1", 5, "x"),
    (5, " \n \t", "en", "s1", 3, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, {} string"


@pytest.fixture(scope="module", params=["full", "empty"])
def docs(request, spark):
    return spark.createDataFrame(ROWS if request.param == "full" else [], SCHEMA.format("label"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "cat sat on the mat and then it slept all day long"), (2, None), (None, "x"), (3, ""), (3, "the cat")], "item_id long, text string")


def test_media(docs):
    rows = avi_mjpeg.media_digests(docs).collect()
    assert len(rows) == docs.count() and all(r.payload_bytes % 64 == 0 and r.payload_bytes >= 64 for r in rows)
    assert all(r.n_bytes == 0 for r in rows if r.doc_id in (2, 3))


def test_near_duplicates(docs):
    for size in (4, 5):
        rows = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_tensor.near_duplicates(docs, size).collect()}
        if docs.count():
            n = 13 - size
            assert {(1, n, 1, True), (None, n, 1, False), (2, 0, 2, True), (3, 0, 3, True), (5, 0, 5, True)} <= rows
        else:
            assert rows == set()


def test_warc(docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html"), "label")
    rows = warc.archive_digests(pages).collect()
    assert len(rows) == docs.count()
    if rows:
        empty = [r for r in rows if r.page_id in (2, 3)]
        assert {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in empty} == {(2, 0, "response", None), (3, 0, "revisit", 2)}
        assert [r.record_type for r in rows if r.page_id == 1] == ["response"] * 2 and [r.record_type for r in rows if r.page_id is None] == ["response"]


def test_shards(docs):
    rows = sorted(sstable.read_digests(sstable.write_shards(docs, TOKENIZER)).collect(), key=lambda r: r.start)
    assert len(rows) == docs.count()
    if rows:
        assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 4, 5] and rows[3].n_tokens == 1
        assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]


def test_contamination(docs, items):
    rows = decontam.contamination(docs, items).collect()
    assert len(rows) == docs.count() and all(r.contaminated == (r.doc_id in (1, None)) for r in rows)
    assert all(r.items_sha256 == hashlib.sha256(b"").hexdigest() for r in rows if not r.contaminated)
    left = decontam.decontaminate(docs, items)
    assert left.columns == docs.columns and left.count() == sum(1 for r in rows if not r.contaminated)
    assert not [r for r in decontam.contamination(docs, items.limit(0)).collect() if r.contaminated]


def test_pii(docs):
    rows = pii.digests(docs).collect()
    assert len(rows) == docs.count() and all(r.spans == "" for r in rows)
    assert pii.sanitise(docs).count() == docs.count()


def test_toxicity(docs, labels):
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert len(toxicity.toxicity(docs, labels.limit(0)).collect()) == docs.count()


def test_line_dedup(docs):
    out = line_dedup.drop_boilerplate(docs, counts=("n_lines", "n_dropped"))
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert sorted(map(str, out.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))


def test_line_dedup_drops_lines_of_few_hundredths(spark):
    # Of 400 pages of a host, a line on 8 goes, and one on 4 stays; on a host of 10 pages one on 4 stays as well.
    rows = [(k, f"own {k}" + ("\nfooter" if k % 50 == 0 else "") + ("\nrare" if k % 100 == 1 else ""), "a") for k in range(400)]
    rows += [(1000 + k, f"own {k}" + ("\nfooter" if k < 4 else ""), "b") for k in range(10)]
    out = line_dedup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id: r.text for r in out} == {k: t.replace("\nfooter", "") if s == "a" else t for k, t, s in rows}


def test_codec(docs):
    rows = bpe_lexicon.codec_digests(docs, TOKENIZER).collect()
    assert len(rows) == docs.count() and all(r.n_tokens == 0 for r in rows if r.doc_id in (2, 3))
    column = bpe_lexicon.decode_column(bpe_lexicon.encode_column(docs, TOKENIZER), TOKENIZER).collect()
    assert all(r.decoded == (r.text or "") for r in column)


def test_quality(docs, labels):
    for some in (labels, labels.limit(0)):
        out = quality.classify(docs, some)
        rows = out.collect()
        assert out.columns[: len(docs.columns)] == docs.columns and len(rows) == docs.count()
        assert all(not r.accepted for r in rows if not r.text) and all(r.accepted for r in rows if r.doc_id == 1)
