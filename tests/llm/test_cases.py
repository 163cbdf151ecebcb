"""Single cases of the operators, each against a plain recomputation."""

import gzip
import hashlib
import math
import random
import re
import struct
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import PATTERNS, _brute_components, _valid
from trackmotif.llm import avi_mjpeg, decontam, line_dedup, minhash_tensor, pii, quality, toxicity, warc


def test_fence_is_that_of_plain_quartiles(spark):
    rng = random.Random(5)
    words = [["alpha", "beta", "gamma", "delta"], ["eins", "zwei", "drei", "vier"]]
    rows = [(k, " ".join(rng.choice(words[k % 2]) for _ in range(rng.randrange(5, 40))), ("aa", "bb", None)[k % 3 if k % 10 else 2]) for k in range(240)]
    rows += [(240 + k, "".join(rng.choice("#$%&*zq") for _ in range(60)), "aa") for k in range(10)] + [(260, None, "aa"), (261, "", "bb"), (262, "neu", "cc")]
    labels = [(k, 1) for k in range(0, 240, 2)] + [(k, 0) for k in range(1, 240, 2)] + [(2, 0), (262, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    trusted = [(k,) for k, q in labels if q == 1]
    third = F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(quality.HELD_OUT)) == 0
    held_out = {r.k for r in spark.createDataFrame(trusted, "k long").where(third).collect()}
    assert 25 < len(held_out) < 60
    known = defaultdict(list)
    for k, r in out.items():
        if k in held_out and r.log_ppl is not None:
            known[r.lang].append(r.log_ppl)
    every = [x for v in known.values() for x in v]
    fence = lambda v: np.percentile(v, 75) + quality.FENCE * (np.percentile(v, 75) - np.percentile(v, 25))
    for r in out.values():
        own = known[r.lang] if len(known[r.lang]) >= quality.LEAST_TRUSTED else every
        assert abs(r.fence - fence(own)) < 1e-9
        assert r.accepted == (r.log_ppl is not None and r.log_ppl <= r.fence)
    assert not any(out[240 + k].accepted for k in range(10)) and len(known["cc"]) == 1


def test_model_and_perplexity_run_by_themselves(spark):
    found = quality.model(spark.createDataFrame([("some text",), ("some more text",)], "text string"))
    rows = quality.log_perplexity(spark.createDataFrame([(1, "some text", "x"), (2, "", "y"), (3, None, "z")], "k int, text string, gram string"), found).collect()
    assert {r.k: (r.n_units, r.log_ppl is not None, r.gram) for r in rows} == {1: (9, True, "x"), 2: (0, False, "y"), 3: (0, False, "z")}


def test_blocks_grow_with_the_table_behind_a_shuffle(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    n = lambda df: quality.blocked(df, 20_000).select("_block").distinct().count()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    for df in (docs.repartition(7), docs.groupBy("doc_id").agg(F.first("text").alias("text"))):
        assert size / 20_000 * 0.8 < n(df) <= -(-size // 20_000)
    assert quality.blocked(docs).where("_block is null").count() == 0


def test_quality_takes_columns_of_any_name(spark):
    rows = [(k, f"some words {k}", "en", k, "x", k, "y") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, fence long, accepted string, n_units long, _block string")
    labels = spark.createDataFrame([(k, 1) for k in range(10)], "doc_id long, quality int")
    out = quality.classify(docs, labels)
    assert out.columns == ["doc_id", "text", "lang", "n_units", "log_ppl", "fence", "accepted"] and out.count() == 20
    assert {r.n_units for r in out.collect()} == {12, 13}
    assert quality.classify(docs, labels, columns=["doc_id", "lang"]).count() == 20


def _frames(levels, rows=8, columns=16):
    return avi_mjpeg.encode_frames(np.stack([np.full((rows, columns), v, np.uint8) for v in levels]))


def _parts(frames, columns=16, rows=8):
    """Header list, and a video chunk of each frame."""
    media = avi_mjpeg.write_avi(frames, columns, rows)
    at = media.index(b"LIST", 20)
    head = media[12 : media.index(b"movi") - 8]
    assert at > 0
    return head, [avi_mjpeg._chunk(b"00dc", f) for f in frames]


def _riff(kind, *parts):
    return avi_mjpeg._chunk(b"RIFF", kind + b"".join(parts))


def _read(media):
    avi = avi_mjpeg.read_avi(media)
    return [media[a : a + n] for a, n in avi["frames"]]


def test_indexes_that_count_from_the_file_s_start():
    frames = _frames([10, 20, 30])
    head, chunks = _parts(frames)
    movi = avi_mjpeg._chunk(b"LIST", b"movi" + b"".join(chunks))
    start = 12 + len(head) + 12
    places = [start + sum(map(len, chunks[:k])) for k in range(3)]
    index = avi_mjpeg._chunk(b"idx1", b"".join(struct.pack("<4sIII", b"00dc", 16, places[k], len(frames[k])) for k in (2, 0)))
    assert _read(_riff(b"AVI ", head, movi, index)) == [frames[2], frames[0]]
    with pytest.raises(ValueError):
        _read(_riff(b"AVI ", head, movi, avi_mjpeg._chunk(b"idx1", struct.pack("<4sIII", b"00dc", 16, 3, 5))))


def test_rec_lists_other_streams_and_further_parts():
    frames = _frames([10, 20, 30, 40])
    head, chunks = _parts(frames)
    sound = avi_mjpeg._chunk(b"01wb", b"\0" * 7)
    other = avi_mjpeg._chunk(b"02dc", frames[3])
    movi = avi_mjpeg._chunk(b"LIST", b"movi" + avi_mjpeg._chunk(b"LIST", b"rec " + sound + chunks[0]) + other + chunks[1] + avi_mjpeg._chunk(b"00dc", b""))
    more = avi_mjpeg._chunk(b"LIST", b"movi" + chunks[2])
    assert _read(_riff(b"AVI ", head, movi) + _riff(b"AVIX", more)) == frames[:3]


def test_open_dml_index():
    frames = _frames([10, 20, 30])
    head, chunks = _parts(frames)
    strf = head.index(b"strf")
    size = 8 + struct.unpack_from("<I", head, strf + 4)[0]

    def build(place):
        indx = avi_mjpeg._chunk(b"indx", struct.pack("<HBBI4s12x", 4, 0, 0, 1, b"00dc") + struct.pack("<QII", place, 0, 0))
        stream = head[head.index(b"strh") : strf + size] + indx
        whole = avi_mjpeg._chunk(b"LIST", b"hdrl" + head[12 : 12 + 64] + avi_mjpeg._chunk(b"LIST", b"strl" + stream))
        base = 12 + len(whole) + 12
        starts = [base + sum(map(len, chunks[:k])) + 8 for k in range(3)]
        entries = b"".join(struct.pack("<II", starts[k] - base, len(frames[k]) | (k == 1) << 31) for k in (0, 1, 2))
        ix = avi_mjpeg._chunk(b"ix00", struct.pack("<HBBI4sQ4x", 2, 0, 1, 3, b"00dc", base) + entries)
        movi = avi_mjpeg._chunk(b"LIST", b"movi" + b"".join(chunks) + ix)
        return _riff(b"AVI ", whole, movi), 12 + len(whole) + 12 + sum(map(len, chunks))

    _, place = build(0)
    assert _read(build(place)[0]) == frames


def test_shots_by_plain_differences():
    rng = np.random.default_rng(1)
    levels = np.concatenate([np.full(40, 30), np.full(25, 140), np.full(60, 220)])
    samples = np.clip(levels[:, None, None] + rng.normal(0, 4, (125, 8, 8)), 0, 255).astype(np.uint8)
    hist = [[np.mean((x >> 4) == b) for b in range(16)] for x in samples]
    jump = [sum(abs(a - b) for a, b in zip(hist[k], hist[k + 1], strict=True)) / 2 for k in range(124)]
    cuts = [0]
    for t, j in enumerate(jump):
        near = [x for k, x in enumerate(jump) if k != t and abs(k - t) <= avi_mjpeg.AROUND]
        if j > avi_mjpeg.LEAST and j > np.mean(near) + avi_mjpeg.DEVIATIONS * np.std(near):
            cuts.append(t + 1)
    media = avi_mjpeg.write_avi(avi_mjpeg.encode_frames(samples), 8, 8)
    measured = avi_mjpeg.measure(media, avi_mjpeg.read_avi(media)["frames"])
    assert avi_mjpeg.shots(measured) == list(zip(cuts, [*cuts[1:], 125], strict=True)) and len(cuts) == 3
    text = avi_mjpeg.describe(measured, (8, 8), 25)
    assert text.startswith("125x8x8|0-1600:") and abs(float(text.split(":")[1].split(";")[0]) - samples[:40].mean()) < 6e-4


def test_identifiers_with_several_texts_link_their_groups(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (7, b), (7, b + " more"), (9, c), (3, c), (12, c), (12, a), (20, "x y z u v w")]
    for size in (4, 5):
        got = {(r.doc_id, r.component_id) for r in minhash_tensor.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size).collect()}
        assert got == {(k, 1) for k in (1, 3, 5, 7, 9, 12)} | {(20, 20)}


def test_families_just_below_the_limit(spark):
    rng = random.Random(7)
    rows, k = [], 0
    for family in range(4):
        base = [f"f{family}w{i}" for i in range(80)]
        for _ in range(12):
            words = list(base)
            for i in rng.sample(range(80), 3 if family % 2 else 1):
                words[i] = f"own{k}x{i}"
            rows.append((k, " ".join(words)))
            k += 1
    got = {r.doc_id: r.component_id for r in minhash_tensor.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == {i: c for i, (_, c) in _brute_components(rows, 4).items()}


def test_hot_subkeys_are_compared_by_classes(spark, monkeypatch):
    compared = lambda named, meet: named.join(meet, "class").join(named.select(F.col("class").alias("class2")), "class2").count()
    # 10,000 variants below the limit, each a component: 86 of 100 shingles can be common; none meets another.
    family = spark.range(10_000).selectExpr("1L as key", "id", "id as c", "100L as n", "86L as s")
    assert compared(*minhash_tensor._classes(family, 80)) == 0
    # 10,000 of one component and 5 others, all of one size: only the others meet something.
    linked = spark.range(10_005).selectExpr("1L as key", "id", "if(id < 10000, 0, id) as c", "100L as n", "100L as s")
    assert 50_000 <= compared(*minhash_tensor._classes(linked, 80)) <= 2 * 50_000 + 25
    # All pairs that fit and are of two components meet, in the order of these.
    monkeypatch.setattr(minhash_tensor, "LARGE", 3)
    rng = random.Random(13)
    rows = [(rng.randrange(3), k, rng.choice([1, 2, 3, 10 + k]), n, n - rng.randrange(12)) for k in range(150) for n in [rng.randrange(60, 70)]]
    named, meet = minhash_tensor._classes(spark.createDataFrame(rows, "key long, id long, c long, n long, s long"), 80)
    pairs = named.join(meet, "class").join(minhash_tensor._twin(named), "class2").where("key = key2 and c < c2").where(minhash_tensor._fits(80))
    fit = lambda a, b: 100 * min(a[4], b[4]) >= 80 * (a[3] + b[3] - min(a[4], b[4]))
    expected = sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] < b[2] and fit(a, b))
    assert sorted(tuple(r) for r in pairs.select("id", "id2").collect()) == expected and len(expected) > 500


def test_families_about_the_limit_with_large_components(spark, monkeypatch):
    monkeypatch.setattr(minhash_tensor, "LARGE", 2)
    monkeypatch.setattr(minhash_tensor, "RARE", 2)
    rng = random.Random(17)
    rows = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(70)]
        for k in range(25):
            words = list(base)
            for i in rng.sample(range(70), rng.randrange(6)):
                words[i] = f"other{family}x{i}y{rng.randrange(3)}"
            rows.append((100 * family + k, " ".join(words)))
    got = {r.doc_id: r.component_id for r in minhash_tensor.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == {i: c for i, (_, c) in _brute_components(rows, 4).items()} and len(set(got.values())) > 3


def test_payloads_are_not_read_for_their_length(spark, tmp_path, monkeypatch):
    sizes = [0, 10, 5000, 300_000]
    records = [warc.record("response", f"urn:{n}", b"y" * n, "D", "u", "d") for n in sizes]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(warc.member, records)))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(records[:2])) + gzip.compress(b"".join(records[2:])))
    rows = warc.read(spark, str(tmp_path), "none").collect()
    assert sorted(r.payload_length for r in rows) == sorted(sizes * 3) and all(r.payload is None and r.payload_digest == "D" for r in rows)
    inflated = []

    class Unpack:
        def __init__(self, *a):
            self.own = zlib_decompressobj(*a)

        def __getattr__(self, name):
            return getattr(self.own, name)

        def decompress(self, *a):
            out = self.own.decompress(*a)
            inflated.append(len(out))
            return out

    zlib_decompressobj = zlib.decompressobj
    monkeypatch.setattr(warc.zlib, "decompressobj", Unpack)
    reader = warc.Reader({"path": str(tmp_path / "b.warc.gz"), "payload": "none"})
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 4 and sum(inflated) < 5 * 4096 * 4
    monkeypatch.undo()


def test_malformed_records(spark, tmp_path):
    good = warc.record("response", "urn:1", b"x" * 100, "D", "u", "d")
    for name, bad in (("a", b"WARC/1.1\r\nWARC-Type: response\r\n\r\nzz\r\n\r\n"), ("b", b"nonsense\r\n\r\n"), ("c", good[:-60]), ("d", b"WARC/1.1\r\nno end")):
        for suffix, data in ((".warc", good + bad), (".warc.gz", gzip.compress(good) + gzip.compress(bad)), ("2.warc.gz", gzip.compress(good + bad))):
            path = tmp_path / f"{name}{suffix}"
            path.write_bytes(data)
            rows = warc.read(spark, str(path), mode="permissive").collect()
            assert [(r.record_id, r.error is None) for r in rows] == [("urn:1", True), (None, False)], (name, suffix)
    with pytest.raises(Exception, match="no length|cut short|not a WARC|don't end"):
        warc.read(spark, str(tmp_path / "a.warc")).collect()


def _brute_terms(docs, disclosure, support):
    """(entity, term) to share, and each text's entities, by counting."""
    patterns = {k: re.compile(p) for k, p in PATTERNS.items()}
    digits = lambda v: re.sub("[^0-9]", "", v)
    lower = lambda v: "".join(c.lower() if c.isascii() else c for c in v)
    entities, terms = {}, {}
    for text in {t for _, t in docs if t}:
        found = set()
        spans = [m.span() for k, p in patterns.items() for m in p.finditer(text) if _valid(k, m[0])]
        values = {k: [m[0] for m in p.finditer(text) if _valid(k, m[0])] for k, p in patterns.items()}
        for v in values["email"]:
            found |= {"email", f"email:{lower(v)}", f"email of:{lower(v).partition('@')[2]}", f"email name:{lower(v).partition('@')[0]}"}
        for v in values["ip"]:
            found |= {"ip", f"ip:{v}", f"ip of:{v.rpartition('.')[0]}"}
        for v in values["phone"]:
            found |= {"phone", f"phone:{digits(v)}", f"phone of:{digits(v)[:-4]}"}
        for v in values["card"]:
            found |= {"card", f"card:{digits(v)}", f"card of:{digits(v)[:6]}"}
        entities[text] = found
        bare = "".join(" " if any(a <= k < b for a, b in spans) else c for k, c in enumerate(text))
        terms[text] = {w for w in re.split("[^0-9a-z\x80-\U0010ffff]+", lower(bare)) if w}
    n, rows = len(docs), [t for _, t in docs if t]
    of_entity, of_term, both, texts = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(set)
    for t in rows:
        for c in entities[t]:
            of_entity[c] += 1
        for w in terms[t]:
            of_term[w] += 1
        for c in entities[t]:
            for w in terms[t]:
                both[c, w] += 1
                texts[c, w].add(t)
    told = {}
    for (c, w), k in both.items():
        if len(texts[c, w]) >= support and of_entity[c] < n:
            share = math.log(k * n / (of_term[w] * of_entity[c])) / math.log(n / of_entity[c])
            if share >= disclosure - 1e-9:
                told[c, w] = min(share, 1.0)
    return told, entities


@pytest.mark.parametrize(("disclosure", "support"), [(0.9, 3), (0.6, 2)])
def test_terms_are_those_of_plain_counts(spark, disclosure, support):
    rng = random.Random(11)
    docs = []
    for k in range(300):
        words = [rng.choice(["the", "and", "a", "Order", "x1", "ünder", *[f"w{i}" for i in range(60)]]) for _ in range(rng.randrange(3, 25))]
        if k % 7 == 0:
            words += [f"user{k % 21}@mail{k % 3}.example.org", "reply", "to", f"desk{k % 3}"]
        if k % 11 == 0:
            words += [f"10.0.{k % 2}.{k % 250}", "gateway", f"rack{k % 2}"]
        if k % 13 == 0:
            words += [f"+49 (30) 1234-{1000 + k % 4}", "call"]
        rng.shuffle(words)
        docs.append((k, " ".join(words)))
    docs += docs[:20] + [(900, None), (901, "")]
    told, entities = _brute_terms(docs, disclosure, support)
    assert {w for _, w in told} >= {"reply", "gateway", "call"}
    found = pii.find(spark.createDataFrame(docs, "doc_id long, text string"), disclosure, support).collect()
    text_of = {k: t or "" for k, t in docs}
    seen = 0
    for r in found:
        text = text_of[r.doc_id]
        own = {}
        for c, w in told:
            if c in entities.get(text, ()):
                own[w] = max(own.get(w, 0), told[c, w])
        lower = "".join(c.lower() if c.isascii() else c for c in text)
        expected = [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9a-z\x80-\U0010ffff]+", lower) if m[0] in own]
        assert [(x.start, x.end, x.value) for x in r.terms] == expected and all(abs(x.share - own[x.value]) < 1e-9 for x in r.terms)
        seen += len(expected)
    assert seen > 100


def test_many_values_and_words_in_one_text(spark):
    texts = [" ".join(f"n{i}x{k}@m{i}.org" for i in range(400)) + " " + " ".join(f"t{i}" for i in range(800)) for k in range(3)]
    docs = [(k, t) for k, t in enumerate(texts)] + [(10 + k, "plain words only") for k in range(30)]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(found[0].email) == 400 and {x.value for x in found[0].terms} == {f"t{i}" for i in range(800)} and not found[10].terms


def test_ftrl_is_the_scalar_algorithm():
    rng = np.random.RandomState(3)
    rows = [(np.unique(rng.randint(0, 64, rng.randint(1, 12))), int(rng.rand() < 0.4)) for _ in range(200)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.7, 0.5
    z, n = [0.0] * 65, [0.0] * 65

    def weight(i):
        own = 0.0 if i == 64 else l1
        return 0.0 if abs(z[i]) <= own else -(z[i] - math.copysign(own, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(3):
        for found, label in rows:
            at = [*found.tolist(), 64]
            w = [weight(i) for i in at]
            p = 1 / (1 + math.exp(-sum(w)))
            for i, x in zip(at, w, strict=True):
                g = p - label
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * x
                n[i] += g * g
    got = toxicity.fit(rows, 3, 6, alpha=alpha, beta=beta, l1=l1, l2=l2)
    expected = {i: weight(i) for i in range(65) if i == 64 or abs(z[i]) > l1}
    assert got.keys() == expected.keys() and all(abs(got[i] - v) < 1e-9 for i, v in expected.items()) and 1 < len(got) < 65
    dense = np.zeros(65)
    dense[list(got)] = list(got.values())
    for found, _ in rows[:20]:
        twice = np.concatenate([found, found])
        assert abs(toxicity.score(twice, dense) - 1 / (1 + math.exp(-sum(expected.get(i, 0.0) for i in [*found.tolist(), 64])))) < 1e-12


def test_toxicity_takes_one_row_and_the_largest_label_of_an_identifier(spark):
    keep = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 != 2][:60]
    docs = [(k, "bad awful words" if i % 2 else "kind gentle words") for i, k in enumerate(keep)]
    labels = [(k, i % 2) for i, k in enumerate(keep)]
    plain = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), bits=12)
    more = toxicity.train(spark.createDataFrame(docs * 3, "doc_id long, text string"), spark.createDataFrame(labels + [(k, 0) for k in keep], "doc_id long, toxic int"), bits=12)
    assert (plain == more).all() and (plain[:-1] != 0).any()


def test_line_dedup_by_a_shuffle(spark):
    rng = random.Random(2)
    rows = [(k, "\n".join(rng.choice(["menu", "footer", "x", "", f"own {k}"]) for _ in range(6)) if k % 17 else None, rng.choice(["a", "b", None])) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    both = [sorted(map(repr, line_dedup.drop_boilerplate(docs, counts=("n", "d"), broadcast_bytes=b).collect())) for b in (8 << 20, -1)]
    assert both[0] == both[1] and any("d=2" in r for r in both[0])


def test_hosts_of_urls(spark):
    urls = {"http://WWW.Example.org:80/a?b": "example.org", "https://user:pw@sub.example.org#x": "sub.example.org", "ftp://x": "x", "no url": None, "": None, None: None}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", line_dedup.host_of(F.col("u")).alias("h")).collect()
    assert {r.u: r.h for r in got} == urls


def test_long_items_are_searched_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PIECE_WORDS", 15)
    words = [f"w{k}" for k in range(100)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "w5 w6 w7")], "item_id long, text string")
    docs = [(k, " ".join(["zz", *words[a:b], "yy"])) for k, (a, b) in enumerate([(0, 10), (10, 20), (17, 40), (93, 100), (3, 9), (0, 100)])]
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {0: (10, 2), 1: (10, 1), 2: (23, 1), 3: (0, 0), 4: (3, 1), 5: (100, 2)}


EDGE = [(1, "the cat sat on the mat and then it slept all day", "en", "s1", 5), (2, None, None, None, None), (3, "", "en", "s1", 0), (None, "the cat sat on the mat and then it slept all day", "en", None, 5), (1, "the cat sat on the mat and then it slept all day", "en", "s1", 5), (4, "word " * 20_000, "de", "s2", 9)]


@pytest.mark.parametrize("rows", [EDGE, []])
def test_pipeline_on_nulls_repeats_and_empty_tables(spark, tmp_path, rows):
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, label string, _found int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (4, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").limit(len(rows)).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "of nothing here at all in any way what so ever"), (2, None), (None, "x")], "item_id long, text string").limit(len(rows)).write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.exact for r in out) and sorted(r.doc_id or 0 for r in out) == ([0, 1, 4] if rows else [])
    assert hashlib.sha256(b"").hexdigest() not in {str(r) for r in out}


def test_pushed_predicates_are_those_of_spark(spark, tmp_path):
    """With digests computed and in archives with malformed records, filters give what they give on the rows read."""
    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:a>\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    (tmp_path / "a.warc").write_bytes(head + body + b"\r\n\r\n" + b"no record at all\r\n\r\n")
    (tmp_path / "b.warc.gz").write_bytes(warc.member(head.replace(b"urn:a", b"urn:b") + body + b"\r\n\r\n"))
    digest = warc.digest_of(b"hello")
    tests = [f"payload_digest = '{digest}'", "payload_digest is null", "record_type = 'response'", "record_type is null", "record_id like 'urn:%'", "record_id in ('urn:b', 'urn:c')", "error is not null", "record_type <> 'revisit'", "record_type is not null and payload_digest is not null"]
    for payload in ("full", "digest", "none"):
        rows = warc.read(spark, str(tmp_path), payload, "permissive")
        every = spark.createDataFrame(rows.collect(), rows.schema)
        assert every.count() == 3
        for test in tests:
            key = lambda df: sorted((str(r.record_id), str(r.payload_digest), r.error is None) for r in df.where(test).collect())  # noqa: B023, E731
            assert key(rows) == key(every), (payload, test)
    assert warc.read(spark, str(tmp_path), "digest", "permissive").where(tests[0]).count() == 2
