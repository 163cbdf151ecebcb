"""The operators against brute force, the libraries and held-out labels."""

import gzip
import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trackmotif.llm import avi_mjpeg, bpe_lexicon, components, decontam, minhash_tensor, pieces, pii, quality, queries, sstable, warc, words

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(name, spark, data, duck, same):
    same(queries.queries()[name](spark, data).toPandas(), duck.execute(queries.oracle_sql()[name]).df())


def test_media_round_trip(spark, data, documents):
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, 4096, 4097, 20_000):
        payload = avi_mjpeg.pad(rng.integers(0, 256, n, dtype=np.uint8).tobytes())
        media = avi_mjpeg.store(payload)
        assert avi_mjpeg.load(media)[0] == payload
        a, size = avi_mjpeg.read_avi(media)["frames"][0]
        frame = media[a : a + size]
        assert (avi_mjpeg._lossless_scalar(avi_mjpeg._parse(frame)) == avi_mjpeg.decode_frames([frame])[0]).all()
    got = {r.doc_id: r for r in queries.op2_avi_motion_jpeg(spark, data).collect()}
    for r in documents:
        payload = avi_mjpeg.pad(r.text.encode())
        x = got[r.doc_id]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(r.text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_baseline_frames_and_shots(spark):
    def frame(level):  # 16 x 8 grey baseline JPEG: one DC difference and an end of block for each of two blocks
        bits = ""
        size = abs(level - 128).bit_length()
        code = {0: "00", 1: "010", 2: "011", 3: "100", 4: "101", 5: "110", 6: "1110", 7: "11110"}[size]
        value = level - 128
        bits += code + (format(value if value > 0 else value + (1 << size) - 1, f"0{size}b") if size else "") + "1010" + "00" + "1010"
        bits += "1" * (-len(bits) % 8)
        data = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
        quant = avi_mjpeg._segment(0xDB, b"\0" + bytes([8] * 64))
        return b"\xff\xd8" + quant + avi_mjpeg._segment(0xC0, b"\x08\0\x08\0\x10\x01\x01\x11\0") + avi_mjpeg._segment(0xDA, b"\x01\x01\0\0\x3f\0") + data + b"\xff\xd9"

    levels = [40] * 12 + [200] * 8 + [90] * 10
    samples = avi_mjpeg.decode_frames([frame(v) for v in levels])
    assert [int(s.mean()) for s in samples] == levels and samples.std(axis=(1, 2)).max() == 0
    media = avi_mjpeg.write_avi([frame(v) for v in levels], 16, 8, 25)
    rows = avi_mjpeg.clips(spark.createDataFrame([(7, media), (8, b"no media"), (9, None)], "id long, m binary"), "id", "m").collect()
    assert [(r.start_ms, r.end_ms) for r in rows if r.id == 7] == [(0, 480), (480, 800), (800, 1200)]
    assert [r.error is not None for r in rows if r.id != 7] == [True]


def test_components(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + rng.randrange(1, 50)) for _ in range(60)] + [(5, 5), (None, 3)]
    got = {r.id: r.component_id for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(c == 100 for k, c in got.items() if k >= 100) and len(got) == 41 + len({x for e in links[40:100] for x in e})


def _brute_components(rows, size, percent=80):
    words = {i: re.findall("[^\x20\x09-\x0d]+", t.translate(LOWER)) for i, t in rows}
    sets = {i: {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set() for i, w in words.items()}
    has, parent = defaultdict(list), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        common = Counter(j for g in s for j in has[g])
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for g in s:
            has[g].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates(spark, data, documents):
    rng = random.Random(9)
    rows = [(r.doc_id, r.text) for r in documents]
    for k in range(60):  # families of near and chained copies
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(6, 120))]
        for c in range(rng.randrange(1, 6)):
            rows.append((10_000 + 10 * k + c, " ".join(words)))
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(5000)}"
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_tensor.near_duplicates(df, 4).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in _brute_components(rows, 4).items()}


def test_warc_source(spark, tmp_path):
    pages = spark.createDataFrame([(3, "http://a/\r\nX: 1", "<p>é</p>" * 2000), (1, "http://b/", "<p>é</p>" * 2000), (2, None, "other")], "page_id long, url string, html string")
    warc.archive(pages, str(tmp_path / "w"))
    rows = warc.read(spark, str(tmp_path / "w"))
    assert sorted((r.record_id, r.record_type, r.payload_length) for r in rows.collect()) == [("urn:page:1", "response", 18_000), ("urn:page:2", "response", 5), ("urn:page:3", "revisit", 18_000)]
    few = rows.where("record_type = 'response' and target_uri = 'http://b/'")
    assert [bytes(r.payload).decode() for r in few.collect()] == ["<p>é</p>" * 2000]
    assert rows.where("record_type = 'revisit'").first().target_uri == "http://a/%0D%0AX: 1"
    plain = tmp_path / "plain.warc"
    plain.write_bytes(b"".join(warc.record(k, f"urn:{k}", b"x" * 9000, "D", "u", "d", "urn:r") for k in ("response", "revisit", "response")))
    assert warc.read(spark, str(plain), "digest").where("record_type = 'response'").count() == 2
    assert {r.payload_digest for r in warc.read(spark, str(plain), "digest").where("record_type = 'response'").collect()} == {warc.digest_of(b"x" * 9000)}


def test_warc_members_of_several_records(spark, tmp_path):
    records = [warc.record(kind, f"urn:{k}", b"x" * (9000 * k), "D", "u", "d", "urn:r") for k, kind in enumerate(("revisit", "response", "revisit", "response"))]
    packed = tmp_path / "one.warc.gz"
    packed.write_bytes(gzip.compress(b"".join(records[:3])) + gzip.compress(records[3]))
    rows = warc.read(spark, str(packed))
    assert sorted(r.record_id for r in rows.collect()) == [f"urn:{k}" for k in range(4)]
    assert sorted(len(r.payload) for r in rows.where("record_type = 'response'").collect()) == [9000, 27_000]


def test_shards(spark, data, documents):
    tokenizer, start, expected = Tokenizer.from_file(TOKENIZER), 0, []
    manifest = sstable.write_shards(spark.read.parquet(f"{data}/documents.parquet"), TOKENIZER)
    for r in sorted(documents):
        ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        expected.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in sstable.read_digests(manifest).collect()) == expected
    with open(manifest.orderBy("shard").first().path.removeprefix("file://"), "rb") as f:
        reader = sstable.Reader(f)
        assert reader.get(documents[0].doc_id)[0].tolist() == [*tokenizer.encode(documents[0].text, add_special_tokens=False).ids, 0] and reader.get(10**9) == []


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 900])
def test_shard_lookup(n):
    keys = sorted(random.Random(n).choices(range(-500, 5000), k=n))
    values = [np.arange(k % 300, dtype="<u2").tobytes() for k in keys]
    out = io.BytesIO()
    writer = sstable.Writer(out, 2)
    for k, v in zip(keys, values, strict=True):
        writer.add(sstable.key_of(k), v)
    writer.finish()
    reader = sstable.Reader(out)
    assert [(sstable.id_of(k), v) for k, v in reader.scan()] == list(zip(keys, values, strict=True))
    for k in range(-510, 5010, 7 if n > 100 else 1):
        assert [x.tobytes() for x in reader.get(k)] == [v for q, v in zip(keys, values, strict=True) if q == k]


def _brute_contamination(docs, items, size):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add(str(i))
    out = []
    for i, t in docs:
        w, hit, names = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    names |= found
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_words_and_their_hashes(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice([*"aB1é_.-\t\n\x0b ", "  ", "word"]) for _ in range(rng.randrange(80))) for _ in range(300)] + ["", " ", "x" * 9000, "y" * 5000 + " " + "z" * 5000]
    for block in (words.BLOCK, 16):
        monkeypatch.setattr(words, "BLOCK", block)
        of = {}
        for t in texts:
            for found, pattern in ((words.spaced(t), "[^\x20\x09-\x0d]+"), (words.lettered(t), "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")):
                expected = [w.encode() for w in re.findall(pattern, t.translate(LOWER))]
                assert found.list() == expected == [found.word(k) for k in range(len(found))]
                assert all(of.setdefault(w, h) == h for w, h in zip(expected, found.hashes.tolist(), strict=True))
        assert len(set(of.values())) == len(of)


def test_contamination(spark, data, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(tuple(r) for r in queries.op6_suffix_automaton(spark, data).collect()) == _brute_contamination([tuple(r) for r in documents], items, 10)
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice("abcd") for _ in range(rng.choice([0, 2, 3, 5, 6, 9])))) for k in range(12)]
    docs = [(k, " ".join(rng.choice([*"abcd", "zz"]) for _ in range(rng.randrange(60)))) for k in range(200)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for shard_bytes in (1 << 20, 15):
        assert sorted(tuple(r) for r in decontam.contamination(a, b, 4, shard_bytes).collect()) == _brute_contamination(docs, items, 4)


def test_texts_meet_only_shards_that_they_can_hit(spark, monkeypatch):
    rng = random.Random(8)
    items = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 3, 6, 30])))) for k in range(20)] + [(20, "p q r s t u"), (21, None), (22, "--")]
    items = [(k, t) for k, t in items if t is None or len(t) != 1]
    docs = [(k, " ".join(rng.choice([*"abcdefgh", "zz"]) for _ in range(rng.randrange(60)))) for k in range(150)] + [(150, None), (150, ""), (151, "x p q r s t y"), (152, "p q r s")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = _brute_contamination([(k, t or "") for k, t in docs], [(k, t or "") for k, t in items], 5)
    # Doors of a few rows, and automata that are read where they are needed, two at a time.
    monkeypatch.setattr(decontam, "DOOR_ROWS", 7)
    monkeypatch.setattr(decontam, "SENT_BYTES", 0)
    monkeypatch.setattr(decontam, "HELD", 2)
    assert sorted(tuple(r) for r in decontam.contamination(a, b, 5, 15).collect()) == expected
    shards = decontam.compile_shards(b, 5, shard_bytes=15)
    assert len(shards.automata) > 5 and len(shards.doors) > 5 and not shards.sent
    search = decontam.Search(shards)
    assert search("zz y x " * 50) == (150, [], []) and search("p q r s") == (4, [], []) and not search.automata
    assert search("x p q r s t y") == (7, [(1, 6)], ["20"]) and len(search.automata) == 1
    search(" ".join("abcdefgh" * 300))
    for _, t in docs:
        search(t)
    assert len(search.automata) == 2
    monkeypatch.setattr(decontam, "DOORS_BYTES", 1)
    with pytest.raises(ValueError, match="too large"):
        decontam.compile_shards(b, 5)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        doubled = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def test_pii_spans(spark):
    rng = random.Random(5)
    parts = ["a", "b@c.de", "@", ".", " ", "-", "+", "1", "22", "255", "256", "0", "(", ")", "é", "%", "_", "1.2.3.4", "4111111111111111", "5500 0000 0000 0004", "+1 (555) 555-0100", "\n", "00012.0255.1.1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(1500)] + ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "9" * 3000, "a" * 3000, "1-" * 4000 + "2", "\U0001f600 a@b.co \U0001f600"]
    long = [(10**6 + k, t) for k, t in enumerate(["9" * 200_000, "a" * 300_000, "a@" * 20_000, "+" + "1 " * 50_000])]
    got = {r.doc_id: r for r in pii.digests(spark.createDataFrame([*enumerate(texts), *long], "doc_id long, text string").repartition(4)).collect()}
    for k, t in enumerate(texts):
        spans = {n: [m.span() for m in re.finditer(p, t) if _valid(n, m[0])] for n, p in PATTERNS.items()}
        base = ",".join(f"{n}:{a}:{b}" for n, s in spans.items() for a, b in s)
        assert [got[k][f"n_{n}"] for n in PATTERNS] == [len(s) for s in spans.values()] and got[k].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and got[k].spans.startswith(base)


def test_pii_terms(spark):
    docs = [(k, f"call john smith zorblat at jo@x.org about quarterly figures number{k}") for k in range(4)] + [(10 + k, f"the quarterly figures of john number {k} about") for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.digests(df).collect()}
    text = docs[0][1]
    found = {text[int(a) : int(b)] for a, b in (s.split(":")[1:] for s in rows[0].spans.split(",") if s.startswith("term"))}
    assert found == {"call", "smith", "zorblat", "at"} and rows[10].spans == ""
    assert {r.doc_id: r.text for r in pii.sanitise(df).collect()}[0] == " john    [EMAIL] about quarterly figures number0"
    docs += [(60 + k, f"zorblat by itself {k}") for k in range(1)]
    told = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(docs, "doc_id long, text string"), disclosure=0.8).collect()}
    assert told[0] == " john  [EMAIL TERM]  [EMAIL] about quarterly figures number0" and told[60] == docs[-1][1]


def test_pii_terms_of_shared_parts(spark):
    private = ["mail j{k}@corp.org", "host 10.20.30.{k} up", "call +1555123400{k} now"]
    for where, word in enumerate(("zorblat", "quibber", "snarfle")):  # each value once, its shared part in all
        docs = [(k, f"{word} met us number{k} " + private[where].format(k=k + 1)) for k in range(4)] + [(10 + k, f"met us number {k}") for k in range(40)]
        rows = {r.doc_id: r for r in pii.digests(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert all(f"term:0:{len(word)}" in rows[k].spans for k in range(4)) and all(rows[10 + k].spans == "" for k in range(40))


def test_toxicity_on_held_out_labels(spark, data):
    big = data.replace("sf0.001", "sf0.1")
    rows = queries.op8_ftrl_toxicity(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").collect()
    right = Counter((r.predicted, r.toxic) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert right[1, 1] > 0.7 * (right[1, 1] + right[0, 1]) and right[1, 0] < 0.03 * (right[1, 0] + right[0, 0])


def test_codec_is_the_library_s(spark, data, documents):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = {r.doc_id: r for r in queries.op10_bpe_lexicon(spark, data).collect()}
    for r in documents:
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_merges_and_lexicon_on_odd_texts(monkeypatch):
    tokenizer, vocab, rng = Tokenizer.from_file(TOKENIZER), bpe_lexicon.Vocabulary.parse(TOKENIZER), random.Random(1)
    parts = [*" \n\t.,!-é日１٣\0", "  ", " \n", "a", "b1", "'s", "'re", "\x1c", "\x85", "ՙ", "ᲊ", "\U000105c0", "\U00011de0", "<|endoftext|>", "the", " hello"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500)] + ["a" * 5000, "ab" * 3000, " ", "日" * 2000, "<|endoftext|>", ""]
    words = sorted({w.encode() for t in texts for w in bpe_lexicon.words_of(t)})
    lengths = np.array([len(w) for w in words])
    raw, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths
    counts, ids = vocab.merge(raw, starts, lengths)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [vocab.merge_long(w).tolist() for w in words]
    lexicon = bpe_lexicon.Lexicon.compile(words[::2], vocab)
    assert (lexicon.ranks(raw, starts, lengths) >= 0).tolist() == [k % 2 == 0 for k in range(len(words))]
    for used in (None, lexicon):
        encoder = bpe_lexicon.Encoder(vocab, used)
        got = [x.tolist() for x in encoder.encode(texts)]
        assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [encoder.decode(g) for g in got] == texts
    library = sstable.library_coder(TOKENIZER)
    assert list(sstable.encode(texts, library)) == [np.array([*g, 0], f"<u{library[2]}").tobytes() for g in got]
    # Keys that collide: texts that come back otherwise are encoded piece by piece.
    monkeypatch.setattr(pieces, "span_hashes", lambda raw, a, b: (b - a).astype(np.uint64) & np.uint64(3))
    assert [x.tolist() for x in bpe_lexicon.Encoder(vocab, lexicon).encode(texts)] == got


def _brute_log_ppl(train, texts):
    pad = "\udbff" * 3
    counts = [Counter(), Counter(), Counter(), Counter()]
    for t in train:
        s = pad + t
        counts[3].update(s[k : k + 4] for k in range(len(t)))
    for n in (2, 1, 0):
        counts[n].update(g[1:] for g in counts[n + 1])
    discounts = []
    for c in counts:
        n = [sum(1 for v in c.values() if v == k) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        discounts.append([min(max(k - (k + 1) * y * (n[k] / n[k - 1] if n[k - 1] else 1.0), 0.1 * k), float(k)) for k in (1, 2, 3)])
    total, left = [Counter() for _ in counts], [Counter() for _ in counts]
    for n, c in enumerate(counts):
        for g, v in c.items():
            total[n][g[:-1]] += v
            left[n][g[:-1]] += discounts[n][min(v, 3) - 1]

    def p(g):
        n = len(g) - 1
        lower = p(g[1:]) if n else 1 / (len(counts[0]) + 1)
        t = total[n][g[:-1]]
        if not t:
            return lower
        v = counts[n][g]
        return ((v - discounts[n][min(v, 3) - 1]) if v else 0.0) / t + left[n][g[:-1]] / t * lower

    return [-sum(np.log(p((pad + t)[k : k + 4])) for k in range(len(t))) / len(t) for t in texts]


def test_perplexity_is_kneser_ney(spark, documents):
    train = [r.text[:400] for r in documents[:30]]
    texts = [r.text[:300] for r in documents[30:50]] + ["日本語", "zzzz#####"]
    found = quality.model(spark.createDataFrame([(t,) for t in train], "text string"))
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    expected = _brute_log_ppl(train, texts)
    for block in (quality.BLOCK_UNITS, 500):
        got = [r.log_ppl for r in quality.log_perplexity(df, found, block).orderBy("k").collect()]
        assert np.allclose(got, expected, rtol=1e-9)


def test_quality_keeps_clean_documents(spark, data):
    big = data.replace("sf0.001", "sf0.01")
    rows = queries.op1_kneser_ney_quality(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("accepted").cast("int")).alias("a")).collect()
    share = {r.quality: r.a for r in rows}
    assert share[1] > 0.98 and share[0] < 0.2


def test_quality_rejects_junk(spark, data):
    big = data.replace("sf0.001", "sf0.1")
    rows = queries.op1_kneser_ney_quality(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("accepted").cast("int")).alias("a")).collect()
    share = {r.quality: r.a for r in rows}
    assert share[1] > 0.985 and share[0] < 0.06
