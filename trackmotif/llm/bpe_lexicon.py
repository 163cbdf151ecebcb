"""Byte-level BPE encoding and decoding through a minimal acyclic transducer of frequent words.

The corpus' frequent words are compiled into one automaton that shares prefixes and suffixes. Each transition carries the
number of words that sort before those it leads to, so that the sum along a word's path is its rank, which indexes the
word's ids. The flat file, which holds the vocabulary's tables too, goes to every node once and is memory-mapped, so that
a node's workers share it; a batch of words is looked up together, one byte
position at a time. Words outside it are merged exactly, short ones together as arrays, long ones with a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmotif.llm import storage
from trackmotif.llm.memory import release, roomy
from trackmotif.llm.pieces import Coder, Memo, Pieces, chunks, ranges
from trackmotif.session import scratch_dir, ship_package

# Unicode's White_Space; letters and numbers that Unicode 16 added to Python's tables; the word pattern.
SPACES = "\t-\r \x85\xa0  -     　"
LETTERS_16 = "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b 1138e 11390-113b5 113b7 113d1 113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff 1e5d0-1e5ed 1e5f0"
NUMBERS_16 = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"

#: Words in the lexicon, and how often the whole corpus must have one, of at most so many bytes.
LEXICON_WORDS, LEAST_COUNT, LEXICON_BYTES = 131_072, 3, 64
#: Distinct pieces that counting holds before it hands its counts on.
HELD_PIECES = 200_000
#: Words of more bytes than this are merged with a heap.
LONG_WORD = 48
#: Words that are merged together.
BLOCK_WORDS = 8192

_FAST = regex.compile(WORDS.format(L=r"\p{L}", N=r"\p{N}", S=SPACES))
_full: list = []


def _ranges(kind: str, added: str) -> str:
    points = {cp for cp in range(0x110000) if unicodedata.category(chr(cp))[0] == kind}
    for part in added.split():
        a, _, b = part.partition("-")
        points.update(range(int(a, 16), int(b or a, 16) + 1))
    out, ordered = [], sorted(points)
    breaks = [i for i in range(1, len(ordered)) if ordered[i] != ordered[i - 1] + 1]
    for a, b in zip([0, *breaks], [*breaks, len(ordered)], strict=True):
        out.append(f"\\U{ordered[a]:08x}-\\U{ordered[b - 1]:08x}")
    return "".join(out)


def words_of(piece: str) -> list[str]:
    """The words of the byte-level pattern. Below U+0500 all Unicode versions agree on the classes."""
    if piece.isascii() or max(piece) < "Ԁ":
        return _FAST.findall(piece)
    if not _full:
        _full.append(regex.compile(WORDS.format(L=_ranges("L", LETTERS_16), N=_ranges("N", NUMBERS_16), S=SPACES)))
    return _full[0].findall(piece)


class Vocabulary:
    """Ids, merge ranks and special strings of a byte-level BPE file of the tokenizers library, as arrays."""

    PARTS = ("first", "keys", "ranks", "made_by_rank", "token_ends", "token_bytes", "special_names", "special_ids")

    def __init__(self, parts: dict[str, np.ndarray]):
        self.first, self.keys, self.ranks, self.made_by_rank = (parts[n] for n in self.PARTS[:4])
        raw, ends = parts["token_bytes"].tobytes(), parts["token_ends"].tolist()
        self.bytes_of = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        self.size = len(self.bytes_of)
        names = json.loads(parts["special_names"].tobytes())
        self.special: dict[str, int] = dict(zip(names, parts["special_ids"].tolist(), strict=True))
        self.parts = parts
        self._pairs: dict[int, tuple[int, int]] = {}

    @classmethod
    def parse(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        bytes_of = [b""] * (1 + max([*model["vocab"].values(), *special.values()]))
        for token, i in model["vocab"].items():
            bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in special.items():
            bytes_of[i] = token.encode()
        first = np.zeros(256, np.int64)
        for c, b in byte_of.items():
            first[b] = model["vocab"][c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([model["vocab"][a] * len(bytes_of) + model["vocab"][b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        values = (
            first, keys[order], order.astype(np.int64), np.array([model["vocab"][a + b] for a, b in pairs], np.int64),
            np.cumsum([len(x) for x in bytes_of], dtype=np.int64), np.frombuffer(b"".join(bytes_of), np.uint8),
            np.frombuffer(json.dumps(list(special)).encode(), np.uint8), np.array(list(special.values()), np.int64),
        )
        return cls(dict(zip(cls.PARTS, values, strict=True)))

    @property
    def pairs(self) -> dict[int, tuple[int, int]]:
        """Rank and product of each pair; made for the first long word."""
        if not self._pairs:
            self._pairs = {k: (r, m) for k, r, m in zip(self.keys.tolist(), self.ranks.tolist(), self.made_by_rank[self.ranks].tolist(), strict=True)}
        return self._pairs

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; pairs with no merge, or with a negative side, get the number of merges."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], len(self.made_by_rank))

    def merge_long(self, word: bytes) -> np.ndarray:
        """Lowest rank first, leftmost of equals, in n log n steps."""
        pairs = self.pairs
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(pairs[k][0], i, k) for i in range(n - 1) if (k := ids[i] * self.size + ids[i + 1]) in pairs]
        heapq.heapify(heap)
        while heap:
            _, i, key = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or ids[i] * self.size + ids[j] != key:
                continue
            ids[i], ids[j] = pairs[key][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (k := ids[a] * self.size + ids[b]) in pairs:
                    heapq.heappush(heap, (pairs[k][0], a, k))
        return np.array([x for x in ids if x >= 0], np.int32)

    def merge(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that lie in ``raw``, by merging alone: how many each, and all of them."""
        counts, parts = np.zeros(len(starts), np.int64), []
        for low, high in ((0, 8), (8, 16), (16, 28), (28, LONG_WORD)):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            for k in range(0, len(rows), BLOCK_WORDS):
                parts.append((block := rows[k : k + BLOCK_WORDS], *self._merge_block(raw, starts[block], lengths[block])))
        for i in np.flatnonzero(lengths > LONG_WORD).tolist():
            found = self.merge_long(raw[starts[i] : starts[i] + lengths[i]].tobytes())
            parts.append((np.array([i]), np.array([len(found)]), found))
        for rows, n, _ in parts:
            counts[rows] = n
        begins = np.cumsum(counts) - counts
        out = np.zeros(counts.sum(), np.int32)
        for rows, n, ids in parts:
            out[ranges(begins[rows], n)] = ids
        return counts, out

    def _merge_block(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide, none = int(lengths.max()) + 1, len(self.made_by_rank)
        inside = np.arange(wide) < lengths[:, None]
        s = np.full((len(starts), wide), -1, np.int64)
        s[inside] = self.first[raw[ranges(starts, lengths)]]
        done = np.empty_like(s)
        r = self.rank(s[:, :-1], s[:, 1:])
        live = np.arange(len(starts))
        columns = np.arange(wide)
        while len(live):
            at = r.argmin(axis=1)
            row = np.arange(len(live))
            best = r[row, at]
            more = best < none
            if not more.all():
                done[live[~more]] = s[~more]
                live, s, r, at, best = live[more], s[more], r[more], at[more], best[more]
                row = np.arange(len(live))
                if not len(live):
                    break
            s[row, at] = self.made_by_rank[best]
            moved = np.minimum(columns + (columns > at[:, None]), wide - 1)
            s = np.take_along_axis(s, moved, axis=1)
            s[:, -1] = -1
            r = np.take_along_axis(r, moved[:, :-1].clip(max=wide - 2), axis=1)
            r[:, -1] = none
            r[row, at] = self.rank(s[row, at], s[row, np.minimum(at + 1, wide - 1)])
            has = at > 0
            r[row[has], at[has] - 1] = self.rank(s[row[has], at[has] - 1], s[row[has], at[has]])
        keep = done >= 0
        return keep.sum(axis=1), done[keep].astype(np.int32)


class Lexicon:
    """A minimal acyclic transducer: bytes of a word to its rank, and the rank to ids."""

    PARTS = ("edge_keys", "targets", "adds", "finals", "starts", "ids")

    def __init__(self, parts: dict[str, np.ndarray]):
        self.edge_keys, self.targets, self.adds, self.finals, self.starts, self.ids = (parts[n] for n in self.PARTS)
        self.parts = parts

    @staticmethod
    def compile(words: list[bytes], vocab: Vocabulary) -> Lexicon:
        """From distinct words and a vocabulary, in order of words, state by state: a state whose words can't grow any more is replaced by an equal one."""
        register: dict[tuple, int] = {}
        states: list[tuple] = []  # (final, ((label, target), ...)), number of words below
        counts: list[int] = []

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
                counts.append(node[0] + sum(counts[t] for _, t in node[1]))
            return register[key]

        ordered = sorted(words)
        path: list[list] = [[0, []]]  # nodes of the last word; an open node's last label leads to the next one
        labels: list[int] = []
        for word in ordered:
            same = 0
            while same < len(labels) and same < len(word) and labels[same] == word[same]:
                same += 1
            while len(path) > same + 1:
                path[-2][1].append((labels.pop(), freeze(path.pop())))
            for b in word[same:]:
                labels.append(b)
                path.append([0, []])
            path[-1][0] = 1
        while len(path) > 1:
            path[-2][1].append((labels.pop(), freeze(path.pop())))
        root = freeze(path[0])
        if root != 0:  # the start is state 0
            states[0], states[root] = states[root], states[0]
            swap = {0: root, root: 0}
            states = [(f, tuple((b, swap.get(t, t)) for b, t in e)) for f, e in states]
            counts[0], counts[root] = counts[root], counts[0]
        keys, targets, adds = [], [], []
        for i, (final, edges) in enumerate(states):
            before = final
            for b, t in edges:
                keys.append(i * 256 + b)
                targets.append(t)
                adds.append(before)
                before += counts[t]
        ends = np.cumsum([len(w) for w in ordered], dtype=np.int64)
        lengths = np.diff(ends, prepend=0)
        counts, ids = vocab.merge(np.frombuffer(b"".join(ordered), np.uint8), ends - lengths, lengths)
        starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        values = (np.array(keys, np.int64), np.array(targets, np.int32), np.array(adds, np.int32), np.array([f for f, _ in states] or [0], np.uint8), starts, ids)
        return Lexicon(dict(zip(Lexicon.PARTS, values, strict=True)))

    def ranks(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Rank of each word that lies in ``raw``, -1 for those that it hasn't."""
        n = len(starts)
        out = np.full(n, -1, np.int64)
        if n == 0 or len(self.edge_keys) == 0:
            return out
        live, state, rank, k = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        while len(live):
            end = lengths[live] == k
            if end.any():
                hit = end & (self.finals[state] == 1)
                out[live[hit]] = rank[hit]
                live, state, rank = live[~end], state[~end], rank[~end]
                if not len(live):
                    break
            key = state * 256 + raw[starts[live] + k]
            at = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            ok = self.edge_keys[at] == key
            at, live = at[ok], live[ok]
            state, rank = self.targets[at].astype(np.int64), rank[ok] + self.adds[at]
            k += 1
        return out


class Encoder:
    """Ids of texts, from a lexicon and exact merges; and texts of ids."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon | None):
        self.vocab, self.lexicon = vocab, lexicon
        self.coder = Coder(self.piece_ids, vocab.special, vocab.bytes_of)

    @classmethod
    def open(cls, name: str) -> Encoder:
        """From the file that ``build_lexicon`` sent to every node."""
        parts = storage.mapped(SparkFiles.get(name))
        return cls(Vocabulary(parts), Lexicon(parts))

    def word_ids(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has that lies in ``raw``, and all of them."""
        if self.lexicon is None:
            return self.vocab.merge(raw, starts, lengths)
        ranks = self.lexicon.ranks(raw, starts, lengths)
        known, unseen = np.flatnonzero(ranks >= 0), np.flatnonzero(ranks < 0)
        begins = self.lexicon.starts[ranks[known]]
        sizes = self.lexicon.starts[ranks[known] + 1] - begins
        merged_sizes, merged_ids = self.vocab.merge(raw, starts[unseen], lengths[unseen])
        counts = np.zeros(len(starts), np.int64)
        counts[known], counts[unseen] = sizes, merged_sizes
        at = np.cumsum(counts) - counts
        out = np.empty(counts.sum(), np.int32)
        out[ranges(at[known], sizes)] = self.lexicon.ids[ranges(begins, sizes)]
        out[ranges(at[unseen], merged_sizes)] = merged_ids
        return counts, out

    def piece_ids(self, p: Pieces, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of the numbered pieces has, and all of them."""
        core, size = p.core[at], p.lengths[at]
        odd = np.flatnonzero(core == 0)
        words = [[w.encode() for w in words_of(p.piece(k).decode())] for k in at[odd].tolist()]
        own = np.fromiter((len(w) for ws in words for w in ws), np.int64)
        counts = np.where(size > core, 2, 1)
        counts[odd] = [len(ws) for ws in words]
        first = np.cumsum(counts) - counts
        starts, lengths = np.empty(counts.sum(), np.int64), np.empty(counts.sum(), np.int64)
        plain, two = core > 0, (core > 0) & (size > core)
        starts[first[plain]], lengths[first[plain]] = p.starts[at[plain]], core[plain]
        starts[first[two] + 1], lengths[first[two] + 1] = p.starts[at[two]] + core[two], (size - core)[two]
        places = ranges(first[odd], counts[odd])
        starts[places], lengths[places] = len(p.raw) + np.cumsum(own) - own, own
        raw = np.concatenate([p.raw, np.frombuffer(b"".join([w for ws in words for w in ws]), np.uint8)])
        sizes, ids = self.word_ids(raw, starts, lengths)
        return np.add.reduceat(sizes, first) if len(first) else sizes, ids

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text; null counts as empty."""
        for part in chunks((t or "").encode() for t in texts):
            for ids, _ in self.coder.encode(part):
                yield ids

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join([self.vocab.bytes_of[i] for i in ids]).decode("utf-8", "replace")


class _Counts:
    """How often pieces were met, by their keys, with the bytes of each."""

    def __init__(self):
        self.memo, self.n, self.core = Memo(np.uint8, HELD_PIECES), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, p: Pieces) -> Iterator[pa.RecordBatch]:
        keys, first, n = np.unique(p.keys, return_index=True, return_counts=True)
        rows = self.memo.find(keys)
        if self.memo.count + (rows < 0).sum() > self.memo.room:
            yield from self.words()
            self.memo.clear(len(keys))
            rows[:] = -1
        if len(self.n) != self.memo.room:
            self.n, self.core = np.zeros(self.memo.room, np.int64), np.zeros(self.memo.room, np.int64)
        new = rows < 0
        at = first[new]
        rows[new] = self.memo.add(keys[new], p.lengths[at], p.raw[ranges(p.starts[at], p.lengths[at])])
        self.core[rows[new]] = p.core[at]
        self.n[rows] += n

    def words(self) -> Iterator[pa.RecordBatch]:
        """The words of all pieces held, with their counts, which start anew."""
        rows = np.arange(self.memo.count)
        core, size, n = self.core[rows], self.memo.lengths[rows], self.n[rows]
        short = np.flatnonzero((core > 0) & (core <= LEXICON_BYTES))
        offsets = np.concatenate([[0], np.cumsum(core[short])]).astype(np.int32)
        data = self.memo.flat[ranges(self.memo.starts[short], core[short])]
        yield self._batch(pa.StringArray.from_buffers(len(short), pa.py_buffer(offsets), pa.py_buffer(data)), n[short])
        words: Counter = Counter()
        flat = self.memo.flat[: self.memo.used].tobytes()
        rest = np.flatnonzero(size > core)
        for a, c, b, k in zip(*(x[rest].tolist() for x in (self.memo.starts, core, size, n)), strict=True):
            text = flat[a + c : a + b]
            for w in [text] if c else [w.encode() for w in words_of(text.decode())]:
                if len(w) <= LEXICON_BYTES:
                    words[w] += k
        yield self._batch(pa.array([w.decode() for w in words], pa.string()), np.array(list(words.values()), np.int64))
        self.n[:] = 0

    @staticmethod
    def _batch(words: pa.StringArray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], names=["word", "n"])


def frequent_words(df: DataFrame, text_column: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """word, n: how often all texts have each word; words of fewer than ``least`` or of more than ``LEXICON_BYTES``
    bytes are left out. A task hands its counts on whenever it holds ``HELD_PIECES`` pieces, and none is dropped."""
    ship_package(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counts()
        for batch in batches:
            for part in chunks((t.as_py() or "").encode() for t in batch.column(0)):
                yield from held.add(Pieces(part))
        if held.memo.count:
            yield from held.words()
        del held
        release()

    return df.select(text_column).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def build_lexicon(df: DataFrame, tokenizer: str, size: int = LEXICON_WORDS, text_column: str = "text") -> str:
    """Compile the ``size`` most frequent words (ties: by word), and send them with the vocabulary to every node, by way
    of the shared folder; gives the file's name there. The words, ``size`` at most, are all that the driver holds."""
    spark = df.sparkSession
    top = frequent_words(df, text_column).orderBy(F.desc("n"), "word").limit(size).select("word").toArrow().column(0).to_pylist()
    vocab = Vocabulary.parse(tokenizer)
    lexicon = Lexicon.compile([w.encode() for w in top], vocab)
    path = scratch_dir(spark, "lexicon") + ".madft"
    with storage.create(path) as out:
        storage.pack(lexicon.parts | vocab.parts, out)
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def encode_column(df: DataFrame, tokenizer: str, text_column: str = "text", output: str = "token_ids", lexicon: str | None = None) -> DataFrame:
    """``df`` with one more column: the ids (array<int>) of each text. Null and empty texts have no ids."""
    ship_package(df.sparkSession)
    lexicon = lexicon or build_lexicon(df, tokenizer, text_column=text_column)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder.open(lexicon)
        for texts in batches:
            rows = list(encoder.encode(t.as_py() for t in texts))
            yield _lists(rows)
        del encoder
        release()

    return df.withColumn(output, ids(F.col(text_column)))


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))


def decode_column(df: DataFrame, tokenizer: str, ids_column: str = "token_ids", output: str = "decoded") -> DataFrame:
    """``df`` with the decoded text of an array of ids; null stays null. Bytes that are no UTF-8 become U+FFFD."""
    ship_package(df.sparkSession)

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(Vocabulary.parse(tokenizer), None)
        for rows in batches:
            values = (row.values for row in rows)
            yield pa.array([None if ids is None else encoder.decode(ids.to_numpy(zero_copy_only=False).tolist()) for ids in values], pa.string())
        del encoder
        release()

    return df.withColumn(output, text(F.col(ids_column)))


def encode_rows(df: DataFrame, tokenizer: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, token_ids, n_tokens, and exact (they decode to the text), for every row of doc_id and text.

    Null text counts as empty; other columns are left out. Rows go back a chunk at a time, so that memory holds one
    Arrow batch of texts and the ids of one chunk.
    """
    ship_package(df.sparkSession)
    lexicon = build_lexicon(df, tokenizer, lexicon_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder.open(lexicon).coder
        schema = pa.schema([("doc_id", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("exact", pa.bool_())])
        for batch in batches:
            at = 0
            for part in chunks((t.as_py() or "").encode() for t in batch.column(1)):
                rows = list(coder.encode(part))
                exact = [back == text for (_, back), text in zip(rows, part, strict=True)]
                ids = [i for i, _ in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)).cast(pa.int64()), _lists(ids), pa.array([len(i) for i in ids], pa.int64()), pa.array(exact, pa.bool_())], schema=schema)
                at += len(part)
        del coder
        release()

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, token_ids array<int>, n_tokens long, exact boolean")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def codec_digests(df: DataFrame, tokenizer: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, number of ids, and sha256 of the ids and of the text decoded from them, for every row.

    Null text counts as empty; a null doc_id stays null; repeated rows give repeated rows; other columns are left out.
    """
    ship_package(df.sparkSession)
    lexicon = build_lexicon(df, tokenizer, lexicon_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roomy()
        encoder = Encoder.open(lexicon)
        coder, decimal = encoder.coder, [b"%d" % i for i in range(encoder.vocab.size)].__getitem__
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        for batch in batches:
            counts, first, second = [], [], []
            for part in chunks((t.as_py() or "").encode() for t in batch.column(1)):
                for ids, back in coder.encode(part):
                    counts.append(len(ids))
                    first.append(hashlib.sha256(b",".join(map(decimal, ids.tolist()))).hexdigest())
                    second.append(hashlib.sha256(back.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], schema=schema)
        del encoder, coder, decimal
        release()

    return df.select("doc_id", "text").mapInArrow(run, DIGEST)
