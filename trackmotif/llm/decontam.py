"""Benchmark decontamination with a generalised suffix automaton of the items' normalised words.

The automaton accepts every run of consecutive words of any item. A document's words are streamed through it while the
length of the longest run that ends at the current word is kept; where the length reaches the window (or a whole shorter
item ends), those words are hit. Only stretches of words whose every neighbouring pair some item may have are streamed.

Items are dealt to shards of about ``SHARD_BYTES`` of text, long ones in pieces that overlap by a window less one word, and
a task compiles each shard to flat arrays in a file of the shared folder. The files go to every node once and are
memory-mapped there, so that a node's workers share them and none holds states of its own. Automata of more than
``SENT_BYTES`` stay in the shared folder, and a task reads those that its texts need, ``HELD`` at a time.

Documents are read once. Hashes of all windows and short items, each with the shards that have it, are dealt by their first
bits to files called doors. A text's runs of words are looked up there, each in one door, and the text goes through the
automata of the shards found, which know words and not only hashes. So a text without a hit costs the same with any number
of shards, and no hit is lost, as equal words have equal hashes.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmotif.llm import storage
from trackmotif.llm.memory import release
from trackmotif.llm.words import BASE, Words, lettered, mix
from trackmotif.session import materialise, scratch_dir, ship_package

WINDOW, SHARD_BYTES, PIECE_WORDS = 10, 1 << 20, 20_000
#: A document of which more than this share of words is hit is dropped whole by ``decontaminate``.
MAX_COVERAGE = 0.8
#: Bytes of automata that are sent to all nodes, and of doors, beyond which a benchmark is refused (about 1.5 GB of text).
SENT_BYTES, DOORS_BYTES = 2 << 30, 4 << 30
#: Rows of a door, and automata that a task holds when they are not sent.
DOOR_ROWS, HELD = 1 << 22, 8
#: Bits of the table of pairs of neighbouring words.
PAIR_BITS = 21

# The words of words.lettered(), in a text.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _pairs(h: np.ndarray) -> np.ndarray:
    return (mix(h[:-1] * BASE + h[1:]) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def _table(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where each ends, and all of them joined."""
    return np.cumsum([len(r) for r in rows], dtype=np.int64), np.frombuffer(b"".join(rows), np.uint8)


class _Builder:
    """States of the items so far; a state's transitions are a dict until they are laid out as arrays."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, ids: list[int]) -> None:
        last = 0
        for t in ids:
            last = self._extend(last, t)

    def _clone(self, p: int, q: int, t: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, t: int) -> int:
        q = self.next[last].get(t)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, t)
        new, p = len(self.next), last
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        while p >= 0 and t not in self.next[p]:
            self.next[p][t] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][t]
            target = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, t)
            self.link[new] = target
        return new


class Automaton:
    """Of items; ``window`` consecutive words of an item, or all of a shorter one, make a hit. All of it is flat arrays."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts
        self.window, self.shortest = parts["limits"].tolist()
        view = lambda name: memoryview(np.ascontiguousarray(parts[name]))
        self.start, self.label, self.target, self.link, self.length, self.near = map(view, ("start", "label", "target", "link", "length", "near"))

    @staticmethod
    def compile(items: Iterable[tuple[str, str]], window: int = WINDOW) -> Automaton:
        """From (name, text)."""
        vocabulary: dict[bytes, int] = {}
        names: dict[str, int] = {}
        rows, built = [], _Builder()
        for name, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in lettered(text).list()]
            if ids:
                rows.append((names.setdefault(name, len(names)), ids))
                built.add(ids)
        # Words are numbered by their hashes' order.
        words = list(vocabulary)
        h = lettered(b" ".join(words).decode()).hashes
        order = np.argsort(h, kind="stable")
        number = np.empty(len(words), np.int64)
        number[order] = np.arange(len(words))
        lookup = number.tolist()
        start, label, target = [0], [], []
        for edges in built.next:
            for t, to in sorted((lookup[t], to) for t, to in edges.items()):
                label.append(t)
                target.append(to)
            start.append(len(label))
        seen = np.zeros(1 << PAIR_BITS, np.uint8)
        for _, ids in rows:
            seen[_pairs(h[ids])] = 1
        whole: dict[int, list[tuple[int, int]]] = {}
        windows: dict[int, set[int]] = {}
        plain = np.int32
        parts = {
            "limits": np.array([window, min([window, *(len(ids) for _, ids in rows)])], np.int64),
            "hash": h[order], "start": np.array(start, plain), "label": np.array(label, plain), "target": np.array(target, plain),
            "link": np.array(built.link, plain), "length": np.array(built.length, plain), "near": np.zeros(len(built.next), plain), "pairs": seen,
        }
        parts["word_ends"], parts["word_bytes"] = _table([words[k] for k in order])
        parts["name_ends"], parts["name_bytes"] = _table([n.encode() for n in names])
        found = Automaton(parts)
        for name, ids in rows:
            ids = [lookup[t] for t in ids]
            if len(ids) < window:
                *_, (_, state, _) = found.stream(ids)
                whole.setdefault(state, []).append((len(ids), name))
            else:
                for _, state, length in found.stream(ids):
                    if length >= window:
                        windows.setdefault(found.of_window(state), set()).add(name)
        # The nearest state on the way of suffix links, itself included, in which short items end; 0 if none.
        near = [0] * len(built.next)
        if whole:
            for v in sorted(range(1, len(near)), key=built.length.__getitem__):
                near[v] = v if v in whole else near[built.link[v]]
        parts["near"] = np.array(near, plain)
        for kind, rows_of in (("whole", {k: sorted(v) for k, v in whole.items()}), ("window", {k: [(0, n) for n in sorted(v)] for k, v in windows.items()})):
            states = sorted(rows_of)
            parts[f"{kind}_state"] = np.array(states, plain)
            parts[f"{kind}_start"] = np.cumsum([0, *(len(rows_of[s]) for s in states)], dtype=np.int64)
            parts[f"{kind}_size"] = np.array([n for s in states for n, _ in rows_of[s]], plain)
            parts[f"{kind}_name"] = np.array([k for s in states for _, k in rows_of[s]], plain)
        return Automaton(parts)

    def of_window(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _rows(self, kind: str, state: int) -> Iterator[tuple[int, int]]:
        k = int(np.searchsorted(self.parts[f"{kind}_state"], state))
        a, b = self.parts[f"{kind}_start"][k : k + 2].tolist()
        return zip(self.parts[f"{kind}_size"][a:b].tolist(), self.parts[f"{kind}_name"][a:b].tolist(), strict=True)

    def name(self, k: int) -> str:
        ends = self.parts["name_ends"]
        return self.parts["name_bytes"][int(ends[k - 1]) if k else 0 : int(ends[k])].tobytes().decode()

    def ids(self, words: Words, a: int, b: int) -> list[int]:
        """Number of each of the words [a, b), -1 for those that no item has: found by hash, then compared."""
        own, ends, text = self.parts["hash"], self.parts["word_ends"], self.parts["word_bytes"]
        h = words.hashes[a:b]
        at = np.minimum(np.searchsorted(own, h), len(own) - 1)
        out = np.where(own[at] == h, at, -1).tolist()
        for k, i in enumerate(out):
            if i >= 0 and text[int(ends[i - 1]) if i else 0 : int(ends[i])].tobytes() != words.word(a + k):
                out[k] = -1
        return out

    def stream(self, ids: Iterable[int]) -> Iterator[tuple[int, int, int]]:
        """Position, state, and length of the longest run of an item that ends there."""
        start, label, target, link, sizes = self.start, self.label, self.target, self.link, self.length
        state = length = 0
        for k, t in enumerate(ids):
            while True:
                high = start[state + 1]
                j = bisect_left(label, t, start[state], high)
                if j < high and label[j] == t:
                    state, length = target[j], length + 1
                    break
                if state == 0:
                    length = 0
                    break
                state = link[state]
                length = sizes[state]
            yield k, state, length

    def _stretches(self, words: Words) -> list[tuple[int, int]]:
        """[first, last + 1) word numbers of all stretches that can hold a hit."""
        if self.shortest < 2:
            ok, more = np.array(self.ids(words, 0, len(words))) >= 0, 0
        else:
            ok, more = self.parts["pairs"][_pairs(words.hashes)] > 0, 1
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]]))).reshape(-1, 2)
        return [(a, b + more) for a, b in edges.tolist() if b + more - a >= self.shortest]

    def match(self, words: Words) -> tuple[list[tuple[int, int]], set[str]]:
        """[first, last + 1) word numbers of hit spans, ascending and apart, and the items whose windows occur."""
        spans: list[list[int]] = []
        states, items = set(), set()
        if len(words) < self.shortest or not len(self.parts["hash"]):
            return [], set()
        for a, b in self._stretches(words):
            for k, state, length in self.stream(self.ids(words, a, b)):
                reach = 0
                if length >= self.window:
                    reach = self.window
                    states.add(self.of_window(state))
                v = self.near[state]
                while v:
                    for size, name in self._rows("whole", v):
                        if size <= length:
                            reach = max(reach, size)
                            items.add(name)
                    v = self.near[self.link[v]]
                if reach:
                    first, last = a + k + 1 - reach, a + k + 1
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append([first, last])
        for s in states:
            items.update(name for _, name in self._rows("window", s))
        return [(x, y) for x, y in spans], {self.name(k) for k in items}


def _pieces(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Items as pieces of at most ``PIECE_WORDS`` words, which overlap so that every window is in one of them."""
    for batch in batches:
        names, texts = [], []
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = lettered(text).list()
            for k in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
                names.append(name)
                texts.append(b" ".join(words[k : k + PIECE_WORDS + window - 1]).decode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["name", "text"])


def _runs(h: np.ndarray, sizes: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Each of the sizes that ``h``, hashes of consecutive words, has runs of, and the hashes of all these runs."""
    run = h
    for size in range(1, min(max(sizes, default=0), len(h)) + 1):
        if size > 1:
            run = run[:-1] * BASE + h[size - 1 :]
        if size in sizes:
            yield size, mix(run + np.uint64(size))


def _door_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """size, hash, shard of the windows of each piece (text, shard), or of all of a shorter one."""
    for batch in batches:
        found = [(size, np.unique(runs), shard) for text, shard in zip(batch.column(0), batch.column(1).to_pylist(), strict=True) for h in [lettered(text.as_py()).hashes] for size, runs in _runs(h, {min(window, len(h))})]
        counts = [len(h) for _, h, _ in found]
        each = lambda k: pa.array(np.repeat(np.array([x[k] for x in found], np.int32), counts))  # noqa: B023, E731
        own = np.concatenate([np.zeros(0, np.uint64), *(h for _, h, _ in found)]).view(np.int64)
        yield pa.RecordBatch.from_arrays([each(0), pa.array(own), each(2)], names=["size", "hash", "shard"])


@dataclass
class Shards:
    """Where the automata and doors of a benchmark are; a hash's door is given by its first ``bits`` bits."""

    automata: dict[int, str]
    sent: bool
    doors: dict[int, str]
    bits: int
    sizes: set[int]


def compile_shards(items: DataFrame, window: int = WINDOW, item_id: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES) -> Shards:
    """Automata and doors of all items: a task compiles a shard, or sorts a door, and writes it to the shared folder.

    Items with a null id or text are left out. Only the files' names and sizes reach the driver.
    """
    spark = items.sparkSession
    ship_package(spark)
    rows = items.select(F.col(item_id).cast("string").alias("name"), F.col(item_text).alias("text")).where("name is not null and text is not null")
    pieces = materialise(rows.mapInArrow(lambda b: _pieces(b, window), "name string, text string").distinct(), "items")
    count = max(1, math.ceil((pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / shard_bytes))
    folder = scratch_dir(spark, "automata")
    stem = f"{folder}/{hashlib.md5(folder.encode()).hexdigest()}"

    def written(path: str, parts: dict[str, np.ndarray], number: int) -> pa.Table:
        with storage.create(path) as out:
            storage.pack(parts, out)
        size = sum(x.nbytes for x in parts.values())
        parts.clear()
        release()
        return pa.table({"number": pa.array([number], pa.int64()), "path": [path], "bytes": pa.array([size], pa.int64())})

    def build(part: pa.Table) -> pa.Table:
        k = part["shard"][0].as_py()
        found = Automaton.compile(sorted(zip(part["name"].to_pylist(), part["text"].to_pylist(), strict=True)), window)
        return written(f"{stem}-{k}.sam", found.parts, k)

    def door(part: pa.Table) -> pa.Table:
        k = part["door"][0].as_py()
        h, shard = part["hash"].to_numpy().view(np.uint64), part["shard"].to_numpy()
        order = np.lexsort((shard, h))
        own, start = np.unique(h[order], return_index=True)
        return written(f"{stem}-{k}.door", {"hash": own, "start": np.append(start, len(h)).astype(np.int64), "shard": shard[order]}, k)

    files = "number long, path string, bytes long"
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("name", "text"), F.lit(count)).cast("int"))
    automata = dealt.groupBy("shard").applyInArrow(build, files).collect()
    entries = materialise(dealt.select("text", "shard").mapInArrow(lambda b: _door_rows(b, window), "size int, hash long, shard int").distinct(), "doors")
    sizes = {r["size"]: r["count"] for r in entries.groupBy("size").count().collect()}
    bits = max(0, math.ceil(math.log2(max(1, sum(sizes.values())) / DOOR_ROWS)))
    first = F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("long")
    doors = entries.select(first.alias("door"), "hash", "shard").distinct().groupBy("door").applyInArrow(door, files).collect()
    if sum(r.bytes for r in doors) > DOORS_BYTES:
        raise ValueError("the benchmark is too large: take it in parts")
    sent = sum(r.bytes for r in automata) <= SENT_BYTES
    for r in [*doors, *(automata if sent else [])]:
        spark.sparkContext.addFile(r.path)
    name = lambda path: path.rpartition("/")[2]
    return Shards({r.number: name(r.path) if sent else r.path for r in automata}, sent, {r.number: name(r.path) for r in doors}, bits, set(sizes))


class Search:
    """A benchmark's doors on a node, and the automata that texts have needed."""

    def __init__(self, shards: Shards):
        self.shards = shards
        self.doors = {k: storage.mapped(SparkFiles.get(name)) for k, name in shards.doors.items()}
        self.automata: dict[int, Automaton] = {}

    def _behind(self, door: int, h: np.ndarray) -> set[int]:
        if door not in self.doors:
            return set()
        own, start, shard = (self.doors[door][x] for x in ("hash", "start", "shard"))
        at = np.searchsorted(own, h)
        hits = np.unique(at[own[np.minimum(at, len(own) - 1)] == h])
        return {k for i in hits.tolist() for k in shard[int(start[i]) : int(start[i + 1])].tolist()}

    def shards_of(self, words: Words) -> list[int]:
        """Numbers of the shards that have some run of the words as a window or a short item."""
        found: set[int] = set()
        for _, h in _runs(words.hashes, self.shards.sizes):
            if self.shards.bits:
                door = (h >> np.uint64(64 - self.shards.bits)).astype(np.int64)
                for d in np.unique(door).tolist():
                    found |= self._behind(d, h[door == d])
            else:
                found |= self._behind(0, h)
        return sorted(found)

    def automaton(self, k: int) -> Automaton:
        if k not in self.automata:
            if not self.shards.sent and len(self.automata) >= HELD:
                del self.automata[next(iter(self.automata))]
            where = self.shards.automata[k]
            self.automata[k] = Automaton(storage.mapped(SparkFiles.get(where)) if self.shards.sent else storage.loaded(where))
        return self.automata[k]

    def __call__(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, hit spans as word numbers, and names of the items found, sorted."""
        words = lettered(text)
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for k in self.shards_of(words):
            more, found = self.automaton(k).match(words)
            spans += more
            items |= found
        return len(words), merged(spans), sorted(items)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of any order as ascending ones that don't touch."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def covered(spans: list[tuple[int, int]]) -> int:
    return sum(b - a for a, b in spans)


DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def contamination(df: DataFrame, items: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """For every row: words, hit words, items whose windows occur, sha256 of their sorted names, and whether any is hit.

    Null text has no words; items with a null id or text are left out, and rows with one item id are one item; an empty
    benchmark hits nothing. Other columns are left out; repeated rows give repeated rows.
    """
    shards = compile_shards(items, window, shard_bytes=shard_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(shards)
        for batch in batches:
            rows = [search(t.as_py()) for t in batch.column(1)]
            hit = [covered(s) for _, s, _ in rows]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0).cast(pa.int64()), "n_words": pa.array([n for n, _, _ in rows], pa.int64()), "n_hit": pa.array(hit, pa.int64()),
                "n_items": pa.array([len(x) for _, _, x in rows], pa.int64()), "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for _, _, x in rows], pa.string()),
                "contaminated": pa.array([n > 0 for n in hit], pa.bool_()),
            })
        del search
        release()

    return df.select("doc_id", "text").mapInArrow(run, DIGEST)


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without those words and what stands between words of a span."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def decontaminate(df: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, text_column: str = "text") -> DataFrame:
    """``df`` without the hit spans of its texts, and without rows of which more than ``max_coverage`` of words is hit.

    All other columns and all rows without a hit stay as they are, null texts too. What a cut brings together is not
    searched again.
    """
    shards = compile_shards(items, window)
    at = df.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(shards)
        for batch in batches:
            texts, kept = [], []
            for value in batch.column(at):
                text = value.as_py()
                n, spans, _ = search(text)
                texts.append(without_spans(text, spans) if spans else text)
                kept.append(covered(spans) <= max_coverage * n)
            out = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield out if all(kept) else out.filter(pa.array(kept))
        del search
        release()

    return df.mapInArrow(run, df.schema)
