"""Similar patterns merged, and patterns split into subpatterns, as Spark jobs of small tasks.

Merging goes by rounds. The driver holds each pattern's number and size, and a similarity and an AUROC of each pair of
patterns that may merge; all else is tables. A round scores only the pairs that no round before it has scored: means of
patterns come from one aggregate, a task aligns two of them, and another compares bounded draws of seqlets of a block of
patterns with those of another block where they align. Merges that depend on each other follow one another, all others run
side by side, each a task with the seqlets of two patterns and the tracks of their examples.

Subpatterns come from all pairs of a pattern's seqlets, in blocks: a task compares two blocks and passes on each seqlet's
nearest, which are the edges of a graph whose communities are the subpatterns.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmotif.operators import graph, kernels, patterns, seqlets
from trackmotif.operators.kernels import Pattern, Settings, Tracks, centred, features
from trackmotif.plans.discover import RESULT, folded, seqlets_of, tensors
from trackmotif.session import materialise

COORDINATES = ("example_idx", "start", "end", "is_revcomp")
MEMBERS = pa.schema([("number", pa.int64()), ("ord", pa.int64()), ("example_idx", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("is_revcomp", pa.bool_())])
MEMBERS_DDL = "number long, ord long, example_idx long, start long, end long, is_revcomp boolean"
#: Seqlets of a block of all pairs; drawn seqlets of a block of patterns.
BLOCK, DRAWN = 512, 2_000
#: Scored pairs that the driver takes up at once.
PASSED = 10_000
#: (number, seqlets) of a pattern, as the driver has it.
Sizes = list[tuple[int, int]]


def _rows_of(number: int, found: list) -> pa.Table:
    rows = [(number, n, *x) for n, x in enumerate(found)]
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(MEMBERS)], schema=MEMBERS)


def sizes_of(members: DataFrame) -> dict[int, int]:
    return {r.number: r.n for r in members.groupBy("number").agg(F.count("*").alias("n")).collect()}


def drawn(members: DataFrame, sizes: dict[int, int], cap: int) -> DataFrame:
    """All members of a pattern, or ``cap`` of them at random; a task draws from one pattern's coordinates."""
    large = [k for k, n in sizes.items() if n > cap]

    def draw(part: pa.Table) -> pa.Table:
        part = part.sort_by("ord")
        return part.take(pa.array(kernels.drawn(list(range(part.num_rows)), cap)))

    chosen = members.where(F.col("number").isin(large)).groupBy("number").applyInArrow(draw, members.schema.simpleString()[7:-1])
    return members.where(~F.col("number").isin(large)).unionByName(chosen) if large else members


def flat_features(rows: DataFrame, tracks: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and flat: both tracks of each seqlet, each scaled to an absolute sum of 1, as one vector."""
    cut = seqlets.slices(rows, tracks, ("contrib", "hyp")).select(*keep, "contrib", "hyp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(c, h).ravel() for c, h in zip(tensors(batch.column("contrib")), tensors(batch.column("hyp")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.list_(pa.float64()))], names=[*keep, "flat"])

    return cut.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.select(*keep).schema) + ", flat array<double>")


def aligned_pairs(pairs: DataFrame, means: DataFrame) -> DataFrame:
    """a, b, place, turn, sim, length of a: where the mean contributions of b (number, contrib) lie best on those of a."""
    side = lambda c, m: means.select(F.col("number").alias(c), F.col("contrib").alias(m))
    both = pairs.join(side("a", "ma"), "a").join(side("b", "mb"), "b").select("a", "b", "ma", "mb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(tensors(batch.column("ma")), tensors(batch.column("mb")), strict=True):
                out.append((*kernels.align(features(a, None, centred), features(b, None, centred), features(b[::-1, ::-1], None, centred), "cosine"), len(a)))
            kinds = (pa.int64(), pa.bool_(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], names=["a", "b", "place", "turn", "sim", "length"])

    return both.mapInArrow(run, "a long, b long, place long, turn boolean, sim double, length long")


def blocks_of(sizes: dict[int, int], cap: int, most: int = DRAWN) -> dict[int, int]:
    """A block for each pattern, in order of their numbers: of at most ``most`` seqlets that are drawn, or one pattern."""
    out, block, filled = {}, 0, 0
    for number in sorted(sizes):
        n = min(sizes[number], cap)
        if filled and filled + n > most:
            block, filled = block + 1, 0
        out[number] = block
        filled += n
    return out


def told_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, auroc of rows by job, patterns (a and flats of their own) before those that lie on them (b, flats and all a
    that they lie on in this way). What a pattern has within itself is compared once a job."""
    own: dict[int, np.ndarray] = {}
    within: dict[int, np.ndarray] = {}
    now = None
    for batch in batches:
        job, side, number = (batch.column(c).to_numpy() for c in ("job", "side", "number"))
        for r in range(batch.num_rows):
            if job[r] != now:
                own, within, now = {}, {}, job[r]
            rows = batch.column("flats")[r].values
            flats = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            if side[r] == 0:
                own[int(number[r])] = flats
                continue
            on = batch.column("on")[r].values.to_numpy()
            there = [int(a) for a in on if int(a) in own]
            aurocs = dict.fromkeys((int(a) for a in on), 0.5)
            if there:
                stack, cuts = np.concatenate([own[a] for a in there]), np.cumsum([0, *(len(own[a]) for a in there)])
                sims = kernels.similarities(flats, stack) if len(flats) <= len(stack) else kernels.similarities(stack, flats).T
                for a, low, high in zip(there, cuts, cuts[1:], strict=False):
                    if a not in within:
                        within[a] = np.sort(kernels.similarities(own[a], own[a]), axis=None)
                    aurocs[a] = kernels.auroc_of_sorted(within[a], sims[:, low:high].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(list(aurocs), pa.int64()), pa.array([number[r]] * len(aurocs), pa.int64()), pa.array(list(aurocs.values()), pa.float64())], names=["a", "b", "auroc"])


def pair_scores(pairs: DataFrame, members: DataFrame, tracks: DataFrame, sizes: dict[int, int], s: Settings) -> DataFrame:
    """a, b, sim, auroc of the pairs (a, b) of patterns: similarity of b aligned on a by contributions, and how well
    similarities within a are told from those with b's seqlets, moved to where they align (0 and 0.5 if none can be).

    A pattern is moved once for all that it lies on in the same way, and patterns meet by blocks, so that no pair has rows
    of its own.
    """
    spark = pairs.sparkSession
    cut = seqlets.slices(members, tracks, ("contrib",))
    means = materialise(patterns.matrices(patterns.means(cut.select("number", "contrib"), "number", "contrib"), "number", "contrib"), "pattern-means")
    placed = materialise(aligned_pairs(pairs, means), "pattern-places")
    few = materialise(drawn(members, sizes, s.sub_sample), "pattern-draws")

    length = means.select("number", F.size("contrib").alias("length"))
    own = flat_features(few.join(length, "number").where(F.col("end") - F.col("start") == F.col("length")), tracks, "number")
    way = ("b", "place", "turn", "length")
    rc = F.col("is_revcomp") != F.col("turn")
    left, right = F.col("place"), F.col("length") - F.col("place") - (F.col("end") - F.col("start"))
    start, end = F.col("start") - F.when(rc, right).otherwise(left), F.col("end") + F.when(rc, left).otherwise(right)
    moved = placed.select(*way).distinct().join(few.withColumnRenamed("number", "b"), "b").select(*way, "example_idx", start.alias("start"), end.alias("end"), rc.alias("is_revcomp"))
    whole = tracks.select(F.size("one_hot").alias("n")).first()
    moved = moved.where(seqlets.inside("start", "end", F.lit(whole.n if whole else 0), strict=True) & (F.col("end") > F.col("start")))
    moved = flat_features(moved, tracks, *way)

    block = spark.createDataFrame(list(blocks_of(sizes, s.sub_sample).items()), "number long, block long")
    of = lambda c: F.broadcast(block.select(F.col("number").alias(c), F.col("block").alias(f"{c}_block")))
    met = placed.select("a", *way).join(of("a"), "a").join(of("b"), "b")
    jobs = [(r.a_block, r.b_block, n) for n, r in enumerate(met.select("a_block", "b_block").distinct().orderBy("a_block", "b_block").collect())]
    job = F.broadcast(spark.createDataFrame(jobs, "a_block long, b_block long, job int"))
    mine = own.groupBy("number").agg(F.collect_list("flat").alias("flats")).join(of("a"), F.col("number") == F.col("a")).join(job, "a_block")
    on = met.join(job, ["a_block", "b_block"]).groupBy("job", *way).agg(F.array_sort(F.collect_list("a")).alias("on"))
    theirs = moved.groupBy(*way).agg(F.collect_list("flat").alias("flats")).join(on, list(way))
    rows = mine.select("job", F.lit(0).alias("side"), "number", F.lit(None).cast("array<bigint>").alias("on"), "flats")
    rows = rows.unionByName(theirs.select("job", F.lit(1).alias("side"), F.col("b").alias("number"), "on", "flats"))
    dealt = rows.repartitionById(max(len(jobs), 1), "job").sortWithinPartitions("job", "side", "number")
    found = dealt.mapInArrow(told_apart, "a long, b long, auroc double")
    sim = F.when(F.col("auroc").isNull(), 0.0).otherwise(F.col("sim"))
    return placed.join(found, ["a", "b"], "left").select("a", "b", sim.alias("sim"), F.coalesce("auroc", F.lit(0.5)).alias("auroc"))


def merged_pairs(jobs: list[tuple[int, int, int]], members: DataFrame, tracks: DataFrame, background: np.ndarray, s: Settings) -> DataFrame:
    """Members of each new pattern of ``jobs`` (new, larger, smaller number); none where nothing is left of it."""
    roles = [(old, new, small) for new, a, b in jobs for old, small in ((a, False), (b, True))]
    rows = members.join(F.broadcast(members.sparkSession.createDataFrame(roles, "number long, new long, small boolean")), "number")

    def fold(part: pa.Table, held: Tracks) -> pa.Table:
        part = part.sort_by("ord")
        small = part["small"].to_numpy().astype(bool)
        large, rest = (seqlets_of(part.filter(pa.array(x))) for x in (~small, small))
        p = kernels.polished(kernels.merged_in(Pattern(held, large), rest, "cosine", False, centred), s.share, s.least, s.initial_flank, s.trim, background)
        return _rows_of(part["new"][0].as_py(), [] if p is None else p.seqlets)

    return folded(rows, tracks, ["new"], fold, MEMBERS_DDL)


def _chains(pairs: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Pairs of places in order, parted so that pairs with a place in common, however far, are together."""
    of: dict[int, list] = {}
    for pair in pairs:
        mine = [of[k] for k in pair if k in of]
        joint = mine[0] if mine else []
        for other in mine[1:]:
            if other is not joint:
                joint += other
                for k in [k for k, c in of.items() if c is other]:
                    of[k] = joint
        joint.append(pair)
        for k in pair:
            of[k] = joint
    place = {pair: n for n, pair in enumerate(pairs)}
    return [sorted(c, key=place.get) for c in {id(c): c for c in of.values()}.values()]


class Collapse:
    """Patterns (number, ord and coordinates of their members) that collapse within scopes, and what is known of pairs."""

    def __init__(self, members: DataFrame, tracks: DataFrame, background: np.ndarray, s: Settings):
        self.members, self.tracks, self.background, self.s = members, tracks, background, s
        self.sizes = sizes_of(members)
        self.next = max(self.sizes, default=-1) + 1
        self.known: dict[tuple[int, int], tuple[float, float]] = {}
        self.history: list[tuple] = []  # (scope, level, number, children, seqlets)

    def _score(self, scopes: dict[object, Sizes]) -> None:
        first, second = array("q"), array("q")
        for found in scopes.values():
            for a, b in ((a, b) for a, _ in found for b, _ in found if a != b and (a, b) not in self.known):
                first.append(a)
                second.append(b)
        if first:
            pairs = self.members.sparkSession.createDataFrame(pa.table({"a": np.array(first), "b": np.array(second)}))
            numbers = sorted({*first, *second})
            sizes = {k: self.sizes[k] for k in numbers}
            scored = pair_scores(pairs, self.members.where(F.col("number").isin(numbers)), self.tracks, sizes, self.s).toArrow()
            for part in scored.to_batches(PASSED):
                a, b, sim, auroc = (part.column(c).to_pylist() for c in ("a", "b", "sim", "auroc"))
                self.known.update(zip(zip(a, b, strict=True), zip(sim, auroc, strict=True), strict=True))

    def _merges(self, found: Sizes) -> list[tuple[int, int]]:
        rows = []
        for i, (p, _) in enumerate(found):
            for j, (q, _) in enumerate(found[:i]):
                both = self.known[p, q], self.known[q, p]
                mixed = [2 * (1 - max(auroc, 0.5)) for _, auroc in both]
                rows.append((j, i, sum(x for x, _ in both) / 2, min(mixed), sum(mixed) / 2))
        return patterns.merges(sorted(rows), list(self.s.merge), list(self.s.veto))

    def _step(self, current: dict[object, list[int]], chains: list[tuple], level: int, done: list) -> bool:
        """The next merge of each chain that has one, all in one job."""
        jobs = []
        for scope, chain in chains:
            now = current[scope]
            while chain and now[chain[0][1][0]] == now[chain[0][1][1]]:
                chain.pop(0)
            if chain:
                order, (i, j) = chain.pop(0)
                p, q = now[i], now[j]
                small, large = sorted((p, q), key=self.sizes.get) if self.sizes[p] != self.sizes[q] else (q, p)
                jobs.append((scope, order, p, q, self.next, large, small))
                self.next += 1
        if not jobs:
            return False
        made = materialise(merged_pairs([job[4:] for job in jobs], self.members, self.tracks, self.background, self.s), "merged")
        sizes = sizes_of(made)
        gone = []
        for scope, order, p, q, new, _, _ in jobs:
            if new in sizes:
                current[scope] = [new if x in (p, q) else x for x in current[scope]]
                gone += [p, q]
                done.append((scope, level, order, new, sorted((p, q)), sizes[new]))
        self.sizes |= sizes
        if gone:
            self.members = materialise(self.members.where(~F.col("number").isin(gone)).unionByName(made), "members")
        return True

    def run(self, scopes: dict[object, list[int]]) -> dict[object, list[int]]:
        """Numbers of the patterns that are left in each scope, the largest first; merges until a round replaces none."""
        left: dict[object, list[int]] = {}
        active = {k: list(v) for k, v in scopes.items()}
        level = 0
        while active:
            level += 1
            found = {k: sorted(v, key=lambda x: -self.sizes[x]) for k, v in active.items()}
            self._score({k: [(x, self.sizes[x]) for x in v] for k, v in found.items()})
            current = {k: list(v) for k, v in found.items()}
            chains = []
            for k, v in found.items():
                pairs = self._merges([(x, self.sizes[x]) for x in v])
                order = {pair: n for n, pair in enumerate(pairs)}
                chains += [(k, [(order[pair], pair) for pair in c]) for c in _chains(pairs)]
            done: list[tuple] = []
            while self._step(current, chains, level, done):
                pass
            self.history += [(scope, at, new, children, n) for scope, at, _, new, children, n in sorted(done, key=lambda x: (str(x[0]), x[2]))]
            active = {}
            for k, v in current.items():
                if v == found[k]:
                    left[k] = v
                else:
                    active[k] = list(dict.fromkeys(v))
        return {k: left[k] for k in scopes}


def subclusters(members: DataFrame, tracks: DataFrame, perplexity: float, seeds: int, size: int = BLOCK) -> DataFrame:
    """number, ord, label of every member: its subpattern, 0 for the largest, by similarity without shifts.

    The three times ``perplexity`` nearest others of each are its edges; patterns of fewer than 3 members have one label.
    """
    rows = flat_features(members, tracks, "number", "ord").withColumn("block", F.expr(f"ord div {size}"))
    entry = F.array_sort(F.collect_list(F.struct("ord", "flat")))
    blocks = materialise(rows.groupBy("number", "block").agg(entry.alias("x")), "subcluster-blocks")
    n = members.groupBy("number").agg(F.count("*").alias("n")).where("n >= 3").select("number", F.least(F.col("n") - 1, F.lit(int(3 * perplexity + 1)).cast("long")).alias("k"))
    pairs = blocks.select("number", F.col("x").alias("xa")).join(blocks.select("number", F.col("x").alias("xb")), "number").join(F.broadcast(n), "number")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(x: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
            own = x.values.field("flat")
            return x.values.field("ord").to_numpy(), own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)

        for batch in batches:
            for r in range(batch.num_rows):
                (i, a), (j, b) = side(batch.column("xa")[r]), side(batch.column("xb")[r])
                sims = kernels.similarities(a, b)
                best = np.argsort(-sims, axis=1, kind="stable")[:, : batch.column("k")[r].as_py() + 1]
                columns = [np.full(best.size, batch.column("number")[r].as_py()), np.repeat(i, best.shape[1]), j[best].ravel(), np.take_along_axis(sims, best, 1).ravel()]
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in columns), pa.array(np.full(best.size, batch.column("k")[r].as_py()))], names=["number", "i", "j", "sim", "k"])

    near = pairs.select("number", "xa", "xb", "k").mapInArrow(nearest, "number long, i long, j long, sim double, k long")
    rank = F.row_number().over(Window.partitionBy("number", "i").orderBy(F.desc("sim"), "j"))
    # The first is the seqlet itself, or one just like it.
    near = near.withColumn("rank", rank).where((F.col("rank") > 1) & (F.col("rank") <= F.col("k") + 1))
    key = lambda c: F.struct("number", F.col(c).alias("ord")).alias(c)
    shares = graph.conditional(near.select(key("i"), key("j"), graph.distance("sim").alias("d")), perplexity)
    edges = shares.select(F.col("i.number").alias("number"), F.col("i.ord").alias("i"), F.col("j.ord").alias("j"), F.col("p").alias("w"))
    found = graph.communities(edges, "number", seeds).select("number", F.col("id").alias("ord"), "label")
    return members.select("number", "ord").join(found, ["number", "ord"], "left").select("number", "ord", F.coalesce("label", F.lit(0)).cast("int").alias("label"))


def _renumbered(members: DataFrame, numbers: DataFrame, *on: str) -> DataFrame:
    """Members with the numbers that ``numbers`` (on, to) gives, and places from 0 in their order."""
    rows = members.join(F.broadcast(numbers), list(on)).drop("number")
    place = F.row_number().over(Window.partitionBy("to").orderBy("ord")) - 1
    return rows.withColumn("place", place.cast("long")).select(F.col("to").alias("number"), F.col("place").alias("ord"), *COORDINATES)


def finished(clusters: DataFrame, tracks: DataFrame, background: np.ndarray, s: Settings) -> DataFrame:
    """Members of the final patterns of each sign from those of clusters (sign, cluster, ord and coordinates): large ones
    are split by subclusters, the parts and then all of a sign merged, too small or too plain ones dropped, and subpatterns
    labelled."""
    spark = clusters.sparkSession
    counts = clusters.groupBy("sign", "cluster").agg(F.count("*").alias("n")).orderBy("sign", "cluster").collect()
    sign_of = {k: r.sign for k, r in enumerate(counts)}
    numbers = spark.createDataFrame([(r.sign, r.cluster, k) for k, r in enumerate(counts)], "sign string, cluster long, to long")
    members = materialise(_renumbered(clusters.withColumn("number", F.lit(0)), numbers, "sign", "cluster"), "clusters")

    large = [k for k, r in enumerate(counts) if r.n > max(s.min_cluster, s.sub_perplexity)]
    parts: dict[int, list[int]] = {}
    if large:
        big = members.where(F.col("number").isin(large))
        labelled = materialise(big.join(subclusters(big, tracks, s.sub_perplexity, s.sub_seeds), ["number", "ord"]), "labels")
        split = [(r.number, r.label, len(counts) + k) for k, r in enumerate(labelled.select("number", "label").distinct().orderBy("number", "label").collect())]
        for number, _, to in split:
            parts.setdefault(number, []).append(to)
        renumbered = _renumbered(labelled, spark.createDataFrame(split, "number long, label int, to long"), "number", "label")
        members = materialise(members.where(~F.col("number").isin(large)).unionByName(renumbered), "parts")
    state = Collapse(members, tracks, background, s)
    left = state.run(parts)
    by_sign: dict[str, list[int]] = {}
    for k, sign in sign_of.items():
        by_sign.setdefault(sign, []).extend(left.get(k, [k]))
    left = state.run(by_sign)

    def keep(part: pa.Table, held: Tracks) -> pa.Table:
        part = part.sort_by("ord")
        p = Pattern(held, seqlets_of(part))
        ic = kernels.information(p.mean("one_hot"), background)
        best = ic.sum() if len(ic) < s.ic_window else np.convolve(ic, np.ones(s.ic_window), "valid").max()
        grown = p.filled(s.final_flank, s.final_flank) if len(p.seqlets) >= s.min_cluster and best >= s.min_ic else None
        return _rows_of(part["number"][0].as_py(), [] if grown is None else grown.seqlets)

    kept = materialise(folded(state.members, tracks, ["number"], keep, MEMBERS_DDL), "kept")
    there = sizes_of(kept)
    order = [(sign, k, number) for sign, found in left.items() for k, number in enumerate(x for x in found if x in there)]
    names = F.broadcast(spark.createDataFrame(order, "sign string, pattern_idx int, number long"))
    labels = subclusters(kept, tracks, s.sub_perplexity, s.sub_seeds).withColumnRenamed("label", "subcluster")
    return kept.join(labels, ["number", "ord"]).join(names, "number").select(*RESULT.names)
