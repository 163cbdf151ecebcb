"""Row numbers by a range sort that is written once; order statistics and quantiles by counting, without a sort.

A selection first takes approximate percentiles just below and above each wanted rank, in one aggregate. A second counts
the rows between and within these bounds, and within them how often each value occurs: the ranks are then known exactly.
Bounds with too many rows to gather are narrowed in the same way, by a factor of thousands each time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmotif.session import materialise

_ROW = "_row"
#: Of approximate percentiles; and values that a selection gathers at most.
ACCURACY, HELD = 10_000, 200_000


def in_order(rows: DataFrame, *order: str | Column) -> tuple[DataFrame, DataFrame]:
    """``rows`` sorted and written once, with ``_row`` (partition << 33 | place in it), and (part, before, n) a partition.

    The sort's ranges also split equal keys, by a random second key, so that a frequent value isn't one task's.
    """
    name = _ROW
    if name in rows.columns:
        raise ValueError(f"a column is named {name}")
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = rows.withColumn("_tie", F.rand(17)).repartitionByRange(*keys, F.col("_tie")).sortWithinPartitions(*keys, "_tie").drop("_tie")
    written = materialise(dealt.withColumn(name, F.monotonically_increasing_id()), "in-order")
    counts = written.groupBy(F.shiftright(name, 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    parts, before = [], 0
    for r in counts:
        parts.append((r.part, before, r.n))
        before += r.n
    return written, rows.sparkSession.createDataFrame(parts, "part long, before long, n long")


def numbered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """``rows`` with row_idx from 0 by ``order`` (rows that tie, in any order)."""
    written, parts = in_order(rows, *order)
    joined = written.join(F.broadcast(parts.drop("n")), F.shiftright(_ROW, 33) == F.col("part"))
    return joined.withColumn("row_idx", F.col("before") + F.col(_ROW).bitwiseAND(F.lit((1 << 33) - 1))).drop(_ROW, "part", "before")


class _Bounds:
    """Disjoint closed intervals; a value's code is 2k between the k-th and the next, 2k + 1 within the next."""

    def __init__(self, parts: list[tuple]):
        self.parts: list[list] = []
        for low, high in sorted(parts):
            if self.parts and low <= self.parts[-1][1]:
                self.parts[-1][1] = max(high, self.parts[-1][1])
            else:
                self.parts.append([low, high])

    def code(self, v: Column) -> Column:
        return sum(((v >= F.lit(low)).cast("int") + (v > F.lit(high)).cast("int") for low, high in self.parts), F.lit(0))


def _by_key(bounds: dict, key: Column | None, of) -> Column:
    """``of`` the bounds of each row's key; null where a key has none."""
    if key is None:
        return of(bounds[None]) if None in bounds else F.lit(None).cast("int")
    out = F.lit(None).cast("int")
    for k, b in bounds.items():
        out = F.when(key.eqNullSafe(F.lit(k)), of(b)).otherwise(out)
    return out


def _selected(rows: DataFrame, value: str, levels: list[float] | None, wanted, by: str | None) -> tuple[dict, dict]:
    """{key: {rank: value}} and {key: number of rows}; ``levels`` are about where the ranks ``wanted(key, n)`` are, if known."""
    v, key = F.col(value), F.col(by) if by else None
    keys = [key.alias("key")] if by else []
    named = lambda r: r["key"] if by else None
    around = lambda ls: sorted({min(max(x + d / ACCURACY, 0.0), 1.0) for x in ls for d in (-2, 2)})
    total = F.count("*").alias("n")
    if levels is None:
        sizes = {named(r): r.n for r in rows.groupBy(*keys).agg(total).collect()}
        levels = sorted({r / max(n - 1, 1) for k, n in sizes.items() for r in wanted(k, n)})
    grid = around(levels)
    near = {named(r): r for r in rows.groupBy(*keys).agg(total, *([F.percentile_approx(v, grid, ACCURACY).alias("q")] if grid else []), F.min(v).alias("low"), F.max(v).alias("high")).collect()}
    sizes = {k: r.n for k, r in near.items() if r.n}
    found: dict = {k: {} for k in sizes}
    open_: dict = {k: sorted({x for x in wanted(k, n) if 0 <= x < n}) for k, n in sizes.items()}
    bounds: dict = {}
    for k, ranks in open_.items():
        r, n = near[k], sizes[k]
        ends = lambda x: (max((q for g, q in zip(grid, r.q) if g <= x - 1 / ACCURACY), default=r.low), min((q for g, q in zip(grid, r.q) if g >= x + 1 / ACCURACY), default=r.high))  # noqa: B023, B905, E731
        if ranks:
            bounds[k] = _Bounds([ends(x / max(n - 1, 1)) for x in ranks])
    hold = sum(4 * len(b.parts) * sizes[k] / ACCURACY for k, b in bounds.items()) <= HELD
    while bounds:
        code = _by_key(bounds, key, lambda b: b.code(v))
        kept = rows.select(*keys, v.alias("v"), code.alias("code")).where("code is not null")
        groups = ["key"] * bool(by) + ["code"]
        tally = kept.groupBy(*groups, F.when(F.col("code") % 2 == 1, F.col("v")).alias("x") if hold else F.lit(None).alias("x"))
        lines: dict = {}
        for r in tally.agg(total, F.min("v").alias("low"), F.max("v").alias("high")).collect():
            lines.setdefault(named(r), []).append((r.code, r.low, r.high, r.n))
        again: dict = {}
        for k, counted in lines.items():
            counted.sort()
            at, before = 0, 0
            for rank in open_[k]:
                while before + counted[at][3] <= rank:
                    before += counted[at][3]
                    at += 1
                _, low, high, n = counted[at]
                if low == high:
                    found[k][rank] = low
                else:
                    again.setdefault(k, {}).setdefault((low, high), []).append((rank, before, n))
        open_ = {k: [rank for spans in parts.values() for rank, _, _ in spans] for k, parts in again.items()}
        for ranks in open_.values():
            ranks.sort()
        bounds = {k: _Bounds(list(parts)) for k, parts in again.items()}
        hold = sum(spans[0][2] for parts in again.values() for spans in parts.values()) <= HELD
        if bounds and not hold:  # narrow each span by percentiles of what it holds
            code = _by_key(bounds, key, lambda b: b.code(v))
            spread = {k: around([(rank - before) / max(n - 1, 1) for spans in parts.values() for rank, before, n in spans]) for k, parts in again.items()}
            every = sorted({x for xs in spread.values() for x in xs})
            within = rows.select(*keys, v.alias("v"), code.alias("code")).where("code % 2 = 1")
            narrow: dict = {}
            for r in within.groupBy(*["key"] * bool(by), "code").agg(F.percentile_approx("v", every, ACCURACY).alias("q"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
                narrow[named(r), r.code] = r
            for k, parts in again.items():
                cut = []
                for place, (span, ranks) in enumerate(sorted(parts.items())):
                    r = narrow[k, 2 * place + 1]
                    for rank, before, n in ranks:
                        x = (rank - before) / max(n - 1, 1)
                        cut.append((max((q for g, q in zip(every, r.q, strict=True) if g <= x - 1 / ACCURACY), default=span[0]), min((q for g, q in zip(every, r.q, strict=True) if g >= x + 1 / ACCURACY), default=span[1])))
                bounds[k] = _Bounds(cut)
    return found, sizes


def _between(a: float, b: float, share: float) -> float:
    """Between two values, from the nearer one."""
    return a + (b - a) * share if share < 0.5 else b - (b - a) * (1 - share)


def at_ranks(rows: DataFrame, value: str, wanted: dict[object, list[int] | object], by: str | None = None, levels: list[float] | None = None) -> dict:
    """{key: {rank: value}} of the ranks (from 0) that ``wanted`` gives for each key of ``by``, or for the key None.

    ``wanted`` may also be a function of (key, number of rows) to ranks; ``levels`` tells about where they are, as shares
    of the rows, and saves a count. Nulls must be out, and keys are few. At most ``HELD`` values are gathered at a time.
    """
    ask = wanted if callable(wanted) else lambda key, _: wanted.get(key, [])
    return _selected(rows, value, levels, ask, by)[0]


def quantiles(rows: DataFrame, value: str, levels: list[float], by: str | None = None) -> dict:
    """{key: (n, [quantile of each level])}, linear between the two nearest values, exact; nulls are left out."""
    place = lambda n, q: (n - 1) * q
    wanted = lambda _, n: [f(place(n, q)) for q in levels for f in (math.floor, math.ceil)]
    kept = rows.where(F.col(value).isNotNull()).select(*([by] if by else []), value)
    found, sizes = _selected(kept, value, levels, wanted, by)
    out = {}
    for key, ranks in found.items():
        n = sizes[key]
        ends = [(place(n, q), ranks[math.floor(place(n, q))], ranks[math.ceil(place(n, q))]) for q in levels]
        out[key] = (n, [_between(a, b, p - math.floor(p)) for p, a, b in ends])
    return out
