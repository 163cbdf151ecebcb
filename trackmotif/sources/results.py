"""Results as Parquet: members of patterns, matrices of patterns and of their subpatterns, and the window size; exports to
MEME, BED, FASTA, tables of matches, and HTML reports with SVG logos."""

from __future__ import annotations

import html

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmotif.functions import vec
from trackmotif.operators import descriptive, kernels, matching, seqlets
from trackmotif.plans.discover import summarised, with_contributions
from trackmotif.session import materialise
from trackmotif.sources import text
from trackmotif.sources.files import create, write_lines

#: Matrices that a motif export can hold.
KINDS = ("PFM", "CWM", "hCWM", "CWM-PFM", "hCWM-PFM")


def save(members: DataFrame, tracks: DataFrame, path: str, window: int) -> None:
    members.write.partitionBy("sign").parquet(f"{path}/seqlets")
    summarised(members, tracks).write.partitionBy("sign").parquet(f"{path}/patterns")
    summarised(members, tracks, "subcluster").write.partitionBy("sign").parquet(f"{path}/subpatterns")
    members.sparkSession.createDataFrame([(window,)], "window_size int").write.parquet(f"{path}/meta")


def patterns(spark: SparkSession, path: str, by_name: bool = False) -> DataFrame:
    """Patterns with their name, ordered by number or, as text exports have them, by name."""
    rows = spark.read.parquet(f"{path}/patterns").withColumn("name", F.concat(F.lit("pattern_"), "pattern_idx"))
    return rows.orderBy("sign", "name") if by_name else rows.orderBy("sign", "pattern_idx")


def subpatterns(spark: SparkSession, path: str) -> DataFrame:
    """Subpatterns of each pattern, the largest first (ties: by subcluster), named by that order."""
    rank = F.row_number().over(Window.partitionBy("sign", "pattern_idx").orderBy(F.desc("n_seqlets"), "subcluster")) - 1
    rows = spark.read.parquet(f"{path}/subpatterns").withColumn("subpattern_idx", rank)
    return rows.withColumn("name", F.concat(F.lit("pattern_"), "pattern_idx", F.lit(".subpattern_"), "subpattern_idx"))


def tag() -> Column:
    """A pattern's name in exports and reports."""
    return F.concat("sign", F.lit("_patterns.pattern_"), "pattern_idx")


def members(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/seqlets")


def window_size(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/meta").first()["window_size"]


def motif(kind: str) -> Column:
    """The matrix of a kind: means as they are, by softmax, or (PFM) probabilities."""
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {', '.join(KINDS)}")
    source = F.col({"PFM": "ppm", "CWM": "cwm", "hCWM": "hcwm", "CWM-PFM": "cwm", "hCWM-PFM": "hcwm"}[kind])
    if kind == "PFM":
        return F.transform(source, lambda r: F.transform(r, lambda x: F.coalesce(F.try_divide(x, vec.total(r)), F.lit(0.0))))
    return F.transform(source, vec.softmax) if kind.endswith("-PFM") else source


def write_meme(spark: SparkSession, path: str, out: str, kind: str = "PFM") -> None:
    rows = patterns(spark, path, by_name=True).select(F.concat("sign", F.lit("_patterns."), "name").alias("name"), motif(kind).alias("pwm"))
    text.write_meme(rows, out)


def _placed(spark: SparkSession, path: str, peaks: str, chroms: list[str] | None, window: int | None) -> DataFrame:
    """Members with their place in the genome, and in exports: pos before neg, patterns by name, members as they stand. A
    member without a peak ends the job."""
    found = members(spark, path).withColumnsRenamed({"start": "s", "end": "e"})
    places = text.read_bed(spark, peaks, chroms).withColumnsRenamed({"start": "peak_start", "end": "peak_end"})
    start, end = text.genome_coordinates("s", "e", "peak_start", "peak_end", window or window_size(spark, path))
    joined = found.join(places, found.example_idx == places.row_idx, "left")
    none = F.raise_error(F.concat(F.lit("the peak file has no peak for example "), F.col("example_idx").cast("string")))
    name = F.concat(F.lit("pattern_"), "pattern_idx")
    return joined.select(
        "sign", (F.col("sign") != "pos").alias("late"), name.alias("name"), "pattern_idx", "ord", "example_idx", "s", "e", "is_revcomp", F.coalesce("chrom", none).alias("chrom"),
        start.alias("start"), end.alias("end"), "score", F.when(F.col("is_revcomp"), "-").otherwise("+").alias("strand"), F.concat(name, F.lit("."), "ord").alias("member"),
    )


def bed_lines(spark: SparkSession, path: str, peaks: str, chroms: list[str] | None = None, window: int | None = None) -> DataFrame:
    """late, name, ord, line: one track a pattern, after a blank line but for the first."""
    rows = _placed(spark, path, peaks, chroms, window)
    c = lambda n: F.col(n).cast("string")
    line = text.bed_line(c("chrom"), c("start"), c("end"), c("member"), c("score"), c("strand"))
    named = rows.select("late", "name").distinct()
    told = text.track_line(F.col("name"), description=F.concat(F.lit("Pattern '"), "name", F.lit("' on the positive strand.")))
    first = named.agg(F.min(F.struct("late", "name")).alias("first"))
    between = named.crossJoin(F.broadcast(first)).where(F.struct("late", "name") != F.col("first"))
    heads = named.select("late", "name", F.lit(-1).cast("long").alias("ord"), told.alias("line"))
    gaps = between.select("late", "name", F.lit(-2).cast("long").alias("ord"), F.lit("").alias("line"))
    return rows.select("late", "name", "ord", line.alias("line")).unionByName(heads).unionByName(gaps)


def write_bed(spark: SparkSession, path: str, peaks: str, out: str, chroms: list[str] | None = None, window: int | None = None, parts: bool = False) -> None:
    """One track a pattern: pos first, patterns by name, members named pattern_k.n in their order (see ``write_lines``)."""
    write_lines(bed_lines(spark, path, peaks, chroms, window), out, "late", "name", "ord", parts=parts)


def write_fasta(spark: SparkSession, path: str, peaks: str, tracks: DataFrame, out: str, chroms: list[str] | None = None, window: int | None = None, parts: bool = False) -> None:
    """The bases of every seqlet, read on its strand, in the order of ``write_bed``."""
    rows = _placed(spark, path, peaks, chroms, window)
    cut = seqlets.slices(rows.select("late", "name", "ord", "member", "chrom", F.col("start").alias("g"), F.col("end").alias("h"), "strand", "example_idx", F.col("s").alias("start"), F.col("e").alias("end"), "is_revcomp"), tracks, ("one_hot",))
    header = F.concat("chrom", F.lit(":"), "g", F.lit("-"), "h", F.lit(" dir="), "strand", F.lit(" "), "member")
    write_lines(cut.select("late", "name", "ord", text.fasta_entry(header, vec.sequence_of(F.col("one_hot"))).alias("line")), out, "late", "name", "ord", parts=parts)


def save_seqlets(spark: SparkSession, path: str, sign: str, pattern_idx: int, tracks: DataFrame, out: str, parts: bool = False) -> None:
    """The bases of one pattern's seqlets, each under its coordinates within the track."""
    rows = members(spark, path).where((F.col("sign") == sign) & (F.col("pattern_idx") == pattern_idx))
    cut = seqlets.slices(rows, tracks, ("one_hot",))
    header = F.format_string("example%d:%d-%d", "example_idx", "start", "end")
    write_lines(cut.select("ord", text.fasta_entry(header, vec.sequence_of(F.col("one_hot"))).alias("line")), out, "ord", parts=parts)


def legacy_strings(spark: SparkSession, path: str) -> DataFrame:
    """sign, pattern_idx, ord and each seqlet as the text that older results hold."""
    return members(spark, path).select("sign", "pattern_idx", "ord", seqlets.to_string("example_idx", "start", "end", "is_revcomp").alias("seqlet"))


def from_legacy(rows: DataFrame) -> DataFrame:
    """Members from such texts."""
    return rows.select("sign", "pattern_idx", "ord", *seqlets.from_string("seqlet"), F.lit(0).alias("subcluster"))


def logo(matrix: list[list[float]], height: int = 60, step: int = 14) -> str:
    """An SVG of stacked letters, scaled by magnitude; negative ones hang below the axis."""
    top = max([sum(x for x in r if x > 0) for r in matrix] + [-sum(x for x in r if x < 0) for r in matrix] + [1e-9])
    colours, parts = dict(zip(vec.BASES, ("#109648", "#255c99", "#f7b32b", "#d62839"), strict=True)), []
    for k, row in enumerate(matrix):
        up = down = height
        for base, x in sorted(zip(vec.BASES, row, strict=True), key=lambda v: abs(v[1])):
            size = abs(x) / top * height
            if size >= 0.5:
                y = up if x > 0 else down + size
                parts.append(f'<text transform="translate({k * step},{y:.2f}) scale(1,{size / 10:.3f})" font-size="14" font-family="monospace" fill="{colours[base]}">{base}</text>')
                up, down = (up - size, down) if x > 0 else (up, down + size)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{step * len(matrix)}" height="{2 * height}">{"".join(parts)}</svg>'


def histogram(rows: list, colour: str, width: int = 480, height: int = 120) -> str:
    """An SVG of bars from (low, high, density)."""
    if not rows:
        return ""
    low, high, top = min(r[0] for r in rows), max(r[1] for r in rows), max(r[2] for r in rows) or 1.0
    x = lambda v: (v - low) / (high - low) * width
    bars = "".join(f'<rect x="{x(a):.1f}" y="{height * (1 - d / top):.1f}" width="{x(b) - x(a):.1f}" height="{height * d / top:.1f}" fill="{colour}"/>' for a, b, d in rows)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height + 16}">{bars}<text x="0" y="{height + 14}" font-size="11">{low:.4g}</text><text x="{width}" y="{height + 14}" font-size="11" text-anchor="end">{high:.4g}</text></svg>'


def _page(title: str, body: str) -> str:
    return f"<!DOCTYPE html><meta charset=utf-8><title>{html.escape(title)}</title>{body}"


def _turned(matrix: list[list[float]]) -> list[list[float]]:
    return [r[::-1] for r in matrix[::-1]]


def _scaled(ppm: list[list[float]]) -> list[list[float]]:
    """Probabilities times the position's information against an even background."""
    ic = kernels.information(np.array(ppm, float), np.full(4, 0.25))
    return (np.array(ppm, float) * ic[:, None]).tolist()


def matched(spark: SparkSession, path: str, database: DataFrame, n: int = 3, share: float = 0.3, columns: str = "euclidean", most_e: float | None = None) -> DataFrame:
    """query (a pattern's tag), rank, target, p, e, score, offset, overlap, strand: the best motifs of ``database`` for each
    pattern's probabilities, trimmed by its contributions."""
    queries = patterns(spark, path).select(tag().alias("name"), matching.trimmed(F.col("ppm"), F.col("cwm"), share).alias("pwm"))
    return matching.matches(queries, database, n, columns=columns, most_e=most_e)


def write_matches(found: DataFrame, folder: str) -> None:
    """One table of tab-separated matches a pattern; patterns and their matches are few."""
    by: dict[str, list[str]] = {}
    columns = ("query", "target", "offset", "p", "e", "overlap", "strand")
    for r in found.orderBy("query", "rank").select(*columns).toLocalIterator():
        by.setdefault(r["query"], ["\t".join(columns)]).append("\t".join(map(str, r)))
    for name, lines in by.items():
        with create(f"{folder}/tomtom/{name}.tomtom.tsv") as f:
            f.write("\n".join(lines) + "\n")


def _match_cells(found: DataFrame, database: DataFrame, n: int) -> dict[str, list[str]]:
    """For each pattern the cells of its matches: name, p-value and logo; blank where there are fewer than ``n``."""
    named = found.join(database.dropDuplicates(["name"]), F.col("target") == F.col("name"), "left").orderBy("query", "rank")
    cells: dict[str, list[str]] = {}
    for r in named.select("query", "target", "p", "pwm").toLocalIterator():
        cells.setdefault(r["query"], []).append(f"<td>{html.escape(r['target'])}<td>{r['p']:.3g}<td>{logo(_scaled(r['pwm'])) if r['pwm'] else ''}")
    return {k: v + ["<td><td><td>"] * (n - len(v)) for k, v in cells.items()}


def report(spark: SparkSession, path: str, out: str, database: DataFrame | None = None, n: int = 3, share: float = 0.3, write_tomtom: str | None = None, columns: str = "euclidean", most_e: float | None = None) -> None:
    """An HTML table of the patterns (a driver's handful of rows): tag, seqlets, logos of the trimmed contributions on both
    strands, and with a ``database`` (name, pwm) the ``n`` best motifs, their p-values and logos. ``write_tomtom`` names a
    folder for the tables of matches."""
    cells: dict[str, list[str]] = {}
    if database is not None:
        found = materialise(matched(spark, path, database, n, share, columns, most_e), "matches")
        cells = _match_cells(found, database, n)
        if write_tomtom:
            write_matches(found, write_tomtom)
    rows = patterns(spark, path).select(tag().alias("tag"), "n_seqlets", matching.trimmed(F.col("cwm"), F.col("cwm"), share, 4, 4).alias("cut"))
    more = "".join(f"<th>match {k}<th>p-value<th>logo" for k in range(n)) if database is not None else ""
    lines = []
    for r in rows.toLocalIterator():
        own = "".join(cells.get(r.tag, ["<td><td><td>"] * n if database is not None else []))
        lines.append(f"<tr><td>{html.escape(r.tag)}<td>{r.n_seqlets}<td>{logo(r.cut)}<td>{logo(_turned(r.cut))}{own}</tr>")
    with create(out) as f:
        f.write(_page("Patterns", f"<table border=1><tr><th>pattern<th>seqlets<th>forward<th>reverse{more}</tr>{''.join(lines)}</table>"))


def described(spark: SparkSession, path: str, tracks: DataFrame) -> DataFrame:
    """Members with tag, importance and offset from the middle of where all seqlets lie."""
    rows = members(spark, path).withColumn("tag", tag())
    cut = seqlets.slices(rows, with_contributions(tracks), ("contrib",))
    return descriptive.placed(cut.withColumn("importance", descriptive.importance(F.col("contrib"))))


def descriptive_report(spark: SparkSession, path: str, tracks: DataFrame, out: str, database: DataFrame | None = None, n: int = 3, examples: int = descriptive.EXAMPLES, share: float = 0.3) -> None:
    """An HTML page with a section a pattern: a name from its best matches, statistics, logos (trimmed on both strands, whole
    contributions, hypothetical ones, and probabilities by information), distributions of importance and place, seqlets of
    even quantiles, and matches. What is gathered is a few rows a pattern."""
    held = materialise(described(spark, path, tracks), "described")
    stats = {r.tag: r for r in descriptive.statistics(held).collect()}
    bars: dict[tuple[str, str], list] = {}
    for value in ("importance", "offset"):
        for r in descriptive.densities(held, value).orderBy("tag", "bin").collect():
            bars.setdefault((r.tag, value), []).append((r.low, r.high, r.density))
    picked = descriptive.quantile_examples(held, examples).join(held.select("tag", "ord", "contrib"), ["tag", "ord"]).orderBy("tag", "rank")
    seqlets_by: dict[str, list[str]] = {}
    for r in picked.toLocalIterator():
        seqlets_by.setdefault(r.tag, []).append(f"<tr><td>{r.quantile}<td>{r.importance:.4g}<td>{logo(r.contrib)}</tr>")
    rows = patterns(spark, path).select(tag().alias("tag"), "n_seqlets", "ppm", "cwm", "hcwm", matching.trimmed(F.col("cwm"), F.col("cwm"), share, 2, 2).alias("cut"))
    names, cells = {}, {}
    if database is not None:
        found = materialise(matched(spark, path, database, n, share), "matches")
        cells = _match_cells(found, database, n)
        names = {r.tag: r["name"] for r in matching.descriptive_names(found, rows).collect()}
    parts = []
    for r in rows.toLocalIterator():
        s, ppm = stats[r.tag], np.array(r.ppm)
        gc, mean = float(ppm[:, 1:3].mean()), float(np.abs(np.array(r.cwm)).sum(axis=1).mean())
        facts = f"<p>{r.n_seqlets} seqlets; mean of C and G {gc:.4f}, share of C and G {2 * gc:.4f}; importance a position {mean:.4g}, deviation of seqlets' importance {s.std_importance:.4g}; distance from the middle {s.median_distance:.4g} (median), {s.std_distance:.4g} (deviation)</p>"
        logos = "".join(f"<figure>{logo(m)}<figcaption>{c}</figcaption></figure>" for c, m in (("trimmed", r.cut), ("trimmed, reversed", _turned(r.cut)), ("contributions", r.cwm), ("hypothetical", r.hcwm), ("probabilities by information", _scaled(r.ppm))))
        plots = histogram(bars.get((r.tag, "importance"), []), "skyblue") + histogram(bars.get((r.tag, "offset"), []), "lightcoral")
        table = f"<table border=1><tr>{'</tr><tr>'.join(cells[r.tag])}</tr></table>" if r.tag in cells else ""
        parts.append(f"<section><h2>{html.escape(names.get(r.tag, r.tag))} ({html.escape(r.tag)})</h2>{facts}{logos}{plots}<table border=1>{''.join(seqlets_by.get(r.tag, []))}</table>{table}</section>")
    with create(out) as f:
        f.write(_page("Patterns in detail", "".join(parts)))
