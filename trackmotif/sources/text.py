"""Text formats: MEME motifs, BED tracks, FASTA and TOMTOM tables, as rows and as lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmotif.operators.ranking import numbered
from trackmotif.sources.files import create

# Fixed values of the MEME format.
MEME_HEADER = "MEME version 4\n\nALPHABET= ACGT\n\nstrands: + -\n\nBackground letter frequencies\nA 0.25 C 0.25 G 0.25 T 0.25\n"


def meme_motifs(lines: Iterator[str]) -> Iterator[tuple[str, list[list[float]]]]:
    """Name (up to the first space) and probability rows of each motif of a MEME file."""
    name, rows, left = None, [], 0
    for line in lines:
        if line.startswith("MOTIF"):
            if name is not None:
                yield name, rows
            name, rows, left = line.split()[1], [], 0
        elif line.startswith("letter-probability matrix"):
            width = re.search(r"w=\s*(\d+)", line)
            left = int(width[1]) if width else 1 << 30
        elif left and name is not None:
            numbers = line.split()
            if len(numbers) != 4:
                left = 0
                continue
            rows.append([float(x) for x in numbers])
            left -= 1
    if name is not None:
        yield name, rows


def read_meme(spark: SparkSession, path: str) -> DataFrame:
    """name and pwm (array<array<double>>) of every motif of a MEME file, or of a folder of them, wherever Spark reads."""
    from trackmotif.session import ship_package

    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [m for t in batch.column(0) for m in meme_motifs(iter(t.as_py().splitlines()))]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.string()), pa.array([m for _, m in found], pa.list_(pa.list_(pa.float64())))], names=["name", "pwm"])

    return spark.read.text(path, wholetext=True).mapInArrow(run, "name string, pwm array<array<double>>")


def meme_block(name: Column, pwm: Column, digits: int = 6, sites: int = 1) -> Column:
    """The lines of one motif."""
    row = lambda r: F.array_join(F.transform(r, lambda x: F.format_string(f"%.{digits}f", x)), " ")
    head = F.concat(F.lit("MOTIF "), name, F.lit("\nletter-probability matrix: alength= 4 w= "), F.size(pwm).cast("string"), F.lit(f" nsites= {sites}\n"))
    return F.concat(head, F.array_join(F.transform(pwm, row), "\n"), F.lit("\n"))


def write_meme(df: DataFrame, path: str, name: str = "name", pwm: str = "pwm", digits: int = 6) -> None:
    """A header and one block a motif, by name; a motif set is small."""
    lines = [r.block for r in df.orderBy(name).select(meme_block(F.col(name), F.col(pwm), digits).alias("block")).toLocalIterator()]
    with create(path) as f:
        f.write("\n".join([MEME_HEADER, *lines]))


def bed_line(*columns: Column) -> Column:
    """Up to 12 columns, tab-separated; missing optional ones are left out."""
    return F.concat_ws("\t", *columns)


def track_line(name: Column, **options: Column | str) -> Column:
    """The line that begins a track; options follow in the order given, all quoted."""
    more = [x for k, v in options.items() for x in (F.lit(f' {k}="'), v if isinstance(v, Column) else F.lit(v), F.lit('"'))]
    return F.concat(F.lit('track name="'), name, F.lit('"'), *more)


def fasta_entry(header: Column, sequence: Column) -> Column:
    return F.concat(F.lit(">"), header, F.lit("\n"), sequence)


def read_bed(spark: SparkSession, path: str, chroms: list[str] | None = None) -> DataFrame:
    """row_idx and the first columns of a peak file; rows are numbered in file order, after the filter of chromosomes.

    Every line keeps its number, as seqlets name peaks by it: one with fewer than 5 columns ends the job, and a blank one
    is a row of nulls (of no chromosome, for the filter).
    """
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("_at"), F.split("value", "\t").alias("c"), (F.trim("value") == "").alias("blank"))
    short = F.raise_error(F.concat(F.lit("a line of the peak file has fewer than 5 columns: "), F.array_join("c", " ")))
    part = lambda k: F.when(F.col("blank"), None).when(F.size("c") < 5, short).otherwise(F.get("c", F.lit(k)))
    rows = rows.select("_at", part(0).alias("chrom"), part(1).cast("long").alias("start"), part(2).cast("long").alias("end"), part(3).alias("name"), part(4).alias("score"))
    return numbered(with_chroms(rows, chroms), "_at").drop("_at")


def with_chroms(rows: DataFrame, chroms: list[str] | None) -> DataFrame:
    """Rows of these chromosomes; None or "*" takes all."""
    return rows if chroms is None or chroms == ["*"] else rows.where(F.col("chrom").isin(chroms))


def read_tomtom(spark: SparkSession, path: str) -> DataFrame:
    """target and p of a TOMTOM table: its second and sixth columns, comments left out."""
    rows = spark.read.option("sep", "\t").option("comment", "#").option("header", "true").csv(path)
    return rows.select(F.col(rows.columns[1]).alias("target"), F.col(rows.columns[5]).cast("double").alias("p"))


def genome_coordinates(start: str, end: str, peak_start: str, peak_end: str, window: int) -> tuple[Column, Column]:
    """Where a seqlet lies: the crop is centred on the peak, and starts count from 1."""
    first = F.floor((F.col(peak_start) + F.col(peak_end)) / 2).cast("long") - window // 2
    return first + F.col(start) + 1, first + F.col(end)
