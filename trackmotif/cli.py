"""Command line: python -m trackmotif.cli COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from trackmotif.operators.kernels import Settings
from trackmotif.plans import discover, merge_runs
from trackmotif.session import build_session, materialise
from trackmotif.sources import legacy, npz, results, text


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="trackmotif")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("motifs", help="discover motifs in tracks")
    for flag, kind in (("--sequences", str), ("--attributions", str), ("--output", str), ("--max-seqlets", int)):
        p.add_argument(flag, type=kind, required=True)
    for flag, value in (("--window", 400), ("--size", 20), ("--trim-size", 30), ("--seqlet-flank-size", 5), ("--initial-flank-to-add", 10), ("--final-flank-to-add", 0), ("--n-leiden", 50)):
        p.add_argument(flag, type=int, default=value)
    for name in ("report", "report-simple", "meme", "seqlet-bed", "seqlet-fasta", "convert", "convert-backward"):
        p = commands.add_parser(name)
        p.add_argument("--results", required=True, help="the results read; older ones for convert")
        p.add_argument("--output", required=True)
        if name == "meme":
            p.add_argument("--datatype", choices=results.KINDS, default="PFM")
        if name.startswith("report"):
            p.add_argument("--meme-db")
            p.add_argument("--matches", type=int, default=3)
            p.add_argument("--trim-threshold", type=float, default=0.3)
            p.add_argument("--columns", choices=["euclidean", "pearson"], default="euclidean", help="how columns of motifs compare (report-simple)")
            p.add_argument("--most-e", type=float, help="matches of larger E-values are none (report-simple)")
            p.add_argument("--write-tomtom", help="a folder for the tables of matches")
        if name.startswith("seqlet"):
            p.add_argument("--peaks", required=True)
            p.add_argument("--chroms", default="*")
            p.add_argument("--parts", action="store_true", help="a folder of files in order, written side by side")
        if name.startswith("seqlet") or name in ("convert", "report"):
            p.add_argument("--window", type=int)
        if name in ("seqlet-fasta", "convert", "report"):
            p.add_argument("--sequences", required=True)
        if name in ("convert", "report"):
            p.add_argument("--attributions", required=True)
    p = commands.add_parser("merge", help="merge the patterns of several runs")
    p.add_argument("--run", nargs=3, action="append", required=True, metavar=("RESULTS", "SEQUENCES", "ATTRIBUTIONS"))
    p.add_argument("--output", required=True)
    return parser.parse_args(argv)


def _tracks(spark: SparkSession, sequences: str, attributions: str, window: int | None) -> DataFrame:
    """Arrays, or where both are one Parquet path, an older layout."""
    if sequences == attributions and not sequences.endswith((".npz", ".npy")):
        return legacy.read_tracks(spark, sequences, window)
    return npz.read_tracks(spark, sequences, attributions, window)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _arguments(argv)
    spark = spark or build_session()
    if a.command == "motifs":
        tracks = _tracks(spark, a.sequences, a.attributions, a.window)
        settings = Settings(window=a.size, flank=a.seqlet_flank_size, fdr=0.05, max_seqlets=a.max_seqlets, trim=a.trim_size, initial_flank=a.initial_flank_to_add, final_flank=a.final_flank_to_add, seeds=a.n_leiden)
        results.save(discover.discover(tracks, settings), tracks, a.output, a.window)
    elif a.command.startswith("report"):
        database = materialise(text.read_meme(spark, a.meme_db), "motif-db") if a.meme_db else None
        if a.command == "report-simple":
            results.report(spark, a.results, a.output, database, a.matches, a.trim_threshold, a.write_tomtom, a.columns, a.most_e)
        else:
            tracks = _tracks(spark, a.sequences, a.attributions, a.window or results.window_size(spark, a.results))
            results.descriptive_report(spark, a.results, tracks, a.output, database, a.matches, share=a.trim_threshold)
            if database is not None and a.write_tomtom:
                results.write_matches(results.matched(spark, a.results, database, a.matches, a.trim_threshold), a.write_tomtom)
    elif a.command == "meme":
        results.write_meme(spark, a.results, a.output, a.datatype)
    elif a.command == "seqlet-bed":
        results.write_bed(spark, a.results, a.peaks, a.output, a.chroms.split(","), a.window, a.parts)
    elif a.command == "convert":
        window = a.window or 400
        legacy.convert(spark, a.results, a.output, _tracks(spark, a.sequences, a.attributions, window), window)
    elif a.command == "convert-backward":
        legacy.convert_backward(spark, a.results, a.output)
    elif a.command == "merge":
        window = results.window_size(spark, a.run[0][0])
        runs = [(results.members(spark, r), _tracks(spark, s, t, results.window_size(spark, r))) for r, s, t in a.run]
        members, tracks, tree = merge_runs.merge(runs)
        results.save(members, tracks, a.output, window)
        tree.write.parquet(f"{a.output}/merge_tree")
    else:
        window = a.window or results.window_size(spark, a.results)
        results.write_fasta(spark, a.results, a.peaks, _tracks(spark, a.sequences, a.sequences, window), a.output, a.chroms.split(","), window, a.parts)


if __name__ == "__main__":
    main()
