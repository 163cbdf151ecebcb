import numpy as np
import pytest

from trackmotif.sources import npz, results


def test_npz_tracks(spark, tmp_path):
    rng = np.random.RandomState(0)
    hot = np.eye(4)[rng.randint(0, 4, (25, 12))].transpose(0, 2, 1).astype("float32")
    hyp = rng.normal(size=(25, 4, 12)).astype("float16")
    np.savez_compressed(tmp_path / "a.npz", hot)
    np.save(tmp_path / "b.npy", hyp)
    rows = npz.read_tracks(spark, str(tmp_path / "a.npz"), str(tmp_path / "b.npy"), 8).orderBy("example_idx").collect()
    assert len(rows) == 25
    assert all(np.allclose(r.one_hot, hot[r.example_idx].T[2:10]) and np.allclose(r.hyp, hyp[r.example_idx].T[2:10]) for r in rows)
    with pytest.raises(ValueError):
        npz.read_tracks(spark, str(tmp_path / "a.npz"), str(tmp_path / "b.npy"), 14)


def test_compressed_arrays_of_bounded_size(spark, tmp_path):
    path = str(tmp_path / "a.npz")
    np.savez_compressed(path, np.zeros((5, 4, 10), np.float32))
    npz.read_tracks(spark, path, path)  # registers the source
    assert spark.read.format("npz").option("packed_bytes", "800").load(path).count() == 5
    with pytest.raises(Exception, match="save the array uncompressed"):
        spark.read.format("npz").option("packed_bytes", "799").load(path).count()


def test_results_and_exports(spark, tmp_path):
    rng = np.random.RandomState(1)
    tracks = spark.createDataFrame([(k, np.eye(4)[rng.randint(0, 4, 20)].tolist(), rng.normal(size=(20, 4)).tolist()) for k in range(6)], "example_idx long, one_hot array<array<double>>, hyp array<array<double>>")
    members = spark.createDataFrame([("pos", p, o, (p + o) % 6, 3, 11, o % 2 == 1, 0) for p in range(11) for o in range(3)], "sign string, pattern_idx int, ord long, example_idx long, start long, end long, is_revcomp boolean, subcluster int")
    path = str(tmp_path / "r")
    results.save(members, tracks, path, 20)
    assert results.window_size(spark, path) == 20
    assert [r.pattern_idx for r in results.patterns(spark, path).collect()] == list(range(11))
    assert [r.name for r in results.patterns(spark, path, True).collect()] == sorted(f"pattern_{k}" for k in range(11))
    peaks = tmp_path / "p.bed"
    peaks.write_text("".join(f"chr{k % 2}\t{1000 * k}\t{1000 * k + 40}\tp\t{k}\n" for k in range(6)))
    results.write_bed(spark, path, str(peaks), str(tmp_path / "o.bed"))
    lines = (tmp_path / "o.bed").read_text().split("\n")
    assert lines[0] == "track name=\"pattern_0\" description=\"Pattern 'pattern_0' on the positive strand.\"" and lines[1] == "chr0\t14\t21\tpattern_0.0\t0\t+" and lines.count("") == 11
    results.write_fasta(spark, path, str(peaks), tracks, str(tmp_path / "o.fa"))
    assert (tmp_path / "o.fa").read_text().count(">") == 33
    entries = (tmp_path / "o.fa").read_text().split("\n")
    assert entries[0] == ">chr0:14-21 dir=+ pattern_0.0" and entries[2] == ">chr1:1014-1021 dir=- pattern_0.1" and entries[12].endswith("pattern_10.0")
    results.write_meme(spark, path, str(tmp_path / "o.meme"), "CWM-PFM")
    results.report(spark, path, str(tmp_path / "o.html"))
    assert (tmp_path / "o.meme").read_text().count("MOTIF") == 11 and (tmp_path / "o.html").read_text().count("<svg") == 22
    back = results.from_legacy(results.legacy_strings(spark, path)).select(*members.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, members.collect()))


def test_exports_in_parts_and_in_order(spark, tmp_path):
    """Parts that tasks write side by side are the one file; pos comes first, patterns by name; no member lacks a peak."""
    tracks = spark.createDataFrame([(k, np.eye(4)[(np.arange(20) * (k + 1)) % 4].tolist(), np.ones((20, 4)).tolist()) for k in range(6)], "example_idx long, one_hot array<array<double>>, hyp array<array<double>>")
    rows = [(sign, p, o, (p + o) % 6, 3, 11, o % 2 == 1, 0) for sign in ("neg", "pos") for p in range(12) for o in range(4)]
    members = spark.createDataFrame(rows, "sign string, pattern_idx int, ord long, example_idx long, start long, end long, is_revcomp boolean, subcluster int")
    path, peaks = str(tmp_path / "r"), tmp_path / "p.bed"
    results.save(members, tracks, path, 20)
    peaks.write_text("".join(f"chr{k % 2}\t{1000 * k}\t{1000 * k + 41}\tp\t{k}\n" for k in range(6)))
    ways = {"bed": lambda out, parts: results.write_bed(spark, path, str(peaks), out, parts=parts), "fa": lambda out, parts: results.write_fasta(spark, path, str(peaks), tracks, out, parts=parts), "one": lambda out, parts: results.save_seqlets(spark, path, "neg", 3, tracks, out, parts)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for name, write in ways.items():
        write(str(tmp_path / f"whole.{name}"), False)
        write(str(tmp_path / f"parts.{name}"), True)
        files = sorted((tmp_path / f"parts.{name}").glob("part-*"))
        assert (name == "one" or len(files) > 1) and "".join(f.read_text() for f in files) == (tmp_path / f"whole.{name}").read_text()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = []
    for sign in ("pos", "neg"):
        for p in sorted(range(12), key=lambda p: f"pattern_{p}"):
            expected += [""] * bool(expected) + [f"track name=\"pattern_{p}\" description=\"Pattern 'pattern_{p}' on the positive strand.\""]
            for o in range(4):
                k = (p + o) % 6
                middle = (2000 * k + 41) // 2
                expected.append(f"chr{k % 2}\t{middle - 10 + 3 + 1}\t{middle - 10 + 11}\tpattern_{p}.{o}\t{k}\t{'+-'[o % 2]}")
    assert (tmp_path / "whole.bed").read_text() == "\n".join(expected) + "\n"
    peaks.write_text("".join(f"chr1\t{k}\t{k + 9}\tp\t{k}\n" for k in range(5)))
    with pytest.raises(Exception, match="no peak for example 5"):
        results.write_bed(spark, path, str(peaks), str(tmp_path / "x.bed"))
