import numpy as np
import pytest

from sigwarn.operators import windows
from sigwarn.sources import recordings as rec

TEXT = """Data Sampling Rate: 256 Hz

File Name: a_01.edf
File Start Time: 23:00:00
File End Time: 24:10:00
Number of Seizures in File: 0

File Name: a_02.edf
File Start Time: 0:20:00
File End Time: 01:20:00
Number of Seizures in File: 2
Seizure 1 Start Time: 10 seconds
Seizure 1 End Time: 40 seconds
Seizure 2 Start Time:  300 seconds
Seizure 2 End Time: 330 seconds

file name: a_03.edf
Number of Seizures in File: 2
Seizure Start Time: 5 seconds
Seizure End Time: 9 seconds
"""


def folder(tmp_path, **texts):
    for name, text in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}-summary.txt").write_text(text)
    return str(tmp_path)


def test_annotation_texts(spark, tmp_path):
    texts = rec.read_texts(spark, folder(tmp_path, s1=TEXT, s2="File Name: b.edf\nNumber of Seizures in File: 1\nSeizure Start Time: 7 seconds\nSeizure End Time: 8 seconds\n", s3="nothing here", s4=TEXT))
    blocks = rec.annotation_blocks(texts)
    events = sorted(tuple(r) for r in rec.annotated_events(blocks).collect())
    two = [("a_02.edf", 1, 10.0, 40.0), ("a_02.edf", 2, 300.0, 330.0)]
    assert events == [*[("s1", *e) for e in two], ("s2", "b.edf", 1, 7.0, 8.0), *[("s4", *e) for e in two]]
    assert sorted(tuple(r) for r in rec.disagreeing(blocks).collect()) == [("s1", "a_03.edf", 2, 1, 1), ("s4", "a_03.edf", 2, 1, 1)]
    assert sorted(tuple(r) for r in rec.subject_counts(texts, ("s4",)).collect()) == [("s1", 1, 2), ("s2", 1, 1), ("s3", 0, 0)]
    times = {r["recording_id"]: (r["abs_start"], r["abs_end"], r["has_event"]) for r in rec.timeline(blocks).where("subject_id = 's1'").collect()}
    assert times == {"a_01.edf": (82_800, 87_000, False), "a_02.edf": (87_600, 91_200, True)}


def test_signal_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    signals = [rng.integers(-32768, 32767, 40) for _ in range(3)]
    (tmp_path / "good.edf").write_bytes(rec.encode(["A-B", "c - d", "T-0"], signals, 8))
    (tmp_path / "cut.edf").write_bytes(rec.encode(["A-B"], signals[:1], 8)[:-7])
    (tmp_path / "rate.edf").write_bytes(rec.encode(["A-B", "C-D", "T"], signals, 4))
    (tmp_path / "bad.edf").write_bytes(b"no file")
    files = rec.read_files(spark, str(tmp_path))
    kept, refused = rec.load(files, 8, ("A-B", "C-D", "T"), chunk=16)
    got = {(r["channel"], r["start_sample"]): r["samples"] for r in kept.collect()}
    assert sorted(got) == [(c, s) for c in ("A-B", "C-D", "T") for s in (0, 16, 32)]
    for k, c in enumerate(("A-B", "C-D", "T")):
        assert np.allclose(np.concatenate([got[c, s] for s in (0, 16, 32)]), signals[k] * 1e-7, atol=1e-12)
    reasons = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in refused.collect()}
    assert reasons["cut.edf"] == "missing C-D, T" and reasons["rate.edf"] == "rate 4.0" and set(reasons) == {"cut.edf", "rate.edf", "bad.edf"}
    assert rec.decode(files).where("path like '%cut.edf'").selectExpr("sum(size(samples)) n").first()["n"] == 32


@pytest.mark.parametrize("task_bytes", [1 << 20, 500, 33])
def test_ranges_of_a_file_give_the_chunks_of_the_whole(spark, tmp_path, task_bytes):
    rng = np.random.default_rng(task_bytes)
    files = {"one/a.edf": rec.encode(["A", "B"], [rng.integers(-9000, 9000, n) for n in (205, 190)], 4), "two/b.edf": rec.encode(["A"], [np.arange(3)], 8), "cut.edf": rec.encode(["A", "B"], [np.arange(40)] * 2, 4)[:-5], "bad.edf": b"no file " * 200, "short.edf": b"x", "none.edf": b"", "odd.edf": b"0".ljust(252) + b"many" + b"0" * 90}
    given = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    assert rec.write_files(given, str(tmp_path)) == len(files)
    assert {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()} == set(files)
    found = rec.read_ranges(spark, str(tmp_path), chunk=16, task_bytes=task_bytes)
    rows = lambda df, cut: sorted((r["path"][cut:], r["place"] or 0, r["start_sample"] or 0, r["fs"], r["samples"], r["names"], r["error"] is None) for r in df.collect())
    assert rows(found, len(str(tmp_path)) + 1) == rows(rec.decode(given, 16), 0)
    assert task_bytes > 1000 or found.rdd.getNumPartitions() > len(files)
    kept, refused = rec.complete(found, 4, ("A", "B"))
    assert kept.select("path").distinct().count() == 2 and refused.count() == 5


def test_a_folder_without_signal_files(spark, tmp_path):
    assert rec.read_ranges(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize(("raw", "want"), [([" fp1 - f7", "T8-P8-0", "T8-P8-1"], [0, 1]), (["T8-P8", "FP1-F7", "T8-P8-0"], [1, 0]), (["FP1-F7", "fp1 -f7", "T8- P8"], [1, 2]), (["T8-P8-1", "FP1-F7"], [1, None]), ([None, "T8-P8"], [None, 1])])
def test_channel_names(spark, raw, want):
    df = spark.createDataFrame([(1, k, n) for k, n in enumerate(raw)], "r int, place int, name string")
    row = rec.map_channels(df, ["r"], targets=("FP1-F7", "T8-P8")).first()
    assert [c["place"] for c in row["channels"]] == want
    assert row["missing"] == [c for c, p in zip(("FP1-F7", "T8-P8"), want, strict=True) if p is None]


def test_rates_without_their_fraction(spark):
    df = spark.createDataFrame([(256.9,), (255.9,), (None,)], "fs double")
    assert [r["accepted"] for r in rec.check_rate(df, 256).collect()] == [True, False, False]


@pytest.mark.parametrize(("width", "step"), [(4, 2), (5, 2), (3, 3), (2, 5)])
def test_segments_are_all_complete_windows(spark, width, step):
    rows = [(s, k, float(10 * k + s)) for s, n in ((0, 13), (1, 3), (2, 4)) for k in range(n) if (s, k) != (0, 7)]
    got = {(r["s"], r["start"]): r["samples"] for r in windows.segments(spark.createDataFrame(rows, "s int, k long, v double"), ["s"], "k", "v", width, step).collect()}
    have = {(s, k): v for s, k, v in rows}
    want = {(s, a): [have[s, a + i] for i in range(width)] for s in range(3) for a in range(0, 13, step) if all((s, a + i) in have for i in range(width))}
    assert got == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "subject_id string, text string")
    assert rec.annotated_events(rec.annotation_blocks(none)).count() == 0 and rec.subject_counts(none).count() == 0
    assert rec.decode(spark.createDataFrame([], "path string, content binary")).count() == 0
