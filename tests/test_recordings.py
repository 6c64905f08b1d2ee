"""Recordings as a data source: parts of long files, pushed conditions, whole files or none; and aligned words."""

import glob
import os
import random
import re

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

from zeitband.operators import metrics
from zeitband.sources import recordings as r

GB = 1 << 30


@pytest.fixture(scope="module")
def long_file(tmp_path_factory):
    """Three gigabytes that take no room on the disk: silence, but for a second that begins at 5000 s."""
    path = tmp_path_factory.mktemp("long")
    with open(path / "long.wav", "wb") as f:
        f.write(r.header(3 * GB, 16_000))
        f.truncate(44 + 3 * GB)
        f.seek(44 + 5000 * 32_000)
        f.write(np.full(16_000, 8192, "<i2").tobytes())
    return f"file://{path}"


def planned(path, *filters, **options):
    reader = r.Recordings({"path": path, **options}).reader(None)
    left = list(reader.pushFilters(list(filters)))
    return reader, reader.partitions(), left


def test_a_long_file_is_read_by_several_tasks(spark, long_file):
    reader, parts, _ = planned(long_file)
    assert len(parts) == 97 and sum(p.last - p.first for p in parts) == -(-3 * GB // 32_000) and max((p.last - p.first) * 32_000 for p in parts) <= 32 << 20
    rows = r.recordings(spark, long_file)
    assert rows.rdd.getNumPartitions() == 97
    last = list(reader.read(parts[-1]))[-1]
    assert last.column("end_ms")[0].as_py() == 3 * GB // 32 and last.column("start_ms")[0].as_py() == (3 * GB // 32_000) * 1000


def test_a_second_reads_a_second(spark, long_file, monkeypatch):
    reader, parts, left = planned(long_file, GreaterThanOrEqual(("start_ms",), 5_000_000), LessThan(("start_ms",), 5_001_000))
    read, real = [], r.read_at
    monkeypatch.setattr(r, "read_at", lambda f, s, n: (read.append(n), real(f, s, n))[1])
    got = [b for p in parts for b in reader.read(p)]
    assert not left and len(got) == 1 and sum(read) == 32_044 and set(got[0].column("samples")[0].as_py()) == {0.25}
    rows = r.recordings(spark, long_file).filter("start_ms >= 5000000 and start_ms < 5001000 and end_ms > 0")
    assert rows.rdd.getNumPartitions() == 1 and [(x["name"], x["start_ms"], x["end_ms"], len(x["samples"])) for x in rows.collect()] == [("long", 5_000_000, 5_001_000, 16_000)]


def test_conditions(tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.wav").write_bytes(r.header(320_000, 16_000) + bytes(320_000))
    (tmp_path / "d.wav").write_bytes(r.header(0, 16_000))
    (tmp_path / "note.txt").write_text("x")
    path, at, name = f"file://{tmp_path}", ("start_ms",), ("name",)
    parts = lambda *f: sorted((p.path[-5:-4], p.first, p.last) for p in planned(path, *f)[1])
    assert parts() == [("a", 0, 10), ("b", 0, 10), ("c", 0, 10)]
    assert parts(EqualTo(name, "b"), GreaterThan(at, 3000)) == [("b", 4, 10)] and parts(In(name, ("a", "c", "x")), LessThanOrEqual(at, 3000)) == [("a", 0, 4), ("c", 0, 4)]
    assert parts(EqualTo(at, 2000), EqualTo(name, "a")) == [("a", 2, 3)] and parts(GreaterThanOrEqual(at, 2001), LessThan(at, 4001), EqualTo(name, "a")) == [("a", 3, 5)]
    assert parts(EqualTo(at, 2500)) == parts(EqualTo(name, "a"), EqualTo(name, "b")) == [("", 0, 0)]
    assert planned(path, EqualTo(("end_ms",), 5))[2] == [EqualTo(("end_ms",), 5)]
    assert planned(f"{path}/none")[1][0].path == ""


def test_written_and_read_back(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rng = np.random.default_rng(1)
    data = {n: (rng.integers(-32000, 32000, k) / 32768).astype(np.float32).tolist() for n, k in (("a", 2500), ("b", 16), ("c", 0))}
    rows = [(n, i, x[s : s + 700]) for n, x in data.items() for i, s in enumerate(range(0, max(1, len(x)), 700))] + [("b", 9, None), (None, 0, [0.5])]
    r.write_recordings(spark.createDataFrame(rows, "name string, start_ms long, samples array<float>").repartition(5), path, rate=1000)
    back = r.recordings(spark, path, rate=1000)
    got = {}
    for x in sorted(back.collect(), key=lambda x: x["start_ms"]):
        got.setdefault(x["name"], []).extend(x["samples"])
        assert x["end_ms"] - x["start_ms"] == len(x["samples"]) <= 1000
    assert got.keys() == {"a", "b"} and all(np.abs(np.array(got[n]) - data[n]).max() < 1e-4 and len(got[n]) == len(data[n]) for n in got)
    assert sorted(os.listdir(tmp_path / "out")) == ["a.wav", "b.wav", "c.wav"]
    assert back.filter("name = 'b'").count() == 1 and back.filter(F.col("name").isin("a", "c") & (F.col("start_ms") > 1000)).count() == 1


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    """One task has no way to write its samples after others wrote theirs."""
    path = f"file://{tmp_path}/out"
    rows = spark.range(40).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.lit(0).cast("long").alias("start_ms"), F.array(F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.lit(0.5))).cast("array<float>").alias("samples"))
    with pytest.raises(Exception, match="broken"):
        r.write_recordings(rows, path)
    assert glob.glob(f"{tmp_path}/out/*") == []


def test_other_files_end_the_job(spark, tmp_path):
    (tmp_path / "x.wav").write_bytes(r.header(1000, 8000) + bytes(1000))
    with pytest.raises(PythonException, match="mono 16-bit"):
        r.recordings(spark, f"file://{tmp_path}").collect()


def test_word_errors(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(12))) for _ in range(120)]
    pairs = [(i, a, b) for i, (a, b) in enumerate(zip(texts[::2], texts[1::2]))] + [(900, None, "x y"), (901, "x", None), (902, None, None), (903, "Der Hund, er läuft!", "der hund läuft schnell")]

    def plain(a, b):
        """Least (cost, deletions, insertions) over all alignments."""
        row = [(j, j, 0) for j in range(len(a) + 1)]
        for h in b:
            new = [(row[0][0] + 1, row[0][1], row[0][2] + 1)]
            for j, w in enumerate(a):
                swap = (row[j][0] + (w != h), *row[j][1:])
                new.append(min(swap, (new[j][0] + 1, new[j][1] + 1, new[j][2]), (row[j + 1][0] + 1, row[j + 1][1], row[j + 1][2] + 1)))
            row = new
        return row[-1]

    norm = lambda t: re.sub(r"[^a-zäöüß0-9\s]", " ", (t or "").lower()).split()
    got = {x["id"]: x for x in metrics.word_errors(spark.createDataFrame(pairs, "id int, reference string, hypothesis string")).collect()}
    for i, a, b in pairs:
        a, b = norm(a), norm(b)
        cost, deleted, inserted = plain(a, b)
        assert tuple(got[i])[1:] == (len(a), len(b), cost - deleted - inserted, deleted, inserted, round(cost / len(a), 6) if a else None)
