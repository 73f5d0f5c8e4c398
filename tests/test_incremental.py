"""Matrix ranges, work that is killed and taken up again, streamed history and steps with feedback."""

import os
import subprocess
import sys
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairograph.operators import forecast as fc
from kairograph.operators import history as hi
from kairograph.sources.matrix import read_matrix, write_matrix
from kairograph.streaming import history as sh
from kairograph.streaming import resumable

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows_of(df):
    return {(os.path.basename(r.file), r.row): list(r.v) for r in df.collect()}


def test_one_matrix_is_read_by_many_tasks(spark, tmp_path):
    m = np.random.default_rng(0).normal(size=(1000, 7)).astype(np.float32)
    np.save(tmp_path / "c.npy", m)
    np.save(tmp_path / "f.npy", np.asfortranarray(m.astype(np.float64)))
    np.savez(tmp_path / "a.npz", other=np.zeros((2, 2)), x=m)
    np.savez_compressed(tmp_path / "z.npz", x=m)
    for name, key in (("c.npy", None), ("f.npy", None), ("a.npz", "x"), ("z.npz", "x")):
        df = read_matrix(spark, f"{tmp_path}/{name}", key, range_bytes=2800)
        assert rows_of(df) == {(name, k): r.tolist() for k, r in enumerate(m)}
        assert df.rdd.getNumPartitions() == {"c.npy": 10, "f.npy": 20, "a.npz": 10, "z.npz": 1}[name]
    assert read_matrix(spark, f"file://{tmp_path}/c.npy", kind="double").count() == 1000


def test_matrices_that_cannot_be_read(spark, tmp_path):
    np.save(tmp_path / "one.npy", np.zeros(3))
    np.save(tmp_path / "text.npy", np.array([["a"]]))
    np.savez(tmp_path / "a.npz", x=np.zeros((1, 1)))
    np.save(tmp_path / "empty.npy", np.zeros((0, 3)))
    for path, key, message in (("one.npy", None, "1 dimensions"), ("text.npy", None, "not numbers"), ("a.npz", "y", "no array y"), ("none.npy", None, "none.npy")):
        with pytest.raises(Exception, match=message):
            read_matrix(spark, f"{tmp_path}/{path}", key).count()
    assert read_matrix(spark, f"{tmp_path}/empty.npy").count() == 0


def test_matrix_round_trip(spark, tmp_path):
    rows = spark.range(0, 500, numPartitions=6).select(F.array("id", F.col("id") * 2).cast("array<double>").alias("v")).where("v[0] < 400")
    write_matrix(rows, f"{tmp_path}/m", kind="long")
    assert sorted(r.v[0] for r in read_matrix(spark, f"{tmp_path}/m", kind="long").collect()) == list(range(400))
    assert all(f.startswith("part-") for f in os.listdir(tmp_path / "m"))
    with pytest.raises(Exception, match="components"):
        write_matrix(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>").coalesce(1), f"{tmp_path}/n")


KILLED = """
import os, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from kairograph.streaming import resumable
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
done = []
def work(batch):
    if len(done) == 2:
        made = batch.select("id", F.lit("half").alias("x"))
        made.write.parquet({folder!r} + "/out/batch=2")  # a result without a mark
        os._exit(9)
    done.append(1)
    return batch.select("id", F.concat(F.lit("x"), F.col("id").cast("string")).alias("x"))
resumable.complete(spark.range(200).select("id"), work, {folder!r}, "id long, x string", id_col="id", batches=6)
"""


def test_killed_and_restarted(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    code = subprocess.run([sys.executable, "-c", textwrap.dedent(KILLED).format(root=ROOT, folder=folder)], capture_output=True, timeout=150).returncode
    assert code == 9
    part = resumable.finished(spark, folder, "id long, x string")
    assert 0 < part.count() < 200 and part.where("x = 'half'").count() == 0
    before, worked = {r.id for r in part.collect()}, []

    def work(batch):
        worked.extend(r.id for r in batch.collect())
        return batch.select("id", F.concat(F.lit("x"), F.col("id").cast("string")).alias("x"))

    out = resumable.complete(spark.range(200).select("id"), work, folder, "id long, x string", id_col="id", batches=6)
    assert sorted((r.id, r.x) for r in out.collect()) == [(i, f"x{i}") for i in range(200)]
    assert sorted(worked) == sorted(set(range(200)) - before)
    again = resumable.complete(spark.range(200).select("id"), lambda b: 1 / 0, folder, "id long, x string", id_col="id", batches=6)
    assert again.count() == 200


def test_nothing_finished(spark, tmp_path):
    assert resumable.finished(spark, f"file://{tmp_path}/no", "id long").count() == 0
    out = resumable.complete(spark.range(0).select("id"), lambda b: b, f"file://{tmp_path}/none", "id long", id_col="id", batches=3)
    assert out.count() == 0


def test_streamed_history_in_many_batches(spark, tmp_path):
    rng = np.random.default_rng(2)
    facts = [(k, int(rng.integers(5)), 0, int(rng.integers(5)), int(d), f"2024-01-{d + 1:02d} {rng.integers(24):02d}:00:00") for k, d in enumerate(np.sort(rng.integers(0, 9, 160)))]
    df = spark.createDataFrame(facts, "seq long, s long, r long, o long, t long, ts string").withColumn("ts", F.to_timestamp("ts"))
    for n in range(16):  # two files of a day, rows dealt by a hash
        part = df.where((F.col("t") == n // 2) & (F.pmod(F.xxhash64("seq"), F.lit(2)) == n % 2))
        part.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    df.where("t = 8").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 3).option("latestFirst", False).parquet(f"file://{tmp_path}/in")
    got = sorted(tuple(r) for r in sh.run_rolling(sh.newest_facts(stream, 4, late="2 days")).collect())
    want = hi.history(df, hi.entity_queries(df), 4).select("e", "q", "rank", "seq", "t", "s", "r", "o")
    closed = [tuple(r) for r in want.where("q < 7").collect()]
    assert {x for x in got if x[1] < 6} == {x for x in closed if x[1] < 6} and len(got) == len(set(got))


def test_forecast_steps(spark):
    rows = [(0, 0, 0, 1), (0, 0, 0, 2), (1, 0, 0, 2), (2, 0, 0, 3), (2, 9, 0, 1), (3, 0, 0, 1), (4, 0, 0, 2)]
    f = spark.createDataFrame(rows, "t long, s long, r long, o long")
    run = lambda **k: sorted((r.t, r.e, r.place, r.entity, r.score) for r in fc.forecast(f, 2, n_rel=1, cut=lambda d: d, **k).collect())
    # day 2 is answered from days 0 and 1, day 3 from day 1 and the answers of day 2, day 4 from the answers of days 2 and 3
    assert run(window=2, k=1) == [(2, 0, 1, 2, 2.0), (3, 0, 1, 2, 2.0), (4, 0, 1, 2, 2.0)]
    assert run(window=2, k=1, feedback=False) == [(2, 0, 1, 2, 2.0), (3, 0, 1, 2, 1.0), (4, 0, 1, 1, 1.0)]
    assert run(window=2, k=5, steps=1) == [(2, 0, 1, 2, 2.0), (2, 0, 2, 1, 1.0)]
    # a step without answers leaves the window
    g = spark.createDataFrame([(0, 0, 0, 1), (1, 5, 0, 6), (2, 0, 0, 7)], "t long, s long, r long, o long")
    assert [(r.t, r.entity) for r in fc.forecast(g, 1, window=1, k=1, n_rel=1, cut=lambda d: d).collect()] == [(2, 1)]
    assert fc.forecast(g, 9, window=1, k=1, n_rel=1, cut=lambda d: d).count() == 0


def test_one_timer_closes_all_days_that_are_over():
    import pandas as pd

    class State(list):
        def get(self):
            return list(self)

        def put(self, rows):
            self[:] = rows

    class Handle:
        timers = set()

        def getListState(self, name, schema):
            return State()

        def registerTimer(self, at):
            self.timers.add(at)

        def listTimers(self):
            return iter(self.timers)

    class Times:
        getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: 4 * 86_400_000

    p = sh.NewestFacts(2, 0)
    p.init(Handle())
    rows = pd.DataFrame([(d, 10 * d + k, 0, 7, 0, k) for d in (3, 0, 1, 5) for k in (2, 0, 1)], columns=["t", "seq", "role", "s", "r", "o"])
    list(p.handleInputRows((7,), iter([rows]), None))
    assert p.handle.timers == {86_400_000}
    p.handle.timers.clear()
    out = pd.concat(list(p.handleExpiredTimer((7,), Times(), Times())))
    assert list(out[["q", "rank", "seq"]].itertuples(index=False, name=None)) == [(1, 1, 2), (1, 2, 1), (3, 1, 12), (3, 2, 11)]
    assert p.handle.timers == {6 * 86_400_000} and [f[1] for f in p.open] == [51, 52]
