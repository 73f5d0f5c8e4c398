"""Graphs whose nodes are all reached, and recordings that are mostly silent."""

import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairograph.llm import ann, audio


def clustered(seed, n, d, groups=2, apart=100.0, spread=0.05):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, d))
    centre *= apart / np.linalg.norm(centre, axis=1, keepdims=True)
    return (centre[np.arange(n) % groups] + spread * rng.normal(size=(n, d))).astype(np.float32)


@pytest.mark.parametrize("seed", range(4))
def test_all_nodes_of_clustered_vectors_are_reached(seed):
    x = clustered(seed, 3000, 32)
    middle = x.mean(0, dtype=np.float64)
    y = (x - middle).astype(np.float32)
    graph, entry = ann.build_graph(y, seed=seed)
    reached = np.zeros(len(x), bool)
    ann._reach(graph, reached, entry)
    assert reached.all()
    found, _ = ann.beam_search(y, graph, entry, y[::30], ann.QUERY_BEAM)
    exact, hits = x.astype(np.float64), []
    for q, row in zip(exact[::30], found):
        want = set(np.argsort(((exact - q) ** 2).sum(1), kind="stable")[:11].tolist())
        got = row[row >= 0]
        best = got[np.argsort(((exact[got] - q) ** 2).sum(1), kind="stable")[:11]]
        hits.append(len(want & set(best.tolist())) / len(want))
    assert np.mean(hits) >= 0.95


def test_search_over_clusters(spark):
    x = clustered(9, 1200, 16, groups=3)
    d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest_neighbours(d, F.col("vec_id") % 40 == 0, k=10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    exact = x.astype(np.float64)
    hits = [len(got[q] & set(np.argsort(((exact - exact[q]) ** 2).sum(1), kind="stable")[1:11].tolist())) for q in range(0, 1200, 40)]
    assert np.mean(hits) >= 9.5


def test_index_is_moved_once(spark):
    d = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(300)], "vec_id long, embedding array<float>")
    index = ann.build_index(d, shard_nodes=50)
    plan = ann.search_index(index, d, k=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "CoGroup" not in plan


def silent_recordings(n=40, seconds=60):
    """Recordings of one minute with eight different seconds of sound each."""
    rng, out = np.random.default_rng(0), []
    for _ in range(n):
        x = np.zeros(audio.RATE * seconds, np.float32)
        at = audio.RATE * int(rng.integers(5, 40))
        pitch = 110 * 2 ** (rng.integers(0, 36, 8 * audio.RATE // audio.HOP) / 12)
        tone = np.sin(np.cumsum(np.repeat(2 * np.pi * pitch / audio.RATE, audio.HOP)))
        x[at : at + len(tone)] = tone
        out.append(x)
    return out


def test_silence_aligns_with_nothing():
    prints = [audio.fingerprint(x) for x in silent_recordings()]
    assert all((p == audio.SILENT).mean() > 0.5 for p in prints)
    shard = audio.Shard(prints)
    assert [r for r, _, _ in shard.aligned(prints[3])] == [3]
    assert list(audio.Shard([np.full(400, audio.SILENT)]).aligned(np.full(400, audio.SILENT))) == []
    shifted = np.concatenate([np.full(30, audio.SILENT), prints[5]])
    assert (5, -30, 0.0) in list(shard.aligned(shifted))


def test_votes_of_runs_are_those_of_pairs():
    rng = np.random.default_rng(3)
    for _ in range(60):
        make = lambda n: np.repeat(rng.integers(0, 3, n), rng.integers(1, 9, n)).astype(np.uint32) << np.uint32(32 - audio.KEY_BITS)
        prints = [make(int(rng.integers(1, 12))) for _ in range(5)]
        for p in prints:
            p[rng.random(len(p)) < 0.1] = audio.SILENT
        query = make(int(rng.integers(1, 12)))
        want = {}
        for r, p in enumerate(prints):
            votes = {}
            for i, a in enumerate(p):
                for j, b in enumerate(query):
                    if a == b and a != audio.SILENT:
                        votes[i - j] = votes.get(i - j, 0) + 1
            if votes:
                want[r] = min((-n, o) for o, n in votes.items())
        assert {int(r): (-int(n), int(o)) for r, o, n in zip(*audio.Shard(prints).votes(query))} == want


def test_one_sound_held_in_all_recordings_needs_little_memory(monkeypatch):
    prints = [np.concatenate([np.full(4000, 77 << 12, np.uint32), np.arange(k, k + 50, dtype=np.uint32) << np.uint32(12)]) for k in range(0, 60_000, 200)]
    shard, before = audio.Shard(prints), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert shard.votes(prints[0])[2][0] == 4050
    monkeypatch.setattr(audio, "PAIRS", 7)
    assert shard.votes(prints[0])[2][0] == 4050
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000
