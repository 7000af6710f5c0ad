"""Clustering of chunks against a plain Python version, round by round; restarts; chunks that leave no discard set."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import bfr
from tessera.streaming.chunks import cluster_files, cluster_stream, streamed_state

K, SEED = 3, 200


def _points(seed: int, n: int, spread: float = 0.4, far: int = 6) -> list[tuple[int, list[float]]]:
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0, 0], [12, 0, 5, 0], [0, 14, 0, 9]], float)
    x = centres[rng.integers(0, 3, n)] + rng.normal(0, spread, (n, 4))
    x[:far] = rng.uniform(-90, 90, (far, 4))
    return [(seed * 10_000 + i, [float(round(v, 3)) for v in row]) for i, row in enumerate(x)]


class Plain:
    """The same method over lists of (id, vector), with sets of members in place of summaries."""

    def __init__(self, rank: dict[int, int]):
        self.rank, self.discard, self.compression, self.retained, self.rounds = rank, {}, {}, [], []
        self.fresh = 0

    def k_means(self, points, k, iterations=3):
        first = sorted(points, key=lambda p: self.rank[p[0]])[:k]
        centres = [np.array(p[1]) for p in first]
        for left in range(iterations - 1, -1, -1):
            groups = {}
            for p in points:
                d = [np.sqrt(((np.array(p[1]) - c) ** 2).sum()) for c in centres]
                groups.setdefault(int(np.argmin(d)), []).append(p)
            if left:
                centres = [np.mean([p[1] for p in groups[c]], axis=0) for c in sorted(groups)]
        return groups

    @staticmethod
    def distance(x, members):
        held = np.array([p[1] for p in members])
        mean, sigma = held.mean(axis=0), np.sqrt(np.maximum((held**2).mean(axis=0) - held.mean(axis=0) ** 2, 0))
        gap = np.abs(np.asarray(x) - mean)
        return np.sqrt(sum((g / s) ** 2 if s > 0 else (0.0 if g == 0 else np.inf) for g, s in zip(gap, sigma, strict=True)))

    def assign(self, points, sets):
        """All points are measured before any joins a set."""
        limit, left, joins = 3 * 3**0.5, [], []
        for p in points:
            found = [(self.distance(p[1], sets[c]), c) for c in sorted(sets)]
            best = min(found, default=(np.inf, -1))
            (joins if best[0] < limit else left).append((p, best[1]))
        for p, c in joins:
            sets[c] = [*sets[c], p]
        return [p for p, _ in left]

    def compress(self, points, more_than):
        groups = self.k_means(points, 3 * K)
        made = {c + self.fresh: g for c, g in groups.items() if len(g) > more_than}
        self.compression |= made
        self.fresh = max([self.fresh, *(c + 1 for c in made)])
        self.retained = [p for g in groups.values() if len(g) <= more_than for p in g]

    def update(self, points):
        if not self.discard:
            groups = self.k_means(points + self.retained, 5 * K)
            inside = [p for g in groups.values() if len(g) > 3 for p in g]
            outside = [p for g in groups.values() if len(g) <= 3 for p in g]
            self.discard = dict(self.k_means(inside, K)) if inside else {}
            self.compress(outside, 3)
        else:
            left = self.assign(points, self.discard)
            left = self.assign(left, self.compression)
            self.compress(left + self.retained, 1)
            self.merge()
        size = lambda sets: sum(map(len, sets.values()))
        self.rounds.append((len(self.rounds) + 1, len(self.discard), size(self.discard), len(self.compression), size(self.compression), len(self.retained)))

    def merge(self):
        while len(self.compression) > 1:
            keys = sorted(self.compression)
            apart = lambda a, b: self.distance(np.mean([p[1] for p in self.compression[a]], axis=0), self.compression[b])
            d, a, b = min((apart(a, b), a, b) for i, a in enumerate(keys) for b in keys[i + 1 :])
            if d >= 3 * 3**0.5:
                return
            self.compression[a] = self.compression[a] + self.compression.pop(b)

    def assignment(self):
        discard, out = dict(self.discard), {p[0]: -1 for p in self.retained}
        homes = {}
        for c in sorted(self.compression):
            mean = np.mean([p[1] for p in self.compression[c]], axis=0)
            d, near = min(((self.distance(mean, discard[x]), x) for x in discard), default=(np.inf, -1))
            homes[c] = near if d < 3 * 3**0.5 else -1
            if homes[c] >= 0:
                discard[near] = discard[near] + self.compression[c]
        for c, g in self.compression.items():
            out |= {p[0]: homes[c] for p in g}
        return out | {p[0]: c for c, g in self.discard.items() for p in g}


def _frame(spark, points):
    return spark.createDataFrame(points, "point_id long, features array<double>")


def _rank(spark, points):
    rows = _frame(spark, points).select("point_id", F.xxhash64("point_id", F.lit(SEED)).alias("h")).collect()
    return {r.point_id: (r.h, r.point_id) for r in rows}


def _clusters(found: dict[int, int]) -> set[frozenset[int]]:
    """The clusters as sets, without their numbers; -1 stays apart."""
    groups = {}
    for p, c in found.items():
        groups.setdefault(c, set()).add(p)
    return {frozenset([c == -1, *(("p", x) for x in g)]) for c, g in groups.items()}


@pytest.fixture(scope="module")
def chunks():
    return [_points(1, 120), _points(2, 60), _points(3, 60, far=12)]


@pytest.fixture(scope="module")
def plain(spark, chunks):
    own = Plain(_rank(spark, sum(chunks, [])))
    for c in chunks:
        own.update(c)
    return own


def test_rounds_and_assignment_equal_the_plain_version(spark, chunks, plain):
    state = bfr.run([_frame(spark, c) for c in chunks], K)
    assert state.rounds == plain.rounds
    found = {r.point_id: r.cluster_id for r in state.assignment().collect()}
    assert len(found) == 240 and _clusters(found) == _clusters(plain.assignment())


def test_points_stay_when_a_chunk_has_no_clusters(spark):
    lonely = [(i, [float(90 * i), float(-70 * i * i), float(i**3), 1.0]) for i in range(1, 9)]
    later = _points(5, 60, far=0)
    own = Plain(_rank(spark, lonely + later))
    state = bfr.Bfr(K)
    for chunk in (lonely, later):
        own.update(chunk)
        state.update(_frame(spark, chunk))
    assert state.rounds == own.rounds
    assert sum(state.rounds[-1][i] for i in (2, 4, 5)) == 68
    alone = bfr.run([_frame(spark, lonely)], K)
    assert {r.cluster_id for r in alone.assignment().collect()} == {-1} and alone.assignment().count() == 8


def test_one_point_and_equal_points(spark):
    state = bfr.run([_frame(spark, [(1, [1.0, 2.0])])], K)
    assert [tuple(r) for r in state.assignment().collect()] == [(1, -1)]
    same = bfr.run([_frame(spark, [(i, [1.0, 2.0]) for i in range(20)])] * 1, K)
    assert same.rounds[0][2] == 20 and {r.cluster_id for r in same.assignment().collect()} == {0}


def _write(folder, chunks):
    for i, c in enumerate(chunks):
        (folder / f"chunk-{i}.txt").write_text("\n".join(",".join(map(str, [p, *x])) for p, x in c) + "\n")


def test_a_folder_is_taken_by_name_and_taken_up_again(spark, tmp_path, chunks, plain):
    data, states = tmp_path / "data", f"file://{tmp_path}/states"
    data.mkdir()
    _write(data, chunks[:2])
    cluster_files(spark, str(data), states, K)
    _write(data, chunks)
    state = cluster_files(spark, str(data), states, K)
    assert state.rounds == plain.rounds
    assert _clusters({r.point_id: r.cluster_id for r in state.assignment().collect()}) == _clusters(plain.assignment())


def test_a_stream_goes_on_after_a_restart(spark, tmp_path, chunks, plain):
    data, states, check = tmp_path / "data", f"file://{tmp_path}/states", str(tmp_path / "check")
    data.mkdir()
    for n in (2, 3):
        _write(data, chunks[n - 1 : n] if n == 3 else chunks[:1])
        if n == 2:
            cluster_stream(spark, str(data), states, check, K).awaitTermination(240)
            (data / "chunk-1.txt").write_text("\n".join(",".join(map(str, [p, *x])) for p, x in chunks[1]) + "\n")
        else:
            (data / "chunk-0.txt").unlink()
            (data / "chunk-2.txt").write_text("\n".join(",".join(map(str, [p, *x])) for p, x in chunks[2]) + "\n")
        cluster_stream(spark, str(data), states, check, K).awaitTermination(240)
    assert streamed_state(spark, states, 3, K).rounds == plain.rounds
