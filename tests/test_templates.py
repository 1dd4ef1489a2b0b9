"""Usual areas of frames, and the match by them, against plain loops and the best of all matches."""

import itertools
import math
import random
from collections import Counter, defaultdict

import pytest

from trackweave.operators import pixels, solving


def plain_peaks(areas, n=5, apart=25):
    counts = Counter(math.floor(math.log2(a) * 100 + 1e-12) for a in areas if a and a >= 1)
    if not counts:
        return []
    smooth = {b: sorted(counts.get(b + k, 0) for k in range(-2, 3))[2] for b in range(max(counts) + 3)}
    best = [b for b, v in smooth.items() if v and all((smooth.get(o, 0), -o) <= (v, -b) for o in range(b - apart, b + apart + 1))]
    used = [a for a in areas if a and a >= 1]
    return [2 ** (b / 100) for b in sorted(best, key=lambda b: (-smooth[b], b))[:n]] or [float(sum(used) // len(used))]


def test_peaks_of_frames(spark):
    rng, frames = random.Random(4), {}
    for t in range(12):
        middles = [rng.uniform(20, 3000) for _ in range(rng.randint(1, 8))]
        frames[t] = [int(rng.choice(middles) * rng.uniform(0.98, 1.02)) for _ in range(400)] + [None, 0]
    frames[12], frames[13] = [7, 500], [None]
    rows = [(t, a) for t, areas in frames.items() for a in areas]
    found = defaultdict(list)
    for r in pixels.frame_peaks(spark.createDataFrame(rows, "t int, area int")).collect():
        found[r["t"]].append(r["peak"])
    assert 13 not in found and found[12] == [253.0]
    for t, areas in frames.items():
        assert sorted(found[t]) == pytest.approx(sorted(plain_peaks(areas)))
    assert any(len(x) > 1 for x in found.values()) and pixels.frame_peaks(spark.createDataFrame([], "t int, area int")).count() == 0


def frame(seed):
    """(areas of nodes, weights of pairs, overlapping nodes, peaks)."""
    rng = random.Random(seed)
    areas = {100 * seed + i: rng.choice([20, 40, 41, 80]) + rng.randint(0, 2) for i in range(5)}
    pairs = {(i, g): float(rng.randint(1, 60)) for i in areas for g in range(1, 4) if rng.random() < 0.6}
    clashes = {p for p in itertools.combinations(areas, 2) if rng.random() < 0.3}
    return areas, pairs, clashes, [20.0, 40.0, 80.0]


def values(areas, pairs, peak):
    return {(i, g): w - 1e-3 + max(areas.values()) - abs(peak - areas[i]) for (i, g), w in pairs.items()}


def fits(taken, i, g, clashes):
    return all(i != a and g != b and (i, a) not in clashes and (a, i) not in clashes for a, b in taken)


def plain(areas, pairs, clashes, peaks):
    """The best links first, for each template; the template that is worth the most, of equal ones the smallest."""
    found = []
    for peak in peaks:
        value, taken = values(areas, pairs, peak), []
        for i, g in sorted(value, key=lambda p: (-value[p], p[0], -p[1])):
            if value[i, g] > 0 and fits(taken, i, g, clashes):
                taken.append((i, g))
        found.append((round(sum(value[p] for p in taken), 6), -peak, sorted(taken)))
    return max(found)


def best(areas, pairs, clashes, peaks):
    def search(left, taken, value):
        worth = sum(value[p] for p in taken)
        return max([worth] + [search(left[k + 1 :], [*taken, p], value) for k, p in enumerate(left) if value[p] > 0 and fits(taken, *p, clashes)])

    return max(search(list(pairs), [], values(areas, pairs, peak)) for peak in peaks)


def test_match_by_area(spark, one_partition):
    frames = {t: frame(t) for t in range(40)}
    nodes = spark.createDataFrame([(i, t, a) for t, f in frames.items() for i, a in f[0].items()], "id long, t int, area int")
    pairs = spark.createDataFrame([(t, i, g, w) for t, f in frames.items() for (i, g), w in f[1].items()], "t int, source_id long, target_id long, weight double")
    overlaps = spark.createDataFrame([p for f in frames.values() for p in f[2]], "node_id long, ancestor_id long")
    peaks = spark.createDataFrame([(t, p) for t, f in frames.items() for p in f[3]], "t int, peak double")
    found = defaultdict(list)
    for r in solving.match_frames_by_area(pairs, overlaps, nodes, peaks).collect():
        found[r["t"], r["peak"]].append((r["source_id"], r["target_id"]))
    want = {t: plain(*f) for t, f in frames.items()}
    assert {k: sorted(v) for k, v in found.items()} == {(t, -peak): taken for t, (_, peak, taken) in want.items() if taken}
    assert len({peak for _, peak in found}) == 3
    share = sum(w for w, _, _ in want.values()) / sum(best(*f) for f in frames.values())
    print("of the best:", share)
    assert share > 0.9
    assert solving.match_frames_by_area(pairs.limit(0), overlaps, nodes, peaks).count() == 0
