"""Forests, gap closing and stitching over random tracks, against plain versions."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from trackweave.operators import assigning, lineage, tracks

TRACKS = "track_id long, t int, z double, y double, x double, parent_track_id long"


def random_forest(seed, n=40):
    """(track, parent) of trees in which a track has two children or none."""
    rng = random.Random(seed)
    ids = rng.sample(range(1, 500), n)
    parent, leaves = {}, []
    while ids:
        if len(ids) == 1 or not leaves or rng.random() < 0.25:
            k = ids.pop()
            parent[k] = -1
            leaves.append(k)
        else:
            p = leaves.pop(rng.randrange(len(leaves)))
            for k in (ids.pop(), ids.pop()):
                parent[k] = p
                leaves.append(k)
    return parent


@pytest.mark.parametrize("seed", [1, 2])
def test_forests_against_a_walk(spark, seed):
    parent = random_forest(seed)
    below = defaultdict(list)
    for k, p in sorted(parent.items()):
        below[p].append(k)
    walk = lambda k: [k, *itertools.chain(*map(walk, below[k]))]
    inner = lambda k: [*inner(below[k][0]), k, *inner(below[k][1])] if below[k] else [k]
    root = lambda k: k if parent[k] == -1 else root(parent[k])
    df = spark.createDataFrame([(k, t, 0.0, float(k), float(t), p) for k, p in parent.items() for t in range(2)], TRACKS)
    some = random.Random(seed).sample(list(parent), 3)
    found = lambda x: sorted(r["track_id"] for r in x.select("track_id").distinct().collect())
    assert found(lineage.subgraph(df, some)) == sorted({x for k in some for x in walk(root(k))})
    assert found(lineage.subgraph(df, [1000])) == []
    for k in (some[0], root(some[1])):
        assert found(lineage.subtree(df, k)) == sorted(walk(k))
    made = defaultdict(list)
    for r in sorted(lineage.inorder(df).collect(), key=lambda r: (r["root_id"], r["position"])):
        made[r["root_id"]].append(r["track_id"])
    assert made == {k: inner(k) for k in below[-1]}
    assert {r["track_id"]: r["root_id"] for r in lineage.track_roots(df).collect()} == {k: root(k) for k in parent}


def test_track_ids_of_random_graphs(spark):
    """A track goes on while a node has one child; both children of a division start tracks below it."""
    rng = random.Random(6)
    parent, open_ = {}, []
    for k in range(120):
        p = open_.pop(rng.randrange(len(open_))) if open_ and rng.random() < 0.9 else -1
        parent[k] = p
        open_ += [k] if rng.random() < 0.8 else [k, k]
    children = defaultdict(list)
    for k, p in parent.items():
        children[p].append(k)
    head = lambda k: head(parent[k]) if parent[k] != -1 and len(children[parent[k]]) == 1 else k
    made = {r["id"]: (r["track_id"], r["parent_track_id"]) for r in lineage.add_track_ids(spark.createDataFrame(list(parent.items()), "id long, parent_id long")).collect()}
    assert {frozenset(k for k in parent if made[k][0] == x) for x, _ in made.values()} == {frozenset(k for k in parent if head(k) == h) for h in map(head, parent)}
    assert all(made[k][1] == (-1 if parent[head(k)] == -1 else made[parent[head(k)]][0]) for k in parent)
    assert {x for x, _ in made.values()} == set(range(1, len({head(k) for k in parent}) + 1))


def best_assignment(a, b):
    """(i, j) of points a and b at least total distance, by trying all."""
    if len(a) > len(b):
        return [(i, j) for j, i in best_assignment(b, a)]
    cost = np.sqrt(((np.array(a)[:, None] - np.array(b)[None]) ** 2).sum(axis=2)) if a else np.zeros((0, 0))
    return list(enumerate(min(itertools.permutations(range(len(b)), len(a)), key=lambda p: sum(cost[i, j] for i, j in enumerate(p)))))


def test_least_total_of_near_columns():
    """As little as over all columns, with ties, lone axes and rows far off; a row looks at the columns near by."""
    rng = np.random.default_rng(2)
    for k in range(200):
        m = int(rng.integers(1, 40))
        n = int(rng.integers(1, m + 1))
        a, b = ((rng.integers(0, 6, (c, 3)) if k % 3 == 0 else rng.normal(0, 1, (c, 3)) if k % 3 == 1 else np.stack([np.zeros(c), np.ones(c), rng.integers(0, 3, c)], 1)).astype(float) for c in (n, m))
        if k % 5 == 0:
            a, b = a + 100.0, (b * 0 + 1 if k % 2 else b)
        cost = np.sqrt(((b[None] - a[:, None]) ** 2).sum(axis=2))
        wanted, found = assigning.least_total(n, m, lambda row, cost=cost: cost[row]), assigning.least_total_near(a, b)
        assert len(set(found.tolist())) == n and abs(cost[np.arange(n), wanted].sum() - cost[np.arange(n), found].sum()) < 1e-9


def test_equal_points_are_sent_at_once(monkeypatch):
    """Copies of a few spots cost what the spots cost, and the total is that of all points one by one."""
    rng, sizes, sent = np.random.default_rng(5), [], assigning._sent

    def counted(points, units, others, room):
        sizes.append((len(points), len(others), units.sum(), room.sum()))
        return sent(points, units, others, room)

    monkeypatch.setattr(assigning, "_sent", counted)
    a, b = rng.random((12, 3))[rng.integers(0, 12, 150)], rng.random((30, 3))[rng.integers(0, 30, 200)]
    cost = np.sqrt(((a[:, None] - b) ** 2).sum(axis=2))
    found, wanted = assigning.least_total_near(a, b), assigning.least_total(len(a), len(b), lambda k: cost[k])
    rows = np.arange(len(a))
    assert len(set(found.tolist())) == len(a) and found.min() >= 0
    assert cost[rows, found].sum() == pytest.approx(cost[rows, wanted].sum())
    assert sizes == [(len(np.unique(a, axis=0)), len(np.unique(b, axis=0)), 150, 200)]


def test_least_total():
    rng = np.random.default_rng(3)
    for n, m in [(1, 1), (3, 3), (4, 6), (5, 5), (6, 7)] * 6:
        cost = rng.uniform(0, 1, (n, m)) if rng.random() < 0.7 else rng.integers(0, 4, (n, m)).astype(float)
        found = assigning.least_total(n, m, lambda k, cost=cost: cost[k])
        best = min(sum(cost[a, b] for a, b in enumerate(p)) for p in itertools.permutations(range(m), n))
        assert len(set(found.tolist())) == n and cost[np.arange(n), found].sum() == pytest.approx(best)


def test_many_points_of_one_frame(spark):
    """Shifted by less than half the way to their neighbours, all points find themselves, without a matrix in memory."""
    n, rng = 2_500, np.random.default_rng(1)
    points = [(k, 0, 0.0, float(4 * (k // 50)), float(4 * (k % 50))) for k in rng.permutation(n).tolist()]
    moved = [(k + n, t, z, y + a, x + b) for (k, t, z, y, x), a, b in zip(points, rng.uniform(-0.9, 0.9, n).tolist(), rng.uniform(-0.9, 0.9, n).tolist(), strict=True)]
    schema = "id long, t int, z double, y double, x double"
    found = assigning.assigned(spark.createDataFrame(points, schema), spark.createDataFrame(moved, schema), "t").collect()
    assert len(found) == n and all(r["right_id"] == r["left_id"] + n for r in found)


def random_tracks(seed, n=30, frames=9, size=12.0):
    rng = random.Random(seed)
    made, ids = [], rng.sample(range(1, 200), n)
    for k in ids:
        t, y, x = rng.randrange(frames), rng.uniform(0, size), rng.uniform(0, size)
        for step in range(rng.randrange(1, 4)):
            made.append((k, t + step, 0.0, y + step * rng.uniform(-1, 1), x + step * rng.uniform(-1, 1), -1))
    # Some tracks that start later than another one's end become its children, two by two.
    end = {k: max(t for i, t, *_ in made if i == k) for k in ids}
    start = {k: min(t for i, t, *_ in made if i == k) for k in ids}
    parents = {}
    for p in ids[:4]:
        late = [k for k in ids[4:] if start[k] == end[p] + 1 and k not in parents]
        parents |= dict.fromkeys(late[:2], p) if len(late) > 1 else {}
    return [(*r[:5], parents.get(r[0], -1)) for r in made]


def ends_and_starts(rows):
    parents = {r[5] for r in rows}
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    ends = {k: max(v, key=lambda r: r[1]) for k, v in by.items() if k not in parents}
    return ends, {k: min(v, key=lambda r: r[1]) for k, v in by.items() if v[0][5] == -1}


def plain_closed(rows, max_gap, radius):
    ends, starts = ends_and_starts(rows)
    before, added = {}, []
    for gap in range(1, max_gap + 1):
        for t in {r[1] for r in ends.values()}:
            a = [r for k, r in sorted(ends.items()) if r[1] == t and k not in before.values()]
            b = [r for k, r in sorted(starts.items()) if r[1] == t + gap + 1 and k not in before]
            for i, j in best_assignment([r[2:5] for r in a], [r[2:5] for r in b]) if a and b else []:
                way = [q - p for p, q in zip(a[i][2:5], b[j][2:5], strict=True)]
                if sum(w * w for w in way) ** 0.5 < radius:
                    before[b[j][0]] = a[i][0]
                    added += [(b[j][0], t + k, *(p + w * k / (gap + 1) for p, w in zip(a[i][2:5], way, strict=True)), -1) for k in range(1, gap + 1)]
    first = lambda k: first(before[k]) if k in before else k
    parent = {r[0]: r[5] for r in rows}
    made = [(first(r[0]), *r[1:5], -1 if parent[first(r[0])] == -1 else first(parent[first(r[0])])) for r in rows + added]
    return sorted((k, t, *(round(c, 6) for c in (z, y, x)), p) for k, t, z, y, x, p in made), before


@pytest.mark.parametrize("seed, radius", [(1, 5.0), (2, 5.0), (3, 300.0)])
def test_gap_closing(spark, seed, radius):
    rows = random_tracks(seed)
    want, joins = plain_closed(rows, 3, radius)
    made = tracks.close_gaps(spark.createDataFrame(rows, TRACKS), 3, radius).collect()
    assert sorted((r["track_id"], r["t"], *(round(r[c], 6) for c in "zyx"), r["parent_track_id"]) for r in made) == want
    assert joins and len(want) > len(rows)


def test_gap_closing_takes_the_least_total(spark):
    """One join of 1 and one of 11 is less than joins of 5 and 9, though the radius keeps only the first of them."""
    rows = [(1, 0, 0.0, 0.0, 0.0, -1), (2, 0, 0.0, 8.485, -2.0, -1), (3, 2, 0.0, 0.0, 1.0, -1), (4, 2, 0.0, 0.0, 5.0, -1)]
    made = tracks.close_gaps(spark.createDataFrame(rows, TRACKS), 1, 10.0)
    assert sorted((r["track_id"], r["t"]) for r in made.collect()) == [(1, 0), (1, 1), (1, 2), (2, 0), (4, 2)]
    assert tracks.close_gaps(spark.createDataFrame([], TRACKS), 2, 5.0).count() == 0


def plain_stitched(rows, limit, selected=None):
    ends, starts = ends_and_starts(rows)
    root, every = {r[0]: r[0] for r in rows}, {r[0]: r[5] for r in rows}
    for k in root:
        while every[root[k]] != -1:
            root[k] = every[root[k]]
    chosen, before = None if selected is None else set(selected), {}
    for t in sorted({r[1] for r in ends.values()}):
        a = [r for k, r in ends.items() if r[1] == t and (chosen is None or k in chosen)]
        b = [r for k, r in starts.items() if r[1] == t + 1 and (chosen is None or k not in chosen)]
        far = lambda p, q: sum((x - y) ** 2 for x, y in zip(p[2:5], q[2:5], strict=True)) ** 0.5
        nearest = [(*min((far(p, q), q[0]) for q in b), p[0]) for p in a if b]
        taken = {}
        for dist, start, end in sorted(nearest):
            if dist < limit and start not in taken:
                taken[start] = end
        before |= taken
        if chosen is not None:
            chosen |= {k for k in root if root[k] in taken}
    first = lambda k: first(before[k]) if k in before else k
    kept = [r for r in rows if chosen is None or r[0] in chosen]
    return sorted((first(r[0]), r[1], -1 if every[first(r[0])] == -1 else first(every[first(r[0])])) for r in kept), before


@pytest.mark.parametrize("seed", [4, 5])
def test_stitching(spark, seed):
    rows = random_tracks(seed, 40, size=6.0)
    df = spark.createDataFrame(rows, TRACKS)
    limit = tracks.drift(df, 0.99).head()[0]
    ids = sorted({r[0] for r in rows})
    for selected in (None, random.Random(seed).sample(ids, 12)):
        want, joins = plain_stitched(rows, limit, selected)
        chosen = None if selected is None else spark.createDataFrame([(k,) for k in selected], "track_id long")
        made = tracks.stitch_tracks(df, 0.99, chosen).collect()
        assert joins and sorted((r["track_id"], r["t"], r["parent_track_id"]) for r in made) == want
    assert not tracks.stitch_tracks(df.limit(0)).head(1)


def test_first_frame_tracks(spark):
    rows = random_tracks(7, 30, frames=4)
    first = [r for r in rows if r[1] == 0]
    markers = [(k, 0.0, 3.0 * k, 11.0 - 2.0 * k) for k in range(min(4, len(first)))]
    taken = {first[j][0] for _, j in best_assignment([m[1:] for m in markers], [r[2:5] for r in first])}
    parent = {r[0]: r[5] for r in rows}
    under = lambda k: k in taken or parent[k] != -1 and under(parent[k])
    df, table = spark.createDataFrame(rows, TRACKS), spark.createDataFrame(markers, "id long, z double, y double, x double")
    assert {r["track_id"] for r in tracks.first_frame_tracks(df, table).collect()} == {k for k in parent if under(k)}
    stitched, _ = plain_stitched(rows, tracks.drift(df, 0.99).head()[0], {k for k in parent if under(k)})
    assert sorted((r["track_id"], r["t"], r["parent_track_id"]) for r in tracks.first_frame_tracks(df, table, stitch=True).collect()) == stitched


def plain_siblings(rows, min_length):
    parent, n = {r[0]: r[5] for r in rows}, Counter(r[0] for r in rows)
    below = defaultdict(list)
    for k, p in parent.items():
        below[p].append(k)
    label, gone = {k: k for k in parent}, set()
    order = [*below[-1]]
    for k in order:
        order += below[k]
    kids = {k: list(below[k]) for k in parent}
    for k in reversed(order):
        short = [c for c in kids[k] if not kids[c] and n[c] <= min_length]
        if len(short) == 1:
            (other,) = set(kids[k]) - set(short)
            gone.add(short[0])
            label[other], kids[k] = k, kids[other]
            n[k] += n[other]
    last = lambda k: k if label[k] == k else last(label[k])
    up = {k: -1 if parent[k] == -1 else last(parent[k]) for k in parent}
    return sorted((last(r[0]), r[1], up[last(r[0])]) for r in rows if r[0] not in gone)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_short_siblings(spark, seed):
    parent, rng = random_forest(seed, 60), random.Random(seed)
    rows = [(k, t, 0.0, 0.0, 0.0, p) for k, p in parent.items() for t in range(rng.randrange(1, 7))]
    made = tracks.filter_short_siblings(spark.createDataFrame(rows, TRACKS), 3).collect()
    assert sorted((r["track_id"], r["t"], r["parent_track_id"]) for r in made) == plain_siblings(rows, 3)
    with pytest.raises(ValueError):
        tracks.filter_short_siblings(spark.createDataFrame([r for r in rows if r[5] == -1][:1] + [(9999, 0, 0.0, 0.0, 0.0, rows[0][0])], TRACKS), 3)


def test_short_siblings_of_a_long_chain(spark):
    """A tree 3,000 tracks high is done in a dozen rounds."""
    rng, rows = random.Random(5), []
    for k in range(3_000):
        rows.append((2 * k, 2 * k, 0.0, 0.0, 0.0, 2 * k - 2 if k else -1))
        rows += [(2 * k + 1, 2 * k + t, 0.0, 0.0, 0.0, 2 * k - 2 if k else -1) for t in range(rng.choice([1, 5]))]
    made = tracks.filter_short_siblings(spark.createDataFrame(rows, TRACKS), 3).collect()
    import sys

    sys.setrecursionlimit(20_000)
    assert sorted((r["track_id"], r["t"], r["parent_track_id"]) for r in made) == plain_siblings(rows, 3)
