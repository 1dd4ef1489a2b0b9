"""The merge hierarchy of random frames against floods of every contour level."""

import numpy as np
import pytest

from trackweave.operators import segmentation
from trackweave.plans.config import SegmentationConfig

SIDE = 24


def flood(mask):
    """The 4-connected components of a mask, as sets of (y, x)."""
    left, found = set(zip(*np.nonzero(mask), strict=True)), []
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            y, x = todo.pop()
            for p in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if p in left:
                    left.remove(p)
                    part.add(p)
                    todo.append(p)
        found.append(frozenset((int(y), int(x)) for y, x in part))
    return found


def plain_nodes(foreground, contour, config):
    """{pixels: (frontier, height, parent's pixels)}."""
    inside, before, nodes = foreground > config.threshold, [], {}
    for level in np.unique(contour[inside]):
        now = flood(inside & (contour <= level))
        for part in now:
            large = [b for b in before if b <= part and len(b) >= config.min_area]
            if len(large) > 1:
                nodes |= dict.fromkeys(large, float(level))
        before = now
    height = lambda part: max(float(contour[p]) for p in part)
    whole = [p for p in before if len(p) >= config.min_area]
    kept = {p: f for p, f in nodes.items() if len(p) <= config.max_area and f >= config.min_frontier}
    kept |= {p: height(p) for p in whole if len(p) <= config.max_area}
    around = {p: min((q for q in kept if p < q), key=len, default=None) for p in kept}
    return {p: (f, height(p), around[p]) for p, f in kept.items()}


@pytest.mark.parametrize("config", [SegmentationConfig(min_area=4), SegmentationConfig(min_area=6, max_area=90, min_frontier=3.0), SegmentationConfig(min_area=1)])
def test_hierarchies_by_tiles_and_of_whole_frames(spark, config):
    rng, frames, rows = np.random.default_rng(int(config.min_area)), {}, []
    for t in range(3):
        contour = rng.integers(0, 9, (SIDE, SIDE)).astype(float)
        if t:
            contour = np.round(sum(np.roll(contour, k, axis) for k in (-1, 0, 1) for axis in (0, 1)) / 6 * t, 1)
        foreground = (rng.random((SIDE, SIDE)) < 0.75).astype(float)
        frames[t] = foreground, contour
        rows += [(t, y, x, float(foreground[y, x]), float(contour[y, x])) for y in range(SIDE) for x in range(SIDE)]
    pixels = spark.createDataFrame(rows, "t int, y int, x int, foreground double, contour double")
    for tile in (5, 512) if config.max_area == 90 else (5,):
        made = segmentation.segment(pixels, SIDE, SIDE, config, tile=tile).collect()
        masks = {r["id"]: frozenset((q["y"], x) for q in r["runs"] for x in range(q["x0"], q["x0"] + q["len"])) for r in made}
        for t, (foreground, contour) in frames.items():
            own = [r for r in made if r["t"] == t]
            found = {masks[r["id"]]: (r["frontier"], r["height"], masks.get(r["hier_parent_id"])) for r in own}
            assert found == plain_nodes(foreground, contour, config) and len(found) == len(own) > 2
            assert all(r["area"] == len(masks[r["id"]]) and r["id"] == 1_000_000 * (t + 1) + r["t_node_id"] for r in own)
    assert segmentation.segment(pixels.limit(0), SIDE, SIDE, config).count() == 0
