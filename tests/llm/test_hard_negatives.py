"""Hard negatives against a plain version, and what zone maps leave unread."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.llm import hard_negatives as hn
from tidegate.plans.staging import staged


def plain(rows, every, k=5, m=3):
    """rows: (key, label, vector) -> the rows of the operator, from all scores."""
    rows = [(i, key, label, [math.floor(256.0 * x) for x in v]) for i, (key, label, v) in enumerate(rows)
            if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, key, label, v in rows:
        if key is None or key % every:
            continue
        scored = [(-sum(map(int.__mul__, v, w)), other is None, other or 0, j, l == label) for j, other, l, w in rows if j != i and len(w) == len(v)]
        scored.sort()
        clear = lambda s: None if s[1] else s[2]
        for p in [s for s in scored if s[4]][:k]:
            fit = [s for s in scored if not s[4] and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:m]
            out += [(key, clear(p), r + 1, clear(s), -p[0], -s[0]) for r, s in enumerate(fit)]
    return sorted(out, key=repr)


def mined(spark, rows, every, parts=4):
    table = spark.createDataFrame([(k, l, v, "a", 1) for k, l, v in rows],
                                  "vec_id long, label int, embedding array<double>, block string, size int").repartition(parts)
    got = hn.hard_negatives(table, table.vec_id % every == 0)
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("BLOCK_ROWS", 16), ("PACK", 4), ("PAGE", 3), ("PARTS", 3)):
        monkeypatch.setattr(hn, name, value)


def test_like_the_plain_version(spark, small_blocks):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 4)), [round(float(x), 3) for x in rng.normal(0, 1, 5) + 0.6]) for i in range(240)]
    rows += [(i, 1, [0.5, 0.5, 0.5, 0.5, 0.5]) for i in range(240, 300)]  # a crowd of copies
    rows += [(i, i % 3, [1.0, -2.0]) for i in range(300, 312)] + [(i, 0, []) for i in range(315, 320)]
    rows += [(320, 0, [0.0] * 5), (320, 2, [0.4] * 5), (325, None, [0.4] * 5), (330, 1, None), (335, 1, [None, 1.0, 1.0, 1.0, 1.0]),
             (340, 1, [float("nan")] * 5), (345, 1, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (None, 1, [0.6] * 5), (None, 2, [0.45] * 5), (350, 2, [3.0e6] * 5),
             (355, -7, [0.7] * 5), (360, 1, [1.0, 2.0, 3.0])]
    assert mined(spark, rows, 5) == plain(rows, 5)


def test_no_anchor_and_no_rows(spark):
    assert mined(spark, [(1, 1, [1.0]), (2, 2, [1.0])], 5) == []
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    got = hn.hard_negatives(empty, empty.vec_id % 5 == 0)
    assert got.count() == 0 and got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_scores_of_any_size():
    for scale in (1, 2**20, 2**30, 2**40):
        a, b = (np.floor(np.random.default_rng(s).normal(0, scale, (3, 7))) for s in (1, 2))
        want = [[min(max(sum(int(x) * int(y) for x, y in zip(p, q)), hn._LOW), hn._HIGH) for q in b] for p in a]
        assert hn.exact_scores(a, b).tolist() == want
        low, high = hn.score_bounds(a, b.min(0)[None], b.max(0)[None])
        assert all(low[i, 0] <= s <= high[i, 0] for i in range(3) for s in want[i])


def test_neighbours_on_the_curve_are_neighbours():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    at = hn.hilbert(grid, 3)
    assert sorted(at.tolist()) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(at)], axis=0)).sum(1) == 1).all()


def test_zone_maps_leave_most_blocks_of_clusters_unread(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (40, 32))
    rows = [(i, i % 40, (centres[i % 40] + rng.normal(0, 0.05, 32)).tolist()) for i in range(4_000)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    placed = staged(hn.place_rows(table, F.col("vec_id") % 50 == 0, key="vec_id", label="label", vector="embedding", scale=256.0), "t")
    blocks = staged(hn.build_blocks(placed), "t")
    anchors = hn.find_anchors(blocks, 5).withColumn("limits", F.array("bound"))
    need = hn.needed_blocks(anchors, "limits", staged(hn.build_pages(blocks), "t"), hn.same_label_above)
    read = need.select(F.sum(F.length("a") / 8)).first()[0]
    assert read <= 0.1 * anchors.count() * blocks.count()
