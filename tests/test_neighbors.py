import re

import numpy as np
import pytest

from twinframe.operators import neighbors


def brute(points, sides, k):
    d = np.sqrt(((points[:, None, :] - points[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(points)), d.shape), d), axis=1)[:, :k]
    return d, order


def pair_of(spark, points, sides):
    rows = [(i, "synth" if s else "real", [float(v) for v in p]) for i, (p, s) in enumerate(zip(points, sides))]
    return spark.createDataFrame(rows, "id long, side string, z array<double>")


def cloud(seed, n, d, copies):
    """Random points of which a third are copies of one, and some come twice."""
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, d)) * ([3] + [1] * (d - 1))
    if copies:
        points[: n // 3] = points[0]
        points[n // 2 : n // 2 + 5] = points[n - 5 :]
    return points, rng.random(n) < 0.5


@pytest.fixture(params=[4096, 20], ids=["one block", "many blocks"])
def block(request, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK", request.param)
    monkeypatch.setattr(neighbors, "TILE", 16)


@pytest.mark.parametrize("copies", [False, True])
def test_pooled_neighbours_equal_brute_force(spark, block, copies):
    points, sides = cloud(1, 150, 3, copies)
    d, order = brute(points, sides, 4)
    got = neighbors.knn_pooled(pair_of(spark, points, sides), "id", 4).collect()
    assert len(got) == 150 * 4
    for r in got:
        j = order[r["id"], r["rank"] - 1]
        assert (r["neighbor"], r["same_side"]) == (j, sides[j] == sides[r["id"]])
        assert r["dist"] == pytest.approx(d[r["id"], j], abs=1e-12)


@pytest.mark.parametrize("copies", [False, True])
def test_snn_and_dcr_equal_brute_force(spark, block, copies):
    points, sides = cloud(2, 140, 4, copies)
    d, order = brute(points, sides, 5)
    pair = pair_of(spark, points, sides)
    other = (sides[order] != sides[:, None]).mean(axis=1)
    got = neighbors.snn_of_vectors(pair, "id", 5).first()
    assert got["snn_real"] == pytest.approx(other[~sides].mean(), abs=1e-12)
    assert got["snn_synth"] == pytest.approx(other[sides].mean(), abs=1e-12)
    assert (got["n_real"], got["n_synth"]) == ((~sides).sum(), sides.sum())

    to_real, among = d[sides][:, ~sides].min(axis=1), d[~sides][:, ~sides].min(axis=1)
    got = neighbors.dcr_of_vectors(pair, "id").first()
    assert got["dcr_synth_to_real_median"] == pytest.approx(np.median(to_real), abs=1e-12)
    assert got["dcr_synth_to_real_5th"] == pytest.approx(np.percentile(to_real, 5), abs=1e-12)
    assert got["dcr_synth_to_real_mean"] == pytest.approx(to_real.mean(), abs=1e-12)
    assert got["dcr_real_to_real_median"] == pytest.approx(np.median(among), abs=1e-12)


def test_nearest_real_record(spark, block):
    points, sides = cloud(3, 120, 2, True)
    d, _ = brute(points, sides, 1)
    real = np.flatnonzero(~sides)
    for r in neighbors.dcr_nearest(pair_of(spark, points, sides), "id").collect():
        row = d[r["id"]][real]
        assert r["neighbor"] == real[np.argmin(row)]
        assert r["dist"] == pytest.approx(row.min(), abs=1e-12)


def test_leave_one_out_finds_another_record(spark, block):
    points, sides = cloud(4, 90, 2, True)
    got = neighbors.dcr_leave_one_out(pair_of(spark, points, sides), "id").collect()
    assert len(got) == (~sides).sum()
    assert all(r["id"] != r["neighbor"] and not sides[r["neighbor"]] for r in got)


def test_copies_of_real_rows_have_distance_zero(spark):
    points = np.array([[0.0], [1.0], [5.0], [0.0], [1.0], [5.0]])
    got = neighbors.dcr_of_vectors(pair_of(spark, points, np.arange(6) >= 3), "id").first()
    assert got["dcr_synth_to_real_median"] == 0 and got["dcr_real_to_real_median"] == 1.0


def test_duplicated_real_rows_give_an_infinite_ratio(spark):
    points = np.array([[0.0], [0.0], [5.0], [5.0], [1.0], [2.0]])
    got = neighbors.dcr_of_vectors(pair_of(spark, points, np.arange(6) >= 4), "id").first()
    assert got["dcr_real_to_real_median"] == 0 and got["dcr_ratio"] == float("inf")


def test_separated_clusters_never_mix(spark):
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(size=(20, 2)), rng.normal(size=(20, 2)) + 100])
    got = neighbors.snn_of_vectors(pair_of(spark, points, np.arange(40) >= 20), "id", 5).first()
    assert got["snn_mean"] == 0 and got["deviation"] == 0.5


def test_empty_side(spark):
    pair = pair_of(spark, np.arange(10.0)[:, None], np.zeros(10, bool))
    got = neighbors.dcr_of_vectors(pair, "id").first()
    assert got["dcr_synth_to_real_median"] is None and got["n_synth"] == 0
    assert neighbors.snn_of_vectors(pair, "id").first()["n_synth"] == 0


def test_subsample_bounds_both_sides(spark, data):
    from twinframe.sources.views import HOUSEHOLD_CATEGORICAL, HOUSEHOLD_NUMERIC, pair_household

    pair = pair_household(spark, data)
    got = neighbors.snn(pair, "c_custkey", HOUSEHOLD_NUMERIC, HOUSEHOLD_CATEGORICAL, subsample=30).first()
    assert (got["n_real"], got["n_synth"]) == (30, 30)
    both = neighbors.inter_record(pair, "c_custkey", HOUSEHOLD_NUMERIC, HOUSEHOLD_CATEGORICAL).collect()
    assert {r["family"] for r in both} == {"snn", "dcr"} and len(both) == 14


def test_both_sides_may_use_the_same_ids(spark, block):
    points, _ = cloud(3, 120, 3, True)
    sides = np.arange(120) % 2 == 1
    apart = pair_of(spark, points, sides)
    shared = apart.selectExpr("id div 2 as id", "side", "z")
    assert neighbors.snn_of_vectors(shared, "id", 5).first() == neighbors.snn_of_vectors(apart, "id", 5).first()
    assert neighbors.dcr_of_vectors(shared, "id").first() == neighbors.dcr_of_vectors(apart, "id").first()
    d = np.sort(np.where(np.eye(120, dtype=bool), np.inf, np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))), axis=1)
    got = neighbors.knn_pooled(shared, "id", 4).collect()
    assert len(got) == 120 * 4
    for r in got:
        assert r["dist"] == pytest.approx(d[2 * r["id"] + (r["side"] == "synth"), r["rank"] - 1], abs=1e-12)


def test_queries_travel_packed(spark, monkeypatch):
    """A query visiting many blocks is not copied to each of them: groups of queries meet runs of blocks."""
    monkeypatch.setattr(neighbors, "BLOCK", 20)
    monkeypatch.setattr(neighbors, "TILE", 16)
    points = np.random.default_rng(7).normal(size=(300, 16))
    sides = np.arange(300) % 2 == 1
    made = []
    search = neighbors._search_far

    def watched(bounded, placed, *rest):
        made.append(search(bounded, placed, *rest))
        return made[-1]

    monkeypatch.setattr(neighbors, "_search_far", watched)
    d, order = brute(points, sides, 3)
    got = neighbors.knn_pooled(pair_of(spark, points, sides), "id", 3).collect()
    assert len(got) == 900 and all(r["neighbor"] == order[r["id"], r["rank"] - 1] for r in got)
    assert made and made[0].columns == ["query", "dist", "neighbor", "synth"]


@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e20])
def test_close_pairs_are_measured_in_full(scale):
    """Short numbers only choose: far from the origin and at any scale the pairs are those of full distances."""
    rng = np.random.default_rng(9)
    points, targets = (rng.normal(size=(n, 8)) * scale + 1000 * scale for n in (60, 90))
    targets[:30] = points[:30]
    targets[5, 2] = np.nan
    away = neighbors._pivot_distances(points, targets)
    bounds = np.sort(np.where(np.isnan(away), np.inf, away), axis=1)[:, 4]
    point, target, dist = neighbors._close(points, targets, bounds, 5)
    with np.errstate(invalid="ignore"):
        assert sorted(zip(point, target)) == list(zip(*np.nonzero(away <= bounds[:, None])))
    assert (dist == away[point, target]).all()
    point, target, _ = neighbors._close(points, targets, np.full(60, np.inf), 5)
    with np.errstate(invalid="ignore"):
        assert set(zip(*np.nonzero(away <= bounds[:, None]))) <= set(zip(point, target))


def test_points_meet_only_the_tiles_they_may_find_something_in(monkeypatch):
    """Points of one tile apart from each other each visit their own tiles, not those of all."""
    tile = neighbors.TILE
    rng = np.random.default_rng(5)
    targets = np.concatenate([rng.random((tile, 3)) + 10 * i for i in range(8)])
    points = targets[:: tile // 4] + 0.01
    bounds = np.full(len(points), 0.3)
    compared = []
    close = neighbors._close

    def counted(some, others, *rest):
        compared.append(len(some) * len(others))
        return close(some, others, *rest)

    monkeypatch.setattr(neighbors, "_close", counted)
    asks = np.arange(1, len(points))
    found = {(int(p), int(t)) for q, v, _ in neighbors._in_block(points, bounds, asks, targets, 3) for p, t in zip(q, v)}
    away = neighbors._pivot_distances(points, targets)
    assert found == {(int(p), int(t)) for p, t in np.argwhere(away <= 0.3) if p}
    assert sum(compared) == len(asks) * tile


def test_points_meet_whole_blocks_where_boxes_leave_nothing_out():
    rng = np.random.default_rng(6)
    targets, points = rng.normal(size=(600, 16)), rng.normal(size=(70, 16))
    targets[5, 2] = np.nan
    bounds = np.where(np.arange(70) % 2, np.inf, 4.0)
    kept = {}
    for query, vector, dist in neighbors._in_block(points, bounds, np.arange(70), targets, 600):
        kept |= {(int(p), int(t)): d for p, t, d in zip(query, vector, dist)}
    away = neighbors._pivot_distances(points, targets)
    assert kept == {(int(p), int(t)): away[p, t] for p, t in np.argwhere(away <= bounds[:, None])}
    assert not list(neighbors._in_block(points, bounds, np.arange(0), targets, 3))


def test_a_block_is_made_ready_once_for_all_its_points(monkeypatch):
    """Targets are centered and rounded once a block, not once for every tile of points that meets it."""
    rng = np.random.default_rng(11)
    targets, points = rng.normal(size=(500, 16)), rng.normal(size=(5 * neighbors.TILE, 16))
    made = []
    ready = neighbors.Ready
    monkeypatch.setattr(neighbors, "Ready", lambda some: made.append(len(some)) or ready(some))
    found = list(neighbors._in_block(points, np.full(len(points), 3.0), np.arange(len(points)), targets, 4))
    away = neighbors._pivot_distances(points, targets)
    pairs = {(int(p), int(t)) for q, v, _ in found for p, t in zip(q, v)}
    assert pairs == set(map(tuple, np.argwhere(away <= 3.0).tolist())) and len(found) == 5 and made == [500]


@pytest.mark.parametrize("pairs", [1, 2, 300])
def test_pairs_are_measured_as_pivots_are(monkeypatch, pairs):
    """To the last bit, and a bounded run of pairs at a time."""
    monkeypatch.setattr(neighbors, "MEASURED", 64 * 7)
    rng = np.random.default_rng(12)
    points, targets = rng.normal(size=(40, 64)), rng.normal(size=(50, 64))
    point, target = rng.integers(0, 40, pairs), rng.integers(0, 50, pairs)
    assert (neighbors._measured(points, targets, point, target) == neighbors._pivot_distances(points, targets)[point, target]).all()


def test_small_tables_are_dealt_over_all_cores():
    for asked, blocks in ((26, 40), (150, 270), (9, 9)):
        group, run = neighbors._task_shape(asked, blocks, 12)
        assert group == 1 or -(-asked // group) * -(-blocks // run) >= 48
    assert neighbors._task_shape(1500, 2700, 12) == (neighbors.GROUP, neighbors.RUN)


def test_a_table_searched_in_itself_is_assigned_once(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK", 20)
    points, sides = cloud(13, 90, 3, True)
    made = []
    assign = neighbors._assign
    monkeypatch.setattr(neighbors, "_assign", lambda rows, pivots: made.append(1) or assign(rows, pivots))
    d, order = brute(points, sides, 2)
    got = neighbors.knn_pooled(pair_of(spark, points, sides), "id", 2).collect()
    assert len(got) == 180 and all(r["neighbor"] == order[r["id"], r["rank"] - 1] for r in got) and len(made) == 1


def test_equal_vectors_meet_however_they_are_written(spark):
    """Keys by hash tell apart what equality tells apart, and nothing else: zeros, not-a-numbers and missing parts."""
    nan = float("nan")
    rows = [[0.0, 1.0], [-0.0, 1.0], [nan, 1.0], [-nan, 1.0], [None, 1.0], [1.0, None], [0.0, 1.0]]
    pair = spark.createDataFrame([(i, "real", z) for i, z in enumerate(rows)], "id long, side string, z array<double>")
    vectors = neighbors.distinct_vectors(pair, 5)
    assert sorted([m["id"] for m in r["members"]] for r in vectors.collect()) == [[0, 1, 6], [2, 3], [4], [5]]
    answers = vectors.select("z", "n_real")
    assert {r["id"]: r["n_real"] for r in neighbors._to_rows(pair, answers).collect()} == {0: 3, 1: 3, 2: 2, 3: 2, 4: 1, 5: 1, 6: 3}
    plan = vectors._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"Window \[.*\], \[_h#\d+L, ", plan)
