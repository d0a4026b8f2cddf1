import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from blackspot import runtime
from blackspot.clustering import blocks, boxtree, groups, hierarchical as hier, mixture, points, seeding, spanning, squares, tiles
from blackspot.clustering.components import components
from blackspot.clustering.dbscan import dbscan, neighbor_counts
from blackspot.clustering.kmeans import assign, candidate_centers, kmeans, kmeans_with_status, lay_out, lloyd, summed
from blackspot.clustering.points import X_SHIFT, Y_SHIFT, place, positions
from partitions import same_partition


def sample(n, seed, hot=0, spread=0.02):
    """Clumps of points; ``hot`` of them share one position."""
    rng = np.random.default_rng(seed)
    c = rng.integers(0, 5, n)
    lat = rng.uniform(30, 30.6, 5)[c] + rng.normal(0, spread, n)
    lon = rng.uniform(-100.6, -100, 5)[c] + rng.normal(0, spread, n)
    lat[:hot], lon[:hot] = lat[0], lon[0]
    return np.round(lat, 6), np.round(lon, 6)


def labels_of(df, column):
    return [r[1] for r in sorted(df.select("Crash_ID", column).collect())]


def micro(lat, lon):
    return np.round(lon * 1e6).astype(int) + X_SHIFT, np.round(lat * 1e6).astype(int) + Y_SHIFT


def interleave(x, y):
    return sum((int(x) >> i & 1) << 2 * i | (int(y) >> i & 1) << 2 * i + 1 for i in range(31))


def lloyd_by_hand(lat, lon, per, rounds):
    x, y = micro(lat, lon)
    order = sorted(range(len(x)), key=lambda i: interleave(x[i], y[i]))
    centers = {}
    for j in range(len(x) // per):
        i = order[(j + 1) * per - 1]
        centers = {c: p for c, p in centers.items() if p != (x[i], y[i])} | {j: (x[i], y[i])}
    centers = centers or {0: (x[order[0]], y[order[0]])}
    ids = np.array(sorted(centers))
    at = np.array([centers[c] for c in ids])
    nearest = lambda: np.argmin((x[:, None] - at[None, :, 0]) ** 2 + (y[:, None] - at[None, :, 1]) ** 2, axis=1)
    for _ in range(rounds):
        a = nearest()
        for c in range(len(ids)):
            if (a == c).any():
                at[c] = x[a == c].sum() // (a == c).sum(), y[a == c].sum() // (a == c).sum()
    return [int(ids[c]) for c in nearest()]


@pytest.mark.parametrize("n,per,hot", [(1500, 25, 500), (400, 40, 0), (30, 250, 0)])
def test_kmeans_matches_brute_force(crashes, n, per, hot):
    lat, lon = sample(n, n, hot)
    df = crashes(lat, lon)
    got = labels_of(kmeans(df, per, 3, 0.0), "kmeans_cluster")
    assert got == lloyd_by_hand(lat, lon, per, 3)
    if hot:
        assert got == labels_of(kmeans(df.repartition(5, "Death_Cnt"), per, 3, 0.0), "kmeans_cluster")


def test_kmeans_says_whether_centres_rest(crashes):
    df = crashes(*sample(400, 4))
    assert not kmeans_with_status(df, 25, 1, 0.0)[1]
    rows, settled = kmeans_with_status(df, 25, 200, 0.0)
    assert settled and labels_of(rows, "kmeans_cluster") == labels_of(kmeans(df, 25, 400, 0.0), "kmeans_cluster")


def test_oversampled_seeds(spark, crashes):
    """As many seeds as clusters, cheaper than those of the curve, the same from any order of rows; weights of candidates count every crash."""
    lat, lon = sample(1500, 8, hot=300)
    x, y = micro(lat, lon)
    cost = lambda centers: min_distances(x, y, centers).sum()
    spots = lambda df: positions(place(df))
    df, per = crashes(lat, lon), 20
    seeds = lambda df: seeding.parallel_start(lay_out(spots(df)), per)[0].collect()
    got = seeds(df)
    assert len(got) == 1500 // per and sorted(c.cid for c in got) == list(range(1500 // per))
    assert sorted(got) == sorted(seeds(df.repartition(7, "Longitude")))
    curve = lloyd(spots(df), per, 0)[1].collect()
    assert cost([(c.cx, c.cy) for c in got]) < 0.9 * cost([(c.cx, c.cy) for c in curve])
    labels, centers, _ = lloyd(spots(df), per, 3, 0.0, seeding.parallel_start)
    at = {c.cid: (c.cx, c.cy) for c in centers.collect()}
    rows = labels.collect()
    best = min_distances(np.array([r.x for r in rows]), np.array([r.y for r in rows]), list(at.values()))
    assert sum(r.w for r in rows) == 1500 and [(r.x - at[r.cid][0]) ** 2 + (r.y - at[r.cid][1]) ** 2 for r in rows] == list(best)


def min_distances(x, y, centers):
    cx, cy = np.array(centers).T
    return ((x[:, None] - cx) ** 2 + (y[:, None] - cy) ** 2).min(axis=1)


@pytest.mark.parametrize("lat,lon,seeds", [([], [], 0), ([30.] * 40, [-100.] * 40, 1), ([30.] * 39 + [31.], [-100.] * 40, 2)])
def test_oversampled_seeds_of_few_positions(crashes, lat, lon, seeds):
    df = crashes(lat, lon)
    rows = kmeans(df, 10, start=seeding.parallel_start).collect()
    assert len(rows) == len(lat) and len({r.kmeans_cluster for r in rows}) == seeds


def test_reduction_takes_heavy_candidates_outright(spark):
    weights = [500, 300, *[5] * 40, 90]
    spots = spark.createDataFrame([(i, i, w, i) for i, w in enumerate(weights)], "x long, y long, w long, z long")
    picked = sorted(r.z for r in seeding.reduced(spots, 8).collect())
    assert len(picked) == 8 and {0, 1, 42} <= set(picked)
    assert [b - a for a, b in zip(picked[2:-1], picked[3:-1])] == [8] * 4


def test_rounds_move_a_row_per_tile_and_centre(spark, crashes, monkeypatch):
    """Tiles hold every position once, and what goes from them to the centres has a row per tile and centre, not per position."""
    monkeypatch.setattr(tiles, "TILE", 200)
    spots = positions(place(crashes(*sample(1500, 5, hot=300)))).cache()
    tiled = tiles.beside(tiles.tiles_of(lay_out(spots)), 30).cache()
    got = [(t.x0 + x, t.y0 + y, w) for t in tiled.collect() for x, y, w in zip(t.xs, t.ys, t.ws)]
    assert sorted(got) == sorted((r.x, r.y, r.w) for r in spots.collect())
    assert tiled.count() >= 6 and all(len(t.xs) <= 200 and t.x1 - t.x0 == max(t.xs) and t.y1 - t.y0 == max(t.ys) for t in tiled.collect())
    seeds = tiled.select(F.explode("hints").alias("cid")).distinct().select("cid", (F.col("cid") * 9000 + X_SHIFT - 100600000).alias("cx"), F.lit(Y_SHIFT + 30300000).cast("bigint").alias("cy"))
    sent = tiles.meet(tiled, candidate_centers(tiled, seeds), summed, "cid bigint, w bigint, sx bigint, sy bigint").collect()
    assert sum(r.w for r in sent) == 1500 and len({(r.tile, r.cid) for r in sent}) == len(sent) < spots.count() / 2
    at = sorted((c.cid, c.cx, c.cy) for c in seeds.collect())
    for r in assign(tiled, seeds).collect():
        assert (r.d2, r.cid) == min(((r.x - a) ** 2 + (r.y - b) ** 2, c) for c, a, b in at)


def mixture_by_hand(lat, lon, per, rounds, gain):
    x, y = (v.astype(float) for v in micro(lat, lon))
    start = np.array(lloyd_by_hand(lat, lon, per, 0))
    ids = sorted(set(start))
    r = (start[:, None] == np.array(ids)[None]).astype(float)
    before = None
    for step in range(rounds + 1):
        n = r.sum(0)
        mx, my = (r * x[:, None]).sum(0) / n, (r * y[:, None]).sum(0) / n
        dx, dy = x[:, None] - mx, y[:, None] - my
        xx, yy, xy = ((r * a * b).sum(0) / n for a, b in ((dx, dx), (dy, dy), (dx, dy)))
        xx, yy = xx + mixture.FLOOR, yy + mixture.FLOOR
        det = xx * yy - xy * xy
        d = np.log(n / len(x)) - np.log(2 * np.pi) - np.log(det) / 2 - (dx * dx * yy - 2 * dx * dy * xy + dy * dy * xx) / det / 2
        top = d.max(1, keepdims=True)
        mass = np.exp(d - top).sum(1, keepdims=True)
        now = (top + np.log(mass)).mean()
        if before is not None and now - before < gain or step == rounds:
            return [ids[k] for k in d.argmax(1)], {c: v for c, v in zip(ids, (np.exp(d - top) / mass).T)}
        before, r = now, np.exp(d - top) / mass


@pytest.mark.parametrize("n,per,hot,rounds", [(600, 60, 0, 100), (900, 50, 300, 100), (500, 40, 0, 2), (40, 250, 0, 100)])
def test_mixture_matches_brute_force(crashes, n, per, hot, rounds):
    lat, lon = sample(n, n + 1, hot)
    want, _ = mixture_by_hand(lat, lon, per, rounds, mixture.GAIN)
    assert labels_of(mixture.gmm(crashes(lat, lon), per, rounds), "gmm_cluster") == want


@pytest.mark.parametrize("n,per,hot", [(600, 60, 0), (500, 50, 200)])
def test_shares_of_components_match_brute_force(crashes, n, per, hot):
    lat, lon = sample(n, n + 1, hot)
    labels, want = mixture_by_hand(lat, lon, per, 100, mixture.GAIN)
    got = labels_of(mixture.shares(crashes(lat, lon), per), "gmm_shares")
    assert [s[0].component for s in got] == labels
    for i, listed in enumerate(got):
        found = {s.component: s.share for s in listed}
        assert len(found) == len(listed) and listed == sorted(listed, key=lambda s: (-s.share, s.component))
        assert abs(sum(found.values()) - 1) < 1e-14 and min(found.values()) >= mixture.LEAST_SHARE
        assert all(abs(found.get(c, 0.0) - v[i]) < 1e-9 for c, v in want.items())
    assert max(map(len, got)) > 1


def test_lists_of_shares_are_made_where_the_rows_are(crashes, monkeypatch):
    """No list passes a shuffle or a written table; the rows of a crowded tile are dealt out, some groups get none."""
    monkeypatch.setattr(tiles, "LABELLED", 7)
    lat, lon = sample(300, 11, 120)
    df = crashes(lat, lon).withColumn("Crash_ID", F.col("Crash_ID") % 250)
    written = []
    monkeypatch.setattr(points, "cut", lambda table, **kept: written.append(table.columns) or runtime.cut(table, **kept))
    got = mixture.shares(df, 30)
    assert not any("gmm_shares" in c for c in written)
    plan = got._jdf.queryExecution().explainString(got._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert not any(line.strip().startswith(("Input", "Arguments")) and "gmm_shares" in line for part in plan.split("\n\n") if ") Exchange" in part for line in part.splitlines())
    rows = got.select("Crash_ID", "Death_Cnt", "Latitude", "Longitude", "gmm_shares").collect()
    assert sorted(r[:4] for r in rows) == sorted(tuple(r) for r in df.select("Crash_ID", "Death_Cnt", "Latitude", "Longitude").collect())
    _, want = mixture_by_hand(lat, lon, 30, 100, mixture.GAIN)
    at = {(a, b): i for i, (a, b) in enumerate(zip(lat, lon))}
    for r in rows:
        found = {s.component: s.share for s in r.gmm_shares}
        assert all(abs(found.get(c, 0.0) - v[at[r.Latitude, r.Longitude]]) < 1e-9 for c, v in want.items())


def test_mixture_of_nothing(crashes):
    assert mixture.gmm(crashes([], [])).collect() == [] and mixture.shares(crashes([], [])).collect() == []


def dbscan_by_hand(lat, lon, eps, least):
    x, y = micro(lat, lon)
    near = [(x - x[i]) ** 2 + (y - y[i]) ** 2 <= eps * eps for i in range(len(x))]
    core = [m.sum() >= least for m in near]
    label, current = [-1] * len(x), 0
    for i in range(len(x)):
        if not core[i] or label[i] >= 0:
            continue
        label[i], stack = current, [i]
        while stack:
            for j in np.flatnonzero(near[stack.pop()]):
                if label[j] < 0:
                    label[j] = current
                    if core[j]:
                        stack.append(j)
        current += 1
    return label, [int(m.sum()) for m in near]


@pytest.mark.parametrize("leaf", [64, 2])
def test_dbscan_matches_brute_force(crashes, monkeypatch, leaf):
    monkeypatch.setattr(boxtree, "LEAF", leaf)
    lat, lon = sample(1200, 9, hot=400, spread=0.008)
    df = crashes(lat, lon)
    want, counts = dbscan_by_hand(lat, lon, 3000, 8)
    assert labels_of(neighbor_counts(df, 0.003), "neighbors") == counts
    assert labels_of(dbscan(df, 0.003, 8), "DBSCAN_cluster") == want
    assert len(set(want)) > 3 and -1 in want


@pytest.mark.parametrize("limit", [300, 60, 3])
def test_squares_are_divided_and_crowded_ones_left_to_trees(crashes, monkeypatch, limit):
    monkeypatch.setattr(blocks, "LIMIT", limit)
    monkeypatch.setattr(blocks, "PAIRS", 100)
    lat, lon = sample(700, 11, hot=100, spread=0.006)
    df = crashes(lat, lon)
    want, counts = dbscan_by_hand(lat, lon, 3000, 9)
    assert labels_of(neighbor_counts(df, 0.003), "neighbors") == counts
    assert labels_of(dbscan(df, 0.003, 9), "DBSCAN_cluster") == want
    assert len(set(want)) > 3 and -1 in want


def test_a_position_travels_to_few_squares(crashes):
    """Not to the 24 cells around its own."""
    rng = np.random.default_rng(8)
    spots = positions(place(crashes(np.round(rng.uniform(30, 31, 3000), 6), np.round(rng.uniform(-100, -99, 3000), 6)))).drop("z")
    dealt, crowded = blocks.deal(spots, 11, 3000)
    assert crowded is None and dealt.filter("home").count() == 3000
    assert dealt.count() < 1.4 * 3000
    assert links_of_line(spots.sparkSession) == [(0, 1), (0, 2)]


def links_of_line(spark):
    """Three cells in a line whose positions are 2,048 apart: two rows tie them together."""
    rows = [(2048 * i + 10, 10, 1, i, True) for i in range(3)]
    spots = spark.createDataFrame(rows, "x long, y long, w long, cell long, core boolean")
    found = blocks.links(blocks.deal(spots, 11, 3000)[0], 11, 3000)
    return sorted((r.root, r.cell) for r in found.collect())


def test_one_crowded_cell_is_opened_exactly(crashes):
    rng = np.random.default_rng(2)
    lat = np.round(np.r_[30 + rng.uniform(0, .002, 500), rng.uniform(29.98, 30.02, 1000)], 6)
    lon = np.round(np.r_[-100 + rng.uniform(0, .002, 500), rng.uniform(-100.02, -99.98, 1000)], 6)
    want, counts = dbscan_by_hand(lat, lon, 3000, 20)
    df = crashes(lat, lon)
    assert labels_of(neighbor_counts(df), "neighbors") == counts
    assert labels_of(dbscan(df, min_samples=20), "DBSCAN_cluster") == want


def test_components_of_path_star_and_cycle(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(300)] + [(5000, 5001), (5001, 5002), (5002, 5000)]
    rng = np.random.default_rng(0)
    rng.shuffle(edges)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in edges], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {n: (0 if n < 1000 else 1000 if n < 5000 else 5000) for e in edges for n in e}


def test_a_star_is_dealt_to_many_tasks(spark, monkeypatch):
    from blackspot import joins
    monkeypatch.setattr(joins, "HEAVY", 10)
    leaves = spark.range(1, 20001).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    both = leaves.unionAll(leaves.select(F.col("b").alias("a"), F.col("a").alias("b")))
    from blackspot.clustering.components import least_of
    sizes = joins.split_join(both, least_of(both), ["a"], "_n", "b").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in sizes) < 3 * 40000 / 8
    assert components(leaves).filter("root <> 0").isEmpty()


def tree_by_hand(lat, lon, k, linkage):
    x, y = micro(lat, lon)
    p = np.stack([x, y], 1).astype(float)
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    size, alive, merges = np.ones(len(p)), list(range(len(p))), []
    for _ in range(len(p) - 1):
        sub = d[np.ix_(alive, alive)]
        i, j = np.unravel_index(np.argmin(sub), sub.shape)
        a, b = alive[i], alive[j]
        h = d[a, b]
        merges.append((h, a, b))
        alive.remove(b)
        for c in alive:
            if c == a:
                continue
            ac, bc = d[a, c], d[b, c]
            d[a, c] = d[c, a] = {
                "single": min(ac, bc), "complete": max(ac, bc), "average": (size[a] * ac + size[b] * bc) / (size[a] + size[b]),
                "ward": np.sqrt(((size[a] + size[c]) * ac ** 2 + (size[b] + size[c]) * bc ** 2 - size[c] * h * h) / (size[a] + size[b] + size[c])),
            }[linkage]
        size[a] += size[b]
    top = sorted(m[0] for m in merges)[len(p) - k - 1] + 1e-3
    root = list(range(len(p)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for h, a, b in merges:
        if h <= top:
            root[find(b)] = find(a)
    return [find(i) for i in range(len(p))]


@pytest.mark.parametrize("linkage", hier.LINKAGES)
def test_hierarchical_matches_brute_force(crashes, linkage):
    lat, lon = sample(100, 3, hot=30)
    got = labels_of(hier.hierarchical(crashes(lat, lon), linkage, 20), "hier_cluster")
    assert same_partition(got, tree_by_hand(lat, lon, 5, linkage))
    assert set(got) == set(range(1, 6))


@pytest.mark.parametrize("linkage, small", [("ward", 3000), ("complete", 12), ("single", 12), ("average", 1)])
def test_regions_are_clustered_on_their_own(spark, monkeypatch, linkage, small):
    """Regions of at most ``small`` positions in one task, larger ones in rounds; ``small`` 1 has rounds to the end."""
    monkeypatch.setattr(hier, "SMALL", small)
    monkeypatch.setattr(hier, "PART", 4)
    rows, want, per = [], [], 8
    for i, n in enumerate([40, 9, 26] if small > 1 else [24, 15]):
        lat, lon = sample(n, 20 + i)
        rows += [(100 * i + j, a, b, 0, f"r{i}" if i else None) for j, (a, b) in enumerate(zip(lat.tolist(), lon.tolist()))]
        want += [(i, c) for c in tree_by_hand(lat, lon, max(n // per, 1), linkage)]
    df = spark.createDataFrame(rows, "Crash_ID long, Latitude double, Longitude double, Death_Cnt int, area string")
    got = sorted(hier.hierarchical(df, linkage, per, by="area").select("Crash_ID", "area", "hier_cluster").collect())
    assert same_partition([(r.area, r.hier_cluster) for r in got], want)
    assert all(min(r.hier_cluster for r in got if r.area == a) == 1 for a in {r.area for r in got})


def test_single_linkage_over_all_crashes_goes_by_squares(spark, crashes, monkeypatch):
    """Several tasks and rounds, equal heights and crowded positions, and no components of all crashes are sought."""
    sought, rounds, one_round = [], [], hier.forest_round
    monkeypatch.setattr(hier, "SMALL", 12)
    monkeypatch.setattr(hier, "ROWS_ALONG", 24, raising=False)
    monkeypatch.setattr(hier, "components", sought.append)
    monkeypatch.setattr(hier, "forest_round", lambda *a: (rounds.append(a[1:]), one_round(*a))[1])
    for lat, lon in (sample(240, 8, hot=20), np.random.default_rng(9).integers(0, 16, (2, 160)) * 1e-5 + [[30], [-100]]):
        rounds.clear()
        got = labels_of(hier.hierarchical(crashes(lat, lon), "single", 20), "hier_cluster")
        assert same_partition(got, tree_by_hand(lat, lon, len(lat) // 20, "single"))
        assert set(got) == set(range(1, max(got) + 1))
        assert len(rounds) > 1 and rounds[0][1] > 1 and not sought


def forest_by_hand(x, y):
    key = lambda i: interleave(x[i], y[i])
    order = sorted(range(len(x)), key=key)
    ids, z = np.arange(1, len(x) + 1), np.array([key(i) for i in order])
    first = {"id": ids, "x": x[order], "y": y[order], "z": z, "comp": ids, "q": z, "level": 0 * ids}
    return pa.table(first | {s: np.full(len(x), spanning.FAR) for s in spanning.SECTORS})


@pytest.mark.parametrize("kind", ["even", "ties", "clumps", "line", "ring"])
def test_shortest_forest_by_squares(monkeypatch, kind):
    """Stretches of a few rows give the same heights and components as the shortest tree of all positions, with a limit too."""
    monkeypatch.setattr(spanning, "LEAF", 8)
    rng, n = np.random.default_rng(6), 500
    where, angle = rng.integers(0, 8, n), rng.uniform(0, 2 * np.pi, n)
    x, y = {"even": rng.integers(0, 10 ** 6, (2, n)), "ties": rng.integers(0, 40, (2, n)),
            "clumps": rng.integers(10 ** 8, 3 * 10 ** 8, (2, 8))[:, where] + (rng.normal(0, 1, (2, n)) * 10.0 ** where).astype(int),
            "line": np.stack([np.arange(n) * 7, np.arange(n) * 3]), "ring": (10 ** 6 * (2 + np.stack([np.cos(angle), np.sin(angle)]))).astype(int)}[kind]
    x, y = np.unique(np.stack([x, y]), axis=1)
    start = forest_by_hand(x, y)
    a, b, want = spanning.shortest_tree(*(start[c].to_numpy() for c in "xy"), np.arange(len(x)))
    for limit in (None, int(np.sort(want)[-20])):
        state, parts, made = start, 9, []
        while state.num_rows:
            cuts = np.unique(np.searchsorted(state["q"].to_numpy(), state["q"].to_numpy()[::-(-state.num_rows // parts)])).tolist()
            tables = [spanning.Stretch(state.slice(i, j - i), limit, parts == 1).result() for i, j in zip(cuts, cuts[1:] + [state.num_rows])]
            found = pa.concat_tables(tables, promote_options="default").to_pandas()
            if "sure" in found:
                made.append(found[found["sure"].eq(True)][["a", "b", "height"]].astype(int))
                found = found[found["square"].isna()]
            state, parts = pa.Table.from_pandas(found[spanning.STATE].astype(int), preserve_index=False).sort_by("z"), parts // 3
        made = np.concatenate(made)
        low = want <= (limit or want.max())
        assert sorted(made[:, 2]) == sorted(want[low])
        assert (spanning.joined(len(x), made[:, 0] - 1, made[:, 1] - 1) == spanning.joined(len(x), a[low], b[low])).all()


@pytest.mark.parametrize("linkage", hier.LINKAGES)
def test_small_groups_are_merged_together(linkage):
    """3,000 regions of one to twelve crashes take a few steps on arrays, not a call each; one region is merged by itself."""
    alone = []
    by_itself = lambda *group: (alone.append(group), hier.merges_of_group(*group, linkage))[1]
    rng = np.random.default_rng(4)
    sizes = np.r_[rng.integers(1, 13, 3000), 90]
    starts = np.r_[0, np.cumsum(sizes)]
    # Few different distances, so that equal heights occur.
    x, y = rng.integers(0, 40, starts[-1]) * 50, rng.integers(0, 40, starts[-1]) * 50
    keep = [len({*zip(x[a:b], y[a:b])}) == b - a for a, b in zip(starts[:-1], starts[1:])]
    w, needed = rng.integers(1, 4, starts[-1]), sizes - np.maximum(sizes // 5, 1)
    root = groups.cut_groups(starts, x, y, w, needed, linkage, by_itself)
    assert len(alone) == 1
    for i in np.flatnonzero(keep)[::40]:
        a, b = starts[i], starts[i + 1]
        if needed[i] > 0:
            merges = [np.array(m)[:, None] for m in hier.merges_of_group(x[a:b], y[a:b], w[a:b], linkage)]
            assert (groups.roots_of(b - a, *merges, needed[i:i + 1])[0] == root[a:b] - a).all()


def test_clusters_of_small_groups_are_numbered_by_their_first_id():
    """Nulls are passed over, and clusters of nulls alone come first."""
    root, ids = np.array([0, 0, 2, 3, 3, 5]), np.array([groups.NO_ID, 7, 4, groups.NO_ID, groups.NO_ID, 9])
    assert groups.numbered(np.array([0, 5, 6]), root, ids).tolist() == [3, 3, 2, 1, 1, 1]


def test_groups_are_handed_on_whole(monkeypatch):
    monkeypatch.setattr(groups, "ROWS", 10)
    keys = np.repeat([f"g{i:03}" for i in range(40)], np.arange(40) % 7 + 1)
    table = pa.table({"grp": keys, "i": np.arange(len(keys))})
    got = [(t["i"].to_pylist(), list(s)) for t, s in groups.whole_groups(iter(table.to_batches(max_chunksize=3)), "grp")]
    assert sum((rows for rows, _ in got), []) == list(range(len(keys)))
    assert sum(len(s) - 1 for _, s in got) == 40


def test_linkage_names_are_checked(crashes):
    with pytest.raises(ValueError):
        hier.hierarchical(crashes([30.], [-100.]), "median")
    few = hier.hierarchical(crashes([30., 30., 31.], [-100., -100., -100.]), "ward", 1)
    assert sorted(labels_of(few, "hier_cluster")) == [1, 1, 2]


@pytest.mark.parametrize("linkage", ["ward", "complete", "average"])
def test_large_groups_are_merged_by_squares(spark, monkeypatch, linkage):
    """Rounds of small squares in many tasks, and pairs of clusters measured only where they contend."""
    for name, value in {"CLUSTERS": 16, "WIDEST": 32, "MEASURED": 24, "PAIRS": 8, "ROWS": 40, "PER_TASK": 20}.items():
        monkeypatch.setattr(squares, name, value)
        if hasattr(hier, name):
            monkeypatch.setattr(hier, name, value)
    monkeypatch.setattr(hier, "SMALL", 50)
    rounds, once = [], hier.round_of
    monkeypatch.setattr(hier, "round_of", lambda *given: (rounds.append(given[4]), once(*given))[1])
    rows, want = [], []
    for i, (n, hot) in enumerate([(300, 30), (30, 0), (150, 0)]):
        lat, lon = sample(n, 40 + i, hot)
        rows += [(1000 * i + j, a, b, 0, f"r{i}") for j, (a, b) in enumerate(zip(lat.tolist(), lon.tolist()))]
        want += [(i, c) for c in tree_by_hand(lat, lon, n // 10, linkage)]
    df = spark.createDataFrame(rows, "Crash_ID long, Latitude double, Longitude double, Death_Cnt int, area string")
    got = sorted(hier.hierarchical(df, linkage, 10, by="area").select("Crash_ID", "area", "hier_cluster").collect())
    assert same_partition([(r.area, r.hier_cluster) for r in got], want)
    assert max(rounds) > 4 and len(rounds) < 40


@pytest.mark.parametrize("linkage", ["ward", "complete", "average"])
def test_a_square_merges_only_what_nothing_outside_can_undo(linkage):
    """Every merge of a square is a merge of the whole map, and most of its inside is settled at once."""
    rng = np.random.default_rng(9)
    p = rng.integers(0, 4000, (300, 2)).astype(float)
    w = rng.integers(1, 4, 300)
    each = lambda rows: [np.array([i]) for i in range(len(rows))]
    whole = squares.Merging(linkage, each(p), *p.T, w, None, np.inf, 1)
    of_tree = set(zip(*(m.tolist() for m in whole.run()[:2])))
    assert len(of_tree) == 299
    here = np.flatnonzero((p < 2000).all(1))
    own = squares.Merging(linkage, each(here), *p[here].T, w[here], (0, 2000, 0, 2000), np.inf, 1)
    lo, hi, _ = own.run()
    assert len(lo) > len(here) / 3
    assert {(here[a], here[b]) for a, b in zip(lo, hi)} <= of_tree


def test_positions_off_the_map_are_merged_too(spark, monkeypatch):
    """Coordinates that no map has lie at the edge of the squares; those too great for a number stay alone."""
    monkeypatch.setattr(hier, "SMALL", 3)
    lat, lon = sample(40, 60)
    lat, lon = lat.tolist() + [5000.0, 5000.1, -5000.0, -5000.1, 1e300], lon.tolist() + [9000.0, 9000.1, -9000.0, -9000.1, 0.0]
    df = spark.createDataFrame([(i, a, b, 0) for i, (a, b) in enumerate(zip(lat, lon))], "Crash_ID long, Latitude double, Longitude double, Death_Cnt int")
    for linkage in ("ward", "average"):
        got = dict(hier.hierarchical(df, linkage, 11).select("Crash_ID", "hier_cluster").collect())
        assert got[40] == got[41] != got[42] == got[43] and len(set(got.values())) >= 3


@pytest.mark.parametrize("linkage", ["ward", "complete", "average"])
def test_a_stretch_is_cut_again_as_long_as_that_settles_much(linkage):
    """One task merges what lies between its first squares too, and keeps only outer positions where no others matter."""
    rng = np.random.default_rng(3)
    p = np.unique(rng.integers(0, 1 << 14, (4000, 2)), axis=0)
    codes = squares.interleaved(*p.T)
    assert codes[:50].tolist() == [interleave(*q) for q in p[:50]]
    p, codes = p[np.argsort(codes)], np.sort(codes)
    n, ones = len(p), np.ones(len(p), np.int64)
    table = pa.table({"grp": [""] * n, "id": np.arange(n), "code": codes, "x": p[:, 0].astype(float), "y": p[:, 1].astype(float), "w": ones,
                      "cx": p[:, 0], "cy": p[:, 1], "limit": pa.nulls(n, pa.float64())})
    out = squares.merge_stretch(table, linkage, 256, False, (0, 0), 1)
    merged, left = out.filter(pc.is_valid(out["square"])), out.filter(pc.is_null(out["square"]))
    whole = squares.Merging(linkage, [np.array([i]) for i in range(n)], *p.T.astype(float), ones, None, np.inf, 1)
    of_tree = set(zip(*(m.tolist() for m in whole.run()[:2])))
    found = list(zip(merged["id"].to_pylist(), merged["hi"].to_pylist()))
    assert set(found) <= of_tree and len(set(found)) == len(found) > 0.55 * n
    assert len(set(merged["square"].to_pylist())) == 1
    assert pc.sum(left["w"]).as_py() == n and pc.sum(left["head"]).as_py() == n - len(found) == len(set(left["id"].to_pylist()))
    assert left.num_rows == n if linkage == "average" else left.num_rows < (n if linkage == "complete" else n - len(found) + 1)


def test_outlines_keep_the_greatest_distances():
    rng = np.random.default_rng(4)
    clouds = [rng.integers(0, 300, (40, 2)), rng.integers(0, 9, (60, 2)), np.c_[np.arange(30), 2 * np.arange(30)], np.c_[rng.integers(0, 99, 25), np.full(25, 7)], rng.integers(0, 5000, (200, 2))]
    clouds = [np.unique(c, axis=0) + 10 ** 8 for c in clouds]
    x, y = np.concatenate(clouds).T.astype(float)
    w = rng.integers(1, 5, len(x))
    parts = np.split(np.arange(len(x)), np.cumsum([len(c) for c in clouds])[:-1])
    nx, ny, nw, fewer = squares.outlines(x, y, w, parts)
    assert sum(map(len, fewer)) < len(x) / 2
    mean = lambda x, w, rows: (x[rows] * w[rows]).sum() / w[rows].sum()
    for a, b in zip(parts, fewer):
        assert w[a].sum() == nw[b].sum() and abs(mean(x, w, a) - mean(nx, nw, b)) < 1e-6 and abs(mean(y, w, a) - mean(ny, nw, b)) < 1e-6
        for c, d in zip(parts, fewer):
            far = lambda x, y, i, j: ((x[i][:, None] - x[j]) ** 2 + (y[i][:, None] - y[j]) ** 2).max()
            assert far(x, y, a, c) == far(nx, ny, b, d)


@pytest.mark.parametrize("linkage", ["ward", "complete"])
def test_merges_of_all_rounds_are_sorted_once(crashes, monkeypatch, linkage):
    """The cut is bounded by numbers of merges in bands; its height is sought once, and merges of a group do not go to one task."""
    monkeypatch.setattr(hier, "SMALL", 50)
    calls, once = [], hier.lowest
    monkeypatch.setattr(hier, "lowest", lambda *given: (calls.append(given), once(*given))[1])
    plans, cut = [], hier.cut
    monkeypatch.setattr(hier, "cut", lambda df, **kept: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df, **kept))[1])
    for name, value in {"CLUSTERS": 16, "ROWS": 40, "PER_TASK": 20}.items():
        monkeypatch.setattr(squares, name, value)
        monkeypatch.setattr(hier, name, value)
    lat, lon = sample(400, 21)
    got = labels_of(hier.hierarchical(crashes(lat, lon), linkage, 10), "hier_cluster")
    assert same_partition(got, tree_by_hand(lat, lon, 40, linkage)) and len(calls) == 1
    counted = [p for p in plans if "band" in p]
    assert counted and not any("SortMergeJoin" in p for p in counted)
