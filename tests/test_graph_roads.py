import heapq
import os
import random

import pytest
from pyspark.sql import functions as F

from ridgewater.operators import graph, roads


def dijkstra(adj, starts):
    dist = dict(starts)
    heap = [(c, n) for n, c in starts.items()]
    heapq.heapify(heap)
    while heap:
        d, u = heapq.heappop(heap)
        if d > dist[u]:
            continue
        for w, c in adj.get(u, []):
            if d + c < dist.get(w, float("inf")):
                dist[w] = d + c
                heapq.heappush(heap, (d + c, w))
    return dist


@pytest.fixture(scope="module")
def net(spark):
    rng = random.Random(11)
    edges = {}
    for _ in range(260):
        a, b = rng.randrange(60), rng.randrange(60)
        if a != b:
            edges[a, b] = float(rng.randint(1, 40))
    rows = [(a, b, c, float(rng.choice([1, 1, 2, 4, 8]))) for (a, b), c in edges.items()]
    df = spark.createDataFrame(rows, "src long, dst long, length_m double, risk double")
    adj = {}
    for a, b, c, _ in rows:
        adj.setdefault(a, []).append((b, c))
    return rows, df, adj


def test_shortest_paths_and_sums(spark, net):
    rows, df, adj = net
    origins = spark.createDataFrame([(1, 1), (2, 2), (9, 30), (9, 31)], "origin long, node long")
    priced = df.withColumn("cost", F.col("length_m"))
    got = {(r.origin, r.node): r.cost for r in graph.shortest_paths(priced, origins).collect()}
    for origin, starts in ((1, {1: 0.0}), (2, {2: 0.0}), (9, {30: 0.0, 31: 0.0})):
        want = dijkstra(adj, starts)
        assert {n: c for (o, n), c in got.items() if o == origin} == want
    carried = graph.shortest_paths(priced, origins, {"metres": F.col("length_m"), "hops": F.lit(1.0)})
    for r in carried.collect():
        assert r.metres == r.cost == got[r.origin, r.node]
        assert (r.prev is None) == (r.cost == 0.0) and (r.hops > 0) == (r.cost > 0)
    near = graph.shortest_paths(priced, origins, max_cost=20.0)
    assert {(r.origin, r.node) for r in near.collect()} == {k for k, c in got.items() if c <= 20}


def test_unroll_gives_a_real_path(spark, net):
    rows, df, adj = net
    lengths = {(a, b): c for a, b, c, _ in rows}
    origins = spark.createDataFrame([(1, 1)], "origin long, node long")
    found = graph.shortest_paths(df.withColumn("cost", F.col("length_m")), origins, {"hops": F.lit(1.0)})
    cost = {r.node: r.cost for r in found.collect()}
    ends = found.filter("cost > 0").select("origin", "node")
    paths = {}
    for r in graph.unroll(found, ends).collect():
        paths.setdefault(r.end, {})[r.position] = r.node
    for end, nodes in paths.items():
        walk = [nodes[i] for i in sorted(nodes, reverse=True)]
        assert walk[0] == 1 and walk[-1] == end
        assert sum(lengths[e] for e in zip(walk, walk[1:])) == cost[end]


def test_hubs_are_split(spark, monkeypatch):
    monkeypatch.setattr(graph, "hot_keys", lambda df, keys: df.groupBy(*keys).count().filter("count > 50").select("src", F.lit(3).alias("_splits")))
    rows = [(0, i, float(i)) for i in range(1, 200)] + [(i, i + 1, 0.5) for i in range(1, 199)]
    df = spark.createDataFrame(rows, "src long, dst long, cost double")
    got = {r.node: r.cost for r in graph.shortest_paths(df, spark.createDataFrame([(0, 0)], "origin long, node long")).collect()}
    assert got == {0: 0.0, **{i: 1 + 0.5 * (i - 1) for i in range(1, 200)}}


def test_nearest_source(spark, net):
    rows, df, _ = net
    back = {}
    for a, b, c, _ in rows:
        back.setdefault(b, []).append((a, c))
    sources = {5: 3, 7: 40, 8: 41}
    got = {r.node: (r.cost, r.source) for r in graph.nearest_source(
        df.withColumn("cost", F.col("length_m")), spark.createDataFrame(list(sources.items()), "source long, node long")).collect()}
    each = {s: dijkstra(back, {n: 0.0}) for s, n in sources.items()}
    for node in range(60):
        options = sorted((d[node], s) for s, d in each.items() if node in d)
        assert got.get(node) == (options[0] if options else None)


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    links = chain + [(1, 5), (5, 9), (9, 2), (200, 201)] + [(300, 300 + i) for i in range(1, 30)]
    rng.shuffle(links)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[n] == 100 for n in range(100, 161)) and got[2] == got[9] == 1 and got[201] == 200 and got[329] == 300


def test_one_way_and_parallel_rules(spark):
    ways = spark.createDataFrame([(1, 2, "yes", 5.0), (3, 4, "-1", 6.0), (5, 6, None, 7.0), (5, 6, "no", 3.0)], "src long, dst long, oneway string, length_m double")
    arcs = roads.directed_edges(ways)
    assert {(r.src, r.dst) for r in arcs.collect()} == {(1, 2), (4, 3), (5, 6), (6, 5)}
    assert {(r.src, r.dst): r.length_m for r in roads.merge_parallel(arcs).collect()}[5, 6] == 3.0
    assert {(r.src, r.dst): r.length_m for r in roads.merge_parallel(arcs, "sum").collect()}[5, 6] == 10.0


def test_weights(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (4.0, 0), (8.0, 0), (1.0, 1), (1.0, 2)], "risk double, report_rank int").withColumn("length_m", F.lit(10.0))
    got = [tuple(r)[3:] for r in roads.with_weights(df).collect()]
    assert got == [(1.0, 10.0, 10.0, 10.0), (2.0, 10.0, 40.0, 17.5), (4.0, 10.0, 160.0, 32.5), (8.0, 10.0, 1e7, 250.0),
                   (4.0, 200.0, 200.0, 200.0), (8.0, 1e7, 1e7, 1e7)]
    wet = [r.safest for r in roads.with_weights(df, rain_mm=8.0).collect()]
    assert wet[1] == 160.0 and wet[2] == 1e7 and [r.effective_risk for r in roads.with_weights(df, 8.0).collect()][1] == 2.0


def test_detour_cap_and_unavoidable(spark):
    # 1-2 directly is extreme; the detour over 3 is 40 times as long, over 4 only twice.
    rows = [(1, 2, 100.0, 8.0), (1, 3, 2000.0, 1.0), (3, 2, 2000.0, 1.0), (5, 6, 100.0, 8.0), (5, 7, 100.0, 1.0), (7, 6, 100.0, 1.0), (8, 9, 50.0, 8.0)]
    df = roads.with_weights(spark.createDataFrame(rows, "src long, dst long, length_m double, risk double"))
    got = {(r.origin, r.node): r for r in roads.safest_with_cap(df, spark.createDataFrame([(1, 1), (5, 5), (8, 8)], "origin long, node long")).collect()}
    assert got[1, 2].safest_capped and got[1, 2].distance_m == 100.0 and not got[1, 2].extreme_unavoidable
    assert not got[5, 6].safest_capped and got[5, 6].distance_m == 200.0 and got[5, 6].n_risk_1 == 2
    assert got[8, 9].extreme_unavoidable


def test_alternative_without_edge(spark):
    rows = [(1, 2, 10.0), (1, 3, 5.0), (3, 1, 1.0), (3, 4, 30.0), (4, 2, 5.0), (7, 8, 9.0), (7, 1, 2.0), (1, 7, 2.0)]
    df = spark.createDataFrame(rows, "src long, dst long, length_m double")
    removed = spark.createDataFrame([(1, 2), (7, 8)], "src long, dst long")
    got = {(r.src, r.dst): r.alternative_m for r in roads.without_edge(df, removed).collect()}
    assert got == {(1, 2): 40.0, (7, 8): None}


def test_nearest_reachable_prefers_the_shorter_road(spark):
    nodes = spark.createDataFrame([(1, 30.0, 79.0), (2, 30.01, 79.0), (3, 30.05, 79.0)], "node_id long, lat double, lon double")
    edges = spark.createDataFrame([(1, 2, 9000.0), (1, 3, 6000.0)], "src long, dst long, length_m double").withColumn("safest", F.col("length_m"))
    points = spark.createDataFrame([(1, 30.0001, 79.0), (2, 20.0, 70.0)], "point_id long, lat double, lon double")
    targets = spark.createDataFrame([(20, 30.01, 79.0001), (30, 30.05, 79.0001)], "target_id long, lat double, lon double")
    got = roads.nearest_reachable(edges, nodes, points, targets).collect()
    assert [(r.point_id, r.target_id, r.distance_m) for r in got] == [(1, 30, 6000.0)]


def chained(seed, junctions=14, links=22):
    """A road network whose junctions are joined by chains, two-way and one-way, with dead ends and a ring of its own."""
    rng = random.Random(seed)
    rows, fresh = {}, iter(range(1000, 100_000))

    def put(a, b, both):
        rows[a, b] = float(rng.randint(1, 9))
        if both:
            rows[b, a] = float(rng.randint(1, 9))

    for _ in range(links):
        a, b = rng.randrange(junctions), rng.randrange(junctions)
        nodes = [a, *(next(fresh) for _ in range(rng.choice([0, 1, 3, 17]))), b]
        both = rng.random() < 0.7
        for x, y in zip(nodes, nodes[1:]):
            if x != y:
                put(x, y, both or rng.random() < 0.1)
    stub = [0, *(next(fresh) for _ in range(6))]
    ring = [next(fresh) for _ in range(5)]
    for x, y in zip(stub, stub[1:]):
        put(x, y, True)
    for x, y in zip(ring, ring[1:] + ring[:1]):
        put(x, y, True)
    return rows, ring


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_give_the_same_paths(spark, seed):
    rows, ring = chained(seed)
    df = spark.createDataFrame([(a, b, c) for (a, b), c in rows.items()], "src long, dst long, cost double")
    inside = next(n for (a, n) in rows if n >= 1000 and n not in ring)
    origins = spark.createDataFrame([(1, 1), (2, 2), (3, inside), (4, ring[0])], "origin long, node long")
    adj = {}
    for (a, b), c in rows.items():
        adj.setdefault(a, []).append((b, c))
    want = {(o, n): c for o, s in ((1, 1), (2, 2), (3, inside), (4, ring[0])) for n, c in dijkstra(adj, {s: 0.0}).items()}
    assert {(r.origin, r.node): r.cost for r in graph.shortest_paths(df, origins, chains=True).collect()} == want
    carried = graph.shortest_paths(df, origins, {"hops": F.lit(1.0), "metres": F.col("cost")}, chains=True)
    for r in carried.collect():
        assert r.cost == r.metres == want.pop((r.origin, r.node))
        assert (r.prev is None) == (r.hops == 0)
    assert not want
    ends = carried.filter("hops > 0").select("origin", "node")
    cost = {(r.origin, r.node): (r.cost, r.hops) for r in carried.collect()}
    paths = {}
    for r in graph.unroll(carried, ends).collect():
        paths.setdefault((r.origin, r.end), {})[r.position] = r.node
    for key, nodes in paths.items():
        walk = [nodes[i] for i in sorted(nodes, reverse=True)]
        assert (sum(rows[e] for e in zip(walk, walk[1:])), len(walk) - 1) == cost[key]
    near = graph.shortest_paths(df, origins, max_cost=15.0, chains=True)
    assert {(r.origin, r.node) for r in near.collect()} == {k for k, (c, _) in cost.items() if c <= 15}


def test_contraction_leaves_junctions(spark):
    rows, ring = chained(5)
    df = spark.createDataFrame([(a, b, c) for (a, b), c in rows.items()], "src long, dst long, cost double")
    steps, inner = graph.contract(df, spark.createDataFrame([(1,)], "node long"))
    around = {}
    for a, b in rows:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    stay = {n for n, x in around.items() if len(x) != 2 or n == 1}
    assert {n for r in steps.collect() for n in (r.src, r.dst)} <= stay and not {r.dst for r in inner.collect()} & (stay | set(ring))
    reached = {n for n, x in around.items() if len(x) == 2 and n != 1} - set(ring)
    assert {r.dst for r in inner.collect()} == reached


def test_rounds_write_what_improves(spark, monkeypatch):
    """A long path costs one row a round, and a merge now and then, not the whole table a round."""
    n = 12
    df = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n)], "src long, dst long, cost double")
    written = []
    stage = graph._observed_stage

    def counted(frame, changed, label):
        out = stage(frame, changed, label)
        written.append((label, out[0].count()))
        return out

    monkeypatch.setattr(graph, "_observed_stage", counted)
    got = graph.shortest_paths(df, spark.createDataFrame([(0, 0)], "origin long, node long")).collect()
    assert {r.node: r.cost for r in got} == {i: float(i) for i in range(n + 1)}
    assert sum(k for label, k in written if label == "paths") == n + 1
    assert len([1 for label, _ in written if label == "known"]) == 3


def test_touching_a_corner_is_no_hazard(spark):
    """Edge 0-1 meets the corner (1, 0) of the polygon only, 2-3 crosses it and 4-5 starts inside."""
    nodes = spark.createDataFrame(
        [(0, -1.0, 1.0), (1, 1.0, 1.0), (2, -1.0, 0.5), (3, 1.0, 0.5), (4, 0.0, 0.25), (5, 0.125, 0.25)],
        "node_id long, lat double, lon double",
    )
    edges = spark.createDataFrame([(0, 1, 1.0), (3, 2, 1.0), (4, 5, 1.0)], "src long, dst long, length_m double")
    ring = [(1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0)]
    polygons = spark.createDataFrame(
        [(1, "EXTREME", [[{"x": x, "y": y} for x, y in ring]])],
        "polygon_id long, hazard_class string, rings array<array<struct<x:double,y:double>>>",
    )
    found = {r.src: (r.risk, r.hazard_code) for r in roads.hazard_overlay(edges, nodes, polygons).collect()}
    assert found == {0: (1.0, 0), 3: (8.0, 4), 4: (8.0, 4)}


def test_origins_share_rows_and_rounds_take_the_cheapest(spark, net, monkeypatch):
    """Five origins in rows of two or three costs, each round below a limit: same costs, far fewer rows than labels."""
    monkeypatch.setattr(graph, "SLOTS", 3)
    monkeypatch.setattr(graph, "SMALL_ROUND", 5)
    rows, df, adj = net
    written, stage = [], graph._observed_stage

    def counted(frame, changed, label):
        out = stage(frame, changed, label)
        written.append((label, out[0].count()))
        return out

    monkeypatch.setattr(graph, "_observed_stage", counted)
    at = {1: 1, 2: 2, 3: 17, 4: 30, 5: 44}
    origins = spark.createDataFrame(list(at.items()), "origin long, node long")
    rows = [(a, b, c + 30.0, r) for a, b, c, r in rows]  # steps are long, so few rounds have to be run
    adj = {a: [(b, c + 30.0) for b, c in out] for a, out in adj.items()}
    want = {(o, n): c for o, s in at.items() for n, c in dijkstra(adj, {s: 0.0}).items()}
    priced = df.withColumn("cost", F.col("length_m") + 30.0)
    found = graph.shortest_paths(priced, origins, {"metres": F.col("cost"), "hops": F.lit(1.0)})
    got = {(r.origin, r.node): r for r in found.collect()}
    assert {k: r.cost for k, r in got.items()} == want == {k: r.metres for k, r in got.items()}
    assert sum(n for label, n in written if label == "paths") < len(want)
    for (o, n), r in got.items():  # prev is the lowest node before the end on any cheapest path
        tight = [a for a, b, c, _ in rows if b == n and (o, a) in want and want[o, a] + c == r.cost]
        assert r.prev == (None if r.cost == 0 else min(tight)) and r.hops == (0 if r.prev is None else got[o, r.prev].hops + 1)


def test_steps_beyond_what_is_known_are_not_moved(spark):
    """Of a node's edges only those up to the highest cost it is known by stay; the nodes no origin knows lose theirs."""
    edges = spark.createDataFrame([(0, 1, 5.0, 0), (0, 2, 9.0, 0), (1, 2, 2.0, 0), (2, 9, 1.0, 0)], "src long, dst long, cost double, _salt int")
    wide = spark.createDataFrame([(0, 0, 0.0, 7.0), (0, 1, 5.0, None), (0, 2, 7.0, 0.0), (1, 2, 8.0, None)], "block long, node long, d0 double, d1 double")
    found = {(r.src, r.dst): r._most for r in graph._bounded(edges, wide, ["d0", "d1"]).collect()}
    assert found == {(0, 1): 5.0, (0, 2): 8.0, (1, 2): 8.0}
    one = {(r.src, r.dst): r._most for r in graph._bounded(edges, wide.drop("d1"), ["d0"]).collect()}
    assert one == found


def test_components_stop_at_stars(spark, monkeypatch):
    """No further round is run to see that nothing changes."""
    written, stage = [], graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, label: written.append(label) or stage(df, label))
    links = spark.createDataFrame([(1, 2), (3, 1), (7, 8)], "a long, b long")
    assert {r.node: r.component for r in graph.components(links).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    assert len(written) == 3


def test_rounds_follow_steps_not_ranges_of_costs(spark, monkeypatch):
    """Costs from 1 to 1e9 in a network of short paths: as many rounds as the longest cheapest path has steps, with plain plans."""
    rng = random.Random(5)
    monkeypatch.setattr(graph, "SMALL_ROUND", 3)
    rows = {(rng.randrange(40), rng.randrange(40)): float(rng.randint(1, 9)) * 10.0 ** rng.choice([0, 3, 6, 9]) for _ in range(300)}
    adj = {}
    for (a, b), c in rows.items():
        adj.setdefault(a, []).append((b, c))
    starts = {0: 0, 1: 1, 2: 2}
    want = {(o, n): c for o, s in starts.items() for n, c in dijkstra(adj, {s: 0.0}).items()}
    name, rounds, stage = "spark.sql.constraintPropagation.enabled", [], graph._observed_stage

    def counted(frame, changed, label):
        rounds.append((label, spark.conf.get(name)))
        return stage(frame, changed, label)

    monkeypatch.setattr(graph, "_observed_stage", counted)
    df = spark.createDataFrame([(a, b, c) for (a, b), c in rows.items()], "src long, dst long, cost double")
    found = graph.shortest_paths(df, spark.createDataFrame(list(starts.items()), "origin long, node long"))
    assert {(r.origin, r.node): r.cost for r in found.collect()} == want
    steps = {(o, s): 0 for o, s in starts.items()}  # of the cheapest path with the fewest steps
    for (o, n), c in sorted(want.items(), key=lambda x: x[1]):
        for m, d in adj.get(n, []):
            if want[o, m] == c + d:
                steps[o, m] = min(steps.get((o, m), 99), steps[o, n] + 1)
    assert sum(label == "paths" for label, _ in rounds) <= max(steps.values()) + 2
    assert {value for _, value in rounds} == {"false"} and spark.conf.get(name) == "true"


def test_nearest_reachable_takes_targets_in_groups(spark, net, monkeypatch):
    """One target at a time: the same answers, and the costs of a group are deleted before the next one."""
    rows, df, adj = net
    place = {n: (30.0 + n / 1000.0, 79.0) for n in range(60)}
    nodes = spark.createDataFrame([(n, *at) for n, at in place.items()], "node_id long, lat double, lon double")
    points = spark.createDataFrame([(100 + n, *place[n]) for n in (0, 7, 21, 40)], "point_id long, lat double, lon double")
    targets = spark.createDataFrame([(n, *place[n]) for n in (3, 30, 55)], "target_id long, lat double, lon double")
    priced = df.withColumn("safest", F.col("length_m"))
    calls, kept, search = [], [], roads.shortest_paths

    def counted(edges, starts, carry):
        calls.append(starts.count())
        out = search(edges, starts, carry)
        kept.append(out.inputFiles())
        return out

    monkeypatch.setattr(roads, "SLOTS", 1)
    monkeypatch.setattr(roads, "LABELS_AT_ONCE", 1)
    monkeypatch.setattr(roads, "shortest_paths", counted)
    got = {r.point_id: (r.target_id, r.distance_m) for r in roads.nearest_reachable(priced, nodes, points, targets).collect()}
    want = {}
    for n in (0, 7, 21, 40):
        cost = dijkstra(adj, {n: 0.0})
        want[100 + n] = min((cost[t], t) for t in (3, 30, 55) if t in cost)
    assert {p: d for p, (_, d) in got.items()} == {p: d for p, (d, _) in want.items()}
    assert calls == [1, 1, 1]
    assert not [f for files in kept for f in files if os.path.exists(f.replace("file://", ""))]
