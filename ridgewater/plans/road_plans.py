"""Registered queries on the road network."""

from __future__ import annotations

from pyspark.sql import functions as F

from ridgewater.operators import graph, roads
from ridgewater.plans import views as v
from ridgewater.session import stage


def _edges(spark, sf):
    return roads.merge_parallel(roads.directed_edges(v.road_ways(spark, sf)))


def _risky(spark, sf):
    return roads.hazard_overlay(_edges(spark, sf), v.road_nodes(spark, sf), v.polygons(spark, sf))


def _reports(spark, sf):
    """Created reports at node-like positions; those of users divisible by 3 are trusted."""
    ev = v.events(spark, sf).filter("event_type = 'error'")
    return ev.select(
        F.col("event_id").alias("report_id"),
        (F.lit(28.65) + F.expr("(event_id * 7919L) % 2850") / F.lit(1000.0)).alias("lat"),
        (F.lit(77.5) + F.expr("(event_id * 104729L) % 3600") / F.lit(1000.0)).alias("lon"),
        (F.col("user_id") % 3 == 0).alias("blocks_road"),
    )


def _depots(spark, sf):
    """One start node per nation."""
    n = v.table(spark, sf, "part").agg(F.count(F.lit(1)).alias("n"))
    return v.table(spark, sf, "nation").join(F.broadcast(n), F.lit(True)).select(
        F.col("n_nationkey").cast("long").alias("origin"), (F.col("n_nationkey") * F.lit(37) % F.col("n")).alias("node")
    )


def _sources(spark, sf):
    """Every supplier stands at a node; several may share one."""
    n = v.table(spark, sf, "part").agg(F.count(F.lit(1)).alias("n"))
    return v.table(spark, sf, "supplier").join(F.broadcast(n), F.lit(True)).select(
        F.col("s_suppkey").alias("source"), (F.col("s_suppkey") * 13 % F.col("n")).alias("node")
    )


def road_edges(spark, sf):
    return _edges(spark, sf)


def road_edges_summed(spark, sf):
    return roads.merge_parallel(roads.directed_edges(v.road_ways(spark, sf)), "sum")


def edge_hazard_overlay(spark, sf):
    return _risky(spark, sf).select("src", "dst", "risk", "hazard_code")


def reported_edges(spark, sf):
    out = roads.mark_reports(_edges(spark, sf), v.road_nodes(spark, sf), _reports(spark, sf))
    return out.select("src", "dst", F.col("report_rank").cast("int").alias("report_rank"))


def road_weights(spark, sf):
    marked = roads.mark_reports(_risky(spark, sf), v.road_nodes(spark, sf), _reports(spark, sf))
    out = roads.with_weights(marked, rain_mm=9.0)
    return out.select("src", "dst", "effective_risk", "fastest", "safest", "relaxed")


def mixed_junctions(spark, sf):
    return roads.mixed_junctions(_risky(spark, sf))


def degree_filter(spark, sf):
    return roads.well_connected(_edges(spark, sf), 25)


def graph_integrity(spark, sf):
    return roads.integrity(_edges(spark, sf), v.road_nodes(spark, sf))


def shortest_paths(spark, sf):
    edges = _edges(spark, sf).select("src", "dst", F.col("length_m").alias("cost"))
    return graph.shortest_paths(edges, _depots(spark, sf))


def shortest_paths_by_chains(spark, sf):
    """The same costs, searched over chains of nodes with two neighbours at once."""
    edges = _edges(spark, sf).select("src", "dst", F.col("length_m").alias("cost"))
    return graph.shortest_paths(edges, _depots(spark, sf), chains=True)


def safest_costs(spark, sf):
    edges = roads.with_weights(_risky(spark, sf)).select("src", "dst", F.col("relaxed").alias("cost"))
    return graph.shortest_paths(edges, _depots(spark, sf))


def nearest_by_cost(spark, sf):
    return roads.nearest_by_cost(_edges(spark, sf), _sources(spark, sf))


def farthest_within(spark, sf):
    edges = _edges(spark, sf).select("src", "dst", F.col("length_m").alias("cost"))
    return roads.farthest_within(graph.shortest_paths(edges, _depots(spark, sf), max_cost=150.0), 150.0)


def road_components(spark, sf):
    """Components of the ways with low traffic: one-way ways of the shortest length only."""
    ways = v.road_ways(spark, sf).filter("length_m = 60 AND oneway = 'yes'")
    return graph.components(ways.select(F.col("src").alias("a"), F.col("dst").alias("b")))


def component_summary(spark, sf):
    nodes = v.road_nodes(spark, sf)
    comp = road_components(spark, sf)
    return comp.join(nodes, comp.node == nodes.node_id).groupBy("component").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"),
        F.min("lon").alias("west"), F.max("lon").alias("east"),
    )


def nearest_reachable(spark, sf):
    edges = stage(roads.with_weights(_risky(spark, sf)), "weighted")
    shelters = v.shelters(spark, sf).filter("kind = 'hospital'").select("target_id", "lat", "lon")
    out = roads.nearest_reachable(edges, v.road_nodes(spark, sf), v.points(spark, sf), shelters)
    return out.select("point_id", "target_id", "distance_m", F.round("cost", 3).alias("cost"))


def safest_routes(spark, sf):
    edges = stage(roads.with_weights(_risky(spark, sf)), "weighted")
    return roads.safest_with_cap(edges, _depots(spark, sf))


def mode_comparison(spark, sf):
    edges = stage(roads.with_weights(_risky(spark, sf)).withColumn("report_rank", F.lit(0)), "weighted")
    fast = stage(roads.routes(edges, _depots(spark, sf), "fastest"), "fast")
    safe = stage(roads.routes(edges, _depots(spark, sf), "safest"), "safest")
    both = roads.compare_modes(fast, safe)
    avoiding = roads.avoiding_pairs(fast, safe).groupBy("origin").agg(F.count(F.lit(1)).alias("n_avoiding"))
    return both.groupBy("origin").agg(
        F.avg("extra_km").alias("extra_km"), F.sum("extreme_avoided").alias("extreme_avoided"), F.count(F.lit(1)).alias("n")
    ).join(avoiding, "origin", "left")


def edge_alternatives(spark, sf):
    """For each depot's longest exit, the way round without it."""
    edges = stage(_edges(spark, sf), "edges")
    exits = edges.join(_depots(spark, sf).select(F.col("node").alias("src")).distinct(), "src")
    longest = exits.groupBy("src").agg(F.max(F.struct("length_m", "dst")).alias("m")).select("src", F.col("m.dst").alias("dst"))
    return roads.without_edge(edges, longest)


def route_hops(spark, sf):
    """Hops of the route from every depot to its farthest node."""
    edges = stage(roads.with_weights(_risky(spark, sf)), "weighted")
    found = stage(graph.shortest_paths(edges.withColumn("cost", F.col("fastest")), _depots(spark, sf), {"hops": F.lit(1.0)}), "found")
    ends = found.groupBy("origin").agg(F.max(F.struct("cost", "node")).alias("b")).select("origin", F.col("b.node").alias("node"))
    hops = roads.path_hops(found, ends, edges)
    return hops.groupBy("origin", "end").agg(F.sum("length_m").alias("length_m"), F.min("hop").cast("long").alias("first_hop"))


_SIDE_HIT = """SELECT DISTINCT s.a, s.b, d.polygon_id, d.hazard_class FROM seg s, side d WHERE
  ((d.x2-d.x1)*(s.p1y-d.y1)-(d.y2-d.y1)*(s.p1x-d.x1)) * ((d.x2-d.x1)*(s.p2y-d.y1)-(d.y2-d.y1)*(s.p2x-d.x1)) < 0
  AND ((s.p2x-s.p1x)*(d.y1-s.p1y)-(s.p2y-s.p1y)*(d.x1-s.p1x)) * ((s.p2x-s.p1x)*(d.y2-s.p1y)-(s.p2y-s.p1y)*(d.x2-s.p1x)) < 0"""
_INSIDE = """SELECT n.node_id, d.polygon_id FROM node n, side d WHERE (y1 > lat) <> (y2 > lat)
  AND lon < (x2-x1)*(lat-y1)/(y2-y1)+x1 GROUP BY 1,2 HAVING count(*) % 2 = 1"""
_OVERLAY = {
    "seg": """SELECT DISTINCT least(src,dst) AS a, greatest(src,dst) AS b, na.lon AS p1x, na.lat AS p1y, nb.lon AS p2x, nb.lat AS p2y
      FROM edge JOIN node na ON na.node_id = least(src,dst) JOIN node nb ON nb.node_id = greatest(src,dst)""",
    "meets": _SIDE_HIT,
    "nin": _INSIDE,
    "hit": """SELECT a, b, hazard_class FROM meets UNION SELECT s.a, s.b, y.hazard_class FROM seg s JOIN nin i ON i.node_id = s.a
      JOIN poly y ON y.polygon_id = i.polygon_id""",
    "worst": """SELECT a, b, max(CASE hazard_class WHEN 'LOW' THEN 1e0 WHEN 'MODERATE' THEN 2e0 WHEN 'SIGNIFICANT' THEN 4e0 ELSE 8e0 END) AS risk,
      max(CASE hazard_class WHEN 'LOW' THEN 1 WHEN 'MODERATE' THEN 2 WHEN 'SIGNIFICANT' THEN 3 ELSE 4 END) AS code FROM hit GROUP BY 1,2""",
    "risky": """SELECT src, dst, length_m, coalesce(risk, 1e0) AS risk, coalesce(code, 0)::INT AS hazard_code FROM edge
      LEFT JOIN worst ON a = least(src,dst) AND b = greatest(src,dst)""",
}
_MARK = {
    "rep": """SELECT event_id, 28.65e0 + ((event_id*7919) % 2850)/1000e0 AS lat, 77.5e0 + ((event_id*104729) % 3600)/1000e0 AS lon,
      user_id % 3 = 0 AS blocks FROM events WHERE event_type = 'error'""",
    "near": f"""SELECT node_id, max(CASE WHEN blocks THEN 2 ELSE 1 END) AS rk FROM node n, rep r
      WHERE abs(n.lat-r.lat) < 0.01 AND {v.haversine_sql('n.lat', 'n.lon', 'r.lat', 'r.lon')} <= 0.15e0 GROUP BY 1""",
    "marked": """SELECT e.src, e.dst, greatest(coalesce(a.rk,0), coalesce(b.rk,0))::INT AS report_rank FROM edge e
      LEFT JOIN near a ON a.node_id = e.src LEFT JOIN near b ON b.node_id = e.dst""",
}
_DEPOT = "SELECT n_nationkey::BIGINT AS origin, n_nationkey*37 % n AS node FROM nation, (SELECT count(*) AS n FROM part)"


def _search(edges: str) -> str:
    return f"""sp(origin, node, cost) USING KEY (origin, node) AS (SELECT origin, node, 0e0 FROM depot UNION
      SELECT f.origin, e.dst, min(f.cost + e.cost) AS cost FROM sp f JOIN {edges} e ON e.src = f.node
      LEFT JOIN recurring.sp p ON p.origin = f.origin AND p.node = e.dst
      WHERE p.cost IS NULL OR f.cost + e.cost < p.cost GROUP BY 1,2)"""


_COST = "SELECT src, dst, length_m AS cost FROM edge"
_RELAXED = """SELECT src, dst, length_m * CASE WHEN risk >= 8 THEN 25e0 ELSE (risk-1e0)*0.75e0+1e0 END AS cost FROM risky"""
_SP = v.sql("edge", "SELECT origin, node, cost FROM sp", depot=_DEPOT, priced=_COST, sp=_search("priced"))

QUERIES = {
    "road_edges": (road_edges, v.sql("edge", "SELECT src, dst, length_m FROM edge")),
    "road_edges_summed": (
        road_edges_summed,
        v.sql(
            "way",
            """SELECT src, dst, sum(length_m) AS length_m FROM (SELECT src, dst, length_m FROM way WHERE oneway <> '-1'
            UNION ALL SELECT dst, src, length_m FROM way WHERE oneway <> 'yes') GROUP BY 1,2""",
        ),
    ),
    "edge_hazard_overlay": (
        edge_hazard_overlay,
        v.sql("edge node side", "SELECT src, dst, risk, hazard_code FROM risky", **_OVERLAY),
    ),
    "reported_edges": (reported_edges, v.sql("edge node", "SELECT * FROM marked", **_MARK)),
    "road_weights": (
        road_weights,
        v.sql(
            "edge node side",
            """SELECT src, dst, eff AS effective_risk, CASE report_rank WHEN 2 THEN length_m*1e6 WHEN 1 THEN greatest(length_m, length_m*20e0) ELSE length_m END AS fastest,
            CASE report_rank WHEN 2 THEN length_m*1e6 WHEN 1 THEN greatest(s, length_m*20e0) ELSE s END AS safest,
            CASE report_rank WHEN 2 THEN length_m*1e6 WHEN 1 THEN greatest(x, length_m*20e0) ELSE x END AS relaxed FROM (
            SELECT *, length_m*CASE WHEN st >= 8 THEN 1e6 ELSE st*st END AS s, length_m*CASE WHEN st >= 8 THEN 25e0 ELSE (st-1e0)*0.75e0+1e0 END AS x FROM (
            SELECT *, CASE eff WHEN 2 THEN 4e0 WHEN 4 THEN 8e0 ELSE eff END AS st FROM (
            SELECT r.*, m.report_rank, CASE m.report_rank WHEN 2 THEN 8e0 WHEN 1 THEN greatest(risk, 4e0) ELSE risk END AS eff
            FROM risky r JOIN marked m USING (src, dst))))""",
            **_OVERLAY,
            **_MARK,
        ),
    ),
    "mixed_junctions": (
        mixed_junctions,
        v.sql(
            "edge node side",
            """SELECT src, exits, extreme_exits FROM (SELECT src, count(*) AS exits, sum((risk = 8)::INT)::BIGINT AS extreme_exits FROM risky GROUP BY 1)
            WHERE exits > 1 AND extreme_exits > 0 AND extreme_exits < exits""",
            **_OVERLAY,
        ),
    ),
    "degree_filter": (
        degree_filter,
        v.sql(
            "edge",
            """SELECT src, dst, length_m FROM edge WHERE src IN (SELECT src FROM edge GROUP BY 1 HAVING count(*) >= 25)
            AND dst IN (SELECT src FROM edge GROUP BY 1 HAVING count(*) >= 25)""",
        ),
    ),
    "graph_integrity": (
        graph_integrity,
        v.sql(
            "edge node",
            """SELECT 'unknown_start' AS "check", count(*) AS n FROM edge WHERE src NOT IN (SELECT node_id FROM node)
            UNION ALL SELECT 'unknown_end', count(*) FROM edge WHERE dst NOT IN (SELECT node_id FROM node)
            UNION ALL SELECT 'repeated_edge', count(*) FROM (SELECT src, dst FROM edge GROUP BY 1,2 HAVING count(*) > 1)
            UNION ALL SELECT 'bad_edge', count(*) FROM edge WHERE length_m <= 0 OR src = dst""",
        ),
    ),
    "shortest_paths": (shortest_paths, _SP),
    "shortest_paths_by_chains": (shortest_paths_by_chains, _SP),
    "safest_costs": (
        safest_costs,
        v.sql("edge node side", "SELECT origin, node, cost FROM sp", **_OVERLAY, depot=_DEPOT, priced=_RELAXED, sp=_search("priced")),
    ),
    "nearest_by_cost": (
        nearest_by_cost,
        v.sql(
            "edge",
            """SELECT node, source, cost FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY cost, source) AS r FROM sp) WHERE r = 1""",
            depot="SELECT s_suppkey AS origin, s_suppkey*13 % n AS node FROM supplier, (SELECT count(*) AS n FROM part)",
            priced="SELECT dst AS src, src AS dst, length_m AS cost FROM edge",
            sp=_search("priced").replace("origin", "source").replace("SELECT source, node, 0e0 FROM depot", "SELECT origin, node, 0e0 FROM depot"),
        ),
    ),
    "farthest_within": (
        farthest_within,
        v.sql(
            "edge",
            """SELECT origin, node, cost FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY cost DESC, node) AS r FROM sp WHERE cost <= 150)
            WHERE r = 1""",
            depot=_DEPOT, priced=_COST, sp=_search("priced"),
        ),
    ),
    "road_components": (
        road_components,
        v.sql(
            "way",
            "SELECT node, min(c) AS component FROM cc GROUP BY 1",
            link="""SELECT src AS a, dst AS b FROM way WHERE length_m = 60 AND oneway = 'yes' UNION SELECT dst, src FROM way WHERE length_m = 60 AND oneway = 'yes'""",
            cc="""cc(node, c) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM link GROUP BY 1 UNION
            SELECT l.b, min(f.c) FROM cc f JOIN link l ON l.a = f.node JOIN recurring.cc p ON p.node = l.b WHERE f.c < p.c GROUP BY 1)""",
        ),
    ),
    "component_summary": (
        component_summary,
        v.sql(
            "way node",
            """SELECT c AS component, count(*) AS n, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat, min(lon) AS west, max(lon) AS east
            FROM cc JOIN node n ON n.node_id = cc.node GROUP BY 1""",
            link="""SELECT src AS a, dst AS b FROM way WHERE length_m = 60 AND oneway = 'yes' UNION SELECT dst, src FROM way WHERE length_m = 60 AND oneway = 'yes'""",
            cc="""cc(node, c) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM link GROUP BY 1 UNION
            SELECT l.b, min(f.c) FROM cc f JOIN link l ON l.a = f.node JOIN recurring.cc p ON p.node = l.b WHERE f.c < p.c GROUP BY 1)""",
        ),
    ),
    "nearest_reachable": (nearest_reachable, None),
    "safest_routes": (safest_routes, None),
    "mode_comparison": (mode_comparison, None),
    "edge_alternatives": (edge_alternatives, None),
    "route_hops": (
        route_hops,
        v.sql(
            "edge",
            """SELECT origin, node AS "end", cost AS length_m, 0::BIGINT AS first_hop FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY cost DESC, node DESC) AS r FROM sp)
            WHERE r = 1""",
            depot=_DEPOT, priced=_COST, sp=_search("priced"),
        ),
    ),
}
