"""Graph jobs on the map edges and spatial checks on a drawing of the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourceweave.catalog import corpus
from sourceweave.catalog.corpus import PRELUDE, table
from sourceweave.catalog.registry import query
from sourceweave.operators import aggregates, filters, graph, ordering, spatial
from sourceweave.plans import publish


def _map(spark, sf):
    return filters.map_edges(corpus.relationships(spark, sf))


def _degrees(spark, sf):
    people = corpus.people(spark, sf)
    return aggregates.degrees(_map(spark, sf), people).join(people.select("id", "pos"), "id")


_MAP = PRELUDE.replace("WITH nat", "WITH RECURSIVE nat", 1) + """,
m AS MATERIALIZED (SELECT * FROM rels WHERE certainty <> 'platonic'),
adj AS MATERIALIZED (SELECT a AS src, b AS dst, pos, id FROM m UNION ALL SELECT b, a, pos, id FROM m),
deg AS MATERIALIZED (SELECT p.id, p.pos, count(adj.src) AS degree FROM people p LEFT JOIN adj ON adj.src = p.id GROUP BY 1, 2),
reach AS (SELECT id, id AS r FROM people UNION SELECT reach.id, adj.dst FROM reach JOIN adj ON adj.src = reach.r),
comp AS MATERIALIZED (SELECT id, min(r) AS component FROM reach GROUP BY 1),
sizes AS (SELECT component, count(*) AS size, min(pos) AS first_pos FROM comp JOIN people USING (id) GROUP BY 1),
hub AS (SELECT id FROM deg ORDER BY degree DESC, pos LIMIT 1),
bfs AS (SELECT id, 0 AS depth FROM hub UNION SELECT adj.dst, depth + 1 FROM bfs JOIN adj ON adj.src = bfs.id WHERE depth < 40),
hops AS MATERIALIZED (SELECT id, min(depth) AS depth FROM bfs GROUP BY 1)
"""


@query("connected_components", _MAP + "SELECT id, component FROM comp")
def connected_components(spark, sf):
    return graph.connected_components(corpus.people(spark, sf), _map(spark, sf))


@query("component_sizes", _MAP + "SELECT component, CAST(size AS BIGINT) AS size, CAST(first_pos AS BIGINT) AS first_pos FROM sizes")
def component_sizes(spark, sf):
    s = graph.component_sizes(connected_components(spark, sf), corpus.people(spark, sf).select("id", "pos"))
    return s.orderBy(F.col("size").desc(), "first_pos")


@query("main_component", _MAP + "SELECT component FROM sizes ORDER BY size DESC, first_pos LIMIT 1")
def main_component(spark, sf):
    return graph.main_component(graph.component_sizes(connected_components(spark, sf), corpus.people(spark, sf).select("id", "pos")))


@query("map_singletons", _MAP + "SELECT id FROM deg WHERE degree = 0")
def map_singletons(spark, sf):
    return graph.singletons(connected_components(spark, sf), _degrees(spark, sf))


@query("tree_components", _MAP + """, e AS (SELECT component, count(*) AS n FROM m JOIN comp ON m.a = comp.id GROUP BY 1)
SELECT component, CAST(size AS BIGINT) AS nodes, CAST(coalesce(e.n, 0) AS BIGINT) AS edges, coalesce(e.n, 0) = size - 1 AS is_tree,
  (SELECT d.id FROM deg d JOIN comp c ON c.id = d.id WHERE c.component = sizes.component ORDER BY d.degree DESC, d.pos LIMIT 1) AS root
FROM sizes LEFT JOIN e USING (component) WHERE size >= 3""")
def tree_components(spark, sf):
    return graph.tree_components(connected_components(spark, sf), _map(spark, sf), corpus.people(spark, sf).select("id", "pos")).select(
        "component", "nodes", "edges", "is_tree", "root")


@query("hub", _MAP + "SELECT deg.id, CAST(degree AS BIGINT) AS degree FROM deg JOIN hub USING (id)")
def hub(spark, sf):
    return graph.hub(_degrees(spark, sf))


@query("nodes_by_degree", _MAP + "SELECT id, CAST(degree AS BIGINT) AS degree FROM deg")
def nodes_by_degree(spark, sf):
    return ordering.by_degree(_degrees(spark, sf)).select("id", "degree")


@query("adjacency", _MAP + "SELECT src, CAST(count(*) AS BIGINT) AS n, min(dst) AS first_dst, max(dst) AS last_dst FROM adj GROUP BY 1")
def adjacency(spark, sf):
    return graph.adjacency(_map(spark, sf)).groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("first_dst"), F.max("dst").alias("last_dst"))


@query("leaf_edges", _MAP + "SELECT m.id, p.degree = 1 OR q.degree = 1 AS leaf FROM m JOIN deg p ON m.a = p.id JOIN deg q ON m.b = q.id")
def leaf_edges(spark, sf):
    return graph.leaf_edges(_map(spark, sf), _degrees(spark, sf)).select("id", "leaf")


def _search(spark, sf):
    edges = _map(spark, sf).select("people", "pos")
    return graph.breadth_first(graph.hub(_degrees(spark, sf)).select("id"), edges)


@query("hops_from_hub", _MAP + "SELECT id, CAST(depth AS INT) AS depth FROM hops")
def hops_from_hub(spark, sf):
    return _search(spark, sf).select("id", "depth")


@query("search_tree_leaves")
def search_tree_leaves(spark, sf):
    """Leaves below each node of the search tree; the tree's parents follow queue order."""
    return graph.subtree_leaves(_search(spark, sf))


@query("leaf_clusters", _MAP + """, lf AS (SELECT src AS hub, dst FROM adj JOIN deg ON deg.id = adj.dst WHERE degree = 1),
h AS (SELECT hub FROM lf GROUP BY 1 HAVING count(*) BETWEEN 2 AND 8)
SELECT DISTINCT h.hub, adj.dst AS member, (SELECT degree FROM deg WHERE id = adj.dst) = 1 AS own FROM h JOIN adj ON adj.src = h.hub UNION ALL SELECT hub, hub, TRUE FROM h""")
def leaf_clusters(spark, sf):
    return graph.leaf_clusters(_map(spark, sf), _degrees(spark, sf))


@query("ego_networks", PRELUDE + "SELECT a AS person, b AS neighbour, id AS edge FROM rels UNION ALL SELECT b, a, id FROM rels")
def ego_networks(spark, sf):
    return graph.ego_networks(corpus.relationships(spark, sf))


# ------------------------------------------------------------------ drawing
# Every vector draws two short strokes from the point of its first two
# dimensions; the strokes share that point and end where further dimensions say.
def _nodes(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(7)])
    k = F.col("vec_id") * 3
    at = lambda n, x, y: F.struct((k + n).alias("node_id"), x.alias("x"), y.alias("y"), (F.lit(0.004) + F.abs(F.col("e6")) * 0.02).alias("r"))
    x, y = F.col("e0"), F.col("e1")
    return e.select(F.inline(F.array(
        at(0, x, y), at(1, x + F.col("e2") * 0.2, y + F.col("e3") * 0.2), at(2, x + F.col("e4") * 0.2, y + F.col("e5") * 0.2))))


def _edges(spark, sf):
    k = F.col("vec_id") * 3
    stroke = lambda n: F.struct((F.col("vec_id") * 2 + n - 1).alias("edge_id"), k.alias("a"), (k + n).alias("b"))
    return table(spark, sf, "embeddings").select(F.inline(F.array(stroke(1), stroke(2))))


_DRAW = """WITH e AS (SELECT vec_id AS v, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS d,
  CAST(embedding[5] AS DOUBLE) AS g, CAST(embedding[6] AS DOUBLE) AS h, 0.004::DOUBLE + abs(CAST(embedding[7] AS DOUBLE)) * 0.02::DOUBLE AS r FROM embeddings),
n AS (SELECT v * 3 AS node_id, x, y, r FROM e UNION ALL SELECT v * 3 + 1, x + c * 0.2::DOUBLE, y + d * 0.2::DOUBLE, r FROM e UNION ALL SELECT v * 3 + 2, x + g * 0.2::DOUBLE, y + h * 0.2::DOUBLE, r FROM e),
ed AS (SELECT v * 2 AS edge_id, v * 3 AS a, v * 3 + 1 AS b FROM e UNION ALL SELECT v * 2 + 1, v * 3, v * 3 + 2 FROM e),
s AS MATERIALIZED (SELECT edge_id, a, b, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2 FROM ed JOIN n p ON ed.a = p.node_id JOIN n q ON ed.b = q.node_id),
cr AS (SELECT l.edge_id AS e1, r.edge_id AS e2 FROM s l JOIN s r ON l.edge_id < r.edge_id AND l.a <> r.a AND l.a <> r.b AND l.b <> r.a AND l.b <> r.b
  WHERE ((r.y2 - l.y1) * (r.x1 - l.x1) > (r.y1 - l.y1) * (r.x2 - l.x1)) <> ((r.y2 - l.y2) * (r.x1 - l.x2) > (r.y1 - l.y2) * (r.x2 - l.x2))
    AND ((r.y1 - l.y1) * (l.x2 - l.x1) > (l.y2 - l.y1) * (r.x1 - l.x1)) <> ((r.y2 - l.y1) * (l.x2 - l.x1) > (l.y2 - l.y1) * (r.x2 - l.x1))),
ol AS (SELECT node_id, r, edge_id, sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2)) AS dist FROM (
  SELECT n.*, s.*, greatest(0.0, least(1.0, ((n.x - x1) * (x2 - x1) + (n.y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t
  FROM n JOIN s ON n.node_id <> s.a AND n.node_id <> s.b)),
onl AS (SELECT node_id, (list(edge_id ORDER BY dist, edge_id))[1] AS edge_id, CAST(round((any_value(r) - min(dist)) / any_value(r) * 100) AS BIGINT) AS into_ FROM ol WHERE dist < r GROUP BY 1),
ov AS (SELECT a.node_id AS n1, b.node_id AS n2 FROM n a JOIN n b ON a.node_id < b.node_id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < a.r + b.r)
"""


def _segments(spark, sf):
    return spatial.segments(_edges(spark, sf), _nodes(spark, sf))


@query("edge_crossings", _DRAW + "SELECT e1, e2 FROM cr")
def edge_crossings(spark, sf):
    return spatial.crossings(_segments(spark, sf))


@query("most_crossed_edges", _DRAW + "SELECT edge_id, CAST(count(*) AS BIGINT) AS crossings FROM (SELECT unnest([e1, e2]) AS edge_id FROM cr) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def most_crossed_edges(spark, sf):
    """The five most crossed edges: a top-k report."""
    return ordering.top(spatial.crossings_per_edge(spatial.crossings(_segments(spark, sf))), 5, F.col("crossings").desc(), "edge_id")


@query("nodes_on_lines", _DRAW + 'SELECT node_id, edge_id, into_ AS "into" FROM onl')
def nodes_on_lines(spark, sf):
    return spatial.nodes_on_lines(_segments(spark, sf), _nodes(spark, sf))


@query("node_overlaps", _DRAW + "SELECT n1, n2 FROM ov")
def node_overlaps(spark, sf):
    return spatial.overlaps(_nodes(spark, sf))


@query("drawing_quality", _DRAW + "SELECT 'crossings' AS metric, CAST((SELECT count(*) FROM cr) AS BIGINT) AS n UNION ALL SELECT 'nodes on lines', (SELECT count(*) FROM onl) UNION ALL SELECT 'overlaps', (SELECT count(*) FROM ov)")
def drawing_quality(spark, sf):
    return spatial.quality(_segments(spark, sf), _nodes(spark, sf))


def _moved(spark, sf):
    e = table(spark, sf, "embeddings")
    p = lambda i, j: e.select(F.col("vec_id").alias("node_id"), (F.col("embedding")[i].cast("double") * 1000).alias("x"), (F.col("embedding")[j].cast("double") * 1000).alias("y"))
    return spatial.drift(p(0, 1), p(2, 3))


_MOVED = """WITH d AS (SELECT vec_id AS node_id, CAST(round(sqrt(pow(CAST(embedding[1] AS DOUBLE) * 1000 - CAST(embedding[3] AS DOUBLE) * 1000, 2) + pow(CAST(embedding[2] AS DOUBLE) * 1000 - CAST(embedding[4] AS DOUBLE) * 1000, 2))) AS BIGINT) AS d FROM embeddings)
"""


@query("drift_median", _MOVED + "SELECT d AS median FROM d ORDER BY d DESC LIMIT 1 OFFSET (SELECT count(*) // 2 FROM d)")
def drift_median(spark, sf):
    return spatial.drift_median(_moved(spark, sf))


@query("most_drifted_nodes", _MOVED + "SELECT node_id, d FROM d ORDER BY d DESC, node_id LIMIT 5")
def most_drifted_nodes(spark, sf):
    return ordering.top(_moved(spark, sf), 5, F.col("d").desc(), "node_id")


@query("metric_comparison", """
WITH a AS (SELECT l_returnflag AS metric, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_returnflag AS metric, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT metric, CAST(b.n AS BIGINT) AS was, CAST(a.n AS BIGINT) AS now, CASE WHEN a.n = b.n THEN 'same' WHEN a.n < b.n THEN 'better' ELSE 'worse' END AS verdict, a.n > b.n AND metric <> 'N' AS regressed
FROM a FULL JOIN b USING (metric)""")
def metric_comparison(spark, sf):
    """Two snapshots of counts compared; one metric is neutral."""
    li = table(spark, sf, "lineitem")
    snap = lambda s: li.where(F.col("l_linestatus") == s).groupBy(F.col("l_returnflag").alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    return publish.compare_metrics(snap("F"), snap("O"), neutral=("N",))
