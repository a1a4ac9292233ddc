"""Golden results on small graphs, invariants, and brute force on random graphs."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideweave.model import TemporalGraph, edges_of
from tideweave.operators import bipartite, components, metrics, partitioning, sequential, summaries, transforms
from tideweave.operators import triangles as tri
from tideweave.operators.snapshots import Snapshot
from tideweave.operators.state import GraphState
from tideweave.sources.edges import sequence_edges

G7 = [(1, 2, 12), (1, 3, 13), (2, 3, 23), (3, 4, 34), (3, 5, 35), (4, 5, 45), (5, 1, 51)]
T15 = [(1, 2), (2, 3), (2, 6), (5, 6), (1, 4), (5, 3), (3, 4), (3, 6), (1, 3), (1, 7), (2, 7), (3, 8), (2, 8), (5, 9), (6, 9)]


def graph(spark, rows):
    rows = [(*r, 0)[:3] for r in rows]
    data = [(i, s, d, float(v), i) for i, (s, d, v) in enumerate(rows)]
    raw = spark.createDataFrame(data, "edge_id long, src long, dst long, value double, t long")
    return edges_of(raw.withColumn("valid_from", F.timestamp_millis(F.col("t")).cast("timestamp_ntz")).drop("t"))


@pytest.fixture(scope="module")
def g7(spark):
    return graph(spark, G7)


def triples(df):
    return sorted((r.src, r.dst, int(r.value)) for r in df.collect())


def test_filters(g7):
    g = TemporalGraph(g7)
    assert triples(g.filter_edges("value > 20").edges) == [e for e in sorted(G7) if e[2] > 20]
    assert triples(g.filter_edges("false").edges) == []
    assert triples(g.filter_vertices(lambda v: v > 1).edges) == [(2, 3, 23), (3, 4, 34), (3, 5, 35), (4, 5, 45)]
    assert triples(g.filter_vertices(lambda v: F.lit(False)).edges) == []


def test_maps(g7):
    assert triples(transforms.map_values(g7, F.col("value") + 1)) == sorted((s, d, v + 1) for s, d, v in G7)
    pairs = transforms.map_values(g7, F.struct(F.col("value").alias("a"), (F.col("value") + 1).alias("b")))
    assert sorted((r.src, r.dst, r.value.a, r.value.b) for r in pairs.collect()) == sorted((s, d, v, v + 1) for s, d, v in G7)


def test_reverse_undirected_union_distinct(g7):
    g = TemporalGraph(g7)
    back = sorted((d, s, v) for s, d, v in G7)
    assert triples(g.reverse().edges) == back
    assert triples(g.reverse().reverse().edges) == sorted(G7)
    assert triples(g.undirected().edges) == sorted(G7 + back)
    assert triples(g.union(g).edges) == sorted(G7 + G7)
    assert triples(g.union(g).distinct().edges) == sorted(G7)


def test_counts(g7):
    assert sorted(r.vertex for r in metrics.vertices(g7).collect()) == [1, 2, 3, 4, 5]
    assert sorted(r.n_edges for r in metrics.running_edge_count(g7).collect()) == list(range(1, 8))
    assert sorted(r.n_vertices for r in metrics.running_vertex_count(g7).collect()) == [1, 2, 3, 4, 5]
    assert metrics.vertex_count(g7, approximate=True).first()[0] == 5


@pytest.mark.parametrize(
    ("direction", "want"),
    [
        ("all", {1: [1, 2, 3], 2: [1, 2], 3: [1, 2, 3, 4], 4: [1, 2], 5: [1, 2, 3]}),
        ("in", {1: [1], 2: [1], 3: [1, 2], 4: [1], 5: [1, 2]}),
        ("out", {1: [1, 2], 2: [1], 3: [1, 2], 4: [1], 5: [1]}),
    ],
)
def test_running_degrees(g7, direction, want):
    got = defaultdict(list)
    for r in metrics.running_degrees(g7, direction).collect():
        got[r.vertex].append(r.degree)
    assert {v: sorted(d) for v, d in got.items()} == want
    assert {r.vertex: r.degree for r in metrics.degrees(g7, direction).collect()} == {v: max(d) for v, d in want.items()}


SLICES = {
    "out": {1: 25, 2: 23, 3: 69, 4: 45, 5: 51},
    "in": {1: 51, 2: 12, 3: 36, 4: 34, 5: 80},
    "all": {1: 76, 2: 35, 3: 105, 4: 79, 5: 131},
}


@pytest.mark.parametrize("direction", SLICES)
def test_slices(g7, direction):
    want = SLICES[direction]
    snap = Snapshot(g7, "1 second", direction=direction)
    assert {r.vertex: int(r.result) for r in snap.reduce().collect()} == want
    fold = snap.fold(F.lit(0.0), lambda s, v, n, x: s + x)
    assert {r.vertex: int(r.result) for r in fold.collect()} == want

    def size(rows: pd.DataFrame) -> pd.DataFrame:
        kind = "big" if rows["value"].sum() > 50 else "small"
        return pd.DataFrame([(rows["vertex"].iloc[0], kind)], columns=["vertex", "kind"])

    got = {r.vertex: r.kind for r in snap.apply(size, "vertex long, kind string").collect()}
    assert got == {v: "big" if s > 50 else "small" for v, s in want.items()}


def test_triangles_known(spark):
    t15 = graph(spark, T15)
    assert tri.triangle_count(t15).first()[0] == 7
    found = {(r.a, r.b, r.c) for r in tri.triangles(t15).collect()}
    assert found == {(1, 2, 3), (1, 3, 4), (1, 2, 7), (2, 3, 6), (3, 5, 6), (2, 3, 8), (5, 6, 9)}
    assert tri.estimate_expectation(t15).first()[0] == pytest.approx(7)
    window = F.window("valid_from", "1 second")["start"]
    w20 = sequence_edges(spark, 10).withColumn("w", window)
    # i, i+1, i+2 close a triangle when all three edges fall into one second.
    ts = {(i, i + s): (100 * i + 50 * (s - 1)) // 1000 for i in range(1, 11) for s in (1, 2)}
    want = Counter(
        ts[i, i + 1] for i in range(1, 10) if ts[i, i + 1] == ts[i + 1, i + 2] == ts[i, i + 2]
    )
    assert sorted(r.triangles for r in tri.triangle_count(w20, "w").collect()) == sorted(want.values())


def random_graph(seed, n=14, m=40):
    rnd = random.Random(seed)
    return [(rnd.randrange(n), rnd.randrange(n), rnd.randrange(1, 90)) for _ in range(m)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows = random_graph(seed)
    edges = graph(spark, rows)
    simple = {frozenset((s, d)) for s, d, _ in rows if s != d}
    nodes = sorted({v for s, d, _ in rows for v in (s, d)})
    want = [c for c in combinations(nodes, 3) if all(frozenset(p) in simple for p in combinations(c, 2))]
    assert tri.triangle_count(edges).first()[0] == len(want)
    per = Counter(v for c in want for v in c)
    got = {r.vertex: r.triangles for r in tri.triangles_per_vertex(edges).collect()}
    assert got.pop(-1, 0) == len(want) and got == dict(per)
    parts = tri.triangles_per_partition(edges, partitioning.owner(F.col("vertex"), 3)).collect()
    assert sum(r.triangles for r in parts) == len(want)
    assert tri.estimate_expectation(edges).first()[0] == pytest.approx(len(want))
    total = sum(r.degree for r in metrics.degrees(edges).collect())
    assert total == 2 * len(rows)
    root = {v: v for v in nodes}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    sign = {}
    for s, d, _ in rows:
        a, b = find(s), find(d)
        root[max(a, b)] = min(a, b)
    assert {r.vertex: r.component for r in components.connected_components(edges).collect()} == {v: find(v) for v in nodes}
    near = defaultdict(set)
    for s, d, _ in rows:
        near[s].add(d)
        near[d].add(s)
    odd = set()
    for v in nodes:
        if v in sign:
            continue
        sign[v], todo = True, [v]
        while todo:
            x = todo.pop()
            for y in near[x]:
                if y not in sign:
                    sign[y] = not sign[x]
                    todo.append(y)
                elif sign[y] == sign[x]:
                    odd.add(find(v))
    sides = {r.vertex: r for r in bipartite.bipartite_sides(edges).collect()}
    for v in nodes:
        assert sides[v].component == find(v) and sides[v].bipartite == (find(v) not in odd)
        assert sides[v].side == (None if find(v) in odd else sign[v])


def test_components_known(spark):
    two = sequence_edges(spark, 100, (2,))
    assert {r.component for r in components.connected_components(two).collect()} == {1, 2}
    path = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.component for r in components.connected_components(path).collect()} == {0}
    assert components.connected_components(path.where("false")).count() == 0
    forest = spark.range(1, 101).select((F.col("id") + 0).alias("src"), (F.col("id") * 2 + 1).alias("dst"))
    assert bipartite.is_bipartite(forest).first()[0]
    loop = spark.createDataFrame([(1, 1)], "src long, dst long")
    assert not bipartite.is_bipartite(loop).first()[0]
    assert bipartite.is_bipartite(loop.where("false")).first()[0]


@pytest.mark.parametrize("seed", [4, 5])
def test_matching(spark, seed):
    rows = random_graph(seed, 10, 60)
    edges = graph(spark, rows)
    state, want = {}, []
    for s, d, w in rows:
        hit = {state[v] for v in (s, d) if v in state}
        if w > 2 * sum(e[2] for e in hit):
            for e in sorted(hit):
                want.append(("REMOVE", *e))
                state = {v: x for v, x in state.items() if x != e}
            want.append(("ADD", s, d, w))
            state[s] = state[d] = (s, d, w)
    events = sequential.weighted_matching_events(edges, F.col("value"))
    assert [(r.op, r.src, r.dst, r.weight) for r in sorted(events.collect(), key=lambda r: r.seq)] == want
    final = [(r.src, r.dst) for r in sequential.matching_of(events).collect()]
    ends = [v for e in final for v in set(e)]
    assert len(ends) == len(set(ends)) and len(final) == len(set(state.values()))


def test_partitioners(spark):
    rows = random_graph(6, 30, 120)
    edges = graph(spark, rows)
    placed = partitioning.dbh_partition(edges, 4)
    assert placed.count() == len(rows)
    q = partitioning.partition_quality(placed).first()
    assert q.edges == len(rows) and q.max_load >= len(rows) / 4 and 1 <= q.replication <= 4
    adjacency = metrics.neighborhoods(edges, "all")
    n = adjacency.count()
    fennel = sequential.fennel_partition(adjacency, 4, n, len(rows)).collect()
    loads = Counter(r.partition_id for r in fennel)
    assert len(fennel) == n and max(loads.values()) <= (1.1 * 4 + n) / 4 + 1
    both = sequential.balanced_partition(edges, 4).collect()
    assert {r.edge_id for r in both} == set(range(len(rows)))
    home = defaultdict(set)
    for r in both:
        home[r.edge_id].add(r.partition_id)
    assert all(1 <= len(p) <= 2 for p in home.values())


def test_state_layouts_agree(spark):
    rows = random_graph(7, 8, 80)
    edges = graph(spark, rows)
    states = {layout: GraphState(edges, "40 milliseconds", "20 milliseconds", layout) for layout in ("EL", "sortedEL", "AL")}
    distinct = {k: {(r.fire, r.src, r.dst) for r in s.live().collect()} for k, s in states.items()}
    assert distinct["EL"] == distinct["sortedEL"] == distinct["AL"]
    assert states["EL"].live().count() > states["AL"].live().count() == len(distinct["AL"])
    lazy = GraphState(edges, "40 milliseconds", "20 milliseconds", "AL", lazy_purge=True, granularity="edge")
    assert sorted(lazy.triangles().collect()) == sorted(states["AL"].triangles().collect())
    pairs = spark.createDataFrame([(rows[0][0], rows[0][1]), (rows[0][0], 99), (99, 1)], "src long, dst long")
    got = {(r.src, r.dst): r.present for r in GraphState(edges, None).contains(pairs).collect()}
    assert list(got.values()).count(None) == 1 and got[rows[0][:2]] is True and got[rows[0][0], 99] is False
    with pytest.raises(ValueError):
        GraphState(edges, None, layout="CSR")


def test_custom_summary(spark):
    def update(state, rows):
        return state | set(rows["src"]) | set(rows["dst"])

    agg = summaries.SummaryAggregation(
        set, update, lambda a, b: a | b, lambda s: pd.DataFrame({"n": [len(s)]}), "n long"
    )
    edges = graph(spark, G7)
    assert [r.n for r in agg.run(edges.repartition(3), "1 second").collect()] == [5]


def test_changes_only(spark):
    rows = [(i, i * 40_000_000 // 7, "aabbbca"[i % 7]) for i in range(60)]
    df = spark.createDataFrame(rows, "edge_id long, ms long, x string")
    df = df.withColumn("valid_from", F.timestamp_millis("ms").cast("timestamp_ntz")).drop("ms")
    got = sorted(r.edge_id for r in metrics.changes_only(df, "x", ("valid_from", "edge_id")).collect())
    assert got == [i for i in range(60) if i == 0 or rows[i][2] != rows[i - 1][2]]


def test_shared_neighbours_of_edges(spark):
    """Loops, repeats, reversed edges and null ends; a hub's neighbours don't move to its edges."""
    rnd = random.Random(3)
    rows = [(rnd.randrange(30), rnd.randrange(12)) for _ in range(150)] + [(1, 1), (1, 1), (40, 40), (2, None), (None, 3), (None, None)]
    edges = edges_of(spark.createDataFrame(rows, "src long, dst long"))
    near = {}
    for a, b in rows:
        if a is not None and b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {(a, b): len(near.get(a, set()) & near.get(b, set())) if None not in (a, b) else 0 for a, b in rows}
    done = tri.shared_neighbours(edges)
    got = done.collect()
    assert len(got) == len(want) and {(r.src, r.dst): r.shared for r in got} == want
    assert "collect_" not in done._jdf.queryExecution().optimizedPlan().toString()
