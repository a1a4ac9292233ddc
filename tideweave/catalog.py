"""Named queries over the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideweave.functions.ids import as_text, hex_of_vertex, vertex_of_hex
from tideweave.functions.properties import from_json_text, get_property, set_property
from tideweave.model import ARRIVAL, TemporalGraph, edges_of
from tideweave.operators import bipartite, components, metrics, partitioning, sequential, summaries, transforms
from tideweave.operators import triangles as tri
from tideweave.operators.snapshots import Snapshot
from tideweave.operators.state import GraphState, inserted_in_batches
from tideweave.plans.lineage import made_path
from tideweave.sources import edges as sources
from tideweave.sources import files
from tideweave.sources.throttled import first_part, throttled_adjacency
from tideweave.streaming.live_state import stream_adjacency
from tideweave.streaming.matching import stream_matching
from tideweave.streaming.runs import read_state, rocksdb, run_to_table, run_until

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PARTS = 4

#: The event graph in SQL, without loops and repeats, and per day.
E = """e as (
    select event_id as id, user_id as src, cast(json_extract_string(props, '$.k') as bigint) as dst,
           ts, value, event_type as label
    from events
)"""
U = "u as (select distinct least(src, dst) as a, greatest(src, dst) as b from e where src <> dst)"
ENDS = """n as (
    select id, src as vertex, dst as other, 0 as side, ts, value from e
    union all select id, dst, src, 1, ts, value from e
)"""
T = """t as (
    select x.a, x.b, y.b as c from u x join u y on x.b = y.a join u z on z.a = x.a and z.b = y.b
)"""
BOTH = "b as (select distinct src as a, dst as b from e union select dst, src from e)"
REACH = "r(v, w) as (select a, a from b union select r.v, b.b from r join b on r.w = b.a)"
HOPS = "h as (select unnest([0, 1, 2]) as i)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.event_edges(spark, sf_dir).drop("valid_to")


# ------------------------------------------------------------------ edge-wise
@query(f"with {E} select id as edge_id, label, src, dst, value, ts as valid_from from e")
def edges_scan(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(f"with {E} select src, dst from e")
def edges_projection(spark, sf_dir):
    return _edges(spark, sf_dir).select("src", "dst")


@query(f"with {E} select id as edge_id, src, dst, value from e where label = 'purchase' and value > 20")
def filter_edges(spark, sf_dir):
    graph = TemporalGraph(_edges(spark, sf_dir)).filter_edges("label = 'purchase' and value > 20")
    return graph.edges.select("edge_id", "src", "dst", "value")


@query(f"with {E} select id as edge_id, src, dst from e where src > 5 and dst > 5")
def filter_vertices(spark, sf_dir):
    return TemporalGraph(_edges(spark, sf_dir)).filter_vertices(lambda v: v > 5).edges.select("edge_id", "src", "dst")


@query(f"""with {E}, d as (select src as v, count(*) as n from e group by src having count(*) >= 60)
    select id as edge_id, src, dst from e where src in (select v from d) and dst in (select v from d)""")
def keep_vertices(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    busy = metrics.degrees(edges, "out").where("degree >= 60")
    return transforms.keep_vertices(edges, busy).select("edge_id", "src", "dst")


@query(f"with {E} select id as edge_id, src, dst, value + 1 as value from e")
def map_edges(spark, sf_dir):
    return transforms.map_values(_edges(spark, sf_dir), F.col("value") + 1).select("edge_id", "src", "dst", "value")


@query(f"with {E} select id as edge_id, src, dst, value + 1 as first, (value + 1) * 2 as second from e")
def map_edges_chained(spark, sf_dir):
    graph = TemporalGraph(_edges(spark, sf_dir)).map_edges(lambda d: transforms.map_values(d, F.col("value") + 1))
    graph = graph.map_edges(lambda d: d.withColumnsRenamed({"value": "first"}).withColumn("second", F.col("first") * 2))
    return graph.edges.select("edge_id", "src", "dst", "first", "second")


@query(f"with {E} select id as edge_id, label, dst as src, src as dst, value, ts as valid_from from e")
def reverse_edges(spark, sf_dir):
    return TemporalGraph(_edges(spark, sf_dir)).reverse().edges


@query(f"with {E} select id as edge_id, src, dst from e union all select id, dst, src from e")
def undirected_edges(spark, sf_dir):
    return TemporalGraph(_edges(spark, sf_dir)).undirected().edges.select("edge_id", "src", "dst")


@query(f"""with {E} select id as edge_id, src, dst, label from e where label = 'purchase'
    union all select id, src, dst, label from e where value > 50""")
def union_edges(spark, sf_dir):
    graph = TemporalGraph(_edges(spark, sf_dir))
    both = graph.filter_edges("label = 'purchase'").union(graph.filter_edges("value > 50"))
    return both.edges.select("edge_id", "src", "dst", "label")


@query("""select event_id as edge_id, event_type as kind, json_extract_string(props, '$.k') as k, 'seen' as state
    from events""")
def edge_properties(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    made = events.select(F.col("event_id").alias("edge_id"), from_json_text(F.col("props")).alias("properties"), "event_type")
    made = made.withColumn("properties", set_property(F.col("properties"), "kind", F.col("event_type")))
    made = made.withColumn("properties", set_property(F.col("properties"), "state", F.lit("seen")))
    names = ("kind", "k", "state")
    return made.select("edge_id", *(get_property(F.col("properties"), n).alias(n) for n in names))


@query(f"""with {E} select id as edge_id, src + dst as total from e where value > 50""")
def map_rows_in_python(spark, sf_dir):
    import pandas as pd

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["value"] > 50]
        return pd.DataFrame({"edge_id": rows["edge_id"], "total": rows["src"] + rows["dst"]})

    edges = _edges(spark, sf_dir).select("edge_id", "src", "dst", "value")
    return transforms.map_rows(edges, total, "edge_id long, total long")


@query(f"""with {E} select id as edge_id, src, dst from e
    qualify row_number() over (partition by src, dst order by ts, id) = 1""")
def distinct_edges(spark, sf_dir):
    return TemporalGraph(_edges(spark, sf_dir)).distinct().edges.select("edge_id", "src", "dst")


@query("""select l_partkey as src, l_suppkey + 1000000 as dst, l_quantity as value, l_shipdate as valid_from
    from lineitem""")
def bipartite_edges(spark, sf_dir):
    return sources.part_supplier_edges(spark, sf_dir).select("src", "dst", "value", "valid_from")


# -------------------------------------------------------------------- metrics
@query(f"with {E}, {ENDS} select vertex, min(ts) as valid_from from n group by vertex")
def vertices(spark, sf_dir):
    return TemporalGraph(_edges(spark, sf_dir)).vertices()


def _degrees_sql(where: str = "") -> str:
    return f"""with {E}, {ENDS} select vertex, count(*) as degree, min(ts) as valid_from from n {where} group by vertex"""


@query(_degrees_sql())
def degrees(spark, sf_dir):
    return TemporalGraph(_edges(spark, sf_dir)).degrees()


@query(_degrees_sql("where side = 1"))
def in_degrees(spark, sf_dir):
    return TemporalGraph(_edges(spark, sf_dir)).degrees("in")


@query(_degrees_sql("where side = 0"))
def out_degrees(spark, sf_dir):
    return TemporalGraph(_edges(spark, sf_dir)).degrees("out")


@query(f"""with {E}, {ENDS} select id as edge_id, vertex, side, count(*) over (
    partition by vertex order by ts, id, side rows unbounded preceding) as degree from n""")
def running_degrees(spark, sf_dir):
    return TemporalGraph(_edges(spark, sf_dir)).running_degrees()


@query(f"with {E} select id as edge_id, row_number() over (order by ts, id) as n_edges from e")
def number_of_edges(spark, sf_dir):
    return metrics.running_edge_count(_edges(spark, sf_dir))


@query(f"""with {E}, {ENDS}, f as (
        select *, row_number() over (partition by vertex order by ts, id, side) as k from n
    ) select id as edge_id, vertex, row_number() over (order by ts, id, side) as n_vertices from f where k = 1""")
def number_of_vertices(spark, sf_dir):
    return metrics.running_vertex_count(_edges(spark, sf_dir))


@query(f"with {E}, {ENDS} select count(distinct vertex) as n_vertices from n")
def vertex_count(spark, sf_dir):
    return metrics.vertex_count(_edges(spark, sf_dir))


@query("select true as close")
def vertex_count_approximate(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    both = metrics.vertex_count(edges, approximate=True).withColumnRenamed("n_vertices", "sketch")
    both = both.withColumn("k", F.lit(1)).join(metrics.vertex_count(edges).withColumn("k", F.lit(1)), "k")  # single rows
    return both.select((F.abs(F.col("sketch") - F.col("n_vertices")) <= 0.1 * F.col("n_vertices")).alias("close"))


@query(f"""with {E} select id as edge_id, printf('%08x', src) || repeat('0', 16) as src_hex, src, dst from e""")
def hex_ids(spark, sf_dir):
    hexed = _edges(spark, sf_dir).withColumn("src_hex", hex_of_vertex(F.col("src")))
    return hexed.select("edge_id", "src_hex", vertex_of_hex(F.col("src_hex")).alias("src"), "dst")


@query(f"""with {E}, {BOTH} select p.src, p.dst, count(y.b) as shared
    from (select distinct src, dst from e) p left join b x on x.a = p.src left join b y on y.a = p.dst and y.b = x.b
    group by p.src, p.dst""")
def shared_neighbours(spark, sf_dir):
    return tri.shared_neighbours(_edges(spark, sf_dir))


@query(f"""with {E}, {ENDS} select vertex, max(value) as largest, min(other) as nearest, count(distinct other) as others
    from n group by vertex""")
def vertex_aggregate(spark, sf_dir):
    return metrics.vertex_aggregate(
        _edges(spark, sf_dir),
        F.max("value").alias("largest"),
        F.min("other").alias("nearest"),
        F.count_distinct("other").alias("others"),
    )


@query(f"""with {E}, l as (select *, lag(label) over (order by ts, id) as p, row_number() over (order by ts, id) as k from e)
    select id as edge_id, ts as valid_from, label from l where k = 1 or label is distinct from p""")
def global_aggregate_changes(spark, sf_dir):
    rows = _edges(spark, sf_dir).select("edge_id", "valid_from", "label")
    return metrics.changes_only(rows, "label", ARRIVAL)


@query(f"""with {E} select src as vertex, string_agg(dst, ',' order by dst) as nbrs
    from (select distinct src, dst from e) group by src""")
def neighborhoods(spark, sf_dir):
    return metrics.neighborhoods(_edges(spark, sf_dir)).select("vertex", as_text(F.col("nbrs")).alias("nbrs"))


@query(f"""with {E}, f as (
        select src, dst, ts, id, row_number() over (partition by src, dst order by ts, id) as k from e
    ) select e.id as edge_id, e.src, e.dst, string_agg(f.dst, ',' order by f.dst) as nbrs
    from e join f on f.src = e.src and f.k = 1 and (f.ts, f.id) <= (e.ts, e.id) group by e.id, e.src, e.dst""")
def running_neighborhoods(spark, sf_dir):
    rows = metrics.running_neighborhoods(_edges(spark, sf_dir))
    return rows.select("edge_id", "src", "dst", as_text(F.col("nbrs")).alias("nbrs"))


# ------------------------------------------------------------------- snapshots
def _reduce_sql(where: str) -> str:
    return f"""with {E}, {ENDS} select cast(date_trunc('day', ts) as timestamp) as window_start, vertex,
        round(sum(value), 4) as total, max(value) as largest from n {where} group by 1, 2"""


def _reduced(spark: SparkSession, sf_dir: str, direction: str) -> DataFrame:
    snap = TemporalGraph(_edges(spark, sf_dir)).slice("1 day", direction=direction)
    return snap.aggregate(F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("largest")).drop("window_end")


@query(_reduce_sql("where side = 0"))
def snapshot_reduce_out(spark, sf_dir):
    return _reduced(spark, sf_dir, "out")


@query(_reduce_sql("where side = 1"))
def snapshot_reduce_in(spark, sf_dir):
    return _reduced(spark, sf_dir, "in")


@query(_reduce_sql(""))
def snapshot_reduce_all(spark, sf_dir):
    return _reduced(spark, sf_dir, "all")


@query(f"""with {E}, {ENDS} select cast(date_trunc('day', ts) as timestamp) as window_start, vertex, min(value) as result
    from n where side = 1 group by 1, 2""")
def snapshot_reduce(spark, sf_dir):
    return Snapshot(_edges(spark, sf_dir), "1 day", direction="in").reduce(F.min).drop("window_end")


@query(f"""with {E}, {ENDS} select cast(date_trunc('day', ts) as timestamp) as window_start, vertex,
    coalesce(max(value) filter (where value > 50), min(value)) as result from n group by 1, 2""")
def snapshot_reduce_custom(spark, sf_dir):
    def keep(a, b):  # the largest above 50, else the smallest
        top = F.greatest(a, b)
        return F.when(top > 50, top).otherwise(F.least(a, b))

    return Snapshot(_edges(spark, sf_dir), "1 day", direction="all").reduce_pairs(keep).drop("window_end")


@query(f"""with {E} select cast(date_trunc('day', ts) as timestamp) as window_start, src as vertex,
    string_agg(dst, '>' order by ts, id) as walk from e group by 1, 2""")
def snapshot_fold(spark, sf_dir):
    snap = Snapshot(_edges(spark, sf_dir), "1 day")
    walk = snap.fold(
        F.lit(""),
        lambda s, v, n, x: F.when(s == "", n.cast("string")).otherwise(F.concat(s, F.lit(">"), n.cast("string"))),
        "walk",
    )
    return walk.drop("window_end")


@query(f"""with {E}, {ENDS} select cast(date_trunc('day', ts) as timestamp) as window_start, vertex,
    case when count(*) > 10 then 'big' else 'small' end as kind, count(distinct other) as others from n group by 1, 2""")
def snapshot_apply(spark, sf_dir):
    import pandas as pd

    def kind(rows: pd.DataFrame) -> pd.DataFrame:
        name = "big" if len(rows) > 10 else "small"
        first = rows.iloc[0]
        row = (first["window_start"], first["vertex"], name, rows["other"].nunique())
        return pd.DataFrame([row], columns=["window_start", "vertex", "kind", "others"])

    snap = Snapshot(_edges(spark, sf_dir), "1 day", direction="all")
    return snap.apply(kind, "window_start timestamp_ntz, vertex long, kind string, others long")


@query(f"""with {E}, {HOPS} select cast(date_trunc('day', ts) - i * interval 1 day as timestamp) as window_start,
    src as vertex, count(*) as n, max(value) as largest from e, h group by 1, 2""")
def sliding_snapshot(spark, sf_dir):
    snap = Snapshot(_edges(spark, sf_dir), "3 days", "1 day")
    return snap.aggregate(F.count("*").alias("n"), F.max("value").alias("largest")).drop("window_end")


# ------------------------------------------------------------------- triangles
@query(f"""with {E}, u as (
        select distinct cast(date_trunc('day', ts) as timestamp) as w, least(src, dst) as a, greatest(src, dst) as b
        from e where src <> dst
    ) select x.w as window_start, count(*) as triangles from u x join u y on x.w = y.w and x.b = y.a
    join u z on z.w = x.w and z.a = x.a and z.b = y.b group by x.w""")
def window_triangles(spark, sf_dir):
    edges = _edges(spark, sf_dir).withColumn("window_start", F.window("valid_from", "1 day")["start"])
    return tri.triangle_count(edges, "window_start")


@query(f"""with {E}, {HOPS}, u as (
        select distinct cast(date_trunc('day', ts) - i * interval 1 day as timestamp) as w,
            least(src, dst) as a, greatest(src, dst) as b from e, h where src <> dst
    ) select x.w as window_start, count(*) as triangles from u x join u y on x.w = y.w and x.b = y.a
    join u z on z.w = x.w and z.a = x.a and z.b = y.b group by x.w""")
def sliding_window_triangles(spark, sf_dir):
    edges = _edges(spark, sf_dir).withColumn("window_start", F.window("valid_from", "3 days", "1 day")["start"])
    return tri.triangle_count(edges, "window_start")


@query(f"with {E}, {U}, {T} select count(*) as triangles from t")
def triangle_count(spark, sf_dir):
    return tri.triangle_count(_edges(spark, sf_dir))


@query(f"""with {E}, {U}, {T} select v as vertex, count(*) as triangles
    from (select unnest([a, b, c, -1]) as v from t) group by v""")
def triangles_per_vertex(spark, sf_dir):
    return tri.triangles_per_vertex(_edges(spark, sf_dir))


_COMPLETED = """o as (select *, row_number() over (order by ts, id) as k from e),
    f as (select least(src, dst) as a, greatest(src, dst) as b, min(k) as k from o where src <> dst group by 1, 2),
    c as (select x.a, x.b, y.b as c, greatest(x.k, y.k, z.k) as k
        from f x join f y on x.b = y.a join f z on z.a = x.a and z.b = y.b)"""


@query(f"""with {E}, {_COMPLETED}, m as (select unnest([a, b, c, -1]) as vertex, k from c),
    n as (select vertex, k, count(*) as n from m group by all)
    select vertex, o.id as edge_id, cast(sum(n) over (partition by vertex order by n.k) as bigint) as triangles
    from n join o on o.k = n.k""")
def running_triangles(spark, sf_dir):
    return tri.running_triangles(_edges(spark, sf_dir))


@query(f"with {E}, {U}, {T} select cast(a % 4 as integer) as partition_id, count(*) as triangles from t group by 1")
def triangles_per_partition(spark, sf_dir):
    return tri.triangles_per_partition(_edges(spark, sf_dir), partitioning.owner(F.col("vertex"), PARTS))


_ESTIMATE = """a as (select distinct * from (select src as u, dst as v from e union all select dst, src from e){where}),
    d as (select u, count(*) as d from a group by u),
    s as (select x.u, x.v, count(*) as s from a x join a y on x.u = y.u join a z on z.u = y.v and z.v = x.v group by 1, 2)
    select round(sum(coalesce(s, 0) * dv.d / (3.0 * (du.d + dv.d))), 6) as triangles
    from a left join s using (u, v) join d du on du.u = a.u join d dv on dv.u = a.v"""


@query(f"with {E}, " + _ESTIMATE.format(where=" where u <> v"))
def estimate_triangles_expectation(spark, sf_dir):
    return tri.estimate_expectation(_edges(spark, sf_dir))


@query(f"with {E}, " + _ESTIMATE.format(where=""))
def estimate_triangles_with_loops(spark, sf_dir):
    return tri.estimate_expectation(_edges(spark, sf_dir), keep_loops=True)


_HASH = "({} + 7) * 2654435761 % 4294967296"


@query(f"""with {E}, a as (select distinct * from (select src as u, dst as v from e union all select dst, src from e) where u <> v),
    d as (select u, cast(count(*) as double) as d from a group by u),
    s as (select x.u, x.v, cast(count(*) as double) as s from a x join a y on x.u = y.u join a z on z.u = y.v and z.v = x.v
        where {_HASH.format('x.u')} < 429496729 group by 1, 2),
    r as (select a.u, coalesce(s, 0.0) * du.d * dv.d / (3.0 * (du.d + dv.d)) as lam,
            row_number() over (partition by a.u order by {_HASH.format('(a.u * 31 + a.v)')}, a.v) as k
        from a left join s using (u, v) join d du on du.u = a.u join d dv on dv.u = a.v
        where {_HASH.format('a.u')} < 429496729)
    select round(coalesce(avg(lam) * (select count(*) from d), 0.0), 6) as triangles, count(*) as samples from r where k = 1""")
def estimate_triangles_sampled(spark, sf_dir):
    return tri.estimate_sampled(_edges(spark, sf_dir))


# ------------------------------------------------- components, sides, matching
@query(f"with recursive {E}, {BOTH}, {REACH} select v as vertex, min(w) as component from r group by v")
def connected_components(spark, sf_dir):
    return components.connected_components(_edges(spark, sf_dir))


@query(f"""with recursive {E}, {BOTH}, {REACH}, c as (select v, min(w) as component from r group by v)
    select component, count(*) as n_vertices from c group by component""")
def component_sizes(spark, sf_dir):
    labels = components.connected_components(_edges(spark, sf_dir))
    return labels.groupBy("component").agg(F.count("*").alias("n_vertices"))


_COVER = """b as (
        select 2 * src as a, 2 * {dst} + 1 as b from e union select 2 * {dst} + 1, 2 * src from e
        union select 2 * src + 1, 2 * {dst} from e union select 2 * {dst}, 2 * src + 1 from e
    ), r(v, w) as (select a, a from b union select r.v, b.b from r join b on r.w = b.a),
    m as (select v, min(w) as w from r group by v),
    p as (select x.v // 2 as vertex, x.w as plus, y.w as minus from m x join m y on y.v = x.v + 1 where x.v % 2 = 0)"""


@query(f"with recursive {E}, {_COVER.format(dst='dst')} select bool_and(plus <> minus) as bipartite from p")
def bipartiteness(spark, sf_dir):
    return bipartite.is_bipartite(_edges(spark, sf_dir))


@query("select count(*) filter (where l_partkey >= 1000000) = 0 as bipartite from lineitem")
def bipartiteness_of_parts(spark, sf_dir):
    return bipartite.is_bipartite(sources.part_supplier_edges(spark, sf_dir))


@query(f"""with recursive {E}, {_COVER.format(dst='(dst + 1000000)')}
    select vertex, least(plus // 2, minus // 2) as component,
        case when plus <> minus then plus % 2 = 0 end as side, plus <> minus as bipartite from p""")
def bipartite_sides(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return bipartite.bipartite_sides(edges.withColumn("dst", F.col("dst") + sources.BIPARTITE_OFFSET))


_NONE = "cast([] as struct(a bigint, b bigint, w bigint)[])"
#: One edge after the other; the state is the list of matched edges.
_MATCHING = f"""with recursive {E}, o as materialized (
        select row_number() over (order by ts, id) as k, src, dst, cast(round(value * 100) as bigint) as w
        from e where value is not null
    ), s(k, m, hit, ok, src, dst, w) as (
        select cast(0 as bigint), {_NONE}, {_NONE}, false, cast(0 as bigint), cast(0 as bigint), cast(0 as bigint)
        union all
        select k, case when ok then list_append(list_filter(m, lambda x: x.a not in (src, dst) and x.b not in (src, dst)),
                {{'a': src, 'b': dst, 'w': w}}) else m end, case when ok then list_sort(hit) else [] end, ok, src, dst, w
        from (select *, w > 2 * coalesce(list_sum(list_transform(hit, lambda x: x.w)), 0) as ok from (
            select o.k, s.m, o.src, o.dst, o.w,
                list_filter(s.m, lambda x: x.a in (o.src, o.dst) or x.b in (o.src, o.dst)) as hit
            from s join o on o.k = s.k + 1))
    ), v as (
        select k, i, 'REMOVE' as op, h.a as src, h.b as dst, h.w as weight
        from (select k, unnest(hit) as h, unnest(range(len(hit))) as i from s where ok)
        union all select k, len(hit), 'ADD', src, dst, w from s where ok
    )
    select row_number() over (order by k, i) - 1 as seq, op, src, dst, weight from v"""


@query(_MATCHING)
def weighted_matching_events(spark, sf_dir):
    return sequential.weighted_matching_events(_edges(spark, sf_dir), F.round(F.col("value") * 100))


@query(f"""with {E}, d as (
        select cast(date_trunc('day', ts) as timestamp) as window_start, count(*) as n, max(value) as largest from e group by 1
    ) select window_start, cast(sum(n) over (order by window_start) as bigint) as n,
        max(largest) over (order by window_start) as largest from d""")
def summary_cumulative(spark, sf_dir):
    per = summaries.windowed_summary(
        _edges(spark, sf_dir), "1 day", F.count("*").alias("n"), F.max("value").alias("largest")
    )
    return summaries.cumulative_summary(per, {"n": F.sum, "largest": F.max})


@query(f"""with {E} select cast(date_trunc('day', ts) as timestamp) as window_start, src % 10 as kind,
    count(distinct src) as sources, count(*) as n from e group by 1, 2""")
def summary_custom(spark, sf_dir):
    import pandas as pd

    def update(state, rows):
        for src in rows["src"].tolist():
            seen, n = state.get(src % 10, (frozenset(), 0))
            state[src % 10] = (seen | {src}, n + 1)
        return state

    def combine(a, b):
        for k, (seen, n) in b.items():
            held, m = a.get(k, (frozenset(), 0))
            a[k] = (held | seen, m + n)
        return a

    def transform(state):
        rows = [(k, len(seen), n) for k, (seen, n) in sorted(state.items())]
        return pd.DataFrame(rows, columns=["kind", "sources", "n"])

    custom = summaries.SummaryAggregation(dict, update, combine, transform, "kind long, sources long, n long")
    return custom.run(_edges(spark, sf_dir), "1 day")


# ----------------------------------------------------------------- graph state
def _state(spark: SparkSession, sf_dir: str, layout: str = "AL") -> GraphState:
    return GraphState(_edges(spark, sf_dir), "3 days", "1 day", layout, PARTS)


LIVE = "l as (select cast(date_trunc('day', ts) - i * interval 1 day + interval 3 day as timestamp) as fire, e.* from e, h)"
AL = """al as (select distinct fire, src, dst, cast(src % 4 as integer) as partition_id from l)"""


@query(f"with {E}, {HOPS}, {LIVE} select fire, src, dst, id as edge_id, cast(src % 4 as integer) as partition_id from l")
def live_edges_el(spark, sf_dir):
    return _state(spark, sf_dir, "EL").live().drop("valid_from")


@query(f"""with {E}, {HOPS}, {LIVE} select fire, src, cast(src % 4 as integer) as partition_id,
    string_agg(dst, ',' order by dst) as nbrs from l group by all""")
def live_edges_sorted_el(spark, sf_dir):
    return _state(spark, sf_dir, "sortedEL").state().withColumn("nbrs", as_text(F.col("nbrs")))


@query(f"""with {E}, {HOPS}, {LIVE}, {AL} select fire, src, partition_id,
    string_agg(dst, ',' order by dst) as nbrs from al group by all""")
def live_edges_al(spark, sf_dir):
    return _state(spark, sf_dir).state().withColumn("nbrs", as_text(F.col("nbrs")))


@query(f"""with {E}, {HOPS}, {LIVE}, {AL} select partition_id, cast(fire - interval 3 day as timestamp) as window_start,
    fire as window_end, count(*) as n_edges from al group by partition_id, fire""")
def state_fires(spark, sf_dir):
    return _state(spark, sf_dir).fires()


@query(f"with {E}, {HOPS}, {LIVE}, {AL} select fire, partition_id, count(*) as n_entries from al group by all")
def al_state_size(spark, sf_dir):
    return _state(spark, sf_dir).size_per_partition()


@query(f"""with {E}, {HOPS}, {LIVE}, {AL} select fire, src, string_agg(dst, ',' order by dst) as nbrs from al
    where partition_id = 2 group by fire, src""")
def al_partition_lookup(spark, sf_dir):
    return _state(spark, sf_dir).partition(2).select("fire", "src", as_text(F.col("nbrs")).alias("nbrs"))


@query(f"""with {E} select src, string_agg(distinct dst, ',' order by dst) as nbrs from e where src in
    (select dst from e) group by src""")
def al_vertex_lookup(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    asked = edges.select(F.col("dst").alias("vertex"))
    found = GraphState(edges, None).neighbours(asked)
    return found.select("src", as_text(F.col("nbrs")).alias("nbrs"))


@query(f"""with {E} select q.src, q.dst, case when exists (select 1 from e where e.src = q.src and e.dst = q.dst) then true
    when exists (select 1 from e where e.src = q.src) then false end as present
    from (select distinct dst as src, src as dst from e) q""")
def al_edge_contains(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    asked = transforms.reverse(edges).select("src", "dst").distinct()
    return GraphState(edges, None).contains(asked)


@query(f"""with {E} select src, string_agg(distinct dst, ',' order by dst) as nbrs,
    (select count(distinct src) from e) as n_live from e where src in (select dst from e) group by src""")
def al_vertex_lookup_total(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    found = GraphState(edges, None).neighbours_with_total(edges.select(F.col("dst").alias("vertex")))
    return found.select("src", as_text(F.col("nbrs")).alias("nbrs"), "n_live")


@query(f"with {E} select distinct x.src, x.dst from e x join e y on x.src = y.dst and x.dst = y.src")
def al_edge_lookup(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return GraphState(edges, None).edge(transforms.reverse(edges))


#: A range of live time, from the tables' own bounds: the middle third of the events' days.
_RANGE = """r as (select min(ts) + (max(ts) - min(ts)) / 3 as lo, min(ts) + (max(ts) - min(ts)) / 3 * 2 as hi from events),
    g as (select e.* from e, r where ts >= lo and ts < hi)"""


def _between(edges: DataFrame):
    lo, hi = edges.agg(F.min("valid_from"), F.max("valid_from")).first()
    third = (hi - lo) / 3
    return (F.col("valid_from") >= F.lit(lo + third).cast("timestamp_ntz")) & (
        F.col("valid_from") < F.lit(lo + third * 2).cast("timestamp_ntz")
    )


@query(f"""with {E}, {_RANGE} select src, string_agg(distinct dst, ',' order by dst) as nbrs from g
    where src in (select dst from e) group by src""")
def al_vertex_lookup_range(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    found = GraphState(edges, None, layout="EL").neighbours(edges.select(F.col("dst").alias("vertex")), _between(edges))
    return found.select("src", as_text(F.col("nbrs")).alias("nbrs"))


@query(f"""with {E}, {_RANGE} select src, string_agg(distinct dst, ',' order by dst) as nbrs,
    (select count(distinct src) from g) as n_live from g where src in (select dst from e) group by src""")
def al_vertex_lookup_total_range(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    asked = edges.select(F.col("dst").alias("vertex"))
    found = GraphState(edges, None, layout="EL").neighbours_with_total(asked, _between(edges))
    return found.select("src", as_text(F.col("nbrs")).alias("nbrs"), "n_live")


@query(f"""with {E}, {_RANGE} select q.src, q.dst,
    case when exists (select 1 from g where g.src = q.src and g.dst = q.dst) then true
    when exists (select 1 from g where g.src = q.src) then false end as present
    from (select distinct dst as src, src as dst from e) q""")
def al_edge_contains_range(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    asked = transforms.reverse(edges).select("src", "dst").distinct()
    return GraphState(edges, None, layout="EL").contains(asked, _between(edges))


@query(f"with {E}, {_RANGE} select distinct x.src, x.dst from g x join e y on x.src = y.dst and x.dst = y.src")
def al_edge_lookup_range(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return GraphState(edges, None, layout="EL").edge(transforms.reverse(edges), _between(edges))


@query(f"with {E}, {_RANGE} select distinct src from g")
def al_vertex_list_range(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return GraphState(edges, None, layout="EL").live_vertices(_between(edges))


_FIRE_LOADS = f"""with {E}, {{hops}}, {{live}} select fire, count(*) as n_edges, count(distinct src) as sources from {{rows}} group by fire"""


def _loads(live: DataFrame) -> DataFrame:
    return live.groupBy("fire").agg(F.count("*").alias("n_edges"), F.count_distinct("src").alias("sources"))


@query(_FIRE_LOADS.format(hops=HOPS, live=LIVE, rows="l"))
def state_run_el(spark, sf_dir):
    return _state(spark, sf_dir, "EL").run(_loads)


@query(_FIRE_LOADS.format(hops=HOPS, live=LIVE, rows="l"))
def state_run_sorted_el(spark, sf_dir):
    return _state(spark, sf_dir, "sortedEL").run(_loads)


@query(_FIRE_LOADS.format(hops=HOPS, live=f"{LIVE}, {AL}", rows="al"))
def state_run_al(spark, sf_dir):
    return _state(spark, sf_dir).run(_loads)


@query(_FIRE_LOADS.format(hops=HOPS, live=f"{LIVE}, {AL}", rows="al"))
def state_run_decoupled(spark, sf_dir):
    return GraphState(_edges(spark, sf_dir), "3 days", "1 day", "AL", PARTS, decoupled=True).run_decoupled(_loads)


@query(f"""with {E}, p as (select *, cast(src % 4 as integer) as partition_id from e), k as (
        select *, (row_number() over (partition by partition_id order by ts, id) - 1) // 100 as batch from p
    ) select id as edge_id, partition_id, batch, min(ts) over (partition by partition_id, batch) as valid_from from k""")
def state_insert_batches(spark, sf_dir):
    rows = inserted_in_batches(_edges(spark, sf_dir), 100, PARTS)
    return rows.select("edge_id", "partition_id", "batch", "valid_from")


@query(f"with {E} select distinct src from e")
def al_vertex_list(spark, sf_dir):
    return GraphState(_edges(spark, sf_dir), None).live_vertices()


@query(f"""with {E}, {HOPS}, l as (select cast(date_trunc('day', ts) - i * interval 1 day + interval 3 day as timestamp) as w,
        e.* from e, h), u as (select distinct w, least(src, dst) as a, greatest(src, dst) as b from l where src <> dst)
    select x.w as fire, count(*) as triangles from u x join u y on x.w = y.w and x.b = y.a
    join u z on z.w = x.w and z.a = x.a and z.b = y.b group by x.w""")
def state_triangles(spark, sf_dir):
    return _state(spark, sf_dir).triangles()


# ---------------------------------------------------------------- partitioning
_DBH = f"""{ENDS}, d as (select vertex, count(*) as d from n group by vertex), p as (
        select e.*, cast((case when x.d < y.d or (x.d = y.d and src <= dst) then src else dst end
            * 2654435761 % 4294967296) % 4 as integer) as partition_id
        from e join d x on x.vertex = src join d y on y.vertex = dst)"""


@query(f"with {E}, {_DBH} select id as edge_id, src, dst, partition_id from p")
def partition_dbh(spark, sf_dir):
    return partitioning.dbh_partition(_edges(spark, sf_dir), PARTS).select("edge_id", "src", "dst", "partition_id")


@query(f"""with {E}, {_DBH}, l as (select partition_id, count(*) as c from p group by 1),
    k as (select v, count(*) as c from (select distinct partition_id, unnest([src, dst]) as v from p) group by v)
    select cast((select sum(c) from l) as bigint) as edges, (select count(*) from k) as vertices,
        (select max(c) from l) as max_load, (select min(c) from l) as min_load,
        round((select avg(c) from k), 6) as replication""")
def partition_quality(spark, sf_dir):
    return partitioning.partition_quality(partitioning.dbh_partition(_edges(spark, sf_dir), PARTS))


#: One vertex after the other, in order of id; the state is the list of the partitions so far.
_FENNEL = f"""{E}, ends as (select distinct src as v, dst as u from e union select dst, src from e),
    rank as materialized (select v, row_number() over (order by v) as k from (select distinct v from ends)),
    near as materialized (
        select r.k, list(q.k) as ns from ends join rank r on r.v = ends.v join rank q on q.v = ends.u group by r.k),
    size as materialized (
        select n, (power(4, 0.5) * power(n, 1.5) + m) / power(n, 1.5) * 1.5 as c, (1.1 * 4 + n) / 4 as room
        from (select (select count(*) from rank) as n, (select count(*) from ends) // 2 as m)),
    s(k, w) as (
        select cast(0 as bigint), cast([] as integer[])
        union all
        select k, list_append(w, cast(list_position(scores, list_max(scores)) - 1 as integer)) from (
            select near.k, s.w, list_transform([0, 1, 2, 3], lambda p: case
                when len(list_filter(s.w, lambda x: x = p)) < size.room then
                    len(list_filter(near.ns, lambda j: j < near.k and s.w[j] = p))
                    - size.c * power(len(list_filter(s.w, lambda x: x = p)), 0.5)
                else -1e300 end) as scores
            from s join near on near.k = s.k + 1, size)
    ), f as (
        select rank.v as vertex, last.w[rank.k] as partition_id
        from rank, (select w from s order by k desc limit 1) last
    )"""


@query(f"with recursive {_FENNEL} select vertex, partition_id from f")
def partition_fennel(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    adjacency = metrics.neighborhoods(edges, "all")
    size = adjacency.agg(F.count("*").alias("n"), F.sum(F.size("nbrs")).alias("m")).first()
    return sequential.fennel_partition(adjacency, PARTS, size["n"], (size["m"] or 0) // 2)


@query(f"with recursive {_FENNEL} select e.id as edge_id, e.src, e.dst, f.partition_id from e join f on f.vertex = e.src")
def vertex_partitioned_edges(spark, sf_dir):
    placement = partition_fennel(spark, sf_dir)
    return partitioning.by_vertex(_edges(spark, sf_dir).select("edge_id", "src", "dst"), placement)


#: One edge after the other; the state is the partition of each vertex and the loads.
_LEAST = "list_position({0}, list_min({0})) - 1"


@query(f"""with recursive {E},
    rank as materialized (select v, row_number() over (order by v) as r from (select src as v from e union select dst from e)),
    o as materialized (
        select row_number() over (order by ts, id) as k, id, src, dst, x.r as sr, y.r as dr
        from e join rank x on x.v = src join rank y on y.v = dst),
    s(k, w, load, home, other) as (
        select cast(0 as bigint), list_transform(range((select count(*) from rank)), lambda x: -1),
            cast([0, 0, 0, 0] as bigint[]), cast(0 as bigint), cast(0 as bigint)
        union all
        select k, list_transform(w, lambda x, i: case when i = sr then home when i = dr then other else x end),
            list_transform(load, lambda x, i: x + case when i - 1 in (home, other) then 1 else 0 end), home, other
        from (select *, case when dr = sr then home when w[dr] >= 0 then w[dr]
                when load[home + 1] > 0 and load[{_LEAST.format('load')} + 1] / load[home + 1] > 0.5 then home
                else {_LEAST.format('load')} end as other
            from (select o.k, s.w, s.load, o.sr, o.dr,
                    case when s.w[o.sr] >= 0 then s.w[o.sr] else {_LEAST.format('s.load')} end as home
                from s join o on o.k = s.k + 1))
    )
    select o.id as edge_id, o.src, o.dst, cast(p as integer) as partition_id
    from (select k, unnest(list_distinct([home, other])) as p from s where k > 0) q join o on o.k = q.k""")
def partition_balanced(spark, sf_dir):
    return sequential.balanced_partition(_edges(spark, sf_dir), PARTS)


# ------------------------------------------------------------- files, adjacency
def _adjacency_file(spark: SparkSession, sf_dir: str, make_undirected: bool = False) -> str:
    path = made_path(spark, "adjacency")
    files.write_adjacency(files.adjacency_rows(_edges(spark, sf_dir), make_undirected), path)
    return path


@query(f"with {E} select src, string_agg(distinct dst, ',' order by dst) as nbrs from e group by src")
def adjacency_scan(spark, sf_dir):
    rows = sources.adjacency_list(spark, _adjacency_file(spark, sf_dir))
    return rows.select("src", as_text(F.col("nbrs")).alias("nbrs"))


@query(f"with {E} select distinct src, dst from e")
def explode_adjacency(spark, sf_dir):
    rows = sources.adjacency_list(spark, _adjacency_file(spark, sf_dir))
    return sources.explode_adjacency(rows).select("src", "dst")


@query(f"""with {E}, {BOTH} select a as src, string_agg(b, ',' order by b) as nbrs from b group by a""")
def el_to_al(spark, sf_dir):
    root = made_path(spark, "edges")
    files.write_edges(_edges(spark, sf_dir), f"{root}/el", " ")
    files.el_to_al(spark, f"{root}/el", f"{root}/al", make_undirected=True)
    return sources.adjacency_list(spark, f"{root}/al").select("src", as_text(F.col("nbrs")).alias("nbrs"))


def _text(lines: DataFrame, spark: SparkSession, name: str) -> str:
    path = made_path(spark, name)
    lines.write.text(path)
    return path


@query(f"""with {E} select src, dst + 1000000 as dst, floor(value) * 10 as value,
    cast(date_trunc('second', ts) as timestamp) as valid_from from e""")
def bipartite_file(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    seconds = F.unix_seconds(F.col("valid_from").cast("timestamp"))
    line = F.concat_ws("\t", "src", "dst", F.floor("value").cast("string"), seconds.cast("string"))
    path = _text(edges.select(line.alias("value")), spark, "movies")
    return sources.bipartite_csv(spark, path).select("src", "dst", "value", "valid_from")


@query(f"""with {E}, o as (select src, dst, row_number() over (order by ts, id) - 1 as edge_id from e)
    select edge_id, src, dst, cast(make_timestamp(edge_id * 1000) as timestamp) as valid_from from o""")
def numbered_file(spark, sf_dir):
    edges = metrics.running_total(_edges(spark, sf_dir), F.lit(1), alias="k").repartitionByRange(3, "k").sortWithinPartitions("k")
    path = _text(edges.select(F.concat_ws(",", "src", "dst").alias("value")), spark, "numbered")
    return sources.numbered_edges(spark, path).select("edge_id", "src", "dst", "valid_from")


@query(f"""with {E} select src, dst, value, cast(date_trunc('second', ts) as timestamp) as valid_from from e where value > 50""")
def weighted_file(spark, sf_dir):
    edges = _edges(spark, sf_dir).where("value > 50")
    seconds = F.unix_seconds(F.col("valid_from").cast("timestamp"))
    line = F.concat_ws(" ", "src", "dst", F.col("value").cast("string"), seconds.cast("string"))
    path = _text(edges.select(line.alias("value")), spark, "weighted")
    return sources.weighted_edge_list(spark, path).select("src", "dst", "value", "valid_from")


@query("""select i as src, i + s as dst, cast(make_timestamp((100 * i + 50 * (s - 1)) * 1000) as timestamp) as valid_from
    from range(1, 501) t(i), (select unnest([1, 2]) as s)""")
def sequence_source(spark, sf_dir):
    return sources.sequence_edges(spark, 500).select("src", "dst", "valid_from")


@query(f"with {E} select distinct src, dst from e")
def throttled_stream(spark, sf_dir):
    path = made_path(spark, "replay")
    files.write_adjacency(files.adjacency_rows(_edges(spark, sf_dir)).coalesce(1), path)
    stream = throttled_adjacency(spark, first_part(spark, path), 500)
    rows, _ = run_to_table(stream.select("src", F.explode("nbrs").alias("dst")), name="throttled", throttled=True)
    return rows


# -------------------------------------------------------------------- streaming
@query(f"""with {E} select cast(date_trunc('day', ts) as timestamp) as window_start, src as vertex,
    count(*) as n, max(value) as largest from e group by 1, 2""")
def stream_snapshot(spark, sf_dir):
    """All windows, those that the watermark has not closed too: the last update of each."""
    edges = sources.stream_event_edges(spark, f"{sf_dir}/events.parquet")
    snap = Snapshot(edges, "1 day").aggregate(F.count("*").alias("n"), F.max("value").alias("largest"))
    done, _ = run_to_table(snap.drop("window_end"), "update", "snapshot")
    last = F.max_by(F.struct("n", "largest"), "batch_id").alias("r")
    done = done.groupBy(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "vertex").agg(last)
    return done.select("window_start", "vertex", "r.n", "r.largest")


@query(f"with {E}, {ENDS} select vertex, count(*) as degree from n group by vertex")
def stream_degrees(spark, sf_dir):
    edges = sources.stream_event_edges(spark, f"{sf_dir}/events.parquet")
    counts = transforms.endpoints(edges).groupBy("vertex").agg(F.count("*").alias("degree"))
    done, _ = run_to_table(counts, "update", "degrees")
    return done.groupBy("vertex").agg(F.max_by("degree", "batch_id").alias("degree"))


@query(f"with {E}, {ENDS} select vertex, count(*) as degree from n group by vertex")
def stream_state_lookup(spark, sf_dir):
    """A running count read back from the stream's own state."""
    edges = sources.stream_event_edges(spark, f"{sf_dir}/events.parquet")
    counts = transforms.endpoints(edges).groupBy("vertex").agg(F.count("*").alias("degree"))
    _, checkpoint = run_to_table(counts, "update", "degrees")
    return read_state(spark, checkpoint).select("key.vertex", F.col("value.count").alias("degree"))


@query(_MATCHING)
def stream_matching_events(spark, sf_dir):
    edges = sources.stream_event_edges(spark, f"{sf_dir}/events.parquet")
    with rocksdb(spark):
        events, _ = run_to_table(stream_matching(edges, F.round(F.col("value") * 100)), name="matching")
    return events.drop("key")


#: An edge leaves three days after the end of its day, once the watermark has passed that.
_LEAVING = f"""with {E}, p as (select src, dst, max(cast(date_trunc('day', ts) as timestamp)) + interval 4 day as ends from e group by 1, 2),
    w as (select max(ts) - interval 1 day as mark from e)
    select cast(src % 4 as integer) as partition_id, count(*) as added, count(*) filter (where {{left}}) as removed
    from p, w group by 1"""


def _purged(spark: SparkSession, sf_dir: str, lazy: bool) -> DataFrame:
    edges = sources.stream_event_edges(spark, f"{sf_dir}/events.parquet")
    state = GraphState(_edges(spark, sf_dir), "3 days", "1 day", parts=PARTS, lazy_purge=lazy)
    with rocksdb(spark):
        rows, _ = run_to_table(state.purging(edges), "update", "adjacency")
    return rows.groupBy("partition_id").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"))


@query(_LEAVING.format(left="ends <= mark"))
def stream_active_purge(spark, sf_dir):
    return _purged(spark, sf_dir, False)


#: Lazily an edge waits for the next multiple of three days.
@query(_LEAVING.format(left="epoch_ms(cast(ceil(epoch_ms(ends) / 259200000.0) as bigint) * 259200000) <= mark"))
def stream_lazy_purge(spark, sf_dir):
    return _purged(spark, sf_dir, True)


@query(f"""with {E} select cast(src % 4 as integer) as partition_id, count(*) as added, count(*) as removed
    from (select distinct src, dst from e) group by 1""")
def stream_clock_purge(spark, sf_dir):
    """By the clock: every edge enters now and has left a few seconds later."""
    edges = sources.stream_event_edges(spark, f"{sf_dir}/events.parquet")
    total = [F.sum("added").alias("added"), F.sum("removed").alias("removed")]

    def gone(rows: DataFrame) -> bool:
        seen = rows.agg(*total).first()
        return bool(seen["added"]) and seen["added"] == seen["removed"]

    with rocksdb(spark):
        rows = run_until(stream_adjacency(edges, 1000, 1000, PARTS, slices=1, clock=True), gone)
    return rows.groupBy("partition_id").agg(*total)


#: The small graph of the legacy tests.
SMALL = [(1, 2, 12.0), (1, 3, 13.0), (2, 3, 23.0), (3, 4, 34.0), (3, 5, 35.0), (4, 5, 45.0), (5, 1, 51.0)]


@query(f"""with e(src, dst, value) as (values {", ".join(map(str, SMALL))}),
    n as (select src as vertex, value from e union all select dst, value from e)
    select cast(vertex as bigint) as vertex, count(*) as degree, cast(sum(value) as double) as total from n group by 1""")
def in_memory_edges(spark, sf_dir):
    edges = edges_of(spark.createDataFrame(SMALL, "src long, dst long, value double"))
    ends = transforms.endpoints(edges)
    return ends.groupBy("vertex").agg(F.count("*").alias("degree"), F.sum("value").alias("total"))


@query(f"with {E} select src, dst, 1 as batches from e group by src, dst, id")
def ingestion_time(spark, sf_dir):
    """A batch's edges share the time of their ingestion, so they fall into one window."""
    edges = sources.ingested(_edges(spark, sf_dir))
    counted = edges.agg(F.count_distinct("valid_from").cast("int").alias("batches")).withColumn("k", F.lit(1))
    return edges.select("src", "dst").withColumn("k", F.lit(1)).join(F.broadcast(counted), "k").drop("k")  # one row


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
