"""Streams against batches, state read back, and text files."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tideweave.functions.ids import hex_of_vertex, shared_neighbours, vertex_of_hex
from tideweave.operators import components, metrics, transforms
from tideweave.sources import edges as sources
from tideweave.sources import files
from tideweave.streaming.components import StreamingComponents
from tideweave.streaming.live_state import stream_adjacency
from tideweave.streaming.runs import read_state, run_to_table

SF = "/root/testdata/sf0.001"
events_only = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@events_only
def test_stream_degrees_equal_batch(spark):
    stream = sources.stream_event_edges(spark, f"{SF}/events.parquet")
    counts = transforms.endpoints(stream).groupBy("vertex").agg(F.count("*").alias("degree"))
    done, checkpoint = run_to_table(counts, "update")
    got = {r.vertex: r.degree for r in done.groupBy("vertex").agg(F.max("degree").alias("degree")).collect()}
    batch = metrics.degrees(sources.event_edges(spark, SF))
    assert got == {r.vertex: r.degree for r in batch.collect()}
    kept = read_state(spark, checkpoint)
    assert kept.count() == len(got)


@events_only
def test_stream_transforms_equal_batch(spark):
    stream = sources.stream_event_edges(spark, f"{SF}/events.parquet")
    done, _ = run_to_table(transforms.undirected(stream.where("value > 20")).select("src", "dst"))
    batch = transforms.undirected(sources.event_edges(spark, SF).where("value > 20")).select("src", "dst")
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, batch.collect()))
    once, _ = run_to_table(
        transforms.distinct_edges(sources.stream_event_edges(spark, f"{SF}/events.parquet", "60 days")).select("src", "dst")
    )
    want = transforms.distinct_edges(sources.event_edges(spark, SF)).select("src", "dst")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, want.collect()))


@events_only
def test_stream_components(spark):
    stream = sources.stream_event_edges(spark, f"{SF}/events.parquet")
    got = StreamingComponents(spark).run(stream.select("src", "dst"))
    want = components.connected_components(sources.event_edges(spark, SF))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@events_only
def test_adjacency_state(spark):
    day = 86_400_000
    stream = sources.stream_event_edges(spark, f"{SF}/events.parquet")
    done, checkpoint = run_to_table(stream_adjacency(stream, 3 * day, day), "update")
    rows = done.collect()
    distinct = sources.event_edges(spark, SF).select("src", "dst").distinct().count()
    assert sum(r.added for r in rows) == distinct
    state = read_state(spark, checkpoint, "edges")
    assert state.count() == sum(r.added - r.removed for r in rows)


def test_text_files(spark, tmp_path):
    source = tmp_path / "el.txt"
    source.write_text("# a comment\n\n1 2\n2\t3\n3 1 0.5\n1 2\n")
    el = sources.edge_list(spark, str(source))
    assert sorted((r.src, r.dst) for r in el.collect()) == [(1, 2), (1, 2), (2, 3), (3, 1)]
    target = str(tmp_path / "al")
    files.el_to_al(spark, str(source), target, make_undirected=True)
    al = sources.adjacency_list(spark, target)
    assert {r.src: r.nbrs for r in al.collect()} == {1: [2, 3], 2: [1, 3], 3: [1, 2]}
    assert sources.explode_adjacency(al).count() == 6
    movies = tmp_path / "u.data"
    movies.write_text("1\t5\t4\t880000000\n")
    row = sources.bipartite_csv(spark, str(movies)).first()
    assert (row.src, row.dst, row.value) == (1, 1_000_005, 40.0)
    birds = tmp_path / "birds.edges"
    birds.write_text("3 4 0.25 2009\n")
    row = sources.weighted_edge_list(spark, str(birds)).first()
    assert (row.src, row.dst, row.value, row.valid_from.year) == (3, 4, 0.25, 2009)


def test_id_functions(spark):
    df = spark.createDataFrame([(255,)], "v long")
    row = df.select(hex_of_vertex(F.col("v")).alias("h"), vertex_of_hex(hex_of_vertex(F.col("v"))).alias("v")).first()
    assert row.h == "000000ff" + "0" * 16 and row.v == 255
    arrays = df.select(shared_neighbours(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))).alias("n"))
    assert arrays.first().n == 1


@events_only
def test_stream_matching_equals_batch(spark):
    from tideweave.operators import sequential
    from tideweave.streaming.matching import stream_matching

    weight = F.round(F.col("value") * 100)
    stream = sources.stream_event_edges(spark, f"{SF}/events.parquet")
    done, checkpoint = run_to_table(stream_matching(stream, weight))
    batch = sequential.weighted_matching_events(sources.event_edges(spark, SF), weight)
    key = ["seq", "op", "src", "dst", "weight"]
    assert sorted(map(tuple, done.select(key).collect())) == sorted(map(tuple, batch.select(key).collect()))
    final = sequential.matching_of(batch).collect()
    assert read_state(spark, checkpoint, "edges").count() == sum(len({r.src, r.dst}) for r in final)


def test_throttled_source(spark, tmp_path):
    from tideweave.sources.throttled import throttled_adjacency

    path = tmp_path / "al.txt"
    path.write_text("".join(f"{i}:[{i + 1}, {i + 2}]\n" for i in range(25)) + "# end\n")
    sizes = []
    query = (
        throttled_adjacency(spark, str(path), 10)
        .writeStream.foreachBatch(lambda df, k: sizes.append(sorted(map(tuple, df.select("src", "nbrs").collect()))))
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    rows = [r for batch in sizes for r in batch]
    assert len([s for s in sizes if s]) >= 3 and max(map(len, sizes)) <= 10
    assert rows == [(i, [i + 1, i + 2]) for i in range(25)]


def test_throttled_source_to_its_end(spark, tmp_path):
    """More lines than a batch takes, and over a block's border; a restart goes on where it stopped."""
    from tideweave.sources.throttled import ReplayReader, throttled_adjacency

    path = tmp_path / "al.txt"
    path.write_text("# über\n" + "".join(f"{i}:[{i + 1}, {i + 2}]\n" for i in range(70)) + f"70:[{'7, ' * 400_000}7]")
    rows, _ = run_to_table(throttled_adjacency(spark, str(path), 20), name="replay", throttled=True)
    got = sorted((r.line, r.src, r.n) for r in rows.select("line", "src", F.size("nbrs").alias("n")).collect())
    assert got == [(i + 1, i, 2 if i < 70 else 400_001) for i in range(71)]
    reader, again = (ReplayReader({"path": str(path), "linesPerBatch": "20"}) for _ in range(2))
    offsets = [reader.initialOffset()] + [reader.latestOffset() for _ in range(5)]
    assert [o["line"] for o in offsets] == [0, 20, 40, 60, 72, 72]
    (part,) = again.partitions(*offsets[1:3])
    assert [k for k, _ in again.read(part)] == list(range(20, 40)) and again.latestOffset() == offsets[3]


def test_numbered_edges(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    for p in range(3):
        (folder / f"part-{p}.csv").write_text("".join(f"{100 * p + i},{i}\n" for i in range(5)))
    rows = sources.numbered_edges(spark, str(folder)).collect()
    assert sorted(r.edge_id for r in rows) == list(range(15))
    for r in rows:  # in the order of files and lines
        assert r.edge_id == 5 * (r.src // 100) + r.src % 100


def test_numbered_edges_over_blocks(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("".join(f"{i},{i % 7}\n" for i in range(20_000)))
    (tmp_path / "short.csv").write_text("50000,1\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = sources.numbered_edges(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 20_001 and all(r.edge_id == min(r.src, 20_000) for r in rows)


def test_decoupled_state_and_modes(spark):
    from tideweave.operators.state import GraphState

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    edges = sources.event_edges(spark, SF)
    coupled = GraphState(edges, "3 days", "1 day")
    apart = GraphState(edges, "3 days", "1 day", decoupled=True)
    count = lambda live: live.groupBy("fire").count()
    assert sorted(map(tuple, apart.run_decoupled(count).collect())) == sorted(map(tuple, coupled.run(count).collect()))
    fires, table = apart.decoupled_output()
    assert fires.agg(F.sum("n_edges")).first()[0] == table.count()
    for wrong in (lambda: apart.run(count), coupled.decoupled_output, lambda: coupled.run_decoupled(count)):
        with pytest.raises(ValueError):
            wrong()


@pytest.mark.parametrize("slide", [None, 7])
def test_adjacency_state_moves_blocks(slide):
    """Far fewer calls of the state store than edges, and the live edges of a plain dictionary."""
    import random
    from types import SimpleNamespace

    import pandas as pd

    from tideweave.streaming.live_state import AdjacencyState

    calls, timers = [0], set()

    class Held(dict):
        def counted(self, out=None):
            calls[0] += 1
            return out

        def getValue(self, k):  # noqa: N802
            return self.counted(self.get(k))

        def updateValue(self, k, v):  # noqa: N802
            self.counted(self.__setitem__(k, v))

        def removeKey(self, k):  # noqa: N802
            self.counted(self.pop(k, None))

        def containsKey(self, k):  # noqa: N802
            return self.counted(k in self)

        def iterator(self):
            return iter(list(self.items()))

    one = Held()
    size = SimpleNamespace(exists=lambda: 0 in one, get=lambda: one[0], update=lambda v: one.__setitem__(0, v))
    state = AdjacencyState(3, 2, slide)
    maps = lambda *_: Held()
    state.init(SimpleNamespace(getMapState=maps, getValueState=lambda *_: size, registerTimer=timers.add))
    rnd, want, n = random.Random(5), {}, 0
    for batch in range(6):
        rows = [(rnd.randrange(-900, 900), rnd.randrange(9), rnd.randrange(4 * batch, 4 * batch + 9)) for _ in range(4000)]
        n += len(rows)
        before = len(want)
        for src, dst, ms in rows:
            want[src, dst] = max(want.get((src, dst), 0), (ms // 2 + 1) * 2 + 3)
        parts = [pd.DataFrame(rows[i : i + 1500], columns=["src", "dst", "ms"]) for i in range(0, 4000, 1500)]
        (out,) = state.handleInputRows((0, 0), iter(parts), None)
        assert out["added"][0] == len(want) - before and out["live"][0] == len(want)
        for at in sorted(t for t in timers if t <= 4 * batch + 3):
            timers.remove(at)
            before = len(want)
            want = {k: end for k, end in want.items() if end > at}
            (out,) = state.handleExpiredTimer((0, 0), None, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at))
            assert out["removed"][0] == before - len(want) and out["live"][0] == len(want)
    assert calls[0] < n / 2
    held = [((s, d), e) for block in state.edges.values() for s, d, e in zip(*block, strict=True)]
    assert len(held) == len(want) > 0 and dict(held) == want


@events_only
def test_processing_time_purges_by_the_clock(spark, tmp_path):
    stream = sources.stream_event_edges(spark, f"{SF}/events.parquet")
    rows = []
    query = (
        stream_adjacency(stream, 1000, 1000, clock=True)
        .writeStream.outputMode("update")
        .foreachBatch(lambda df, k: rows.extend(df.collect()))
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(processingTime="500 milliseconds")
        .start()
    )
    distinct = sources.event_edges(spark, SF).select("src", "dst").distinct().count()
    try:
        until = time.time() + 60
        while time.time() < until and sum(r.removed for r in rows) < distinct:
            time.sleep(0.5)
    finally:
        query.stop()
    assert sum(r.added for r in rows) == distinct == sum(r.removed for r in rows)


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from tideweave.plans import lineage

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    lone = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
    with pytest.raises(ValueError):
        lineage.shared_dir(lone)
    before = lineage.made_so_far()
    kept, gone = lineage.stash(spark.range(3), "kept"), lineage.stash(spark.range(3), "gone")
    lineage.drop_made(spark, before, keep=kept)
    assert kept.count() == 3 and os.path.isdir(kept._stashed_at) and not os.path.exists(gone._stashed_at)
    assert lineage.made_so_far() == [*before, kept._stashed_at]


def test_matching_runs_components_apart(spark):
    from tideweave.model import edges_of
    from tideweave.operators import sequential

    import random

    rnd = random.Random(4)
    rows = [(i, 10 * c + rnd.randrange(10), 10 * c + rnd.randrange(10), float(rnd.randrange(1, 90))) for i in range(600) for c in [rnd.randrange(12)]]
    df = spark.createDataFrame(rows, "edge_id long, src long, dst long, value double")
    df = edges_of(df.withColumn("valid_from", F.timestamp_millis("edge_id").cast("timestamp_ntz")))
    state, want = sequential.Matching(), []
    for _, s, d, w in rows:
        want += state.add(s, d, int(w))
    for task_rows in (0, 1000):
        got = sequential.weighted_matching_events(df, F.col("value"), task_rows).orderBy("seq").collect()
        assert [(r.op, r.src, r.dst, r.weight) for r in got] == want and [r.seq for r in got] == list(range(len(want)))


@events_only
@pytest.mark.parametrize("task_rows", [0, 9, 1_000_000])
def test_hubs_are_summed_by_grains(spark, task_rows):
    ends = transforms.endpoints(sources.event_edges(spark, SF)).select("edge_id", "vertex", "side", "valid_from")
    ends = ends.unionAll(ends.where("edge_id < 5").withColumn("vertex", F.lit(None).cast("long")))
    order = ("valid_from", "edge_id", "side")
    got = metrics.running_total(ends, F.lit(1), order, "n", by=("vertex",), task_rows=task_rows).collect()
    rows = sorted(ends.collect(), key=lambda r: (r.valid_from, r.edge_id, r.side))
    seen, want = {}, {}
    for r in rows:
        seen[r.vertex] = want[r.edge_id, r.vertex, r.side] = seen.get(r.vertex, 0) + 1
    assert len(got) == len(rows) and {(r.edge_id, r.vertex, r.side): r.n for r in got} == want
