"""Specs checked and built; streams of files, anchors, windows and the position cache."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidewater.operators import rescoring
from tidewater.plans import spec
from tidewater.sources import sinks
from tidewater.streaming import anchors, windows

GOOD = {
    "stages": [
        {"name": "batches", "type": "tensor_generator", "inputs": ["mix"], "batch_size": 8},
        {"name": "mix", "type": "join_positions", "inputs": ["unpack"]},
        {"name": "unpack", "type": "chunk_unpacker", "inputs": ["pool"], "position_sampling_rate": 0.5},
        {"name": "pool", "type": "shuffling_chunk_pool", "inputs": ["split.train"], "chunk_pool_size": 10},
        {"name": "split", "type": "chunk_source_splitter", "inputs": ["source"], "output": ["train", "test"], "weight": [3, 1]},
        {"name": "source", "type": "synthetic_source", "sources": 4, "mean_chunks": 6},
    ],
    "outputs": ["train:batches", "held:split.test"],
}


def test_a_spec_is_built_whatever_the_order_of_its_stages(spark):
    out = spec.build(spark, json.dumps(GOOD))
    assert set(out) == {"train", "held"}
    rows = out["train"].select("batch_id", "place", F.size("inputs").alias("i"), F.size("values").alias("v")).collect()
    assert rows and len(rows) % 8 == 0 and {(r["i"], r["v"]) for r in rows} == {(7168, 18)}
    assert out["held"].count() > 0


def changed(**by_stage):
    stages = [dict(s) | by_stage.get(s["name"], {}) for s in GOOD["stages"]]
    return {"stages": stages, "outputs": GOOD["outputs"]}


@pytest.mark.parametrize(
    "bad",
    [
        changed(source={"type": "nothing"}),
        changed(source={"colour": 1}),
        changed(split={"weight": [1]}),
        changed(split={"weight": [0, 0]}),
        changed(split={"output": ["a", "a"]}),
        changed(mix={"name": "pool"}),
        changed(mix={"inputs": ["nowhere"]}),
        changed(mix={"inputs": []}),
        changed(unpack={"position_count": 2}),
        changed(unpack={"position_sampling_rate": None}),
        changed(unpack={"prefetch_count": 2}),
        changed(pool={"cachehit_output": "hits"}),
        changed(pool={"inputs": ["batches"]}),
        changed(batches={"batch_size": 0}),
        changed(batches={"overflow_behavior": "SPILL"}),
        changed(source={"inputs": ["mix"]}),
    ],
)
def test_bad_specs(bad):
    with pytest.raises(spec.BadSpec):
        spec.checked(bad)


def test_bad_outputs(spark):
    for outputs in (["a:nowhere"], ["a:source", "a:source"], ["a:split"]):
        with pytest.raises(spec.BadSpec):
            spec.build(spark, GOOD | {"outputs": outputs})
    with pytest.raises(spec.BadSpec):
        spec.stage("join_positions")(lambda *a: {})


def test_unpacking_by_count_and_prefetch(spark):
    stages = [
        {"name": "source", "type": "synthetic_source", "sources": 2, "mean_chunks": 3},
        {"name": "chunks", "type": "simple_chunk_extractor", "inputs": ["source"]},
        {"name": "unpack", "type": "chunk_unpacker", "inputs": ["chunks"], "position_count": 1, "prefetch_count": 3, "prefetch_output": "rest"},
        {"name": "shuffle", "type": "shuffling_frame_sampler", "inputs": ["unpack"], "reservoir_size_per_thread": 1},
    ]
    out = spec.build(spark, {"stages": stages})
    n = out["chunks"].select("global_index").distinct().count()
    assert out["unpack"].count() == n and out["unpack.rest"].count() == 3 * n
    assert out["shuffle"].count() == n
    assert {r["next_use"] for r in out["unpack.rest"].collect()} == {1}


SOURCE = {"name": "source", "type": "synthetic_source", "sources": 3, "mean_chunks": 4}


def test_frames_that_come_twice_are_batched_once_each(spark):
    stages = [
        SOURCE,
        {"name": "twice", "type": "join_positions", "inputs": ["source", "source"]},
        {"name": "batches", "type": "tensor_generator", "inputs": ["twice"], "batch_size": 4},
    ]
    out = spec.build(spark, {"stages": stages})
    n = out["twice"].count()
    got = out["batches"].select("batch_id", "place").collect()
    assert sorted(tuple(r) for r in got) == [(i // 4, i % 4) for i in range(n // 4 * 4)]


def test_batches_keep_the_order_of_the_sampler(spark):
    stages = [
        SOURCE,
        {"name": "sampler", "type": "shuffling_frame_sampler", "inputs": ["source"], "reservoir_size_per_thread": 50},
        {"name": "batches", "type": "tensor_generator", "inputs": ["sampler"], "batch_size": 4},
    ]
    out = spec.build(spark, {"stages": stages})
    first = lambda df, planes: [tuple(r[0]) for r in df.select(planes).collect()]
    came = first(out["sampler"], F.slice("planes", 1, 3))
    batched = first(out["batches"].orderBy("batch_id", "place"), F.slice("inputs", 1, 192))
    number = lambda bits: tuple(sum(int(bits[64 * p + s]) << (s ^ 7) for s in range(64)) for p in range(3))
    assert [number(b) for b in batched] == came[: len(came) // 4 * 4] and came != sorted(came)


def test_epochs_by_rate_and_by_weight(spark):
    stages = [
        SOURCE,
        {"name": "pool", "type": "shuffling_chunk_pool", "inputs": ["source"], "chunk_pool_size": 100, "epochs": 4},
        {"name": "half", "type": "chunk_unpacker", "inputs": ["pool"], "position_sampling_rate": 0.5},
        {"name": "one", "type": "chunk_unpacker", "inputs": ["pool"], "position_count": 1, "seed": "one"},
    ]
    out = spec.build(spark, {"stages": stages})
    n, chunks_ = out["source"].count(), out["source"].select("sort_key", "chunk_index").distinct().count()
    by_use = {r["use_count"]: r["count"] for r in out["half"].groupBy("use_count").count().collect()}
    assert by_use[0] + by_use[1] == n == by_use[2] + by_use[3] and all(0.4 * n < x < 0.6 * n for x in by_use.values())
    assert out["half"].where("use_count < 2").dropDuplicates(["global_index", "frame_idx"]).count() == n
    assert {r["count"] for r in out["one"].groupBy("use_count").count().collect()} == {chunks_}
    with pytest.raises(spec.BadSpec):
        spec.checked({"stages": [*stages[:2], {**stages[3], "position_sampling": {"colour": 1}}]})


def test_the_pool_caches_positions(spark):
    stages = [
        SOURCE,
        {"name": "pool", "type": "shuffling_chunk_pool", "inputs": ["source", "unpack.ahead"], "chunk_pool_size": 100, "epochs": 5, "cachehit_output": "hits", "position_cache_size": 250},
        {"name": "unpack", "type": "chunk_unpacker", "inputs": ["pool"], "position_count": 1, "prefetch_count": 4, "prefetch_output": "ahead"},
        {"name": "all", "type": "join_positions", "inputs": ["pool.hits", "unpack"]},
    ]
    out = spec.build(spark, {"stages": stages})
    plan = out["pool.cache"].collect()
    chunks_ = {r["global_index"] for r in plan}
    assert len(plan) == 5 * len(chunks_)
    cached, carried = {g: 0 for g in chunks_}, 0.0
    order = {(r["global_index"], r["use_count"]): r for r in plan}
    for u in range(5):
        for g in chunks_:
            r = order[g, u]
            assert r["status"] == ("hit" if cached[g] else "miss")
            cached[g] += r["newly_cached"] - (r["status"] == "hit")
            assert r["status"] == "hit" or (r["newly_cached"] in (2, 3) and r["dropped"] == 4 - r["newly_cached"])  # 2.5 a miss
    hits, taken = out["pool.hits"].count(), out["unpack"].count()
    assert hits == sum(r["status"] == "hit" for r in plan) > 0 and hits + taken == len(plan)
    plain = spec.build(spark, {"stages": [SOURCE, {**stages[1], "inputs": ["source"], "cachehit_output": None}, {"name": "unpack", "type": "chunk_unpacker", "inputs": ["pool"], "position_count": 1}]})
    keys = ("global_index", "use_count", "frame_idx")
    assert sorted(tuple(r) for r in out["all"].select(*keys).collect()) == sorted(tuple(r) for r in plain["unpack"].select(*keys).collect())  # a cached position is the one that the use would have come to
    with pytest.raises(spec.BadSpec):
        spec.checked({"stages": [SOURCE, {**stages[1], "inputs": ["source", "unpack"]}, stages[2]]})


def test_queues_that_overflow(spark):
    stages = [SOURCE, {"name": "a", "type": "join_positions", "inputs": ["source"], "overflow_behavior": "DROP_NEW", "queue_capacity": 5}, {"name": "b", "type": "join_positions", "inputs": ["source"], "overflow_behavior": "KEEP_NEWEST", "queue_capacity": 7}]
    out = spec.build(spark, {"stages": stages})
    rows = [(r["sort_key"], r["chunk_index"], r["frame_idx"]) for r in out["source"].collect()]
    of = lambda name: [(r["sort_key"], r["chunk_index"], r["frame_idx"]) for r in out[name].collect()]
    assert of("a") == rows[:5] and of("b") == rows[-7:]


def test_a_rescorer_by_name(spark):
    def turned(table, options):
        if table["chunk_index"][0].as_py() == 0:
            raise ValueError("no table holds this game")
        q = [x * options["dist_temp"] for x in table["root_q"].to_pylist()]
        return table.set_column(table.schema.get_field_index("root_q"), "root_q", [q])

    rescoring.RESCORERS["turned"] = turned
    try:
        frames = spark.createDataFrame([("k", c, i, 0.5, 0.25, 7) for c in range(2) for i in range(3)], "sort_key string, chunk_index bigint, frame_idx int, root_q double, root_d double, played_idx int")
        out = spec.STAGES["chunk_rescorer"](spark, spec.options_of({"name": "r", "type": "chunk_rescorer", "inputs": [], "rescorer": "turned", "dist_temp": 0.5}), [frames])
        rows = out[""].orderBy("frame_idx").collect()
        assert [tuple(r) for r in out["metrics"].collect()] == [("failed_rescores", "count", 1.0, None)]
        assert [(r["chunk_index"], r["root_q"]) for r in rows] == [(1, 0.25)] * 3 and rows[2]["q_st"] == pytest.approx(0.25) and rows[0]["opp_played_idx"] == 7
    finally:
        del rescoring.RESCORERS["turned"]
    for bad in ({"dist_temp": 0.5}, {"syzygy_paths": "/t"}, {"rescorer": "nobody"}):
        with pytest.raises(spec.BadSpec):
            spec.checked({"stages": [SOURCE, {"name": "r", "type": "chunk_rescorer", "inputs": ["source"], **bad}]})


def test_graph():
    text = sinks.dot(GOOD)
    assert '"split" -> "pool" [label="train"];' in text and text.startswith("digraph")


def test_files_are_followed_once(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []
    write = lambda *rows: spark.createDataFrame(list(rows), "sort_key string, chunk_count bigint").coalesce(1).write.mode("append").parquet(folder)
    write(("a", 3))
    stream = lambda: windows.watched(spark, folder, "sort_key string, chunk_count bigint")
    sink = lambda df, i, phase: seen.append((phase, sorted(r["sort_key"] for r in df.collect())))
    initial = spark.createDataFrame([("0", 1)], "sort_key string, chunk_count bigint")
    windows.two_phases(initial, stream(), sink, str(tmp_path / "c"))
    write(("b", 4))
    windows.run_available(stream(), lambda df, i: sink(df, i, "new"), str(tmp_path / "c"))
    assert seen == [("initial", ["0"]), ("new", ["a"]), ("new", ["b"])]
    with pytest.raises(ValueError):
        windows.two_phases(initial.where("false"), stream(), sink, str(tmp_path / "c2"))
    anchor = anchors.Anchor(spark, f"file://{tmp_path}/anchor")
    anchor.follow(stream(), str(tmp_path / "c3")).awaitTermination()
    assert (anchor.chunks, anchor.newest) == (7, "b")
    write(("c", 5))
    again = anchors.Anchor(spark, f"file://{tmp_path}/anchor")
    again.follow(stream(), str(tmp_path / "c3")).awaitTermination()
    assert (again.chunks, again.newest) == (12, "c")


def test_metric_windows_of_event_time(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = spark.createDataFrame([(i, "m", float(i)) for i in range(8)], "i int, name string, value double").select((F.lit(0.0) + F.col("i") / 64.0).cast("timestamp").alias("ts"), "name", "value")
    rows.coalesce(1).write.parquet(folder)
    out = []
    agg = windows.tumbling(windows.watched(spark, folder, rows.schema), "ts", 2, "1 second", ["name"], [F.sum("value").alias("s")])
    q = agg.writeStream.outputMode("complete").foreachBatch(lambda df, i: out.append(sorted(r["s"] for r in df.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert out[-1] == [6.0, 22.0]


def test_position_cache(spark, tmp_path):
    folder, out = str(tmp_path / "in"), []
    schema = "global_index bigint, kind string, use_count int, items array<string>, capacity int, sequence bigint"
    rows = [(1, "use", 0, [], 0, 0), (1, "fill", 1, ["x", "y", "z"], 2, 1), (1, "use", 0, [], 0, 2), (1, "use", 0, [], 0, 3), (1, "use", 0, [], 0, 4), (1, "fill", 1, ["q"], 2, 5), (2, "use", 0, [], 0, 0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    q = windows.position_cache(windows.watched(spark, folder, spark.read.parquet(folder).schema)).writeStream.foreachBatch(lambda df, i: out.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    of = lambda kind: sorted((g, u, x) for g, u, k, x in out if k == kind)
    assert of("hit") == [(1, 1, "x"), (1, 2, "y")]
    assert [(g, u) for g, u, _ in of("miss") if True] == [(1, 0), (1, 3), (2, 0)]
    assert len(of("newly_cached")) == 2 and len(of("dropped")) == 1 and len(of("mismatched")) == 1


def test_progress_lines(spark):
    lines = []
    listener = windows.Progress(lines.append)
    spark.streams.addListener(listener)
    try:
        q = spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", os.path.join(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"), "rate")).trigger(once=True).start()
        q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(listener)
    assert lines and "numInputRows" in lines[0]
