"""Laws and exact values of the operators that the tables alone don't show."""

import itertools
import math
import os
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.functions import rng
from tidewater.operators import exponential, joins, ordering, pool, rescoring, sampling, schedule, split, stats
from tidewater.streaming import anchors, queues, windows


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# Statistics.
def test_log2_bins_at_powers_of_two_and_beside_them(spark):
    found = {2.0**r for r in range(-1074, 1024)} | {1.7e308}
    for r in range(-150, 60):
        low = high = 2.0**r
        for _ in range(20):
            low, high = math.nextafter(low, 0), math.nextafter(high, math.inf)
            found |= {low, high}
    rows = spark.createDataFrame([(x,) for x in found], "x double").select("x", stats.log2_bin(-F.col("x")).alias("bin")).collect()
    assert [r["bin"] for r in rows] == [math.floor(math.log2(r["x"])) for r in rows]


def test_difference_bins_of_nulls(spark):
    pairs = spark.createDataFrame([(1.0, 1.0), (1.0, 0.5), (None, 2.0), (1.0, None), (2.0, 1e-5)], "a double, b double")
    got = {(r["kind"], r["bin"]): r["n"] for r in stats.difference_bins(pairs, "a", "b").collect()}
    assert got == {("absolute", None): 3, ("absolute", -1): 1, ("absolute", 0): 1, ("relative", None): 2, ("relative", 0): 1}


# Sampling laws.
def plain_uses(rate, uses, draw):
    """Uses of one position by walking the line share by share, in exact numbers."""
    rate, found, out, line = Fraction(rate), [], False, 0
    while line < uses * rate:
        use = int((line + Fraction(draw(line))) / rate)
        met_at_end = (use + 1) * rate > line + 1
        if not out and use < uses:
            found.append(use)
        out = not out and met_at_end
        line += 1
    return found


@pytest.mark.parametrize(("rate", "exact"), [(0.5, "1/2"), (0.125, "1/8"), (0.3, "3/10"), (0.4, "2/5"), (0.75, "3/4"), (0.7, "7/10"), (1.0, "1")])
def test_position_uses_against_a_walk_of_the_line(spark, rate, exact):
    uses, n = 9, 300
    rows = sampling.sampled_positions(spark.createDataFrame([(1, n)], "global_index bigint, n int"), rate, uses, "s").collect()
    got = {i: [] for i in range(n)}
    for r in rows:
        got[r["frame_idx"]].append(r["use_count"])
    assert got == {i: plain_uses(exact, uses, lambda line, i=i: rng.number("s", 1, line, i)) for i in range(n)}
    assert all(len(set(u)) == len(u) for u in got.values())
    if 1 / rate == int(1 / rate):
        whole = int(1 / rate)
        assert all(sorted(x // whole for x in u) == list(range(len(u))) for u in got.values())  # once a round
    shares = [sum(u.count(k) for u in got.values()) / n for k in range(uses)]
    assert all(abs(x - rate) < 0.12 for x in shares if rate < 0.5)
    one = spark.createDataFrame([(i, k) for i in range(60) for k in range(uses)], "frame_idx int, use_count int")
    met = one.where(sampling.sampled_at(lambda line: rng.uniform("s", F.lit(1), line, F.col("frame_idx")), rate, F.col("use_count"))).collect()
    assert sorted((r["frame_idx"], r["use_count"]) for r in met) == sorted((i, k) for i in range(60) for k in got[i])


def test_later_epochs_are_not_empty(spark):
    rows = sampling.sampled_positions(spark.createDataFrame([(1, 600)], "global_index bigint, n int"), 0.5, 4, "s").groupBy("use_count").count().collect()
    assert len(rows) == 4 and all(240 < r["count"] < 360 for r in rows)


def test_sampled_positions_are_repeatable(spark):
    chunks = spark.createDataFrame([(1, 50), (2, 0), (3, 7)], "global_index bigint, n int")
    a, b = (values(sampling.sampled_positions(chunks, 0.25, 6, "s"), "global_index", "frame_idx", "use_count") for _ in range(2))
    assert a == b and {x[0] for x in a} == {1, 3}


@pytest.mark.parametrize(("n", "size", "out"), [(5, 10, 0), (10, 10, 1), (20, 10, 11), (0, 3, 0), (4, 1, 4)])
def test_reservoir_counts(spark, n, size, out):
    rows = spark.range(n).coalesce(1)
    found = [r["id"] for r in sampling.reservoir_shuffle(rows, size, 1).collect()]
    assert len(found) == out == len(set(found)) and set(found) <= set(range(n))
    assert sorted(r["id"] for r in sampling.reservoir_shuffle(rows, size, 1, drain=True).collect()) == list(range(n))


def test_reservoirs_over_many_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = [r["id"] for r in sampling.reservoir_shuffle(spark.range(500).coalesce(1), 20, 3, drain=True).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(out) == list(range(500)) and out != sorted(out) and sum(abs(a - b) for a, b in enumerate(out)) / 500 > 10


def test_unpack_by_count_walks_the_sequence(spark):
    chunks = spark.createDataFrame([(7, u, i) for u in range(3) for i in range(3)], "global_index bigint, use_count int, frame_idx int")
    got = values(sampling.unpack(chunks, "s", count=2), "use_count", "frame_idx", "place")
    assert [u for u, *_ in got] == [0, 0, 1, 1, 2, 2] and sorted(p for *_, p in got) == list(range(6))
    assert sorted(f for _, f, _ in got) == [0, 0, 1, 1, 2, 2]  # two permutations
    emitted, offered = sampling.prefetched(sampling.unpack(chunks, "s", count=1, prefetch=3))
    assert values(emitted, "use_count", "place") == [(0, 0), (1, 1), (2, 2)]
    assert values(offered, "next_use", "place") == [(u + 1, u + k) for u in range(3) for k in (1, 2, 3)]


def test_unpack_by_count_favours_weight(spark):
    frames = spark.createDataFrame([(g, 0, i, 0.0, 1.0 if i < 2 else 0.0, 0.0) for g in range(300) for i in range(4)], "global_index bigint, use_count int, frame_idx int, best_q double, orig_q double, policy_kld double")
    got = values(sampling.unpack(frames, "s", count=1, weights={"q_weight": 1.0, "pol_scale": 1.0, "beta": 0.05}), "frame_idx")
    light = sum(1 for (i,) in got if i >= 2)
    assert len(got) == 300 and 5 < light < 60
    nothing = sampling.unpack(frames.withColumn("policy_kld", F.lit(-9.0)), "s", count=1, weights={"q_weight": 1.0, "pol_scale": 1.0})
    assert len(nothing.collect()) == 300  # no weight is positive: all count alike


def test_unpack_by_rate_is_disjoint(spark):
    chunks = spark.createDataFrame([(7, u, i) for u in range(4) for i in range(40)], "global_index bigint, use_count int, frame_idx int")
    assert [f for f, _ in values(sampling.unpack(chunks, "s", rate=0.25), "frame_idx", "use_count")] == list(range(40))
    for bad in ({}, {"rate": 0.5, "count": 1}, {"rate": 1.5}, {"count": 0}):
        with pytest.raises(ValueError):
            sampling.unpack(chunks, "s", **bad)


def test_null_keys_draw_numbers_of_their_own(spark):
    rows = spark.createDataFrame([(None, 1), (1, None), (None, None)], "a int, b int")
    assert rows.select(rng.uniform("s", F.col("a"), F.col("b"))).distinct().count() == 3
    assert spark.range(1).select(rng.uniform("s", F.lit(3), F.lit("x"))).first()[0] == rng.number("s", 3, "x")


def test_position_weight(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(0.5, 0.25, 0.1), (0.5, nan, 0.1), (0.5, 0.25, 100.0), (0.5, None, 0.0), (0.0, 0.0, -3.0)], "b double, o double, k double")
    w = sampling.position_weight(F.col("b"), F.col("o"), F.col("k"), q_weight=6.0, pol_scale=3.5, alpha=2.0, beta=0.05, gamma=0.8, tau=5.0, default=0.7)
    got = [r[0] for r in rows.select(w).collect()]
    assert got[0] == pytest.approx(((6 * 0.25 + 0.1) / 9.5 * 2 + 0.05) ** 0.8)
    assert got[1:4] == [0.7, 5.0, 0.7] and np.isnan(got[4])
    assert rows.select(sampling.position_weight(F.col("b"), F.col("o"), F.col("k"), default=0.3)).first()[0] == 0.3


# Splits.
def test_split_outputs(spark):
    parts = split.split_outputs(spark.range(3000), ["k", F.col("id")], {"a": 1, "b": 2, "z": 0})
    n = {k: v.count() for k, v in parts.items()}
    assert sum(n.values()) == 3000 and n["z"] == 0 and abs(n["a"] - 1000) < 120
    with pytest.raises(ValueError):
        split.hash_split(["k"], {"a": 0})


# Orders, windows and the pool.
def test_prefix_sums_over_partitions(spark):
    rows = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)], "k int, v bigint")
    got = values(ordering.prefixed(rows, [F.col("k")], {"before": F.col("v")}), "k", "v", "row_number", "before")
    total = 0
    for i, (k, v, n, before) in enumerate(got):
        assert (k, n, before) == (i, i + 1, total)
        total += v
    assert ordering.numbered(rows.where("k < 0"), [F.col("k")]).count() == 0


@given(st.lists(st.integers(1, 30), min_size=1, max_size=6), st.integers(1, 80))
@settings(max_examples=8, deadline=None)
def test_newest_window(spark, counts, size):
    sources = spark.createDataFrame([(f"{i:03d}", c) for i, c in enumerate(counts)], "sort_key string, chunk_count bigint")
    kept, newer = [], 0
    for i in range(len(counts) - 1, -1, -1):
        if newer < size:
            kept.append(f"{i:03d}")
        newer += counts[i]
    assert [x[0] for x in values(pool.newest_window(sources, size), "sort_key")] == sorted(kept)
    stay = values(pool.evicted(sources, size).where("not evicted"), "sort_key")
    assert [x[0] for x in stay] == sorted(kept)


def test_look_ups_over_gaps_and_empty_sources(spark):
    sources = spark.createDataFrame([("a", 5, 3), ("b", 8, 0), ("c", 8, 40), ("d", 60, 1)], "sort_key string, start_chunk_index bigint, chunk_count bigint")
    indices = spark.createDataFrame([(i, i * 2) for i in range(70)] + [(6, 0), (None, 1)], "global_index bigint, own int")
    want = sorted([(i, k, i - s0) for i in [*range(70), 6] for k, s0, n in (("a", 5, 3), ("c", 8, 40), ("d", 60, 1)) if s0 <= i < s0 + n])
    got = pool.range_lookup(indices, sources)
    assert values(got, "global_index", "sort_key", "index_within_sort_key") == want and got.columns[:2] == ["global_index", "own"]
    assert pool.range_lookup(indices, sources.where("false")).count() == 0 and pool.range_lookup(indices.where("false"), sources).count() == 0


def test_rows_are_numbered_as_they_come(spark):
    rows = spark.createDataFrame([(i % 3,) for i in range(50)], "k int").repartition(5)
    came = [r["k"] for r in rows.collect()]
    got = values(ordering.arrivals(rows), "row_number", "k")
    assert [n for n, _ in got] == list(range(1, 51)) and sorted(k for _, k in got) == sorted(came)
    assert ordering.arrivals(rows.where("k > 9")).count() == 0


def test_an_order_by_a_random_number(spark):
    rows = spark.range(500).select(F.col("id"), (F.col("id") % 2).alias("g"))
    got = ordering.shuffled(rows, rng.uniform("s", F.col("id")), [F.col("id")], "n", F.col("g"), buckets=7)
    want = sorted(range(500), key=lambda i: (i % 2, rng.number("s", i), i))
    assert [i for _, i in values(got, "n", "id")] == want and got.columns == ["id", "g", "n"]


def test_cache_plans_share_out_what_the_cache_holds(spark):
    uses = spark.createDataFrame([(g, u, 10 * u + g, 1.0 if g else 0.5) for g in range(4) for u in range(6)], "global_index bigint, use_count bigint, position bigint, probability double")
    rows = {(r["global_index"], r["use_count"]): r for r in pool.cache_plan(uses, 6, 4, 2).collect()}
    held, carried, average = {g: 0 for g in range(4)}, 0.0, 1.0
    for u in range(6):
        for g in range(4):
            p, r = (1.0 if g else 0.5), rows[g, u]
            if held[g]:
                assert r["status"] == "hit"
                held[g] -= 1
                continue
            average = 0.01 * average + 0.99 * p
            exact = p * 6 / 4 / average + carried
            carried = exact - int(exact)
            held[g] = min(int(exact), 2)
            assert (r["status"], r["newly_cached"], r["dropped"]) == ("miss", held[g], max(0, 2 - int(exact)))


def test_epochs_are_permutations(spark):
    rows = spark.range(50).withColumnRenamed("id", "global_index")
    got = values(pool.epochs(rows, 3, "s"), "epoch", "position", "global_index")
    orders = [[g for e, _, g in got if e == k] for k in range(3)]
    assert all(sorted(o) == list(range(50)) for o in orders) and orders[0] != orders[1]
    assert [p for _, p, _ in got] == list(range(1, 151))


def test_requests_and_blacklist(spark):
    uses = spark.createDataFrame([(1, 2), (2, 3)], "global_index bigint, use_count int")
    asked = spark.createDataFrame([(1, 2), (2, 1), (9, 0)], "global_index bigint, next_use int")
    assert values(pool.matched_requests(asked, uses), "global_index", "status") == [(1, "matched"), (2, "mismatched"), (9, "not_found")]
    assert values(pool.without_dropped(asked, uses, ["global_index"]), "global_index") == [(9,)]


# Aggregates.
def test_chunk_results(spark):
    rows = spark.createDataFrame([(1.0, 0.0, 0), (1.0, 0.0, 1), (-1.0, 0.0, 0), (-1.0, 0.0, 1), (0.3, 1.0, 0), (0.5, 0.0, 0), (1.0, 0.5, 0)], "q double, d double, s int")
    got = [r[0] for r in rows.select(stats.chunk_result(F.col("q"), F.col("d"), F.col("s") != 0)).collect()]
    assert got == ["win", "loss", "loss", "win", "draw", None, None]


def test_running_average_is_capped(spark):
    xs = [1.0, 5.0, 3.0, 9.0]
    n = avg = 0.0
    for x in xs:
        avg, n = (avg * n + x) / (n + 1), min(n + 1, 2.0)
    got = spark.createDataFrame([(xs,)], "x array<double>").select(stats.weighted_averages(F.col("x"), 2)).first()[0]
    assert got == pytest.approx(avg)


def test_metric_merges(spark):
    a = spark.createDataFrame([("s", "n", "count", 2.0, 1), ("s", "g", "gauge", 7.0, 5)], "stage string, name string, kind string, value double, time int")
    b = spark.createDataFrame([("s", "n", "count", 3.0, 2), ("s", "g", "gauge", None, 9), ("t", "n", "count", 1.0, 1)], a.schema)
    assert values(stats.merged_metrics([a, b]), "stage", "name", "value") == [("s", "g", 7.0), ("s", "n", 5.0), ("t", "n", 1.0)]
    parts = spark.createDataFrame([("x", 1.0, 3.0, 4.0, 2, 3.0, 1), ("x", None, None, None, 0, None, 9), ("x", 0.0, 1.0, 1.0, 1, 0.5, 4)], "k string, min double, max double, sum double, count bigint, latest double, time int")
    assert values(stats.merged_statistics(parts, ["k"]), "min", "max", "sum", "count", "latest") == [(0.0, 3.0, 5.0, 3, 0.5)]
    assert spark.range(1).select(stats.clip_scale(F.lit(4.0), 1.0)).first()[0] == 0.25


# Exponential windows: the closed forms against the carrying of whole buckets, as the windows are defined.
def test_buckets_against_carrying():
    slots: dict[int, tuple[int, int]] = {}
    for t in range(1, 130):
        span, i = (t - 1, t), 0
        slots[0] = span
        while t % (1 << (i + 1)) == 0:
            i += 1
            span = (t - (1 << i), t)
            slots[i] = span
        for k, expected in slots.items():
            assert exponential.bucket_span(t, k) == expected
        assert exponential.bucket_span(t, t.bit_length()) == (0, 0)
    assert [exponential.ending_now_ticks(37, n) for n in (0, 1, 5, 6, 33, 100)] == [0, 1, 5, 13, 37, 37]


@pytest.mark.parametrize(("t", "n"), list(itertools.product((1, 7, 37, 64, 100), (1, 2, 3, 8, 31, 90))))
def test_ending_now_covers(t, n):
    m = exponential.ending_now_ticks(t, n)
    assert m <= t and (m >= n or m == t or t < n or (1 << n.bit_length()) > t)


def test_ending_now_with_pending(spark):
    ticks = spark.createDataFrame([(i, float(i)) for i in range(1, 11)], "tick bigint, value double")
    pending = spark.createDataFrame([(11, 100.0)], ticks.schema)
    assert exponential.ending_now(ticks, 10, 2, "tick", [F.sum("value").alias("s")], pending).first()["s"] == 100.0 + sum(range(11 - exponential.ending_now_ticks(10, 2), 11))


# Schedules.
def lr_at(spark, rules, steps):
    return [r[0] for r in spark.createDataFrame([(s,) for s in steps], "s bigint").select(schedule.scheduled(F.col("s"), rules)).collect()]


def test_learning_rates(spark):
    constant = [{"starting_step": 0, "duration_steps": [0], "lr": [0.3], "transition": []}]
    assert lr_at(spark, constant, [0, 5, 1000]) == [0.3] * 3
    line = [{"starting_step": 10, "duration_steps": [10], "lr": [1.0, 2.0], "transition": ["LINEAR"]}]
    assert lr_at(spark, line, [0, 10, 15, 20, 99]) == [1.0, 1.0, 1.5, 2.0, 2.0]
    cosine = [{"starting_step": 0, "duration_steps": [10], "lr": [1.0, 0.0], "transition": ["COSINE"]}]
    assert lr_at(spark, cosine, [0, 5, 10]) == pytest.approx([1.0, 0.5, 0.0])
    loop = [{"starting_step": 0, "duration_steps": [2, 2], "lr": [1.0, 3.0, 9.0], "transition": ["CONSTANT", "CONSTANT"], "loop": True}]
    assert lr_at(spark, loop, [0, 1, 2, 3, 4, 6]) == [1.0, 1.0, 3.0, 3.0, 1.0, 3.0]
    assert lr_at(spark, line + [{"starting_step": 50, "duration_steps": [], "lr": [7.0], "transition": []}], [49, 50]) == [2.0, 7.0]
    assert lr_at(spark, [], [3]) == [0.0]
    assert schedule.gate(100, 50, [120, 10, 500]) == [30, 70, 25]


def test_globs(spark):
    rows = spark.createDataFrame([("a.b/w1",), ("x",), ("q[1]",)], "p string")
    got = [r[0] for r in rows.select(schedule.selected(F.col("p"), [("a.b*", 1), ("?", 2), ("q[[]1[]]", 3)], 9)).collect()]
    assert got == [1, 2, 3]


# Rescoring.
def test_short_term_values(spark):
    rows = spark.createDataFrame([(1, i, q, d) for i, (q, d) in enumerate([(0.5, 0.1), (-0.25, 0.2), (1.0, -0.3)])], "c int, i int, q double, d double")
    got = values(rescoring.short_term_values(rows, "c", "i", "q", "d", 0.25), "i", "q_st", "d_st")
    s2, s1 = 1.0, 0.25 * 1.0 + 0.75 * 0.25
    assert [x[1] for x in got] == pytest.approx([0.25 * s1 + 0.75 * 0.5, -s1, s2])
    assert got[2][2] == 0.0  # never under zero


def test_rescoring_drops_chunks_that_fail(spark):
    rows = spark.createDataFrame([(c, i, float(c)) for c in range(3) for i in range(2)], "c int, i int, x double")

    def hook(table):
        if table["c"][0].as_py() == 1:
            raise RuntimeError
        return table

    after = rescoring.rescored(rows, "c", "i", hook)
    assert values(after, "c", "i") == [(0, 0), (0, 1), (2, 0), (2, 1)]
    assert values(rescoring.failed_rescores(rows, after, "c"), "c") == [(1,)]
    assert rescoring.check_options("", 0.1, 0.2) and not rescoring.check_options()
    with pytest.raises(ValueError):
        rescoring.check_options("", 0.1)


# Joins.
def test_merging_paths_by_rules(spark):
    old = spark.createDataFrame([("a.x", 1.0), ("b.y", 2.0), ("skip.z", 3.0), ("k", 4.0)], "path string, value double")
    new = spark.createDataFrame([("n.x", 0.0), ("b.y", 0.0), ("fresh", 0.0)], old.schema)
    got = values(joins.merged_paths(old, new, [("move", "a", "n"), ("ignore", "skip", ""), ("keep", "b", "")]), "path", "status")
    assert got == [("b.y", "copied"), ("fresh", "+"), ("k", "-"), ("n.x", "copied")]


def test_alignment_by_shape_then_size(spark):
    ours = spark.createDataFrame([("a", "1,4", 4), ("b", "2,2", 4), ("c", "9", 9)], "name string, shape string, size int")
    reference = spark.createDataFrame([("x", "2,2", 4), ("y", "4,1", 4), ("z", "3,3", 9)], ours.schema)
    assert values(joins.aligned(ours, reference, "shape", "size", "name"), "ours", "reference") == [("a", "y"), ("b", "x"), ("c", "z")]


def test_latest_needs_enough(spark):
    assert joins.latest(spark.range(3), "id", 9, allow_less=True).count() == 3
    with pytest.raises(ValueError):
        joins.latest(spark.range(3), "id", 9)
    assert spark.createDataFrame([([5, 6, 7],)], "x array<int>").select(joins.gathered(F.col("x"), [2, 0])).first()[0] == [7, 5]


# Edges and anchors.
def test_overflow(spark):
    puts = spark.createDataFrame([("e", i) for i in range(7)], "edge string, n int")
    assert values(queues.kept(puts, "edge", "n", 3, "DROP_NEW"), "n") == [(0,), (1,), (2,)]
    assert values(queues.kept(puts, "edge", "n", 3, "KEEP_NEWEST"), "n") == [(4,), (5,), (6,)]
    assert queues.kept(puts, "edge", "n", 3, "BLOCK").count() == 7
    assert values(queues.counts(puts, "edge", 3), "put_count", "drop_count") == [(7, 4)]
    with pytest.raises(ValueError):
        queues.kept(puts, "edge", "n", 3, "SPILL")


def test_anchor(spark, tmp_path):
    sources = lambda *rows: spark.createDataFrame(list(rows), "sort_key string, chunk_count bigint")
    path = f"file://{tmp_path}/anchor"
    a = anchors.Anchor(spark, path)
    a.set("b")
    a.add(sources(("a", 5), ("b", 7), ("c", 3)))
    assert (a.chunks, a.newest) == (3, "c")
    a.add(sources(("a2", 4)), batch=0)
    a = anchors.Anchor(spark, path)  # a restart goes on from what was kept
    a.add(sources(("a2", 4)), batch=0)  # the same batch again
    assert a.chunks == 7
    assert a.reset() == ("c", 7) and a.chunks == 0
    a.add(sources(("d", 2)), batch=1)
    a.set("x")
    assert (a.key, a.chunks) == ("x", 2)
    os.makedirs(tmp_path / "anchor" / "version=99")  # a version that was never finished
    b = anchors.Anchor(spark, path)
    assert b.state == a.state and b.state.batch == 1 and b.version == a.version
    b.add(sources(("e", 1)), batch=2)
    assert anchors.Anchor(spark, path).chunks == 3


def test_trim(spark):
    ids = spark.createDataFrame([("t", i) for i in range(12)] + [("u", i) for i in range(5)], "part string, id int")
    assert values(windows.trimmed(ids, 10), "part", "id") == [("t", 0), ("t", 1)]
    assert windows.cache_budget(0.5, 100, 10, 2.0, 0.75) == (3, 0.25)
    assert windows.smoothed(None, 4.0) == 4.0 and windows.smoothed(1.0, 2.0) == pytest.approx(1.99)
