"""The registered queries of the engine's own operators, each with the SQL that gives its rows.

The tables stand for archives: months of orders and sources of documents are chunk sources, users' events in order of
time are the frames of chunks, embeddings are planes and layers of weights.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import codecs, losses, rng, tensors, text
from tidewater.functions.rng import sql_below, sql_uniform
from tidewater.operators import exponential, joins, pool, rescoring, sampling, schedule, split, stats
from tidewater.operators.ordering import numbered, prefixed
from tidewater.sources import files
from tidewater.streaming import queues

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
SEED = "tw"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def register(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"query {f.__name__} is registered twice")
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column | str, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# Months of orders as sources of chunks.
MONTHS = "months AS (SELECT strftime(o_orderdate, '%Y-%m') AS sort_key, count(*) AS chunk_count FROM orders GROUP BY 1)"


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("sort_key")).agg(F.count("*").alias("chunk_count"))


# Orders as chunks with global indices, oldest month first.
CHUNKS = "chunks AS (SELECT strftime(o_orderdate, '%Y-%m') AS sort_key, o_orderkey, row_number() OVER (ORDER BY strftime(o_orderdate, '%Y-%m'), o_orderkey) - 1 AS global_index FROM orders)"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("sort_key"), "o_orderkey")
    return numbered(slim, [F.col("sort_key"), F.col("o_orderkey")], "n").select("sort_key", "o_orderkey", (F.col("n") - F.lit(1)).alias("global_index"))


# Users' events as frames.
FRAMES = """raw AS (SELECT event_id, ts, user_id AS chunk, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
frames AS (SELECT event_id, chunk, event_type, value, k, row_number() OVER (PARTITION BY chunk ORDER BY ts) - 1 AS frame_idx, k / 50.0::DOUBLE - 1 AS best_q,
    CASE WHEN k % 10 = 0 THEN 'NaN'::DOUBLE ELSE (k / 50.0::DOUBLE - 1) / 2 END AS orig_q, value / 100 AS kld, k % 7 / 10.0::DOUBLE AS d FROM raw)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("chunk"), "event_type", "value", k.alias("k"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts")) - 1).alias("frame_idx"))
    q = F.col("k") / F.lit(50.0) - 1
    return rows.select("*", q.alias("best_q"), F.when(F.col("k") % 10 == 0, float("nan")).otherwise(q / 2).alias("orig_q"), (F.col("value") / 100).alias("kld"), (F.col("k") % 7 / F.lit(10.0)).alias("d"))


WEIGHT = dict(q_weight=6.0, pol_scale=3.5, alpha=2.0, beta=0.05, gamma=0.8, tau=1.0)


def weight() -> Column:
    return sampling.position_weight(F.col("best_q"), F.col("orig_q"), F.col("kld"), **WEIGHT)


WEIGHTS = FRAMES + """, weighted AS (SELECT *, CASE WHEN isnan(orig_q) THEN 1.0 ELSE least(pow((6.0 * abs(best_q - orig_q) + kld) / 9.5 * 2.0 + 0.05, 0.8), 1.0) END AS weight FROM frames)"""


# A: aggregates.
@query("""SELECT source AS sort_key, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS win, count(*) FILTER (WHERE toxic = 1) AS draw,
    count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS loss, 0 AS invalid FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def q_result_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    result = stats.chunk_result(F.col("quality") * 2.0 - 1, F.col("toxic").cast("double"), F.lit(False))
    return stats.result_distribution(both.select(F.col("source").alias("sort_key"), result.alias("result")))


@query(f"WITH {WEIGHTS} SELECT chunk, round(sum(weight), 6) AS weight, round(max(weight), 6) AS greatest FROM weighted GROUP BY chunk")
def q_chunk_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).groupBy("chunk").agg(rounded(F.sum(weight())).alias("weight"), rounded(F.max(weight())).alias("greatest"))


@query(f"WITH {WEIGHTS} SELECT event_id, round(CASE WHEN max(weight) OVER (PARTITION BY chunk) <= 0 THEN 1 ELSE weight / max(weight) OVER (PARTITION BY chunk) END, 6) AS probability FROM weighted")
def q_weight_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.normalised(frames(spark, sf_dir).withColumn("weight", weight()), "weight", "chunk").select("event_id", rounded("probability").alias("probability"))


@query("""WITH r AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem)
    SELECT p::INTEGER AS percentile, v AS value FROM r JOIN range(101) t(p) ON i = (n - 1) * p // 100""")
def q_weight_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.percentile_rows(table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_partkey"), "l_extendedprice", "l_partkey").select("percentile", F.col("value"))


@query("""WITH e AS (SELECT min(value) AS low, max(value) AS high FROM events)
    SELECT greatest(0, least(49, floor((value - low) / (high - low) * 49)))::INTEGER AS bucket, count(*) AS n FROM events, e GROUP BY 1""")
def q_weight_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bucket_histogram(table(spark, sf_dir, "events"), "value")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 1")
def q_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.argmax(table(spark, sf_dir, "events").select("event_id", "value"), "value", "event_id")


@query("SELECT event_type, min(value) AS min, max(value) AS max, round(sum(value), 4) AS sum, count(value) AS count, max_by(value, ts) AS latest FROM events GROUP BY event_type")
def q_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "events").groupBy("event_type").agg(*stats.statistics(F.col("value"), F.col("ts")))
    return out.withColumn("sum", rounded("sum", 4))


@query("""SELECT event_type AS stage, 'value' AS name, 'gauge' AS kind, max_by(value, ts) FILTER (WHERE value IS NOT NULL) AS value FROM events GROUP BY 1
    UNION ALL SELECT event_type, 'events', 'count', count(*)::DOUBLE FROM events GROUP BY 1""")
def q_metric_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    sides = []
    for half in (0, 1):
        own = events.where(F.col("event_id") % 2 == half)
        sides.append(own.select(F.col("event_type").alias("stage"), F.lit("value").alias("name"), F.lit("gauge").alias("kind"), "value", F.col("ts").alias("time")))
        sides.append(own.select(F.col("event_type").alias("stage"), F.lit("events").alias("name"), F.lit("count").alias("kind"), F.lit(1.0).alias("value"), F.col("ts").alias("time")))
    return stats.merged_metrics(sides)


@query("""WITH s AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, event_type IN ('click', 'purchase') AS active FROM events),
    d AS (SELECT user_id, active, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t), 1706659200) - t AS d FROM s)
    SELECT user_id, round(coalesce(sum(d) FILTER (WHERE active), 0), 3) AS load_seconds, round(sum(d), 3) AS total_seconds FROM d GROUP BY user_id""")
def q_load_duty(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    out = stats.duty_cycle(table(spark, sf_dir, "events"), "user_id", seconds, F.col("event_type").isin("click", "purchase"), F.lit(1706659200.0))
    return out.select("user_id", rounded("load_seconds", 3).alias("load_seconds"), rounded("total_seconds", 3).alias("total_seconds"))


COORDINATES = "cells AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))


@query(f"WITH {COORDINATES} SELECT label, i % 4 AS part, round(sqrt(sum(x * x) / count(x)), 6) AS rms FROM cells GROUP BY GROUPING SETS ((label, part), (label), ())")
def q_rms_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.rms(cells(spark, sf_dir).withColumn("part", F.col("i") % 4), "x", ["label", "part"], [["label", "part"], ["label"], []])
    return out.withColumn("rms", rounded("rms"))


@query(f"""WITH {COORDINATES}, p AS (SELECT a.x AS ours, b.x AS reference FROM cells a JOIN cells b ON a.i = b.i AND b.vec_id = a.vec_id + 1),
    s AS (SELECT 'absolute' AS kind, abs(ours - reference) AS x FROM p UNION ALL SELECT 'relative', abs(ours - reference) / abs(reference) FROM p WHERE abs(reference) >= 1e-4)
    SELECT kind, CASE WHEN x <> 0 THEN floor(log2(x))::INTEGER END AS bin, count(*) AS n FROM s GROUP BY 1, 2""")
def q_diff_log2_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    pairs = c.select("vec_id", "i", F.col("x").alias("ours")).join(c.select((F.col("vec_id") - 1).alias("vec_id"), "i", F.col("x").alias("reference")), ["vec_id", "i"])
    return stats.difference_bins(pairs, "ours", "reference")


@query(f"""WITH {COORDINATES}, n AS (SELECT a.vec_id, sqrt(sum((b.x - a.x) * (b.x - a.x))) AS moved, sqrt(sum(a.x * a.x)) AS was FROM cells a JOIN cells b ON a.i = b.i AND b.vec_id = a.vec_id + 1 GROUP BY 1),
    r AS (SELECT vec_id, CASE WHEN was > 0 THEN moved / was ELSE -1 END AS ratio FROM n)
    SELECT vec_id, round(ratio, 6) AS ratio, (CASE WHEN ratio > 0 THEN floor(log10(ratio) * 10) ELSE 200 END)::INTEGER AS bin FROM r""")
def q_update_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    after = c.select((F.col("vec_id") - 1).alias("vec_id"), "i", "x")
    return stats.update_ratio(c, after, "vec_id", "i", "x").withColumn("ratio", rounded("ratio"))


@query(f"""WITH {FRAMES}, s AS (SELECT chunk, list(value ORDER BY frame_idx) AS xs FROM frames GROUP BY chunk)
    SELECT chunk, round(list_reduce(list_prepend({{'a': 0.0::DOUBLE, 'n': 0.0::DOUBLE}}, list_transform(xs, lambda x: {{'a': x, 'n': 0.0::DOUBLE}})),
        lambda acc, x: {{'a': (acc.a * acc.n + x.a) / (acc.n + 1), 'n': least(acc.n + 1, 10.0::DOUBLE)}}).a, 6) AS average FROM s""")
def q_swa(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.transform(F.sort_array(F.collect_list(F.struct("frame_idx", "value"))), lambda s: s["value"])
    return frames(spark, sf_dir).groupBy("chunk").agg(values.alias("xs")).select("chunk", rounded(stats.weighted_averages(F.col("xs"), 10)).alias("average"))


@query(f"""WITH {FRAMES} SELECT chunk, event_id, rank FROM (SELECT chunk, event_id, row_number() OVER (PARTITION BY chunk ORDER BY kld DESC, event_id)::INTEGER AS rank FROM frames) WHERE rank <= 3""")
def q_top_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_moves(frames(spark, sf_dir), "chunk", "event_id", "kld", 3).select("chunk", "event_id", "rank")


@query("SELECT source, round(avg(n_chars), 6) AS mean, count(*) AS n FROM documents GROUP BY source")
def q_mean_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(rounded(F.avg("n_chars")).alias("mean"), F.count("*").alias("n"))


# H, F: splits and samples.
@query(f"SELECT CASE WHEN r < 1 THEN 'a' WHEN r < 3 THEN 'b' ELSE 'c' END AS output, count(*) AS n FROM (SELECT {sql_below(8, repr(SEED), 'source', 'doc_id')} AS r FROM documents) GROUP BY 1")
def q_hash_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [SEED, F.col("source"), F.col("doc_id")]
    return table(spark, sf_dir, "documents").groupBy(split.hash_split(keys, {"a": 1, "b": 2, "c": 5, "none": 0}).alias("output")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 100 >= 90 THEN 'test' ELSE 'train' END AS part FROM documents")
def q_mod_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", split.mod_split(F.col("doc_id")).alias("part"))


@query(f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {sql_uniform(repr(SEED), 'doc_id')}, doc_id) <= floor(0.9 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS part FROM documents")
def q_ratio_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.ratio_split(table(spark, sf_dir, "documents").select("doc_id"), 0.9, SEED, F.col("doc_id")).select("doc_id", "part")


@query(f"SELECT event_id FROM events WHERE {sql_below(32, repr(SEED), 'event_id')} = 0")
def q_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id").where(split.downsample([SEED, F.col("event_id")], 32))


@query(f"WITH {FRAMES} SELECT event_id FROM frames WHERE NOT (NOT isnan(orig_q) AND kld > 0 AND 0.05 + 1.5 * ((6.0 * abs(best_q - orig_q) + 3.5 * kld) / 9.5) < 1 AND {sql_uniform(repr(SEED), 'event_id')} > 0.05 + 1.5 * ((6.0 * abs(best_q - orig_q) + 3.5 * kld) / 9.5))")
def q_diff_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = sampling.diff_focus(F.lit(6), F.col("orig_q"), F.col("best_q"), F.col("kld"), rng.uniform(SEED, F.col("event_id")), 0.05, 1.5, 6.0, 3.5)
    return frames(spark, sf_dir).where(keep).select("event_id")


@query(f"WITH {WEIGHTS} SELECT event_id, round(weight, 6) AS weight FROM weighted")
def q_position_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("event_id", rounded(weight()).alias("weight"))


@query(f"""WITH {WEIGHTS}, c AS (SELECT chunk, sum(weight) AS weight FROM weighted GROUP BY chunk), m AS (SELECT max(weight) AS most FROM c)
    SELECT chunk FROM c, m WHERE {sql_uniform(repr(SEED), 'chunk')} < CASE WHEN most <= 0 THEN 1 ELSE pow(weight / most, 2.0) END""")
def q_hanse_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = frames(spark, sf_dir).groupBy("chunk").agg(F.sum(weight()).alias("weight"))
    return pool.accepted(weights, 2.0, SEED).where("accepted").select("chunk")


# A position on unit L of the line falls in share (L + u) / rate. It is left out of a unit if the run of units before, on
# each of which it fell in the share over the unit's end, is odd: the first of such a run counts, the next doesn't.
@query(f"""WITH {FRAMES}, t AS (SELECT event_id, line, floor((line + {sql_uniform(repr(SEED), 'chunk', 'line', 'frame_idx')}) / 0.3)::BIGINT AS use_count, floor((line + 1) / 0.3)::BIGINT AS last FROM frames, range(4) r(line)),
    s AS (SELECT *, use_count = last AND last * 0.3 < line + 1 AS over FROM t),
    r AS (SELECT *, line - 1 - coalesce(max(CASE WHEN NOT over THEN line END) OVER (PARTITION BY event_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS run FROM s)
    SELECT event_id, use_count FROM r WHERE run % 2 = 0 AND use_count < 10""")
def q_pick_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten uses at a rate whose shares reach over the ends of units."""
    at = sampling.position_uses(lambda line: rng.uniform(SEED, F.col("chunk"), line, F.col("frame_idx")), 0.3, F.lit(10).cast("bigint"))
    return frames(spark, sf_dir).select("event_id", F.explode(at).alias("use_count"))


SEQUENCE = f"""{WEIGHTS}, p AS (SELECT chunk, frame_idx, CASE WHEN max(weight) OVER (PARTITION BY chunk) <= 0 THEN 1 ELSE weight / max(weight) OVER (PARTITION BY chunk) END AS probability FROM weighted),
    b AS (SELECT chunk, frame_idx, block FROM p, range(6) t(block) WHERE {sql_uniform(repr(SEED), "'accept'", 'chunk', 'block', 'frame_idx')} < probability),
    o AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY block, {sql_uniform(repr(SEED), "'order'", 'chunk', 'block', 'frame_idx')}, frame_idx) - 1 AS place FROM b)"""


def sequence_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.normalised(frames(spark, sf_dir).withColumn("weight", weight()), "weight", "chunk").select("chunk", "frame_idx", "probability")


@query(f"WITH {SEQUENCE} SELECT chunk, frame_idx, block, place FROM o WHERE place >= 2 AND place < 6")
def q_prob_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = sampling.probabilistic_sequence(sequence_frames(spark, sf_dir), "chunk", "frame_idx", "probability", 4, F.lit(2), SEED)
    return taken.select("chunk", "frame_idx", F.col("block").cast("bigint").alias("block"), F.col("place").cast("bigint").alias("place"))


@query(f"WITH {SEQUENCE} SELECT chunk, frame_idx, place = 0 AS emitted, CASE WHEN place > 0 THEN 1::BIGINT END AS next_use FROM o WHERE place < 6")
def q_unpack_prefetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).withColumnRenamed("kld", "policy_kld").withColumn("use_count", F.lit(0).cast("bigint"))
    emitted, offered = sampling.prefetched(sampling.unpack(rows, SEED, count=1, prefetch=5, weights=WEIGHT, chunk="chunk"))
    both = emitted.select("chunk", "frame_idx", F.lit(True).alias("emitted"), F.lit(None).cast("bigint").alias("next_use"))
    return both.unionByName(offered.select("chunk", "frame_idx", F.lit(False).alias("emitted"), "next_use"))


@query("SELECT (user_id % 8)::INTEGER AS reservoir, greatest(0, count(*) - 10 + 1) AS emitted, true AS known FROM events GROUP BY 1")
def q_reservoir_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight reservoirs side by side: of each, how many rows leave, and that they are rows that came."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id").repartitionById(8, (F.col("user_id") % 8).cast("int"))
    out = sampling.reservoir_shuffle(rows, 10, 1)
    return out.groupBy((F.col("user_id") % 8).cast("int").alias("reservoir")).agg(F.count("*").alias("emitted"), (F.count_distinct("event_id") == F.count("*")).alias("known"))


@query("SELECT event_id FROM events")
def q_reservoir_drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reservoirs that are emptied at the end lose no row."""
    return sampling.reservoir_shuffle(table(spark, sf_dir, "events").select("event_id").repartition(4), 50, 1, drain=True)


@query(f"WITH {CHUNKS} SELECT global_index, row_number() OVER (ORDER BY {sql_uniform(repr(SEED), '3', 'global_index')}, global_index) AS position FROM chunks")
def q_epoch_shuffle_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.epoch_order(chunks(spark, sf_dir).select("global_index"), SEED, 3)


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) - 1 AS use_count FROM lineitem")
def q_use_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("sequence", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"))
    return pool.use_counts(rows, "l_partkey", "sequence").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "use_count")


# W, J, O, U: windows, joins, orders and sets.
@query(f"WITH {MONTHS} SELECT sort_key, chunk_count, (sum(chunk_count) OVER (ORDER BY sort_key) - chunk_count)::BIGINT AS start_chunk_index FROM months")
def q_source_prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.start_indices(months(spark, sf_dir))


NEWER = MONTHS + ", newer AS (SELECT *, (sum(chunk_count) OVER (ORDER BY sort_key DESC) - chunk_count)::BIGINT AS newer_chunks FROM months)"


@query(f"WITH {NEWER} SELECT sort_key, chunk_count, newer_chunks FROM newer WHERE newer_chunks < 5000")
def q_newest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.newest_window(months(spark, sf_dir), 5000)


@query(f"WITH {NEWER} SELECT sort_key, newer_chunks >= 5000 AND sort_key <> (SELECT max(sort_key) FROM months) AS evicted FROM newer")
def q_window_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.evicted(months(spark, sf_dir), 5000).select("sort_key", "evicted")


@query(f"WITH {CHUNKS} SELECT global_index, sort_key, (row_number() OVER (PARTITION BY sort_key ORDER BY global_index) - 1)::BIGINT AS index_within_sort_key FROM chunks")
def q_range_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    indices = chunks(spark, sf_dir).select("global_index")
    return pool.range_lookup(indices, pool.start_indices(months(spark, sf_dir))).select("global_index", "sort_key", "index_within_sort_key")


@query("""WITH u AS (SELECT l_partkey AS global_index, count(*) AS use_count FROM lineitem GROUP BY 1), r AS (SELECT p_partkey AS global_index, 30::BIGINT AS next_use FROM part)
    SELECT CASE WHEN use_count IS NULL THEN 'not_found' WHEN use_count = next_use THEN 'matched' ELSE 'mismatched' END AS status, count(*) AS n FROM r LEFT JOIN u USING (global_index) GROUP BY 1""")
def q_cache_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("global_index")).agg(F.count("*").alias("use_count"))
    requests = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("global_index"), F.lit(30).alias("next_use"))
    return pool.matched_requests(requests, uses).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {MONTHS} SELECT coalesce(sum(chunk_count), 0)::BIGINT AS chunks_since_anchor, count(*) AS sources FROM months WHERE sort_key > '1998-03'")
def q_anchor_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.since_anchor(months(spark, sf_dir), "1998-03")


@query("SELECT c_custkey AS id, 'c' AS part FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier UNION ALL SELECT p_partkey, 'p' FROM part")
def q_join_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = [table(spark, sf_dir, t).select(F.col(c).alias("id"), F.lit(p).alias("part")) for t, c, p in (("customer", "c_custkey", "c"), ("supplier", "s_suppkey", "s"), ("part", "p_partkey", "p"))]
    return joins.join_positions(sides)


@query("SELECT c_custkey AS id FROM (SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 500) WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def q_anti_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return joins.newest_not_in(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), used, "id", 500)


@query("SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def q_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda flag: table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("id"))
    return part("A").intersect(part("R"))


@query("""WITH o AS (SELECT 'm.' || c_custkey AS path, c_acctbal AS value FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT 'n.' || c_custkey AS path, 0.0::DOUBLE AS value FROM customer WHERE c_custkey % 3 = 0),
    moved AS (SELECT 'n' || substr(path, 2) AS path, value FROM o)
    SELECT coalesce(m.path, n.path) AS path, CASE WHEN n.path IS NULL THEN '-' WHEN m.path IS NULL THEN '+' ELSE 'copied' END AS status, CASE WHEN m.path IS NOT NULL AND n.path IS NOT NULL THEN m.value ELSE n.value END AS value
    FROM moved m FULL JOIN n ON m.path = n.path""")
def q_path_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 2 = 0").select(F.concat(F.lit("m."), F.col("c_custkey")).alias("path"), F.col("c_acctbal").alias("value"))
    new = c.where("c_custkey % 3 = 0").select(F.concat(F.lit("n."), F.col("c_custkey")).alias("path"), F.lit(0.0).alias("value"))
    return joins.merged_paths(old, new, [("move", "m", "n")])


@query("SELECT source AS name, count(*) AS n FROM documents GROUP BY source HAVING count(*) > 1")
def q_duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.duplicates(table(spark, sf_dir, "documents").select(F.col("source").alias("name")), "name")


@query("""SELECT o_orderkey, b AS batch_id, p AS place FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 128 AS b, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) % 128 AS p, count(*) OVER () // 128 AS whole FROM orders) WHERE b < whole""")
def q_batching(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")])
    return joins.batches(rows, 128).select("o_orderkey", "batch_id", "place")


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id DESC LIMIT 100")
def q_latest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.latest(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 100)


@query(f"""WITH {FRAMES}, s AS (SELECT chunk, list(CASE WHEN frame_idx % 2 = 0 THEN best_q ELSE -best_q END ORDER BY frame_idx) AS qs, list(d ORDER BY frame_idx) AS ds FROM frames GROUP BY chunk),
    f AS (SELECT event_id, frame_idx, list_reduce(list_reverse(list_slice(qs, frame_idx + 1, len(qs))), lambda a, x: a * 0.8333333333 + x * (1 - 0.8333333333::DOUBLE)) AS q, list_reduce(list_reverse(list_slice(ds, frame_idx + 1, len(ds))), lambda a, x: a * 0.8333333333 + x * (1 - 0.8333333333::DOUBLE)) AS d FROM frames JOIN s USING (chunk))
    SELECT event_id, round(CASE WHEN frame_idx % 2 = 0 THEN q ELSE -q END, 6) + 0 AS q_st, round(greatest(d, 0), 6) AS d_st FROM f""")
def q_short_term_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rescoring.short_term_values(frames(spark, sf_dir).withColumnRenamed("d", "dd"), "chunk", "frame_idx", "best_q", "dd")
    return out.select("event_id", (rounded("q_st") + 0).alias("q_st"), rounded("d_st").alias("d_st"))


@query(f"WITH {FRAMES} SELECT event_id, coalesce(lead(k, 1) OVER w, 65535) AS opp_played_idx, coalesce(lead(k, 2) OVER w, 65535) AS next_played_idx FROM frames WINDOW w AS (PARTITION BY chunk ORDER BY frame_idx)")
def q_lead_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescoring.next_moves(frames(spark, sf_dir), "chunk", "frame_idx", "k").select("event_id", "opp_played_idx", "next_played_idx")


RULES = [
    {"starting_step": 100, "duration_steps": [400, 0, 600], "lr": [0.1, 0.2, 0.2, 0.05], "transition": ["LINEAR", "CONSTANT", "COSINE"]},
    {"starting_step": 3000, "duration_steps": [500, 500], "lr": [0.01, 0.02, 0.01], "transition": ["LINEAR", "CONSTANT"], "loop": True},
]


@query("""SELECT event_id AS step, round(CASE WHEN event_id >= 3000 THEN CASE WHEN (event_id - 3000) % 1000 < 500 THEN 0.01 + 0.01 * (((event_id - 3000) % 1000) / 500.0::DOUBLE) ELSE 0.02 END
    WHEN event_id >= 1100 THEN 0.05 WHEN event_id >= 500 THEN 0.2 - 0.075 * (1 - cos(pi() * ((event_id - 500) / 600.0::DOUBLE))) WHEN event_id >= 100 THEN 0.1 + 0.1 * ((event_id - 100) / 400.0::DOUBLE) ELSE 0.1 END, 6) AS lr FROM events""")
def q_lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), rounded(schedule.scheduled(F.col("event_id"), RULES)).alias("lr"))


@query("SELECT event_id, (event_id + 1) % 50 = 0 AS by_step, (event_id % 1000 + 1) % 40 = 0 AS by_epoch_step, event_id % 1000 = 999 AS after_epoch FROM events")
def q_metric_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    step, local = F.col("event_id"), F.col("event_id") % 1000
    return table(spark, sf_dir, "events").select("event_id", schedule.due(step, local, 50).alias("by_step"), schedule.due(step, local, 40, use_global=False).alias("by_epoch_step"), schedule.due(step, local, 1, after_epoch=True, last=local == 999).alias("after_epoch"))


@query("SELECT p_partkey, CASE WHEN regexp_full_match(p_type, '.*STEEL.*') THEN 1 WHEN regexp_full_match(p_type, 'S.*') THEN 2 WHEN regexp_full_match(p_type, '[LM].*') THEN 3 ELSE 0 END AS chosen FROM part")
def q_glob_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", schedule.selected(F.col("p_type"), [("*STEEL*", 1), ("S*", 2), ("[LM]*", 3)], 0).alias("chosen"))


TICKS = "ticks AS (SELECT event_id, event_id + 1 AS tick, value, event_type FROM events)"


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") + 1).alias("tick"), "value", "event_type")


def tick_statistics() -> list[Column]:
    return stats.statistics(F.col("value"), F.col("tick"))


@query(f"""WITH {TICKS}, n AS (SELECT max(tick) AS now FROM ticks), b AS (SELECT i::INTEGER AS bucket, (now // (1::BIGINT << i)) * (1::BIGINT << i) AS e, 1::BIGINT << i AS w FROM n, range(40) t(i) WHERE 1::BIGINT << i <= now)
    SELECT bucket, e - w + 1 AS first_tick, e AS last_tick, min(value) AS min, max(value) AS max, round(sum(value), 4) AS sum, count(value) AS count, max_by(value, tick) AS latest FROM ticks JOIN b ON tick > e - w AND tick <= e GROUP BY 1, 2, 3""")
def q_exp_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bucket after the table's last tick."""
    rows = ticks(spark, sf_dir)
    return exponential.buckets(rows, rows.agg(F.max("tick")).first()[0] or 0, "tick", tick_statistics()).withColumn("sum", rounded("sum", 4))


# Bits of the count of ticks below the least power of two over what is asked for; if these are too few, that power as well.
@query(f"""WITH {TICKS}, n AS (SELECT max(tick) AS now, max(tick) // 3 AS asked FROM ticks), p AS (SELECT now, asked, 1::BIGINT << (floor(log2(asked))::INTEGER + 1) AS power FROM n),
    c AS (SELECT now, now % power + CASE WHEN now % power < asked AND power <= now THEN power ELSE 0 END AS covered FROM p)
    SELECT min(value) AS min, max(value) AS max, round(sum(value), 4) AS sum, count(value) AS count, max_by(value, tick) AS latest FROM ticks, c WHERE tick > now - covered AND tick <= now""")
def q_exp_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate over a third of all ticks at least, ending with the table's last."""
    rows = ticks(spark, sf_dir)
    now = rows.agg(F.max("tick")).first()[0] or 0
    return exponential.ending_now(rows, now, now // 3, "tick", tick_statistics()).withColumn("sum", rounded("sum", 4))


@query(f"WITH {TICKS} SELECT (tick - 1) >> 5 AS block, event_type, count(*) AS n, round(sum(value), 4) AS sum FROM ticks GROUP BY 1, 2")
def q_exp_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponential.blocks(ticks(spark, sf_dir), 5, "tick", ["event_type"], [F.count("*").alias("n"), rounded(F.sum("value"), 4).alias("sum")])


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 4")
def q_overflow_drop_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.kept(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 4, "DROP_NEW")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 4")
def q_overflow_keep_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.kept(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 4, "KEEP_NEWEST")


@query("SELECT user_id, count(*) AS put_count, greatest(0, count(*) - 4) AS drop_count FROM events GROUP BY user_id")
def q_overflow_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.counts(table(spark, sf_dir, "events"), "user_id", 4)


@query(f"""WITH RECURSIVE {MONTHS}, s AS (SELECT *, row_number() OVER (ORDER BY sort_key) AS n FROM months),
    g AS (SELECT 0::BIGINT AS n, 180::BIGINT AS to_wait UNION ALL SELECT s.n, greatest(g.to_wait + 180 - s.chunk_count, 90) FROM g JOIN s ON s.n = g.n + 1) SELECT n, to_wait FROM g WHERE n > 0""")
def q_epoch_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loop over epochs, one for each month: what an epoch used sets what the next one waits for."""
    used = [r["chunk_count"] for r in months(spark, sf_dir).orderBy("sort_key").collect()]  # a row a month
    return spark.createDataFrame(list(enumerate(schedule.gate(180, 180, used), 1)), "n bigint, to_wait bigint")


@query("SELECT p_partkey FROM part WHERE p_size = 7 AND p_brand = (SELECT min(p_brand) FROM part)")
def q_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame matches if its first planes equal constants; here the planes are a part's numbers."""
    parts = table(spark, sf_dir, "part")
    least = parts.agg(F.min("p_brand").alias("least"))
    rows = parts.crossJoin(F.broadcast(least)).select("p_partkey", F.array(F.col("p_size").cast("bigint"), (F.col("p_brand") == F.col("least")).cast("bigint"), F.col("p_partkey")).alias("planes"))  # least is one row
    return rows.where(tensors.starts_with(F.col("planes"), [7, 1])).select("p_partkey")


@query("SELECT source, doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE n_chars < 20)")
def q_blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return pool.without_dropped(docs, docs.where("n_chars < 20"), ["source"]).select("source", "doc_id")


# X, P: scalars and projections.
@query("SELECT o_orderkey, list_sum(list_transform(range(64), lambda s: ((o_orderkey * 2654435761) >> xor(s, 7)) & 1))::BIGINT AS ones, list_sum(list_transform(range(64), lambda s: s * (((o_orderkey * 2654435761) >> xor(s, 7)) & 1)))::BIGINT AS places FROM orders")
def q_plane_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "orders").select("o_orderkey", tensors.bits(F.col("o_orderkey") * F.lit(2654435761)).alias("b"))
    flat = b.select("o_orderkey", F.posexplode("b").alias("s", "x"))
    return flat.groupBy("o_orderkey").agg(F.sum(F.col("x").cast("bigint")).alias("ones"), F.sum(F.col("x").cast("bigint") * F.col("s")).alias("places"))


@query("""SELECT event_id, 512::INTEGER AS n, round(64 * (k % 2 + k // 2 % 2 + k // 4 % 2 + k // 8 % 2 + k // 16 % 2 + k / 99.0::DOUBLE + 1), 4) AS total
    FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""")
def q_meta_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    flags = [F.shiftright(k, i) % 2 for i in range(5)]
    planes = F.transform(tensors.meta_planes(*flags, k), lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "events").select("event_id", planes.alias("p"))
    return rows.select("event_id", F.size("p").alias("n"), F.round(tensors.total(F.col("p")), 4).alias("total"))


@query(f"""WITH {FRAMES} SELECT event_id, round(best_q, 4) + 0 AS q0, round(d, 4) AS d0, round(value, 2) AS m0, isnan(orig_q) AS unknown, true AS last_nan FROM frames""")
def q_values_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = {"result_q": "best_q", "result_d": "d", "plies_left": "value", "orig_q": "orig_q"}
    m = tensors.value_matrix(lambda n: F.col(has[n]) if n in has else F.lit(0.0))
    rows = frames(spark, sf_dir).select("event_id", m.alias("m"))
    cell = lambda i: F.get("m", F.lit(i)).cast("double")
    return rows.select("event_id", (F.round(cell(0), 4) + 0).alias("q0"), F.round(cell(1), 4).alias("d0"), F.round(cell(2), 2).alias("m0"), F.isnan(cell(9)).alias("unknown"), F.isnan(cell(17)).alias("last_nan"))


@query("SELECT event_id, " + ", ".join(f"(k >> {i} & 1)::INTEGER AS {n}" for i, n in enumerate(tensors.INVARIANCE_FLAGS)) + " FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)")
def q_invariance_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in tensors.invariance_bits(k).items()])


@query(f"WITH {FRAMES} SELECT event_id, round((1 + best_q - d) / 2, 6) + 0 AS w, round(d, 6) AS d, round((1 - best_q - d) / 2, 6) + 0 AS l FROM frames")
def q_wdl(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tensors.wdl(F.col("best_q"), F.col("d"))
    return frames(spark, sf_dir).select("event_id", p.alias("p")).select("event_id", *[(F.round(F.get("p", F.lit(i)), 6) + 0).alias(n) for i, n in enumerate("wdl")])


@query(r"""SELECT page_id, regexp_extract(url, '([^/]*)/?$', 1) AS name, regexp_extract(url, '^https?://([^/]+)', 1) AS host, TRY_CAST(nullif(regexp_extract(regexp_extract(url, '([^/]*)/?$', 1), '(\d+)(?:\.[^.\d]*)?$', 1), '') AS BIGINT) AS id FROM pages""")
def q_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.basename(F.col("url")).alias("name"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), text.file_id(F.col("url")).alias("id"))


@query("SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 8, '0') AS name, o_orderkey AS parsed FROM orders")
def q_number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers to hexadecimal text and back, and a padded name."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.format_string("%08d", "o_orderkey").alias("name"), text.number(F.concat(F.lit("0x"), F.hex("o_orderkey"))).alias("parsed"))


@query("SELECT url AS path, 'training.' || (row_number() OVER (ORDER BY TRY_CAST(nullif(regexp_extract(regexp_extract(url, '([^/]*)/?$', 1), '(\\d+)(?:\\.[^.\\d]*)?$', 1), '') AS BIGINT) NULLS FIRST, url) + 99) || '.gz' AS new_name FROM (SELECT DISTINCT url FROM pages)")
def q_training_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.training_names(table(spark, sf_dir, "pages").select(F.col("url").alias("path")).distinct(), 100)


@query("SELECT DISTINCT l_orderkey AS path FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def q_new_file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are seen several times, less those that the initial scan listed."""
    initial = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("path"))
    return files.new_events(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path")), initial)


@query("SELECT doc_id, n_chars > 0 AND n_chars % 4 = 0 AS whole FROM documents")
def q_whole_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", files.whole_records(F.col("n_chars"), 4).alias("whole"))


# L, M: losses and weights over embeddings: the first half are logits, the second targets.
HEADS = """heads AS (SELECT vec_id, label, list_transform(list_slice(embedding, 1, 32), lambda x: (x * 10)::DOUBLE) AS logits,
    list_transform(list_slice(embedding, 33, 64), lambda x: CASE WHEN x::DOUBLE < -0.15 THEN -1.0::DOUBLE ELSE abs(x::DOUBLE) END) AS raw FROM embeddings),
    targets AS (SELECT *, list_transform(raw, lambda x: CASE WHEN x < 0 THEN -1.0::DOUBLE ELSE x / list_sum(list_transform(raw, lambda y: greatest(y, 0.0::DOUBLE))) END) AS t FROM heads)"""


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda x: x.cast("double")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 32), lambda x: d(x * F.lit(10).cast("float"))).alias("logits"), F.transform(F.slice("embedding", 33, 32), lambda x: F.when(d(x) < -0.15, -1.0).otherwise(F.abs(d(x)))).alias("raw"))
    target = lambda whole: lambda x: F.when(x < 0, -1.0).otherwise(x / whole)
    return rows.withColumn("t", tensors.let(tensors.total(losses.legal(F.col("raw"))), lambda whole: F.transform("raw", target(whole))))


LSE = "ln(list_sum(list_transform(list_filter(list_zip(logits, t), lambda p: p[2] >= 0), lambda p: exp(p[1]))))"
CE = f"list_sum(list_transform(list_filter(list_zip(logits, t), lambda p: p[2] > 0), lambda p: p[2] * ({LSE} - p[1])))"
#: WDL logits are the first three.
Q_HAT = "((exp(logits[1]) - exp(logits[3])) / (exp(logits[1]) + exp(logits[2]) + exp(logits[3])))"


@query(f"WITH {HEADS} SELECT vec_id, round({CE}, 5) AS loss FROM targets")
def q_policy_ce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads(spark, sf_dir).select("vec_id", F.round(losses.policy_cross_entropy(F.col("logits"), F.col("t")), 5).alias("loss"))


@query(f"WITH {HEADS} SELECT vec_id, round({CE} + list_sum(list_transform(list_filter(t, lambda x: x > 0), lambda x: x * ln(x))), 5) AS loss FROM targets")
def q_policy_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads(spark, sf_dir).select("vec_id", F.round(losses.policy_kl(F.col("logits"), F.col("t")), 5).alias("loss"))


@query(f"WITH {HEADS}, r AS (SELECT vec_id, list_transform(t, lambda x: pow(greatest(x, 0.0::DOUBLE), 0.5)) AS r FROM targets) SELECT vec_id, round(list_max(r) / list_sum(r), 6) AS greatest, round(list_min(r) / list_sum(r), 6) AS least FROM r")
def q_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = heads(spark, sf_dir).select("vec_id", losses.tempered(losses.legal(F.col("t")), 2.0).alias("r"))
    return rows.select("vec_id", F.round(F.array_max("r"), 6).alias("greatest"), F.round(F.array_min("r"), 6).alias("least"))


def wdl_logits() -> Column:
    return F.slice("logits", 1, 3)


@query(f"WITH {HEADS} SELECT vec_id, round(1 / (1 + exp(-(((logits[4] / 10 - {Q_HAT}) / (sqrt(abs(logits[5])) + 0.01)) - 2.0) * 0.5)), 6) AS weight FROM heads")
def q_optimistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = losses.optimistic_weight(F.get("logits", F.lit(3)) / 10, wdl_logits(), F.abs(F.get("logits", F.lit(4))), 2.0, 0.01, 0.5)
    return heads(spark, sf_dir).select("vec_id", F.round(w, 6).alias("weight"))


@query(f"""WITH {HEADS}, v AS (SELECT *, logits[4] / 20 AS q, 0.3::DOUBLE AS d, ln(exp(logits[1]) + exp(logits[2]) + exp(logits[3])) AS z FROM heads)
    SELECT vec_id, round((1 + q - d) / 2 * (z - logits[1]) + d * (z - logits[2]) + (1 - q - d) / 2 * (z - logits[3]), 5) AS loss FROM v""")
def q_value_ce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads(spark, sf_dir).select("vec_id", F.round(losses.value_cross_entropy(wdl_logits(), F.get("logits", F.lit(3)) / 20, F.lit(0.3)), 5).alias("loss"))


@query("SELECT event_id, round(CASE WHEN abs(value - 40) / 20 <= 0.5 THEN 0.5 * pow((value - 40) / 20, 2) ELSE 0.5 * (abs(value - 40) / 20 - 0.25) END, 6) AS loss FROM events")
def q_huber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(losses.moves_left(F.lit(40.0), F.col("value")), 6).alias("loss"))


@query(f"WITH {HEADS} SELECT vec_id, round(pow(abs(logits[5]) - pow({Q_HAT} - logits[4] / 10, 2), 2), 5) AS loss FROM heads")
def q_value_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads(spark, sf_dir).select("vec_id", F.round(losses.value_error(F.abs(F.get("logits", F.lit(4))), wdl_logits(), F.get("logits", F.lit(3)) / 10), 5).alias("loss"))


@query(f"WITH {HEADS}, b AS (SELECT *, greatest(0, least(31, floor((logits[4] / 10 + 1) / 2 * 32)))::INTEGER AS bucket FROM heads) SELECT vec_id, bucket, round(ln(list_sum(list_transform(logits, lambda x: exp(x)))) - logits[bucket + 1], 5) AS loss FROM b")
def q_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.get("logits", F.lit(3)) / 10
    return heads(spark, sf_dir).select("vec_id", losses.q_bucket(q, 32).alias("bucket"), F.round(losses.categorical(F.col("logits"), q, 32), 5).alias("loss"))


@query(f"""WITH {HEADS}, m AS (SELECT *, list_transform(list_zip(logits, t), lambda p: CASE WHEN p[2] >= 0 THEN p[1] ELSE -1e9 END) AS ml FROM targets)
    SELECT vec_id, (list_position(ml, list_max(ml)) = list_position(t, list_max(t)))::INTEGER::DOUBLE AS accuracy, round(-list_sum(list_transform(list_filter(t, lambda x: x > 0), lambda x: x * ln(x))), 5) AS entropy, round(ln(len(list_filter(t, lambda x: x >= 0))), 5) AS uniform FROM m""")
def q_policy_accuracy_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heads(spark, sf_dir).select("vec_id", losses.policy_accuracy(F.col("logits"), F.col("t")).alias("accuracy"), F.round(losses.policy_entropy(F.col("t")), 5).alias("entropy"), F.round(losses.policy_uniform_loss(F.col("t")), 5).alias("uniform"))


@query(f"WITH {HEADS} SELECT label, round(avg({CE} * 1.5 + 0.25 * pow(logits[4] / 10, 2)), 5) AS loss FROM targets GROUP BY label")
def q_total_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = {"policy": losses.policy_cross_entropy(F.col("logits"), F.col("t")), "value": losses.value_mse(F.lit(0.0), F.get("logits", F.lit(3)) / 10) * 4}
    return heads(spark, sf_dir).groupBy("label").agg(F.round(F.avg(losses.weighted(both, {"policy": 1.5, "value": 0.25})), 5).alias("loss"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x, list_min(embedding)::DOUBLE AS low, list_max(embedding)::DOUBLE AS high FROM embeddings),
    c AS (SELECT vec_id, low, high, list_transform(x, lambda v: round_even(65535.0::DOUBLE * ((v - low) / (high - low)), 0)::INTEGER) AS codes FROM e)
    SELECT vec_id, round(low, 6) AS low, round(high, 6) AS high, list_sum(codes)::BIGINT AS codes, round(list_sum(list_transform(codes, lambda k: k / 65535.0::DOUBLE * high + (1 - k / 65535.0::DOUBLE) * low)), 5) AS decoded FROM c""")
def q_linear16(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = table(spark, sf_dir, "embeddings").select("vec_id", codecs.linear16_encode(F.col("embedding")).alias("c"))
    codes = F.aggregate("c.codes", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return coded.select("vec_id", F.round("c.low", 6).alias("low"), F.round("c.high", 6).alias("high"), codes.alias("codes"), F.round(tensors.total(codecs.linear16_decode(F.col("c"))), 5).alias("decoded"))


@query(f"WITH {COORDINATES} SELECT a.vec_id AS path, round(sum(0.75 * a.x + 0.25 * b.x), 5) AS total, count(*) AS n FROM cells a JOIN cells b ON a.i = b.i AND b.vec_id = a.vec_id + 1 GROUP BY 1")
def q_weights_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("path"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))
    out = codecs.combined(net, net.withColumn("path", F.col("path") - 1), 0.75, 0.25)
    return out.select("path", F.round(tensors.total(F.col("values")), 5).alias("total"), F.size("values").cast("bigint").alias("n"))


@query("SELECT o_orderkey, sum(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL AS first, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_number FROM orders")
def q_prefix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.lit(1).alias("one"))
    out = prefixed(rows, [F.col("o_orderdate"), F.col("o_orderkey")], {"before": F.col("one")})
    return out.select("o_orderkey", (F.col("before") == 0).alias("first"), "row_number")


@query(f"""WITH {COORDINATES}, n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM cells GROUP BY label) SELECT label, round(norm, 6) AS norm, round(CASE WHEN norm > 5 THEN 5 / norm ELSE 1 END, 6) AS scale FROM n""")
def q_gradient_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    norms = cells(spark, sf_dir).groupBy("label").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return norms.select("label", rounded("norm").alias("norm"), rounded(stats.clip_scale(F.col("norm"), 5.0)).alias("scale"))


@query("SELECT CASE WHEN doc_id % 100 >= 90 THEN 'test' ELSE 'train' END AS part, count(*) AS n, max(doc_id) AS latest FROM documents GROUP BY 1")
def q_split_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", split.mod_split(F.col("doc_id")).alias("part"))
    return docs.groupBy("part").agg(F.count("*").alias("n"), F.max("doc_id").alias("latest"))


@query("SELECT source, sum(n_chars // 276)::BIGINT AS plies, count(*) FILTER (WHERE n_chars % 276 <> 0) AS broken FROM documents GROUP BY source")
def q_pack_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plies by the sizes of games, and games whose size is no multiple of a record's."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.sum(F.expr("n_chars div 276")).alias("plies"), F.count_if(~files.whole_records(F.col("n_chars"), 276) & (F.col("n_chars") > 0)).alias("broken"))


@query(f"SELECT epoch, doc_id, row_number() OVER (ORDER BY epoch, {sql_uniform(repr(SEED), 'epoch', 'doc_id')}, doc_id) AS position FROM documents, range(3) t(epoch)")
def q_epoch_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three epochs one after another, each in an order of its own."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return pool.epochs(docs, 3, SEED, "doc_id").select(F.col("epoch").cast("bigint").alias("epoch"), "doc_id", "position")


@query("SELECT doc_id, [quality, toxic, CASE WHEN quality = 0 AND toxic = 0 THEN 1 ELSE 0 END][CASE WHEN quality = 1 THEN 1 WHEN toxic = 1 THEN 2 ELSE 3 END] AS one, CASE WHEN quality = 1 THEN 1 WHEN toxic = 1 THEN 2 ELSE 3 END AS place FROM labels")
def q_legacy_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of 1, 0 and -1 as one of three places."""
    result = F.when(F.col("quality") == 1, 1).when(F.col("toxic") == 1, 0).otherwise(-1)
    rows = table(spark, sf_dir, "labels").select("doc_id", tensors.wdl_of_result(result).alias("w"))
    return rows.select("doc_id", F.array_max("w").cast("int").alias("one"), F.array_position("w", F.array_max("w")).cast("int").alias("place"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS p0, round(embedding[21]::DOUBLE, 6) AS p20, round(embedding[64]::DOUBLE, 6) AS p63 FROM embeddings WHERE label = 3")
def q_start_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen elements of the vectors that a predicate keeps; indices count from 0."""
    rows = table(spark, sf_dir, "embeddings").where("label = 3").select("vec_id", tensors.probes(F.col("embedding"), [0, 20, 63]).alias("p"))
    return rows.select("vec_id", *[F.round(F.get("p", F.lit(i)).cast("double"), 6).alias(n) for i, n in enumerate(("p0", "p20", "p63"))])


@query(f"""WITH RECURSIVE {FRAMES}, s AS (SELECT chunk, frame_idx, event_id, value AS a FROM frames WHERE frame_idx = 0
    UNION ALL SELECT f.chunk, f.frame_idx, f.event_id, 0.99 * f.value + 0.01 * s.a FROM s JOIN frames f ON f.chunk = s.chunk AND f.frame_idx = s.frame_idx + 1)
    SELECT event_id, round(a, 6) AS smoothed FROM s""")
def q_smoothed_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running average that weighs each new value by 0.99."""
    rows = frames(spark, sf_dir).select("event_id", "chunk", "frame_idx", "value")
    return rescoring.smoothed(rows, "chunk", "frame_idx", "value").select("event_id", rounded("smoothed").alias("smoothed"))


@query(f"WITH {FRAMES} SELECT chunk, round(avg(abs(best_q - coalesce(nullif(orig_q, 'NaN'::DOUBLE), 0))), 6) AS error, round(avg(0.75 * best_q + 0.25 * d), 6) + 0 AS mixed FROM frames GROUP BY chunk")
def q_error_and_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute error, and a mix of two targets."""
    error = F.abs(F.col("best_q") - F.when(F.isnan("orig_q"), 0.0).otherwise(F.col("orig_q")))
    return frames(spark, sf_dir).groupBy("chunk").agg(rounded(F.avg(error)).alias("error"), (rounded(F.avg(losses.q_mix(F.col("best_q"), F.col("d"), 0.25))) + 0).alias("mixed"))


# The flagship pipeline, end to end: window, weights, acceptance, unpacking and batches.
@query(f"""WITH {WEIGHTS}, c AS (SELECT chunk, sum(weight) AS weight FROM weighted GROUP BY chunk), m AS (SELECT max(weight) AS most FROM c),
    kept AS (SELECT chunk FROM c, m WHERE {sql_uniform(repr(SEED), 'chunk')} < pow(weight / most, 1.0)),
    p AS (SELECT event_id, chunk, frame_idx FROM weighted JOIN kept USING (chunk) WHERE floor({sql_uniform(repr(SEED), 'chunk', '0', 'frame_idx')} / 0.25) = 0),
    o AS (SELECT event_id, row_number() OVER (ORDER BY {sql_uniform(repr(SEED), "'out'", 'event_id')}, event_id) - 1 AS n, count(*) OVER () // 64 AS whole FROM p)
    SELECT event_id, n // 64 AS batch_id, n % 64 AS place FROM o WHERE n // 64 < whole""")
def q_training_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).select("event_id", "chunk", "frame_idx", weight().alias("weight"))
    kept = pool.accepted(rows.groupBy("chunk").agg(F.sum("weight").alias("weight")), 1.0, SEED).where("accepted").select("chunk")
    chosen = rows.join(kept, "chunk").where(sampling.sampled_at(lambda line: rng.uniform(SEED, F.col("chunk"), line, F.col("frame_idx")), 0.25, F.lit(0))).select("event_id")
    return joins.batches(numbered(chosen, [rng.uniform(SEED, "out", F.col("event_id")), F.col("event_id")]), 64).select("event_id", "batch_id", "place")
