"""Queries over archives, files, streams and specs: what a query reads was written first, into the shared folder.

Nations are chunk sources, their customers' market segments chunks and customers frames, so that every record that
comes back has its row in the tables.
"""

from __future__ import annotations

import datetime
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import codecs, moves, rng, tensors, text
from tidewater.functions.rng import sql_uniform
from tidewater.operators import exponential, joins, rescoring, schedule, stats
from tidewater.operators.ordering import arrivals, numbered
from tidewater.plans import control, spec
from tidewater.plans.catalogue import COORDINATES, MONTHS, SEED, cells, months, query, rounded, table
from tidewater.sources import chunks, files, nets, sinks, synthetic
from tidewater.storage import new_path
from tidewater.streaming import anchors, windows

KEYS = ["sort_key", "chunk_index", "frame_idx"]
ARCHIVE = """archive AS (SELECT 'nation-' || lpad(c_nationkey::VARCHAR, 2, '0') AS sort_key, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) - 1 AS chunk_index,
    (row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) - 1)::INTEGER AS frame_idx, c_custkey AS id, (c_custkey % 64) / 64.0::DOUBLE AS q FROM customer)"""


def archive(spark: SparkSession, sf_dir: str, version: int = 6) -> DataFrame:
    """Customers as frames: their fields are functions of the key, exact in floats."""
    by = Window.partitionBy("c_nationkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    keyed = c.select(F.format_string("nation-%02d", "c_nationkey").alias("sort_key"), (F.dense_rank().over(by.orderBy("c_mktsegment")) - 1).cast("bigint").alias("chunk_index"), (F.row_number().over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")) - 1).alias("frame_idx"), F.col("c_custkey").alias("id"))
    q = ((F.col("id") % 64) / F.lit(64.0)).cast("float")
    fields = {"version": F.lit(version).cast("bigint"), "input_format": F.lit(3).cast("bigint"), "planes": F.transform(F.sequence(F.lit(0), F.lit(103)), lambda i: F.col("id") * 1000 + i), "rule50_count": (F.col("id") % 100).cast("short"), "played_idx": (F.col("id") % 1858).cast("int"), "visits": F.col("id"), "best_q": q, "orig_q": q, "root_q": q, "root_d": F.lit(0.25).cast("float"), "policy_kld": F.lit(0.5).cast("float")}
    return keyed.select(*KEYS, *[v.alias(k) for k, v in fields.items()])


def local(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder as Python sees it."""
    return new_path(spark, name).removeprefix("file://").removeprefix("file:")


def tars(spark: SparkSession, sf_dir: str) -> str:
    path = local(spark, "tars")
    chunks.tar_archives(archive(spark, sf_dir), path).count()
    return path


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    chunks.register(spark)
    return spark.read.format("chunks").options(**options).load(path)


def write_chunks(frames: DataFrame, path: str, **options: str) -> None:
    """Frames through the chunks writer; whole chunks lie in one task, in order."""
    chunks.register(frames.sparkSession)
    frames.repartition("sort_key", "chunk_index").sortWithinPartitions(*KEYS).write.format("chunks").options(**options).mode("append").save(path)


FRAME_COLUMNS = "sort_key, chunk_index, frame_idx, id, (id % 100)::SMALLINT AS rule50, (id % 1858)::INTEGER AS played, q AS best_q, id * 1000 AS first_plane, id * 1000 + 103 AS last_plane"


def frame_columns(frames: DataFrame) -> DataFrame:
    return frames.select(*KEYS, F.col("visits").alias("id"), F.col("rule50_count").alias("rule50"), F.col("played_idx").alias("played"), F.col("best_q").cast("double").alias("best_q"), F.get("planes", F.lit(0)).alias("first_plane"), F.get("planes", F.lit(103)).alias("last_plane"))


# S: sources.
@query(f"WITH {ARCHIVE} SELECT {FRAME_COLUMNS} FROM archive")
def q_tar_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tars of gzipped chunks, indexed and decoded."""
    return frame_columns(read(spark, tars(spark, sf_dir), version="6"))


@query(f"WITH {ARCHIVE} SELECT {FRAME_COLUMNS} FROM archive WHERE frame_idx = 0")
def q_tar_first_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first frame of each chunk, of which no more is unpacked."""
    return frame_columns(read(spark, tars(spark, sf_dir), firstFrameOnly="true"))


@query(f"WITH {ARCHIVE} SELECT sort_key || '_' || chunk_index AS sort_key, 0::BIGINT AS chunk_index, frame_idx, id FROM archive")
def q_raw_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a chunk, written by the chunks writer and read back."""
    path = local(spark, "raw")
    write_chunks(archive(spark, sf_dir), path)
    return read(spark, path).select(*KEYS, F.col("visits").alias("id"))


@query(f"WITH {ARCHIVE} SELECT DISTINCT sort_key || '_' || chunk_index || '_found.gz' AS name, 'file' AS message_type FROM archive")
def q_listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk of a tree: every regular file, no hidden one, no content."""
    path = local(spark, "listed")
    write_chunks(archive(spark, sf_dir), f"{path}/deep/er", suffix="_found")
    write_chunks(archive(spark, sf_dir).where("chunk_index = 0"), f"{path}/.hidden")
    return synthetic.file_events(spark, path).select(text.basename(F.col("path")).alias("name"), "message_type")


@query(f"""WITH {ARCHIVE}, v AS (SELECT unnest([3, 4, 5, 6]) AS version) SELECT version, sort_key, frame_idx, CASE WHEN version < 5 THEN 1 ELSE 3 END::BIGINT AS input_format, (id % 100)::SMALLINT AS rule50,
    CASE WHEN version > 3 THEN q ELSE 0 END AS best_q, CASE WHEN version > 5 THEN id ELSE 0 END AS visits, id * 1000 + 103 AS last_plane FROM archive, v WHERE chunk_index = 1""")
def q_older_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of versions 3 to 6, told apart by their first bytes and widened."""
    out = []
    for version in (3, 4, 5, 6):
        path = local(spark, f"version-{version}")
        write_chunks(archive(spark, sf_dir, version).where("chunk_index = 1"), path, version=str(version))
        out.append(read(spark, path).select(F.col("version").cast("int").alias("version"), F.regexp_replace("sort_key", "_1$", "").alias("sort_key"), "frame_idx", "input_format", F.col("rule50_count").alias("rule50"), F.col("best_q").cast("double").alias("best_q"), "visits", F.get("planes", F.lit(103)).alias("last_plane")))
    return joins.join_positions(out)


@query("""WITH g AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS n, count(*) OVER () AS total FROM supplier),
    p AS (SELECT s_suppkey, least(n // 7, greatest(total // 7 - 1, 0)) AS pack, n FROM g)
    SELECT 'games_' || lpad(pack::VARCHAR, 5, '0') AS sort_key, (n - pack * 7)::BIGINT AS chunk_index, s_suppkey % 5 + 1 AS plies, (s_suppkey % 100)::SMALLINT AS rule50 FROM p""")
def q_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games packed seven at a time, the rest with the last, and unpacked."""
    path = local(spark, "packs")
    games = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 5 + 1).cast("int").alias("plies"), (F.col("s_suppkey") % 100).cast("short").alias("rule50_count"))
    chunks.packed(numbered(games, [F.col("s_suppkey")]), path, "games", 7).count()
    return read(spark, path).groupBy("sort_key", "chunk_index").agg(F.count("*").alias("plies"), F.max("rule50_count").alias("rule50"))


@query("""WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS n, count(*) OVER () // 4 AS whole FROM supplier)
    SELECT n // 4 AS batch, count(*) AS n, sum(s_suppkey)::DOUBLE AS inputs, 2.0::DOUBLE * sum(s_suppkey) AS values FROM r WHERE n // 4 < whole GROUP BY 1""")
def q_npz_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches pulled one by one, each kept as an NPZ file, and read."""
    path = local(spark, "npz")
    rows = table(spark, sf_dir, "supplier").select(F.array(F.col("s_suppkey").cast("float")).alias("inputs"), F.array(F.lit(0.5)).alias("probabilities"), F.array(F.col("s_suppkey") * 2.0).alias("values"), "s_suppkey").orderBy("s_suppkey")
    for i, batch in enumerate(sinks.Pull(rows, 4)):
        synthetic.write_npz(batch, f"{path}/batch-{i:06d}.npz")
    got = synthetic.npz_batches(spark, f"file://{path}")
    total = lambda c: F.sum(F.get(c, F.lit(0)).cast("double"))
    return got.groupBy(F.regexp_extract("path", r"batch-(\d+)", 1).cast("bigint").alias("batch")).agg(F.count("*").alias("n"), total("inputs").alias("inputs"), total("values").alias("values"))


@query("SELECT step, 'layers.' || n_nationkey AS path, n_nationkey * step::DOUBLE AS first FROM nation, (SELECT unnest([20, 30]) AS step)")
def q_checkpoint_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a checkpoint, those within bounds read again; a step written twice holds what came last."""
    path = new_path(spark, "checkpoint")
    leaves = lambda k: table(spark, sf_dir, "nation").select(F.concat(F.lit("layers."), "n_nationkey").alias("path"), F.array(F.lit(1)).alias("shape"), F.array(F.col("n_nationkey") * F.lit(float(k))).alias("values"))
    for step, k in ((10, 10), (20, 1), (30, 30), (40, 40), (20, 20)):
        files.write_checkpoint(leaves(k), step, path)
    return joins.join_positions([files.read_checkpoint(spark, path, s).select(F.lit(s).alias("step"), "path", F.get("values", F.lit(0)).alias("first")) for s in files.checkpoint_steps(spark, path, 15, 30)])


@query(f"""WITH i AS (SELECT range AS id FROM range(400)), u AS (SELECT id, greatest({sql_uniform("'synthetic'", "'r'", 'id')}, 1e-12::DOUBLE) AS r, greatest({sql_uniform("'synthetic'", "'a'", 'id')}, 1e-12::DOUBLE) AS a FROM i)
    SELECT lpad(id::VARCHAR, 8, '0') AS sort_key, greatest(1, round(20 + sqrt(-2 * ln(r)) * cos(2 * pi() * a) * 5.0::DOUBLE)::BIGINT) AS chunk_count FROM u""")
def q_synthetic_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic sources whose counts are about normal; they read no table."""
    return synthetic.sources(spark, 400, 20).select("sort_key", "chunk_count")


# K: sinks.
@query("""SELECT source AS file, (count(*) FILTER (WHERE quality = 1))::VARCHAR AS w, (count(*) FILTER (WHERE toxic = 1))::VARCHAR AS d, (count(*) FILTER (WHERE quality = 0 AND toxic = 0))::VARCHAR AS l FROM documents JOIN labels USING (doc_id) GROUP BY source
    UNION ALL SELECT 'file', 'w', 'd', 'l'""")
def q_csv_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report with a header and the same without, read as plain text fields."""
    both = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file")).join(table(spark, sf_dir, "labels"), "doc_id")
    report = both.groupBy("file").agg(F.count_if(F.col("quality") == 1).alias("w"), F.count_if(F.col("toxic") == 1).alias("d"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 0)).alias("l")).coalesce(1)
    bare, headed = new_path(spark, "csv"), new_path(spark, "csv")
    sinks.write_csv(report, bare, header=False)
    sinks.write_csv(report.limit(0).union(report), headed, header=True)
    schema = "file string, w string, d string, l string"
    first = spark.read.schema(schema).csv(headed).where("file = 'file'")
    return spark.read.schema(schema).csv(bare).union(first)


@query("SELECT 'n_nationkey: ' || n_nationkey || chr(10) || 'n_name: ' || n_name || chr(10) || 'n_regionkey: ' || n_regionkey || chr(10) || 'none: null' AS value FROM nation")
def q_text_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as lines of text, one field a line, written and read whole."""
    path = new_path(spark, "dump")
    sinks.dump(table(spark, sf_dir, "nation").withColumn("none", F.lit(None).cast("string"))).write.option("lineSep", "\x1e").text(path)
    return spark.read.option("lineSep", "\x1e").text(path)


@query("""SELECT o_orderpriority AS run, year(o_orderdate)::BIGINT AS step, tag, round(CASE tag WHEN 'price/greatest' THEN max(o_totalprice) WHEN 'price/sum' THEN sum(o_totalprice) ELSE count(*) END, 2) AS value
    FROM orders, (SELECT unnest(['price/greatest', 'price/sum', 'n']) AS tag) GROUP BY 1, 2, 3""")
def q_scalar_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested metrics by path, added to a series run by run."""
    path = new_path(spark, "scalars")
    price = F.struct(F.max("o_totalprice").alias("greatest"), F.sum("o_totalprice").alias("sum"), F.first("o_orderpriority").alias("name"))
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("run"), F.year("o_orderdate").cast("bigint").alias("step")).agg(F.struct(price.alias("price"), F.count("*").alias("n")).alias("m"))
    for early in (True, False):
        sinks.scalars(text.flattened(found.where((F.col("step") < 1998) == early), "m", ["run", "step"]), path)
    return spark.read.parquet(path).select("run", "step", "tag", rounded("value", 2).alias("value"))


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","inner":{"n_regionkey":' || n_regionkey || '}}' AS value FROM nation""")
def q_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as lines of JSON, and back to JSON from what was read."""
    path = new_path(spark, "json")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.struct("n_regionkey").alias("inner"))
    text.to_json(rows).write.text(path)
    again = spark.read.text(path).select(F.from_json("value", rows.schema).alias("r")).select("r.*")
    return text.to_json(again)


@query("""SELECT '{"payload":{"done":' || count(*) || ',"name":"' || c_mktsegment || '"},"type":"progress"}' AS value FROM customer GROUP BY c_mktsegment""")
def q_status_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status lines of a stream, one for each of a handful of rows, checked by their reader."""
    counts = table(spark, sf_dir, "customer").groupBy("c_mktsegment").count().collect()  # a row a segment
    lines = [sinks.status_line("progress", {"name": r["c_mktsegment"], "done": r["count"]}) for r in counts]
    for line in lines:
        sinks.read_status(line, {"progress"})
    return spark.createDataFrame([(x,) for x in lines], "value string")


GRAPH = {"stages": [{"name": "source", "type": "synthetic_source"}, {"name": "split", "type": "chunk_source_splitter", "inputs": ["source"], "output": ["a", "b"], "weight": [1, 1]}, {"name": "pool", "type": "shuffling_chunk_pool", "inputs": ["split.a"]}]}


@query(r"""WITH s(name, type, source, label) AS (VALUES ('source', 'synthetic_source', NULL, NULL), ('split', 'chunk_source_splitter', 'source', NULL), ('pool', 'shuffling_chunk_pool', 'split', 'a'))
    SELECT 'digraph pipeline {' AS line UNION ALL SELECT '  "' || name || '" [label="' || name || '\n' || type || '"];' FROM s
    UNION ALL SELECT '  "' || source || '" -> "' || name || '"' || coalesce(' [label="' || label || '"]', '') || ';' FROM s WHERE source IS NOT NULL UNION ALL SELECT '}'""")
def q_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline's graph, line by line."""
    return spark.createDataFrame([(x,) for x in sinks.dot(GRAPH).split("\n")], "line string")


@query(f"WITH {ARCHIVE} SELECT sort_key, chunk_index, count(*) AS n, true AS together, true AS ordered FROM archive GROUP BY 1, 2")
def q_shuffled_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks dealt at random: their frames stay together and in order."""
    rows = arrivals(files.shuffled_chunks(archive(spark, sf_dir).select(*KEYS), SEED, 5, ["sort_key", "chunk_index"]), "at")
    found = rows.groupBy("sort_key", "chunk_index").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high"), F.max(F.col("at") - F.col("frame_idx")).alias("a"), F.min(F.col("at") - F.col("frame_idx")).alias("b"))
    return found.select("sort_key", "chunk_index", "n", (F.col("high") - F.col("low") + 1 == F.col("n")).alias("together"), (F.col("a") == F.col("b")).alias("ordered"))


# Specs.
BAD_SPECS = {
    "no such type": [{"name": "a", "type": "nothing"}],
    "no such option": [{"name": "a", "type": "synthetic_source", "colour": 1}],
    "a name twice": [{"name": "a", "type": "synthetic_source"}, {"name": "a", "type": "synthetic_source"}],
    "no such input": [{"name": "a", "type": "join_positions", "inputs": ["b"]}],
    "a circle": [{"name": "a", "type": "join_positions", "inputs": ["b"]}, {"name": "b", "type": "join_positions", "inputs": ["a"]}],
    "rate and count": [{"name": "s", "type": "synthetic_source"}, {"name": "a", "type": "chunk_unpacker", "inputs": ["s"], "position_sampling_rate": 0.5, "position_count": 1}],
    "neither": [{"name": "s", "type": "synthetic_source"}, {"name": "a", "type": "chunk_unpacker", "inputs": ["s"]}],
    "half a prefetch": [{"name": "s", "type": "synthetic_source"}, {"name": "a", "type": "chunk_unpacker", "inputs": ["s"], "position_count": 1, "prefetch_count": 2}],
    "more outputs than weights": [{"name": "s", "type": "synthetic_source"}, {"name": "a", "type": "chunk_source_splitter", "inputs": ["s"], "output": ["x", "y"], "weight": [1]}],
    "no weight": [{"name": "s", "type": "synthetic_source"}, {"name": "a", "type": "chunk_source_splitter", "inputs": ["s"], "output": ["x"], "weight": [0]}],
    "half a deblunder": [{"name": "s", "type": "synthetic_source"}, {"name": "a", "type": "chunk_rescorer", "inputs": ["s"], "deblunder_threshold": 0.1}],
    "no queue": [{"name": "a", "type": "synthetic_source", "queue_capacity": 0}],
    "sound": [{"name": "s", "type": "synthetic_source"}, {"name": "a", "type": "chunk_unpacker", "inputs": ["s"], "position_count": 1}],
}


@query("SELECT unnest(['no such type', 'no such option', 'a name twice', 'no such input', 'a circle', 'rate and count', 'neither', 'half a prefetch', 'more outputs than weights', 'no weight', 'half a deblunder', 'no queue', 'sound']) AS fault, unnest([true, true, true, true, true, true, true, true, true, true, true, true, false]) AS refused")
def q_bad_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs that are refused before anything is built."""

    def refused(stages: list[dict]) -> bool:
        try:
            spec.checked({"stages": stages})
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(k, refused(v)) for k, v in BAD_SPECS.items()], "fault string, refused boolean")


LOADED = [{"name": "files", "type": "file_path_provider"}, {"name": "load", "type": "chunk_source_loader", "inputs": ["files"]}]


def built(spark: SparkSession, sf_dir: str, stages: list[dict], outputs: list[str]) -> dict[str, DataFrame]:
    first = {**LOADED[0], "directory": f"file://{tars(spark, sf_dir)}"}
    return spec.build(spark, {"stages": [*reversed(stages), first, LOADED[1]], "outputs": outputs})


#: Chunks by global index, oldest source first.
GLOBAL = ARCHIVE + ", c AS (SELECT sort_key, chunk_index, row_number() OVER (ORDER BY sort_key, chunk_index) - 1 AS global_index FROM (SELECT DISTINCT sort_key, chunk_index FROM archive)), f AS (SELECT * FROM archive JOIN c USING (sort_key, chunk_index))"


@query(f"""WITH {GLOBAL}, u AS (SELECT global_index, frame_idx, line, floor((line + {sql_uniform("'unpack'", 'global_index', 'line', 'frame_idx')}) / 0.5)::BIGINT AS use_count FROM f, range(2) r(line))
    SELECT global_index, use_count, frame_idx FROM u WHERE use_count < 3""")
def q_spec_unpacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files listed, loaded, pooled for three epochs and unpacked at a rate of a half."""
    stages = [{"name": "pool", "type": "shuffling_chunk_pool", "inputs": ["load"], "chunk_pool_size": 1_000_000, "epochs": 3}, {"name": "unpack", "type": "chunk_unpacker", "inputs": ["pool"], "position_sampling_rate": 0.5}]
    return built(spark, sf_dir, stages, ["out:unpack"])["out"].select("global_index", "use_count", "frame_idx")


@query(f"WITH {ARCHIVE}, n AS (SELECT 2 * count(*) AS n FROM archive) SELECT batch_id, 64::BIGINT AS n, 63::BIGINT AS last, 7168 AS inputs, 18 AS values FROM n, range(n // 64) t(batch_id)")
def q_spec_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that come twice over, each in one batch of its own place; batches are whole."""
    stages = [{"name": "twice", "type": "join_positions", "inputs": ["load", "load"]}, {"name": "shuffle", "type": "shuffling_frame_sampler", "inputs": ["twice"], "reservoir_size_per_thread": 1}, {"name": "batches", "type": "tensor_generator", "inputs": ["shuffle"], "batch_size": 64}]
    got = built(spark, sf_dir, stages, ["out:batches"])["out"]
    return got.groupBy("batch_id").agg(F.count("*").alias("n"), F.max("place").alias("last"), F.max(F.size("inputs")).alias("inputs"), F.max(F.size("values")).alias("values"))


@query(f"""WITH {GLOBAL}, o AS (SELECT global_index, use_count::BIGINT AS use_count, row_number() OVER (ORDER BY use_count, {sql_uniform("'pool'", 'use_count', 'global_index')}, global_index) AS position FROM c, range(5) t(use_count))
    SELECT global_index, use_count, CASE WHEN use_count % 3 = 0 THEN 'miss' ELSE 'hit' END AS status, CASE WHEN use_count % 3 = 0 THEN 2 ELSE 0 END::BIGINT AS newly_cached, CASE WHEN use_count % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS dropped, position FROM o""")
def q_position_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool whose cache holds two positions of every chunk: a miss fills what the next two uses take."""
    n = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct().count()
    stages = [
        {"name": "pool", "type": "shuffling_chunk_pool", "inputs": ["load", "unpack.ahead"], "chunk_pool_size": n, "epochs": 5, "cachehit_output": "hits", "position_cache_size": 2 * n},
        {"name": "unpack", "type": "chunk_unpacker", "inputs": ["pool"], "position_count": 1, "prefetch_count": 3, "prefetch_output": "ahead"},
    ]
    out = built(spark, sf_dir, stages, ["cache:pool.cache", "hits:pool.hits", "taken:unpack"])
    seen = out["hits"].select("global_index", "use_count", "position", F.lit("hit").alias("status")).union(out["taken"].select("global_index", "use_count", "position", F.lit("miss").alias("status")))
    return out["cache"].join(seen, ["global_index", "use_count", "status"])


@query(f"""WITH {ARCHIVE}, s AS (SELECT sort_key, count(DISTINCT chunk_index) AS n FROM archive GROUP BY 1), w AS (SELECT sort_key FROM (SELECT sort_key, sum(n) OVER (ORDER BY sort_key DESC) - n AS newer FROM s) WHERE newer < 17),
    c AS (SELECT DISTINCT sort_key, chunk_index FROM archive JOIN w USING (sort_key)), k AS (SELECT *, row_number() OVER (ORDER BY sort_key, chunk_index) - 1 AS global_index, count(*) OVER () AS all FROM c)
    SELECT sort_key, chunk_index, global_index, 0::BIGINT AS use_count, count(*) AS n FROM k JOIN archive USING (sort_key, chunk_index) WHERE global_index >= "all" - 17 GROUP BY 1, 2, 3""".replace("AS all FROM", 'AS "all" FROM'))
def q_spec_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest seventeen chunks and no older one."""
    out = built(spark, sf_dir, [{"name": "pool", "type": "shuffling_chunk_pool", "inputs": ["load"], "chunk_pool_size": 17}], ["out:pool"])["out"]
    return out.groupBy("sort_key", "chunk_index", "global_index", "use_count").agg(F.count("*").alias("n"))


@query(f"""WITH {ARCHIVE}, s AS (SELECT sort_key, count(DISTINCT chunk_index) AS n FROM archive GROUP BY 1), w AS (SELECT * FROM (SELECT *, sum(n) OVER (ORDER BY sort_key DESC) - n AS newer FROM s) WHERE newer < 17), t AS (SELECT sum(n) AS total FROM s)
    SELECT 'pool' AS stage, unnest(['chunks_total', 'chunk_sources', 'chunks_current', 'dropped', 'hanse_rejected', 'cache_hits', 'cache_misses', 'newly_cached', 'dropped_cache_positions', 'cached_positions']) AS name,
        unnest(['gauge', 'gauge', 'gauge', 'count', 'count', 'count', 'count', 'count', 'count', 'gauge']) AS kind,
        unnest([max(total), count(*), sum(n), 0, 0, 17 * 3, 17 * 2, 17 * 4, 17 * 2, 17]::DOUBLE[]) AS value, NULL::VARCHAR AS text FROM w, t
    UNION ALL SELECT 'load', 'skipped_files', 'count', 1.0::DOUBLE, NULL UNION ALL SELECT 'load', 'last_chunk_key', 'gauge', NULL, max(sort_key) FROM archive
    UNION ALL SELECT 'all', unnest(['chunks_processed', 'chunks_dropped', 'sources_processed']), 'count', unnest([sum(n), 0, count(*)]::DOUBLE[]), NULL FROM s""")
def q_stage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stages tell of themselves: five uses of seventeen chunks, two positions cached by each miss."""
    path = tars(spark, sf_dir)
    with open(f"{path}/notes.txt", "w") as f:
        f.write("a file that is no archive")
    stages = [
        {**LOADED[0], "directory": f"file://{path}"},
        LOADED[1],
        {"name": "all", "type": "simple_chunk_extractor", "inputs": ["load"]},
        {"name": "pool", "type": "shuffling_chunk_pool", "inputs": ["load", "unpack.ahead"], "chunk_pool_size": 17, "epochs": 5, "cachehit_output": "hits", "position_cache_size": 34},
        {"name": "unpack", "type": "chunk_unpacker", "inputs": ["pool"], "position_count": 1, "prefetch_count": 3, "prefetch_output": "ahead"},
    ]
    out = spec.build(spark, {"stages": stages})
    return joins.join_positions([out[f"{k}.metrics"].select(F.lit(k).alias("stage"), "name", "kind", "value", "text") for k in ("pool", "load", "all")])


@query(f"""WITH {ARCHIVE}, c AS (SELECT DISTINCT sort_key, chunk_index FROM archive)
    SELECT sort_key, chunk_index, row_number() OVER (ORDER BY sort_key, {sql_uniform("'extract'", 'sort_key', 'chunk_index')}, chunk_index) - 1 AS global_index, 0::BIGINT AS use_count FROM c""")
def q_spec_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's chunks once, in an order of their own."""
    out = built(spark, sf_dir, [{"name": "all", "type": "simple_chunk_extractor", "inputs": ["load"]}], ["out:all"])["out"]
    return out.select("sort_key", "chunk_index", "global_index", "use_count").distinct()


@query(f"WITH {ARCHIVE} SELECT 'first' AS kept, sort_key, chunk_index, frame_idx FROM (SELECT * FROM archive ORDER BY sort_key, chunk_index, frame_idx LIMIT 9) UNION ALL SELECT 'newest', sort_key, chunk_index, frame_idx FROM (SELECT * FROM archive ORDER BY sort_key DESC, chunk_index DESC, frame_idx DESC LIMIT 9)")
def q_spec_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queues that drop what comes too late, or what is oldest, of one burst."""
    path = tars(spark, sf_dir)
    stage = lambda name, behaviour: {"name": name, "type": "chunk_source_loader", "path": path, "queue_capacity": 9, "overflow_behavior": behaviour}
    out = spec.build(spark, {"stages": [stage("first", "DROP_NEW"), stage("newest", "KEEP_NEWEST")]})
    return joins.join_positions([out[k].select(F.lit(k).alias("kept"), *KEYS) for k in ("first", "newest")])


def mirrored_chunk(frames, options):
    """A rescorer for the query below: turns root_q round, and fails on every chunk that begins with an odd key."""
    if frames["visits"][0].as_py() % 2:
        raise ValueError("no table holds this game")
    at = frames.schema.get_field_index("root_q")
    return frames.set_column(at, "root_q", [[-x * options["dist_temp"] for x in frames["root_q"].to_pylist()]])


@query(f"""WITH {ARCHIVE}, f AS (SELECT *, first(id) OVER (PARTITION BY sort_key, chunk_index ORDER BY frame_idx) AS head FROM archive)
    SELECT sort_key || '_' || chunk_index || '_rescored' AS sort_key, frame_idx, -q / 2 AS root_q FROM f WHERE head % 2 = 0""")
def q_rescored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks through a rescorer that a spec names, kept as files of their own; those that it fails on go."""
    rescoring.RESCORERS["mirrored"] = mirrored_chunk
    out = built(spark, sf_dir, [{"name": "again", "type": "chunk_rescorer", "inputs": ["load"], "rescorer": "mirrored", "dist_temp": 0.5}], ["out:again"])["out"]
    path = local(spark, "rescored")
    write_chunks(out, path, suffix="_rescored")
    return read(spark, path).select("sort_key", "frame_idx", (F.col("root_q").cast("double") + 0).alias("root_q"))


# T: streams.
def streamed_months(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(months up to 1995 as a table, later ones as a stream of files)."""
    rows, path = months(spark, sf_dir), new_path(spark, "watched")
    rows.where("sort_key >= '1996'").repartition(6).write.parquet(path)
    return rows.where("sort_key < '1996'"), windows.watched(spark, path, rows.schema, files_per_trigger=2)


@query(f"WITH {MONTHS} SELECT sort_key, chunk_count, CASE WHEN sort_key < '1996' THEN 'initial' ELSE 'new' END AS phase FROM months")
def q_two_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The initial scan in one batch, then what comes, two files at a time, each once."""
    initial, stream = streamed_months(spark, sf_dir)
    path = new_path(spark, "phases")
    windows.two_phases(initial, stream, lambda df, i, phase: df.withColumn("phase", F.lit(phase)).write.mode("overwrite").parquet(f"{path}/batch={i}"), new_path(spark, "stream"))
    return spark.read.parquet(path).select("sort_key", "chunk_count", "phase")


@query(f"WITH {MONTHS} SELECT (sum(chunk_count) FILTER (WHERE sort_key > '1995-06' AND sort_key < '1996' OR sort_key >= '1996'))::BIGINT AS before_reset, max(sort_key) AS anchor, 0::BIGINT AS after_reset FROM months")
def q_anchor_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks since an anchor over an initial load and a stream, by a state that is opened again for each step."""
    initial, stream = streamed_months(spark, sf_dir)
    path = new_path(spark, "anchor")
    anchors.Anchor(spark, path).set("1995-06")
    anchors.Anchor(spark, path).add(initial)
    anchors.Anchor(spark, path).follow(stream, new_path(spark, "stream")).awaitTermination()
    key, before = anchors.Anchor(spark, path).reset()
    return spark.createDataFrame([(before, key, anchors.Anchor(spark, path).chunks)], "before_reset bigint, anchor string, after_reset bigint")


@query("SELECT count(*) AS rows FROM events")
def q_stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream reports of itself, batch by batch: the rows that it read."""
    path, lines = new_path(spark, "events"), []
    rows = table(spark, sf_dir, "events").select("event_id")
    rows.repartition(3).write.parquet(path)
    listener = windows.Progress(lines.append)
    spark.streams.addListener(listener)
    try:
        windows.run_available(windows.watched(spark, path, rows.schema, files_per_trigger=1), lambda df, i: df.write.format("noop").mode("overwrite").save(), new_path(spark, "stream"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(listener)
    return spark.createDataFrame([(sum(json.loads(x)["numInputRows"] for x in lines),)], "rows bigint")


@query("SELECT event_type, (epoch_us(ts) // 4096000000)::BIGINT AS block, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 2**18 ticks of event time over a stream of files."""
    path, out = new_path(spark, "events"), new_path(spark, "windows")
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    rows.repartition(3).write.parquet(path)
    agg = windows.tumbling(windows.watched(spark, path, rows.schema), "ts", 18, "40 days", ["event_type"], [F.count("*").alias("n"), F.sum("value").alias("total")])
    sink = lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i:06d}")
    agg.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    every = spark.read.parquet(out)
    last = every.agg(F.max("batch")).first()[0]
    return every.where(F.col("batch") == last).select("event_type", F.expr("unix_micros(window.start) div 4096000000").alias("block"), "n", rounded("total", 4).alias("total"))


@query(f"""WITH {MONTHS} SELECT 'new' AS stage, n, CASE n WHEN 1 THEN '1999-01' WHEN 2 THEN '1999-01' WHEN 3 THEN max(sort_key) ELSE max(sort_key) END AS anchor,
    CASE WHEN n <= 3 THEN sum(chunk_count) ELSE 0 END::BIGINT AS chunks_since_anchor FROM months, range(1, 5) t(n) GROUP BY n
    UNION ALL SELECT 'old', n, CASE WHEN n < 3 THEN '1999-01' ELSE '' END, 0 FROM range(1, 5) t(n)""")
def q_control_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages to all stages: two pools answer, one of which was told of sources."""
    pool = lambda name: {"name": name, "type": "shuffling_chunk_pool", "inputs": ["source"]}
    controls = control.Controls(spark, {"stages": [{"name": "source", "type": "synthetic_source"}, pool("new"), pool("old")]}, new_path(spark, "controls"))
    controls.ingested("new", months(spark, sf_dir))
    out = []
    for n, request in enumerate(({"set_anchor": "1999-01"}, {}, {"reset_anchor": True}, {}), 1):
        out += [(stage, n, a["anchor"], a["chunks_since_anchor"]) for stage, a in controls.send({"chunk_pool": request, "unknown": {}})]
    return spark.createDataFrame(out, "stage string, n bigint, anchor string, chunks_since_anchor bigint")


def rises(older: dict, newer: dict) -> dict:
    """Of two runs of values, how often a value is over the one before."""
    if not older["n"] or not newer["n"]:
        return newer if not older["n"] else older
    return {"first": older["first"], "last": newer["last"], "n": older["n"] + newer["n"], "rises": older["rises"] + newer["rises"] + (newer["first"] > older["last"])}


@query("""WITH v AS (SELECT event_type, value, lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS before FROM events)
    SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > before) AS rises FROM v GROUP BY event_type""")
def q_user_monoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate of the user's own whose states must be merged in order."""
    state = F.struct(F.col("value").alias("first"), F.col("value").alias("last"), F.lit(1).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("rises"))
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") + 1).alias("tick"), state.alias("state"))
    monoid = exponential.Monoid(lambda: {"first": 0.0, "last": 0.0, "n": 0, "rises": 0}, rises)
    return exponential.folded(rows, "tick", ["event_type"], "state", monoid, 9).select("event_type", "state.n", "state.rises")


@query("SELECT part, id FROM (SELECT o_orderpriority AS part, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC) AS n, count(*) OVER (PARTITION BY o_orderpriority) AS all_ FROM orders) WHERE n > 100 AND all_ > 110")
def q_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids over each part's newest hundred once there are a tenth more."""
    return windows.trimmed(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("part"), F.col("o_orderkey").alias("id")), 100).select("part", "id")


# A, J, L, M, X: what no other query calls.
@query("SELECT event_type, min(value) AS min, max(value) AS max, round(sum(value), 4) AS sum, count(value) AS count, max_by(value, event_id) AS latest FROM events GROUP BY event_type")
def q_merged_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial statistics of sixteen parts, merged."""
    parts = table(spark, sf_dir, "events").groupBy("event_type", (F.col("event_id") % 16).alias("part")).agg(*stats.statistics(F.col("value"), F.col("event_id")), F.max("event_id").alias("time"))
    return stats.merged_statistics(parts, ["event_type"]).withColumn("sum", rounded("sum", 4))


@query("""WITH a AS (SELECT p_partkey AS o, p_brand AS shape, p_size AS size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_partkey AS o, p_brand AS shape, p_size AS size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 3 = 0),
    first AS (SELECT a.o AS ours, b.o AS reference FROM a JOIN b USING (shape, n)),
    ra AS (SELECT o, size, row_number() OVER (PARTITION BY size ORDER BY o) AS n FROM a WHERE o NOT IN (SELECT ours FROM first)), rb AS (SELECT o, size, row_number() OVER (PARTITION BY size ORDER BY o) AS n FROM b WHERE o NOT IN (SELECT reference FROM first))
    SELECT ours, reference FROM first UNION ALL SELECT ra.o, rb.o FROM ra JOIN rb USING (size, n)""")
def q_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs paired by shape in order, what is left by size."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("o"), F.col("p_brand").alias("shape"), F.col("p_size").alias("size"))
    return joins.aligned(part.where("o % 2 = 0"), part.where("o % 3 = 0"), "shape", "size", "o")


SQUARES = "s AS (SELECT f, r, chr((97 + f)::INTEGER) || (r + 1) AS name FROM range(8) a(f), range(8) b(r))"
MOVES = f"""{SQUARES}, plain AS (SELECT a.name || b.name AS move, a.r AS r1, a.f AS f1, b.r AS r2, b.f AS f2 FROM s a, s b WHERE a.name <> b.name AND (a.f = b.f OR a.r = b.r OR abs(a.f - b.f) = abs(a.r - b.r) OR abs(a.f - b.f) * abs(a.r - b.r) = 2)),
    m AS (SELECT move, 0 AS kind, r1, f1, r2, f2, 0 AS piece FROM plain UNION ALL SELECT a.name || b.name || p, 1, a.r, a.f, b.r, b.f, i FROM s a, s b, (VALUES ('q', 0), ('r', 1), ('b', 2)) t(p, i) WHERE a.r = 6 AND b.r = 7 AND abs(a.f - b.f) <= 1),
    numbered AS (SELECT (row_number() OVER (ORDER BY kind, r1, f1, CASE WHEN kind = 0 THEN r2 END, f2, piece) - 1)::INTEGER AS move_index, * FROM m)"""


@query(f"WITH {MOVES} SELECT move_index, move, translate(move, '12345678', '87654321') AS mirrored FROM numbered")
def q_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All moves by rule, and as the other side sees them."""
    return moves.table(spark).select("move_index", "move", tensors.mirrored(F.col("move")).alias("mirrored"))


@query(f"""WITH {MOVES} SELECT move_index, CASE WHEN kind = 0 THEN 64 * (8 * r1 + f1) + 8 * r2 + f2 ELSE 4096 + 24 * f1 + 3 * f2 + piece END::BIGINT AS place FROM numbered""")
def q_move_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each move lies among pairs of squares: an array gathered by the map of places."""
    logits = F.sequence(F.lit(0), F.lit(moves.PAIRS + 24 * 8 - 1))
    got = spark.range(1).select(joins.gathered(logits, moves.pair_map()).alias("x"))
    return got.select(F.posexplode("x").alias("move_index", "place")).select("move_index", F.col("place").cast("bigint").alias("place"))


@query(f"""WITH {MOVES}, d AS (SELECT *, f2 - f1 AS df, r2 - r1 AS dr FROM numbered),
    p AS (SELECT move_index, 8 * r1 + f1 AS square, CASE WHEN kind = 1 THEN 64 + 3 * (df + 1) + CASE piece WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END
        WHEN abs(df) * abs(dr) = 2 THEN 56 + list_position([[1, 2], [2, 1], [2, -1], [1, -2], [-1, -2], [-2, -1], [-2, 1], [-1, 2]], [df, dr]) - 1
        ELSE 7 * (list_position([[0, 1], [1, 1], [1, 0], [1, -1], [0, -1], [-1, -1], [-1, 0], [-1, 1]], [sign(df)::BIGINT, sign(dr)::BIGINT]) - 1) + greatest(abs(df), abs(dr)) - 1 END AS plane FROM d)
    SELECT plane::INTEGER AS plane, square::INTEGER AS square, move_index FROM p""")
def q_move_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which plane and square holds each move."""
    return moves.plane_map(spark)


@query("""WITH k AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events), f AS (SELECT *, [1, 2, 3, 4, 5, 132, 133][k % 7 + 1] AS fmt, 100 + k AS inv FROM k)
    SELECT event_id, 512 AS n, round(CASE WHEN fmt = 1 THEN 64 * (k % 2 + 1 + 0 + k % 3 + k % 5) ELSE bit_count(k % 2) + bit_count(1) + bit_count(0) + bit_count(k % 3) + CASE WHEN fmt = 2 THEN 64 * (k % 5) ELSE bit_count(k % 5) END END
        + 64 * k / CASE WHEN fmt > 3 THEN 100.0::DOUBLE ELSE 99.0::DOUBLE END + CASE WHEN fmt >= 132 AND inv >= 128 THEN 64 ELSE 0 END + 64, 3) AS total FROM f""")
def q_format_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Auxiliary planes as each input format lays them out, by their sums."""
    k = F.get_json_object("props", "$.k").cast("int")
    fmt = F.get(F.array(*[F.lit(x) for x in (1, 2, 3, 4, 5, 132, 133)]), k % 7)
    planes = tensors.format_planes(fmt, k % 2, F.lit(1), F.lit(0), k % 3, k % 5, k, k + 100)
    rows = table(spark, sf_dir, "events").select("event_id", F.transform(planes, lambda x: x.cast("double")).alias("p"))
    return rows.select("event_id", F.size("p").alias("n"), F.round(tensors.total(F.col("p")), 3).alias("total"))


@query("SELECT event_id, CASE WHEN k % 5 = 0 THEN k ELSE k % 5 END AS plies FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)")
def q_plies_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", tensors.plies_left(k % 5, k).alias("plies"))


BOARD = """b AS (SELECT c_custkey AS id, list_transform(range(64), lambda s: (c_custkey * 31 + s * s * 7 + s * 13) % 40) AS board FROM customer),
    t AS (SELECT id, list_transform(board, lambda p: CASE WHEN p < 12 THEN substr('PNBRQKpnbrqk', (p + 1)::INTEGER, 1) ELSE '.' END) AS t FROM b),
    l AS (SELECT id, list_transform(range(8), lambda r: array_to_string(list_slice(t, 57 - 8 * r, 64 - 8 * r), '')) AS l FROM t)"""


@query(f"""WITH {BOARD}, j AS (SELECT id, array_to_string(l, chr(10)) AS board, array_to_string(l, '/') AS fen FROM l)
    SELECT id, board, {'replace(' * 8}fen{''.join(f", '{'.' * n}', '{n}')" for n in range(8, 0, -1))} AS fen FROM j""")
def q_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards of twelve planes as text, and as the first field of a position's name."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda s: (F.col("c_custkey") * 31 + s * s * 7 + s * 13) % 40).alias("b"))
    plane = lambda k: F.aggregate("b", F.struct(F.lit(0).cast("bigint").alias("bits"), F.lit(0).alias("s")), lambda acc, p: F.struct(F.when(p == k, acc["bits"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), acc["s"]))).otherwise(acc["bits"]).alias("bits"), (acc["s"] + 1).alias("s")), lambda acc: acc["bits"])
    planes = rows.select("id", *[plane(k).alias(f"p{k}") for k in range(12)])
    own = [F.col(f"p{k}") for k in range(12)]
    return planes.select("id", tensors.ascii_board(own).alias("board"), tensors.fen_placement(own).alias("fen"))


@query("""WITH v AS (SELECT o_orderkey, (o_totalprice * o_totalprice * (o_orderkey % 7))::DOUBLE AS x, o_orderkey * 37 AS s FROM orders)
    SELECT o_orderkey, CASE WHEN x >= 1e9 THEN printf('%.1fG', x / 1e9) WHEN x >= 1e6 THEN printf('%.1fM', x / 1e6) WHEN x >= 1e3 THEN printf('%.1fk', x / 1e3) ELSE printf('%.0f', x) END AS count_text,
        CASE WHEN s < 60 THEN printf('%ds', s) WHEN s < 3600 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%dh %02dm', s // 3600, s // 60 % 60) END AS time_text FROM v""")
def q_readable_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    x = (F.col("o_totalprice") * F.col("o_totalprice") * (F.col("o_orderkey") % 7)).cast("double")
    return o.select("o_orderkey", text.si(x).alias("count_text"), text.duration(F.col("o_orderkey") * 37).alias("time_text"))


@query("SELECT n_nationkey, 'net-' || lpad(n_nationkey::VARCHAR, 8, '0') || '-' || n_nationkey || '-20240131-120500.pb' AS name FROM nation")
def q_rendered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of exports from a template."""
    at = F.lit(datetime.datetime(2024, 1, 31, 12, 5)).cast("timestamp_ntz")
    return table(spark, sf_dir, "nation").select("n_nationkey", text.rendered("net-{step:08d}-{step}-{datetime}.pb", F.col("n_nationkey"), at).alias("name"))


@query("""WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
    c AS (SELECT vec_id, i, CASE WHEN abs(x) < pow(2, -14) THEN round_even(x * pow(2, 24), 0) / pow(2, 24) ELSE round_even(x / pow(2, floor(log2(abs(x))) - 10), 0) * pow(2, floor(log2(abs(x))) - 10) END AS half, CASE WHEN x = 0 THEN 0 ELSE trunc(x / pow(2, floor(log2(abs(x))) - 7)) * pow(2, floor(log2(abs(x))) - 7) END AS brain FROM e)
    SELECT vec_id, round(sum(half * i), 5) + 0 AS half, round(sum(brain * i), 5) + 0 AS brain FROM c GROUP BY vec_id""")
def q_half_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights through both sixteen-bit floats."""
    weigh = lambda c: F.round(F.aggregate(F.transform(c, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x), 5) + 0
    coded = table(spark, sf_dir, "embeddings").select("vec_id", codecs.float16("embedding").alias("half"), codecs.bfloat16("embedding").alias("brain"))
    return coded.select("vec_id", weigh("half").alias("half"), weigh("brain").alias("brain"))


@query("""WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x, list_min(embedding)::DOUBLE AS low, list_max(embedding)::DOUBLE AS high FROM embeddings),
    c AS (SELECT vec_id, i, CASE WHEN abs(x) < pow(2, -14) THEN round_even(x * pow(2, 24), 0) / pow(2, 24) ELSE round_even(x / pow(2, floor(log2(abs(x))) - 10), 0) * pow(2, floor(log2(abs(x))) - 10) END AS half,
        CASE WHEN x = 0 THEN 0 ELSE trunc(x / pow(2, floor(log2(abs(x))) - 7)) * pow(2, floor(log2(abs(x))) - 7) END AS brain, round_even(65535.0::DOUBLE * ((x - low) / (high - low)), 0) / 65535.0::DOUBLE AS k, low, high FROM e)
    SELECT 'net-00000007-' || encoding || '.pq' AS file, 'layer.' || vec_id AS path, round(sum(i * CASE encoding WHEN 'LINEAR16' THEN k * high + (1 - k) * low WHEN 'FLOAT16' THEN half ELSE brain END), 4) + 0 AS total
    FROM c, (SELECT unnest(['LINEAR16', 'FLOAT16', 'BFLOAT16']) AS encoding) GROUP BY encoding, vec_id""")
def q_coded_nets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nets exported in each encoding under names from a template, and read."""
    net = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("layer."), "vec_id").alias("path"), F.when(F.col("vec_id") % 2 == 0, F.array(F.lit(4), F.lit(16))).otherwise(F.array(F.lit(64))).alias("shape"), F.col("embedding").alias("values"))
    folder, out = new_path(spark, "nets"), []
    for encoding in nets.ENCODINGS:
        path = nets.export(net, folder, f"net-{{step:08d}}-{encoding}.pq", 7, datetime.datetime(2024, 1, 31), encoding)
        total = F.aggregate(F.transform("values", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
        out.append(nets.read_net(spark, path).select(F.lit(path.rpartition("/")[2]).alias("file"), "path", (F.round(total, 4) + 0).alias("total")))
    return joins.join_positions(out)


@query(f"WITH {COORDINATES}, t AS (SELECT vec_id, (i % 4) * 16 + i // 4 AS place, x FROM cells) SELECT vec_id, round(sum(x * place), 4) + 0 AS total FROM t GROUP BY vec_id")
def q_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix of four rows by sixteen from its transpose's values."""
    turned = table(spark, sf_dir, "embeddings").select("vec_id", codecs.transposed(F.col("embedding"), 4, 16).alias("v"))
    total = F.aggregate(F.transform("v", lambda x, i: x.cast("double") * i), F.lit(0.0), lambda a, x: a + x)
    return turned.select("vec_id", (F.round(total, 4) + 0).alias("total"))


@query(f"""WITH {COORDINATES}, n AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'body.' ELSE 'head.' END || vec_id AS path, vec_id, i, x FROM cells),
    m AS (SELECT a.path, a.vec_id, a.i, CASE WHEN a.path LIKE 'head.%' THEN 2 * a.x ELSE 0.25 * (a.x + b.x) - 2 * a.x END AS x FROM n a JOIN (SELECT vec_id - 1 AS vec_id, i, x FROM n) b USING (vec_id, i))
    SELECT path, round(sum(x), 4) + 0 AS total, count(*) AS n FROM m GROUP BY path""")
def q_weight_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script over named nets: arithmetic, then layers of one net grafted on another."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("values"))
    named = lambda k: F.concat(F.when(k % 2 == 0, "body.").otherwise("head."), k)
    net = e.select(named(F.col("vec_id")).alias("path"), "values")
    after = e.where("vec_id > 0").select(named(F.col("vec_id") - 1).alias("path"), "values")
    out = codecs.script({"a": net, "b": after}, "twice = 2 * a\nout = 0.25 * (a + b) - twice\nout['head.'] = twice['head.']")["out"]
    return out.select("path", (F.round(tensors.total(F.col("values")), 4) + 0).alias("total"), F.size("values").cast("bigint").alias("n"))


@query(f"WITH {COORDINATES} SELECT round(sum(CASE WHEN label = 3 THEN 0.5 WHEN label % 2 = 0 THEN 2 ELSE 0 END * x * x), 4) AS penalty FROM cells")
def q_selected_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares summed over the leaves that rules select: the first rule that meets a path gives its weight."""
    rows = cells(spark, sf_dir).withColumn("path", F.concat_ws(".", F.lit("net"), F.when(F.col("label") % 2 == 0, "even").otherwise("odd"), F.col("label").cast("string")))
    weight: Column = schedule.selected(F.col("path"), [("*.3", 0.5), ("net.even.*", 2.0)], 0.0)
    return rows.select(F.sum(weight * F.col("x") * F.col("x")).alias("p")).select(F.round("p", 4).alias("penalty"))


@query(f"SELECT event_id, {sql_uniform(repr(SEED), "coalesce(k::VARCHAR, '<null>')", 'event_type')} < 0.5 AS chosen FROM (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS k FROM events)")
def q_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random numbers by keys of which some are null."""
    k = F.when(F.col("event_id") % 3 == 0, None).otherwise(F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", (rng.uniform(SEED, k, F.col("event_type")) < 0.5).alias("chosen"))
