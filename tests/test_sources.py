"""Archives written and read back, frame layouts, tensors, codecs and text functions."""

import bz2
import gzip
import io
import math
import os
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import codecs, losses, rng, tensors, text
from tidewater.sources import chunks, files, frames, nets, sinks, synthetic


def made(n, seed=0):
    g = np.random.default_rng(seed)
    f = np.zeros(n, frames.V7)
    f["version"], f["input_format"] = 6, 3
    f["probabilities"] = g.random((n, frames.POLICY), np.float32)
    f["planes"] = g.integers(0, 1 << 63, (n, frames.HISTORY), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    f["rule50_count"], f["result_q"], f["played_idx"] = 42, 0.5, np.arange(n)
    return f


def test_sizes():
    assert frames.V6.itemsize == 8356 and frames.V6.fields["castling_us_ooo"][1] == 8272 and frames.V6.fields["policy_kld"][1] == 8348
    assert (frames.SIZES[3], frames.SIZES[4], frames.SIZES[5]) == (8276, 8292, 8308)


@pytest.mark.parametrize("version", [3, 4, 5, 6, 7])
def test_versions_widen(version):
    f = made(3)
    f["version"] = version
    data = frames.encode(f, 7) if version == 7 else frames.encode(f)
    if version < 6:
        rows = np.frombuffer(data, np.uint8).reshape(3, -1)
        rows = rows[:, : frames.SIZES[5]] if version == 5 else np.hstack([rows[:, :4], rows[:, 8 : frames.SIZES[version] + 4]])
        data = rows.tobytes()
    assert len(data) == 3 * frames.SIZES[version]
    out = frames.decode(data)
    assert np.array_equal(out["planes"], f["planes"]) and np.array_equal(out["probabilities"], f["probabilities"])
    assert set(out["input_format"]) == ({1} if version < 5 else {3}) and set(out["rule50_count"]) == {42}
    for bad in (b"", data[:-1], b"\x63" + data[1:]):
        with pytest.raises(frames.BadFrames):
            frames.decode(bad)


def archive(folder):
    """A tar of two good chunks, one broken, one empty and a licence; a single chunk; a hidden one; a pack."""
    def member(tar, name, data):
        info = tarfile.TarInfo(name)
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))

    with tarfile.open(f"{folder}/a.tar", "w") as tar:
        d = tarfile.TarInfo("d")
        d.type = tarfile.DIRTYPE
        tar.addfile(d)
        member(tar, "d/0.gz", gzip.compress(frames.encode(made(2, 1))))
        member(tar, "d/LICENSE", b"text")
        member(tar, "d/1.gz", b"no gzip")
        member(tar, "d/2.gz", b"")
        member(tar, "d/3.gz", gzip.compress(frames.encode(made(5, 2))))
    with open(f"{folder}/b.gz", "wb") as f:
        f.write(gzip.compress(frames.encode(made(4, 3))))
    for name in (".hidden.gz", "notes.txt"):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(b"x")


def test_chunk_source(spark, tmp_path):
    archive(tmp_path)
    chunks.register(spark)
    read = lambda **o: spark.read.format("chunks").options(**o).load(str(tmp_path))
    counts = {(r["sort_key"], r["chunk_index"]): r["count"] for r in read().groupBy("sort_key", "chunk_index").count().collect()}
    assert counts == {("a", 0): 2, ("a", 3): 5, ("b", 0): 4}
    first = read(firstFrameOnly="true").select("sort_key", "chunk_index", "frame_idx", "played_idx", "rule50_count").collect()
    assert sorted(tuple(r) for r in first) == [("a", 0, 0, 0, 42), ("a", 3, 0, 0, 42), ("b", 0, 0, 0, 42)]
    bad = read(corrupt="keep").where("frame_idx = -1").select("sort_key", "chunk_index").collect()
    assert sorted(tuple(r) for r in bad) == [("a", 1), ("a", 2)]
    planes = read().where("sort_key = 'b' and frame_idx = 1").select("planes").first()[0]
    assert np.array_equal(np.asarray(planes, np.int64).view(np.uint64), made(4, 3)["planes"][1])


def test_chunks_written_read_back(spark, tmp_path):
    archive(tmp_path)
    chunks.register(spark)
    rows = spark.read.format("chunks").load(str(tmp_path))
    out = str(tmp_path / "out")
    rows.repartition(2, "sort_key", "chunk_index").sortWithinPartitions("sort_key", "chunk_index").write.format("chunks").option("suffix", "_rescored").mode("append").save(out)
    assert sorted(os.listdir(out)) == ["a_0_rescored.gz", "a_3_rescored.gz", "b_0_rescored.gz"]
    with gzip.open(f"{out}/a_3_rescored.gz") as f:
        assert f.read() == frames.encode(made(5, 2))


def test_packs(tmp_path):
    games = [bytes([i]) * (frames.SIZES[3] * (i + 1)) for i in range(5)]
    paths = chunks.pack_games(games, str(tmp_path / "p"), 2)
    assert len(paths) == 2
    assert [d for p in paths for _, d in chunks.members(p)] == games
    with bz2.open(paths[1]) as f:
        assert f.read()[-4:] == (3).to_bytes(4, "little")


def test_a_prefix_is_read_no_further_than_asked(tmp_path):
    data = os.urandom(3_000_000)
    stream = io.BytesIO(gzip.compress(data, 1))
    assert chunks.gunzipped(stream, 1000) == data[:1000] and stream.tell() <= chunks.READ
    many = gzip.compress(b"ab") + gzip.compress(b"cd")
    assert chunks.gunzipped(io.BytesIO(many)) == b"abcd" and chunks.gunzipped(io.BytesIO(many), 3) == b"abc"
    for bad in (b"", b"nonsense", many[:-3]):
        assert chunks.gunzipped(io.BytesIO(bad)) is None


def test_a_job_that_fails_leaves_no_file(spark, tmp_path):
    chunks.register(spark)
    path = tmp_path / "out"
    rows = spark.createDataFrame([("k", i, 0) for i in range(6)], "sort_key string, chunk_index bigint, frame_idx int").repartition(3)
    rows.write.format("chunks").mode("append").save(str(path))
    assert sorted(os.listdir(path)) == [f"k_{i}.gz" for i in range(6)]
    before = {n: (path / n).stat().st_mtime_ns for n in os.listdir(path)}
    broken = rows.withColumn("frame_idx", F.when(F.col("chunk_index") == 4, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("frame_idx")))
    with pytest.raises(Exception):
        broken.write.format("chunks").mode("append").save(str(path))
    assert {n: (path / n).stat().st_mtime_ns for n in os.listdir(path)} == before


def test_listed_files_are_read_where_their_rows_are(spark, tmp_path):
    rows = spark.createDataFrame([(k, i, 0) for k in ("a", "b") for i in range(3)], "sort_key string, chunk_index bigint, frame_idx int").withColumn("rule50_count", F.col("chunk_index").cast("short")).withColumn("version", F.lit(6).cast("bigint"))
    made = chunks.tar_archives(rows, str(tmp_path / "t")).collect()
    assert sorted((r["sort_key"], r["chunks"]) for r in made) == [("a", 3), ("b", 3)]
    got = chunks.frames_of(spark.createDataFrame([(f"file:{r['path']}",) for r in made], "path string")).collect()
    assert sorted((r["sort_key"], r["chunk_index"], r["rule50_count"]) for r in got) == [(k, i, i) for k in ("a", "b") for i in range(3)]


def test_pulling_does_not_wait(spark):
    slow = spark.range(4).repartition(1).select(F.udf(lambda i: (__import__("time").sleep(1), i)[1], "bigint")("id").alias("id"))
    pull = sinks.Pull(slow, 4)
    assert pull.maybe() is None and not pull.ended
    assert len(pull.get()) == 4
    with pytest.raises(StopIteration):
        pull.get()
    assert pull.ended and pull.maybe() is None
    failing = sinks.Pull(spark.range(3).select(F.raise_error(F.lit("bad"))), 1)
    with pytest.raises(Exception, match="bad"):
        failing.get()


def test_synthetic_source(spark):
    s = synthetic.sources(spark, 50, 20).collect()
    assert s[7]["sort_key"] == "00000007" and min(r["chunk_count"] for r in s) >= 1
    assert abs(np.mean([r["chunk_count"] for r in s]) - 20) < 4
    f = synthetic.frames(spark, 2, 3).select("sort_key", "chunk_index", "frame_idx", F.slice("planes", 1, 3).alias("p"), F.size("planes").alias("n")).collect()
    assert all(r["p"] == [int(r["sort_key"]), r["chunk_index"], r["frame_idx"]] and r["n"] == 104 for r in f)
    assert synthetic.sources(spark, 5, 9).collect() == synthetic.sources(spark, 5, 9).collect()


def test_npz(spark, tmp_path):
    batch = [{"inputs": [1.0, 2.0], "probabilities": [0.5], "values": [3.0]}, {"inputs": [4.0, 5.0], "probabilities": [0.25], "values": [6.0]}]
    synthetic.write_npz(batch, str(tmp_path / "b.npz"))
    got = synthetic.npz_batches(spark, str(tmp_path / "b.npz")).collect()
    assert [list(r["inputs"]) for r in got] == [[1.0, 2.0], [4.0, 5.0]]


def test_file_events(spark, tmp_path):
    os.makedirs(tmp_path / "in" / "sub")
    for n in ("in/a.gz", "in/sub/b.gz", "in/.c.gz"):
        (tmp_path / n).write_bytes(b"x")
    assert sorted(os.path.basename(r["path"]) for r in synthetic.file_events(spark, str(tmp_path / "in")).collect()) == ["a.gz", "b.gz"]


# Tensors.
def one(spark, *columns):
    row = spark.range(1).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_planes(spark):
    value = 0x8000000000000001
    got = one(spark, tensors.bits(F.lit(value - (1 << 64))))
    assert [s for s, x in enumerate(got) if x] == [7, 56] and all(got[s] == (value >> (s ^ 7)) & 1 for s in range(64))
    meta = one(spark, tensors.meta_planes(F.lit(1), F.lit(0), F.lit(0), F.lit(1), F.lit(1), F.lit(50)))
    assert [meta[64 * i] for i in range(8)] == pytest.approx([1, 0, 0, 1, 1, 50 / 99, 0, 1]) and len(meta) == 512
    planes = F.array(*[F.lit(i) for i in range(104)]).cast("array<bigint>")
    assert len(one(spark, tensors.input_planes(planes, *[F.lit(0)] * 6))) == 7168


@pytest.mark.parametrize(("fmt", "divisor", "armageddon"), [(1, 99, 0), (2, 99, 0), (3, 99, 0), (4, 100, 0), (132, 100, 1)])
def test_auxiliary_planes(spark, fmt, divisor, armageddon):
    args = [F.lit(x) for x in (fmt, 1, 2, 4, 8, 16, 50, 128)]
    got = one(spark, tensors.format_planes(*args))
    assert len(got) == 512 and got[5 * 64] == pytest.approx(50 / divisor) and got[6 * 64] == armageddon and got[7 * 64] == 1
    if fmt == 1:
        assert [got[64 * i] for i in range(5)] == [1, 2, 4, 8, 16]
    else:
        assert got[:8] == [1, 0, 0, 0, 0, 0, 0, 0] and got[56:64] == [0, 0, 1, 0, 0, 0, 0, 0]
        assert got[64:72] == [0, 1, 0, 0, 0, 0, 0, 0] and got[4 * 64 + 60] == (16 if fmt == 2 else 1)


def test_values_and_results(spark):
    row = {"result_q": 0.5, "result_d": 0.2, "plies_left": 42.5, "best_q": 0.3, "best_d": 0.1, "best_m": 42.5}
    m = one(spark, tensors.value_matrix(lambda n: F.lit(row.get(n, 0.0))))
    assert m[:6] == pytest.approx([0.5, 0.2, 42.5, 0.3, 0.1, 42.5]) and math.isnan(m[17]) and len(m) == 18
    assert one(spark, tensors.wdl_of_result(F.lit(-1))) == [0, 0, 1]
    assert one(spark, tensors.plies_left(F.lit(0), F.lit(9)), tensors.plies_left(F.lit(3), F.lit(9))) == (9, 3)
    board = one(spark, tensors.ascii_board([F.lit(1 << i).cast("bigint") for i in range(12)]))
    assert board.split("\n")[7] == "PNBRQKpn" and board.split("\n")[6] == "brqk...."
    assert one(spark, tensors.fen_placement([F.lit(1 << i).cast("bigint") for i in range(12)])) == "8/8/8/8/8/8/brqk4/PNBRQKpn"
    assert one(spark, tensors.mirrored(F.lit("e2e4"))) == "e7e5"
    frames_ = spark.createDataFrame([([([1, 2, 9],), ([5, -1, 0],)],)], "f array<struct<planes: array<bigint>>>")
    assert frames_.select(tensors.first_match(F.col("f"), "planes", [5, (1 << 64) - 1]), tensors.first_match(F.col("f"), "planes", [8])).first()[:] == (1, None)


# Losses.
def arr(*xs):
    return F.array(*[F.lit(x) for x in xs])


def test_losses(spark):
    lg, t = [1.0, 2.0, -1.0, 0.5], [0.25, 0.75, -1.0, 0.0]
    z = math.log(sum(math.exp(x) for x, y in zip(lg, t) if y >= 0))
    ce = sum(y * (z - x) for x, y in zip(lg, t) if y > 0)
    kl = ce + sum(y * math.log(y) for y in t if y > 0)
    got = one(spark, losses.policy_cross_entropy(arr(*lg), arr(*t)), losses.policy_kl(arr(*lg), arr(*t)), losses.policy_entropy(arr(*t)), losses.policy_accuracy(arr(*lg), arr(*t)))
    assert got == pytest.approx((ce, kl, ce - kl, 1.0))
    assert one(spark, losses.tempered(arr(0.0, 0.0), 2.0)) == [0.0, 0.0]
    assert one(spark, losses.tempered(arr(0.2, 0.8), 0.0)) == [0.2, 0.8]
    assert one(spark, losses.moves_left(F.lit(30.0), F.lit(25.0)), losses.moves_left(F.lit(80.0), F.lit(0.0))) == pytest.approx((0.5 * 0.25**2, 0.5 * (4 - 0.25)))
    assert one(spark, losses.q_bucket(F.lit(-1.0), 4), losses.q_bucket(F.lit(1.0), 4), losses.q_bucket(F.lit(0.0), 4)) == (0, 3, 2)
    assert one(spark, losses.value_accuracy(arr(3.0, 1.0, 0.0), F.lit(0.9), F.lit(0.05))) == 1.0
    assert one(spark, losses.q_mix(F.lit(1.0), F.lit(0.0), 0.25)) == 0.75
    with pytest.raises(ValueError):
        losses.weighted({"a": F.lit(1.0)}, {"b": 1.0})


# Codecs and nets.
def test_codecs(spark):
    x = [0.0, 0.1, 1.0, -2.0]
    df = spark.createDataFrame([(x,), ([3.0, 3.0],)], "x array<float>")
    coded = df.select(codecs.linear16_encode(F.col("x")).alias("c")).select("c", codecs.linear16_decode(F.col("c")).alias("d")).collect()
    assert coded[0]["d"] == pytest.approx(x, abs=3 / 65535) and coded[1]["d"] == pytest.approx([3.0, 3.0])
    assert coded[0]["c"]["codes"][2:] == [65535, 0] and coded[1]["c"]["codes"] == [32768, 32768]
    half = df.select(codecs.float16("x").alias("h"), codecs.bfloat16("x").alias("b")).first()
    assert half["h"] == pytest.approx(x, rel=1e-3) and half["b"] == pytest.approx(x, rel=1e-2)


def test_net_arithmetic(spark):
    a = spark.createDataFrame([("p.w", [1.0, 2.0]), ("p.b", [3.0]), ("q.w", [4.0])], "path string, values array<double>")
    b = codecs.scaled(a, 10.0)
    got = {r["path"]: r["values"] for r in codecs.combined(a, b, 1.0, -0.1).collect()}
    assert all(v == pytest.approx([0.0] * len(v)) for v in got.values()) and set(got) == {"p.w", "p.b", "q.w"}
    graft = {r["path"]: r["values"] for r in codecs.grafted(a, b, ["q."]).collect()}
    assert graft == {"p.w": [1.0, 2.0], "p.b": [3.0], "q.w": [40.0]}
    assert one(spark, codecs.transposed(arr(1, 2, 3, 4, 5, 6), 2, 3)) == [1, 3, 5, 2, 4, 6]


# Text.
def test_counts_are_rounded_as_in_c(spark):
    counts = [1250.0, 1350.0, 12250.0, 12350.0, 1449.9999, 999950.0, 999949.9, 966050000.0, 2.5e6, 1.25e9, 1.35e9, 8.7654321e24, 0.5, 1.5, 2.5, 998.5, 999.5, -1.5, 0.0]
    counts += [(i * 2 + 1) * 50.0 for i in range(10, 10000, 7)] + [(i * 2 + 1) * 5e4 for i in range(10, 10000, 7)]
    plain = lambda x: f"{x / 1e9:.1f}G" if x >= 1e9 else f"{x / 1e6:.1f}M" if x >= 1e6 else f"{x / 1e3:.1f}k" if x >= 1e3 else f"{x:.0f}"
    rows = spark.createDataFrame([(x,) for x in counts], "x double").select("x", text.si(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in rows] == [plain(r["x"]) for r in rows]
    assert one(spark, text.si(F.lit(None).cast("double")), text.duration(F.lit(None).cast("bigint"))) == (None, None)


def test_text(spark):
    p = lambda s: F.lit(s)
    assert one(spark, text.basename(p("a/b.c.gz")), text.stem(p("a/b.c.gz")), text.extension(p("a/b.c.gz")), text.extension(p(".gz")), text.file_id(p("x/training.123.gz"))) == ("b.c.gz", "b.c", ".gz", "", 123)
    assert one(spark, text.numbers(p("0xFFFFFFFFFFFFFFFF, 10,x"))) == [-1, 10, None]
    assert one(spark, text.si(F.lit(1234567)), text.si(F.lit(999)), text.duration(F.lit(75)), text.duration(F.lit(7261))) == ("1.2M", "999", "1m 15s", "2h 01m")
    assert one(spark, text.rendered("net-{step:08d}-{datetime}", F.lit(42), F.lit("2024-01-02 03:04:05").cast("timestamp"))) == "net-00000042-20240102-030405"
    nested = spark.createDataFrame([(1, (1.5, (2, "x")))], "step int, m struct<loss: double, sub: struct<n: int, s: string>>")
    assert sorted(tuple(r) for r in text.flattened(nested, "m", ["step"]).collect()) == [(1, "loss", 1.5), (1, "sub/n", 2.0)]
    assert text.to_json(spark.createDataFrame([(1,)], "a int")).first()[0] == '{"a":1}'
    assert one(spark, text.hidden(p("/a/.b/c")), text.hidden(p("/a/b"))) == (True, False)


def test_random_numbers_are_functions_of_their_keys(spark):
    a, b = one(spark, rng.uniform("s", F.lit(1)), rng.uniform("s", F.lit(1)))
    assert a == b and 0 <= a < 1


# Sinks.
def test_sinks(spark, tmp_path):
    pull = sinks.Pull(spark.range(7), 3)
    assert [len(b) for b in pull] == [3, 3] and pull.maybe() is None
    assert [len(b) for b in sinks.Pull(spark.range(7), 3, keep_rest=True)] == [3, 3, 1]
    sinks.write_csv(spark.createDataFrame([("f", 1, 2, 3)], "file string, w int, d int, l int"), str(tmp_path / "csv"), header=False)
    assert spark.read.csv(str(tmp_path / "csv")).first()[:] == ("f", "1", "2", "3")
    assert sinks.dump(spark.createDataFrame([(1, None)], "a int, b string")).first()[0] == "a: 1\nb: null"
    series = spark.createDataFrame([("r", 1, "t", 0.5)], "run string, step int, tag string, value double")
    for _ in range(2):
        sinks.scalars(series, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("run = 'r'").count() == 2
    line = sinks.status_line("progress", {"step": 3})
    assert sinks.read_status(line, {"progress"}) == ("progress", {"step": 3})
    with pytest.raises(ValueError):
        sinks.read_status(line, {"other"})


def test_checkpoints(spark, tmp_path):
    path = str(tmp_path / "ck")
    leaves = lambda v: spark.createDataFrame([("a.b", [1], [v])], "path string, shape array<int>, values array<double>")
    for step, v in ((10, 1.0), (20, 2.0), (30, 3.0), (20, 2.5)):
        files.write_checkpoint(leaves(v), step, path)
    assert files.checkpoint_steps(spark, path) == [10, 20, 30] and files.checkpoint_steps(spark, path, 15, 25) == [20]
    assert files.read_checkpoint(spark, path, 20).first()["values"] == [2.5] and files.read_checkpoint(spark, path).first()["values"] == [3.0]


def test_chunks_are_shuffled_whole(spark):
    rows = spark.createDataFrame([(c, i) for c in range(20) for i in range(3)], "c int, frame_idx int")
    out = files.shuffled_chunks(rows, "s", 4, ["c"])
    got = [(r["p"], r["c"], r["frame_idx"]) for r in out.select(F.spark_partition_id().alias("p"), "*").collect()]
    assert sorted(x[1:] for x in got) == sorted((c, i) for c in range(20) for i in range(3))
    assert all(got[k][2] == k % 3 and got[k][1] == got[k - k % 3][1] for k in range(len(got)))


def test_weight_scripts(spark):
    net = lambda *v: spark.createDataFrame([("body.a", [v[0]]), ("head.b", [v[1]])], "path string, values array<double>")
    out = codecs.script({"a": net(1.0, 2.0), "b": net(4.0, 8.0)}, "c = -(a - b) / 2 + a * 3\nc['head'] = b['head']")
    assert {r["path"]: r["values"] for r in out["c"].collect()} == {"body.a": [4.5], "head.b": [8.0]}
    for bad in ("c = d", "import os", "c = a * b", "c = 1 + 2", "c = a ** 2", "c = open('x')", "a['x'] = b['y']", "a.b = a", "c = a if 1 else b"):
        with pytest.raises(codecs.BadScript):
            codecs.script({"a": net(1.0, 2.0), "b": net(1.0, 2.0)}, bad)


def test_older_records_are_encoded_as_they_are_read():
    f = made(4)
    for version in (3, 4, 5, 6, 7):
        f["version"] = version
        data = frames.encode(f, version)
        assert len(data) == 4 * frames.SIZES[version]
        back = frames.decode(data)
        assert np.array_equal(back["planes"], f["planes"]) and set(back["version"]) == {version}


def test_nets_are_kept_column_by_column(spark, tmp_path):
    layers = [("a", [2, 3], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), ("b", [2], [0.5, 0.25]), ("c", [0], []), ("d", [1, 2], None)]
    net = spark.createDataFrame(layers, "path string, shape array<int>, values array<double>")
    for encoding in nets.ENCODINGS:
        path = f"file://{tmp_path}/{encoding}"
        nets.write_net(net, path, encoding)
        kept = {r["path"]: r["values"] for r in spark.read.parquet(path).collect()}
        assert len(kept["a"]) == 6 and (encoding != "LINEAR16" or kept["a"] == [0, 39321, 13107, 52428, 26214, 65535])  # 1, 4, 2, 5, 3, 6
        got = {r["path"]: r["values"] for r in nets.read_net(spark, path).collect()}
        assert got["a"] == pytest.approx(layers[0][2], abs=1e-4) and got["b"] == pytest.approx([0.5, 0.25]) and got["c"] == [] and got["d"] is None
    with pytest.raises(ValueError):
        nets.write_net(net, "nowhere", "FLOAT8")
