from tidewater.functions import moves, tensors
from tidewater.operators import joins
from pyspark.sql import functions as F


def test_names():
    n = moves.names()
    assert len(n) == len(set(n)) == 1858 and n[:3] == ["a1b1", "a1c1", "a1d1"] and n[23] == "b1a1"
    assert n[1791] == "h8g8" and n[1792:1795] == ["a7a8q", "a7a8r", "a7a8b"] and n[-1] == "h7h8b"


def test_maps(spark):
    planes = [m for m in moves.plane_moves() if m]
    assert len(moves.plane_moves()) == 73 * 64 and sorted(planes) == sorted(moves.names())
    pairs = moves.pair_map()
    assert len(set(pairs)) == 1858 and max(pairs) < 64 * 64 + 8 * 24
    assert moves.plane_map(spark).count() == 1858
    n = moves.table(spark).where(F.col("move") == "e2e4").select("move_index", tensors.mirrored(F.col("move"))).first()
    assert moves.names()[n[0]] == "e2e4" and n[1] == "e7e5"
    logits = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(4287)), lambda i: i * 2).alias("x"))
    assert logits.select(joins.gathered(F.col("x"), pairs)).first()[0] == [2 * i for i in pairs]
