"""The pipeline's stages one after another, each on what the one before kept."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_llm import check_pieces
from tidewater.llm import linerules, packing
from tidewater.llm.common import stored


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(stored(f(spark, out[-1], SF), name.replace(" ", "-")))
    return out


def ids(df):
    return [r["doc_id"] for r in df.select("doc_id").collect()]


def test_columns_and_rows(stages):
    for before, after in zip(stages[:-2], stages[1:-1]):
        assert after.columns == stages[0].columns
        assert set(ids(after)) <= set(ids(before)) and len(set(ids(after))) == len(ids(after))


def test_rules_clean_and_reject(stages):
    kept = {r["doc_id"]: r for r in stages[1].collect()}
    for r in stages[0].collect():
        found = linerules.judged(r["text"])
        assert (r["doc_id"] in kept) == found[6]
        if found[6]:
            assert kept[r["doc_id"]]["text"] == found[8] and kept[r["doc_id"]]["n_chars"] in (r["n_chars"], len(found[8]))


def test_clean_documents_pass_the_filters(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    first, second = set(ids(stages[1])), set(ids(stages[2]))
    good = [i for i in first if labels.get(i) == 1]
    assert np.mean([i in second for i in good]) > 0.97


def test_equal_texts_stay_once(stages):
    texts = [r["text"] for r in stages[3].collect()]
    assert len(texts) == len(set(texts))
    assert {r["text"] for r in stages[2].collect()} >= set(texts)


def test_packed_whole(stages):
    check_pieces(stages[5].collect(), {r["doc_id"]: r["text"] for r in stages[4].collect()})


def test_run_is_the_stages(spark, stages):
    mine = corpus_pipeline.run(spark, SF)
    total = lambda df: df.agg(F.count("*"), F.sum("length"), F.sum("ids_crc32")).first()
    assert total(mine)[1] == total(stages[5])[1] and set(ids(mine)) == set(ids(stages[5]))


def test_an_empty_table(spark, stages):
    df = stages[0].where("false")
    for _, f in corpus_pipeline.STAGES:
        df = f(spark, df, SF)
    assert df.count() == 0


def test_nulls(spark):
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "many words in this text make it long enough to stay in, it seems.", None, None, None), (2, "many words in this text make it long enough to stay in, it seems.", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, f in corpus_pipeline.STAGES:
        df = f(spark, df, SF)
    assert df.count() <= 1
    assert zlib.crc32(b"") == 0


def test_long_texts_ties_and_clashing_columns(spark, stages):
    """Every stage over odd rows: a very long text, equal texts of equal and of different ids, columns called as the stages' own."""
    some = [r for r in stages[2].collect() if len(r["text"].split()) > 40][:12]
    long = " ".join(r["text"] for r in some)
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in some]
    rows += [rows[0], (10**9, rows[1][1], "en", "z", 1), (10**9 + 1, long, None, "z", len(long)), (10**9 + 2, long + " one more word", "en", None, 3), (None, rows[2][1], "en", "z", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clash = "key fp row tokens topic vector word n rank part start a b node component id band minima mean own a`b".split()
    df = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)])
    out = [df]
    for _, f in corpus_pipeline.STAGES[:-1]:
        after = f(spark, out[-1], SF)
        assert after.columns == df.columns
        out.append(after.sparkSession.createDataFrame(after.collect(), after.schema))
    kept = out[3].collect()
    texts = [r["text"] for r in kept]
    assert len(texts) == len(set(texts)) and max(map(len, texts)) > 0.9 * len(long)
    assert sum(r["text"].startswith(long[:2000]) for r in kept) == 1 and None not in [r["doc_id"] for r in kept]
    assert [r["doc_id"] for r in kept if r["text"] == rows[1][1]] == [rows[1][0]]  # of equal texts the smallest id stays
    pieces = packing.pack(out[4]).collect()
    assert sum(p["length"] for p in pieces) == sum(p["doc_tokens"] for p in pieces if p["start"] == 0)
