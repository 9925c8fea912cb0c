"""The queries of the training-data operators, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import langid, linerules, media, mixing, packing, sharding, simhash, suffixtree, warc, weaklabels
from tidewater.llm.common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return weaklabels.classify(docs, weaklabels.learn(docs))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicated(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dimensions = [sharding.Dimension(n) for n in ("source", "lang", "n_chars")]
    return sharding.hilbert_shards(table(spark, sf_dir, "documents"), dimensions)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linerules.judge(table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_predictions(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "spans")


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.scored(table(spark, sf_dir, "documents"))


_all = (op1_quality_classifier, op2_simhash, op3_warc, op4_sharding, op5_quality_rules, op6_media, op7_mixing, op8_packing, op9_language, op10_suffix_tree)
QUERIES = {f.__name__: f for f in _all}
#: Line rules of op5 as conditions on a line's words ws, their number n and their characters c.
_failed = f"""(2 * len(list_filter(ws, lambda w: regexp_matches(w, '[#*$%&<>^~=_]{{2,}}|[!?]{{2,}}'))) > n
    OR (n >= 5 AND NOT regexp_matches(line, '\\p{{Ll}}') AND regexp_matches(line, '\\p{{Lu}}'))
    OR 3 * len(regexp_extract_all(line, '[#*$%&|<>]')) > c
    OR (len(list_filter(ws, lambda w: w IN ({', '.join(repr(x) for x in sorted(linerules.SEPARATORS))}))) >= greatest(3, n / 5))
    OR (n >= 3 AND len(list_filter(ws, lambda w: regexp_full_match(w, '(https?://|www\\.)\\S+|\\[[^\\]]*\\]\\([^)]*\\)'))) = n)
    OR regexp_matches(lower(line), '{'|'.join(linerules.BOILERPLATE).replace("'", "''")}'))"""
#: Cells of op4's dimensions: how many of a dimension's cut points are at or below a value.
_cells = """{name}_cells AS (SELECT v, sum(CASE WHEN before > 0 AND (before * 32 + t - 1) // t < ((before + n) * 32 + t - 1) // t THEN 1 ELSE 0 END) OVER (ORDER BY v)::BIGINT AS cell
    FROM (SELECT v, n, (sum(n) OVER (ORDER BY v) - n)::BIGINT AS before, (sum(n) OVER ())::BIGINT AS t FROM (SELECT {name} AS v, count(*) AS n FROM documents WHERE {name} IS NOT NULL GROUP BY 1)))"""


def _hilbert() -> str:
    """The tables h0 ... of coordinates x0, x1, x2 turned step by step, each from the one before, and last the index."""
    steps, at = [], 0
    for q in (16, 8, 4, 2):
        for i in range(3):
            held, swap = f"x{i} & {q} <> 0", f"xor(x0, x{i}) & {q - 1}"
            new = [f"CASE WHEN {held} THEN xor(x0, {q - 1}) ELSE xor(x0, {swap}) END AS x0"]
            new += [f"CASE WHEN {held} THEN x{k} ELSE xor(x{k}, {swap}) END AS x{k}" if k == i else f"x{k}" for k in (1, 2)]
            steps.append(f"h{at + 1} AS (SELECT id, doc_id, size, crc, {', '.join(new)} FROM h{at})")
            at += 1
    steps.append(f"g AS (SELECT id, doc_id, size, crc, x0, xor(x0, x1) AS x1, xor(xor(x0, x1), x2) AS x2 FROM h{at})")
    turn = "0"
    for q in (16, 8, 4, 2):
        turn = f"xor({turn}, CASE WHEN x2 & {q} <> 0 THEN {q - 1} ELSE 0 END)"
    steps.append(f"t AS (SELECT id, doc_id, size, crc, xor(x0, {turn}) AS x0, xor(x1, {turn}) AS x1, xor(x2, {turn}) AS x2 FROM g)")
    index = " + ".join(f"((x{i} >> {b}) & 1) * {1 << (3 * b + 2 - i)}" for b in range(5) for i in range(3))
    return ",\n        ".join([*steps, f"curve AS (SELECT id, doc_id, size, crc, ({index})::BIGINT AS curve FROM t)"])


#: CRC-32 of a text's bytes, by a table of its own.
_crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: ('0x' || b)::BIGINT)), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"
ORACLE_SQL: dict[str, str] = {
    "op4_sharding": f"""
        WITH tbl AS (SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
        {', '.join(_cells.format(name=n) for n in ('source', 'lang', 'n_chars'))},
        h0 AS (SELECT row_number() OVER () AS id, doc_id, strlen(coalesce(text, '')) + 1 AS size, {_crc} AS crc, coalesce(a.cell, 0) AS x0, coalesce(b.cell, 0) AS x1, coalesce(c.cell, 0) AS x2
            FROM documents d CROSS JOIN tbl LEFT JOIN source_cells a ON d.source = a.v LEFT JOIN lang_cells b ON d.lang = b.v LEFT JOIN n_chars_cells c ON d.n_chars = c.v),
        {_hilbert()},
        r AS (SELECT *, row_number() OVER (ORDER BY curve, crc, doc_id NULLS FIRST, size) - 1 AS rank, count(*) OVER () AS total FROM curve),
        s AS (SELECT *, rank * 16 // total AS shard FROM r)
        SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, curve, 'rows' AS law, shard::INTEGER AS shard, (rank - (shard * total + 15) // 16)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM s""",
    "op5_quality_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 4), ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 5)),
        repeats AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
        covered AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM repeats, range(5) r(j) GROUP BY doc_id),
        lines AS (SELECT doc_id, line, ws, len(ws) AS n, list_sum(list_transform(ws, lambda w: length(w))) AS c
            FROM (SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)) WHERE len(ws) > 0),
        judged AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (WHERE failed) AS n_removed_lines, coalesce(sum(c) FILTER (WHERE failed), 0) AS lost
            FROM (SELECT doc_id, line, c, {_failed} AS failed FROM lines) GROUP BY doc_id),
        base AS (SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
            coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(lost, 0) AS lost
            FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN judged USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
            NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost <= {linerules.LOST} * word_chars AS kept, n_removed_lines FROM base""",
    "op3_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS largest FROM pages)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 1000 AND largest IS NOT NULL AND page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to
        FROM p""",
}
