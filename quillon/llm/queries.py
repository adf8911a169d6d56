"""The queries of this subpackage, over whole tables and with production parameters, and their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe_tree, exact_dedup, html_text, langid_ppm, licenses, mixing, quality, sharding, simhash, warc_zip
from quillon.llm.common import read_table as _read, small_batches

VOCABULARY = "byte_bpe_50k.tiktoken"
SHARDS = [f"shard-{i:03d}" for i in range(sharding.SHARDS)]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _read(small_batches(spark), sf_dir, name)


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    rows = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    sample = langid_ppm.training_sample(rows.filter(~F.col("held_out")))
    return langid_ppm.identify(rows, langid_ppm.fit(sample), keep=["doc_id", "held_out"])


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read_table(spark, sf_dir, "documents"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(read_table(spark, sf_dir, "documents"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.token_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(read_table(spark, sf_dir, "pages"))


def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(read_table(spark, sf_dir, "documents"))


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.cluster(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": html_extraction,
    "op2_language_id": language_id,
    "op3_source_mix": source_mix,
    "op4_quality_rules": quality_rules,
    "op5_license_scan": license_scan,
    "op6_byte_bpe": byte_bpe,
    "op7_warc": warc,
    "op8_exact_dedup": dedup,
    "op9_simhash": near_dedup,
    "op10_sharding": shard,
}

_BASE32 = "list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda i: list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * i, 5))::INTEGER >> s) & 31), 1)))"

ORACLE_SQL: dict[str, str] = {
    "op7_warc": f"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS h FROM p),
        k AS (SELECT page_id, payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS keeper FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string(flatten({_BASE32}), '') AS payload_digest,
               CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to
        FROM k""",
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op10_sharding": f"""
        WITH filled AS (SELECT string_split('{",".join(map(str, sharding.fill_table(SHARDS)))}', ',') AS t),
        placed AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {sharding.SLOTS} AS INTEGER) AS slot FROM documents)
        SELECT doc_id, slot, CAST(t[slot + 1] AS INTEGER) AS shard FROM placed, filled""",
}


def _quality_sql() -> str:
    """The base measures, sketches, fences and verdicts of quality.judged."""
    levels = ", ".join(f"('{name}', {up}, {'NULL' if down is None else down}, {spread})" for name, up, down, spread in quality.MEASURES)

    def fences(name: str, groups: str) -> str:
        """SQL: the fences of each group's sketch by itself."""
        by = f"PARTITION BY {groups}measure"
        at = lambda percent: f"min(v) FILTER (WHERE upto * 100 >= n_rows * {percent})"
        return f"""{name}_ranked AS (SELECT {groups}measure, v, sum(n) OVER ({by} ORDER BY v ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER ({by}) AS n_rows
            FROM (SELECT {groups}measure, v, sum(n) AS n FROM counted GROUP BY {groups}measure, v)),
        {name}_found AS (SELECT {groups}r.measure, any_value(spread) AS spread, max(n_rows) AS n_rows, {at("down")} AS down, {at("50")} AS middle, {at("up")} AS up FROM {name}_ranked r JOIN levels m ON r.measure = m.measure GROUP BY {groups}r.measure),
        {name} AS (SELECT {groups}measure, CAST(n_rows AS DOUBLE) AS n_rows, down - spread * greatest(middle - down, 1) AS low, up + spread * greatest(up - middle, 1) AS high FROM {name}_found)"""

    drawn = lambda own, rows, to: f"(({own}) * {rows} + ({to}) * {quality.PRIOR}) / ({rows} + {quality.PRIOR})"
    blend = lambda x: drawn(f"g.{x}", "g.n_rows", drawn(f"l.{x}", "l.n_rows", f"a.{x}"))
    return rf"""
        WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
        s AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
        windows AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM s WHERE len(ws) > 7),
        shingles AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS w FROM windows),
        twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM shingles),
        covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS i FROM twice WHERE n > 1),
        repeats AS (SELECT doc_id, count(*) AS n_repeat_words FROM covered GROUP BY doc_id),
        base AS (SELECT s.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
            CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
            CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines FROM s LEFT JOIN repeats ON s.doc_id = repeats.doc_id),
        judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
        long AS (SELECT doc_id, lang, source, base_failed, unnest(['symbols', 'repeats', 'dup_lines', 'word_len']) AS measure,
            unnest([n_symbols * 1000 // greatest(n_words, 1), n_repeat_words * 1000 // greatest(n_words, 1), n_dup_lines * 1000 // greatest(n_lines, 1), word_chars * 100 // greatest(n_words, 1)]) AS x FROM judged),
        sketch AS (SELECT doc_id, lang, source, base_failed, measure, x - x % CAST(2 ** greatest(0, length(bin(x)) - 7) AS BIGINT) AS v FROM long),
        counted AS (SELECT lang, source, measure, v, count(*) AS n FROM sketch WHERE NOT base_failed GROUP BY lang, source, measure, v),
        levels(measure, up, down, spread) AS (VALUES {levels}),
        {fences("own", "lang, source, ")}, {fences("by_lang", "lang, ")}, {fences("overall", "")},
        fences AS (SELECT g.lang, g.source, g.measure, {blend("low")} AS low, {blend("high")} AS high
            FROM own g JOIN by_lang l ON g.lang IS NOT DISTINCT FROM l.lang AND g.measure = l.measure JOIN overall a ON g.measure = a.measure),
        bad AS (SELECT DISTINCT doc_id FROM sketch x JOIN fences f ON x.lang IS NOT DISTINCT FROM f.lang AND x.source IS NOT DISTINCT FROM f.source AND x.measure = f.measure WHERE v < low OR v > high)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM judged"""


ORACLE_SQL["op4_quality_rules"] = _quality_sql()
