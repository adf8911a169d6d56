"""Exact dedup by content-defined chunk recipes, in DataFrame functions alone.

A text is cut at places that its own content defines (a sentence or line end, failing that white space, after a least
length and before a greatest), so equal passages give equal chunks wherever they stand. Each chunk has an identifier of
two 64-bit hashes. Every distinct chunk is moved once, after map-side combining, to verify that no two chunks share an
identifier; a text is from then on its recipe, the ordered list of identifiers, and equality of texts is equality of
recipes. Long texts are not moved again: of the documents, only those to be dropped (and those few that a bitmap takes
for them) are looked up. Should two identifiers ever collide, recipes list the chunks themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import col, marked, nested, row_hash, stored, unnested

#: Characters of a chunk: least and greatest.
LEAST, GREATEST = 256, 8192
CUT = r"[\n.!?。](?=\s)"
CHUNK = rf"(?s).{{{LEAST},{GREATEST}}}?(?:(?<={CUT})|\z)|.{{{LEAST},{GREATEST}}}?(?<=\s)|.{{1,{GREATEST}}}"


def chunks(text: Column) -> Column:
    """The chunks of a text, in order; their concatenation is the text. An empty text has none."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def _identifiers(x: str = "c") -> str:
    """SQL: the two hashes of a chunk, the second under another seed."""
    return f"array(xxhash64({x}), xxhash64(1L, {x}))"


def recipes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (k, sha, recipe) of all rows: ordered identifiers of verified chunks, and the text's SHA-256."""
    rows = docs.select(col(docs, key).alias("k"), F.coalesce(col(docs, text), F.lit("")).alias("body"))
    cut = rows.select(F.explode(chunks(F.col("body"))).alias("c"))
    # identifiers that stand for more than one chunk: each distinct chunk is compared once
    distinct = cut.select(F.expr(f"{_identifiers()}").alias("id"), "c").groupBy("id", "c").agg(F.lit(1).alias("one"))
    collided = distinct.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    verified = collided.limit(1).count() == 0
    listed = F.expr(f"flatten(transform(chunks, c -> {_identifiers()}))") if verified else F.col("chunks")
    return rows.withColumn("chunks", chunks(F.col("body"))).select("k", F.sha2("body", 256).alias("sha"), listed.alias("recipe"))


def _decided(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """Rows (k, sha, copies, keep, size): each key and text with how often it comes, and its group's keeper and size."""
    rows = stored(recipes(docs, key, text_col).groupBy("k", "sha", "recipe").agg(F.count(F.lit(1)).alias("copies")))
    several = rows.groupBy("recipe").agg(F.max("k").alias("keep"), F.sum("copies").alias("size"), F.count(F.lit(1)).alias("n")).filter("size > 1")
    # by a key of its own, so that both sides are dealt anew and a hot recipe can be split
    several = several.select(F.xxhash64("recipe").alias("h"), F.col("recipe").alias("r"), "keep", "size")
    joined = rows.withColumn("g", F.xxhash64("recipe")).join(several, (F.col("g") == F.col("h")) & (F.col("recipe") == F.col("r")), "left")
    keep, size = F.when(F.col("size").isNull(), F.col("k")).otherwise(F.col("keep")), F.coalesce("size", F.lit(1)).cast("long")
    return joined.select("k", "sha", "copies", keep.alias("keep"), size.alias("size"))


def groups(docs: DataFrame, key: str = "doc_id", *, text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, keep_id (the largest key among equal texts), group_size, kept, text_sha256.

    A null text counts as empty. Rows that agree in key and text are copies too: one of them has ``kept``. A null key is
    smaller than any other. An empty table gives an empty result. Other columns of ``docs`` may have any name.
    """
    each = _decided(docs, key, text_col).select("k", "sha", "keep", "size", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    kept = F.col("k").eqNullSafe(F.col("keep")) & (F.col("copy") == 1)
    return each.select(F.col("k").alias(key), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, key: str = "doc_id", *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are: of equal texts the row with the largest key.

    A null text counts as empty, a null key is smaller than any other, an empty table stays empty. Of rows that agree in
    key and text, the one with the smallest hash of all its columns stays. Rows that a bitmap of what is to be dropped
    doesn't mark are passed on where they are; only marked ones are moved, and told apart by key and digest.
    """
    decided = stored(_decided(docs, key, text_col))
    hashed = lambda k, sha: F.xxhash64(k, sha)
    gone = decided.filter(~F.col("k").eqNullSafe(F.col("keep")))
    looked_up = stored(decided.filter(~F.col("k").eqNullSafe(F.col("keep")) | (F.col("copies") > 1)).select(hashed("k", "sha").alias("h")))
    body, k = F.coalesce(col(docs, text_col), F.lit("")), col(docs, key)
    rows = marked(nested(docs, k=k, sha=F.sha2(body, 256), order=row_hash(docs)).withColumn("h", hashed("k", "sha")), looked_up)
    gone = gone.select(hashed("k", "sha").alias("g"), F.col("k").alias("l"), F.col("sha").alias("t"))
    doubtful = rows.filter("maybe").join(gone, (F.col("h") == F.col("g")) & F.col("k").eqNullSafe(F.col("l")) & (F.col("sha") == F.col("t")), "left_anti")
    stay = doubtful.groupBy("k", "sha").agg(F.min_by("row", "order").alias("row"))
    return unnested(rows.filter("not maybe").select("row").unionByName(stay.select("row")), docs.columns)
