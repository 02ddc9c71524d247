"""Line dedup by spread over sites: boilerplate lines are those found on many distinct sites.

A HyperLogLog sketch of the sites of each line hash is built and merged by aggregation, so a line's copies never meet in
one task. Estimates clear of the threshold decide; lines near it get an exact count of distinct sites. Everything is
DataFrame functions.

Lines are split at newlines and compared after trimming blanks, tabs and carriage returns. Cases: lines empty after
trimming are never counted nor removed; a null text stays null, an empty one empty; a text of boilerplate only becomes
empty; a null site counts as the empty site; repeated rows add nothing to a spread and are cleaned alike; an empty table
gives an empty one. Other columns are kept as they are; names of this module's own start with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import stage

#: Sites on which a line is boilerplate.
MIN_SITES = 10
#: log2 of a sketch's buckets: the standard error is 1.04 / sqrt(4096), 1.6 %.
LOG_BUCKETS = 12
#: Estimates within this share of the threshold, five standard errors, or within one site, are counted exactly.
NEAR = 0.08
#: Copies of the few spread lines, over which a hot line's occurrences are dealt in joins.
SALTS = 32
#: Texts copied over several sites whose keys (some 50 bytes each) are sent to every executor at most; more of them are joined by a shuffle.
BROADCAST_COPIES = 200_000


def trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r"))


def line_key(line: Column) -> Column:
    """Two hashes of a trimmed line, so that different lines don't meet in any collection."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def line_rows(docs: DataFrame, site_col: str, text_col: str, row_key: Column) -> DataFrame:
    """A row for each non-empty line of each document: __row, __site, __line (its line_key), __salt."""
    return (
        docs.select(row_key.alias("__row"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("__site"), F.explode(F.split(text_col, "\n")).alias("__text"))
        .select("__row", "__site", trimmed(F.col("__text")).alias("__text"))
        .where("__text <> ''")
        .select("__row", "__site", line_key(F.col("__text")).alias("__line"), F.pmod(F.xxhash64("__row"), F.lit(SALTS)).alias("__salt"))
    )


def salted(lines: DataFrame) -> DataFrame:
    return lines.select("__line", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("__salt"))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes of the lines found on at least min_sites distinct sites."""
    near = max(1, round(NEAR * min_sites))
    sketched = (
        lines.groupBy("__line")
        .agg(F.hll_sketch_agg("__site", LOG_BUCKETS).alias("__sketch"))
        .select("__line", F.hll_sketch_estimate("__sketch").alias("__sites"))
        .where(F.col("__sites") >= min_sites - near)
    )
    clear = sketched.where(F.col("__sites") > min_sites + near).select("__line")
    unsure = sketched.where(F.col("__sites") <= min_sites + near)
    counted = (
        lines.join(salted(unsure), ["__line", "__salt"], "left_semi")
        .select("__line", "__site")
        .distinct()
        .groupBy("__line")
        .agg(F.count("*").alias("__exact"))
        .where(F.col("__exact") >= min_sites)
        .select("__line")
    )
    return clear.unionByName(counted)


def sites_of_texts(docs: DataFrame, id_col: str, site_col: str, text_col: str) -> DataFrame:
    """docs with the least site among a text's copies in place of their own, so that copies of a text add one site to a line."""
    site = F.coalesce(F.col(site_col).cast("string"), F.lit(""))
    rows = docs.select(F.md5(text_col).alias("__text_key"), site.alias("__own"), F.pmod(F.xxhash64(id_col), F.lit(SALTS)).alias("__salt"), *docs.columns)
    copied = stage(rows.groupBy("__text_key").agg(F.min("__own").alias("__first"), F.max("__own").alias("__last")).where("__first < __last").select("__text_key", "__first"), "copied-texts")
    if copied.count() <= BROADCAST_COPIES:
        found = rows.join(F.broadcast(copied), "__text_key", "left")
    else:
        dealt = copied.select("__text_key", "__first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("__salt"))
        found = rows.join(dealt, ["__text_key", "__salt"], "left")
    return found.withColumn(site_col, F.coalesce("__first", "__own")).select(*docs.columns)


def remove_spread_lines(docs: DataFrame, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES, copies_count: bool = True) -> DataFrame:
    """docs with spread lines cut out of the text, and __n_lines (non-empty lines before) and __n_removed beside.

    Without copies_count, a text's copies count as one document on the least of their sites, so a text that is only copied
    as a whole, over however many sites, keeps its lines.
    """
    row_key = F.xxhash64(id_col, text_col)
    lines = line_rows(docs, site_col, text_col, row_key)
    counted = lines if copies_count else line_rows(sites_of_texts(docs.select(id_col, site_col, text_col), id_col, site_col, text_col), site_col, text_col, row_key)
    found = lines.join(salted(spread_lines(counted, min_sites)), ["__line", "__salt"]).groupBy("__row").agg(F.collect_set("__line").alias("__spread"))
    split = F.split(text_col, "\n")
    kept = F.filter(split, lambda x: ~F.array_contains("__spread", line_key(trimmed(x))) | (trimmed(x) == ""))
    lines_in = lambda x: F.coalesce(F.size(F.filter(x, lambda y: trimmed(y) != "")), F.lit(0))
    return (
        docs.withColumn("__row", row_key)
        .join(found, "__row", "left")
        .withColumn("__n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(lines_in(split)))
        .withColumn("__n_removed", F.when(F.col("__spread").isNull(), 0).otherwise(F.col("__n_lines") - lines_in(kept)))
        .withColumn(text_col, F.when(F.col("__spread").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))
        .drop("__row", "__spread")
    )


def line_digest(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Per document: lines, lines removed, and the length and MD5 of what is kept."""
    return remove_spread_lines(docs.select("doc_id", "source", "text"), min_sites=min_sites).select(
        "doc_id", F.col("__n_lines").cast("long").alias("n_lines"), F.col("__n_removed").cast("long").alias("n_removed"), F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5")
    )


SQL = f"""
WITH lines AS (
  SELECT source, trim(unnest(string_split(text, chr(10))), chr(32) || chr(9) || chr(13)) AS line FROM documents),
spread AS (
  SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce(source, '')) >= {MIN_SITES}),
gone AS (SELECT coalesce(list(line), []) AS lines FROM spread),
split AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS parts, lines FROM documents, gone),
cut AS (
  SELECT doc_id, text, parts,
    array_to_string(list_filter(parts, lambda x: NOT list_contains(lines, trim(x, chr(32) || chr(9) || chr(13)))), chr(10)) AS kept,
    list_filter(parts, lambda x: trim(x, chr(32) || chr(9) || chr(13)) <> '') AS full_parts,
    list_filter(parts, lambda x: list_contains(lines, trim(x, chr(32) || chr(9) || chr(13)))) AS lost
  FROM split)
SELECT doc_id, CAST(coalesce(len(full_parts), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lost), 0) AS BIGINT) AS n_removed,
  CAST(length(CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END) AS BIGINT) AS kept_chars,
  md5(CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END) AS kept_md5
FROM cut
"""
