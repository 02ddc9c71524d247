"""Finding texts by an index of their trigrams.

The index holds a row for each document and each run of three characters that it has, in lower case, once (documents of one
id may share runs; a search counts each once). Rows are dealt
into folders by a hash of the trigram and sorted within, so that a search reads the folders of its own trigrams only, and
of these the row groups that can hold them. Documents that have all trigrams of what is sought are candidates; their texts
are then searched, so the answer is that of a search of all texts.

Cases: null texts are never found; a text sought of fewer than three characters is sought in all texts; an empty one is in
every text; repeated ids are documents of one id, of which each is searched; other columns of docs are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of an index.
FOLDERS = 64
GRAM = 3


def folder_of(gram: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(folders)).cast("int")


def build_index(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", folders: int = FOLDERS) -> None:
    """Write the index of docs (id, text) at a path."""
    low = F.lower(text_col)
    # each place looks ahead, so runs overlap, and a text is read once
    grams = F.array_distinct(F.regexp_extract_all(low, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))
    rows = docs.where(F.length(low) >= GRAM).select(F.col(id_col).alias("id"), F.explode(grams).alias("gram"))
    # a gram that all documents have is dealt to many tasks by document
    dealt = rows.withColumn("folder", folder_of(F.col("gram"), folders)).repartition("folder", F.pmod(F.xxhash64("id"), F.lit(16)))
    dealt.sortWithinPartitions("folder", "gram", "id").write.partitionBy("folder").option("compression", "zstd").parquet(path)


def grams_of(needle: str) -> list[str]:
    low = needle.lower()
    return sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})


def candidates(spark: SparkSession, path: str, needle: str, folders: int = FOLDERS) -> DataFrame:
    """id of the documents that have all trigrams of a text of three characters or more."""
    grams = grams_of(needle)
    numbers = [r.n for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(folder_of(F.col("gram"), folders).alias("n")).distinct().collect()]
    rows = spark.read.schema("id long, gram string, folder int").parquet(path).where(F.col("folder").isin(numbers) & F.col("gram").isin(grams))
    return rows.groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("id")


def find(docs: DataFrame, path: str, needle: str, text_col: str = "text", id_col: str = "doc_id", folders: int = FOLDERS) -> DataFrame:
    """docs that hold a text, whatever its case, with the place of the first hit (from 1) and how many there are.

    Only candidates of the index at path are searched.
    """
    low, wanted = F.lower(text_col), needle.lower()
    some = docs
    if len(wanted) >= GRAM:
        found = candidates(docs.sparkSession, path, needle, folders).withColumnRenamed("id", "__id")
        some = docs.join(found, F.col(id_col) == F.col("__id"), "left_semi")
    hits = (F.length(low) - F.length(F.replace(low, F.lit(wanted), F.lit("")))) / max(1, len(wanted))
    return some.where(low.contains(wanted)).withColumn("first_at", F.instr(low, wanted)).withColumn("hits", F.floor(hits).cast("long"))


def find_any(docs: DataFrame, path: str, needles: list[str], **columns: str) -> DataFrame:
    """find for several texts at once, with the text as needle: one reading of the index for each."""
    return reduce(DataFrame.unionByName, [find(docs, path, x, **columns).withColumn("needle", F.lit(x)) for x in needles])
