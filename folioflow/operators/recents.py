"""Recently opened documents: stamps joined to files, sections and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recents_sections(seen: DataFrame, stamps: DataFrame, now: Column, temp: str = "/tmp/") -> DataFrame:
    """path, section, label, arrival_ord of seen (path, mtime, arrival_ord, file_exists), with the stamps' times first.

    now may be a scalar subquery. The order of arrival is kept; files that are gone or temporary are left out.
    """
    at = now
    shown = seen.where(F.col("file_exists") & ~F.startswith("path", F.lit(temp))).join(stamps, "path", "left").withColumn("at", F.coalesce("opened", "mtime"))
    today = F.coalesce(F.to_date("at") == F.to_date(at), F.lit(False))
    return shown.select("path", F.when(today, "Today").otherwise("Earlier").alias("section"), opened_label(F.col("at"), at).alias("label"), "arrival_ord")


def opened_label(t: Column, now: Column) -> Column:
    """The time today, Yesterday, the day this year, or the whole date."""
    return (
        F.when(F.to_date(t) == F.to_date(now), F.date_format(t, "HH:mm"))
        .when(F.to_date(t) == F.date_sub(F.to_date(now), 1), "Yesterday")
        .when(F.year(t) == F.year(now), F.concat(F.date_format(t, "MM"), F.lit("-"), F.date_format(t, "dd")))
        .otherwise(F.date_format(t, "yyyy-MM-dd"))
    )


def known_paths(recents: DataFrame, opened: DataFrame) -> DataFrame:
    """path: what the system knows and what was just opened, each once."""
    return recents.select("path").union(opened.select("path")).distinct()


def pruned_stamps(stamps: DataFrame, seen: DataFrame) -> DataFrame:
    return stamps.join(seen.select("path").distinct(), "path", "left_semi")
