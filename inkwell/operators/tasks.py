"""Collection tasks: from sources to tasks, and from fetched pages to materials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tasks_of(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """Tasks that copy their source's fields; ``error`` where the source is unknown."""
    s = sources.select(F.col("id").alias("source_id"), "name", "type", F.col("note").alias("_note"))
    out = requests.join(s, "source_id", "left")
    goal = F.coalesce(F.nullif(F.trim("_note"), F.lit("")), F.concat(F.lit("collect "), F.col("name")))
    return out.withColumn("goal", goal).withColumn("error", F.when(F.col("name").isNull(), "unknown source")).drop("_note")


def materials_of(tasks: DataFrame, fetched: DataFrame, most: int = 120) -> DataFrame:
    """Each task (task_id, url, name, type) with its fetched page (url, title, content, error): a material and the task's new status.

    A page that wasn't fetched or has no text fails its task, and its material is empty.
    """
    pages = fetched.select("url", "title", "content", F.col("error").alias("_error"), F.lit(True).alias("_there"))
    out = tasks.join(pages, "url", "left")
    error = F.when(F.col("_there").isNull(), "not fetched").otherwise(F.col("_error"))
    good = error.isNull()
    return out.select(
        "task_id", "url", F.col("name").alias("source_name"), F.col("type").alias("source_type"),
        F.when(good, F.col("title")).alias("title"), F.when(good, F.col("content")).alias("content"), F.when(good, F.substring("content", 1, most)).alias("summary"),
        F.when(good, "done").otherwise("failed").alias("status"), error.alias("error"),
    )
