"""Adapters of collectors: what yields raw items, as DataFrames or as a Python data source, each on its own.

An adapter is a function without arguments that returns a DataFrame of raw items. ``gathered``
runs several at once and writes what each one gives; one that raises, when it is called or
when its rows are made, leaves no rows and a failure, and the others' rows come through.

``registered`` makes a data source of two functions of the user's own, one that names pages
and one that fetches a page's items: batch (``spark.read.format``) and stream
(``spark.readStream.format``). Each page is a partition, fetched by an executor; a page that
raises, or an item that doesn't fit, becomes a row with ``error`` and the page's name. As a
stream, pages are taken in order of their names, so a page must be named after its time or
number; a batch done again after a failure fetches the same pages.

Cases: an adapter without rows is no failure; missing fields of an item are null, further ones
are dropped, and text is not guessed from other types; columns that an adapter lacks are null,
those beyond the schema are dropped; no adapters give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from inkwell.operators.dedup import table_path

#: Fields of a raw item and the Python type of each.
FIELDS = (("url", "string", str), ("title", "string", str), ("summary", "string", str), ("source_name", "string", str), ("published_at", "timestamp", datetime))
RAW = ", ".join(f"{n} {t}" for n, t, _ in FIELDS)
AT_ONCE = 8


class Failure(NamedTuple):
    """An adapter that gave no rows, and why."""

    adapter: str
    message: str


def fitting(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order; missing ones are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def gathered(spark: SparkSession, adapters: dict[str, Callable[[], DataFrame]], schema: T.StructType | str = RAW, at_once: int = AT_ONCE) -> tuple[DataFrame, list[Failure]]:
    """All adapters' rows with the name of each in ``adapter``, and the failures."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    paths = {name: table_path(spark, "adapter") for name in adapters}

    def run(name: str) -> Failure | None:
        try:
            fitting(adapters[name](), schema).write.parquet(paths[name])
        except Exception as e:  # noqa: BLE001 - an adapter is a user's code, and must not take the others with it
            return Failure(name, f"{type(e).__name__}: {(str(e).splitlines() or [''])[0]}"[:500])
        return None

    with ThreadPoolExecutor(max(1, min(at_once, len(adapters)))) as pool:
        failures = [f for f in pool.map(run, adapters) if f]
    out = spark.createDataFrame([], T.StructType([T.StructField("adapter", T.StringType()), *schema.fields]))
    for name in adapters.keys() - {f.adapter for f in failures}:
        out = out.union(spark.read.schema(schema).parquet(paths[name]).select(F.lit(name).alias("adapter"), *[f.name for f in schema]))
    return out, failures


# --- A data source of a user's functions ---------------------------------------------------------


class Page(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


def item_rows(page: str, options: dict, items: Callable[[str, dict], Iterable[dict]]) -> Iterator[tuple]:
    """Rows of a page: its items in order, and an error for an item that doesn't fit or for what the page raises."""
    nothing = (None,) * len(FIELDS)
    try:
        for pos, item in enumerate(items(page, options)):
            wrong = [n for n, _, kind in FIELDS if item.get(n) is not None and not isinstance(item[n], kind)]
            if wrong:
                yield page, pos, *nothing, f"item {pos}: wrong type of {', '.join(wrong)}"
            else:
                yield page, pos, *[item.get(n) for n, _, _ in FIELDS], None
    except Exception as e:  # noqa: BLE001 - one page must not take the others with it
        yield page, None, *nothing, f"{type(e).__name__}: {e}"[:500]


def source(name_: str, pages: Callable[[dict], Iterable[str]], items: Callable[[str, dict], Iterable[dict]]) -> type[DataSource]:
    """A data source class: ``pages(options)`` names what there is, ``items(page, options)`` fetches one."""
    fetch = item_rows  # bound here, so that a worker needs no global of this module

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = options

        def partitions(self) -> list[Page]:
            return [Page(p) for p in pages(self.options)]

        def read(self, partition: Page) -> Iterator[tuple]:
            yield from fetch(partition.name, self.options, items)

    class Stream(DataSourceStreamReader):
        def __init__(self, options: dict):
            self.options = options

        def initialOffset(self) -> dict:  # noqa: N802 - Spark's name
            return {"page": ""}

        def latestOffset(self) -> dict:  # noqa: N802
            return {"page": max(pages(self.options), default="")}

        def partitions(self, start: dict, end: dict) -> list[Page]:
            return [Page(p) for p in sorted(pages(self.options)) if start["page"] < p <= end["page"]]

        def read(self, partition: Page) -> Iterator[tuple]:
            yield from fetch(partition.name, self.options, items)

        def commit(self, end: dict) -> None:
            pass

        def stop(self) -> None:
            pass

    class Items(DataSource):
        @classmethod
        def name(cls) -> str:
            return name_

        def schema(self) -> str:
            return f"page string, pos int, {RAW}, error string"

        def reader(self, schema: T.StructType) -> Reader:
            return Reader(dict(self.options))

        def streamReader(self, schema: T.StructType) -> Stream:  # noqa: N802
            return Stream(dict(self.options))

    return Items


def registered(spark: SparkSession, name: str, pages: Callable[[dict], Iterable[str]], items: Callable[[str, dict], Iterable[dict]]) -> None:
    """Make ``spark.read.format(name)`` and ``spark.readStream.format(name)`` fetch with these functions."""
    spark.dataSource.register(source(name, pages, items))
