"""Tables behind an interface that gives pages: planned from the total, read in parallel, whole or not at all."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: (offset, limit) -> rows, in an order that doesn't change between calls.
Page = Callable[[int, int], Sequence[tuple]]


class ShortPage(RuntimeError):
    """A page has other rows than were planned; the scan fails instead of giving part of a table."""


@dataclass
class Pages(InputPartition):
    offsets: list[int]


class PagedReader(DataSourceReader):
    def __init__(self, page: Page, total: Callable[[], int], size: int, pages_a_task: int):
        self.page, self.total, self.size, self.pages_a_task = page, total, size, pages_a_task
        self.rows = total()

    def partitions(self) -> list[Pages]:
        offsets = list(range(0, self.rows, self.size))
        return [Pages(offsets[k : k + self.pages_a_task]) for k in range(0, len(offsets), self.pages_a_task)] or [Pages([])]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for offset in partition.offsets:
            rows, due = self.page(offset, self.size), min(self.size, self.rows - offset)
            if len(rows) != due:
                raise ShortPage(f"{len(rows)} rows at {offset}, {due} planned")
            yield from rows


def read_pages(spark: SparkSession, page: Page, total: Callable[[], int], schema: str | StructType, size: int = 1000, pages_a_task: int = 8) -> DataFrame:
    """All rows of a paged table. `total` is asked once, on planning; each task fetches some pages.

    page and total are shipped to Python workers. An empty table has no rows; a page that is shorter
    or longer than planned is an error.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return "waymark_pages"

        def schema(self) -> str | StructType:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return PagedReader(page, total, size, pages_a_task)

    spark.dataSource.register(Paged)
    return spark.read.format("waymark_pages").load()
