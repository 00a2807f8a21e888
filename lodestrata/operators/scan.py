"""Reads: point, range, prefix, pages and iterators."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..schema import RESERVED, check_prefix
from .resolve import live

PAGE_SIZE = 10


def with_key(log: DataFrame, key: str) -> DataFrame:
    return log.where(F.col("key") == key)


def with_range(log: DataFrame, start: str, end: str) -> DataFrame:
    """Both ends inclusive, by bytes; nothing where end < start."""
    return log.where(F.col("key").between(start, end))


def with_prefix(log: DataFrame, prefix: str) -> DataFrame:
    """The empty prefix has all keys."""
    return log.where(F.col("key").startswith(prefix)) if prefix else log


def visible(log: DataFrame) -> DataFrame:
    return log.where(F.col("key") != RESERVED)


def point_get(log: DataFrame, key: str) -> DataFrame:
    """The live version of a key: one row, or none if it is missing or deleted."""
    return live(with_key(log, key))


def range_scan(log: DataFrame, start: str, end: str) -> DataFrame:
    """Live rows of a range, unordered; pages and iterators order them."""
    return live(with_range(visible(log), start, end))


def prefix_scan(log: DataFrame, prefix: str) -> DataFrame:
    return live(with_prefix(visible(log), check_prefix(prefix)))


@dataclass
class ScanResult:
    """A page of rows by key. Counts are taken when asked for."""

    rows: DataFrame
    page_number: int = 1
    page_size: int = PAGE_SIZE

    def __post_init__(self) -> None:
        self.page_number = max(1, self.page_number)
        self.page_size = self.page_size if self.page_size >= 1 else PAGE_SIZE

    @property
    def records(self) -> DataFrame:
        """Planned as one ordered limit with an offset; a page past the end is empty."""
        return self.rows.orderBy("key").offset((self.page_number - 1) * self.page_size).limit(self.page_size)

    @cached_property
    def total_count(self) -> int:
        return self.rows.count()

    @property
    def total_pages(self) -> int:
        return -(-self.total_count // self.page_size)

    @property
    def has_more(self) -> bool:
        return self.page_number * self.page_size < self.total_count

    def next(self) -> ScanResult:
        return self._at(self.page_number + 1) if self.has_more else self

    def previous(self) -> ScanResult:
        return self._at(self.page_number - 1)

    def _at(self, page: int) -> ScanResult:
        made = ScanResult(self.rows, page, self.page_size)
        if "total_count" in self.__dict__:
            made.__dict__["total_count"] = self.total_count
        return made


def page_summary(rows: DataFrame, page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """total_count, total_pages and has_more as one row."""
    at = ScanResult(rows, page, size)
    total = rows.agg(F.count(F.lit(1)).alias("total_count"))
    return total.select(
        "total_count",
        F.ceil(F.col("total_count") / at.page_size).alias("total_pages"),
        F.lit(at.page_number).cast("long").alias("page_number"),
        F.lit(at.page_size).cast("long").alias("page_size"),
        (F.col("total_count") > at.page_number * at.page_size).alias("has_more"),
    )


class KeyIterator:
    """Rows by key, fetched a partition at a time. After stop() there are none, and reset() does nothing."""

    def __init__(self, rows: DataFrame) -> None:
        self._rows, self._now, self._stopped = rows.orderBy("key"), None, False
        self._it: Iterator[Row] | None = None

    def next(self) -> bool:
        """Move on; False at the end."""
        if self._stopped:
            return False
        if self._it is None:
            self._it = self._rows.toLocalIterator()
        self._now = next(self._it, None)
        return self._now is not None

    @property
    def key(self) -> str:
        return self._now["key"] if self._now is not None else ""

    @property
    def value(self) -> bytes | None:
        return self._now["value"] if self._now is not None else None

    @property
    def tombstone(self) -> bool:
        return bool(self._now["tombstone"]) if self._now is not None else False

    def reset(self) -> None:
        if not self._stopped:
            self._it = self._now = None

    def stop(self) -> None:
        self._stopped, self._it, self._now = True, None, None

    def __iter__(self) -> Iterator[Row]:
        while self.next():
            yield self._now
