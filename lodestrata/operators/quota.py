"""Token buckets. Every refill fills a bucket up, so a bucket is a quota in tumbling windows from its start."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quota(events: DataFrame, most: int, refill_us: int, start_us: int | Column, user: str = "user_id", time_us: str = "ts_us", *ties: str) -> DataFrame:
    """Each event with allowed: whether it is among the first `most` of its user's window.

    Windows part a user's events, so a user with very many is no single group.
    """
    if most < 1 or refill_us < 1:
        raise ValueError("tokens and refill time must be positive")
    window = F.floor((F.col(time_us) - start_us) / refill_us)
    ranked = F.row_number().over(Window.partitionBy(user, "_window").orderBy(time_us, *ties))
    return events.withColumn("_window", window).withColumn("allowed", ranked <= most).drop("_window")


@dataclass
class TokenBucket:
    """One bucket, for single calls; times in nanoseconds."""

    most: int
    refill_s: int
    current: int
    last_ns: int

    @classmethod
    def new(cls, most: int, refill_s: int, now_ns: int) -> TokenBucket:
        if most < 1 or refill_s < 1:
            raise ValueError("tokens and refill time must be positive")
        return cls(most, refill_s, most, now_ns)

    def _refill(self, now_ns: int) -> None:
        whole = (now_ns - self.last_ns) // (self.refill_s * 10**9)
        if whole > 0:
            self.current, self.last_ns = self.most, self.last_ns + whole * self.refill_s * 10**9

    def allow(self, now_ns: int) -> bool:
        self._refill(now_ns)
        if self.current < 1:
            return False
        self.current -= 1
        return True

    def next_refill_s(self, now_ns: int) -> int:
        """Whole seconds since the last refill count."""
        return self.refill_s - (now_ns - self.last_ns) // 10**9

    def dump(self) -> bytes:
        """Four big-endian 64-bit numbers."""
        return b"".join(x.to_bytes(8, "big", signed=True) for x in (self.most, self.current, self.refill_s, self.last_ns))

    @classmethod
    def load(cls, data: bytes) -> TokenBucket:
        if len(data) != 32:
            raise ValueError("a bucket has 32 bytes")
        most, current, refill_s, last_ns = (int.from_bytes(data[k : k + 8], "big", signed=True) for k in range(0, 32, 8))
        return cls(most, refill_s, current, last_ns)
