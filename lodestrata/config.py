"""Settings by section. A section with improper values falls back to its defaults, and is told.

The names of sections and settings and their defaults are fixed values: configuration files have them.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any


@dataclass
class BufferPool:
    MaxSize: int = 8
    BlockSize: int = 4

    def holds(self) -> bool:
        return self.MaxSize > 0 and self.BlockSize in (4, 8, 16)


@dataclass
class Cache:
    MaxSize: int = 20

    def holds(self) -> bool:
        return self.MaxSize > 0


@dataclass
class Memtable:
    MaxCount: int = 2
    Type: str = "hashmap"
    MaxSizeBytes: int = 100
    MaxSizeEntries: int = 100
    BPlusTreeDegree: int = 0
    SkipListMaxHeight: int = 0

    def holds(self) -> bool:
        shape = {"hashmap": True, "skip_list": self.SkipListMaxHeight > 0, "b_plus_tree": self.BPlusTreeDegree >= 2}
        return self.MaxCount >= 1 and shape.get(self.Type, False)

    def full(self, writes: int) -> bool:
        """With a limit in bytes a write counts as 100 of them and the limit of entries plays no part."""
        return writes * 100 >= self.MaxSizeBytes if self.MaxSizeBytes > 0 else writes >= self.MaxSizeEntries

    @property
    def capacity(self) -> int:
        """Writes that fill an instance."""
        return max(1, -(-self.MaxSizeBytes // 100) if self.MaxSizeBytes > 0 else self.MaxSizeEntries)


@dataclass
class TokenBucket:
    MaxNumTokens: int = 3
    RefillTime: int = 60

    def holds(self) -> bool:
        return self.MaxNumTokens > 0 and self.RefillTime > 0


@dataclass
class SSTable:
    SummaryInterval: int = 40
    MultipleFiles: bool = False

    def holds(self) -> bool:
        return self.SummaryInterval > 0


@dataclass
class WriteAheadLog:
    SegmentSize: int = 16

    def holds(self) -> bool:
        return self.SegmentSize > 0


@dataclass
class Levels:
    NumLevels: int = 4
    CompactionFactor: int = 10

    def holds(self) -> bool:
        return self.NumLevels >= 1 and self.CompactionFactor >= 2


@dataclass
class Config:
    BufferPoolConfig: BufferPool = field(default_factory=BufferPool)
    CacheConfig: Cache = field(default_factory=Cache)
    MemtableConfig: Memtable = field(default_factory=Memtable)
    TokenBucketConfig: TokenBucket = field(default_factory=TokenBucket)
    SSTableConfig: SSTable = field(default_factory=SSTable)
    WriteAheadLogConfig: WriteAheadLog = field(default_factory=WriteAheadLog)
    LSMConfig: Levels = field(default_factory=Levels)
    #: Sections that fell back.
    improper: list[str] = field(default_factory=list)

    @property
    def segment_bytes(self) -> int:
        """Of the write-ahead log: so many blocks of so many KB."""
        return self.WriteAheadLogConfig.SegmentSize * self.BufferPoolConfig.BlockSize * 1024

    @classmethod
    def of(cls, sections: Mapping[str, Mapping[str, Any]] | None = None) -> Config:
        made = cls()
        for f in fields(cls):
            given = (sections or {}).get(f.name)
            if f.name == "improper" or given is None:
                continue
            kind = type(getattr(made, f.name))
            own = {k: v for k, v in given.items() if k in {x.name for x in fields(kind)}}
            try:
                section = kind(**own)
                good = all(type(getattr(section, x.name)) is type(getattr(kind(), x.name)) for x in fields(kind)) and section.holds()
            except TypeError:
                good = False
            if good:
                setattr(made, f.name, section)
            else:
                made.improper.append(f.name)
        block = made.BufferPoolConfig.BlockSize
        if made.WriteAheadLogConfig.SegmentSize * block < 64:  # a segment of the log has 64 KB at least
            made.improper.append("WriteAheadLogConfig")
            made.WriteAheadLogConfig = WriteAheadLog()
        return made

    def check(self) -> None:
        if self.improper:
            raise ValueError(f"configuration has improper values in {', '.join(self.improper)}")


def parse_sections(text: str) -> dict[str, dict[str, Any]]:
    """Sections of indented `Name: value` lines, as configuration files have them; # begins a comment."""
    out: dict[str, dict[str, Any]] = {}
    section: dict[str, Any] = {}
    for n, line in enumerate(text.splitlines(), 1):
        line = line.split("#", 1)[0].rstrip()
        if not line.strip():
            continue
        name, colon, value = line.strip().partition(":")
        if not colon:
            raise ValueError(f"line {n}: no `Name: value`")
        if line[0] not in " \t":
            section = out.setdefault(name, {})
            continue
        value = value.strip().strip("\"'")
        section[name] = {"true": True, "false": False}.get(value.lower(), int(value) if value.lstrip("-").isdigit() else value)
    return out
