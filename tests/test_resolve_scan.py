import random

import pytest
from helpers import shown
from pyspark.sql import functions as F

from lodestrata.operators import history, resolve, scan
from lodestrata.schema import RESERVED, InvalidKey

FRUIT = [("apple", 1, "f1"), ("banana", 1, "f2"), ("cherry", 1, "f3"), ("date", 1, "f4"), ("elderberry", 1, "f5")]


def test_range_is_inclusive_and_bytewise(log):
    rows = log(*FRUIT)
    assert shown(scan.range_scan(rows, "b", "e"), "key") == [("banana",), ("cherry",), ("date",)]
    assert shown(scan.range_scan(rows, "date", "date"), "value") == [("f4",)]
    assert not scan.range_scan(rows, "e", "b").count()


def test_prefix(log):
    rows = log(*((k, 1, "v") for k in ("apple", "apricot", "banana", "berry", "blueberry", "cherry")))
    assert [scan.prefix_scan(rows, p).count() for p in ("ap", "b", "xyz", "")] == [2, 3, 0, 6]


def test_reserved_key(log):
    rows = log((RESERVED, 1, "state"), ("_x", 1, "v"))
    assert shown(scan.range_scan(rows, "A", "z"), "key") == [("_x",)]
    with pytest.raises(InvalidKey):
        scan.prefix_scan(rows, "__tb")
    assert shown(scan.prefix_scan(rows, "_x"), "key") == [("_x",)]


def test_tombstones_hide_older_versions_of_other_sources(log):
    run, memory = log(("apple", 1, "fruit")), log(("apple", 2, None))
    both = resolve.together([memory, run])
    assert not scan.range_scan(both, "a", "z").count() and not scan.point_get(both, "apple").count()


def test_equal_times_go_by_source_then_sequence(log):
    memory, run = log(("apple", 5, "mem"), ("date", 5, "mem")), log(("apple", 5, "old"), ("banana", 5, "b"), ("cherry", 5, "c"))
    got = scan.range_scan(resolve.together([memory, run]), "a", "z")
    assert shown(got, "key", "value") == [("apple", "mem"), ("banana", "b"), ("cherry", "c"), ("date", "mem")]
    assert shown(resolve.live(log(("k", 1, "a", 1), ("k", 1, "b", 2))), "value") == [("b",)]


def test_merge(log):
    old, new = log(("dead", 100, "alive"), ("keep", 100, "old")), log(("dead", 200, None), ("fresh", 200, "f"), ("keep", 200, "new"))
    assert shown(resolve.merge([new, old]), "key", "tombstone") == [("dead", True), ("fresh", False), ("keep", False)]
    assert shown(resolve.merge([new, old], purge=True), "key", "value") == [("fresh", "f"), ("keep", "new")]


def test_pages(log):
    rows = scan.range_scan(log(*((c, 1, "v") for c in "abcdefghij")), "a", "z")
    pages = {n: scan.ScanResult(rows, n, 3) for n in (1, 2, 4, 10)}
    assert {n: (p.records.count(), p.has_more, p.total_count) for n, p in pages.items()} == {1: (3, True, 10), 2: (3, True, 10), 4: (1, False, 10), 10: (0, False, 10)}
    assert [r.key for r in pages[2].records.collect()] == ["d", "e", "f"]
    default = scan.ScanResult(rows, 0, 0)
    assert (default.page_number, default.page_size, default.records.count()) == (1, 10, 10)
    assert pages[1].next().page_number == 2 and pages[1].previous().page_number == 1 and pages[4].next() is pages[4] and pages[1].total_pages == 4


def test_iterator(log):
    it = scan.KeyIterator(scan.range_scan(log(*FRUIT), "b", "d"))
    assert it.key == "" and it.next() and it.key == "banana" and bytes(it.value) == b"f2" and not it.tombstone
    it.reset()
    assert [r.key for r in it] == ["banana", "cherry"]
    it.stop(), it.reset()
    assert not it.next() and it.key == "" and it.value is None


def test_history(log):
    rows = log(("k", 3, "c"), ("k", 1, "a"), ("k", 2, None), ("k", 2, "b2"), ("j", 9, "z"))
    assert shown(history.versions(rows).where("key = 'k'"), "version", "ts_ns") == [(0, 1), (1, 2), (2, 2), (3, 3)]
    assert shown(history.nth(rows, 3), "value") == [("c",)]
    assert shown(history.first(rows), "key", "value") == [("j", "z"), ("k", "a")]
    assert shown(history.last(rows), "key", "value") == [("j", "z"), ("k", "c")]
    assert shown(history.at(rows, 1), "value") == [("a",)]
    assert shown(history.counts(rows), "key", "versions") == [("j", 1), ("k", 4)]
    assert shown(history.listing(rows), "key", "ts_ns", "value") == [("j", 9, "z"), ("k", 1, "a"), ("k", 2, "b2"), ("k", 3, "c")]
    assert shown(history.as_of(rows, 1), "key", "value") == [("k", "a")]


def test_against_a_dictionary(log):
    rng, rows, model = random.Random(7), [], {}
    for n in range(600):
        key = f"k{rng.randrange(80):02d}"
        value = None if rng.random() < 0.3 else f"v{n}"
        rows.append((key, n // 3, value))  # ties of time
        model[key] = value
    own = log(*rows)
    want = sorted((k, v) for k, v in model.items() if v is not None)
    assert shown(resolve.live(own), "key", "value") == want
    runs = [own.where((F.col("seq") >= a) & (F.col("seq") < a + 200)) for a in (400, 200, 0)]
    assert shown(resolve.merge([runs[0], resolve.merge(runs[1:])], purge=True), "key", "value") == want


def test_filters_reach_the_scan(spark, log, tmp_path):
    log(*FRUIT).write.parquet(str(tmp_path / "x"))
    read = spark.read.parquet(str(tmp_path / "x"))
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key,b)" in plan(scan.range_scan(read, "b", "d")) and "StringStartsWith(key,b)" in plan(scan.prefix_scan(read, "b"))
    assert "WindowGroupLimit" in plan(resolve.live(read))


def test_empty(log):
    none = log(("a", 1, "v")).where("false")
    assert not resolve.live(none).count() and scan.ScanResult(none).total_pages == 0 and not resolve.newest_record(none).count() and not history.versions(none).count()
