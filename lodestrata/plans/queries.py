"""One query for each operator, over the events table as a log of writes, and its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history, integrity, quota, resolve, scan, sketches
from ..sources.events import event_log

Query = Callable[[SparkSession, str], DataFrame]

#: The log in SQL.
KV = """WITH kv AS (
    SELECT 'u' || lpad(user_id::VARCHAR, 6, '0') || ':' || lpad((event_id % 40)::VARCHAR, 2, '0') AS key, epoch_us(ts) * 1000 AS ts_ns, event_type = 'error' AS tombstone,
        CASE WHEN event_type = 'error' THEN NULL ELSE event_type || '#' || event_id END AS value, event_id AS seq
    FROM events),
newest AS (SELECT * FROM kv QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts_ns DESC, seq DESC) = 1),
live AS (SELECT * FROM newest WHERE NOT tombstone),
history AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_ns, seq) - 1 AS version FROM kv)
"""
#: 2024-01-15 00:00:00 UTC, the point in time of the queries that have one; the largest is at the end of that month.
MIDDLE = 1_705_276_800 * 10**9
#: Writes that fill an instance, in the queries about runs.
CAPACITY = 1_000
LOW, HIGH, PREFIX = "u000010:", "u000012:99", "u00001"
HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that follows KV."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = KV + sql
        return f

    return put


@query("SELECT * FROM live WHERE key = 'u000007:07'")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.point_get(event_log(spark, sf_dir), "u000007:07")


@query("SELECT * FROM live WHERE key = (SELECT min(key) FROM newest WHERE tombstone)")
def point_get_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No rows: the key's newest version is a tombstone."""
    log = event_log(spark, sf_dir)
    first = resolve.deleted(log).agg(F.min("key").alias("first"))
    return resolve.live(log.join(first, log["key"] == first["first"], "left_semi"))


@query("SELECT * FROM live WHERE key = 'zzz'")
def point_get_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.point_get(event_log(spark, sf_dir), "zzz")


@query(f"SELECT * FROM live WHERE key BETWEEN '{LOW}' AND '{HIGH}'")
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.range_scan(event_log(spark, sf_dir), LOW, HIGH).orderBy("key")


@query("SELECT * FROM live WHERE key BETWEEN 'u000003:03' AND 'u000003:03'")
def range_scan_single_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.range_scan(event_log(spark, sf_dir), "u000003:03", "u000003:03")


@query("SELECT * FROM live WHERE key BETWEEN 'u9' AND 'u0'")
def range_scan_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.range_scan(event_log(spark, sf_dir), "u9", "u0")


@query(f"SELECT * FROM live WHERE starts_with(key, '{PREFIX}')")
def prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.prefix_scan(event_log(spark, sf_dir), PREFIX).orderBy("key")


@query("SELECT * FROM live WHERE starts_with(key, 'xyz')")
def prefix_scan_no_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.prefix_scan(event_log(spark, sf_dir), "xyz")


@query("SELECT * FROM live")
def prefix_scan_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The empty prefix has all keys."""
    return scan.prefix_scan(event_log(spark, sf_dir), "")


@query(f"SELECT * FROM live WHERE starts_with(key, '{PREFIX}') ORDER BY key LIMIT 20")
def scan_page_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.ScanResult(scan.prefix_scan(event_log(spark, sf_dir), PREFIX), 1, 20).records


@query(f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY key) - 1 AS n FROM live WHERE starts_with(key, '{PREFIX}')) WHERE n // 20 = (SELECT (count(*) - 1) // 20 FROM live WHERE starts_with(key, '{PREFIX}'))".replace("SELECT * FROM (", "SELECT * EXCLUDE (n) FROM (", 1))
def scan_page_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan.prefix_scan(event_log(spark, sf_dir), PREFIX)
    return scan.ScanResult(rows, scan.ScanResult(rows, 1, 20).total_pages, 20).records


@query("SELECT * FROM live WHERE false")
def scan_page_past_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.ScanResult(scan.prefix_scan(event_log(spark, sf_dir), PREFIX), 1_000_000, 20).records


@query(f"SELECT * FROM live WHERE key BETWEEN '{LOW}' AND '{HIGH}' ORDER BY key LIMIT 10")
def scan_page_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 0 of size 0 is page 1 of size 10."""
    return scan.ScanResult(scan.range_scan(event_log(spark, sf_dir), LOW, HIGH), 0, 0).records


@query(f"SELECT count(*) AS total_count, ceil(count(*) / 20)::BIGINT AS total_pages, 2::BIGINT AS page_number, 20::BIGINT AS page_size, count(*) > 40 AS has_more FROM live WHERE starts_with(key, '{PREFIX}')")
def scan_page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.page_summary(scan.prefix_scan(event_log(spark, sf_dir), PREFIX), 2, 20)


@query("SELECT * FROM newest")
def latest_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.latest(event_log(spark, sf_dir))


@query("SELECT * FROM live")
def live_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.live(event_log(spark, sf_dir))


@query("SELECT * FROM newest WHERE tombstone")
def deleted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.deleted(event_log(spark, sf_dir))


@query(f"SELECT * FROM kv WHERE key BETWEEN '{LOW}' AND '{HIGH}'")
def raw_versions_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions, tombstones too."""
    return scan.with_range(event_log(spark, sf_dir), LOW, HIGH)


@query(f"SELECT * FROM kv WHERE starts_with(key, '{PREFIX}')")
def raw_versions_with_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.with_prefix(event_log(spark, sf_dir), PREFIX)


@query("SELECT * FROM kv")
def sorted_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a flush writes: by key, newest first."""
    return event_log(spark, sf_dir).orderBy("key", F.desc("ts_ns"))


def _halves(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    log = event_log(spark, sf_dir)
    return [log.where("seq % 2 = 1"), log.where("seq % 2 = 0")]


@query("SELECT * FROM newest")
def merge_keep_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.merge(_halves(spark, sf_dir))


@query("SELECT * FROM live")
def merge_purge_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.merge(_halves(spark, sf_dir), purge=True)


@query(f"SELECT *, seq // {3 * CAPACITY} AS level FROM kv QUALIFY row_number() OVER (PARTITION BY seq // {3 * CAPACITY}, key ORDER BY ts_ns DESC, seq DESC) = 1")
def merge_every_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs a level, over the whole log, each level as one run."""
    return resolve.latest(event_log(spark, sf_dir).withColumn("level", resolve.run_of(3 * CAPACITY)), "level")


@query(f"SELECT seq // {CAPACITY} AS run, count(*) AS writes, count(*) FILTER (tombstone) AS tombstones, count(DISTINCT key) AS keys FROM kv GROUP BY 1")
def memtable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).groupBy(resolve.run_of(CAPACITY).alias("run")).agg(F.count(F.lit(1)).alias("writes"), F.count_if("tombstone").alias("tombstones"), F.count_distinct("key").alias("keys"))


ZONES = f"SELECT seq // {CAPACITY} AS run, min(key) AS min_key, max(key) AS max_key, count(*) AS rows, max(ts_ns) AS max_ts_ns FROM kv GROUP BY 1"


@query(ZONES)
def run_zone_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.zone_map(event_log(spark, sf_dir).withColumn("run", resolve.run_of(CAPACITY)), "run")


@query(f"SELECT * FROM ({ZONES}) WHERE min_key <= '{HIGH}' AND max_key >= '{LOW}'")
def runs_pruned_for_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose keys may lie in the range."""
    return run_zone_map(spark, sf_dir).where((F.col("min_key") <= HIGH) & (F.col("max_key") >= LOW))


@query("SELECT * FROM kv ORDER BY ts_ns DESC, seq DESC LIMIT 1")
def newest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.newest_record(event_log(spark, sf_dir))


@query(f"SELECT * FROM kv WHERE ts_ns > {MIDDLE}")
def wal_replay_after_hw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.after(event_log(spark, sf_dir), MIDDLE)


@query(f"SELECT seq // {CAPACITY} AS segment, count(*) AS rows, max(ts_ns) AS max_ts_ns FROM kv GROUP BY 1 HAVING max(ts_ns) > {MIDDLE}")
def wal_gc_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that still have something to replay."""
    segments = event_log(spark, sf_dir).groupBy(resolve.run_of(CAPACITY).alias("segment")).agg(F.count(F.lit(1)).alias("rows"), F.max("ts_ns").alias("max_ts_ns"))
    return segments.where(F.col("max_ts_ns") > MIDDLE)


@query("SELECT * FROM history WHERE key = 'u000005:05'")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.versions(scan.with_key(event_log(spark, sf_dir), "u000005:05"))


@query("SELECT * FROM history WHERE version = 2")
def version_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.nth(event_log(spark, sf_dir), 2)


@query("SELECT kv.* FROM kv WHERE ts_ns = (SELECT max(ts_ns) FROM kv)")
def version_at_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions of the log's last moment."""
    log = event_log(spark, sf_dir)
    return history.at(log, log.agg(F.max("ts_ns").alias("last")))


@query("SELECT * FROM history WHERE version = 0")
def version_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.first(event_log(spark, sf_dir))


@query("SELECT * FROM newest")
def version_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.last(event_log(spark, sf_dir))


@query("SELECT key, count(*) AS versions FROM kv GROUP BY key")
def version_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.counts(event_log(spark, sf_dir))


@query("SELECT key, ts_ns, value FROM kv QUALIFY row_number() OVER (PARTITION BY key, ts_ns ORDER BY seq DESC) = 1 AND NOT tombstone")
def version_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.listing(event_log(spark, sf_dir))


@query(f"SELECT * FROM (SELECT * FROM kv WHERE ts_ns <= {MIDDLE} QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts_ns DESC, seq DESC) = 1) WHERE NOT tombstone")
def as_of_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.as_of(event_log(spark, sf_dir), MIDDLE)


def _quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("ts_us"))
    timed = events.crossJoin(F.broadcast(events.agg(F.min("ts_us").alias("start"))))  # one row
    return quota.quota(timed, 2, DAY_US, F.col("start"), "user_id", "ts_us", "event_id").drop("start")


QUOTA = f"SELECT event_id, user_id, epoch_us(ts) AS ts_us, row_number() OVER (PARTITION BY user_id, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // {DAY_US} ORDER BY ts, event_id) <= 2 AS allowed FROM events"


@query(QUOTA)
def token_bucket_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quota(spark, sf_dir)


@query(f"SELECT user_id, count(*) AS denied FROM ({QUOTA}) WHERE NOT allowed GROUP BY user_id")
def token_bucket_denied_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quota(spark, sf_dir).where("not allowed").groupBy("user_id").agg(F.count(F.lit(1)).alias("denied"))


@query(f"SELECT user_id, epoch_us(max(ts)) AS last_us, 60 - ((epoch_us(max(ts)) - (SELECT min(epoch_us(ts)) FROM events)) % 60000000) // 1000000 AS next_refill_s FROM events GROUP BY user_id")
def token_bucket_next_refill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds from each user's last event to the next refill of a bucket of 60 seconds."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("ts_us"))
    start = events.agg(F.min("ts_us").alias("start"))
    last = events.groupBy("user_id").agg(F.max("ts_us").alias("last_us")).crossJoin(F.broadcast(start))  # one row
    return last.select("user_id", "last_us", (60 - F.floor((F.col("last_us") - F.col("start")) % 60_000_000 / 1_000_000)).alias("next_refill_s"))


#: A filter of all live keys, sized by how many they are.
BLOOM_SIZE = "(SELECT m, ceil(m / n * ln(2.0))::BIGINT AS k FROM (SELECT n, ceil(n * abs(ln(0.01)) / pow(ln(2.0), 2))::BIGINT AS m FROM (SELECT greatest(count(*), 1) AS n FROM live)))"
BITS = "SELECT DISTINCT key, ('0x' || substr(md5(encode(key) || unhex(lpad(hex(s), 8, '0'))), 1, 8))::BIGINT % m AS bit FROM {}, " + BLOOM_SIZE + ", range(16) r(s) WHERE s < k"


def _bloom(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[int, int]]:
    """The bits of a filter of all live keys, and its size."""
    keys = resolve.live(event_log(spark, sf_dir)).select("key")
    size = sketches.bloom_size(max(1, keys.count()), 0.01)
    return sketches.bloom_bits(keys, "key", *size), size


@query(f"SELECT DISTINCT bit FROM ({BITS.format('live')})")
def bloom_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bloom(spark, sf_dir)[0]


@query(f"SELECT key FROM ({BITS.format('newest')}) a LEFT JOIN (SELECT DISTINCT bit FROM ({BITS.format('live')})) b USING (bit) GROUP BY key HAVING count(*) = count(b.bit)")
def bloom_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key that was ever written against the filter of the live ones: all of those, and a few that were deleted."""
    bits, size = _bloom(spark, sf_dir)
    return sketches.bloom_probe(event_log(spark, sf_dir), "key", bits, *size)


REGISTERS = """SELECT (('0x' || substr(d, 1, 4))::BIGINT >> 4) AS bucket, max(1 + length(regexp_extract(b, '(0*)$', 1))) AS rank
    FROM (SELECT md5(user_id::VARCHAR) AS d, lpad(bin(('0x' || substr(md5(user_id::VARCHAR), 1, 16))::UBIGINT), 64, '0') AS b FROM events) GROUP BY 1"""


@query(REGISTERS)
def hll_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.hll_registers(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id")


@query(f"""SELECT round(CASE WHEN e <= 2.5 * 4096 AND z > 0 THEN 4096 * ln(4096.0 / z) ELSE e END, 6) AS estimate FROM (
    SELECT 4096 - count(*) AS z, (0.7213 / (1 + 1.079 / 4096)) * 4096 * 4096 / (sum(pow(2.0, -rank)) + 4096 - count(*)) AS e FROM ({REGISTERS}))""")
def hll_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.hll_estimate(hll_registers(spark, sf_dir)).select(F.round("estimate", 6).alias("estimate"))


RECORD = "unhex(lpad(hex(ts_ns), 16, '0') || CASE WHEN tombstone THEN '01' ELSE '00' END || lpad(hex(strlen(key)), 8, '0') || lpad(hex(strlen(coalesce(value, ''))), 8, '0')) || encode(key) || encode(coalesce(value, ''))"


@query(f"SELECT key, seq, sha256({RECORD}) AS hash FROM kv")
def record_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of each record's encoding without its checksum."""
    from ..functions.codec import record_body

    return event_log(spark, sf_dir).select("key", "seq", F.sha2(record_body(), 256).alias("hash"))


def _text_leaves(log: DataFrame) -> DataFrame:
    """Leaves over text, as SQL can make them too."""
    text = F.concat_ws("|", "key", F.col("ts_ns").cast("string"), F.coalesce("value", F.lit("-")))
    return integrity.numbered(resolve.latest(log).select("key", F.sha2(text.cast("binary"), 256).alias("hash")), "key")


LEAVES = "SELECT row_number() OVER (ORDER BY key) - 1 AS idx, key, sha256(key || '|' || ts_ns || '|' || coalesce(value, '-')) AS hash FROM {}"


@query(LEAVES.format("newest"))
def merkle_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_leaves(event_log(spark, sf_dir)).select("idx", "key", "hash")


CHANGED = "(SELECT key, ts_ns, CASE WHEN seq % 97 = 0 THEN 'changed' ELSE value END AS value FROM newest)"


@query(f"SELECT b.idx, b.key, b.hash FROM ({LEAVES.format('newest')}) a FULL JOIN ({LEAVES.format(CHANGED)}) b ON a.idx = b.idx WHERE a.hash IS DISTINCT FROM b.hash")
def merkle_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    changed = log.withColumn("value", F.when(F.col("seq") % 97 == 0, F.lit("changed")).otherwise(F.col("value")))
    return integrity.difference(_text_leaves(log), _text_leaves(changed))


@query("SELECT 'memory' AS source, count(*) AS versions, count(DISTINCT key) AS keys, coalesce(sum(strlen(value)), 0)::BIGINT AS bytes FROM kv WHERE NOT tombstone")
def live_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of what is no tombstone."""
    log = event_log(spark, sf_dir).where("not tombstone")
    return log.agg(F.count(F.lit(1)).alias("versions"), F.count_distinct("key").alias("keys"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).cast("long").alias("bytes")).select(F.lit("memory").alias("source"), "versions", "keys", "bytes")


#: CRC-32 by its table of 256, which its polynomial gives; and records with their checksum before them.
CRC = f"""kv_records AS (SELECT key, ts_ns, tombstone, value, seq, {RECORD} AS body FROM {{}}),
crc_table AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n::UBIGINT, range(8)::UBIGINT[]), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(n))),
with_crc AS (SELECT * EXCLUDE (body, t), body, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(octet_length(body)), lambda i: ('0x' || substr(hex(body), 2 * i + 1, 2))::UBIGINT)),
    lambda c, b: xor(c >> 8, t[(1 + (xor(c, b) & 255))::BIGINT])))::BIGINT AS crc FROM kv_records, crc_table)
"""
NO_HASH = "'" + "0" * 64 + "'"


@query(", " + CRC.format("newest") + f"""SELECT list_reduce(list_prepend(list(hash ORDER BY key), list_transform(range(64), lambda x: ['']::VARCHAR[])), lambda h, _: CASE WHEN len(h) = 1 THEN h ELSE
    list_transform(range(0, len(h), 2), lambda k: sha256(unhex(h[k + 1]) || unhex(coalesce(h[k + 2], {NO_HASH})))) END)[1] AS root
    FROM (SELECT key, sha256(unhex(lpad(hex(crc), 8, '0')) || body) AS hash FROM with_crc)""")
def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.root(integrity.leaves(resolve.latest(event_log(spark, sf_dir))).select("idx", "hash"))


@query(", " + CRC.format("kv") + "SELECT * EXCLUDE (body) FROM with_crc")
def record_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.with_crc(event_log(spark, sf_dir))


@query("SELECT key, value FROM live ORDER BY key LIMIT 25")
def iterator_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of an iterator over all keys."""
    it, rows = scan.KeyIterator(scan.prefix_scan(event_log(spark, sf_dir), "")), []
    while len(rows) < 25 and it.next():
        rows.append((it.key, it.value))
    it.stop()
    return spark.createDataFrame(rows, "key string, value string")
