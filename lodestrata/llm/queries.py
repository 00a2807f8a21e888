"""The queries of this package, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, language_id, licenses, line_dedup, mixing, near_dups, pii, token_counts, token_files


def _table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _joined(values: Column) -> Column:
    return F.array_join(values, ",")


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    starts, base = F.expr("transform(found, x -> x.start)"), F.expr("array_sort(array_distinct(transform(found, x -> x.label)))")
    every = F.expr("array_sort(array_distinct(transform(shares, x -> x.label)))")
    score = F.coalesce(F.array_max(F.expr("transform(shares, x -> x.share)")), F.lit(0.0))
    return got.select("doc_id", "n_words", F.size("found").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), _joined(base).alias("base_labels"), _joined(every).alias("labels"), score.alias("score"), "n_blocks")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", "n_dropped", _sha256(F.col("kept")).alias("kept_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), _sha256(_joined(F.col("item_ids"))).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "repeats")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.join_near(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "class_size")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    got = language_id.identify(docs, language_id.fit(docs))
    return got.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.find_personal(_table(spark, sf_dir, "documents"))
    kinds = F.array(*(F.lit(k) for k in pii.KINDS))

    def told(spans: Column) -> Column:
        return _joined(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))

    base = F.filter("spans", lambda x: x["base"])

    def of(kind: int) -> Column:
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")

    counts = [of(k).alias(f"n_{n}") for k, n in enumerate(pii.KINDS[: pii.BASE])]
    return got.select("doc_id", *counts, _sha256(told(base)).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(_table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_license_scans, op2_token_counts, op3_line_dedup, op4_decontamination, op5_mixing, op6_ngram_jaccard_join, op7_language_id, op8_pii, op9_fingerprints, op10_token_files)}
#: A text's words in SQL, and documents as rows with theirs.
SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL_DOCS = f"d AS (SELECT row_number() OVER () AS r, doc_id, {SQL_WORDS} AS w FROM documents)"


def _sql_templates() -> str:
    """Templates as rows: label, their words (each once), how many must be met, and whether they must stand consecutively."""
    made = licenses.templates_of(licenses.PHRASES, licenses.TEMPLATES, licenses.THRESHOLD)
    own = [(t.label, [w.decode() for w in dict.fromkeys(t.words)], t.least, t.phrase) for t in made]
    return "t(label, ws, least_words, phrase) AS (VALUES " + ", ".join(f"('{label}', {ws}, {least}, {phrase})" for label, ws, least, phrase in own) + ")"


ORACLE_SQL: dict[str, str] = {
    # windows of 256 words, a new one every 128, each with each template
    "op1_license_scans": f"""
        WITH {SQL_DOCS}, {_sql_templates()},
        b AS (SELECT r, w, unnest(range(0, greatest(1, len(w) - 128), 128)) AS a FROM d WHERE len(w) > 0),
        m AS (SELECT r, a, label, phrase, ws, w, len(list_intersect(w[a + 1 : a + 256], ws)) AS held FROM b, t WHERE len(list_intersect(w[a + 1 : a + 256], ws)) >= least_words),
        f AS (SELECT *, CASE WHEN phrase THEN list_filter(range(a, least(a + 256, len(w)) - len(ws) + 1), lambda k: w[k + 1 : k + len(ws)] = ws) ELSE []::BIGINT[] END AS places FROM m),
        h AS (SELECT r, a, label, held / len(ws) AS share, places FROM f WHERE NOT phrase OR len(places) > 0),
        p AS (SELECT r, count(*) AS n_base, min(x) AS first_word, max(x) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM (SELECT DISTINCT r, label, unnest(places) AS x FROM h) GROUP BY r),
        q AS (SELECT r, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(share) AS score, count(DISTINCT a) AS n_blocks FROM h GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score, coalesce(n_blocks, 0) AS n_blocks
        FROM d LEFT JOIN p USING (r) LEFT JOIN q USING (r)""",
    # windows of items and of documents, joined as strings
    "op4_decontamination": f"""
        WITH {SQL_DOCS},
        i AS (SELECT item_id::VARCHAR AS item, {SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
        p AS (SELECT DISTINCT item, len(x) AS n, array_to_string(x, ' ') AS phrase FROM (SELECT item, unnest(list_transform(range(greatest(1, len(w) - 12)), lambda k: w[k + 1 : k + 13])) AS x FROM i WHERE len(w) > 0)),
        o AS (SELECT r, n, a, array_to_string(w[a + 1 : a + n], ' ') AS phrase FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS a FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
        h AS (SELECT r, item, a, n FROM o JOIN p USING (n, phrase)),
        c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(a, a + n)) AS x FROM (SELECT DISTINCT r, a, n FROM h)) GROUP BY r),
        g AS (SELECT r, list_sort(list_distinct(list(item))) AS items FROM h GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
        FROM d LEFT JOIN c USING (r) LEFT JOIN g USING (r)""",
    # every pair of sets that share a shingle, and the transitive closure of links
    "op6_ngram_jaccard_join": f"""
        WITH RECURSIVE {SQL_DOCS},
        s AS (SELECT r, doc_id, CASE WHEN len(w) > 0 THEN list_sort(list_distinct(list_transform(range(greatest(1, len(w) - 4)), lambda k: array_to_string(w[k + 1 : k + 5], ' ')))) END AS own FROM d),
        k AS (SELECT md5(array_to_string(own, '|')) AS id, any_value(own) AS own, count(*) AS copies, min(doc_id) AS first_id FROM s WHERE own IS NOT NULL GROUP BY 1),
        x AS (SELECT id, len(own) AS n, unnest(list_transform(own, lambda y: hash(y))) AS shingle FROM k),
        e AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.id <> b.id GROUP BY a.id, b.id HAVING count(*) * 10 >= 8 * (any_value(a.n) + any_value(b.n) - count(*))),
        c AS (SELECT id AS node, id AS root FROM k UNION SELECT e.b, c.root FROM c JOIN e ON c.node = e.a),
        m AS (SELECT node, min(root) AS root FROM c GROUP BY node),
        z AS (SELECT root, min(first_id) AS class_id, sum(copies)::BIGINT AS class_size FROM m JOIN k ON node = id GROUP BY root),
        l AS (SELECT a AS id, sum(copies)::BIGINT AS links FROM e JOIN k ON b = id GROUP BY a)
        SELECT doc_id, CASE WHEN own IS NULL THEN doc_id ELSE class_id END AS class_id, coalesce(copies - 1 + coalesce(links, 0), 0)::BIGINT AS n_links, coalesce(class_size, 1) AS class_size
        FROM s LEFT JOIN k ON md5(array_to_string(s.own, '|')) = k.id LEFT JOIN m ON m.node = k.id LEFT JOIN z ON z.root = m.root LEFT JOIN l ON l.id = k.id""".replace("SELECT doc_id, CASE WHEN own", "SELECT doc_id, CASE WHEN s.own"),
    "op3_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, i, line, lower_key AS k FROM (
                SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS line, unnest(list_transform(a, lambda x: translate(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS lower_key
                FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents))),
        r AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) + bool_or(doc_id IS NULL)::INT >= 5)
        SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (r.k IS NOT NULL AND l.doc_id IS DISTINCT FROM r.keeper) AS n_dropped,
            sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (r.k IS NULL OR l.doc_id IS NOT DISTINCT FROM r.keeper), '')) AS kept_sha256
        FROM l LEFT JOIN r ON l.k = r.k GROUP BY l.doc_id""",
    "op5_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('17:' || coalesce(doc_id::VARCHAR, '')) AS turn
            FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, ([3, 1, 2])[1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS w FROM d GROUP BY source),
        o AS (SELECT *, 2 * source_size AS cap, row_number() OVER (ORDER BY 2 * source_size / w, source) AS k FROM s),
        v AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / ((SELECT sum(w) FROM s) - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM o),
        f AS (SELECT arg_min(level, k) AS level FROM v WHERE level <= cap::DOUBLE / w),
        t AS (SELECT source, source_size, CASE WHEN f.level IS NULL OR cap <= f.level * w THEN cap::DOUBLE ELSE f.level * w END AS target FROM v, f),
        g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
        c AS (SELECT d.*, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS more,
            sum(size) OVER (PARTITION BY d.source ORDER BY turn) AS upto, sum(size) OVER (PARTITION BY d.source, turn) AS same
            FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
        e AS (SELECT source, max(turn) FILTER (upto - same / 2 <= more AND more > 0) AS last_turn FROM c GROUP BY source)
        SELECT doc_id, size, source_size, target, (CASE WHEN turn <= last_turn THEN whole + 1 ELSE whole END)::BIGINT * size AS taken, (CASE WHEN turn <= last_turn THEN whole + 1 ELSE whole END)::BIGINT AS repeats
        FROM c JOIN e ON c.source IS NOT DISTINCT FROM e.source""",
}
