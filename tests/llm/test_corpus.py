import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from helpers import SF, rows
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrata.llm import common, decontaminate, fingerprints, language_id, line_dedup, mixing, near_dups, queries


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df, told = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    names = sorted(df.columns)
    assert names == sorted(told.columns)
    assert rows(df, *names) == sorted((tuple(r[told.columns.index(n)] for n in names) for r in told.fetchall()), key=repr)


# line dedup


def brute_lines(texts, least_chars, least_docs):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in texts:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    keeper = {k: max(v, key=lambda i: (i is not None, i)) for k, v in holders.items()}
    out = []
    for i, t in texts:
        split = (t or "").split("\n")
        kept = [x for x in split if not (len(key(x)) >= least_chars and len(holders[key(x)]) >= least_docs and i != keeper[key(x)])]
        out.append((i, len(split), len(split) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches, fanout", [(1, 2), (5, 2), (4, 9), (None, 2)])
def test_line_dedup_against_brute_force(spark, docs, batches, fanout):
    """Repeated rows count once, whatever the batches; ids may be text."""
    rng = random.Random(str(batches))
    pool = [f"  Line {k} É" + "x" * rng.randrange(4) + "\t" for k in range(12)] + ["", "short", "LINE 3 É", "line 3 É\r"]
    texts = [(n, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for n in range(40)] + [(90, None), (91, ""), (92, "\n\n"), (93, pool[0] + "\n" + pool[0]), (93, pool[0] + "\n" + pool[0]), (None, pool[0]), (None, pool[1])]
    texts += [(94, "repeated line")] * 3 + [(95, "repeated line"), *[(n, "in every text\nin three") for n in (96, 97, 97, 98)], (94, "another text\nin every text")]
    got = line_dedup.dedup_lines(docs(*texts), least_chars=6, least_docs=3, batches=batches, fanout=fanout)
    assert rows(got, "doc_id", "n_lines", "n_dropped", "kept") == brute_lines(texts, 6, 3)
    named = [(None if i is None else f"d{i:03}", t) for i, t in texts]
    got = line_dedup.dedup_lines(spark.createDataFrame(named, "doc_id string, text string"), least_chars=6, least_docs=3, batches=batches, fanout=fanout)
    assert rows(got, "doc_id", "n_lines", "n_dropped", "kept") == brute_lines(named, 6, 3)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_line_dedup_of_nothing(docs):
    assert not line_dedup.dedup_lines(docs("a").where("false")).count()


# mixing


def test_targets_by_iteration(spark):
    rng = random.Random(1)
    for _ in range(6):
        sizes = {f"s{k}": rng.choice([0, rng.randrange(1, 5000)]) for k in range(7)}
        df = spark.createDataFrame([*sizes.items()], "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes))}
        total, capped = 1.5 * sum(sizes.values()), {}
        while True:  # clamp and deal out again
            free = [s for s in sizes if s not in capped]
            level = (total - sum(capped.values())) / max(1, sum(weights[s] for s in free))
            over = [s for s in free if level * weights[s] > 2 * sizes[s]]
            if not over:
                break
            capped |= {s: 2 * sizes[s] for s in over}
        for s in sizes:
            assert got[s] == pytest.approx(capped.get(s, level * weights[s])), (sizes, s)


def test_mix(docs):
    rng = random.Random(2)
    own = docs(*((n, "w " * rng.randrange(1, 40), "en", rng.choice("aaaab")) for n in range(300)), (300, None, "en", "a"), (301, "", "en", None), (302, "x y", "en", None), (302, "x y", "en", None))
    got = mixing.mix(own).collect()
    size = lambda n: n * 40  # noqa: E731  one document
    for s in ("a", "b", None):
        taken, (target,) = sum(r.taken for r in got if r.source == s), {r.target for r in got if r.source == s}
        assert abs(taken - target) <= size(1)
    assert all(r.taken <= 2 * r.size and r.taken == r.repeats * r.size for r in got) and len(got) == 304
    assert rows(mixing.mix(own.repartition(7))) == sorted(map(tuple, got), key=repr)
    whole = mixing.mixed(own)
    assert whole.columns == own.columns and whole.count() == sum(r.repeats for r in got)
    assert not mixing.mix(own.where("false")).count() and mixing.mix(docs(None)).first().target == 0


# near duplicates


def brute_classes(texts, threshold=0.8):
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := common.words((t or "").encode())) else None for _, t in texts]
    up = list(range(len(texts)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    links = [0] * len(texts)
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                up[max(root(a), root(b))] = min(root(a), root(b))
    of = defaultdict(list)
    for k in range(len(texts)):
        of[root(k)].append(texts[k][0])
    return sorted(((texts[k][0], min(of[root(k)]), links[k], len(of[root(k)])) for k in range(len(texts))), key=repr)


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates_against_brute_force(docs, monkeypatch, block):
    monkeypatch.setattr(near_dups, "BLOCK", block)
    rng = random.Random(block)
    say = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    texts = []
    for group in range(12):
        base = say(rng.choice([30, 80, 200]))
        for copy in range(rng.choice([1, 2, 3, 14])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                own[rng.randrange(len(own))] = "changed%d" % rng.randrange(50)
            texts.append(" ".join(own))
    texts = list(enumerate([*texts, "one two", "one two", "One, two!", "", None, "!!", "x " * 20_000, "x " * 9_000]))
    got = near_dups.join_near(docs(*texts))
    assert rows(got, "doc_id", "class_id", "n_links", "class_size") == brute_classes(texts)
    assert near_dups.join_near(docs("a b").where("false")).count() == 0


def test_repeated_rows_are_copies(docs):
    got = near_dups.join_near(docs((4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (9, None)))
    assert rows(got, "doc_id", "class_id", "n_links") == sorted([(4, 2, 3), (4, 2, 3), (2, 2, 3), (None, 2, 3), (9, 9, 0)], key=repr)


def test_a_set_of_very_many_copies(docs):
    """More copies than the thousandth of all rows that a shuffle may meet, beside other sets and rows without words."""
    got = near_dups.join_near(docs(*["a b c d e f"] * 1500, *[None] * 3, *["g h i j k l"] * 2, *[" ".join(f"w{k}" for k in range(30))] * 1, " ".join(f"w{k}" for k in range(31))))
    told = Counter((r.class_id, r.n_links, r.class_size) for r in got.collect())
    assert told == {(0, 1499, 1500): 1500, **{(k, 0, 1): 1 for k in range(1500, 1503)}, (1503, 1, 2): 2, (1505, 1, 2): 2}


def test_prefixes_are_shortened_until_the_recall(docs, monkeypatch):
    for s in (0.5, 0.8, 0.95):
        depth = next(d for d in range(near_dups.DEPTH, 0, -1) if near_dups.deep_enough({}, d, s))
        assert depth == 1 or near_dups.meeting(s, depth) >= near_dups.RECALL
    assert not near_dups.deep_enough({0: 1, 9: 1000}, 5, 0.8) and near_dups.deep_enough({0: 0, 3: 1}, 6, 0.8) and not near_dups.deep_enough({1: 5}, 6, 0.8) and near_dups.deep_enough({1: 5}, 5, 0.8)
    searched, met = [], near_dups._met
    monkeypatch.setattr(near_dups, "_met", lambda spots, depth, threshold: searched.append(depth) or met(spots, depth, threshold))
    base = [f"w{k}" for k in range(400)]
    close = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in (0, 100, 399)]
    assert near_dups.join_near(docs(*close)).where("n_links = 2").count() == 3 and searched == [6]  # close copies: no need of shorter prefixes
    far = [" ".join(base[:200]), " ".join(["other" if k % 40 == 20 else w for k, w in enumerate(base[:200])][:160] + base[160:200])]
    searched.clear()
    assert near_dups.join_near(docs(*far)).count() == 2 and searched[:2] == [6, 5]


def test_pairs_belong_to_one_node_each():
    """Every pair that shares a prefix in some tree is found once, at its longest one, whatever the blocks."""
    rng = np.random.default_rng(4)
    paths = rng.integers(0, 3, (60, near_dups.TREES, near_dups.DEPTH)).astype("<u2")
    longest = lambda a, b: max(int(np.argmin([*(a[t] == b[t]), False])) for t in range(near_dups.TREES))
    found = Counter()
    for depth in range(6, 3, -1):
        codes = near_dups.prefixes(paths, depth)
        for tree in range(near_dups.TREES):
            for code in np.unique(codes[:, tree]):
                own = np.nonzero(codes[:, tree] == code)[0]
                unit = {"end": np.full(len(own), len(own)), "cross": np.zeros(len(own), bool), "block": np.zeros(len(own)), "tree": np.full(len(own), tree), "depth": np.full(len(own), depth), "size": np.full(len(own), 9), "paths": paths[own]}
                for i, j, _ in near_dups.candidates(unit, 0.2):
                    found.update((int(own[x]), int(own[y]), depth) for x, y in zip(i, j))
    assert set(found.values()) == {1}
    assert {(i, j, d) for i in range(60) for j in range(i + 1, 60) if (d := longest(paths[i], paths[j])) >= 4} == set(found)


def test_links_are_exact():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
    pairs = np.array([(i, j) for i in range(40) for j in range(i + 1, 40)]).T
    want = [len(np.intersect1d(sets[i], sets[j])) >= 0.4 * len(np.union1d(sets[i], sets[j])) for i, j in pairs.T]
    first = rng.random(40) < 0.5
    cross = first[pairs[0]] != first[pairs[1]]
    assert near_dups.linked(sets, *pairs, 0.4).tolist() == want and near_dups.linked(sets, *pairs[:, :50], 0.4).tolist() == want[:50]
    assert near_dups.linked(sets, *pairs[:, cross], 0.4, first).tolist() == [w for w, c in zip(want, cross) if c]
    holds = np.array(want)
    edges, up = near_dups.stars(40, *pairs[:, holds], [f"{k:02}" for k in range(40)]), {}
    for a, b in edges:
        assert a < b and b not in up and a not in up
        up[b] = a
    assert all(up.get(f"{i:02}", f"{i:02}") == up.get(f"{j:02}", f"{j:02}") for i, j in pairs[:, holds].T)


def test_near_duplicate_query(spark, documents):
    sets = {r.doc_id: frozenset(near_dups.shingles(common.words((r.text or "").encode())).tolist()) for r in documents.collect()}
    shared, holders, links = Counter(), defaultdict(list), Counter()
    for i, s in sets.items():
        for h in s:
            shared.update((i, j) for j in holders[h])
            holders[h].append(i)
    for (a, b), n in shared.items():
        if 10 * n >= 8 * (len(sets[a]) + len(sets[b]) - n):
            links.update((a, b))
    got = {r.doc_id: r.n_links for r in queries.op6_ngram_jaccard_join(spark, SF).collect()}
    lost = sum(max(0, links[i] - got[i]) for i in sets)
    assert all(got[i] <= links[i] for i in sets) and lost <= 0.002 * sum(links.values()) and sum(links.values()) > 50


# fingerprints


def pieces(t):
    width = 1
    while width * 16 <= len(t):
        width *= 2
    return set(re.findall("[^\n]{1,160}", t)) | ({("short", t[k : k + width]) for k in range(0, len(t), width)} if len(t) < 480 else set())


def like(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def check_fingerprint(r, t, n):
    third = len(t) // 3
    edited = t[: len(t) - third] + n[:third]
    assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    assert r.near_edited == pytest.approx(like(pieces(t), pieces(edited))) and r.near_next == pytest.approx(like(pieces(t), pieces(n)))
    assert (r.fingerprint == r.edited_fingerprint) == (pieces(t) == pieces(edited))


def check_fingerprints(got, texts):
    order = sorted(texts, key=lambda x: (x[0] is None, -(x[0] or 0)))
    for k, (i, t) in enumerate(order):
        check_fingerprint(got[i], t, order[(k + 1) % len(order)][1])


@pytest.mark.parametrize("bucket", [4000, 7])
def test_fingerprint_query(spark, documents, monkeypatch, bucket):
    """In one bucket and in 142. Every text is liker to its own edited version than to the next document."""
    monkeypatch.setattr(fingerprints, "BUCKET", bucket)
    got = {r.doc_id: r for r in queries.op9_fingerprints(spark, SF).collect()}
    check_fingerprints(got, [(r.doc_id, r.text or "") for r in documents.collect()])
    assert all(r.near_edited > r.near_next for r in got.values())


def test_fingerprint_edges(spark, docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET", 2), monkeypatch.setattr(fingerprints, "LEAST_BUCKET", 1)
    long = "\n".join(f"line {k} é日" for k in range(3000))
    texts = [(1, None), (3, ""), (5, "one\ntwo\nthree"), (8, "x" * 1000), (13, long), (14, long + "\nmore"), (20, "é"), (21, "abc"), (22, "日本語テキスト" * 9), (None, "last")]
    got = {r.doc_id: r for r in fingerprints.fingerprint(docs(*texts)).collect()}
    check_fingerprints(got, [(i, t or "") for i, t in texts])
    assert fingerprints.fingerprint(docs((1, "a\nb\nc"))).first().near_next == 1
    assert fingerprints.fingerprint(docs((2, "a"), (2, "a"))).count() == 2 and not fingerprints.fingerprint(docs("a").where("false")).count()


def test_fingerprints_of_repeated_rows_and_text_ids(spark, docs, monkeypatch):
    """Rows that repeat a document by the hundred, rows of one id or none with many texts, ids that are no numbers."""
    monkeypatch.setattr(fingerprints, "BUCKET", 5)
    own = docs(*[(7, "seven " * 9)] * 150, *[(None, None)] * 100, *((None, f"text {k}") for k in range(40)), *((9, f"nine {k}") for k in range(40)), *((k, f"doc {k}") for k in range(20, 50)))
    got = fingerprints.fingerprint(own).collect()
    assert Counter(r.doc_id for r in got) == {7: 150, None: 140, 9: 40} | dict.fromkeys(range(20, 50), 1)
    by = {k: [r for r in got if r.doc_id == k] for k in (7, None, 9, 20)}
    assert sum(r.near_next == 1 for r in by[7]) == 149 and sum(r.n_chars == 0 and r.near_next == 1 for r in by[None]) == 99
    assert len({r.fingerprint for r in by[9]}) == 40
    named = own.where("doc_id >= 20").selectExpr("concat('d', doc_id) as doc_id", "text")
    told = {r.doc_id: r for r in fingerprints.fingerprint(named).collect()}
    for k in range(20, 50):
        check_fingerprint(told[f"d{k}"], f"doc {k}", f"doc {k - 1 if k > 20 else 49}")


# language


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    scores, moves, starts = rng.normal(size=(4, 2, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    both, expected = language_id.forward_backward(scores, moves, starts)
    assert np.allclose(both, language_id.marginals(scores, moves, starts))
    pairs = np.zeros((3, 3))
    for c in range(2):
        want, total, own = np.zeros((4, 3)), 0.0, np.zeros((3, 3))
        for path in np.ndindex(3, 3, 3, 3):
            w = np.exp(starts[path[0]] + sum(scores[t, c, path[t]] for t in range(4)) + sum(moves[path[t], path[t + 1]] for t in range(3)))
            total += w
            for t in range(4):
                want[t, path[t]] += w
            for t in range(3):
                own[path[t], path[t + 1]] += w
        assert np.allclose(both[:, c], want / total)
        pairs += own / total
    assert np.allclose(expected, pairs)


def test_language_query(spark, documents):
    got = queries.op7_language_id(spark, SF).join(documents.select("doc_id", "lang"), "doc_id")
    by = {r.held_out: (r.n, r.right) for r in got.groupBy("held_out").agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).collect()}
    assert by[True][1] > 0.97 and 200 < by[True][0] < 300
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_query_against_whole_chains(spark, documents):
    """Every document of the table, as one chain of all its words: the same labels, and scores that the cuts don't move."""
    model = language_id.fit(documents)
    got = {r.doc_id: r for r in language_id.identify(documents, model).collect()}
    worst = 0.0
    for r in documents.collect():
        own = language_id.words_of(r.text or "")
        if not own:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        scores = model.weights[language_id.padded([language_id.features(w, model.lexicon) for w in own])].sum(1)
        mean = language_id.forward_backward(scores[:, None].astype(float), model.moves.astype(float), model.starts.astype(float))[0][:, 0].mean(0)
        worst = max(worst, abs(mean.max() - got[r.doc_id].score))
        assert model.labels[int(mean.argmax())] == got[r.doc_id].lang_pred
    print("largest difference of a score", worst)
    assert worst < 1e-3


def test_chains_of_unequal_lengths(docs, documents):
    """Words' probabilities of texts of any lengths are those of each text alone."""
    model = language_id.fit(documents)
    long = [language_id.words_of(r.text) for r in documents.where("n_chars > 4000").orderBy("doc_id").limit(6).collect()]
    texts = [w[:n] for w, n in zip(long, (1, 2, 127, 128, 129, 1000))] + [[]]
    _, own = language_id.Labeler(model).label(texts)
    at = 0
    for t in texts[:-1]:
        scores = model.weights[language_id.padded([language_id.features(w, model.lexicon) for w in t])].sum(1)
        exact = language_id.forward_backward(scores[:, None].astype(float), model.moves.astype(float), model.starts.astype(float))[0][:, 0]
        assert np.abs(exact - own[at : at + len(t)]).max() < 1e-3
        at += len(t)


def test_code_switching_and_edges(docs, documents):
    model = language_id.fit(documents)
    some = {r.lang: " ".join(r.text.split()[:60]) for r in documents.where("lang in ('fr', 'de') and n_chars > 900 and doc_id % 5 = 1").collect()}
    texts = [None, "", "123 !?", some["fr"] + " " + some["de"], some["de"], "×÷", "日本語"]
    got = {r.doc_id: r for r in language_id.identify(docs(*texts), model).collect()}
    assert [got[k].lang_pred for k in (0, 1, 2, 5)] == ["und"] * 4 and all(got[k].score == 0 for k in (0, 1, 2, 5))
    assert set(got[3].shares) == {"fr", "de"} and min(got[3].shares.values()) > 0.35 and got[4].lang_pred == "de" and got[6].lang_pred != "und"
    assert language_id.fit(docs("a").where("false")) is None and language_id.identify(docs("a"), None).first().lang_pred == "und"
    assert not language_id.identify(docs("a").where("false"), model).count()


def test_all_letters_of_long_runs_play_a_part(docs):
    for word in ("abcdefghijk", "".join(chr(0x4E00 + k) for k in range(57)), "x" * 8 + "é" * 22):
        told = {x for w in language_id.words_of(word) for x in language_id.features(w, {})}
        grams = {f"{kind}{word[k : k + n]}" for kind, n in (("b", 2), ("t", 3)) for k in range(len(word) - n + 1)}
        assert {zlib.crc32(g.encode()) % (language_id.TABLE - 1) for g in grams} <= told
    assert all(len(language_id.features("abcdefghij"[:n], {"abcdefghij"[:n]: 0})) <= language_id.FEATURES for n in range(1, 11))
    rng = random.Random(3)
    say = lambda k: "".join(rng.choice(x) for x in ["一二三四五六七八九十"] * 20 + [("日月火水金土", "山川田木森林")[k]] * 40 + ["一二三四五六七八九十"] * 20)
    model = language_id.fit(docs(*((n, say(n % 2), "ab"[n % 2]) for n in range(300))))
    got = language_id.identify(docs(*((n, say(n % 2)) for n in range(200))), model).collect()
    assert sum(r.lang_pred == "ab"[r.doc_id % 2] for r in got) > 195


def test_rare_languages_are_learned(docs, monkeypatch):
    """More than 64 languages: the rarest, too, are predicted."""
    rng, names = random.Random(7), [f"{a}{b}" for a in "bcdfghjklm" for b in "aeiouyz"]
    say = lambda k: " ".join(names[k] + rng.choice("aeiou") + rng.choice("nrst") for _ in range(30))
    own = [(n, say(k), f"l{k:02}") for n, k in enumerate(k for k in range(70) for _ in range(12 if k < 64 else 8))]
    monkeypatch.setattr(language_id, "CELLS", 1 << 20)  # pieces, too
    model = language_id.fit(docs(*own))
    assert model.labels == [f"l{k:02}" for k in range(70)]
    got = {r.doc_id: r for r in language_id.identify(docs(*((k, say(k)) for k in range(70))), model).collect()}
    assert sum(got[k].lang_pred == f"l{k:02}" for k in range(70)) >= 68 and all(got[k].lang_pred == f"l{k}" for k in range(64, 70))


# the pipeline


def test_pipeline(spark, documents):
    held = documents
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = held
        held = common.stored(stage(spark, held, SF), "test-stage")
        kept[k] = held
        if k < 4:
            assert held.columns == documents.columns
        if k < 3:
            assert not held.join(before, "doc_id", "left_anti").count() and held.count() == held.select("doc_id").distinct().count()
    classes = near_dups.join_near(kept[0])
    assert kept[1].count() == classes.select("class_id").distinct().count()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.decontaminate(kept[2], bench).where("20 * n_hit >= n_words and n_hit > 0").count() == 0
    assert kept[3].count() == mixing.mix(kept[2]).agg(F.sum("repeats")).first()[0]
    assert kept[4].columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"] and kept[4].count() == kept[3].count()
    whole = rows(corpus_pipeline.run(spark, SF))
    assert whole == rows(kept[4])


def test_one_row_of_each_class_stays(spark, docs):
    """Also of rows whose doc_id is null or repeated; rows without words are classes of their own."""
    a, b, c = "a b c d e f", "one two three four five six seven", "k l m n o p q r"
    own = docs((5, a), (None, a), (None, b), (None, b), (7, c), (7, a), (5, a), (9, c), (None, None), (None, None), (None, "!!"), (3, ""), (3, ""), (4, None))
    got = corpus_pipeline.near_duplicates(spark, own, SF)
    assert got.columns == own.columns
    assert rows(got, "doc_id", "text") == sorted([(5, a), (None, b), (7, c), (None, None), (None, None), (None, "!!"), (3, ""), (4, None)], key=repr)


def test_scratch_goes_below_the_shared_folder(spark):
    path = common.scratch(spark, "here")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    spark.range(3).write.parquet(path)
    common.drop_scratch(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)
