import hashlib
import random
import re

import pytest
from helpers import SF, rows

from lodestrata.llm import decontaminate as dc
from lodestrata.llm import licenses as li
from lodestrata.llm import pii, queries
from lodestrata.llm.common import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_words():
    for t in ("A b-C_d\x00é Él 1,2", "", "日本 x", "\x7fabc@[`{"):
        assert [w.decode() for w in words(t.encode())] == WORD.findall(lower(t))


def places(text):
    own = WORD.findall(lower(text))
    found = [(label, k) for p, label in li.PHRASES.items() for k in range(len(own)) if own[k : k + len(p.split())] == p.split()]
    return len(own), found


def test_license_query(spark, documents):
    got = {r.doc_id: r for r in queries.op1_license_scans(spark, SF).collect()}
    for r in documents.collect():
        n, found = places(r.text)
        x, at = got[r.doc_id], [k for _, k in found]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == (n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted({a for a, _ in found})))
        assert set(x.base_labels.split(",")) <= set(x.labels.split(",")) | {""} and 0 <= x.score <= 1 and (not at or x.score == 1)


def test_license_blocks_and_edges(docs):
    filler = " ".join(f"w{k}" for k in range(700))
    own = docs(None, "", filler + " MIT\nLicense " + filler, f"{filler} {li.TEMPLATES['bsd']} {filler}", "cc by cc by", "by cc", "x " * 254 + "gnu general public license", ("apache license " * 500).strip())
    got = {r.doc_id: r for r in li.scan_licenses(own).collect()}
    assert got[0].n_words == got[1].n_words == 0 and not got[0].found and not got[0].shares
    assert [tuple(x) for x in got[2].found] == [("mit", 700)] and [x.label for x in got[3].shares] == ["bsd"] and not got[3].found
    assert [x.start for x in got[4].found] == [0, 2] and not got[5].found and [x.start for x in got[6].found] == [254] and len(got[7].found) == 500
    assert not li.scan_licenses(own.where("false")).count()


def test_set_join_is_exact():
    rng = random.Random(2)
    vocabulary = [f"v{k}".encode() for k in range(30)]
    for _ in range(200):
        templates = [li.Template(str(k), tuple(rng.sample(vocabulary, rng.randrange(1, 9))), rng.choice([0.5, 0.8, 1.0]), False) for k in range(6)]
        join = li.Join(templates, {w: rng.randrange(50) for w in vocabulary})
        block = set(rng.sample(vocabulary, rng.randrange(0, 20)))
        want = {n: len(set(t.words) & block) / len(t.words) for n, t in enumerate(templates) if len(set(t.words) & block) / len(t.words) >= t.threshold - 1e-9}
        assert dict(join.matches(block)) == want


def test_templates_in_slices(docs, monkeypatch):
    own = docs("under the MIT license or the Apache License", (0, "gnu general public license"), "none")
    whole = rows(li.scan_licenses(own), "doc_id", "n_words", "found", "shares")
    monkeypatch.setattr(li, "SLICE", 3)
    assert rows(li.scan_licenses(own), "doc_id", "n_words", "found", "shares") == whole


def brute(items, text, window):
    own, hit, ids = words((text or "").encode()), set(), set()
    for i, t in items:
        ws = words((t or "").encode())
        for k in range(max(1, len(ws) - window + 1) if ws else 0):
            w = ws[k : k + window]
            for p in range(len(own) - len(w) + 1):
                if own[p : p + len(w)] == w:
                    hit |= set(range(p, p + len(w)))
                    ids.add(i)
    return len(own), len(hit), sorted(ids)


@pytest.mark.parametrize("slice_bytes, part_words", [(dc.SLICE_BYTES, dc.PART_WORDS), (40, 6)])
def test_decontamination_against_brute_force(spark, docs, monkeypatch, slice_bytes, part_words):
    """In one slice; and in many, with items longer than a part and than a slice."""
    monkeypatch.setattr(dc, "PART_WORDS", part_words)
    rng = random.Random(5)
    say = lambda most: " ".join(rng.choice(["a", "B", "c,", "dé", "x1\n"]) for _ in range(rng.randrange(most)))
    items = [(str(k), say(9)) for k in range(12)] + [("3", None), ("twice", "a b c"), ("twice", "a b c"), ("long", " ".join(f"l{k}" for k in range(50)))]
    own = [say(60) for _ in range(25)] + [None, "", "zz " * 3000 + items[2][1], "x " + items[-1][1] + " y", *(" ".join(f"l{k}" for k in range(a, a + 5)) for a in (0, 3, 5, 9, 45))]
    bench = spark.createDataFrame([*items, (None, "a")], "item_id string, text string").selectExpr("*", "1 as doc_id")
    got = dc.decontaminate(docs(*own), bench, window=4, with_text=True, slice_bytes=slice_bytes)
    for r in got.collect():
        assert (r.n_words, r.n_hit, r.item_ids) == brute(items, own[r.doc_id], 4)
        assert r.n_hit or r.text == (own[r.doc_id] or "")
        kept = [w for k, w in enumerate(words((own[r.doc_id] or "").encode())) if not any(s.start <= k < s.end for s in r.spans)]
        assert words(r.text.encode()) == kept or r.n_hit  # words on both sides of a cut may meet
    assert not dc.decontaminate(docs("a").where("false"), bench).count()
    assert dc.decontaminate(docs("a b"), bench.where("false")).first().n_hit == 0


def test_fm_index():
    import numpy as np

    rng = np.random.default_rng(1)
    for top in (1, 2, 40):
        values = np.append(rng.integers(0, top + 1, 500), 0)
        index = dc.FMIndex(values)
        for size in (1, 2, 3):
            phrases = rng.integers(1, top + 2, (30, size))
            low, high = index.search(phrases)
            for p, a, b in zip(phrases, low, high):
                want = [k for k in range(501 - size) if (values[k : k + size] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_decontamination_query(spark, documents):
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {}
    for i, t in bench:
        ws = words(t.encode())
        for k in range(max(1, len(ws) - 12)):
            windows.setdefault(tuple(ws[k : k + 13]), set()).add(i)
    got, sizes, hits = {r.doc_id: r for r in queries.op4_decontamination(spark, SF).collect()}, {len(w) for w in windows}, 0
    for r in documents.collect():
        own, hit, ids = words((r.text or "").encode()), set(), set()
        for n in sizes:
            for p in range(len(own) - n + 1):
                if w := windows.get(tuple(own[p : p + n])):
                    hit |= set(range(p, p + n))
                    ids |= w
        x = got[r.doc_id]
        assert (x.n_words, x.n_hit, x.n_items, x.items_sha256) == (len(own), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest())
        assert x.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(own))
        hits += bool(hit)
    assert hits


def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(pii.digits_of(m[0])) <= 19 and pii.luhn(pii.digits_of(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(pii.digits_of(m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(9)
    parts = ["a", "b.c", "@", "@@", ".", "-", "1", "22", "255", "256", "+", "(", ")", " ", "4111 1111 1111 1111", "5500-0000-0000-0004", "me@x.org", "+49 (30) 1234567", "10.0.0.1", "é", "%", "\n"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(t)] == plain_spans(t), t


def test_long_runs_take_linear_time():
    for t in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000, "1 " * 100_000, "me@x.org " * 20_000, "a:" * 100_000, "::" * 100_000, "AB12" * 50_000, "token=" * 30_000, "[at]" * 50_000, "sk-" * 60_000):
        pii.proposals(t)


def test_pii_query(spark, documents):
    got = {r.doc_id: r for r in queries.op8_pii(spark, SF).collect()}
    for r in documents.collect():
        want = plain_spans(r.text or "")
        told, x = ",".join(f"{k}:{s}:{e}" for k, s, e in want), got[r.doc_id]
        assert x.base_sha256 == hashlib.sha256(told.encode()).hexdigest() and [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == n for k, *_ in want) for n in pii.KINDS[:4]]
        assert set(told.split(",")) <= set(x.spans.split(",")) | {""}
        assert all(not ((r.text or "")[int(s) : int(e)]).isspace() for _, s, e in (y.split(":") for y in x.spans.split(",") if y))


def test_pii_method(docs):
    own = docs(*[f"mail me at user{k}@site{k}.org or call +1 (415) 555-01{k:02d} today" for k in range(40)], *[f'password = "s3cr3tpw{k}x"' for k in range(40)], "order 1234 5678 9012 3456 7", None, "")
    got = {r.doc_id: r.spans for r in pii.find_personal(own).collect()}
    assert [pii.KINDS[s.kind] for s in got[3]] == ["email", "phone"] and [pii.KINDS[s.kind] for s in got[43]] == ["secret"] and not got[80] and not got[81] and not got[82]
    assert all(0 <= s.score <= 1 for x in got.values() for s in x)
    assert not pii.find_personal(own.where("false")).count() and not pii.find_personal(docs("nothing here")).first().spans


def brute_spans(t):
    """Base spans and, of what the loose patterns find in the whole text, those that overlap neither a base span nor one that begins before them."""
    names = {n: k for k, n in enumerate(pii.KINDS)}
    base = [(names[n], s, e) for n, s, e in plain_spans(t)]
    loose = {(k, m.start(), m.end()) for k, p in ((0, pii.OBFUSCATED), (3, pii.LOCAL_PHONE), (4, pii.IBAN), (6, pii.SSN), (5, pii.MARKED)) for m in p.finditer(t)}
    loose |= {(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= sum(c.isdigit() for c in m[0]) <= 19}
    loose |= {(1, m.start(), m.end()) for m in pii.IP6.finditer(t) if pii.is_ip6(m[0])}
    for m in re.finditer("[:=]", t):
        if pii.KEYWORD.search(t[max(0, m.start() - pii.KEYED) : m.start()]) and (v := pii.VALUE.match(t, m.end())):
            loose.add((5, *v.span(1)))
    out, taken = [], set()
    for _, s, e in base:
        taken |= set(range(s, e))
    for k, s, e in sorted(loose, key=lambda x: (x[1], -x[2], x[0])):
        if taken.isdisjoint(range(s, e)):
            taken |= set(range(s, e))
            out.append((k, s, e))
    return base, out


def test_added_spans_equal_the_patterns():
    rng = random.Random(10)
    parts = ["a", "b.c", "@", " [at] ", "(at)", " dot ", "[dot]", ".", "-", "1", "22", "+", "(", ")", " ", "4111 1111 1111 1111", "3782 822463 10005", "me@x.org", "(415) 555-0100", "123-45-6789", "DE89 3704 0044 0532 0130 00", "password", "token", "=", ": ", "s3cr3tw0rd", "ghp_" + "a1B2" * 9, "fe80::1ff:fe23:4567:890a", "::", "é", "\n"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        base, loose = brute_spans(t)
        got = pii.disjoint(t)
        assert [x[:3] for x in got if x[3]] == base and sorted(x[:3] for x in got if not x[3]) == sorted(loose), t


def test_pii_query_against_brute_force(spark, documents):
    """The added spans of every document: what the patterns propose, kept where the classifier that all documents train says so."""
    own = [(r.doc_id, r.text or "") for r in documents.collect()]
    made = {i: pii.proposals(t) for i, t in own}
    counts = {}
    for spans in made.values():
        for x in spans:
            counts[x[3]] = counts.get(x[3], 0) + 1
    belief = pii.believed(counts)
    every = sorted((x[3], x[5]) for spans in made.values() for x in spans)  # fewer than the sample takes
    w = pii.train([f for _, f in every], __import__("numpy").array([belief[c] for c, _ in every]))
    got = {r.doc_id: r.spans for r in queries.op8_pii(spark, SF).collect()}
    for i, t in own:
        base, loose = brute_spans(t)
        facts = {x[:3]: x[5] for x in made[i]}
        kept = [x for x in loose if pii.chances(w, pii.padded([facts[x]]))[0] >= 0.5]
        assert got[i] == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in sorted(base + kept, key=lambda x: x[:2])), i


def planted(rng):
    """A sentence with personal data, or with what only looks so: text, its span, its kind (None for the latter)."""
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name, word = rng.choice(["ann", "bob.lee", "kim_7", "j.doe"]), rng.choice(["there", "today", "please", "now"])

    def card(head, n):
        body = head + digit(n - len(head) - 1)
        last = next(d for d in "0123456789" if pii.luhn(body + d))
        return body + last

    def iban():
        body = digit(18)
        return f"DE{98 - int(body + '131400') % 97:02}{body}"

    good = {
        "email": (f"write to {{}} {word}", f"{name}@site{digit(2)}.org"), "email2": (f"you can mail {{}} {word}", f"{name} [at] host{digit(1)} [dot] com"),
        "ip": (f"login from {{}} was seen {word}", f"10.{rng.randrange(256)}.{rng.randrange(256)}.7"), "ip2": (f"the server address is {{}} {word}", f"2001:db8:{digit(4)}::{digit(3)}:{digit(2)}"),
        "card": (f"paid with card {{}} {word}", card("4", 16)), "card2": (f"my credit card is {{}} {word}", card("37", 15)),
        "phone": (f"call {{}} {word}", f"+1 ({rng.randrange(200, 999)}) 555-0{digit(3)}"), "phone2": (f"phone: {{}} {word}", f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{digit(4)}"),
        "iban": (f"transfer to account {{}} {word}", iban()), "secret": ("password = {}", "x" + digit(3) + "Qz" + digit(4)), "secret2": (f"use the key {{}} {word}", "AKIA" + "".join(rng.choice("ABCDEFGH234567") for _ in range(16))),
        "ssn": (f"my social security number is {{}} {word}", f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{digit(4)}"),
    }
    bad = [(f"order number {{}} {word}", card("9", 15)[:-1] + "0"), (f"see part no {{}} {word}", f"666-00-{digit(4)}"), ("password: {}", "required"), (f"serial {{}} {word}", f"XX00{digit(16)}"), (f"table {{}} {word}", "1111111111111")]
    if rng.random() < 0.7:
        kind = rng.choice(sorted(good))
        frame, value = good[kind]
        return frame.format(value), value, kind.rstrip("2")
    frame, value = rng.choice(bad)
    return frame.format(value), value, None


def test_precision_and_recall_of_planted_spans(docs):
    """Of each of the seven kinds; a document has words between its planted sentences."""
    rng, texts, want = random.Random(12), [], []
    for n in range(400):
        text, spans = "", set()
        for _ in range(rng.randrange(1, 4)):
            text += " ".join(rng.choice(["river", "stone", "walks", "over", "quiet"]) for _ in range(rng.randrange(3, 12))) + ". "
            sentence, value, kind = planted(rng)
            at = len(text) + sentence.index(value)
            text += sentence + ". "
            if kind:
                spans.add((kind, at, at + len(value)))
        texts.append(text), want.append(spans)
    got = {r.doc_id: {(pii.KINDS[s.kind], s.start, s.end) for s in r.spans} for r in pii.find_personal(docs(*texts)).collect()}
    told = {}
    for kind in pii.KINDS:
        found, planted_spans = [{x for x in got[n] if x[0] == kind} for n in range(400)], [{x for x in w if x[0] == kind} for w in want]
        right, n, m = sum(len(a & b) for a, b in zip(found, planted_spans)), sum(map(len, found)), sum(map(len, planted_spans))
        told[kind] = (round(right / max(n, 1), 3), round(right / m, 3), m)
    print("precision, recall, planted:", told)
    assert all(p >= 0.9 and r >= 0.9 for p, r, _ in told.values()), told


def test_em_finds_the_good_labelers():
    import numpy as np

    rng = np.random.default_rng(0)
    truth, right = rng.random(4000) < 0.4, (0.95, 0.9, 0.85, 0.55, 0.9)
    votes = np.stack([np.where(rng.random(4000) < p, truth, ~truth) * 2 - 1 for p in right], 1)
    p, table = pii.reliabilities(np.zeros(4000, int), votes, np.ones(4000))
    assert ((p > 0.5) == truth).mean() > 0.97 and table[0, 1, 2] > table[3, 1, 2]
