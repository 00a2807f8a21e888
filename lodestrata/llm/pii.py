"""Personal data by weak supervision.

Patterns propose spans: the strict ones of the four base kinds, and looser ones. Five labelers vote on each span, for (1),
against (-1) or not at all (0): its strict pattern; its check digits or ranges; a gazetteer of domains, calling codes,
issuers and marks of secrets; the words before it; and the variety of its characters. Votes of all spans of all documents are counted by pattern of votes, and
expectation-maximisation (Dawid and Skene's model, one table of reliabilities for each labeler, one prior for each kind)
turns the counts into probabilities. A logistic regression learns these: the final classifier of spans. It sees the votes, and what no labeler
sees: a span's shape, its length and shares of digits and capitals, the words on both sides, and how many spans of which kinds its document has. It learns from
about `sample_spans` spans of each kind, chosen by hash over all documents. Base spans always stay; the others stay where the classifier says so and no base span
overlaps. Of two loose spans that overlap the one that begins first stays a proposal, then the longer.

The words around a span are looked for within AROUND characters; a keyword stands within KEYED characters before its secret; the local part of a
written-out address (name [at] site) has 64 characters at most. Starts and ends are code points, end exclusive. Null and empty texts have no spans. Every row gives
one row, repeated rows too (each counts for the votes). With no spans at all nothing is trained.
"""

from __future__ import annotations

import ipaddress
import re
import zlib
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, stored

#: Base kinds in their order, then those that only the method adds.
KINDS = ("email", "ip", "card", "phone", "iban", "secret", "ssn")
BASE = 4
LABELERS = ("pattern", "check", "gazetteer", "context", "variety")
#: Votes that a labeler is believed to have cast before any is seen, of spans that are personal data: against, none, for. It keeps the classes from changing places.
BELIEF = (4.0, 12.0, 24.0)
AROUND, KEYED = 48, 24
#: Rows of the classifier's table of weights.
TABLE = 1 << 14
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
IP6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_PHONE = re.compile(r"(?<![0-9+(-])\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
KEYWORD = re.compile(r"(?:password|passwd|pwd|token|secret|api[ _-]?key|access[ _-]?key|private[ _-]?key)[\"']?[ \t]*$", re.I)
VALUE = re.compile(r"[ \t]*[\"']?([A-Za-z0-9+/_.~-]{7,}[A-Za-z0-9+/_~-]={0,2})")
OBFUSCATED = re.compile(r"([A-Za-z0-9._%+-]{1,64}) ?[\[(] ?at ?[\])] ?([A-Za-z0-9-]{1,63}(?:(?: ?[\[(] ?dot ?[\])] ?|\.)[A-Za-z0-9-]{1,63})+)", re.I)
#: Secrets that tell what they are by how they begin; their forms are fixed by those who issue them.
MARKED = re.compile(r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})")
#: Gazetteers: ends of domains, calling codes by first digits, issuers' first digits.
DOMAIN_ENDS = frozenset("com org net edu gov mil int info biz io co ai app dev me tv us ca mx br ar cl pe uk ie fr de at ch be nl lu dk se no fi is es pt it gr pl cz sk hu ro bg ru ua tr il za eg ng ke in pk cn hk tw jp kr sg my th id ph vn au nz eu".split())
CALLING = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 354 358 380 420 421 852 886 971 972".split())
ISSUERS = tuple("4 51 52 53 54 55 22 23 24 25 26 27 34 37 36 38 62 65 644 6011 3528 3589".split())
COUNTRIES = frozenset("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split())
EMPTY_SECRETS = frozenset("password changeme required undefined example placeholder".split())
CONTEXT = {
    "email": "mail contact write reach address courriel correo", "ip": "ip address host server client from login", "card": "card credit debit visa mastercard payment pay account karte carte tarjeta",
    "phone": "phone tel call mobile fax cell contact sms ruf appel", "iban": "iban bank account transfer konto compte cuenta", "secret": "password token secret key login", "ssn": "ssn social security number taxpayer",
}
AGAINST = re.compile(r"\b(?:version|ver|v|isbn|section|chapter|figure|table|page|order|invoice|ratio|part|serial|tracking)\W*(?:(?:no|nr|number|id)\W*)?$", re.I)
SAID = {k: re.compile(r"\b(?:" + "|".join(v.split()) + r")", re.I) for k, v in CONTEXT.items()}
WORDS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def in_ranges(ip: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in ip.split("."))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, from each @ outwards: a local part can't cross one, so the time is linear."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            out.append((begin, m.end()))
            end = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start."""
    out = [(0, *x) for x in emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        if "." in text:
            out += [(1, *m.span()) for m in IP.finditer(text) if in_ranges(m[0])]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans that the looser patterns propose."""
    out = []
    if ("[" in text or "(" in text) and re.search(r"[\[(] ?at ?[\])]", text, re.I):
        out += [(0, *m.span()) for m in OBFUSCATED.finditer(text)]
    if re.search("[0-9]", text):
        if "-" in text:
            out += [(6, *m.span()) for m in SSN.finditer(text)]
        out += [(3, *m.span()) for m in LOCAL_PHONE.finditer(text)]
        out += [(4, *m.span()) for m in IBAN.finditer(text)]
        for m in CARD.finditer(text):
            if 13 <= len(digits_of(m[0])) <= 19:
                out.append((2, *m.span()))
    if "=" in text or ":" in text:
        for m in re.finditer("[:=]", text):
            if KEYWORD.search(text[max(0, m.start() - KEYED) : m.start()]) and (v := VALUE.match(text, m.end())):
                out.append((5, *v.span(1)))
    out += [(5, *m.span()) for m in MARKED.finditer(text)]
    if text.count(":") > 1:
        out += [(1, *m.span()) for m in IP6.finditer(text) if is_ip6(m[0])]
    return out


def is_ip6(text: str) -> bool:
    """With five digits at least: `::` and times of day are none."""
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return sum(c != ":" for c in text) >= 5


def iban_holds(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def vote(text: str, kind: int, start: int, end: int, strict: bool) -> tuple[int, ...]:
    """What each of LABELERS says of a span."""
    span, name = text[start:end], KINDS[kind]
    digits = digits_of(span)
    before = text[max(0, start - AROUND) : start]
    if kind == 0:
        check, known = 0, 1 if span.rpartition(".")[2].lower() in DOMAIN_ENDS else 0
    elif kind == 1:
        check, known = 1 if strict or ":" in span else -1, -1 if span.startswith(("0.", "127.", "255.")) else 0
    elif kind == 2:
        check, known = 1 if luhn(digits) else -1, 1 if digits.startswith(ISSUERS) else -1
    elif kind == 3:
        check, known = 1 if 8 <= len(digits) <= 15 else -1, (1 if digits.startswith(CALLING) else 0) if span[0] == "+" else 0
    elif kind == 4:
        check, known = 1 if iban_holds(span) else -1, 1 if span[:2] in COUNTRIES else -1
    elif kind == 6:
        check, known = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" else 1, 0
    else:
        check, known = 1 if re.search("[0-9]", span) else -1, 1 if MARKED.match(span) else -1 if span.lower() in EMPTY_SECRETS else 0
    context = 1 if SAID[name].search(before) else -1 if AGAINST.search(before) else 0
    variety = -1 if len(set(digits if name in ("card", "phone", "iban", "ssn") else span)) <= 2 else 1 if len(set(span)) >= 5 else 0
    return (1 if strict else 0), check, known, context, variety


def disjoint(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base): base spans, and loose ones that neither a base span nor an earlier loose one overlaps."""
    base = base_spans(text)
    spans, taken = [(*x, True) for x in base], []  # disjoint stretches in order
    for s, e in sorted((s, e) for _, s, e in base):
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    for x in sorted(set(loose_spans(text)), key=lambda x: (x[1], -x[2], x[0])):
        k = bisect(taken, (x[1], x[2]))
        if (k == 0 or taken[k - 1][1] <= x[1]) and (k == len(taken) or x[2] <= taken[k][0]):
            taken.insert(k, (x[1], x[2]))
            spans.append((*x, False))
    return spans


def shape_of(span: str) -> str:
    """Runs of digits, capitals, letters and signs, each run once; at most sixteen runs tell."""
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[0-9]", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", span[:256]))))[:16]


def facts(text: str, kind: int, start: int, end: int, votes: tuple[int, ...], kinds: Counter) -> list[int]:
    """Rows of the classifier's table: of the kind, each vote, the shape, the words around and the document."""
    span = text[start:end]
    share = lambda n: min(4, 5 * n // (end - start))
    before, after = WORDS.findall(text[max(0, start - AROUND) : start])[-2:], WORDS.findall(text[end : end + AROUND])[:1]
    out = ["", f"shape {shape_of(span)}", f"length {min(7, (end - start) // 6)}", f"digits {share(sum(c.isdigit() for c in span))}", f"capitals {share(sum(c.isupper() for c in span))}", f"distinct {min(9, len(set(span)) // 2)}"]
    out += [f"vote {n} {v}" for n, v in zip(LABELERS, votes)] + [f"before {w.lower()}" for w in before] + [f"after {w.lower()}" for w in after]
    out += [f"left {text[start - 1 : start]}", f"right {text[end : end + 1]}", f"same {min(4, kinds[kind].bit_length())}", f"others {min(4, (kinds.total() - kinds[kind]).bit_length())}"]
    return [zlib.crc32(f"{kind} {x}".encode()) % TABLE for x in out]


def proposals(text: str) -> list[tuple[int, int, int, int, bool, list[int]]]:
    """(kind, start, end, pattern of votes, base, facts)."""
    spans = disjoint(text)
    kinds, out = Counter(k for k, *_ in spans), []
    for kind, s, e, strict in spans:
        votes, code = vote(text, kind, s, e, strict), kind
        for v in votes:
            code = code * 3 + v + 1
        out.append((kind, s, e, code, strict, facts(text, kind, s, e, votes, kinds)))
    return out


def decoded(code: int) -> tuple[int, list[int]]:
    """Kind and votes of a code."""
    votes = []
    for _ in LABELERS:
        code, v = divmod(code, 3)
        votes.append(v - 1)
    return code, votes[::-1]


def reliabilities(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: the probability of each row of votes, and for each labeler P(vote | class)."""
    n = votes.shape[1]
    seen = np.where(votes == 0, 0.5, votes > 0)
    said = (votes != 0).sum(1)
    p = np.clip(np.where(said, (seen * (votes != 0)).sum(1) / np.maximum(said, 1), 0.5), 0.05, 0.95)  # the majority to begin with
    table = np.zeros((n, 2, 3))
    for _ in range(rounds):
        prior = np.array([(1 + (p * counts)[kinds == k].sum()) / (2 + counts[kinds == k].sum()) for k in range(len(KINDS))])
        for j in range(n):
            for v in (-1, 0, 1):
                of = votes[:, j] == v
                table[j, 1, v + 1], table[j, 0, v + 1] = BELIEF[1 + v] + (p * counts)[of].sum(), BELIEF[1 - v] + ((1 - p) * counts)[of].sum()
        table /= table.sum(2, keepdims=True)
        log = np.log(prior[kinds]) - np.log(1 - prior[kinds])
        for j in range(n):
            log = log + np.log(table[j, 1, votes[:, j] + 1]) - np.log(table[j, 0, votes[:, j] + 1])
        p = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return p, table


def believed(counts: dict[int, int]) -> dict[int, float]:
    """The probability that a span is personal data, by its pattern of votes, from how often each occurs."""
    if not counts:
        return {}
    codes = sorted(counts)
    kinds, votes = (np.array(x) for x in zip(*map(decoded, codes)))
    p, _ = reliabilities(kinds, votes, np.array([counts[c] for c in codes], float))
    return dict(zip(codes, p.tolist(), strict=True))


def padded(rows: list[list[int]]) -> np.ndarray:
    """Rows of facts of one width; TABLE stands for none."""
    out = np.full((len(rows), max(map(len, rows), default=0)), TABLE, np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def train(rows: list[list[int]], p: np.ndarray, rounds: int = 200, rate: float = 0.3, decay: float = 1e-5) -> np.ndarray:
    """Weights of a logistic regression of probabilities p on rows of facts."""
    w, square = np.zeros(TABLE + 1), np.full(TABLE + 1, 1e-8)
    x = padded(rows)
    for _ in range(rounds if len(rows) else 0):
        off = (chances(w, x) - p) / len(p)
        slope = np.bincount(x.ravel(), np.repeat(off, x.shape[1]), TABLE + 1) + decay * w
        slope[TABLE] = 0
        square += slope**2
        w -= rate * slope / np.sqrt(square)
    return w


def chances(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[x].sum(1), -30, 30)))


SPANS = "array<struct<kind:int,start:int,end:int,code:int,base:boolean,facts:array<int>>>"


def fit(proposed: DataFrame, sample_spans: int) -> np.ndarray:
    """The classifier, from the proposals of all documents."""
    spans = proposed.select("doc_id", F.explode("spans").alias("x")).select("doc_id", "x.*")
    counts = {r["code"]: r["count"] for r in spans.groupBy("code").count().collect()}  # kinds x votes: 1701 rows at most
    belief, of_kind = believed(counts), Counter()
    for code, n in counts.items():
        of_kind[decoded(code)[0]] += n
    chance = F.element_at(F.array(*(F.lit(min(1.0, sample_spans / max(1, of_kind[k]))) for k in range(len(KINDS)))), F.col("kind") + 1)
    place = F.pmod(F.xxhash64(F.lit("span"), "doc_id", "start", "end"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = sorted((r["code"], list(r["facts"])) for r in spans.where(place < chance).select("code", "facts").collect())  # the sample
    return train([f for _, f in some], np.array([belief[c] for c, _ in some]))


def find_personal(docs: DataFrame, least: float = 0.5, sample_spans: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: kind, start, end, base, score (the classifier's), by kind, then start."""

    def propose(data: list[bytes]) -> dict:
        keys = ("kind", "start", "end", "code", "base", "facts")
        return {"spans": [[dict(zip(keys, x)) for x in proposals(t.decode("utf-8", "replace"))] for t in data]}

    proposed = stored(map_texts(docs, propose, f"spans {SPANS}", id_col, text_col), "pii")
    sent = docs.sparkSession.sparkContext.broadcast(fit(proposed, sample_spans))
    schema = f"doc_id {proposed.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:int,start:int,end:int,base:boolean,score:double>>"
    span_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column("spans").to_pylist()
            scores = iter(chances(sent.value, padded([s["facts"] for spans in every for s in spans or ()])).tolist())
            rows = []
            for spans in every:
                told = [{"kind": s["kind"], "start": s["start"], "end": s["end"], "base": s["base"], "score": next(scores)} for s in spans or ()]
                rows.append(sorted((s for s in told if s["base"] or s["score"] >= least), key=lambda s: (s["kind"], s["start"])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, span_type)], ["doc_id", "spans"])

    return proposed.mapInArrow(settle, schema)
