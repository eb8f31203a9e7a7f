"""Personal data in texts: regular expressions propose spans, checks confirm them, words nearby move the score.

Base kinds (always kept once their check holds): email, ip (parts at most 255), card (12 to 19 digits, Luhn), phone (+ and 9 to 15
digits), each leftmost and without overlap within its kind.  The method adds spans of score 0.5 or more that overlap no base span:

* iban: country, two check digits and 11 to 30 more, mod-97 equal to 1 (score 0.9; with a bank word nearby 1.0);
* national: ten digits grouped 3-3-4 without a +, score 0.3, 0.7 with a telephone word within five words, 0 next to a word that
  names another kind of number;
* ssn: 3-2-4 digits in an assigned range, score 0.3, 0.8 with an identity word nearby.

Scanning is linear in the text, also in long runs of digits or letters without an end.  A card's or phone's failing match is dropped and
not retried at a shorter length.

Defined cases: null and empty texts have no spans.  Positions are code points, ends exclusive.  Spans are ordered by start, then by
kind in the order of KINDS.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrose.llm.common import pieces

KINDS = ("email", "ip", "card", "phone", "iban", "national", "ssn")
BASE_KINDS = KINDS[:4]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
RUN = re.compile(r"[0-9]+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![0-9A-Za-z+(.-])\(?[2-9][0-9]{2}\)?[\x20.-]{1,2}[2-9][0-9]{2}[\x20.-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])")
SSN = re.compile(r"(?<![0-9A-Za-z.-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z]|[.-][0-9])")
WORD = re.compile(r"\w+")
REACH = 60          # code points before a span in which context words are looked up, at most five words
PHONE_WORDS = frozenset("phone telephone tel call mobile cell fax téléphone telefon teléfono móvil handy".split())
OTHER_WORDS = frozenset("order invoice part serial version isbn tracking bestellung factura commande".split())
BANK_WORDS = frozenset("iban account konto cuenta compte bank banque banco transfer".split())
IDENTITY_WORDS = frozenset("ssn social security taxpayer identity".split())
DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)       # digit sum of twice a digit


def luhn(digits: str) -> bool:
    d = [ord(c) - 48 for c in digits]
    return (sum(d[-1::-2]) + sum(DOUBLED[x] for x in d[-2::-2])) % 10 == 0


def mod97(code: str) -> bool:
    code = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in code)) % 97 == 1


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in LOCAL:
            lo -= 1
        m = DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            yield lo, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind number, end) of the base kinds."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    ip_done = card_done = 0
    for run in RUN.finditer(text):
        p, q = run.span()
        if p >= ip_done and text[q:q + 1] == "." and (m := IP.match(text, p)):
            ip_done = m.end()
            if all(map(small, m.groups())):
                out.append((p, 1, ip_done))
        if p >= card_done and (m := CARD.match(text, p)):
            card_done = m.end()
            if m.end() - p >= 12:
                d = digits_of(m.group())
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((p, 2, card_done))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    out.sort()
    return out


def near(text: str, start: int) -> set[str]:
    return set(WORD.findall(text[max(0, start - REACH):start].lower())[-5:])


def added_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, int, float]]:
    """(start, kind number, end, score) of the spans that the method adds."""
    found = []
    for m in IBAN.finditer(text):
        code = m.group().replace(" ", "")
        if 15 <= len(code) <= 34 and mod97(code):
            found.append((m.start(), 4, m.end(), 1.0 if near(text, m.start()) & BANK_WORDS else 0.9))
    for m in NATIONAL.finditer(text):
        words = near(text, m.start())
        found.append((m.start(), 5, m.end(), 0.0 if words & OTHER_WORDS else 0.7 if words & PHONE_WORDS else 0.3))
    for m in SSN.finditer(text):
        found.append((m.start(), 6, m.end(), 0.8 if near(text, m.start()) & IDENTITY_WORDS else 0.3))
    return [x for x in found if x[3] >= 0.5 and not any(x[0] < e and s < x[2] for s, _, e in base)]


def spans_of(text: str | None) -> tuple[list, list]:
    """Base spans and all spans, each (start, kind number, end)."""
    if not text or not ("@" in text or RUN.search(text)):
        return [], []
    base = base_spans(text)
    return base, sorted(base + [x[:3] for x in added_spans(text, base)])


def written(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def masked(text: str, spans: list) -> str:
    """The text with each span, or each run of overlapping spans, replaced by its (first) kind."""
    out, done = [], 0
    for s, k, e in spans:
        if s >= done:
            out += [text[done:s], f"<{KINDS[k].upper()}>"]
        done = max(done, e)
    return "".join(out) + text[done:]


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row."""
    def run(batches):
        for b in pieces(batches):
            counts, digest, spans, added = [[], [], [], []], [], [], []
            for text in b.column("text").to_pylist():
                base, every = spans_of(text)
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in base))
                digest.append(hashlib.sha256(written(base).encode()).hexdigest()), spans.append(written(every)), added.append(len(every) - len(base))
            yield pa.RecordBatch.from_arrays([b.column("doc_id")] + [pa.array(c, pa.int64()) for c in counts] + [pa.array(digest), pa.array(spans), pa.array(added, pa.int64())],
                                             ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; a column n_chars follows the new text."""
    names, schema = docs.columns, docs.schema

    def run(batches):
        for b in pieces(batches):
            old = b.column("text").to_pylist()
            new = [masked(t, s) if t and (s := spans_of(t)[1]) else t for t in old]
            cols = [pa.array(new, b.column(i).type) if n == "text" else b.column(i) for i, n in enumerate(names)]
            if "n_chars" in names:
                i = names.index("n_chars")
                size = [len(y) if x != y else n for x, y, n in zip(old, new, b.column(i).to_pylist())]
                cols[i] = pa.array(size, b.column(i).type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, schema)
