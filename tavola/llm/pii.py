"""Personal data by patterns, checksums and context (operator 7).

Regular expressions propose spans.  Validators confirm them: Luhn for card
numbers, mod-97 for IBANs, ranges and digit counts for addresses and phones,
letter and digit mixture for secrets.  Each kind has a base score; context words
within ``REACH`` code points before the span (or a few after it) raise it, and
spans under the threshold are dropped.  The four base kinds stand on their
checks alone: they always reach the threshold.

Every text is scanned whole, once per kind, in time linear in its length (no
pattern can start twice in one run of its characters), and there is no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_from, id_and_text, rows_of

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")  # order of listing
BASE_KINDS = KINDS[:4]
THRESHOLD = 0.6
REACH = 40

# Base score of each kind, and what a context word near the span adds.
SCORES = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "secret": 0.3}
CONTEXT_GAIN = 0.35
# Characters of an IBAN by country code.
IBAN_LENGTHS = {c: n for n, codes in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in codes.split()}
CONTEXT = {
    "email": ("mail", "contact", "e-mail"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "debit"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("token", "key", "secret", "password", "passwd", "apikey", "api_key", "bearer"),
}

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits starts a match at its first digit or nowhere: hence the look-behind after it.
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"[0-9](?<![0-9-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"[A-Za-z0-9_](?<![A-Za-z0-9_+/-][A-Za-z0-9_])[A-Za-z0-9_+/-]{23,}+")
WORD = re.compile(r"[a-z][a-z_-]*")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod_97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern, found from each @ outward."""
    free, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > free and text[start - 1] in LOCAL:
                start -= 1
        if start < at:
            yield start, domain.end()
            free = domain.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """IBANs from left to right: each start with the end its country fixes, else the longest that passes mod-97."""
    m = IBAN.search(text)
    while m:
        start, at = m.start(), m.start() + 1  # behind a failed start
        ends = [m.end(), *(start + k for k in range(len(m[0]) - 1, 0, -1) if m[0][k] == " ")]
        coded = [(end, len(code), code) for end in ends if 15 <= len(code := text[start:end].replace(" ", "")) <= 34]
        length = IBAN_LENGTHS.get(m[0][:2])
        if length:  # of a known country: its length, or all that stands there
            coded = [c for c in coded if c[1] == length] + coded[:1]
        for end, _, code in coded:
            if mod_97(code):
                yield start, end
                at = end
                break
        m = IBAN.search(text, at)


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans of each kind, kinds in order, each from left to right."""
    for start, end in emails(text):
        yield "email", start, end
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        digits = _digits(m[0]) if 16 <= len(m[0]) <= 37 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    for m in PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            yield "phone", *m.span()
    for start, end in ibans(text):
        yield "iban", start, end
    for m in SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", *m.span()
    for m in SECRET.finditer(text):
        if len(set(m[0])) >= 8 and any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
            yield "secret", *m.span()


def spans(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """Scored spans at or over the threshold, by kind as listed, then start."""
    out = []
    for kind, start, end in proposals(text):
        near = set(WORD.findall(text[max(0, start - REACH):start].lower())) | \
            set(WORD.findall(text[end:end + REACH // 4].lower()))
        score = min(1.0, SCORES[kind] + CONTEXT_GAIN * any(w in near for w in CONTEXT[kind]))
        if score >= threshold or kind in BASE_KINDS:
            out.append(Span(kind, start, end, score))
    return out


def told(found: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found)


def redact(text: str, threshold: float = THRESHOLD) -> str:
    """The text with each span replaced by its kind; overlapping spans become one, named by the first."""
    out, at = [], 0
    for s in sorted(spans(text, threshold), key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at:s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join(out) + text[at:] if out else text


def find_pii(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end, score; code points, end exclusive) of every row.

    A null text has no spans; a null id stays null; repeated rows give repeated
    results; an empty table gives no rows; other columns are ignored.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(kind))])

    def run(batches):
        return batches_from(((d, [s._asdict() for s in spans(t, threshold)]) for d, t in rows_of(batches, "doc_id", "text")),
                            schema, 512)

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double>>")


def pii_report(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text; cases as ``find_pii``."""
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS),
                        ("base_sha256", pa.string()), ("spans", pa.string())])

    def rows(batches):
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            found = spans(text, threshold)
            base = [s for s in found if s.kind in BASE_KINDS]
            kinds = [s.kind for s in base]
            yield (doc_id, *map(kinds.count, BASE_KINDS), hashlib.sha256(told(base).encode()).hexdigest(), told(found))

    return id_and_text(docs, id_col, text_col).mapInArrow(
        lambda b: batches_from(rows(b), schema),
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_documents(docs: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The input with every span of ``text_col`` replaced; all columns, whatever their names.

    Null and empty texts stay as they are, ids are not read, repeated rows are
    treated alike, an empty table gives no rows.
    """
    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else redact(t, threshold))

    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))
