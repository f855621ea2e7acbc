"""Operator 7: base spans against the patterns applied as they stand, and the added kinds."""

import hashlib
import random
import re
import time

from tavola.llm.pii import BASE_KINDS, find_pii, luhn, mod_97, pii_report, redact, redact_documents, spans

from .fixtures import ROWS, frame, key, sample

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p) < 4000 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = digits(m[0])
        if 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10
                                      for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return out


PERSONAL = [(900, "Mail a.b+c@x-y.example.com, card 4111 1111 1111 1111 or 4111-1111-1111-1112, +1 (555) 555-0100 from 010.2.3.255"),
            (901, "é 1.2.3.4.5.6.7.8 and 1.2.3.256 a@b.c_d@e.f @x.y z@w"),
            (902, 'iban GB82 WEST 1234 5698 7654 32; ssn 123-45-6789; token = "cb1a9fee807a05366fcb8b6c95c7c565ede51a72"'),
            (903, "GB83 WEST 1234 5698 7654 32 and 123-45-6789 and cb1a9fee807a05366fcb8b6c95c7c565ede51a72")]


def test_report(spark):
    rng = random.Random(3)
    rows = ROWS + sample() + PERSONAL
    rows += [(k, "".join(rng.choice("ab@.%_-+1290 ()9@.") for _ in range(60))) for k in range(1000, 3000)]
    want = []
    for d, t in rows:
        found = brute(t or "")
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()
        want.append((d, *([f[0] for f in found].count(k) for k in BASE_KINDS), digest))
    got = pii_report(frame(spark, rows)).collect()
    assert key(tuple(r)[:-1] for r in got) == key(want)
    base_only = lambda s: [x for x in s.split(",") if x.split(":")[0] in BASE_KINDS]
    assert key((r.doc_id, base_only(r.spans)) for r in got) == key(
        (d, [f"{k}:{a}:{b}" for k, a, b in brute(t or "")]) for d, t in rows)
    assert pii_report(frame(spark, [])).count() == 0


def test_checks_and_context():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert mod_97("GB82WEST12345698765432") and not mod_97("GB83WEST12345698765432")
    assert [s.kind for s in spans(PERSONAL[2][1])] == ["iban", "ssn", "secret"]
    assert spans(PERSONAL[3][1]) == []  # a wrong check number; no context word near the others
    assert redact("write to a@b.cd, now") == "write to [EMAIL], now"


def test_find_and_redact(spark):
    df = frame(spark, ROWS + PERSONAL)
    found = {r.doc_id: r.spans for r in find_pii(df).where("doc_id >= 900").collect()}
    assert [s.kind for s in found[900]] == ["email", "ip", "card", "phone"] and found[903] == []
    out = redact_documents(df)
    assert out.columns == df.columns
    assert key((r.doc_id, r.text) for r in out.collect()) == key((d, t and redact(t)) for d, t in ROWS + PERSONAL)


def test_linear_on_long_runs():
    began = time.process_time()
    for text in ("7" * 200000, "a." * 100000 + "@", "@" * 100000, "+1" * 100000, "1.1." * 50000, "x-" * 100000):
        spans(text)
    assert time.process_time() - began < 5


def test_iban_before_capitals_and_digits():
    for code in ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NO9386011117947"):
        for before in ("", "AB12 3456 7890 1234 ", "REF 77 "):  # a failed start ahead of it
            for after in (" BIC COBADEFF", " 100 EUR", " I sent", " 2024-05-01", "", ".", " DE89370400440532013001"):
                text = before + code + after
                assert [text[s.start:s.end] for s in spans(text) if s.kind == "iban"] == [code], text
    assert redact("DE89370400440532013000 GB82 WEST 1234 5698 7654 32 BIC") == "[IBAN] [IBAN] BIC"
    assert redact("DE89370400440532013000BIC") == "DE89370400440532013000BIC"


def test_iban_of_unknown_country():
    code = next(c for k in range(100) if mod_97(c := f"ZZ{k:02}123456789012345"))
    assert redact(f"to {code} IN EUR 7") == "to [IBAN] IN EUR 7"


def test_long_secret():
    rng = random.Random(5)
    secret = "".join(rng.choice("abcdefghijklmnop0123456789") for _ in range(5000))
    assert redact(f"token = {secret};") == "token = [SECRET];"


def test_linear_on_failing_ibans():
    began = time.process_time()
    for text in ("AB12 " * 40000, "AB12 CD34EFGH " * 15000, "A" * 200000):
        spans(text)
    assert time.process_time() - began < 10
