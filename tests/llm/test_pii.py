"""Spans against Python's patterns."""

import hashlib
import re

from presswork.llm import pii
from presswork.llm.queries import op2_pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def base(text):
    found = [(m.start(), r, k, m.end()) for r, (k, rx) in enumerate(PLAIN.items()) for m in re.finditer(rx, text or "") if good(k, m[0])]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (r, want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in PLAIN]
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans)


def test_op2(spark, medium):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    check(op2_pii(spark, medium).collect(), texts)


HARD = [
    None, "", "é😀 a@b.c_x@d.e-f.g a@b a@b..c @x.y x@.y", "1.2.3.4.5.6.7.8 256.1.1.1 000255.0.0.01 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4 1 1",
    "+1 (017) 555-7713. +49 30 1234567890123 +1", "+12345678 ", "++123456789", "1.1.1.1+1 234 567 890 a@1.2.3.4", "9" * 4000, "a" * 5000 + "@", "a.b." * 3000 + "@x" + ".y" * 5000,
    "4111111111111111@a.b", "٤111 1111", "\x00a@b.c\x00", "+1((((((((((2", "2013 2014 2015 4012888888881881 5", "a@b.c" * 3, "+1 2345 6789 +1 2345 67890",
]


def test_hard_texts(spark):
    texts = dict(enumerate(HARD))
    df = spark.createDataFrame([(k, t, "s", 1) for k, t in texts.items()], "doc_id long, text string, spans string, base_spans int")
    check(pii.find_pii(df).collect(), texts)
    assert pii.find_pii(df.where("false")).count() == 0


def test_added_spans_and_redaction(spark):
    rows = [(1, 'set token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" now'), (2, "plain words without any data, 2019-2020 and 12 34"), (3, "x a@b.c and 4111 1111 1111 1111, call 10.0.0.1."), (4, None), (5, "my SSN 078-05-1120 ok"), (6, "a@b.c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find_pii(df).collect()}
    assert spans[1].startswith("secret:13:53") and spans[2] == "" and spans[5] == "ssn:7:18"
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert out[1] == 'set token = "[SECRET]" now' and out[2] == rows[1][1] and out[4] is None and out[6] == "[EMAIL]"
    assert out[3] == "x [EMAIL] and [CARD], call [IP]."
