from __future__ import annotations

import re

from pyspark.sql import functions as F

from factloom.llm import pii
from tests.llm import odd


def luhn(s):
    return sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
}
TEXTS = [
    "a@b.c_x@y.z a@b@c.d %+@a-b.-. x@y", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 1.2.3 99999999999999999999999.1.1.1", "4111 1111-1111 1111 4111111111111112 41111111111111114111111111111111 4111-1111-1111-1111-",
    "+1 (234) 555-0199 tel +49 30 1234567. ++1--2--3--4--5--6--7 +1 2 +123456789012345678", "é😀 x@é.com é@x.com 😀a.b@c.de😀", "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 or DE88370400440532013000",
    'token = "04dbebab91ab85687d33eeaaf9ac699e118" api_key: ABCDEFGHIJKLMNOPQRSTUVWX', "1-2 3-4 5 " * 200, "a" * 5000 + "@b.c", "7" * 3000, "x.y@z.co, " * 300, "1.1.1.1 " * 200,
]


def brute(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in BASE.items() for m in re.finditer(p, text or "") if ok(m[0])]


def test_base_spans_equal_brute_force(spark):
    docs = odd.rows(6) + [(2000 + i, t) for i, t in enumerate(TEXTS)] + [(3000, "".join(TEXTS))]
    found = sorted(((r.doc_id or -1, [(s.kind, s.start, s.end) for s in r.spans if s.kind in BASE]) for r in pii.find_pii(odd.frame(spark, docs)).collect()), key=str)
    assert found == sorted(((i or -1, brute(t)) for i, t in docs), key=str)


def test_added_kinds_and_scores(spark):
    found = {r.doc_id: r.spans for r in pii.find_pii(odd.frame(spark, list(enumerate(TEXTS)))).collect()}
    spans = lambda i, kind: [TEXTS[i][s.start : s.end] for s in found[i] if s.kind == kind]
    assert spans(5, "iban") == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    assert spans(6, "secret") == ["04dbebab91ab85687d33eeaaf9ac699e118"]
    assert {s.score for s in found[3] if s.kind == "phone"} == {0.7}
    alone = pii.find_pii(odd.frame(spark, [(1, "x +1 (234) 555-0199")])).collect()[0].spans
    assert [s.score for s in alone] == [0.6]
    assert pii.find_pii(odd.empty(spark)).count() == 0


def test_redaction(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["mail a@b.co now", "card 4111 1111 1111 1111!", None, "", "nothing 1.2 +1", "call +1 (234) 555-0199", "at 10.0.0.1", 'token="abcdef0123456789abcd" x'])], "i int, text string")
    got = [r[0] for r in docs.orderBy("i").select(pii.redacted(F.col("text"))).collect()]
    assert got == ["mail [EMAIL] now", "card [CARD]!", None, "", "nothing 1.2 +1", "call [PHONE]", "at [IP]", 'token="[SECRET]" x']
