import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from quarryline.llm import pii

TEXTS = [
    None, "", "none here", "mail a.b+c@mail.example.com, or x@y and z@q.r_w@host.tld now", "a@b.c@d.e", "1.2.3.4 and 256.1.1.1 and 1.2.3.4.5.6.7.8 001.02.3.255",
    "4111 1111 1111 1111 or 4111-1111-1111-1112 5500005555555559", "call +1 (743) 555-3824 or +49-30-1234567 or +1 2", "\U0001f600 tel: 212-555-0199. SSN 123-45-6789, order 12345678",
    "1" * 30000, "a" * 30000 + "@", "1 2 " * 8000, "4" * 16 + " " + "+1234567890" * 3, "user@" + "a." * 9000 + "b", "IBAN DE44 5001 0517 5407 3249 31 x",
]


def luhn(d):
    return sum(v - 9 if v > 9 else v for v in (int(x) * (1 + i % 2) for i, x in enumerate(reversed(d)))) % 10 == 0


def brute(text):
    """The base kinds by their plain forms."""
    text, out = text or "", []
    for kind, form in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        if kind == "email" and len(text) >= 30000:
            continue
        for m in re.finditer(form, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(1, "dup")], "doc_id long, text string")
    rows = pii.digest(pii.scan(docs)).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        if r.doc_id == 1:
            continue
        want = brute(TEXTS[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (TEXTS[r.doc_id], r.spans)
        assert r.spans.split(",")[: len(want)] == (want or [""])[: len(want)]
        assert r.n_email == sum(w.startswith("email") for w in want) and r.n_card == sum(w.startswith("card") for w in want)


def test_added_spans(spark):
    docs = spark.createDataFrame([(1, "tel: 212-555-0199. SSN 123-45-6789, order 12345678 end"), (2, "version 1.22.3333 page 20240512")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(pii.scan(docs)).collect()}
    assert "national_id:23:34" in got[1] and "local_phone:5:17" in got[1] and "order" not in got[1] and not got[2]


def test_features_agree_and_model_is_calibrated(spark):
    held, y = pii.synthetic(400, 99)
    x = np.array([pii._numeric(c) for c in held], float)
    assert ((pii.model().probability(x) >= pii.model().threshold) == y).mean() > 0.85
    rows = spark.createDataFrame([(i, c.before, c.body, c.after, c.generator) for i, c in enumerate(held)], "i int, b string, body string, a string, g int")
    rows = rows.withColumn("text", F.concat("b", "body", "a")).withColumn("z", F.struct(F.length("b").cast("long").alias("s"), (F.length("b") + F.length("body")).cast("long").alias("e"), F.col("body")))
    columns = pii.features(F.col("text"), F.col("z"), 0) | {"generator": F.col("g").cast("double")}
    got = rows.select("i", *(c.alias(k) for k, c in columns.items()), pii.model().column(columns).alias("p")).orderBy("i").collect()
    assert np.allclose([[r[k] for k in pii.FEATURES] for r in got], x)
    assert np.allclose([r.p for r in got], pii.model().probability(x))


def test_empty_and_redact(spark):
    assert pii.digest(pii.scan(spark.createDataFrame([], "doc_id long, text string, base int"))).count() == 0
    got = pii.redact(spark.createDataFrame([(1, "to a@b.cd and +1 (743) 555-3824!")], "doc_id long, text string")).collect()
    assert got[0].text == "to [PII] and [PII]!"


PLANTED = {
    "national_id": ("her SSN is {}", "social security: {} on file", ["123-45-6789", "987-65-4320", "219-09-9999"]),
    "local_phone": ("please call {} today", "my mobile {} rings", ["212-555-0199", "(415) 555-2671", "303-555-0142"]),
    "account": ("the IBAN {} is mine", "account {} was charged", ["DE44 5001 0517 5407 3249 31", "GB29601613319268190012", "ES9121000418450200051332"]),
    "number": ("passport {} was lost", "tel {} after six", ["123-456-789", "555-012-345"]),
    "birth_date": ("she was born on {} in town", "DOB {} as given", ["1984-03-12", "12/05/1971"]),
    "document": ("passport {} expired", "his licence {} was found", ["C01234567", "XK1234567"]),
    "device": ("the device {} joined", "mac {} was seen", ["00:1a:2B:3c:4D:5e", "a1-b2-c3-d4-e5-f6"]),
    "street": ("she lives at {} now", "address: {} as before", ["221 Baker Street", "12 New Oak Lane", "7 Mill Hill Road"]),
}
CLEAN = [
    "order 12345678 was shipped", "version 1.22.3333 is out", "see page 20240512 of it", "item 303 555 0142 in stock", "published 2024-05-12 by us", "updated on 12.05.2021 again", "model A1234567 sells", "part XK123456 fits",
    "chapter 12 Oak Street begins", "table 100-200-300 shows", "total 123456789012 units", "invoice 2024/1234 is due", "released 2019-10-11 first", "figure 12 New Road is clear", "sku 123.456.7890 sold", "year 2020-01-15 total",
]


def test_recall_of_planted_kinds(spark):
    rows, where = [], []
    for kind, (*forms, bodies) in PLANTED.items():
        for form in forms:
            for body in bodies:
                text = "Some words before it. " + form.format(body) + ", and some after."
                where.append((kind, text.index(body), text.index(body) + len(body)))
                rows.append((len(rows), text))
    clean = [(1000 + i, "There: " + t + ".") for i, t in enumerate(CLEAN)]
    got = {r.doc_id: r.added for r in pii.scan(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()}
    found = [any(z.s <= s and e <= z.e for z in got[i]) for i, (_, s, e) in enumerate(where)]
    assert sum(found) >= 0.9 * len(found), [w for w, ok in zip(where, found, strict=True) if not ok]
    assert sum(bool(got[i]) for i, _ in clean) <= 0.15 * len(clean), [t for i, t in clean if got[i]]


def test_overlaps_are_settled_by_rank(spark):
    rng = np.random.default_rng(4)
    rows, want = [], []
    for i in range(60):
        spans = [(int(r), int(s), int(s) + int(n)) for r, s, n in zip(rng.integers(0, 12, 90), rng.integers(0, 900 if i % 2 else 5000, 90), rng.integers(1, 20, 90), strict=True)]
        spans = sorted(set(spans), key=lambda z: (z[1], z[0], z[2]))
        rows.append((i, [(s, r, e, "k", 1.0) for r, s, e in spans]))
        want.append([(r, s, e) for r, s, e in spans if r < 4 or not any((q < 4 or q < r) and s < f and t < e for q, t, f in spans)])
    df = spark.createDataFrame(rows, "i int, v array<struct<s:bigint,rank:int,e:bigint,kind:string,score:double>>")
    got = df.select("i", pii.uncovered(F.col("v")).alias("v")).orderBy("i").collect()
    assert [[(z.rank, z.s, z.e) for z in r.v] for r in got] == want
