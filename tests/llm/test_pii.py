import re

from pyspark.sql import functions as F

from foliospark.llm import pii as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    None,
    "",
    "write a.b@c.de, x@y.z_w@v.u and @no a@b",
    "ips 1.2.3.4.5.6.7.8 256.1.1.1 0255.0.0.1 99999999999999999999.1.1.1",
    "cards 4111 1111 1111 1111, 4111-1111-1111-1112, 4111  1111 1111 1111 0000000000000000",
    "call +1 (736) 555-2678 or +12 or +1234567890123456 (",
    "é𠮷 a@b.cd 𠮷 10.0.0.1",
    "IBAN GB82WEST12345698765432 xGB82WEST12345698765432 GB82WEST12345698765433",
    "ssn 123-45-6789; 123-45-6789 is " + "far " * 30 + "987-65-4321",
    "9" * 20000 + " " + "1 2 " * 5000 + "a" * 20000 + "@b.c",
    "write a.b@c.de, x@y.z_w@v.u and @no a@b",
]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(len(x.lstrip("0")) < 4 and int(x.lstrip("0")[:3] or 0) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(out)]


def test_base_spans_equal_plain_expressions(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, pii int")
    for r in P.find(docs).collect():
        got = [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["pii"] if s["kind"] in P.BASE]
        assert got == brute(TEXTS[r["doc_id"]])
        assert all((TEXTS[r["doc_id"]] or "")[s["start"] : s["end"]] == s["text"] and 0 <= s["score"] <= 1 for s in r["pii"])


def test_own_kinds_and_scores(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r[0]: r[1] for r in P.find(docs).select("doc_id", P.listed(F.col("pii"))).collect()}
    assert got[7] == "iban:5:27"
    assert got[8] == "ssn:4:15"  # a context reaches as far as the next match of its kind
    near, far = P.find(spark.createDataFrame([(0, "card 4111111111111111"), (1, "x 4111111111111111")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert near["pii"][0]["score"] > far["pii"][0]["score"]


def test_empty_table(spark):
    assert P.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
