"""Personal data: regular expressions propose spans, validators confirm them, nearby words adjust their scores.

All of it is column expressions. A text is looked at for a kind only if it holds a character that the kind can't do
without. Spans are in code points, end exclusive.

Kinds email, ip, card and phone are found leftmost and without overlap within a kind; a match that its validator
turns down is dropped. Kinds iban (mod-97) and ssn (which needs a context word) are the method's own; they stand alone,
not within longer runs of letters and digits. Scores run from 0 to 1: what the form of a span is worth, more for a
passed checksum, more for a context word within NEAR characters, up to the next match of the kind.

Null and empty texts have no spans. Rows are treated one by one, so repeated rows repeat. A column of the result's name
is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters on either side in which a context word counts.
NEAR = 50


@dataclass(frozen=True)
class Kind:
    """pattern: starts only where a run of its first characters starts or the last match ended, so that a long run is
    read once. needs: what a text must match to be searched at all."""

    name: str
    pattern: str
    needs: str
    valid: Callable[[Column], Column]
    worth: float
    checked: float
    context: str
    alone: bool = False


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    n = F.length(_digits(c))
    return (n >= 14) & (n <= 19) & F.call_function("luhn_check", _digits(c))


def _phone(c: Column) -> Column:
    return F.length(_digits(c)).between(10, 15)


def _mod97(c: Column) -> Column:
    moved = F.concat(F.substring(c, 5, 64), F.substring(c, 1, 4))
    value = F.aggregate(
        F.filter(F.split(moved, ""), lambda x: x != ""),
        F.lit(0).cast("long"),
        lambda a, x: F.when(x.rlike("[0-9]"), (a * 10 + F.ascii(x) - 48) % 97).otherwise((a * 100 + F.ascii(x) - 55) % 97),
    )
    return value == 1


#: In the order in which spans of one start are listed.
KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), 0.7, 0.0, "mail|contact|write|correo|kontakt"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9][.][0-9]", lambda m: m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}$"), 0.5, 0.1, "ip|host|server|address|login"),
    Kind("card", r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++", "[0-9]", _luhn, 0.4, 0.3, "card|credit|visa|mastercard|payment|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "[+][0-9]", _phone, 0.5, 0.0, "phone|call|tel|mobile|fax|whatsapp"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", "[A-Z]{2}[0-9]{2}", _mod97, 0.4, 0.4, "iban|bank|account|konto|cuenta|compte", True),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]-[0-9]", lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 0.3, 0.0, "ssn|social security", True),
]
#: A method's own span needs this score.
LEAST = 0.5
BASE = [k.name for k in KINDS if not k.alone]

SPAN = "struct<kind:string,rank:int,start:int,end:int,text:string,score:double>"


def _spans(text: Column, kind: Kind) -> Column:
    """The kind's spans in a text: matches, and the parts between them, whose lengths add up to the starts."""
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    rank = [k.name for k in KINDS].index(kind.name)
    parts, found = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    # a match with the parts on either side
    pairs = F.zip_with(found, parts, lambda m, p: F.struct(m.alias("text"), p.alias("before")))
    sized = F.filter(F.zip_with(pairs, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda x, after: F.struct(x["before"].alias("before"), x["text"].alias("text"), after.alias("after"))), lambda x: x["text"].isNotNull())

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["text"])
        return F.struct(end.alias("at"), F.concat(acc["got"], F.array(F.struct(start.alias("start"), end.alias("end"), x["text"].alias("text"), F.right(x["before"], F.lit(NEAR)).alias("before"), F.substring(x["after"], 1, NEAR).alias("after")))).alias("got"))

    zero = F.expr("struct(0 as at, cast(array() as array<struct<start:int,end:int,text:string,before:string,after:string>>) as got)")
    placed = F.aggregate(sized, zero, step, lambda acc: acc["got"])
    keep = F.filter(placed, lambda s: kind.valid(s["text"]))
    if kind.alone:
        keep = F.filter(keep, lambda s: ~s["before"].rlike("[A-Za-z0-9]$") & ~s["after"].rlike("^[A-Za-z0-9]"))

    def scored(s: Column) -> Column:
        near = F.concat_ws(" ", s["before"], s["after"]).rlike(f"(?i)(?<![A-Za-z])(?:{kind.context})")
        score = F.lit(kind.worth + kind.checked) + F.when(near, 0.2).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), F.round(score, 6).alias("score"))

    out = F.transform(keep, scored)
    if kind.alone:
        out = F.filter(out, lambda s: s["score"] >= LEAST)
    return F.when(text.rlike(kind.needs), out.cast(f"array<{SPAN}>")).otherwise(none)


def find(docs: DataFrame, *, text: str = "text", into: str = "pii") -> DataFrame:
    """docs with a column `into`: an array of SPAN by start, then by the order of KINDS."""
    column = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = F.concat(*(_spans(column, k) for k in KINDS))
    return docs.withColumn(into, F.when(F.size(found) > 1, F.array_sort(found, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"]))).otherwise(found))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pii = F.col("pii")
    n = lambda kind: F.size(F.filter(pii, lambda s: s["kind"] == kind)).cast("long")
    return find(docs).select(
        "doc_id",
        n("email").alias("n_email"),
        n("ip").alias("n_ip"),
        n("card").alias("n_card"),
        n("phone").alias("n_phone"),
        F.sha2(listed(F.filter(pii, lambda s: s["kind"].isin(BASE))), 256).alias("base_sha256"),
        listed(pii).alias("spans"),
    )


def _oracle() -> str:
    """One query a kind: matches by RE2 on the plain patterns, starts from the lengths of the parts between."""
    luhn = "list_sum([CASE WHEN i % 2 = 1 THEN v[-i]::INT ELSE CASE WHEN v[-i]::INT > 4 THEN v[-i]::INT * 2 - 9 ELSE v[-i]::INT * 2 END END FOR i IN range(1, len(v) + 1)]) % 10 = 0"
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max([x::HUGEINT FOR x IN string_split(m, '.')]) <= 255"),
        "card": (r"[0-9]([\x20-]?[0-9])+", f"length({digits}) BETWEEN 14 AND 19 AND {luhn}"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 10 AND 15"),
        "iban": (r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", "NOT regexp_matches(b, '[A-Za-z0-9]$') AND NOT regexp_matches(a, '^[A-Za-z0-9]') AND list_reduce(list_prepend(0::BIGINT, [CASE WHEN ord(x) < 58 THEN ord(x) - 48 ELSE ord(x) - 55 END::BIGINT FOR x IN string_split(m[5:] || m[:4], '')]), LAMBDA s, x: (s * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1"),
        "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "NOT regexp_matches(b, '[A-Za-z0-9]$') AND NOT regexp_matches(a, '^[A-Za-z0-9]') AND NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$') AND regexp_matches(b || ' ' || a, '(?i)(^|[^A-Za-z])(ssn|social security)')"),
    }
    selects = [
        f"""SELECT r, '{name}' AS kind, {n} AS k, s, s + length(m) AS e FROM (
  SELECT r, m, b, a, v, s FROM (SELECT r, ms[i] AS m, right(ps[i], 50) AS b, left(ps[i + 1], 50) AS a, string_split(regexp_replace(ms[i], '[^0-9]', '', 'g'), '') AS v,
    list_sum([length(x) FOR x IN ps[1:i]])::BIGINT + coalesce(list_sum([length(x) FOR x IN ms[1:i - 1]]), 0)::BIGINT AS s
  FROM (SELECT r, ps, ms, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT r, regexp_split_to_array(t, '{p}') AS ps, regexp_extract_all(t, '{p}') AS ms FROM d)))
) WHERE {valid}"""
        for n, (name, (p, valid)) in enumerate(kinds.items())
    ]
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({' UNION ALL '.join(selects)}),
g AS (SELECT r, count(*) FILTER (kind = 'email') AS ne, count(*) FILTER (kind = 'ip') AS ni, count(*) FILTER (kind = 'card') AS nc, count(*) FILTER (kind = 'phone') AS np,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(ne, 0)::BIGINT AS n_email, coalesce(ni, 0)::BIGINT AS n_ip, coalesce(nc, 0)::BIGINT AS n_card, coalesce(np, 0)::BIGINT AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""


ORACLE_SQL = _oracle()
