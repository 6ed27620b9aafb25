"""Line dedup by a segment-partition edit join.

Lines take part that are not blank, without ASCII white space at their ends. Of equal lines the first stays, by
(doc_id, line number), of lines of at least `floor` characters (1 if not stated); of two lines of LEAST characters and
more within EDITS edits, the later goes, wherever it stands. Shorter lines are near each other by chance. A line of n characters is
cut into EDITS + 1 segments; a line within EDITS edits of it holds one of them unchanged, at a place that the lengths
narrow down. So lines meet by (length, segment number, substring), and a banded bit-parallel edit distance verifies
those that meet.

DataFrame functions only. Keys are made for the first of equal lines alone, and texts move for those that meet alone.
What is joined to all lines or documents is broadcast if the written table's files have BROADCAST_BYTES at most; larger
tables are shuffled.

Null texts stay null and empty ones empty. Rows with one id and text are treated alike; a null id comes after all
others. Very long lines and texts are treated as others are, by one task at a time. Empty tables give empty results. Other columns stay, whatever their names; a column of a result's name is
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.sources.runtime import plan_bytes, table

LEAST, EDITS, BROADCAST_BYTES = 20, 2, 8 << 20
SPACE = " \t\r\f\v"
#: Letters whose counts, modulo 16, travel with the keys of crowded segments' lines: an edit changes their sum by two at most, so lines whose counts
#: differ by more than that are not compared. Near copies share segments though they differ by whole words; without
#: this, their groups would meet pair by pair.
LETTERS = "enisratdhulcgmob"
#: A segment is crowded if more lines than this have it at its place.
CROWD = 4


def _lines(docs: DataFrame, floor: int) -> DataFrame:
    """Lines of so many characters, with their place in the order of lines and two hashes."""
    line = F.btrim(F.col("raw"), F.lit(SPACE))
    return (
        docs.select(F.col("__id"), F.xxhash64("__text").alias("__th"), F.posexplode(F.split("__text", "\n", -1)).alias("no", "raw"))
        .where(F.length("raw") >= floor)
        .withColumn("line", line)
        .where(F.length("line") >= floor)
        .select(F.struct(F.col("__id").isNull().alias("last"), F.col("__id").alias("id"), F.col("no"), F.col("__th").alias("th")).alias("at"), F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("g"), "line")
    )


def _join(left: DataFrame, right: DataFrame, on, how: str) -> DataFrame:
    """right is of a written table: broadcast if the bytes of its files are within the bound."""
    return left.join(F.broadcast(right) if plan_bytes(right) <= BROADCAST_BYTES else right.hint("merge"), on, how)


def segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Start (from 1) and length of the i-th of edits + 1 segments: the later ones take what is left over."""
    size = lambda j: F.floor((length + (j - 1)) / (edits + 1)).cast("int")
    start = F.lit(1)
    for j in range(1, i):
        start = start + size(j)
    return start, size(i)


def _key(length: Column, i: int, part: Column) -> Column:
    return F.xxhash64(length, F.lit(i), part)


def counts(line: Column) -> Column:
    """Sixteen counts of four bits."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(LETTERS):
        n = F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
        out = out.bitwiseOR(F.shiftleft((n % 16).cast("long"), 4 * i))
    return out


def apart(a: Column, b: Column) -> Column:
    """At most the sum of the differences of two lines' counts."""
    out = F.lit(0)
    for i in range(len(LETTERS)):
        nibble = lambda c: F.shiftrightunsigned(c, 4 * i).bitwiseAND(F.lit(15).cast("long")).cast("int")  # noqa: B023, E731
        d = F.abs(nibble(a) - nibble(b))
        out = out + F.least(d, 16 - d)
    return out


def index_keys(line: Column, edits: int) -> Column:
    n = F.length(line)
    return F.array(*(_key(n, i, F.substring(line, *segment(n, i, edits))) for i in range(1, edits + 2)))


def probe_keys(line: Column, edits: int) -> Column:
    """Substrings that a line shorter by 0 to edits characters may hold as a segment. Of m edits, those left of a kept
    segment shift it by as many at most, those right of it bound the shift by the rest."""
    n, keys = F.length(line), []
    for less in range(edits + 1):
        m = n - less
        for i in range(1, edits + 2):
            start, size = segment(m, i, edits)
            low, high = max(1 - i, less - (edits + 1 - i)), min(i - 1, less + (edits + 1 - i))
            keys += [_key(m, i, F.substring(line, start + shift, size)) for shift in range(low, high + 1)]
    return F.array(*keys)


def within(x: Column, y: Column, edits: int) -> Column:
    """Whether two arrays of characters are within so many edits. x and y are columns, not expressions: the band's
    masks look x up once a character.

    Bit d + edits of word e says that y's first j characters are within e edits of x's first j + d; a step matches
    y's next character against the band of x in one mask.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    # before the first character, word e holds x's openings of up to e characters
    zero = F.struct(*(F.lit(sum(1 << (d + edits) for d in range(e + 1))).alias(f"e{e}") for e in range(edits + 1)))
    masks = F.transform(y, lambda c, j: sum((F.when(F.get(x, j + d) == c, 1 << (d + edits)).otherwise(0) for d in range(-edits, edits + 1)), F.lit(0)))

    def step(acc: Column, mask: Column) -> Column:
        words: list[Column] = []
        for e in range(edits + 1):
            now = acc[f"e{e}"].bitwiseAND(mask)
            if e:
                before = acc[f"e{e - 1}"]
                now = now.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(words[-1], 1)).bitwiseAND(F.lit(full))
            words.append(now)
        return F.when(acc[f"e{edits}"] == 0, acc).otherwise(F.struct(*(w.alias(f"e{e}") for e, w in enumerate(words))))

    # the bit of the diagonal on which both end
    last = F.pow(F.lit(2), F.size(x) - F.size(y) + edits).cast("int")
    run = F.aggregate(masks, zero, step, lambda acc: acc[f"e{edits}"].bitwiseAND(last) != 0)
    return F.when(F.abs(F.size(x) - F.size(y)) > edits, False).otherwise(run)


def _middles(pairs: DataFrame) -> DataFrame:
    """Pairs without what both lines start and end with: found by halving, so that the distance runs over the rest."""
    steps = lambda n: F.sequence(F.ceil(F.log2(F.greatest(n, F.lit(1)) + 1)).cast("int"), F.lit(0), F.lit(-1))

    def common(a: Column, b: Column) -> Column:
        most = F.least(F.length(a), F.length(b))

        def longer(n: Column, k: Column) -> Column:
            m = n + F.pow(F.lit(2), k).cast("int")
            return F.when((m <= most) & (F.left(a, m) == F.left(b, m)), m).otherwise(n)

        return F.aggregate(steps(most), F.lit(0), longer)

    cut = pairs.withColumn("n", common(F.col("a_line"), F.col("b_line")))
    cut = cut.withColumn("a_mid", F.expr("substring(a_line, n + 1)")).withColumn("b_mid", F.expr("substring(b_line, n + 1)"))
    cut = cut.withColumn("m", common(F.reverse("a_mid"), F.reverse("b_mid")))
    chars = lambda c: F.expr(f"filter(split(left({c}, length({c}) - m), ''), x -> x != '')")
    return cut.withColumn("x", chars("a_mid")).withColumn("y", chars("b_mid"))


def mark(docs: DataFrame, *, edits: int = EDITS, floor: int = 1, tag: str = "lines") -> DataFrame:
    """docs with a column removed_lines: the numbers, from 0, of lines that go. docs: doc_id, text and others."""
    base = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__text", F.col("text").cast("string"))
    slim = base.select("__id", "__text")
    occurrences = table(_lines(slim, max(1, floor)).drop("line"), "lines", tag)
    repeated = table(occurrences.groupBy("h", "g").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "lines-repeated", tag)
    again = _join(occurrences, repeated, ["h", "g"], "inner").where("at != first").select("at")

    once = table(_join(_lines(slim, LEAST), repeated, ["h", "g"], "left").where("first is null or at = first").drop("first").withColumn("keys", index_keys(F.col("line"), edits)), "lines-once", tag)
    # lines of crowded segments get counts, so that of near copies only those that can be near are listed as pairs
    index = once.select("h", F.explode("keys").alias("key"))
    crowds = table(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("key"), "lines-crowds", tag)
    crowded = table(_join(index, crowds, "key", "inner").select("h").distinct().withColumn("crowded", F.lit(True)), "lines-crowded", tag)
    keyed = _join(once, crowded, "h", "left").withColumn("counts", F.when(F.col("crowded"), counts(F.col("line"))))
    index = keyed.select(F.explode("keys").alias("key"), F.col("h").alias("a"), F.col("counts").alias("ca"))
    probe = keyed.select(F.explode(probe_keys(F.col("line"), edits)).alias("key"), F.col("h").alias("b"), F.col("counts").alias("cb"))
    near = F.coalesce(apart(F.col("ca"), F.col("cb")) <= 2 * edits, F.lit(True))
    meet = (index["key"] == probe["key"]) & (F.col("a") != F.col("b")) & near
    met = index.join(probe.hint("merge"), meet).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = table(met, "lines-pairs", tag)
    ids = table(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "lines-ids", tag)
    texts = table(_join(once, ids, "h", "inner").select("h", "g", "at", "line"), "lines-texts", tag)
    side = lambda s: texts.select(F.col("h").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("g", "at", "line")))
    later = F.col("a_at") > F.col("b_at")
    # written, so that neither the arrays nor the distance are worked out again where they are used
    middles = table(_middles(pairs.join(side("a"), "a").join(side("b"), "b")).select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("h"), F.when(later, F.col("a_g")).otherwise(F.col("b_g")).alias("g"), "x", "y"), "lines-middles", tag)
    near = table(middles.select("h", "g", within(F.col("x"), F.col("y"), edits).alias("near")), "lines-near", tag)
    gone = table(near.where("near").select("h", "g").distinct(), "lines-gone", tag)
    near_at = _join(occurrences, gone, ["h", "g"], "inner").select("at")

    removed = again.union(near_at).distinct().groupBy(F.col("at.last").alias("__last"), F.col("at.id").alias("__rid"), F.col("at.th").alias("__rth")).agg(F.array_sort(F.collect_list("at.no")).alias("removed_lines"))
    removed = table(removed.withColumn("__rid", F.coalesce("__rid", F.lit(0))), "lines-removed", tag)
    joined = _join(base.drop("removed_lines").withColumn("__th", F.xxhash64("__text")), removed, (F.col("__last") == F.col("__id").isNull()) & (F.col("__rid") == F.coalesce("__id", F.lit(0))) & (F.col("__rth") == F.col("__th")), "left")
    return joined.withColumn("removed_lines", F.coalesce("removed_lines", F.expr("cast(array() as array<int>)"))).drop("__id", "__text", "__th", "__last", "__rid", "__rth")


def dedup(docs: DataFrame, *, edits: int = EDITS, floor: int = 1, tag: str = "lines") -> DataFrame:
    """docs whose texts have lost the lines that mark() names; texts without such lines stay as they are."""
    kept = F.array_join(F.filter(F.split(F.col("text").cast("string"), "\n", -1), lambda _, i: ~F.array_contains(F.col("removed_lines"), i)), "\n")
    return mark(docs, edits=edits, floor=floor, tag=tag).withColumn("text", F.when(F.size("removed_lines") > 0, kept).otherwise(F.col("text")))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    return dedup(docs).select(
        "doc_id",
        "n_lines",
        F.size("removed_lines").cast("long").alias("n_removed"),
        F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


ORACLE_SQL = r"""
WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
occ AS (SELECT doc_id, i - 1 AS no, regexp_replace(ls[i], '^\s+|\s+$', '', 'g') AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM raw)),
lines AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, no) AS k FROM occ WHERE line <> ''),
once AS MATERIALIZED (SELECT line, length(line) AS n, doc_id, no, line[:n // 3] AS s1, line[n // 3 + 1:n // 3 + (n + 1) // 3] AS s2, line[n // 3 + (n + 1) // 3 + 1:] AS s3 FROM lines WHERE k = 1 AND length(line) >= 20),
met AS MATERIALIZED (SELECT a.line AS a, b.line AS b, (a.doc_id, a.no) > (b.doc_id, b.no) AS a_later FROM once a JOIN (SELECT *, n - unnest([0, 1, 2]) AS m FROM once) b ON a.n = b.m AND (a.n < b.n OR a.line < b.line)
  AND (contains(b.line, a.s1) OR contains(b.line, a.s2) OR contains(b.line, a.s3))),
near AS (SELECT DISTINCT CASE WHEN a_later THEN a ELSE b END AS line FROM met WHERE levenshtein(a, b) <= 2),
gone AS (SELECT doc_id, no FROM lines WHERE k > 1 OR line IN (SELECT line FROM near)),
g AS (SELECT doc_id, list_sort(list(no)) AS nos FROM gone GROUP BY doc_id)
SELECT doc_id, len(ls)::BIGINT AS n_lines, len(coalesce(nos, []))::BIGINT AS n_removed, coalesce(array_to_string(nos, ','), '') AS removed,
  sha256(array_to_string([ls[i] FOR i IN range(1, len(ls) + 1) IF NOT list_contains(coalesce(nos, []), i - 1)], chr(10))) AS text_sha256
FROM raw LEFT JOIN g USING (doc_id)
"""
