import re

from pyspark.sql import functions as F

from foliospark.llm import licenses as L

TEXTS = [
    None,
    "",
    "MIT License and the mit  license.\nApache-License! general\tpublic (license) x",
    "amit license mit licensed émit license mit license2 general public licenses",
    "The MITK License, the Mit License é",
    "Licensed under CC BY-NC 4.0.\nfoo",
    "foo All rights reserved. foo bar",
    "all rights were reserved",
    "This work is licensed under the GNU General Public License, version 3.",
    "this software is licensed and rights exist",
    "mit license " * 3000,
    "MIT License and the mit  license.\nApache-License! general\tpublic (license) x",
]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at, labels = [], set()
    for label, p in L.BASE.items():
        p = p.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_places_equal_a_plain_search(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    out = L.scan(docs)
    for r in out.collect():
        x = r["license"]
        s = x["starts"]
        assert (x["n_words"], len(s), s[0] if s else None, s[-1] if s else None, ",".join(x["base"])) == brute(TEXTS[r["doc_id"]])
        assert 0 <= x["score"] <= 1


def test_templates_need_their_phrase_and_place(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    labels = {r[0]: r[1] for r in L.scan(docs).select("doc_id", F.array_join("license.labels", ",")).collect()}
    assert labels[5] == "cc-by-nc-4.0"
    assert labels[6] == "all-rights-reserved"
    assert labels[7] == "" and labels[9] == "" and labels[0] == ""
    assert labels[8] == "gpl,gpl-3.0"


def test_empty_table_and_clashing_column(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, license int")
    assert L.scan(docs).count() == 0
    docs = spark.createDataFrame([(1, "MIT License", 5)], "doc_id long, text string, license int")
    assert L.scan(docs).collect()[0]["license"]["base"] == ["mit"]


def test_all_licences_of_a_notices_file_are_found(spark):
    """Every template in one text, the rare words of which outnumber any fixed choice of them."""
    notices = "\n\n".join(f"Third-party notice {n}:\n{t}." for n, (t, _) in enumerate(L.TEMPLATES.values()))
    # other texts make some words common
    docs = spark.createDataFrame([(0, notices), *((n, "license licensed version gnu software") for n in range(1, 40))], "doc_id long, text string")
    x = L.scan(docs).where("doc_id = 0").collect()[0]["license"]
    assert {t["label"]: t["coverage"] for t in x["templates"]} == {label: 1.0 for label in L.TEMPLATES}
