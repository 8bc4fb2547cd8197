"""The fill-in-middle transformation against a plain version on strings."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from winnow.llm import fim

from .tables import documents, empty, rows

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plainly(doc_id, text):
    """The contract, on strings."""
    text = text or ""
    found = UNIT.findall(text)
    assert "".join(found) == text
    h = [int(sha(f"42:{'' if doc_id is None else doc_id}")[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(found) + 1), h[1] % (len(found) + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return doc_id, len(found), "plain", None, None, sha(text), sha(text)
    p, m, s = "".join(found[:a]), "".join(found[a:b]), "".join(found[b:])
    form, output = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, len(found), form, len(p), len(m), sha(output), sha(text)


def sample():
    rng = random.Random(5)
    pool = ["a", "Bé", "😀", " ", "\n", "\t\x0b", "\x0c\r", "\x85", " ", "<", "<P", "P>", ">", "<p>", "S", "M>", "<<S", "word"]
    made = [(i, "".join(rng.choices(pool, k=rng.randrange(30)))) for i in range(600)]
    made += [(i, f"one {mark} two") for i, mark in enumerate(["<P>", "<S>", "<M>", "<P", "<M >", "<S<S>"] * 10, 1000)]
    made += [(i, t) for i in range(2000, 2004) for t in ("ends <", "> begins", "word " * 300_000)]
    made += [(-5, "negative id"), (None, "no id at all"), (None, None), (7, None), (8, ""), (9, " "), (9, " ")]
    return made


def test_report(spark):
    made = sample()
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    found = sorted(map(tuple, fim.fill_in_middle(docs).collect()), key=repr)
    wanted = sorted((plainly(*r) for r in made), key=repr)
    assert found == wanted
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_cases(spark):
    found = fim.fill_in_middle(documents(spark)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted((plainly(r[0], r[1]) for r in rows()), key=repr)
    assert fim.fill_in_middle(empty(spark)).count() == 0


def test_a_text_may_end_where_the_next_one_goes_on(spark):
    docs = spark.createDataFrame([(1, "x <"), (2, "P> y"), (3, "<P"), (4, ">")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: bool(r) for r in fim.transform(docs, rate=100).where("form = 'plain'").collect()} == {}


def test_rates(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    forms = {r.form: r["count"] for r in fim.transform(docs).groupBy("form").count().collect()}
    assert 1400 < forms["plain"] < 1600 and 0.75 < forms["spm"] / (forms["spm"] + forms["psm"]) < 0.85
    assert {r.form for r in fim.transform(docs, rate=100, spm_rate=0).select("form").distinct().collect()} == {"psm"}
    assert fim.transform(docs, rate=0).where("form <> 'plain' OR output <> 'a b c'").count() == 0


def test_restore_takes_outputs_of_any_origin(spark):
    made = [(1, "psm", "<P>a<S>c<M>b"), (2, "spm", "<S>c<P>a<M>b"), (3, "plain", "<P>"), (4, None, "x"), (5, "psm", None), (6, "spm", "<S><P><M>")]
    frame = spark.createDataFrame(made, "k long, form string, output string").withColumn("restored", F.lit(1))
    found = {r.k: r.restored for r in fim.restore(frame).collect()}
    assert found == {1: "abc", 2: "abc", 3: "<P>", 4: None, 5: None, 6: ""}
    with pytest.raises(ValueError):
        fim.sections_of(b"<P>a<M>b", "psm")
    with pytest.raises(ValueError):
        fim.sections_of(b"<S>a<P>b<M>c", "psm")


def test_pieces():
    sections = fim.cut(fim.Piece(fim.TEXT, 2, 9), (4, 4))
    assert sections == [(0, 2, 4), (0, 4, 4), (0, 4, 9)]
    held = fim.buffers(b"..abcdefg")
    assert fim.joined(fim.arrange(sections, "psm"), held) == b"<P>ab<S>cdefg<M>"
    for form, order in fim.FORMS.items():
        assert [order[i] for i in fim.inverse(order)] == [0, 1, 2]
        output = fim.joined(fim.arrange(sections, form), held)
        assert fim.joined(fim.sections_of(output, form), fim.buffers(output)) == b"abcdefg"
        assert fim.digest(fim.arrange(sections, form), held) == hashlib.sha256(output).hexdigest()
