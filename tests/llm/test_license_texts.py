"""Whole licence texts, as they circulate, against the look-up; and its SQL."""

import re

import duckdb

from tessera.llm import licenses


def forms(text):
    """The text itself, in one line a paragraph (but where a line
    states a copyright), in capitals, with another
    owner, with other quotes and in British spelling."""
    yield text
    yield "\n\n".join(p if re.search(r"(?i)copyright \(c\)|©", p) else " ".join(p.split()) for p in re.split(r"\n[ \t]*\n", text))
    yield text.upper()
    yield "Copyright (c) 2019-2021 Someone Else\nAll rights reserved.\n\n" + text
    yield text.replace('"', "\u201c").replace("license", "licence")


def test_whole_texts(spark):
    known = licenses.texts_known()
    assert len({n for n, _ in known}) >= 20
    rows = [(i * 10 + j, t, n) for i, (n, text) in enumerate(known) for j, t in enumerate(forms(text))]
    df = spark.createDataFrame(rows, "doc_id long, text string, want string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(df).collect()}
    assert [(i, w, got[i]) for i, _, w in rows if got[i] != w] == []
    # A text with one sentence more, or cut short, is none of them.
    odd = [(i * 2 + j, t) for i, (_, text) in enumerate(known) for j, t in enumerate((text + " And no more.", text[: len(text) // 2]))]
    assert [r for r in licenses.scan(spark.createDataFrame(odd, "doc_id long, text string")).collect() if r["license"]] == []


def test_whole_texts_in_sql(spark):
    rows = [(i, t) for i, (_, text) in enumerate(licenses.texts_known()) for t in (text, text + " x")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(con.execute(licenses.oracle()).fetchall(), key=repr)
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.select("doc_id", "canonical_sha256", "license").collect()), key=repr) == want
