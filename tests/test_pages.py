"""Pages: heads in any form, links, chunks at headings."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from larkspur.operators import extraction as X


def one(spark, html, column):
    return spark.createDataFrame([(html,)], "h string").select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("head", "want"),
    [
        ('<meta property="og:title" content="A">', "A"),
        ("<meta content='A' property='og:title'>", "A"),
        ("<META name=og:title content=A >", "A"),
        ('<meta name="og:title" content="B"><meta property="og:title" content=" A ">', "A"),
        ('<meta property="og:title" content=""><meta name="og:title" content="B">', "B"),
        ('<meta property="og:title" content="it\'s &quot;A&quot; &amp;lt;">', 'it\'s "A" &lt;'),
        ('<meta data-content="no" property="og:title" content="A">', "A"),
        ('<meta title="a > b" property="og:title" content="A">', "A"),
        ('<meta property="og:titles" content="A"><metadata property="og:title" content="A">', None),
        (None, None),
    ],
)
def test_meta(spark, head, want):
    assert one(spark, head, X.meta(F.col("h"), "og:title")) == want


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ('{"@type": "Article", "n": "a"}', "a"),
        ('[{"@type": "Thing", "n": "t"}, 5, {"@type": "Article", "n": "a"}]', "a"),
        ('[{"@type": "Thing"}]', None),
        ('{"@type": ["Article"], "n": "a"}', None),
        ("[]", None),
        ("{", None),
    ],
)
def test_json_ld_lists(spark, said, want):
    for script in ("<script type='application/ld+json' id=x>", '<script type="application/ld+json">'):
        html = f'{script}{{"broken</script>{script}{said}</script>'
        assert one(spark, html, F.try_variant_get(X.json_ld(F.col("h"), ["Article"]), "$.n", "string")) == want


def test_links_to_an_entity(spark):
    html = """<a href='https://x.example/wines/abc-1?u'>, "/wines/b_2", <a href=/wines/map> /wines/page /wines/own /wines/abc-1 /wineries/z /wines/Big"""
    assert one(spark, html, X.links(F.col("h"), "wines", "own")) == ["abc-1", "b_2"]


def chunks(spark, body, headings):
    df = spark.createDataFrame([(1, body, headings)], "id int, body string, hs array<string>")
    return [(r.heading, r.text) for r in X.chunk_sections(df, "id", F.col("body"), F.col("hs")).orderBy("chunk").collect()]


def test_chunks_at_headings(spark):
    body = "Lead text.\n\nFirst\n\nabout one\n\nSecond\n\nabout two"
    want = [(None, "Lead text."), ("First", "First\n\nabout one"), ("Second", "Second\n\nabout two")]
    assert chunks(spark, body, ["Second", "First", "Absent"]) == want
    assert chunks(spark, "First\n\nx", ["First", "Firs"]) == [("First", "First\n\nx")]  # of one place the later by name
    assert chunks(spark, body, []) == chunks(spark, body, None) == chunks(spark, body, ["Absent"]) == [(None, body)]
    assert chunks(spark, "", ["a"]) == chunks(spark, None, None) == []
    assert chunks(spark, " \n ", []) == [(None, " \n ")]


def brute(body, headings, longest=2000):
    places = sorted((body.find(h), h) for h in headings if h in body)
    parts = [(None, body)] if not places else []
    if places:
        cuts = [(0, None), *places]
        for (at, h), (stop, _) in zip(cuts, [*places, (len(body), None)], strict=True):
            if body[at:stop].strip():
                parts.append((h, body[at:stop].strip()))
    out = []
    for h, text in parts:
        held = []
        for p in [p.strip() for p in re.split(r"\n{2,}", text) if p.strip()] if len(text) > longest else [text]:
            if held and len(held[-1]) + 2 + len(p) <= longest:
                held[-1] += "\n\n" + p
            else:
                held.append(p)
        out += [(h, t) for t in held]
    return out


def test_long_parts_are_packed(spark):
    body = "\n\n".join(f"H{i}\n\n" + "\n\n\n".join(f"p{i}.{j} " + "word " * (j * 40 % 500) for j in range(12)) for i in range(4)) + "\n\n" + "x" * 5000
    assert chunks(spark, body, ["H2", "H1", "H3"]) == brute(body, ["H2", "H1", "H3"])
