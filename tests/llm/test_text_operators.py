"""Operators on one text at a time: BPE, licences, HTML."""

import random

import pytest
from pyspark.sql import functions as F

bpe = pytest.importorskip("helixloom.llm.bpe")
from helixloom.llm import html_render, license_scan  # noqa: E402


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.load(bpe.default_vocab())


def texts():
    r = random.Random(3)
    odd = ["", " ", "<|endoftext|>x <|endoftext|>", "   a  b\n\n c", "日本語 テスト🙂", "x" * 3000, "ab" * 900, " " * 400, "don't we'll I'M", "\x00\x7f", "é́"]
    pools = [(1, 127), (128, 0x2FFF), (0x1F300, 0x1F6FF)]
    return odd + ["".join(chr(r.randint(*r.choice(pools))) for _ in range(r.randint(1, 120))) for _ in range(300)]


def test_bpe_equals_the_library_and_round_trips(tokenizer):
    tokenizers = pytest.importorskip("tokenizers")
    ref = tokenizers.Tokenizer.from_file(bpe.default_vocab())
    for text, (n, ids, decoded) in zip(texts(), tokenizer.run(texts()), strict=True):
        want = ref.encode(text, add_special_tokens=False).ids
        assert ids == ",".join(map(str, want)) and n == len(want)
        assert decoded == ref.decode(want, skip_special_tokens=False) == text


def test_bpe_table(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "hello hello", "c"), (None, "hello hello", "c")], "doc_id long, text string, n_tokens string")
    out = bpe.bpe_columns(df, bpe.default_vocab()).collect()
    assert sorted((r.n_tokens, r.decoded) for r in out) == [(0, ""), (0, ""), (2, "hello hello"), (2, "hello hello")]
    assert bpe.bpe_columns(df.limit(0), bpe.default_vocab()).count() == 0


def test_licence_rules():
    s = license_scan.Scanner()
    full = "\n\n".join(license_scan.SENTENCES[k][0] for k in ("by-mit", "mit-grant", "mit-notice", "mit-as-is", "mit-liable"))
    assert [x[0] for x in s.scan(full)[0]] == ["MIT"]
    wrapped = full.replace(" ", "\n", 40)
    assert [x[0] for x in s.scan(wrapped)[0]] == ["MIT"]
    found, rest, n = s.scan("Text.\nLicensed under the Apache\nLicense, Version 2.0.\nmore\nSee the GNU General Public License for more details.")
    assert [x[0] for x in found] == ["Apache-2.0"] and rest == ["gpl-see"] and n == 2
    assert s.scan(None) == s.scan("") == s.scan("the license is fine") == ([], [], 0)


def test_licence_spans_hold_the_sentence():
    text = "First. Released under the MIT License. Last."
    ((name, a, b),) = license_scan.Scanner().scan(text)[0]
    assert name == "MIT" and license_scan.normalise(text[a:b]) == "released under the mit license"


def test_licence_table(spark):
    df = spark.createDataFrame([(1, "All rights reserved."), (1, None), (None, "")], "doc_id long, text string")
    got = sorted(license_scan.scan_licences(df.withColumn("unknown", F.lit(1))).select("licences", "n_licences").collect())
    assert [tuple(r) for r in got] == [("", 0), ("", 0), ("All-rights-reserved", 1)]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, None),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>one<p>two<br>three", "one\n\ntwo\nthree"),
        ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>", "* a\n* b\n  3. c\n  4. d"),
        ("<table><tr><th>Name<th>Qty<tr><td>fig<td>12</table>", "Name  Qty\nfig   12"),
        ("<td>x<td>y", "x y".replace(" ", "")),
        ("<div hidden>no</div><p style='DISPLAY : none'>no</p>yes<script>no</script>", "yes"),
        ("<pre>  a\n   b</pre>end", "  a\n   b\n\nend"),
        ("a <b>b<i>c</b> d", "a bc d"),
        ("<title>t</title><body>x <a href='y>z'>link</a", "x link"),
        ("cut <a href='never closed", "cut"),
        ("x<!-- <p>no</p> -->y &lt;z", "xy <z"),
        ("<b>" * 5000 + "deep", "deep"),
    ],
)
def test_render(html, text):
    assert html_render.render(html) == text


def test_render_table(spark):
    df = spark.createDataFrame([(1, "<p>a"), (2, None)], "page_id long, html string")
    assert [r.text for r in html_render.extract_text(df).orderBy("page_id").collect()] == ["a", None]
    assert html_render.extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>one</p><a title=Bob's href=x>two</a><p>three</p>", "one\n\ntwo\n\nthree"),
        ("<p>one</p><a title=Bob's href=x>two</a><p>don't</p>", "one\n\ntwo\n\ndon't"),
        ("<p>one<img alt=\"5\"\">two</p>", "one5two"),
        ("<p>one <a title=\"open>two</a></p><p>three", "one two\n\nthree"),
        ("a<b class=x\"y title = 'p>q' data-x=\"r>s\"/>c</b>d", "acd"),
        ("<p title=a\"b hidden>no</p>yes<p x=1'2 style=\"display:none\">no</p>", "yes"),
        ("<b " + "a='" * 3000 + ">deep", "deep"),
        ("x <b ==\"a>y</b>", "x y"),
    ],
)
def test_stray_quotes_do_not_swallow_text(html, text):
    assert html_render.render(html) == text
