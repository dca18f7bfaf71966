import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ticketloom.functions import text
from ticketloom.functions.html import to_markdown, to_text

CASES = [
    ("summary", "Re: Fwd: hello", "hello"),
    ("summary", "More: info", "moinfo"),
    ("summary", None, ""),
    ("summary", "   SUBJECT:  X ", "x"),
    ("mail", "Hello.\nKind regards\nBob", "Hello."),
    ("mail", "To: best regards\nHello", "Hello."),
    ("mail", "A.  B. . C", "A. B. C."),
    ("mail", "What?", "What?."),
    ("mail", "Mr. X. Y", "Mr. X. Y."),
    ("mail", "a b\u0085c\u001cd", "a. b. c. d."),
    ("mail", None, None),
    ("mail", "", ""),
    ("description", "_x000D_\nHi", ". Hi."),
    ("description", "{color:#f00}Hi{color}", "Hi."),
    ("description", None, None),
]


@pytest.mark.parametrize("kind,given_,want", CASES)
def test_cases(spark, kind, given_, want):
    f = {"summary": text.clean_summary, "mail": text.filter_email_content, "description": text.clean_description}[kind]
    assert spark.createDataFrame([(given_,)], "t string").select(f(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("s,want", [("not related to operations", True), ("hd2 cannot help", True), ("hello", False), ("", False), (None, False)])
def test_unwanted(spark, s, want):
    assert spark.createDataFrame([(s,)], "t string").select(text.is_unwanted_summary(F.col("t"))).first()[0] is want


@pytest.mark.parametrize("n,a,b", [(100, 103, 100), (101, 103, 100), (0, 3, 0)])
def test_cuts(spark, n, a, b):
    df = spark.createDataFrame([("x" * n,)], "t string")
    assert tuple(map(len, df.select(text.cut_always(F.col("t")), text.cut_long(F.col("t"))).first())) == (a, b)


@pytest.mark.parametrize("url,want", [("https://h/a/b.html?x#y", "a_b.md"), ("https://h/", "index.md"), ("https://h/a b/c", "a_b_c.md"), ("https://h/é.x", "é.md"), ("https://h/!!!", "page.md")])
def test_file_name(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(text.file_name(F.col("u"))).first()[0] == want


def test_between(spark):
    df = spark.createDataFrame([("x<a> hi <b>",), ("x<a> hi",), ("<b>",), (None,)], "t string")
    assert [r[0] for r in df.select(text.between(F.col("t"), "<a>", "<b>")).collect()] == ["hi", None, None, None]


def model(s):
    """The mail rules, line by line."""
    import re

    out = []
    for line in re.split("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]", s):
        t = line.strip()
        if not t or re.match(r"^\s*\*?\s*(From|Sent|To|Subject|Importance|CC)\s*:", line, re.I) or re.match(r"^\s*\|", line):
            continue
        if any(p in line.lower() for p in text.SIGN_OFFS + text.PRIVACY):
            break
        parts, at = [], 0
        for m in re.finditer(r"\. +", line):
            if m.start() >= at and not any(line[: m.start()].endswith(a) for a in text.ABBREVIATIONS):
                parts.append(line[at : m.start()])
                at = m.end()
        parts = [p.strip() for p in [*parts, line[at:]] if p.strip()]
        joined = ". ".join(parts)
        if joined:
            out.append(joined if joined.endswith(".") else joined + ".")
    return " ".join(out)


PIECES = ["Hello", "Mr", "e.g", ". ", ".  ", ".", "From: x", "| a |", "\n", "\r\n", " ", "Kind regards", "Disclaimer: x", " ", "What?", "com", "To : y"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=1, max_size=40))
def test_mail_against_model(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.filter_email_content(F.col("t")).alias("o"))
    assert [r.o for r in df.orderBy("i").collect()] == [model(t) for t in texts]


def test_html():
    page = "<h2>T &amp; U</h2><p>a <b>b</b></p><ul><li>x<li>y</ul><script>z</script><table><tr><th>A<th>B<tr><td>1<td>2</table><pre>c\n  d</pre>"
    md = to_markdown(page)
    assert "## T & U" in md and "a **b**" in md and "- x\n- y" in md and "z" not in md and "c\n  d" in md and "| 1 | 2" in md
    assert to_markdown("") == to_markdown(None) == "" and to_text("<p>a</p> <p> b </p>") == "a\nb"


def _mail_by_lines(text_):
    """The mail rules line by line, in plain Python."""
    import re

    space = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x2028, 0x2029, 0x3000]))
    kept = []
    for line in re.split("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]", text_):
        if not line.strip(space) or re.match(r"\s*(?:\*?\s*(?:From|Sent|To|Subject|Importance|CC)\s*:|\|)", line, re.I):
            continue
        if any(p in line.lower() for p in text.SIGN_OFFS + text.PRIVACY):
            break
        parts, at = [], 0
        for m in re.finditer(r"\. +", line):
            if not line[: m.start()].endswith(tuple(text.ABBREVIATIONS)):
                parts.append(line[at : m.start()])
                at = m.end()
        parts = [p for p in (p.strip(space) for p in [*parts, line[at:]]) if p]
        if parts:
            joined = ". ".join(parts)
            kept.append(joined if joined.endswith(".") else joined + ".")
    return " ".join(kept)


def test_mail_rules_against_lines(spark):
    """Random texts of the pieces that the rules look at."""
    import random

    rng = random.Random(5)
    pieces = ["a", "Mr", "etc", "i.e", ".", ". ", ".  ", " ", "  ", "\t", "\n", "\r\n", "\x0b", " ", "\xa0", "From:", "*To :", "|x", "Kind Regards", "disclaimer:", "word", "B", "..", "com"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(6000)] + ["a" + " " * 20000 + ". b" + ". " * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", text.filter_email_content(F.col("t")).alias("r"))
    for r in df.collect():
        assert r.r == _mail_by_lines(texts[r.i]), repr(texts[r.i])
