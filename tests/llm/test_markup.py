import pytest

from ticketloom.llm import markup

CASES = [
    ("<p>Hi</p>", ["html"]), ("a &nbsp; b", ["html"]), ("&lt;b&gt;x&lt;/b&gt;", ["html"]), ("The notice<br /> is", ["html"]),
    ("# Steps\ndo it", ["markdown"]), ("a **b** c", ["markdown"]), ("Steps\n=====\nx", ["markdown"]), ("[a](https://x.example/b)", ["markdown"]), ("```\nx = <p>\n```", ["markdown"]), ("| a | b |\n|---|---|\n| 1 | 2 |", ["markdown"]), ("use `x` now", ["markdown"]), ("a ~~b~~", ["markdown"]),
    ("h2. Steps\nx", ["wiki"]), ("{color:red}x{color}", ["wiki"]), ("{{a.pdf}}", ["wiki"]), ("||a||b||\n|1|2|", ["wiki"]), ("[a|https://x.example]", ["wiki"]), ("== A ==\nx", ["wiki"]), ("'''x'''", ["wiki"]), ("!a.png|thumbnail!", ["wiki"]), ("{code:xml}\n<p>&amp;</p> **b**\n{code}", ["wiki"]), ("{*}to{*}", ["wiki"]),
    ("\\textbf{x}", ["latex"]), ("\\begin{itemize}\n\\item a\n\\end{itemize}", ["latex"]), ("$x_{1} \\leq 2$", ["latex"]), ("rule\\footnote{v2} x", ["latex"]), ("\\(n^2\\)", ["latex"]),
    ("<p>x</p> and **b**", ["html", "markdown"]),
    ("- a\n- b", []), ("1. a\n2) b", []), ("the value must be < 6 and > 2 in column A", []), ("> quoted", []), ("A price of $ 88 (or $5 with tax)", []), ("C:\\tenders\\section\\new", []), ("a > b > c", []), ("data_set_24_final.csv a_b_c", []),
    ("<cbc:ID> and <cac:Project>", []), ("{none}", []), ("x _x000D_", []), ("text\n______________\nmore", []), ("<a.b@x.example> [mailto:a@x.example]", []), ("see note [5] and *", []), ("user[at]x dot example", []), ("", []), (None, []),
]


def test_kinds(spark):
    rows = spark.createDataFrame([(i, t, "h") for i, (t, _) in enumerate(CASES)] + [(0, "<p>Hi</p>", "h"), (900, "<b>x</b> " * 30_000, None)], "id long, text string, host string")
    got = {}
    for r in markup.find_markup(rows, "id", "text", "host").collect():
        got.setdefault(r.id, []).append(r.markup_kind)
    assert got.pop(900) == ["html"]
    assert [sorted(got.get(i, [])) for i in range(len(CASES))] == [k for _, k in CASES]
    assert markup.find_markup(rows.limit(0), "id", "text", "host").count() == 0


def test_folding_and_alignment():
    assert markup.fold(["a", "a", "a"]) == ["a+"]
    assert markup.fold(["a", "b", "a", "b", "c"]) == ["(a b)+", "c"]
    assert markup.align(["a", "#", "b"], ["a", "#", "c", "b"]) == ["a", "#", "c?", "b"]
    assert markup.align(["a", "b"], ["x", "y", "z"]) is None
    done = markup.wrappers([(["a", "#", "b"], ["s1"], 5), (["a", "#", "c", "b"], ["s2"], 2), (["x"], ["s3"], 1)])
    assert [(w, sorted(s), n) for w, s, n in done] == [(["a", "#", "c?", "b"], ["s1", "s2"], 7), (["x"], ["s3"], 1)]


def test_wrapper_decides_the_ambiguous():
    assert markup.kinds_of("any_hash #", "wiki_heading any_hash #") == []
    assert markup.kinds_of("any_hash #", "any_hash #") == ["markdown"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("h2. Steps\n* a\n** b\n{code}\nx = '''1'''\n{code}", "## Steps\n- a\n  - b\n\n```\nx = '''1'''\n```"),
        ("Steps\n=====\n**a** [b](https://x.example) ~~c~~", "# Steps\na b c"),
        ("\\section{S}\n\\begin{itemize}\n\\item a\n\\end{itemize}\n$x_{1} \\leq 2$ \\textbf{b}", "## S\n\n- a\n$x_{1} \\leq 2$ b"),
        ("<h3>S</h3>\n<ul>\n <li>a</li>\n</ul>\n<pre><code>\n&lt;p&gt;\n</code></pre>", "### S\n\n- a\n\n```\n<p>\n```"),
        ("||a||b||\n|1|2|", "| a | b |\n|1|2|"),
        ("plain < text & more", "plain < text & more"),
        ("", ""),
        (None, None),
    ],
)
def test_clean(text, want):
    assert markup.clean(text) == want


def test_cleaning_follows_the_wrapper(spark):
    rows = [(k, "h2. S\n# one\n{quote}", "w") for k in range(1, 9)] + [(9, "# one\n{quote}", "w"), (10, "# one\n{quote}", "x"), (11, None, "w"), (12, "plain", None), (12, "plain", None)]
    df = spark.createDataFrame(rows, "id long, text string, host string")
    kinds = {(r.id, r.markup_kind) for r in markup.find_markup(df, "id", "text", "host").collect()}
    assert (9, "wiki") in kinds and (10, "wiki") not in kinds
    got = sorted((r.id, r.clean_text) for r in markup.clean_text(df, "id", "text", "host").collect())
    assert got[8:] == [(9, "# one"), (10, "# one\n{quote}"), (11, None), (12, "plain"), (12, "plain")]
    assert {s for _, s in got[:8]} == {"## S\n# one"}


def test_long_pieces_are_markup_like_short_ones():
    """Ten times the former bounds of a token's length, and LaTeX commands nested deeper than six."""
    long = "word " * 1300 + "end"
    cases = [
        (f"**{long}**", "markdown"),
        (f"[{long}](https://a.example)", "markdown"),
        (f"`{long}`", "markdown"),
        (f"'''{long}'''", "wiki"),
        ("{{" + long + "}}", "wiki"),
        (f"${long} \\alpha$", "latex"),
        (f"\\[{long}\\]", "latex"),
    ]
    for text, kind in cases:
        assert markup.kinds_of(" ".join(markup.stream(f"See {text} here")), "") == [kind], text[:20]
    nested = "deep"
    for _ in range(60):
        nested = f"\\textbf{{{nested}}}"
    assert markup.clean(f"It is {nested} now") == "It is deep now"


def test_a_host_of_many_streams(spark, monkeypatch):
    """Each stream of a host gets one wrapper, also where its streams are merged in parts."""
    monkeypatch.setattr(markup, "PART_STREAMS", 5)
    texts = ["**a** " * (k % 4 + 1) + "x " + "`b` " * (k % 7) + "y " + "[c](https://a.example) z " * (k % 3) for k in range(60)]
    signed = markup.signatures(spark.createDataFrame([(k, "h", t) for k, t in enumerate(texts)], "id long, host string, text string"), "id", "text", "host")
    got = markup.infer_wrappers(signed).toPandas()
    assert sorted(got.signature) == sorted({" ".join(markup.stream(t)) for t in texts}) and got.wrapper.nunique() < len(got)
