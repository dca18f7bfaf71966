import pytest

from ticketloom.llm import residue

CASES = [
    ("{{issue_title}}", "template"), ("Re: ${subject} ", "template"), ("Request from ${a} about ${b}", "template"), ("[Insert summary here]", "template"), ("%subject%", "template"), ("__summary__", "template"),
    ("TODO", "filler"), ("lorem ipsum dolor", "filler"), ("xxxxxx", "filler"), ("....", "filler"), ("N/A", "filler"), ("Subject: -- empty --", "filler"), ("aaa bbb ccc", "filler"), ("test 12", "filler"),
    ("500 Internal Server Error ", "error"), ("502 Bad Gateway - request id 11867", "error"), ("Traceback (most recent call last): KeyError: 'summary'", "error"), ("Oops! Something went wrong on our side. Try again later.", "error"),
    ("Please enable JavaScript to view this page", "notice"), ("Your browser does not support scripts", "notice"), ("Loading, please wait...", "notice"), ("We use cookies to improve your experience. Accept all | Reject", "notice"),
    ("Question on the template placeholder ${subject} shown in E2", None), ("Internal server error during upload of lot-38.pdf", None), ("JavaScript warning in the supplier portal since 22/05/2023", None),
    ("Cookies must be enabled message blocks MyBids on tablets", None), ("Access denied page for the second user of Port of Ostrelle", None), ("HD cannot answer", None), ("Session expired while filling in F2, how to extend it", None),
    ("Undefined value in column lots of lot-45.pdf", None), ("test notice published by mistake, please remove 00123-2022", None), ("How to use the template for a change notice", None), (None, None), ("", None), ("   ", None),
    ("word " * 50_000, None),
]


def test_cases(spark):
    rows = spark.createDataFrame([(i, t, "s") for i, (t, _) in enumerate(CASES)], "id long, text string, source string")
    got = {r.id: r.kind for r in residue.find_residue(rows, "id", "text", "source").collect()}
    assert [got.get(i) for i in range(len(CASES))] == [k for _, k in CASES]


def test_weak_phrases_need_recurrence(spark):
    text = "our system could not answer, try again later"
    rows = [(i, text, f"s{i}") for i in range(6)] + [(9, "the clerk told me to try again later", "s1")]
    df = spark.createDataFrame(rows, "id long, text string, source string")
    assert {r.id for r in residue.find_residue(df, "id", "text", "source").collect()} == set(range(6))
    assert residue.find_residue(df.where("id < 2"), "id", "text", "source").count() == 0


@pytest.mark.parametrize("kind", ["template", "filler"])
def test_kept_rows(spark, kind):
    df = spark.createDataFrame([(1, "todo", "a", kind), (2, "a real summary", None, kind), (3, None, "a", kind), (2, "a real summary", None, kind)], "id long, text string, source string, form string")
    got = residue.keep_content(df, "id", "text", "source")
    assert [r.id for r in got.collect()] == [2, 2] and got.columns == df.columns
    assert residue.keep_content(df.limit(0), "id", "text", "source").count() == 0
