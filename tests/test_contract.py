import random

import pytest

from ticketloom.operators import contract

GOOD = ["Summary", "HD-1", "", "1", "", "Question", "Open", "Minor", "", "u", "c", "text", "", "", "", "", "", "EN - English", "", "s", "x"]
LABELS = "lang string, label string"


def record(cells, quote=()):
    return ";".join('"' + c.replace('"', '""') + '"' if i in quote or any(x in c for x in ';"\n\r') else c for i, c in enumerate(cells))


def errors(spark, records):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "row_id long, raw_record string")
    labels = spark.createDataFrame([("en", "EN - English"), ("xx", None)], LABELS)
    return {r.row_id: r.reason for r in contract.record_errors(rows, labels).collect()}


def with_cell(i, v):
    return record([*GOOD[:i], v, *GOOD[i + 1 :]])


CASES = [
    (record(GOOD), None),
    (record(GOOD) + "\r", None),
    (record(GOOD, quote=range(21)), None),
    (record(GOOD, quote=range(21)) + "\r", None),
    (with_cell(11, 'a "b"; c\nd'), None),
    (with_cell(11, '"'), None),
    (record(GOOD) + "\r\r", "quoting"),
    (record(GOOD) + "\n", "quoting"),
    (record(GOOD).replace("text", 'te"xt'), "quoting"),
    (record(GOOD).replace("text", '"te"xt'), "quoting"),
    (record(GOOD).replace("text", '"te"xt"'), "quoting"),
    (record(GOOD).replace("text", '"text" '), "quoting"),
    (record(GOOD).replace("text", '"text'), "quoting"),
    (record(GOOD).replace("text", "te\nxt"), "quoting"),
    (record(GOOD[:-1]), "column_count"),
    (record([*GOOD, "y"]), "column_count"),
    ("", "column_count"),
    (None, "column_count"),
    (with_cell(0, "  "), "value"),
    (with_cell(0, "a�b"), "value"),
    (with_cell(11, "a\x07b"), "value"),
    (with_cell(11, "a\tb"), None),
    (with_cell(1, "HD-"), "value"),
    (with_cell(1, "HD-1 "), "value"),
    (with_cell(3, ""), "value"),
    (with_cell(3, "1١"), "value"),
    (with_cell(4, "12"), None),
    (with_cell(4, "x"), "value"),
    (with_cell(7, "minor"), "value"),
    (with_cell(7, ""), "value"),
    (with_cell(17, ""), None),
    (with_cell(17, "en"), "value"),
    (with_cell(16, "\x07�"), None),
    (with_cell(11, "x" * 300_000), None),
    (with_cell(11, '""' * 50_000), None),
]


def test_cases(spark):
    got = errors(spark, [r for r, _ in CASES])
    assert [got.get(i) for i in range(len(CASES))] == [w for _, w in CASES]


def test_round_trip(spark):
    rng = random.Random(1)
    bits = ["a", ";", '"', "\n", "\r", "é", " ", "﷐", "﷑", "﷐﷒", ""]
    table = [["".join(rng.choice(bits) for _ in range(rng.randint(0, 6))) for _ in range(21)] for _ in range(200)]
    rows = spark.createDataFrame([(i, record(c, quote=[k for k in range(21) if rng.random() < 0.3])) for i, c in enumerate(table)], "row_id long, raw_record string")
    cells = contract.cell_table(rows).collect()
    got = {}
    for r in cells:
        got.setdefault(r.row_id, {})[r.column_no] = r.value
    assert {i: [v[k] for k in range(21)] for i, v in got.items()} == dict(enumerate(table))


def test_loaded_keeps_columns_and_repeats(spark):
    rows = spark.createDataFrame([(1, record(GOOD), "a"), (1, record(GOOD), "b"), (2, "bad", "c")], "row_id long, raw_record string, summary string")
    got = contract.load_records(rows, spark.createDataFrame([("en", "EN - English")], LABELS))
    assert sorted((r.row_id, r.raw_summary, r.summary, r.issue_id, r.parent_id) for r in got.collect()) == [(1, "a", "Summary", 1, None), (1, "b", "Summary", 1, None)]


@pytest.mark.parametrize("f", [contract.record_errors, contract.load_records])
def test_empty(spark, f):
    assert f(spark.createDataFrame([], "row_id long, raw_record string"), spark.createDataFrame([], LABELS)).count() == 0
