import pytest

from ticketloom.functions import tokens
from ticketloom.llm import mixing


def tables(spark, sizes, targets):
    docs = [(k * 10_000 + i, "word " * 20, s, 7) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, copy_no int"), spark.createDataFrame(targets, "source_name string, target_share double, max_repeats int")


def test_shares_and_caps(spark):
    docs, targets = tables(spark, {"a": 900, "b": 300, "c": 20, None: 50, "d": 10}, [("a", 0.5, 1), ("b", 0.35, 2), ("c", 0.1, 4), ("none", 0.05, 3)])
    report = {r.source_name: r for r in mixing.mix_report(docs, targets).collect()}
    assert report["none"].actual_share == 0 and report["c"].rate == 4.0
    for s, share in (("a", 0.5), ("b", 0.35), ("c", 0.1)):
        assert abs(report[s].actual_share - share / 0.95) < 0.03 and report[s].rate <= report[s].max_repeats
    mixed = mixing.mix(docs, targets)
    counts = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert counts == {s: report[s].emitted_docs for s in "abc"}
    assert mixed.groupBy("doc_id").count().selectExpr("max(count)").first()[0] == 4
    assert set(map(tuple, mixed.collect())) == set(map(tuple, mixing.mix(docs, targets).collect()))


def test_fixed_total_falls_short_of_caps(spark):
    docs, targets = tables(spark, {"a": 100, "b": 10}, [("a", 0.5, 1), ("b", 0.5, 2)])
    report = {r.source_name: r for r in mixing.mix_report(docs, targets, total_tokens=10**9).collect()}
    assert (report["a"].rate, report["b"].rate) == (1.0, 2.0) and report["b"].emitted_docs == 20


def test_edges(spark):
    docs, targets = tables(spark, {"a": 3}, [("a", 1.0, 1), ("a", 1.0, 1)])
    more = docs.unionByName(spark.createDataFrame([(90, None, "a", 1), (91, "", "a", 1), (0, "word " * 20, "a", 1)], docs.schema))
    assert mixing.mix(more, targets).count() == 6
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0
    assert mixing.mix_report(docs.limit(0), targets).first().actual_share == 0


@pytest.mark.parametrize("text", ["a b c", "x" * 500_000, " " * 300_000, "é 漢字"])
def test_long_texts_are_counted_whole(text):
    encode = tokens.encoding(mixing.TOKENIZER).encode_ordinary
    assert "".join(tokens.pieces(text)) == text and sum(len(encode(p)) for p in tokens.pieces(text)) > 0


def test_pieces_do_not_change_the_count(monkeypatch):
    """Cut before single spaces, also where a word is longer than a piece."""
    text = "one two  three " * 50 + "x" * 5000 + " four five\n\n six " * 30
    encode = tokens.encoding(tokens.TOKENIZER).encode_ordinary
    whole = len(encode(text))
    monkeypatch.setattr(tokens, "PIECE", 40)
    parts = list(tokens.pieces(text))
    assert "".join(parts) == text and len(parts) > 10
    assert sum(len(encode(p)) for p in parts) == whole
