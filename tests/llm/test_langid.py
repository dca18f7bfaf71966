import numpy as np
import pytest

from ticketloom.llm import langid

TEXT = {
    "en": "The form asks for a value that our procedure does not have. We need to know which fields are mandatory here. Please explain how the notice can be withdrawn before the deadline. ",
    "de": "Das System meldet den Fehler, sobald wir das Formular speichern. Könnten Sie uns bitte mitteilen, wie die Frist noch geändert werden kann? Die Übersetzung erscheint in einer anderen Sprache. ",
    "fr": "Nous ne parvenons pas à publier l'avis depuis la mise à jour. Je souhaite savoir quels champs sont obligatoires pour ce marché. La traduction est publiée dans une autre langue. ",
}


@pytest.fixture(scope="module")
def net():
    texts = [v for v in TEXT.values() for _ in range(40)]
    return langid.train(texts, [k for k in TEXT for _ in range(40)], epochs=14)


def test_gradients_are_right():
    net = langid.Network.fresh(("a", "b"), 1)
    x = np.random.default_rng(0).integers(1, 255, (6, langid.WINDOW)).astype(np.uint8)
    y = np.array([0, 1, 0, 1, 1, 0])
    for k, w in enumerate(net.weights()):
        w[...] = w.astype(np.float64)
    _, g = net.gradients(x, y)
    for k in (1, 5, len(g) - 2, len(g) - 1):
        w = net.weights()[k]
        at = np.unravel_index(np.abs(g[k]).argmax(), w.shape)
        old, eps = float(w[at]), 1e-2
        w[at] = old + eps
        up, _ = net.gradients(x, y)
        w[at] = old - eps
        down, _ = net.gradients(x, y)
        w[at] = old
        assert abs((up - down) / (2 * eps) - g[k][at]) < 0.05 * abs(g[k][at]) + 1e-3


def test_segments():
    assert langid.segments("Hello\n{code}select one two three four five six{code}\nshort one.") == []
    assert len(langid.segments(TEXT["en"])) == 3
    wrapped = "We need to know which fields are mandatory when the new\nform is used for the agreement."
    assert len(langid.segments(wrapped)) == 1


def test_mixed_text(spark, net):
    rows = spark.createDataFrame(
        [(1, "en", TEXT["en"]), (2, "fr", TEXT["en"]), (3, "de", TEXT["de"] + "\n" + TEXT["fr"]), (4, None, TEXT["de"]), (5, "en", None), (6, "en", ""), (7, "en", "Hi"), (8, "xx", TEXT["fr"] * 3000), (2, "fr", TEXT["en"])],
        "issue_id long, lang string, text string",
    ).withColumnRenamed("lang", "label")
    got = langid.wrong_labels(rows, net, [("en", "EN - English"), ("fr", "FR - French"), ("de", "DE - German")], "issue_id", "text", "label")
    assert sorted((r.issue_id, r.lang) for r in got.collect()) == [(2, "en"), (3, "de"), (3, "fr"), (4, "de"), (8, "fr")]
    assert langid.label_segments(rows.limit(0), net, "issue_id", "text").count() == 0
    assert langid.label_segments(rows.where("issue_id = 1"), net, "issue_id", "text").count() == 3


@pytest.mark.parametrize("label,want", [("EN - English", "en"), ("de - german", "de"), (" FR", "fr"), ("Deutsch", "de"), ("N/A", None), ("", None), (None, None), ("XX - Unknown", None), ("PT-BR", "pt"), ("SV - Swedish", "sv")])
def test_label_names(spark, label, want):
    codes = [("en", "EN - English"), ("fr", "FR - French"), ("de", "DE - German"), ("pt", "PT - Portuguese"), ("sv", "SV - Swedish")]
    assert spark.createDataFrame([(label,)], "l string").select(langid.named_language(langid.F.col("l"), codes)).first()[0] == want


def test_nothing_to_train():
    with pytest.raises(ValueError):
        langid.train([], [])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    docs = docs[docs.lang.notna()]
    used, held = docs.iloc[::2], docs.iloc[1::2]
    net = langid.train(list(used.text), list(used.lang.str.lower()), epochs=4)
    found = langid._of_batch(list(held.text), net)
    pairs = [(max(x, key=lambda s: s[2])[1], y) for x, y in zip(found, held.lang.str.lower()) if x]
    assert np.mean([a == b for a, b in pairs]) > 0.95


def test_export_artefacts_are_no_words():
    assert langid.segments("Kind regards, _x000D_\nMaria Haldois _x000D_\nContract manager _x000D_") == []
    assert len(langid.segments("The export button of the form no longer reacts _x000D_\nafter the update of last week. _x000D_")) == 1


def test_long_tags_and_quotations():
    tag = '<span style="' + "color:red; " * 400 + '">'
    assert langid.segments(tag + "we do not know if it went through</span>") == ["we do not know if it went through"]
    assert langid.segments('He wrote "' + "a" * 500 + " " + "b" * 500 + '" to them') == []
