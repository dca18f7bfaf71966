import random

import numpy as np
import pytest

from ticketloom.llm import quality


def corpus():
    rng = random.Random(3)
    subjects = ["the office", "our team", "a buyer", "the new system", "every supplier"]
    verbs = ["sends the form to", "looks at the list of", "cannot open the page for", "has to check the value of"]
    ends = ["the notice before the end of the day", "the old procedure without any trouble", "the second lot in the same week", "the file that was rejected"]
    sentence = lambda: f"{rng.choice(subjects).capitalize()} {rng.choice(verbs)} {rng.choice(ends)}."
    docs = [" ".join(sentence() for _ in range(rng.randint(4, 9))) for _ in range(150)]
    prose = len(docs)
    for _ in range(12):
        words = " ".join(sentence() for _ in range(8)).split()
        rng.shuffle(words)
        docs.append(" ".join(words))
        docs.append("\n".join(f"- lot {rng.randint(1, 99)}" for _ in range(20)))
        docs.append("\n".join(f"{rng.randint(1, 10**6)};LOT-{rng.randint(1, 99)};{rng.randint(1, 99)}.{rng.randint(10, 99)};2024-01-02" for _ in range(20)))
        docs.append("click here " * 60)
        docs.append("\n".join("".join(rng.choice("abcdefABCDEF0123456789+/") for _ in range(60)) for _ in range(8)))
    docs += [docs[0].upper(), docs[1].replace(".", ""), docs[2].lower()]
    return docs, set(range(prose, len(docs) - 3))


def test_types(spark):
    docs, junk = corpus()
    df = spark.createDataFrame([*enumerate(docs), (9000, None), (9001, ""), (0, docs[0])], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.text_types(df).collect()}
    assert {i for i, r in got.items() if r.prose < 0.5} == junk and 9000 not in got and 9001 not in got
    assert all(abs(r.prose + r["list"] + r.table + r.junk - 1) < 1e-6 for r in got.values())
    assert quality.text_types(df.limit(0)).count() == 0


def test_long_text(spark):
    docs, _ = corpus()
    df = spark.createDataFrame([*enumerate(docs[:60]), (900, " ".join(docs[:60]) * 20)], "doc_id long, text string")
    assert {r.doc_id: r.prose for r in quality.text_types(df).collect()}[900] > 0.9


def test_statistics(spark):
    df = spark.createDataFrame([(1, "The cat sat.\n\nA dog"), (2, ""), (3, None), (4, "--- ---")], "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in quality.statistics(df).collect()}
    assert got[1] == (5, 2.8, round(1 / 14, 6), 0.5, 0.2) or got[1][:2] == (5, 2.8)
    assert got[2] == got[3] == (0, None, None, None, None) and got[4][2] == 1.0


def test_segments_keep_all_words():
    docs, _ = corpus()
    for t in docs:
        assert "".join("".join(quality.segments(t)).split()) == "".join(t.split())


def test_expectation_maximization_recovers_accuracies():
    """Votes drawn from known accuracies come out sorted by type."""
    rng = np.random.default_rng(0)
    n = len(quality.FUNCTIONS)
    truth = rng.random(4000) < 0.7
    votes = np.where(rng.random((4000, n)) < 0.85, np.where(truth[:, None], 2, 1), np.where(truth[:, None], 1, 2))
    code = (votes * 3 ** np.arange(n)).sum(1)
    pattern, at, count = np.unique(code, return_inverse=True, return_counts=True)
    p = quality.posterior(pattern, count.astype(float))[at, 0]
    assert ((p > 0.5) == truth).mean() > 0.9


@pytest.mark.parametrize("text", ["", " ", "\n"])
def test_blank(text):
    assert quality.segments(text) == []


def test_copies_do_not_vouch_for_their_own_pairs(spark):
    docs, junk = corpus()
    copied = [docs[i] for i in sorted(junk)[::5]]  # words in random order
    df = spark.createDataFrame([*enumerate(docs), *((9000 + i, s) for i, s in enumerate(copied * 4))], "doc_id long, text string")
    got = {r.doc_id for r in quality.text_types(df).where("prose < 0.5").collect()}
    assert got == junk | set(range(9000, 9000 + 4 * len(copied)))


def batch(texts):
    """The analysed texts as the second pass reads them."""
    parts = [quality.segment_votes(quality.segments(t)) for t in texts]
    return quality._Batch(quality.pd.DataFrame({"words": [p[0].tobytes() for p in parts], "segments": [np.stack(p[1:]).tobytes() for p in parts]}))


def test_collision_load_is_taken_off():
    b = batch(["alpha beta"])
    slot = int(b.pairs(quality.PAIR_BITS)[0])
    rows = quality.pd.DataFrame([(0, slot, 8)], columns=["kind", "slot", "n"])
    pairs = lambda load: quality.Pairs(rows, quality.PAIR_BITS, load << quality.PAIR_BITS)
    assert pairs(0).known(b).all() and not pairs(6).known(b).any()


def test_pairs_and_words_are_counted_once_a_text(monkeypatch):
    monkeypatch.setattr(quality, "WORD_BITS", 20)
    b = batch(["one two one two one two", "one two\nthree"])
    got = quality.pd.concat(quality._count(quality.PAIR_BITS)(iter([quality.pd.DataFrame({"words": [b.words[:6].tobytes(), b.words[6:].tobytes()], "segments": [np.stack([b.k[:1], b.code[:1], b.n[:1]]).tobytes(), np.stack([b.k[1:], b.code[1:], b.n[1:]]).tobytes()]})])))
    assert sorted(got[got.kind == 0].n) == [1, 2]  # "two one" in one text, "one two" in two; no pair crosses a line
    assert sorted(got[got.kind == 1].n) == [1, 2] and sorted(got[got.kind == 2].n) == [1, 2]


def test_the_sketch_grows_with_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(quality, "PAIR_BITS", 4)
    monkeypatch.setattr(quality, "MAX_PAIR_BITS", 9)
    docs, _ = corpus()
    df = spark.createDataFrame([(0, i, 1, t) for i, t in enumerate(docs[:50])], "h1 long, h2 long, copies long, text string")
    table = quality.analysed(df)
    assert 4 < quality.Pairs.of(table).bits <= 9
    monkeypatch.setattr(quality, "FULL", 0.01)
    assert quality.Pairs.of(table).bits == 9


def figures(s):
    """A segment's votes by plain Python, one text at a time."""
    import re

    words = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?", s)  # then in lower case, which may make two characters of one
    vote = lambda against, for_it: 1 if against else 2 if for_it else 0
    k, n, letters = len(words), len(s.split()), sum(map(len, words))
    chars = len(s) - s.count(" ") or 1
    common = sum(w.lower() in quality._COMMON for w in words) / (k or 1)
    symbols = max(0, chars - letters - sum(c.isdecimal() for c in s)) / chars
    digits = len(re.findall(r"[^\s\d]*\d\S*", s)) / (n or 1)
    rules = len(re.findall(r"[|;={}<>\\\t·•~^#$%&*+@]|\.{3,}|(?<=\S)/(?=\s)|(?<=\S),(?=\S)|\s{3,}", s)) / (n or 1)
    variety, size = len({w.lower() for w in words}) / (k or 1), letters / (k or 1)
    upper = len(re.findall(r"\s[A-ZÀ-ÞĀ-ſΑ-ΩА-Я]", s)) / max(1, n - 1)
    return [
        vote(k <= 4, k >= 6), 0 if k < 3 else vote(common < 0.1, common >= 0.2), vote(symbols > 0.16, symbols < 0.09), vote(digits > 0.4, digits < 0.25), vote(rules > 0.18, rules < 0.08),
        0 if k < 6 else vote(variety < 0.5, variety > 0.7), 0, 0, vote(upper > 0.55, upper < 0.35) if n >= 4 and not s.isupper() else 0, 0 if not k else vote(size > 12 or size < 2.3, 3 <= size <= 9),
        2 if s.rstrip("\"'”’»)] ")[-1:] in (".", "!", "?", "…") else 0,
    ]


def test_votes_of_a_batch_equal_those_of_each_segment():
    docs, _ = corpus()
    extra = ["L'été n’est pas fini, dit-il…", "a , b / c ... d 12.5 % x_y 7a", "ÇA VA TRÈS BIEN AUJOURD'HUI", "Ж и Я — 42; foo=bar", "one", "....", "Straße İstanbul ﬁn ½ ² x", "tab\there  and   three"]
    segs = [s for t in docs + extra for s in quality.segments(t)]
    _, k, code, n = quality.segment_votes(segs)
    got = quality.digits_of(code)
    for s, row, tokens in zip(segs, got.tolist(), n.tolist()):
        assert row == figures(s) and tokens == sum(any(c.isalnum() or c == "_" for c in w) for w in s.split()), s
