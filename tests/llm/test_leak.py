import random

import numpy as np

from ticketloom.llm import leak


def brute(docs, items, n=leak.MIN_WORDS):
    def words(t):
        return leak._WORD.findall(leak._clean(t).lower())

    return {(i, d) for d, t in docs for i, x in items for w in [words(x)] for k in range(len(w) - n + 1) if f" {' '.join(w[k : k + n])} " in f" {' '.join(words(t))} "}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(leak, "BLOCK_CHARS", 2000)
    rng = random.Random(5)
    vocabulary = [a + b for a in ("mo", "ka", "ti", "su", "re") for b in ("la", "no", "vi", "der", "s")]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 14, 30])))) for i in range(60)]
    docs = []
    for d in range(150):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            x = rng.choice(items)[1].split()
            n = rng.choice([11, 12, 13, 30])
            a = rng.randint(0, max(0, len(x) - n))
            part = x[a : a + n]
            if rng.random() < 0.3:
                part[len(part) // 2] += "x"
            if rng.random() < 0.5:
                part = [rng.choice(["{}", "**{}**", "<b>{}</b>", "{},", "\n> {}", "{}\u200b"]).format(p.upper() if rng.random() < 0.2 else p) for p in part]
            at = rng.randint(0, len(w))
            w[at:at] = part
        docs.append((d, " ".join(w)))
    df = spark.createDataFrame([*docs, (900, None), (901, ""), (0, docs[0][1])], "doc_id long, text string")
    it = spark.createDataFrame([*items, (800, None), (801, "")], "item_id long, item_text string")
    got = {tuple(r) for r in leak.find_leaks(df, it).select("item_id", "doc_id").collect()}
    want = brute(docs, items)
    assert got == want and len(want) > 20


def test_word_ends_count(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, "x" + item), (2, item + "0 tail"), (3, "a " + item + "."), (4, (item + " ") * 3000)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, item_text string")
    assert sorted(r.doc_id for r in leak.find_leaks(docs, items).collect()) == [3, 4]


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, item_text string")
    assert leak.find_leaks(docs, items).count() == 0
    assert leak.find_leaks(docs.limit(0), spark.createDataFrame([(1, "a " * 20)], items.schema)).count() == 0


def test_lemma_bound_holds():
    """A passage with few edits shares at least the bound of q-grams in one band."""
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(12)]
    index = leak.Index([(1, " ".join(words))])
    codes, _, _ = leak.letters(" ".join(words))
    changed = codes.copy()
    changed[[10, 40]] = ord("z")
    assert index.bands(changed) and index.aligned(changed, 0, 0, len(codes), 0, 0)


def test_long_tags_and_links_hide_nothing(spark):
    """Markup of ten times the former bounds inside a passage doesn't part its words."""
    words = "the award notice was published with the wrong closing date and must be corrected before friday".split()
    tag = '<span style="' + "color:red; " * 400 + '">'
    texts = [" ".join(words[:6]) + f" {tag}" + " ".join(words[6:]) + "</span>", " ".join(words[:6]) + f" [{' '.join(words[6:])}](https://{'a' * 4000}.example)"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, item_text string")
    assert {r.doc_id for r in leak.find_leaks(docs, items).collect()} == {0, 1}


def test_one_scan_keeps_what_the_blocks_need(spark):
    """The bitmap keeps every document with a passage and drops those that share little."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(30)]
    docs = [(i, " ".join([word() for _ in range(30)] + (items[i][1].split()[3:16] if i < 30 else []))) for i in range(90)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    count, seen, least = leak._all_grams(iter([items[:15], items[15:]]), leak.MIN_WORDS)
    kept = {r.doc_id for r in leak._sharing(df, seen, least, "text").collect()}
    assert count == 2 and kept == set(range(30))
