import random

import pytest
from pyspark.sql import functions as F

from ticketloom.llm import mail


def gone(text):
    return [i for i, z in enumerate(mail.parse(text)[1], 1) if z and z != mail.NEW]


CASES = [
    ("Hello,\nIt fails.\n\nKind regards,\nBob Ost\nHead of unit\n\n-----Original Message-----\nFrom: a\nSent: b\nold text", [4, 5, 6, 8, 9, 10, 11]),
    ("> old one\n> old two\n\nHello,\nIt fails.", [1, 2]),
    ("On 2021-11-14, Chloe Kest wrote:\n> Question?\nThe answer.\n> Another?\nYes.", [1, 2, 4]),
    ("Hello,\nIt fails.\n-- \nRui", [3, 4]),
    ("Hello,\nRegards to deadlines, the page is wrong.\nPlease pass my best regards to them.", []),
    ("From: Bob Ost <b@x.example>\nSent: 2021-02-05 09:42\nTo: c@x.example\nSubject: x\n\nHello,\nIt fails.", [1, 2, 3, 4]),
    ("Hello,\nIt fails.\n____________\nFrom: Bob Ost <b@x.example>\nSent: 2021-02-05 09:42\nTo: c@x.example\n\nold", [3, 4, 5, 6, 8]),
    ("From: and To: in the search form are swapped.\nSubject: stays empty in the template.", []),
    ("It fails.\nSent from my phone", [2]),
    ("It fails.\nIf you are not the intended recipient, please delete this message.", [2]),
    ("Title\n=====\nIt fails.", []),
    ("Es geht nicht.\nMit freundlichen Grüßen\nA. B.", [2, 3]),
    ("It fails. _x000D_\n _x000D_\nCheers, _x000D_\nBob", [3, 4]),
    ("", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_zones(text, want):
    assert gone(text) == want


def test_simhash_is_near_for_near_texts():
    a = "this notice is meant for the reader named above and for nobody else in the office"
    b = a.replace("reader", "readers")
    c = "the form asks for a value that our procedure does not have at all this week"
    h = [int(x) & (2**64 - 1) for x in mail.simhashes([a, b, c, ""])]
    assert (h[0] ^ h[1]).bit_count() < (h[0] ^ h[2]).bit_count()


def test_learned_boilerplate(spark):
    """A notice that no phrase rule knows is learned from its place under signatures, and found without one, with a typing error too."""
    notice = "Our house keeps every letter that reaches it for exactly ten years"
    rows = [(i, f"It fails since day {i}.\nKind regards,\nBob\n{notice}.") for i in range(8)]
    rows += [(20, f"It fails again.\n{notice}."), (21, f"It fails again.\n{notice.replace('exactly', 'exacly')}."), (22, "It fails again and the list is still empty."), (22, "It fails again and the list is still empty.")]
    rows += [(23, None), (24, ""), (25, "x " * 200_000)]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("line_no", F.lit("clash"))
    got = {(r.id, r.line_no) for r in mail.find_inherited(df, "id", "text").collect()}
    assert got == {(i, k) for i in range(8) for k in (2, 3, 4)} | {(20, 2), (21, 2)}
    new = {r.id: r.text for r in mail.newly_written(df, "id", "text").collect()}
    assert new[20] == "It fails again." and new[0] == "It fails since day 0." and new[24] == ""
    assert mail.find_inherited(df.limit(0), "id", "text").count() == 0


def test_every_near_line_within_the_bound_is_retrieved(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    seeds, near = [], []
    while len(near) < 40:
        seed = " ".join(word() for _ in range(8))
        line = list(seed)
        for at in rng.sample(range(len(line)), 3):
            line[at] = rng.choice("abcdefghijklmnopqrstuvwxyz")
        line = "".join(line)
        a, b = (int(x) for x in mail.simhashes([seed, line]))
        x = (a ^ b) & (2**64 - 1)
        if 5 <= x.bit_count() <= mail.HAMMING and all(x >> 13 * k & 0x1FFF for k in range(5)):  # no 13-bit part is equal
            seeds.append(seed)
            near.append(line)
    rows = [(mail._key(s), s, 0, 9) for s in seeds] + [(mail._key(s), s, 1, 0) for s in near] + [(1, "a line that is like no seed at all", 1, 0)]
    got = {r.h for r in mail.boilerplate(spark.createDataFrame(rows, "h long, line string, n_new long, n_below long")).collect()}
    assert got == {r[0] for r in rows[:-1]}


def test_copies_of_earlier_mails(spark):
    """An earlier mail pasted without any mark below the sender's own text is found, with typing errors too; a mail sent again, a
    shared sentence, other numbers and a text that many mails hold are not."""
    old = ["Hello,", "the upload of our award notice ends with a blank page every time", "Second try.", "we tried two other browsers and a colleague's computer without success", "the reference of the procedure is 2023-4711 and the deadline is near", "please tell us which office can unlock the stored draft again"]
    typed = [s.replace("colleague's", "coleague's").replace("stored", "storred") for s in old]
    steps = ["open the draft and wait until it is loaded", "choose the second tab and fill in each field", "press save and read the message at the top"]
    own = "I come back to the question below because nobody answered it so far"
    later = {
        2: [own, *old], 3: [own, "Good day", *typed], 4: old, 5: [own, old[1], "this time it happened on the day before the holidays began"],
        6: [own, *(s.replace("4711", "4712") for s in old)], 7: [own + " and it is urgent", *old[:4], "Yes.", *old[4:]],
    }
    rows = [(1, "2024-01-01", "\n".join(old))] + [(i, f"2024-01-0{i}", "\n".join(x)) for i, x in later.items()] + [(9, None, f"{own} today\n" + "\n".join(old))]
    rows += [(100 + k, f"2024-02-{k % 28 + 1:02d}", "\n".join([f"case {k} of the list that we keep in our office {'abcdefghij'[k % 10] * 5}", *steps])) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, at string, text string")
    marks = {(r.id, r.line_no) for r in mail.find_inherited(df, "id", "text").collect()}
    got = {(r.id, r.line_no) for r in mail.find_inherited(df, "id", "text", "at").collect()} - marks
    assert {x for x in got if x[0] < 100 and x[0] != 1} == {(2, k) for k in range(2, 8)} | {(3, k) for k in range(3, 9)} | {(7, k) for k in (2, 3, 4, 5, 7, 8)}
    assert not {x for x in got if x[0] >= 100}


def test_bounds_exceeded_tenfold():
    """Introductions, header blocks, closing formulas and device lines are as long as they are."""
    who = "Maria " + "Anna-Luise " * 200 + "Haldeley"
    zones = lambda text: mail.parse(text)[1]
    assert zones(f"It fails.\nOn 03.07.2021, {who} wrote:\nHello")[1:] == [mail.HEADER, mail.EARLIER]
    block = "\n".join(f"Cc: a{k}@x.example;\n<b{k}@x.example>;" if not k else f"<a{k}@x.example>;" for k in range(150))
    assert set(zones(f"It fails.\nFrom: a@x.example\nTo: b@x.example\n{block}\nSubject: X\nEarlier")[1:-1]) == {mail.HEADER}
    assert zones(f"It fails.\nKind regards, {'A' + 'b' * 700}") == [mail.NEW, mail.SIGNATURE]
    assert zones(f"It fails.\nSent from my {'very ' * 100}old phone") == [mail.NEW, mail.SIGNATURE]
    assert zones("Il valore di 537.469 EUR manca.\nIl 16/04/2023 15:13 Rui Sereley ha scritto:\n> Ciao") == [mail.NEW, mail.HEADER, mail.QUOTED]
    assert zones("Am 3.5. schrieb ich Ihnen wegen der Frist") == [mail.NEW]
