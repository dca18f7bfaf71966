"""Per-document text statistics and text types.

`statistics` gives the plain figures (words, word length, symbols, line ends, common words) with built-in functions.
`text_types` uses figures of the same kind, taken of each segment of a document (a sentence, or a line that is none), as
noisy labelling functions: each votes for running prose, against it, or abstains. The vote patterns of all segments
are counted (at most 3 to the power of the number of functions), the accuracies of the functions are
learned from these counts by expectation-maximization, and each segment gets the posterior of four types: prose, list, table,
junk. A document's type shares are the posterior means over its words.

Word order is judged by word pairs: how many documents hold a pair of neighbours, against the number that the words' own
places in pairs let expect in random order. The counts cover all documents, in a sketch that grows with the number of
pairs up to a bound, so its broadcast has a bound too.

Each distinct text is cut and judged once, over whole batches of code points in numpy; its words' hashes and its segments'
votes are written, and the second pass, which adds the votes on word order, reads only those.

A null or blank text has no words: its shares are null and it is not reported. Very long texts are read whole, segment by
segment. Repeated rows count as often as they occur, but word pairs are counted once for each distinct text, so
copies do not support each other's pairs. An empty table gives empty results. Only the named columns are read, so clashing names do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.session import written

TYPES = ("prose", "list", "table", "junk")
#: Slots of pairs, as a power of 2: at first, and at most where more than `FULL` of them are taken; slots of words.
PAIR_BITS, MAX_PAIR_BITS, WORD_BITS, FULL = 21, 23, 20, 0.3
#: A pair is known when so many documents besides its own hold it, and so many times more than chance lets expect.
PAIR_DOCS, PAIR_LIFT = 2, 1.0
ROUNDS = 60

# Frequent function words of eight languages.
COMMON = (
    "the of and to in is that for it as was with be by on not at from are this have an which or but when if we our you has can "
    "le la les de des du et un une est en que qui dans pour pas sur au ce il ne se sont avec par plus nous vous "
    "der die das und den von zu mit sich ein eine ist nicht auf für im dem wir wird bei auch es an aus "
    "el los las y del se por con para su al lo como más una un no "
    "il di che e per non sono gli alla della nel dal "
    "o a os as do da em um uma com não ao dos das que "
    "de het een van op te dat voor zijn met niet aan er om ook wordt "
    "w i z na nie się do jest że od po przez oraz co "
).split()
_COMMON = frozenset(COMMON)

_BREAK = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_END = re.compile(r"[.!?…][\"'”’»)\]]*\s+(?=[\"'“‘«(\[¿¡]*[^\W_])")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, mean_word_length, symbol_ratio, punctuated_line_share, common_word_share); null without words."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(t, r"[ \t\r\n]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda s: s.rlike(r"[^ \t\r]"))
    common = F.array(*[F.lit(w) for w in sorted(_COMMON)])
    base = docs.select(id_col, t.alias("t"), words.alias("w"), lines.alias("l"))
    n, m = F.size("w"), F.size("l")
    letters = F.length(F.array_join("w", ""))
    return base.select(
        id_col,
        n.alias("n_words"),
        F.when(n > 0, F.round(letters / n, 6)).alias("mean_word_length"),
        F.when(letters > 0, F.round(F.length(F.regexp_replace(F.array_join("w", ""), r"[\p{L}\p{N}]", "")) / letters, 6)).alias("symbol_ratio"),
        F.when(m > 0, F.round(F.size(F.filter("l", lambda s: s.rlike(r"[.!?][ \t\r]*\z"))) / m, 6)).alias("punctuated_line_share"),
        F.when(n > 0, F.round(F.size(F.filter("w", lambda w: F.array_contains(common, F.lower(w)))) / n, 6)).alias("common_word_share"),
    )


def _sentences(line: str) -> Iterator[str]:
    at = 0
    for m in _END.finditer(line):
        yield line[at : m.end()].rstrip()
        at = m.end()
    yield line[at:]


def segments(text: str) -> list[str]:
    """Sentences where they end inside a line; wrapped lines are joined first."""
    lines = [s for s in (x.strip() for x in _BREAK.split(text)) if s]
    joined: list[list[str]] = []
    length = spaces = 0
    for s in lines:
        wrapped = length >= 35 and joined[-1][-1][-1] not in ".!?:;…|}>" and spaces >= 3 and (s[0].islower() or s[0].isdigit() and " " in s)
        if wrapped:
            joined[-1].append(s)
            length, spaces = length + 1 + len(s), spaces + 1 + s.count(" ")
        else:
            joined.append([s])
            length, spaces = len(s), s.count(" ")
    out = []
    for s in map(" ".join, joined):
        parts: list[str] = []
        for p in _sentences(s):
            if parts and (parts[-1].count(" ") < 3 or p.count(" ") < 2):
                parts[-1] += " " + p
            else:
                parts.append(p)
        for p in parts:
            if p.count(" ") <= 60:
                out.append(p)
            else:
                t = p.split(" ")
                out += [" ".join(t[i : i + 40]) for i in range(0, len(t), 40)]
    return out


# Classes of a code point, as bits.
_KNOWN, _LETTER, _DECIMAL, _SPACE, _APOSTROPHE, _RULE, _CAPITAL, _UPPER, _LOWER, _TOKEN = (1 << k for k in range(10))
_CLASSES = np.zeros(0x110000, np.uint16)  # filled as code points come
_RULE_SIGNS = frozenset("|;={}<>\\\t·•~^#$%&*+@")


def _class_of(c: str) -> int:
    out = _KNOWN | _DECIMAL * c.isdecimal() | _SPACE * c.isspace() | _UPPER * c.isupper() | _LOWER * c.islower()
    out |= _LETTER * (c.isalnum() and not c.isdecimal()) | _TOKEN * (c.isalnum() or c == "_")
    capital = "A" <= c <= "Z" or "\u00c0" <= c <= "\u00de" or "\u0100" <= c <= "\u017f" or "\u0391" <= c <= "\u03a9" or "\u0410" <= c <= "\u042f"
    return out | _APOSTROPHE * (c in "'’") | _RULE * (c in _RULE_SIGNS) | _CAPITAL * capital


def _classes(codes: np.ndarray) -> np.ndarray:
    got = _CLASSES[codes]
    if not got.all():
        for k in np.unique(codes[got == 0]):
            _CLASSES[k] = _class_of(chr(k))
        got = _CLASSES[codes]
    return got


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def word_hashes(low: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each word, given the code points of all words in a row and where each starts."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
        at = np.arange(len(low)) - np.repeat(starts, sizes)
        h = np.add.reduceat((low.astype(np.uint64) + np.uint64(1)) * powers[at], starts)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype(np.uint32)


def _hashed(words: list[str]) -> np.ndarray:
    sizes = np.array([len(w) for w in words])
    return word_hashes(_code_points("".join(words)), np.cumsum(sizes) - sizes, sizes)


_COMMON_HASHES = np.unique(_hashed(sorted(_COMMON)))


#: The labelling functions; each votes 1 (against prose), 2 (for it) or 0 (abstains).
FUNCTIONS = ("length", "common_words", "symbols", "digits", "separators", "variety", "order", "document_order", "capitals", "word_length", "line_end")
_N = len(FUNCTIONS)


def _vote(against: np.ndarray, for_it: np.ndarray) -> np.ndarray:
    return np.where(against, 1, np.where(for_it, 2, 0))


def _coded(votes: dict[str, np.ndarray]) -> np.ndarray:
    return sum(v.astype(np.int32) * 3 ** FUNCTIONS.index(name) for name, v in votes.items())


def segment_votes(segs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes of all segments, words a segment, vote pattern without those on order, tokens a segment)."""
    if not segs:
        none = np.zeros(0, np.int32)
        return np.zeros(0, np.uint32), none, none, none
    text = "\n".join(segs) + "\n"
    codes = _code_points(text)
    kind = _classes(codes)
    start = np.cumsum([0, *(len(s) + 1 for s in segs[:-1])])
    owner = np.repeat(np.arange(len(segs)), np.diff(np.append(start, len(codes))))
    first = np.zeros(len(codes), bool)
    first[start] = True
    last = np.append(first[1:], True)  # the line end that closes a segment

    def has(bit: int) -> np.ndarray:
        return (kind & bit) != 0

    def before(flag: np.ndarray) -> np.ndarray:
        return np.append(False, flag[:-1])

    def after(flag: np.ndarray) -> np.ndarray:
        return np.append(flag[1:], False)

    def count(flag: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flag, start, dtype=np.int64)

    letter, space, decimal = has(_LETTER), has(_SPACE), has(_DECIMAL)
    inside = letter | has(_APOSTROPHE) & before(letter) & after(letter)
    word_start = inside & ~before(inside)
    at = np.flatnonzero(inside)
    heads = np.flatnonzero(word_start[at])
    hashes = word_hashes(_code_points(_lower(text))[at], heads, np.diff(np.append(heads, len(at))))
    of_word = owner[at[heads]]
    k = np.bincount(of_word, minlength=len(segs))
    near = _COMMON_HASHES[np.minimum(np.searchsorted(_COMMON_HASHES, hashes), len(_COMMON_HASHES) - 1)]
    common = np.bincount(of_word[near == hashes], minlength=len(segs))
    keys = np.sort(of_word.astype(np.uint64) << np.uint64(32) | hashes)
    distinct = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    variety = np.bincount((distinct >> np.uint64(32)).astype(np.int64), minlength=len(segs))
    token = ~space & before(space)
    token[0] = not space[0]
    heads = np.flatnonzero(token)
    n = np.bincount(owner[heads], minlength=len(segs))
    holds = lambda flag: np.bincount(owner[heads[np.add.reduceat(flag, heads, dtype=np.int64) > 0]], minlength=len(segs)) if len(heads) else n
    digits, tokens = holds(decimal), holds(has(_TOKEN))
    letters, numerals, chars = count(inside), count(decimal), np.maximum(1, count((codes != 32) & ~last))
    capital = count(has(_CAPITAL) & before(space) & ~first)
    shouted = (count(has(_UPPER)) > 0) & (count(has(_LOWER)) == 0)
    dot, solid = codes == ord("."), ~space
    rules = has(_RULE) | dot & after(dot) & after(after(dot)) & ~before(dot) | (codes == ord("/")) & before(solid) & after(space & ~last)
    rules |= (codes == ord(",")) & before(solid) & after(solid) & ~first | space & after(space) & after(after(space)) & ~before(space) & ~last
    ratio = lambda x, y: x / np.maximum(1, y)
    symbols, rules, size, share = np.maximum(0, chars - letters - numerals) / chars, ratio(count(rules), n), ratio(letters, k), ratio(common, k)
    digits, various, upper = ratio(digits, n), ratio(variety, k), ratio(capital, n - 1)
    ended = np.array([s.rstrip("\"'”’»)] ")[-1:] in (".", "!", "?", "…") for s in segs])
    code = _coded(
        {
            "length": _vote(k <= 4, k >= 6),
            "common_words": np.where(k < 3, 0, _vote(share < 0.1, share >= 0.2)),
            "symbols": _vote(symbols > 0.16, symbols < 0.09),
            "digits": _vote(digits > 0.4, digits < 0.25),
            "separators": _vote(rules > 0.18, rules < 0.08),
            "variety": np.where(k < 6, 0, _vote(various < 0.5, various > 0.7)),
            "capitals": np.where((n >= 4) & ~shouted, _vote(upper > 0.55, upper < 0.35), 0),
            "word_length": np.where(k == 0, 0, _vote((size > 12) | (size < 2.3), (size >= 3) & (size <= 9))),
            "line_end": np.where(ended, 2, 0),
        }
    )
    return hashes, k.astype(np.int32), code.astype(np.int32), tokens.astype(np.int32)


def analysed(texts: DataFrame) -> DataFrame:
    """(h1, h2, copies, words, segments) of the distinct texts (h1, h2, copies, text): the words' hashes, and per segment
    its words, vote pattern and tokens, as 32-bit numbers. A batch's texts are judged together."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            segs = [segments(t) for t in pdf.text]
            hashes, k, code, n = segment_votes([s for x in segs for s in x])
            seg_end = np.cumsum([len(x) for x in segs]).astype(np.int64)
            word_end = np.append(0, np.cumsum(k))[seg_end]
            rows = [(hashes[a:b].tobytes(), np.stack([k[p:q], code[p:q], n[p:q]]).tobytes()) for a, b, p, q in zip(np.append(0, word_end), word_end, np.append(0, seg_end), seg_end)]
            yield pdf[["h1", "h2", "copies"]].assign(words=[r[0] for r in rows], segments=[r[1] for r in rows])

    return texts.mapInPandas(scan, "h1 long, h2 long, copies long, words binary, segments binary")


class _Batch:
    """The analysed texts of a batch: all words in a row, with each word's segment and each segment's text."""

    def __init__(self, pdf: pd.DataFrame):
        parts = [np.frombuffer(b, np.int32).reshape(3, -1) for b in pdf.segments]
        self.words = np.frombuffer(b"".join(pdf.words), np.uint32)
        self.k, self.code, self.n = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int32)
        self.text = np.repeat(np.arange(len(parts)), [p.shape[1] for p in parts])
        self.segment = np.repeat(np.arange(len(self.k)), self.k)
        #: The words that the next one follows in the same segment.
        self.left = np.flatnonzero(self.segment[:-1] == self.segment[1:])

    def pairs(self, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self.words[self.left].astype(np.uint64) << np.uint64(32) | self.words[self.left + 1]) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(64 - bits)).astype(np.int64)

    def slots(self, at: np.ndarray) -> np.ndarray:
        return self.words[at] >> np.uint32(32 - WORD_BITS)


def _count(bits: int):
    """Texts that hold each pair slot, and the distinct pairs of texts in which a word slot comes first or second."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, firsts, seconds = np.zeros(1 << bits, np.int32), np.zeros(1 << WORD_BITS, np.int64), np.zeros(1 << WORD_BITS, np.int64)
        for pdf in batches:
            b = _Batch(pdf)
            slot = b.pairs(bits)
            once, at = np.unique(b.text[b.segment[b.left]] << bits | slot, return_index=True)  # a pair counts once a text
            pairs += np.bincount(once & (1 << bits) - 1, minlength=1 << bits).astype(np.int32)
            firsts += np.bincount(b.slots(b.left[at]), minlength=1 << WORD_BITS)
            seconds += np.bincount(b.slots(b.left[at] + 1), minlength=1 << WORD_BITS)
        for kind, x in ((0, pairs), (1, firsts), (2, seconds)):
            at = np.flatnonzero(x)
            yield pd.DataFrame({"kind": kind, "slot": at, "n": x[at]})

    return scan


class Pairs:
    """Counts of texts with a word pair and of a word's pairs, in sketches of bounded size."""

    def __init__(self, rows: pd.DataFrame, bits: int, total: float):
        self.bits, self.total, self.load = bits, max(1.0, total), total / (1 << bits)  # load: what other pairs are expected to add to a slot
        self.pairs, self.first, self.second = (np.zeros(1 << b, np.float32) for b in (bits, WORD_BITS, WORD_BITS))
        for kind, x in enumerate((self.pairs, self.first, self.second)):
            part = rows[rows.kind == kind]
            x[part.slot.to_numpy(np.int64)] = part.n.to_numpy(np.float32)

    @classmethod
    def of(cls, table: DataFrame) -> Pairs:
        """Counted over all distinct texts. At most 2 ** MAX_PAIR_BITS + 2 ** (WORD_BITS + 1) rows of 9 bytes reach the driver."""
        bits = PAIR_BITS
        while True:
            counted = table.select("words", "segments").mapInPandas(_count(bits), "kind byte, slot int, n int").groupBy("kind", "slot").agg(F.sum("n").cast("int").alias("n"))
            counted = written(counted)
            taken = counted.where("kind = 0").agg(F.count("*").alias("slots"), F.sum("n").alias("n")).first()
            filled = taken.slots / (1 << bits)
            if filled <= FULL or bits >= MAX_PAIR_BITS:
                break
            # the number of pairs that fill so many slots, to be spread over enough of them
            bits = MAX_PAIR_BITS if filled > 0.95 else max(bits + 1, min(MAX_PAIR_BITS, int(np.ceil(np.log2(-np.log1p(-filled) * (1 << bits) / FULL)))))
        return cls(counted.where(f"kind > 0 or n > {PAIR_DOCS}").toPandas(), bits, float(taken.n or 0))

    def known(self, batch: _Batch) -> np.ndarray:
        """Whether each pair of neighbours is known; the text's own count and the slot's expected collisions are taken off."""
        n = self.pairs[batch.pairs(self.bits)] - 1 - self.load
        expected = self.first[batch.slots(batch.left)] / self.total * self.second[batch.slots(batch.left + 1)]
        return (n >= PAIR_DOCS) & (n > PAIR_LIFT * expected)


def votes(table: DataFrame, pairs: Pairs) -> DataFrame:
    """(h1, h2, copies, pattern, n_words): a distinct text's words by vote pattern, those on word order included."""
    shared = table.sparkSession.sparkContext.broadcast(pairs)  # of bounded size

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            b = _Batch(pdf)
            known = shared.value.known(b)
            m = np.maximum(0, b.k - 1)
            known = np.bincount(b.segment[b.left], known, len(b.k))
            share = known / np.maximum(1, m)
            order = np.where(m < 4, 0, _vote(share < 0.4, share >= 0.6))
            all_pairs = np.bincount(b.text, m, len(pdf))
            whole = np.bincount(b.text, known, len(pdf)) / np.maximum(1, all_pairs)
            whole = np.where(all_pairs < 12, 0, _vote(whole < 0.45, whole >= 0.6))[b.text]
            code = b.code + _coded({"order": order, "document_order": np.where((order != 0) | (b.n >= 5), whole, 0)})
            use = b.n > 0
            base = 3 ** len(FUNCTIONS)
            key, at = np.unique(b.text[use] * base + code[use], return_inverse=True)
            out = pdf[["h1", "h2", "copies"]].iloc[key // base].assign(pattern=(key % base).astype(np.int32), n_words=np.bincount(at, b.n[use], len(key)).astype(np.int64))
            yield out

    return table.mapInPandas(scan, "h1 long, h2 long, copies long, pattern int, n_words long")


def digits_of(pattern: np.ndarray) -> np.ndarray:
    """The votes of each pattern, one column a function."""
    return (pattern[:, None] // 3 ** np.arange(_N)[None, :]) % 3


def first_guess(v: np.ndarray) -> np.ndarray:
    """Types by what the functions were written for, from which the maximization starts."""
    at = FUNCTIONS.index
    out = np.full((len(v), len(TYPES)), 0.1)
    against = v == 1
    shuffled = against[:, at("document_order")] & ~(v[:, at("order")] == 2) | against[:, at("order")] & (v[:, at("document_order")] != 2)
    junk = shuffled & ~against[:, at("separators")] & ~against[:, at("length")] | against[:, at("variety")] | against[:, at("word_length")]
    table = against[:, at("separators")] | against[:, at("digits")] | against[:, at("symbols")]
    brief = against[:, at("length")] | against[:, at("capitals")]
    prose = ~(junk | table | brief) & ((v == 2).sum(1) >= 5)
    # votes that lean to prose make it likely even where one of them is against, but for those that tell junk
    lean = ((v == 2).sum(1) / np.maximum(1, (v > 0).sum(1))) ** 3
    out[:, 0] = np.where(junk, out[:, 0], np.maximum(out[:, 0], lean))
    for i, x in enumerate((prose, brief & ~table & ~junk, table & ~junk, junk)):
        out[x, i] = 1
    return out / out.sum(1, keepdims=True)


def posterior(pattern: np.ndarray, count: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """P(type | pattern), by expectation-maximization: votes are independent given the type."""
    v = digits_of(pattern)
    hot = (v[:, :, None] == np.arange(3)[None, None, :]).astype(float)
    p = first_guess(v)
    for _ in range(rounds):
        w = p * count[:, None]
        prior = (w.sum(0) + 1) / (w.sum() + len(TYPES))
        table = np.einsum("nt,nfv->tfv", w, hot) + 0.5
        table /= table.sum(2, keepdims=True)
        log = np.log(prior)[None, :] + np.einsum("nfv,tfv->nt", hot, np.log(table))
        new = np.exp(log - log.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        if np.abs(new - p).max() < 1e-6:
            return new
        p = new
    return p


def text_types(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, prose, list, table, junk, text_type): the share of a document's words in text of each type."""
    keyed = docs.select(F.col(id_col), F.col(text_col).alias("text")).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    texts = keyed.where("text is not null").groupBy("h1", "h2", "text").agg(F.count("*").alias("copies"))
    table = written(analysed(texts))
    v = written(votes(table, Pairs.of(table)))
    counts = v.groupBy("pattern").agg(F.sum("copies").alias("n")).toPandas()  # 3 ** len(FUNCTIONS) rows at most
    p = posterior(counts.pattern.to_numpy(np.int64), counts.n.to_numpy(float)) if len(counts) else np.zeros((0, len(TYPES)))
    rows = [(int(a), *map(float, b)) for a, b in zip(counts.pattern, p)]
    patterns = docs.sparkSession.createDataFrame(rows, "pattern int, " + ", ".join(f"p_{t} double" for t in TYPES))
    weighed = v.join(F.broadcast(patterns), "pattern")
    by_text = weighed.groupBy("h1", "h2").agg(F.sum("n_words").alias("n_words"), *[F.sum(F.col("n_words") * F.col(f"p_{t}")).alias(t) for t in TYPES])
    total = F.sum("n_words")
    # the copies of one text may be a third of all rows; these rows of three numbers AQE splits as a skewed join
    joined = keyed.select(id_col, "h1", "h2").join(by_text, ["h1", "h2"])
    shares = [(F.sum(t) / total).alias(t) for t in TYPES]
    out = joined.groupBy(id_col).agg(total.alias("n_words"), *shares)
    best: Column = F.greatest(*TYPES)
    kind = F.coalesce(*[F.when(F.col(t) == best, F.lit(t)) for t in TYPES])
    return out.withColumn("text_type", F.when(F.col("prose") >= 0.5, "prose").otherwise(kind))
