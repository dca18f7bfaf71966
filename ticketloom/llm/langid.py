"""Languages of documents and of the segments of mixed ones, with confidences.

Method: a byte convolutional network (byte embedding, filters of several widths, max pooling over the window, softmax)
trained in numpy on labelled text, applied to batches of fixed-length windows. The labelled rows for the training are
the `SAMPLE` of least hash, a documented bound; everything else reads all rows and whole texts. A segment is a sentence of
`MIN_WORDS` words or more: shorter ones (greetings, names, headings, quoted messages) and code carry no evidence. A segment
of more than one window gets the mean of its windows' log probabilities.

A null, blank or wordless text has no segment, so it gets no row. A label that names no language counts as missing.
Repeated rows with one id give that id's languages once. Equal probabilities: the language first in the alphabet.
Texts of any length are read whole. Without a labelled row of any language nothing can be trained: ValueError. An empty
table of texts gives an empty result. Only the named columns are read, so clashing names do no harm.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.session import least_hashed

LANGUAGES = ("de", "en", "es", "fr", "it", "nl", "pl", "pt")
WINDOW, STRIDE = 72, 54
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4, 5), 20, 10
MIN_WORDS = 6
#: Labelled rows used for the training, windows of one language, and characters of a labelled row at most.
SAMPLE, CLASS_WINDOWS, MAX_CHARS = 8000, 3000, 20_000
#: A language beside a text's main one counts from this probability of a segment on, the main one from the lower.
SURE, LIKELY = 0.92, 0.5

# Names of languages beside the codes and English names of the label table.
NAMES = {
    "english": "en", "anglais": "en", "englisch": "en", "inglés": "en", "inglese": "en", "inglês": "en", "engels": "en", "angielski": "en",
    "french": "fr", "français": "fr", "francais": "fr", "französisch": "fr", "francés": "fr", "francese": "fr", "francês": "fr", "frans": "fr", "francuski": "fr",
    "german": "de", "deutsch": "de", "allemand": "de", "alemán": "de", "tedesco": "de", "alemão": "de", "duits": "de", "niemiecki": "de",
    "spanish": "es", "español": "es", "espanol": "es", "espagnol": "es", "spanisch": "es", "spagnolo": "es", "espanhol": "es", "spaans": "es", "hiszpański": "es",
    "italian": "it", "italiano": "it", "italien": "it", "italienisch": "it", "italiaans": "it", "włoski": "it",
    "portuguese": "pt", "português": "pt", "portugues": "pt", "portugais": "pt", "portugiesisch": "pt", "portugués": "pt", "portoghese": "pt", "portugees": "pt", "portugalski": "pt",
    "dutch": "nl", "nederlands": "nl", "néerlandais": "nl", "niederländisch": "nl", "neerlandés": "nl", "olandese": "nl", "neerlandês": "nl", "holenderski": "nl",
    "polish": "pl", "polski": "pl", "polonais": "pl", "polnisch": "pl", "polaco": "pl", "polacco": "pl", "polonês": "pl", "pools": "pl",
}

_CODE = re.compile(r"\{(code|noformat)(?::[^}\n]*)?\}.*?\{\1\}|```.*?(?:```|\Z)|<(pre|code|script|style)\b.*?</\2\s*>|`[^`\n]*`|\\begin\{(equation\*?|verbatim|lstlisting|align\*?)\}.*?\\end\{\3\}|\$\$.*?\$\$", re.S | re.I)
_MARK = re.compile(r"<[A-Za-z][\w:-]*(?:\s+[\w:@.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))+\s*/?>|</?[A-Za-z!][^<>]{0,300}>|\{[a-zA-Z]+(?::[^{}\n]*)?\}|\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?|&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);|\]\([^()\s]*\)|https?://\S+|www\.\S+")
_QUOTED = re.compile(r"\"[^\"\n]+\"|«[^»\n]+»|„[^“”\"\n]+[“”\"]|“[^”\n]+”")
_END = re.compile(r"[.!?…][\"'”’»)\]*_]*\s+")
_WORD = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")


# The names of mail header fields in eight languages.
_HEADER = re.compile(
    r"\W*(?:from|sent|date|to|cc|bcc|subject|de|envoyé|à|objet|von|gesendet|datum|an|kopie|betreff|enviado|para|asunto|da|inviato|a|oggetto|data|assunto|van|verzonden|aan|onderwerp|od|wysłano|do|dw|temat)[ \t]*:(?!.*\b[.?!] )",
    re.I,
)


def _counts(s: str) -> bool:
    """Whether a sentence is one: `MIN_WORDS` words, not mostly names (addresses, titles), not a mail header."""
    if s.count(" ") < MIN_WORDS - 1:
        return False
    words = _WORD.findall(s)
    if len(words) < MIN_WORDS:
        return False
    small = len([w for w in words if w[0].islower()])
    return (small >= 4 or s.isupper() or 2 * small > len(words)) and not (":" in s[:16] and _HEADER.match(s))


def _sentences(line: str) -> Iterator[str]:
    at = 0
    for m in _END.finditer(line):
        yield line[at : m.end()]
        at = m.end()
    yield line[at:]


def segments(text: str) -> list[str]:
    """The sentences of `MIN_WORDS` or more words, without code, markup, addresses and short quotations."""
    text = text.replace("_x000D_", "")  # what exports leave of carriage returns would count as words
    if "{" in text or "`" in text or "<" in text or "\\" in text or "$$" in text:
        text = _CODE.sub("\n", text)
        text = _MARK.sub(" ", text)
    elif "&" in text or "](" in text or "http" in text or "www." in text:
        text = _MARK.sub(" ", text)
    if '"' in text or not text.isascii():
        text = _QUOTED.sub(lambda m: " " if m[0].count(" ") < 5 else m[0], text)
    lines: list[str] = []
    before = ""
    for line in text.splitlines():
        line = line.strip(" \t>|")
        if not line:
            continue
        if len(before) >= 40 and before[-1] not in ".!?…:;" and (line[0].islower() or len(before) >= 55 and line[0].isalnum()):
            lines[-1] = before = f"{before} {line}"
        else:
            lines.append(line)
            before = line
    return [s for line in lines for s in _sentences(line) if _counts(s)]


def plain(segment: str) -> str:
    """What the network reads: lower case, composed, numbers as 0."""
    s = segment if segment.isascii() else unicodedata.normalize("NFC", segment)
    return " ".join(_DIGITS.sub("0", s.lower()).split())


def without_accents(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).replace("ł", "l")


def windows(s: str) -> np.ndarray:
    """The text's bytes in windows of fixed length; the last one ends with the text. Short texts are padded with 0."""
    b = np.frombuffer(s.encode("utf-8", "replace"), np.uint8)
    if len(b) <= WINDOW:
        out = np.zeros((1, WINDOW), np.uint8)
        out[0, : len(b)] = b
        return out
    at = np.unique(np.append(np.arange(0, len(b) - WINDOW, STRIDE), len(b) - WINDOW))
    return b[at[:, None] + np.arange(WINDOW)]


@dataclass
class Network:
    """The weights. Filters of width w are matrices of w * EMBEDDING rows."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray
    languages: tuple[str, ...]

    @classmethod
    def fresh(cls, languages: tuple[str, ...], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        embedding = normal(256, EMBEDDING, scale=0.5)
        embedding[0] = 0
        filters = [normal(w * EMBEDDING, FILTERS, scale=1 / np.sqrt(w * EMBEDDING)) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        return cls(embedding, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], normal(n, len(languages), scale=1 / np.sqrt(n)), np.zeros(len(languages), np.float32), languages)

    def weights(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.dense, self.dense_bias]

    @staticmethod
    def columns(x: np.ndarray, w: int) -> np.ndarray:
        """(windows, positions, w * EMBEDDING), a view: neighbouring embeddings lie side by side in memory."""
        n, length, e = x.shape
        s = x.strides
        return np.lib.stride_tricks.as_strided(x, (n, length - w + 1, w * e), (s[0], s[1], s[2]), writeable=False)

    def pooled(self, batch: np.ndarray) -> np.ndarray:
        x = self.embedding[batch]
        out = [(np.ascontiguousarray(self.columns(x, w)).reshape(-1, w * EMBEDDING) @ f).reshape(len(batch), -1, FILTERS).max(1) + b for w, f, b in zip(WIDTHS, self.filters, self.biases)]
        return np.maximum(np.concatenate(out, 1), 0)

    def log_probabilities(self, batch: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(batch), 512):
            z = self.pooled(batch[i : i + 512]) @ self.dense + self.dense_bias
            z -= z.max(1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)

    def gradients(self, batch: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients; max pooling passes the gradient to the position that won."""
        n = len(batch)
        x = self.embedding[batch]
        hidden, winners = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.biases):
            c = (np.ascontiguousarray(self.columns(x, w)).reshape(-1, w * EMBEDDING) @ f).reshape(n, -1, FILTERS)
            best = c.argmax(1)
            winners.append(best)
            hidden.append(np.take_along_axis(c, best[:, None, :], 1)[:, 0, :] + b)
        z = np.concatenate(hidden, 1)
        h = np.maximum(z, 0)
        logits = h @ self.dense + self.dense_bias
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        loss = float(-np.log(p[np.arange(n), y] + 1e-9).mean())
        p[np.arange(n), y] -= 1
        p /= n
        g_dense, g_bias = h.T @ p, p.sum(0)
        g_z = (p @ self.dense.T) * (z > 0)
        g_embedding, g_filters, g_biases = np.zeros_like(self.embedding), [], []
        for k, (w, f, best) in enumerate(zip(WIDTHS, self.filters, winners)):
            g = g_z[:, k * FILTERS : (k + 1) * FILTERS]
            at = best[:, :, None] + np.arange(w)  # windows, filters, width
            rows = np.arange(n)[:, None, None]
            seen = x[rows, at].reshape(n, FILTERS, w * EMBEDDING)
            g_filters.append(np.einsum("nf,nfd->df", g, seen))
            g_biases.append(g.sum(0))
            back = (g[:, :, None] * f.T[None]).reshape(n, FILTERS, w, EMBEDDING)
            where, flat = batch[rows, at].reshape(-1), back.reshape(-1, EMBEDDING)
            for e in range(EMBEDDING):
                g_embedding[:, e] += np.bincount(where, flat[:, e], 256)
        return loss, [g_embedding, *g_filters, *g_biases, g_dense, g_bias]


def _examples(texts: list[str], labels: list[str], languages: tuple[str, ...], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Windows and classes. Each language gives `CLASS_WINDOWS` windows at most and is repeated up to the largest."""
    xs, ys = [], []
    for k, lang in enumerate(languages):
        segs = [plain(s) for t, y in zip(texts, labels) if y == lang for s in segments(t)]
        segs = [segs[i] for i in rng.permutation(len(segs))[:CLASS_WINDOWS]]
        if not segs:
            continue
        # a third of the segments lose their accents, since mails often do; a window may start anywhere
        segs = [without_accents(s) if rng.random() < 0.33 else s for s in segs]
        cut = [s[a : a + int(rng.integers(28, WINDOW + 30))] for s in segs for a in [int(rng.integers(0, max(1, len(s) - 40)))]]
        w = np.concatenate([windows(s)[:1] for s in segs + cut])
        xs.append(w[rng.permutation(len(w))[:CLASS_WINDOWS]])
        ys.append(np.full(len(xs[-1]), k))
    if not xs:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64)
    most = max(map(len, xs))
    return np.concatenate([np.resize(x, (most, WINDOW)) for x in xs]), np.concatenate([np.resize(y, most) for y in ys])


def train(texts: list[str], labels: list[str], doubtful: tuple[list[str], list[str]] = ([], []), epochs: int = 6, seed: int = 7) -> Network:
    """A network for the languages among the labels, by Adam on windows of the texts' segments.

    doubtful: texts whose labels may be wrong. In the second half of the epochs those join the training whose label is the
    main language that the network by then finds in them."""
    rng = np.random.default_rng(seed)
    languages = tuple(sorted(set(labels)))
    if not languages:
        raise ValueError("no labelled text to train on")
    x, y = _examples(texts, labels, languages, rng)
    if not len(x):
        raise ValueError("no labelled text has a sentence")
    net = Network.fresh(languages, seed)
    w = net.weights()
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for epoch in range(epochs):
        if epoch == epochs // 2 and doubtful[0]:
            found = [languages_of(f) for f in _of_batch(doubtful[0], net)]
            agreed = [(a, b) for a, b, f in zip(*doubtful, found) if list(f) == [b]]
            x2, y2 = _examples([a for a, _ in agreed], [b for _, b in agreed], languages, rng)
            half = rng.permutation(len(x))[: max(len(x) // 2, len(x) - len(x2))]
            x, y = np.concatenate([x[half], x2]), np.concatenate([y[half], y2])
        order = rng.permutation(len(x))
        for i in range(0, len(x), 128):
            _, g = net.gradients(x[order[i : i + 128]], y[order[i : i + 128]])
            t += 1
            rate = 0.004 * (1 - epoch / epochs * 0.85)
            for a, b, c, d in zip(w, g, m, v):
                c += 0.1 * (b - c)
                d += 0.01 * (b * b - d)
                a -= (rate * (c / (1 - 0.9**t)) / (np.sqrt(d / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        net.embedding[0] = 0
    return net


def _sample(rows: DataFrame, id_col: str, text_col: str, lang: F.Column, n: int) -> tuple[list[str], list[str]]:
    """Texts and labels of the `n` labelled ids of least hash; rows and characters are bounded."""
    usable = lang.isin(*LANGUAGES) & (F.length(text_col) <= MAX_CHARS)
    labelled = rows.where(usable).select(F.col(text_col).alias("t"), lang.alias("l"), F.col(id_col).alias("i"))
    got = least_hashed(labelled, F.col("i"), n).select("h", "t", "l").toPandas().sort_values("h")
    return list(got.t), list(got.l)


def train_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", doubtful: DataFrame | None = None, sample: int = SAMPLE) -> Network:
    """Trained on the `sample` labelled rows of least hash, and on as many of `doubtful`, whose columns are id, text, lang."""
    sure = _sample(docs, id_col, text_col, F.lower(F.trim(F.col(lang_col))), sample)
    more = _sample(doubtful, "id", "text", F.col("lang"), sample) if doubtful is not None else ([], [])
    return train(*sure, more)


def classified(segs: list[str], net: Network) -> list[tuple[str, float]]:
    """(language, confidence) of each segment; equal segments of a batch are read once."""
    keys = [plain(s) for s in segs]
    unique = list(dict.fromkeys(keys))
    if not unique:
        return []
    parts = [windows(s) for s in unique]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    log = net.log_probabilities(np.concatenate(parts))
    mean = np.zeros((len(unique), log.shape[1]))
    np.add.at(mean, owner, log)
    mean /= np.bincount(owner, minlength=len(unique))[:, None]
    p = np.exp(mean - mean.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    found = {s: (net.languages[b], float(q[b])) for s, b, q in zip(unique, best, p)}
    return [found[k] for k in keys]


def _of_batch(texts: list[str | None], net: Network) -> list[list[tuple[str, str, float]]]:
    """(segment, language, confidence) of each text of a batch."""
    segs = [segments(t) if t else [] for t in texts]
    flat = iter(classified([s for x in segs for s in x], net))
    return [[(s, *next(flat)) for s in x] for x in segs]


def label_segments(rows: DataFrame, net: Network, id_col: str, text_col: str) -> DataFrame:
    """(id, segment_no, segment, lang, confidence) of every segment."""
    shared = rows.sparkSession.sparkContext.broadcast(net)  # of fixed size
    kind = rows.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, k, *s) for i, x in zip(pdf[id_col], _of_batch(list(pdf[text_col]), shared.value)) for k, s in enumerate(x)]
            yield pd.DataFrame(out, columns=[id_col, "segment_no", "segment", "lang", "confidence"])

    return rows.select(id_col, text_col).mapInPandas(scan, f"{id_col} {kind}, segment_no int, segment string, lang string, confidence double")


def languages_of(found: list[tuple[str, str, float]]) -> dict[str, tuple[int, float]]:
    """Segments and greatest confidence of a text's main language and of each other one that is sure at least once."""
    weight: dict[str, float] = {}
    for _, lang, p in found:
        weight[lang] = weight.get(lang, 0.0) + p
    main = min(weight, key=lambda k: (-weight[k], k)) if weight else None
    out: dict[str, tuple[int, float]] = {}
    for _, lang, p in found:
        if p >= (LIKELY if lang == main else SURE):
            n, q = out.get(lang, (0, 0.0))
            out[lang] = (n + 1, max(q, p))
    return out


def label_documents(rows: DataFrame, net: Network, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, lang, confidence, n_segments, n_languages): one row per language of each text that has any."""
    shared = rows.sparkSession.sparkContext.broadcast(net)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    names = [id_col, *keep, "lang", "confidence", "n_segments", "n_languages"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            kept = zip(*[pdf[c] for c in (id_col, *keep)])
            for k, found in zip(kept, _of_batch(list(pdf[text_col]), shared.value)):
                got = languages_of(found)
                out += [(*k, lang, p, n, len(got)) for lang, (n, p) in sorted(got.items())]
            yield pd.DataFrame(out, columns=names)

    return rows.select(id_col, *keep, text_col).mapInPandas(scan, f"{kinds}, lang string, confidence double, n_segments int, n_languages int")


def named_language(label: F.Column, codes: list[tuple[str, str]]) -> F.Column:
    """The code of the language that a label names in any spelling, or null. codes: rows of the label table."""
    names = dict(NAMES)
    for code, text in codes:
        names[code.lower()] = code.lower()
        names |= {w.lower(): code.lower() for w in _WORD.findall(text or "") if len(w) > 2}
    table = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    words = F.split(F.lower(label), r"[^\p{L}]+")
    return F.get(F.filter(F.transform(words, lambda w: F.try_element_at(table, w)), lambda c: c.isNotNull()), F.lit(0))


def wrong_labels(rows: DataFrame, net: Network, codes: list[tuple[str, str]], id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, lang, confidence): the languages of the texts whose label is missing or contradicts them, or that mix."""
    base = rows.where(F.col(text_col).isNotNull()).select(id_col, text_col, named_language(F.col(label_col), codes).alias("named"))
    found = label_documents(base, net, id_col, text_col, keep=("named",))
    wrong = F.col("named").isNull() | (F.col("named") != F.col("lang")) | (F.col("n_languages") > 1)
    return found.where(wrong).groupBy(id_col, "lang").agg(F.max("confidence").alias("confidence"))
