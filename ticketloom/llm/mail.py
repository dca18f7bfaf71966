"""Mails cut down to what their sender newly wrote.

Method: every line's masked words give a 64-bit SimHash. Lines that recur as signature or notice text (below a closing
formula, a signature mark or a ruler) are boilerplate seeds; the lines of all mails are retrieved against them through
Hamming partition tables (16-bit parts, probed within two flipped bits), verified by Hamming and edit distance, and removed wherever they stand.
The boundaries of earlier messages come from the mail's own marks: quote marks, header blocks, introductions, forwarding
rulers, closing formulas, signature marks. What the marks leave is compared with the earlier mails: each window of `WINDOW`
lines has a fingerprint, its mail and its time; windows of earlier mails are retrieved through Hamming partition tables
and verified by edit distance. One sentence alone tells nothing, since it is new in one mail and quoted in another; the
lines are inherited where most of an earlier mail stands, by more than chance, below text of the sender's own.

A null text gives no line; an empty or blank one neither. Lines are counted from 1 at each newline, blank ones included.
Very long mails are read whole. Repeated rows of one id give each line once. Ties in counts are no boilerplate. Empty
tables give empty results. Only the named columns are read, so clashing names do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ticketloom.llm.leak import grams
from ticketloom.session import written

#: A line is a seed when at least so many mails hold it below their own text, and so large a share of all that hold it.
SEED_MAILS, SEED_SHARE = 4, 0.8
MIN_WORDS = 5
SHINGLE = 4
HAMMING, EDIT_RATE = 10, 0.15
#: Parts of a fingerprint, of 16 bits each. Of `HAMMING` differing bits, one part has `HAMMING // PARTS` at most.
PARTS, SALTS = 4, 16
#: Lines of `MIN_WORDS` words in a row that are compared with earlier mails, the bits in which two windows may differ, and the
#: parts of which all but that many agree. Of an earlier mail's windows at least `COVER` must stand in the later one, and the
#: number of mails that would hold the same lines by chance, from their frequencies, may be `CHANCE` at most.
WINDOW, WINDOW_HAMMING, WINDOW_PARTS = 3, 3, 5
COVER, CHANCE = 0.5, 0.001
_FLIPS = [sum(1 << b for b in bits) for n in range(HAMMING // PARTS + 1) for bits in combinations(range(16), n)]

# Names of mail header fields in eight languages.
_FIELDS = "from|sent|date|to|cc|bcc|subject|importance|attachments|reply-to|de|envoyé|envoye|à|objet|importance|von|gesendet|datum|an|kopie|betreff|enviado|enviado el|para|asunto|da|inviato|a|oggetto|data|assunto|van|verzonden|aan|onderwerp|od|wysłano|wyslano|do|dw|temat"
# How messages of eight languages are called where they are forwarded or quoted.
_MESSAGE = "original message|forwarded message|begin forwarded message|original appointment|message d'origine|message transféré|message transfere|message original|ursprüngliche nachricht|ursprungliche nachricht|weitergeleitete nachricht|mensaje original|mensaje reenviado|messaggio originale|messaggio inoltrato|mensagem original|mensagem reencaminhada|mensagem encaminhada|oorspronkelijk bericht|doorgestuurd bericht|oryginalna wiadomość|oryginalna wiadomosc|przekazana wiadomość|przekazana wiadomosc|wiadomość oryginalna"
# Closing formulas of eight languages, as whole lines or before a name.
_CLOSING = "|".join(
    [
        r"(?:with |my |our )?(?:kind|kindest|best|warm|warmest|many|friendly)?\s*regards",
        r"(?:with )?(?:best|all good|kind) wishes",
        r"(?:yours )?(?:sincerely|faithfully|truly)(?: yours)?",
        r"yours(?: sincerely| faithfully| truly)?",
        r"cheers",
        r"(?:many |kind )?thanks(?: (?:and|&) (?:kind |best )?(?:regards|wishes|best wishes))?(?: in advance)?",
        r"thank you(?: (?:in advance|very much|and (?:kind |best )?regards))?",
        r"(?:br|kr|rgds|mfg|lg|vg|mvg|bgds|cdt|cdlt)",
        r"(?:bien )?cordialement(?: vôtre)?",
        r"(?:meilleures|sincères|cordiales) salutations",
        r"salutations(?: distinguées| cordiales)?",
        r"bien (?:à vous|cordialement|a vous)",
        r"(?:je vous prie|nous vous prions|veuillez)\b.*\b(?:agréer|agreer|recevoir|croire)\b.*(?:salutations|sentiments|considération|respect).*",
        r"merci d'avance",
        r"(?:mit )?(?:freundlichen|besten|herzlichen|vielen|lieben) (?:grüßen|grussen|gruessen|grüssen)",
        r"(?:freundliche|beste|viele|herzliche|liebe|schöne) (?:grüße|grusse|gruesse|grüsse)",
        r"(?:mit )?(?:freundlichem|bestem|herzlichem) gru(?:ß|ss)",
        r"hochachtungsvoll",
        r"atentamente|cordialmente|saludos(?: cordiales)?|un (?:cordial )?saludo(?: cordial)?|reciba un (?:cordial )?saludo|muchas gracias",
        r"(?:distinti|cordiali|cari|migliori) saluti|un cordiale saluto|cordialmente|saluti|grazie",
        r"(?:com os )?(?:melhores )?cumprimentos|atenciosamente|com estima|obrigad[oa]|um abraço",
        r"(?:met )?(?:vriendelijke|hartelijke|beste) groet(?:en)?|groet(?:en|jes)?|hoogachtend|mvg",
        r"z (?:poważaniem|powazaniem|wyrazami szacunku)|(?:serdecznie )?pozdrawiam(?: serdecznie)?|pozdrowienia|łączę pozdrowienia",
        r"gracias|dank(?:e|u)(?: im voraus)?|vielen dank|bedankt|dziękuję",
    ]
)
# Introductions of quoted messages.
_INTRO = "|".join(
    [
        r"on\b.{4,}\bwrote",
        r"le\b.{4,}\ba (?:écrit|ecrit)",
        r"am\b.{4,}\bschrieb\b(?! (?:ich|wir)\b).*",
        r"(?:el|em|no dia|a)\b.{4,}\b(?:escribió|escribio|escreveu)",
        r"il\b.{4,}\bha scritto",
        r"op\b.{4,}\bschreef\b(?! (?:ik|wij|we)\b).*",
        r"(?:w dniu|dnia)\b.{4,}\bnapisał(?:\(a\)|a)?",
        r"(?:w dniu|dnia)\b.{4,}\bnapisal(?:\(a\)|a)?",
    ]
)
# Marks that mobile devices leave.
_DEVICE = "|".join(
    [
        r"(?:sent|get) (?:from|via|with) (?:my )?[^.!?]*",
        r"get (?:the |our )?[^.!?]*\b(?:app|outlook)\b[^.!?]*",
        r"(?:envoyé|envoye) (?:depuis|de|à partir de) (?:mon|ma) [^.!?]*",
        r"(?:von meinem [^.!?]* gesendet|gesendet von (?:meinem |mein )?[^.!?]*)",
        r"enviado (?:desde|do|de|a partir do) (?:mi|meu|minha) [^.!?]*",
        r"inviato (?:dal|da|dalla) (?:mio|mia) [^.!?]*",
        r"(?:verzonden|verstuurd) (?:vanaf|van|met) mijn [^.!?]*",
        r"(?:wysłano|wyslano) z (?:mojego|mojej) [^.!?]*",
    ]
)
# Phrases of legal, confidentiality and environment notices in eight languages.
_LEGAL = "|".join(
    [
        r"(?:this|the) (?:e-?mail|message|communication|content of this (?:e-?mail|message))(?: and any| and its| may|,| is| contains|\b.{0,40}\b(?:confidential|privileged))",
        r"(?:confidentiality|privacy|legal) (?:notice|disclaimer)\b|^disclaimer ?: ?(?:this|the (?:information|content))",
        r"\b(?:are|is|may be) (?:strictly )?(?:confidential|privileged)\b.*\b(?:addressee|recipient|third part|privileged|intended|disclos)",
        r"if you (?:are not the (?:intended|named) (?:recipient|addressee)|have received this (?:e-?mail|message|mail))",
        r"views expressed (?:here|in this)|do(?:es)? not (?:necessarily )?(?:bind|represent the (?:views|opinion))",
        r"(?:think|consider)\b.{0,20}\benvironment\b.*\bprint",
        r"ce (?:message|courriel|mail)(?: électronique)?\b.{0,60}\b(?:confidentiel|destin|réserv)|si vous avez reçu ce (?:message|courriel|mail)|pensez à l'environnement",
        r"diese (?:nachricht|e-?mail|mail)\b.{0,80}\b(?:vertraulich|bestimmt|empfänger)|(?:wenn|falls|sollten) sie diese (?:nachricht|e-?mail|mail)\b|nicht der (?:richtige|beabsichtigte) (?:adressat|empfänger)|bitte (?:denken|prüfen) sie\b.{0,60}\b(?:umwelt|ausdruck)",
        r"este (?:mensaje|correo)\b.{0,80}\b(?:confidencial|destinatari)|si ha recibido este (?:mensaje|correo)",
        r"(?:questo messaggio|la presente (?:e-?mail|comunicazione)|il presente messaggio)\b.{0,80}\b(?:riservat|confidenzial|destinatari)|(?:se avete|se ha|qualora (?:aveste|abbia)) ricevuto questo (?:messaggio|messagio)",
        r"esta? (?:mensagem|correio|e-?mail)\b.{0,80}\b(?:confidencia|destinat)|se recebeu est[ea] (?:mensagem|correio|e-?mail)",
        r"dit (?:bericht|e-?mailbericht|e-?mail)\b.{0,80}\b(?:vertrouwelijk|bestemd)|als u (?:deze|dit) (?:mail|e-?mail|bericht)\b.{0,60}\b(?:vergissing|onterecht|abusievelijk)|indien u niet de (?:bedoelde|geadresseerde)",
        r"(?:ta wiadomość|niniejsza wiadomość|wiadomość ta|ta wiadomosc)\b.{0,80}\b(?:poufn|przeznaczon|adresat)|jeśli (?:otrzymali państwo|otrzymałeś|nie jest)\b.{0,60}\b(?:wiadomość|pomył|omył|adresat)|jeśli wiadomość dotarła",
    ]
)

_HEAD = re.compile(rf"^\W{{0,3}}(?:{_FIELDS})\W{{0,2}}[ \t]*:(?=\s|$|\S)", re.I)
_FORWARD = re.compile(rf"^[-_*=>\s]*(?:{_MESSAGE})\s*:?[-_*=<\s]*$", re.I)
_CLOSE_BARE = re.compile(rf"^(?:{_CLOSING})\s*[,.!;]*$", re.I)
_CLOSE_NAMED = re.compile(rf"^(?i:{_CLOSING})\s*[,.!;]*\s*[,–-]?\s*(?:[A-ZÀ-Ý][\w.'’-]*\s*){{1,4}}$")
_INTRO_LINE = re.compile(rf"^(?:{_INTRO})\s*:?\s*$", re.I)
_INTRO_START = re.compile(r"^(?:on|le|am|el|em|no dia|il|op|w dniu|dnia)\b.*\d", re.I)
_DEVICE_LINE = re.compile(rf"^(?:{_DEVICE})$", re.I)
_NOTICE = re.compile(_LEGAL, re.I)
_RULER = re.compile(r"^(?:[-_=*~#–—]\s?){5,}$")
_SIGN = re.compile(r"^(?:--|—|–)\s*$")
_DIGITS = re.compile(r"\d+")
_TOKEN = re.compile(r"\w+")

NEW, QUOTED, HEADER, EARLIER, SIGNATURE, NOTICE = "new", "quoted", "header", "earlier", "signature", "notice"


# The words with which a closing formula may start; a cheap test before the pattern.
_CLOSING_WORDS = frozenset(
    "with my our kind kindest best warm warmest many friendly regards all good yours sincerely faithfully truly cheers thanks thank "
    "bien cordialement meilleures sincères cordiales salutations je nous veuillez merci mit freundlichen besten herzlichen vielen lieben "
    "freundliche beste viele herzliche liebe schöne freundlichem bestem herzlichem hochachtungsvoll atentamente cordialmente saludos un reciba "
    "muchas distinti cordiali cari migliori saluti grazie com melhores cumprimentos atenciosamente obrigado obrigada met vriendelijke hartelijke "
    "groet groeten groetjes hoogachtend z serdecznie pozdrawiam pozdrowienia łączę gracias dank danke bedankt dziękuję "
    "br kr rgds mfg lg vg mvg bgds cdt cdlt".split()
)
_INTRO_WORDS = frozenset("on le am el em no a il op w dnia".split())
_DEVICE_WORDS = frozenset("sent get envoyé envoye von gesendet enviado inviato verzonden verstuurd wysłano wyslano".split())
# Pieces of which every notice holds one.
_NOTICE_PIECES = (
    "confiden", "privileg", "recipient", "addressee", "environment", "expressed", "disclaimer", "legal", "privacy", "vertraulich", "empfänger", "irrt", "umwelt", "bestimmt",
    "destin", "réserv", "riservat", "reçu", "recibido", "recebeu", "ricevut", "vertrouwelijk", "bestemd", "vergissing", "onterecht", "poufn", "adresat", "omył", "pomył", "bind",
)


def _bare(line: str) -> str:
    return line.replace("_x000D_", "").strip()


def _is_header(line: str) -> bool:
    return ":" in line[:24] and _HEAD.match(line) is not None


def _header_block(lines: list[str], i: int) -> int:
    """The number of lines of the header block that starts at line i, or 0; at least three fields, or two beside an address."""
    n = fields = 0
    mail = False
    names = set()
    while i + n < len(lines):
        s = lines[i + n]
        if _is_header(s):
            name = s.split(":", 1)[0].strip(" \t*\"'").lower()
            if name in names:
                break
            names.add(name)
            fields += 1
            mail = mail or "@" in s or "(at)" in s.lower() or "[at]" in s.lower()
        elif not s or not n or not (s[0] in "<;" or lines[i + n - 1].endswith((";", ","))):
            break
        n += 1
    return n if fields >= 3 or fields == 2 and mail else 0


def _introduction(lines: list[str], i: int, word: str) -> int:
    """The lines of an introduction ("On ..., ... wrote:") that starts at line i, one or two, or 0."""
    s = lines[i]
    if word not in _INTRO_WORDS:
        return 0
    if _INTRO_LINE.match(s):
        return 1
    after = lines[i + 1] if i + 1 < len(lines) else ""
    # a line that ends a sentence, or stands above a whole introduction, is no part of one
    if not after or s[-1] in ".!?" or _INTRO_LINE.match(after):
        return 0
    return 2 if _INTRO_START.match(s) and _INTRO_LINE.match(f"{s} {after}") else 0


def closes(s: str, word: str) -> bool:
    """Whether a line is a closing formula, alone or with a name after it; a sentence that goes on is none."""
    return word in _CLOSING_WORDS and (_CLOSE_BARE.match(s) is not None or _CLOSE_NAMED.match(s) is not None)


def _notice(s: str) -> bool:
    low = s.lower()
    return any(p in low for p in _NOTICE_PIECES) and _NOTICE.search(s) is not None


def parse(text: str) -> tuple[list[str], list[str | None]]:
    """The bare lines and the zone of each, None for blank ones."""
    raw = [_bare(x) for x in text.split("\n")]
    n_lines = len(raw)
    zones: list[str | None] = [None] * n_lines
    last_quote = max((i for i, s in enumerate(raw) if s[:1] == ">"), default=-1)
    zone, started, i = NEW, False, 0
    while i < n_lines:
        s = raw[i]
        if not s or s[0] == ">" or zone == EARLIER:
            zones[i] = None if not s else QUOTED if s[0] == ">" else EARLIER
            i += 1
            continue
        if (s[0] in "-_*=" or s[-1] == ":") and _FORWARD.match(s):
            zone = EARLIER
            zones[i] = HEADER
            i += 1
            continue
        if _is_header(s) and (n := _header_block(raw, i)):
            zones[i : i + n] = [HEADER if raw[k] else None for k in range(i, i + n)]
            if started:  # a block above everything is the mail's own header
                zone = EARLIER
            i += n
            continue
        word = s.split(None, 1)[0].strip(",.!:;").lower()
        if n := _introduction(raw, i, word):
            zones[i : i + n] = [HEADER] * n
            i += n
            if last_quote < i and started:  # without quote marks the rest is the earlier message, unless nothing else is left
                zone = EARLIER
            started = True
            continue
        if zone == NEW:
            if _SIGN.match(s) or closes(s, word):
                zone = SIGNATURE
            elif word in _DEVICE_WORDS and _DEVICE_LINE.match(s):
                zones[i] = SIGNATURE
                i += 1
                continue
            elif _notice(s):
                while i < n_lines and raw[i] and raw[i][0] != ">":  # to the end of its paragraph
                    zones[i] = NOTICE
                    i += 1
                continue
        zones[i] = zone
        started = True
        i += 1
    # a ruler belongs to what stands under it, at the end to what stands above it
    for i in range(n_lines - 1, -1, -1):
        if zones[i] == NEW and raw[i][0] in "-_=*~#–—" and _RULER.match(raw[i]):
            after = next((z for z in zones[i + 1 :] if z), None)
            before = next((z for z in reversed(zones[:i]) if z), None)
            if after and after != NEW and after != QUOTED or after is None and before and before != NEW:
                zones[i] = after or before
    return raw, zones


def masked(line: str) -> str:
    """A line's words in lower case, numbers as 0."""
    return " ".join(_TOKEN.findall(_DIGITS.sub("0", line.lower())))


def _bit_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text how many of its hashed character `SHINGLE`-grams have each of 64 bits set, and how many grams there are.

    Character grams, since a typing error then changes few of a short line's shingles."""
    out, totals = np.zeros((len(texts), 64), np.int32), np.zeros(len(texts), np.int64)
    for at in range(0, len(texts), 1000):
        part = [t.ljust(SHINGLE) for t in texts[at : at + 1000]]
        sizes = np.array([len(t) for t in part])
        h = grams(np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32), SHINGLE)
        owner = np.repeat(np.arange(len(part)), sizes)
        inside = owner[: len(h)] == owner[SHINGLE - 1 :]  # no gram crosses from one text into the next
        bits = np.unpackbits(h[inside].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts = sizes - SHINGLE + 1
        ends = np.cumsum(counts)
        out[at : at + 1000] = np.add.reduceat(bits, np.concatenate([[0], ends[:-1]]), axis=0, dtype=np.int32)
        totals[at : at + 1000] = counts
    return out, totals


def _signs(bits: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Signed 64-bit numbers whose bits are those that most grams have set."""
    return np.packbits(2 * bits > totals[:, None], axis=1).view(">u8").reshape(-1).astype(np.uint64).view(np.int64)


def simhashes(texts: list[str]) -> np.ndarray:
    """Of each text the signs of the summed bits of its hashed character `SHINGLE`-grams, as signed 64-bit numbers."""
    return _signs(*_bit_counts(texts))


def _key(line: str) -> int:
    return xxhash.xxh64_intdigest(line) - 2**63


_WINDOW = "at long, pos int, n_windows int, l1 long, l2 long, l3 long, h1 long, h2 long, h3 long, code long, numbers long, shorts string"
_WINDOW_COLUMNS = [x.split()[0] for x in _WINDOW.split(", ")]


def _windows(mails: list[tuple], bits: np.ndarray, totals: np.ndarray, keys: np.ndarray) -> list[tuple]:
    """The windows of a batch's mails. A mail is (id, at, counted, gaps): counted has (line_no, number of the distinct line,
    numbers in it) of each line, gaps the short lines before each of them and after the last, as "line_no:key" words."""
    out, firsts, meta = [], [], []
    order = [c[1] for m in mails for c in m[2]]
    at = 0
    for i, t, counted, gaps in mails:
        n = len(counted) - WINDOW + 1
        for p in range(n):
            firsts.append(at + p)
            numbers = " ".join(c[2] for c in counted[p : p + WINDOW] if c[2])
            meta.append((i, t, p, n, *(c[0] for c in counted[p : p + WINDOW]), numbers, " ".join(g for g in gaps[p : p + WINDOW + 1] if g)))
        at += len(counted)
    if not meta:
        return out
    order, firsts = np.array(order), np.array(firsts)
    members = [order[firsts + k] for k in range(WINDOW)]
    codes = _signs(sum(bits[m] for m in members), sum(totals[m] for m in members)).tolist()
    hs = zip(*(keys[m].tolist() for m in members))
    for (i, t, p, n, l1, l2, l3, numbers, shorts), h, code in zip(meta, hs, codes):
        out.append((i, t, p, n, l1, l2, l3, *h, code, _key(numbers) if numbers else 0, shorts))
    return out


def scanned(rows: DataFrame, id_col: str, text_col: str, time_col: str | None = None) -> DataFrame:
    """Each mail's lines, read once. Rows with a zone: a line that the mail's marks show as not new (h null), or a new one of
    `MIN_WORDS` words or more (h is the key of its masked text). Rows without, but with h: a batch's distinct masked lines with
    n_below, the times they stand in a signature or notice, n_new, in a mail's own text, and their fingerprint. Rows with
    neither: with a time, each window of `WINDOW` such new lines of a mail."""
    kind = rows.schema[id_col].dataType.simpleString()
    columns = [id_col, "line_no", "zone", "h", "line", "n_new", "n_below", "fingerprint"]
    schema = f"`{id_col}` {kind}, line_no long, zone string, h long, line string, n_new long, n_below long, fingerprint long, {_WINDOW}"
    time = F.unix_micros(F.col(time_col).cast("timestamp")) if time_col else F.lit(None).cast("long")

    texts = {"zone", "line", "shorts"}

    def frame(out: list[tuple], names: list[str], ids: object) -> pd.DataFrame:
        # column by column, since pandas takes numbers beside None for floats and rounds 64-bit keys
        filled = dict(zip(names, zip(*out))) if out else dict.fromkeys(names, ())
        kinds = {c: object if c in texts else ids if c == id_col else "Int64" for c in columns + _WINDOW_COLUMNS}
        return pd.DataFrame({c: pd.Series(list(filled[c]) if c in filled else [None] * len(out), dtype=kind) for c, kind in kinds.items()})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf[id_col].dtype if pdf[id_col].dtype == object else "Int64"
            out, counts, mails = [], {}, []
            for i, text, t in zip(pdf[id_col], pdf[text_col], pdf["__at"]):
                if not text:
                    continue
                timed, counted, gaps = not pd.isna(t), [], [""]
                for k, (s, z) in enumerate(zip(*parse(text)), 1):
                    if z is None:
                        continue
                    if z != NEW:
                        out.append((i, k, z, None, None, None, None, None))
                    if (z == NEW or z == SIGNATURE or z == NOTICE) and s.count(" ") >= MIN_WORDS - 1:
                        m = masked(s)
                        if m.count(" ") >= MIN_WORDS - 1:
                            if (c := counts.get(m)) is None:
                                c = counts[m] = [0, 0, _key(m), len(counts)]
                            c[z != NEW] += 1
                            if z == NEW:
                                out.append((i, k, z, c[2], None, None, None, None))
                                counted.append((k, c[3], " ".join(_DIGITS.findall(s))))
                                gaps.append("")
                                continue
                    if z == NEW and timed:
                        gaps[-1] += f"{' ' if gaps[-1] else ''}{k}:{_key(s.lower())}"
                if timed and len(counted) >= WINDOW:
                    mails.append((i, int(t), counted, gaps))
            bits, totals = _bit_counts(list(counts))
            codes = _signs(bits, totals).tolist()
            out += [(None, None, None, h, m, a, b, codes[k]) for m, (a, b, h, k) in counts.items()]
            yield frame(out, columns, ids)
            yield frame(_windows(mails, bits, totals, np.array([c[2] for c in counts.values()], np.int64)), [id_col, *_WINDOW_COLUMNS], ids)

    read = rows.select(id_col, text_col, time.alias("__at")).where(F.col(text_col).isNotNull())
    return read.mapInPandas(scan, schema)


def line_table(scan: DataFrame) -> DataFrame:
    """(h, line, n_new, n_below, fingerprint) of each distinct masked line."""
    counted = scan.where("zone is null and h is not null").groupBy("h")
    return counted.agg(F.min("line").alias("line"), F.sum("n_new").alias("n_new"), F.sum("n_below").alias("n_below"), F.min("fingerprint").alias("fingerprint"))


def _few_edits(line: str, other: str) -> Column:
    """Whether at most `EDIT_RATE` of the other's characters differ; the edit distance is given up beyond that bound."""
    return F.expr(f"levenshtein({line}, {other}, cast(floor({EDIT_RATE} * length({other})) as int)) >= 0")


def boilerplate(lines: DataFrame) -> DataFrame:
    """(h): the seeds, and the distinct new lines near one of them.

    A 16-bit part of the fingerprint that differs in two bits at most retrieves a pair, of which at most `HAMMING` bits and
    `EDIT_RATE` of the characters may differ; no pair within `HAMMING` bits is missed. The seeds, of which there are few, are
    entered under each value that their parts take with up to two bits flipped. Only fingerprints are shuffled; the texts join the retrieved pairs. Each distinct line is one row here,
    however frequent it is."""
    if "fingerprint" not in lines.columns:
        lines = lines.withColumn("fingerprint", F.pandas_udf(lambda s: pd.Series(simhashes(list(s)), dtype="int64"), LongType())("line"))
    seed = (F.col("n_below") >= SEED_MAILS) & (F.col("n_below") >= SEED_SHARE * (F.col("n_below") + F.col("n_new")))
    # written, so that no line is fingerprinted again for the other sides of the joins
    coded = written(lines.select("h", "line", F.col("fingerprint").alias("code"), seed.alias("seed"), (F.col("n_new") > 0).alias("new")).where("seed or new"))
    seeds, others = coded.where("seed").drop("seed", "new"), coded.where("not seed").drop("seed", "new")

    def parts(df: DataFrame, h: str, code: str, flips: list[int]) -> DataFrame:
        keyed = df.select(F.col("h").alias(h), F.col("code").alias(code))
        part = [F.struct(F.lit(k).alias("part"), F.shiftrightunsigned(code, 16 * k).bitwiseAND(0xFFFF).cast("int").alias("value")) for k in range(PARTS)]
        split = keyed.withColumn("p", F.explode(F.array(*part))).withColumn("flip", F.explode(F.array(*[F.lit(x) for x in flips])))
        return split.select(h, code, "p.part", F.col("p.value").bitwiseXOR(F.col("flip")).alias("value"))

    near = parts(others, "h", "code", [0]).join(parts(seeds, "seed", "seed_code", _FLIPS), ["part", "value"])
    near = near.where(F.bit_count(F.col("code").bitwiseXOR(F.col("seed_code"))) <= HAMMING).select("h", "seed").distinct()
    near = near.join(others.select("h", "line"), "h").join(seeds.select(F.col("h").alias("seed"), F.col("line").alias("seed_line")), "seed")
    near = near.where(_few_edits("line", "seed_line"))
    return seeds.select("h").unionByName(near.select("h")).distinct()


def _near_windows(first: DataFrame) -> DataFrame:
    """(code, numbers, other): the codes with the same numbers that differ in 1 to `WINDOW_HAMMING` bits, both ways.

    Of `WINDOW_PARTS` parts, so many less `WINDOW_HAMMING` agree whichever bits differ, so a table for each choice of that many
    parts misses no pair."""
    # windows with numbers of their own need no table
    shared = first.where("numbers != 0").groupBy("numbers").agg(F.count("*").alias("n")).where("n > 1").select("numbers")
    left = first.where("numbers = 0").unionByName(first.where("numbers != 0").join(shared, "numbers", "left_semi")).select("code", "numbers")
    edges = [64 * k // WINDOW_PARTS for k in range(WINDOW_PARTS + 1)]
    masks = [sum((1 << edges[p + 1]) - (1 << edges[p]) for p in chosen) for chosen in combinations(range(WINDOW_PARTS), WINDOW_PARTS - WINDOW_HAMMING)]
    masks = [m - (m >> 63 << 64) for m in masks]  # as signed numbers
    tables = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("code").bitwiseAND(F.lit(m).cast("long")).alias("part")) for k, m in enumerate(masks)]))
    met = left.select("code", "numbers", tables.alias("t")).groupBy("numbers", "t").agg(F.collect_list("code").alias("codes")).where(F.size("codes") > 1)
    pairs = met.select("numbers", "codes", F.explode("codes").alias("code")).select("numbers", "code", F.explode("codes").alias("other"))
    return pairs.where((F.col("code") != F.col("other")) & (F.bit_count(F.col("code").bitwiseXOR(F.col("other"))) <= WINDOW_HAMMING)).distinct()


def earlier_copies(scan: DataFrame, lines: DataFrame, id_col: str, mails: int) -> DataFrame:
    """(id, line_no): the new lines that copy an earlier mail, of `mails`, below text of the sender's own.

    A window's origin is the earliest mail that holds a window near it, with the same numbers. The windows before and after it in
    both mails are then compared too. Each line of a pair lies within `EDIT_RATE`. The short lines among and beside a window are
    copies too if its origin has the same ones there. A mail that begins with its origin's text was sent again and is new; one in
    which copies and answers alternate from the first line on cannot be told from it."""
    w = scan.where("code is not null").select(F.col(id_col).alias("id"), *_WINDOW_COLUMNS)
    here = F.struct("at", "id", "pos")
    first = written(w.groupBy("code", "numbers").agg(F.min(here).alias("o"), (F.min("id") != F.max("id")).alias("again")))
    near = _near_windows(first).join(first.select(F.col("code").alias("other"), "numbers", "o"), ["other", "numbers"]).select("code", "numbers", "o")
    origins = near.unionByName(first.where("again").select("code", "numbers", "o")).groupBy("code", "numbers").agg(F.min("o").alias("o"))
    hits = w.join(origins, ["code", "numbers"]).where((F.col("o.at") < F.col("at")) & (F.col("o.id") != F.col("id")))
    # the other windows of the two mails that lie as far apart, however many bits differ
    shifts = written(hits.select("id", F.col("o.id").alias("origin"), (F.col("pos") - F.col("o.pos")).alias("shift")).distinct())
    theirs = w.select(F.col("id").alias("origin"), F.col("pos").alias("origin_pos"), "numbers", F.col("n_windows").alias("all"), *[F.col(f"h{k}").alias(f"oh{k}") for k in (1, 2, 3)], F.col("shorts").alias("origin_shorts"))
    hits = w.drop("at", "code", "n_windows").join(shifts, "id").withColumn("origin_pos", F.col("pos") - F.col("shift")).join(theirs, ["origin", "origin_pos", "numbers"])
    hits = written(hits.drop("numbers", "shift").distinct())
    # each line near its counterpart
    sides = F.explode(F.array(*[F.struct(F.col(f"h{k}").alias("h"), F.col(f"oh{k}").alias("oh")) for k in (1, 2, 3)]))
    text = lambda h, name: lines.select(F.col("h").alias(h), F.col("line").alias(name))
    place = ["id", "pos", "origin", "origin_pos"]
    differing = hits.select(*place, sides.alias("s")).select(*place, "s.*").where("h != oh")
    unlike = differing.select("h", "oh").distinct().join(text("h", "line"), "h").join(text("oh", "origin_line"), "oh").where(~_few_edits("line", "origin_line")).select("h", "oh")
    hits = hits.join(differing.join(unlike, ["h", "oh"]).select(*place).distinct(), place, "left_anti")
    # most of the origin, below own text
    pair = hits.groupBy("id", "origin").agg(F.min("pos").alias("top"), F.count_distinct("origin_pos").alias("met"), F.max("all").alias("all"))
    pair = pair.where(F.col("top") > 0).where(F.col("met") >= COVER * F.col("all")).select("id", "origin")
    hits = written(hits.join(pair, ["id", "origin"], "left_semi"))
    # more than chance
    held = hits.select("id", "origin", F.explode(F.array("oh1", "oh2", "oh3")).alias("h")).distinct().join(lines.select("h", "n_new"), "h")
    chance = held.groupBy("id", "origin").agg(F.sum(F.log(F.greatest("n_new", F.lit(1)) / F.lit(float(max(mails, 1))))).alias("p"))
    chance = chance.where(F.col("p") + float(np.log(max(mails, 1))) <= float(np.log(CHANCE))).select("id", "origin")
    hits = hits.join(chance, ["id", "origin"], "left_semi")
    beside = F.transform(F.split("origin_shorts", " "), lambda x: F.split_part(x, F.lit(":"), F.lit(2)))
    same = F.filter(F.split("shorts", " "), lambda x: (x != "") & F.array_contains(beside, F.split_part(x, F.lit(":"), F.lit(2))))
    shorts = F.transform(same, lambda x: F.split_part(x, F.lit(":"), F.lit(1)).cast("long"))
    return hits.select(F.col("id").alias(id_col), F.explode(F.concat(F.array("l1", "l2", "l3"), shorts)).alias("line_no")).distinct()


def find_inherited(rows: DataFrame, id_col: str, text_col: str, time_col: str | None = None) -> DataFrame:
    """(id, line_no): the non-blank lines that the sender did not newly write. Without a time, no mail is earlier than another."""
    scan = written(scanned(rows, id_col, text_col, time_col))
    lines = written(line_table(scan))
    bad = boilerplate(lines)
    marked = scan.where("zone is not null and h is null").select(id_col, "line_no")
    if time_col:
        mails = rows.agg(F.approx_count_distinct(id_col)).first()[0]
        marked = marked.unionByName(earlier_copies(scan, lines, id_col, mails))
    # salted: one notice may stand in a third of all mails; the right side has distinct lines only
    salted = bad.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    new = scan.where("zone is not null and h is not null").select(id_col, "line_no", "h", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("long").alias("salt"))
    return marked.unionByName(new.join(salted, ["h", "salt"], "left_semi").select(id_col, "line_no")).distinct()


def newly_written(rows: DataFrame, id_col: str, text_col: str, time_col: str | None = None) -> DataFrame:
    """(id, text): each mail's newly written lines; the boilerplate lines are sent to the tasks if few, else joined."""
    drop = find_inherited(rows, id_col, text_col, time_col).groupBy(id_col).agg(F.collect_set("line_no").alias("gone"))
    base = rows.groupBy(id_col).agg(F.min(text_col).alias(text_col)).join(drop, id_col, "left")
    kept = F.filter(
        F.transform(F.split(text_col, "\n"), lambda s, i: F.when(F.coalesce(F.array_contains("gone", (i + 1).cast("long")), F.lit(False)), F.lit(None)).otherwise(F.rtrim(F.replace(s, F.lit("_x000D_"), F.lit(""))))),
        lambda s: s.isNotNull(),
    )
    return base.select(id_col, F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n")).alias("text"))
