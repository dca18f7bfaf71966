"""Personal information in free text, replaced by typed placeholders.

Method: candidate gradient boosting. Generators with high recall propose spans (addresses of mail, number-like runs, streets with
numbers, runs of capitalised words); boosted trees score each by features of its format and context; a threshold calibrated
on the candidates of held-out texts selects the redactions; of overlapping spans the type that can contain the other stays
(an email address its name), then the better scored one.

Labels come from the texts themselves: a candidate whose context says what it is (a field of a mail header, a greeting, the line
under a closing formula, a keyword before a number) is a labelled example, and half of the examples lose these context features in
training, so that format and lexicon must carry what context does not tell. The lexicon counts, over all texts, how often a
word stands where a name must stand and how often it is capitalised at all, in a sketch of fixed size. The trees are fitted on
the `SAMPLE` rows of least hash, a documented bound.

Null texts stay null, empty ones empty. Texts of any length are read whole. Repeated rows give one result an id. Two spans of equal
score: the longer one stays, then the earlier. Empty tables give empty results. Only the named columns are read, so
clashing names do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ticketloom.llm.boosting import Boosted
from ticketloom.llm.mail import closes
from ticketloom.llm.quality import COMMON
from ticketloom.session import least_hashed

COMMON_WORDS = frozenset(COMMON)

TYPES = ("email", "phone", "id_number", "address", "name")
BITS = 21
SAMPLE, MAX_CHARS = 6000, 20_000
#: Streets of each class that trees are fitted on at least. Their labels follow from the span's own form, unlike those of other types.
MIN_ADDRESSES = 20

_CAP = r"[A-ZÀ-ÖØ-ÞĄĆĘŁŃŚŹŻ][\w'’]*(?:-[A-ZÀ-Þ][\w'’]*)*"
_CAP_WORD = re.compile(_CAP)

# Greetings and titles that stand before a name, in eight languages.
GREETINGS = frozenset(
    "dear hello hi good hey bonjour bonsoir cher chère chere chers hallo liebe lieber guten sehr geehrte geehrter beste geachte goedemiddag hola estimado estimada estimados buenos "
    "ciao salve buongiorno gentile egregio cara caro olá ola caro cara exmo exma exmos prezado prezada bom boa witam szanowny szanowna szanowni drogi droga dzień cześć pani pan".split()
)
TITLES = frozenset("mr mrs ms miss dr prof sir madam madame monsieur mme mlle m frau herr herrn señor señora sr sra srta signor signora signore dott dottor senhor senhora heer mevrouw dhr mevr pan pani panie".split())
# Words that make a run of capitalised words the name of an organisation, a place or a thing.
ORGANISATION = frozenset(
    "office offices works agency university consulting council clinic group board transit ministry port institute ltd limited gmbh inc sa srl bv nv llc plc ag company bank hospital "
    "department unit team project service services centre center college school society association foundation authority commission committee directorate helpdesk desk street road "
    "lane avenue square login portal form button release version roads water energy rail transport union federation court library museum".split()
)
# Words that stand before a phone number or a personal number, and before numbers of other things.
PHONE_WORDS = frozenset(
    "tel tél phone telephone mobile mobil cell gsm fax call ring dial t ph téléphone telefon telefono teléfono telefone telefoon telefonu handy portable móvil cellulare telemóvel komórka reached phoned "
    "anrufen llamarme llamar chiamarmi chiamare ligar bellen dzwonić erreichbar joindre joignable appelez appeler appelle rufen rufe llamen llame chiamate ligue zadzwonić".split()
)
ID_WORDS = frozenset(
    "passport identity social security national personal tax ssn nino personnel personnelle passeport identité sécurité sociale persönliche persönlicher steuernummer ausweis ausweisnummer personalausweis reisepass "
    "pasaporte identidad personale codice fiscale identità passaporto pessoal passaporte contribuinte nif dni nie nss bsn persoonlijk persoonlijke paspoort burgerservicenummer rijksregisternummer pesel paszport osobisty osobistego dowód card".split()
)
OTHER_WORDS = frozenset(
    "notice avis bekanntmachung anuncio bando anúncio aankondiging ogłoszenia ogłoszenie lot lots cpv order ticket reference version company vat eur € $ amount value montant wert betrag importe importo valor bedrag kwota request gateway page "
    "article rule code form file procedure verfahren procedimiento procedura procedimento postępowania postepowania ogloszenia ogloszenie published publication identifier invoice br hd corrected".split()
)
DATE_WORDS = frozenset("since after before on le am vom dem el del il dal em desde op sinds od dnia until deadline".split())
# Words that greetings hold and nobody is called.
NOBODY = frozenset(
    "damen herren sirs team helpdesk all everyone colleagues colleague mesdames messieurs señores señoras signori senhores senhoras państwo państwa panstwo panstwa kolleginnen kollegen support assistance service "
    "kundendienst equipo collègues colleghi collega's sirs whom concern morning afternoon day days noon buongiorno tag días dias".split()
)
# Street words of eight languages. Those of the second group end a longer word.
STREET = (
    r"street|road|lane|avenue|square|drive|close|court|terrace|crescent|gardens|row|st\.|rd\.|ave\.?|rue|avenue|boulevard|bd\.?|place|chemin|allée|impasse|quai|route|cours|"
    r"calle|c/|avenida|avda?\.|av\.|plaza|paseo|camino|carretera|via|viale|piazza|corso|vicolo|largo|rua|praça|travessa|estrada|"
    r"ul\.|ulica|al\.|aleja|pl\.|plac|os\.|weg|platz|gasse|allee|straße|strasse|laan|plein|straat|kade|gracht|singel"
)
STREET_END = r"stra(?:ß|ss)e|str\.|weg|platz|gasse|allee|ring|damm|ufer|straat|laan|plein|kade|gracht|singel|dreef|steenweg"
_NUMBER = r"\d{1,4}(?:[ ]?(?:bis|ter)\b|[a-zA-Z]\b)?(?:[/-]\d{1,4}[a-z]?)?"
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._+-'")
_AT = re.compile(r"@|[\[({<]\s?(?i:at|@)\s?[\])}>]")
_DOMAIN = re.compile(r"[ ]?[\w-]+(?:\.[\w-]+|[ ]?(?:\[dot\]|\(dot\)|\{dot\})[ ]?[\w-]+|[ ](?:dot|punkt|point|punto|ponto)[ ][\w-]+)+", re.I)
_SPELLED = re.compile(r"(?<![\w.+'-])([\w.+'-]+) at ([\w-]+(?: dot [\w-]+)+)", re.I)
_DIGIT_RUN = re.compile(r"\d[\d ()./-]{5,}\d[A-Z]?")
#: What parts numbers that stand side by side, the widest first.
_WIDE = re.compile(r" +[/-]+ +| {2,}"), re.compile(r"/"), re.compile(r" (?=\(?0)")
_CODE_RUN = re.compile(r"[A-Z]{1,6}\d{2,9}[A-Z0-9]*")
_CODE = re.compile(r"[A-Z]{2}\d{7}|[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]|[A-Z]{1,3}\d{6,9}[A-Z]?")
_DATE = re.compile(r"(?:\d{4}[./-]\d{1,2}[./-]\d{1,2}|\d{1,2}[./-]\d{1,2}[./-](?:\d{4}|\d\d))(?:[ ]+\d{1,2})?")
_GROUP = re.compile(r"\d+")


def emails(text: str) -> list[tuple[int, int]]:
    """Addresses around each @ or its disguises; the local part is read backwards from it."""
    out = []
    for m in _AT.finditer(text):
        a, b = m.span()
        if m[0] != "@" and a and text[a - 1] == " ":
            a -= 1
        end = a
        while a and text[a - 1] in _LOCAL_CHARS:
            a -= 1
        if a < end and (d := _DOMAIN.match(text, b)):
            out.append((a, d.end()))
    if " dot " in text:
        out += [m.span() for m in _SPELLED.finditer(text) if not any(p < m.end() and m.start() < q for p, q in out)]
    return out


def _number_parts(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """A run of digits; one of more than 16 digits in parts, cut at the widest separators that it has."""
    if sum(map(str.isdigit, text[a:b])) <= 16:
        return [(a, b)]
    for wide in _WIDE:
        cuts = [m.span() for m in wide.finditer(text, a, b)]
        if cuts:
            return [x for p, q in zip([a, *(e for _, e in cuts)], [*(s for s, _ in cuts), b]) if (d := [i for i in range(p, q) if text[i].isalnum()]) for x in _number_parts(text, d[0], d[-1] + 1)]
    return [(a, b)]


def numbers(text: str) -> list[tuple[int, int]]:
    """Number-like runs of 7 to 16 digits that are no dates, and codes of letters and digits. Longer runs are several numbers
    side by side, if they have a wide separator."""
    out = []
    for m in _DIGIT_RUN.finditer(text):
        a, b = m.span()
        if a and (text[a - 1].isalnum() or text[a - 1] in "@.,/-_") or b < len(text) and (text[b].isalnum() or text[b] in "@_"):
            continue
        for a, b in _number_parts(text, a, b):
            s = text[a:b]
            n = sum(map(str.isdigit, s))
            if n < 7 or n > 16 or _DATE.fullmatch(s):
                continue
            while a and text[a - 1] in "+(":
                a -= 1
            out.append((a, b))
    for m in _CODE_RUN.finditer(text):
        a, b = m.span()
        if _CODE.fullmatch(m[0]) and not (a and (text[a - 1].isalnum() or text[a - 1] in "-_./@")) and not (b < len(text) and (text[b].isalnum() or text[b] in "-_@")):
            out.append((a, b))
    return out


_HEADER_NAME = re.compile(r"(?:from|de|von|da|od|van|reply-to|expéditeur)\s*:[ \t]*\"?([^<\[\n\"@]{3,60}?)\"?[ \t]*[<\[]", re.I)
_HEADER_WORDS = frozenset("from de von da od van reply-to expéditeur".split())
_INTRO_NAME = re.compile(rf"\w+(?: \w+)?\s+\d[\d./-]+(?:\s+\d{{1,2}}:\d{{2}})?,?\s+(?:schrieb\s+|schreef\s+)?({_CAP}(?:\s+{_CAP}){{0,2}})\s*(?:wrote|a écrit|a ecrit|:|escribió|ha scritto|escreveu|napisał|escribio|napisal|<)")
_INTRO_WORDS = frozenset("on le am el il op w no em".split())
_GREETED = re.compile(r"(?:[ \t]*[\w'’-]+\.?){1,7}(?=[ \t]*[,:!]|[ \t]*$)")
_SIGNED = re.compile(rf"{_CAP}\.?(?:[ \t]+{_CAP}\.?){{0,2}}$")
_BEFORE = re.compile(r"[\w€$°º.]+")
_LAST_WORDS = 48


def word_slot(word: str) -> int:
    return xxhash.xxh64_intdigest(word.lower()) >> (64 - BITS)


def name_places(text: str) -> list[tuple[int, int]]:
    """Spans in which a name must stand: header fields, introductions, greetings, the line under a closing formula."""
    out = []
    at, closed = 0, False
    for line in text.split("\n"):
        start = at
        at += len(line) + 1
        s = line.lstrip("> \t")
        start += len(line) - len(s)
        s = s.rstrip()
        if s.endswith("_x000D_"):
            s = s[:-7].rstrip()
        if not s:
            continue
        if closed:
            closed = False
            if len(s) < 50 and _SIGNED.match(s):
                out.append((start, start + len(s)))
                continue
        word = s.split(None, 1)[0].strip(",.!:;").lower()
        if word in GREETINGS or word in TITLES:
            if m := _GREETED.match(s):
                out.append((start, start + m.end()))
        elif word in _HEADER_WORDS and ":" in s[:16] and (m := _HEADER_NAME.match(s)):
            out.append((start + m.start(1), start + m.end(1)))
        elif word in _INTRO_WORDS and (m := _INTRO_NAME.match(s)):
            out.append((start + m.start(1), start + m.end(1)))
        elif s in ("--", "—") or closes(s, word):
            closed = True
    return out


def _name_words(text: str) -> list[str]:
    return [w for w in _CAP_WORD.findall(text) if _may_name(w.lower())]


def _may_name(w: str) -> bool:
    return len(w) > 1 and w not in GREETINGS and w not in TITLES and w not in ORGANISATION and w not in NOBODY and w not in COMMON_WORDS


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per word slot: times at a name's place, times capitalised."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    known: dict[str, int] = {}
    for pdf in batches:
        for column in pdf.columns:
            for text in pdf[column]:
                if not text:
                    continue
                if len(known) > 300_000:
                    known.clear()
                for k, words in ((1, _CAP_WORD.findall(text)), (0, [w for a, b in name_places(text) for w in _name_words(text[a:b])])):
                    for w in words:
                        if (s := known.get(w)) is None:
                            s = known[w] = word_slot(w)
                        counts[k, s] += 1
    at = np.flatnonzero(counts[1] | counts[0])
    yield pd.DataFrame({"slot": at, "named": counts[0, at], "capital": counts[1, at]})


@dataclass
class Lexicon:
    """Share of a word's capitalised occurrences that stand at a name's place."""

    named: np.ndarray
    capital: np.ndarray
    known: dict[str, int] = field(default_factory=dict)
    counts: dict[str, float] = field(default_factory=dict)

    def slot(self, word: str) -> int:
        """The word's slot, remembered for a bounded number of words."""
        if (s := self.known.get(word)) is None:
            if len(self.known) > 300_000:
                self.known.clear()
            s = self.known[word] = word_slot(word)
        return s

    @classmethod
    def of(cls, rows: DataFrame, columns: list[str]) -> Lexicon:
        """Counted over all rows; at most 2 ** BITS rows reach the driver."""
        counted = rows.select(*columns).mapInPandas(_count, "slot long, named long, capital long")
        got = counted.groupBy("slot").agg(F.sum("named").alias("named"), F.sum("capital").alias("capital")).where("named > 0").toPandas()
        named, capital = np.zeros(1 << BITS, np.float32), np.ones(1 << BITS, np.float32)
        named[got.slot.to_numpy(np.int64)] = got.named.to_numpy(np.float32)
        capital[got.slot.to_numpy(np.int64)] = np.maximum(got.capital, got.named).to_numpy(np.float32)
        return cls(named, capital)

    def count(self, word: str) -> float:
        """Times the word stands at a name's place."""
        if (n := self.counts.get(word)) is None:
            if len(self.counts) > 300_000:
                self.counts.clear()
            n = self.counts[word] = float(self.named[self.slot(word)])
        return n

    def share(self, word: str, own: int) -> float:
        """The share without `own` occurrences at the candidate's place."""
        s = self.slot(word)
        n, c = self.named[s] - own, self.capital[s] - own
        return float(n / (c + 1)) if n > 0 else 0.0


@dataclass
class Candidate:
    start: int
    end: int
    kind: str
    features: list[float]
    label: int  # 1, 0, or -1 where nothing tells


def _number_features(text: str, a: int, b: int) -> tuple[list[float], int, int]:
    """Features of a number-like span, and its labels as a phone and as a personal number (-1: unknown)."""
    s = text[a:b]
    groups = [len(g) for g in _GROUP.findall(s)]
    line_start = text.rfind("\n", 0, a) + 1
    line_end = text.find("\n", b)
    line_end = len(text) if line_end < 0 else line_end
    before = _BEFORE.findall(text[max(0, a - _LAST_WORDS) : a].lower())[-4:]
    before = [w.strip(".") for w in before]
    near = before[-1:] or [""]
    phone = float(any(w in PHONE_WORDS for w in before)) + float(near[0] in PHONE_WORDS) + float("☎" in text[max(0, a - 4) : a])
    ident = float(any(w in ID_WORDS for w in before)) + float(near[0] in ID_WORDS)
    other = float(any(w in OTHER_WORDS for w in before)) + 2 * float(near[0] in OTHER_WORDS or "/" in text[max(0, a - 4) : a])
    if near[0] in DATE_WORDS and not phone and s[0] != "+":
        other += 2
    left, right = text[line_start:a].strip(" \t>"), text[b:line_end].replace("_x000D_", "").strip()
    alone = float(not right and len(left) <= 12)
    year = float(groups[-1:] == [4] and s[-4:-2] in ("19", "20"))
    shape = [
        sum(groups), len(groups), groups[0] if groups else 0, groups[1] if len(groups) > 1 else 0, groups[-1] if groups else 0, max(groups, default=0), min(groups, default=0),
        float("+" in s), float("(" in s), s.count(" "), s.count("-"), s.count("."), s.count("/"), float(s[:1] == "0" or s[:2] == "(0"), float(s[:2] == "00"), float(s[-1:].isalpha()), float(s[:1].isalpha()), year,
    ]
    context = [phone, ident, other, alone, float(text[b : b + 2] in (" E", " €", " %", ",0", " M")), float("," in text[b : b + 1])]
    if other >= 2 or other and not phone and not ident:
        return shape + context, 0, 0
    is_phone = 1 if phone and not ident else 0 if ident else -1
    is_id = 1 if ident and not phone else 0 if phone else -1
    return shape + context, is_phone, is_id


_CONTEXT_NUMBER = 6
_CONTEXT_NAME = 7


def _name_features(text: str, a: int, b: int, words: list[str], places: list[tuple[int, int]], locals_: set[str], lexicon: Lexicon, prev: str) -> tuple[list[float], int]:
    inside = any(p <= a and b <= q + 1 for p, q in places)
    shares = [lexicon.share(w, int(inside)) for w in words]
    low = [w.lower() for w in words]
    before = text[max(0, a - 30) : a]
    line_start = before.rfind("\n")
    lead = before[line_start + 1 :].strip(" \t>\"'(")
    after = text[b : b + 24]
    organisation = float(any(w in ORGANISATION for w in low) or after[:1] == " " and after[1:].split(" ")[0].lower().strip(".,;:") in ORGANISATION)
    mail = float(bool(locals_) and any(len(w) > 2 and any(w in x for x in locals_) for w in low))
    sentence_start = float(not lead or lead[-1:] in ".?!:")
    shape = [max(shares), min(shares), sum(shares) / len(shares), len(words), len(text[a:b]), organisation, float(all(w.isupper() for w in words)), float(any(w.isupper() for w in words)), float(any(len(w) < 3 for w in words)), float(any(c.isdigit() for c in text[a:b])), float(text[b : b + 1] in "-_./@0123456789" and b < len(text))]
    context = [float(inside), mail, sentence_start, float(prev in GREETINGS or prev in TITLES), float(not after.strip(" \t\r_x0D,:").split("\n")[0][:1].strip()), float(prev in ("by", "to", "from", "add", "with", "par", "von", "por", "da", "door", "przez")), float(bool(re.match(r"\s*[<\[]", after)))]
    label = 1 if inside and not organisation else 0 if organisation or max(shares) < 0.01 else -1
    return shape + context, label


_Run = list[tuple[int, int, str]]


def _trimmed(run: _Run, count) -> tuple[str, _Run]:
    """The word before and the run without the words at its edges that are no part of a name ("Yesterday Luca", "Dear Ms Bob")."""
    prev = ""
    while run and not _may_name(v := run[0][2].lower()) and v not in ORGANISATION and len(v) > 1:
        prev, run = v, run[1:]
    while len(run) > 1 and not _may_name(v := run[-1][2].lower()) and v not in ORGANISATION:
        run = run[:-1]
    while len(run) > 1 and count(run[0][2]) == 0 and (v := run[0][2].lower()) not in ORGANISATION and len(v) > 1:
        prev, run = v, run[1:]
    return prev, run


def _windows(run: _Run, text: str, known) -> list[_Run]:
    """A run of four words at most as it is. A longer one is cut at commas, and where that leaves more than four words into the
    stretches of known words, of four words at most each; no known word is left out."""
    if len(run) <= 4:
        return [run]
    pieces = [run[:1]]
    for before, word in zip(run, run[1:]):
        if "," in text[before[1] : word[0]]:
            pieces.append([])
        pieces[-1].append(word)
    out = []
    for piece in pieces:
        if len(piece) <= 4:
            out.append(piece)
            continue
        for is_known, stretch in groupby(piece, lambda w: known(w[2])):
            words = list(stretch)
            out += [words[i : i + 4] for i in range(0, len(words), 4)] if is_known else []
    return out


def candidates(text: str, lexicon: Lexicon) -> list[Candidate]:
    """All spans that the generators propose; a number run is proposed as a phone and as a personal number."""
    out = []
    mails = emails(text)
    for a, b in mails:
        out.append(Candidate(a, b, "email", [1.0], 1))
    for a, b in numbers(text):
        f, phone, ident = _number_features(text, a, b)
        out.append(Candidate(a, b, "phone", f, phone))
        out.append(Candidate(a, b, "id_number", f, ident))
    low = text.lower()
    done = 0
    for end, size in _street_pieces().iter(low if len(low) == len(text) else text):
        # the pattern itself runs only around a street word that has a number near
        if end - size < done:
            continue
        p, q = max(done, end - size - 60), end + 70
        if not _GROUP.search(text, p, q):
            continue
        for m in _STREETS.finditer(text, p, min(len(text), q)):
            m = _STREETS.match(text, m.start()) or m  # what the window cut off
            f = _address_features(text, m)
            out.append(Candidate(m.start(), m.end(), "address", f, address_label(f)))
            done = m.end()
    count = lexicon.count
    runs: list[list[tuple[int, int, str]]] = []
    hits: list[bool] = []
    end = -9
    for m in _CAP_WORD.finditer(text):
        a, b = m.span()
        if a and (text[a - 1].isalnum() or text[a - 1] in "@.#/&_\\"):
            end = -9
            continue
        gap = text[end:a] if 0 <= a - end <= 3 else None
        if gap in (" ", ", ", "  ", "\t", ". ") and (gap != ". " or end - runs[-1][-1][0] == 1):
            runs[-1].append((a, b, w := m[0]))
            hits[-1] = hits[-1] or count(w) > 0
        else:
            runs.append([(a, b, w := m[0])])
            hits.append(count(w) > 0)
        end = b
    places = locals_ = None
    known = lambda w: len(w) == 1 or count(w) > 0
    windows = []
    for run, hit in zip(runs, hits):
        if hit:
            prev, run = _trimmed(run, count)
            windows += [(prev if w[:1] == run[:1] else "", w) for w in _windows(run, text, known)]
    for first, run in windows:
        prev, run = _trimmed(run, count)
        prev = prev or first
        if not run or all(len(w) == 1 or count(w) == 0 for _, _, w in run):
            continue
        words = [w for _, _, w in run]
        a, b = run[0][0], run[-1][1]
        if any(p < b and a < q for p, q in mails):
            continue
        if places is None:
            places = name_places(text)
            locals_ = {text[p:q].lower() for p, q in mails}
        if not prev:
            w = _BEFORE.findall(text[max(0, a - 16) : a].lower())
            prev = w[-1] if w else ""
        f, label = _name_features(text, a, b, words, places, locals_, lexicon, prev)
        out.append(Candidate(a, b, "name", f, label))
    return out


# Pieces of which every street the pattern knows holds one.
_STREET_PIECES = (
    "street|road|lane|avenue|square|drive|close|court|terrace|crescent|gardens|row|st.|rd.|ave.|rue |boulevard|bd |place |chemin|allée|impasse|quai |route |cours |calle |c/ |avenida|av.|avda|plaza |paseo|camino|"
    "carretera|via |viale|piazza|corso |vicolo|largo |rua |praça|travessa|estrada|ul.|ulica|al. |aleja|pl. |plac |os. |weg |platz|gasse|allee|straße|strasse|str.|ring |damm|ufer|laan|plein|straat|kade|gracht|singel|dreef"
).split("|")


@lru_cache(maxsize=1)
def _street_pieces() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for piece in _STREET_PIECES:
        automaton.add_word(piece, len(piece))
    automaton.make_automaton()
    return automaton


_SMALL = r"(?:de|des|du|la|le|les|l|d|del|dei|della|delle|degli|di|do|da|dos|das|van|den|der|het|of|the|en|y|e|los|las|el)\b['’]?"
_STREETS = re.compile(
    rf"(?P<before>(?:(?:Unit|Flat|Apt\.?|Suite)[ \t]+\d{{1,4}}[a-z]?,\s+)?(?<![\w/.,-]){_NUMBER},?\s+(?:(?P<w1>(?:[\w'’]+\.?\s+){{0,3}}?)(?P<s1>(?i:{STREET}))(?![\w])(?P<rest>\s+(?:{_SMALL}\s*)+{_CAP}(?:[ ]{_CAP})*|(?=\b))))"
    rf"|(?P<after>(?<!\w)(?P<s2>(?i:{STREET}))\s+(?P<w2>(?:[\w'’-]+\s+){{0,4}}?[\w'’-]+),?\s+{_NUMBER}(?![\w./-]))"
    rf"|(?P<joined>(?:\b[A-ZÀ-Þ][\w-]*(?:{STREET_END})|\b{_CAP}[ ]+(?i:{STREET_END}))\s+{_NUMBER}(?![\w./-]))"
    rf"|(?P<unit>\b(?:Unit|Flat|Apt\.?|Suite)[ \t]+\d{{1,4}}[a-z]?,\s+(?P<w3>(?:{_CAP}\s+){{1,3}}?)(?P<s3>(?i:{STREET}))(?![\w]))"
)


def _address_features(text: str, m: re.Match) -> list[float]:
    s = m[0]
    named = m["w1"] or m["w2"] or m["w3"] or ""
    tail = s if m["joined"] else named
    words = [w for w in re.findall(r"[\w'’]+", tail) if not w.isdigit()]
    small = frozenset("de des du la le les d l del della delle dei degli da do das dos van den der het of the en y e st bis ter".split())
    content = [w for w in words if w.lower() not in small]
    caps = sum(w[0].isupper() for w in content)
    after = text[m.end() : m.end() + 30]
    rest_words = [w for w in re.findall(r"[\w'’]+", m["rest"] or "") if w.lower() not in small]
    number = re.search(r"\d+", s)
    return [
        float(bool(m["before"] or m["unit"])), float(bool(m["after"])), float(bool(m["joined"])), len(content), caps / len(content) if content else -1.0, len(words) - len(content),
        float((m["s1"] or m["s2"] or m["s3"] or "x")[:1].isupper()), float("\n" in s), sum(w[0].isupper() for w in rest_words), len(rest_words),
        float(bool(re.match(r"[,\s]*(?:(?:à|in|te|w|en|em|a|B-|D-)\s*)?(?:\d{4,5}|[A-ZÀ-Þ])", after))), float(len(number[0])) if number else 0.0, float(any(w.lower() in ORGANISATION for w in re.findall(r"\w+", after[:20])[:1])),
    ]


def address_label(f: list[float]) -> int:
    """Weak labels of a street span: a street name whose words are capitalised, or a place after it, tells; small words only deny."""
    before, after, joined, n, caps, _, upper, _, rest_caps, rest, place, digits, organisation = f
    if organisation or digits > 4:
        return 0
    if joined:
        return 1
    if before and n and caps == 1 and upper or before and not n and rest_caps and rest_caps == rest:
        return 1
    if after and n and caps == 1 and (place or n <= 3):
        return 1
    return 0 if (n and caps == 0) or (not n and not rest_caps) else -1


class Detector:
    """A boosted model per type, fitted on weakly labelled candidates."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.models: dict[str, Boosted] = {}

    def fit(self, texts: list[str], seed: int = 5) -> Detector:
        rng = np.random.default_rng(seed)
        found: dict[str, list[tuple[list[float], int, bool]]] = {t: [] for t in TYPES}
        for k, t in enumerate(texts):
            for c in candidates(t, self.lexicon):
                if c.label >= 0:
                    found[c.kind].append((c.features, c.label, k % 5 == 0))
        for kind, rows in found.items():
            y = np.array([b for _, b, _ in rows], int)
            if kind == "email" or not len(y) or y.min() == y.max():
                continue  # one class only: the generator decides
            if kind == "address" and np.bincount(y, minlength=2).min() < MIN_ADDRESSES:
                continue  # too few that a label denies to learn from: the generator decides, but for those
            x = np.array([a for a, _, _ in rows], float)
            held = np.array([h for _, _, h in rows], bool)  # every fifth text with all its candidates
            cut = {"phone": _CONTEXT_NUMBER, "id_number": _CONTEXT_NUMBER, "name": _CONTEXT_NAME}.get(kind, 0)
            if cut:  # half of the examples lose what labelled them
                lost = x.copy()
                lost[:, -cut:] = 0
                drop = rng.random(len(x)) < 0.5
                x, y, held = np.concatenate([x, lost[drop]]), np.concatenate([y, y[drop]]), np.concatenate([held, held[drop]])
            self.models[kind] = Boosted().fit(x, y, held)
        return self

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        """(start, end, type, score) of each text's redactions, in order, without overlaps."""
        all_of = [candidates(t, self.lexicon) if t else [] for t in texts]
        flat: dict[str, list[tuple[int, Candidate]]] = {t: [] for t in TYPES}
        for i, cs in enumerate(all_of):
            for c in cs:
                flat[c.kind].append((i, c))
        out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
        for kind, rows in flat.items():
            if not rows:
                continue
            model = self.models.get(kind)
            if model is None:
                # nothing in the sample denies a candidate of this type: what the generator proposes counts unless its own label denies it
                p = np.array([float(kind == "email" or c.label == 1 or kind == "address" and c.label < 0) for _, c in rows])
                limit = 0.5
            else:
                p, limit = model.predict(np.array([c.features for _, c in rows], float)), model.threshold
            for (i, c), q in zip(rows, p):
                if q >= limit:
                    out[i].append((c.start, c.end, kind, float(q)))
        return [_without_overlaps(s) for s in out]


def _without_overlaps(spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    kept: list[tuple[int, int, str, float]] = []
    rank = {"email": 3, "address": 2, "id_number": 1, "phone": 1, "name": 0}
    for s in sorted(spans, key=lambda s: (-rank[s[2]], -s[3], s[0] - s[1], s[0])):
        if all(s[1] <= a or b <= s[0] for a, b, _, _ in kept):
            kept.append(s)
    return sorted(kept)


def fit(rows: DataFrame, id_col: str, columns: list[str], sample: int = SAMPLE) -> Detector:
    """The lexicon of all rows and models of the `sample` texts of least hash, each of `MAX_CHARS` at most."""
    lexicon = Lexicon.of(rows, columns)
    texts = None
    for c in columns:
        part = rows.select(F.col(c).alias("t")).where(F.length("t").between(1, MAX_CHARS))
        texts = part if texts is None else texts.unionByName(part)
    got = least_hashed(texts, F.col("t"), sample).toPandas().sort_values("h")
    return Detector(lexicon).fit(list(got.t))


def find_pii(rows: DataFrame, detector: Detector, id_col: str, columns: list[str]) -> DataFrame:
    """(id, field_name, pii_type): the types that each field of each id holds."""
    shared = rows.sparkSession.sparkContext.broadcast(detector)  # of fixed size
    kind = rows.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for c in columns:
                texts = [t or "" for t in pdf[c]]
                unique = list(dict.fromkeys(texts))
                types = dict(zip(unique, ({s[2] for s in found} for found in shared.value.spans(unique))))
                out += [(i, c, t) for i, text in zip(pdf[id_col], texts) for t in types[text]]
            yield pd.DataFrame(out, columns=[id_col, "field_name", "pii_type"])

    return rows.select(id_col, *columns).mapInPandas(scan, f"{id_col} {kind}, field_name string, pii_type string").distinct()


def redact(rows: DataFrame, detector: Detector, columns: list[str]) -> DataFrame:
    """`rows` with typed placeholders in the columns, such as [EMAIL]; everything else stays as it is."""
    shared = rows.sparkSession.sparkContext.broadcast(detector)

    def replaced(texts: pd.Series) -> pd.Series:
        clean = [t or "" for t in texts]
        out = []
        for t, spans in zip(clean, shared.value.spans(clean)):
            parts, at = [], 0
            for a, b, kind, _ in spans:
                parts += [t[at:a], f"[{kind.upper()}]"]
                at = b
            out.append("".join([*parts, t[at:]]))
        return pd.Series([o if t is not None else None for o, t in zip(out, texts)], dtype=object)

    change = F.pandas_udf(replaced, StringType())
    return rows.withColumns({c: change(F.col(c)) for c in columns})
