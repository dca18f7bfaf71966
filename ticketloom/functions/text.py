"""Text rules as Column expressions. Every pattern is valid in Java; those used by SQL checks are valid in RE2 too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and line ends as Python's str methods know them.
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LB = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
# The patterns and phrases of mail and summary cleaning.
HEADER = rf"^{WS}*\*?{WS}*(?:From|Sent|To|Subject|Importance|CC){WS}*:"
TABLE = rf"^{WS}*\|"
ABBREVIATIONS = ["Mr", "Ms", "Mrs", "Dr", "etc", "i.e", "e.g", "com", "eu", "org", "gov", "edu"]
SIGN_OFFS = ["kind regards", "best regards", "best wishes", "sincerely", "thank you in advance", "regards", "yours sincerely", "thanks and regards"]
PRIVACY = [
    "this e-mail and any attachments",
    "this email and any attachments",
    "this message and any attachments",
    "this communication is confidential",
    "this email is confidential",
    "confidentiality notice",
    "privacy notice",
    "privileged/confidential information",
    "if you are not the intended recipient",
    "if you have received this email in error",
    "this email transmission is intended only",
    "disclaimer:",
    "legal disclaimer:",
    "confidentiality disclaimer",
]
COLOR = r"(?i)\{color(?::[^}]+)?\}"
ARTEFACTS = ["_x000D_", "-----Original Message-----"]
PREFIX = rf"(?i)(?:subject|fwd|fw|re):{WS}*"
UNWANTED = (
    rf"(?i)(?:^hd{WS}*cannot{WS}*answer$|hd[0-9]*{WS}*cannot{WS}*(?:help|answer)|not{WS}+related{WS}+to{WS}+op|more{WS}+info(?:rmation)?{WS}+(?:needed|required)|"
    rf"not{WS}+enough{WS}+info(?:rmation)?{WS}+for{WS}+hd[0-9]*|insufficient{WS}+info(?:rmation)?{WS}+(?:provided|given|available)|"
    rf"cannot{WS}+(?:be{WS}+)?(?:resolved|answered){WS}+(?:by|with){WS}+(?:the{WS}+)?hd[0-9]*)"
)


def _escaped(word: str) -> str:
    return word.replace(".", r"\.")


# Every pattern starts with a character that few positions hold; W(?<!WW) is the first of a run of white space.
_IN_LINE = WS.replace(r"[\s", r"[ \t")
_RUN = rf"{_IN_LINE}(?<!{_IN_LINE}{_IN_LINE}){_IN_LINE}*+"
_SENTENCE = rf"\.(?<!{'|'.join(_escaped(a) + '[.]' for a in ABBREVIATIONS)}) +{_IN_LINE}*+"


def _any_of(phrases: list[str]) -> str:
    """A pattern of the phrases, by first letter; one that holds another is left out."""
    least = [p for p in phrases if not any(q != p and q in p for q in phrases)]
    return "|".join(rf"{a}(?:{'|'.join(rf'\Q{p[1:]}\E' for p in least if p[0] == a)})" for a in sorted({p[0] for p in least}))


# The characters of WS, for trimming.
_SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space at both ends, as str.strip takes it."""
    return F.btrim(c, F.lit(_SPACES))


def filter_email_content(c: Column) -> Column:
    """The text of a mail up to its sign-off or privacy notice, without header and table lines; null stays null.

    Each kept line comes as its sentences, joined by ". " and ended by a full stop; lines are joined by a space. Every rule is
    one pass of a pattern over the whole text, so no line is an object of its own. A sign-off or privacy phrase anywhere in a
    line ends the mail before that line; case is that of ASCII letters, which is all the phrases have."""
    header = HEADER.removeprefix("^").replace(WS, _IN_LINE)
    t = F.regexp_replace(c, LB, "\n")
    t = F.regexp_replace(t, rf"(?md)^(?:(?iu:{header})|{_IN_LINE}*+\|)[^\n]*", "")
    t = F.regexp_replace(t, rf"(?md)^(?i:[^\n]*?(?:{_any_of(SIGN_OFFS + PRIVACY)}))(?s:.*)", "")
    t = F.regexp_replace(t, rf"(?md)^(?:{_IN_LINE}*+{_SENTENCE})++", "")
    t = F.regexp_replace(t, rf"{_SENTENCE}(?:{_SENTENCE})*+", ". ")
    t = F.regexp_replace(t, rf"{_RUN}(?=\. )", "")
    t = F.regexp_replace(t, r"\. (?=\n|\z)", "")
    # blank ends of lines and empty lines, then the full stops
    t = strip(F.regexp_replace(t, rf"(?:{_RUN})?\n{WS}*+", "\n"))
    return F.regexp_replace(F.regexp_replace(t, r"(?<=[^.\n])(?=\n|\z)", "."), "\n", " ")


def clean_description(c: Column) -> Column:
    """Colour tags, mail parts and export artefacts removed, white space single."""
    text = filter_email_content(F.regexp_replace(c, COLOR, ""))
    for a in ARTEFACTS:
        text = F.replace(text, F.lit(a), F.lit(""))
    return strip(F.regexp_replace(text, rf"(?:  |(?! ){WS}){WS}*+", " "))


def clean_summary(c: Column) -> Column:
    """Reply and subject prefixes removed wherever they stand, trimmed, lower case; null becomes ''."""
    return F.lower(strip(F.regexp_replace(F.coalesce(c, F.lit("")), PREFIX, "")))


def is_unwanted_summary(c: Column) -> Column:
    """Whether a cleaned summary says that there is no answer; null does not."""
    return F.coalesce(c.rlike(UNWANTED), F.lit(False))


def cut_always(c: Column, n: int = 100) -> Column:
    return F.concat(F.left(c, F.lit(n)), F.lit("..."))


def cut_long(c: Column, n: int = 100) -> Column:
    """Texts of more than `n` characters cut to `n` with the dots counted in."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 3)), F.lit("..."))).otherwise(c)


def label_text(c: Column) -> Column:
    """A cluster label as text; null and -1 are noise."""
    return F.when(F.coalesce(c, F.lit(-1)) == -1, F.lit("Noise")).otherwise(c.cast("string"))


def label_text_or_unknown(c: Column) -> Column:
    """A cluster label as text where a missing label is no noise: null is Unknown, -1 is Noise."""
    return F.when(c.isNull(), F.lit("Unknown")).when(c == -1, F.lit("Noise")).otherwise(c.cast("string"))


def between(c: Column, start: str, end: str) -> Column:
    """The trimmed text between the first `start` and the next `end`, or null where either is missing."""
    a = F.locate(start, c)
    rest = F.substr(c, a + F.lit(len(start)))
    b = F.locate(end, rest)
    return F.when((a > 0) & (b > 0), strip(F.left(rest, b - 1)))


def file_name(url: Column, extension: str = "md") -> Column:
    """A file name from a URL's path: parts joined by _, the last one's extension dropped, at most 100 characters before the new one."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/", -1), lambda s: s != "")
    n = F.size(parts)
    last = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    joined = F.when(n == 0, F.lit("index")).otherwise(F.array_join(F.concat(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(last)), "_"))
    safe = F.regexp_replace(joined, r"(?U)[^\w\-]+", "_")
    safe = F.regexp_replace(F.regexp_replace(safe, "^_+|_+$", ""), "^-+|-+$", "")
    return F.concat(F.left(F.when(safe == "", F.lit("page")).otherwise(safe), F.lit(100)), F.lit(f".{extension}"))


def entities_decoded(c: Column) -> Column:
    """The five named entities of XML and the non-breaking space; &amp; comes last, so nothing is decoded twice."""
    # Entity names.
    for name, value in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]:
        c = F.replace(c, F.lit(name), F.lit(value))
    return c


def page_title(html: Column) -> Column:
    """The title element's text, else the first h1's, else Untitled."""

    def of(tag: str) -> Column:
        text = strip(entities_decoded(F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>([^<]*)</{tag}\s*>", 1)))
        return F.nullif(text, F.lit(""))

    return F.coalesce(of("title"), of("h1"), F.lit("Untitled"))


def first_article(html: Column) -> Column:
    """The first article element, else the main element, else null."""
    parts = [F.nullif(F.regexp_extract(html, rf"(?is)(<{t}(?:\s[^>]*)?>.*?</{t}\s*>)", 1), F.lit("")) for t in ("article", "main")]
    return F.coalesce(*parts)


def markdown_page(title: Column, url: Column, body: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n\n**Source:** <"), url, F.lit(">\n\n---\n\n"), body)


def text_page(title: Column, url: Column, body: Column) -> Column:
    return F.concat(F.lit("Title: "), title, F.lit("\nSource: "), url, F.lit("\n\n---\n\n"), body)


def word_count(c: Column) -> Column:
    """Words between white space, a native stand-in for a tokenizer under a name of its own."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), f"{WS}+", -1), lambda w: w != ""))
