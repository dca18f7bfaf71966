"""Markup residue: which notations a text holds, and the text without them.

Method: union-free regular-expression inference. A lexer turns each text into a stream of markup tokens and text slots;
repeats in a stream are folded into groups (...)+. The streams of one host (who sent the text, or the site of a page) are
aligned one after the other: where two streams differ, the missing part becomes optional, and texts become a slot. The
expressions so made are the host's wrappers. A wrapper decides tokens that are ambiguous alone, such as a line
starting with one `#`, by the unambiguous tokens it stands with. Distinct streams are counted before they meet in a
task, and a host's streams are merged in parts, so a host with a third of all rows does not fill one task.

Text in a code block of one notation is no evidence of another. Null, empty and plain texts have no notation and come
out unchanged (null stays null). Texts of any length are read whole; a text's stream is folded, so its length is that of
its structure. Repeated rows and ties give one result an id. Empty tables give empty results. Only the named columns are
read, so clashing names do no harm.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ticketloom.functions.html import to_markdown
from ticketloom.session import written

KINDS = ("html", "markdown", "wiki", "latex")
SALTS = 16
#: Streams or wrappers of one host that are aligned in one task.
PART_STREAMS = 400
#: Two streams share a wrapper when so much of the longer one aligns.
ALIKE = 0.6

# The HTML elements that count as markup.
ELEMENTS = "a abbr address area article aside b base big blockquote body br button caption center cite code col colgroup dd del details div dl dt em fieldset figcaption figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark meta nav noscript o:p object ol optgroup option p param pre q s samp script section select small source span strike strong style sub summary sup table tbody td textarea tfoot th thead title tr tt u ul var wbr"
# Wiki macros, of which some take parameters.
MACROS = "code noformat panel color quote tip info warning note toc anchor expand section column status jira details"
# LaTeX commands that need no argument.
SIGNS = "times cdot leq geq neq approx alpha beta gamma delta lambda sigma omega pi mu sum prod int infty pm ldots dots rightarrow leftarrow forall exists partial nabla hline noindent newline newpage maketitle tableofcontents"

_NAMES = "|".join(sorted(map(re.escape, ELEMENTS.split()), key=len, reverse=True))
_ENTITY = "|".join(sorted(name2codepoint, key=len, reverse=True))
_MACRO = "|".join(MACROS.split())

# Characters at which a token may start, and the pattern of each; all other text is skipped in one scan.
_START = re.compile(r"\n(?=[ \t>]*[`~#|\-:\\]|h[1-6]\.|=|bq\.|\{\||[ \t]*[*+]+[ \t])|<(?=[/!a-zA-Z])|&(?=[#a-zA-Z])|`|\{|!(?=[^\s!])|\[|\*\*|__|~~|''|\\|\$")
_EOL = r"(?=[ \t]*(?:\r|\n|_x000D_|\Z))"
_PATTERNS = {
    "\n": [
        ("markdown_fence", r"\n[ \t>]*(```+|~~~+)[^\n`]*\n(?:.*?\n)?[ \t>]*\1" + _EOL),
        ("markdown_open", r"\n[ \t>]*```+[^\n`]*(?=\n|\Z)"),
        ("markdown_heading", r"\n#{2,6}[ \t]+[^\n#][^\n]*"),
        ("any_hash", r"\n#[ \t]+[^\n]+"),
        ("markdown_rule", r"\n[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?" + _EOL),
        ("markdown_under", r"\n(?:={3,}|-{3,})" + _EOL),
        ("markdown_task", r"\n[ \t]*[-*+][ \t]\[[ xX]\][ \t]"),
        ("wiki_heading", r"\nh[1-6]\.[ \t]+[^\n]+"),
        ("wiki_title", r"\n(={2,6})[ \t]*[^=\n][^\n]*?\1" + _EOL),
        ("wiki_head", r"\n[ \t]*\|\|[^\n]*\|\|"),
        ("any_row", r"\n[ \t]*\|[^\n|]*\|[^\n]*"),
        ("wiki_quote", r"\nbq\.[ \t]"),
        ("wiki_table", r"\n\{\|[^\n]*"),
        ("latex_item", r"\n[ \t]*\\item\b"),
    ],
    "<": [
        ("html_block", r"<(pre|code|script|style)\b[^<>]*>.*?</\1\s*>"),
        ("html_comment", r"<!--.*?-->|<!DOCTYPE\b[^<>]*>"),
        ("html_tag", rf"</?(?:{_NAMES})(?:\s[^<>]*)?/?>"),
    ],
    "&": [("html_entity", rf"&(?:#\d{{2,6}}|#[xX][0-9a-fA-F]{{2,5}}|{_ENTITY});")],
    "`": [("markdown_code", r"`{1,2}(?!`)[^`\n]+`{1,2}")],
    "{": [
        ("wiki_block", r"\{(code|noformat)(?::[^{}\n]*)?\}.*?\{\1\}"),
        ("wiki_mono", r"\{\{(?!\{)[^{}\n]+\}\}"),
        ("wiki_macro", rf"\{{(?:{_MACRO}):[^{{}}\n]+\}}|\{{[*_+?^~-]\}}"),
        ("any_macro", rf"\{{(?:{_MACRO})\}}"),
    ],
    "!": [
        ("markdown_image", r"!\[[^\[\]\n]*\]\([^()\s]+(?:[ \t]\"[^\"\n]*\")?\)"),
        ("wiki_image", r"![^\s!|\n][^!|\n]*(?:\.(?:png|jpe?g|gif|bmp|svg|webp)(?:\|[^!\n]*)?|\|thumbnail)!"),
    ],
    "[": [
        ("markdown_link", r"\[[^\[\]\n]+\]\((?:https?:|ftp:|mailto:|www\.|/|\.|#|[\w%-]+(?:[./#][\w%./#-]*)?)[^()\s]*(?:[ \t]\"[^\"\n]*\")?\)"),
        ("wiki_link", r"\[\[[^\[\]\n]+\]\]|\[(?!\[)[^\[\]|\n]+\|(?:https?://|mailto:|ftp://|#|\^|/)[^\[\]\n]*\]|\[[\^~][\w.@-]+\]"),
    ],
    "*": [("markdown_bold", r"\*\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*\*")],
    "_": [("markdown_bold", r"(?<!\w)__(?=[^\W_])[^_\n]+(?<=[^\W_])__(?!\w)")],
    "~": [("markdown_strike", r"~~(?=[^\s~])[^~\n]+(?<=\S)~~")],
    "'": [("wiki_bold", r"'''(?=[^\s'])[^\n]+?(?<=[^\s])'''|''(?=[^\s'])[^'\n]+(?<=[^\s'])''")],
    "$": [("latex_math", r"\$\$[^$]+\$\$|\$(?=[^\s$])(?=[^$\n]*(?:\\[a-zA-Z]+|[_^][{\w]))[^$\n]+\$(?!\d)")],
    "\\": [
        ("latex_block", r"\\begin\{(verbatim|lstlisting|minted)\}.*?\\end\{\1\}"),
        ("latex_math", r"\\\((?:(?!\\\()[^\n])+?\\\)|\\\[(?:(?!\\\[).)+?\\\]"),
        ("latex_env", r"\\(?:begin|end)\{[a-zA-Z]+\*?\}"),
        ("latex_command", r"\\[a-zA-Z]{2,}\*?(?:\[[^\[\]\n]*\])?\{"),
        ("latex_sign", rf"(?<![\w\\:])\\(?:{'|'.join(SIGNS.split())})\b(?![\\/])"),
    ],
}
_PATTERNS = {c: [(role, re.compile(p, re.S).match) for role, p in ps] for c, ps in _PATTERNS.items()}


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(role, from, to) of the markup in `text` with a line end put before it; roles are kind_part or any_part."""
    out = []
    body, at = "\n" + text, 0
    while start := _START.search(body, at):
        i = start.start()
        at = i + 1
        for role, match in _PATTERNS[body[i]]:
            if m := match(body, i):
                break
        else:
            continue
        if role == "markdown_under":
            before = body[:i].rsplit("\n", 1)[-1].replace("_x000D_", "").strip()
            if not before or abs(len(before) - len(m[0].strip())) > 1 or not any(c.isalpha() for c in before):
                continue
        elif role == "any_hash" and (len(m[0]) > 70 or m[0].rstrip().endswith((".", "?", "!", ":"))):
            role = "any_numbered"
        elif role == "any_row" and not m[0].rstrip().removesuffix("_x000D_").rstrip().endswith("|"):
            continue
        out.append((role, i, m.end()))
        # what a line holds after its mark is read on; blocks and inline pieces are done
        at = m.end() if body[i] != "\n" or role in ("markdown_fence", "markdown_rule", "markdown_under") else i + 1
    return out


def stream(text: str) -> list[str]:
    """The tokens' roles with # for the text between them, repeats folded."""
    out: list[str] = []
    at = 0
    body = "\n" + text
    for role, a, b in tokens(text):
        if a > at and body[at:a].strip() and out and out[-1] != "#":
            out.append("#")
        out.append(role)
        at = b
    return fold(out)


def fold(parts: list[str], widest: int = 6) -> list[str]:
    """Neighbouring repeats of up to `widest` parts become one group (...)+."""
    parts = list(parts)
    for width in range(1, widest + 1):
        out: list[str] = []
        i = 0
        while i < len(parts):
            unit = parts[i : i + width]
            n = 1
            while len(unit) == width and parts[i + n * width : i + (n + 1) * width] == unit:
                n += 1
            one = unit[0] if width == 1 else "(" + " ".join(unit) + ")"
            if n > 1:
                out.append(one if width == 1 and one.endswith("+") else one + "+")
                i += n * width
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def _base(part: str) -> str:
    return part.rstrip("+?")


def align(a: list[str], b: list[str]) -> list[str] | None:
    """The union-free expression of both streams, or None when too little of them agrees."""
    x, y = [_base(p) for p in a], [_base(p) for p in b]
    blocks = SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()
    if sum(m.size for m in blocks) < ALIKE * max(len(x), len(y)):
        return None
    out: list[str] = []
    i = j = 0
    for m in blocks:
        for p in a[i : m.a] + b[j : m.b]:  # what one stream lacks is optional
            out.append(p if p.endswith("?") else p + "?")
        for k in range(m.size):
            p, q = a[m.a + k], b[m.b + k]
            mark = ("+" if "+" in (p[-1], q[-1]) or p.endswith("+?") or q.endswith("+?") else "") + ("?" if "?" in (p[-1], q[-1]) else "")
            out.append(_base(p) + mark)
        i, j = m.a + m.size, m.b + m.size
    return fold(out)


def wrappers(streams: list[tuple[list[str], list[str], int]]) -> list[tuple[list[str], list[str], int]]:
    """Merges (expression, the streams it covers, rows) one after the other, most frequent first."""
    done: list[tuple[list[str], list[str], int]] = []
    for expr, covered, n in sorted(streams, key=lambda s: (-s[2], s[1])):
        for k, (other, seen, m) in enumerate(done):
            if (both := align(other, expr)) is not None:
                done[k] = (both, seen + covered, m + n)
                break
        else:
            done.append((expr, covered, n))
    return done


def _roles(expr: str) -> list[str]:
    return re.findall(r"[a-z]+_[a-z]+", expr)


def kinds_of(signature: str, context: str) -> list[str]:
    """The notations of a stream. Ambiguous tokens follow what is unambiguous in the stream, then in its wrapper.

    A short line after one # is a heading of Markdown unless the stream or wrapper speaks wiki only; numbered lines, bare macros and rows
    alone prove nothing."""
    roles = set(_roles(signature))
    sure = {r.split("_")[0] for r in roles if not r.startswith("any_")}
    around = {r.split("_")[0] for r in _roles(context) if not r.startswith("any_")} - {"html", "latex"}
    near = (sure & {"markdown", "wiki"}) or around
    if "any_macro" in roles and (near == {"wiki"} or re.search(r"any_macro(?:\+|.*any_macro)", signature)):
        sure.add("wiki")
    if "any_hash" in roles and near != {"wiki"}:
        sure.add("markdown")
    return sorted(sure)


def signatures(rows: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(id, host, signature) of the texts that hold any token."""
    kind = rows.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, h, " ".join(s)) for i, h, t in zip(pdf[id_col], pdf["_host"], pdf[text_col]) if t and (s := stream(t))]
            yield pd.DataFrame(out, columns=[id_col, "host", "signature"])

    host = F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("_host")
    # A text without any of these characters holds no token; the test runs before rows go to Python.
    may = F.col(text_col).rlike(r"[<&`{\[!*_~'\\$]|(?m)^(?:#|[ \t]*\||h[1-6]\.|bq\.|=|-{3})")
    return rows.where(may).select(id_col, host, text_col).mapInPandas(scan, f"{id_col} {kind}, host string, signature string")


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, expr, wrapper, n): each expression with the wrapper that covers it. Rows come sorted by (host, part), so the
    `PART_STREAMS` or so expressions of one part are held at a time."""
    columns = ["host", "expr", "wrapper", "n"]
    key, held = None, []

    def flush() -> list[tuple]:
        return [(key[0], e, " ".join(w), n) for w, covered, n in wrappers(held) for e in covered] if key is not None else []

    for pdf in batches:
        out = []
        for host, part, expr, n in zip(pdf["host"], pdf["part"], pdf["expr"], pdf["n"]):
            if (host, part) != key:
                out += flush()
                key, held = (host, part), []
            held.append((_parts(expr), [expr], int(n)))
        yield pd.DataFrame(out, columns=columns)
    yield pd.DataFrame(flush(), columns=columns)


def _merge_parts(expressions: DataFrame) -> DataFrame:
    """(host, expr, wrapper, n) of (host, expr, n). A host's expressions are merged in as many parts, by hash, as keep each at
    about `PART_STREAMS`; the number of tasks is fixed, since little data here is much work."""
    sizes = expressions.groupBy("host").agg(F.ceil(F.count("*") / PART_STREAMS).alias("parts"))
    parted = expressions.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("expr"), F.col("parts")))
    tasks = int(expressions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = parted.select("host", "part", "expr", "n").repartition(tasks, "host", "part").sortWithinPartitions("host", "part", "expr")
    return sorted_.mapInPandas(_merged, "host string, expr string, wrapper string, n long")


def _parts(expr: str) -> list[str]:
    """An expression's parts at its outermost level."""
    out, depth, part = [], 0, ""
    for c in expr:
        depth += (c == "(") - (c == ")")
        if c == " " and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [p for p in [*out, part] if p]


def infer_wrappers(signed: DataFrame) -> DataFrame:
    """(host, signature, wrapper, kinds): each distinct stream of a host with the wrapper that covers it.

    Streams are counted first; parts of a host's streams are merged, then the wrappers so made, which again meet in parts where
    a host has more than `PART_STREAMS`. Wrappers carry no list of their streams; those follow by a join."""
    counted = signed.groupBy("host", F.col("signature").alias("expr")).agg(F.count("*").alias("n"))
    first = written(_merge_parts(counted))
    again = _merge_parts(first.groupBy("host", F.col("wrapper").alias("expr")).agg(F.max("n").alias("n")))
    last = again.select("host", F.col("expr").alias("inner"), "wrapper")
    flat = first.select("host", F.col("expr").alias("signature"), F.col("wrapper").alias("inner")).join(last, ["host", "inner"]).drop("inner")

    @F.pandas_udf("array<string>")
    def kinds(signature: pd.Series, wrapper: pd.Series) -> pd.Series:
        return pd.Series([kinds_of(s, w) for s, w in zip(signature, wrapper)])

    return flat.withColumn("kinds", kinds("signature", "wrapper"))


def find_markup(rows: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(id, markup_kind): each notation a text holds, by the wrappers of its host."""
    signed = written(signatures(rows, id_col, text_col, host_col))
    table = infer_wrappers(signed).select("host", "signature", F.explode("kinds").alias("markup_kind"))
    # Salted: the rows of one host and stream may be a third of all.
    salt = F.pmod(F.xxhash64(id_col), F.lit(SALTS)).alias("salt")
    left = signed.select(id_col, "host", "signature", salt).distinct()
    right = table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return left.join(right, ["host", "signature", "salt"]).select(id_col, "markup_kind").distinct()


# --- Clean text ------------------------------------------------------------------------------------------------------


def _fence(code: str) -> str:
    return "\n```\n" + code.strip("\r\n") + "\n```\n"


def _command(text: str) -> str:
    """Unwraps LaTeX commands from the inside out; sections become headings, footnotes brackets."""
    heads = {"section": "## ", "subsection": "### ", "subsubsection": "#### ", "chapter": "# ", "title": "# "}

    def one(m: re.Match) -> str:
        name, inner = m[1], m[2]
        if name in heads:
            return f"\n{heads[name]}{inner}\n"
        if name == "footnote":
            return f" ({inner})"
        return "" if name in ("label", "cite", "ref", "usepackage", "documentclass", "vspace", "hspace") else inner

    while (new := re.sub(r"\\([a-zA-Z]{2,})\*?(?:\[[^\[\]\n]*\])?\{([^{}]*)\}", one, text)) != text:  # each pass takes commands away
        text = new
    return text


def clean(text: str | None, kinds: Iterable[str] | None = None) -> str | None:
    """`text` without markup of the given kinds, by default those of its own stream; headings come as # lines, lists as - lines, tables as | rows, code fenced, formulas as $."""
    if not text:
        return text
    kinds = set(kinds_of(" ".join(stream(text)), "") if kinds is None else kinds)
    if not kinds:
        return text
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\x00{len(kept) - 1}\x01"

    body = "\n" + text.replace("\r\n", "\n").replace("\x00", "").replace("\x01", "")
    if "html" in kinds and "&lt;" in body and re.search(rf"&lt;/?(?:{_NAMES})\b", body):
        body = re.sub(rf"&lt;(/?(?:{_NAMES})\b[^<>&]*?)&gt;", r"<\1>", body)
    # code and formulas first: they stay as they are
    body = re.sub(r"\n[ \t>]*(```+|~~~+)[^\n`]*\n(.*?)\n?[ \t>]*\1(?=[ \t\r]*(?:\n|_x000D_|\Z))", lambda m: keep(_fence(m[2])), body, flags=re.S)
    body = re.sub(r"\{(code|noformat)(?::[^{}\n]*)?\}(.*?)\{\1\}", lambda m: keep(_fence(m[2])), body, flags=re.S)
    body = re.sub(r"\\begin\{(verbatim|lstlisting|minted)\}(.*?)\\end\{\1\}", lambda m: keep(_fence(m[2])), body, flags=re.S)
    body = re.sub(r"<pre\b[^<>]*>(?:\s*<code\b[^<>]*>)?(.*?)(?:</code\s*>\s*)?</pre\s*>", lambda m: keep(_fence(html.unescape(m[1]))), body, flags=re.S | re.I)
    if "latex" in kinds:
        body = re.sub(r"\\begin\{(equation|align|gather|displaymath|eqnarray|math)\*?\}(.*?)\\end\{\1\*?\}", lambda m: keep(f"\n$${m[2].strip()}$$\n"), body, flags=re.S)
        body = re.sub(r"\$\$([^$]+)\$\$|\\\[(.+?)\\\]", lambda m: keep(f"$${(m[1] or m[2]).strip()}$$"), body, flags=re.S)
        body = re.sub(r"\$(?=[^\s$])(?=[^$\n]*(?:\\[a-zA-Z]+|[_^][{\w]))([^$\n]+)\$(?!\d)|\\\(([^\n]+?)\\\)", lambda m: keep(f"${(m[1] or m[2]).strip()}$"), body)
    if "markdown" in kinds:
        body = re.sub(r"(`{1,2})(?!`)([^`\n]+)\1", lambda m: keep(f"`{m[2]}`"), body)
        body = re.sub(r"\n([^\n]+)\n={3,}[ \t]*(?=\r|\n|_x000D_|\Z)", r"\n# \1", body)
        body = re.sub(r"!?\[([^\[\]\n]*)\]\((?:[^()\s]+)(?:[ \t]\"[^\"\n]*\")?\)", r"\1", body)
        body = re.sub(r"\*\*(?=[^\s*])([^*\n]+)\*\*", r"\1", body)
        body = re.sub(r"(?<!\w)__(?=[^\W_])([^_\n]+)__(?!\w)", r"\1", body)
        body = re.sub(r"~~(?=\S)([^~\n]+)~~", r"\1", body)
        body = re.sub(r"\n[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*(?=\r|\n|_x000D_|\Z)", "", body)
    if "wiki" in kinds:
        body = re.sub(r"\{\{([^{}\n]+)\}\}", r"\1", body)
        body = re.sub(r"\nh([1-6])\.[ \t]+", lambda m: "\n" + "#" * int(m[1]) + " ", body)
        body = re.sub(r"\n(={2,6})[ \t]*([^=\n].*?)[ \t]*\1(?=[ \t\r]*(?:\n|_x000D_|\Z))", lambda m: "\n" + "#" * len(m[1]) + " " + m[2], body)
        body = re.sub(r"\{panel:[^{}\n]*?title=([^|{}\n]*)[^{}\n]*\}", r"\n### \1\n", body)
        body = re.sub(rf"\{{(?:{_MACRO})(?::[^{{}}\n]*)?\}}|\{{([*_+?^~-])\}}", "", body)
        body = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]|\[([^\[\]|\n]+)\|[^\[\]\n]+\]|\[[\^~]([\w.@-]+)\]", lambda m: m[1] or m[2] or m[3], body)
        body = re.sub(r"!([^\s!|\n][^!|\n]*)(?:\|[^!\n]*)?!(?=\W|$)", lambda m: m[1] if "." in m[1] else m[0], body)
        body = re.sub(r"'''(.+?)'''|''(.+?)''", lambda m: m[1] or m[2], body)
        body = re.sub(r"\n[ \t]*\|\|([^\n]*?)\|\|[ \t]*(?=\r|\n|_x000D_|\Z)", lambda m: "\n| " + " | ".join(c.strip() for c in m[1].split("||")) + " |", body)
        body = re.sub(r"\n(\*+|#+)[ \t]+(?=\S)", lambda m: "\n" + "  " * (len(m[1]) - 1) + "- " if m[1][0] == "*" else "\n" + m[1] + " ", body)
        body = re.sub(r"\nbq\.[ \t]", "\n> ", body)
    if "latex" in kinds:
        body = re.sub(r"\n?[ \t]*\\(?:begin|end)\{[a-zA-Z]+\*?\}", "", body)
        body = re.sub(r"\n[ \t]*\\item\b(?:\[[^\]\n]*\])?[ \t]*", "\n- ", body)
        body = _command(body)
    if "html" in kinds:
        if re.search(rf"<!--|</?(?:{_NAMES})(?:\s[^<>]*)?/?>", body):
            # line ends of the text itself stay, only those between tags fold
            safe = re.sub(rf"<(?!/?(?:{_NAMES})(?:\s[^<>]*)?/?>|!--)", "&lt;", body)
            body = "\n" + to_markdown(re.sub(r"(?<!>)\n(?!\s*<)", "<br>", safe), with_links=False)
        else:
            body = html.unescape(body)
        body = body.replace("\xa0", " ")
    body = re.sub("\x00(\\d+)\x01", lambda m: kept[int(m[1])], body)
    return re.sub(r"\n{3,}", "\n\n", body).strip("\n")


@F.pandas_udf(StringType())
def _signature(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: " ".join(stream(t)) or None, na_action="ignore")


@F.pandas_udf(StringType())
def _cleaned(texts: pd.Series, kinds: pd.Series) -> pd.Series:
    return pd.Series([clean(t, k) for t, k in zip(texts, kinds)], dtype=object)


def clean_text(rows: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """The rows with `clean_text`, the text without the notations that `find_markup` sees in it, by the wrappers of its host."""
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host")
    kept = F.struct(*[c for c in rows.columns]).alias("row")
    signed = written(rows.select(kept, host, _signature(text_col).alias("signature")))
    have = signed.where("signature is not null")
    table = infer_wrappers(have.select("host", "signature")).select("host", "signature", "kinds")
    # Salted as in find_markup; rows without a token take no part.
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    left = have.withColumn("salt", F.pmod(F.xxhash64(f"row.{id_col}"), F.lit(SALTS)).cast("long"))
    known = left.join(table.withColumn("salt", salts), ["host", "signature", "salt"], "left")
    done = known.select("row", _cleaned(f"row.{text_col}", F.coalesce("kinds", F.array().cast("array<string>"))).alias("clean_text"))
    plain = signed.where("signature is null").select("row", F.col(f"row.{text_col}").alias("clean_text"))
    return done.unionByName(plain).select("row.*", "clean_text")
