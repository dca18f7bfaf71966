"""HTML as text and Markdown, on the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Elements that never hold content, elements whose text is dropped, elements that start a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(("script", "style", "template", "noscript"))
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form header html legend main nav ol p section summary table tbody tfoot thead tr ul".split())


class _Markdown(HTMLParser):
    """Collects Markdown pieces while the parser walks the tags; unclosed tags close with their block."""

    def __init__(self, with_links: bool):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.lists: list[list] = []
        self.skip = self.pre = 0
        self.links: list[tuple[int, str]] = []
        self.cell = False
        self.row: list[str] | None = None
        self.rows = 0
        self.with_links = with_links

    def line(self, n: int = 1) -> None:
        self.out.append("\n" * n)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in DROPPED:
            self.skip += 1
        elif tag == "br":
            self.line()
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag in ("ul", "ol"):
            self.line(1 if self.lists else 2)
            self.lists.append([tag, 0])
        elif tag == "li":
            depth = max(0, len(self.lists) - 1)
            mark = "-"
            if self.lists and self.lists[-1][0] == "ol":
                self.lists[-1][1] += 1
                mark = f"{self.lists[-1][1]}."
            self.out.append(f"\n{'  ' * depth}{mark} ")
        elif re.fullmatch(r"h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a":
            self.links.append((len(self.out), a.get("href") or ""))
        elif tag == "img" and a.get("alt"):
            self.out.append(f"![{a['alt']}]({a.get('src') or ''})")
        elif tag == "table":
            self.rows = 0
            self.line(2)
        elif tag == "tr":
            self.close_row()
            self.row = []
            self.line()
        elif tag in ("td", "th"):
            self.out.append("| " if not self.row else " | ")
            if self.row is not None:
                self.row.append(tag)
        elif tag in BLOCKS:
            self.line(2)

    def close_row(self) -> None:
        if self.row:
            self.out.append(" |")
            if self.rows == 0:
                self.out.append("\n|" + " --- |" * len(self.row))
            self.rows += 1
        self.row = None

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.line(1 if self.lists else 2)
        elif re.fullmatch(r"h[1-6]", tag):
            self.line(2)
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a" and self.links:
            at, href = self.links.pop()
            text = "".join(self.out[at:]).strip()
            if self.with_links and href and text:
                self.out[at:] = [f"[{text}]({href})"]
        elif tag == "tr":
            self.close_row()
        elif tag == "table":
            self.close_row()
            self.line(2)
        elif tag in BLOCKS:
            self.line(2)

    def handle_data(self, data):
        if self.skip:
            return
        self.out.append(data if self.pre else re.sub(r"[ \t\r\n\f]+", " ", data))


def _tidy(text: str) -> str:
    parts = re.split(r"(```.*?```)", text, flags=re.S)
    for i in range(0, len(parts), 2):
        t = re.sub(r"\*\*\s*\*\*|(?<!\*)\*\s+\*(?!\*)", "", parts[i])
        t = re.sub(r"[ \t]+\n", "\n", t)
        t = re.sub(r"\n[ \t]+(?![-\d ])", "\n", t)
        parts[i] = re.sub(r"\n{3,}", "\n\n", t)
    return "".join(parts).strip()


def to_markdown(markup: str | None, with_links: bool = True) -> str:
    """Markdown with ATX headings and `-` bullets; script and style text is dropped. Null and empty give ''."""
    if not markup:
        return ""
    parser = _Markdown(with_links)
    parser.feed(markup)
    parser.close()
    return _tidy("".join(parser.out))


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in DROPPED

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in DROPPED))

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.out.append(data.strip())


def to_text(markup: str | None) -> str:
    """The stripped text pieces of the page, one a line. Null and empty give ''."""
    if not markup:
        return ""
    parser = _Text()
    parser.feed(markup)
    parser.close()
    return "\n".join(parser.out)


_PLACES = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<(/?)(div|section)\b([^<>]*)>", re.S | re.I)
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def sections_of(page: str, container: str | None = None) -> str | None:
    """The section elements of a page in document order, each up to its own end tag, or the container's where it is missing."""
    found: list[tuple[int, int]] = []
    opened: list[int] = []
    depth, inside = 0, container is None
    end = len(page)
    for m in _PLACES.finditer(page):
        closing, tag = bool(m[2]), (m[3] or "").lower()
        if not tag:
            continue
        if tag == "div" and container is not None:
            if not inside:
                name = _CLASS.search(m[4])
                inside = not closing and name is not None and container in (name[1] or name[2] or name[3] or "").split()
                depth = 1
            else:
                depth += -1 if closing else 1
                if not depth:
                    end = m.start()
                    break
        elif inside and tag == "section":
            if not closing:
                opened.append(m.start())
            elif opened:
                found.append((opened.pop(), m.end()))
    found += [(a, end) for a in opened]
    return "".join(page[a:b] for a, b in sorted(found)) or None
