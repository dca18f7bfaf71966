"""Template residue, filler text, error pages and browser notices in short texts.

Method: numbers, addresses, dates and identifiers are masked, exact normalised forms are hashed and counted across
sources, and each distinct form is classified once by placeholder and phrase rules. A form that says by its whole
wording what it is needs no other evidence; one that only holds a phrase of that kind counts when it recurs
in `min_rows` rows and `min_sources` sources, since a report of one such event names its own details.

Nulls are no residue. An empty or blank text is none either (there is nothing to judge). Repeated rows and ties change
the counts only. An empty table gives an empty result. Clashing column names cannot occur: the operator reads
only the three named columns. Whole texts of any length are read; the rules are linear in it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.session import written

SALTS = 16

# Reply and forward prefixes that may stand before anything.
PREFIX = r"^\s*(?:(?:re|fwd?|aw|wg|tr|rv|subject|betreff|objet|more|title)\s*:\s*)+"

# What masking replaces, in this order.
MASKS = [
    (r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "<email>"),
    (r"(?:https?://|www\.)\S+", "<url>"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<address>"),
    (r"\b(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})\b", "<date>"),
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<id>"),
    (r"\b(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{12,}\b", "<id>"),
    (r"\d+", "0"),
]

# The notations of placeholders.
PLACEHOLDER = "|".join(
    [
        r"\{\{[^{}]*\}\}",
        r"\{%[^{}]*%\}",
        r"\$\{[^{}]*\}",
        r"\{0\}|\{[a-z][a-z]*[_.][a-z_.]*\}",
        r"<%[^%]*%>",
        r"<<[^<>]*>>",
        r"\[\[[^\[\]]*\]\]",
        r"\[(?:insert|enter|type|add|your|put|subject|title|summary|name|issue|ticket|request|category|country|product)[^\[\]]*\]",
        r"<(?!(?:email|url|address|date|id)>)[a-z][a-z_. ]*>",
        r"%[a-z][a-z_.]*%",
        r"@@[a-z][a-z_.]*@@",
        r"__[a-z][a-z_.]*__",
        r"#[a-z][a-z_.]*#",
        r"_{4,}",
    ]
)
# Words that may join placeholders without making them a text.
GLUE = (
    r"\b(?:a|about|an|and|at|by|category|class|country|date|dear|dr|for|from|has|hello|hi|id|in|is|issue|message|mr|mrs|ms|name|new|no|of|on|or|"
    r"product|regarding|request|status|subject|summary|ticket|title|to|type|with|you|your|x+)\b"
)

# Forms that are residue as a whole. {any} of them must match the whole form.
FILLER = [
    r"(?:lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|elit|sed|do|eiusmod|tempor|incididunt|ut|labore|et|dolore|magna|aliqua|enim|ad|minim|veniam|quis|nostrud|exercitation|ullamco|laboris|nisi|aliquip|ex|ea|commodo|consequat|duis|aute|irure|in|reprehenderit|voluptate|velit|esse|cillum|eu|fugiat|nulla|pariatur|excepteur|sint|occaecat|cupidatat|non|proident|sunt|culpa|qui|officia|deserunt|mollit|anim|id|est|laborum|[\s.,;:])+",
    r"(?:(?:test|testing|tests|asdf|qwer|qwerty|asd|foo|bar|baz|blah|bla|abc|xyz|def|dummy|sample|example|text|summary|title|placeholder|tbd|tba|todo|fixme|xxx+|x+|0)[\s.,;:/_-]*)+",
    r"(?:\b(\w)\1{2,}\b[\s.]*)+",
    r"(?:n/?a|null|nan|none|nil|undefined|unknown|empty|-+ ?(?:empty|none|blank) ?-+|untitled(?: (?:document|page|ticket))?|no (?:title|subject|summary|text|content)|new (?:document|ticket|page)|\[object object\]|#ref!|#n/a|#value!|#name\?|#div/0!|#null!|\(?(?:blank|null|none|empty)\)?)[.!]*",
    r"[^\p{L}\p{N}]+",
    r"[\W\d_]+",
    r"(?:the )?quick brown fox.*",
    r"(?:title|subject|summary|name)\s*:\s*[_.\-\s]*",
    r"(?:click|tap|type|enter|insert|write|add|put|fill in)\b[^.]*\b(?:summary|title|subject|text|description)\b[^.]*\b(?:here|below)[.!]?",
    r"<?(?:please )?(?:enter|type|insert|write|add)\b[^.<>]*\b(?:summary|title|subject|text|description)\b[^.<>]{0,20}>",
    r"(?:summary|title|description|text)\b.{0,40}\(?(?:to be (?:completed|filled(?: in)?|added|provided|written)|will be (?:added|completed))\b.{0,40}",
]
# Names of HTTP states.
STATES = (
    r"(?:bad request|unauthorized|forbidden|(?:page |file )?not found|method not allowed|request timeout|too many requests|internal server error|not implemented|"
    r"bad gateway|service (?:temporarily )?unavailable|gateway time-?out|access denied)"
)
ERROR = [
    rf"(?:http |status |error |code |http status |http/0\.0 )*0? *[-:–]? *{STATES}(?: *[-:–(,.]? *(?:request|support|incident|reference|ref|ray|trace) ?(?:id|number|no)?\.?:? ?[#\w-]*\)?)*[.!\s]*",
    rf"(?:http |status |error |code )*0 *[-:–]? *{STATES}[.:,]? (?:you|the (?:page|server|requested|resource)|upstream|please|try|sorry)\b.*",
    rf"{STATES}[.:!] (?:you|the (?:page|server|requested|resource)|upstream|please|try|sorry)\b.*",
    r"error 0: .*",
    r"server error in .{0,40}application.*",
    r"traceback \(most recent call last\).*",
    r"(?:[a-z_]\w*\.)+\w*(?:exception|error)\b.*",
    r"(?:uncaught |fatal |unhandled )?(?:\w*(?:exception|error)): .*(?:undefined|null|line 0|at \w+[.(:]).*",
    r"(?:oops|sorry|whoops|uh-oh)\b.*(?:went wrong|not exist|been moved|not (?:be )?found|try again|unavailable).*",
    r"something went wrong.*",
    r"(?:the )?(?:requested )?(?:page|url|resource|file|document)(?: you(?: are|'re| were)? (?:looking for|requested))?.{0,10}(?:could not be found|was not found|does not exist|has (?:been )?moved|was rejected|is (?:not available|unavailable)).*",
    r"this (?:site|page|webpage) (?:can'?t|can’t|cannot|could not) be (?:reached|displayed|loaded|found).*",
    r"your (?:session|login) (?:has )?(?:expired|timed out)\b.*(?:log ?in|sign in|again|reload).*",
    r"(?:access denied|blocked)[.!:] .*(?:your (?:request|ip|access)|incident|permission).*",
    r"(?:database|server|backend|network) (?:connection|error|failure)\b.*(?:failed|refused|too many connections|timed out|lost|closed).*",
    r"gateway time-?out: .*",
    r".*\b(?:no (?:summary|translation|answer|text|result) was (?:generated|produced|created|returned)).*",
    r"(?:translation|summary|ai|language|model) (?:service|server|model) (?:is )?(?:currently |temporarily )?(?:unavailable|failed|not available).*",
    r"(?:request|connection) (?:failed|timed out|refused)\b.*",
]
NOTICE = [
    r"(?:please |you (?:need|have|must) (?:to )?|to continue,? (?:please )?)*(?:enable|activate|allow|turn on|switch on|accept|unblock)\b.{0,20}\b(?:java ?script|scripts?|scripting|cookies?)\b.*(?:\b(?:reload|view|continue|run|use|proceed|work|and|browser|try|this|page|site|app)\b.*|[.!]|)",
    r"(?:java ?script|scripts?|scripting|cookies?) (?:is|are|must be|has to be|have to be|seems?)\b.{0,15}\b(?:disabled|blocked|off|required|needed|enabled)\b(?! (?:message|warning|notice|error|page)).*",
    r"(?:your|this|the) browser (?:does not|doesn'?t|doesn’t|is not|cannot) (?:support|run|able)\b.*",
    r"this (?:page|site|website|application|app|service|portal)\b.{0,20}\b(?:requires?|needs?|works?|uses?)\b.*\b(?:java ?script|scripts?|cookies?)\b.*",
    r"(?:we|this site|this website) uses? cookies\b.*",
    r"(?:checking|verifying|validating) (?:your|the) (?:browser|connection|request)\b.*",
    r"(?:please )?(?:verify|confirm|prove)\b.{0,20}\byou(?: are|'re|’re) (?:a )?(?:human|not a robot)\b.*",
    r"(?:i am|i'm) not a robot.*",
    r"noscript\b.*",
    r"(?:loading|please wait|just a moment|one moment)\b[ ,.…!]*(?:please wait|loading|while .*)?[ .…!]*",
    r"(?:accept|reject) all(?: cookies)?\b.*",
]
# Phrases of messages that count only where the same form recurs widely.
WEAK = [
    r"\b(?:try again later|contact (?:your|the) administrator|support id|request id|incident id)\b",
    r"\b(?:enable|turn on|switch on) (?:java ?script|scripts|cookies)\b",
    r"\b(?:ddos protection|captcha|cookie settings|reload the page)\b",
]
# Words by which a text reports such a message instead of being one.
REPORT = r"\b(?:message|warning|text|placeholder|template|notice|page) (?:appears?|blocks?|shown|after|for|in|on|when|while|during|since|prevents?|stays)\b|\b(?:question|how to|cannot|unable|user gets)\b"


def normal_form(text: Column) -> Column:
    """Lower-case text without reply prefixes; numbers, addresses, dates and identifiers masked, white space single."""
    t = F.regexp_replace(F.lower(text), r"[\s\x{a0}\x{200b}-\x{200d}\x{feff}]+", " ")
    t = F.regexp_replace(F.trim(t), PREFIX, "")
    for pattern, to in MASKS:
        t = F.regexp_replace(t, pattern, to)
    return F.trim(t)


def _whole(form: Column, patterns: list[str]) -> Column:
    return form.rlike(r"\A(?:" + "|".join(patterns) + r")\z")


def residue_kind(form: Column, widely: Column) -> Column:
    """`template`, `filler`, `error`, `notice`, or null for content. widely: whether the form recurs widely."""
    bare = F.regexp_replace(F.regexp_replace(form, PLACEHOLDER, " "), GLUE, " ")
    template = form.rlike(PLACEHOLDER) & ~bare.rlike(r"[\p{L}\p{N}]{2,}|\p{L}")
    weak = widely & form.rlike("|".join(WEAK)) & ~form.rlike(REPORT)
    return (
        F.when(form == "", None)
        .when(template, "template")
        .when(_whole(form, FILLER), "filler")
        .when(_whole(form, ERROR), "error")
        .when(_whole(form, NOTICE), "notice")
        .when(weak, "notice")
    )


def forms(rows: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(row id, source, form, h1, h2) of the rows that have a text; h1 and h2 together identify a form."""
    t = rows.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), normal_form(F.col(text_col)).alias("form"))
    return t.where("form <> ''").withColumns({"h1": F.xxhash64("form"), "h2": F.hash("form")})


def _counted(found: DataFrame, min_rows: int, min_sources: int) -> DataFrame:
    f = found.groupBy("h1", "h2", "source").agg(F.count("*").alias("n"), F.min("form").alias("form"))
    g = f.groupBy("h1", "h2").agg(F.min("form").alias("form"), F.sum("n").alias("n_rows"), F.count("source").alias("n_sources"))
    return g.withColumn("kind", residue_kind(F.col("form"), (F.col("n_rows") >= min_rows) & (F.col("n_sources") >= min_sources)))


def form_table(rows: DataFrame, id_col: str, text_col: str, source_col: str, min_rows: int = 5, min_sources: int = 3) -> DataFrame:
    """(h1, h2, form, n_rows, n_sources, kind) of each distinct form. The partial aggregate meets hot forms first."""
    return _counted(forms(rows, id_col, text_col, source_col), min_rows, min_sources)


def find_residue(rows: DataFrame, id_col: str, text_col: str, source_col: str, min_rows: int = 5, min_sources: int = 3) -> DataFrame:
    """(id, kind), one row per id whose text is residue. A form that a third of all rows share meets `SALTS` tasks.

    The masked forms are written once, for the counts and for the rows that join them."""
    f = written(forms(rows, id_col, text_col, source_col))
    bad = _counted(f, min_rows, min_sources).where("kind is not null").select("h1", "h2", "kind")
    bad = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    f = f.select("id", "h1", "h2", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    return f.join(bad, ["h1", "h2", "salt"]).groupBy("id").agg(F.min("kind").alias("kind"))


def keep_content(rows: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The rows that may be embedded: with a text that is no residue. All input columns stay."""
    bad = find_residue(rows, id_col, text_col, source_col).select(F.col("id").alias(id_col))
    return rows.where(F.col(text_col).isNotNull() & (F.trim(text_col) != "")).join(bad, id_col, "left_anti")
