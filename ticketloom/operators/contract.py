"""Loading `;`-separated export records against a contract: valid rows come out typed, the others with a reason.

The record is cut at its quotation marks. Pieces at even positions lie outside quotes, those at odd positions inside;
an empty outside piece between two inside pieces is a doubled quote. That tells broken quoting from good without a
regular expression that could backtrack over a long record. Cells are then exploded into (row, column, value), joined
with a rule table, evaluated, and their errors aggregated; clean rows are what the anti-join leaves.

Nulls, empties and the like: a null or empty record has one empty field at most, so its reason is `column_count`.
Repeated rows with the same row id yield one error row per id. An empty table gives empty results. Extra columns of the
input are ignored by `record_errors` and kept by `load_records`, where a clashing name gets the prefix `raw_`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of a record, in order, with the typed column each becomes.
FIELDS = [
    ("Summary", "summary"),
    ("Issue key", "issue_key"),
    ("Inward issue link (Relates)", "relates"),
    ("Issue id", "issue_id"),
    ("Parent id", "parent_id"),
    ("Issue Type", "issue_type"),
    ("Status", "status"),
    ("Priority", "priority"),
    ("Resolution", "resolution"),
    ("Creator", "creator"),
    ("Component/s", "components"),
    ("Description", "description"),
    ("Category", "category"),
    ("Classification", "classification"),
    ("Classification (Calculated)", "classification_calculated"),
    ("Country", "country"),
    ("Solution", "solution"),
    ("Language", "ticket_language"),
    ("Summary Solution", "summary_solution"),
    ("Summary in English", "summary_in_english"),
    ("User category", "user_category"),
]
LONGS = {"issue_id", "parent_id"}


@dataclass(frozen=True)
class Rule:
    """A check of one field. kind `pattern`: the whole value must match; `no_pattern`: nothing in it may; `label`: the
    value is empty or in the label table."""

    column_name: str
    rule: str
    kind: str
    pattern: str = ""


# The checks of the contract. Patterns are valid in Java and RE2.
RULES = [
    Rule("Summary", "not_blank", "pattern", r"(?s).*[^\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}].*"),
    Rule("Summary", "clean_text", "no_pattern", r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}\x{fffd}]"),
    Rule("Description", "clean_text", "no_pattern", r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{7f}-\x{9f}\x{fffd}]"),
    Rule("Issue key", "key", "pattern", r"HD-[0-9]+"),
    Rule("Issue id", "digits", "pattern", r"[0-9]+"),
    Rule("Parent id", "digits_or_empty", "pattern", r"[0-9]*"),
    Rule("Priority", "priority", "pattern", r"Blocker|Critical|Major|Minor|Trivial"),
    Rule("Language", "language", "label"),
]

# Two noncharacters mark a field's end; a noncharacter of the text itself is escaped first, so no text can forge it.
_MARK, _END, _SELF = "﷐", "﷐﷑", "﷐﷒"


def _with(value: Column, body) -> Column:
    """body(value) with the value worked out once, as the variable of a lambda; Catalyst would copy it to each place."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _of_record(raw: Column, body) -> Column:
    """body(quoting_ok, cells) of a raw record; cells are unquoted, doubled quotes are single."""
    record = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\r\z", "")
    # a separator at both ends makes the outer pieces like all others: lambdas need no position but even or odd
    text = F.replace(F.concat(F.lit(";"), record, F.lit(";")), F.lit(_MARK), F.lit(_SELF))

    def bad(s: Column, i: Column) -> Column:
        return (i % 2 == 0) & (s != "") & (~s.startswith(";") | ~s.endswith(";") | s.contains("\n") | s.contains("\r"))

    def rebuilt(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, s).when(s == "", F.lit('"')).otherwise(F.replace(s, F.lit(";"), F.lit(_END)))

    def of_pieces(pieces: Column) -> Column:
        ok = (F.size(pieces) % 2 == 1) & (F.size(F.filter(pieces, bad)) == 0)
        cells = F.split(F.array_join(F.transform(pieces, rebuilt), ""), _END, -1)
        inner = _with(cells, lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c) - 2, F.lit(0))))
        return _with(F.transform(inner, lambda c: F.replace(c, F.lit(_SELF), F.lit(_MARK))), lambda c: body(ok, c))

    return _with(F.split(text, '"', -1), of_pieces)


def parsed(raw: Column) -> Column:
    """struct(quoting_ok, cells) of a raw record."""
    return _of_record(raw, lambda ok, cells: F.struct(ok.alias("quoting_ok"), cells.alias("cells")))


_CELL = "array<struct<column_no:int,value:string>>"
#: The column number of a record's own row, whose value is the reason of its shape.
_RECORD = -1


def cell_table(records: DataFrame, id_col: str = "row_id", raw_col: str = "raw_record", columns: list[int] | None = None) -> DataFrame:
    """(row id, column_no, value) of every record that has good quoting and the right number of fields, of all columns or of
    those asked for. A record of another shape has one row, of column -1, with the reason as its value.

    One generator parses each record once."""
    wanted = sorted(set(range(len(FIELDS)) if columns is None else columns))

    def cells_of(ok: Column, cells: Column) -> Column:
        pairs = F.array(*[F.struct(F.lit(i).alias("column_no"), F.get(cells, F.lit(i)).alias("value")) for i in wanted]).cast(_CELL)
        shape = lambda reason: F.array(F.struct(F.lit(_RECORD).alias("column_no"), F.lit(reason).alias("value"))).cast(_CELL)
        return F.when(~ok, shape("quoting")).when(F.size(cells) != len(FIELDS), shape("column_count")).otherwise(pairs)

    return records.select(F.col(id_col), F.inline(_of_record(F.col(raw_col), cells_of)))


def rule_table(df: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The rules as a table of a few rows: rule_no, column_no, rule, kind. The last one is that of a record's shape."""
    at = {name: i for i, (name, _) in enumerate(FIELDS)}
    rows = [(i, at[r.column_name], r.rule, r.kind) for i, r in enumerate(rules)] + [(len(rules), _RECORD, "shape", "shape")]
    return df.sparkSession.createDataFrame(rows, "rule_no int, column_no int, rule string, kind string")


def _checked(cells: DataFrame, labels: DataFrame, rules: list[Rule]) -> DataFrame:
    """The cells that break a rule, with the rule; a record of bad shape breaks that of its shape."""
    checked = cells.join(F.broadcast(rule_table(cells, rules)), "column_no")  # as many rows as there are rules
    known = labels.select(F.col("label").alias("value"), F.lit("label").alias("kind"), F.lit(True).alias("known")).where("value is not null").distinct()
    checked = checked.join(known, ["value", "kind"], "left")
    broken = F.col("kind") == "shape"
    for i, r in enumerate(rules):
        if r.kind == "pattern":
            this = ~F.col("value").rlike(rf"\A(?:{r.pattern})\z")
        elif r.kind == "no_pattern":
            this = F.col("value").rlike(r.pattern)
        else:
            this = (F.col("value") != "") & F.col("known").isNull()
        broken = F.when(F.col("rule_no") == i, this).otherwise(broken)
    return checked.where(broken)


def _errors() -> Column:
    names = F.array(*[F.lit(name) for name, _ in FIELDS])
    error = F.when(F.col("column_no") >= 0, F.struct(F.get(names, F.greatest("column_no", F.lit(0))).alias("column_name"), "rule"))
    return F.array_sort(F.collect_set(error))  # as many as there are rules at most


def value_errors(cells: DataFrame, labels: DataFrame, id_col: str = "row_id", rules: list[Rule] = RULES) -> DataFrame:
    """(row id, errors array<struct<column_name, rule>>) of the rows in which a rule is broken."""
    return _checked(cells.where(f"column_no <> {_RECORD}"), labels, rules).groupBy(id_col).agg(_errors().alias("errors"))


def record_errors(records: DataFrame, labels: DataFrame, id_col: str = "row_id", raw_col: str = "raw_record", rules: list[Rule] = RULES) -> DataFrame:
    """(row id, reason, errors): the records that break the contract with the first reason that applies, one of
    `quoting`, `column_count` and `value`; errors names the broken rules of the last. One row an id."""
    at = {name: i for i, (name, _) in enumerate(FIELDS)}
    cells = cell_table(records, id_col, raw_col, [at[r.column_name] for r in rules])
    shape = F.max(F.when(F.col("column_no") == _RECORD, F.col("value")))  # quoting comes before column_count, also in order
    found = _checked(cells, labels, rules).groupBy(id_col).agg(shape.alias("shape"), _errors().alias("errors"))
    none = F.array().cast("array<struct<column_name:string,rule:string>>")
    return found.select(id_col, F.coalesce("shape", F.lit("value")).alias("reason"), F.when(F.col("shape").isNull(), F.col("errors")).otherwise(none).alias("errors"))


def load_records(records: DataFrame, labels: DataFrame, id_col: str = "row_id", raw_col: str = "raw_record") -> DataFrame:
    """The valid records as typed columns beside the input's other columns; empty fields become null.

    A number too long for a BIGINT, though it is valid by the contract, becomes null."""
    bad = record_errors(records, labels, id_col, raw_col).select(id_col)
    taken = {c for _, c in FIELDS}
    kept = [F.col(c).alias(f"raw_{c}" if c.lower() in taken and c != id_col else c) for c in records.columns if c != raw_col]
    p = records.join(bad, id_col, "left_anti").select(*kept, parsed(F.col(raw_col)).alias("_p"))

    def typed(i: int, name: str) -> Column:
        v = F.nullif(F.get(F.col("_p.cells"), F.lit(i)), F.lit(""))
        return (v.try_cast("long") if name in LONGS else v).alias(name)

    return p.select(*[c for c in p.columns if c != "_p"], *[typed(i, name) for i, (_, name) in enumerate(FIELDS)])
