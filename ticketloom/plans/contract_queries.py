"""Queries of the record contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticketloom.operators import contract
from ticketloom.session import read


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    errors = contract.record_errors(read(spark, root, "export_lines"), read(spark, root, "language_codes"))
    return errors.select("row_id", "reason")


def p3_errors(spark: SparkSession, root: str) -> DataFrame:
    """Every broken rule of every record with readable shape."""
    lines, codes = read(spark, root, "export_lines"), read(spark, root, "language_codes")
    return contract.value_errors(contract.cell_table(lines), codes).selectExpr("row_id", "inline(errors)")


def p3_loaded(spark: SparkSession, root: str) -> DataFrame:
    """The valid records as typed columns."""
    return contract.load_records(read(spark, root, "export_lines"), read(spark, root, "language_codes"))


QUERIES = {"p3_found": p3_found, "p3_errors": p3_errors, "p3_loaded": p3_loaded}

_BAD_TEXT = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\x{fffd}]"
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*"
_FIELD = r"""(?:"(?:[^"]|"")*"|[^";\r\n]*)"""

_CUT = rf"""
with lines as (select row_id, export_file, record_no, loaded_at, regexp_replace(coalesce(raw_record, ''), '\r\z', '') as r from export_lines),
shaped as (
  select *, regexp_full_match(r, '{_FIELD}(?:;{_FIELD})*') as quoting_ok,
    len(string_split(regexp_replace(r, '"(?:[^"]|"")*"', 'Q', 'g'), ';')) as n
  from lines),
cells as (
  select row_id, export_file, record_no, loaded_at,
    list_transform(regexp_extract_all(';' || r, ';({_FIELD})', 1),
      lambda c: case when starts_with(c, '"') then replace(substr(c, 2, length(c) - 2), '""', '"') else c end) as c
  from shaped where quoting_ok and n = 21),
broken as (
  select row_id, unnest([
    case when regexp_full_match(c[1], '{_BLANK}') then 'Summary|not_blank' end,
    case when regexp_matches(c[1], '{_BAD_TEXT}') then 'Summary|clean_text' end,
    case when regexp_matches(c[12], '{_BAD_TEXT}') then 'Description|clean_text' end,
    case when not regexp_full_match(c[2], 'HD-[0-9]+') then 'Issue key|key' end,
    case when not regexp_full_match(c[4], '[0-9]+') then 'Issue id|digits' end,
    case when not regexp_full_match(c[5], '[0-9]*') then 'Parent id|digits_or_empty' end,
    case when c[8] not in ('Blocker', 'Critical', 'Major', 'Minor', 'Trivial') then 'Priority|priority' end,
    case when c[18] <> '' and c[18] not in (select label from language_codes where label is not null) then 'Language|language' end]) as e
  from cells)"""

_TYPED = ",\n  ".join(
    f"try_cast(nullif(c[{i}], '') as bigint) as {name}" if name in contract.LONGS else f"nullif(c[{i}], '') as {name}"
    for i, (_, name) in enumerate(contract.FIELDS, 1)
)

SQL = {
    "p3_found": rf"""{_CUT}
select row_id, case when not quoting_ok then 'quoting' else 'column_count' end as reason from shaped where not quoting_ok or n <> 21
union all select distinct row_id, 'value' as reason from broken where e is not null""",
    "p3_errors": rf"""{_CUT}
select row_id, split_part(e, '|', 1) as column_name, split_part(e, '|', 2) as rule from broken where e is not null""",
    "p3_loaded": rf"""{_CUT}
select row_id, export_file, record_no, loaded_at, {_TYPED}
from cells where row_id not in (select row_id from broken where e is not null)""",
}
