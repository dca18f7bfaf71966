"""SQL of the queries that SQL can express."""

from __future__ import annotations

from ticketloom.llm.quality import COMMON

_COMMON = ", ".join(f"'{w}'" for w in sorted(set(COMMON)))

SQL = {
    "p10_stats": rf"""
with b as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\r\n]+'), lambda w: w <> '') as w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^ \t\r]')) as l from documents),
c as (select *, array_to_string(w, '') as letters from b)
select doc_id, len(w) as n_words,
  case when len(w) > 0 then round(length(letters) / len(w), 6) end as mean_word_length,
  case when length(letters) > 0 then round(length(regexp_replace(letters, '[\p{{L}}\p{{N}}]', '', 'g')) / length(letters), 6) end as symbol_ratio,
  case when len(l) > 0 then round(len(list_filter(l, lambda s: regexp_matches(s, '[.!?][ \t\r]*\z'))) / len(l), 6) end as punctuated_line_share,
  case when len(w) > 0 then round(len(list_filter(w, lambda x: lower(x) in ({_COMMON}))) / len(w), 6) end as common_word_share
from c""",
}
