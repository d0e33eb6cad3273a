"""The queries of this subpackage that SQL can say as well."""

from __future__ import annotations

_SHAPE = r"^(.+?)(?:__|/)(.+?)[-#]0*(\d+)(?:-v(?:[0-9a-f]+|nan))?$"


def key_sql(x: str) -> str:
    """instance_key in SQL."""
    b = rf"regexp_replace(lower(regexp_replace({x}, '^\s+|\s+$', '', 'g')), '^instance_', '')"
    parts = ", ".join(f"regexp_extract({b}, '{_SHAPE}', {i})" for i in (1, 2, 3))
    return f"case when {b} = '' then null when regexp_extract({b}, '{_SHAPE}', 3) <> '' then concat_ws('|', {parts}) else {b} end"


TIER = r"case when lower(regexp_replace(strength, '^\s+|\s+$', '', 'g')) = 'verified' then 0 else 1 end"
P1_FOUND = f"""select pair_id from (select pair_id, row_number() over (partition by {key_sql('instance_id')} order by {TIER}, rank_gap desc nulls last, pair_id) as r, {key_sql('instance_id')} as k from preference_pairs) where k is not null and r > 8"""
P5_FOUND = f"""with s as (select instance_id as s, {key_sql('instance_id')} as k from (select instance_id from preference_pairs union select instance_id from eval_items) where instance_id is not null)
select a.s as instance_id_a, b.s as instance_id_b from s a join s b on a.k = b.k and a.s < b.s"""


def bare_sql(x: str) -> str:
    return rf"lower(upper(regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', '', 'g')))"


def lines_sql(x: str) -> str:
    head = r"(?i)^[^\p{L}\p{N}]*(?:HYPOTHESIS|REASONING|CHECK)[^\p{L}\p{N}]*:"
    lines = rf"regexp_split_to_array(coalesce({x}, ''), '\r\n|[\n\x0b\x0c\r\x85]')"
    labelled = f"array_to_string(list_sort(list_transform(list_filter({lines}, lambda l: regexp_matches(l, '{head}')), lambda l: {bare_sql('l')})), '|')"
    return f"{bare_sql(f'''array_to_string(list_filter({lines}, lambda l: not regexp_matches(l, '{head}')), ' ')''')} || '#' || {labelled}"


_GROUPS = f"""g as (select pair_id, min(pair_id) over w as first_id, count(*) over w as n_copies from preference_pairs
window w as (partition by sha1({bare_sql("coalesce(prompt, '')")}), sha1({lines_sql('chosen')}), sha1({lines_sql('rejected')})))"""
P6_FOUND = f"with {_GROUPS} select first_id as first_pair_id, pair_id from g where pair_id <> first_id"
P6_GROUPS = f"with {_GROUPS} select pair_id, n_copies from g where pair_id = first_id"
