"""Views over the test tables that stand for logs, candidates and scores; the same text runs in Spark and elsewhere."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from trajecta.registry import table

#: A message log of each user: clicks state hypotheses, errors bring feedback, views are reads, purchases tests, signups edits.
MESSAGES = """
select cast(user_id as string) as instance_id, event_id as idx, event_type,
  case when event_type = 'click' then 'assistant' else 'user' end as role,
  case event_type
    when 'click' then case when event_id % 11 = 0 then 'HYPOTHESIS: <one sentence>' else 'HYPOTHESIS: the h' || cast(event_id % 3 as string) || ' of it' end
    when 'error' then case event_id % 3 when 0 then 'guidance round 2' when 1 then 'tests FAILED. Reconsider your current HYPOTHESIS' else 'Still failing after several rounds' end
    when 'view' then 'src/m' || cast(event_id % 7 as string) || '.py:' || cast(event_id % 50 as string) || ': hit'
    when 'purchase' then cast(event_id % 5 as string) || ' passed, returncode 0'
    else 'sed -i s/a/b/ src/m' || cast(event_id % 4 as string) || '.py' end as text
from {events}
"""
#: Candidates of a node, a user's day: scored, labelled and in groups.
CANDIDATES = """
select cast(user_id as string) || '::' || substr(cast(ts as string), 1, 10) as node_id,
  row_number() over (partition by user_id, substr(cast(ts as string), 1, 10) order by event_id) as cand_idx,
  value as score, event_type as grp,
  case event_type when 'purchase' then 'correct' when 'error' then 'wrong' when 'view' then 'partial' when 'signup' then null else 'partial' end as label,
  'candidate ' || cast(event_id % 17 as string) as text
from {events}
"""


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A view of its tables."""
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))})


def plain(text: str) -> str:
    """The text with table names in place of the braces, for other engines."""
    return re.sub(r"\{(\w+)\}", r"\1", text)
