"""All core queries, each with its SQL twin where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajecta.functions import fixed, render
from trajecta.functions import text as T
from trajecta.functions.hashing import hash_order, one_in, pick_variant, sha_mod, split_bucket
from trajecta.functions.pandas_udfs import context_windows, similarity
from trajecta.operators import hooks, intervals, joins, ledger, metrics, pairs, prep, streaks, turns
from trajecta.plans.views import CANDIDATES, MESSAGES, plain, view
from trajecta.registry import Registry, table
from trajecta.sources.readers import inspected
from trajecta.streaming.twins import settled_counts

REG = Registry()
LOG, CANDS = f"log as ({plain(MESSAGES)})", f"cands as ({plain(CANDIDATES)})"


def sha_sql(x: str, m: int) -> str:
    """SHA-1 modulo m in SQL: chunks of hex digits, recombined."""
    part = lambda a, n: f"(('0x' || substr(sha1({x}), {a}, {n}))::bigint % {m})"
    return f"((((({part(1, 15)} * {pow(16, 15, m)} + {part(16, 15)}) % {m}) * {pow(16, 10, m)}) + {part(31, 10)}) % {m})"


def _instances(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "instances")


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "preference_pairs")


def _samples(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "sft_samples")


def _log(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, MESSAGES)


def _cands(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, CANDIDATES)


# ---- splits, walls and samples -------------------------------------------------------------------------------------

SPLITS = [("train", 70), ("dev", 80), ("test", 100)]
BUCKET_SQL = f"case when {sha_sql('instance_id', 100)} < 70 then 'train' when {sha_sql('instance_id', 100)} < 80 then 'dev' else 'test' end"


@REG.add("split_buckets", f"select {BUCKET_SQL} as split, count(*) as n from instances group by 1")
def split_buckets(s: SparkSession, d: str) -> DataFrame:
    """Instances by hashed bucket."""
    return _instances(s, d).groupBy(split_bucket(F.col("instance_id"), SPLITS).alias("split")).agg(F.count("*").alias("n"))


@REG.add("split_disjoint", f"with b as (select instance_id, {BUCKET_SQL} as split from instances) select count(*) as n, count(distinct instance_id) as ids, count(*) = count(distinct instance_id) as disjoint from (select distinct instance_id, split from b)")
def split_disjoint(s: SparkSession, d: str) -> DataFrame:
    """Whether each id has one split."""
    b = _instances(s, d).select("instance_id", split_bucket(F.col("instance_id"), SPLITS).alias("split")).distinct()
    return b.agg(F.count("*").alias("n"), F.countDistinct("instance_id").alias("ids")).withColumn("disjoint", F.col("n") == F.col("ids"))


WALL_SQL = f"wall as (select instance_id from instances where {sha_sql('instance_id', 100)} >= 80)"


def _wall(s: SparkSession, d: str) -> DataFrame:
    return _instances(s, d).filter(sha_mod(F.col("instance_id"), 100) >= 80).select("instance_id")


@REG.add("wall_anti_join", f"with {WALL_SQL} select type, count(*) as n from sft_samples s where not exists (select 1 from wall w where w.instance_id = s.instance_id) group by type")
def wall_anti_join(s: SparkSession, d: str) -> DataFrame:
    """Samples outside the wall."""
    return joins.beyond_wall(_samples(s, d), _wall(s, d), "instance_id").groupBy("type").agg(F.count("*").alias("n"))


@REG.add("wall_excluded_count", f"with {WALL_SQL} select count(*) as excluded, count(distinct instance_id) as ids from sft_samples where instance_id in (select instance_id from wall)")
def wall_excluded_count(s: SparkSession, d: str) -> DataFrame:
    return joins.wall_hits(_samples(s, d), _wall(s, d), "instance_id").agg(F.count("*").alias("excluded"), F.countDistinct("instance_id").alias("ids"))


@REG.add(
    "hash_sample_strata",
    """with a as (select instance_id, difficulty is not null as seen, sha1('pick|' || instance_id) as h from instances),
    r as (select *, row_number() over (partition by seen order by h, instance_id) as k from a),
    c as (select *, row_number() over (order by k > 25, h, instance_id) as place from r)
    select instance_id, seen from c where place <= 50""",
)
def hash_sample_strata(s: SparkSession, d: str) -> DataFrame:
    """Half of a sample from each stratum in hashed order, topped up from what is left."""
    rows = _instances(s, d).select("instance_id", F.col("difficulty").isNotNull().alias("seen"))
    h = hash_order("pick", F.col("instance_id"))
    # each stratum can fill the sample alone at most, so 50 of each are enough
    top = rows.withColumn("k", F.row_number().over(W.partitionBy("seen").orderBy(h, "instance_id"))).filter("k <= 50")
    return top.orderBy(F.col("k") > 25, h, "instance_id").limit(50).select("instance_id", "seen")


@REG.add("skin_pick", f"select case when {sha_sql('instance_id', 20000)} % 10000 >= 1500 then null when {sha_sql('instance_id', 20000)} < 10000 then 'assessment' else 'review' end as skin, count(*) as n from instances group by 1")
def skin_pick(s: SparkSession, d: str) -> DataFrame:
    """Which rows get another label set."""
    return _instances(s, d).groupBy(pick_variant(F.col("instance_id"), 0.15, ["assessment", "review"]).alias("skin")).agg(F.count("*").alias("n"))


@REG.add("twin_sample", f"select instance_id from instances where {sha_sql('instance_id', 4)} = 0")
def twin_sample(s: SparkSession, d: str) -> DataFrame:
    return _instances(s, d).filter(one_in(F.col("instance_id"), 4)).select("instance_id")


@REG.add("seeded_shuffle_head", "select instance_id from instances order by sha1('7|' || instance_id), instance_id limit 20")
def seeded_shuffle_head(s: SparkSession, d: str) -> DataFrame:
    """The head of a seeded order (a top-k report)."""
    return prep.shuffled(_instances(s, d).select("instance_id"), "7", "instance_id").limit(20)


# ---- commands, feedback and text predicates -----------------------------------------------------------------------

COMMANDS_SQL = "commands as (select doc_id, unnest(regexp_extract_all(text, '(?m)^\\$ (.+)$', 1)) as command from documents)"


def _commands(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\$ (.+)$"), F.lit(1))).alias("command"))


@REG.add(
    "classify_commands",
    f"""with {COMMANDS_SQL}, c as (select regexp_replace(regexp_replace(trim(command), '^([A-Z_]+=\\S+\\s+)+', ''), '^cd\\s+\\S+\\s*&&\\s*', '') as c from commands)
    select case when contains(c, 'COMPLETE_TASK_AND_SUBMIT') then 'submit'
      when regexp_matches(c, '\\bsed -i\\b|\\bgit apply\\b|\\bpatch -p|\\bapply_patch\\b|cat\\s*>|tee\\s+\\S+|>\\s*\\S+\\.(?:py|cfg|txt)|open\\([^)]*[''"][wa]|write_text\\(') then 'edit'
      when regexp_matches(c, '\\bpytest\\b|python -m pytest|\\bunittest\\b|python\\s+\\S*test\\S*\\.py|python\\s+repro|assert ') then 'test' else 'read' end as kind, count(*) as n from c group by 1""",
)
def classify_commands(s: SparkSession, d: str) -> DataFrame:
    """Shell commands of run logs by kind."""
    return _commands(s, d).groupBy(T.classify_command("command").alias("kind")).agg(F.count("*").alias("n"))


TRIGGER_SQL = "case when contains(text, 'guidance round') or contains(text, 'WHERE your reasoning is wrong') then 'oracle' when contains(text, 'tests FAILED') and contains(text, 'Reconsider your current HYPOTHESIS') then 'self_rescue' end"


@REG.add("feedback_triggers", f"with {LOG} select {TRIGGER_SQL} as trigger, count(*) as n, count(*) filter (where contains(text, 'Still failing after several rounds')) as injected from log group by 1")
def feedback_triggers(s: SparkSession, d: str) -> DataFrame:
    return _log(s, d).groupBy(T.trigger("text").alias("trigger")).agg(F.count("*").alias("n"), F.count_if(T.is_injected("text")).alias("injected"))


MASKED = "(submission feedback withheld)"
MASK_SQL = "case when " + " or ".join(f"contains(text, '{x}')" for x in fixed.FEEDBACK_MARKERS) + f" then '{MASKED}' else text end"


@REG.add("crutch_mask", f"with {LOG} select instance_id, count(*) as n, count(*) filter (where {MASK_SQL} = '{MASKED}') as masked, sum(length({MASK_SQL}))::bigint as chars from log group by 1")
def crutch_mask(s: SparkSession, d: str) -> DataFrame:
    """Harness feedback masked."""
    m = T.mask_feedback("text", MASKED)
    return _log(s, d).groupBy("instance_id").agg(F.count("*").alias("n"), F.count_if(m == MASKED).alias("masked"), F.sum(F.length(m)).alias("chars"))


@REG.add(
    "protocol_class",
    f"with {LOG} select instance_id, case when bool_or(contains(text, 'Sanitized test-feedback direction')) then 'sanitized' when bool_or(contains(text, 'guidance round')) or bool_or(contains(text, 'tests FAILED')) then 'raw_leak' else 'none' end as protocol from log group by 1",
)
def protocol_class(s: SparkSession, d: str) -> DataFrame:
    """How each log's feedback was given."""
    has = lambda *x: F.bool_or(T.contains_any("text", x))
    return _log(s, d).groupBy("instance_id").agg(F.when(has("Sanitized test-feedback direction"), "sanitized").when(has("guidance round", "tests FAILED"), "raw_leak").otherwise("none").alias("protocol"))


OVERFLOW_SQL = " or ".join(f"contains(lower(text), '{x}')" for x in fixed.OVERFLOW_MARKERS)


@REG.add("context_overflow", f"select count(*) as n, count(*) filter (where {OVERFLOW_SQL}) as overflow from documents")
def context_overflow(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").agg(F.count("*").alias("n"), F.count_if(T.is_context_overflow("text")).alias("overflow"))


@REG.add("message_roles", "with m as (select unnest(messages) as m from sft_samples) select lower(m.role) as role, count(*) as n, count(*) filter (where contains(m.content, 'HYPOTHESIS:')) as hypotheses from m group by 1")
def message_roles(s: SparkSession, d: str) -> DataFrame:
    """Messages by role, and those that state a hypothesis."""
    m = _samples(s, d).select(F.explode("messages").alias("m"))
    return m.groupBy(F.lower("m.role").alias("role")).agg(F.count("*").alias("n"), F.count_if(F.contains("m.content", F.lit("HYPOTHESIS:"))).alias("hypotheses"))


@REG.add("log_inspector", f"with {LOG} select instance_id, count(*) as messages, count(*) filter (where role = 'assistant') as assistant, count(*) filter (where contains(text, 'HYPOTHESIS:')) as hypotheses from log group by 1")
def log_inspector(s: SparkSession, d: str) -> DataFrame:
    return inspected(_log(s, d), ["instance_id"])


# ---- ledger --------------------------------------------------------------------------------------------------------

OPEN_SQL = f"""{LOG},
said as (select *, case when role = 'assistant' and not contains(text, '<one sentence') then nullif(substr(regexp_extract(text, 'HYPOTHESIS:\\s*(.+)', 1), 1, 400), '') end as hyp,
   case when role <> 'assistant' then {TRIGGER_SQL} end as fb from log),
stated as (select *, lag(idx) over (partition by instance_id order by idx) as before_idx, lag(hyp) over (partition by instance_id order by idx) as before_hyp from said where hyp is not null),
pend as (select st.instance_id, st.idx, st.hyp, st.before_hyp, max_by(f.fb, f.idx) as fb from stated st left join (select instance_id, idx, fb from said where fb is not null) f
   on f.instance_id = st.instance_id and f.idx < st.idx and f.idx > coalesce(st.before_idx, -1) group by 1, 2, 3, 4),
opened as (select *, row_number() over (partition by instance_id order by idx) as card from pend where before_hyp is null or hyp <> before_hyp or fb is not null)"""


def _opened(s: SparkSession, d: str) -> DataFrame:
    return ledger.card_openings(_log(s, d), ["instance_id"])


@REG.add("cards", f"with {OPEN_SQL} select instance_id, card, 'msg#' || idx as raw_ref, coalesce(fb, 'explore') as opened_by, hyp from opened")
def cards(s: SparkSession, d: str) -> DataFrame:
    """Hypothesis cards of each log."""
    return ledger.cards(_opened(s, d), ["instance_id"])


CARD_SQL = f"{OPEN_SQL}, placed as (select l.*, (select count(*) from opened o where o.instance_id = l.instance_id and o.idx <= l.idx) as card from said l)"


@REG.add("card_sizes", f"with {CARD_SQL} select instance_id, card, count(*) as n, count(*) filter (where event_type = 'view') as reads from placed group by 1, 2")
def card_sizes(s: SparkSession, d: str) -> DataFrame:
    """Rows and reads of each card, 0 being what comes before the first."""
    return _opened(s, d).groupBy("instance_id", "card").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "view").alias("reads"))


@REG.add(
    "card_found_top8",
    f"""with {CARD_SQL}, hits as (select instance_id, card, text as item, min(idx) as pos, bool_or(contains(text, 'm1') or contains(text, 'm2')) as front from placed where regexp_matches(text, '^\\S+\\.[A-Za-z0-9_]+:\\d+:') group by 1, 2, 3)
    select instance_id, card, item, place from (select *, row_number() over (partition by instance_id, card order by front desc, pos, item) as place from hits) where place <= 8""",
)
def card_found_top8(s: SparkSession, d: str) -> DataFrame:
    """The first eight distinct hits of each card, those in edited files before others."""
    hits = _opened(s, d).withColumn("item", F.explode(T.search_hits("text")))
    return ledger.first_seen_top(hits, ["instance_id", "card"], "item", "idx", T.contains_any("item", ("m1", "m2")), 8)


BODY_SQL = "trim(text || repeat(' line ' || idx || ' of it', (idx % 500)::int))"


@REG.add("latest_snapshot", f"with {CARD_SQL}, v as (select instance_id, card, split_part(text, ':', 1) as file, idx, {BODY_SQL} as body from placed where event_type = 'view') select instance_id, card, file, max_by(substr(body, 1, 2500), idx) as body from v where length(body) > 40 group by 1, 2, 3")
def latest_snapshot(s: SparkSession, d: str) -> DataFrame:
    """The last view of each file in each card that is more than an error, cut to 2,500 characters."""
    body = F.concat("text", F.repeat(F.concat(F.lit(" line "), F.col("idx").cast("string"), F.lit(" of it")), (F.col("idx") % 500).cast("int")))
    views = _opened(s, d).filter("event_type = 'view'").withColumn("file", F.split_part("text", F.lit(":"), F.lit(1))).withColumn("body", body)
    return ledger.latest_snapshots(views, ["instance_id", "card", "file"], "body", "idx")


@REG.add(
    "test_attach",
    f"""with {LOG}, e as (select *, event_type = 'signup' as is_test, case when event_type <> 'signup' and regexp_matches(text, '(?i)returncode|passed|failed|error') then text end as r from log),
    t as (select *, max(case when is_test then idx end) over (partition by instance_id order by idx) as test_at from e)
    select instance_id, test_at, min_by(substr(r, 1, 400), idx) filter (where r is not null) as result from t where test_at is not null group by 1, 2""",
)
def test_attach(s: SparkSession, d: str) -> DataFrame:
    """Each test run with the first result behind it."""
    test = F.col("event_type") == "signup"
    result = F.when(F.col("text").rlike("(?i)returncode|passed|failed|error"), F.col("text"))
    return ledger.attach_results(_log(s, d), ["instance_id"], "idx", test, result)


@REG.add(
    "action_pairs",
    f"""with {LOG}, b as (select *, sum((role = 'assistant')::int) over (partition by instance_id order by idx) as block from log),
    a as (select instance_id, block, unnest([0, 1]) as k, unnest(['act ' || block || 'a', 'act ' || block || 'b']) as action from b where role = 'assistant'),
    o as (select instance_id, block, row_number() over (partition by instance_id, block order by idx) - 1 as k, text as observation from b where role <> 'assistant' and block > 0)
    select a.instance_id, a.block::bigint as block, a.k::int as k, a.action, o.observation from a left join o using (instance_id, block, k)""",
)
def action_pairs(s: SparkSession, d: str) -> DataFrame:
    """The k-th action of a message with the k-th observation behind it."""
    w = W.partitionBy("instance_id").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    log = _log(s, d).withColumn("b", F.sum((F.col("role") == "assistant").cast("int")).over(w))
    log = log.withColumn("actions", F.array(*[F.concat(F.lit("act "), F.col("b").cast("string"), F.lit(x)) for x in "ab"]))
    return ledger.pair_actions(log, ["instance_id"]).select("instance_id", "block", F.col("k").cast("int").alias("k"), "action", "observation")


@REG.add(
    "prior_evidence",
    f"""with {CARD_SQL}, found as (select instance_id, card, idx, text from placed where event_type = 'view' and card > 0),
    base as (select o.instance_id, o.card, o.hyp, lag(o.hyp) over (partition by o.instance_id order by o.card) as prior_hyp from opened o),
    seen as (select b.instance_id, b.card, f.text, min(f.idx) as pos from base b join found f on f.instance_id = b.instance_id and f.card < b.card group by 1, 2, 3),
    ranked as (select *, row_number() over (partition by instance_id, card order by pos desc, text desc) as r from seen)
    select b.instance_id, b.card, b.prior_hyp, count(r.text) as n, string_agg(r.text, '|' order by r.pos, r.text) as found from base b left join ranked r on r.instance_id = b.instance_id and r.card = b.card and r.r <= 12 group by 1, 2, 3""",
)
def prior_evidence(s: SparkSession, d: str) -> DataFrame:
    """What each card may know: the last twelve distinct hits and the last hypothesis strictly before it."""
    log = _opened(s, d).filter("card > 0")
    w = W.partitionBy("instance_id").orderBy("card")
    nodes = ledger.cards(log, ["instance_id"]).select("instance_id", "card", F.lag("hyp").over(w).alias("prior_hyp"))
    got = ledger.last_before(nodes, log.filter("event_type = 'view'"), ["instance_id"], "card", "text", "idx", 12)
    return got.select("instance_id", "card", "prior_hyp", F.size("prior").cast("bigint").alias("n"), F.nullif(F.array_join("prior", "|"), F.lit("")).alias("found"))


# ---- conversations --------------------------------------------------------------------------------------------------

TURNS_SQL = f"""{LOG}, w as (select instance_id, idx, case when role = 'assistant' then 'gpt' else 'human' end as who, text from log),
m as (select *, coalesce((who <> lag(who) over (partition by instance_id order by idx))::int, 1) as fresh from w),
n as (select *, sum(fresh) over (partition by instance_id order by idx) as turn from m),
merged as (select instance_id, turn::bigint as turn, who, string_agg(text, chr(10) || chr(10) order by idx) as text from n group by 1, 2, 3)"""


def _merged(s: SparkSession, d: str) -> DataFrame:
    who = F.when(F.col("role") == "assistant", "gpt").otherwise("human")
    return turns.merge_speakers(_log(s, d).withColumn("who", who), ["instance_id"])


@REG.add("chat_turn_merge", f"with {TURNS_SQL} select instance_id, turn, who, length(text) as chars, sha1(text) as print from merged")
def chat_turn_merge(s: SparkSession, d: str) -> DataFrame:
    """Consecutive messages of one speaker as one turn."""
    return _merged(s, d).select("instance_id", "turn", "who", F.length("text").cast("bigint").alias("chars"), F.sha1(F.col("text").cast("binary")).alias("print"))


@REG.add(
    "chat_trim",
    f"""with {TURNS_SQL}, e as (select *, min(case when who = 'human' then turn end) over (partition by instance_id) as a, max(case when who = 'gpt' then turn end) over (partition by instance_id) as z from merged),
    k as (select *, count(*) over (partition by instance_id) as n from e where turn between a and z) select instance_id, count(*) as turns, min(turn) as first_turn, max(turn) as last_turn from k where n >= 2 group by 1""",
)
def chat_trim(s: SparkSession, d: str) -> DataFrame:
    """Conversations from the first human to the last model turn."""
    return turns.trim_ends(_merged(s, d), ["instance_id"]).groupBy("instance_id").agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@REG.add(
    "context_before_statement",
    f"""with {LOG}, n as (select *, row_number() over (partition by instance_id order by idx) - 1 as i, count(*) over (partition by instance_id) as size from log),
    b as (select instance_id, case when try_cast(instance_id as int) % 2 = 0 then 10 else 1000000 end as ref, 'the h1 of it' as hyp from (select distinct instance_id from log)),
    j as (select n.*, b.ref, coalesce(case when ref >= 0 and ref < size then ref end, min(case when role = 'assistant' and contains(lower(text), hyp) then i end) over (partition by n.instance_id)) as bound from n join b using (instance_id))
    select instance_id, count(*) as messages, max(i) as last from j where i < bound group by 1""",
)
def context_before_statement(s: SparkSession, d: str) -> DataFrame:
    """How many messages stand before a node's statement, by its place or by its text."""
    log = _log(s, d).withColumn("i", (F.row_number().over(W.partitionBy("instance_id").orderBy("idx")) - 1).cast("bigint"))
    ids = log.select("instance_id").distinct()
    bounds = ids.withColumn("raw_ref", F.when(F.expr("try_cast(instance_id as int)") % 2 == 0, 10).otherwise(1_000_000)).withColumn("hyp", F.lit("the h1 of it"))
    return turns.up_to(log, ["instance_id"], bounds, order="i").groupBy("instance_id").agg(F.count("*").alias("messages"), F.max("i").alias("last"))


@REG.add(
    "masked_context_budget",
    f"""with {LOG}, p as (select instance_id, idx, {MASK_SQL} as text, row_number() over (partition by instance_id order by idx) as i, count(*) over (partition by instance_id) as n from log),
    t as (select *, sum(length(text)) over (partition by instance_id) + 2 * (n - 1) as total, sum(case when i > 2 then length(text) else 0 end) over (partition by instance_id order by i desc) as back,
      least(sum(case when i <= 2 then length(text) end) over (partition by instance_id) + 2 * (least(n, 2) - 1), 600) as head from p),
    k as (select *, case when total <= 600 then 'all' when i <= 2 then 'head' when head + back <= 600 then 'tail' when i = n then 'cut' end as place from t)
    select instance_id, place, count(*) as n, min(idx) as first, max(idx) as last from k where place is not null group by 1, 2""",
)
def masked_context_budget(s: SparkSession, d: str) -> DataFrame:
    """The first two and the newest parts of each masked log within 600 characters."""
    parts = _log(s, d).select("instance_id", "idx", T.mask_feedback("text", MASKED).alias("text"))
    got = turns.head_and_recent(parts, ["instance_id"], 600)
    return got.groupBy("instance_id", "place").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"))


@REG.add("context_fit")
def context_fit(s: SparkSession, d: str) -> DataFrame:
    """Merged conversations squeezed into a window by halving observations."""
    talks = _merged(s, d).groupBy("instance_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "who", "text"))), lambda t: F.struct(t["who"].alias("who"), t["text"].alias("text"))).alias("turns"))
    return turns.fit_conversations(talks, "turns", 12_000).select("instance_id", F.size("turns").alias("n"), F.aggregate("turns", F.lit(0), lambda a, t: a + F.length(t["text"])).alias("chars"))


# ---- leaks, anchors and rewrites ------------------------------------------------------------------------------------

TOKENS_SQL = """tokens as (select instance_id, list_sort(list_distinct(flatten(list_transform(string_split(replace(replace(fail_to_pass, '''', ''), '"', ''), ','), lambda x: regexp_extract_all(list_extract(string_split(x, '::'), -1), '\\btest_[A-Za-z0-9_]{3,}\\b'))))) as tokens from instances)"""


def _tokens(s: SparkSession, d: str) -> DataFrame:
    return _instances(s, d).select("instance_id", T.test_tokens(T.literal_list("fail_to_pass")).alias("tokens"))


@REG.add("hidden_test_tokens", f"with {TOKENS_SQL} select instance_id, len(tokens) as n, array_to_string(tokens, ' ') as tokens from tokens")
def hidden_test_tokens(s: SparkSession, d: str) -> DataFrame:
    """Tokens of hidden tests of each instance."""
    return _tokens(s, d).select("instance_id", F.size("tokens").cast("bigint").alias("n"), F.array_join(F.array_sort("tokens"), " ").alias("tokens"))


SEGMENTS_SQL = r"""segs as (select instance_id, flatten(list_transform(string_split(replace(replace(fail_to_pass, '''', ''), '"', ''), ','), lambda x: regexp_extract_all(list_extract(string_split(x, '::'), -1), '\btest_[A-Za-z0-9_]{3,}\b'))) as s from instances where fail_to_pass is not null),
camels as (select *, list_filter(list_transform(s, lambda x: 'Test' || upper(substr(x, 6, 1)) || substr(x, 7)), lambda x: regexp_full_match(x, 'Test[A-Z][A-Za-z0-9_]{2,}')) as c, list_filter(list_transform(s, lambda x: 'it ' || replace(x, '_', ' ')), lambda x: length(x) >= 15) as t from segs)"""


@REG.add("hidden_test_kinds", f"with {SEGMENTS_SQL} select instance_id, array_to_string(list_sort(list_distinct(list_concat(list_concat(s, c), t))), '|') as tokens from camels")
def hidden_test_kinds(s: SparkSession, d: str) -> DataFrame:
    """Tokens of hidden tests told as functions, as classes and as titles."""
    names = T.literal_list("fail_to_pass")
    part = F.transform(names, lambda n: F.element_at(F.split(n, "::"), -1))
    camel = F.transform(part, lambda n: F.concat(F.lit("x::Test"), F.upper(F.substring(n, 6, 1)), F.substr(n, F.lit(7))))
    title = F.transform(part, lambda n: F.concat(F.lit("x::it "), F.replace(n, F.lit("_"), F.lit(" "))))
    tokens = T.test_tokens(F.concat(names, camel, title))
    return _instances(s, d).filter("fail_to_pass is not null").select("instance_id", F.array_join(F.array_sort(tokens), "|").alias("tokens"))


@REG.add(
    "token_leak_hits",
    f"""with {TOKENS_SQL}, t as (select instance_id, unnest(tokens) as tok from tokens)
    select p.pair_id, count(*) as hits from preference_pairs p join t on t.instance_id = p.instance_id
    where regexp_matches(concat_ws(chr(10), p.prompt, p.chosen, p.rejected), '\\b' || substr(t.tok, 6) || '\\b') group by 1""",
)
def token_leak_hits(s: SparkSession, d: str) -> DataFrame:
    """Pairs that name what a hidden test of their instance is called after."""
    names = _tokens(s, d).withColumn("tokens", F.transform("tokens", lambda t: F.substr(t, F.lit(6))))
    blob = F.concat_ws("\n", "prompt", "chosen", "rejected")
    # hot instances are the pairs' side; the tokens are a dimension
    got = _pairs(s, d).join(names, "instance_id").select("pair_id", F.size(T.leaked_tokens(blob, F.col("tokens"))).cast("bigint").alias("hits"))
    return got.filter("hits > 0")


@REG.add("redacted_text")
def redacted_text(s: SparkSession, d: str) -> DataFrame:
    """Pairs with the names of their hidden tests replaced, and how often."""
    names = _tokens(s, d).withColumn("tokens", F.transform("tokens", lambda t: F.substr(t, F.lit(6))))
    return _pairs(s, d).join(names, "instance_id").select("pair_id", T.redact(F.col("prompt"), F.col("tokens")).alias("prompt"), T.redactions(F.col("prompt"), F.col("tokens")).alias("n"))


ANCHOR_SQL = "list_distinct(list_concat(list_concat(list_filter(list_transform(regexp_extract_all({x}, '`([^`\\n]{{2,80}})`', 1), lambda a: trim(a)), lambda a: length(a) >= 3), regexp_extract_all({x}, '\\b[\\w./\\\\-]*\\w\\.(?:py|go|js|ts|tsx|jsx|c|h|cpp|rb|java)\\b')), list_concat(list_filter(regexp_extract_all({x}, '\\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\\b'), lambda a: length(a) >= 6 and a not in ('fail_to_pass', 'pass_to_pass', 'self_rescue', 'why_proposed')), list_filter(regexp_extract_all({x}, '\\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\\b'), lambda a: length(a) >= 6))))"


@REG.add("anchors", f"select pair_id, len({ANCHOR_SQL.format(x='chosen')}) as n, array_to_string(list_sort({ANCHOR_SQL.format(x='chosen')}), ' ') as anchors from preference_pairs")
def anchors(s: SparkSession, d: str) -> DataFrame:
    """Concrete code in chosen answers."""
    return _pairs(s, d).withColumn("a", T.anchors("chosen")).select("pair_id", F.size("a").cast("bigint").alias("n"), F.array_join(F.array_sort("a"), " ").alias("anchors"))


@REG.add(
    "grounded_flag",
    f"with a as (select pair_type, prompt, {ANCHOR_SQL.format(x='rejected')} as names from preference_pairs) select pair_type, count(*) as n, count(*) filter (where len(names) = 0 or len(list_filter(names, lambda x: contains(prompt, x))) * 2 >= len(names)) as grounded from a group by 1",
)
def grounded_flag(s: SparkSession, d: str) -> DataFrame:
    """Rejected answers at least half of whose code occurs in the prompt."""
    return _pairs(s, d).groupBy("pair_type").agg(F.count("*").alias("n"), F.count_if(T.is_grounded("rejected", F.col("prompt"))).alias("grounded"))


@REG.add("phrase_rewrite")
def phrase_rewrite(s: SparkSession, d: str) -> DataFrame:
    """Answers in neutral wording, where it changes them."""
    answer = F.try_element_at("messages", F.lit(-1))["content"]
    return _samples(s, d).select("sample_id", answer.alias("before"), T.rewrite_phrases(answer).alias("after")).filter(~F.col("before").eqNullSafe(F.col("after")))


@REG.add("neutral_words", "with t as (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\bredirected\\b', 'turned', 'gi'), '\\bredirecting\\b', 'turning', 'gi'), '\\bredirect(?:ion)?\\b', 'turn', 'gi'), '\\bthe oracle\\b', 'the analysis', 'gi'), '\\boracle\\b', 'analysis', 'gi') as t from documents) select doc_id, sha1(t) as print from t")
def neutral_words(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.sha1(T.neutral_words("text").cast("binary")).alias("print"))


@REG.add("soften_redirect")
def soften_redirect(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.sha1(T.soften_redirect("text").cast("binary")).alias("print"))


@REG.add("match_contexts")
def match_contexts(s: SparkSession, d: str) -> DataFrame:
    """What stands around line references in documents."""
    return table(s, d, "documents").select("doc_id", F.explode(context_windows(F.col("text"), r"\bline \d+\b")).alias("context"))


# ---- labels and sections --------------------------------------------------------------------------------------------

ANSWER_SQL = "answers as (select sample_id, type, list_extract(messages, -1).content as a from sft_samples)"


def _answers(s: SparkSession, d: str) -> DataFrame:
    return _samples(s, d).select("sample_id", "type", F.try_element_at("messages", F.lit(-1))["content"].alias("a"))


LABEL_ROWS_SQL = " union all ".join(f"select sample_id, '{x}' as label, instr(a, '{x}:') as pos from answers where regexp_matches(a, '(?m)^{x}:')" for x in fixed.LABELS)


@REG.add("labels_in_order", f"with {ANSWER_SQL}, f as ({LABEL_ROWS_SQL}) select sample_id, string_agg(label, ' / ' order by pos, label) as labels from f group by 1")
def labels_in_order(s: SparkSession, d: str) -> DataFrame:
    """The section labels of each answer in their order."""
    return _answers(s, d).select("sample_id", F.array_join(T.labels_in_order("a"), " / ").alias("labels")).filter("labels <> ''")


@REG.add("renamed_labels")
def renamed_labels(s: SparkSession, d: str) -> DataFrame:
    """Answers under other labels, with the note that asks for them."""
    names = fixed.SKINS["review"]
    return _answers(s, d).select("sample_id", T.rename_labels("a", names).alias("answer"), T.schema_note(T.labels_in_order("a"), names).alias("note"))


@REG.add("section_split", f"with {ANSWER_SQL} select sample_id, regexp_extract(a, '(?s)HYPOTHESIS: (.*?)(?:\\nREASONING:|\\z)', 1) as hypothesis, regexp_extract(a, '(?s)REASONING: (.*?)\\z', 1) as reasoning from answers where a is not null")
def section_split(s: SparkSession, d: str) -> DataFrame:
    """Hypothesis and reasoning of answers; the reasoning runs to the end."""
    rows = _answers(s, d).filter("a is not null")
    return rows.select("sample_id", T.section("a", "HYPOTHESIS: ", r"\nREASONING:").alias("hypothesis"), T.section("a", "REASONING: ").alias("reasoning"))


WHITE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@REG.add("one_line_hypothesis", rf"""with {ANSWER_SQL}, h as (select sample_id, a, regexp_extract(a, '(?i)HYPOTHESIS:\s*([^\n\r\x{{85}}\x{{2028}}\x{{2029}}]+)', 1) as h from answers)
    select sample_id, case when coalesce(h, '') <> '' then trim(regexp_replace(h, '{WHITE}', ' ', 'g')) else substr(trim(regexp_replace(coalesce(a, ''), '{WHITE}', ' ', 'g')), 1, 400) end as line from h""")
def one_line_hypothesis(s: SparkSession, d: str) -> DataFrame:
    """The hypothesis of each answer as one line, else the answer's beginning."""
    return _answers(s, d).select("sample_id", T.one_line_hypothesis("a").alias("line"))


@REG.add("answer_flags", f"with {ANSWER_SQL} select lower(regexp_extract(a, '(?i)VERDICT:\\s*(good|weak|wrong)', 1)) as verdict, count(*) as n, count(*) filter (where regexp_matches(a, '{fixed.DECLINES}')) as declines from answers where a is not null group by 1")
def answer_flags(s: SparkSession, d: str) -> DataFrame:
    """Answers by verdict, and those that decline to name a cause."""
    rows = _answers(s, d).filter("a is not null")
    return rows.groupBy(F.lower(F.regexp_extract("a", fixed.VERDICT, 1)).alias("verdict")).agg(F.count("*").alias("n"), F.count_if(F.col("a").rlike(fixed.DECLINES)).alias("declines"))


@REG.add("file_mentions", "with f as (select doc_id, unnest(regexp_extract_all(text, '[\\w./-]+\\.(?:py|pyx|rst|txt|cfg|ini|toml|md|ya?ml|json|c|h|cpp|js|html)\\b')) as file from documents where text is not null) select file, count(*) as n from f group by 1")
def file_mentions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.explode(T.file_names("text")).alias("file")).groupBy("file").agg(F.count("*").alias("n"))


@REG.add("middle_cut", "select doc_id, case when length(text) <= 1000 then text else substr(text, 1, 500) || chr(10) || '... [output truncated] ...' || chr(10) || substr(text, -500) end as text from documents")
def middle_cut(s: SparkSession, d: str) -> DataFrame:
    """Long texts without their middle."""
    return table(s, d, "documents").select("doc_id", T.middle_cut("text", 1000).alias("text"))


@REG.add("literal_lists", "select instance_id, case when fail_to_pass = '[]' or fail_to_pass is null or fail_to_pass = '' then 0 else len(string_split(fail_to_pass, ',')) end as n from instances")
def literal_lists(s: SparkSession, d: str) -> DataFrame:
    """How many tests a JSON or Python list holds."""
    return _instances(s, d).select("instance_id", F.size(T.literal_list("fail_to_pass")).cast("bigint").alias("n"))


# ---- preparing pairs ------------------------------------------------------------------------------------------------

PREP_SQL = f"""early as (select p.*, case when exists (select 1 from instances i where i.instance_id = p.instance_id and {sha_sql('i.instance_id', 100)} >= 90) then 'wall' when protocol = 'raw_leak' then 'raw_leak' when run_id = 'tb1' then 'run' end as e,
   sha1(concat_ws(chr(31), coalesce(prompt, ''), coalesce(chosen, ''), coalesce(rejected, ''))) as k, (length(prompt) + length(chosen) + length(rejected)) / 3.5 as tokens from preference_pairs p),
firsts as (select k, min(pair_id) as first from early where e is null group by 1),
chain as (select early.*, coalesce(e, case when pair_id > first then 'dup' end, case when tokens > 750 then 'length' end) as reason from early left join firsts using (k))"""


def _chain(s: SparkSession, d: str) -> DataFrame:
    """Pairs with the first reason to drop them: run, wall and protocol, then repeats, then length."""
    held = _instances(s, d).filter(sha_mod(F.col("instance_id"), 100) >= 90).select("instance_id", F.lit(True).alias("held"))
    rows = _pairs(s, d).join(held, "instance_id", "left")
    early = [("wall", F.col("held")), ("raw_leak", F.col("protocol") == "raw_leak"), ("run", F.col("run_id") == "tb1")]
    long = T.token_estimate("prompt", "chosen", "rejected") > 750
    return prep.drop_chain(rows, "pair_id", early, prep.content_print("prompt", "chosen", "rejected"), [("length", long)])


@REG.add("pair_filter_reasons", f"with {PREP_SQL} select coalesce(reason, 'kept') as reason, count(*) as n from chain group by 1 union all select 'read', count(*) from chain")
def pair_filter_reasons(s: SparkSession, d: str) -> DataFrame:
    """How many pairs each filter drops, in order."""
    return prep.accounting(_chain(s, d).select("reason"))


@REG.add("pair_dedup", "select pair_id from preference_pairs qualify row_number() over (partition by sha1(concat_ws(chr(31), coalesce(prompt, ''), coalesce(chosen, ''), coalesce(rejected, ''))) order by pair_id) = 1")
def pair_dedup(s: SparkSession, d: str) -> DataFrame:
    """The first of each exactly repeated pair."""
    rows = _pairs(s, d).withColumn("k", prep.content_print("prompt", "chosen", "rejected")).groupBy("k").agg(F.min("pair_id").alias("pair_id"))
    return rows.select("pair_id")


@REG.add("prefix_dedup", "select pair_type, min(pair_id) as pair_id, count(*) as n from preference_pairs group by pair_type, substr(chosen, 1, 200), substr(rejected, 1, 200)")
def prefix_dedup(s: SparkSession, d: str) -> DataFrame:
    """Pairs of a type with the same beginnings, the first of each."""
    return _pairs(s, d).groupBy("pair_type", F.substring("chosen", 1, 200), F.substring("rejected", 1, 200)).agg(F.min("pair_id").alias("pair_id"), F.count("*").alias("n")).select("pair_type", "pair_id", "n")


@REG.add(
    "pair_prep_kept",
    f"""with {PREP_SQL}, r as (select *, row_number() over (partition by instance_id order by (strength = 'verified') is not true, sha1('42|' || pair_id), pair_id) as r from chain where reason is null and instance_id is not null)
    select pair_type, coalesce(strength, 'none') as strength, count(*) as n, sum(pair_id)::bigint as ids from r where r <= 16 group by 1, 2""",
)
def pair_prep_kept(s: SparkSession, d: str) -> DataFrame:
    """What a training set keeps: filtered, and at most 16 pairs of an instance, verified ones first."""
    kept = _chain(s, d).filter("reason is null and instance_id is not null").select("pair_id", "instance_id", "pair_type", "strength")
    rest = F.coalesce(F.col("strength") == "verified", F.lit(False))
    top = prep.capped(kept, "instance_id", 16, "42", "pair_id", [(~rest)])
    return top.groupBy("pair_type", F.coalesce("strength", F.lit("none")).alias("strength")).agg(F.count("*").alias("n"), F.sum("pair_id").alias("ids"))


# ---- pairs from candidates ------------------------------------------------------------------------------------------


def _by_node(df: DataFrame) -> DataFrame:
    return df.groupBy("node_id").agg(F.count("*").alias("pairs"))


@REG.add("sibling_pairs", f"with {CANDS} select a.node_id, count(*) as pairs from cands a join cands b on a.node_id = b.node_id and a.label = 'correct' and b.label = 'wrong' and lower(a.text) <> lower(b.text) group by 1")
def sibling_pairs(s: SparkSession, d: str) -> DataFrame:
    """Correct against wrong candidates of a node."""
    return _by_node(pairs.sibling_pairs(_cands(s, d).select("node_id", "cand_idx", "label", "text")))


RANK_SQL = "case {x} when 'correct' then 2 when 'partial' then 1 else 0 end"


@REG.add("anchor_pairs", f"with {CANDS}, real as (select * from cands where cand_idx = 1) select a.node_id, count(*) as pairs from real a join cands b on a.node_id = b.node_id and {RANK_SQL.format(x='b.label')} < {RANK_SQL.format(x='a.label')} and a.text <> b.text group by 1")
def anchor_pairs(s: SparkSession, d: str) -> DataFrame:
    """A node's first candidate against those on a lower step."""
    c = _cands(s, d).select("node_id", "cand_idx", "label", "text")
    return _by_node(pairs.worse_than_anchor(c, c.filter("cand_idx = 1")))


@REG.add(
    "rank_gap_pairs",
    f"""with {CANDS}, r as (select node_id, cand_idx, label, text, (cand_idx * 7) % 5 as rank, case label when 'correct' then 2 when 'partial' then 1 when 'wrong' then 0 end as step from cands),
    p as (select a.node_id, a.cand_idx as cand_idx_a, b.cand_idx as cand_idx_b, b.rank - a.rank as gap from r a join r b on a.node_id = b.node_id and b.rank > a.rank and coalesce(b.step > a.step, false) = false and a.text <> b.text)
    select node_id, cand_idx_a, cand_idx_b, gap from (select *, row_number() over (partition by node_id order by gap desc, sha1('g|' || cand_idx_a || '|' || cand_idx_b)) as r from p) where r <= 4""",
)
def rank_gap_pairs(s: SparkSession, d: str) -> DataFrame:
    """The four widest rank gaps of a node that labels don't contradict, seeded order on ties."""
    c = _cands(s, d).select("node_id", "cand_idx", "label", "text", ((F.col("cand_idx") * 7) % 5).alias("rank"))
    got = pairs.rank_gap_pairs(c).select("node_id", "cand_idx_a", "cand_idx_b", "gap")
    w = W.partitionBy("node_id").orderBy(F.col("gap").desc(), hash_order("g", F.col("cand_idx_a"), F.col("cand_idx_b")))
    return got.withColumn("r", F.row_number().over(w)).filter("r <= 4").drop("r")


@REG.add("not_worse_pairs", f"with {CANDS}, tier as (select node_id, text, case when score > 15 then 'above' when score > 8 then 'par' else 'below' end as tier from cands), ok as (select distinct node_id, text from tier where tier in ('par', 'above')), real as (select * from cands where cand_idx = 1) select a.node_id, count(*) as pairs from real a join cands b on a.node_id = b.node_id and {RANK_SQL.format(x='b.label')} < {RANK_SQL.format(x='a.label')} and a.text <> b.text where not exists (select 1 from ok where ok.node_id = b.node_id and ok.text = b.text) group by 1")
def not_worse_pairs(s: SparkSession, d: str) -> DataFrame:
    """As anchor_pairs, without candidates that a judge puts on par or above."""
    c = _cands(s, d)
    tier = F.when(F.col("score") > 15, "above").when(F.col("score") > 8, "par").otherwise("below")
    judged = c.withColumn("tier", tier).groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("tier", "cand_idx"))).alias("x"))
    judged = judged.select("node_id", F.transform("x", lambda t: F.array(t["cand_idx"].cast("int"))).alias("groups"), F.transform("x", lambda t: t["tier"]).alias("tiers"))
    c = c.select("node_id", F.col("cand_idx").cast("int").alias("cand_idx"), "label", "text")
    return _by_node(pairs.worse_than_anchor(c, c.filter("cand_idx = 1"), not_worse=pairs.not_worse(judged, c)))


@REG.add("mixed_nodes", f"with {CANDS} select node_id from cands group by 1 having bool_or(label = 'correct') and bool_or(label = 'wrong')")
def mixed_nodes(s: SparkSession, d: str) -> DataFrame:
    return metrics.mixed(_cands(s, d))


@REG.add("node_labels_summary", f"with {CANDS} select node_id, count(*) as k, round(avg((label = 'correct' and label is not null)::int), 6) as frac_right, min_by(coalesce(label = 'correct', false)::int, cand_idx) as first_right, max_by(coalesce(label = 'correct', false)::int, score * 1000000 - cand_idx) as picked_right from cands group by 1".replace("label = 'correct' and label is not null", "coalesce(label = 'correct', false)"))
def node_labels_summary(s: SparkSession, d: str) -> DataFrame:
    """Each node's share of correct candidates, its first and its best-scored one."""
    return metrics.node_summary(_cands(s, d).withColumn("right", F.coalesce(F.col("label") == "correct", F.lit(False))))


@REG.add(
    "bon_curve",
    f"""with {CANDS}, r as (select node_id, coalesce(label = 'correct', false)::int as y, row_number() over (partition by node_id order by score desc, cand_idx) - 1 as r, count(*) over (partition by node_id) as k from cands),
    x as (select r.*, n.n from r, range(1, 9) n(n) where k >= n.n),
    f as (select node_id, n, y * (case when k - 1 - r < n - 1 then 0.0 else (factorial((k - 1 - r)::int)::double / factorial((k - r - n)::int)::double / factorial((n - 1)::int)::double) / (factorial(k::int)::double / factorial((k - n)::int)::double / factorial(n::int)::double) end) as p from x),
    g as (select n, node_id, sum(p) as p from f group by 1, 2)
    select n::int as n, count(*) as nodes, round(avg(p), 6) as accuracy from g group by 1""",
)
def bon_curve(s: SparkSession, d: str) -> DataFrame:
    """How often the best-scored of n random candidates is correct."""
    return metrics.best_of_n(_cands(s, d).withColumn("right", F.coalesce(F.col("label") == "correct", F.lit(False))))


@REG.add("label_signatures", f"with {CANDS}, s as (select node_id, string_agg(distinct label, '/' order by label) as signature from cands where label is not null group by 1) select signature, count(*) as n from s group by 1")
def label_signatures(s: SparkSession, d: str) -> DataFrame:
    """Which labels nodes hold."""
    per = _cands(s, d).filter("label is not null").groupBy("node_id").agg(metrics.signature(F.collect_set("label")).alias("signature"))
    return per.groupBy("signature").agg(F.count("*").alias("n"))


# ---- metrics --------------------------------------------------------------------------------------------------------

DIMS = ("pair_type", "protocol", "rejected_source")


@REG.add("slice_accuracy", " union all ".join(f"select '{x}' as dim, coalesce({x}, 'none') as value, count(*) as n, round(avg((length(chosen) > length(rejected))::int), 6) as acc from preference_pairs group by 2" for x in DIMS))
def slice_accuracy(s: SparkSession, d: str) -> DataFrame:
    """A flag's rate in each slice of three dimensions."""
    return metrics.slices(_pairs(s, d), DIMS, F.length("chosen") > F.length("rejected"))


@REG.add("length_bias", "select pair_type, count(*) as n, round(avg(case when length(rejected) > length(chosen) then chosen_grounded::int end), 6) as acc_rejected_longer, round(avg(case when length(chosen) > length(rejected) then chosen_grounded::int end), 6) as acc_chosen_longer from preference_pairs group by 1")
def length_bias(s: SparkSession, d: str) -> DataFrame:
    """A flag's rate by which side is longer."""
    longer = F.length("rejected") > F.length("chosen")
    shorter = F.length("chosen") > F.length("rejected")
    flag = F.col("chosen_grounded").cast("int")
    return _pairs(s, d).groupBy("pair_type").agg(F.count("*").alias("n"), metrics.rate(flag, longer).alias("acc_rejected_longer"), metrics.rate(flag, shorter).alias("acc_chosen_longer"))


@REG.add("pearson", "select source, case when count(n_chars) < 3 then 0.0 else round(coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0), 6) end as r from (select source, n_chars, n_chars::double as x, case when n_chars is not null then (doc_id % 100)::double end as y from documents) group by 1")
def pearson(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("source", F.col("n_chars").cast("double").alias("x"), (F.col("doc_id") % 100).cast("double").alias("y"))
    return docs.groupBy("source").agg(metrics.pearson("x", "y").alias("r"))


@REG.add("two_arm_metrics", "with o as (select task, 'base' as arm, input as value, expected from eval_items union all select task, 'sft', expected, expected from eval_items) select arm, task, count(*) as n, count(value) as given, round(avg(case when expected is not null then (value = expected)::int end), 6) as agree from o group by 1, 2")
def two_arm_metrics(s: SparkSession, d: str) -> DataFrame:
    """Two outputs of an item as rows of two arms, and how often they agree with what is expected."""
    items = table(s, d, "eval_items").select("task", "item_no", "expected", F.col("input").alias("output_base"), F.col("expected").alias("output_sft"))
    rows = metrics.two_arms(items, ["task", "item_no", "expected"], {"output_base": "base", "output_sft": "sft"})
    return rows.groupBy("arm", "task").agg(F.count("*").alias("n"), F.count("value").alias("given"), metrics.rate((F.col("value") == F.col("expected")).cast("int"), F.col("expected").isNotNull()).alias("agree"))


@REG.add("rollout_rates", "select run_id, count(*) as n, round(avg((len(evals) > 0 and list_extract(evals, -1).resolved is true)::int), 6) as resolve_rate, round(avg(n_messages), 6) as mean_messages, round(sum(unchanged_resubmits)::double / nullif(sum(retries_used), 0), 6) as thrash from outcomes group by 1")
def rollout_rates(s: SparkSession, d: str) -> DataFrame:
    """Behaviour of runs: quotients of sums, null for empty denominators."""
    last = F.coalesce(F.try_element_at("evals", F.lit(-1))["resolved"], F.lit(False)).cast("int")
    return table(s, d, "outcomes").groupBy("run_id").agg(
        F.count("*").alias("n"), metrics.rate(last).alias("resolve_rate"), F.round(F.avg("n_messages"), 6).alias("mean_messages"), metrics.ratio(F.col("unchanged_resubmits"), F.col("retries_used")).alias("thrash")
    )


@REG.add(
    "before_first_submit",
    f"with {LOG}, s as (select instance_id, min(idx) as at from log where event_type = 'purchase' group by 1) select l.instance_id, count(*) filter (where l.idx < s.at and event_type = 'click') as stated, count(*) filter (where l.idx > s.at and event_type = 'error') as failed_after from log l join s using (instance_id) group by 1",
)
def before_first_submit(s: SparkSession, d: str) -> DataFrame:
    """What stands before and after each log's first submission."""
    log = _log(s, d)
    return log.join(joins.in_order(log, "instance_id", F.when(F.col("event_type") == "purchase", F.col("idx"))).filter("at is not null"), "instance_id").groupBy("instance_id").agg(F.count_if((F.col("idx") < F.col("at")) & (F.col("event_type") == "click")).alias("stated"), F.count_if((F.col("idx") > F.col("at")) & (F.col("event_type") == "error")).alias("failed_after"))


@REG.add("accounting_shares", "select type, coalesce(source, 'none') as source, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from sft_samples group by 1, 2")
def accounting_shares(s: SparkSession, d: str) -> DataFrame:
    return prep.shares(_samples(s, d).select("type", F.coalesce("source", F.lit("none")).alias("source")), "type", "source")


@REG.add("grouped_marginals", "select coalesce(source, 'none') as source, type, count(*) as n from sft_samples group by 1, 2 union all select 'all', type, count(*) from sft_samples group by type")
def grouped_marginals(s: SparkSession, d: str) -> DataFrame:
    return metrics.marginals(_samples(s, d), "source", "type")


@REG.add("margin_quantiles", "with v as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null) select event_type, round(avg(value), 4) as mean, max(value) filter (where i = floor(0.5 * n)) as median, max(value) filter (where i = floor(0.9 * n)) as p90 from v group by 1")
def margin_quantiles(s: SparkSession, d: str) -> DataFrame:
    """Mean, discrete median and ninth decile of each group."""
    rows = table(s, d, "events").select("event_type", "value").filter("value is not null")
    got = rows.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean"))
    for q, name in ((0.5, "median"), (0.9, "p90")):
        got = got.join(metrics.quantile_at(rows, ["event_type"], "value", q, name), "event_type")
    return got


@REG.add("score_spread", "select count(*) as n, max(greatest(length(chosen), length(rejected))) - min(least(length(chosen), length(rejected))) as spread from preference_pairs")
def score_spread(s: SparkSession, d: str) -> DataFrame:
    """Whether scores differ at all."""
    rows = _pairs(s, d).select(F.length("chosen").cast("bigint").alias("a"), F.length("rejected").cast("bigint").alias("b"))
    return rows.agg(F.count("*").alias("n"), metrics.spread("a", "b").alias("spread"))


@REG.add("bootstrap_ci")
def bootstrap_ci(s: SparkSession, d: str) -> DataFrame:
    """Intervals of a flag's rate in each pair type."""
    return metrics.bootstrap(_pairs(s, d).select("pair_type", F.col("chosen_grounded").cast("int").alias("y")), "y", ["pair_type"])


@REG.add("similar_adjacent")
def similar_adjacent(s: SparkSession, d: str) -> DataFrame:
    """How alike each card's hypothesis is to the one before."""
    c = ledger.cards(_opened(s, d), ["instance_id"])
    c = c.withColumn("before", F.lag("hyp").over(W.partitionBy("instance_id").orderBy("card"))).filter("before is not null")
    return c.groupBy("instance_id").agg(F.count("*").alias("n"), F.round(F.avg(similarity("before", "hyp")), 6).alias("similarity"))


@REG.add("connectives", "select sample_id, round(len(regexp_extract_all(lower(a), '\\b(?:because|since|therefore|hence|so that|which means)\\b')) * 100.0 / greatest(len(regexp_extract_all(a, '\\S+')), 1), 6) as per_100 from (select sample_id, list_extract(messages, -1).content as a from sft_samples) where a is not null")
def connectives(s: SparkSession, d: str) -> DataFrame:
    """Connectives in a hundred words of an answer."""
    rows = _answers(s, d).filter("a is not null")
    words = F.greatest(F.regexp_count("a", F.lit(r"\S+")), F.lit(1))
    return rows.select("sample_id", F.round(F.regexp_count(F.lower("a"), F.lit(r"\b(?:because|since|therefore|hence|so that|which means)\b")) * 100.0 / words, 6).alias("per_100"))


# ---- streaks and histograms -----------------------------------------------------------------------------------------


@REG.add(
    "failure_streaks",
    f"with {LOG}, i as (select *, sum((event_type <> 'error')::int) over (partition by instance_id order by idx) as isle from log), k as (select instance_id, isle, count(*) filter (where event_type = 'error') as run from i group by 1, 2) select instance_id, max(run) as longest, count(*) filter (where run >= 3) as runs from k group by 1",
)
def failure_streaks(s: SparkSession, d: str) -> DataFrame:
    """The longest row of failures, and how many reach three."""
    got = streaks.streaks(_log(s, d), ["instance_id"], "idx", F.col("event_type") == "error")
    return got.groupBy("instance_id").agg(F.max("streak").alias("longest"), F.count_if(F.col("streak") == 3).alias("runs"))


@REG.add(
    "unchanged_streaks",
    f"with {LOG}, c as (select *, coalesce(event_type = lag(event_type) over (partition by instance_id order by idx), false) as same from log), i as (select *, sum((not same)::int) over (partition by instance_id order by idx) as isle from c), k as (select instance_id, isle, count(*) filter (where same) as run from i group by 1, 2) select instance_id, max(run) as stuck from k group by 1",
)
def unchanged_streaks(s: SparkSession, d: str) -> DataFrame:
    """How often in a row a state came back unchanged."""
    return streaks.unchanged(_log(s, d), ["instance_id"], "idx", "event_type").groupBy("instance_id").agg(F.max("unchanged").alias("stuck"))


EPOCH_SQL = f"""{LOG}, e as (select *, sum((event_type = 'error')::int) over (partition by instance_id order by idx) as epoch from log),
f as (select *, min(case when event_type = 'signup' then idx end) over (partition by instance_id, epoch) as stop from e where epoch > 0),
g as (select instance_id, epoch, count(*) filter (where event_type = 'view' and idx < stop) as n from f where stop is not null group by 1, 2)"""


@REG.add("explore_histogram", f"with {EPOCH_SQL} select least(n, 5) as reads, count(*) as n from g group by 1")
def explore_histogram(s: SparkSession, d: str) -> DataFrame:
    """Reads between a feedback and the next edit, five and more as one."""
    kind = F.col("event_type")
    got = streaks.between(_log(s, d), ["instance_id"], "idx", kind == "error", kind == "signup", kind == "view")
    return got.groupBy(F.least("n", F.lit(5)).alias("reads")).agg(F.count("*").alias("n"))


@REG.add("oracle_depth", f"with {LOG}, d as (select *, sum(contains(text, 'guidance round')::int) over (partition by instance_id order by idx) as depth from log) select least(depth, 9)::bigint as depth, count(*) as n, round(avg((event_type = 'click')::int), 6) as rate from d group by 1")
def oracle_depth(s: SparkSession, d: str) -> DataFrame:
    """A rate by how many rounds of guidance came so far."""
    got = streaks.running_count(_log(s, d), ["instance_id"], "idx", F.contains("text", F.lit("guidance round")), "depth")
    return got.groupBy(F.least("depth", F.lit(9)).alias("depth")).agg(F.count("*").alias("n"), metrics.rate(F.col("event_type") == "click").alias("rate"))


@REG.add(
    "stage_labels",
    f"with {LOG}, d as (select *, coalesce(sum(contains(text, 'guidance round')::int) over p, 0) as told, coalesce(sum((event_type = 'error')::int) over p, 0) as seen from log window p as (partition by instance_id order by idx rows between unbounded preceding and 1 preceding)) select case when told > 0 then 'oracle_' || told when seen > 0 then 'self_rescue' else 'first' end as stage, count(*) as n from d group by 1",
)
def stage_labels(s: SparkSession, d: str) -> DataFrame:
    """Rows by what feedback came before them."""
    got = streaks.stages(_log(s, d), ["instance_id"], "idx", F.col("event_type") == "error", F.contains("text", F.lit("guidance round")))
    return got.groupBy("stage").agg(F.count("*").alias("n"))


# ---- patches and intervals ------------------------------------------------------------------------------------------

HUNK_SQL = """lines as (select instance_id, unnest(string_split(patch, chr(10))) as line, generate_subscripts(string_split(patch, chr(10)), 1) as pos from instances where patch is not null),
files as (select *, last_value(case when starts_with(line, '+++ b/') then trim(substr(line, 7)) end ignore nulls) over (partition by instance_id order by pos) as file from lines),
hunks as (select instance_id, file, regexp_extract(line, '^@@ -(\\d+)', 1)::bigint as start, regexp_extract(line, '^@@ -(\\d+)', 1)::bigint + greatest(coalesce(nullif(regexp_extract(line, '^@@ -\\d+,(\\d+)', 1), '')::bigint, 1), 1) as "end" from files where regexp_matches(line, '^@@ -\\d+') and file is not null)"""


@REG.add("patch_hunks", f'with {HUNK_SQL} select instance_id, file, start, "end" from hunks')
def patch_hunks(s: SparkSession, d: str) -> DataFrame:
    """Old line ranges that a patch changes."""
    return intervals.hunks(_instances(s, d), ["instance_id"], "patch").drop("at")


@REG.add(
    "interval_merge",
    f"""with {HUNK_SQL}, w as (select instance_id, file, greatest(start - 18, 1) as s, "end" + 18 as e from hunks),
    m as (select *, max(e) over (partition by instance_id, file order by s, e rows between unbounded preceding and 1 preceding) as far from w),
    i as (select *, sum((far is null or s > far + 1)::int) over (partition by instance_id, file order by s, e rows unbounded preceding) as isle from m)
    select instance_id, file, min(s) as start, max(e) as "end" from i group by instance_id, file, isle""",
)
def interval_merge(s: SparkSession, d: str) -> DataFrame:
    """Those ranges widened by 18 lines and merged."""
    return intervals.merged(intervals.hunks(_instances(s, d), ["instance_id"], "patch"), ["instance_id", "file"], widen=18)


@REG.add(
    "order_line_islands",
    """with r as (select l_suppkey, l_linenumber + (l_partkey % 40) * 3 as s, l_linenumber + (l_partkey % 40) * 3 + 1 as e from lineitem),
    m as (select *, max(e) over (partition by l_suppkey order by s, e rows between unbounded preceding and 1 preceding) as far from r),
    i as (select *, sum((far is null or s > far + 1)::int) over (partition by l_suppkey order by s, e rows unbounded preceding) as isle from m)
    select l_suppkey, min(s) as start, max(e) as "end" from i group by l_suppkey, isle""",
)
def order_line_islands(s: SparkSession, d: str) -> DataFrame:
    """Interval merging at volume."""
    rows = table(s, d, "lineitem").select("l_suppkey", (F.col("l_linenumber") + (F.col("l_partkey") % 40) * 3).alias("start"))
    return intervals.merged(rows.withColumn("end", F.col("start") + 1), ["l_suppkey"], floor=0)


@REG.add(
    "complexity_rank",
    """with p as (select instance_id, patch, case when fail_to_pass = '[]' or fail_to_pass is null or fail_to_pass = '' then 0 else len(string_split(fail_to_pass, ',')) end as tests, list_distinct(regexp_extract_all(patch, '(?m)^\\+\\+\\+ b/(.+)$', 1)) as files,
      len(list_filter(string_split(patch, chr(10)), lambda x: regexp_matches(x, '^[+-]') and not starts_with(x, '+++') and not starts_with(x, '---'))) as lines from instances where patch is not null)
    select instance_id, (least(len(list_filter(files, lambda f: not contains(f, '/test') and not starts_with(list_extract(string_split(f, '/'), -1), 'test'))), 5) * 15 + least(lines, 100) + least(tests, 4) * 3)::int as score from p""",
)
def complexity_rank(s: SparkSession, d: str) -> DataFrame:
    """A score of difficulty from a patch."""
    rows = _instances(s, d).filter("patch is not null")
    return rows.select("instance_id", intervals.complexity(F.col("patch"), F.size(T.literal_list("fail_to_pass"))).alias("score"))


# ---- set operations and look-ups ------------------------------------------------------------------------------------


@REG.add("resume_anti_join", "select pair_type, count(*) as n from preference_pairs p where not exists (select 1 from outcomes o where o.instance_id = p.instance_id) group by 1")
def resume_anti_join(s: SparkSession, d: str) -> DataFrame:
    """Work whose key has no stored outcome."""
    return joins.beyond_wall(_pairs(s, d), table(s, d, "outcomes"), "instance_id").groupBy("pair_type").agg(F.count("*").alias("n"))


@REG.add("union_channels", "select 'pairs' as channel, count(*) as n, count(prompt) as prompts from preference_pairs union all select 'items', count(*), 0 from eval_items union all select 'samples', count(*), 0 from sft_samples")
def union_channels(s: SparkSession, d: str) -> DataFrame:
    """Tables as one with their origin; what one lacks is null."""
    parts = {"pairs": _pairs(s, d).select("instance_id", "prompt"), "items": table(s, d, "eval_items").select("instance_id"), "samples": _samples(s, d).select("instance_id")}
    return joins.tagged_union(parts).groupBy("channel").agg(F.count("*").alias("n"), F.count("prompt").alias("prompts"))


@REG.add("last_wins", "select item_id, max(item_no) as item_no, max_by(task, item_no) as task from eval_items group by 1")
def last_wins(s: SparkSession, d: str) -> DataFrame:
    """Items by id, the last built one."""
    return joins.last_wins(table(s, d, "eval_items").select("item_id", "item_no", "task"), "item_id", "item_no")


@REG.add("first_run_wins", "with e as (select instance_id, run_id, min(pair_id) as pos from preference_pairs where protocol <> 'raw_leak' and instance_id is not null group by 1, 2) select instance_id, min_by(run_id, pos) as run_id from e group by 1")
def first_run_wins(s: SparkSession, d: str) -> DataFrame:
    """Each instance's first eligible run; eligibility comes first."""
    rows = _pairs(s, d).filter("protocol <> 'raw_leak' and instance_id is not null").select("instance_id", "run_id", "pair_id")
    return joins.first_wins(rows, "instance_id", "pair_id").select("instance_id", "run_id")


@REG.add("known_instances", "select count(*) as n, count(distinct p.instance_id) as ids from preference_pairs p join instances i using (instance_id)")
def known_instances(s: SparkSession, d: str) -> DataFrame:
    """Pairs whose instance is known."""
    return joins.lookup(_pairs(s, d).select("instance_id"), _instances(s, d).select("instance_id"), "instance_id").agg(F.count("*").alias("n"), F.countDistinct("instance_id").alias("ids"))


@REG.add("set_difference", "select i.instance_id from instances i where not exists (select 1 from eval_items e where e.instance_id = i.instance_id) and not exists (select 1 from sft_samples f where f.type = 'fix' and f.instance_id = i.instance_id) and exists (select 1 from outcomes o where o.instance_id = i.instance_id)")
def set_difference(s: SparkSession, d: str) -> DataFrame:
    """Instances in no evaluation item and no fix, but with an outcome."""
    left = joins.beyond_wall(_instances(s, d).select("instance_id"), table(s, d, "eval_items"), "instance_id")
    left = joins.beyond_wall(left, _samples(s, d).filter("type = 'fix'"), "instance_id")
    return joins.wall_hits(left, table(s, d, "outcomes"), "instance_id")


@REG.add("sources_of_instance", "select instance_id, string_agg(distinct source, '/' order by source) as sources from sft_samples where source is not null and instance_id is not null group by 1")
def sources_of_instance(s: SparkSession, d: str) -> DataFrame:
    rows = _samples(s, d).filter("source is not null and instance_id is not null")
    return rows.groupBy("instance_id").agg(F.array_join(F.array_sort(F.collect_set("source")), "/").alias("sources"))


@REG.add("entry_by_number", "with e as (select instance_id, run_id, coalesce(try_cast(retries_used as int), 0) as number, row_number() over (partition by instance_id, run_id order by finished_at, n_messages) - 1 as place, outcome from outcomes where instance_id is not null), f as (select instance_id, run_id, number, min_by(place, place) as place, min_by(coalesce(outcome, 'none'), place) as outcome from e group by 1, 2, 3) select number, outcome, count(*) as n from f group by 1, 2")
def entry_by_number(s: SparkSession, d: str) -> DataFrame:
    """Entries by their number, the first one of a number."""
    rows = table(s, d, "outcomes").filter("instance_id is not null")
    place = F.row_number().over(W.partitionBy("instance_id", "run_id").orderBy("finished_at", "n_messages")) - 1
    rows = rows.select("instance_id", "run_id", F.coalesce("retries_used", F.lit(0)).alias("number"), place.alias("place"), F.coalesce("outcome", F.lit("none")).alias("outcome"))
    first = joins.first_wins(rows, ["instance_id", "run_id", "number"], "place")
    return first.groupBy("number", "outcome").agg(F.count("*").alias("n"))


@REG.add("nth_row", "select instance_id from instances order by instance_id limit 1 offset 10")
def nth_row(s: SparkSession, d: str) -> DataFrame:
    """The eleventh instance in order (a selection by place)."""
    return _instances(s, d).select("instance_id").orderBy("instance_id").offset(10).limit(1)


@REG.add("refuted_match", "with r as (select instance_id, unnest(refuted_hypotheses) as r from outcomes), n as (select instance_id, lower(trim(regexp_replace(upper(substr(r, 1, 70)), '\\s+', ' ', 'g'))) as r from r), o as (select instance_id, lower(trim(regexp_replace(r, '\\s+', ' ', 'g'))) as c from r) select distinct o.instance_id, o.c as said from o join n using (instance_id) where o.c <> '' and (o.c = n.r or (least(length(o.c), length(n.r)) >= 60 and (starts_with(o.c, n.r) or starts_with(n.r, o.c))))")
def refuted_match(s: SparkSession, d: str) -> DataFrame:
    """Hypotheses that were refuted on their instance, as a list of shortened ones in capitals tells."""
    said = table(s, d, "outcomes").select("instance_id", F.explode("refuted_hypotheses").alias("said"))
    told = said.select("instance_id", F.upper(F.substring("said", 1, 70)).alias("r"))
    both = said.join(told, "instance_id").filter(T.same_or_cut(F.col("said"), F.col("r"), 60))
    return both.select("instance_id", F.lower(T.normalise_line("said")).alias("said")).distinct()


@REG.add("line_difference", "select case_, count(*) as n from (select chosen_label as case_ from preference_pairs except all select rejected_label from preference_pairs) group by 1")
def line_difference(s: SparkSession, d: str) -> DataFrame:
    """Labels of chosen answers beyond those of rejected ones, each as often as there are more of it."""
    rows = _pairs(s, d)
    return joins.added_lines(rows.select(F.col("chosen_label").alias("case_")), rows.select(F.col("rejected_label").alias("case_"))).groupBy("case_").agg(F.count("*").alias("n"))


@REG.add("all_targets", "select instance_id from eval_items where instance_id is not null union select instance_id from sft_samples where type = 'fix' and instance_id is not null")
def all_targets(s: SparkSession, d: str) -> DataFrame:
    """Instances of evaluation items or of fixes, each once."""
    named = [x.select("instance_id").filter("instance_id is not null") for x in (table(s, d, "eval_items"), _samples(s, d).filter("type = 'fix'"))]
    return joins.all_targets(*named)


@REG.add("registry_json", "select instance_id, to_json({'instance_id': instance_id, 'source': list_sort(list_distinct(list(source)))})::varchar as entry from sft_samples where source is not null and instance_id is not null group by 1")
def registry_json(s: SparkSession, d: str) -> DataFrame:
    """The sources of each instance as a JSON object."""
    return prep.registry(_samples(s, d), "instance_id", "source")


@REG.add("new_work_head", "select i.instance_id from instances i where not exists (select 1 from eval_items e where e.instance_id = i.instance_id) order by length(i.patch) desc nulls last, i.instance_id limit 20")
def new_work_head(s: SparkSession, d: str) -> DataFrame:
    """The first twenty instances that no item stands for yet, the longest patch first (a top-k report)."""
    return prep.new_work(_instances(s, d), table(s, d, "eval_items"), "instance_id", 20, F.length("patch").desc_nulls_last()).select("instance_id")


@REG.add("worst_runs", "select instance_id, run_id, n_messages from outcomes order by unchanged_resubmits desc nulls last, instance_id, run_id, n_messages limit 8")
def worst_runs(s: SparkSession, d: str) -> DataFrame:
    """The eight outcomes with most unchanged resubmissions (a top-k report)."""
    return prep.worst(table(s, d, "outcomes"), F.col("unchanged_resubmits"), 8, "instance_id", "run_id", "n_messages").select("instance_id", "run_id", "n_messages")


@REG.add("progress_numbers", "with o as (select distinct run_id, instance_id, finished_at, outcome from outcomes), p as (select run_id, count(*) over w as done, sum((coalesce(outcome = 'failed', false))::bigint) over w as failed from o window w as (partition by run_id order by finished_at, instance_id, outcome rows unbounded preceding)) select run_id, done, failed::bigint as failed from p")
def progress_numbers(s: SparkSession, d: str) -> DataFrame:
    """How many outcomes of a run had come in with each, and how many of them had failed."""
    rows = table(s, d, "outcomes").select("run_id", "instance_id", "finished_at", "outcome").distinct()
    order = [F.col(c).asc_nulls_last() for c in ("finished_at", "instance_id", "outcome")]
    return prep.progress(rows, "run_id", order, F.col("outcome") == "failed").select("run_id", "done", "failed")


@REG.add("protocol_tags", "select type, case when protocol = 'raw_leak' and not coalesce(source in ('self_rescue', 'oracle'), false) then 'none' else protocol end as protocol, count(*) as n from sft_samples group by 1, 2")
def protocol_tags(s: SparkSession, d: str) -> DataFrame:
    """Samples by protocol, where leaking feedback counts only for sources that it reaches."""
    tag = prep.protocol_tag(F.col("source"), F.col("protocol"), ["self_rescue", "oracle"])
    return _samples(s, d).groupBy("type", tag.alias("protocol")).agg(F.count("*").alias("n"))


@REG.add("items_with_candidates", "select split_part(i.item_id, '::', 1) as owner, count(*) as n, count(distinct i.item_no) as items from eval_items i join preference_pairs p on p.instance_id || '::' || p.node || '::propose' = i.item_id group by 1")
def items_with_candidates(s: SparkSession, d: str) -> DataFrame:
    """Candidates of evaluation items by the instance that the item's name begins with."""
    cands = _pairs(s, d).select(F.concat("instance_id", F.lit("::"), "node", F.lit("::propose")).alias("item_id"))
    got = joins.candidates_of_items(table(s, d, "eval_items").select("item_id", "item_no"), cands, "item_id", "owner")
    return got.groupBy("owner").agg(F.count("*").alias("n"), F.countDistinct("item_no").alias("items"))


@REG.add(
    "submit_behaviour",
    f"""with {CARD_SQL}, e as (select instance_id, min(idx) filter (where event_type = 'purchase') as submit, min(idx) filter (where event_type = 'signup') as test from log group by 1),
    op as (select instance_id, max(idx) as last_open from opened group by 1), f as (select l.instance_id, count(*) as fails, count(*) filter (where op.last_open > l.idx) as redirects from log l left join op using (instance_id) where l.event_type = 'error' group by 1)
    select count(*) as n, round(avg(case when submit is not null then coalesce(test > submit, true)::int end), 6) as premature_rate, round(sum(coalesce(redirects, 0))::double / sum(coalesce(fails, 0)), 6) as redirect_rate from e left join f using (instance_id)""",
)
def submit_behaviour(s: SparkSession, d: str) -> DataFrame:
    """How often logs submit untested, and how often a failed submission leads to a new card."""
    kind = lambda x: F.col("event_type") == x
    got = metrics.submit_behaviour(_opened(s, d), ["instance_id"], "idx", kind("purchase"), kind("error"), kind("signup"), F.col("opens"))
    return got.agg(F.count("*").alias("n"), F.round(F.avg(F.col("premature").cast("int")), 6).alias("premature_rate"), metrics.ratio(F.col("redirects"), F.col("failed_attempts")).alias("redirect_rate"))


@REG.add("emission_counters", "select count(distinct instance_id) as items, count(*) as candidates_scored, coalesce(sum((not coalesce(contains(chosen, 'HYPOTHESIS:'), false))::int), 0)::bigint as extract_fallback, round(avg((not coalesce(contains(chosen, 'HYPOTHESIS:'), false))::int), 3) as extract_fallback_frac from preference_pairs")
def emission_counters(s: SparkSession, d: str) -> DataFrame:
    """Candidates scored, and those whose hypothesis could not be extracted."""
    return metrics.emission_counters(_pairs(s, d), "instance_id", "chosen", F.contains("chosen", F.lit("HYPOTHESIS:")))


@REG.add(
    "selection_report",
    f"""with {CANDS}, n as (select node_id, bool_or(label = 'correct') and bool_or(label = 'wrong') as mixed, (max_by(label, score * 1000000 - cand_idx) = 'correct')::int as best, (min_by(label, cand_idx) = 'correct')::int as first, avg((coalesce(label, '') = 'correct')::int) as random from cands where label is not null group by 1),
    x as (select 'all' as subset, * from n union all select 'mixed', * from n where mixed union all select 'none', * from n where false)
    select v.subset, count(x.node_id) as n, round(avg(best), 6) as best, round(avg(first), 6) as first, round(avg(random), 6) as random, round(avg(best) - avg(random), 6) as delta_best, round(avg(first) - avg(random), 6) as delta_first from (values ('all'), ('mixed'), ('none')) v(subset) left join x using (subset) group by 1""",
)
def selection_report(s: SparkSession, d: str) -> DataFrame:
    """How often the best-scored, the first and a random candidate are right, over all nodes, mixed ones, and an empty subset."""
    c = _cands(s, d).filter("label is not null")
    right = lambda x: (x == "correct").cast("int")
    nodes = c.groupBy("node_id").agg(
        (F.bool_or(F.col("label") == "correct") & F.bool_or(F.col("label") == "wrong")).alias("mixed"),
        right(F.max_by("label", F.col("score") * 1000000 - F.col("cand_idx"))).alias("best"), right(F.min_by("label", "cand_idx")).alias("first"), F.avg(right(F.col("label"))).alias("random"),
    )
    return metrics.selection_report(nodes, {"all": F.lit(True), "mixed": F.col("mixed"), "none": F.lit(False)}, ["best", "first", "random"], "random")


@REG.add("above_the_real", f"with {CANDS}, real as (select * from cands where cand_idx = 1) select a.node_id, count(*) as pairs from cands a join real b on a.node_id = b.node_id where a.label = 'correct' and lower(a.text) <> lower(b.text) group by 1")
def above_the_real(s: SparkSession, d: str) -> DataFrame:
    """Candidates that a judge puts above a node's first one, against it; the judge's groups come from the labels."""
    c = _cands(s, d).select("node_id", "cand_idx", "label", "text")
    judged = c.filter("label is not null").groupBy("node_id", "label").agg(F.array_sort(F.collect_list("cand_idx")).alias("g"))
    judged = judged.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("label", "g"))).alias("x"))
    tier = lambda t: F.when(t["label"] == "correct", "above").when(t["label"] == "partial", "par").otherwise("below")
    judged = judged.select("node_id", F.transform("x", lambda t: t["g"]).alias("groups"), F.transform("x", tier).alias("tiers"))
    return pairs.above_the_real(judged, c.select("node_id", "cand_idx", "text"), c.filter("cand_idx = 1")).groupBy("node_id").agg(F.count("*").alias("pairs"))


@REG.add("rank_positions", f"with {CANDS}, g as (select node_id, label, max(score) as top from cands where label is not null group by 1, 2), r as (select *, row_number() over (partition by node_id order by top desc, label) - 1 as rank, count(*) over (partition by node_id) as n from g) select c.node_id, c.cand_idx as cand, r.rank::int as rank from cands c join r on r.node_id = c.node_id and r.label = c.label where r.n > 1")
def rank_positions(s: SparkSession, d: str) -> DataFrame:
    """Each candidate's place by the order of its group, groups being ordered by their best score."""
    c = _cands(s, d).filter("label is not null")
    g = c.groupBy("node_id", "label").agg(F.array_sort(F.collect_list("cand_idx")).alias("members"), F.max("score").alias("top"))
    g = g.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("label", "members", "top"))).alias("x"))
    order = F.transform(F.array_sort(F.transform("x", lambda t, i: F.struct((-t["top"]).alias("s"), t["label"], i.alias("i")))), lambda t: t["i"])
    judged = g.select("node_id", F.transform("x", lambda t: t["members"]).alias("groups"), order.alias("ranking"), F.array().cast("array<string>").alias("tiers"))
    return pairs.rank_positions(judged).select("node_id", "cand", "rank")


# ---- hooks and streams ----------------------------------------------------------------------------------------------


@REG.add("perturbed_requests", "select item_no, k::int as k, list_extract(['plain', 'terse', 'doubt'], (k % 3 + 1)::int) as style, row_number() over (partition by item_no order by sha1('p|' || item_no || '|' || k)) as place from eval_items, range(0, 6) t(k)")
def perturbed_requests(s: SparkSession, d: str) -> DataFrame:
    """Six requests for each item, styles in turn, in seeded order."""
    rows = hooks.perturbed(table(s, d, "eval_items").select("item_no"), ["plain", "terse", "doubt"], 6)
    w = W.partitionBy("item_no").orderBy(hash_order("p", F.col("item_no"), F.col("k")))
    return rows.withColumn("place", F.row_number().over(w))


@REG.add("best_of_picks", f"with {CANDS}, r as (select *, row_number() over (partition by node_id order by sha1('b|' || node_id || '|' || cand_idx)) as h from cands) select node_id, max_by(cand_idx, score * 1000000 - cand_idx) as best, min(cand_idx) as first, min_by(cand_idx, h) as random from r group by 1")
def best_of_picks(s: SparkSession, d: str) -> DataFrame:
    """Each node's best-scored, first and seeded random candidate."""
    return hooks.picks(_cands(s, d), "node_id", "cand_idx", "score", "b")


@REG.add("recorded_answers", "select i.item_no, coalesce(max(p.chosen), '(none)') as answer from eval_items i left join preference_pairs p on p.pair_id = i.item_no * 3 group by 1")
def recorded_answers(s: SparkSession, d: str) -> DataFrame:
    """Requests answered from recorded responses, never by a call."""
    asked = table(s, d, "eval_items").select("item_no", (F.col("item_no") * 3).alias("request"))
    told = _pairs(s, d).select(F.col("pair_id").alias("request"), F.col("chosen").alias("answer"))
    return hooks.recorded(asked, told, "request", "answer", "(none)").select("item_no", "answer")


@REG.add("stream_event_counts", "select event_type, count(*) as n from (select distinct on (event_id) event_id, event_type from events) group by 1")
def stream_event_counts(s: SparkSession, d: str) -> DataFrame:
    """Events counted by a stream that takes each key once, up to where the folder ends."""
    return settled_counts(s, f"{d}/events.parquet", "event_id", "event_type")


# ---- rendering and small reports ------------------------------------------------------------------------------------


@REG.add("rubric_means", "select event_type, 'k' as criterion, count(*) as n, round(avg(json_extract(props, '$.k')::double), 6) as mean from events where props is not null group by 1")
def rubric_means(s: SparkSession, d: str) -> DataFrame:
    """Means of graded criteria from JSON objects."""
    grades = table(s, d, "events").select("event_type", F.explode(F.from_json("props", "map<string,double>")).alias("criterion", "value"))
    return grades.groupBy("event_type", "criterion").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@REG.add("presence_counts", "select pair_type, count(*) filter (where a and b) as both, count(*) filter (where a and not b) as only_verbs, count(*) filter (where b and not a) as only_adjectives, count(*) filter (where not a and not b) as neither from (select pair_type, regexp_matches(lower(chosen), '\\b(?:passes|raises|compares|writes|keeps)\\b') as a, regexp_matches(lower(chosen), '\\b(?:stale|weak|empty|cached|partial)\\b') as b from preference_pairs) group by 1")
def presence_counts(s: SparkSession, d: str) -> DataFrame:
    """Verbs of operation and adjectives in answers, as a table of two by two."""
    a, b = F.lower("chosen").rlike(r"\b(?:passes|raises|compares|writes|keeps)\b"), F.lower("chosen").rlike(r"\b(?:stale|weak|empty|cached|partial)\b")
    return _pairs(s, d).groupBy("pair_type").agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_verbs"), F.count_if(b & ~a).alias("only_adjectives"), F.count_if(~a & ~b).alias("neither"))


@REG.add("state_fingerprint", "select instance_id, md5(array_to_string(list_sort(regexp_extract_all(patch, '(?m)^\\+\\+\\+ b/(.+)$', 1)), chr(10))) as print from instances where patch is not null")
def state_fingerprint(s: SparkSession, d: str) -> DataFrame:
    """One print for the files that a patch writes, in any order."""
    rows = _instances(s, d).filter("patch is not null")
    return rows.select("instance_id", render.fingerprint(F.regexp_extract_all("patch", F.lit(r"(?m)^\+\+\+ b/(.+)"), F.lit(1))).alias("print"))


@REG.add("smallest_failing", "select instance_id, run_id, list_extract(list_sort(list_transform(list_filter(evals, lambda e: e.resolved is not true), lambda e: {'n': length(e.stage), 'stage': e.stage})), 1).stage as stage, n_messages from outcomes")
def smallest_failing(s: SparkSession, d: str) -> DataFrame:
    """The failing evaluation with the shortest name."""
    fails = F.transform("evals", lambda e: ~F.coalesce(e["resolved"], F.lit(False)))
    stage = render.smallest(F.transform("evals", lambda e: e["stage"]), fails, F.transform("evals", lambda e: F.length(e["stage"])))
    return table(s, d, "outcomes").select("instance_id", "run_id", stage.alias("stage"), "n_messages")


@REG.add("hard_multi_hunk", "select difficulty, count(*) as n from instances where difficulty in ('1-4 hours', '>4 hours') and (length(patch) - length(replace(patch, '@@', ''))) / 2 >= 4 group by 1")
def hard_multi_hunk(s: SparkSession, d: str) -> DataFrame:
    """Instances of given difficulties whose patch has two hunks or more."""
    rows = _instances(s, d).filter(F.col("difficulty").isin("1-4 hours", ">4 hours") & (F.regexp_count("patch", F.lit("@@")) >= 4))
    return rows.groupBy("difficulty").agg(F.count("*").alias("n"))


@REG.add("transcripts", "select sample_id, sha1(array_to_string(list_transform(messages, lambda m: '[' || coalesce(m.role, '') || '] ' || case when lower(m.role) = 'assistant' then coalesce(m.content, '') else substr(coalesce(m.content, ''), 1, 800) end), chr(10))) as print from sft_samples")
def transcripts(s: SparkSession, d: str) -> DataFrame:
    """Conversations as transcripts: what the assistant says whole, the rest cut to 800 characters each."""
    return _samples(s, d).select("sample_id", F.sha1(render.transcript(F.col("messages"), 800).cast("binary")).alias("print"))


@REG.add("refuted_digest", "select instance_id, run_id, n_messages, case when len(refuted_hypotheses) > 0 then array_to_string(list_transform(refuted_hypotheses, lambda x, i: 'H' || i || ': ' || x), chr(10)) else '(none)' end as refuted from outcomes")
def refuted_digest(s: SparkSession, d: str) -> DataFrame:
    """Refuted hypotheses of each outcome as a numbered list."""
    return table(s, d, "outcomes").select("instance_id", "run_id", "n_messages", render.digest(F.col("refuted_hypotheses"), "H", "(none)").alias("refuted"))


@REG.add("failure_feedback")
def failure_feedback(s: SparkSession, d: str) -> DataFrame:
    """Feedback on failed evaluations, and the refuted hypotheses as a list."""
    failed = F.transform(F.filter("evals", lambda e: ~F.coalesce(e["resolved"], F.lit(False))), lambda e: e["stage"])
    hidden = F.size(F.filter("evals", lambda e: ~F.coalesce(e["p2p_pass"], F.lit(False))))
    return table(s, d, "outcomes").select("instance_id", "run_id", render.feedback(failed, hidden).alias("feedback"), render.digest(F.col("refuted_hypotheses"), "H", "(none)").alias("refuted"))


@REG.add("prompt_template", "select item_no, concat_ws(chr(10) || chr(10), 'ISSUE:' || chr(10) || nullif(substr(input, 1, 3000), ''), 'EXPECTED:' || chr(10) || nullif(expected, ''), 'Name one cause.') as prompt from eval_items")
def prompt_template(s: SparkSession, d: str) -> DataFrame:
    """Prompts from headed blocks; what is missing is left out."""
    blocks = [("ISSUE:", F.substring("input", 1, 3000)), ("EXPECTED:", F.col("expected"))]
    return table(s, d, "eval_items").select("item_no", render.prompt(blocks, "Name one cause.").alias("prompt"))


@REG.add(
    "scan_status",
    f"""with {TOKENS_SQL}, h as (select p.pair_id, t.tokens, (select count(*) from unnest(t.tokens) u(tok) where regexp_matches(p.prompt, '\\b' || substr(tok, 6) || '\\b')) as hits from preference_pairs p left join tokens t on t.instance_id = p.instance_id)
    select case when tokens is null then 'unscanned' when hits > 0 then 'hit' else 'clean' end as status, count(*) as n from h group by 1""",
)
def scan_status(s: SparkSession, d: str) -> DataFrame:
    """Pairs without known tokens (kept and counted), with a hit, and clean."""
    names = _tokens(s, d).withColumn("tokens", F.transform("tokens", lambda t: F.substr(t, F.lit(6))))
    both = _pairs(s, d).select("instance_id", "prompt").join(names, "instance_id", "left")
    status = F.when(F.col("tokens").isNull(), "unscanned").when(F.size(T.leaked_tokens(F.col("prompt"), F.col("tokens"))) > 0, "hit").otherwise("clean")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@REG.add(
    "winner_pairs",
    "with w as (select instance_id, max_by(chosen, pair_id) as winner from preference_pairs where strength = 'verified' group by 1) select k.kind, count(*) as n from w join preference_pairs p using (instance_id), (values ('decision'), ('issue_only')) k(kind) where lower(trim(p.rejected)) <> lower(trim(w.winner)) and p.rejected <> '' group by 1",
)
def winner_pairs(s: SparkSession, d: str) -> DataFrame:
    """Each instance's last verified answer against its rejected ones, for two kinds of prompt."""
    rows = _pairs(s, d)
    winner = rows.filter("strength = 'verified'").groupBy("instance_id").agg(F.max_by("chosen", "pair_id").alias("winner"))
    both = rows.select("instance_id", "rejected").join(winner, "instance_id").filter((F.lower(F.trim("rejected")) != F.lower(F.trim("winner"))) & T.truthy("rejected"))
    return both.select(F.explode(F.array(F.lit("decision"), F.lit("issue_only"))).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@REG.add("hypothesis_places", "select sample_id, array_to_string(list_filter(list_transform(messages, lambda m, i: case when contains(m.content, 'HYPOTHESIS:') then i - 1 end), lambda x: x is not null), ',') as places from sft_samples")
def hypothesis_places(s: SparkSession, d: str) -> DataFrame:
    """At which places of a conversation hypotheses are stated."""
    return _samples(s, d).select("sample_id", F.array_join(F.transform(render.hit_places(F.col("messages"), ["HYPOTHESIS:"]), lambda i: i.cast("string")), ",").alias("places"))
