"""The pN_ queries of the nine problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.llm.abuse import score_documents
from trajecta.llm.cap import stratified_cap
from trajecta.llm.copies import bare, bare_lines, fold_copies
from trajecta.llm.defects import broken_answers
from trajecta.llm.identity import instance_key
from trajecta.llm.overlap import overlap_counts, overlaps
from trajecta.llm.packing import pack
from trajecta.llm.splits import spelling_pairs, stratified_splits
from trajecta.llm.sql import P1_FOUND, P5_FOUND, P6_FOUND, P6_GROUPS
from trajecta.llm.tiling import leaked
from trajecta.llm.tokens import encode_corpus
from trajecta.registry import Registry, table

REG = Registry()
CAP, CAPACITY = 8, 8_192
PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def strength_tier(col) -> F.Column:
    """`verified` whatever its case and outer blanks; everything else, null included, is `other`."""
    return F.when(F.lower(F.regexp_replace(col, r"(?U)^\s+|\s+$", "")) == "verified", "verified").otherwise("other")


def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 1 with strength as stratum: all slots go to `verified`, its spare ones to the others."""
    pairs = table(spark, sf_dir, "preference_pairs")
    return stratified_cap(
        pairs,
        "pair_id",
        instance_key(F.col("instance_id")),
        [(F.col("rank_gap"), "desc")],
        cap=CAP,
        stratum=strength_tier(F.col("strength")),
        weight=lambda s: (s == "verified").cast("int"),
    )


@REG.add("p1_found", P1_FOUND)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs beyond the cap of their instance."""
    return _capped(spark, sf_dir).filter(~F.col("kept")).select("pair_id")


@REG.add("p1_kept_by_type")
def p1_kept_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap split over pair types by their row counts, quality by strength inside each."""
    pairs = table(spark, sf_dir, "preference_pairs")
    quality = [(F.when(strength_tier(F.col("strength")) == "verified", 0).otherwise(1), "asc"), (F.col("rank_gap"), "desc")]
    return stratified_cap(pairs, "pair_id", instance_key(F.col("instance_id")), quality, cap=CAP, stratum=F.col("pair_type"))


@REG.add("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose last answer is defective, with the defect."""
    return broken_answers(table(spark, sf_dir, "sft_samples"), "sample_id", "type", "messages")


@REG.add("p6_found", P6_FOUND)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair that repeats an earlier one but for its form, with the first of its group."""
    return _folded(spark, sf_dir).filter("pair_id <> first_id").select(F.col("first_id").alias("first_pair_id"), "pair_id")


@REG.add("p6_groups", P6_GROUPS)
def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each group of copies, with its number of copies."""
    return _folded(spark, sf_dir).filter("pair_id = first_id").select("pair_id", "n_copies")


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "preference_pairs")
    return fold_copies(pairs, "pair_id", {"chosen": bare_lines, "rejected": bare_lines, "prompt": bare})


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and items as one table of records: p<pair_id> and i<item_no>."""
    pairs = table(spark, sf_dir, "preference_pairs").select(
        F.concat(F.lit("p"), "pair_id").alias("record"), "instance_id", F.concat(F.lit("pair|"), strength_tier(F.col("strength")), F.lit("|"), F.coalesce("pair_type", F.lit(""))).alias("label")
    )
    items = table(spark, sf_dir, "eval_items").select(
        F.concat(F.lit("i"), "item_no").alias("record"), "instance_id", F.concat(F.lit("item|"), F.coalesce("task", F.lit(""))).alias("label")
    )
    return pairs.unionByName(items)


@REG.add("p5_found", P5_FOUND)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different spellings of one instance: the strings that the grouping puts into one component."""
    names = [table(spark, sf_dir, t).select("instance_id") for t in ("preference_pairs", "eval_items")]
    found = spelling_pairs(names[0].union(names[1]), "instance_id", instance_key(F.col("instance_id")))
    return found.select(F.col("a").alias("instance_id_a"), F.col("b").alias("instance_id_b"))


@REG.add("p5_splits")
def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of each record."""
    return stratified_splits(_records(spark, sf_dir), "record", [instance_key(F.col("instance_id"))], F.col("label"), PROPORTIONS)


@REG.add("p7_ids")
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of each document."""
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


@REG.add("p8_containers")
def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container and place of each document, sized in tokens."""
    sizes = encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", lengths=True)
    return pack(sizes, "doc_id", "n_tokens", CAPACITY)


def _compared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Train prompts; prompts of the other splits and inputs of items."""
    pairs, items = table(spark, sf_dir, "preference_pairs"), table(spark, sf_dir, "eval_items")
    train = pairs.filter("split_tag = 'train'").select("pair_id", "run_id", F.col("prompt").alias("said"))
    asked = pairs.filter("split_tag in ('dev', 'test')").select(F.lit("pair").alias("eval_kind"), F.col("pair_id").alias("eval_no"), F.col("split_tag").alias("eval_split"), F.col("prompt").alias("said"))
    built = items.select(F.lit("item").alias("eval_kind"), F.col("item_no").alias("eval_no"), F.lit("eval").alias("eval_split"), F.col("input").alias("said"))
    return train, asked.union(built)


@REG.add("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation prompts and inputs, and the train pairs whose prompt is the same or nearly so."""
    return overlaps(*_compared(spark, sf_dir), "said", ["pair_id"], ["eval_kind", "eval_no"]).select("eval_kind", "eval_no", "pair_id")


@REG.add("p3_counts")
def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps counted for each evaluation split and train run."""
    return overlap_counts(*_compared(spark, sf_dir), "said", "run_id", "eval_split")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, samples = table(spark, sf_dir, "preference_pairs"), table(spark, sf_dir, "sft_samples")
    passages = table(spark, sf_dir, "heldout_items")
    parts = [
        pairs.select(F.lit("pair").alias("record_kind"), F.col("pair_id").alias("record_id"), F.array("prompt", "chosen", "rejected").alias("texts")),
        samples.select(F.lit("sample").alias("record_kind"), F.col("sample_id").alias("record_id"), F.col("messages.content").alias("texts")),
    ]
    return leaked(parts[0].union(parts[1]), ["record_kind", "record_id"], F.col("texts"), passages, "heldout_id", "passage")


@REG.add("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that hold twelve words in a row of a passage, with the item that leaks."""
    return _leaks(spark, sf_dir).filter("longest >= 12").select("heldout_id", "record_kind", "record_id")


@REG.add("p4_items")
def p4_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaked item: in how many records, in how many of them only by parts that together cover half of it, and how much of it at most."""
    return _leaks(spark, sf_dir).groupBy("heldout_id", "record_kind").agg(
        F.count("*").alias("records"), F.count_if(F.col("longest") < 12).alias("in_parts"), F.max("longest").alias("longest"), F.max(F.round(F.col("covered") / F.col("words"), 6)).alias("coverage")
    )


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "review_labels"), "text", "category", ["source"])


@REG.add("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least one abusive, hateful or sexually explicit passage."""
    return _scored(spark, sf_dir).filter(F.col("score") >= 0.5).select("doc_id")


@REG.add("p9_rates")
def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source its documents and the share of those with such a passage."""
    hit = (F.col("score") >= 0.5).cast("int")
    return _scored(spark, sf_dir).groupBy("source").agg(F.count("*").alias("documents"), F.sum(hit).alias("found"), F.round(F.avg(hit), 6).alias("rate"))
