"""Tables from directories of JSON, JSONL, TOML and text."""

from __future__ import annotations

import tomllib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.functions import text as T
from trajecta.functions.pandas_udfs import decoded_cases
from trajecta.operators.joins import last_wins

ID_AND_RUN = r"([^/]+)/([^/]+)/[^/]+$"


def path_part(pattern: str, group: int = 1) -> Column:
    """A part of the path of a row's file."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, group)


def keyed_rows(spark: SparkSession, path: str, key: str, fmt: str = "json", order: str | None = None) -> DataFrame:
    """Rows by a key, the last one of a key; order is a column, or the place in the file."""
    df = spark.read.format(fmt).load(path)
    if order is not None:
        return last_wins(df, key, order)
    return last_wins(df.withColumn("__row", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id())), key, "__row").drop("__row")


def dataset_path(name: str, aliases: dict[str, str]) -> str:
    """A known name's path, or the name itself."""
    return aliases.get(name, name)


def episodes(spark: SparkSession, root: str, run: str, file: str, schema: str) -> DataFrame:
    """<root>/<instance_id>/<run>/<file> as rows with instance_id and run_id; a missing file is a missing row."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", file).option("recursiveFileLookup", True).json(root)
    df = df.withColumn("instance_id", path_part(ID_AND_RUN, 1)).withColumn("run_id", path_part(ID_AND_RUN, 2))
    return df.filter(F.col("run_id") == run)


def messages(trajectories: DataFrame, column: str = "messages", joiner: str = " ") -> DataFrame:
    """One row for each message: instance_id, run_id, `idx`, `role`, `text`; content may be text or parts."""
    flat = trajectories.select("instance_id", "run_id", F.posexplode(column).alias("idx", "m"))
    return flat.select("instance_id", "run_id", F.col("idx").cast("bigint").alias("idx"), F.col("m.role").alias("role"), T.flat_content(F.col("m.content"), joiner).alias("text"))


def jsonl(spark: SparkSession, glob: str, schema: str, run_from: str = "parent", torn: bool = False) -> DataFrame:
    """JSON lines with `run_id` from the parent folder, or from the file's stem without `pairs_` and `_train`.

    Blank lines are skipped. Torn lines fail the read, or are dropped with `torn`.
    """
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED" if torn else "FAILFAST").json(glob)
    if run_from == "parent":
        return df.withColumn("run_id", path_part(r"([^/]+)/[^/]+$"))
    return df.withColumn("run_id", F.regexp_replace(F.regexp_replace(path_part(r"([^/]+?)(?:\.[^./]+)?$"), "^pairs_", ""), "_train$", ""))


def wall(spark: SparkSession, paths: Sequence[str], optional: Sequence[str] = (), key: str = "instance_id") -> DataFrame:
    """Held-out ids from JSON arrays. A missing file fails the read, as without it everything would be let through;
    those in `optional` may be missing."""
    out = spark.createDataFrame([], f"{key} string")
    for path in (*paths, *optional):
        try:
            text = spark.read.text(path, wholetext=True)
        except Exception as e:
            if path in optional and "PATH_NOT_FOUND" in str(e):
                continue
            raise
        out = out.union(text.select(F.explode(F.from_json("value", "array<string>")).alias(key)))
    return out.distinct()


def problems(spark: SparkSession, path: str, schema: str, after: str | None = None, difficulties: Sequence[str] = (), most_cases: int | None = None) -> DataFrame:
    """Problem lines of given difficulties after a date, with decoded `public` and `private` cases, the latter cut to
    their head and tail. The filters come before the decoding."""
    df = spark.read.schema(schema).json(path)
    if after is not None:
        df = df.filter(F.substring("contest_date", 1, 10) > after)
    if difficulties:
        df = df.filter(F.col("difficulty").isin(*difficulties))
    df = df.withColumn("public", decoded_cases("public_test_cases")).withColumn("private", decoded_cases("private_test_cases"))
    return df if most_cases is None else df.withColumn("private", T.head_and_tail(F.col("private"), most_cases))


def task_dirs(spark: SparkSession, root: str, files: Sequence[str] = ("task.toml", "instruction.md", "solution/solve.sh", "tests/test.sh")) -> DataFrame:
    """One row for each directory that holds all files and names a `docker_image`: task_id and the files' texts."""
    df = spark.read.text(root, wholetext=True, recursiveFileLookup=True).withColumn("path", F.col("_metadata.file_path"))
    rest = F.substring_index(F.col("path"), f"/{root.rstrip('/').rsplit('/', 1)[-1]}/", -1)
    df = df.select(F.substring_index(rest, "/", 1).alias("task_id"), F.regexp_replace(rest, "^[^/]+/", "").alias("file"), "value")
    wide = df.filter(F.col("file").isin(*files)).groupBy("task_id").pivot("file", list(files)).agg(F.first("value"))
    for f in files:
        wide = wide.filter(F.col(f"`{f}`").isNotNull())

    @F.pandas_udf("string")
    def image(texts: pd.Series) -> pd.Series:
        def one(t: str) -> str | None:
            try:
                return tomllib.loads(t).get("environment", {}).get("docker_image")
            except tomllib.TOMLDecodeError:
                return None

        return pd.Series([one(t) for t in texts], dtype=object)

    toml = files[0]
    return wide.withColumn("docker_image", image(F.col(f"`{toml}`"))).filter(F.coalesce("docker_image", F.lit("")) != "")


def report_statuses(text: Column) -> Column:
    """A map from test name to status out of a report with prose around it, the last status of a name; empty where nothing parses."""
    found = T.json_object(text, "tests array<struct<name:string,status:string>>")
    entries = F.transform(found["tests"], lambda t: F.struct(t["name"].alias("key"), t["status"].alias("value")))
    return F.coalesce(T.last_of_key(entries, "key"), F.from_json(F.lit("{}"), "map<string,string>"))


def all_passed(names: Column, statuses: Column) -> Column:
    """Whether every name has the status PASSED; a missing one hasn't."""
    return F.forall(names, lambda n: F.coalesce(F.try_element_at(statuses, n) == "PASSED", F.lit(False)))


def rendered_code(regions: DataFrame, by: str, width: int = 6000, none: str = "(source not captured)") -> DataFrame:
    """(by, `code`): headed blocks of a file's line ranges in their order, cut to width."""
    block = F.concat(F.lit("# "), F.col("file"), F.lit(" (lines "), F.col("lines"), F.lit("):\n"), F.col("code"))
    got = F.transform(F.array_sort(F.collect_list(F.struct("ord", block.alias("b")))), lambda s: s["b"])
    return regions.groupBy(by).agg(F.coalesce(F.nullif(F.substring(F.array_join(got, "\n\n"), 1, width), F.lit("")), F.lit(none)).alias("code"))


def inspected(log: DataFrame, by: Sequence[str]) -> DataFrame:
    """Messages by role and hypothesis lines of each log."""
    return log.groupBy(*by).agg(
        F.count("*").alias("messages"), F.count_if(F.col("role") == "assistant").alias("assistant"), F.count_if(F.contains("text", F.lit("HYPOTHESIS:"))).alias("hypotheses")
    )


def not_done(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work whose key isn't stored yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")
