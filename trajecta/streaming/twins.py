"""Streaming forms of the incremental jobs: append-only logs and the episode state machine."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trajecta.session import shared_folder


def incremental_rows(spark: SparkSession, folder: str, schema: str, key: str, fmt: str = "parquet", files: int = 8) -> DataFrame:
    """A stream of a folder's rows, each key once over all batches: the state holds keys, never rows."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(folder)
    return stream.dropDuplicates([key])


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Processes what is there and stops; a later call goes on from the checkpoint."""
    query = stream.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()


def until_quiet(step: Callable[[], int], quiet: int = 2, most: int = 1_000) -> list[int]:
    """Runs a step, which tells how much is done, until it says the same `quiet` times in a row; gives what it said.

    A stream's step is `run_available` and a count of its sink. After `most` rounds it raises: work that always moves never ends.
    """
    said: list[int] = []
    while len(said) < most:
        said.append(step())
        if len(said) > quiet and len(set(said[-quiet - 1 :])) == 1:
            return said
    raise RuntimeError(f"still moving after {most} rounds")


def running_counts(stream: DataFrame, *by: str) -> DataFrame:
    return stream.groupBy(*by).agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, ts: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts in tumbling windows with a watermark for late rows."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"))


def settled_counts(spark: SparkSession, path: str, key: str, by: str) -> DataFrame:
    """Counts of a file's or folder's rows by a column, each key once, from a stream that runs to the end and stops.

    The checkpoint lies in the shared folder that the session names; the result has one row for each value, so that the
    driver may hold it. The state holds every key of the folder, as any row may come again: the folder bounds it.
    """
    base = spark.sparkContext.getCheckpointDir() or shared_folder(spark)
    table = spark.read.parquet(path).select(key, by)
    stream = spark.readStream.schema(table.schema)
    if [unquote(f).rsplit("/", 1)[-1] for f in table.inputFiles()[:2]] == [path.rsplit("/", 1)[-1]]:
        folder, file = path.rsplit("/", 1)  # a stream reads folders
        rows = stream.option("pathGlobFilter", file).parquet(folder)
    else:
        rows = stream.parquet(path)
    rows = rows.dropDuplicates([key])
    name = f"settled_{uuid.uuid4().hex}"
    query = running_counts(rows, by).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{base}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


EPISODE_OUT = "key string, step bigint, rounds int, stuck int, outcome string"
EPISODE_STATE = "rounds int, stuck int, last string, outcome string"


def episode_step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState, most_rounds: int = 7, most_stuck: int = 3) -> Iterator[pd.DataFrame]:
    """Counts feedback rounds and unchanged resubmits of one episode and settles its outcome once.

    Rows arrive in any batch; inside a batch they go by step.
    """
    rounds, stuck, last, outcome = state.get if state.exists else (0, 0, None, None)
    out = []
    for pdf in batches:
        for r in pdf.sort_values("step").itertuples():
            if outcome is None:
                stuck = stuck + 1 if last is not None and r.state == last else 0
                last = r.state
                if r.resolved:
                    outcome = "solved"
                elif stuck >= most_stuck:
                    outcome = "stuck"
                elif rounds >= most_rounds:
                    outcome = "exhausted"
                else:
                    rounds += 1
            out.append((key[0], int(r.step), rounds, stuck, outcome))
    state.update((rounds, stuck, last, outcome))
    yield pd.DataFrame(out, columns=["key", "step", "rounds", "stuck", "outcome"])


def episodes(stream: DataFrame) -> DataFrame:
    """The state machine over a stream (or table) of key, step, state and resolved."""
    return stream.groupBy("key").applyInPandasWithState(episode_step, EPISODE_OUT, EPISODE_STATE, "append", GroupStateTimeout.NoTimeout)
