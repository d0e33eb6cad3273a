"""Where outside services answer: recorded responses by default, a client by choice."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.functions.hashing import hash_order


def perturbed(items: DataFrame, styles: Sequence[str], k: int) -> DataFrame:
    """k requests for each item, with styles in turn; a fixed number of rows each, no join."""
    named = F.array(*[F.lit(x) for x in styles])
    out = items.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return out.withColumn("style", F.element_at(named, (F.col("k") % len(styles) + 1).cast("int")))


def recorded(requests: DataFrame, responses: DataFrame, key: str, answer: str, missing: str) -> DataFrame:
    """Requests with their recorded responses; what has none gets a given text."""
    one = responses.groupBy(key).agg(F.max(answer).alias(answer))
    return requests.join(one, key, "left").withColumn(answer, F.coalesce(answer, F.lit(missing)))


def retrying(call: Callable[[str], str], tries: int = 3, pause: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str | None]:
    """A call that is tried again after a pause that grows; None when all tries fail."""

    def run(x: str) -> str | None:
        for i in range(tries):
            try:
                return call(x)
            except Exception:
                if i + 1 < tries:
                    sleep(pause * (i + 1))
        return None

    return run


def answered(requests: DataFrame, prompt: str, call: Callable[[str], str], workers: int = 2, answer: str = "answer") -> DataFrame:
    """Requests answered by a client in the workers, at most `workers` tasks at a time; failed ones stay null."""
    ask = retrying(call)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{answer: pd.Series([ask(x) for x in b[prompt]], dtype=object, index=b.index)})

    schema = ", ".join(f"`{c}` {t}" for c, t in requests.dtypes) + f", `{answer}` string"
    return requests.repartition(workers).mapInPandas(run, schema)


def picks(cands: DataFrame, node: str, idx: str, score: str, seed: str) -> DataFrame:
    """(node, `best`, `first`, `random`): candidates by score (the first on ties), by place, and in seeded order."""
    return cands.groupBy(node).agg(
        F.max_by(idx, F.struct(F.col(score), -F.col(idx))).alias("best"),
        F.min(idx).alias("first"),
        F.min_by(idx, hash_order(seed, F.col(node), F.col(idx))).alias("random"),
    )


def best_checkpoint(logs: DataFrame, loss: str, step: str) -> DataFrame:
    """The step with the least loss, the last step where none has one."""
    best = F.min_by(step, F.when(F.col(loss).isNotNull(), F.struct(F.col(loss), F.col(step))))
    return logs.agg(F.coalesce(best, F.max(step)).alias(step))
