"""Model calls that can be taken up again: a store of answers, and runs that send only what it lacks.

A request is known by the digest of its text, so the same text is sent once whatever documents it belongs to.
A run finds the requests without an answer (an anti join with the store), deals them into waves, and appends the answers
of a wave by one job.  What is lost is bounded: a lost task sends its own ``task_requests`` again, a
lost driver one wave; a new run sends only what is still unanswered.  Appending is idempotent: a wave owns its folder, and
answers that are there twice count once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkproof.operators.requests import apply_model

_STORE = "request_id string, response string, error string, attempt int, run string, wave int"


def request_id(request: Column) -> Column:
    return F.sha2(request.cast("binary"), 256)


class ResponseStore:
    """Answers below a folder that all executors see, a sub-folder per run and wave."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        # an empty part, so that a new store can be read
        empty = spark.createDataFrame([], _STORE).drop("run", "wave")
        empty.coalesce(1).write.mode("ignore").parquet(f"{self.path}/answers/run=none/wave=0")

    def attempts(self) -> DataFrame:
        """Every call recorded: request_id, response, error, attempt, run, wave."""
        return self.spark.read.schema(_STORE).parquet(f"{self.path}/answers")

    def answers(self) -> DataFrame:
        """One row per request: ``response``, ``error`` and ``run`` of its answer (else of its last attempt), and ``sends``."""
        told = F.struct("response", "error", "run")
        rank = F.struct(F.col("response").isNotNull(), "attempt", "run")
        best = self.attempts().groupBy("request_id").agg(F.max_by(told, rank).alias("told"), F.count("*").alias("sends"))
        return best.select("request_id", "told.*", "sends")

    def append(self, answered: DataFrame, run: str, wave: int) -> None:
        """Record a wave; recording it again replaces it."""
        answered.write.mode("overwrite").parquet(f"{self.path}/answers/run={run}/wave={wave}")

    def pending(self, requests: DataFrame, attempts: int) -> DataFrame:
        """(request_id, request, attempt) of distinct requests without an answer that were sent fewer times than ``attempts``."""
        asked = requests.where("request is not null").groupBy(request_id(F.col("request")).alias("request_id"))
        told = self.answers()
        finished = told.where(F.col("response").isNotNull() | (F.col("sends") >= attempts)).select("request_id")
        open_ones = asked.agg(F.first("request").alias("request")).join(finished, "request_id", "left_anti")
        sent = told.where("response is null").select("request_id", "sends")
        tried = F.coalesce("sends", F.lit(0)) + 1
        return open_ones.join(sent, "request_id", "left").select("request_id", "request", tried.cast("int").alias("attempt"))


def apply_resumable(
    requests: DataFrame,
    make_client: Callable[[], Callable[[str], str]],
    store: ResponseStore,
    *,
    keys: Sequence[str] = ("doc_id",),
    request: str = "request",
    waves: int = 8,
    task_requests: int = 1000,
    attempts: int = 3,
) -> DataFrame:
    """``keys``, ``response``, ``error``, ``run`` and ``sends`` of every request, after sending what the store lacks.

    A call that raises is recorded with its error and sent again by the next run, ``attempts`` times in all.  Null
    requests are not sent.  ``make_client`` runs once per task.
    """
    if min(waves, task_requests, attempts) < 1:
        raise ValueError("waves, task_requests and attempts must be positive")
    spark, run = requests.sparkSession, uuid.uuid4().hex
    todo = f"{store.path}/todo/{run}"
    asked = store.pending(requests.select(F.col(request).alias("request")), attempts)
    # written once: what is sent doesn't change while the answers come in
    wave = F.pmod(F.xxhash64("request_id"), F.lit(waves)).cast("int").alias("wave")
    # from the tasks that they are in, by request: dealt by wave, one task would hold a whole wave
    asked.select("*", wave).write.partitionBy("wave").parquet(todo)
    open_ones = spark.read.schema(asked.select("*", wave).schema).parquet(todo)
    counts = {row["wave"]: row["count"] for row in open_ones.groupBy("wave").count().collect()}
    for number, many in sorted(counts.items()):
        part = open_ones.where(F.col("wave") == number).repartition(-(-many // task_requests))
        answered = apply_model(part, make_client, keys=["request_id", "attempt"])
        store.append(answered.select("request_id", "response", "error", "attempt"), run, number)
    named = requests.select(*keys, request_id(F.col(request)).alias("request_id"))
    return named.join(store.answers(), "request_id", "left").drop("request_id")
