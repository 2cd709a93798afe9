"""Counters kept up by streams: what triggers do in a row store. Extensions of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import MIN_SEARCH, valid_text
from ..operators.caches import merge_counts
from ..storage import exists, remove


def hourly_requests(events: DataFrame, ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Requests by hour of a stream; hours close when the watermark passes them."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour")).agg(F.count("*").alias("requests")).select(F.col("window.start").alias("hour"), "requests")


def valid_answers(answers: DataFrame, text: str = "text") -> DataFrame:
    """The running number of valid answers."""
    return answers.where(valid_text(text, MIN_SEARCH)).groupBy().agg(F.count("*").alias("valid_count"))


def _steps(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """An answer's changes in order, against the question that it was last counted for; out come steps of questions."""
    (now,) = state.get if state.exists else (None,)
    rows, out = pd.concat(list(batches)).sort_values("seq", kind="stable"), []
    for op, question in zip(rows["op"], rows["question_id"], strict=True):
        new = None if op == "delete" or pd.isna(question) else int(question)
        if new == now:  # an update in place, a second insert, a delete of what isn't there
            continue
        out += [(q, d) for q, d in ((now, -1), (new, 1)) if q is not None]
        now = new
    if now is None:
        if state.exists:
            state.remove()
    else:
        state.update((now,))
    if out:
        yield pd.DataFrame(out, columns=["question_id", "delta"])


def count_steps(changes: DataFrame) -> DataFrame:
    """Steps (question_id, delta) from a stream of answers' changes: answer_id, question_id, op (insert, update or delete), seq.

    The state of an answer is the question it counts for, so a move takes from the old one, and a delete needs no question. seq orders the
    changes of an answer within a batch; batches come in order. A null question counts nowhere.
    """
    slim = changes.select(F.col("answer_id").cast("long"), F.col("question_id").cast("long"), "op", F.col("seq").cast("long"))
    return slim.groupBy("answer_id").applyInPandasWithState(_steps, "question_id long, delta long", "question_id long", "append", GroupStateTimeout.NoTimeout)


def _versions(spark: SparkSession, path: str) -> list[int]:
    if not exists(spark, path):
        return []
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def _keep(deltas: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A table of counts that each micro-batch of (question_id, delta) updates.

    Versions are written side by side, named by batch; a batch that runs again writes its version again from the one before, so nothing counts twice.
    Versions that no rerun can need are removed.
    """
    spark = deltas.sparkSession
    if _versions(spark, path) and not exists(spark, f"{checkpoint}/offsets"):
        raise ValueError(f"{path} holds counts of another checkpoint: a new one reads the stream from its start, so it needs a new folder")

    def apply(batch: DataFrame, number: int) -> None:
        session: SparkSession = batch.sparkSession
        delta = batch.groupBy("question_id").agg(F.sum("delta").alias("delta"))
        old = read_question_counts(session, path, number - 1)
        empty = session.createDataFrame([], "question_id long, answers_count long")
        merge_counts(empty if old is None else old, delta.withColumn("question_id", F.col("question_id").cast("long")), "question_id").write.mode("overwrite").parquet(f"{path}/v{number}")
        for v in _versions(session, path):
            if v < number - 1:
                remove(session, f"{path}/v{v}")

    return deltas.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_question_counts(answers: DataFrame, path: str, checkpoint: str, question: str = "question_id") -> StreamingQuery:
    """Counts of answers per question from a stream of new answers."""
    return _keep(answers.select(F.col(question).alias("question_id"), F.lit(1).cast("long").alias("delta")), path, checkpoint)


def keep_changed_counts(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Counts of answers per question from a stream of inserts, moves and deletes."""
    return _keep(count_steps(changes), path, checkpoint)


def read_question_counts(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """A version, or the last; None where there is none."""
    if version is None:
        version = max(_versions(spark, path), default=-1)
    return None if version < 0 else spark.read.parquet(f"{path}/v{version}")
