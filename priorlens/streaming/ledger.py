"""Report attempts as a stateful stream, and incremental candidate ingest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.attempts import evaluate_attempts
from ..operators.hashes import identity_hash

ATTEMPT_OUT = "identity string, report_hash string, attempt int, max_attempts int, status string, conclusion_cap string, reason string"


class AttemptLedger(StatefulProcessor):
    """Keeps (budget, tries used, finished) per audit identity.

    Submissions of one micro-batch are taken in ``seq`` order. An open identity
    expires after the given time without a submission; a finished one never does.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        state = T.StructType([T.StructField("budget", T.IntegerType()), T.StructField("used", T.IntegerType()), T.StructField("done", T.BooleanType())])
        self.state = handle.getValueState("ledger", state, ttlDurationMs=self.ttl_ms)
        self.finished = handle.getValueState("finished", state)

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        held = self.finished if self.finished.exists() else self.state
        budget, used, done = held.get() if held.exists() else (None, 0, False)
        out = []
        for sub in batch.itertuples():
            reason = status = None
            wanted = int(sub.max_attempts)
            if done:
                reason = "attempt after a final one"
            elif budget is not None and wanted != budget:
                reason = "attempt limit differs from the first one"
            else:
                budget, used = wanted, used + 1
                status = "COMPLETE" if sub.valid else "PARTIAL" if used == budget else "RETRY_REQUIRED"
                done = status != "RETRY_REQUIRED"
            cap = None if status is None else "NONE" if status == "COMPLETE" else "INCONCLUSIVE"
            out.append((key[0], sub.report_hash, None if reason else used, budget, status, cap, reason))
        (self.finished if done else self.state).update((budget, used, done))
        frame = pd.DataFrame(out, columns=["identity", "report_hash", "attempt", "max_attempts", "status", "conclusion_cap", "reason"])
        yield frame.astype({"attempt": "Int32", "max_attempts": "Int32"})

    def close(self) -> None:
        pass


def attempt_stream(submissions: DataFrame, ttl_ms: int = 30 * 24 * 3600 * 1000) -> DataFrame:
    """Streaming twin of ``operators.attempts.evaluate_attempts``.

    Rows without a full identity or with a budget outside 1..3 have to be
    filtered by the caller; they never reach a state.
    """
    s = submissions.withColumn("identity", identity_hash(F.col("audit_id"), F.col("claim_id"), F.col("freeze_hash"), F.col("cutoff")))
    s = s.filter(F.col("identity").isNotNull() & F.col("max_attempts").between(1, 3)).select("identity", "seq", "max_attempts", "valid", "report_hash")
    return s.groupBy("identity").transformWithStateInPandas(AttemptLedger(ttl_ms), ATTEMPT_OUT, "Append", "ProcessingTime")


def run_ledger(submissions: DataFrame, folder: str) -> DataFrame:
    """Drain a bounded stream of submissions into ``folder`` and return every submission's outcome.

    Each micro-batch is judged together with the earlier submissions of the identities
    it holds, by the batch operator, and its own rows are written under its number: a
    batch that is repeated after a failure overwrites itself. Submissions of one identity
    must arrive in ``seq`` order across batches. Columns: the submission's, ``identity``,
    ``attempt``, ``status``, ``reason``.
    """
    schema = submissions.schema

    def judge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = batch.withColumn("_batch", F.lit(number))
        name = identity_hash(F.col("audit_id"), F.col("claim_id"), F.col("freeze_hash"), F.col("cutoff"))
        known = [f"{folder}/history/number={n}" for n in range(number)]
        if known:
            earlier = spark.read.schema(schema).parquet(*known).withColumn("_batch", F.lit(-1))
            touched = own.select(name.alias("_identity")).distinct()
            own = own.unionByName(earlier.withColumn("_identity", name).join(touched, "_identity", "left_semi").drop("_identity"))
        good, bad = evaluate_attempts(own)
        rows = good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)
        keep = [*schema.names, "identity", "attempt", "status", "reason"]
        rows.filter(F.col("_batch") == number).select(*keep).write.mode("overwrite").parquet(f"{folder}/outcomes/number={number}")
        batch.write.mode("overwrite").parquet(f"{folder}/history/number={number}")

    run = submissions.writeStream.foreachBatch(judge).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return submissions.sparkSession.read.parquet(f"{folder}/outcomes").drop("number")


def run_candidates(records: DataFrame, folder: str, lateness: str = "1 day") -> DataFrame:
    """Drain a bounded stream of records into ``folder`` through :func:`new_candidates` and return what it kept."""
    sink = new_candidates(records, lateness).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/kept")
    sink.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return records.sparkSession.read.schema(records.schema).parquet(f"{folder}/kept")


def new_candidates(records: DataFrame, lateness: str = "1 day") -> DataFrame:
    """First record of each canonical key per audit; later copies inside the watermark are dropped.

    Fuzzy merging stays a batch job.
    """
    return records.withWatermark("retrieved_at", lateness).dropDuplicatesWithinWatermark(["audit_id", "canonical_key"])
