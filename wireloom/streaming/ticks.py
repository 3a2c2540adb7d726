"""The training schedule as a state machine over ticks, and the log of what it says.

A tick looks at the number of corrections.  Below the threshold it is skipped;
otherwise training is due, started, and then done or failed.  Each step is a row
of the notification log; counters and the last result are one row of state.  The
corrections stay, so that a due state is due again at the next tick.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "seq bigint, event_type string, message string, payload string, timestamp string"


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


@dataclass
class State:
    """Counters of a schedule."""

    total_checks: int = 0
    total_retrains: int = 0
    last_check_at: str | None = None
    last_retrain_at: str | None = None
    last_result: dict | None = None
    said: int = 0


@dataclass
class Schedule:
    """Ticks of one schedule; ``train`` returns a result with ``status``, and where it succeeds maybe ``weights_path``."""

    spark: SparkSession
    log_path: str
    threshold: int
    train: Callable[[], dict]
    register: Callable[[str, dict], None] | None = None
    webhook: Callable[[dict], None] | None = None
    state: State = field(default_factory=State)

    def notify(self, event_type: str, payload: dict, message: str = "") -> dict:
        """Appends to the log and calls the webhook; a webhook that fails changes nothing."""
        self.state.said += 1
        entry = {"event_type": event_type, "message": message, "payload": payload, "timestamp": _now()}
        row = (self.state.said, event_type, message, json.dumps(payload, ensure_ascii=False), entry["timestamp"])
        self.spark.createDataFrame([row], EVENTS).write.mode("append").json(self.log_path)
        if self.webhook:
            try:
                self.webhook(entry)
            except OSError:
                pass
        return entry

    def tick(self, n_corrections: int) -> dict:
        state = self.state
        state.total_checks += 1
        state.last_check_at = _now()
        if n_corrections < self.threshold:
            return {"status": "skipped", "reason": "threshold_not_reached"}
        self.notify("retrain_due", {"feedback_count": n_corrections}, f"{n_corrections} corrections have come")
        self.notify("retrain_started", {"feedback_count": n_corrections})
        try:
            result = self.train()
        except Exception as e:  # whatever training raises is its result
            result = {"status": "failed", "error": str(e)}
        state.last_retrain_at = _now()
        state.last_result = result
        state.total_retrains += 1
        if result.get("status") == "success":
            self.notify("retrain_done", result, "training finished")
            if self.register and result.get("weights_path"):
                self.register(result["weights_path"], result.get("metrics", {}))
        else:
            self.notify("retrain_failed", result, "training failed")
        return {"status": "retrained", "result": result}

    def save(self, path: str) -> None:
        """The state as a table of one row."""
        row = asdict(self.state) | {"last_result": json.dumps(self.state.last_result)}
        kind = "total_checks bigint, total_retrains bigint, last_check_at string, last_retrain_at string, last_result string, said bigint"
        self.spark.createDataFrame([tuple(row.values())], kind).write.mode("overwrite").parquet(path)

    def load(self, path: str) -> None:
        row = self.spark.read.parquet(path).first().asDict()
        self.state = State(**(row | {"last_result": json.loads(row["last_result"])}))


def history(spark: SparkSession, log_path: str, most: int = 100) -> DataFrame:
    """The last notifications; lines that don't parse go."""
    rows = spark.read.schema(EVENTS + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(log_path)
    return rows.where(F.col("_bad").isNull()).drop("_bad").orderBy(F.desc("seq")).limit(most)


def run(stream: DataFrame, schedule: Schedule, checkpoint: str, counts: str, every: str | None = None) -> StreamingQuery:
    """A tick after each batch of a stream of corrections, by running counts: a row for each batch, written again if the batch is.

    ``every``: a processing time; without one, what is there is gone through once.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        n = batch.count()
        spark.createDataFrame([(number, n)], "batch bigint, n bigint").write.mode("overwrite").parquet(f"{counts}/batch-{number:012d}")
        total = spark.read.parquet(f"{counts}/batch-*").where(F.col("batch") <= number).agg(F.sum("n")).first()[0]
        schedule.tick(total)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
