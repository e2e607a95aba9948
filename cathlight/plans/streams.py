"""Queries that run as streams over the tables; they join the catalogue's."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.scratch import folder_for
from ..streaming import status as S
from .catalog import query

STALE, DELAY = 6 * 3_600_000, 2 * 3_600_000


def _status():
    return F.when(F.col("event_type").isin("signup", "view"), "in_progress").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "error")


@query(f"""WITH e AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) // 1000 AS ms, ts, event_id, CASE WHEN event_type IN ('signup', 'view') THEN 'in_progress' WHEN event_type = 'purchase' THEN 'completed' WHEN event_type = 'error' THEN 'error' END AS status FROM events),
  m AS (SELECT max(ms) - {DELAY} AS mark FROM e), o AS (SELECT e.*, lag(status) OVER w AS prior, lag(ms) OVER w AS last, lead(ms) OVER w AS next FROM e, m WHERE status IS NOT NULL AND user_id_ok AND ms <= mark WINDOW w AS (PARTITION BY key ORDER BY ms, event_id)),
  c AS (SELECT key, ms, event_id, 1 AS turn, status FROM o WHERE prior IS NULL OR prior <> status OR (prior = 'in_progress' AND ms - last > {STALE})
    UNION ALL SELECT key, ms + {STALE}, event_id, 2, 'stalled' FROM o, m WHERE status = 'in_progress' AND ms + {STALE} <= mark AND coalesce(next - ms > {STALE}, true))
  SELECT key, ms, status, (sum((status = 'in_progress')::INTEGER) OVER (PARTITION BY key ORDER BY ms, turn, event_id ROWS UNBOUNDED PRECEDING))::INTEGER AS attempts FROM c""".replace(" AND user_id_ok", " AND key IS NOT NULL"))
def statuses_by_stream(spark, d):
    stream = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parque[t]")  # a pattern: the table may be one file or a folder
    top = f"{folder_for(spark)}/status-{uuid.uuid4().hex[:12]}"
    S.write_by_batch(S.transitions(stream, "user_id", "ts", "event_id", _status(), STALE, f"{DELAY} milliseconds"), top, f"{top}/checkpoint")
    return S.status_table(spark, top).withColumnRenamed("at", "ms")
