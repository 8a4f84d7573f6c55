"""The streams over the given tables, each run over all there is and returned as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import place
from ..streaming import jobs
from .registry import query, table


def drained(spark, df: DataFrame, mode: str = "append") -> DataFrame:
    """The rows of a stream after everything available has been read."""
    at = place(spark, "stream")
    if mode != "append":

        def keep(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/rows")

        q = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    else:
        q = df.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/rows")


def stream_of(spark, d, name):
    """A table as a stream, be it one file or a folder of them: a pattern, which has that name alone."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


@query("""WITH t AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations WHERE role <> 'system'), u AS (SELECT * FROM t WHERE role = 'user'),
s AS (SELECT conv_id, turn, least(100, 20 + sum(1 + CASE WHEN contains(text, 'tion') THEN 2 ELSE 0 END + CASE WHEN contains(text, 'less') AND contains(coalesce(reply, ''), 'the') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn))::INT AS score,
  last_value(CASE WHEN length(text) > 20 AND (contains(text, 'tion') OR contains(text, 'less')) THEN substr(text, 1, 120) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS important FROM u)
SELECT conv_id::VARCHAR AS key, s.turn AS seq, score, CASE WHEN score >= 50 THEN 'close' WHEN score >= 25 THEN 'known' ELSE 'new' END AS stage, important,
  CASE WHEN contains(text, 'tion') THEN 'glad' WHEN contains(text, 'less') THEN 'low' ELSE 'steady' END AS mood FROM s JOIN u USING (conv_id, turn)""")
def x1_stream_engagement(spark, d):
    """The turns come in two triggers, each with some of every conversation's."""
    reply = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = table(spark, d, "conversations").filter("role <> 'system'").withColumn("reply", reply).filter("role = 'user'")
    time = F.timestamp_seconds(1_700_000_000 + 60 * F.col("turn"))
    rows = turns.select(F.col("conv_id").cast("string").alias("key"), F.col("turn").alias("seq"), "text", "reply", time.alias("at"))
    at = place(spark, "turns")
    half = F.pmod(F.xxhash64("key", "seq"), F.lit(2))
    for i in (0, 1):
        rows.filter(half == i).coalesce(1).write.mode("append").parquet(at)
    for name, value in jobs.STORE.items():
        spark.conf.set(name, value)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(at)
    return jobs.settled(drained(spark, jobs.stream_engagement(stream, positive=("tion",), low=("less",), comfort=("the",)), "update"))


@query("SELECT sha256(text) AS digest FROM documents GROUP BY text")
def x2_stream_dedup(spark, d):
    out = jobs.stream_dedup(stream_of(spark, d, "documents").select("doc_id", "text"), F.col("text"))
    return drained(spark, out.select("digest"))


@query("SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def x3_stream_daily(spark, d):
    return drained(spark, jobs.daily(stream_of(spark, d, "events"), "ts", "event_type"), "complete")


@query("WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) SELECT conv_id::VARCHAR AS key, turn AS seq FROM r WHERE n % 3 = 0")
def x4_stream_turn_trigger(spark, d):
    rows = stream_of(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("key"), F.col("turn").alias("seq"))
    return drained(spark, jobs.stream_every_nth(rows, 3))
