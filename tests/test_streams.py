"""Engagement over triggers: order, revisions and expiry."""

import random
from datetime import datetime, timedelta

from loomcorpus.plans import streams
from loomcorpus.streaming import jobs

SCHEMA = "key string, seq long, text string, reply string, at timestamp"
START = datetime(2024, 1, 1)


def run(spark, tmp_path, triggers, **more):
    for name, value in jobs.STORE.items():
        spark.conf.set(name, value)
    at = tmp_path / "in"
    at.mkdir()
    for i, rows in enumerate(triggers):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"file://{at}/t{i}")
        part = next((at / f"t{i}").glob("*.parquet"))
        part.rename(at / f"{i}.parquet")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{at}/*.parquet")
    out = []
    done = jobs.stream_engagement(stream, positive=("good",), low=("bad",), comfort=("there",), **more)
    q = done.writeStream.outputMode("update").foreachBatch(lambda b, i: out.append(b.collect())).option("checkpointLocation", f"file://{tmp_path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return out


def test_two_triggers_in_shuffled_order_give_the_rows_of_one(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"k{k}", i, rng.choice(["good", "bad", "so so", "this is a good long text", None]), rng.choice([None, "there there"]), START + timedelta(minutes=i)) for k in range(6) for i in range(15)]
    shuffled = rng.sample(rows, len(rows))
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    once = [r for b in run(spark, tmp_path / "a", [rows]) for r in b]
    twice = [r for b in run(spark, tmp_path / "b", [shuffled[:45], shuffled[45:]]) for r in b]
    final = lambda rows: sorted(map(repr, jobs.settled(spark.createDataFrame(rows, jobs._OUT)).collect()))
    assert final(once) == final(twice) and len(final(once)) == len(rows)
    assert max(r.revision for r in twice) == 2 and {r.mood for r in once} == {"glad", "low", "steady"}
    score = 20
    for r in sorted((r for r in rows if r[0] == "k0"), key=lambda r: r[1]):
        text, reply = r[2] or "", r[3] or ""
        score += 1 + 2 * ("good" in text) + ("bad" in text and "there" in reply)
        assert next(x for x in once if (x.key, x.seq) == ("k0", r[1])).score == score


def test_expired_keys_leave(spark, tmp_path):
    day = timedelta(days=1)
    triggers = [[("old", 0, "good", None, START), ("kept", 0, "good", None, START)], [("kept", 1, "x", None, START + 9 * day)], [("kept", 2, "x", None, START + 10 * day)], [("old", 1, "x", None, START + 11 * day), ("kept", 3, "x", None, START + 11 * day)]]
    rows = [r for b in run(spark, tmp_path, triggers, delay="1 day", keep=5 * day) for r in b]
    scores = {(r.key, r.seq): (r.score, r.revision) for r in rows}
    assert scores["old", 0] == (23, 1) and scores["old", 1] == (21, 1)  # begun anew
    assert scores["kept", 3][1] > 1


def test_a_table_in_many_files_is_read_whole(spark, tmp_path):
    at = f"file://{tmp_path}"
    spark.createDataFrame([(i, f"text {i % 3}") for i in range(9)], "doc_id long, text string").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i % 2, i // 2, "user", "x") for i in range(12)], "conv_id long, turn long, role string, text string").repartition(4).write.parquet(f"{at}/conversations.parquet")
    spark.createDataFrame([(1, "other")], "doc_id long, text string").write.parquet(f"{at}/documents.parquet_old")
    assert streams.x2_stream_dedup(spark, at).count() == 3
    assert sorted(streams.x4_stream_turn_trigger(spark, at).collect()) == [("0", 2), ("0", 5), ("1", 2), ("1", 5)]
