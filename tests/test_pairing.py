"""Questions and answers of a stream: the rows of a whole table, though the stream is stopped and started again mid-way."""

import datetime as dt

from pyspark.sql import functions as F

from millrace.streaming import chat

STORE = "spark.sql.streaming.stateStore.providerClass"


def test_pairs_survive_a_restart(spark, tmp_path):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    c = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").where("conv_id < 12")
    c = c.withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("conv_id") + 60 * F.col("turn")))
    rows = [tuple(r) for r in c.select("conv_id", "turn", "role", "text").orderBy("conv_id", "turn").collect()]
    c.where("turn < 2").coalesce(1).write.parquet(f"{tmp_path}/in")

    def run():
        stream = chat.answered(spark.readStream.schema(c.schema).parquet(f"{tmp_path}/in"), "1 minute")
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()
        return {(r["conv_id"], r["turn"]): (r["question"], r["answer"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    try:
        first = run()
        want = {}
        for (conv, turn, role, text), after in zip(rows, [*rows[1:], (None,)]):
            if role == "user":
                want[conv, turn] = (text, after[3] if after[0] == conv else None)
        assert first == {k: v for k, v in want.items() if v[1] is not None and k[1] == 0} != {}
        c.where("turn >= 2").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        assert run() == {k: v for k, v in want.items() if v[1] is not None}  # the state is that of the run before
        # a much later turn moves the watermark: questions without an answer come out
        late = spark.createDataFrame([(99, 0, dt.datetime(2030, 1, 1), "assistant", "hello")], "conv_id long, turn long, ts timestamp, role string, text string")
        late.select(*c.columns).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        assert run() == want
    finally:
        spark.conf.unset(STORE)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
