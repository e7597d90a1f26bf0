"""Topic envelopes: batches against a step-by-step simulation, and the stream against batches."""

import random

from loomsheet.streaming import topics

FIELDS = "topic_id string, topic_sequence long, payload_ref string, ordering_key long, dedupe_identity string"


def simulated(rows):
    seen, top, out = set(), {}, []
    for r in sorted(rows, key=lambda r: (r[3], r[0], r[1], r[4], r[2])):
        if r[4] in seen:
            continue
        seen.add(r[4])
        if r[1] >= top.get(r[0], r[1]):
            top[r[0]] = r[1]
            out.append(r)
    return out


def made(seed, n=60):
    rng = random.Random(seed)
    return [(rng.choice("ab"), rng.randrange(9), str(i), i // 2, str(rng.randrange(40))) for i in range(n)]


def test_batches(spark):
    for seed in range(4):
        rows = made(seed)
        got = topics.accepted(spark.createDataFrame(rows, FIELDS)).collect()
        assert sorted(map(tuple, got)) == sorted(simulated(rows))
    assert topics.accepted(spark.createDataFrame([], FIELDS)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = made(7)
    schema = "topic_id string, topic_sequence long, payload_ref string, ordering_key long, dedupe_identity string, ts timestamp"
    for i in (0, 1):
        part = spark.createDataFrame(rows[30 * i : 30 * i + 30], FIELDS).selectExpr("*", "timestamp_seconds(1700000000 + ordering_key) as ts")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = topics.accepted_stream(stream).writeStream.format("memory").queryName("accepted_stream_out")
    query = out.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = [tuple(r) for r in spark.sql("select * from accepted_stream_out").collect()]
    assert sorted(got) == sorted(simulated(rows))
