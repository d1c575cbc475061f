"""Stores under several writers and readers, stored models, and streams whose rows come late, in any
order, again or not any more."""

import os
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quillion.operators import chunking as C
from quillion.operators import vectors as V
from quillion.sources import commits
from quillion.sources import store as S
from quillion.streaming import jobs

CHUNK = "src long, doc_name string, text string"


def chunks(spark, first, n):
    return spark.createDataFrame([(first + i, None if i % 5 == 0 else "d", "t") for i in range(n)], CHUNK)


def test_two_writers_get_disjoint_consecutive_ids(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: S.append_chunks(chunks(spark, 100 * k, 7 + k), path, ["src"]), range(6)))
    rows = S.read_store(spark, path).collect()
    n = sum(7 + k for k in range(6))
    assert sorted(r.rid for r in rows) == list(range(n))
    for k in range(6):  # an append's ids follow each other in its order
        own = sorted((r.src, r.rid) for r in rows if r.src // 100 == k)
        assert [b - own[0][1] for _, b in own] == list(range(7 + k))
    assert {r.doc_name for r in rows} == {"d", "Unknown.pdf"}
    assert sorted(r.version for r in commits.log(spark, path, "default").collect()) == list(range(1, 7))


def test_a_claim_is_made_once(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: commits.claim(spark, f"file://{tmp_path}/log/1.json", f"{k}"), range(16)))
    assert sum(won) == 1 and open(f"{tmp_path}/log/1.json").read() == str(won.index(True))
    assert os.listdir(f"{tmp_path}/log") == ["1.json"]


def test_an_append_again_is_the_same_append(spark, tmp_path):
    path = f"{tmp_path}/store"
    S.append_chunks(chunks(spark, 0, 4), path, ["src"], name="b1")
    again = S.append_chunks(chunks(spark, 0, 4), path, ["src"], name="b1")
    assert sorted(r.rid for r in again.collect()) == [0, 1, 2, 3]


def test_reset_is_one_step(spark, tmp_path):
    path = f"{tmp_path}/store"
    assert not S.ensure_ns(spark, path, "a", 8, "m")
    S.append_chunks(chunks(spark, 0, 5), path, ["src"], "a")
    S.append_chunks(chunks(spark, 0, 3), path, ["src"], "b")
    before = S.read_store(spark, path, "a")  # a reader that began before the reset
    assert not S.ensure_ns(spark, path, "a", 8, "m") and S.read_store(spark, path, "a").count() == 5
    assert S.ensure_ns(spark, path, "a", 16, "m")
    assert S.read_store(spark, path, "a").count() == 0 and before.count() == 5 and S.read_store(spark, path, "b").count() == 3
    S.append_chunks(chunks(spark, 0, 2), path, ["src"], "a")
    assert sorted(r.rid for r in S.read_store(spark, path, "a").collect()) == [0, 1]
    assert commits.vacuum(spark, path, "a") == 1 and S.read_store(spark, path, "a").count() == 2
    S.reset_ns(spark, path, "a")
    assert commits.state(spark, path, "a")["dim"] == 16 and S.read_store(spark, path, "a").count() == 0


def test_rows_not_committed_are_not_there(spark, tmp_path):
    path = f"{tmp_path}/store"
    S.append_chunks(chunks(spark, 0, 3), path, ["src"])
    chunks(spark, 50, 9).withColumn("place", F.col("src")).write.parquet(f"{path}/ns=default/commit=cdead")
    assert S.read_store(spark, path).count() == 3


def test_stored_model_in_steps(spark, tmp_path):
    texts = ["the cat sat", "the dog ran far", "a bird", None, "", "the cat and the dog"]
    df = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    first = V.add_texts(df.where("rid < 3"), f"{tmp_path}/m", "ns", 64)
    V.add_texts(df.where("rid >= 3"), f"{tmp_path}/m", "ns", 64, name="second")
    last = V.add_texts(df.where("rid >= 3"), f"{tmp_path}/m", "ns", 64, name="second")  # once only
    V.add_texts(df, f"{tmp_path}/m", "whole", 64)
    model = V.vectorizer(spark, f"{tmp_path}/m", "ns")
    assert model.version == last > first and model.weights == V.vectorizer(spark, f"{tmp_path}/m", "whole").weights
    assert V.vectorizer(spark, f"{tmp_path}/m", "ns", first).weights != model.weights
    alone = {r.rid: r.embedding for r in V.embed(df.where("rid = 1"), model).collect()}
    every = {r.rid: r.embedding for r in V.embed(df, model).collect()}
    assert every[1] == alone[1] and abs(sum(x * x for x in every[1]) - 1) < 1e-9 and sum(map(abs, every[4])) == 0
    assert every[0] == {r.rid: r.embedding for r in V.embed(df, dim=64).collect()}[0]  # fitted on the same texts


def feed(spark, path, frames):
    """Folders of one file each, read one a batch in this order."""
    for k, df in enumerate(frames):
        df.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1 if k + 1 < len(frames) else 0)  # files go by the time they were written
    return jobs.stateful_session(spark).readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


PAGES = "doc_name string, page int, text string"


def page(doc, k, extra=""):
    return (doc, k, f"HEAD OF {doc.upper()}\nPage {k} has some text. It goes on; and on {extra}.\n- a bullet {k}\nFoot {doc}")


def test_ingest_in_any_order_is_the_batch(spark, tmp_path):
    every = [page(d, k) for d in "ab" for k in range(1, 7)] + [page("c", 1, "x" * 5900), ("d", 1, ""), ("d", 2, None)]
    late = [page("a", 2, "changed"), ("b", 3, "")]  # a page that comes again, and one that loses its text
    order = [every[i] for i in (7, 0, 12, 3)], [every[i] for i in (1, 2, 13, 8, 9)], [every[i] for i in (4, 5, 6, 10, 11, 14)], late
    stream = feed(spark, f"{tmp_path}/in", [spark.createDataFrame(rows, PAGES) for rows in order])
    jobs.stream_ingest(stream, f"{tmp_path}/store", f"{tmp_path}/cp").start().awaitTermination()
    got = jobs.ingested(spark, f"{tmp_path}/store")
    final = {(d, k): (d, k, t) for d, k, t in every} | {(d, k): (d, k, t) for d, k, t in late}
    names = [x.split()[0] for x in C.CHUNKS.split(", ")]
    want = C.chunk_pages(spark.createDataFrame(list(final.values()), PAGES))
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(map(tuple, want.select(*names).collect()))
    rids = [r.rid for r in got.select("rid").collect()]
    assert len(set(rids)) == len(rids) and not any("HEAD OF" in r.text for r in got.where("doc_name = 'a'").collect())


TURNS = "conv_id long, turn long, q string, a string, ts timestamp_ntz"


def told(out, spark, path):
    write = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{path}/out")
    out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination()
    last: dict = {}
    for r in sorted(spark.read.parquet(f"{path}/out").collect(), key=lambda r: r.batch):
        if last.get(r.conv_id, (None,))[0] != r.batch:
            last[r.conv_id] = (r.batch, [])
        last[r.conv_id][1].extend([] if r.turn is None else [r.turn])
    return {k: sorted(v) for k, (_, v) in last.items()}


@pytest.fixture
def turns(spark):
    from datetime import datetime

    def made(rows):
        return spark.createDataFrame([(c, t, "q" * 40, "a" * 40, datetime(2024, 1, 1, h, m)) for c, t, h, m in rows], TURNS)

    return made


def test_memory_of_turns_out_of_order(spark, tmp_path, turns):
    frames = [turns([(1, 5, 0, 0), (2, 1, 0, 0)]), turns([(1, 3, 0, 0), (1, 4, 0, 0), (1, 5, 0, 0)]), turns([(1, 1, 0, 0), (2, 2, 0, 0)])]
    out = jobs.stream_memory(feed(spark, f"{tmp_path}/in", frames), 60)  # three turns of 20 fit
    assert told(out, spark, str(tmp_path)) == {1: [3, 4, 5], 2: [1, 2]}


def test_idle_conversations_expire_by_event_time(spark, tmp_path, turns):
    frames = [
        turns([(1, 1, 0, 0), (2, 1, 0, 5)]),
        turns([(1, 3, 0, 30), (1, 2, 0, 25)]),
        turns([(3, 1, 2, 0)]),  # moves the watermark to 1:50
        turns([(2, 2, 0, 1), (3, 2, 2, 1)]),  # a turn of conversation 2 behind the watermark
    ]
    out = jobs.stream_memory(feed(spark, f"{tmp_path}/in", frames), idle=3600, late="10 minutes")
    assert told(out, spark, str(tmp_path)) == {1: [], 2: [], 3: [1, 2]}


def test_memory_with_ttl_forgets(spark, tmp_path, turns):
    frames = [turns([(1, 1, 0, 0), (2, 1, 0, 0)]), turns([(1, 2, 0, 0)])]
    out = jobs.stream_memory(feed(spark, f"{tmp_path}/in", frames), ttl=0.001)
    write = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{tmp_path}/out")
    query = out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    found, until = [], time.time() + 120  # by the clock there is always another batch, so it is stopped
    while time.time() < until and query.isActive and (1, 2) not in found:
        time.sleep(2)
        found = [(r.conv_id, r.turn) for r in spark.read.schema("conv_id long, turn long, n_kept int, batch int").parquet(f"{tmp_path}/out").collect()] if os.path.isdir(f"{tmp_path}/out") else []
    query.stop()
    assert sorted(found) == [(1, 1), (1, 2), (2, 1)]  # the first turn was gone when the second came
    with pytest.raises(ValueError):
        jobs.stream_memory(turns([]), ttl=1, idle=1)
