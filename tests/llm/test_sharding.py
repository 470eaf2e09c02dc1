import random
import zlib

from pyspark.sql import functions as F

from loomframe.llm import sharding


def placed(spark, rows, n=4, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, size long, slot string")
    return sharding.assign_shards(df, n, F.xxhash64("text"), "doc_id", "size", **kw).collect()


def check(rows, out, n):
    assert len(out) == len(rows)
    total, most = sum(r[2] or 0 for r in rows), max(r[2] or 0 for r in rows)
    shards = {}
    for r in out:
        shards.setdefault(r.shard, []).append(r)
    for got in shards.values():
        assert sorted(r.slot for r in got) == list(range(len(got)))
    sizes = [sum(r.size or 0 for r in shards.get(s, [])) for s in range(n)]
    assert max(sizes) - min(sizes) < 2 * most + 2 and abs(sum(sizes) - total) == 0


def test_equal_bytes_and_gapless_slots(spark):
    r = random.Random(1)
    rows = [(i, f"t{i}", r.choice((1, 5, 40, 400)), None) for i in range(800)]
    check(rows, placed(spark, rows), 4)
    check(rows, placed(spark, rows, 7, ranges_per_shard=3, samples_per_range=2), 7)


def test_hot_group_is_split_and_stays_together_in_order(spark):
    rows = [(i, "hot", 10, None) for i in range(400)] + [(1000 + i, f"t{i}", 10, None) for i in range(400)]
    out = placed(spark, rows, 8, ranges_per_shard=4)
    check(rows, out, 8)
    line = [r.text for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    first, last = line.index("hot"), len(line) - 1 - line[::-1].index("hot")
    assert last - first + 1 == 400


def test_same_places_again(spark):
    rows = [(i % 90, f"t{i % 60}", i % 13 + 1, None) for i in range(300)]
    key = lambda out: sorted((r.doc_id, r.text, r.size, r.shard, r.slot) for r in out)
    assert key(placed(spark, rows)) == key(placed(spark, rows[::-1]))


def test_odd_rows(spark):
    rows = [(None, None, None, "x"), (None, None, None, "x"), (1, None, 3, None), (1, "", 0, None), (2, "big", 10**9, None)] + [(5, "same", 2, None)] * 6
    out = placed(spark, rows)
    assert len(out) == len(rows)
    for s in {r.shard for r in out}:
        got = [r.slot for r in out if r.shard == s]
        assert sorted(got) == list(range(len(got)))
    df = spark.createDataFrame([], "doc_id long, text string, size long")
    empty = sharding.assign_shards(df, 4, F.xxhash64("text"))
    assert empty.count() == 0 and {"shard", "slot"} <= set(empty.columns)


def test_query_and_writer(spark, tmp_path):
    texts = [None, "", "a", "é" * 9] + [f"text {i}" for i in range(60)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.op1_sharding(spark, str(tmp_path))
    got = out.collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)}
    assert all(r.law == "bytes" and 0 <= r["shard"] < 16 and r.grown_shard is None for r in got)
    sharding.write_shards(out, f"{tmp_path}/shards")
    assert spark.read.parquet(f"{tmp_path}/shards").count() == len(texts)
