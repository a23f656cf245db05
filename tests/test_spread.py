"""The word search dealt over tasks gives the rows of the one inside the row."""

import random
from collections import Counter

from pyspark.sql import functions as F

from inkproof.operators import grounding, spread


def _rows(frame):
    return Counter(tuple(row) for row in frame.collect())


def test_same_rows_as_inside_the_row(spark):
    r = random.Random(11)
    letters = "abcdefg"
    some = lambda n: ["".join(r.choices(letters, k=r.randint(1, 9))) for _ in range(n)]
    rows = [
        (1, ["", None, "abc def", "$ $"], "abc xyz"), (2, ["abc"], None), (2, ["abc"], None), (None, ["abd"], ""),
        (None, ["abd"], ""), (3, None, "text"), (4, [], "text"), (5, ["abcdefg abcdefh"] * 3, "abcdefgh abcdef"), (6, ["zz"], "zz" * 50),
    ]
    for n in range(30):
        rows.append((n, [" ".join(some(r.randint(1, 4))) for _ in range(5)], " ".join(some(r.choice([0, 3, 60])))))
    rows.append((99, [" ".join(some(40)) for _ in range(10)], " ".join(some(3000))))
    docs = spark.createDataFrame(rows, "id int, vs array<string>, t string")
    for threshold in (0.5, 0.8):
        want = _rows(grounding.find_values(docs, "vs", keys=["id"], text="t", threshold=threshold))
        for text_block, word_block in ((1, 2), (100, 7), (4096, 4096)):
            got = spread.find_values_spread(
                docs, "vs", keys=["id"], text="t", threshold=threshold, text_block=text_block, word_block=word_block
            )
            assert _rows(got) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "id int, vs array<string>, t string")
    assert spread.find_values_spread(docs, "vs", keys=["id"], text="t").collect() == []


def test_one_long_text_is_dealt_over_all_tasks(spark):
    r = random.Random(12)
    words = list({"".join(r.choices("abcdefghijklmnop", k=8)) for _ in range(40_000)})
    wanted = [w[:3] + "z" + w[4:] for w in words[:200]]
    rows = spark.createDataFrame([("row", wanted, words)], "_row string, _wanted array<string>, _source array<string>")
    best = spread.best_matches(rows, threshold=0.8, text_block=512, partitions=16)
    assert best.where(F.col("best") >= 0.875).count() == len(wanted)
    pairs = rows.select("_row", F.posexplode(spread._blocks("_source", 512)).alias("_t", "_source")).withColumn("_w", F.lit(0))
    busy = pairs.repartition(16, "_row", "_t", "_w").select(F.spark_partition_id().alias("p")).groupBy("p").count()
    assert busy.count() >= 14


def test_rows_are_made_some_at_a_time():
    import pyarrow as pa

    from inkproof.functions.ratio import row_lists

    r = random.Random(13)
    words = [None if n % 7 == 3 else ["".join(r.choices("ab\u00e9", k=3)) for _ in range(r.randint(0, 4))] for n in range(1100)]
    values = [None if n % 5 == 2 else [r.choice([None, [], ["x", "yz"]]) for _ in range(r.randint(0, 3))] for n in range(1100)]
    for start, size in ((0, 1100), (13, 700), (0, 0)):
        text = pa.array(words, pa.list_(pa.string())).slice(start, size)
        nested = pa.array(values, pa.list_(pa.list_(pa.string()))).slice(start, size)
        parts = list(row_lists()(nested, text))
        assert max(map(len, parts), default=0) < 500
        assert [row for part in parts for row in part] == list(zip(values, words))[start : start + size]
