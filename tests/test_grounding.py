import random

import pytest
from pyspark.sql import functions as F

from inkproof.functions import ratio
from inkproof.operators import grounding
from inkproof.operators.responses import DEFAULT_RECORD
from tests.plain import plain_find
from workload import frames

VECTORS = [  # value, text, (found, confidence) at 0.8, at 0.7
    ("Chan Accounting", "Chan Accounting", (True, 1.0), (True, 1.0)),
    ("Chan Acounting", "Chan Accounting", (True, 0.9736842105263157), (True, 0.9736842105263157)),
    ("Chan Acount", "Chan Accounting", (False, 0.5), (True, 0.875)),
    ("John Smith", "Chan Accounting", (False, 0.0), (False, 0.0)),
    ("January 15, 2024", "Date: 15/01/2024", (False, 0.0), (False, 0.0)),
    ("500.00", "TOTAL $500", (False, 0.0), (False, 0.0)),
    ("500.00", "TOTAL 1,500.00", (True, 1.0), (True, 1.0)),
    ("1234567.80", "$1,234,567.80", (True, 1.0), (True, 1.0)),
    ("", "abc", (True, 1.0), (True, 1.0)),
    ("$ $", "abc", (True, 1.0), (True, 1.0)),
    ("Gordon Paul", "Paul J Gordon", (True, 1.0), (True, 1.0)),
    ("2024-01-15", "2024-01-16", (True, 0.9), (True, 0.9)),
    ("abc", "", (False, 0.0), (False, 0.0)),
    ("-5.00", "(5.00)", (False, 0.0), (True, 0.7272727272727273)),
]


def _finds(spark, rows, **options):
    frame = spark.createDataFrame(rows, "id int, value string, text string")
    frame = frame.withColumn("values", F.array("value"))
    found = grounding.find_values(frame, "values", keys=["id"], text="text", **options)
    return {r.id: (r.found, r.confidence) for r in found.collect()}


def test_vectors(spark):
    rows = [(i, v[0], v[1]) for i, v in enumerate(VECTORS)]
    for threshold, position in ((0.8, 2), (0.7, 3)):
        got = _finds(spark, rows, threshold=threshold)
        assert got == {i: v[position] for i, v in enumerate(VECTORS)}


def _random_rows(n, seed):
    r = random.Random(seed)

    def word():
        return "".join(r.choice("abcdeé01.") for _ in range(r.randint(1, 9)))

    texts = [" ".join(word() for _ in range(r.choice([0, 3, 30, 90]))) for _ in range(n)]
    values = []
    for t in texts:
        kept = [w[:-1] + "z" if r.random() < 0.5 else w for w in r.sample(t.split(), min(3, len(t.split())))]
        values.append(" ".join(kept + [word() for _ in range(r.randint(0, 12))]))
    return list(zip(range(n), values, texts))


def test_pruning_changes_nothing_and_matches_brute_force(spark):
    rows = _random_rows(300, 11)
    for threshold in (0.0, 0.4, 0.7, 0.8, 1.0):
        pruned = _finds(spark, rows, threshold=threshold)
        assert pruned == _finds(spark, rows, threshold=threshold, prune=False)
        for i, value, text in rows:
            found, confidence = plain_find(value, text, threshold)
            assert pruned[i][0] == found
            assert abs(pruned[i][1] - confidence) < 1e-12


def test_repeated_text_words_and_thresholds(spark):
    rows = _random_rows(200, 5)
    doubled = [(i, v, t + " . " + t) for i, v, t in rows]
    plain_dot = [(i, v, t + " . ") for i, v, t in rows]
    by_threshold = [_finds(spark, rows, threshold=t) for t in (0.6, 0.7, 0.8, 0.9)]
    for i, value, text in rows:
        levels = [by[i][1] for by in by_threshold]
        assert levels == sorted(levels, reverse=True)
    fuzzy_only = {i for i, r in _finds(spark, doubled).items() if r[1] != 1.0}
    once, twice = _finds(spark, plain_dot), _finds(spark, doubled)
    assert all(once[i] == twice[i] for i in fuzzy_only)


def test_whole_documents_match_brute_force(spark, small):
    docs = frames.table(spark, small, "documents").where(F.length("text") < 3000)
    line = F.translate(F.element_at(F.split("text", "\n"), 1), "e", "c")
    docs = docs.select("doc_id", "text", F.array(line).alias("values")).orderBy("doc_id").limit(40)
    kept = docs.collect()
    found = grounding.find_values(
        spark.createDataFrame(kept, docs.schema), "values", keys=["doc_id"], text="text"
    )
    got = {r.doc_id: (r.found, r.confidence) for r in found.collect()}
    for row in kept:
        want = plain_find(row["values"][0], row.text, 0.8)
        assert got[row.doc_id][0] == want[0]
        assert abs(got[row.doc_id][1] - want[1]) < 1e-12


GOLDEN_TEXT = """# INVOICE

## N O .

Paul J Gordon
0324

| DESCRIPTION | HOURS | RATE | AMOUNT |
| First task | 5 | $\\$ 50$ | $\\$ 100.00$ |
| Second task | 2 | $\\$ 50$ | $\\$ 100.00$ |
TOTAL $\\$ 500.00$"""


def _golden(spark):
    items = [(d, 5.0, 50.0, 100.0) for d in ("First task", "Second task", "First task", "Second task", "First task")]
    record = ("invoice", "0324", None, ("Chan Accounting", None, None), ("Paul J Gordon", None, None),
              (500.0, "USD"), items)
    rows = [(1, GOLDEN_TEXT, *record), (2, "abc", "memo", None, None, None, None, None, None),
            (3, "abc", "memo", "abc", None, None, None, None, [])]
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in DEFAULT_RECORD.fields)
    return spark.createDataFrame(rows, f"doc_id bigint, ocr_text string, {columns}")


def test_golden_record(spark):
    grounded = grounding.ground(_golden(spark))
    summary = {r.doc_id: r for r in grounding.doc_confidence(grounded).collect()}
    one = summary[1]
    assert (one.overall_confidence, one.total_fields) == (0.87, 6)
    assert (one.high_confidence, one.medium_confidence, one.low_confidence) == (5, 0, 1)
    assert (summary[2].overall_confidence, summary[2].total_fields) == (1.0, 5)
    assert summary[3].total_fields == 5
    fields = {(r.doc_id, r.field): r for r in grounding.field_scores(grounded).collect()}
    supplier = fields[1, "supplier_name"]
    assert (supplier.found_in_ocr, supplier.confidence, supplier.note) == (False, 0.0, "not found in OCR")
    assert fields[1, "document_date"].note == "Field is null"
    assert fields[1, "line_items"].extracted == "5 items"
    assert fields[1, "line_items"].note == "average across 5 items"
    assert grounding.line_item_scores(grounded).count() == 5


def test_weights_and_filters_on_scores(spark):
    grounded = grounding.ground(_golden(spark))
    none = grounding.doc_confidence(grounded, weights={f.name: 0.0 for f in grounding.DEFAULT_FIELDS} | {"line_items": 0.0})
    assert {r.overall_confidence for r in none.collect()} == {0.0}
    equal = grounding.doc_confidence(grounded, weights={}).where("overall_confidence < 0.9")
    assert [(r.doc_id, r.overall_confidence) for r in equal.collect()] == [(1, 0.833)]
    low = grounding.field_scores(grounded).where("confidence < 0.5")
    assert [r.field for r in low.collect()] == ["supplier_name"]


def test_own_fields(spark):
    rows = [(1, "Lease 77 of Anna Berg for 1,200.00 EUR", "77", "Anna Borg", 1200.0)]
    docs = spark.createDataFrame(rows, "id int, body string, number string, tenant string, rent double")
    fields = [
        grounding.Field("number", "number"),
        grounding.Field("tenant", "tenant"),
        grounding.Field("rent", "rent", is_amount=True),
    ]
    grounded = grounding.ground(docs, keys=["id"], text="body", fields=fields, items=None, threshold=0.7)
    got = {r.field: (r.found_in_ocr, r.confidence) for r in grounding.field_scores(grounded, ["id"]).collect()}
    assert got == {"number": (True, 1.0), "tenant": (True, 0.875), "rent": (True, 1.0)}


def test_ratio_is_ordered(spark):
    pairs = [("tide", "diet", 0.25), ("diet", "tide", 0.5), ("ab", "ba", 0.5), ("smith", "smyth", 0.8)]
    frame = spark.createDataFrame(pairs, "a string, b string, want double")
    got = grounding.text_similarity(frame, "a", "b").collect()
    assert all(r.similarity == r.want for r in got)
    edge = [("", "", 1.0), (None, "", 1.0), ("", "a", 0.0), ("$", "a", 0.95), ("a b", "A  B", 1.0)]
    frame = spark.createDataFrame(edge, "a string, b string, want double")
    assert all(r.similarity == r.want for r in grounding.text_similarity(frame, "a", "b").collect())


def _long_row(spark, n):
    """One document of ``n`` items, none of which its two words hold."""
    item = lambda i: F.struct(
        F.concat(F.lit("zzz"), i.cast("string")).alias("description"), (i * 1.5).cast("double").alias("total")
    )
    return spark.range(1).select(
        F.col("id").alias("doc_id"),
        F.lit("aa bb").alias("ocr_text"),
        F.transform(F.sequence(F.lit(1), F.lit(n)), item).alias("line_items"),
    )


def test_long_rows_take_linear_time(spark):
    import time

    def seconds(n):
        started = time.perf_counter()
        rows = grounding.ground(_long_row(spark, n), fields=()).select(F.size("item_scores").alias("n")).collect()
        assert rows[0].n == n
        return time.perf_counter() - started

    seconds(100)
    few, many = (min(seconds(n) for _ in range(2)) for n in (8_000, 16_000))
    assert many <= 2.5 * few + 0.5


def test_words_just_below_and_above_the_array_path(spark):
    """Both ways of bounding word pairs (512 of them or fewer, and more) give the same."""
    r = random.Random(17)
    word = lambda: "".join(r.choice("abcdeé01") for _ in range(r.randint(2, 8)))
    rows = []
    for i in range(60):
        text = [word() for _ in range(r.choice([30, 31, 32, 33, 34]))]
        value = [r.choice(text)[:-1] + r.choice("xyz") for _ in range(r.choice([15, 16, 17]))]
        rows.append((i, " ".join(value), " ".join(text)))
    got = _finds(spark, rows, threshold=0.8)
    for i, value, text in rows:
        found, confidence = plain_find(value, text, 0.8)
        assert got[i][0] == found and abs(got[i][1] - confidence) < 1e-12


def test_amounts_as_text_and_plain_doubles(spark):
    rows = [
        (1, "1,234.50", 12345678.5, "Total 1234.50 and 12345678.5"),
        (2, "USD -5", 1e7, "5.00 10000000.0"),
        (3, "n/a", 0.5, "N/A 0.5"),
        (4, "", None, "x"),
        (5, None, 1.5e16, "1.5e+16"),
    ]
    frame = spark.createDataFrame(rows, "doc_id int, amount string, size double, ocr_text string")
    fields = [grounding.Field("amount", "amount", is_amount=True), grounding.Field("size", "size")]
    scored = grounding.field_scores(grounding.ground(frame, fields=fields, items=None)).collect()
    got = {(r.doc_id, r.field): (r.extracted, r.found_in_ocr) for r in scored}
    assert got[1, "amount"] == ("1234.50", True) and got[1, "size"] == ("12345678.5", True)
    assert got[2, "amount"] == ("5.00", True) and got[2, "size"] == ("10000000.0", True)
    assert got[3, "amount"] == ("n/a", True) and got[5, "size"] == ("1.5e+16", True)
    assert got[5, "amount"] == (None, True) and got[4, "size"] == (None, True)


def test_an_order_of_many_lines_is_one_invoice(spark, small, tmp_path):
    for name in ("orders", "customer", "part", "supplier"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    lines = spark.read.parquet(f"{small}/lineitem.parquet")
    one = lines.limit(1).drop("l_linenumber").crossJoin(spark.range(1, 451).select(F.col("id").alias("l_linenumber")))
    one.select(lines.columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    built = frames.invoices(spark, str(tmp_path)).where(F.size("line_items") > 0)
    docs = built.collect()
    assert [len(d.line_items) for d in docs] == [450]
    text = docs[0].ocr_text
    assert text.count("\n| ") == 450 and text.count("# INVOICE") == 1
    scored = grounding.ground(built).select(F.size("item_scores").alias("n")).collect()
    assert [s.n for s in scored] == [450]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 0.8, 0.95, 1.0])
def test_word_index_passes_nothing_over(threshold):
    r = random.Random(3)

    def some(n, letters):
        return list(dict.fromkeys("".join(r.choices(letters, k=r.randint(1, 14))) for _ in range(n)))

    for letters in ("ab", "abcdé𝔘", "abcdefghijklmnopqrstuvwxyz"):
        words = some(40, letters)
        others = some(600, letters) + [w[:2] + r.choice(letters) + w[3:] for w in words] + [w * 2 for w in words]
        others = list(dict.fromkeys(others))
        every = ratio.best_ratios(threshold, prune=False)()(words, others)
        for index_from in (1, 1000):
            found = ratio.best_ratios(threshold, index_from=index_from)()(words, others)
            assert [x * (x >= threshold) for x in found] == [x * (x >= threshold) for x in every]
