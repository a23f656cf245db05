"""Grounding: how well each extracted field is supported by the source text.

One document is one row, and everything about it is decided inside that row:
no explode, no join and no shuffle between reading the row and writing its
scores.  Work is narrowed step by step, so that only the words that are truly
unresolved reach the Arrow function:

1. null and empty values, and values contained in the text, are settled;
2. words of the missed values that occur in the text are settled (ratio 1);
3. for the rest, words of the text that cannot reach the threshold are skipped.

The values of a row stand in one array, and every step keeps their places (null where a
value is settled), so a verdict is found by its place and the work is linear in the row; a row
without misses costs nothing more.

``ground`` leaves two array columns, ``comparisons`` (one entry per field) and
``item_scores`` (one per line item); the functions below unpack or fold them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkproof.functions import ratio
from inkproof.functions.numbers import compensated_sum, float_text, round_exact
from inkproof.functions.text import normalize, normalize_amount, normalize_amount_text, words

# --- fixed values ------------------------------------------------------------
DEFAULT_THRESHOLD = 0.8
LENIENT_THRESHOLD = 0.7
METHOD = "ocr_extraction_comparison"
ITEMS_FIELD = "line_items"
DEFAULT_WEIGHTS = {
    "document_number": 1.5,
    "document_date": 1.2,
    "supplier_name": 1.0,
    "customer_name": 1.0,
    "total_amount": 2.0,
    "line_items": 1.0,
}
OTHER_WEIGHT = 1.0
NOTE_NULL = "Field is null"
NOTE_EXACT = "exact match"
NOTE_FUZZY = "fuzzy match"
NOTE_MISSING = "not found in OCR"
CONTAINED_SIMILARITY = 0.95
HIGH_CONFIDENCE = 0.9
MEDIUM_CONFIDENCE = 0.5
# -----------------------------------------------------------------------------

_VERDICT = "struct<found:boolean,raw:double,confidence:double>"


@dataclass(frozen=True)
class Field:
    """A field to ground: its name, where its value is, and whether it is an amount."""

    name: str
    value: str
    is_amount: bool = False


@dataclass(frozen=True)
class Items:
    """A repeated part of the record, scored as one field."""

    column: str = "line_items"
    description: str = "description"
    total: str = "total"


DEFAULT_FIELDS = (
    Field("document_number", "document_number"),
    Field("document_date", "document_date"),
    Field("supplier_name", "supplier.name"),
    Field("customer_name", "customer.name"),
    Field("total_amount", "total_amount.amount", is_amount=True),
)
DEFAULT_ITEMS = Items()


def field_text(value: Column, is_amount: bool = False, kind: T.DataType | None = None) -> Column:
    """Text under which a value of type ``kind`` is looked up; null stays null.

    Amounts given as text are read as text, never cast; doubles have their shortest plain form.
    """
    if is_amount:
        text = normalize_amount_text(value) if isinstance(kind, T.StringType) else normalize_amount(value)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = float_text(value.cast("double"))
    else:
        text = value.cast("string")
    return F.when(value.isNotNull(), text)


def _kind(docs: DataFrame, value: str) -> T.DataType:
    return docs.select(F.col(value)).schema[0].dataType


def found_exactly(value_text: Column, normalized_value: Column, normalized_text: Column) -> Column:
    """Null, empty and contained values need no further search."""
    return (
        value_text.isNull() | (value_text == "") | F.contains(normalized_text, normalized_value)
    )


def missed(value: Column, normalized_value: Column, normalized_text: Column) -> Column:
    return ~F.coalesce(found_exactly(value, normalized_value, normalized_text), F.lit(True))


def _judged(docs: DataFrame, text: str, threshold: float, prune: bool) -> DataFrame:
    """Replace ``text`` (normalised) and ``_sought`` (array of values, null where settled) by
    ``_verdicts``: struct<found, raw, confidence> in the places of ``_sought``, null where settled;
    the whole is null for a row without misses."""
    passed = [c for c in docs.columns if c not in (text, "_sought")]
    missing = F.exists("_sought", lambda v: v.isNotNull())
    split = F.transform("_sought", lambda v: F.when(v.isNotNull(), words(normalize(v))))
    # only rows that still look for something are split
    worded = docs.select(
        *passed,
        F.when(missing, split).alias("_words"),
        F.when(missing, F.array_distinct(words(F.col(text)))).alias("_text_words"),
    )
    found = ratio.judge_values(F.col("_words"), F.col("_text_words"), threshold, prune)
    judged = worded.select(*passed, found.alias("_found"))
    verdicts = F.transform(
        "_found",
        lambda v: F.when(
            v.isNotNull(),
            F.struct(v["found"].alias("found"), v["raw"].alias("raw"), _rounded(v["raw"]).alias("confidence")),
        ),
    )
    return judged.select(*passed, verdicts.alias("_verdicts"))


def _rounded(raw: Column) -> Column:
    # most confidences are 0 or 1, which need no arithmetic
    return F.when((raw == 1.0) | (raw == 0.0), raw).otherwise(round_exact(raw))


def _confidence(verdict: Column) -> Column:
    return F.coalesce(verdict["confidence"], F.lit(1.0))


def _comparison(name: Column, value: Column, verdict: Column) -> Column:
    raw, found = F.coalesce(verdict["raw"], F.lit(1.0)), F.coalesce(verdict["found"], F.lit(True))
    return F.struct(
        name.alias("field"),
        value.alias("extracted"),
        found.alias("found_in_ocr"),
        _confidence(verdict).alias("confidence"),
        F.when(value.isNull(), NOTE_NULL)
        .when(raw == 1.0, NOTE_EXACT)
        .when(found, NOTE_FUZZY)
        .otherwise(NOTE_MISSING)
        .alias("note"),
    )


def _items_comparison(mean: Column, n_items: Column, threshold: float) -> Column:
    count = n_items.cast("string")
    return F.struct(
        F.lit(ITEMS_FIELD).alias("field"),
        F.concat(count, F.lit(" items")).alias("extracted"),
        (mean > threshold).alias("found_in_ocr"),
        _rounded(mean).alias("confidence"),
        F.concat(F.lit("average across "), count, F.lit(" items")).alias("note"),
    )


def ground(
    docs: DataFrame,
    *,
    keys: Sequence[str] = ("doc_id",),
    text: str = "ocr_text",
    fields: Sequence[Field] = DEFAULT_FIELDS,
    items: Items | None = DEFAULT_ITEMS,
    threshold: float = DEFAULT_THRESHOLD,
    prune: bool = True,
) -> DataFrame:
    """Ground every field of every record in the text of the same row.

    Returns ``keys``, ``comparisons`` and ``item_scores``.  ``prune=False`` compares
    every pair of words; results are the same, it exists for tests.
    """
    none = F.array().cast("array<string>")
    values = [f"_value_{i}" for i in range(len(fields))]
    if items is None:
        n_items, descriptions, totals = F.lit(0), none, none
    else:
        n_items = F.coalesce(F.size(items.column), F.lit(0))
        records = F.filter(
            F.coalesce(F.col(items.column), F.array()), lambda item: item.isNotNull()
        )
        descriptions = records[items.description].cast("array<string>")
        total_kind = _kind(docs, f"{items.column}.{items.total}").elementType
        totals = F.transform(records[items.total], lambda t: field_text(t, True, total_kind))
    prepared = docs.select(
        *keys,
        normalize(F.col(text)).alias("_text"),
        *[
            field_text(F.col(f.value), f.is_amount, _kind(docs, f.value)).alias(v)
            for f, v in zip(fields, values)
        ],
        n_items.alias("_n_items"),
        descriptions.alias("_descriptions"),
        totals.alias("_totals"),
    )
    source = F.col("_text")
    sought_fields = [
        # the text of an amount is already in normal form
        F.when(missed(F.col(v), F.col(v) if f.is_amount else normalize(F.col(v)), source), F.col(v))
        for f, v in zip(fields, values)
    ]
    sought = F.concat(
        F.array(*sought_fields) if sought_fields else none,
        F.transform("_descriptions", lambda d: F.when(missed(d, normalize(d), source), d)),
        F.transform("_totals", lambda t: F.when(missed(t, t, source), t)),
    )
    judged = _judged(prepared.withColumn("_sought", sought), "_text", threshold, prune)
    verdicts = F.col("_verdicts")
    n_records, n_fields = F.size("_descriptions"), F.lit(len(fields))
    item_pairs = F.arrays_zip(
        F.slice("_verdicts", n_fields + 1, n_records).alias("d"),
        F.slice("_verdicts", n_fields + n_records + 1, n_records).alias("t"),
    )
    item_means = F.transform(item_pairs, lambda p: (_confidence(p["d"]) + _confidence(p["t"])) / 2)
    mean = (
        F.when(n_records == 0, None)
        .when(verdicts.isNull(), 1.0)
        .otherwise(F.try_divide(compensated_sum(item_means), n_records))
    )
    averaged = judged.withColumn("_mean", mean)
    # over an array, not an expression per field: one method for all of them is more than the JVM compiles
    placed = [F.struct(F.lit(f.name).alias("field"), F.col(v).alias("value")) for f, v in zip(fields, values)]
    scalars = F.array()
    if placed:
        scalars = F.transform(
            F.array(*placed), lambda f, i: _comparison(f["field"], f["value"], F.get(verdicts, i))
        )
    with_items = F.concat(
        scalars, F.array(_items_comparison(F.col("_mean"), F.col("_n_items"), threshold))
    )
    settled = F.lit(None).cast(_VERDICT)
    scored = F.when(
        verdicts.isNull(),
        F.transform("_descriptions", lambda d, i: _item_score(i + 1, settled, settled)),
    ).otherwise(F.transform(item_pairs, lambda p, i: _item_score(i + 1, p["d"], p["t"])))
    return averaged.select(
        *keys,
        F.when(F.col("_mean").isNull(), scalars).otherwise(with_items).alias("comparisons"),
        F.when(n_records > 0, scored).alias("item_scores"),
    )


def _item_score(item: Column, description: Column, total: Column) -> Column:
    parts = _confidence(description), _confidence(total)
    return F.struct(
        item.alias("item"),
        parts[0].alias("description_confidence"),
        parts[1].alias("total_confidence"),
        ((parts[0] + parts[1]) / 2).alias("confidence"),
    )


def find_values(
    docs: DataFrame,
    values: str,
    *,
    keys: Sequence[str],
    text: str,
    threshold: float = DEFAULT_THRESHOLD,
    prune: bool = True,
) -> DataFrame:
    """Look up an array of values per row: ``keys``, ``position``, ``value``, ``found``, ``confidence``.

    The confidence is not rounded here.
    """
    prepared = docs.select(*keys, F.col(values).alias("_values"), normalize(F.col(text)).alias("_text"))
    sought = F.transform("_values", lambda v: F.when(missed(v, normalize(v), F.col("_text")), v))
    judged = _judged(prepared.withColumn("_sought", sought), "_text", threshold, prune)
    placed = F.transform(
        "_values", lambda v, i: F.struct(v.alias("value"), F.get("_verdicts", i).alias("verdict"))
    )
    listed = judged.select(*keys, F.posexplode_outer(placed).alias("position", "placed"))
    verdict = F.col("placed.verdict")
    return listed.where(F.col("position").isNotNull()).select(
        *keys,
        "position",
        F.col("placed.value").alias("value"),
        F.coalesce(verdict["found"], F.lit(True)).alias("found"),
        F.coalesce(verdict["raw"], F.lit(1.0)).alias("confidence"),
    )


# The outer generators below keep Spark from deriving a size filter, which would
# evaluate the whole array a second time.


def field_scores(grounded: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per document and field."""
    return grounded.select(*keys, F.inline_outer("comparisons"))


def line_item_scores(grounded: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per document and line item."""
    return grounded.select(*keys, F.inline_outer("item_scores")).where(F.col("item").isNotNull())


def _weight_of(field: Column, weights: Mapping[str, float]) -> Column:
    if not weights:
        return F.lit(OTHER_WEIGHT)
    table = F.create_map(*[F.lit(v) for k, w in weights.items() for v in (k, float(w))])
    return F.coalesce(table[field], F.lit(OTHER_WEIGHT))


def doc_confidence(
    grounded: DataFrame,
    *,
    keys: Sequence[str] = ("doc_id",),
    weights: Mapping[str, float] | None = None,
    comparisons: str = "comparisons",
) -> DataFrame:
    """Weighted overall confidence and banded counts, one row per document.

    ``weights`` replaces the default map as a whole; other fields weigh 1.
    """
    return grounded.select(*keys, confidence_summary(F.col(comparisons), weights).alias("s")).select(
        *keys, "s.*"
    )


def confidence_summary(
    comparisons: Column, weights: Mapping[str, float] | None = None
) -> Column:
    """struct<overall_confidence, total_fields, high_/medium_/low_confidence>."""
    table = DEFAULT_WEIGHTS if weights is None else weights

    def add(state: Column, c: Column) -> Column:
        return F.struct(
            (state["scored"] + c["confidence"] * c["weight"]).alias("scored"),
            (state["weight"] + c["weight"]).alias("weight"),
        )

    weighted = F.transform(
        comparisons,
        lambda c: F.struct(
            c["confidence"].alias("confidence"), _weight_of(c["field"], table).alias("weight")
        ),
    )
    start = F.struct(F.lit(0.0).alias("scored"), F.lit(0.0).alias("weight"))
    mean = F.aggregate(
        weighted,
        start,
        add,
        lambda s: F.when(s["weight"] > 0, F.try_divide(s["scored"], s["weight"])).otherwise(0.0),
    )
    overall = F.get(F.transform(F.array(mean), _rounded), F.lit(0))

    def count(condition) -> Column:
        return F.size(F.filter(comparisons, lambda c: condition(c["confidence"]))).cast("bigint")

    return F.struct(
        overall.alias("overall_confidence"),
        F.size(comparisons).cast("bigint").alias("total_fields"),
        count(lambda c: c >= HIGH_CONFIDENCE).alias("high_confidence"),
        count(lambda c: (c >= MEDIUM_CONFIDENCE) & (c < HIGH_CONFIDENCE)).alias("medium_confidence"),
        count(lambda c: c < MEDIUM_CONFIDENCE).alias("low_confidence"),
    )


def confidence_report(
    grounded: DataFrame,
    *,
    keys: Sequence[str] = ("doc_id",),
    weights: Mapping[str, float] | None = None,
) -> DataFrame:
    """The nested report: overall score, method, field map and summary counts."""
    return grounded.select(*keys, report_struct(F.col("comparisons"), weights).alias("r")).select(
        *keys, "r.*"
    )


def report_struct(comparisons: Column, weights: Mapping[str, float] | None = None) -> Column:
    fields = F.map_from_entries(F.transform(comparisons, lambda c: F.struct(c["field"], c)))
    counts = ("total_fields", "high_confidence", "medium_confidence", "low_confidence")

    def packed(summary: Column) -> Column:
        return F.struct(
            summary["overall_confidence"].alias("overall_confidence"),
            F.lit(METHOD).alias("method"),
            fields.alias("fields"),
            F.struct(*[summary[name].alias(name) for name in counts]).alias("summary"),
        )

    # one element, so that the summary is computed once
    return F.get(F.transform(F.array(confidence_summary(comparisons, weights)), packed), F.lit(0))


def text_similarity(pairs: DataFrame, a: str, b: str, out: str = "similarity") -> DataFrame:
    """Similarity of two text columns: 1 if equal, 0.95 if one holds the other, else the ratio.

    Emptiness is tested before normalisation, so '$' is not empty here.
    """
    left, right = F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit(""))
    settled = pairs.withColumn("_a", normalize(F.col(a))).withColumn("_b", normalize(F.col(b)))
    settled = settled.withColumn(
        "_known",
        F.when((left == "") & (right == ""), 1.0)
        .when((left == "") | (right == ""), 0.0)
        .when(F.col("_a") == F.col("_b"), 1.0)
        .when(
            F.contains("_a", "_b") | F.contains("_b", "_a"),
            CONTAINED_SIMILARITY,
        ),
    )
    open_only = [F.when(F.col("_known").isNull(), F.col(c)) for c in ("_a", "_b")]
    return settled.withColumn(
        out, F.coalesce(F.col("_known"), ratio.gestalt_ratio(*open_only))
    ).drop("_a", "_b", "_known")
