"""Reports over many documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkproof.functions.numbers import percent_text
from inkproof.operators.grounding import HIGH_CONFIDENCE, MEDIUM_CONFIDENCE

# fixed values
ABSENT = "N/A"
LISTED_CHARACTERS = 40
LISTED_SUFFIX = "..."
HYBRID_MODE = "hybrid_ocr_vision"


def result_rows(docs: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Readable row per document; needs the record columns and the confidence summary."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(ABSENT)).alias(name)

    return docs.select(
        *keys,
        shown("document_type"),
        shown("document_number"),
        shown("document_date"),
        F.col("total_amount.amount").alias("amount"),
        F.col("total_amount.currency").alias("currency"),
        "overall_confidence",
        percent_text(F.col("overall_confidence")).alias("confidence_text"),
        "high_confidence",
        "medium_confidence",
        "low_confidence",
        F.coalesce(F.size("line_items"), F.lit(0)).cast("bigint").alias("n_items"),
    )


def list_items(
    docs: DataFrame, items: str = "line_items", keys: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Numbered line items with a shortened description."""
    numbered = docs.select(*keys, F.posexplode(items).alias("_pos", "_item"))
    description = F.coalesce(F.col("_item.description"), F.lit(ABSENT))
    return numbered.select(
        *keys,
        (F.col("_pos") + 1).alias("item"),
        F.concat(F.substring(description, 1, LISTED_CHARACTERS), F.lit(LISTED_SUFFIX)).alias(
            "description"
        ),
        F.col("_item.total").alias("total"),
    )


def mode_label(mode: Column) -> Column:
    """Text mode records no name."""
    return F.when(mode == HYBRID_MODE, "hybrid").otherwise("text_only")


def compare_modes(runs: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Input tokens and confidence of the two modes side by side, one row per document."""
    label = mode_label(F.col("mode"))

    def of(mode: str, name: str) -> Column:
        return F.max(F.when(label == mode, F.col(name)))

    return runs.groupBy(*keys).agg(
        *[
            of(mode, name).alias(f"{mode}_{short}")
            for mode in ("hybrid", "text_only")
            for name, short in (("input_tokens", "tokens"), ("overall_confidence", "confidence"))
        ]
    )


def token_usage(runs: DataFrame) -> DataFrame:
    """Sums per model and mode; whole numbers, so the order of summing does not matter."""
    return runs.groupBy("model", mode_label(F.col("mode")).alias("mode")).agg(
        F.count(F.lit(1)).alias("extractions"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        (F.sum("input_tokens") / F.count("input_tokens")).alias("mean_input_tokens"),
    )


def judge_token_usage(judge: DataFrame) -> DataFrame:
    """Prompt, completion and total tokens per judge metric."""
    return judge.groupBy("metric").agg(
        *[
            F.sum(name).alias(name)
            for name in ("prompt_tokens", "completion_tokens", "total_tokens")
        ]
    )


def field_quality(field_scores: DataFrame) -> DataFrame:
    """Per field: mean confidence, misses and band counts.

    Confidences have three decimals, so they are summed exactly as decimals.  There
    are few fields and many documents; partial aggregates are all that is shuffled.
    """
    confidence = F.col("confidence")
    exact = F.sum(confidence.cast("decimal(10,3)")).cast("double")
    return field_scores.groupBy("field").agg(
        F.count(F.lit(1)).alias("documents"),
        (exact / F.count("confidence")).alias("mean_confidence"),
        F.count_if(~F.col("found_in_ocr")).alias("not_found"),
        F.count_if(confidence >= HIGH_CONFIDENCE).alias("high_confidence"),
        F.count_if((confidence >= MEDIUM_CONFIDENCE) & (confidence < HIGH_CONFIDENCE)).alias(
            "medium_confidence"
        ),
        F.count_if(confidence < MEDIUM_CONFIDENCE).alias("low_confidence"),
    )
