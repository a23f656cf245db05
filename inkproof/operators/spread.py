"""The word search of ``grounding`` for texts too long for one task: blocks of words dealt over all tasks.

A row's missed words are compared with its text block by block, each block in whatever task it was dealt to.  The best ratio
of a word is the maximum over blocks, taken in the tasks first and then by row and word, and joined back to the values.
Only blocks, best ratios and the values' words are shuffled; nothing of a row but one block is ever held by a
task that compares.  For tables of short texts ``find_values`` costs less, as it shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkproof.functions.ratio import best_ratios, row_lists
from inkproof.functions.text import normalize, words
from inkproof.operators import grounding


def _best_of_block(wanted: Column, source: Column, threshold: float) -> Column:
    make, parts_of = best_ratios(threshold), row_lists()

    def best_batches(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        best_of = make()
        for wanted_batch, source_batch in batches:
            done = [pa.array([], pa.list_(pa.float64()))]
            for part in parts_of(wanted_batch, source_batch):
                done.append(pa.array([best_of(sought, block) for sought, block in part], pa.list_(pa.float64())))
            yield pa.concat_arrays(done)

    return F.arrow_udf(best_batches, "array<double>")(wanted, source)


def _blocks(items: str, size: int) -> Column:
    """The array in parts of ``size``; one empty part for an empty array, null for null."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(size))
    return F.when(F.col(items).isNotNull(), F.transform(starts, lambda start: F.slice(items, start, size)))


def best_matches(
    rows: DataFrame, *, threshold: float, text_block: int = 4096, word_block: int = 4096, partitions: int | None = None
) -> DataFrame:
    """``_row``, ``word``, ``best``: each word of ``_wanted`` with its best ratio among ``_source``, 0 if below the threshold.

    ``partitions`` (default: the session's shuffle partitions) is how many tasks the pairs of blocks are dealt to; adaptive
    execution leaves that number alone, as work here goes by words and not by bytes.
    """
    sought = rows.where(F.size("_wanted") > 0)
    rated = _rated(sought, [], threshold, text_block, word_block, partitions)
    told = rated.select("_row", F.inline_outer(_ratings(threshold)))
    return told.groupBy("_row", "word").agg(F.max("best").alias("best"))


def _rated(
    rows: DataFrame, carried: Sequence[str], threshold: float, text_block: int, word_block: int, partitions: int | None
) -> DataFrame:
    """Pairs of blocks with the best ratios of their words; the first pair of a row also has what is ``carried``.

    The generators are outer ones: of others Spark derives a size filter, for which it would make the blocks a second time.
    Rows without ``_source`` are dropped.
    """
    if min(text_block, word_block) < 1:
        raise ValueError("blocks must hold at least one word")
    tasks = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_text = rows.select(
        "_row", *carried, "_wanted", F.posexplode_outer(_blocks("_source", text_block)).alias("_t", "_source")
    ).where(F.col("_t").isNotNull())
    pairs = by_text.select(
        "_row", *carried, "_t", "_source", F.posexplode_outer(_blocks("_wanted", word_block)).alias("_w", "_wanted")
    )
    first = (F.col("_t") == 0) & (F.col("_w") == 0)
    once = [F.when(first, F.col(c)).alias(c) for c in carried]
    dealt = pairs.select("_row", "_t", "_w", "_source", "_wanted", *once).repartition(tasks, "_row", "_t", "_w")
    best = _best_of_block(F.col("_wanted"), F.col("_source"), threshold)
    return dealt.select("_row", *carried, "_wanted", best.alias("_best"))


def _ratings(threshold: float) -> Column:
    """array<struct<word, best>> of a pair of blocks; 0 for a ratio below the threshold."""
    rated = F.arrays_zip(F.col("_wanted").alias("word"), F.col("_best").alias("best"))
    return F.transform(
        rated,
        lambda r: F.struct(
            r["word"].alias("word"), F.when(r["best"] >= threshold, r["best"]).otherwise(F.lit(0.0)).alias("best")
        ),
    )


def find_values_spread(
    docs: DataFrame,
    values: str,
    *,
    keys: Sequence[str],
    text: str,
    threshold: float = grounding.DEFAULT_THRESHOLD,
    text_block: int = 4096,
    word_block: int = 4096,
    partitions: int | None = None,
) -> DataFrame:
    """The rows of ``grounding.find_values``, with the comparisons of a row dealt over tasks.

    Rows are told apart by the digest of their values and text: repeated rows (and null keys) give repeated results,
    as there.  A null or empty value is found; a missed value in a text without words isn't.
    """
    # the digest is of the text as it is, so that only the search has to normalise it
    digest = F.sha2(F.concat(F.to_json(F.struct(F.col(values).alias("v"))), F.coalesce(F.col(text), F.lit(""))), 256)
    normal = docs.select(digest.alias("_row"), F.col(values).alias("_values"), normalize(F.col(text)).alias("_text"))
    missed = F.transform("_values", lambda v: F.when(grounding.missed(v, normalize(v), F.col("_text")), words(normalize(v))))
    searched = normal.select("_row", "_text", missed.alias("_missed"))
    split = searched.select(
        "_row", "_missed",
        F.when(F.exists("_missed", lambda v: v.isNotNull()), F.array_distinct(words(F.col("_text")))).alias("_source"),
    )
    wanted = F.array_except(F.flatten(F.filter("_missed", lambda v: v.isNotNull())), F.col("_source"))
    named = split.select("_row", "_missed", "_source", wanted.alias("_wanted"))
    rows = named.select(
        "_row", "_missed", "_wanted",
        # nothing to compare, but the row's words are still to be told
        F.when(F.size("_wanted") == 0, F.slice("_source", 1, 0)).otherwise(F.col("_source")).alias("_source"),
    )
    rated = _rated(rows, ["_missed"], threshold, text_block, word_block, partitions)
    nothing = F.lit(None).cast("int")
    told = F.transform(
        _ratings(threshold),
        lambda r: F.struct(
            r["word"].alias("word"), r["best"].alias("best"), nothing.alias("position"), nothing.alias("place")
        ),
    )
    of_value = F.transform(
        F.coalesce("_missed", F.array().cast("array<array<string>>")),
        lambda value, position: F.transform(
            F.coalesce(value, F.array().cast("array<string>")),
            lambda word, place: F.struct(
                word.alias("word"), F.lit(None).cast("double").alias("best"), position.alias("position"), place.alias("place")
            ),
        ),
    )
    listed_words = rated.select("_row", F.inline_outer(F.concat(told, F.flatten(of_value))))
    spot = F.when(F.col("position").isNotNull(), F.struct("position", "place"))
    by_word = listed_words.groupBy("_row", "word").agg(F.max("best").alias("best"), F.collect_set(spot).alias("_spots"))
    # a word that wasn't looked for occurs in the text
    scored = by_word.select(
        "_row", F.coalesce("best", F.lit(1.0)).alias("best"), F.inline("_spots")
    )
    gathered = scored.groupBy("_row", "position").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "best"))), lambda s: s["best"]).alias("_scores")
    )
    hits = F.filter("_scores", lambda s: s >= threshold)
    total = F.aggregate(hits, F.lit(0.0), lambda sum_, s: sum_ + s)
    verdicts = gathered.select(
        "_row", "position",
        (F.size(hits) == F.size("_scores")).alias("_found"),
        (total / F.size("_scores")).alias("_raw"),
    )
    listed = docs.select(*keys, digest.alias("_row"), F.posexplode(values).alias("position", "value"))
    return listed.join(verdicts, ["_row", "position"], "left").select(
        *keys,
        "position",
        "value",
        F.coalesce("_found", F.lit(True)).alias("found"),
        F.coalesce("_raw", F.lit(1.0)).alias("confidence"),
    )
