"""URL filters: rules by host and path, and a character language-model ratio for the rest.

``judge`` gives every URL its host, path, the longest rule that fits, and a verdict.  Where no rule
fits, two smoothed variable-order Markov models decide, one of the accepted and one of the
rejected URLs (those that the rules allow and block): the difference of the log-likelihoods, divided by
the length, is compared with a calibrated threshold.

* **Letters** are the characters of the URL as they are, between starts and an end; nothing is folded.
* **Variable order.**  A letter is predicted from the longest context of up to ``order`` letters that the learned URLs hold at least
  ``support`` times, so contexts grow where counts support them, and the tables grow with the input.
* **Smoothing.** Witten-Bell: each context's estimate is interpolated with the next shorter one's, down to
  the uniform one over the letters that occur, so no letter has zero probability.
* **Scores** are whole numbers of micro-nats, so sums don't depend on the order of rows.
* **Calibration.** A fold of the URLs, by the digest, is held out of the models.  The threshold has the best balanced accuracy over
  those of it that the rules decide, in ``bins`` steps of a thousandth of a nat per letter (wider scores count in the last step); of
  equals, the nearest to zero.  Without held-out URLs of both classes it is zero.

Equal URLs are one row with a number from the start.  Grams and URLs meet in joins by a shuffle, never in a broadcast: only a URL's
number and the gram are shuffled.  DataFrame functions only.  A null URL, or one without ``://``, has an empty host and path; its letters are
still judged.  Rows that repeat an id and URL return as often as they came.  Very
long URLs count whole, extra columns are not read, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkproof.llm.shared import stored

_START, _END = "\x02", "\x03"
_MICRO = 1_000_000
#: First hexadecimal digits of the digest of URLs that are held out: 3 of 16.
_HELD_OUT = ("0", "1", "2")
_CLASSES = ("accepted", "rejected")


def host(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://([^/?#]*)", 1)
    return F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule for the host or a parent domain and a prefix of the path; null if none fits.

    A rule is a host, a slash and the rest of a path.  Rules stand in the plan, so they are meant to be
    some hundreds at most.
    """
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        domain, _, rest = rule.partition("/")
        here = (host == domain) | host.endswith(f".{domain}")
        chosen = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(here & path.startswith(f"/{rest}"), chosen))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def held_out(url: Column) -> Column:
    """Whether a URL is calibrated on instead of learned from."""
    return F.substring(F.md5(F.coalesce(url, F.lit("")).cast("binary")), 1, 1).isin(*_HELD_OUT)


def _grams(url: Column, order: int) -> Column:
    """All grams of ``order`` letters and the one after them.

    The letters are split once and bound by a one-element transform; grams are slices of that array, so the
    work is linear in the URL.
    """
    padded = F.concat(F.lit(_START * order), F.coalesce(url, F.lit("")), F.lit(_END))

    def grams(each: Column) -> Column:
        gram = lambda n: F.array_join(F.slice(each, n, order + 1), "")
        return F.transform(F.sequence(F.lit(1), F.size(each) - order), gram)

    return F.get(F.transform(F.array(F.split(padded, "")), grams), F.lit(0))


def _spread(frame: DataFrame) -> DataFrame:
    """The frame as a side of joins by a shuffle; it has one row for each key, so a task's share of it is small.

    Spark takes the size of a stored table from its files, where grams are many times smaller than in memory, and that of the
    grams of stored URLs from the URLs.  A broadcast chosen by such a size goes through the driver and may not fit it.
    """
    return frame.hint("shuffle_hash")


def _table(counts: DataFrame, order: int, support: int) -> DataFrame:
    """(gram, score): micro-nats by which the accepted model finds the last letter likelier than the rejected one."""
    levels = [counts.select("gram", *_CLASSES)]
    for width in range(order, 0, -1):
        # the last letters, one fewer each time
        shorter = F.substring("gram", 2, width).alias("gram")
        level = levels[-1].groupBy(shorter).agg(*[F.sum(c).alias(c) for c in _CLASSES])
        # each is read three times below
        levels.append(stored(level, f"url-grams-{width}"))
    # of all URLs, so that every letter has its share
    alphabet = max(levels[-1].count(), 1)
    models = None
    for width, level in enumerate(reversed(levels), 1):
        seen = [F.sum(c).alias(f"{c}_all") for c in _CLASSES]
        seen += [F.sum((F.col(c) > 0).cast("int")).alias(f"{c}_kinds") for c in _CLASSES]
        context = F.substring("gram", 1, width - 1)
        totals = level.groupBy(context.alias("context")).agg(*seen)
        known = level.join(_spread(totals), context == F.col("context"))
        held = F.lit(True)
        if models is None:
            below = {c: F.lit(1.0 / alphabet) for c in _CLASSES}
        else:
            known = known.join(_spread(models), F.substring("gram", 2, width) == F.col("tail"))
            below = {c: F.col(f"{c}_tail") for c in _CLASSES}
            held = F.col("accepted_all") + F.col("rejected_all") >= support
        share = {
            c: F.when(
                held & (F.col(f"{c}_all") > 0),
                (F.col(c) + F.col(f"{c}_kinds") * below[c]) / (F.col(f"{c}_all") + F.col(f"{c}_kinds")),
            ).otherwise(below[c])
            for c in _CLASSES
        }
        known = known.select("gram", *[share[c].alias(f"{c}_p") for c in _CLASSES])
        models = known.select(F.col("gram").alias("tail"), *[F.col(f"{c}_p").alias(f"{c}_tail") for c in _CLASSES])
    ratio = F.log("accepted_p") - F.log("rejected_p")
    return known.select("gram", F.round(ratio * _MICRO).cast("bigint").alias("score"))


def train(urls: DataFrame, order: int = 5, support: int = 4) -> DataFrame:
    """The stored (gram, score) table from (url, copies, verdict); it covers every gram that occurs.

    URLs with a null verdict are not learned from, but their grams are in the table.
    """
    if order < 1 or support < 1:
        raise ValueError("order and support must be positive")
    each = urls.select(F.explode(_grams(F.col("url"), order)).alias("gram"), "copies", "verdict")
    of = lambda verdict: F.sum(F.when(F.col("verdict") == verdict, F.col("copies")).otherwise(0))
    counts = each.groupBy("gram").agg(of("allow").alias("accepted"), of("block").alias("rejected"))
    return stored(_table(stored(counts, "url-grams"), order, support), "url-model")


def score(urls: DataFrame, model: DataFrame, order: int = 5) -> DataFrame:
    """(number, score) of (number, url): micro-nats per letter in favour of accepting.

    How the grams meet the model is left to the caller (``_spread``).
    """
    each = urls.select("number", F.explode(_grams(F.col("url"), order)).alias("gram"))
    total = each.join(model, "gram").groupBy("number").agg(F.sum("score").alias("total"), F.count("*").alias("many"))
    return total.select("number", F.expr("total div many").alias("score"))


def threshold(scored: DataFrame, bins: int = 2000) -> int:
    """The score from which a URL is accepted, from scored URLs (score, copies, verdict of a rule)."""
    known = scored.where("verdict is not null").select(
        F.greatest(F.lit(-bins), F.least(F.lit(bins), F.floor(F.col("score") / 1000))).alias("bin"), "verdict", "copies"
    )
    each = known.groupBy("bin").agg(
        F.sum(F.when(F.col("verdict") == "allow", F.col("copies")).otherwise(0)).alias("allow"),
        F.sum(F.when(F.col("verdict") == "block", F.col("copies")).otherwise(0)).alias("block"),
    )
    best, total = (0.0, 0), each.agg(F.sum("allow"), F.sum("block")).first()
    if not (total[0] and total[1]):
        return 0
    # at most 2 * bins + 1 rows
    rows = sorted(each.collect())
    below_allow = below_block = 0
    edges = []
    for row in rows:
        edges.append((below_block / total[1] - below_allow / total[0], -abs(row.bin), row.bin))
        below_allow, below_block = below_allow + row.allow, below_block + row.block
    edges.append((below_block / total[1] - below_allow / total[0], -abs(rows[-1].bin + 1), rows[-1].bin + 1))
    best = max(edges)
    return best[2] * 1000


def judge(
    pages: DataFrame, rules: list[tuple[str, str]], order: int = 5, support: int = 4, bins: int = 2000
) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, score) of every page."""
    decided = fitting_rule(host(F.col("url")), path(F.col("url")), rules)
    urls = stored(
        pages.groupBy("url")
        .agg(F.count("*").alias("copies"))
        .select("url", "copies", decided.alias("fit"), held_out(F.col("url")).alias("held"))
        .withColumn("number", F.monotonically_increasing_id()),
        "urls",
    )
    learned = F.when(~F.col("held"), F.col("fit.verdict")).alias("verdict")
    model = train(urls.select("url", "copies", learned), order, support)
    scored = stored(urls.join(_spread(score(urls, _spread(model), order)), "number"), "url-scores")
    least = threshold(scored.where("held").select("score", "copies", F.col("fit.verdict").alias("verdict")), bins)
    own = F.when(F.col("score") >= least, "allow").otherwise("block")
    judged = scored.select(F.col("url").alias("of"), "fit", F.coalesce("fit.verdict", own).alias("verdict"), "score")
    each = pages.select("page_id", "url").join(_spread(judged), F.col("url").eqNullSafe(F.col("of")))
    return each.select(
        "page_id",
        "url",
        host(F.col("url")).alias("host"),
        path(F.col("url")).alias("path"),
        F.col("fit.rule").alias("rule"),
        "verdict",
        "score",
    )
