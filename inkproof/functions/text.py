"""Text expressions: normalisation for matching, words, previews, file names."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkproof.functions.numbers import fixed_text, round_exact

# --- fixed values: these decide which texts count as equal -------------------
BLANKS = (
    r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
ARTEFACT_PATTERN = r"\^?\{\}?\[?\]?"
ARTEFACT_MARK = "{"  # every artefact holds one
CURRENCY_SIGNS = "$€£¥"
THOUSANDS_PATTERN = r",(\p{Nd}{3})"
FIRST_NUMBER_PATTERN = r"[\p{Nd},]+\.?\p{Nd}*"
PREVIEW_LENGTH = 500
PREVIEW_SUFFIX = "..."

DEFAULT_MIME_TYPE = "application/octet-stream"
# -----------------------------------------------------------------------------

# the standard library's built-in tables, without the files of the system it runs on
_TABLES = mimetypes.MimeTypes(filenames=())
MIME_TYPES = {suffix[1:]: kind for suffix, kind in _TABLES.types_map[True].items()}
# suffixes that name an encoding; the type is the one of the inner name
ENCODING_SUFFIXES = [suffix[1:] for suffix in _TABLES.encodings_map]
# short suffixes that stand for a type inside an encoding: tgz is tar inside gz
COMPOUND_SUFFIXES = {short[1:]: long.split(".")[1] for short, long in _TABLES.suffix_map.items()}


# Only runs that are not already one space are matched; the leading ranges let
# printable characters fail on a single comparison.
_RUN_OF_BLANKS = rf"[[^ -~]&&[{BLANKS}]][[^!-~]&&[{BLANKS}]]*+| [[^!-~]&&[{BLANKS}]]++"


def normalize(text: Column) -> Column:
    """Canonical form used on both sides of every match; null becomes ''.

    Blanks are folded first, which turns trimming into ``trim`` and leaves the
    second fold with single spaces only.  Each later pass is skipped by a plain
    substring test when it has nothing to do.
    """
    folded = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _RUN_OF_BLANKS, " "))
    cleaned = _where_contained(
        folded,
        ARTEFACT_MARK,
        lambda t: F.regexp_replace(F.regexp_replace(t, ARTEFACT_PATTERN, ""), " {2,}", " "),
    )
    for sign in CURRENCY_SIGNS:
        cleaned = F.replace(cleaned, F.lit(sign), F.lit(""))
    return _where_contained(
        cleaned, ",", lambda t: F.regexp_replace(t, THOUSANDS_PATTERN, "$1")
    )


def _where_contained(text: Column, mark: str, change) -> Column:
    return F.get(
        F.transform(
            F.array(text),
            lambda t: F.when(F.contains(t, F.lit(mark)), change(t)).otherwise(t),
        ),
        F.lit(0),
    )


def normalize_amount(amount: Column) -> Column:
    """Canonical text of a numeric amount; null becomes ''."""
    return F.coalesce(fixed_text(amount.cast("double"), 2), F.lit(""))


def normalize_amount_text(text: Column) -> Column:
    """Canonical text of an amount given as text: its first number, else the text."""
    number = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), FIRST_NUMBER_PATTERN, 0)
    return F.coalesce(fixed_text(number.try_cast("double"), 2), normalize(text))


def words(normalized: Column) -> Column:
    """Words of an already normalised text, in order, duplicates kept."""
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def preview(text: Column, length: int = PREVIEW_LENGTH) -> Column:
    return F.when(
        F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit(PREVIEW_SUFFIX))
    ).otherwise(text)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def _suffix(name: Column) -> Column:
    return F.regexp_extract(name, r"(?s)\A.*[^.].*\.([^.]*)\z", 1)


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*\z", "")


def file_extension(name: Column) -> Column:
    """Lower-case suffix without its dot; '' for none, and for names like ``.profile``."""
    return F.lower(_suffix(name))


def is_pdf(name: Column) -> Column:
    return file_extension(name) == "pdf"


def mime_type(name: Column) -> Column:
    suffix = _suffix(name)
    compound = F.create_map(*[F.lit(v) for kv in COMPOUND_SUFFIXES.items() for v in kv])
    types = F.create_map(*[F.lit(v) for kv in MIME_TYPES.items() for v in kv])
    inner = (
        F.when(F.lower(suffix).isin(list(COMPOUND_SUFFIXES)), compound[F.lower(suffix)])
        .when(suffix.isin(ENCODING_SUFFIXES), file_extension(_stem(name)))
        .otherwise(F.lower(suffix))
    )
    return F.coalesce(types[inner], F.lit(DEFAULT_MIME_TYPE))


def size_in_mb(size_bytes: Column) -> Column:
    return round_exact(size_bytes.cast("double") / F.lit(1048576.0), 3)


def base64_text(content: Column) -> Column:
    """Unwrapped base64: Spark breaks the lines, a data URI must not."""
    return F.translate(F.base64(content), "\r\n", "")


def data_uri(mime: Column, encoded: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), encoded)
