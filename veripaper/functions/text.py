"""String normalization and similarity as plain column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def matched(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, null where the pattern does not match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once per row, also inside inner lambdas."""
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def strip(text: Column) -> Column:
    """Whitespace of every kind off both ends (``trim`` only takes blanks)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def blank(text: Column) -> Column:
    return text.isNull() | (text == "")


def edit_similarity(a: Column, b: Column, lower: bool = True) -> Column:
    """1 - edit distance / longer length; two empty strings are equal."""
    if lower:
        a, b = F.lower(a), F.lower(b)
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def levenshtein_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def normalize_string(text: Column) -> Column:
    """Lower case, punctuation and accented letters dropped, single blanks."""
    return F.trim(squeeze(F.regexp_replace(F.lower(text), r"[^\w\s]", "")))


def _title_key(text: Column) -> Column:
    return strip(F.regexp_replace(F.lower(text), r"[^\w\s]", ""))


def title_words(text: Column) -> Column:
    """Distinct words of a normalized title, the tokens of the title search."""
    return F.array_distinct(F.filter(F.split(normalize_string(text), " "), lambda w: w != ""))


def title_similarity(a: Column, b: Column) -> Column:
    """Title likeness in 0..1: equality, containment, word overlap lifted by a common start."""

    def likeness(left: Column, right: Column, words_l: Column, words_r: Column) -> Column:
        len_l, len_r = F.length(left), F.length(right)
        shorter = F.when(len_l < len_r, left).otherwise(right)
        longer = F.when(len_l < len_r, right).otherwise(left)
        shared = F.size(F.filter(words_l, lambda w: F.array_contains(words_r, w)))
        overlap = shared * 2 / (F.size(words_l) + F.size(words_r))
        start = F.least(len_l, len_r, F.lit(30))
        same_start = (start >= 10) & (
            F.substring(left, F.lit(1), start) == F.substring(right, F.lit(1), start)
        )
        return (
            F.when(left == right, F.lit(1.0))
            .when(F.contains(longer, shorter), F.length(shorter) / F.length(longer))
            .when((F.size(words_l) == 0) | (F.size(words_r) == 0), F.lit(0.0))
            .when(same_start, F.greatest(overlap, F.lit(0.7)))
            .otherwise(overlap)
        )

    def words(key: Column) -> Column:
        return F.filter(F.split(key, r"\s+"), lambda w: F.length(w) > 2)

    keys = F.struct(_title_key(a).alias("l"), _title_key(b).alias("r"))
    compared = let(
        keys,
        lambda k: let(
            F.struct(words(k["l"]).alias("l"), words(k["r"]).alias("r")),
            lambda w: likeness(k["l"], k["r"], w["l"], w["r"]),
        ),
    )
    return F.when(blank(a) | blank(b), F.lit(0.0)).otherwise(compared)


def trigrams(text: Column) -> Column:
    """Sorted set of 3-grams of the alphanumeric words, padded two left and one right."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(
        padded,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))
        ),
    )
    return F.array_sort(F.array_distinct(F.flatten(grams)))


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(0.0)).otherwise(common / union)


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def _ascii_punctuation(text: Column, low_quotes: bool) -> Column:
    plain = F.translate(text, "‘’“”–—", "''\"\"--")
    plain = F.replace(plain, F.lit("…"), F.lit("..."))
    return F.translate(plain, "‚„", "'\"") if low_quotes else plain


def _trailing_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"[,.;:]+$", "")


def _outer_quotes(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"""^["']+""", ""), r"""["']+$""", "")


def clean_title_for_search(title: Column) -> Column:
    """Title as the first catalogue's search takes it."""
    clean = _trailing_punctuation(_ascii_punctuation(title, low_quotes=True))
    return F.coalesce(F.trim(squeeze(_outer_quotes(clean))), F.lit(""))


def clean_query(title: Column, raw: Column) -> Column:
    """Search text of reference verification; the raw text stands in."""
    query = F.coalesce(F.nullif(title, F.lit("")), raw)
    clean = _trailing_punctuation(_ascii_punctuation(query, low_quotes=False))
    return F.trim(squeeze(_outer_quotes(clean)))


def clean_upload_query(title: Column) -> Column:
    """Search text used after an upload: no quote stripping, no squeezing."""
    return strip(_trailing_punctuation(_ascii_punctuation(title, low_quotes=False)))


def shared_words(a: Column, b: Column) -> Column:
    """Share of the first text's distinct words that the second has as well."""
    left = F.array_distinct(F.filter(F.split(F.lower(a), r"\s+"), lambda w: w != ""))
    right = F.split(F.lower(b), r"\s+")
    return F.when(F.size(left) == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(left, right)) / F.size(left)
    )


def contains_any(text: Column, marks: list[str]) -> Column:
    return reduce(lambda x, y: x | y, [F.contains(F.lower(text), F.lit(m)) for m in marks])


def score_text(score: Column) -> Column:
    """A score as text, all its digits; 1.0 reads ``1``."""
    return F.regexp_replace(score.cast("string"), r"\.0$", "")


def joined_notes(*notes: Column, separator: str = "; ") -> Column:
    """Non-null notes in order, joined."""
    return F.array_join(F.array_compact(F.array(*notes)), separator)
