"""Image fingerprints and their distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def _hex(flags: Column) -> Column:
    """Array of flags as hex digits, the first flag being the highest bit."""

    def packed(bits: Column) -> Column:
        def digit(quad: Column) -> Column:
            at = quad * 4
            value = sum((F.get(bits, at + i) * 2 ** (3 - i) for i in range(1, 4)), F.get(bits, at) * 8)
            return F.lower(F.hex(value))

        quads = F.sequence(F.lit(0), (F.size(bits) / 4).cast("int") - 1)
        return F.array_join(F.transform(quads, digit), "")

    return let(F.transform(flags, lambda flag: flag.cast("int")), packed)


def _median(ordered: Column) -> Column:
    half = (F.size(ordered) / 2).cast("int")
    upper = F.get(ordered, half)
    return F.when(F.size(ordered) % 2 == 1, upper).otherwise((upper + F.get(ordered, half - 1)) / 2)


def phash(values: Column) -> Column:
    """Bit per coefficient: larger than the median of all."""
    exact = values.cast("array<double>")
    return let(
        let(F.sort_array(exact), _median), lambda median: _hex(F.transform(exact, lambda v: v > median))
    )


def ahash(values: Column) -> Column:
    """Bit per value: larger than the mean."""
    exact = values.cast("array<double>")
    mean = F.aggregate(exact, F.lit(0.0), lambda s, v: s + v) / F.size(exact)
    return let(mean, lambda m: _hex(F.transform(exact, lambda v: v > m)))


def dhash(rows: Column) -> Column:
    """Bit per value of each row but the first: larger than its left neighbour.

    ``rows`` is an array of rows, each one value wider than the hash.
    """
    flags = F.flatten(
        F.transform(
            rows,
            lambda row: F.transform(
                F.sequence(F.lit(1), F.size(row) - 1), lambda i: F.get(row, i) > F.get(row, i - 1)
            ),
        )
    )
    return _hex(flags)


def hex_distance(a: Column, b: Column, on_unequal: str = "longest") -> Column:
    """Differing characters; unequal lengths count as the longer one, or never match (null)."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    distance = F.aggregate(pairs, F.lit(0), lambda s, d: s + d)
    unequal = (
        F.greatest(F.length(a), F.length(b)) if on_unequal == "longest" else F.lit(None).cast("int")
    )
    return F.when(F.length(a) == F.length(b), distance).otherwise(unequal)


def hash_words(value: Column, digits: int) -> list[Column]:
    """The hash as 32-bit words held in BIGINT columns (64-bit ones would overflow ``conv``)."""
    return [
        F.conv(F.substring(value, at + 1, 8), 16, 10).cast("bigint") for at in range(0, digits, 8)
    ]


def bit_distance(a: Column, b: Column, digits: int = 64) -> Column:
    """Differing bits of two hex hashes of ``digits`` digits."""
    words = zip(hash_words(a, digits), hash_words(b, digits))
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in words), F.lit(0))


def bit_similarity(a: Column, b: Column, digits: int = 64) -> Column:
    """1 - differing bits / all bits, clamped to 0..1."""
    share = 1 - bit_distance(a, b, digits) / F.lit(float(digits * 4))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))


def format_hash(value: Column, limit: int = 16) -> Column:
    """Hash for display, shortened with an ellipsis."""
    return (
        F.when(value.isNull(), F.lit(""))
        .when(F.length(value) <= limit, value)
        .otherwise(F.concat(F.substring(value, 1, limit), F.lit("...")))
    )


def search_urls(image_url: Column) -> Column:
    """``struct(google, bing)`` reverse-search links for a public image address."""
    # fixed values: link formats
    google = "https://www.google.com/searchbyimage?image_url="
    bing = (
        "https://www.bing.com/images/search?view=detailv2&iss=sbi&form=SBIVSP"
        "&sbisrc=UrlPaste&q=imgurl:"
    )
    encoded = F.replace(F.url_encode(image_url), F.lit("+"), F.lit("%20"))
    for escaped, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(escaped), F.lit(char))
    return F.struct(
        F.concat(F.lit(google), encoded).alias("google"), F.concat(F.lit(bing), encoded).alias("bing")
    )


def client_key(headers: Column) -> Column:
    """Caller's address from a header map: forwarded, real, proxy, else ``local``."""
    forwarded = F.trim(F.get(F.split(headers["x-forwarded-for"], ","), F.lit(0)))
    return F.coalesce(
        F.when(headers["x-forwarded-for"] != "", forwarded),
        F.when(headers["x-real-ip"] != "", F.trim(headers["x-real-ip"])),
        F.when(headers["cf-connecting-ip"] != "", F.trim(headers["cf-connecting-ip"])),
        F.lit("local"),
    )


def rect_distance(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Euclidean gap between two boxes given as x0, y0, x1, y1 columns."""
    across = F.greatest(F.lit(0.0), a["x0"] - b["x1"], b["x0"] - a["x1"])
    down = F.greatest(F.lit(0.0), a["y0"] - b["y1"], b["y0"] - a["y1"])
    return F.sqrt(across * across + down * down)


def format_date(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, yyyy")


def format_date_time(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, yyyy, hh:mm a")
