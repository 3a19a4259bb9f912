"""Diagram fingerprints: duplicate groups, exact Hamming-distance joins, image likeness."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import ceil, comb, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.hashes import hash_words
from ..functions.scale import cut_lineage, salted_join
from ..functions.text import let


def duplicate_groups(images: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Hashes held by more than one image, with their number of images. Blank hashes never group."""
    keys = keys or []
    return (
        images.where("hash <> ''")
        .groupBy(*keys, "hash")
        .agg(F.count(F.lit(1)).alias("n_files"))
        .where("n_files > 1")
    )


def duplicate_files(images: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The files of every duplicate group, one per row; a group may be of any size."""
    keys = keys or []
    return salted_join(
        images.select(*keys, "hash", "image_id", "filename"),
        duplicate_groups(images, keys),
        [*keys, "hash"],
        [F.col("image_id")],
        how="inner",
    )


def duplicate_summary(images: DataFrame, keys: list[str]) -> DataFrame:
    """All and unique images per key; images without a hash count as unique."""
    per_hash = images.groupBy(*keys, "hash").agg(F.count(F.lit(1)).alias("n"))
    extra = F.when(F.coalesce("hash", F.lit("")) != "", F.col("n") - 1).otherwise(F.lit(0))
    return per_hash.groupBy(*keys).agg(
        F.sum("n").alias("total_images"), (F.sum("n") - F.sum(extra)).alias("unique_images")
    )


def mark_duplicates(images: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Images with ``is_duplicate`` and the size of their hash group."""
    keys = keys or []
    flagged = salted_join(
        images, duplicate_groups(images, keys), [*keys, "hash"], [F.col("image_id")], how="left"
    )
    return flagged.withColumn("is_duplicate", F.col("n_files").isNotNull()).withColumn(
        "n_files", F.coalesce("n_files", F.lit(1))
    )


def _digit_patterns(length: int, differing: int) -> list[tuple[int, ...]]:
    """Position sets of which two strings with at most ``differing`` unequal digits agree on one.

    The digits are cut into g parts; one part then has at most ``differing // g`` unequal digits,
    so that leaving any so many out gives an equal rest. The number of parts is chosen so that a
    rest has at least four digits if that is possible.
    """
    for parts in range(differing + 1, 0, -1):
        bounds = [length * i // parts for i in range(parts + 1)]
        left_out = differing // parts
        if min(b - a for a, b in zip(bounds, bounds[1:])) - left_out >= min(4, length - differing):
            break
    patterns = []
    for a, b in zip(bounds, bounds[1:]):
        patterns += combinations(range(a, b), (b - a) - left_out)
    return patterns


def _with_words(hashes: DataFrame, digits: int) -> DataFrame:
    """Distinct hashes of one length with their 32-bit words, read from the text once per hash."""
    fitting = hashes.select("hash").where(F.length("hash") == digits).distinct()
    return fitting.withColumn("words", F.array(*hash_words(F.col("hash"), digits)))


def _word_pairs(digits: int) -> list[tuple[Column, Column]]:
    return [(F.get("l.words", F.lit(i)), F.get("r.words", F.lit(i))) for i in range((digits + 7) // 8)]


def _unequal_digits(digits: int) -> Column:
    """Hex digits in which ``l.words`` and ``r.words`` differ: the non-zero quads of their xor."""
    total = F.lit(0)
    for a, b in _word_pairs(digits):
        x = a.bitwiseXOR(b)
        quads = x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseOR(F.shiftright(x, 3))
        total = total + F.bit_count(quads.bitwiseAND(F.lit(0x11111111).cast("bigint")))
    return total


def _unequal_bits(digits: int) -> Column:
    return sum((F.bit_count(a.bitwiseXOR(b)) for a, b in _word_pairs(digits)), F.lit(0))


def _signatures(hashes: DataFrame, length: int, differing: int) -> DataFrame:
    patterns = F.array(
        *[
            F.struct(F.lit(n).alias("n"), F.array(*[F.lit(at + 1) for at in kept]).alias("kept"))
            for n, kept in enumerate(_digit_patterns(length, differing))
        ]
    )
    digits = F.transform("pattern.kept", lambda at: F.substring("hash", at, F.lit(1)))
    return hashes.withColumn("pattern", F.explode(patterns)).select(
        "hash", "words", F.col("pattern.n").alias("nth"), F.array_join(digits, "").alias("signature")
    )


def _first_pattern(patterns: list[tuple[int, ...]], digits: int) -> Column:
    """The first pattern on whose digits ``hash`` and ``other`` agree."""
    same = F.transform(F.sequence(F.lit(1), F.lit(digits)), lambda i: F.substring("hash", i, F.lit(1)) == F.substring("other", i, F.lit(1)))
    kept = F.array(*[F.array(*[F.lit(at) for at in pattern]) for pattern in patterns])
    return let(same, lambda same: F.array_position(F.transform(kept, lambda pattern: F.forall(pattern, lambda at: F.get(same, at))), True) - 1)


def near_hash_pairs(left: DataFrame, right: DataFrame, length: int, differing: int) -> DataFrame:
    """Pairs of distinct hashes ``(hash, other, distance)`` with at most ``differing`` unequal digits.

    Exact: every such pair shares a signature (pigeonhole). The distance is a condition of the
    join itself, so that only true pairs leave it, and a pair stays where it meets first; a frequent
    signature is split by the adaptive skew join. Signatures are many rows a hash, which Spark's estimates
    do not see: they are joined by sorting, never broadcast.
    """
    l = _signatures(_with_words(left, length), length, differing).alias("l")
    r = _signatures(_with_words(right, length), length, differing).alias("r")
    distance = _unequal_digits(length)
    met = (F.col("l.nth") == F.col("r.nth")) & (F.col("l.signature") == F.col("r.signature"))
    return (
        l.join(r.hint("merge"), met & (distance <= differing))
        .select(F.col("l.hash").alias("hash"), F.col("r.hash").alias("other"), distance.alias("distance"), F.col("l.nth").alias("nth"))
        .where(F.col("nth") == _first_pattern(_digit_patterns(length, differing), length))
        .drop("nth")
    )


def hashes_within(images: DataFrame, differing: int = 5, length: int = 16) -> DataFrame:
    """Pairs of different hashes at most ``differing`` digits apart, smaller one first."""
    return near_hash_pairs(images, images, length, differing).where("hash < other")


def suspicious_diagrams(
    diagrams: DataFrame, above: float = 0.85, denominator: int = 64, length: int = 16
) -> DataFrame:
    """Diagrams whose hash nearly equals that of a diagram in another paper; smallest id first.

    The likeness is 1 - unequal digits / ``denominator``. Per hash the two smallest ids of
    different papers are all that a match can need.
    """
    differing = max(d for d in range(length + 1) if 1 - d / denominator > above)
    hashed = diagrams.where("hash <> ''")
    per_paper = hashed.groupBy("hash", "paper_id").agg(F.min("diagram_id").alias("first_id"))
    holders = _two_first(per_paper, ["hash"], "first_id").select(
        F.col("hash").alias("other"), "first_id", "paper_id"
    )
    offered = near_hash_pairs(hashed, hashed, length, differing).join(holders, "other")
    similarity = 1 - F.col("distance") / F.lit(float(denominator))
    # Per hash the smallest match of each paper, then the two smallest: one is of another paper.
    per_match = offered.groupBy("hash", "paper_id").agg(
        F.min(F.struct("first_id", similarity.alias("similarity"))).alias("match")
    )
    options = (
        _two_first(per_match, ["hash"], "match")
        .groupBy("hash")
        .agg(F.array_sort(F.collect_list(F.struct("match", F.col("paper_id").alias("of_paper")))).alias("options"))
    )
    matched = salted_join(hashed, options, ["hash"], [F.col("diagram_id")], how="inner")
    first, second = F.get("options", F.lit(0)), F.get("options", F.lit(1))
    chosen = F.when(first["of_paper"] != F.col("paper_id"), first["match"]).otherwise(second["match"])
    return (
        matched.withColumn("chosen", chosen)
        .where("chosen is not null")
        .select(
            "diagram_id",
            "paper_id",
            F.col("chosen.first_id").alias("matched_diagram_id"),
            F.col("chosen.similarity").alias("similarity_score"),
        )
    )


def _two_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The two smallest rows per key, cut to two before the exchange."""
    ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(order)))
    return ranked.where(F.col("_r") <= 2).drop("_r")


#: Signatures that a query hash may be looked up by.
MOST_PROBES = 20_000


@dataclass(frozen=True)
class Bands:
    """``bounds`` of the bit bands, of which one has at most ``turned`` unequal bits in every near pair."""

    bounds: list[tuple[int, int]]
    turned: int

    @property
    def probes(self) -> int:
        return sum(comb(b - a, i) for a, b in self.bounds for i in range(self.turned + 1))

    def met(self, stored: int) -> float:
        """Of ``stored`` random hashes, how many a query meets in a band."""
        return stored * sum(comb(b - a, i) / 2 ** (b - a) for a, b in self.bounds for i in range(self.turned + 1))


def bit_bands(bits: int, differing: int, stored: int) -> Bands:
    """Bands for a store of ``stored`` hashes: few broad bands with several turned bits meet fewer hashes, many
    narrow ones need fewer signatures of a query. The sum of both is smallest."""
    found = []
    fewest = -(-bits // 32)
    for n in range(fewest, max(fewest, differing + 1) + 1):
        cuts = [bits * i // n for i in range(n + 1)]
        bands = Bands(list(zip(cuts, cuts[1:])), differing // n)
        if bands.probes <= MOST_PROBES:
            found.append(bands)
    return min(found, key=lambda bands: bands.probes + bands.met(stored))


def _band(words: Column, first: int, last: int) -> Column:
    """Bits ``first`` to ``last`` (behind it) of 32-bit words as a number."""
    at, width = first // 32, last - first
    pair = F.shiftleft(F.get(words, F.lit(at)), 32).bitwiseOR(F.coalesce(F.get(words, F.lit(at + 1)), F.lit(0)))
    return F.shiftrightunsigned(pair, 64 - first % 32 - width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _plain_bands(hashes: DataFrame, bands: Bands) -> DataFrame:
    values = [
        F.struct(F.lit(n).alias("nth"), F.lit(b - a).alias("width"), _band(F.col("words"), a, b).alias("value"))
        for n, (a, b) in enumerate(bands.bounds)
    ]
    return hashes.select("hash", "words", F.inline(F.array(*values)))


def _turned_bands(hashes: DataFrame, bands: Bands) -> DataFrame:
    """Every band as it is and with each choice of up to ``turned`` bits turned."""
    masks = {
        width: [sum(1 << at for at in chosen) for i in range(bands.turned + 1) for chosen in combinations(range(width), i)]
        for width in {b - a for a, b in bands.bounds}
    }
    of_width = F.create_map(*[x for width, some in masks.items() for x in (F.lit(width), F.lit(some).cast("array<long>"))])
    turned = F.explode(F.element_at(of_width, F.col("width"))).alias("mask")
    rows = _plain_bands(hashes, bands).select("hash", "words", "nth", "value", turned)
    return rows.select("hash", "words", "nth", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))


#: Pairs that cost as much as a row of a signature, and as two hashes that meet in a band, where all pairs are compared.
ROW_PAIRS, MET_PAIRS = 400, 80
#: Hashes of a block, the fewest that are worth a block of their own, and pairs that are compared at once.
HASH_BLOCK, SMALL_HASH_BLOCK, HASH_TILE = 1 << 18, 1 << 11, 1 << 16


def _near_rows(one: np.ndarray, two: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of ``one`` and ``two`` (64-bit words, a row for each word of all hashes) with at most ``most`` unequal bits.

    Half of the words rules most pairs out.
    """
    n_words, n = two.shape
    half = (n_words + 1) // 2
    width = min(n, 1 << 12)
    height = max(1, HASH_TILE // width)
    for i in range(0, one.shape[1], height):
        for j in range(0, n, width):
            x, y = one[:, i : i + height], two[:, j : j + width]
            unequal = np.zeros((x.shape[1], y.shape[1]), np.uint8 if half <= 3 else np.uint16)
            for word in range(half):
                unequal += np.bitwise_count(x[word][:, None] ^ y[word])
            hit = np.flatnonzero(unequal <= most)
            a, b = hit // y.shape[1], hit % y.shape[1]
            distance = unequal.ravel()[hit].astype(np.int64)
            for word in range(half, n_words):
                distance += np.bitwise_count(x[word][a] ^ y[word][b])
            stays = distance <= most
            if stays.any():
                yield i + a[stays], j + b[stays], distance[stays]


def _near_words(left: DataFrame, right: DataFrame, differing: int, counts: tuple[int, int]) -> DataFrame:
    """Pairs ``(words, other_words, distance)`` of distinct words with at most ``differing`` unequal bits, by all pairs.

    Two blocks of words meet in one task, in tiles; nothing is shuffled but the words, once for each block they meet.
    """
    within = left is right
    cores = left.sparkSession.sparkContext.defaultParallelism
    n_blocks = [max(1, -(-n // HASH_BLOCK), min(n // SMALL_HASH_BLOCK, ceil(4 * sqrt(cores)))) for n in counts]

    def dealt(words: DataFrame, own: int, others: int, side: int) -> DataFrame:
        block = F.pmod(F.xxhash64("words"), F.lit(own)).cast("int").alias("block")
        rows = words.select("words", block).select("*", F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias("other"))
        if within:
            role = F.when(F.col("block") > F.col("other"), 1).otherwise(0)
            return rows.select(F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), role.alias("role"), "words")
        one, two = ("other", "block") if side else ("block", "other")
        return rows.select(F.col(one).alias("one"), F.col(two).alias("two"), F.lit(side).alias("role"), "words")

    rows = dealt(left, n_blocks[0], n_blocks[1], 0)
    if not within:
        rows = rows.unionByName(dealt(right, n_blocks[1], n_blocks[0], 1))
    tasks = n_blocks[0] * (n_blocks[0] + 1) // 2 if within else n_blocks[0] * n_blocks[1]

    def packed(words: pa.Array) -> np.ndarray:
        flat = words.flatten().to_numpy().astype(np.uint64).reshape(len(words), -1)
        flat = np.pad(flat, ((0, 0), (0, flat.shape[1] % 2)))
        return np.ascontiguousarray((flat[:, ::2] << np.uint64(32) | flat[:, 1::2]).T)

    def worked(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        alone = within and rows.column("one")[0] == rows.column("two")[0]
        cut = int((rows.column("role").to_numpy() == 0).sum())
        words = rows.column("words").combine_chunks()
        one, two = words.slice(0, cut), words.slice(0, cut) if alone else words.slice(cut)
        if not len(one) or not len(two):
            return
        for a, b, distance in _near_rows(packed(one), packed(two), differing):
            columns = [one.take(pa.array(a)), two.take(pa.array(b)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, names=["words", "other_words", "distance"])
            if within and not alone:
                yield pa.RecordBatch.from_arrays([columns[1], columns[0], columns[2]], names=["words", "other_words", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            keys = batch.column("one").to_numpy().astype(np.int64) << 32 | batch.column("two").to_numpy()
            cuts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)).tolist() + [len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if int(keys[a]) != now:
                    if held:
                        yield from worked(pa.Table.from_batches(held))
                    held, now = [], int(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from worked(pa.Table.from_batches(held))

    put = rows.repartition(max(1, min(tasks, 16 * cores)), "one", "two").sortWithinPartitions("one", "two", "role")
    return put.mapInArrow(run, "words array<bigint>, other_words array<bigint>, distance bigint")


def similar_hash_pairs(left: DataFrame, right: DataFrame, minimum: float, digits: int) -> DataFrame:
    """Pairs of distinct hashes ``(hash, other, similarity)`` with bit likeness of at least ``minimum``.

    Loose bounds compare all pairs, in tiles and by bits: the signatures of an index would be thousands of rows a hash.
    Strict ones use an exact one-sided multi-index join: ``right``, the store, has one row for each band of a hash,
    ``left`` is looked up with bits of its bands turned. A pair stays at the first band in which it meets.
    Turned bands and pairs are joined by sorting, never broadcast: estimates do not see how many they are.
    """
    bits = digits * 4
    differing = max(d for d in range(bits + 1) if 1 - d / bits >= minimum)
    same = left is right
    stored = cut_lineage(_with_words(right, digits))
    asked = stored if same else cut_lineage(_with_words(left, digits))
    n_stored = stored.count()
    bands = bit_bands(bits, differing, n_stored)
    likeness = (1 - F.col("distance") / F.lit(float(bits))).alias("similarity")
    if bands.probes * ROW_PAIRS + bands.met(n_stored) * MET_PAIRS >= n_stored:
        # Some texts have equal words, as upper and lower case.
        words = stored.where(F.forall("words", lambda w: w.isNotNull())).select("words").distinct()
        others = words if same else asked.where(F.forall("words", lambda w: w.isNotNull())).select("words").distinct()
        near = _near_words(others, words, differing, (n_stored if same else asked.count(), n_stored))
        held = stored.select(F.col("hash").alias("other"), F.col("words").alias("other_words"))
        return near.join(asked.hint("merge"), "words").join(held.hint("merge"), "other_words").select("hash", "other", likeness)
    l = _turned_bands(asked, bands).alias("l")
    r = _plain_bands(stored, bands).drop("width").alias("r")
    distance = _unequal_bits(digits)
    met = (F.col("l.nth") == F.col("r.nth")) & (F.col("l.value") == F.col("r.value"))
    near = l.join(r.hint("merge"), met & (distance <= differing)).select(
        F.col("l.hash").alias("hash"),
        F.col("r.hash").alias("other"),
        F.col("l.nth").alias("nth"),
        distance.alias("distance"),
        F.zip_with("l.words", "r.words", lambda a, b: a.bitwiseXOR(b)).alias("unequal"),
    )
    first = F.coalesce(
        *[F.when(F.bit_count(_band(F.col("unequal"), a, b)) <= bands.turned, F.lit(n)) for n, (a, b) in enumerate(bands.bounds)]
    )
    return near.where(F.col("nth") == first).select("hash", "other", likeness)


def find_similar_hashes(
    store: DataFrame, queries: DataFrame, minimum: float = 0.8, digits: int = 64
) -> DataFrame:
    """Stored hashes at least ``minimum`` alike to each query hash: ``(hash, other, similarity, n_files)``.

    A result per distinct hash: ``n_files`` stored files share ``other``, however many they are.
    """
    files = store.groupBy(F.col("hash").alias("other")).agg(F.count(F.lit(1)).alias("n_files"))
    return similar_hash_pairs(queries, store, minimum, digits).join(files, "other").select(
        "hash", "other", "similarity", "n_files"
    )


def hash_match_summary(
    store: DataFrame, queries: DataFrame, minimum: float = 0.8, digits: int = 64, k: int = 5
) -> DataFrame:
    """Per query file: number of other stored files alike to it, highest likeness, ``k`` best paths.

    Copies of a hash are counted, not listed: of every stored hash only the first ``k + 1`` paths
    can be among the best (one of them may be the query file itself).
    """
    similar = cut_lineage(find_similar_hashes(store, queries, minimum, digits))
    by_path = W.partitionBy("hash").orderBy("file_path")
    first_paths = (
        store.select("hash", "file_path")
        .withColumn("_n", F.row_number().over(by_path))
        .where(F.col("_n") <= k + 1)
        .select(F.col("hash").alias("other"), "file_path")
    )
    best_first = W.partitionBy("hash").orderBy(F.desc("similarity"), "file_path")
    top = (
        similar.join(first_paths, "other")
        .withColumn("_r", F.row_number().over(best_first))
        .where(F.col("_r") <= k + 1)
        .groupBy("hash")
        .agg(F.array_sort(F.collect_list(F.struct("_r", "file_path", "similarity"))).alias("top"))
    )
    totals = similar.groupBy("hash").agg(F.sum("n_files").alias("n_files"))
    per_hash = totals.join(top, "hash")
    stored = store.select("file_path", F.col("hash").alias("stored_hash"), F.lit(1).alias("is_stored")).distinct()
    files = queries.select("hash", "file_path").join(
        stored.withColumnRenamed("stored_hash", "hash"), ["file_path", "hash"], "left"
    )
    joined = salted_join(files, per_hash, ["hash"], [F.col("file_path")], how="inner")
    others = let(
        F.struct("top", "file_path"),
        lambda s: F.filter(s["top"], lambda t: t["file_path"] != s["file_path"]),
    )
    return (
        joined.withColumn("n_matches", F.col("n_files") - F.coalesce("is_stored", F.lit(0)))
        .where("n_matches > 0")
        .select(
            F.col("file_path").alias("query_path"),
            "n_matches",
            F.get(others, F.lit(0))["similarity"].alias("highest"),
            F.transform(F.slice(others, 1, k), lambda t: t["file_path"]).alias("top_paths"),
        )
    )


def descriptor_match(query: DataFrame, train: DataFrame, ratio: float = 0.75) -> DataFrame:
    """Share of query descriptors whose nearest train descriptor is clearly nearer than the second.

    Both sides are ``(pair_id, desc_id, bits array<bigint>)``; descriptors meet within their image
    pair only. The two nearest are kept by a partial top-2 before any exchange.
    """
    t = train.select("pair_id", F.col("desc_id").alias("train_id"), F.col("bits").alias("train_bits"))
    words = F.zip_with("bits", "train_bits", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    distance = F.aggregate(words, F.lit(0), lambda s, d: s + d)
    met = query.join(t, "pair_id").select("pair_id", "desc_id", "train_id", distance.alias("distance"))
    nearest = W.partitionBy("pair_id", "desc_id").orderBy("distance", "train_id")
    two = (
        met.withColumn("_r", F.row_number().over(nearest))
        .where("_r <= 2")
        .groupBy("pair_id", "desc_id")
        .agg(F.min("distance").alias("d1"), F.max("distance").alias("d2"), F.count(F.lit(1)).alias("n"))
    )
    good = (F.col("n") == 2) & (F.col("d1") < F.lit(ratio) * F.col("d2"))
    return two.groupBy("pair_id").agg(
        F.count_if(good).alias("good"),
        F.count(F.lit(1)).alias("n_descriptors"),
        (F.count_if(good) / F.count(F.lit(1))).alias("orb_score"),
    )


def match_percentage(orb: Column, ssim: Column) -> Column:
    return (orb * 0.4 + ssim * 0.6) * 100


def compare_with_reference_set(pairs: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Best reference image per query from scored pairs ``(image_id, ref_id, orb_score, ssim)``.

    Gives the number compared and matched; without a match the best fields are null, score 0.
    """
    score = match_percentage(F.col("orb_score"), F.col("ssim"))
    scored = pairs.withColumn("score", score).withColumn("is_match", F.col("score") >= threshold * 100)
    order = F.when(F.col("is_match"), F.struct("score", -F.col("ref_id"), "ssim"))
    return scored.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("total_compared"),
        F.count_if("is_match").alias("n_matches"),
        F.max_by("ref_id", order).alias("best_ref"),
        F.coalesce(F.max_by("score", order), F.lit(0.0)).alias("best_score"),
        F.max_by("ssim", order).alias("best_ssim"),
    )


def ssim(
    a: DataFrame, b: DataFrame, keys: list[str], side: int = 7, data_range: float = 255.0
) -> DataFrame:
    """Mean structural likeness of image pairs given as pixels ``(*keys, y, x, v)``.

    Only whole windows count, as in a cropped comparison. Sums over a window are rolling sums along x,
    then along y, so that a pixel is one row throughout and a task holds one line of an image.
    """
    joined = a.select(*keys, "y", "x", F.col("v").cast("double").alias("p")).join(
        b.select(*keys, "y", "x", F.col("v").cast("double").alias("q")), [*keys, "y", "x"]
    )
    p, q = F.col("p"), F.col("q")
    terms = {"n": F.lit(1.0), "p": p, "q": q, "pp": p * p, "qq": q * q, "pq": p * q}
    along_x = W.partitionBy(*keys, "y").orderBy("x").rangeBetween(0, side - 1)
    along_y = W.partitionBy(*keys, "x").orderBy("y").rangeBetween(0, side - 1)
    lines = joined.select(*keys, "y", "x", *[term.alias(name) for name, term in terms.items()])
    for direction in (along_x, along_y):
        lines = lines.select(*keys, "y", "x", *[F.sum(name).over(direction).alias(name) for name in terms])
    n = float(side * side)

    def spread(product: str, one: str, two: str) -> Column:
        return (F.col(product) - F.col(one) * F.col(two) / n) / (n - 1)

    windows = lines.where(F.col("n") == n).select(
        *keys, (p / n).alias("mp"), (q / n).alias("mq"), spread("pp", "p", "p").alias("vp"),
        spread("qq", "q", "q").alias("vq"), spread("pq", "p", "q").alias("cov"),
    )
    # fixed values: the usual stabilizers
    c1, c2 = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2
    mp, mq, vp, vq, cov = (F.col(n) for n in ("mp", "mq", "vp", "vq", "cov"))
    likeness = ((2 * mp * mq + c1) * (2 * cov + c2)) / ((mp * mp + mq * mq + c1) * (vp + vq + c2))
    return windows.groupBy(*keys).agg(F.avg(likeness).alias("ssim"))


def drawing_boxes(points: DataFrame, minimum: float = 50.0) -> DataFrame:
    """Bounding box per drawing from its path points ``(doc_id, page, drawing_id, x, y)``."""
    boxes = points.groupBy("doc_id", "page", "drawing_id").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")
    )
    return boxes.where((F.col("x1") - F.col("x0") >= minimum) & (F.col("y1") - F.col("y0") >= minimum))
