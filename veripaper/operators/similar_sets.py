"""Exact Jaccard join of sets of 3-grams: blocks of sets of near sizes meet in pairs, each pair in one task."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.scale import _starts

#: Grams of a block, where a set counts for ``EXTRA`` more, and the fewest sets that are worth a block of their own.
BLOCK_GRAMS, EXTRA, SMALL_BLOCK = 4 << 20, 32, 1 << 12
#: Pairs of sets that are bounded at once, that wait to be compared, and whose grams are compared at once.
TILE, WAITING, CHECKED = 1 << 16, 1 << 18, 1 << 13
#: 64-bit words of the longest bitmap of a set; shorter ones are folded from it.
BITMAP_WORDS = 8
#: Up to this size, sets of each size are counted by themselves.
OWN_SIZE = 1024


def _codes(grams: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 3-grams of concatenated ones as numbers of three 21-bit characters, and how many each set has."""
    sizes = pc.utf8_length(grams).to_numpy(zero_copy_only=False).astype(np.int64) // 3
    text = b"".join(grams.cast(pa.binary()).to_pylist()).decode()
    letters = np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(-1, 3)
    codes = letters[:, 0].astype(np.int64)
    for n in (1, 2):
        codes <<= 21
        codes += letters[:, n]
    return codes, sizes


class _Sets:
    """Sets in the order of their sizes: their grams, the rarest first, and bitmaps of all grams."""

    def __init__(self, grams: np.ndarray, sizes: np.ndarray) -> None:
        n = len(sizes)
        self.order = np.argsort(sizes, kind="stable")
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        self.sizes = sizes[self.order]
        self.begin = np.cumsum(self.sizes) - self.sizes
        keys = np.repeat(place << 32, sizes)
        keys |= grams
        keys.sort()
        self.grams, self.owner = keys.astype(np.uint32).astype(np.int32), (keys >> 32).astype(np.int32)
        del keys
        flat = np.zeros(n * 64 * BITMAP_WORDS, bool)
        flat[self.owner.astype(np.int64) * (64 * BITMAP_WORDS) + self.grams % (64 * BITMAP_WORDS)] = True
        bits = np.packbits(flat, bitorder="little").view(np.uint64).reshape(n, BITMAP_WORDS)
        self.bits = {BITMAP_WORDS: np.ascontiguousarray(bits.T)}
        words = BITMAP_WORDS
        while words > 1:
            words //= 2
            self.bits[words] = self.bits[2 * words][:words] | self.bits[2 * words][words:]

    def prefix(self, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Grams and owners of the rarest grams, of which one is shared with a set that shares over ``share`` of all."""
        keep = self.sizes - np.floor(self.sizes * share - 1e-9).astype(np.int64)
        chosen = np.arange(len(self.grams)) < np.repeat(self.begin + keep, self.sizes)
        grams, owner = self.grams[chosen], self.owner[chosen]
        by_gram = np.argsort(grams, kind="stable")
        return grams[by_gram], owner[by_gram]


def _common(one: _Sets, two: _Sets, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many grams the sets of each pair share, and the rarest of them."""
    out, rarest = np.zeros(len(a), np.int64), np.full(len(a), -1)
    for at in range(0, len(a), CHECKED):
        pair = slice(at, at + CHECKED)
        keys = []
        for sets, chosen in ((one, a[pair]), (two, b[pair])):
            sizes = sets.sizes[chosen]
            ends = np.cumsum(sizes)
            places = np.arange(ends[-1]) + np.repeat(sets.begin[chosen] - ends + sizes, sizes)
            keys.append(np.repeat(np.arange(len(chosen)), sizes) << 32 | sets.grams[places])
        together = np.sort(np.concatenate(keys))
        same = together[1:][together[1:] == together[:-1]]
        out[pair] = np.bincount(same >> 32, minlength=len(out[pair]))
        sharing, at_first = np.unique(same >> 32, return_index=True)
        rarest[at + sharing] = same[at_first] & 0xFFFFFFFF
    return out, rarest


def _pairs(small: _Sets, large: _Sets, threshold: float, longer: bool, within: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs ``(place in small, place in large, likeness)`` above ``threshold``, each once, the second set no smaller.

    ``longer``: only pairs in which it is larger. ``within``: both are the same sets, which meet in their order.

    Prefix filter: in the order of rarity the smaller set of such a pair has over 2 t / (1 + t) of its grams in common
    with the other, which has over t of its own, so they share one of the grams before that many. Sets that meet at a
    gram are bounded by bitmaps, as they differ in as many grams as bits at least. A pair stays at its rarest gram.
    """
    differ = (1 - threshold) / (1 + threshold)
    s_grams, s_owner = small.prefix(2 * threshold / (1 + threshold))
    l_grams, l_owner = large.prefix(threshold)
    met, s_first, s_count = np.unique(s_grams, return_index=True, return_counts=True)
    l_first, l_last = np.searchsorted(l_grams, met, "left"), np.searchsorted(l_grams, met, "right")
    found: list[np.ndarray] = []
    at_gram: list[np.ndarray] = []
    waiting = 0

    def checked() -> tuple[np.ndarray, ...]:
        pairs, first = np.unique(np.concatenate(found), return_index=True)
        gram = np.concatenate(at_gram)[first]
        a, b = pairs // len(large.sizes), pairs % len(large.sizes)
        total = small.sizes[a] + large.sizes[b]
        words = zip(small.bits[BITMAP_WORDS], large.bits[BITMAP_WORDS])
        unequal = sum(np.bitwise_count(x[a] ^ y[b]).astype(np.int64) for x, y in words)
        stays = unequal <= total * differ + 1e-6
        a, b, total, gram = a[stays], b[stays], total[stays], gram[stays]
        common, rarest = _common(small, large, a, b)
        likeness = common / (total - common)
        stays = (likeness > threshold) & (gram == rarest)
        return a[stays], b[stays], likeness[stays]

    for gram, first, count, lo, hi in zip(met.tolist(), s_first.tolist(), s_count.tolist(), l_first.tolist(), l_last.tolist()):
        others = l_owner[lo:hi]
        other_sizes = large.sizes[others]
        at, last = first, first + count
        while at < last:
            begin = int(np.searchsorted(other_sizes, small.sizes[s_owner[at]], "right" if longer else "left"))
            if within:
                begin = max(begin, int(np.searchsorted(others, s_owner[at], "right")))
            if begin == len(others):
                break
            some = s_owner[at : min(last, at + max(1, TILE // (len(others) - begin)))]
            at += len(some)
            sizes = small.sizes[some]
            end = int(np.searchsorted(other_sizes, sizes[-1] / threshold + 1e-6, "right"))
            if begin >= end:
                continue
            right, right_sizes = others[begin:end], other_sizes[begin:end]
            # So many bits that sets with nothing in common would differ in far more of them than similar ones.
            wanted = differ * int(sizes[-1] + right_sizes[-1]) / 20
            words = 1 if wanted <= 1 else 2 if wanted <= 2 else 4 if wanted <= 4 else BITMAP_WORDS
            kind, most = (np.uint8, 64) if words == 1 else (np.uint16, 512)
            unequal = np.zeros((len(some), len(right)), kind)
            for x, y in zip(small.bits[words], large.bits[words]):
                unequal += np.bitwise_count(x[some][:, None] ^ y[right])
            own, others_own = (np.minimum(np.ceil(v * differ + 1e-6), most).astype(kind) for v in (sizes, right_sizes))
            hit = np.flatnonzero(unequal <= own[:, None] + others_own)
            if not len(hit):
                continue
            a, b = some[hit // len(right)], right[hit % len(right)]
            if within:
                stays = a < b
            else:
                stays = small.sizes[a] < large.sizes[b] if longer else small.sizes[a] <= large.sizes[b]
            found.append(a[stays].astype(np.int64) * len(large.sizes) + b[stays])
            at_gram.append(np.full(len(found[-1]), gram))
            waiting += len(found[-1])
            if waiting >= WAITING:
                yield checked()
                found.clear()
                at_gram.clear()
                waiting = 0
    if found:
        yield checked()


def _similar(one: tuple, two: tuple | None, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs ``(place in one, place in two, likeness)`` of sets given as grams and sizes; without ``two`` of two in ``one``."""
    grams = np.concatenate([one[0], two[0]]) if two else one[0]
    encoded = pa.array(grams).dictionary_encode()
    codes = encoded.indices.to_numpy()
    counts = np.bincount(codes)
    rarity = np.empty(len(counts), np.int32)
    rarity[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    codes = rarity[codes]
    left = _Sets(codes[: len(one[0])], one[1])
    if two is None:
        for a, b, likeness in _pairs(left, left, threshold, False, True):
            yield left.order[a], left.order[b], likeness
        return
    right = _Sets(codes[len(one[0]) :], two[1])
    for a, b, likeness in _pairs(left, right, threshold, False, False):
        yield left.order[a], right.order[b], likeness
    if left.sizes[-1] > right.sizes[0]:
        for b, a, likeness in _pairs(right, left, threshold, True, False):
            yield left.order[a], right.order[b], likeness


def _ages(rows: pa.Table) -> np.ndarray:
    """Places in the order of (created_at, paper_id), nulls first; equal ones share a place."""
    ages = rows.select(["created_at", "paper_id"])
    order = pc.sort_indices(ages, sort_keys=[(c, "ascending") for c in ages.column_names], null_placement="at_start")
    starts = np.zeros(len(order), np.int64)
    starts[_starts(ages.take(order), ages.column_names)] = 1
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.cumsum(starts)
    return place


def _worked(rows: pa.Table, threshold: float, wanted: str, within: bool, alone: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The pairs of two blocks, whose rows are sorted by ``role``, or of one block (``alone``)."""
    rows = rows.combine_chunks()
    n_left = int((rows.column("role").to_numpy() == 0).sum())
    one, two = rows.slice(0, n_left), rows.slice(n_left)
    if not n_left or not (two.num_rows or alone):
        return
    sets = [_codes(side.column("grams")) for side in (one, two) if side.num_rows]
    ages = _ages(rows) if wanted != "both" else None
    best: list[np.ndarray] | None = None

    def batches(l: np.ndarray, r: np.ndarray, score: np.ndarray) -> list[pa.RecordBatch]:
        key = rows.column("set")
        columns = {"l_set": key.take(l), "r_set": key.take(r), "score": pa.array(score)}
        if wanted == "best":
            columns |= {c: rows.column(c).take(r) for c in ("created_at", "paper_id")}
        return pa.table([columns[f.name].cast(f.type) for f in schema], schema=schema).to_batches()

    for l, r, score in _similar(sets[0], sets[1] if len(sets) == 2 else None, threshold):
        r = r + n_left if len(sets) == 2 else r
        if within and wanted == "both":
            l, r, score = np.concatenate([l, r]), np.concatenate([r, l]), np.tile(score, 2)
        elif within:
            later = ages[l] > ages[r]
            stays = ages[l] != ages[r]
            l, r, score = np.where(later, l, r)[stays], np.where(later, r, l)[stays], score[stays]
        if wanted != "best":
            yield from batches(l, r, score)
            continue
        if best is not None:
            l, r, score = (np.concatenate(v) for v in zip(best, (l, r, score)))
        order = np.lexsort((ages[r], -score, l))
        kept = order[np.diff(l[order], prepend=-1) > 0]
        best = [l[kept], r[kept], score[kept]]
    if best is not None:
        yield from batches(*best)


class _Blocks:
    """Blocks of sets in the order of their sizes. Sizes are bounded by ``least`` and ``most`` of each block."""

    def __init__(self, sets: DataFrame, cores: int) -> None:
        bucket = self._bucket(F.col("n"))
        counted = sets.select((F.length("grams") / 3).cast("int").alias("n")).groupBy(bucket.alias("bucket")).agg(
            F.count(F.lit(1)).alias("count"), F.min("n").alias("least"), F.max("n").alias("most")
        )
        rows = sorted(counted.collect())
        n = sum(r["count"] for r in rows)
        weights = [r["count"] * (r["most"] + EXTRA) for r in rows]
        self.n = max(1, ceil(sum(weights) / BLOCK_GRAMS), min(n // SMALL_BLOCK, ceil(4 * sqrt(cores))))
        width = max(sum(weights), 1) / self.n
        self.start, at = [0.0] * (max((r["bucket"] for r in rows), default=0) + 1), 0.0
        self.span = list(self.start)
        self.least, self.most = [1 << 62] * (self.n + 1), [0] * (self.n + 1)
        for r, weight in zip(rows, weights):
            self.start[r["bucket"]], self.span[r["bucket"]] = at, weight / width
            for block in range(int(at), int(at + weight / width) + 1):
                self.least[block] = min(self.least[block], r["least"])
                self.most[block] = max(self.most[block], r["most"])
            at += weight / width

    @staticmethod
    def _bucket(size: Column) -> Column:
        return F.when(size <= OWN_SIZE, size).otherwise(OWN_SIZE + F.ceil(64 * (F.log2(size) - log2(OWN_SIZE)))).cast("int")

    def of(self, sets: DataFrame) -> Column:
        """The block of a set; sets of one size are dealt by their keys."""
        bucket = self._bucket(F.length("grams") / 3)
        part = F.pmod(F.xxhash64("set"), F.lit(1 << 20)) / float(1 << 20)
        return (F.get(_numbers(self.start, "double"), bucket) + part * F.get(_numbers(self.span, "double"), bucket)).cast("int")

    def met(self, others: _Blocks, threshold: float) -> tuple[list[int], list[int]]:
        """For each block the first and the last of ``others`` with sets of sizes that can be similar, 0 and -1 for none."""
        first, last = [], []
        for least, most in zip(self.least, self.most):
            near = [
                k for k, (a, b) in enumerate(zip(others.least, others.most)) if b >= least * threshold - 1e-6 and most >= a * threshold - 1e-6
            ]
            first.append(near[0] if near else 0)
            last.append(near[-1] if near else -1)
        return first, last


def _numbers(values: list, kind: str) -> Column:
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def similar_sets(left: DataFrame, right: DataFrame, threshold: float, wanted: str) -> DataFrame:
    """Pairs of sets ``(l_set, r_set, score)`` with Jaccard likeness above ``threshold``.

    ``left`` and ``right`` are (set, first, grams), one row per distinct set, which are read more than once: ``set`` is
    its key, ``first`` its earliest paper, ``grams`` its 3-grams put together. If both are the same table, pairs
    are of a set and one whose ``first`` is earlier (``wanted`` is ``earlier``), or of all different sets (``both``).
    ``best``: only earlier ones, and of each left set the best pair of each task, with ``r_first``.

    Sets are cut into blocks by their sizes. Two blocks of sizes that can be similar meet in one task, which keeps an
    index of both; nothing is shuffled but the sets, once for each block they meet.
    """
    context = left.sparkSession.sparkContext
    within = left is right
    blocks = _Blocks(left, context.defaultParallelism)
    other_blocks = blocks if within else _Blocks(right, context.defaultParallelism)
    sides = [(left, blocks, other_blocks, 0)] + ([] if within else [(right, other_blocks, blocks, 1)])
    dealt, n_tasks = [], 0
    for sets, own, others, side in sides:
        first, last = own.met(others, threshold)
        n_tasks += sum(b - a + 1 for a, b in zip(first, last))
        block = sets.select("set", "first.created_at", "first.paper_id", "grams", own.of(sets).alias("block"))
        range_ = [F.get(_numbers(v, "int"), F.col("block")) for v in (first, last)]
        rows = block.where(range_[0] <= range_[1]).select("*", F.explode(F.sequence(*range_)).alias("other"))
        if within:
            one, two = F.least("block", "other"), F.greatest("block", "other")
            role = F.when(F.col("block") > F.col("other"), 1).otherwise(0)
        else:
            one, two = (F.col("block"), F.col("other")) if side == 0 else (F.col("other"), F.col("block"))
            role = F.lit(side)
        dealt.append(rows.select(one.alias("one"), two.alias("two"), role.alias("role"), "set", "created_at", "paper_id", "grams"))
    rows = dealt[0] if within else dealt[0].unionByName(dealt[1])
    partitions = max(1, min(ceil(n_tasks / 2), 16 * context.defaultParallelism))
    kinds = dict(rows.dtypes)
    columns = {"l_set": kinds["set"], "r_set": kinds["set"], "score": "double"}
    if wanted == "best":
        columns |= {c: kinds[c] for c in ("created_at", "paper_id")}
    ddl = ", ".join(f"{c} {kind}" for c, kind in columns.items())
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def work() -> Iterator[pa.RecordBatch]:
            if held:
                alone = within and now >> 32 == now & 0xFFFFFFFF
                yield from _worked(pa.Table.from_batches(held), threshold, wanted, within, alone, schema)
                held.clear()

        for batch in batches:
            keys = batch.column("one").to_numpy().astype(np.int64) << 32 | batch.column("two").to_numpy()
            cuts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)).tolist() + [len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if int(keys[a]) != now:
                    yield from work()
                    now = int(keys[a])
                held.append(batch.slice(a, b - a))
        yield from work()

    pairs = rows.repartition(partitions, "one", "two").sortWithinPartitions("one", "two", "role").mapInArrow(run, ddl)
    if wanted == "best":
        return pairs.select("l_set", "r_set", "score", F.struct("created_at", "paper_id").alias("r_first"))
    return pairs
