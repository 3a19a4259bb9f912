"""Matching references and papers against a catalogue."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scale import cut_lineage
from ..functions.text import (
    blank,
    edit_similarity,
    let,
    normalize_string,
    title_similarity,
    title_words,
)


def verify_by_doi(refs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Status of references that carry a DOI: VALID when the catalogue has it, else MISSING."""
    cleaned = F.trim(F.regexp_replace("doi", r"^https?://doi\.org/|^doi:", ""))
    known = catalogue.where(~blank(F.col("doi"))).groupBy("doi").agg(F.min("cat_id").alias("cat_id"))
    with_doi = refs.where(~blank(F.col("doi"))).withColumn("clean_doi", cleaned)
    return (
        with_doi.join(known.withColumnRenamed("doi", "clean_doi"), "clean_doi", "left")
        .withColumn("status", F.when(F.col("cat_id").isNotNull(), "VALID").otherwise("MISSING"))
        .drop("clean_doi")
    )


#: Sets in the first block of a search for each hit it wants, and the most sets of a block.
HEAD, SHARE_ROWS = 64, 1 << 17
#: Queries of one task, how many of them it searches for at once, and pairs of a query and a set that it compares at once.
GROUP, SLICE, PAIRS = 1 << 18, 1 << 14, 1 << 19
#: Words of 64 bits in which a set notes the most frequent words of its block.
PLANES = 2


def _word_sets(df: DataFrame, text: Column, *others: str) -> DataFrame:
    """Rows with words: ``others``, the key of the word set and the words as 64-bit numbers."""
    words = F.array_sort(title_words(text))
    rows = df.select(*others, words.alias("words")).where(F.size("words") > 0)
    codes = F.transform("words", lambda w: F.xxhash64(w))
    return rows.select(*others, F.md5(F.array_join("words", " ")).alias("_set"), codes.alias("codes"))


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers ``begin .. begin + count - 1`` of all ranges, one range after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + count, count)


class _Search:
    """The ``k`` best sets of many queries, found in blocks of sets that come in the order of their ids.

    A later set has a larger id, so it must share more words than the k-th set found, and as many as the k-th
    row: ``need``. A set that shares ``need`` of ``n`` words has one of any ``n - need + 1`` of them, so only
    the postings of a query's rarest words in the block are read. The most frequent words are bits of each
    set, which bound what a set can share before pairs are put together; the other words are looked up.
    """

    def __init__(self, ids: np.ndarray, codes: np.ndarray, sizes: np.ndarray, k: int) -> None:
        self.queries, self.sizes, self.begin, self.k = ids, sizes, np.cumsum(sizes) - sizes, k
        self.vocabulary, self.words = np.unique(codes, return_inverse=True)
        self.need = np.ones(len(ids), np.int64)
        self.overlap, self.rows = np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), np.int64)
        self.sets = np.zeros((len(ids), k), "S32")

    def block(self, ids: np.ndarray, rows: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> None:
        m = len(ids)
        word = np.minimum(np.searchsorted(self.vocabulary, codes), len(self.vocabulary) - 1)
        known = self.vocabulary[word] == codes
        word = word[known]
        postings = np.sort(word * m + np.repeat(np.arange(m), sizes)[known])
        counts = np.bincount(word, minlength=len(self.vocabulary))
        starts = np.cumsum(counts) - counts
        # The most frequent words are bits of each set.
        bits, marks = np.zeros((PLANES, len(counts)), np.uint64), np.zeros((PLANES, m), np.uint64)
        for i, w in enumerate(np.argsort(counts)[-64 * PLANES :]):
            bits[i // 64, w] = bit = np.uint64(1 << i % 64)
            marks[i // 64, postings[starts[w] : starts[w] + counts[w]] - w * m] |= bit

        # Few queries at once, so that what is noted for each of their words stays small.
        open_ = np.flatnonzero(self.sizes >= self.need)
        for at in range(0, len(open_), SLICE):
            self._search(open_[at : at + SLICE], ids, rows, postings, counts, starts, bits, marks)

    def _search(
        self, asked: np.ndarray, ids: np.ndarray, rows: np.ndarray, postings: np.ndarray, counts: np.ndarray,
        starts: np.ndarray, bits: np.ndarray, marks: np.ndarray,
    ) -> None:
        m = len(ids)
        sizes, need = self.sizes[asked], self.need[asked]
        begin = np.cumsum(sizes) - sizes
        words = self.words[_ranges(self.begin[asked], sizes)]
        owner = np.repeat(np.arange(len(asked)), sizes)
        words = words[np.argsort(owner << 32 | counts[words])]
        rank = np.arange(len(words)) - np.repeat(begin, sizes)
        is_read = rank <= np.repeat(sizes - need, sizes)
        read = np.where(is_read, counts[words], 0)
        marked = bits[:, words].any(axis=0)
        own_bits = [b[words] for b in bits]
        all_bits = [np.add.reduceat(b, begin) if len(b) else b for b in own_bits]
        # Bits and number of the words after a word: what a set whose rarest shared word this is can share.
        after = [np.repeat(np.cumsum(t), sizes) - np.cumsum(b) for t, b in zip(all_bits, own_bits)]
        plain = np.where(marked, 0, counts[words] > 0)
        n_plain = np.bincount(owner, plain, len(asked)).astype(np.int64)
        least = np.repeat(need - 1 - np.cumsum(n_plain), sizes) + np.cumsum(plain)
        # Words neither read nor marked are looked up.
        others = words[(plain > 0) & ~is_read]
        n_others = np.bincount(owner[(plain > 0) & ~is_read], minlength=len(asked))
        others_begin = np.cumsum(n_others) - n_others
        until = np.cumsum(np.bincount(owner, read, len(asked)).astype(np.int64))
        first = 0
        while first < len(asked):
            done = until[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(until, done + PAIRS, "right")))
            part = slice(begin[first], begin[last - 1] + sizes[last - 1])
            of, word, has_bit = owner[part], words[part], marked[part]
            keys = []
            for by_bit in (False, True):
                some = np.flatnonzero(has_bit == by_bit)
                count = read[part][some]
                sets = postings[_ranges(starts[word[some]], count)] - np.repeat(word[some] * m, count)
                if by_bit:
                    at = np.repeat(some, count)
                    found = sum(np.bitwise_count(mark[sets] & b[part][at]) for mark, b in zip(marks, after))
                    hit = np.flatnonzero(found >= least[part][at])
                    keys.append(of[at[hit]] * m + sets[hit])
                else:
                    keys.append(np.repeat(of[some] * m, count) + sets)
            pairs, shared = np.unique(keys[0], return_counts=True)
            more = np.sort(keys[1])
            more = more[np.diff(more, prepend=-1) > 0]
            if len(pairs):
                more = more[pairs[np.minimum(np.searchsorted(pairs, more), len(pairs) - 1)] != more]
            pairs = np.concatenate([pairs, more])
            shared = np.concatenate([shared, np.zeros(len(more), np.int64)])
            query, sets = pairs // m, pairs % m
            shared += sum(np.bitwise_count(mark[sets] & b[query]) for mark, b in zip(marks, all_bits))
            stays = np.flatnonzero(shared + n_others[query] >= need[query])
            query, sets, shared = query[stays], sets[stays], shared[stays]
            for step in range(int(n_others[query].max(initial=0))):
                open_ = np.flatnonzero(n_others[query] > step)
                wanted = others[others_begin[query[open_]] + step] * m + sets[open_]
                place = np.minimum(np.searchsorted(postings, wanted), len(postings) - 1)
                shared[open_] += postings[place] == wanted
                stays = shared + np.maximum(n_others[query] - 1 - step, 0) >= need[query]
                query, sets, shared = query[stays], sets[stays], shared[stays]
            order = np.argsort(query * m + sets)
            self._take(asked[query[order]], sets[order], shared[order], ids, rows)
            first = last

    def _take(self, query: np.ndarray, sets: np.ndarray, shared: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """New sets of queries, ascending by query and set, put among the best ones of these queries."""
        k = self.k
        touched, local = np.unique(query, return_inverse=True)
        owner = np.concatenate([np.repeat(np.arange(len(touched)), k), local])
        overlap = np.concatenate([self.overlap[touched].ravel(), shared])
        order = np.lexsort((-overlap, owner))  # stable: sets found earlier first
        own = owner[order]
        rank = np.arange(len(order)) - np.searchsorted(own, own)
        best = order[rank < k]
        old, new = best < len(touched) * k, np.maximum(best - len(touched) * k, 0)
        kept = np.where(old, best, 0)
        shape = (len(touched), k)

        def merged(known: np.ndarray, found: np.ndarray) -> np.ndarray:
            return np.where(old, known[touched].ravel()[kept], found[sets][new]).reshape(shape)

        if len(touched):
            self.sets[touched], self.rows[touched] = merged(self.sets, ids), merged(self.rows, rows)
            self.overlap[touched] = overlap = overlap[best].reshape(shape)
            enough = np.cumsum(self.rows[touched], axis=1) >= k
            by_rows = np.where(enough.any(axis=1), overlap[np.arange(len(touched)), enough.argmax(axis=1)], 1)
            self.need[touched] = np.maximum(overlap[:, -1] + 1, by_rows)

    def result(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.queries), SLICE):
            query, place = np.nonzero(self.overlap[at : at + SLICE])
            query += at
            keys = [pa.array(v, pa.binary()).cast(pa.string()) for v in (self.queries[query], self.sets[query, place])]
            overlap = pa.array(self.overlap[query, place].astype(np.int32))
            yield pa.RecordBatch.from_arrays([*keys, overlap], names=["_q", "_set", "overlap"])


def _best_sets(asked: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """``_q, _set, overlap``: the ``k`` sets that share most words with each query, then the smaller ``set_id``.

    Queries are dealt in groups; each group meets all sets, sorted by id, in blocks that grow.
    """
    n = asked.count()
    groups = max(1, min(n, asked.sparkSession.sparkContext.defaultParallelism), -(-n // GROUP))
    none = F.lit(None).cast(sets.schema["set_id"].dataType)
    rows = asked.select(
        F.pmod(F.xxhash64("_q"), F.lit(groups)).cast("int").alias("group"), F.lit(0).alias("kind"), none.alias("set_id"),
        F.col("_q").alias("id"), F.lit(0).cast("long").alias("n_rows"), "codes",
    ).unionByName(
        sets.select(
            F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("kind"), "set_id",
            F.col("_set").alias("id"), "n_rows", "codes",
        )
    )
    head, most = HEAD * k, SHARE_ROWS

    def columns(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks()
        codes = rows.column("codes")
        return (
            rows.column("id").to_numpy().astype("S32"),
            rows.column("n_rows").to_numpy(),
            np.concatenate([np.zeros(0, np.int64), *[c.flatten().to_numpy() for c in codes.chunks]]),
            np.concatenate([pc.list_value_length(c).to_numpy().astype(np.int64) for c in codes.chunks]),
        )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running: _Search | None = None
        now, held, size = (-1, 0), [], head

        def work() -> None:
            nonlocal running, held, size
            if held:
                ids, n_rows, codes, sizes = columns(held)
                if not now[1]:
                    running = _Search(ids, codes, sizes, k)
                elif running is not None:
                    running.block(ids, n_rows, codes, sizes)
                    size = min(size * 2, most)
            held = []

        for batch in batches:
            keys = batch.column("group").to_numpy().astype(np.int64) * 2 + batch.column("kind").to_numpy()
            at = 0
            while at < batch.num_rows:
                key = divmod(int(keys[at]), 2)
                if key != now:
                    work()
                    if key[0] != now[0]:
                        if running is not None:
                            yield from running.result()
                        running, size = None, head
                    now = key
                end = int(np.searchsorted(keys, keys[at], "right"))
                if key[1]:
                    end = min(end, at + max(size - sum(b.num_rows for b in held), 1))
                held.append(batch.slice(at, end - at).select(["id", "n_rows", "codes"]))
                at = end
                if key[1] and sum(b.num_rows for b in held) >= size:
                    work()
        work()
        if running is not None:
            yield from running.result()

    dealt = rows.repartition(groups, "group").sortWithinPartitions("group", "kind", "set_id", "id")
    return dealt.select("group", "kind", "id", "n_rows", "codes").mapInArrow(search, "_q string, _set string, overlap int")


def title_candidates(queries: DataFrame, catalogue: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` catalogue rows nearest to each ``query`` text: ``(*keys, cat_id, rank, overlap)``.

    Stands in for a remote search. A row is a hit when it shares a word with the query; more shared
    words rank first, then the smaller id. Equal word sets are searched once.

    Sets are searched in the order of their ids, in blocks that grow: what a query has found by then is a bound
    for all later sets, so that it reads the postings of fewer and rarer words the further it gets. Words
    are told apart by 64 bits. Rows without an id are no hits where no equal set has one.
    """
    asked = cut_lineage(_word_sets(queries, F.col("query"), *keys).withColumnRenamed("_set", "_q"))
    stored = _word_sets(catalogue, F.col("title"), "cat_id")
    by_set = W.partitionBy("_set").orderBy("cat_id")
    members = cut_lineage(stored.withColumn("_n", F.row_number().over(by_set)).where(F.col("_n") <= k).drop("_n"))
    sets = members.groupBy("_set").agg(
        F.min("cat_id").alias("set_id"), F.count(F.lit(1)).alias("n_rows"), F.first("codes").alias("codes")
    )
    sets = cut_lineage(sets.where("set_id is not null"))
    different = cut_lineage(asked.groupBy("_q").agg(F.first("codes").alias("codes")))
    hits = cut_lineage(_best_sets(different, sets, k))
    best_rows = W.partitionBy("_q").orderBy(F.desc("overlap"), "cat_id")
    top = (
        hits.join(members.select("_set", "cat_id"), "_set")
        .select("_q", "cat_id", "overlap", F.row_number().over(best_rows).alias("rank"))
        .where(F.col("rank") <= k)
    )
    return asked.select(*keys, "_q").join(top, "_q").drop("_q")


def best_per_ref(scored: DataFrame, keys: list[str], keep: list[str], score: str = "score", rank: str = "rank") -> DataFrame:
    """Row with the highest score per key; the first in rank order among equals."""
    others = F.struct(*keep, score)
    return (
        scored.groupBy(*keys)
        .agg(F.max_by(others, F.struct(score, -F.col(rank))).alias("best"))
        .select(*keys, "best.*")
    )


def _name_parts(name: Column) -> Column:
    return F.filter(F.split(name, r"\s+"), lambda p: F.length(p) > 1)


def _author_score(ref_authors: Column, names: Column) -> Column:
    """0.8 when the first cited author resembles a catalogue author, 0.7 on a reverse hit, else 0."""
    cited = F.lower(ref_authors)
    head = F.trim(F.get(F.split(cited, r"[,;]|et\s+al"), F.lit(0)))
    first = F.when(head == "", cited).otherwise(head)
    named = F.transform(
        names,
        lambda n: F.struct(
            n.alias("name"), F.get(F.split(n, " "), F.lit(0)).alias("given"), _name_parts(n).alias("parts")
        ),
    )

    def score(first: Column, parts: Column) -> Column:
        first_part = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))

        def resembles(n: Column) -> Column:
            # Equal and prefix parts are contained parts as well, so one containment test is enough.
            part_hit = F.exists(
                parts, lambda p: F.exists(n["parts"], lambda q: F.contains(q, p) | F.contains(p, q))
            )
            return part_hit | F.contains(first, n["given"]) | F.contains(n["name"], first_part)

        reverse = F.exists(
            named, lambda n: F.contains(cited, n["given"]) | F.array_contains(parts, n["given"])
        )
        return F.when(F.exists(named, resembles), F.lit(0.8)).when(reverse, F.lit(0.7)).otherwise(F.lit(0.0))

    return let(
        F.struct(first.alias("first"), _name_parts(first).alias("parts")), lambda f: score(f["first"], f["parts"])
    )


def best_match(refs: DataFrame, candidates: DataFrame, catalogue: DataFrame, keys: list[str]) -> DataFrame:
    """Best scored catalogue row per reference and the status it earns.

    Title above 0.6 gives 0.4 (above 0.3: 0.2), an equal year 0.3, a likely author 0.3. VALID
    needs more than 0.4, or more than 0.3 with a title above 0.6.
    """
    c = catalogue.select(
        "cat_id",
        F.col("title").alias("cat_title"),
        F.col("year").alias("cat_year"),
        F.transform("authors", lambda a: F.lower(F.trim(a))).alias("cat_authors"),
    )
    rows = candidates.join(refs.select(*keys, "title", "authors", "year"), keys).join(c, "cat_id")
    likeness = title_similarity(F.col("title"), F.col("cat_title"))
    scored = rows.withColumn("title_sim", likeness)
    title_points = F.when(F.col("title_sim") > 0.6, 0.4).when(F.col("title_sim") > 0.3, 0.2).otherwise(0.0)
    year_points = F.when(
        (F.col("year") == F.col("cat_year")) & (F.col("year") != 0), 0.3
    ).otherwise(0.0)
    named = ~blank(F.col("authors")) & (F.size("cat_authors") > 0)
    author_points = F.when(
        named & (_author_score(F.col("authors"), F.col("cat_authors")) > 0.6), 0.3
    ).otherwise(0.0)
    scored = scored.withColumn("score", title_points + year_points + author_points)
    best = best_per_ref(scored, keys, ["cat_id", "title_sim"])
    valid = (F.col("score") > 0.4) | ((F.col("score") > 0.3) & (F.col("title_sim") > 0.6))
    return best.withColumn("status", F.when(valid, "VALID").otherwise("MISSING"))


def best_title_match(refs: DataFrame, candidates: DataFrame, catalogue: DataFrame, keys: list[str]) -> DataFrame:
    """Best catalogue row by title alone: above 0.7 VALID, above 0.5 INVALID, else MISSING."""
    c = catalogue.select("cat_id", F.col("title").alias("cat_title"))
    rows = candidates.join(refs.select(*keys, "title"), keys).join(c, "cat_id")
    scored = rows.withColumn("score", title_similarity(F.col("title"), F.col("cat_title")))
    best = best_per_ref(scored, keys, ["cat_id"])
    status = F.when(F.col("score") > 0.7, "VALID").when(F.col("score") > 0.5, "INVALID").otherwise("MISSING")
    return best.withColumn("status", status)


def author_fallback(refs: DataFrame, catalogue: DataFrame, keys: list[str]) -> DataFrame:
    """For references without title hits: first catalogue row of the first cited author.

    The author's whole name must be among the catalogue's authors; a known year may be off by
    one. The status stays MISSING; the smallest id is the first result.
    """
    head = F.trim(F.get(F.split("authors", r"(?i)[,;]|et\s+al"), F.lit(0)))
    asked = refs.withColumn("first_author", F.lower(head)).where(F.length("first_author") > 3)
    # One row per (author, year): copies of a name never meet each other.
    index = (
        catalogue.select("cat_id", F.col("year").alias("cat_year"), F.explode("authors").alias("name"))
        .select("cat_year", F.lower(F.trim("name")).alias("first_author"), "cat_id")
        .groupBy("first_author", "cat_year")
        .agg(F.min("cat_id").alias("cat_id"))
    )
    wanted = asked.select("first_author", "year").distinct()
    near = (
        F.col("year").isNull()
        | F.col("cat_year").isNull()
        | (F.abs(F.col("year") - F.col("cat_year")) <= 1)
    )
    first = (
        wanted.join(index, "first_author")
        .where(near)
        .groupBy("first_author", "year")
        .agg(F.min("cat_id").alias("cat_id"))
    )
    found = asked.alias("a").join(
        first.alias("f"),
        (F.col("a.first_author") == F.col("f.first_author")) & F.col("a.year").eqNullSafe(F.col("f.year")),
    )
    result = found.select(*[F.col(f"a.{k}") for k in keys], F.col("a.title").alias("title"), F.col("f.cat_id"))
    titles = catalogue.select("cat_id", F.col("title").alias("cat_title"))
    return result.join(titles, "cat_id").select(
        *keys,
        "cat_id",
        title_similarity(F.col("title"), F.col("cat_title")).alias("title_sim"),
        F.lit("MISSING").alias("status"),
    )


def _any_alike(names: Column, others: Column, bound: float = 0.7) -> Column:
    return F.exists(
        names, lambda n: F.exists(others, lambda o: edit_similarity(n, o, lower=False) > bound)
    )


#: Titles up to this length are compared by the built-in edit distance.
LONG_TITLE = 400


def _alike(a: str, b: str, bound: float) -> bool:
    """Whether 1 - edit distance / longer length is above ``bound``: one column at a time as bits of a number."""
    longer = max(len(a), len(b))
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance, left = full, 0, len(a), len(b)
    for c in b:
        match = places.get(c, 0)
        flat = (((match & up) + up) ^ up | match) & full
        grown, shrunk = down | full ^ (flat | up), up & flat
        distance += bool(grown & last) - bool(shrunk & last)
        left -= 1
        if not 1 - max(distance - left, 0) / longer > bound:
            return False
        grown = (grown << 1 | 1) & full
        match |= down
        up, down = (shrunk << 1 | full ^ (match | grown)) & full, grown & match
    return 1 - distance / longer > bound


def _with_title_match(rows: DataFrame, bound: float) -> DataFrame:
    """``rows`` with ``title_match`` in place of ``norm`` and ``cat_norm``: whether these are alike beyond ``bound``.

    Equal titles and those whose lengths differ too much need no edit distance; where both are long, it is
    worked out on numbers of as many bits as the title has letters.
    """
    a, b = F.col("norm"), F.col("cat_norm")
    longer, shorter = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    too_far = ~(1 - (longer - shorter) / longer > bound)
    known = (
        F.when(a.isNull() | b.isNull() | (a == b), a == b)
        .when(too_far, False)
        .when(longer <= LONG_TITLE, edit_similarity(a, b, lower=False) > bound)
    )
    is_open = a.isNotNull() & b.isNotNull() & known.isNull()
    marked = rows.withColumn("title_match", known)
    marked = marked.withColumn("norm", F.when(is_open, a)).withColumn("cat_norm", F.when(is_open, b))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], bool] = {}
        for batch in batches:
            pairs = zip(batch.column("norm").to_pylist(), batch.column("cat_norm").to_pylist())
            found = batch.column("title_match").to_pylist()
            for i, pair in enumerate(pairs):
                if pair[0] is not None and pair[1] is not None:
                    if pair not in seen:
                        seen[pair] = _alike(*pair, bound)
                    found[i] = seen[pair]
            seen.clear()
            place = batch.schema.get_field_index("title_match")
            yield batch.set_column(place, "title_match", pa.array(found, pa.bool_())).drop_columns(["norm", "cat_norm"])

    out = marked.drop("norm", "cat_norm")
    return marked.mapInArrow(compare, out.schema)


def catalogue_match(papers: DataFrame, candidates: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Best catalogue row per paper with match flags and notes.

    Reads papers ``paper_id, title, year, authors`` and scores title, year and author agreement
    with penalties for disagreement; a match needs more than 0.5.
    """
    c = catalogue.select(
        "cat_id",
        F.col("title").alias("cat_title"),
        F.col("year").alias("cat_year"),
        F.transform("authors", normalize_string).alias("cat_names"),
        normalize_string(F.col("title")).alias("cat_norm"),
    )
    p = papers.select(
        "paper_id",
        "title",
        F.nullif("year", F.lit(0)).alias("year"),
        F.filter(F.transform("authors", normalize_string), lambda n: n != "").alias("names"),
        F.size("authors").alias("n_authors"),
        normalize_string(F.col("title")).alias("norm"),
    )
    rows = _with_title_match(candidates.join(p, "paper_id").join(c, "cat_id"), 0.8)
    both_named = (F.col("n_authors") > 0) & (F.size("cat_names") > 0)
    rows = rows.withColumn("author_match", both_named & _any_alike(F.col("names"), F.col("cat_names")))
    one_year = F.col("year").isNotNull() | F.col("cat_year").isNotNull()
    year_points = (
        F.when(F.col("year") == F.col("cat_year"), 0.3)
        .when(F.col("year") != F.col("cat_year"), -0.2)
        .when(one_year, -0.05)
        .otherwise(0.0)
    )
    author_points = (
        F.when(~both_named, 0.0).when(F.col("author_match"), 0.3).otherwise(-0.15)
    )
    raw = F.when(F.col("title_match"), 0.4).otherwise(0.0) + year_points + author_points
    scored = rows.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    scored = scored.withColumn("n_cat", F.size("cat_names"))
    kept = ["cat_id", "title", "cat_title", "year", "cat_year", "title_match", "author_match", "n_authors", "n_cat", "score"]
    best = (
        scored.groupBy("paper_id")
        .agg(
            F.max_by(F.struct(*kept), F.struct("score", -F.col("rank"))).alias("best"),
            F.count_if((F.col("n_authors") > 0) & (F.col("n_cat") == 0)).cast("int").alias("n_unnamed"),
        )
        .select("paper_id", "n_unnamed", "best.*")
    )
    found = F.col("score") > 0.5
    matched = best.select(
        "paper_id",
        F.when(found, F.col("cat_id")).alias("cat_id"),
        found.alias("found"),
        F.when(found, F.col("score")).otherwise(0.0).alias("match_score"),
        (found & F.col("title_match")).alias("title_match"),
        (found & F.coalesce(F.col("year") == F.col("cat_year"), F.lit(False))).alias("year_match"),
        (found & F.col("author_match")).alias("author_match"),
        *match_notes(found),
    )
    searched = papers.select("paper_id").join(matched, "paper_id", "left")
    nothing = F.array(F.lit("No matching papers found in OpenAlex"))
    return searched.select(
        "paper_id",
        "cat_id",
        *[F.coalesce(f, F.lit(False)).alias(f) for f in ("found", "title_match", "year_match", "author_match")],
        F.coalesce("match_score", F.lit(0.0)).alias("match_score"),
        F.coalesce("differences", F.array().cast("array<string>")).alias("differences"),
        F.coalesce("match_warnings", nothing).alias("match_warnings"),
    )


def match_notes(found: Column) -> list[Column]:
    """``differences`` and ``match_warnings`` of a best match row of :func:`catalogue_match`."""
    c = F.col
    year_text = F.when(
        c("year").isNotNull() & c("cat_year").isNull(),
        F.concat(F.lit("Year mismatch: PDF has "), c("year"), F.lit(", OpenAlex has unknown")),
    )
    author_text = F.when(
        (c("n_authors") > 0) & (c("n_cat") > 0) & ~c("author_match"),
        F.lit("Author mismatch: PDF authors don't match OpenAlex authors"),
    )
    title_text = F.when(
        ~c("title_match"),
        F.concat(F.lit('Title mismatch: "'), c("title"), F.lit('" vs "'), c("cat_title"), F.lit('"')),
    )
    unnamed = (c("n_authors") > 0) & (c("n_cat") == 0)
    empty = F.array().cast("array<string>")
    low = F.format_string("Best match score (%.2f) is below threshold (0.5)", c("score"))
    differences = F.when(found, F.array_compact(F.array(year_text, author_text, title_text))).otherwise(empty)
    warnings = F.concat(
        F.array_repeat(F.lit("OpenAlex paper has no author information"), c("n_unnamed")),
        F.array_compact(
            F.array(
                F.when(unnamed & found, F.lit("Could not compare authors - OpenAlex has no author information")),
                F.when(~found, low),
            )
        ),
    )
    return [differences.alias("differences"), warnings.alias("match_warnings")]

