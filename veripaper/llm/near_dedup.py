"""Near-duplicates by a chosen-path set similarity join over minwise tokens.

Each text is a set of word shingles with a signature of minwise tokens. A tree starts with all sets in
one node; a node picks a few coordinates of the signature at random, and every set goes to one child for
each picked coordinate, named by its token there. With on average ``1 / threshold`` picks two similar
sets are expected to meet in at least one child. Nodes small enough are compared exhaustively, larger
ones branch again; independent trees repeat this until the recall is reached.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .repeats import PACKED, cells_for, merged_cells, packed_batch, span_hashes
from .shared import BASES, U64, cut, mix, run_hashes, small_batches, word_hashes, word_spans, written

#: Words of a shingle, and the similarity (in hundredths) from which texts are linked.
SHINGLE, PERCENT = 5, 75
#: A pair at the threshold is missed by one tree with probability 1/e, by all with e**-TREES.
TREES = 10
#: Minwise tokens of a signature.
TOKENS = 128
#: Sets of a node that is compared exhaustively, and how often larger nodes branch.
SMALL_NODE, LEVELS = 1000, 3
#: Estimates from which a pair is surely worth confirming, and below which it is not (three standard
#: deviations of the estimate below the threshold).
SURE, LEAST = 0.8, 0.63
#: Sets of a node too large to branch further that meet all others of the node.
HUBS = 8


def shingle_sets(data: np.ndarray, starts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted in each text, and where each text's set begins."""
    lower = data + np.uint8(32) * ((data >= 65) & (data <= 90)).astype(np.uint8)
    begin, end, first = word_spans(lower, starts)
    words = word_hashes(lower, begin, end, BASES[0])
    count = np.diff(first)
    n_runs = np.maximum(0, count - size + 1)
    text = np.repeat(np.arange(len(count)), n_runs)
    at = np.arange(n_runs.sum()) + np.repeat(first[:-1] - (np.cumsum(n_runs) - n_runs), n_runs)
    runs = run_hashes(words, size, BASES[2])[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        runs = np.append(runs, span_hashes(words, first[short], first[short + 1], BASES[3]))
        text = np.append(text, short)
    order = np.lexsort((runs, text))
    runs, text = runs[order], text[order]
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (runs[1:] != runs[:-1]) | (text[1:] != text[:-1])
    return runs[new], np.searchsorted(text[new], np.arange(len(count) + 1))


def set_keys(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One key for each set, equal for equal sets; 0 for the empty set."""
    sizes = np.diff(first)
    keys = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        keys[full] = mix(np.add.reduceat(mix(shingles ^ U64(BASES[1])), first[full]) + sizes[full].astype(np.uint64))
    return keys


def signatures(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``TOKENS`` minwise tokens for each non-empty set, 32 bits each; their lower halves tell tokens apart."""
    full = first[:-1][np.diff(first) > 0]
    out = np.zeros((len(full), TOKENS), np.uint32)
    factors = mix(np.arange(1, TOKENS + 1, dtype=np.uint64)) | U64(1)
    for i, factor in enumerate(factors) if len(full) else ():
        out[:, i] = np.minimum.reduceat(shingles * factor, full) >> U64(32)
    return out


def _set_rows(docs: DataFrame) -> DataFrame:
    """``doc, key, n`` and the signature's halves of every document; without shingles ``n`` is 0 and they are null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in small_batches(batches, "text"):
            shingles, first = shingle_sets(data, starts)
            sizes = np.diff(first)
            rows = signatures(shingles, first)
            full = np.cumsum(sizes > 0) - 1
            upper, lower = (
                pa.array([half[i].tobytes() if n else None for i, n in zip(full, sizes)], pa.binary())
                for half in ((rows >> np.uint32(16)).astype(np.uint16), rows.astype(np.uint16))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(set_keys(shingles, first).view(np.int64)), pa.array(sizes, pa.int64()), upper, lower],
                names=["doc", "key", "n", "upper", "lower"],
            )

    return docs.mapInArrow(work, "doc long, key long, n long, upper binary, lower binary")


def _tokens(halves: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(halves), np.uint16).reshape(-1, TOKENS)


def _children(rows: DataFrame) -> DataFrame:
    """``node, key`` one level below ``rows (node, key, upper, lower)``: one row for each picked coordinate."""
    odds = U64(int((1 << 64) / (PERCENT / 100 * TOKENS)))
    coordinates = np.arange(TOKENS, dtype=np.uint64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picks: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = batch.column("node").to_numpy().view(np.uint64)
            keys = batch.column("key").to_numpy()
            upper, lower = (_tokens(batch.column(half).to_pylist()).astype(np.uint64) for half in ("upper", "lower"))
            tokens = (upper << U64(16)) | lower
            out_nodes, out_keys = [], []
            for node in np.unique(nodes):
                if node not in picks:
                    if len(picks) > 10_000:
                        picks.clear()
                    drawn = mix(mix(coordinates + U64(1)) ^ node)
                    picks[node] = np.flatnonzero(drawn < odds)
                own = np.flatnonzero(nodes == node)
                for i in picks[node]:
                    out_nodes.append(mix(mix(tokens[own, i] + node) ^ U64(i + 1)))
                    out_keys.append(keys[own])
            if out_nodes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_nodes).view(np.int64)), pa.array(np.concatenate(out_keys))],
                    names=["node", "key"],
                )

    return rows.select("node", "key", "upper", "lower").mapInArrow(work, "node long, key long")


def _leaves(sets: DataFrame, trees: int) -> DataFrame:
    """``node, chunk, hub, key``: sets that meet in a last node, nodes of equal members only once.

    A node that is still large at the last level is dealt into chunks of about ``SMALL_NODE``; its hubs
    are in every chunk.
    """
    roots = [int(mix(np.array([t + 1], np.uint64)).view(np.int64)[0]) for t in range(trees)]
    level = sets.select(F.explode(F.array(*[F.lit(r) for r in roots])).alias("node"), "key", "upper", "lower")
    leaves: DataFrame | None = None
    for depth in range(LEVELS + 1):
        rows = written(_children(level))
        nodes = rows.groupBy("node").agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")
        ).where("n > 1")
        nodes = written(nodes.groupBy("n", "x", "y").agg(F.min("node").alias("node")).select("node", "n"))
        large = nodes.where(F.col("n") > SMALL_NODE)
        last = depth == LEVELS or large.isEmpty()
        done = rows.join(nodes if last else nodes.where(F.col("n") <= SMALL_NODE), "node")
        leaves = done if leaves is None else leaves.unionByName(done)
        if last:
            break
        level = rows.join(large.select("node"), "node").join(sets, "key").select("node", "key", "upper", "lower")
    leaves = written(leaves)
    chunks = F.ceil(F.col("n") / SMALL_NODE).cast("int")
    small = leaves.where(F.col("n") <= SMALL_NODE).select("node", F.lit(0).alias("chunk"), F.lit(False).alias("hub"), "key")
    big = leaves.where(F.col("n") > SMALL_NODE).withColumn("chunks", chunks).withColumn("order", F.xxhash64("key", "node"))
    ranked = big.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("order", "key")))
    hubs = ranked.where(F.col("rank") <= HUBS).select(
        "node", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("hub"), "key"
    )
    dealt = big.select("node", F.pmod("order", "chunks").cast("int").alias("chunk"), F.lit(False).alias("hub"), "key")
    return small.unionByName(dealt).unionByName(hubs)


def _similarities(tokens: np.ndarray) -> np.ndarray:
    """Estimated similarity of all pairs of a node, in tokens that agree."""
    out = np.empty((len(tokens), len(tokens)), np.int16)
    for i in range(0, len(tokens), 32):
        out[i : i + 32] = (tokens[i : i + 32, None, :] == tokens[None, :, :]).sum(axis=2)
    return out


def strongest_links(alike: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges of a maximum spanning forest among pairs with at least ``least`` tokens in common."""
    n = len(alike)
    best, via = np.full(n, -1, np.int16), np.zeros(n, np.int64)
    free, edges = np.ones(n, dtype=bool), []
    for _ in range(n):
        at = int(np.argmax(np.where(free, best, -2)))
        if best[at] >= least:
            edges.append((int(via[at]), at))
        free[at] = False
        better = free & (alike[at] > best)
        best[better], via[better] = alike[at][better], at
    return edges


def _by_node(rows: DataFrame, column: str, work: Callable[[np.ndarray, np.ndarray, list[bytes]], list[np.ndarray]], names: list[str]) -> DataFrame:
    """``work(keys, components, values of column)`` on the distinct sets of every node and chunk, one in memory at a time."""

    def one(part: pa.Table) -> pa.RecordBatch:
        keys, own = np.unique(part.column("key").to_numpy(), return_index=True)
        values = part.column(column).take(pa.array(own)).to_pylist()
        found = work(keys, part.column("component").to_numpy()[own], values)
        place = [pa.array(np.full(len(found[0]), part.column(c)[0].as_py()), part.schema.field(c).type) for c in ("node", "chunk")]
        return pa.RecordBatch.from_arrays([*place, *map(pa.array, found)], names=["node", "chunk", *names])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            node, chunk = rows.column("node").to_numpy(), rows.column("chunk").to_numpy()
            edges = np.flatnonzero((np.diff(node) != 0) | (np.diff(chunk) != 0)) + 1
            for a, b in zip([0, *edges[:-1]], edges):
                if b > a + 1:
                    yield one(rows.slice(int(a), int(b - a)))
            held = rows.slice(int(edges[-1]) if len(edges) else 0)
        if held is not None and held.num_rows > 1:
            yield one(held)

    placed = rows.select("node", "chunk", "key", "component", column).repartition("node", "chunk")
    schema = "node long, chunk int, " + ", ".join(f"{n} long" for n in names)
    return placed.sortWithinPartitions("node", "chunk").mapInArrow(nodes, schema)


def _strong_pairs(rows: DataFrame) -> DataFrame:
    """Pairs ``a, b``: in every node the strongest estimated links that hold it together."""

    def work(keys: np.ndarray, parts: np.ndarray, tokens: list[bytes]) -> list[np.ndarray]:
        alike = _similarities(_tokens(tokens))
        edges = np.array(strongest_links(alike, SURE * TOKENS), np.int64).reshape(-1, 2)
        a, b = keys[edges[:, 0]], keys[edges[:, 1]]
        return [np.minimum(a, b), np.maximum(a, b)]

    return _by_node(rows, "lower", work, ["a", "b"]).select("a", "b").distinct()


def _open_members(rows: DataFrame) -> DataFrame:
    """``node, chunk, key, component``: sets that may reach the threshold with one of another component."""

    def work(keys: np.ndarray, parts: np.ndarray, tokens: list[bytes]) -> list[np.ndarray]:
        alike = _similarities(_tokens(tokens))
        kept = ((alike >= LEAST * TOKENS) & (parts[:, None] != parts[None, :])).any(axis=1)
        return [keys[kept], parts[kept]]

    return _by_node(rows, "lower", work, ["key", "component"])


def common_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of every two sets, by products of incidence matrices."""
    names, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    own = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = counts > 1
    column = np.cumsum(shared) - 1
    own, at = own[shared[at]], column[at[shared[at]]]
    order = np.argsort(at, kind="stable")
    own, at = own[order], at[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for begin in range(0, int(shared.sum()), 1024):
        a, b = np.searchsorted(at, [begin, begin + 1024])
        part = np.zeros((len(sets), 1024), np.float32)
        part[own[a:b], at[a:b] - begin] = 1
        total += part @ part.T
    total[np.diag_indices(len(sets))] = [len(x) for x in sets]
    return total


def local_links(keys: np.ndarray, parts: np.ndarray, sets: list[np.ndarray]) -> list[np.ndarray]:
    """Links ``a, b`` of a node's sets, as few as join all components that the threshold joins."""
    common = common_shingles(sets)
    size = np.array([len(x) for x in sets])
    a, b = [], []
    free = np.ones(len(sets), dtype=bool)
    for head in range(len(sets)):
        reached = [head] if free[head] else []
        free[head] = False
        while reached:
            at = reached.pop()
            both = common[at].astype(np.int64)
            found = np.flatnonzero(free & (100 * both >= PERCENT * (size[at] + size - both)))
            free[found] = False
            reached += found.tolist()
            other = found[parts[found] != parts[at]]
            a += [keys[at]] * len(other)
            b += keys[other].tolist()
    return [np.array(a, np.int64), np.array(b, np.int64)]


def _exact_links(rows: DataFrame) -> DataFrame:
    """Confirmed links between unlike components of every node, from full sets."""

    def work(keys: np.ndarray, parts: np.ndarray, sets: list[bytes]) -> list[np.ndarray]:
        return local_links(keys, parts, [unpacked_set(x) for x in sets])

    return _by_node(rows, "shingles", work, ["a", "b"]).select("a", "b").distinct()


def packed_set(shingles: np.ndarray) -> bytes:
    """The upper 40 bits of sorted shingle hashes, byte planes apart; the upper plane is sorted and compresses to little.

    Unlike shingles of a pair of texts with 1000 of them agree in these bits with probability 10**-6.
    """
    short = shingles >> U64(24)
    return (short >> U64(32)).astype(np.uint8).tobytes() + short.astype(np.uint32).tobytes()


def unpacked_set(value: bytes) -> np.ndarray:
    n = len(value) // 5
    upper, lower = np.frombuffer(value, np.uint8, n), np.frombuffer(value, np.uint32, n, n)
    return (upper.astype(np.uint64) << U64(32)) | lower


def _owner_key(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mix(doc.view(np.uint64) * U64(BASES[0]) ^ key.view(np.uint64))


def _full_sets(keys: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """``key, shingles`` (packed) of the wanted sets, read again from their owners' texts.

    Which these are comes to the tasks as bits of bounded size; what slips through them is dropped by
    the joins with this table.
    """
    spark = keys.sparkSession
    needed = cut(keys.distinct().join(sets.select("key", "owner"), "key"))
    cells = cells_for(needed.count())

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield packed_batch(_owner_key(batch.column("owner").to_numpy(), batch.column("key").to_numpy()), cells)

    wanted = spark.sparkContext.broadcast(
        merged_cells(needed.select("owner", "key").mapInArrow(sketch, PACKED), cells, 1)
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts in small_batches(batches, "text"):
            shingles, first = shingle_sets(data, starts)
            keys = set_keys(shingles, first)
            doc = batch.column("doc").to_numpy(zero_copy_only=False)
            kept = np.flatnonzero(wanted.value.hold(_owner_key(doc, keys.view(np.int64))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[kept].view(np.int64)), pa.array([packed_set(shingles[first[i] : first[i + 1]]) for i in kept], pa.binary())],
                names=["key", "shingles"],
            )

    return written(docs.mapInArrow(read, "key long, shingles binary").dropDuplicates(["key"]))


def _confirmed(pairs: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""
    full = _full_sets(pairs.select(F.explode(F.array("a", "b")).alias("key")), docs, sets)
    one = full.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
    two = full.select(F.col("key").alias("b"), F.col("shingles").alias("y"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = unpacked_set(x.as_py()), unpacked_set(y.as_py())
                common = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text's set has its distinct runs of five words
    (of fewer words the whole sequence). Sets with a similarity of 0.75 or more are linked, confirmed on
    the full sets; ``component_id`` is the smallest identifier that links lead to, and the row that bears
    it is kept. Equal sets are one vertex, so copies are never paired. Null and empty texts have no
    shingles and are linked with nothing; a row without identifier is linked with nothing, has no
    component and is kept; rows that repeat an identifier get the same answer each. Other columns are
    ignored. An empty table gives no rows; a very long text is read whole, as one batch.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    rows = written(_set_rows(slim))
    linked = rows.where("doc is not null and n > 0")
    slim = slim.where("doc is not null")
    sets = written(linked.groupBy("key").agg(F.min("doc").alias("owner"), F.first("upper").alias("upper"), F.first("lower").alias("lower")))
    leaves = written(_leaves(sets, trees))
    signed = sets.select("key", "lower")
    first = leaves.join(signed, "key").withColumn("component", F.col("key"))
    links = cut(_confirmed(cut(_strong_pairs(first)), slim, sets))
    parts = cut(components(links))

    placed = leaves.join(parts.withColumnRenamed("vertex", "key"), "key", "left").withColumn(
        "component", F.coalesce("component", "key")
    )
    # Of a node in chunks, the sets outside its main component meet all others, block by block.
    outside = F.col("component") != F.col("main")
    nodes = placed.groupBy("node").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), (F.max("chunk") + 1).alias("chunks"),
        F.max(F.when(F.col("hub"), F.col("component"))).alias("main"),
    ).where("low < high").select("node", "chunks", "main")
    open_rows = written(placed.where("not hub").join(nodes, "node").select("node", "chunk", "chunks", "main", "key", "component"))
    blocks = open_rows.where("chunks > 1").groupBy("node").agg(
        F.greatest(F.lit(1), F.ceil(F.count_if(outside) / SMALL_NODE)).cast("int").alias("blocks")
    )
    dealt = open_rows.where("chunks > 1").join(blocks, "node")

    def spread(rows: DataFrame, chunk: Column) -> DataFrame:
        return rows.select("node", chunk.alias("chunk"), "key", "component")

    each_block = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each_chunk = dealt.where(outside).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    own_block = F.pmod(F.xxhash64("key", F.lit(2)), F.col("blocks")).cast("int")
    second = (
        open_rows.where("chunks = 1").select("node", "chunk", "key", "component")
        .unionByName(spread(each_block, F.col("block") * F.col("chunks") + F.col("chunk")))
        .unionByName(spread(each_chunk, own_block * F.col("chunks") + F.col("other")))
        .join(signed, "key")
    )
    members = written(_open_members(second))
    if not members.isEmpty():
        full = _full_sets(members.select("key"), slim, sets)
        links = cut(links.unionByName(_exact_links(members.join(full, "key"))))
        parts = cut(components(links))

    vertex = linked.select("doc", "key").join(parts.withColumnRenamed("vertex", "key"), "key", "left").withColumn(
        "component", F.coalesce("component", "key")
    )
    smallest = vertex.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = sets.select("key").join(parts.withColumnRenamed("vertex", "key"), "key", "left").select(
        "key", F.coalesce("component", "key").alias("component")
    ).join(smallest, "component").select("key", "component_id")
    out = rows.select("doc", "n", F.when(F.col("doc").isNotNull() & (F.col("n") > 0), F.col("key")).alias("key"))
    return out.join(named, "key", "left").select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "doc") == F.col("doc"), F.lit(True)).alias("kept"),
    )
