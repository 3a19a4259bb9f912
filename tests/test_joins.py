"""Exact joins against all pairs, on made-up rows with skew."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veripaper.functions import text as X
from veripaper.operators import diagrams as D
from veripaper.operators import duplicates as U
from veripaper.operators import matching as M
from veripaper.operators.diagrams import _digit_patterns, bit_bands


def near_hashes(rng, n, digits):
    base = ["%0*x" % (digits, rng.getrandbits(digits * 4)) for _ in range(4)]
    out = []
    for _ in range(n):
        h = list(rng.choice(base))
        for at in rng.sample(range(digits), rng.randint(0, digits // 2)):
            h[at] = rng.choice("0123456789abcdef")
        out.append("".join(h))
    return out + [base[0]] * n  # a third and more are copies


def unequal(a, b):
    return sum(x != y for x, y in zip(a, b))


def test_digit_join(spark):
    hashes = near_hashes(random.Random(1), 120, 16)
    df = spark.createDataFrame([(i, i % 7, h) for i, h in enumerate(hashes)], "diagram_id long, paper_id long, hash string")
    distinct = sorted(set(hashes))
    for differing in (5, 9):
        want = {(a, b): unequal(a, b) for a in distinct for b in distinct if a < b and unequal(a, b) <= differing}
        got = {(r["hash"], r.other): r.distance for r in D.hashes_within(df, differing).collect()}
        assert got == want
    best = {}
    for i, a in enumerate(hashes):
        for j, b in enumerate(hashes):
            if i % 7 != j % 7 and 1 - unequal(a, b) / 64 > 0.85:
                best[i] = j
                break
    assert {r.diagram_id: r.matched_diagram_id for r in D.suspicious_diagrams(df).collect()} == best


def test_bit_join(spark):
    rng = random.Random(2)
    for digits, minimum in ((16, 0.8), (64, 0.8), (64, 0.9)):
        base = rng.getrandbits(digits * 4)
        hashes = set()
        for _ in range(60):
            h = base
            for at in rng.sample(range(digits * 4), rng.randint(0, digits * 4 // 4)):
                h ^= 1 << at
            hashes.add("%0*x" % (digits, h))
        df = spark.createDataFrame([(h,) for h in hashes], "hash string")
        got = {(r["hash"], r.other): round(r.similarity, 9) for r in D.similar_hash_pairs(df, df, minimum, digits).collect()}
        bits = digits * 4
        want = {}
        for a in hashes:
            for b in hashes:
                s = 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / bits
                if s >= minimum:
                    want[(a, b)] = round(s, 9)
        assert got == want


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 12), st.data())
def test_patterns_are_complete(differing, data):
    wrong = set(data.draw(st.lists(st.integers(0, 15), max_size=differing, unique=True)))
    assert any(not wrong & set(kept) for kept in _digit_patterns(16, differing))


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 51), st.sampled_from([10, 10**4, 10**8, 10**12]), st.data())
def test_bands_are_complete(differing, stored, data):
    wrong = data.draw(st.lists(st.integers(0, 255), max_size=differing, unique=True))
    bands = bit_bands(256, differing, stored)
    assert any(sum(a <= w < b for w in wrong) <= bands.turned for a, b in bands.bounds)
    assert bands.bounds[0][0] == 0 and bands.bounds[-1][1] == 256 and max(b - a for a, b in bands.bounds) <= 32


def grams(text):
    import re

    out = set()
    for word in re.findall(r"[^\W_]+", text.lower()):
        padded = f"  {word} "
        out |= {padded[i:i + 3] for i in range(len(padded) - 2)}
    return out


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def titles(n):
    rng = random.Random(5)
    words = ["deep", "graph", "models", "of", "learning", "sparse", "the", "data", "streams", "join"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 6))) for _ in range(n)]
    return made + ["a hot title of many copies"] * n + ["", "?!"]


def test_title_join(spark):
    made = titles(80)
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(made)], "paper_id long, title string, created_at timestamp_ntz")
    sets = [grams(t) for t in made]
    want = {}
    for i, a in enumerate(sets):
        options = [(-likeness(a, b), j) for j, b in enumerate(sets[:i]) if a and likeness(a, b) > 0.7]
        if options:
            want[i] = (min(options)[1], round(-min(options)[0], 9))
    got = {r.paper_id: (r.similar_paper_id, round(r.similarity, 9)) for r in U.duplicate_titles_within(df).collect()}
    assert got == want


def test_import(spark):
    made = titles(40)
    rng = random.Random(9)
    dois = [rng.choice([None, None, f"d{rng.randint(0, 20)}"]) for _ in made]
    rows = list(zip(range(len(made)), made, dois))
    incoming = spark.createDataFrame(rows, "paper_id long, title string, doi string")
    stored = spark.createDataFrame([(1000, made[0], None), (1001, "nothing alike whatsoever", "d3")], "paper_id long, title string, doi string")
    kept, want = [(1000, grams(made[0]), None), (1001, grams("nothing alike whatsoever"), "d3")], {}
    for i, title, doi in rows:
        g = grams(title)
        hit = any((doi and doi == d) or (g and likeness(g, o) > 0.8) for _, o, d in kept)
        want[i] = not hit
        if not hit:
            kept.append((i, g, doi))
    result = {r.paper_id: r for r in U.import_papers(stored, incoming).collect()}
    assert {i: r.imported for i, r in result.items()} == want
    assert all((r.similar_paper_id is None) == r.imported for r in result.values())


def test_greedy_dedup(spark):
    rng = random.Random(4)
    nodes = range(60)
    edges = {(a, b) for a in nodes for b in range(a) if rng.random() < 0.06}
    kept = []
    for n in nodes:
        if not any((n, k) in edges for k in kept):
            kept.append(n)
    df = spark.createDataFrame([(n,) for n in nodes], "paper_id long")
    links = spark.createDataFrame(list(edges), "paper_id long, earlier_id long")
    got = sorted(r.paper_id for r in U.greedy_dedup(df, links).collect() if r.kept)
    assert got == kept


def test_title_candidates(spark, monkeypatch):
    rng = random.Random(3)
    # "the" is in most titles, few queries share half of their words with k of them.
    word = lambda: "the" if rng.random() < 0.3 else f"w{int(rng.random() ** 2 * 60)}"
    titles = [" ".join(word() for _ in range(rng.randint(1, 6))) for _ in range(150)]
    titles += ["the w0"] * 7 + ["deep nets"]
    asked = [" ".join(word() for _ in range(rng.randint(1, 20))) for _ in range(60)]
    asked += ["smith jones journal volume twelve pages deep nets", "the", "unheard words"]
    queries = spark.createDataFrame(list(enumerate(asked)), "q long, query string")
    catalogue = spark.createDataFrame(list(enumerate(titles)), "cat_id long, title string")
    # Small heads and shares make every word but the rarest a frequent one.
    for head, share in ((8, 4096), (1, 3)):
        monkeypatch.setattr(M, "HEAD", head)
        monkeypatch.setattr(M, "SHARE_ROWS", share)
        want = {}
        for q, text in enumerate(asked):
            words = set(text.split())
            found = [(-len(words & set(t.split())), i) for i, t in enumerate(titles)]
            for rank, (n, i) in enumerate(sorted(f for f in found if f[0])[:5], 1):
                want[q, rank] = (i, -n)
        got = {(r.q, r["rank"]): (r.cat_id, r.overlap) for r in M.title_candidates(queries, catalogue, ["q"], 5).collect()}
        assert got == want


def test_title_search_reads_less_the_further_it_gets():
    """Every word is frequent; the sets of the last block are searched by the words that the bound leaves."""
    rng = np.random.default_rng(4)
    sets = [np.unique((rng.random(9) ** 3 * 40).astype(np.int64)) for _ in range(4000)]
    asked = [s for s in sets[-200:]]
    put = lambda some: (np.concatenate(some), np.array([len(s) for s in some]))
    search = M._Search(np.arange(200).astype("S32"), *put(asked), 5)
    for a, b in ((0, 100), (100, 1000), (1000, 4000)):
        codes, sizes = put(sets[a:b])
        search.block(np.arange(a, b).astype("S32"), np.ones(b - a, np.int64), codes, sizes)
    for i, q in enumerate(asked):
        best = sorted((-len(np.intersect1d(q, s)), j) for j, s in enumerate(sets))[:5]
        assert [(-int(n), int(s)) for n, s in zip(search.overlap[i], search.sets[i])] == best
    assert (search.need > 5).mean() > 0.5


def test_titles_alike(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abc é") for _ in range(n))
    pairs = [("", ""), ("a", ""), (None, "a"), ("a", None), ("abcde", "abcdx")]
    for _ in range(300):
        a = list(text(rng.randint(1, 30)))
        b = [c if rng.random() > 0.2 else rng.choice(["", "x", c + "y"]) for c in a]
        pairs.append(("".join(a), "".join(b)))
    # Built-in distances of these took minutes.
    long = text(60_000)
    rows = spark.createDataFrame([(*p, i) for i, p in enumerate([*pairs, (long, text(58_000)), (long, long[50:] + "x" * 70)])], "norm string, cat_norm string, i int")
    for most in (10_000, 0):
        monkeypatch.setattr(M, "LONG_TITLE", most)
        some = rows if not most else rows.where(F.col("i") < len(pairs))
        got = {r.i: r.title_match for r in M._with_title_match(some, 0.8).collect()}
        want = {r.i: r.s for r in rows.where(F.col("i") < len(pairs)).select("i", (X.edit_similarity(F.col("norm"), F.col("cat_norm"), lower=False) > 0.8).alias("s")).collect()}
        if not most:
            want |= {len(pairs): False, len(pairs) + 1: True}
        assert got == want
