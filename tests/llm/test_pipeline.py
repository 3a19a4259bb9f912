"""The pipeline against a plain version of each stage on the smallest table."""

import re
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as C

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def near_groups(texts):
    sets = {}
    for doc, text in texts.items():
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}
    best = {d: d for d in sets}

    def root(d):
        return d if best[d] == d else root(best[d])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                best[y] = x
    return {d for d in sets if root(d) == d}


def test_against_plain_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    texts = {d: t for d, t in texts.items() if any(c.isalpha() for c in t)}
    groups = defaultdict(list)
    for d, t in texts.items():
        groups["".join(WORD.findall(t))].append(d)
    stay = {min(ds, key=lambda d: (-len(texts[d]), d)) for ds in groups.values()}
    texts = {d: t for d, t in texts.items() if d in stay}
    stay = near_groups(texts)
    texts = {d: t for d, t in texts.items() if d in stay}
    seen, final = set(), {}
    for d in sorted(texts):
        w = WORD.findall(texts[d])
        windows = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        gone = {i + k for i, x in enumerate(windows) if x in seen for k in range(50)}
        seen.update(windows)
        if not gone:
            final[d] = texts[d]
        elif len(gone) < len(w):
            final[d] = " ".join(x for i, x in enumerate(w) if i not in gone)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in final.items()}
    rows = C.run(spark, folder).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in rows} == expected
    assert sum(r["length"] for r in rows) == sum(expected.values())


def test_stages_keep_columns_and_odd_rows(spark, folder):
    rows = [(1, "a b c", "en", "s", 5, "x"), (2, None, None, None, None, None), (None, "d e", "en", "s", 3, "y"), (3, "", "en", "s", 0, "z"),
            (1, "a b c", "en", "s", 5, "x"), (4, "word " * 30000, "en", "s", 150000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert out.count() > 0 and stage(spark, docs.where("false"), folder).count() == 0
    assert C.STAGES[-1][1](spark, docs, folder).count() > 0
