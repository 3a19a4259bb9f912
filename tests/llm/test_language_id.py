import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veripaper.llm import language_id as L


def phrases_by_hand(text: str, sample: str) -> int:
    """Phrases of one text, segment by segment; a letter that the sample lacks is a phrase of its own."""
    total = 0
    for begin in range(0, len(text), L.SEGMENT):
        segment, at = text[begin : begin + L.SEGMENT], 0
        while at < len(segment):
            size = 1
            while at + size < len(segment) and segment[at : at + size + 1] in sample:
                size += 1
            total, at = total + 1, at + size
    return total


@pytest.mark.parametrize("seed", range(4))
def test_phrases(seed):
    rng = random.Random(seed)
    draw = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    sample = draw(300, "abc ")
    texts = ["", "a", *(draw(rng.randrange(1, 1500), "abcd ") for _ in range(20)), "zzz", sample]
    points = [np.array([ord(c) if c != " " else 0 for c in t], dtype=np.uint32) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in points])]).astype(np.int64)
    automaton = L.Automaton(np.array([ord(c) if c != " " else 0 for c in sample], dtype=np.uint32))
    found = automaton.phrases(np.concatenate(points), starts)
    assert found.tolist() == [phrases_by_hand(t, sample) for t in texts]


def test_held_out_accuracy(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = L.language_id(docs, L.labelled_samples(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(out) == docs.count()
    held = out[out.held_out]
    assert len(held) > 20 and (held.lang_pred == held.lang).mean() > 0.95
    assert out.score.between(0, 1).all()


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en", "x"), (2, "le chat et le chien", "fr", "x"), (3, None, "en", "x"),
            (4, "12 ... 34", "fr", "x"), (5, "", None, "x"), (None, "the dog", None, None), (1, "the cat and the dog", "en", "x"),
            (6, "le chien " * 20000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    samples = L.labelled_samples(docs)
    out = {(r["doc_id"], r["row"]["text"]): r for r in L.language_id(docs, samples, carry=True).collect()}
    assert L.language_id(docs, samples).count() == len(rows)
    assert out[3, None]["lang_pred"] == out[4, "12 ... 34"]["lang_pred"] == out[5, ""]["lang_pred"] == L.UNKNOWN
    assert out[3, None]["score"] == 0
    assert out[None, "the dog"]["held_out"] is False
    if set(samples) == {"en", "fr"}:
        assert out[6, "le chien " * 20000]["lang_pred"] == "fr"
    empty = docs.where("false")
    assert L.labelled_samples(empty) == {} and L.language_id(empty, {}).count() == 0
    assert {r["lang_pred"] for r in L.language_id(docs, {}).collect()} == {L.UNKNOWN}
    blank = docs.withColumn("lang", F.lit(None).cast("string"))
    assert L.labelled_samples(blank) == {}


def test_rare_letters_count():
    rng = random.Random(5)
    letters = [chr(0x4E00 + i) for i in range(900)]
    sample = "".join(rng.choice(letters) for _ in range(4000))
    texts = [sample[at : at + 700] for at in (0, 1000, 3300)] + ["".join(rng.choice(letters) for _ in range(600)), "zzz"]
    points = [np.array([ord(c) for c in t], dtype=np.uint32) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in points])]).astype(np.int64)
    found = L.Automaton(np.array([ord(c) for c in sample], dtype=np.uint32)).phrases(np.concatenate(points), starts)
    assert found.tolist() == [phrases_by_hand(t, sample) for t in texts]


def test_samples_behind_headers(spark):
    header, digits = "this notice stands before all texts " * 60, "12, " * 1000
    rows = [(i, header + "le chien et le chat " * 400, "fr") for i in range(30)]
    rows += [(i, digits + "der hund", "de") for i in range(30, 60)]
    samples = L.labelled_samples(spark.createDataFrame(rows, "id long, text string, lang string"), "id")
    assert samples["fr"].count("chien") > samples["fr"].count("notice") > 0
    assert "der hund" in samples["de"]
    assert all(len(samples[lang]) <= 30 * (L.SAMPLE_LETTERS + L.SAMPLE_PLACES) for lang in samples)
