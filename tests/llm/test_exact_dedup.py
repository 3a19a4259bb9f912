import hashlib
import re

import pytest

from veripaper.llm import exact_dedup as E

BLANKS = re.compile("[\\x20\\x09-\\x0D]")


def by_hand(rows):
    """keep_id and group_size of every identifier (identifiers differ)."""
    groups = {}
    for doc, text in rows:
        groups.setdefault(BLANKS.sub("", text or ""), []).append((doc, len(text or "")))
    out = {}
    for content, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0]))[0]
        for doc, _ in members:
            out[doc] = (keep, len(members), doc == keep, hashlib.sha256(content.encode()).hexdigest())
    return out


@pytest.mark.parametrize("range_rows", [4096, 25, 3])
def test_groups_over_many_ranges(spark, monkeypatch, range_rows):
    """A third of all rows in one group, which the splitters cut into several ranges."""
    monkeypatch.setattr(E, "RANGE_ROWS", range_rows)
    texts = ["same text here", "same  text\there ", "sametext\nhere"] * 30 + [f"text {i % 97}" for i in range(150)]
    texts += ["", None, " \n", "x" * 200000, "x " * 200000, "é", "é"]
    texts += ["long head " * 20 + str(i % 5) for i in range(40)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kept", "'y' as keep_id").repartition(5)
    found = E.exact_dedup(docs).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in found} == by_hand(rows)
    carried = E.exact_dedup(docs, carry=True).where("kept").select("row.*")
    assert carried.columns == docs.columns and carried.count() == sum(r["kept"] for r in found)


def test_repeated_rows_nulls_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(E, "RANGE_ROWS", 2)
    docs = spark.createDataFrame([(1, "a")] * 9 + [(None, "a "), (None, "a "), (2, "c"), (None, None)], "doc_id long, text string")
    rows = E.exact_dedup(docs).collect()
    assert len(rows) == 13 and sum(r["kept"] for r in rows) == 3
    assert {(r["keep_id"], r["group_size"]) for r in rows} == {(None, 11), (2, 1), (None, 1)}
    assert E.exact_dedup(docs.where("false")).count() == 0


def test_main_path_has_no_python(spark, folder):
    plan = E.exact_dedup(spark.read.parquet(f"{folder}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
