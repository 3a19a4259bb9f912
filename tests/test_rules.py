"""Text rules on hand-made rows with literal results, and properties on whole texts."""

import json

from pyspark.sql import functions as F

from veripaper.functions import patterns as P
from veripaper.functions import references as R
from veripaper.operators import documents as D
from veripaper.operators import keywords as K
from veripaper.plans import bindings as B

def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "text string").select(*columns).collect()[0]


def test_keywords(spark):
    texts = spark.createDataFrame(
        [
            (1, 'The fig "deep net" at 640x480, 12.5% and CIFAR10; Fig again'),
            (2, "Great Big Name, YOLO-V, the was"),
            (3, ""),
            (4, "a I"),
        ],
        "image_id long, ocr_text string",
    )
    listed = {r.image_id: r.keywords for r in K.keyword_lists(K.extract_keywords(texts)).collect()}
    assert listed[1][:3] == ["deep net", "640x480", "CIFAR10"]
    assert {"12.5%", "12.5", "again", "Fig", "deep", "net"} <= set(listed[1]) and "fig" not in listed[1]
    assert listed[2] == ["Great Big Name", "YOLO-V", "Great", "Name", "YOLO", "Big"]
    assert set(listed) == {1, 2}


def test_keyword_properties(spark, folder):
    """Longest first, one spelling of each, no stop word, and nothing left out of long texts."""
    words = " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200))
    texts = B.ocr_text_v(spark, folder).unionByName(spark.createDataFrame([(-1, words)], "image_id long, ocr_text string"))
    listed = {r.image_id: r.keywords for r in K.keyword_lists(K.extract_keywords(texts)).collect()}
    assert len(listed[-1]) == 200
    for keywords in listed.values():
        lowered = [k.lower() for k in keywords]
        assert len(set(lowered)) == len(lowered) and not set(lowered) & set(P.STOP_WORDS)
        assert [len(k) for k in keywords] == sorted((len(k) for k in keywords), reverse=True)


def test_queries(spark):
    texts = spark.createDataFrame(
        [(1, "one two three"), (2, "ResNet Block with sizes 64x64"), (3, "?!?"), (4, "")], "image_id long, ocr_text string"
    )
    keywords = K.extract_keywords(texts)
    listed = {}
    for r in K.build_queries(texts, keywords).orderBy("image_id", "pos").collect():
        listed.setdefault(r.image_id, []).append(r.query)
    assert listed[1] == [
        "three diagram", "three architecture", "one diagram", "one architecture", "two diagram", "two architecture",
        "three one", "three two", "one two",
    ]
    assert {"ResNet architecture", "ResNet neural network", "ResNet 64x64"} <= set(listed[2])
    assert listed[3] == ["?!?"] and 4 not in listed


def test_quote_aware_squeeze(spark):
    cases = {
        'a  b "c\n  d"  e\n\nf': 'a b "c   d" e f',
        "it's  a\n\ntest's  end": "it's  a  test's end",
        'open "x  y': 'open "x  y',
        "plain \t text": "plain text",
        "": "",
    }
    for text, expected in cases.items():
        assert one(spark, text, R.quote_aware_squeeze(F.col("text")).alias("t")).t == expected


def test_multi_paper(spark):
    refs = spark.createDataFrame(
        [
            (1, 'P. Roe et al., "First long title", Journal One, vol. 3, pp. 5, 2009. "Second long title", Journal Two, vol. 4, pp. 6, 2010.'),
            (2, 'P. Roe, "Only one title here", Journal, vol. 3, 2009.'),
        ],
        "ord int, raw_text string",
    )
    rows = [(r.ord, r.sub_order, r.raw_text) for r in D.split_multi_paper(refs).orderBy("ord", "sub_order").collect()]
    assert rows[0] == (1, 0, '"First long title", Journal One, vol. 3, pp. 5, 2009')
    assert rows[1] == (1, 1, 'P. Roe et al., "Second long title", Journal Two, vol. 4, pp. 6, 2010.')
    assert rows[2][:2] == (2, 0) and len(rows) == 3
    assert D.split_order(D.split_multi_paper(refs)).where("position.sub_order = 1").count() == 1


def test_split_references(spark):
    sections = spark.createDataFrame(
        [
            (1, "[1] A first reference\ntext that wraps\ntwice\n[2] short\n[3]  Two on one line here [4] And the other reference\nmore"),
            (2, "Smith (2001) On things that\nmatter. Jones Lee (1999) Another work\nend"),
        ],
        "paper_id long, section string",
    )
    rows = {(r.paper_id, r.ord): r.raw_text for r in D.split_references(sections).collect()}
    assert rows[(1, 1)] == "A first reference\ntext that wraps\ntwice" and (1, 2) not in rows
    assert rows[(1, 3)] == "Two on one line here" and rows[(1, 4)] == "And the other reference\nmore"
    assert rows[(2, 1)] == "Smith (2001) On things that\nmatter. Jones"
    assert rows[(2, 2)] == "Lee (1999) Another work\nend"


def test_reference_pages(spark):
    texts = {
        1: ["intro", "References\n[1] x", "[2] y", "no list", "appendix"],
        2: ["a", "Bibliography", "[1] a", "Smith et al. b", "[9] References again", "[3] late"],
        3: ["p1", "p2", "p3", "p4"],
    }
    rows = [(d, i + 1, t) for d, pages in texts.items() for i, t in enumerate(pages)]
    pages = spark.createDataFrame(rows, "paper_id long, page int, text string")
    got = {}
    for r in D.references_pages(pages).collect():
        got.setdefault(r.paper_id, []).append(r.page)
    assert {k: sorted(v) for k, v in got.items()} == {1: [2, 3], 2: [2, 3, 4, 5, 6], 3: [1, 2, 3, 4]}


def test_first_page(spark):
    page = "IEEE Transactions\n12\nA Study of Very Long\nthings in the world of data,\nJohn Smith\nJane Doe\nDept of Engineering\nBob Late\nSep 3, 2021 and 2019"
    row = one(
        spark, page, D.first_page_title(F.col("text")).alias("title"),
        D.first_page_authors(F.col("text")).alias("authors"), D.first_page_year(F.col("text")).alias("year"),
    )
    assert row.title == "A Study of Very Long things in the world of data"
    assert row.authors == ["IEEE Transactions"][:0] + ["John Smith", "Jane Doe"]
    assert row.year == 2021
    assert one(spark, "short\nJohn Smith", D.first_page_title(F.col("text")).alias("t")).t is None


def test_second_page_title(spark):
    text = "\n".join(["x", "Title: A line.", "An even longer line of the second page here that wins!", "not this one, although it is by far the longest line"])
    assert one(spark, text, D.second_page_title(F.col("text")).alias("t")).t == "An even longer line of the second page here that wins"
    assert one(spark, "no", D.second_page_title(F.col("text")).alias("t")).t is None


def test_responses(spark):
    refs = [{"title": f"T{i}", "authors": "A B, C D", "year": y, "journal": "J"} for i, y in enumerate([2001, "1999", "n.d.", None])]
    raw = spark.createDataFrame(
        [(1, "```json\n" + json.dumps({"references": refs}) + "\n```"), (2, json.dumps({"references": refs[:1]})), (3, "not json")],
        "paper_id long, response string",
    )
    rows = D.parse_llm_responses(raw)
    listed = {(r.paper_id, r.ord): r for r in rows.collect()}
    assert [listed[(1, i)].year for i in range(1, 5)] == [2001, 1999, None, None]
    assert listed[(1, 1)].raw_text == "A B, C D (2001) T0" and listed[(1, 1)].authors == "A B, C D"
    assert (listed[(2, 1)].venue, listed[(2, 1)].type) == ("J", "other") and (3, 1) not in listed
    by_pattern = spark.createDataFrame([(1, 1, "p"), (2, 1, "p"), (3, 1, "p")], "paper_id long, ord int, raw_text string")
    chosen = D.choose_references(rows, by_pattern)
    assert {(r.paper_id, r.raw_text == "p") for r in chosen.collect()} == {(1, False), (2, False), (3, True)}


def test_title_of_a_long_text_without_marks(spark):
    """A capital at every other character and no year: the rule must not start anew at each of them."""
    long = "AB " * 100_000
    rows = spark.createDataFrame([(long,), (f"x. {long}, 2001",)], "raw string").select(R.extract_title(F.col("raw"))["title"].alias("t"))
    assert [r.t for r in rows.collect()] == [long.strip(), long.strip()]


def test_first_page_lines_are_looked_at_once(spark):
    """Lines behind the title are not looked at for its start, and rules that decide differently by title likeness hold."""
    texts = {
        "A Study of Deep Things in Networks\nof physics departments\nx@y.edu": "A Study of Deep Things in Networks of physics departments",
        "deep learning for all of us today\nDepartment of late things in networks\nmore": "deep learning for all of us today",
        "deep learning for all of us today\nDepartment 1999\nmore": "deep learning for all of us today Department 1999",
        "deep learning for all of us today\nsee doi of this one for more of it": "deep learning for all of us today see doi of this one for more of it",
        "deep learning for all of us today\nshort\nmore": "deep learning for all of us today",
        "in Ieee things\nwith springer words in it\nhttps://a.b and some words\nonly this line here is one": "only this line here is one",
        "no": None,
    }
    title = D.first_page_title(F.col("text"))
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", title.alias("title")).collect()
    assert {r.text: r.title for r in rows} == texts
    plan = spark.createDataFrame([("x",)], "text string").select(title)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\d{4}|") <= 4  # each place of the rule is a run over the lines
