"""Page geometry."""

import random

import numpy as np

from pyspark.sql import functions as F

from veripaper.functions.hashes import client_key, format_hash, rect_distance, search_urls
from veripaper.operators import diagrams as D
from veripaper.operators import regions as R

SCHEMA = "doc_id long, page int, region_id long, x0 double, y0 double, x1 double, y1 double, ext string, page_w double, page_h double"


def boxes(spark, *rows):
    full = [(1, r[0], i, *map(float, r[1:5]), r[5] if len(r) > 5 else "png", 1000.0, 1000.0) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def ids(df):
    return sorted(r.region_id for r in df.collect())


def test_embedded_images(spark):
    df = boxes(
        spark,
        (2, 100, 100, 300, 300),  # kept
        (1, 100, 100, 300, 300),  # first page
        (5, 100, 100, 300, 300),  # references page
        (2, 100, 100, 300, 300, "gif"),
        (2, 0, 0, 760, 100),  # too wide
        (2, 100, 100, 199, 300),  # too narrow
        (2, 100, 100, 360.7, 228.2),  # logo
        (2, 10, 10, 740, 740, "JPEG"),  # 53 % of the page
    )
    refs = spark.createDataFrame([(1, 5)], "doc_id long, references_page int")
    assert ids(R.filter_embedded_images(df, refs)) == [0, 7]
    assert ids(R.image_boxes(df)) == [0, 1, 2, 4, 7]


def test_simple_filter(spark):
    df = spark.createDataFrame(
        [(1, "png", 50, 50), (2, "bmp", 90, 90), (3, "jpg", 260, 128), (4, "png", 49, 90)],
        "region_id long, ext string, width int, height int",
    )
    assert ids(R.filter_embedded_images_simple(df)) == [1]


def test_drawing_regions(spark):
    df = boxes(spark, (2, 100, 100, 300, 300), (2, 400, 100, 600, 300), (2, 100, 500, 240, 700))
    blocks = spark.createDataFrame(
        [(1, 2, 110.0 + i, 110.0, 120.0 + i, 120.0) for i in range(6)] + [(1, 2, 410.0, 110.0, 420.0, 120.0), (1, 2, 600.0, 0.0, 700.0, 400.0)],
        "doc_id long, page int, x0 double, y0 double, x1 double, y1 double",
    )
    counted = {r.region_id: r.n_text for r in R.regions_with_text(df, blocks).collect()}
    assert counted == {0: 6, 1: 1, 2: 0}  # a shared edge is no overlap
    assert ids(R.filter_drawing_regions(df, blocks)) == [1]


def test_clip_regions(spark):
    df = boxes(spark, (1, -50, -50, 120, 120), (1, 900, 900, 1200, 1200), (1, 950, 0, 1200, 500))
    rows = {r.region_id: (r.x0, r.y0, r.x1, r.y1) for r in R.clip_regions(df).collect()}
    assert rows == {0: (0.0, 0.0, 120.0, 120.0), 1: (900.0, 900.0, 1000.0, 1000.0)}
    pages = spark.createDataFrame([(1, 150, 150), (2, 149, 900)], "page int, width int, height int")
    assert [r.page for r in R.whole_pages(pages).collect()] == [1]


def merged_by_hand(rects, gap):
    used, out = [False] * len(rects), []
    for i, rect in enumerate(rects):
        if used[i]:
            continue
        used[i], current, changed = True, rect, True
        while changed:
            changed = False
            for j, other in enumerate(rects):
                if used[j]:
                    continue
                h = max(0, max(current[0] - other[2], other[0] - current[2]))
                v = max(0, max(current[1] - other[3], other[1] - current[3]))
                if (h * h + v * v) ** 0.5 < gap:
                    current = (min(current[0], other[0]), min(current[1], other[1]), max(current[2], other[2]), max(current[3], other[3]))
                    used[j] = changed = True
        out.append(current)
    return out


def test_merge_regions(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for page in range(1, 8):
        rects = []
        for _ in range(12):
            x, y = rng.uniform(0, 900), rng.uniform(0, 900)
            rects.append((x, y, x + rng.uniform(5, 120), y + rng.uniform(5, 120)))
        expected[page] = sorted(merged_by_hand(rects, 50))
        rows += [(page, *r) for r in rects]
    got = {}
    for r in R.merge_regions(boxes(spark, *rows)).collect():
        got.setdefault(r.page, []).append((r.x0, r.y0, r.x1, r.y1))
    assert {p: sorted(v) for p, v in got.items()} == expected


def test_many_boxes_on_one_page():
    """A grid of boxes far apart, with a row of near ones and some broad ones: looking at strips keeps this short."""
    side = 316
    corner = np.stack(np.meshgrid(np.arange(side), np.arange(side)), axis=-1).reshape(-1, 2) * 200.0
    found = np.column_stack([corner, corner + 20.0])
    near = np.array([[i * 200.0 + 60, 60.0, i * 200.0 + 80, 80.0] for i in range(side)])
    broad = np.array([[0.0, -1000.0 * k, 50_000.0, -1000.0 * k + 5] for k in range(1, 9)])
    merged = R._grow(np.concatenate([found, near, broad]), 50)
    # A near box is 40 away from its own corner's box on both axes, more than 50 in all, and joins nothing.
    assert len(merged) == side * side + side + 8
    assert len(R._grow(np.concatenate([found, near - 10]), 50)) == side * side


def test_drawing_boxes_and_union(spark):
    points = spark.createDataFrame(
        [(1, 1, 1, 0.0, 0.0), (1, 1, 1, 60.0, 50.0), (1, 1, 2, 0.0, 0.0), (1, 1, 2, 49.0, 90.0)],
        "doc_id long, page int, drawing_id long, x double, y double",
    )
    found = D.drawing_boxes(points)
    assert [(r.drawing_id, r.x1, r.y1) for r in found.collect()] == [(1, 60.0, 50.0)]
    assert R.union_regions(boxes(spark, (1, 0, 0, 1, 1)), found).count() == 2


def test_small_functions(spark):
    row = spark.range(1).select(
        format_hash(F.lit("a" * 20)).alias("long"),
        format_hash(F.lit("ab")).alias("short"),
        search_urls(F.lit("http://x.y/a b(1)!.png")).alias("urls"),
        client_key(F.create_map(F.lit("x-forwarded-for"), F.lit("1.2.3.4, 5.6.7.8"))).alias("forwarded"),
        client_key(F.create_map(F.lit("x-real-ip"), F.lit(" 9.9.9.9 "))).alias("real"),
        client_key(F.create_map(F.lit("other"), F.lit("x"))).alias("local"),
        rect_distance(
            {"x0": F.lit(0.0), "y0": F.lit(0.0), "x1": F.lit(1.0), "y1": F.lit(1.0)},
            {"x0": F.lit(4.0), "y0": F.lit(5.0), "x1": F.lit(6.0), "y1": F.lit(6.0)},
        ).alias("gap"),
    ).collect()[0]
    assert (row.long, row.short) == ("a" * 16 + "...", "ab")
    assert row.urls.google.endswith("image_url=http%3A%2F%2Fx.y%2Fa%20b(1)!.png")
    assert (row.forwarded, row.real, row.local, row.gap) == ("1.2.3.4", "9.9.9.9", "local", 5.0)


def test_pages_are_merged_many_at_a_time(spark):
    rows = [(d, d % 3 if d % 7 else None, i, 100.0 * i, 0.0, 100.0 * i + 60 + d % 2 * 40, 50.0) for d in range(40) for i in range(d % 4 + 1)]
    df = spark.createDataFrame(rows, "doc_id long, page int, region_id long, x0 double, y0 double, x1 double, y1 double")
    merged = R.merge_regions(df, gap=30.0)
    text = merged._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "FlatMapGroups" not in text  # no call for each page
    want = set()
    for d in range(40):
        n, page = d % 4 + 1, d % 3 if d % 7 else None
        if d % 2:  # boxes touch
            want.add((d, page, 0, 0.0, 100.0 * n))
        else:
            want |= {(d, page, i, 100.0 * i, 100.0 * i + 60) for i in range(n)}
    for batch in ("1", "10000"):  # pages that go on in the next batch
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        assert {(r.doc_id, r.page, r.region_id, r.x0, r.x1) for r in merged.collect()} == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
