"""Boxes on pages: filters, overlap with text, and merging of neighbours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scale import Columns, map_groups

def _width() -> Column:
    return F.col("x1") - F.col("x0")


def _height() -> Column:
    return F.col("y1") - F.col("y0")


# --- fixed values: a logo size that is never a diagram, and accepted file types ---------------
LOGO_SIZE = (260, 128)
IMAGE_TYPES = ["jpg", "jpeg", "png"]


def _logo(width: Column, height: Column) -> Column:
    w, h = width.cast("int"), height.cast("int")
    a, b = LOGO_SIZE
    return ((w == a) & (h == b)) | ((w == b) & (h == a))


def _typed() -> Column:
    return F.lower("ext").isin(IMAGE_TYPES)


def _page_sized() -> Column:
    """Covers most of the page by area or by one side, or reaches all its margins."""
    pw, ph = F.col("page_w"), F.col("page_h")
    margin = 0.05
    edge = (
        (F.col("x0") < pw * margin)
        & (F.col("y0") < ph * margin)
        & (F.col("x1") > pw * (1 - margin))
        & (F.col("y1") > ph * (1 - margin))
    )
    return (_width() * _height() > pw * ph * 0.6) | (_width() > pw * 0.75) | (_height() > ph * 0.75) | edge


def filter_embedded_images(regions: DataFrame, references: DataFrame) -> DataFrame:
    """Image boxes that can be diagrams: typed, diagram-sized, between the first page and the references.

    ``references`` is ``(doc_id, references_page)`` with -1 for none; pages count from 1.
    """
    placed = regions.join(references, "doc_id", "left")
    last = F.coalesce("references_page", F.lit(-1))
    return placed.where(
        _typed()
        & ~_page_sized()
        & (_width() >= 100)
        & (_height() >= 100)
        & ~_logo(_width(), _height())
        & (F.col("page") >= 2)
        & ((last < 0) | (F.col("page") < last))
    ).drop("references_page")


def filter_embedded_images_simple(images: DataFrame, minimum: int = 50) -> DataFrame:
    """Images by type and pixel size alone; reads ``ext, width, height``."""
    w, h = F.col("width"), F.col("height")
    return images.where(_typed() & (w >= minimum) & (h >= minimum) & ~_logo(w, h))


def image_boxes(images: DataFrame, minimum: int = 100) -> DataFrame:
    """Image boxes by type and size, without page rules."""
    return images.where(
        _typed() & (_width() >= minimum) & (_height() >= minimum) & ~_logo(_width(), _height())
    )


def regions_with_text(regions: DataFrame, text_blocks: DataFrame) -> DataFrame:
    """Regions with ``n_text``, the number of text blocks of their page that they intersect."""
    b = text_blocks.select("doc_id", "page", *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    hit = (
        (F.col("x0") < F.col("t_x1"))
        & (F.col("t_x0") < F.col("x1"))
        & (F.col("y0") < F.col("t_y1"))
        & (F.col("t_y0") < F.col("y1"))
    )
    counted = (
        regions.select("doc_id", "page", "region_id", "x0", "y0", "x1", "y1")
        .join(b, ["doc_id", "page"])
        .where(hit)
        .groupBy("doc_id", "page", "region_id")
        .agg(F.count(F.lit(1)).alias("n_text"))
    )
    return regions.join(counted, ["doc_id", "page", "region_id"], "left").withColumn(
        "n_text", F.coalesce("n_text", F.lit(0))
    )


def filter_drawing_regions(regions: DataFrame, text_blocks: DataFrame, most_text: int = 5) -> DataFrame:
    """Drawing regions that can be diagrams: not page-sized, little text, at least 150 wide and high."""
    counted = regions_with_text(regions, text_blocks)
    return counted.where(
        ~_page_sized() & (F.col("n_text") <= most_text) & (_width() >= 150) & (_height() >= 150)
    )


def union_regions(images: DataFrame, drawings: DataFrame) -> DataFrame:
    return images.unionByName(drawings, allowMissingColumns=True)


def clip_regions(regions: DataFrame, scale: float = 2.0) -> DataFrame:
    """Regions clamped to their page and large enough to keep once rendered at ``scale``."""
    pw, ph = F.col("page_w"), F.col("page_h")
    zero = F.lit(0.0)
    clamped = regions.withColumns(
        {
            "x0": F.greatest(zero, F.least(F.col("x0"), pw)),
            "y0": F.greatest(zero, F.least(F.col("y0"), ph)),
            "x1": F.greatest(F.col("x0"), F.least(F.col("x1"), pw)),
            "y1": F.greatest(F.col("y0"), F.least(F.col("y1"), ph)),
        }
    )
    sized = clamped.where((_width() >= 100) & (_height() >= 100))
    return sized.where((_width() * scale >= 150) & (_height() * scale >= 150))


def whole_pages(pages: DataFrame, minimum: int = 150) -> DataFrame:
    """Rendered pages kept when a document gave no region."""
    return pages.where((F.col("width") >= minimum) & (F.col("height") >= minimum))


CORNERS = ("x0", "y0", "x1", "y1")


class _Strips:
    """Boxes of a page by width class and left edge, to find those that reach into a strip of the page."""

    def __init__(self, boxes: np.ndarray):
        width = boxes[:, 2] - boxes[:, 0]
        classes = np.ceil(np.log2(np.maximum(width, 1.0))).astype(int)
        self.classes = []
        for k in np.unique(classes):
            mine = np.flatnonzero(classes == k)
            mine = mine[np.argsort(boxes[mine, 0], kind="stable")]
            self.classes.append((mine, boxes[mine, 0], width[mine].max()))

    def between(self, left: float, right: float) -> np.ndarray:
        """Boxes that may have a point between two upright lines, and all that have one."""
        found = [
            order[np.searchsorted(lefts, left - widest) : np.searchsorted(lefts, right, side="right")]
            for order, lefts, widest in self.classes
        ]
        return np.concatenate(found)


def _grow(boxes: np.ndarray, gap: float) -> np.ndarray:
    """Boxes of one page merged in input order: a box takes in all that touch it or lie nearer than ``gap``."""
    free = np.ones(len(boxes), dtype=bool)
    strips, merged = _Strips(boxes), []
    for seed in range(len(boxes)):
        if not free[seed]:
            continue
        x0, y0, x1, y1 = boxes[seed]
        free[seed] = False
        while True:
            around = strips.between(x0 - gap, x1 + gap)
            around = around[free[around]]
            some = boxes[around]
            across = np.maximum(0, np.maximum(x0 - some[:, 2], some[:, 0] - x1))
            down = np.maximum(0, np.maximum(y0 - some[:, 3], some[:, 1] - y1))
            near = np.hypot(across, down) < gap
            if not near.any():
                break
            taken = some[near]
            x0, y0 = min(x0, taken[:, 0].min()), min(y0, taken[:, 1].min())
            x1, y1 = max(x1, taken[:, 2].max()), max(y1, taken[:, 3].max())
            free[around[near]] = False
        merged.append((x0, y0, x1, y1))
    return np.array(merged)


def merge_regions(regions: DataFrame, gap: float = 50.0) -> DataFrame:
    """Neighbouring boxes of a page merged: ``(doc_id, page, region_id, x0, y0, x1, y1)``.

    Growth depends on what was taken in before, so that a page is worked on as one group, in order of
    ``region_id`` and corners. Only boxes in the strip of the page around a growing box are looked at.
    Many pages are worked on in one call.
    """

    def per_page(rows: Columns, starts: np.ndarray) -> tuple[np.ndarray, Columns]:
        boxes = np.column_stack([rows[c] for c in CORNERS]).astype(float)
        pages = np.split(boxes, starts[1:])
        merged = [page if len(page) == 1 else _grow(page, gap) for page in pages]
        counts = np.array([len(page) for page in merged])
        found = np.concatenate(merged)
        before = np.repeat(np.cumsum(counts) - counts, counts)
        return counts, {"region_id": np.arange(len(found)) - before, **{c: found[:, i] for i, c in enumerate(CORNERS)}}

    kinds = dict(regions.dtypes)
    schema = (
        f"doc_id {kinds['doc_id']}, page {kinds['page']}, region_id bigint, "
        "x0 double, y0 double, x1 double, y1 double"
    )
    corners = [F.col(c).cast("double").alias(c) for c in CORNERS]
    boxes = regions.select("doc_id", "page", "region_id", *corners)
    return map_groups(boxes, ["doc_id", "page"], ["region_id", *CORNERS], per_page, schema)
