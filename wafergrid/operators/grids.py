"""Pixel grids in long form, one row (image, x, y): resizing, crops, fusion of views, components, regions, prompts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def minmax(df: DataFrame, by: Sequence[str], value: str, out: str = "normalized") -> DataFrame:
    """``df`` with ``value`` scaled to 0..1 within ``by``; groups without contrast give 0."""
    w = Window.partitionBy(*by)
    span = F.max(value).over(w) - F.min(value).over(w)
    return df.withColumn(out, F.when(span > 0, (F.col(value) - F.min(value).over(w)) / span).otherwise(F.when(F.col(value).isNotNull(), 0.0)))


def axis_positions(length: Column, window: Column, step: Column) -> Column:
    """Starts of windows along an axis: 0, step, ... and the last that ends at the edge; 0 alone if the window is no shorter than the axis."""
    last = length - window
    return F.when(last <= 0, F.array(F.lit(0))).otherwise(F.array_union(F.sequence(F.lit(0), last.cast("int"), step.cast("int")), F.array(last.cast("int"))))


def crop_boxes(df: DataFrame, width: str, height: str, crop: int, overlap: float) -> DataFrame:
    """``df`` once for each crop, with its box x1, y1, x2, y2 (ends exclusive): square windows with the given overlap, cut at the edges."""
    if crop < 1 or not 0 <= overlap < 1:
        raise ValueError("crop is positive and overlap at least 0 and below 1")
    step = max(1, int(np.rint(crop * (1 - overlap))))
    w, h = F.col(width).cast("int"), F.col(height).cast("int")
    df = df.withColumn("y1", F.explode(axis_positions(h, F.lit(crop), F.lit(step)))).withColumn("x1", F.explode(axis_positions(w, F.lit(crop), F.lit(step))))
    return df.withColumn("x2", F.least(F.col("x1") + crop, w)).withColumn("y2", F.least(F.col("y1") + crop, h))


def source_index(out: Column, n_in: Column, n_out: Column) -> Column:
    """Index of the nearest input cell of an output cell."""
    return F.least(F.floor((out + 0.5) * n_in / n_out), n_in - 1).cast("int")


def resize_nearest(cells: DataFrame, sizes: DataFrame, image: str, value: str, out_width: int, out_height: int) -> DataFrame:
    """(image, x, y, value): the grid at another size by the nearest cell. ``sizes``: image, width, height. Cells that are missing in the input stay missing."""
    out = sizes.select(image, "width", "height", F.explode(F.sequence(F.lit(0), F.lit(out_height - 1))).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(out_width - 1))))
    at = out.select(image, F.col("x").alias("ox"), F.col("y").alias("oy"), source_index(F.col("x"), F.col("width"), F.lit(out_width)).alias("x"), source_index(F.col("y"), F.col("height"), F.lit(out_height)).alias("y"))
    return at.join(cells.select(image, "x", "y", value), [image, "x", "y"]).select(image, F.col("ox").alias("x"), F.col("oy").alias("y"), value)


def resize_bilinear(cells: DataFrame, sizes: DataFrame, image: str, value: str, out_width: int, out_height: int) -> DataFrame:
    """(image, x, y, value): the grid at another size, linear between cell centres and constant beyond the outer ones.

    ``sizes``: image, width, height of the input. Cells that are missing in the input leave out their weight.
    """
    cx = F.greatest(F.lit(0.0), F.least((F.col("x") + 0.5) * F.col("width") / out_width - 0.5, F.col("width") - 1.0))
    cy = F.greatest(F.lit(0.0), F.least((F.col("y") + 0.5) * F.col("height") / out_height - 0.5, F.col("height") - 1.0))
    out = sizes.select(image, "width", "height", F.explode(F.sequence(F.lit(0), F.lit(out_height - 1))).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(out_width - 1))))
    out = out.withColumn("cx", cx).withColumn("cy", cy).withColumn("x0", F.floor("cx").cast("int")).withColumn("y0", F.floor("cy").cast("int"))
    fx, fy = F.col("cx") - F.col("x0"), F.col("cy") - F.col("y0")
    x1, y1 = F.least(F.col("x0") + 1, F.col("width").cast("int") - 1), F.least(F.col("y0") + 1, F.col("height").cast("int") - 1)
    corner = lambda x, y, w: F.struct(x.alias("sx"), y.alias("sy"), w.alias("w"))
    corners = F.array(corner(F.col("x0"), F.col("y0"), (1 - fx) * (1 - fy)), corner(x1, F.col("y0"), fx * (1 - fy)), corner(F.col("x0"), y1, (1 - fx) * fy), corner(x1, y1, fx * fy))
    four = out.select(image, F.col("x").alias("ox"), F.col("y").alias("oy"), F.explode(corners).alias("c")).where("c.w > 0")
    four = four.select(image, "ox", "oy", F.col("c.sx").alias("x"), F.col("c.sy").alias("y"), F.col("c.w").alias("w"))
    mixed = four.join(cells.select(image, "x", "y", value), [image, "x", "y"]).groupBy(image, "ox", "oy").agg((F.sum(F.col(value) * F.col("w")) / F.sum("w")).alias(value))
    return mixed.select(image, F.col("ox").alias("x"), F.col("oy").alias("y"), value)


def block_means(cells: DataFrame, image: str, values: Sequence[str], patch: int) -> DataFrame:
    """(image, gy, gx, values...): means over square patches; the last patch of a row or column may be smaller."""
    return cells.groupBy(image, F.floor(F.col("y") / patch).cast("int").alias("gy"), F.floor(F.col("x") / patch).cast("int").alias("gx")).agg(*[F.avg(v).alias(v) for v in values])


def valid_patches(patches: DataFrame, grid_w: Column, grid_h: Column, image_w: Column, image_h: Column, box: Sequence[Column]) -> DataFrame:
    """The patches (gx, gy) whose centre lies in the content box x1, y1, x2, y2 (ends exclusive)."""
    cx, cy = (F.col("gx") + 0.5) * image_w / grid_w, (F.col("gy") + 0.5) * image_h / grid_h
    return patches.where((cx >= box[0]) & (cx < box[2]) & (cy >= box[1]) & (cy < box[3]))


def fuse_views(views: DataFrame, image: str, value: str, fusion: str) -> DataFrame:
    """(image, x, y, value): views of an image, each a set of cells, put together by 'max' or 'mean'."""
    if fusion not in ("max", "mean"):
        raise ValueError("fusion is max or mean")
    return views.groupBy(image, "x", "y").agg((F.max(value) if fusion == "max" else F.avg(value)).alias(value))


def cells_in_boxes(cells: DataFrame, boxes: DataFrame, image: str) -> DataFrame:
    """Each cell once for every box x1, y1, x2, y2 of its image that holds it.

    Boxes are few an image and cells many; both meet on image and row, so that a large image isn't one task.
    """
    rows = boxes.withColumn("y", F.explode(F.sequence(F.col("y1").cast("int"), F.col("y2").cast("int") - 1)))
    return cells.join(rows, [image, "y"]).where("x >= x1 and x < x2")


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of ``n`` nodes with edges a-b the smallest node of each one's component."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            shorter = root[root]
            if (shorter == root).all():
                break
            root = shorter
    return root


def components(cells: DataFrame, image: str) -> DataFrame:
    """(image, x, y, component): cells that touch at an edge share a component, named by its first cell as ``y * 2**20 + x``.

    Images are dealt by hash and pass through a task one after the other, in order: it holds one image and one batch
    of rows at a time. NULL images and coordinates have no component, repeated cells count once. Coordinates lie below
    ``2**20``.
    """
    kind = cells.schema[image].dataType.simpleString()

    def labelled(t: pa.Table, number: np.ndarray) -> pa.RecordBatch:
        """``number``: of the image, in the order of the rows."""
        place = t.column(2).to_numpy().astype(np.int64) << 20 | t.column(1).to_numpy().astype(np.int64)
        key, first = np.unique(number << 40 | place, return_index=True)
        a, b = [], []
        for shift in (1, 1 << 20):  # the cell to the right, and the one below
            at = np.minimum(np.searchsorted(key, key + shift), len(key) - 1)
            hit = np.flatnonzero(key[at] == key + shift)
            a.append(hit)
            b.append(at[hit])
        root = _joined(len(key), np.concatenate(a), np.concatenate(b))
        some = t.take(pa.array(first))
        return pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in some.columns], pa.array(place[first][root])], names=[image, "x", "y", "component"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            names = held.column(0).combine_chunks()
            if not len(names):
                continue
            number = np.concatenate([[0], np.cumsum(pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False))]).astype(np.int64)
            last = int(np.searchsorted(number, number[-1]))
            if last:  # the last image may go on in the next batch
                yield labelled(held.slice(0, last), number[:last])
            held = held.slice(last)
        if held is not None and held.num_rows:
            yield labelled(held, np.zeros(held.num_rows, np.int64))

    good = cells.select(image, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).where(F.col(image).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    return good.repartition(image).sortWithinPartitions(image).mapInArrow(run, f"{image} {kind}, x int, y int, component long")


def regions(labelled: DataFrame, cells: DataFrame, image: str, score: str) -> DataFrame:
    """(image, component, x1, y1, x2, y2, area, score, px, py): box (ends exclusive), size, highest score and where it is (topmost, then leftmost)."""
    j = labelled.join(cells.select(image, "x", "y", score), [image, "x", "y"])
    point = F.max_by(F.struct("x", "y"), F.struct(F.col(score), -F.col("y"), -F.col("x")))
    out = j.groupBy(image, "component").agg(
        F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"), F.count("*").alias("area"), F.max(score).alias("score"), point.alias("p")
    )
    return out.select(image, "component", "x1", "y1", "x2", "y2", "area", "score", F.col("p.x").alias("px"), F.col("p.y").alias("py"))


def top_regions(found: DataFrame, image: str, *, min_area: int = 8, most: int = 8) -> DataFrame:
    """The best regions of an image by score, then area, then place; with their ``rank``."""
    w = Window.partitionBy(image).orderBy(F.desc("score"), F.desc("area"), "y1", "x1", "component")
    return found.where(F.col("area") >= min_area).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def perimeter(cells: DataFrame, image: str) -> DataFrame:
    """(image, area, perimeter): edges between a cell of the mask and one that isn't, the border counted as outside."""
    a = cells.select(image, "x", "y").distinct()
    right = F.lead("x").over(Window.partitionBy(image, "y").orderBy("x")) == F.col("x") + 1
    below = F.lead("y").over(Window.partitionBy(image, "x").orderBy("y")) == F.col("y") + 1
    a = a.withColumn("r", F.coalesce(right, F.lit(False)).cast("int")).withColumn("b", F.coalesce(below, F.lit(False)).cast("int"))
    return a.groupBy(image).agg(F.count("*").alias("area"), (4 * F.count("*") - 2 * F.sum(F.col("r") + F.col("b"))).alias("perimeter"))


def boxes_to_cells(boxes: DataFrame, image: str) -> DataFrame:
    """(image, x, y): the union of rectangles x1, y1, x2, y2 that include their ends, rounded half to even; what lies left of or above 0 is cut."""
    lo = lambda c: F.greatest(F.bround(F.col(c)).cast("int"), F.lit(0))
    hi = lambda c: F.bround(F.col(c)).cast("int")
    good = boxes.where((hi("x2") >= lo("x1")) & (hi("y2") >= lo("y1")))
    return good.withColumn("y", F.explode(F.sequence(lo("y1"), hi("y2")))).withColumn("x", F.explode(F.sequence(lo("x1"), hi("x2")))).select(image, "x", "y").distinct()


def centre_scaled(x1: Column, x2: Column, scale: float, length: Column) -> tuple[Column, Column]:
    """A span shrunk around its centre, moved back inside 0..length where it sticks out; rounded half to even."""
    if scale == 1:
        return x1, x2
    size = F.greatest(F.lit(1), F.bround((x2 - x1) * F.lit(float(scale)))).cast("int")
    start = F.greatest(F.lit(0), F.bround((x1 + x2) / F.lit(2.0) - size / F.lit(2.0)).cast("int"))
    stop = F.least(start + size, length.cast("int"))
    return F.greatest(F.lit(0), stop - size), stop


def grid_prompts(sizes: DataFrame, width: str, height: str, grid: int, most: int, scale: float = 1.0) -> DataFrame:
    """``sizes`` once for each box of a regular grid, row by row, at most ``most`` that aren't empty; edges are rounded half to even. Boxes may be shrunk around their centres by ``scale``."""
    if grid < 1 or not 0 < scale <= 1:
        raise ValueError("grid is positive, scale above 0 and at most 1")
    df = sizes.withColumn("__row", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn("__col", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    edge = lambda i, n: F.bround(i * F.col(n) / grid).cast("int")
    df = df.withColumn("x1", edge(F.col("__col"), width)).withColumn("x2", edge(F.col("__col") + 1, width)).withColumn("y1", edge(F.col("__row"), height)).withColumn("y2", edge(F.col("__row") + 1, height))
    (a, b), (c, d) = centre_scaled(F.col("x1"), F.col("x2"), scale, F.col(width)), centre_scaled(F.col("y1"), F.col("y2"), scale, F.col(height))
    df = df.withColumns({"x1": a, "x2": b, "y1": c, "y2": d}) if scale != 1 else df
    df = df.where("x2 > x1 and y2 > y1").withColumn("area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    w = Window.partitionBy(*sizes.columns).orderBy("__row", "__col")
    df = df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return df.withColumn("px", (F.col("x1") + F.col("x2")) / 2).withColumn("py", (F.col("y1") + F.col("y2")) / 2).drop("__row", "__col")


def prompt_shape(width: Column, height: Column, longest: int) -> tuple[Column, Column]:
    """Width and height at a longest side of ``longest``, each at least 1, rounded half to even."""
    scale = F.lit(float(longest)) / F.greatest(width, height)
    return F.greatest(F.lit(1), F.bround(width * scale)).cast("int"), F.greatest(F.lit(1), F.bround(height * scale)).cast("int")


def content_box(width: Column, height: Column, side: int) -> tuple[Column, ...]:
    """Where an image lies in a square of ``side`` after it was scaled to fit and centred: x1, y1, x2, y2."""
    scale = F.least(side / width, side / height)
    w, h = F.greatest(F.lit(1), F.bround(width * scale)).cast("int"), F.greatest(F.lit(1), F.bround(height * scale)).cast("int")
    x, y = F.floor((side - w) / 2).cast("int"), F.floor((side - h) / 2).cast("int")
    return x, y, x + w, y + h


def scaled_box(box: Sequence[Column], from_size: Sequence[Column], to_size: Sequence[Column]) -> tuple[Column, ...]:
    """A box in another size of the same image, kept inside it and at least one cell wide and high."""
    sx, sy = to_size[0] / from_size[0], to_size[1] / from_size[1]
    x1 = F.greatest(F.lit(0), F.least(F.bround(box[0] * sx), to_size[0] - 1))
    y1 = F.greatest(F.lit(0), F.least(F.bround(box[1] * sy), to_size[1] - 1))
    x2 = F.greatest(x1 + 1, F.least(F.bround(box[2] * sx), to_size[0]))
    y2 = F.greatest(y1 + 1, F.least(F.bround(box[3] * sy), to_size[1]))
    return tuple(c.cast("int") for c in (x1, y1, x2, y2))


def clipped_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> tuple[Column, Column, Column, Column, Column]:
    """A box cut to the image, and its area (0 if nothing is left)."""
    cut = lambda c, n: F.greatest(F.lit(0.0), F.least(c.cast("double"), n.cast("double")))
    a, b, c, d = cut(x1, width), cut(y1, height), cut(x2, width), cut(y2, height)
    return a, b, c, d, F.greatest(c - a, F.lit(0.0)) * F.greatest(d - b, F.lit(0.0))


def refine_in_boxes(cells: DataFrame, boxes: DataFrame, image: str, key: str, score: str, fraction: float = 0.5) -> DataFrame:
    """(image, key, x, y, score) of the cells of each box at or above ``fraction`` of its highest score (at least 0): the mask of a box where no model refines it."""
    inside = cells_in_boxes(cells, boxes.select(image, key, "x1", "y1", "x2", "y2"), image)
    top = F.max(score).over(Window.partitionBy(image, key))
    return inside.withColumn("__t", F.greatest(top * fraction, F.lit(0.0))).where(F.col(score) >= F.col("__t")).select(image, key, "x", "y", score)


def project_to_source(patches: DataFrame, sizes: DataFrame, image: str, value: str, content: tuple[int, int], source: tuple[int, int]) -> DataFrame:
    """(image, x, y, value): a patch grid brought to the size of the prepared content and then to that of the source, both linearly.

    ``patches``: the valid ones (see ``valid_patches``) with x, y counted from the first valid row and column; ``sizes``: image, width, height of that grid.
    """
    first = resize_bilinear(patches, sizes, image, value, *content)
    between = sizes.select(image, F.lit(content[0]).alias("width"), F.lit(content[1]).alias("height"))
    return resize_bilinear(first, between, image, value, *source)


def best_candidate(candidates: DataFrame, by: Sequence[str], index: str, *, model_score: str, heat: str, inside: str, area: str, image_area: str, most_area: float | None) -> DataFrame:
    """(by..., index, selection): the candidate mask of the highest selection, the first of equals; if every one is larger than ``most_area`` of the image, the best of all.

    ``heat``: mean normalized score inside the mask, ``inside``: cells of the mask inside its prompt, ``area``: cells of the mask.
    """
    a = F.col(area).cast("double")
    share = a / F.col(image_area)
    chosen = F.when(a > 0, F.col(model_score) * (0.25 + F.col(heat)) * (0.25 + F.col(inside) / a) / (0.25 + share)).otherwise(0.0)
    fits = F.lit(True) if most_area is None else share <= most_area
    df = candidates.withColumn("selection", chosen).withColumn("__fits", fits)
    best = F.max_by(F.struct(F.col(index), F.col("selection")), F.struct("__fits", "selection", -F.col(index)))
    return df.groupBy(*by).agg(best.alias("b")).select(*by, f"b.{index}", "b.selection")
