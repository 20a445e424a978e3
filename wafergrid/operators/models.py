"""Where models plug in: feature extractors and mask refiners are Python objects that run on batches of rows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wafergrid.operators.grids import block_means


class PatchExtractor(Protocol):
    """Gets rows image_id and content, and gives rows image_id, view, gy, gx, vec."""

    def extract(self, images: pd.DataFrame) -> pd.DataFrame: ...


class MaskRefiner(Protocol):
    """Gets the rows of an image (its pixels and prompts), and gives rows image_id, region, candidate, x, y, score."""

    def refine(self, image: pd.DataFrame) -> pd.DataFrame: ...


def extracted(images: DataFrame, extractor: PatchExtractor) -> DataFrame:
    """(image_id, view, gy, gx, vec) of all images, batch by batch; weights are loaded once a worker by the extractor itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield extractor.extract(pdf)

    return images.mapInPandas(run, "image_id string, view string, gy int, gx int, vec array<float>")


def refined(images: DataFrame, refiner: MaskRefiner, image: str = "image_id") -> DataFrame:
    return images.groupBy(image).applyInPandas(lambda pdf: refiner.refine(pdf), f"{image} string, region int, candidate int, x int, y int, score double")


def color_patches(pixels: DataFrame, image: str, patch: int = 14) -> DataFrame:
    """(image, gy, gx, vec): mean colours of square patches, the extractor that needs no model. ``pixels``: image, x, y, r, g, b from 0 to 255."""
    m = block_means(pixels, image, ["r", "g", "b"], patch)
    return m.select(image, "gy", "gx", F.array(*[(F.col(c) / 255).cast("float") for c in "rgb"]).alias("vec"))


def image_net_normalized(channel: str, mean: float, deviation: float):
    return (F.col(channel) / 255 - mean) / deviation
