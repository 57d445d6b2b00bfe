"""Image sizes within a pixel budget; only numbers, no pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the models: pixels of an image, and pixels of a visual token.
BUDGET, PIXELS_A_TOKEN = 5_120_000, 1024


def over_budget(w: Column, h: Column, budget: int = BUDGET) -> Column:
    return w * h > budget


def fitted(w: Column, h: Column, budget: int = BUDGET) -> Column:
    """struct(w, h): the size within the budget, never larger than given."""
    scale = F.sqrt(F.lit(float(budget)) / (w * h))

    def side(x: Column) -> Column:
        return F.when(over_budget(w, h, budget), F.greatest(F.lit(1), F.floor(x * scale))).otherwise(x).cast("long")

    return F.struct(side(w).alias("w"), side(h).alias("h"))


def preparation(w: Column, h: Column, kept_w: Column, kept_h: Column, budget: int = BUDGET) -> Column:
    """What preparing an image does, given the size of the copy that is there already (null: none)."""
    there = kept_w.isNotNull() & ~over_budget(kept_w, kept_h, budget)
    return F.when(there, "kept").when(over_budget(w, h, budget), "resized").otherwise("copied")


def visual_tokens(w: Column, h: Column) -> Column:
    return F.floor(w * h / PIXELS_A_TOKEN).cast("long")
