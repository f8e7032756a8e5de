"""Token pruning by masks over a grid of image patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_center(row: Column, col: Column, rows: Column, cols: Column, threshold: float) -> Column:
    """Whether a patch is kept by a crop around the centre, measured from its corner."""
    distance = F.sqrt(F.pow(row - rows / 2, F.lit(2.0)) + F.pow(col - cols / 2, F.lit(2.0)))
    largest = F.sqrt(F.pow(rows / 2, F.lit(2.0)) + F.pow(cols / 2, F.lit(2.0)))
    return distance / largest <= 1.0 - threshold


def crop_mask(sides: DataFrame, threshold: float) -> DataFrame:
    """side, patch_row, patch_col and kept for each patch of square grids."""
    line = F.sequence(F.lit(0), F.col("side") - 1)
    grid = sides.select("side", F.explode(line).alias("patch_row")).select("side", "patch_row", F.explode(line).alias("patch_col"))
    side = F.col("side").cast("double")
    return grid.withColumn("kept", in_center(F.col("patch_row"), F.col("patch_col"), side, side, threshold))


def prune_ids(df: DataFrame, ids: str, threshold: float, name: str = "kept_ids") -> DataFrame:
    """df with the ids whose patch is kept on the largest square grid; all of them if none or all are.

    Which places are kept follows from the number of ids alone, so the mask is worked out once for
    each number there is, and joined.
    """
    numbers = df.select(F.size(ids).alias("n_")).distinct().where("n_ > 0")
    side = F.floor(F.sqrt(F.col("n_").cast("double"))).cast("int")
    grid = numbers.select("n_", side.alias("side_"), F.explode(F.sequence(F.lit(0), side * side - 1)).alias("at_"))
    wide = F.col("side_").cast("double")
    inside = grid.where(in_center(F.floor(F.col("at_") / F.col("side_")), F.pmod("at_", "side_"), wide, wide, threshold))
    masks = inside.groupBy("n_").agg(F.sort_array(F.collect_list("at_")).alias("places_"))
    met = df.withColumn("n_", F.size(ids)).join(masks, "n_", "left")
    whole = F.col("places_").isNull() | (F.size("places_") == F.col("n_"))
    return met.withColumn(name, F.when(whole, F.col(ids)).otherwise(F.transform("places_", lambda k: F.get(ids, k)))).drop("n_", "places_")


def combine_masks(pixels: DataFrame, whole: float = 0.8) -> DataFrame:
    """image, pixel and value of the strongest mask there; masks that cover nearly all are left out.

    pixels: image, mask, pixel, inside (boolean), iou.
    """
    covers = pixels.groupBy("image", "mask").agg(F.avg(F.col("inside").cast("double")).alias("share_"))
    usable = pixels.join(covers, ["image", "mask"])
    value = F.when(F.col("inside") & (F.col("share_") < whole), F.col("iou")).otherwise(F.lit(0.0))
    return usable.groupBy("image", "pixel").agg(F.max(value).alias("value"))


def patch_mask(combined: DataFrame, patch: Column, threshold: float) -> DataFrame:
    """image, patch, mean and kept; all patches of an image without any mask value are kept."""
    strongest = combined.groupBy("image").agg(F.max("value").alias("top_"))
    means = combined.withColumn("patch", patch).groupBy("image", "patch").agg(F.avg("value").alias("mean"))
    return means.join(strongest, "image").select("image", "patch", "mean", ((F.col("top_") < 1e-6) | (F.col("mean") >= threshold)).alias("kept"))
