"""Per-detection filters and boxes with settings per model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexicue import constants as K
from lexicue.functions import geometry as G
from lexicue.functions import text as T
from lexicue.operators.staging import staged
from lexicue.sources.dimensions import fixed, known


def settings(spark) -> DataFrame:
    """Fixed dimension: five models with their confidence and duration thresholds."""
    return fixed(spark, ["model", "min_confidence", "min_duration"], K.MODEL_SETTINGS)


def readable(detections: DataFrame, spark) -> DataFrame:
    """Keep texts of enough confidence and length for their model; ``model, text, confidence`` needed.

    A model without settings stops the job.
    """
    return known(detections, settings(spark).select("model", "min_confidence"), "model").filter(
        (F.col("confidence") >= F.col("min_confidence")) & T.long_enough(F.col("text"))
    ).drop("min_confidence")


def boxed(detections: DataFrame, scale: float = 1.0, per_script: bool = True) -> DataFrame:
    """Polygons (``poly``) to boxes with character boxes; flat polygons are dropped."""
    box = G.polygon_box(F.col("poly"), scale)
    out = staged(detections, __b=box).filter(F.col("__b.y1") - F.col("__b.y0") > 0)
    width, height = F.col("__b.x1") - F.col("__b.x0"), F.col("__b.y1") - F.col("__b.y0")
    text = F.col("text")
    if per_script:
        step = width / F.greatest(F.length(text), F.lit(1))
        chars = G.unit_boxes(text, F.col("__b.x0"), F.col("__b.y0"), step, height)
    else:
        chars = G.equal_char_boxes(text, F.col("__b.x0"), F.col("__b.y0"), width, height)
    return out.withColumn("bbox", G.box_struct(F.col("__b"))).withColumn("chars", chars).withColumn(
        "confidence", F.bround("confidence", 4)
    ).drop("__b", "poly")
