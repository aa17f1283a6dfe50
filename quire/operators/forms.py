"""Forms over the fields table: recalculation in order, formatted values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import formcalc


def recalculated(fields: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, name, value, skipped of every field after the document's calculations, in its calculation order.

    A formula may use what another has just set, so a document is worked through at
    once: its fields come as one row, as many as a form has.
    """
    rows = fields.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_no", "obj", "name", "value", "calc", "format"))).alias("f"))
    both = rows.join(documents.select("doc_id", "calc_order"), "doc_id", "left")

    def run(it):
        for b in it:
            out = []
            for doc_id, f, order in zip(b["doc_id"], b["f"], b["calc_order"], strict=True):
                own = [{k: r[k] for k in ("obj", "name", "value", "calc", "format")} for r in f]
                values, skipped = formcalc.recalculated(own, list(order) if order is not None else [])
                out += [(doc_id, n, v, n in skipped) for n, v in values.items()]
            yield pd.DataFrame(out, columns=["doc_id", "name", "value", "skipped"])

    return both.mapInPandas(run, "doc_id long, name string, value string, skipped boolean")


def picked(buttons: DataFrame, group: list[str], button: str, on: Column) -> DataFrame:
    """buttons with is_on and is_cleared: of the picked ones (on) of a group the last by button is on, and its siblings are cleared.

    One row for each group with a pick; siblings are never paired."""
    last = buttons.where(on).groupBy(*group).agg(F.max(button).alias("_on"))
    j = buttons.join(last, group, "left")
    same = F.col("_on") == F.col(button)
    return j.withColumn("is_on", F.coalesce(same, F.lit(False))).withColumn("is_cleared", F.coalesce(~same, F.lit(False))).drop("_on")
