"""The exchange table's schema and the names of the matrices."""

from __future__ import annotations

import json

from pyspark.sql import types as T

TECHNOSPHERE, BIOSPHERE, CHARACTERIZATION, NORMALIZATION, WEIGHTING = (f"{n}_matrix" for n in ("technosphere", "biosphere", "characterization", "normalization", "weighting"))

DISTRIBUTION = T.StructType([T.StructField("uncertainty_type", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in ("loc", "scale", "shape", "minimum", "maximum")], T.StructField("negative", T.BooleanType())])

EXCHANGES = T.StructType([
    T.StructField("group_ord", T.IntegerType()), T.StructField("group", T.StringType()), T.StructField("matrix", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("identifier", T.StringType()), T.StructField("global_index", T.LongType()), T.StructField("row_id", T.LongType()), T.StructField("col_id", T.LongType()),
    T.StructField("amount", T.DoubleType()), T.StructField("samples", T.ArrayType(T.DoubleType())), T.StructField("flip", T.BooleanType()), T.StructField("dist", DISTRIBUTION),
])


def label(name) -> str | None:
    """One text for a label, which is a string or a tuple of strings; a string and a 1-tuple stay apart."""
    if name is None:
        return None
    return json.dumps(list(name) if isinstance(name, (tuple, list)) else name)


def unlabel(text: str):
    """The label that `label` made a text of."""
    found = json.loads(text)
    return tuple(found) if isinstance(found, list) else found
