"""Cutting text at delimiters, and description sequences as columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

from ..functions.tables import DELIMITERS
from .matcher import SEGMENT_EXCLUSIVE, SEGMENT_INCLUSIVE, ids_end, ids_split


def split_segments(col: Column, inclusive: bool = True) -> Column:
    """array<string>: segments with their delimiter at the end, or delimiters as segments of their own."""
    return F.regexp_extract_all(col, F.lit(SEGMENT_INCLUSIVE if inclusive else SEGMENT_EXCLUSIVE), F.lit(0))


def segments(df: DataFrame, col: str, inclusive: bool = True) -> DataFrame:
    """One row for each segment, numbered from 0."""
    return df.select(*[c for c in df.columns if c != col], F.posexplode(split_segments(F.col(col), inclusive)).alias("pos", "segment"))


_IS_DELIMITER = np.isin(np.arange(1 << 16), [ord(c) for c in DELIMITERS])


def ranges_of(text: str, inclusive: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of a text's segments in UTF-16 units."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
    after = np.flatnonzero(_IS_DELIMITER[units]) + 1
    cuts = [after, [0, len(units)]] if inclusive else [after, after - 1, [0, len(units)]]
    edges = np.unique(np.concatenate(cuts)).astype(np.int32)
    return edges[:-1], np.diff(edges)


def segment_ranges(col: Column, inclusive: bool = True) -> Column:
    """array<struct<start,length>> in UTF-16 units; null stays null."""

    @arrow_udf("array<struct<start:int,length:int>>")
    def run(a: pa.Array) -> pa.Array:
        found = [ranges_of(x or "", inclusive) for x in a.to_pylist()]
        ends = np.cumsum([0, *(len(x[0]) for x in found)], dtype=np.int32)
        pairs = [pa.array(np.concatenate([x[i] for x in found]) if found else [], pa.int32()) for i in (0, 1)]
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(pairs, ["start", "length"]), mask=a.is_null())

    return run(col)


_PARTS = T.ArrayType(T.StructType([T.StructField("ids", T.BooleanType()), T.StructField("text", T.StringType())]))


@pandas_udf(_PARTS)
def ids_parts(s: pd.Series) -> pd.Series:
    """Description sequences and what lies between them."""
    return s.map(lambda t: [{"ids": a, "text": b} for a, b in ids_split(t)], na_action="ignore")


@pandas_udf(T.BooleanType())
def is_complete_ids(s: pd.Series) -> pd.Series:
    """Whether the whole text is one description sequence."""
    return s.map(lambda t: bool(t) and "⿰" <= t[0] <= "⿿" and ids_end(t, 0) == len(t), na_action="ignore")
