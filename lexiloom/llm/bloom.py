"""A filter of fixed size for keys: which rows of a wide table can be meant, before they are shuffled.

The filter has ``BITS`` bits whatever the number of keys, so it may always be broadcast. It lets every key through that
was put in and, while it is far from full, few others. A full filter lets all through: what follows it decides exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26
HASHES = 3


def _places(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BITS)) for i in range(HASHES)]


def maybe_in(keys: DataFrame, column: str):
    """A function from a key column to whether it may be one of ``keys``. Null is no key."""
    place = keys.where(F.col(column).isNotNull()).select(F.explode(F.array(*_places(F.col(column)))).alias("p")).select((F.col("p") + 1).alias("p"))
    parts = place.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bits = np.zeros(BITS // 8, np.uint8)
    for row in parts.collect():  # BITS bits in all
        at = (row["b"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(row["bits"], np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def found(*places: pd.Series) -> pd.Series:
        out = np.ones(len(places[0]), bool)
        for place in places:
            p = place.to_numpy(np.int64)
            out &= shared.value[p >> 3] >> (p & 7).astype(np.uint8) & 1 == 1
        return pd.Series(out)

    return lambda key: key.isNotNull() & found(*_places(key))
