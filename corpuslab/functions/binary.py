"""Binary encodings that Spark has no built-in for (vectorized per Arrow batch)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as ST


@F.pandas_udf(ST.BinaryType())
def int32_le(tokens: pd.Series) -> pd.Series:
    """array<int> -> consecutive little-endian int32 bytes (the packed ``.bin`` record)."""
    return tokens.map(lambda x: None if x is None else np.asarray(x, dtype="<i4").tobytes())
