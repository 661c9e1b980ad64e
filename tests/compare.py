"""Order-insensitive comparison of two pandas frames."""

import numpy as np
import pandas as pd


def _cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
        return "null"
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    if isinstance(v, int | float | np.integer | np.floating):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(_cell(v) for v in r) for r in df[cols].itertuples(index=False))


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    ra, rb = rows(a), rows(b)
    assert len(ra) == len(rb)
    assert ra == rb
