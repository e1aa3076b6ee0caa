"""Helpers of all tests."""

import os

DATA = os.environ.get("ORRERY_TESTDATA", "/root/testdata")


def canonical(frame):
    """Rows as sorted tuples with numbers in one form."""
    import numbers

    import numpy as np
    import pandas as pd

    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        return repr(float(v)) if isinstance(v, numbers.Real) and not isinstance(v, (bool, np.bool_)) else str(v)

    cols = sorted(frame.columns)
    return sorted(tuple(plain(v) for v in row) for row in frame[cols].itertuples(index=False))
