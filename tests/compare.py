"""Frames as comparable rows."""


def rows_of(frame):
    """Rows of a pandas frame as comparable tuples, columns by name, in any order."""
    import numpy as np
    import pandas as pd

    def plain(v):
        if isinstance(v, (list, np.ndarray)):
            return tuple(map(plain, v))
        if hasattr(v, "item"):
            v = v.item()
        if v is None or v is pd.NA or v != v:
            return None
        return int(v) if isinstance(v, float) and abs(v) < 1e15 and v == int(v) else v

    cols = sorted(frame.columns)
    return cols, sorted(repr(tuple(plain(v) for v in r)) for r in frame[cols].astype(object).itertuples(index=False, name=None))
