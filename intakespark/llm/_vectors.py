"""Vectors as integer units, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def integer_rows(lists: pa.Array, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, places, floor(scale * x) as int64 rows) of the vectors of a list<double> column, dimension by dimension.

    Null vectors and those with a null or non-finite component are left out. A component that does not fit 64 bits raises.
    """
    sizes = pc.list_value_length(lists).fill_null(-1).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes[sizes >= 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        x = lists.take(pa.array(at)).flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(at), dim)
        fine = np.isfinite(x).all(axis=1)
        units = np.floor(scale * x[fine])
        if np.abs(units).max(initial=0) >= 2.0**63:
            raise OverflowError(f"a component times {scale} does not fit 64 bits")
        if fine.any():
            yield dim, at[fine], units.astype(np.int64)


def narrow(v: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    for kind in (np.int8, np.int16, np.int32):
        if not v.size or (v.min() >= np.iinfo(kind).min and v.max() <= np.iinfo(kind).max):
            return v.astype(kind)
    return v
