"""Embeddings as integer matrices, with products that are exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Components become floor(STEPS * x).
STEPS = 256.0


def integers(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix): the places of the usable vectors and their components as floor(256 * x), a row each.

    Usable is a vector of exactly ``dim`` components of which none is null, NaN or infinite. One whose squared distance
    to another could leave 63 bits (components beyond about 500,000 at 64 of them) is refused with an error.
    """
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)  # null: NaN
    rows = np.flatnonzero(lengths == dim)
    flat = vectors.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    values = np.asarray(flat, np.float64).reshape(len(rows), dim)
    whole = np.isfinite(values).all(axis=1)
    rows, values = rows[whole], np.floor(STEPS * values[whole])
    if len(values) and 4 * dim * float(np.abs(values).max()) ** 2 >= 2.0**62:
        raise ValueError("components are too large for distances of 63 bits")
    return rows, values.astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The integer matrix product a @ b.T; by floating point only where each partial sum is exact in it."""
    if a.size and b.size and a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T
