"""What the operators of this folder share with the library, and Arrow helpers."""

from __future__ import annotations

import pyarrow as pa

from runlens.shared import discard, materialize, prepare, salted_join, settled, shared_dir

__all__ = ["discard", "materialize", "prepare", "salted_join", "settled", "shared_dir", "utf8"]


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
