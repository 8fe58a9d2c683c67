"""Controlled change batches for demonstrations: repeats, a change, duplicates, a new column, a bad row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from ..operators.bronze import restamp, slice_keys


def make_change_batches(first: DataFrame, key: str, keys: Sequence[str], hashed: Sequence[str], names: Sequence[str], change: dict[str, Column], broken: dict[str, Column], added: dict[str, Column], repeats: int = 100, wider: int = 50) -> list[DataFrame]:
    """Three batches, called ``names``, after the stamped batch ``first``.

    The first repeats ``repeats`` keys, changes the first of them (``change``)
    and duplicates the second and third. The second repeats the next ``wider``
    keys with new columns (``added``), hashes inherited. The third is the key
    after those, with values that fail every rule (``broken``).
    """
    if len(keys) < repeats + wider + 1 or repeats < 3:
        raise ValueError(f"{repeats + wider + 1} keys are needed, and three to repeat")
    rows = lambda a, b: slice_keys(first, key, keys[a:b])
    again = restamp(rows(0, repeats), names[0], 2).unionByName(restamp(rows(0, 1), names[0], 3, change, hashed)).unionByName(restamp(rows(1, 3), names[0], 2))
    return [again, restamp(rows(repeats, repeats + wider), names[1], 4, added), restamp(rows(repeats + wider, repeats + wider + 1), names[2], 5, broken, hashed)]
