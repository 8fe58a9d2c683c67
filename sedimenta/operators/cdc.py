"""Change data: latest rows, change classes, and slowly changing dimensions of type 1 and 2.

Merges return the target's next state as a frame from one join on the key;
publishing it is one commit. A run's ``run_ts`` both closes and opens versions,
so the intervals of a key never overlap. Hashes are compared null-safely
everywhere: two null hashes are unchanged, a null and another one are changed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from ..functions.names import free_prefix
from .quality import duplicate_keys


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by ``order``, nulls last.

    Spark limits each task to its own best row of a key before the shuffle, so
    a hot key costs no more than a cold one.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    row = f"{free_prefix(df.columns)}row"
    return df.withColumn(row, F.row_number().over(w)).where(F.col(row) == 1).drop(row)


def _sides(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, StructType]:
    """Both sides' rows as structs of all columns, full outer joined on the key."""
    names = {f.name: f for f in [*target.schema, *source.schema][::-1]}
    schema = StructType([StructField(f.name, names[f.name].dataType) for f in [*target.schema, *[g for g in source.schema if g.name not in target.columns]]])

    def row(df: DataFrame, alias: str) -> DataFrame:
        cells = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
        return df.select(*[F.col(k).alias(f"{alias}_{i}") for i, k in enumerate(keys)], F.struct(*cells).alias(alias))

    on = [F.col(f"t_{i}") == F.col(f"s_{i}") for i in range(len(keys))]
    return row(target, "t").join(row(source, "s"), on, "full_outer").select("t", "s"), schema


def _unique(source: DataFrame, keys: Sequence[str]) -> None:
    if not duplicate_keys(source, keys).isEmpty():
        raise ValueError(f"the merge source repeats a key of {list(keys)}")


def classify_changes(current: DataFrame, source: DataFrame, keys: Sequence[str], hash_col: str = "_record_hash") -> DataFrame:
    """``source`` with ``change``: new, changed or unchanged against the current versions.

    ``current`` may be a whole history; rows that are not ``is_current`` are left out.
    """
    own = free_prefix([*current.columns, *source.columns])
    held = current.where("is_current").select(*[F.col(k).alias(f"{own}{i}") for i, k in enumerate(keys)], F.col(hash_col).alias(f"{own}hash"), F.lit(True).alias(f"{own}held"))
    on = [F.col(k) == F.col(f"{own}{i}") for i, k in enumerate(keys)]
    change = F.when(F.col(f"{own}held").isNull(), "new").when(~F.col(hash_col).eqNullSafe(F.col(f"{own}hash")), "changed").otherwise("unchanged")
    return source.join(held, on, "left").withColumn("change", change).drop(*[c for c in held.columns])


def scd1_merge(target: DataFrame, source: DataFrame, keys: Sequence[str], hash_col: str = "_record_hash", keep: Sequence[str] = ("silver_created_at",), checked: bool = False) -> DataFrame:
    """The target after an upsert.

    Rows whose hash is unchanged, or that the source lacks, stay as they are;
    changed ones take the source's columns but for ``keep``; new ones are
    added. Columns of either side alone are null in the other's rows. A source
    that repeats a key raises before anything is computed, unless it has been
    ``checked`` before, as ``Table.merge`` does.
    """
    if not checked:
        _unique(source, keys)
    both, schema = _sides(target, source, keys)
    t, s = F.col("t"), F.col("s")
    stays = s.isNull() | (t.isNotNull() & t[hash_col].eqNullSafe(s[hash_col]))
    cells = []
    for f in schema:
        new = F.when(t.isNotNull(), t[f.name]).otherwise(s[f.name]) if f.name in keep else s[f.name]
        cells.append(F.when(stays, t[f.name]).otherwise(new).alias(f.name))
    return both.select(*cells)


def scd2_step(current: DataFrame, source: DataFrame, keys: Sequence[str], hash_col: str = "_record_hash", run_ts: Column | None = None, touch: Sequence[str] = ("silver_updated_at",), checked: bool = False) -> DataFrame:
    """What follows the ``current`` rows of a history after a wave of ``source``: closed rows and current ones.

    A changed key's row is closed at ``run_ts`` and followed by one that is
    valid from then on; ``touch`` columns of a closed row are set to ``run_ts``
    too. Unchanged keys, and keys the source lacks, stay current. ``source``
    has no ``valid_from``, ``valid_to`` and ``is_current``; see ``scd1_merge``
    for ``checked``. Closed versions of the history take no part.
    """
    if not checked:
        _unique(source, keys)
    ts = F.current_timestamp() if run_ts is None else run_ts
    types = {f.name: f.dataType for f in current.schema}
    opened = source.select("*", ts.cast(types["valid_from"]).alias("valid_from"), F.lit(None).cast(types["valid_to"]).alias("valid_to"), F.lit(True).alias("is_current"))
    both, schema = _sides(current, opened, keys)
    t, s = F.col("t"), F.col("s")
    changed = s.isNotNull() & t.isNotNull() & ~t[hash_col].eqNullSafe(s[hash_col])
    stamp = {"valid_to": ts, "is_current": F.lit(False)} | {c: ts for c in touch if c in types}
    closed = F.struct(*[(stamp[f.name].cast(f.dataType) if f.name in stamp else t[f.name]).alias(f.name) for f in schema])
    rows = F.filter(F.array(F.when(changed, closed).otherwise(t), F.when(changed | t.isNull(), s)), lambda r: r.isNotNull())
    return both.select(F.explode(rows).alias("r")).select("r.*")


def scd2_merge(history: DataFrame, source: DataFrame, keys: Sequence[str], **how) -> DataFrame:
    """The whole history after a wave: ``scd2_step`` of its current rows, beside the closed ones, which it does not shuffle.

    A ``Table`` with ``current="is_current"`` merges ``scd2_step`` instead, and leaves closed rows where they are.
    """
    merged = scd2_step(history.where("is_current"), source, keys, **how)
    return history.where("NOT is_current").unionByName(merged, allowMissingColumns=True)
