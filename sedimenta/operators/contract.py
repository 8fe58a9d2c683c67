"""Schema contracts: allowed columns, types, required fields, approved evolutions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: Type changes that lose nothing.
WIDENINGS = {("int", "bigint"), ("smallint", "int"), ("smallint", "bigint"), ("float", "double"), ("int", "double"), ("date", "timestamp_ntz")}


class ContractError(ValueError):
    """A frame does not meet the contract; nothing was written."""


def schema_diff(old: StructType, new: StructType) -> dict[str, list[str]]:
    """Names that were added, that are missing, and whose types differ."""
    a, b = {f.name: f.dataType for f in old}, {f.name: f.dataType for f in new}
    return {"added": [x for x in b if x not in a], "missing": [x for x in a if x not in b], "changed": [x for x in b if x in a and a[x].simpleString() != b[x].simpleString()]}


def check_same(old: StructType, new: StructType) -> None:
    diff = schema_diff(old, new)
    if diff["added"] or diff["changed"]:
        raise ContractError(f"unexpected columns {diff['added']}, changed types {diff['changed']}")


def widened_schema(old: StructType, new: StructType) -> StructType:
    """``old`` with the columns that ``new`` adds; changed types are rejected."""
    diff = schema_diff(old, new)
    if diff["changed"]:
        raise ContractError(f"changed types {diff['changed']}")
    return StructType([*old, *[f for f in new if f.name in diff["added"]]])


@dataclass(frozen=True)
class Contract:
    """What producers and consumers of a table have agreed on."""

    schema: StructType
    required: tuple[str, ...] = ()
    owner: str = ""
    approved: tuple[str, ...] = ()  # columns that may be added
    notes: dict[str, str] = field(default_factory=dict)

    def check(self, df: DataFrame) -> None:
        """Raises unless ``df`` has only agreed or approved columns, of the agreed types, and all required ones."""
        diff = schema_diff(self.schema, df.schema)
        extra = [x for x in diff["added"] if x not in self.approved]
        absent = [x for x in self.required if x not in df.columns]
        if extra or diff["changed"] or absent:
            raise ContractError(f"unexpected {extra}, changed types {diff['changed']}, required but missing {absent}")

    def violations(self, df: DataFrame) -> DataFrame:
        """One row: how many rows have a null in each required field."""
        return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in self.required])


def check_contract(contract: Contract, df: DataFrame) -> DataFrame:
    contract.check(df)
    return df


def widen_column(df: DataFrame, name: str, to: str) -> DataFrame:
    """``name`` cast to a wider type; any other change is rejected."""
    now: DataType = df.schema[name].dataType
    if (now.simpleString(), to) not in WIDENINGS:
        raise ContractError(f"{name}: {now.simpleString()} does not widen to {to}")
    return df.withColumn(name, F.col(name).cast(to))


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    if old not in df.columns or new in df.columns:
        raise ContractError(f"cannot rename {old} to {new}")
    return df.withColumnRenamed(old, new)


def drop_column(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        raise ContractError(f"no column {name}")
    return df.drop(name)
