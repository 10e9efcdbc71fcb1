"""Condition blocks: map<operator, map<key, array<target>>> against a context map<key, array<value>>.

All operators and keys must hold; any target of a key will do, for negative operators too. A missing key fails, but
for ``IfExists``, ``Null`` and ``ForAllValues:``. Unknown operators fail.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatelens.functions.globs import glob_regex

NUMERIC = {
    "NumericEquals": lambda v, t: v == t,
    "NumericNotEquals": lambda v, t: v != t,
    "NumericLessThan": lambda v, t: v < t,
    "NumericLessThanEquals": lambda v, t: v <= t,
    "NumericGreaterThan": lambda v, t: v > t,
    "NumericGreaterThanEquals": lambda v, t: v >= t,
}


def _truth(x: Column) -> Column:
    return F.lower(x).isin("true", "1")


def holds(op: Column, value: Column, target: Column) -> Column:
    """One operator, one value, one target."""
    like = F.rlike(value, glob_regex(target))
    number = lambda x: x.try_cast("double")
    out = (
        F.when(op == "StringEquals", value == target)
        .when(op == "StringNotEquals", value != target)
        .when(op == "StringEqualsIgnoreCase", F.lower(value) == F.lower(target))
        .when(op == "StringNotEqualsIgnoreCase", F.lower(value) != F.lower(target))
        .when(op.isin("StringLike", "ArnLike"), like)
        .when(op.isin("StringNotLike", "ArnNotLike"), ~like)
        .when(op == "Bool", _truth(value) == _truth(target))
        .when(op == "ArnEquals", F.trim(value) == F.trim(target))
        .when(op == "ArnNotEquals", F.trim(value) != F.trim(target))
    )
    for name, test in NUMERIC.items():
        out = out.when(op == name, F.coalesce(test(number(value), number(target)), F.lit(False)))
    return F.coalesce(out.otherwise(F.lit(False)), F.lit(False))


def single(operator: Column, value: Column, targets: Column) -> Column:
    """One value, null if the key is missing, against any target."""
    if_exists = F.endswith(operator, F.lit("IfExists"))
    op = F.regexp_replace(operator, "IfExists$", "")
    null = F.exists(targets, lambda t: _truth(t) == value.isNull())
    return F.when(if_exists & value.isNull(), True).when(op == "Null", null).when(value.isNull(), False).otherwise(F.exists(targets, lambda t: holds(op, value, t)))


def block_holds(block: Column, context: Column) -> Column:
    """A null or empty block holds."""

    def key_holds(operator: Column, entry: Column) -> Column:
        values = F.try_element_at(context, entry["key"])
        core = F.regexp_replace(operator, "^(ForAnyValue|ForAllValues):", "")
        each = F.coalesce(values, F.expr("cast(array() as array<string>)"))
        return (
            F.when(F.startswith(operator, F.lit("ForAnyValue:")), F.exists(each, lambda v: single(core, v, entry["value"])))
            .when(F.startswith(operator, F.lit("ForAllValues:")), F.forall(each, lambda v: single(core, v, entry["value"])))
            .otherwise(single(operator, F.try_element_at(each, F.lit(1)), entry["value"]))
        )

    return F.coalesce(F.forall(F.map_entries(block), lambda o: F.forall(F.map_entries(o["value"]), lambda e: key_holds(o["key"], e))), F.lit(True))
