"""References to records that are absent, deleted or written later.

A reference is a tuple of key columns, some of which may be null.  References
are grouped by their null mask, and each mask that occurs is anti-joined on its
non-null columns only, under the declared match semantics (as in SQL's MATCH):

* ``simple``: a reference with any null refers to nothing and is left out;
* ``partial``: the non-null columns must be found together in one record;
* ``full``: a reference has all its columns or none; mixed ones are ``mixed``.

What the anti-join leaves is missing; what it finds is judged by the records
found.  Records are reduced to one row for each key before the join (a partial
aggregate runs before the shuffle), so a key that very many records share costs
one row, and one that very many references share is split at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING, DELETED, LATE, MIXED, FOUND = "missing", "deleted", "late", "mixed", "found"
MATCHES = ("simple", "partial", "full")


def _present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def judged(references: DataFrame, keys: list[str], at: str, records: DataFrame, record_keys: list[str], created: str, deleted: str, match: str = "simple") -> DataFrame:
    """``references`` with a column ``kind``: found, missing, deleted, late or (``full`` only) mixed.

    Keys are strings as they compare; null and empty ones are null.  ``missing``:
    no record has the key.  ``deleted``: every record with it has ``deleted``.
    ``late``: the earliest ``created`` of its undeleted records is after the
    reference's ``at`` (never where either is null).  References that refer to
    nothing are left out; an empty record table makes every reference missing.
    Further columns of the references stay, those of the records don't enter.
    """
    if match not in MATCHES:
        raise ValueError(f"match is one of {', '.join(MATCHES)}")
    columns = references.columns
    bits = F.concat(*(F.when(_present(F.col(k)), "1").otherwise("0") for k in keys))
    full = "1" * len(keys)
    # one key has one mask; of several, those that occur (as many rows as there are masks at most)
    masks = [full] if len(keys) == 1 else sorted(r[0] for r in references.select(bits).distinct().collect())
    out = references.limit(0).withColumn("kind", F.lit(FOUND))
    for mask in masks:
        if "1" not in mask or (match == "simple" and mask != full):
            continue
        part = references.filter(bits == mask)
        if match == "full" and mask != full:
            out = out.unionByName(part.withColumn("kind", F.lit(MIXED)))
            continue
        used = [(k, r) for k, r, there in zip(keys, record_keys, mask) if there == "1"]
        held = records.filter(F.expr(" and ".join(f"`{r}` is not null and `{r}` <> ''" for _, r in used)))
        held = held.groupBy(*(F.col(r).alias(f"_key{i}") for i, (_, r) in enumerate(used))).agg(
            F.max(F.col(deleted).isNull()).alias("_alive"), F.min(F.when(F.col(deleted).isNull(), F.col(created))).alias("_first")
        )
        same = [F.col(k) == F.col(f"_key{i}") for i, (k, _) in enumerate(used)]
        missing = part.join(held, same, "left_anti").withColumn("kind", F.lit(MISSING))
        kind = F.when(~F.col("_alive"), DELETED).when(F.col("_first") > F.col(at), LATE).otherwise(FOUND)
        out = out.unionByName(missing).unionByName(part.join(held, same).withColumn("kind", kind).select(*columns, "kind"))
    return out


def orphans(references: DataFrame, name: str, id: str, key: list[str], at: str, records: DataFrame, record_key: list[str], created: str, deleted: str, match: str = "simple") -> DataFrame:
    """``(src_table, src_id, kind, period)`` of the references of table ``name`` that aren't found; repeated rows count once.

    ``period`` is the month of ``at``, null where that is null.
    """
    judged_rows = judged(references, key, at, records, record_key, created, deleted, match)
    return (
        judged_rows.filter(F.col("kind") != FOUND)
        .select(F.lit(name).alias("src_table"), F.col(id).cast("string").alias("src_id"), "kind", F.date_format(at, "yyyy-MM").alias("period"))
        .distinct()
    )
