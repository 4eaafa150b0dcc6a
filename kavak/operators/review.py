"""Joins of reviewed records that fail closed: what has no partner, several partners or another hash is told, never dropped.

None of these decides anything; they carry given statuses from table to table
and say which rows don't fit together.  Keys are unique on both sides unless a
function says what it does with repeats; null keys find no partner.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kavak.functions.scalars import text_hash
from kavak.operators.gates import errors


def joined_or_told(left: DataFrame, right: DataFrame, keys: Sequence[str], told: str = "missing") -> DataFrame:
    """``left`` with the columns of ``right`` and ``error``: null, or ``told`` where the keys find nothing."""
    there = right.withColumn("_there", F.lit(True))
    out = left.join(there, list(keys), "left")
    return out.withColumn("error", F.when(F.col("_there").isNull(), told)).drop("_there")


def or_raise(rows: DataFrame, error: str = "error") -> DataFrame:
    """``rows`` as they are; the query ends with the first error found in them."""
    return rows.withColumn(error, F.when(F.col(error).isNotNull(), F.raise_error(F.concat(F.lit("record without partner: "), F.col(error)))).otherwise(F.lit(None).cast("string")))


def applied(queue: DataFrame, decisions: DataFrame, key: str, decision: str, absent: str = "PENDING", repeated: str = "REPEATED") -> DataFrame:
    """``queue`` with its decision: ``absent`` where there is none, ``repeated`` where there are several."""
    one = decisions.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), F.min(decision).alias(decision))
    given = F.when(F.col("_n") > 1, repeated).otherwise(F.coalesce(decision, F.lit(absent)))
    return queue.join(one, key, "left").withColumn(decision, given).drop("_n")


def unknown(decisions: DataFrame, queue: DataFrame, key: str) -> DataFrame:
    """Decisions about records that the queue lacks, null keys included."""
    return decisions.join(queue.select(key).distinct(), key, "left_anti")


def carried(results: DataFrame, originals: DataFrame, key: str, checks: Mapping[str, Column], passed: str = "READY", failed: str = "BLOCKED") -> DataFrame:
    """``results`` with their originals, the ``errors`` of checks over both, and ``status``.

    Without an original the one error is ``original``; the other checks need it.
    """
    both = results.join(originals.withColumn("_there", F.lit(True)), key, "left")
    found = F.when(F.col("_there").isNull(), F.array(F.lit("original"))).otherwise(errors(checks))
    out = both.withColumn("errors", found).drop("_there")
    return out.withColumn("status", F.when(F.size("errors") == 0, passed).otherwise(failed))


def reconciled(manifest: DataFrame, approved: DataFrame, key: str, held: str = "RELEASED", lost: str = "SUSPENDED") -> DataFrame:
    """``manifest`` with ``now``: ``held`` if its key is among the approved ones, else ``lost``."""
    known = approved.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_ok", F.lit(True))
    return manifest.join(known, key, "left").withColumn("now", F.when(F.col("_ok"), held).otherwise(lost)).drop("_ok")


def hash_checks(text: Column, *hashes: Column) -> dict[str, Column]:
    """Checks that a text's hash is each of the hashes told about it."""
    return {f"hash_{i}": h == text_hash(text) for i, h in enumerate(hashes, 1)}


def unique_checks(rows: DataFrame, keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(check, failed, total)``: for each set of columns how many rows repeat another's values; rows with a null there don't count."""
    out = None
    for name, columns in keys.items():
        there = F.lit(True)
        for c in columns:
            there = there & F.col(c).isNotNull()
        # counted by value first, so that a value which very many rows share is summed where it lies
        n = rows.filter(there).groupBy(*columns).agg(F.count("*").alias("n"))
        part = n.agg(F.lit(name).alias("check"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
        out = part if out is None else out.union(part)
    return out


def ladder(passed: Column, failed: Column, open_: Column) -> Column:
    """The state of a whole from the counts of its parts: FAIL, PASS, PASS_WITH_LIMITED_SCOPE or UNVERIFIED."""
    return F.when(failed > 0, "FAIL").when((passed > 0) & (open_ == 0), "PASS").when(passed > 0, "PASS_WITH_LIMITED_SCOPE").otherwise("UNVERIFIED")


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the columns' values, parted by a sign that stands in none; null and empty differ."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns)), 256)
