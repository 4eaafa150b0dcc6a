"""Theta and fuzzy matches of short texts to a list of names, made equi joins on tokens or words.

No text is compared with every name: a name can only stand in a text if its
first three signs do, so names and texts meet on three-sign pieces, and only
then is containment tested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kavak.functions.text import let, question_tokens
from kavak.operators.ranking import first_wins, unique_best
#: Names up to this number are sent to all workers.
FEW_NAMES = 20_000


def contained(texts: DataFrame, id: str, text: str, names: DataFrame, name: str, norm) -> DataFrame:
    """``(id, name columns)`` of every name that stands somewhere in a text, both put through ``norm``.

    Names meet texts on three-sign pieces: the text's distinct pieces against
    the name's first piece; names shorter than three signs never match.  Null
    texts and empty names don't take part.
    """
    t = texts.select(F.col(id).alias("_id"), norm(F.col(text)).alias("_text")).filter(F.col("_text").isNotNull())
    n = names.withColumn("_norm", norm(F.col(name))).filter(F.length("_norm") >= 3).withColumn("_piece", F.substring("_norm", 1, 3))
    cut = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit("(?s)(?=(...))"), F.lit(1)))
    out = [F.col("_id").alias(id), *names.columns, F.length("_norm").alias("matched")]
    if n.limit(FEW_NAMES + 1).count() <= FEW_NAMES:
        # a bounded list goes to all texts, which stay where they are
        return t.withColumn("_piece", F.explode(let(F.col("_text"), cut))).join(F.broadcast(n), "_piece").filter(F.contains("_text", F.col("_norm"))).select(*out)
    # else pieces meet without the texts, and the texts come back for the pairs met
    met = t.select("_id", F.explode(let(F.col("_text"), cut)).alias("_piece")).join(n, "_piece")
    return met.join(t, "_id").filter(F.contains("_text", F.col("_norm"))).distinct().select(*out)


def longest_contained(texts: DataFrame, id: str, text: str, names: DataFrame, name: str, place: str, norm) -> DataFrame:
    """The longest contained name of each text, the first in ``place`` order on ties."""
    return first_wins(contained(texts, id, text, names, name, norm), [id], [-F.col("matched"), F.col(place)])


def longest_unique(texts: DataFrame, id: str, text: str, names: DataFrame, name: str, norm) -> DataFrame:
    """The longest contained name of each text; none where two names of that length stand in it."""
    return unique_best(contained(texts, id, text, names.dropDuplicates([name]), name, norm), [id], "matched")


def first_keyword(texts: DataFrame, id: str, text: str, keywords: DataFrame, keyword: str, label: str, place: str, norm) -> DataFrame:
    """The label of the first group (by ``place``) with any keyword in the text."""
    return first_wins(contained(texts, id, text, keywords, keyword, norm), [id], [F.col(place)]).select(id, label)


def overlap_matches(texts: DataFrame, id: str, text: str, units: DataFrame, unit: str, topic: str, whole: Column | None = None, least: int = 4, share: float = 0.60) -> DataFrame:
    """``(id, unit, score)``: units whose topic stands in a text (10000) or shares enough of its tokens with it.

    Enough: ``least`` tokens and ``share`` of the topic's; the score is 100 for
    each shared token plus the whole per cents of the share.  Texts and units
    meet on tokens (inverted index), so pairs without a common token never
    form.  Use :func:`unique_best` on the result for the tie rule.
    """
    t = texts.select(F.col(id).alias("id"), question_tokens(F.col(text)).alias("tokens"), F.lower(F.trim(F.col(text))).alias("low"))
    u = units.select(F.col(unit).alias("unit"), question_tokens(F.col(topic)).alias("tokens"), F.lower(F.trim(F.col(topic))).alias("low"))
    shared = (
        t.select("id", F.explode("tokens").alias("token"))
        .join(u.select("unit", F.explode("tokens").alias("token"), F.size("tokens").alias("n")), "token")
        .groupBy("id", "unit", "n")
        .agg(F.count("*").alias("overlap"))
    )
    enough = shared.filter((F.col("overlap") >= least) & (F.col("overlap") / F.col("n") >= share))
    scored = enough.select("id", "unit", (F.col("overlap") * 100 + F.floor(F.col("overlap") / F.col("n") * 100)).cast("long").alias("score"))
    held = contained(texts.select(F.col(id).alias("id"), F.col(text).alias("text")), "id", "text", units.select(F.col(unit).alias("unit"), F.col(topic).alias("topic")), "topic", lambda c: F.lower(F.trim(c)))
    both = held.select("id", "unit", F.lit(10_000).cast("long").alias("score")).union(scored)
    return both.groupBy("id", "unit").agg(F.max("score").alias("score")).withColumnRenamed("id", id).withColumnRenamed("unit", unit)


def share_matches(queue: DataFrame, keys: list[str], terms: Column, pages: DataFrame, group: list[str], page: str, page_terms: Column, k: int = 5) -> DataFrame:
    """The ``k`` pages of a queue row's group that hold most of its terms, pages without any included.

    ``group`` columns are on both sides.  Gives keys, page, ``score`` (share of
    the row's tokens, four places) and ``rank``.  Only the zero-score rows need
    pages that share nothing: they are the group's first ``k`` pages by number.
    """
    from kavak.operators.ranking import top_k

    q = queue.select(*keys, *group, F.array_distinct(terms).alias("terms"))
    p = pages.select(*group, page, F.array_distinct(page_terms).alias("terms"))
    hits = q.select(*keys, *group, F.explode("terms").alias("t"), F.size("terms").alias("n")).join(p.select(*group, page, F.explode("terms").alias("t")), [*group, "t"])
    scored = hits.groupBy(*keys, page).agg((F.count("*") / F.first("n")).alias("s")).select(*keys, page, F.round("s", 4).alias("score"))
    first = top_k(p.select(*group, page).distinct(), group, [F.col(page)], k, "_n").drop("_n")
    zero = q.select(*keys, *group).join(first, group).select(*keys, page, F.lit(0.0).alias("score"))
    both = scored.union(zero).groupBy(*keys, page).agg(F.max("score").alias("score"))
    return top_k(both, keys, [F.desc("score"), F.col(page)], k)
