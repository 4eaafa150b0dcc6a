"""Relevance of pages to outcomes over an inverted index, and matching of topics to texts.

The pages are the large side.  Their postings (token, page, count) meet the
outcomes' terms on the token, so no outcome is compared with a page it shares
no token with.  The terms of up to ``FEW_OUTCOMES`` outcomes go to the pages,
which are scored where they lie, so many pages at once as ``CELLS`` and
``HITS`` allow; those of more meet them by shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kavak.functions.text import bare_words, bigrams, let, search_tokens, source_tokens
from kavak.operators.matching import contained
from kavak.operators.ranking import top_k
from kavak.plans.lineage import written

# The weights of the relevance score.
WEIGHT_TITLE, WEIGHT_THEME, WEIGHT_FRAMEWORK = 8.0, 0.5, 0.15
WEIGHT_BIGRAM = 12.0
AFFINE, NOT_AFFINE, SINGLE_HIT, HIT_BONUS, MOST_BONUS_HITS, TF_BONUS, MOST_TF = 1.20, 0.82, 0.55, 0.08, 5, 0.15, 3
#: Outcomes up to this number (some ten terms each) are sent to all workers.
FEW_OUTCOMES = 20_000
#: Pairs of a page and an outcome, and terms of them, that a task sums up at once.
CELLS, HITS = 1_000_000, 2_000_000


def page_tokens(pages: DataFrame, keys: Sequence[str], text: Column) -> DataFrame:
    """``(keys, tokens)``: each page's search tokens in order, made once and laid out by page in the shared folder."""
    return written(pages.select(*keys, search_tokens(text).alias("tokens")), "tokens")


def postings(tokens: DataFrame, keys: Sequence[str], pairs: bool = False) -> DataFrame:
    """``(keys, token, tf)`` of :func:`page_tokens`; with ``pairs`` also the distinct neighbours of each page row, joined by a blank.

    A page without tokens has none.  Whole pages are laid out by page before
    their tokens are, so neither these nor sums over them need a shuffle.
    """
    terms = F.concat("tokens", F.array_distinct(bigrams(F.col("tokens")))) if pairs else F.col("tokens")
    return tokens.repartition(*keys).select(*keys, F.explode(terms).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("tf"))


def document_frequency(post: DataFrame) -> DataFrame:
    """``(token, df)``: in how many pages a token stands."""
    return post.groupBy("token").agg(F.count("*").alias("df"))


def _merged(tokens: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """(:func:`page_tokens` with one row for each page, pages); tokens of repeated pages are parted by an empty one."""
    n_pages = tokens.select(*keys).distinct().count()
    if n_pages < tokens.count():
        parted = F.concat("tokens", F.array(F.lit("")))
        tokens = written(tokens.groupBy(*keys).agg(F.flatten(F.collect_list(parted)).alias("tokens")), "merged")
    return tokens, n_pages


def _sums(sought: pa.Table, keys: Sequence[str], best: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` over one row for each page: what its pairs with outcomes sum up to.

    ``sought`` has ``token, outcome_id, grade, worth, in_title, pair``.  With
    ``best``, pairs are left out that so many others of the outcome, seen in
    the same task, exceed whether or not their pages are affine.
    """
    pair = np.asarray(sought["pair"]) > 0
    words = pc.unique(sought["token"].filter(pa.array(~pair)))
    owners = sought.select(["outcome_id", "grade"]).group_by(["outcome_id", "grade"]).aggregate([])
    each = lambda rows: zip(rows["outcome_id"].to_pylist(), rows["grade"].to_pylist())
    number = {o: i for i, o in enumerate(each(owners))}
    owner = np.array([number[o] for o in each(sought)], np.int64)
    n_words, n_owners = len(words), len(number)
    # a pair's term: the numbers of its two words; a pair with a word that no page has is in no page
    word = lambda x: pc.fill_null(pc.index_in(pa.array(x, words.type), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    tokens = np.array(sought["token"].to_pylist(), object)
    term = np.full(len(tokens), -1, np.int64)
    term[~pair] = word(tokens[~pair].tolist())
    first, second = (word([t.split(" ")[i] for t in tokens[pair].tolist()]) for i in (0, 1))
    codes = np.where((first >= 0) & (second >= 0), first * n_words + second, -1)
    neighbours = np.unique(codes[codes >= 0])
    term[pair] = np.where(codes >= 0, n_words + np.searchsorted(neighbours, codes), -1)
    order = np.argsort(term, kind="stable")
    order = order[term[order] >= 0]
    starts = np.searchsorted(term[order], np.arange(n_words + len(neighbours) + 1))
    owner, worth = owner[order], np.asarray(sought["worth"], np.float64)[order]
    # both counts in one number
    counts = (np.asarray(sought["in_title"], np.float64) + (1 << 20) * pair)[order]
    outcome_ids, grades = (owners[c].combine_chunks() for c in ("outcome_id", "grade"))

    def postings_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(page, term, how often) by page."""
        lens = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        found = pc.fill_null(pc.index_in(column.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        page = np.repeat(np.arange(len(lens)), lens)
        there = np.flatnonzero(found >= 0)
        n_terms = n_words + len(neighbours)
        single, n = np.unique(page[there] * n_terms + found[there], return_counts=True)
        left = there[:-1][np.diff(there) == 1]
        left = left[page[left] == page[left + 1]]
        code = found[left] * n_words + found[left + 1]
        if len(neighbours):
            at = np.minimum(np.searchsorted(neighbours, code), len(neighbours) - 1)
            hit = neighbours[at] == code
            both = np.unique(page[left[hit]] * n_terms + n_words + at[hit])
            single, n = np.concatenate((single, both)), np.concatenate((n, np.ones(len(both), n.dtype)))
            by_page = np.argsort(single)
            single, n = single[by_page], n[by_page]
        return single // n_terms, single % n_terms, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.full((best or 0, n_owners), -np.inf)
        for batch in batches if n_owners else ():
            page, t, n = postings_of(batch.column(len(keys)))
            tf = 1 + TF_BONUS * (np.minimum(n, MOST_TF) - 1)
            many = starts[t + 1] - starts[t]
            by_page = np.searchsorted(page, np.arange(batch.num_rows + 1))
            total = np.concatenate(([0], np.cumsum(many)))[by_page]
            at = 0
            while at < batch.num_rows:
                to = min(int(np.searchsorted(total, total[at] + HITS, "right")) - 1, at + CELLS // n_owners)
                to = min(max(to, at + 1), batch.num_rows)
                x = slice(by_page[at], by_page[to])
                rep = many[x]
                entry = np.repeat(starts[t[x]] - (np.cumsum(rep) - rep), rep) + np.arange(int(rep.sum()))
                cell = np.repeat((page[x] - at) * n_owners, rep) + owner[entry]
                shape = (to - at, n_owners)
                base = np.bincount(cell, worth[entry] * np.repeat(tf[x], rep), shape[0] * n_owners).astype(np.float64).reshape(shape)  # of nothing, numpy gives whole numbers
                count = np.bincount(cell, counts[entry], shape[0] * n_owners).astype(np.int64).reshape(shape)
                title, pairs = count & ((1 << 20) - 1), count >> 20
                kept = title > 0
                if best:
                    s = (base + WEIGHT_BIGRAM * pairs) * np.where((title == 1) & (pairs == 0), SINGLE_HIT, 1.0) * (1 + np.minimum(title, MOST_BONUS_HITS) * HIT_BONUS)
                    low = np.where(kept, s * min(AFFINE, NOT_AFFINE), -np.inf)
                    top = np.concatenate((held, low if len(low) <= best else np.partition(low, -best, axis=0)[-best:]))
                    held = np.partition(top, -best, axis=0)[-best:]
                    # scores are rounded to six places before they are compared
                    kept &= s * max(AFFINE, NOT_AFFINE) >= held.min(axis=0) - 2e-6
                rows, owners_kept = np.nonzero(kept)
                where, whose = pa.array(rows + at), pa.array(owners_kept)
                yield pa.RecordBatch.from_arrays(
                    [outcome_ids.take(whose), grades.take(whose), *(batch.column(k).take(where) for k in range(len(keys))), pa.array(base[kept]), pa.array(title[kept]), pa.array(pairs[kept])],
                    ["outcome_id", "grade", *keys, "base", "title_hits", "bigram_hits"],
                )
                at = to

    return run


def page_scores(outcomes: DataFrame, pages: DataFrame, page_keys: Sequence[str], text: Column, affine: Column, best: int | None = None) -> DataFrame:
    """Scores of outcome-page pairs that share a token of the outcome's title.

    ``outcomes`` has ``outcome_id, grade, title, theme, framework`` (null
    texts are empty), one row each.  ``affine`` is a boolean over the outcome's
    and page's columns.  Gives ``outcome_id``, the page keys, ``score`` (six
    places), ``title_hits``, ``bigram_hits`` and ``affine``.  Repeated pages
    (equal keys) count as one page of all their tokens.  With ``best``, pairs
    may be absent that can't be among so many best of their outcome: all that
    are, and all that tie with them, are there.
    """
    outcomes = written(outcomes.select("outcome_id", "grade", "title", "theme", "framework"), "outcomes")
    tokens, n_pages = _merged(page_tokens(pages, page_keys, text), page_keys)
    df = tokens.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    fields = [("title", WEIGHT_TITLE), ("theme", WEIGHT_THEME), ("framework", WEIGHT_FRAMEWORK)]
    term = None
    for name, weight in fields:
        part = outcomes.select("outcome_id", "grade", F.lit(name).alias("field"), F.lit(weight).alias("weight"), F.explode(F.array_distinct(search_tokens(F.col(name)))).alias("token"))
        term = part if term is None else term.union(part)
    idf = F.log((F.lit(n_pages) + 1) / (F.col("df") + 1)) + 1
    # a token of several fields is one row of their worths; a pair of title tokens is a term of its own
    weighted = term.join(df, "token").groupBy("token", "outcome_id", "grade").agg(F.sum(F.col("weight") * idf).alias("worth"), F.count_if(F.col("field") == "title").alias("in_title"), F.lit(0).cast("long").alias("pair"))
    pair = F.explode(F.array_distinct(bigrams(F.array_distinct(search_tokens(F.col("title"))))))
    sought = weighted.union(outcomes.select(pair.alias("token"), "outcome_id", "grade", F.lit(0.0), F.lit(0).cast("long"), F.lit(1).cast("long")))
    # a bounded list of outcomes goes to all pages; a longer one meets them by shuffle
    if outcomes.limit(FEW_OUTCOMES + 1).count() <= FEW_OUTCOMES:
        own = [outcomes.schema["outcome_id"], outcomes.schema["grade"], *(tokens.schema[k] for k in page_keys)]
        sums = [T.StructField("base", T.DoubleType()), T.StructField("title_hits", T.LongType()), T.StructField("bigram_hits", T.LongType())]
        both = tokens.select(*page_keys, "tokens").mapInArrow(_sums(sought.toArrow(), page_keys, best), T.StructType([*own, *sums]))
    else:
        tf = 1 + TF_BONUS * (F.least(F.col("tf"), F.lit(MOST_TF)) - 1)
        both = (
            postings(tokens, page_keys, pairs=True).join(sought, "token").groupBy("outcome_id", "grade", *page_keys)
            .agg(F.sum(F.col("worth") * tf).alias("base"), F.sum("in_title").alias("title_hits"), F.sum("pair").alias("bigram_hits"))
            .filter(F.col("title_hits") > 0)
        )
    score = (F.col("base") + WEIGHT_BIGRAM * F.col("bigram_hits")) * F.when(affine, AFFINE).otherwise(NOT_AFFINE)
    score = score * F.when((F.col("title_hits") == 1) & (F.col("bigram_hits") == 0), SINGLE_HIT).otherwise(1.0)
    score = score * (1 + F.least(F.col("title_hits"), F.lit(MOST_BONUS_HITS)) * HIT_BONUS)
    return both.select("outcome_id", *page_keys, F.round(score, 6).alias("score"), "title_hits", "bigram_hits", F.coalesce(affine, F.lit(False)).alias("affine"))


def best_pages(scores: DataFrame, page_keys: Sequence[str], k: int = 8) -> DataFrame:
    """The ``k`` best pages of each outcome by (score descending, page keys)."""
    return top_k(scores, ["outcome_id"], [F.desc("score"), *map(F.col, page_keys)], k)


def candidate_status(best: DataFrame) -> DataFrame:
    """``(outcome_id, status, margin)`` from the best two pages of each outcome."""
    two = best.filter(F.col("rank") <= 2).groupBy("outcome_id").agg(
        F.max(F.when(F.col("rank") == 1, F.struct("score", "title_hits", "bigram_hits", "affine"))).alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second")
    )
    margin = F.round(F.col("top.score") - F.coalesce("second", F.lit(0.0)), 6)
    strong = (F.col("top.title_hits") >= 2) & ((F.col("top.bigram_hits") >= 1) | (F.col("top.title_hits") >= 3)) & (margin >= 2.0) & F.col("top.affine")
    status = F.when(strong, "STRONG_CANDIDATE").when(F.col("top.title_hits") >= 1, "REVIEW_REQUIRED").otherwise("WEAK_CANDIDATE")
    return two.select("outcome_id", status.alias("status"), margin.alias("margin"))


def topic_terms(topic: Column, subtopics: Column) -> Column:
    """What :func:`topic_page_score` looks for: a struct to be made once a topic."""
    subs = F.filter(F.coalesce(subtopics, F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    parts = F.transform(subs, lambda x: F.struct(bare_words(x).alias("phrase"), source_tokens(x).alias("words")))
    return F.struct(bare_words(topic).alias("name"), source_tokens(topic).alias("tokens"), parts.alias("parts"))


def topic_page_score(text: Column, topic: Column, subtopics: Column, sibling_hits: Column | None = None, page_words: Column | None = None, terms: Column | None = None) -> Column:
    """Struct (score, support) of a page for a topic and its subtopics by contained phrases and tokens.

    Under 120 signs: -1000 and 0.  Null subtopics are none; null text is empty.
    ``page_words`` is the text's :func:`bare_words` and ``terms`` the topic's
    :func:`topic_terms`, if they are at hand.
    """
    raw = F.coalesce(text, F.lit(""))
    terms = topic_terms(topic, subtopics) if terms is None else terms
    name, tokens, parts = terms["name"], terms["tokens"], terms["parts"]
    nothing = F.struct(F.lit(0).alias("s"), F.lit(0).alias("h"))

    def one(page: Column, part: Column) -> Column:
        found = lambda n: F.when((n >= 2) & (n / F.size(part["words"]) >= 0.5), F.struct((18 + n * 4).alias("s"), F.lit(1).alias("h"))).otherwise(nothing)
        whole = (part["phrase"] != "") & F.contains(page, part["phrase"])
        return F.when(whole, F.struct(F.lit(45).alias("s"), F.lit(2).alias("h"))).otherwise(let(F.size(F.filter(part["words"], lambda t: F.contains(page, t))), found))

    def judged(page: Column) -> Column:
        return F.struct(
            ((name != "") & F.contains(page, name)).alias("named"),
            F.size(F.filter(tokens, lambda t: F.contains(page, t))).alias("hits"),
            F.aggregate(F.transform(parts, lambda x: one(page, x)), nothing, lambda a, x: F.struct((a["s"] + x["s"]).alias("s"), (a["h"] + x["h"]).alias("h"))).alias("subs"),
            F.contains(page, F.lit("icindekiler")).alias("listing"),
        )

    short = F.length(F.trim(raw)) < 120

    def score(j: Column) -> Column:
        points = F.when(j["named"], 140).otherwise(0) + j["hits"] * 10 + j["subs"]["s"] + F.when(j["listing"], -300).otherwise(0) + F.when(F.length(raw) >= 700, 8).otherwise(0)
        if sibling_hits is not None:
            points = points + F.when(sibling_hits >= 5, -220).otherwise(0)
        support = F.when(j["named"], 2).otherwise(0) + j["hits"] + j["subs"]["h"]
        return F.struct(F.when(short, -1000).otherwise(points).cast("int").alias("score"), F.when(short, 0).otherwise(support).cast("int").alias("support"))

    return let(let(bare_words(raw) if page_words is None else page_words, judged), score)


def topic_page_sums(pages: DataFrame, id: str, text: str, topics: DataFrame, key: str, topic: str, subtopics: str) -> DataFrame:
    """``(key, id, score, support)`` as :func:`topic_page_score` has it, for the pages that hold any name, phrase or word of a topic.

    What is sought is found in each page once, whichever topics seek it, and
    the points are summed by topic and page; no text meets a topic.  A page
    that holds five names of the list loses points, as contents lists do.
    Phrases of fewer than three signs aren't sought.  Null texts are left out.
    """
    t = topics.select(F.col(key).alias("k"), topic_terms(F.col(topic), F.col(subtopics)).alias("t"))
    one = lambda role, part, piece, n: F.struct(F.lit(role).alias("role"), part.cast("int").alias("part"), piece.alias("piece"), n.cast("int").alias("n"))
    none = F.lit(-1)
    names = F.array(one("name", none, F.col("t.name"), none))
    words = F.transform("t.tokens", lambda x: one("word", none, x, none))
    phrases = F.transform("t.parts", lambda x, i: one("phrase", i, x["phrase"], none))
    pieces = F.flatten(F.transform("t.parts", lambda x, i: F.transform(x["words"], lambda w: one("piece", i, w, F.size(x["words"])))))
    sought = t.select("k", F.explode(F.concat(names, words, phrases, pieces)).alias("x")).select("k", "x.*").filter(F.length("piece") >= 3)
    texts = pages.filter(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"))
    texts = texts.withColumn("short", F.length(F.trim("text")) < 120).withColumn("long", F.length("text") >= 700)
    found = contained(texts, "id", "text", sought.select("piece").distinct(), "piece", lambda c: bare_words(c)).select("id", "piece")
    facts = texts.select("id", "short", "long", F.contains(bare_words(F.col("text")), F.lit("icindekiler")).alias("listing"))
    hits = found.join(F.broadcast(sought) if sought.limit(FEW_OUTCOMES + 1).count() <= FEW_OUTCOMES else sought, "piece")
    whole = F.col("role") == "phrase"
    by_part = hits.groupBy("id", "k", F.when(F.col("role").isin("phrase", "piece"), F.col("part")).otherwise(F.lit(-1)).alias("part")).agg(
        F.max(F.col("role") == "name").alias("named"), F.count_if(F.col("role") == "word").alias("words"), F.max(whole).alias("whole"), F.count_if(F.col("role") == "piece").alias("pieces"), F.max("n").alias("n")
    )
    enough = (F.col("pieces") >= 2) & (F.col("pieces") / F.col("n") >= 0.5)
    points = F.when(F.col("part") < 0, F.when(F.col("named"), 140).otherwise(0) + F.col("words") * 10).otherwise(F.when(F.col("whole"), 45).when(enough, 18 + F.col("pieces") * 4).otherwise(0))
    support = F.when(F.col("part") < 0, F.when(F.col("named"), 2).otherwise(0) + F.col("words")).otherwise(F.when(F.col("whole"), 2).when(enough, 1).otherwise(0))
    sums = by_part.groupBy("id", "k").agg(F.sum(points).alias("points"), F.sum(support).alias("support"))
    titles = hits.filter("role = 'name'").groupBy("id").agg(F.countDistinct("k").alias("titles"))
    rows = sums.join(facts, "id").join(titles, "id", "left")
    score = F.col("points") + F.when(F.col("listing"), -300).otherwise(0) + F.when(F.col("long"), 8).otherwise(0) + F.when(F.col("titles") >= 5, -220).otherwise(0)
    return rows.select(F.col("k").alias(key), F.col("id").alias(id), F.when(F.col("short"), -1000).otherwise(score).cast("int").alias("score"), F.when(F.col("short"), 0).otherwise(F.col("support")).cast("int").alias("support"))


def excerpts(pages: DataFrame, id: str, text: str, phrases: Column, tokens: Column, most: int = 6000, keep: int = 8, before: int = 4, after: int = 8) -> DataFrame:
    """``(id, excerpt)``: a long text's lines around its ``keep`` best ones, in order, cut at ``most`` signs; short texts whole.

    A line scores 20 if it holds a phrase of five signs or more, and 2 for each
    token in it.  ``phrases`` and ``tokens`` are arrays over the page's columns.
    """
    base = pages.select(F.col(id).alias("id"), F.trim(F.coalesce(F.col(text), F.lit(""))).alias("t"), phrases.alias("ph"), tokens.alias("tk"))
    lines = F.filter(F.transform(F.split("t", "\\R"), lambda x: F.trim(x)), lambda x: x != "")
    long = base.filter(F.length("t") > most).withColumn("lines", lines).withColumn("n", F.size("lines"))
    line = long.select("id", "ph", "tk", F.posexplode("lines").alias("i", "line"))
    points = lambda norm: F.when(F.exists("ph", lambda p: (F.length(p) >= 5) & F.contains(norm, p)), 20).otherwise(0) + 2 * F.size(F.filter("tk", lambda t: F.contains(norm, t)))
    score = let(bare_words(F.col("line")), points)
    best = top_k(line.select("id", "i", score.alias("s")).filter("s > 0"), ["id"], [F.desc("s"), F.col("i")], keep)
    wanted = best.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("i") - before, F.col("i") + after))))).alias("at"))
    cut = long.join(wanted, "id", "left").select(
        "id",
        F.when(F.col("at").isNull(), F.left("t", F.lit(most))).otherwise(
            F.trim(F.left(F.array_join(F.transform(F.filter("at", lambda i: (i >= 0) & (i < F.col("n"))), lambda i: F.get("lines", i)), "\n"), F.lit(most)))
        ).alias("excerpt"),
    )
    return base.filter(F.length("t") <= most).select("id", F.col("t").alias("excerpt")).union(cut).withColumnRenamed("id", id)


def within_budget(rows: DataFrame, key: str, text: str, score: str, place: str, most_signs: int = 5200, most_rows: int = 14) -> DataFrame:
    """Greedy choice of a key's texts by score under a budget of signs and rows, back in source order.

    The first is always kept; one that would exceed the budget is passed over
    and smaller ones after it still enter.  Repeated texts count once (first
    place).  A key's texts are folded in one row; keep them bounded per key.
    """
    once = rows.groupBy(key, text).agg(F.min(place).alias(place), F.max(score).alias(score))
    item = F.struct((-F.col(score)).alias("o"), F.col(place).alias("p"), F.length(text).alias("n"), F.col(text).alias("t"))
    start = F.struct(F.lit(0).alias("signs"), F.expr("cast(array() as array<int>)").alias("places"))

    def take(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["places"]) == 0) | ((acc["signs"] + x["n"] <= most_signs) & (F.size(acc["places"]) < most_rows))
        return F.when(fits, F.struct((acc["signs"] + x["n"]).alias("signs"), F.concat(acc["places"], F.array(x["p"].cast("int"))).alias("places"))).otherwise(acc)

    kept = once.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items")).withColumn("kept", F.aggregate("items", start, take, lambda a: a["places"]))
    chosen = kept.select(key, F.array_sort(F.transform(F.filter("items", lambda x: F.array_contains(F.col("kept"), x["p"].cast("int"))), lambda x: F.struct(x["p"].alias("p"), x["t"].alias("t")))).alias("c"))
    return chosen.select(key, F.size("c").alias("n_chunks"), F.array_join(F.transform("c", lambda x: x["t"]), "\n").alias("answer"))

