"""Plans over outcomes, source pages, evidence and curriculum topics; each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kavak.functions import scalars as S
from kavak.functions import text as X
from kavak.operators import coverage, gates, matching, ranking, scoring
from kavak.plans.lineage import written
from kavak.sources.tables import spread, table

# Words that tell a subject, in the order in which subjects are tried.
KEYWORDS = (
    ("Biyoloji", "hücre"), ("Biyoloji", "enzim"), ("Biyoloji", "doku"), ("Tarih", "antlaşma"), ("Tarih", "beylik"), ("Tarih", "medrese"),
    ("Kimya", "çözelti"), ("Kimya", "tepkime"), ("Matematik", "polinom"), ("Matematik", "türev"),
)

#: Whose pages count as an official source.
AUTHORITY = "OKUL-YAYIN"
#: Numbers of pages (8 bytes each) that are sent to all workers; more meet the pages by shuffle.
FEW_PAGES = 60_000


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each learning outcome, its texts the least of its spellings."""
    rows = table(spark, folder, "evidence_records").filter(F.col("outcome_id").isNotNull())
    return rows.groupBy("outcome_id").agg(F.min("grade").alias("grade"), F.min("outcome_title").alias("title"), F.min("theme_name").alias("theme"), F.lit("").alias("framework"))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Source pages: the evidence records' texts."""
    rows = table(spark, folder, "evidence_records")
    return spread(rows.select("record_no", F.col("source.package_id").alias("package_id"), "evidence_text", "source"))


def _affine() -> Column:
    """Lower grades belong to one exam's packages, higher ones to the other's."""
    return F.contains("package_id", F.when(F.col("grade") <= 10, "-TYT-").otherwise("-AYT-"))


def _scores(spark: SparkSession, folder: str, best: int) -> DataFrame:
    return scoring.page_scores(outcomes(spark, folder), pages(spark, folder), ["record_no", "package_id"], F.col("evidence_text"), _affine(), best)


def document_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """In how many pages each token stands."""
    return scoring.document_frequency(scoring.postings(scoring.page_tokens(pages(spark, folder), ["record_no"], F.col("evidence_text")), ["record_no"]))


def crosswalk_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The eight best pages of each outcome."""
    return scoring.best_pages(_scores(spark, folder, 8), ["package_id", "record_no"], 8)


def crosswalk_status(spark: SparkSession, folder: str) -> DataFrame:
    """How well the best page of each outcome stands out; outcomes without any page are unresolved."""
    status = scoring.candidate_status(crosswalk_topk(spark, folder))
    return outcomes(spark, folder).select("outcome_id").join(status, "outcome_id", "left").select("outcome_id", F.coalesce("status", F.lit("UNRESOLVED")).alias("status"), "margin")


def crosswalk_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes by status."""
    return crosswalk_status(spark, folder).groupBy("status").agg(F.count("*").alias("n_outcomes"))


def verify_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The three best pages of each outcome, checked: title tokens and neighbours found, and whether the source is complete."""
    best = written(crosswalk_topk(spark, folder).filter(F.col("rank") <= 3).select("outcome_id", "record_no", "score", "affine", "rank"), "best")
    # only the best pages are made words; their numbers go to all pages if they are few
    wanted = best.select("record_no").distinct()
    wanted = F.broadcast(wanted) if wanted.limit(FEW_PAGES + 1).count() <= FEW_PAGES else wanted
    titles = outcomes(spark, folder).select("outcome_id", X.distinct_search_tokens(F.col("title")).alias("title"))
    held = table(spark, folder, "evidence_records").select("record_no", "evidence_text", "source").join(wanted, "record_no", "left_semi").withColumn("complete", gates.complete("source", ["source_anchor", "html_path", "image_path"]) & (F.trim("evidence_text") != ""))
    words = F.split(X.searchable(F.col("evidence_text")), " ")
    rows = best.join(titles, "outcome_id").join(held.select("record_no", "complete", words.alias("words")), "record_no", "left")
    rows = rows.withColumn("title_hits", F.size(F.array_intersect("title", "words"))).withColumn("bigram_hits", F.size(F.array_intersect(X.bigrams(F.col("title")), X.bigrams(F.col("words")))))
    strong = gates.holds(F.col("complete")) & (F.col("title_hits") >= 3) & F.col("affine")
    weak = gates.holds(F.col("complete")) & (F.col("title_hits") >= 1)
    status = F.when(strong, "VERIFIED").when(weak, "REVIEW_REQUIRED").otherwise("REJECTED")
    return rows.select("outcome_id", "record_no", "score", "rank", F.col("title_hits").cast("long").alias("title_hits"), F.col("bigram_hits").cast("long").alias("bigram_hits"), status.alias("status"))


def verify_best(spark: SparkSession, folder: str) -> DataFrame:
    """The best checked page of each outcome by (status, title hits, neighbours, score)."""
    order = F.when(F.col("status") == "VERIFIED", 3).when(F.col("status") == "REVIEW_REQUIRED", 2).otherwise(1)
    rows = verify_candidates(spark, folder)
    return ranking.top_k(rows.withColumnRenamed("rank", "page_rank"), ["outcome_id"], [order.desc(), F.desc("title_hits"), F.desc("bigram_hits"), F.desc("score"), F.col("record_no")], 1).drop("rank", "page_rank")


def review_gate(spark: SparkSession, folder: str) -> DataFrame:
    """The checks that each evidence record fails: authority, source, hash, the grade's packages, policy, earlier verification, length, title found in the text."""
    rows = spread(table(spark, folder, "evidence_records").select("record_no", "grade", F.col("source.package_id").alias("package_id"), "evidence_text", "outcome_title", "source", "verification", "compiler_policy"))
    title = X.distinct_search_tokens(F.col("outcome_title"))
    hits = F.size(F.array_intersect(title, F.split(X.searchable(F.col("evidence_text")), " ")))
    checks = {
        "authority": F.col("source.authority") == AUTHORITY,
        "source": gates.complete("source", ["authority", "package_id", "page", "source_anchor", "html_path", "image_path", "text_sha256"]),
        "hash": S.text_hash(F.col("evidence_text")) == F.col("source.text_sha256"),
        "affinity": _affine(),
        "policy": F.col("compiler_policy") == "FAIL_CLOSED",
        "verified": F.col("verification.status") == "VERIFIED",
        "checks": F.forall(F.map_values("verification.checks"), lambda x: gates.holds(x)),
        "length": F.length(F.trim("evidence_text")) >= 120,
        "title": (hits >= 3) & (hits / F.nullif(F.size(title), F.lit(0)) >= 0.5),
    }
    out = gates.gated(rows, checks)
    return out.select("record_no", "status", F.array_join("errors", ",").alias("failed"))


def review_gate_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence records by gate status."""
    return review_gate(spark, folder).groupBy("status").agg(F.count("*").alias("n_records"))


def constraint_errors(spark: SparkSession, folder: str) -> DataFrame:
    """How many evidence records break each table constraint."""
    rows = table(spark, folder, "evidence_records")
    return gates.table_checks(
        rows,
        {
            "grade_range": F.col("grade").between(9, 12),
            "theme_range": F.col("theme_number") >= 1,
            "title_present": F.trim("outcome_title") != "",
            "text_present": F.trim("evidence_text") != "",
            "page_positive": F.col("source.page") > 0,
            "not_visible": F.col("student_visible") == F.lit(False),
            "deleted_after_created": F.col("deleted_at").isNull() | (F.col("deleted_at") >= F.col("created_at")),
        },
    )


def duplicate_records(spark: SparkSession, folder: str) -> DataFrame:
    """record_ids that stand more than once."""
    return gates.duplicate_keys(table(spark, folder, "evidence_records"), ["record_id"])


def conflicting_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated record_ids: how many copies, whether they agree on text and hash, and the first copy."""
    rows = table(spark, folder, "evidence_records").select("record_id", "record_no", "evidence_text", F.col("source.text_sha256").alias("sha"))
    out = ranking.agreeing_copies(rows, "record_id", ["evidence_text", "sha"], [F.col("record_no")])
    return out.filter("copies > 1").select("record_id", "copies", "agree", F.col("record_no").alias("first_record_no"))


def dedupe_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    """The last arrival of each question id."""
    rows = table(spark, folder, "questions").select("id", "loaded_at", "topic", "answer")
    return ranking.last_wins(rows, ["id"], [F.col("loaded_at")]).select("id", "topic", "answer")


def dedupe_richest(spark: SparkSession, folder: str) -> DataFrame:
    """The copy of each record_id with the longest title and text, the first on ties."""
    rows = table(spark, folder, "evidence_records").select("record_id", "record_no", "outcome_title", "evidence_text")
    return ranking.richest_wins(rows, ["record_id"], ["outcome_title", "evidence_text"], [F.col("record_no")]).select("record_id", "record_no")


def dedupe_hash_first(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose exact text an earlier doc_id has, with that doc_id."""
    rows = table(spark, folder, "documents").filter(F.col("text").isNotNull()).select("doc_id", S.text_hash(F.col("text")).alias("sha"))
    first = rows.groupBy("sha").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("copies")).filter("copies > 1")
    return rows.join(first, "sha").filter("doc_id <> first_doc_id").select("doc_id", "first_doc_id")


def manifest_one_to_one(spark: SparkSession, folder: str) -> DataFrame:
    """Where the manifest and the records don't match one to one on the text's hash, by fault."""
    left = table(spark, folder, "biology_release_manifest").filter(F.col("record_id").isNotNull()).select("record_id", F.col("canonical_text_sha256").alias("sha"))
    right = table(spark, folder, "evidence_records").select("record_id", F.col("source.text_sha256").alias("sha"))
    return gates.one_to_one(left, right, "record_id", ["sha"]).groupBy("fault").agg(F.count("*").alias("n_records"))


def coverage_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Records by status, by grade, by (grade, theme) and in all, in one pass."""
    return coverage.counted(table(spark, folder, "evidence_records"), [["evidence_status"], ["grade"], ["grade", "theme_number"], []], "n_records")


def coverage_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Records by grade, theme and status, and each shorter beginning of these."""
    return coverage.rolled_up(table(spark, folder, "evidence_records"), ["grade", "theme_number", "evidence_status"], "n_records")


def status_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """For each grade and theme the records of each review status."""
    return coverage.pivoted(table(spark, folder, "evidence_records"), ["grade", "theme_number"], "review_status", ["PASS", "MANUAL"])


def referential_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Names in dependencies that no topic has, as they stand."""
    rows = table(spark, folder, "ayt_biyoloji")
    flat = rows.select(F.col("plan_id"), F.explode("dependencies").alias("ref")).filter(F.col("ref").isNotNull()).distinct()
    return flat.join(rows.select("plan_id", F.col("topic").alias("ref")).distinct(), ["plan_id", "ref"], "left_anti")


def question_solutions(spark: SparkSession, folder: str) -> DataFrame:
    """Undeleted questions with their solutions, joined on the reference as it stands."""
    q = table(spark, folder, "questions").filter(F.col("deleted_at").isNull()).select("id", "subject", "topic", "difficulty", "solution_id").distinct()
    s = table(spark, folder, "solutions").filter(F.col("deleted_at").isNull()).select(F.col("id").alias("solution_id"), "strategy", F.size("steps").cast("long").alias("n_steps")).distinct()
    return q.join(s, "solution_id").select("id", "subject", "topic", "difficulty", "solution_id", "strategy", "n_steps")


def questions_without_solution(spark: SparkSession, folder: str) -> DataFrame:
    """Questions whose reference, as it stands, finds no solution, by subject."""
    q = table(spark, folder, "questions").select("id", "subject", F.col("solution_id").alias("sid")).distinct()
    return q.join(table(spark, folder, "solutions").select(F.col("id").alias("sid")).distinct(), "sid", "left_anti").groupBy("subject").agg(F.countDistinct("id").alias("n_questions"))


def questions_by_difficulty(spark: SparkSession, folder: str) -> DataFrame:
    """Questions by subject, grade and difficulty in one spelling."""
    d = F.lower("difficulty")
    level = F.when(d.isin("basic", "easy", "kolay"), "easy").when(d.isin("intermediate", "medium", "orta"), "medium").when(d.isin("advanced", "hard", "zor"), "hard").otherwise(d)
    return table(spark, folder, "questions").groupBy("subject", "grade", level.alias("level")).agg(F.countDistinct("id").alias("n_questions"))


def source_mapping_topk(spark: SparkSession, folder: str) -> DataFrame:
    """For each topic of the history list the five history documents that hold most of its words."""
    queue = table(spark, folder, "tyt_tarih").select("subject", "topic_no", "topic")
    docs = spread(table(spark, folder, "documents").filter(F.col("text").isNotNull()).select("subject", "doc_id", "text"))
    out = matching.share_matches(queue, ["topic_no"], X.bare_tokens(F.col("topic")), docs, ["subject"], "doc_id", X.bare_tokens(F.col("text")))
    return out.withColumn("confidence", S.confidence(F.col("score")))


def mapping_status(spark: SparkSession, folder: str) -> DataFrame:
    """Topics of the list by the confidence of their best document."""
    best = source_mapping_topk(spark, folder).filter("rank = 1")
    topics = table(spark, folder, "tyt_tarih").select("topic_no")
    joined = topics.join(best, "topic_no", "left")
    return joined.groupBy(F.coalesce("confidence", F.lit("UNRESOLVED")).alias("confidence")).agg(F.count("*").alias("n_topics"))


def topic_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The three best history documents of each topic of the list by phrases and words (30 points and one support at least)."""
    topics = table(spark, folder, "tyt_tarih").select("topic_no", "topic", "subtopics")
    docs = spread(table(spark, folder, "documents").filter(X.turkish_small(F.col("subject")) == "tarih").select("doc_id", "text"))
    scored = scoring.topic_page_sums(docs, "doc_id", "text", topics, "topic_no", "topic", "subtopics")
    kept = scored.filter("score >= 30 and support >= 1")
    return ranking.top_k(kept, ["topic_no"], [F.desc("score"), F.desc("support"), F.col("doc_id")], 3)


def resolve_topic_longest(spark: SparkSession, folder: str) -> DataFrame:
    """The longest history topic that stands in each topic typed in the log, the first of the list on ties."""
    log = table(spark, folder, "study_log").filter(F.col("topic").isNotNull()).select("topic").distinct()
    names = table(spark, folder, "tyt_tarih").select("topic_no", F.col("topic").alias("name"))
    return matching.longest_contained(log, "topic", "topic", names, "name", "topic_no", X.turkish_small).select("topic", "topic_no")


def resolve_topic_unique(spark: SparkSession, folder: str) -> DataFrame:
    """The longest history topic that stands in a typed study topic; none on ties."""
    log = table(spark, folder, "study_log").filter(F.col("topic").isNotNull()).select("topic").distinct()
    names = table(spark, folder, "tyt_tarih").select("topic_no", F.col("topic").alias("name"))
    return matching.longest_unique(log, "topic", "topic", names, "name", X.bare_words).select("topic", "topic_no")


def resolve_unit_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """The one biology outcome whose title shares most tokens with each question's text; none on ties."""
    q = table(spark, folder, "questions").filter(F.col("question").isNotNull()).groupBy("id").agg(F.min("question").alias("question"))
    units = outcomes(spark, folder).filter(F.col("title").isNotNull()).select("outcome_id", "title")
    found = matching.overlap_matches(q, "id", "question", units, "outcome_id", "title")
    return ranking.unique_best(found, ["id"], "score").select("id", "outcome_id", "score")


def keyword_subject(spark: SparkSession, folder: str) -> DataFrame:
    """The first subject with a keyword in each question's text."""
    words = spark.createDataFrame([(i, s, k) for i, (s, k) in enumerate(KEYWORDS)], "place int, label string, keyword string")
    q = table(spark, folder, "questions").filter(F.col("question").isNotNull()).groupBy("id").agg(F.min("question").alias("question"))
    return matching.first_keyword(q, "id", "question", words, "keyword", "label", "place", X.turkish_small)


def next_topic(spark: SparkSession, folder: str) -> DataFrame:
    """Each topic of the list with the one before and after it."""
    rows = table(spark, folder, "tyt_tarih").select("subject", "topic_no", "topic")
    return ranking.with_neighbours(rows, ["subject"], [F.col("topic_no")], "topic", "previous", "next").drop("subject")


def previous_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Each topic of the list with all before it."""
    rows = table(spark, folder, "tyt_tarih").select("subject", "topic_no", "topic")
    out = ranking.with_predecessors(rows, ["subject"], [F.col("topic_no")], "topic")
    return out.select("topic_no", F.size("predecessors").cast("long").alias("n_before"), F.array_join("predecessors", "|").alias("before"))


def normal_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Each question topic in the normalisers' forms."""
    c = F.col("topic")
    return table(spark, folder, "questions").select("topic").filter(c.isNotNull()).distinct().select(
        "topic", X.searchable(c).alias("searchable"), X.bare(c).alias("bare"), X.bare_words(c).alias("bare_words"), X.turkish_small(c).alias("turkish_small"),
        X.keyword_small(c).alias("keyword_small"), X.slug(c).alias("slug"), X.unit_slug(c).alias("unit_slug"), X.trimmed_small(c).alias("trimmed_small"),
    )


def document_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """How often each bare token of three letters or more stands in the corpus, and in how many documents."""
    rows = spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", F.explode(X.bare_tokens(F.col("text"), X.STOP_LEXICAL)).alias("token"))
    one = rows.groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    return one.groupBy("token").agg(F.sum("n").alias("n_times"), F.count("*").alias("n_documents"))


def title_bigrams(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring distinct tokens of outcome titles, with how many outcomes have them."""
    rows = outcomes(spark, folder).select("outcome_id", F.explode(X.bigrams(X.distinct_search_tokens(F.col("title")))).alias("bigram")).distinct()
    return rows.groupBy("bigram").agg(F.count("*").alias("n_outcomes"))


def top_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The ten commonest terms of each document by (count, term)."""
    rows = spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", F.explode(X.bare_tokens(F.col("text"), X.STOP_LEXICAL)).alias("term"))
    return ranking.top_k(rows.groupBy("doc_id", "term").agg(F.count("*").alias("n")), ["doc_id"], [F.desc("n"), F.col("term")], 10)


def root_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Stems of the words of question topics, by how many topics have them."""
    rows = table(spark, folder, "questions").select("topic").filter(F.col("topic").isNotNull()).distinct()
    return rows.select("topic", F.explode(X.meaningful_roots(F.col("topic"))).alias("root")).groupBy("root").agg(F.count("*").alias("n_topics"))


def chunk_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """How many useful sentences each evidence text has, and their signs."""
    s = X.sentences_of(F.col("evidence_text"))
    rows = table(spark, folder, "evidence_records").filter(F.col("evidence_text").isNotNull()).select("record_no", s.alias("s"))
    return rows.select("record_no", F.size("s").cast("long").alias("n_sentences"), F.coalesce(F.aggregate("s", F.lit(0), lambda a, x: a + F.length(x)), F.lit(0)).cast("long").alias("n_signs"))


def extractive_answers(spark: SparkSession, folder: str) -> DataFrame:
    """For each outcome with evidence the sentences that share most with its title, then its theme, under a budget, in source order."""
    rows = spread(table(spark, folder, "evidence_records").filter(F.col("evidence_text").isNotNull() & F.col("outcome_title").isNotNull()).select("record_no", "outcome_title", "theme_name", "evidence_text"))
    q, way = X.grounding_tokens(F.col("outcome_title")), X.grounding_tokens(F.coalesce("theme_name", F.lit("")))
    s = rows.select("record_no", q.alias("q"), way.alias("way"), F.posexplode(X.sentences_of(F.col("evidence_text"))).alias("place", "sentence"))
    tokens = s.withColumn("tokens", X.grounding_tokens(F.col("sentence")))
    scored = tokens.withColumn("score", (6 * F.size(F.array_intersect("q", "tokens")) + 2 * F.size(F.array_intersect("way", "tokens"))).cast("long"))
    return scoring.within_budget(scored.drop("q", "way", "tokens"), "record_no", "sentence", "score", "place")


def excerpt_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Long documents cut to the lines around names and words of their subject's first topic, as hashes; short ones, and those of other subjects, whole or from the start."""
    lists = table(spark, folder, "tyt_tarih").select("subject", F.col("topic_no").cast("long").alias("spot"), "topic", "subtopics").union(table(spark, folder, "ayt_biyoloji").select("subject", "plan_id", "topic", "subtopics"))
    first = ranking.first_wins(lists.filter(F.col("subtopics").isNotNull()), ["subject"], [F.col("spot"), F.col("topic")])
    parts = F.concat(F.array("topic"), "subtopics")
    sought = first.select("subject", F.transform(parts, X.bare_words).alias("phrases"), X.source_tokens(F.array_join(parts, " ")).alias("tokens"))
    rows = spread(table(spark, folder, "documents").filter(F.col("text").isNotNull()).select("doc_id", "text", "subject")).join(sought, "subject", "left")
    none = F.array().cast("array<string>")
    out = scoring.excerpts(rows, "doc_id", "text", F.coalesce("phrases", none), F.coalesce("tokens", none))
    return out.select("doc_id", F.length("excerpt").cast("long").alias("n_signs"), S.text_hash(F.col("excerpt")).alias("sha256"))


def script_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with and without signs of scripts that answers must not hold, by label."""
    rows = table(spark, folder, "documents").filter(F.col("text").isNotNull())
    return rows.groupBy("lang", S.has_foreign_script(F.col("text")).alias("foreign")).agg(F.count("*").alias("n_documents"))


def page_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers and addresses taken from the records' page paths, by package."""
    src = table(spark, folder, "evidence_records").select("source.*")
    n = S.page_number(F.col("html_path"))
    url = F.concat(F.lit("https://kaynak.example/"), F.col("source_anchor"))
    return src.groupBy("package_id").agg(
        F.count("*").alias("n_records"), F.count(n).alias("n_numbers"), F.max(n).alias("last_page"), F.count_if(n == F.col("page")).alias("n_same"), F.count_if(S.is_official_url(url, "kaynak.example")).alias("n_official")
    )


QUERIES = (
    document_frequency, crosswalk_topk, crosswalk_status, crosswalk_status_counts, verify_candidates, verify_best, review_gate, review_gate_counts, constraint_errors,
    duplicate_records, conflicting_copies, dedupe_last_wins, dedupe_richest, dedupe_hash_first, manifest_one_to_one, coverage_sets, coverage_rollup, status_pivot,
    referential_gaps, question_solutions, questions_without_solution, questions_by_difficulty, source_mapping_topk, mapping_status, topic_pages, resolve_topic_longest,
    resolve_topic_unique, resolve_unit_overlap, keyword_subject, next_topic, previous_topics, normal_forms, document_tokens, title_bigrams, top_terms, root_counts,
    chunk_sentences, extractive_answers, excerpt_windows, script_guard, page_parts,
)
