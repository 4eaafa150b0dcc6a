"""Plans over reviewed evidence, the release manifest and the question store: partners, gates and projections, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kavak.functions import scalars as S
from kavak.functions import text as X
from kavak.operators import gates, lookups, matching, ranking, reshape, review
from kavak.sources.tables import table

SOURCE_FIELDS = ["authority", "corpus_family", "package_id", "page", "source_anchor", "html_path", "image_path", "text_sha256"]
LETTERS = ["A", "B", "C", "D", "E"]
# What a student asks about a topic, after its name.
TEMPLATES = (" nedir?", " konusunu anlat", " hakkında bilgi ver")


def _filled(c: str) -> Column:
    return F.trim(c) != ""


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The first record of each record_id."""
    rows = table(spark, folder, "evidence_records").select(
        "record_id", "record_no", "outcome_id", "grade", "evidence_text", "source", F.col("verification.status").alias("verified"), "review_status", "evidence_status", "student_visible", "compiler_policy", "deleted_at"
    )
    return ranking.first_wins(rows, ["record_id"], [F.col("record_no")])


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The first arrival of each unit."""
    return ranking.first_wins(table(spark, folder, "biology_release_manifest"), ["unit_id"], [F.col("loaded_at")])


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.first_wins(table(spark, folder, "questions"), ["id"], [F.col("loaded_at")])


def _solutions(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.first_wins(table(spark, folder, "solutions"), ["id"], [F.col("loaded_at")])


def evidence_build(spark: SparkSession, folder: str) -> DataFrame:
    """Verified records with the first long enough page of their package and number; an error where there is none."""
    rows = table(spark, folder, "evidence_records").select("record_no", F.col("source.package_id").alias("package_id"), F.col("source.page").alias("page"), F.col("verification.status").alias("verified"), F.length(F.trim("evidence_text")).alias("n"))
    pages = rows.filter(F.col("n") >= 120).groupBy("package_id", "page").agg(F.min("record_no").alias("page_record_no"))
    return review.joined_or_told(rows.filter("verified = 'VERIFIED'").select("record_no", "package_id", "page"), pages, ["package_id", "page"], "page")


def approval_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest units with the passed record they name; an error where no record passed under that id."""
    passed = _evidence(spark, folder).filter("review_status = 'PASS'").select("record_id", "record_no", F.col("source.text_sha256").alias("sha"))
    return review.joined_or_told(_manifest(spark, folder).select("unit_id", "record_id"), passed, ["record_id"], "record")


def approval_apply(spark: SparkSession, folder: str) -> DataFrame:
    """Passed records with the manifest's status: PENDING without one, REPEATED with several."""
    queue = _evidence(spark, folder).filter("review_status = 'PASS'").select("record_id", "record_no")
    return review.applied(queue, _manifest(spark, folder).select("record_id", F.col("status").alias("decision")), "record_id", "decision")


def unknown_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest units about records that aren't among the passed ones."""
    queue = _evidence(spark, folder).filter("review_status = 'PASS'")
    return review.unknown(_manifest(spark, folder).select("unit_id", "record_id"), queue, "record_id")


def _unit_checks() -> dict[str, Column]:
    text = F.col("evidence_text")
    return {
        "text": F.length(F.trim(text)) >= 120,
        **review.hash_checks(text, F.col("source.text_sha256")),
        "canonical": F.col("canonical_text_sha256").rlike("^[0-9a-f]{64}$"),
        "provenance": gates.complete("source", SOURCE_FIELDS),
        "verified": F.col("verified") == "VERIFIED",
        "review": F.col("review_status") == "PASS",
        "evidence": F.col("evidence_status") == "READY",
        "policy": F.col("compiler_policy") == "FAIL_CLOSED",
        "hidden": F.col("student_visible") == F.lit(False),
        "kept": F.col("deleted_at").isNull(),
    }


def _entry_checks() -> dict[str, Column]:
    return {
        "status": F.col("entry_status") == "RELEASED",
        "ready": F.col("student_ready"),
        "not_visible": F.col("entry_visible") == F.lit(False),
        "policy": F.col("release_policy") == "FAIL_CLOSED",
        "path": F.contains("canonical_path", X.unit_slug(F.col("unit_id"))),
        "identity": F.startswith("unit_id", F.col("outcome_id")),
    }


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    return _manifest(spark, folder).select("unit_id", "record_id", "canonical_path", "canonical_text_sha256", F.col("status").alias("entry_status"), "student_ready", F.col("student_visible").alias("entry_visible"), "release_policy")


def promotion(spark: SparkSession, folder: str) -> DataFrame:
    """Each manifest unit with its record: READY, or BLOCKED by the checks named."""
    out = review.carried(_entries(spark, folder), _evidence(spark, folder), "record_id", _unit_checks())
    return out.select("unit_id", "record_id", "status", F.array_join("errors", ",").alias("failed"))


def release_gate(spark: SparkSession, folder: str) -> DataFrame:
    """The checks that each manifest entry fails, of the unit and of the entry; entries without a record fail both as a whole."""
    units = review.carried(_entries(spark, folder), _evidence(spark, folder), "record_id", _unit_checks()).withColumnRenamed("errors", "unit_errors").drop("status")
    both = gates.gated(units, _entry_checks(), "OPEN", "CLOSED")
    return both.select("unit_id", F.array_join("unit_errors", ",").alias("unit_failed"), F.array_join("errors", ",").alias("entry_failed"))


def released(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest entries that pass every check, with their record."""
    approved = _evidence(spark, folder).filter("review_status = 'PASS'").select("record_id")
    both = _entries(spark, folder).join(_evidence(spark, folder), "record_id").join(approved, "record_id", "left_semi")
    passed = gates.gated(both, {f"unit_{n}": c for n, c in _unit_checks().items()} | _entry_checks())
    return passed.filter("status = 'PASS'").select("unit_id", "record_id", "record_no")


def release_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest entries by their status and by what the approved records make of it."""
    approved = _evidence(spark, folder).filter("review_status = 'PASS' and evidence_status = 'READY' and deleted_at is null")
    out = review.reconciled(_manifest(spark, folder).select("unit_id", "record_id", "status"), approved, "record_id")
    return out.groupBy("status", "now").agg(F.count("*").alias("n_units"))


def decision_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest entries as decisions: a known status, flags that are there, a policy, and ready whenever released."""
    checks = {
        "status": F.col("status").isin("RELEASED", "SUSPENDED_PENDING_HUMAN_REVIEW"),
        "flags": F.col("student_ready").isNotNull() & F.col("student_visible").isNotNull(),
        "policy": _filled("release_policy"),
        "released_ready": (F.col("status") != "RELEASED") | F.col("student_ready"),
        "record": _filled("record_id"),
    }
    return gates.gated(_manifest(spark, folder).select("unit_id", *{c for c in ("status", "student_ready", "student_visible", "release_policy", "record_id")}), checks, status="gate").select("unit_id", "gate", F.array_join("errors", ",").alias("failed"))


def packet_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the manifest by what is wrong with their packet: repeated ids and copies, the hash of their text, and a canonical hash."""
    rows = table(spark, folder, "evidence_records").select("record_id", "record_no", "evidence_text", F.col("source.text_sha256").alias("told"))
    copies = ranking.agreeing_copies(rows, "record_id", ["evidence_text", "told"], [F.col("record_no")])
    named = _manifest(spark, folder).filter(F.col("record_id").isNotNull()).groupBy("record_id").agg(F.count("*").alias("n"), F.min("canonical_text_sha256").alias("canonical"))
    checks = {"once": F.col("n") == 1, "one_copy": F.col("copies") == 1, **review.hash_checks(F.col("evidence_text"), F.col("told")), "canonical": F.col("canonical").rlike("^[0-9a-f]{64}$")}
    return review.carried(named, copies, "record_id", checks, "PASS", "FAIL").select("record_id", "status", F.array_join("errors", ",").alias("failed"))


def manifest_checks(spark: SparkSession, folder: str) -> DataFrame:
    """How many manifest rows repeat a key or break a rule of the table."""
    rows = table(spark, folder, "biology_release_manifest")
    unique = review.unique_checks(rows, {"unit_once": ["unit_id"], "record_once": ["record_id"], "path_once": ["canonical_path"], "arrival_once": ["unit_id", "loaded_at"]})
    flags = gates.table_checks(rows, {"hash_form": F.col("canonical_text_sha256").rlike("^[0-9a-f]{64}$"), "closed": F.col("release_policy") == "FAIL_CLOSED", "not_visible": F.col("student_visible") == F.lit(False), "after_created": F.col("loaded_at") >= F.col("created_at")})
    return unique.union(flags)


def source_checks(spark: SparkSession, folder: str) -> DataFrame:
    """How many records have a source without authority, family, address or hash, and packages with several families."""
    rows = table(spark, folder, "evidence_records").select("source.*")
    filled = {c: F.trim(F.col(c).cast("string")) != "" for c in ("authority", "corpus_family", "package_id", "source_anchor")}
    checks = filled | {"path_has_hash": F.col("html_path").isNull() | F.col("text_sha256").isNotNull(), "page_in_path": S.page_number(F.col("html_path")) == F.col("page")}
    families = rows.groupBy("package_id").agg((F.min("corpus_family") != F.max("corpus_family")).alias("several"))
    return gates.table_checks(rows, checks).union(families.agg(F.lit("one_family").alias("check"), F.count_if("several").alias("failed"), F.count("*").alias("total")))


def question_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Questions by the checks they fail: filled fields, grade, five choices all different, an answer among them, concepts, a solution."""
    choices = F.coalesce("choices", F.array().cast("array<string>"))
    good = F.filter(choices, lambda x: F.trim(x) != "")
    checks = {
        "fields": _filled("id") & _filled("subject") & _filled("topic") & _filled("question"),
        "grade": F.col("grade").between(9, 12),
        "choices": (F.size(good) == 5) & (F.size(F.array_distinct(good)) == 5),
        "answer": F.array_position(F.array(*map(F.lit, LETTERS)), F.col("answer")).between(1, F.size(choices)),
        "concepts": F.size(F.filter(F.coalesce("concepts", F.array().cast("array<string>")), lambda x: F.trim(x) != "")) > 0,
        "solution": _filled("solution_id"),
        "level": lookups.level(F.col("difficulty")).isNotNull(),
    }
    return gates.gated(_questions(spark, folder), checks).groupBy("status", F.array_join("errors", ",").alias("failed")).agg(F.count("*").alias("n_questions"))


def solution_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Solutions by the checks they fail: steps all filled, an answer letter, a strategy, a question named."""
    steps = F.coalesce("steps", F.array().cast("array<string>"))
    checks = {
        "steps": (F.size(steps) > 0) & F.forall(steps, lambda x: gates.holds(F.trim(x) != "")),
        "answer": F.col("final_answer").isin(*LETTERS),
        "strategy": _filled("strategy"),
        "question": _filled("question_id"),
    }
    return gates.gated(_solutions(spark, folder), checks).groupBy("status", F.array_join("errors", ",").alias("failed")).agg(F.count("*").alias("n_solutions"))


def relation_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Plan rows by the checks their relations fail: no blank name, none twice, none to the topic itself."""
    out = {}
    for c in ("dependencies", "next_topics"):
        names = F.coalesce(c, F.array().cast("array<string>"))
        out[f"{c}_filled"] = F.forall(names, lambda x: gates.holds(F.trim(x) != ""))
        out[f"{c}_once"] = F.size(F.array_distinct(names)) == F.size(names)
        out[f"{c}_other"] = ~F.exists(names, lambda x: F.coalesce(x == F.col("topic"), F.lit(False)))
    return gates.gated(table(spark, folder, "ayt_biyoloji"), out).groupBy("status", F.array_join("errors", ",").alias("failed")).agg(F.count("*").alias("n_rows"))


def topic_parts(spark: SparkSession, folder: str) -> DataFrame:
    """For each subject and topic which stores hold it, and its state: READY with all, NOT_READY with some, MISSING with the list alone."""
    q = _questions(spark, folder).filter(F.col("topic").isNotNull()).select("subject", "topic", "id")
    s = _solutions(spark, folder).select(F.col("question_id").alias("id")).filter(F.col("id").isNotNull()).distinct()
    listed = table(spark, folder, "tyt_tarih").select("subject", "topic").union(table(spark, folder, "ayt_biyoloji").select("subject", "topic")).distinct()
    rows = q.select("subject", "topic").distinct().union(listed).distinct()
    for name, part in (("listed", listed), ("asked", q), ("solved", q.join(s, "id"))):
        rows = lookups.with_membership(rows, ["subject", "topic"], part, name)
    state = F.when(F.col("listed") & F.col("asked") & F.col("solved"), "READY").when(F.col("asked") | F.col("solved"), "NOT_READY").otherwise("MISSING")
    return rows.withColumn("state", state)


def claim_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Questions whose answer isn't one of their choices' letters, whose text holds their excluded term, or shares no stem with any choice."""
    q = _questions(spark, folder).filter(F.col("question").isNotNull() & F.col("choices").isNotNull())
    checks = {
        "answer_held": F.get("choices", F.array_position(F.array(*map(F.lit, LETTERS)), F.col("answer")).cast("int") - 1).isNotNull(),
        "excluded_absent": ~F.contains(F.lower("question"), F.lower("misconception_target")),
        "stem_shared": X.roots_overlap(X.meaningful_roots(F.col("question")), F.array_distinct(F.flatten(F.transform("choices", X.meaningful_roots)))),
    }
    return gates.gated(q, checks).select("id", F.array_join("errors", ",").alias("failed"))


def routed_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Each question's choices, concepts and tags as claims, put back by kind in order."""
    items = lookups.unpivoted(_questions(spark, folder), "id", [], ["choices", "concepts", "tags"])
    kind, place = F.regexp_extract("path", "^([^\\[]+)", 1), F.regexp_extract("path", "\\[(\\d+)\\]$", 1).cast("int")
    out = reshape.routed(items.select("id", kind.alias("kind"), place.alias("place"), "text"), "id", ["choices", "concepts", "tags"], "kind", "place", "text")
    return out.select("id", *(F.array_join(c, "|").alias(c) for c in ("choices", "concepts", "tags")))


def record_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Records written as nested JSON documents and read again: how many say what they said."""
    rows = _evidence(spark, folder)
    doc = F.to_json(F.struct("record_id", F.struct("grade", F.struct(F.col("source.package_id").alias("package"), F.col("source.page").alias("page")).alias("source")).alias("meta"), F.col("evidence_text").alias("text")))
    got = rows.withColumn("doc", doc)
    same = F.get_json_object("doc", "$.record_id").eqNullSafe(F.col("record_id")) & F.get_json_object("doc", "$.meta.source.page").cast("int").eqNullSafe(F.col("source.page"))
    return got.groupBy("grade").agg(F.count("*").alias("n_records"), F.count_if(same).alias("n_same"), F.count(F.get_json_object("doc", "$.text")).alias("n_texts"))


def release_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Entries for a release: verified records that no student sees, with a hash of the entry."""
    rows = _evidence(spark, folder).filter("verified = 'VERIFIED' and student_visible = false").select("record_id", "record_no", F.lit("FAIL_CLOSED").alias("release_policy"), F.col("source.text_sha256").alias("sha"))
    return rows.withColumn("entry_sha256", review.row_hash(["record_id", "release_policy", "sha"]))


def own_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose grade and theme aren't those in their outcome's code, with both."""
    code = F.split("outcome_id", "\\.")
    rows = table(spark, folder, "evidence_records").filter(F.col("outcome_id").isNotNull()).select("record_no", "grade", "theme_number", F.get(code, F.lit(1)).try_cast("int").alias("code_grade"), F.get(code, F.lit(2)).try_cast("int").alias("code_theme"))
    return rows.filter(~(F.col("grade").eqNullSafe(F.col("code_grade")) & F.col("theme_number").eqNullSafe(F.col("code_theme"))))


def nested_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes nested by grade and theme and made flat again."""
    rows = table(spark, folder, "evidence_records").filter(F.col("outcome_id").isNotNull())
    flat = rows.groupBy("grade", "theme_number", "outcome_id").agg(F.min("theme_name").alias("theme_name"), F.min("outcome_title").alias("title"), F.min("source.page").alias("source_page")).withColumn("framework", F.lit(""))
    nested = reshape.nested_outcomes(flat)
    return reshape.outcome_rows(nested.select(F.array(F.struct("grade", "themes")).alias("grade_records"))).select("grade", "theme_number", "theme_name", "outcome_id", "title", "source_page")


def solution_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Each solution's steps as one text with page markers, and the page that its last sign lies on."""
    steps = lookups.unpivoted(_solutions(spark, folder), "id", [], ["steps"]).withColumn("n", F.regexp_extract("path", "\\[(\\d+)\\]$", 1).cast("int") + 1)
    whole = reshape.full_text(steps, "id", "n", "text")
    return whole.select("id", "full_text", S.marked_page(F.col("full_text"), F.length("full_text")).alias("last_page"))


def theme_frames(spark: SparkSession, folder: str) -> DataFrame:
    """The first page of each theme of a package and where the next theme begins."""
    rows = table(spark, folder, "evidence_records").filter(F.col("theme_number").isNotNull()).select(F.col("source.package_id").alias("package_id"), "theme_number", F.col("source.page").alias("page"))
    first = rows.groupBy("package_id", "theme_number").agg(F.min("page").alias("starts"))
    return reshape.frames(first, ["package_id"], [F.col("theme_number")], "starts")


def page_links(spark: SparkSession, folder: str) -> DataFrame:
    """Page numbers linked from each record's page and its two neighbours, and the page's address."""
    page = F.col("source.page")
    html = F.concat(*(x for d in (1, -1, 0, 1) for x in (F.lit('<a href="basic-html/page'), (page + d).cast("string"), F.lit('.html">'))))
    rows = table(spark, folder, "evidence_records").filter(page.isNotNull())
    return rows.select("record_no", F.array_join(S.page_numbers(html), ",").alias("numbers"), S.page_url(F.lit("https://kaynak.example/kitap/index.html"), page).alias("address"))


def outcome_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Outcome blocks taken apart again: the title after the code, and the section between two headers."""
    rows = table(spark, folder, "evidence_records").filter(F.col("outcome_title").isNotNull() & F.col("theme_name").isNotNull())
    block = F.concat(F.col("outcome_id"), F.lit(". "), F.col("outcome_title"), F.lit("\na) ilk adım\nANAHTAR KAVRAMLAR\n"), F.col("theme_name"), F.lit("\nSÜREÇ\nson"))
    return rows.select("record_no", S.outcome_title(block).alias("title"), S.section(block, "ANAHTAR KAVRAMLAR", ["SÜREÇ", "EKLER"]).alias("concepts"))


def expression_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each kind with and without parts that an expression must not hold."""
    rows = table(spark, folder, "documents").filter(F.col("text").isNotNull())
    return rows.groupBy("doc_kind", S.is_safe_expression(F.col("text")).alias("safe")).agg(F.count("*").alias("n_documents"))


def json_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers wrapped as a model writes them, with the JSON taken out again."""
    body = F.concat(F.lit('{"cevap": "'), F.col("answer"), F.lit('", "id": {"no": "'), F.col("id"), F.lit('"}}'))
    fenced = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    told = F.concat(F.lit("Yanıt: "), body, F.lit(" (son)"))
    rows = _questions(spark, folder).filter(F.col("answer").isNotNull())
    read = lambda c: F.get_json_object(S.json_part(c), "$.id.no")
    return rows.select("id", read(fenced).alias("fenced"), read(told).alias("told"))


def page_text_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in the form of page texts and on one line, as hashes."""
    rows = table(spark, folder, "documents").filter(F.col("text").isNotNull())
    return rows.select("doc_id", S.text_hash(X.joined_lines(F.col("text"))).alias("page_form"), S.text_hash(X.one_line(F.col("text"))).alias("one_line"))


def name_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Names of packages, files and grades in their forms."""
    src = table(spark, folder, "evidence_records").select("source.package_id", "source.html_path", "grade").distinct()
    copy = F.concat(F.col("package_id"), F.lit(" (2)"))
    return src.select("package_id", "html_path", "grade", X.package_name(copy).alias("name"), X.file_stem(F.col("html_path")).alias("stem"), X.grade_number(F.concat(F.lit("Grade"), F.col("grade").cast("string"))).alias("grade_number"))


def package_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Packages by the kind, exam and subject in their names."""
    rows = table(spark, folder, "evidence_records").select(F.col("source.package_id").alias("package_id"))
    part = lambda i: F.split_part("package_id", F.lit("-"), F.lit(i))
    return rows.groupBy("package_id").agg(F.count("*").alias("n_records")).select("package_id", part(1).alias("kind"), part(2).alias("exam"), part(3).alias("subject"), "n_records")


def review_overall(spark: SparkSession, folder: str) -> DataFrame:
    """The state of each package's review from the counts of its records."""
    rows = table(spark, folder, "evidence_records").withColumn("package_id", F.col("source.package_id"))
    counts = rows.groupBy("package_id").agg(F.count_if((F.col("review_status") == "PASS") & F.col("deleted_at").isNull()).alias("passed"), F.count_if(F.col("deleted_at").isNotNull()).alias("failed"), F.count_if((F.col("review_status") != "PASS") & F.col("deleted_at").isNull()).alias("open"))
    return counts.withColumn("overall", review.ladder(F.col("passed"), F.col("failed"), F.col("open")))


def page_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Terms by the pages that have them: of title and theme where there are any, else of the text."""
    c = lambda n: X.bare_tokens(F.coalesce(F.col(n), F.lit("")))
    named = F.array_distinct(F.concat(c("outcome_title"), c("theme_name")))
    rows = table(spark, folder, "evidence_records").select("record_no", F.explode(F.when(F.size(named) > 0, named).otherwise(F.array_distinct(c("evidence_text")))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("n_pages"))


def family_state(spark: SparkSession, folder: str) -> DataFrame:
    """Families of packages: whether any page has a text, pages ready and in all."""
    rows = table(spark, folder, "evidence_records")
    ready = F.length(F.trim("evidence_text")) > 0
    return rows.groupBy(F.col("source.corpus_family").alias("family")).agg(F.coalesce(F.max(ready), F.lit(False)).alias("has_text"), F.count_if(ready).alias("n_ready"), F.count("*").alias("n_pages"))


def resolving_questions(spark: SparkSession, folder: str) -> DataFrame:
    """What a student asks about each list topic, and the topic that the question resolves to."""
    names = table(spark, folder, "tyt_tarih").select("topic_no", F.col("topic").alias("name"))
    asked = names.select("topic_no", F.explode(F.array(*(F.concat(F.col("name"), F.lit(t)) for t in TEMPLATES))).alias("question"))
    found = matching.longest_unique(asked.select("question").distinct(), "question", "question", names.withColumnRenamed("topic_no", "found_no"), "name", X.bare_words)
    return asked.join(found.select("question", "found_no"), "question", "left")


def visible_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents put on pages between unseen parts and read back by the HTML reader, as hashes of what is seen."""
    from kavak.functions.pages import visible_text

    rows = table(spark, folder, "documents").filter(F.col("text").isNotNull())
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><head><title>baslik</title><script>x()</script><style>p{}</style></head><body><noscript>yok</noscript><p>"), escaped, F.lit("</p></body></html>"))
    return rows.select("doc_id", S.text_hash(visible_text(page)["text"]).alias("sha256"))


def title_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Outcome titles as pages' titles and headings, read back by the plain reader line by line, as hashes."""
    from kavak.functions.pages import page_lines

    rows = table(spark, folder, "evidence_records").filter(~F.col("outcome_title").rlike("[<>&]") & ~F.col("theme_name").rlike("[<>&]"))
    page = F.concat(F.lit("<html><head><title>"), F.col("theme_name"), F.lit("</title><style>p{}</style></head><body><script>x()</script><h1>"), F.col("outcome_title"), F.lit("</h1></body></html>"))
    return rows.select("record_no", S.text_hash(page_lines(page)).alias("sha256"))


QUERIES = (
    evidence_build, approval_queue, approval_apply, unknown_decisions, promotion, release_gate, released, release_reconcile, decision_gate, packet_gate, manifest_checks, source_checks, question_gate,
    solution_gate, relation_gate, topic_parts, claim_gate, routed_claims, record_documents, release_entries, own_identity, nested_registry, solution_texts, theme_frames, page_links, outcome_sections,
    expression_guard, json_answers, page_text_forms, name_forms, package_kinds, review_overall, page_terms, family_state, resolving_questions, visible_pages, title_lines,
)
