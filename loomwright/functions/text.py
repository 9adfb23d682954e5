"""Text columns: cleaning, tokens, identities, labels, routing by terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
EVALUATOR_STOP_WORDS = (
    "the a an and or but in on at to for is are was were be been being of with from by as that this these "
    "those it its into than then there here what when where which who whom whose why how do does did can "
    "could would should will shall have has had your you our we they their them"
).split()
JUDGE_STOP_WORDS = (
    "the and for that this with from what when where which who how does can could would should about have "
    "has are was were your you our their they them into than then there here also"
).split()
SKILLS = [
    "python", "java", "javascript", "typescript", "react", "node.js", "sql", "postgresql", "mysql", "mongodb", "aws",
    "azure", "gcp", "docker", "kubernetes", "terraform", "git", "linux", "fastapi", "django", "flask", "pytorch",
    "tensorflow", "scikit-learn", "machine learning", "deep learning", "generative ai", "genai", "llm", "nlp",
    "computer vision", "rag", "langchain", "langgraph", "faiss", "hugging face", "transformers", "spark", "databricks",
    "airflow", "power bi", "tableau", "excel", "communication", "leadership", "project management", "agile", "scrum",
]
UI_TALENT_TERMS = [
    "resume", "cv", "candidate", "candidates", "bench", "ai engineer", "software engineer", "developer", "hire", "hiring",
    "job description", "jd", "skills", "shortlist", "short list", "who should", "best fit", "talent", "vacancy",
]
UI_POLICY_TERMS = [
    "policy", "leave", "benefit", "benefits", "attendance", "conduct", "harassment", "grievance", "payroll", "holiday",
    "holidays", "employee", "disciplinary", "code of conduct", "working hours", "remote work", "maternity", "insurance",
    "compliance", "procedure", "rule",
]
TALENT_TERMS = [
    "resume", "resumes", "candidate", "candidates", "talent", "bench", "job description", "job opening", "hiring", "hire",
    "recruit", "skills match", "talent pool", "internal candidate", "staffing",
]
POLICY_TERMS = [
    "policy", "leave", "attendance", "benefits", "salary", "compensation", "bonus", "insurance", "harassment",
    "discrimination", "posh", "conduct", "ethics", "privacy", "gdpr", "security", "remote work", "working hours",
    "holiday", "sick leave", "expense", "travel", "grievance", "performance", "probation", "notice period",
]
DOMAINS = {
    "ConductPolicy": ["harassment", "discrimination", "posh", "complaint", "ethics", "code of conduct", "misconduct"],
    "OperationsPolicy": ["leave", "attendance", "working hours", "punctuality", "remote work", "schedule"],
    "BenefitsPolicy": ["benefits", "compensation", "salary", "reward", "bonus", "insurance", "401k"],
    "SecurityPolicy": ["security", "confidential", "data protection", "privacy", "gdpr", "pii"],
}
REASONING_WORDS = ["why", "how", "analyze", "analyse", "compare", "evaluate", "explain", "difference", "recommend", "summarize", "assess"]
NO_CONTEXT_MARKERS = [
    "i don't have any policy context", "i do not have any policy context", "no policy context available",
    "no policy context is available", "knowledge base is not ready", "please contact hr for more information",
    "i couldn't find relevant policy information", "i could not find relevant policy information",
    "error processing query", "error generating answer", "error:",
]
# ----------------------------------------------------------------------------

WORD = r"[\p{L}\p{N}_]"
#: Words are met at their first character, as those that aren't tokens are passed over whole.
BM25_TOKEN = rf"([a-z0-9](?:[a-z0-9\-]*[a-z0-9])?)(?!{WORD})|{WORD}++"


def let(value: Column, body) -> Column:
    """``body`` of the value, which is worked out once however often the body names it (also within lambdas, where
    Spark would repeat it for each element)."""
    return F.transform(F.array(value), body)[0]


def words_array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def has_any(text: Column, terms: list[str]) -> Column:
    """Does the text hold any of the terms (as substrings)?"""
    return let(text, lambda x: F.exists(words_array(terms), lambda t: F.contains(x, t)))


def count_of(text: Column, terms: list[str]) -> Column:
    return let(text, lambda x: F.size(F.filter(words_array(terms), lambda t: F.contains(x, t))))


def normalise_query(text: Column, most: int = 8000) -> Column:
    """Control characters and runs of white space to one space, trimmed; null if empty or too long."""
    one = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1f\x7f]", " "), r"\s+", " "))
    return F.when((F.length(one) > 0) & (F.length(one) <= most), one)


def clean_text(text: Column, most: int) -> Column:
    """Without NUL, trimmed, cut to ``most`` characters with an ellipsis."""
    one = F.regexp_replace(F.coalesce(text, F.lit("")), r"\x00", " ")
    one = F.regexp_replace(one, r"^\s+|\s+$", "")
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, most), F.lit("…"))).otherwise(one)


def bm25_tokens(text: Column) -> Column:
    return F.array_remove(F.regexp_extract_all(F.lower(text), F.lit(BM25_TOKEN), F.lit(1)), "")


def plain_tokens(text: Column, least: int = 1) -> Column:
    """Runs of word characters, lower case, of at least ``least`` characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"{WORD}{{{least},}}"), F.lit(0))


def ascii_words(text: Column, stop_words: list[str], least: int = 3) -> Column:
    """Distinct ASCII words that stand between non-word characters, long enough and not stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"([a-z0-9]{{{least},}}+)(?!{WORD})|{WORD}++"), F.lit(1))
    return F.array_except(F.array_distinct(found), words_array(["", *stop_words]))


def skill_terms(text: Column) -> Column:
    """The known skills that the text holds (as substrings, so "java" is found in "javascript"), in list order."""
    normal = F.regexp_replace(F.lower(text), r"[^a-z0-9+#.\- ]+", " ")
    return let(normal, lambda x: F.filter(words_array(SKILLS), lambda s: F.contains(x, s)))


def candidate_name(filename: Column, text: Column) -> Column:
    """From the file's name, else from a "name:" or "candidate:" line."""
    stem = F.regexp_replace(F.regexp_replace(filename, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    spaced = F.trim(F.regexp_replace(stem, r"[_\-]+", " "))
    lines = [F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?im)^\s*{w}\s*[:\-]\s*(.+)$", 1) for w in ("name", "candidate")]
    by_line = F.coalesce(*[F.when(x != "", clean_text(x, 120)) for x in lines])
    named = (spaced != "") & ~spaced.rlike(r"(?i)\b(resume|cv|curriculum vitae|profile)\b")
    return F.when(named, F.substring(spaced, 1, 120)).otherwise(F.coalesce(by_line, F.when(spaced != "", F.substring(spaced, 1, 120)), F.lit("Unnamed Candidate")))


def ui_route(text: Column) -> Column:
    """Talent terms come before policy terms."""
    low = F.lower(text)
    return F.when(has_any(low, UI_TALENT_TERMS), "Talent Intelligence").when(has_any(low, UI_POLICY_TERMS), "HR Policy RAG").otherwise("General HR Assistant")


def graph_route(text: Column, role: Column) -> Column:
    low = F.lower(text)
    talent = count_of(low, TALENT_TERMS) > 0
    return F.when(talent & F.lower(role).isin("editor", "admin"), "TalentIntelligence").when(talent, "AccessControlled").when(count_of(low, POLICY_TERMS) > 0, "PolicyIntelligence").otherwise("GeneralHR")


def policy_domain(text: Column) -> Column:
    """The domain with most of its keywords in the text; the first of equals."""

    def first_of_most(hits: Column) -> Column:
        chain = F.when(F.array_max(hits) == 0, "GeneralPolicy")
        for k, d in enumerate(DOMAINS):
            chain = chain.when(hits[k] == F.array_max(hits), d)
        return chain

    return F.coalesce(let(let(F.lower(text), lambda x: F.array(*[count_of(x, terms) for terms in DOMAINS.values()])), first_of_most), F.lit("GeneralPolicy"))


def keyword_boost(score: Column, text: Column, keywords: Column, step: float = 0.1) -> Column:
    """min(1, score + step for each keyword in the text), if there is any."""
    n = let(F.lower(text), lambda x: F.size(F.filter(keywords, lambda k: F.contains(x, k))))
    return let(n, lambda n: F.when(n > 0, F.least(F.lit(1.0), score + step * n)).otherwise(score))


def token_estimate(text: Column) -> Column:
    """A token for each four characters, at least one; none for an empty text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor((n + 3) / 4))).cast("int")


def model_choice(text: Column) -> Column:
    simple = (F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) < 15) & ~has_any(F.lower(text), REASONING_WORDS)
    return F.when(text.isNull() | (text == ""), "default").when(simple, "simple").otherwise("reasoning")


def no_context_answer(text: Column) -> Column:
    return let(F.lower(clean_text(text, 4000)), lambda x: (x == "") | F.exists(words_array(NO_CONTEXT_MARKERS), lambda t: F.contains(x, t)))


def cache_hash(org: Column, namespace: Column, user: Column, role: Column, query: Column) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (org, namespace, user, role)]
    return F.sha2(F.concat_ws("\u001f", *parts, F.lower(F.trim(F.regexp_replace(query, r"\s+", " ")))), 256)


def pseudonym(text: Column) -> Column:
    one = F.trim(F.coalesce(text, F.lit("")))
    return F.when(one == "", "anonymous").otherwise(F.substring(F.sha2(one, 256), 1, 16))


def metric_name(name: Column) -> Column:
    """Letters, digits and underscores, none at the ends, not led by a digit."""
    one = F.regexp_replace(F.regexp_replace(F.trim(name), "[^a-zA-Z0-9_]", "_"), "^_+|_+$", "")
    one = F.when(one == "", "metric").otherwise(one)
    return F.when(one.rlike("^[0-9]"), F.concat(F.lit("_"), one)).otherwise(one)


def document_id(content: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha2(content, 256), 1, 32))


def chunk_key(chunk_id: Column, content: Column, source: Column, page: Column) -> Column:
    own = F.when(F.trim(chunk_id) != "", F.concat(F.lit("id:"), F.trim(chunk_id)))
    return F.coalesce(own, F.concat_ws("|", F.lit("content:"), content, F.coalesce(source, F.lit("")), F.coalesce(page.cast("string"), F.lit(""))))


def citation(source: Column, page: Column) -> Column:
    return F.when(page.isNull(), source).otherwise(F.concat(source, F.lit(" (Page "), page.cast("string"), F.lit(")")))


def citation_with_relevance(source: Column, page: Column, score: Column) -> Column:
    return F.concat_ws(" — ", source, F.when(page.isNotNull(), F.concat(F.lit("Page "), page.cast("string"))), F.format_string("relevance %.2f", score))


def judge_score(text: Column) -> Column:
    """A number from JSON, fenced JSON, JSON within text, or the first "score: n"; null if there is none."""
    kind = "struct<score:double>"
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    inside = F.regexp_extract(text, r"(?s)(\{[^{}]*\})", 1)
    loose = F.regexp_extract(text, r"(?i)score\D{0,5}([0-9]+(?:\.[0-9]+)?)", 1)
    return F.coalesce(*[F.from_json(F.trim(x), kind)["score"] for x in (text, fenced, inside)], F.expr("null").cast("double"), F.when(loose != "", loose.cast("double")))


def json_field(text: Column, kind: str, default: Column) -> Column:
    """A JSON text as a value of the type ``kind``; ``default`` for null and bad JSON, and for another kind of value."""
    return F.coalesce(F.from_json(text, kind, {"mode": "PERMISSIVE"}), default)


def ends_after(start: Column, minutes: Column) -> Column:
    """The end of an interval: start and minutes; null if it has none or doesn't end later."""
    return F.when(minutes > 0, start + F.make_interval(mins=minutes))
