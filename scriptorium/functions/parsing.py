"""Parsing of model text, citations, guards and hashes as Column expressions."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists and patterns that results depend on.
SOURCE_LEAKS = ("passage", "text above", "this text", "the book", "the chapter", "bishop", "goodfellow", "huyen", "géron", "geron", "raschka", "jurafsky", "according to the")
REASONING_OPENERS = (
    "we are given", "we are asked", "we need to", "we are to", "hmm", "okay, let", "okay, so", "alright, let", "the user is asking", "the user wants",
    "<think>", "i need to", "i must", "i should", "i'll ", "i will ", "let me", "let's ", "first, i", "first, let",
)
INJECTIONS = (
    r"ignore (all |any |the )?(previous|prior|above|earlier) (instructions|prompts?|rules)",
    r"disregard (all |any |the |your )?(previous |prior )?(instructions|rules|prompt)",
    r"forget (all |your |the )?(previous |prior )?(instructions|rules)",
    r"(reveal|show|print|repeat|output) (me )?(your|the) (system )?(prompt|instructions)",
    r"you are now (?!studying|learning)",
    r"\bjailbreak\b",
    r"\bdeveloper mode\b",
    r"act as (an? )?(unfiltered|unrestricted|uncensored)",
    r"pretend (that )?you (have no|are not bound|don't have) (rules|restrictions|limits)",
)
PERSONAL = (
    ("EMAIL", r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"),
    ("CARD", r"\b(?:\d[ -]?){13,16}\b"),
    ("PHONE", r"(?<![\w.])\+?\d{1,3}[\s-]?\(?\d{3}\)?[\s-]?\d{3}[\s-]?\d{4}\b"),
)
NON_CONTENT = r"bibliograph|historical note|references|further reading|exercise|\bindex\b|acknowledg|preface|table of contents|notation|about the author|colophon|copyright|errata"
NON_CONTENT_SECTION = NON_CONTENT + "|^contents|glossary"
DRAFT_CRUFT = r"not yet updated|TODO|\[\s*citation needed\s*\]"
CITATION = r"(?i)\[\s*(S\d+(?:\s*,\s*S\d+)*)\s*\]"
PREAMBLES = ("here are", "queries:", "sure")
VERDICT_SCORES = {"supported": 1.0, "partial": 0.5, "unsupported": 0.0}
SCOPE_THRESHOLD = 0.294
REFUSAL = "not_in_sources"


def leaks_source(question: Column) -> Column:
    return F.exists(F.array(*map(F.lit, SOURCE_LEAKS)), lambda x: F.contains(F.lower(question), x))


def usable_candidate(breadcrumb: Column, text: Column, n_tokens: Column, alpha: Column, single: Column) -> Column:
    content = (F.size(breadcrumb) > 0) & ~F.concat_ws(" > ", breadcrumb).rlike("(?i)" + NON_CONTENT) & ~text.rlike("(?i)" + DRAFT_CRUFT)
    return content & (n_tokens >= 250) & (alpha >= 0.78) & (single <= 0.12)


def usable_synthetic(text: Column, least: int = 400, most: int = 2400) -> Column:
    kept = F.length(F.regexp_replace(text, r"[^\p{L}\s]", ""))
    return F.length(text).between(least, most) & (kept / F.greatest(F.length(text), F.lit(1)) >= 0.75)


def is_content_section(breadcrumb: Column) -> Column:
    return (F.size(breadcrumb) > 0) & ~F.concat_ws(" > ", breadcrumb).rlike("(?i)" + NON_CONTENT_SECTION)


def citations(answer: Column) -> Column:
    """Every cited source id in order, repeats included, in upper case."""
    groups = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1))
    return F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(F.upper(g), F.lit(r"S\d+"), F.lit(0))))


def verify(answer: Column, available: Column) -> Column:
    """struct of what an answer's citations did: cited, valid, fabricated, unused, marks and derived rates."""
    marks = citations(answer)
    cited = F.array_distinct(marks)
    have = F.transform(available, F.upper)
    fabricated = F.filter(cited, lambda s: ~F.array_contains(have, s))
    n = F.size(cited)
    return F.struct(
        cited.alias("cited"),
        F.filter(cited, lambda s: F.array_contains(have, s)).alias("valid"),
        fabricated.alias("fabricated"),
        F.filter(available, lambda s: ~F.array_contains(cited, F.upper(s))).alias("unused"),
        F.size(marks).alias("n_marks"),
        F.round(F.when(n == 0, F.lit(0.0)).otherwise(F.size(fabricated) / n), 4).alias("fabrication_rate"),
        (n > 0).alias("has_citations"),
        ((n > 0) & (F.size(fabricated) == 0)).alias("grounded"),
    )


def expand(answer: Column, names: Column, bracket_unknown: bool = True) -> Column:
    """Citations replaced by their sources' names: (A; B), or [A; S9 — NO SUCH SOURCE] if one is unknown.

    names: map from source id to what is shown. Marks are cut out by position and put back between the pieces.
    """
    pieces = F.split(answer, CITATION)
    groups = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1))

    def shown(group: Column) -> Column:
        ids = F.regexp_extract_all(F.upper(group), F.lit(r"S\d+"), F.lit(0))
        texts = F.array_join(F.transform(ids, lambda s: F.coalesce(F.element_at(names, s), F.concat(s, F.lit(" — NO SUCH SOURCE")))), "; ")
        unknown = F.exists(ids, lambda s: F.element_at(names, s).isNull()) & F.lit(bracket_unknown)
        return F.when(unknown, F.concat(F.lit("["), texts, F.lit("]"))).otherwise(F.concat(F.lit("("), texts, F.lit(")")))

    return F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(shown(F.get(groups, i)), F.lit("")))), "")


def is_refusal(answer: Column) -> Column:
    return F.contains(F.lower(answer), F.lit(REFUSAL))


def leaked_reasoning(answer: Column) -> Column:
    head = F.substring(F.lower(F.regexp_replace(answer, r"^\s+", "")), 1, 60)
    return F.exists(F.array(*map(F.lit, REASONING_OPENERS)), lambda o: F.startswith(head, o))


def strip_reasoning(text: Column) -> Column:
    once = F.regexp_replace(text, r"(?is)Thinking\.\.\..*?(?:\.\.\.done thinking\.|<\|end\|>)", "")
    return F.regexp_replace(F.regexp_replace(once, r"(?is)<think>.*?</think>", ""), r"^\s+|\s+$", "")


def fill_prompt(template: Column, question: Column, context: Column) -> Column:
    """Literal replacement, so braces inside the values are safe; the question goes in first."""
    return F.replace(F.replace(template, F.lit("{question}"), question), F.lit("{context}"), context)


def load_template(text: str, required: tuple[str, ...] = ("question", "context")) -> str:
    """A prompt template without its comment lines; fails if a placeholder is missing."""
    kept = "\n".join(line for line in text.splitlines() if not line.lstrip().startswith("#")).strip()
    missing = [r for r in required if "{" + r + "}" not in kept]
    if missing:
        raise ValueError(f"template lacks {missing}")
    return kept


def subqueries(raw: Column, question: Column, most: int = 3) -> Column:
    bare = lambda line: F.trim(F.regexp_replace(F.regexp_replace(line, r"^\s*(?:[-*•]|\d+[.)])\s*", ""), r"^\s+|\s+$", ""), F.lit('"'))
    preamble = lambda x: F.exists(F.array(*map(F.lit, PREAMBLES)), lambda p: F.startswith(F.lower(x), p))
    found = F.slice(F.filter(F.transform(F.split(raw, r"\r?\n"), bare), lambda x: (F.length(x) >= 3) & ~preamble(x)), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(question))


def grade(raw: Column) -> Column:
    return F.startswith(F.lower(F.regexp_replace(raw, r"^\s+", "")), F.lit("yes"))


def batch_grades(raw: Column, n: int) -> Column:
    """array<boolean> of n grades from `number: yes|no` entries; missing is no, a later entry for a number wins."""
    pattern = r"(?i)(\d+)\s*[:.)\-]\s*(yes|no)"
    number = F.transform(F.regexp_extract_all(raw, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))
    said = F.transform(F.regexp_extract_all(raw, F.lit(pattern), F.lit(2)), lambda x: F.lower(x) == "yes")
    last = lambda i: F.get(F.reverse(F.filter(said, lambda s, k: F.get(number, k) == i)), F.lit(0))
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.coalesce(last(i), F.lit(False)))


def route(grades: Column, attempt: Column) -> Column:
    return F.when(F.exists(grades, lambda g: g) | (attempt > 0), "generate").otherwise("rewrite")


def verdicts(raw: Column, expected: Column) -> Column:
    """array<struct<sid, verdict>> for the expected ids; skipped ones are unsupported. Null if there is no JSON."""
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    parsed = F.from_json(body, "verdicts array<struct<sid:string,verdict:string>>")["verdicts"]
    given = F.filter(
        F.transform(parsed, lambda v: F.struct(F.trim(F.upper(v["sid"]), F.lit("[]")).alias("sid"), F.trim(F.lower(v["verdict"])).alias("verdict"))),
        lambda v: v["verdict"].isin(*VERDICT_SCORES),
    )
    last = lambda s: F.get(F.reverse(F.filter(given, lambda v: v["sid"] == s)), F.lit(0))["verdict"]
    return F.when(parsed.isNotNull(), F.transform(expected, lambda s: F.struct(s.alias("sid"), F.coalesce(last(s), F.lit("unsupported")).alias("verdict"))))


def faithfulness(found: Column) -> Column:
    """Mean verdict score; null without verdicts."""
    score = F.create_map(*[F.lit(x) for kv in VERDICT_SCORES.items() for x in kv])
    total = F.aggregate(found, F.lit(0.0), lambda a, v: a + score[v["verdict"]])
    return F.when(F.size(found) > 0, total / F.size(found))


def question_of(raw: Column) -> Column:
    """The question in a reply: from its first JSON object, else its first longer line that ends in a question mark."""
    said = F.trim(F.get_json_object(F.regexp_extract(raw, r"(?s)\{.*?\}", 0), "$.question"))
    lines = F.filter(F.transform(F.split(raw, r"\r?\n"), lambda x: F.trim(F.trim(x), F.lit('"'))), lambda x: x.endswith("?") & (F.length(x) > 20))
    return F.coalesce(F.nullif(said, F.lit("")), F.get(lines, F.lit(0)))


def parse_json(text: str) -> dict | None:
    """An object from model text: fenced, bare, the outermost braces, or a cut-off one closed again (`_truncated`)."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    opened = text.find("{")
    tries = [fenced[1] if fenced else None, text, text[opened : text.rfind("}") + 1] if opened >= 0 else None]
    for t in tries:
        try:
            found = json.loads(t) if t else None
        except json.JSONDecodeError:
            continue
        if isinstance(found, dict):
            return found
    if opened < 0:
        return None
    stack, quoted, skip, last = [], False, False, 0
    body = text[opened:]
    for i, c in enumerate(body):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
        elif c == ",":
            last = i
    close = "".join(reversed(stack))
    for t in (body + '"' * quoted + close, body[:last] + close):
        try:
            return json.loads(t) | {"_truncated": True}
        except json.JSONDecodeError:
            continue
    return None


def injection(message: Column) -> Column:
    """What the first matching injection pattern matched, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(message, "(?i)" + p, 0), F.lit("")) for p in INJECTIONS])


def scrub(text: Column) -> Column:
    for label, pattern in PERSONAL:
        text = F.regexp_replace(text, "(?U)" + pattern, f"[{label} REDACTED]")
    return text


def gate(injected: Column, scope: Column, first_turn: Column, threshold: float = SCOPE_THRESHOLD) -> Column:
    """Why a message is blocked, null if it is not: injection on every turn, scope on the first only."""
    return F.when(injected.isNotNull(), "injection").when(first_turn & (scope < threshold), "out_of_scope")


def short_hash(text: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def validate(item: Column, books: Column) -> Column:
    """Names of the coherence rules that a golden item breaks."""
    types = ("factual", "definition", "explanation", "comparison", "multi_hop", "synthesis", "specific_source", "ambiguous", "numerical", "unanswerable")
    kind, hard, behaviour, can = item["question_type"], item["difficulty"], item["expected_behaviour"], item["answerable"]
    contexts = item["ground_truth_contexts"]
    some = F.size(contexts) > 0
    rules = {
        "question_type": ~kind.isin(*types),
        "difficulty": ~hard.isin("easy", "medium", "hard", "unanswerable"),
        "book": F.exists(contexts, lambda c: ~F.array_contains(books, c["book"])),
        "pages": F.exists(contexts, lambda c: c["page_start"] > c["page_end"]),
        "behaviour": ~behaviour.isin("answer", "clarify", "refuse"),
        "answerable_without_contexts": can & ~some,
        "contexts_without_answerable": ~can & some,
        "answerable_without_answer": can & (F.coalesce(item["ground_truth_answer"], F.lit("")) == ""),
        "refuse_but_answerable": (behaviour == "refuse") & can,
        "answer_but_not_answerable": behaviour.isin("answer", "clarify") & ~can,
        "unanswerable_must_refuse": (kind == "unanswerable") & (behaviour != "refuse"),
        "ambiguous_must_clarify": (kind == "ambiguous") & (behaviour != "clarify"),
    }
    return F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]), lambda x: x.isNotNull())
