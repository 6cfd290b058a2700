"""Predicates and rewrites of questions and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import STOP_WORDS, hits

# Signs in questions and answers.
BROAD = ("overview", "summary", "summarize", "explain", "main", "key", "principles", "concepts", "introduction", "describe", "general", "overall", "compare", "relationship", "themes")
CODE = r"(?i)\b(code|script|function|class|import|python|sql)\b"
NUMBER = r"\d"
ABSTAIN = ("i don't know", "not available", "no information", "cannot determine", "not mentioned", "insufficient")
CONTINUES = ("continue", "keep going", "go on", "more of", "pull more", "show more", "what else", "any more", "any other", "next ones")
REFERS = ("what about", "tell me more", "can you also", "how about", "and the")
GREETS = ("hi", "hello", "hey", "thanks", "thank you", "ok", "okay", "bye", "good morning", "good evening", "help", "what can you do")
WRITES = r"\b(CREATE|MERGE|DELETE|DETACH|SET|REMOVE|DROP|INSERT|UPDATE|ALTER|CALL|LOAD)\b"


def broad(text: Column) -> Column:
    """Whether a question is for summaries: a sign of breadth, or four words at most."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.exists(F.array(*map(F.lit, BROAD)), lambda w: F.contains(F.lower(text), w)) | (words <= 4)


def read_only(query: Column) -> Column:
    """Whether a query has none of the words that write."""
    return ~F.upper(query).rlike(WRITES)


def route_score(text: Column, keywords: Column, similarity: Column | None = None) -> Column:
    """How well a topic fits: its keywords' hits, five at most, and a similarity from -1 to 1 if there is one."""
    words = F.least(hits(text, keywords) / 5, F.lit(1.0))
    return words if similarity is None else 0.3 * words + 0.7 * (similarity + 1) / 2


def content_words(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), 0)
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*STOP_WORDS)))


def overlap(answer: Column, truth: Column) -> Column:
    """The share of the truth's content words that an answer has; for a truth without any, 1 if the answer has words, else 0.5."""
    n = F.size(truth)
    return F.when(n == 0, F.when(F.size(answer) > 0, 1.0).otherwise(0.5)).otherwise(F.size(F.array_intersect(answer, truth)) / n)


def abstains(text: Column) -> Column:
    return F.exists(F.array(*map(F.lit, ABSTAIN)), lambda p: F.contains(F.lower(text), p))


def expanded(text: Column, groups: list[list[str]], most: int = 3) -> Column:
    """A question with up to three shortest synonyms, not yet in it, of the terms that it has; longer ones first."""
    pairs = sorted({(a.lower(), b.lower()) for g in groups for a in g for b in g if a.lower() != b.lower()}, key=lambda p: (-len(p[0]), p[0], len(p[1]), p[1]))
    low = F.lower(text)
    found = F.filter(F.array(*(F.when(F.contains(low, F.lit(a)) & ~F.contains(low, F.lit(b)), F.lit(b)) for a, b in pairs)), lambda x: x.isNotNull())
    chosen = F.slice(F.array_distinct(found), 1, most)
    return F.when(F.size(chosen) > 0, F.concat(text, F.lit(" "), F.array_join(chosen, " "))).otherwise(text)


def session_score(score: Column) -> Column:
    """A session search's score on the display scale."""
    return F.when(score >= 0.5, F.least(F.lit(0.98), 0.85 + (score - 0.5) * 0.26)).when(score >= 0.3, 0.6 + (score - 0.3) * 1.25).when(score >= 0.1, 0.3 + (score - 0.1) * 1.5).otherwise(score * 3.0)


def live_latency(ms: Column) -> Column:
    """1 up to half a second, then down to 0.7 at two, 0.3 at five and 0 at ten."""
    return F.when(ms <= 500, 1.0).when(ms <= 2000, 1.0 - (ms - 500) / 1500 * 0.3).when(ms <= 5000, 0.7 - (ms - 2000) / 3000 * 0.4).otherwise(F.greatest(F.lit(0.0), 0.3 - (ms - 5000) / 5000 * 0.3))


def technical(text: Column, patterns: tuple[str, ...] = (), skips: tuple[str, ...] = ()) -> Column:
    """Whether a message is a question that should be searched for: not a short one that goes on or refers to what was said,
    no greeting, nothing to skip; where a domain gives patterns, one of these must be found."""
    low = F.lower(F.trim(text))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)) if words else F.lit(False)
    refers = F.lit(False)
    for phrase in REFERS:
        refers = refers | low.startswith(phrase)
    found = F.lit(not patterns)
    for pattern in patterns:
        found = found | low.rlike(pattern)
    n = F.length(low)
    return ~(has(CONTINUES) & (n < 60)) & ~(refers & (n < 50)) & (n >= 15) & ~has(skips) & ~low.isin(*GREETS) & found
