"""Column expressions that profile chat messages: style, preferences, expertise, feedback, corrections, actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import match_count

# Patterns of the message detectors; all are matched whatever the case.
CASUAL = (r"\bhey\b", r"\bthanks\b", r"\bthx\b", r"\bcool\b", r"\bawesome\b", r"\bgreat\b", r"\bnice\b", r"\byeah\b", r"\byep\b", r"\bnope\b", r"\bgotcha\b", r"\bsure\b", r"\bbtw\b", r"\bfyi\b", r"\blol\b", r"\bhaha\b", r"!+", r"\bk\b", r"\bok\b")
FORMAL = (r"\bplease\b", r"\bkindly\b", r"\bwould you\b", r"\bcould you\b", r"\bi would appreciate\b", r"\bthank you\b", r"\bregards\b", r"\brespe[c]?tfully\b", r"\baccordingly\b", r"\bfurthermore\b", r"\bpursuant\b", r"\bhereby\b")
URGENT = (r"\basap\b", r"\burgent\b", r"\bdeadline\b", r"\bimmediately\b", r"\bright away\b", r"\bquick\b", r"\bhurry\b", r"\beod\b", r"\btoday\b", r"\bnow\b", r"\bpriority\b", r"\bcritical\b", r"\btime.?sensitive\b", r"\brushed\b")
TECHNICAL = (r"\d+\.?\d*\s*(kpa|psi|mpa|kn|psf|ksf|m|ft|mm|kg|g|mol|hz|ghz)", r"\b(c|phi|gamma|sigma|tau|epsilon|delta|alpha|beta|lambda|mu)\b", r"\d+\s*[x×]\s*\d+", r"=\s*\d+", r"\b\d+(\.\d+)?%\b")
SHORTER, LONGER = r"\b(too long|too detailed|tl;?dr|be concise|shorter)\b", r"\b(too short|more detail|elaborate|be thorough|longer)\b"
FORMATS = ((r"\b(use bullets|bullet points|make a list|bulleted)\b", "bullets"), (r"\b(no bullets|in prose|paragraph form|no lists)\b", "prose"), (r"\b(use a table|in table format|tabular)\b", "table"))
UNITS = ((r"\b(in metric|use metric|metres|meters|kPa\b|kN\b)", "metric"), (r"\b(in imperial|use imperial|feet|psf\b|psi\b)", "imperial"))
REASONING = ((r"\b(show your work|explain.{0,10}reasoning|step by step)\b", True), (r"\b(just the answer|skip the explanation|bottom line)\b", False))
NEGATIVE = (r"\b(wrong|incorrect|not right|mistake)\b", r"\b(no|nope),?\s+(that|the|it)", r"\bactually,?\s*(it|the|that|you)", r"\b(doesn't|didn't|isn't|wasn't)\s+work", r"\b(not what|that's not)\s+", r"\b(error|problem|issue)\s+with")
POSITIVE = (r"\b(thanks|thank you|thx|ty)\b", r"\b(great|awesome|perfect|excellent|wonderful)\b", r"\b(helpful|useful|exactly|spot on)\b", r"\b(good job|well done|nice work)\b", r"\b(that helps|makes sense|got it)\b")
LEVELS = {
    "junior": (r"\b(I'?m (an? )?(EIT|intern|student|learning|new to))\b", r"\bcan you explain\b.*\bto me\b", r"\bwhat (is|are|does) (a |an |the )?\w+\b", r"\bhow do (I|you|we) (calculate|determine|find)\b", r"\bi('?m| am) (not sure|confused|unsure)\b", r"\b(never done|first time|haven'?t done)\b"),
    "senior": (r"\b(verify|check|review) (this|my|these)\b", r"\b(edge case|typical practice|your (take|read|opinion))\b", r"\b(assuming .{15,})\b", r"\b(in my experience|typically I|usually we)\b", r"\b(sanity check|gut check|double.?check)\b", r"\b(code (says|requires|specifies)|per (the|CFEM|NBC))\b", r"\b(second opinion|another perspective)\b"),
    "management": (r"\b(executive |high-level )?(summary|overview)\b", r"\b(bottom line|net-net|upshot)\b", r"\b(risk|cost|schedule|budget) (impact|implication)\b", r"\b(client|stakeholder) (meeting|presentation|call)\b", r"\bfor (the proposal|our bid|the client)\b", r"\b(decision|go.?no.?go|recommendation)\b", r"\bkeep it (brief|short|simple)\b"),
}
ACTIONS = ((r"upload|attached|here'?s?\s+(?:the|a|my)", "file_upload"), (r"(?:\d+\s*[\+\-\*\/]\s*\d+|calculate|compute|formula)", "math_interest"), (r"(?:code|script|function|class|import|def\s)", "code_interest"), (r"\?$|^(?:what|how|why|when|where|who|is|are|can|could|would|should)\b", "question"))
CORRECTIONS = ((r"no[,.]?\s*(?:i\s+)?meant?\s+(.+)", 0.9), (r"actually[,.]?\s*(?:it'?s?|i\s+want(?:ed)?|it\s+should\s+be)\s+(.+)", 0.85), (r"(?:that'?s?\s+)?(?:wrong|incorrect)[,.]?\s*(.+)?", 0.9), (r"(?:don'?t|stop|never)\s+(?:us(?:e|ing)|say(?:ing)?|call(?:ing)?|assum(?:e|ing)|do(?:ing)?)\s+(.+)", 0.95), (r"(?:always|whenever)\s+(?:us(?:e|ing)|say(?:ing)?|assum(?:e|ing)|call(?:ing)?|do(?:ing)?)\s+(.+)", 0.9), (r"(?:too|way\s+too)\s+(long|short|detailed|brief|verbose|technical|simple)", 0.8), (r"i\s+(?:said|asked\s+for|wanted|meant)\s+(.+?)(?:,|\s+not\s+|\s*$)", 0.85), (r"(?:i\s+)?prefer\s+(.+?)(?:\s+(?:instead|over|rather)\s+|$)", 0.75), (r"(?:please\s+)?use\s+(.+?)\s+instead(?:\s+of\s+)?", 0.85))
CONTEXT_WORDS = ("metric", "imperial", "si", "units", "meters", "feet", "inches", "mm", "brief", "detailed", "summary", "bullets", "list", "table")
# How a correction says what is wrong and what is right.
NEVER = r"(?:don'?t|stop|never)\s+(?:us(?:e|ing)|say(?:ing)?|call(?:ing)?|assum(?:e|ing)|do(?:ing)?)\s+(.+?)"
NEVER_BUT = NEVER + r"(?:,\s*(?:use|say)\s+(.+?)\s+instead|,\s*instead\s+(?:use|say)\s+(.+?)|$)"
NEVER_END = NEVER + r"(?:\s*[,.]|$)"
ALWAYS = r"(?:always|whenever)\s+(?:use|say|assume|call|do)\s+(.+?)(?:\s*[,.]|$)"
TOO = r"(?:too|way\s+too)\s+(long|short|detailed|brief|verbose|technical|simple)"
RATHER = r"(.+?)\s+(?:not|instead\s+of)\s+(.+?)(?:\s*[,.]|$)"
OPPOSITES = {
    "long": ("long responses", "shorter responses"), "short": ("short responses", "more detailed responses"), "detailed": ("overly detailed responses", "concise responses"), "brief": ("too brief responses", "more complete responses"),
    "verbose": ("verbose responses", "concise responses"), "technical": ("overly technical language", "simpler explanations"), "simple": ("oversimplified responses", "more technical detail"),
}
# Question patterns.
CROSS = ("compare (?:and contrast)?", "difference(?:s)? between", "(?:vs|versus)", "similarities between", "how (?:does|do) .+ (?:differ|compare)")
GLOBAL = (
    "what are the (?:main|major|key|primary|different|various)", "(?:overview|summary|introduction|fundamentals) of", "explain (?:the|how|what|why)", "describe (?:the|how|what)", "types? of", "categories? of", "classification of", "pros and cons", "advantages (?:and disadvantages)?",
    "(?:general|overall|broad) (?:considerations|approach|guidelines)", "considerations? for", "factors? (?:affecting|influencing|that)", "principles? of", "best practices? for", "how do(?:es)? .+ work", "what is (?:the role|importance) of", "when (?:should|to) use",
)
LOCAL = ("what is the (?:value|range|typical|exact)", "how much", "how many", "what (?:is|are) the (?:specific|exact)", "calculate", "formula for", "equation for", "compute", "according to (?:astm|aashto|asce|csa)", r"(?:astm|aashto|asce) [a-z]?\d+", "per (?:astm|aashto|code)", "specification for", "define ", "definition of")


def any_case(patterns) -> list[str]:
    return ["(?i)" + p for p in patterns]


def words(text: Column) -> Column:
    """Number of words between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def formality(text: Column) -> Column:
    """From -1 (casual) to 1 (formal), 0 without a sign of either."""
    casual, formal = match_count(text, any_case(CASUAL)), match_count(text, any_case(FORMAL))
    return F.when(casual + formal > 0, (formal - casual) / (casual + formal)).otherwise(F.lit(0.0))


def urgency(text: Column) -> Column:
    n = match_count(text, any_case(URGENT))
    return F.when(n >= 2, "urgent").when(n == 1, "normal").otherwise("relaxed")


def technical_depth(text: Column) -> Column:
    return F.least(F.lit(1.0), match_count(text, any_case(TECHNICAL)) / 5.0)


def first_match(text: Column, patterns) -> Column:
    """The value of the first pattern found, null if there is none."""
    out = F.lit(None)
    for pattern, value in reversed(patterns):
        out = F.when(text.rlike("(?i)" + pattern), F.lit(value)).otherwise(out)
    return out


def last_match(text: Column, patterns) -> Column:
    return first_match(text, tuple(reversed(patterns)))


def feedback(text: Column) -> Column:
    """Negative signs before positive ones; null without any."""
    return first_match(text, [(p, "negative") for p in NEGATIVE] + [(p, "positive") for p in POSITIVE])


def shows(text: Column, level: str) -> Column:
    """1 if a message shows a level of expertise, however often."""
    return (match_count(text, any_case(LEVELS[level])) > 0).cast("int")


def expertise(depth: Column, junior: Column, senior: Column, management: Column) -> Column:
    """Level from technical depth and what a session has shown so far. A senior's signs count twice beside a junior's;
    three signs decide; where the most is one, it decides if it agrees with the depth."""
    base = F.when(depth < 0.05, "junior").when(depth > 0.5, "senior").otherwise("intermediate")
    senior = F.when((senior > 0) & (junior > 0), senior * 2).otherwise(senior)
    most = F.greatest(junior, senior, management)
    one = most == 1
    return (
        F.when((most >= 3) & (management == most), "management").when((most >= 3) & (senior == most), "senior").when(most >= 3, "junior")
        .when(one & (management == 1), "management").when(one & (senior == 1) & (base != "junior"), "senior").when(one & (junior == 1) & (base == "junior"), "junior")
        .otherwise(base)
    )


def question_class(text: Column) -> Column:
    """struct(kind, confidence) of a question."""
    t = F.lower(F.trim(text))
    cross, wide, near = (match_count(t, any_case(p)) for p in (CROSS, GLOBAL, LOCAL))
    n = words(text)
    guess = (
        F.when(n <= 3, "hybrid").when(t.startswith("what are") | t.startswith("how do") | t.startswith("why"), "global").when(t.startswith("what is") & (n <= 6), "local").when(n >= 10, "local").otherwise("hybrid")
    )
    share = lambda x: F.least(F.lit(0.95), x / (wide + near + 1) + 0.3)
    kind = F.when(cross > 0, "cross_ref").when(wide + near == 0, guess).when(wide > near, "global").when(near > wide, "local").otherwise("hybrid")
    sure = F.when(cross > 0, F.least(F.lit(0.95), 0.5 + cross * 0.2)).when(wide + near == 0, 0.5).when(wide > near, share(wide)).when(near > wide, share(near)).otherwise(0.6)
    return F.struct(kind.alias("kind"), F.round(sure, 6).alias("confidence"))


def correction_said(text: Column) -> Column:
    """struct(wrong, right) where a message says either in a way that is known; else null."""
    low = F.lower(text)
    part = lambda pattern, group: F.trim(F.regexp_extract(low, pattern, group))
    none = F.lit("")
    both = lambda wrong, right: F.struct(wrong.alias("wrong"), right.alias("right"))
    too = F.regexp_extract(low, TOO, 1)
    opposite = [F.coalesce(F.create_map(*(F.lit(x) for k, v in OPPOSITES.items() for x in (k, v[i])))[too], none) for i in (0, 1)]
    return (
        F.when(low.rlike(NEVER_BUT), both(part(NEVER_BUT, 1), F.concat(part(NEVER_BUT, 2), part(NEVER_BUT, 3))))
        .when(low.rlike(NEVER_END), both(part(NEVER_END, 1), none)).when(low.rlike(ALWAYS), both(none, part(ALWAYS, 1))).when(low.rlike(TOO), both(*opposite)).when(low.rlike(RATHER), both(part(RATHER, 2), part(RATHER, 1)))
    )


def corrected(rows: DataFrame, text_col: str) -> DataFrame:
    """The rows that correct an answer, with kind (the number of the first pattern that shows it and gives something), wrong
    and right. Messages of fewer than five characters correct nothing."""
    text, low = F.col(text_col), F.lower(F.trim(text_col))
    said, ways = F.col("_said"), []
    for i, (pattern, _) in enumerate(CORRECTIONS):
        caught = F.trim(F.coalesce(F.regexp_extract(low, "(?i)" + pattern, 1), F.lit("")))
        rest = F.when(caught != "", caught).when(F.length(text) < 100, F.trim(text)).otherwise("")
        own = F.struct(F.lit(i).alias("kind"), F.when(said.isNull(), "").otherwise(said["wrong"]).alias("wrong"), F.when(said.isNull(), rest).otherwise(said["right"]).alias("right"))
        ways.append(F.when(low.rlike("(?i)" + pattern), own))
    # a generator gives the first way or no row, and keeps the expressions before and behind it apart
    first = F.slice(F.filter(F.array(*ways), lambda w: (w["wrong"] != "") | (w["right"] != "")), 1, 1)
    rows = rows.where(F.length(low) >= 5).withColumn("_said", correction_said(text))
    return rows.select("*", F.inline(first)).drop("_said")
