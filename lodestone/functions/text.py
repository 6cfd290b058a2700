"""Column expressions on text: tokens, n-grams, cleaning, similarity. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the lexical index.
STOP_WORDS = (
    "a an the and or but in on at to for of with by from as is was are were be been being have has had do does did will would "
    "could should may might must shall can this that these those it its they them their what which who whom when where why how"
).split()
#: Tokens of the lexical index: letters and digits, joined inside by single hyphens or points.
TOKEN = "[a-z0-9]+(?:[-.]?[a-z0-9]+)*"
#: Tokens of the corpus profile.
TERM = "[a-zA-Z][a-zA-Z0-9-]*[a-zA-Z0-9]|[a-zA-Z]"


def tokens(text: Column, keep: tuple[str, ...] = ()) -> Column:
    """Lower-case tokens without stop words and single characters, but for those to keep."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)
    return F.filter(found, lambda t: t.isin(*keep) | (~t.isin(*STOP_WORDS) & (F.length(t) > 1)) if keep else ~t.isin(*STOP_WORDS) & (F.length(t) > 1))


def terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), 0), F.lower)


def valid_term(term: Column, stop_words=STOP_WORDS) -> Column:
    """Three characters or more, not one character again and again, no stop word. (Terms start with a letter.)"""
    return (F.length(term) >= 3) & (F.replace(term, F.substring(term, 1, 1), F.lit("")) != "") & ~term.isin(*stop_words)


def term_ngrams(all_terms: Column, n: int, stop_words=STOP_WORDS) -> Column:
    """Runs of n terms whose first and last are no stop words and have two characters or more."""
    # the array beside itself, one step on each time: what a lambda captures is computed for each element
    shifted = [F.slice(all_terms, k + 1, F.greatest(F.size(all_terms) - k, F.lit(0))).alias(f"t{k}") for k in range(n)]
    first, last = (lambda z: z["t0"]), (lambda z: z[f"t{n - 1}"])
    fit = lambda x: ~x.isin(*stop_words) & (F.length(x) >= 2)
    good = F.filter(F.arrays_zip(*shifted), lambda z: last(z).isNotNull() & fit(first(z)) & fit(last(z)))
    return F.transform(good, lambda z: F.concat_ws(" ", *(z[f"t{k}"] for k in range(n))))


def term_windows(all_terms: Column) -> Column:
    """Each term with the two behind it: an array of structs t0, t1, t2, null beyond the end."""
    return F.arrays_zip(*(F.slice(all_terms, k + 1, F.greatest(F.size(all_terms) - k, F.lit(0))).alias(f"t{k}") for k in range(3)))


def profile_terms(stop_words=STOP_WORDS) -> Column:
    """The term, pair and triple that columns t0, t1, t2 make for the corpus profile: an array with nulls for those that
    aren't valid."""
    t0, t1, t2 = (F.col(f"t{k}") for k in range(3))
    fit = lambda x: ~x.isin(*stop_words) & (F.length(x) >= 2)
    return F.array(F.when(valid_term(t0, stop_words), t0), F.when(fit(t0) & fit(t1), F.concat_ws(" ", t0, t1)), F.when(fit(t0) & fit(t2), F.concat_ws(" ", t0, t1, t2)))


def word_set(text: Column) -> Column:
    """Distinct words between white space, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct elements; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    a, b = (F.trim(F.regexp_replace(x, r"\s+", " ")) for x in (a, b))
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / most)


def hits(text: Column, keywords: Column) -> Column:
    """How many of an array's keywords are in the text, whatever their case."""
    return F.size(F.filter(keywords, lambda k: F.contains(F.lower(text), F.lower(k))))


def clean_title(source: Column) -> Column:
    """A readable title from a file's path."""
    name = F.regexp_replace(F.regexp_extract(source, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    for pattern in (r"^\d{10,}-", r"^\[\d+\]", r"[\(_]\d{4}[\)]?$"):
        name = F.regexp_replace(name, pattern, "")
    name = F.trim(F.regexp_replace(F.translate(name, "_-", "  "), r"\s+", " "))
    name = F.when(name == F.lower(name), F.initcap(name)).otherwise(name)
    name = F.when(F.length(name) > 60, F.concat(F.substring(name, 1, 57), F.lit("..."))).otherwise(name)
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("Unknown Source")).otherwise(name)


#: Character references that strip_html decodes.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def strip_html(text: Column) -> Column:
    """Text without tags, with references decoded and white space made single spaces."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")
    for entity, character in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(character))
    return F.trim(F.regexp_replace(out, "[\\s ]+", " "))


def url_key(url: Column) -> Column:
    """What equal pages share: the address in lower case, without query and closing slashes."""
    return F.rtrim(F.element_at(F.split(F.lower(url), r"\?"), 1), F.lit("/"))


def url_quality(url: Column, best: tuple[str, ...], good: tuple[str, ...]) -> Column:
    """2 for an address that holds one of the best domains, 1 for one of the good, else 0."""
    has = lambda names: F.exists(F.array(*map(F.lit, names)), lambda d: F.contains(F.lower(url), d))
    return F.when(has(best), 2).when(has(good), 1).otherwise(0)


def match_count(text: Column, patterns) -> Column:
    """How many of the patterns are found in the text."""
    return sum((text.rlike(p).cast("int") for p in patterns), F.lit(0))


def chunk_id(content: Column, *parts: Column) -> Column:
    """16 hex digits from the non-empty parts and the content's digest."""
    filled = [F.when(p != "", p) for p in parts]
    return F.substring(F.md5(F.concat_ws(":", *filled, F.substring(F.md5(content), 1, 8))), 1, 16)


def cleaned(text: Column) -> Column:
    """Extracted text with at most one empty line in a row, words that a line's end parts joined, and no null characters."""
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    return F.regexp_replace(F.replace(text, F.lit("\0"), F.lit("")), r"^\s+|\s+$", "")


# What titles don't start with, and signs of figures and equations.
NO_TITLES = ("page", "chapter", "table", "figure", "copyright")
FIGURE, EQUATION, MATH = r"(?i)(?:Figure|Fig\.?)\s+\d+", r"[a-z]\s*=\s*[a-z0-9]", "∫∑∏√∞≈≠≤≥±×÷αβγδεθλμπσφω"


def title_line(text: Column) -> Column:
    """The first of a text's first fifteen lines that looks like a title: of 11 to 149 characters, no number, and not the
    start of a page, chapter, table, figure or notice; null without any."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 15), lambda x: F.trim(x))
    fit = lambda x: (F.length(x) > 10) & (F.length(x) < 150) & ~F.lower(x).rlike("^(?:" + "|".join(NO_TITLES) + ")") & ~x.rlike(r"^\d+$")
    return F.get(F.filter(lines, fit), F.lit(0))


def math_signs(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, MATH, ""))


def by_length(text: Column, pages: Column) -> Column:
    """Text cut into so many pieces of equal length, the last with the rest."""
    each = F.floor(F.length(text) / pages).cast("int")
    piece = lambda i: F.substring(text, i * each + 1, F.when(i == pages - 1, F.length(text)).otherwise(each))
    return F.transform(F.sequence(F.lit(0), pages.cast("int") - 1), piece)


def display_name(path: Column) -> Column:
    """A file's name as it is shown: no ending, spaces for underscores and hyphens, 60 characters at most."""
    name = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    name = F.trim(F.regexp_replace(F.translate(name, "_-", "  "), r"\s+", " "))
    name = F.when(F.length(name) > 60, F.concat(F.substring(name, 1, 57), F.lit("..."))).otherwise(name)
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("Document")).otherwise(name)


def inline_citation(title: Column, page: Column, section: Column) -> Column:
    """[Title, p.X, Section], the title cut to 50 and the section to 30 characters; parts that are empty or 0 are left out."""
    short = F.when(F.length(title) > 50, F.concat(F.substring(title, 1, 50), F.lit("..."))).otherwise(title)
    parts = F.concat_ws(", ", F.when(title != "", short), F.when(page != 0, F.concat(F.lit("p."), page.cast("string"))), F.when(section != "", F.substring(section, 1, 30)))
    return F.concat(F.lit("["), F.when(parts == "", F.lit("Unknown")).otherwise(parts), F.lit("]"))


def reference(number: Column, title: Column, page: Column, section: Column) -> Column:
    """[1] Title Section: S Page X, without the parts that are empty or 0."""
    return F.concat_ws(" ", F.concat(F.lit("["), number.cast("string"), F.lit("]")), F.when(title != "", title), F.when(section != "", F.concat(F.lit("Section: "), section)), F.when(page != 0, F.concat(F.lit("Page "), page.cast("string"))))
