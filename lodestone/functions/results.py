"""Result pages of a web search, as JSON or HTML, into results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How results, their links and their texts are marked, and how much of a text is kept.
ARTICLE = r"(?is)<article[^>]*class=[\"'][^\"']*result[^\"']*[\"'][^>]*>(.*?)</article>"
LINK = r"(?is)<a[^>]*href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"
CONTENT = r"(?is)<p[^>]*class=[\"'][^\"']*content[^\"']*[\"'][^>]*>(.*?)</p>"
PREVIEW = 300
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
_FIELDS = "struct<results:array<struct<title:string,url:string,content:string>>>"


def unescaped(text: Column) -> Column:
    """Common character references decoded, & last."""
    for name, character in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(character))
    return text


def plain(html: Column) -> Column:
    """Text without tags, decoded, white space as one space."""
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(html, "<[^>]+>", " ")), r"[\s ]+", " "))


def _result(title: Column, url: Column, content: Column) -> Column:
    return F.struct(title.alias("title"), url.alias("url"), F.substring(content, 1, PREVIEW).alias("content"))


def from_json(text: Column, limit: int) -> Column:
    """The first results of a JSON page, trimmed; missing fields are empty, and what isn't such JSON has none."""
    trimmed = lambda c: F.trim(F.coalesce(c, F.lit("")))
    found = F.coalesce(F.from_json(text, _FIELDS)["results"], F.array().cast("array<struct<title:string,url:string,content:string>>"))
    return F.transform(F.slice(found, 1, limit), lambda r: _result(trimmed(r["title"]), trimmed(r["url"]), trimmed(r["content"])))


def from_html(text: Column, limit: int) -> Column:
    """The first results of an HTML page that have a link elsewhere (none, or one within the site, doesn't count)."""
    blocks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ARTICLE), 1)

    def one(block: Column) -> Column:
        return _result(plain(F.regexp_extract(block, LINK, 2)), F.trim(unescaped(F.regexp_extract(block, LINK, 1))), plain(F.regexp_extract(block, CONTENT, 1)))

    return F.slice(F.filter(F.transform(blocks, one), lambda r: (r["url"] != "") & ~r["url"].startswith("/")), 1, limit)
