"""JSON inside text: found, repaired and parsed as far as that goes."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def repaired(text: str | None) -> str | None:
    """The first JSON object or array in a text as strict JSON, null if there is none that can be mended: other text around
    it, Python's words, single quotes, bare keys, commas before closing brackets and brackets never closed are mended."""
    if not text:
        return None
    start = re.search(r"[{\[]", text)
    if not start:
        return None
    body = text[start.start() :]
    try:
        return json.dumps(json.JSONDecoder().raw_decode(body)[0], ensure_ascii=False)
    except ValueError:
        pass
    out, stack, quote, i = [], [], "", 0
    while i < len(body):
        c = body[i]
        if quote:
            if c == "\\" and i + 1 < len(body):
                out.append(body[i : i + 2])
                i += 2
                continue
            out.append('"' if c == quote else '\\"' if c == '"' else c)
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
            out.append('"')
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
            out.append(c)
        elif c in "}]":
            if not stack:
                break
            out.append(stack.pop())
            if not stack:
                break
        elif word := re.match(r"[A-Za-z_][\w-]*", body[i:]):
            plain = {"None": "null", "True": "true", "False": "false"}.get(word[0], word[0])
            out.append(plain if plain in ("null", "true", "false") else json.dumps(plain))
            i += len(word[0])
            continue
        else:
            out.append(c)
        i += 1
    mended = re.sub(r",(\s*[}\]])", r"\1", "".join(out).rstrip().rstrip(",") + ('"' if quote else "") + "".join(reversed(stack)))
    try:
        return json.dumps(json.loads(mended), ensure_ascii=False)
    except ValueError:
        return None


def repair_json(text: Column) -> Column:
    @F.pandas_udf("string")
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(repaired)

    # Spark's own parser takes what is strict already
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise(each(text))
