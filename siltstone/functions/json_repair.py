"""Broken JSON as models write it, made to parse."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def repair_json(raw: str | None) -> str | None:
    """The text as valid JSON, or null.

    Fences and prose around the first bracket go, raw line breaks inside strings
    are escaped, commas before a closing bracket go, and what is still open at
    the end is closed.
    """
    if not raw:
        return None
    start = min((i for i in (raw.find("{"), raw.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    out, open_, inside, skip = [], [], False, False
    for c in raw[start:]:
        if inside:
            if skip:
                skip = False
            elif c == "\\":
                skip = True
            elif c == '"':
                inside = False
            elif c in "\n\r\t":
                c = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}[c]
            out.append(c)
            continue
        if c in "“”":
            c = '"'
        inside = c == '"'
        if c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]":
            if not open_ or open_.pop() != c:
                return None
        out.append(c)
        if not open_:
            break
    text = "".join(out) + '"' * inside
    text = re.sub(r",\s*$", "", text) + "".join(reversed(open_))
    text = re.sub(r",(\s*[}\]])", r"\1", text)
    try:
        return json.dumps(json.loads(text), ensure_ascii=False)
    except ValueError:
        return None


def repaired_json(raw: Column | str) -> Column:
    """Arrow-batched form of :func:`repair_json`; a stateful scan has no built-in equal."""

    def repair(texts: pd.Series) -> pd.Series:
        return texts.map(repair_json)

    return pandas_udf(repair, StringType())(raw)
