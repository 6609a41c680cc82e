"""Opening hours as ranges of minutes of the week."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAYS = ("mo", "tu", "we", "th", "fr", "sa", "su")
DAY, WEEK = 1440, 7 * 1440
RANGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_token = re.compile(r"\s*(?:(?P<all>24/7)|(?P<span>\d{1,2}:\d{2}\s*-\s*\d{1,2}:\d{2})\+?|(?P<day>mo|tu|we|th|fr|sa|su|ph)(?![a-z])|(?P<off>off|closed)(?![a-z])|(?P<mark>[-,:]))", re.I)


def _tokens(rule: str) -> list[tuple[str, str]] | None:
    """(kind, text) of a rule's parts; None if something in it is unknown."""
    out, at = [], 0
    rule = rule.rstrip()
    while at < len(rule):
        m = _token.match(rule, at)
        if not m:
            return None
        out.append((m.lastgroup, m[m.lastgroup].lower()))
        at = m.end()
    return out


def _span(text: str) -> tuple[int, int] | None:
    h, m, h2, m2 = map(int, re.findall(r"\d+", text))
    a, b = 60 * h + m, 60 * h2 + m2
    if a >= DAY or b > 2 * DAY or m >= 60 or m2 >= 60:
        return None
    return a, b + DAY if b <= a and b <= DAY else b


def _rules(tokens: list[tuple[str, str]]) -> list[tuple[list[int], list[tuple[int, int]]]] | None:
    """(days, spans) of the rules in one part between semicolons; those after the first add to what is there."""
    out, i = [], 0
    kinds = [k if k != "mark" else t for k, t in tokens] + ["end"]
    while kinds[i] != "end":
        days, named = [], kinds[i] == "day"
        while kinds[i] == "day":
            a = b = tokens[i][1]
            if kinds[i + 1] == "-":
                if kinds[i + 2] != "day" or "ph" in (a, tokens[i + 2][1]):
                    return None
                b, i = tokens[i + 2][1], i + 2
            if a != "ph":
                first, last = DAYS.index(a), DAYS.index(b)
                days += [(first + k) % 7 for k in range((last - first) % 7 + 1)]
            i += 1
            if kinds[i] == "," and kinds[i + 1] == "day":
                i += 1
            else:
                break
        if named and kinds[i] == ":":
            i += 1
        spans = []
        if kinds[i] == "all" and not named:
            spans, i = [(0, DAY)], i + 1
        elif kinds[i] == "off":
            i += 1
        elif kinds[i] == "span":
            while True:
                span = _span(tokens[i][1])
                if span is None:
                    return None
                spans.append(span)
                i += 1
                if kinds[i] == "," and kinds[i + 1] == "span":
                    i += 1
                else:
                    break
        elif named and kinds[i] == "end":
            spans = [(0, DAY)]
        else:
            return None
        if days or not named:
            out.append((days if named else list(range(7)), spans))
        else:
            out.append(([], []))
        if kinds[i] == "," and kinds[i + 1] == "day":
            i += 1
        elif kinds[i] != "end":
            return None
    return out


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap as one: where the number of open ones leaves and comes back to zero."""
    ends = sorted([(a, -1) for a, _ in spans] + [(b, 1) for _, b in spans])
    out, depth = [], 0
    for at, kind in ends:
        if depth == 0:
            start = at
        depth -= kind
        if depth == 0:
            out.append((start, at))
    return out


def week_ranges(value: str | None) -> list[tuple[int, int]] | None:
    """Sorted disjoint ranges; None for what is not understood or only closes some days, [] for always closed.

    Rules after a semicolon replace the days they name, rules after a comma before a weekday add to them; a
    later end than midnight runs into the next day, equal ends are the whole day, public holidays are dropped.
    """
    # one record for each day a rule names: (day, whether it adds, spans), in the order of the text
    records: list[tuple[int, bool, list[tuple[int, int]]]] = []
    for part in filter(str.strip, (value or "").split(";")):
        tokens = _tokens(part)
        rules = None if tokens is None else _rules(tokens)
        if rules is None:
            return None
        records += [(day, k > 0 and bool(spans), spans) for k, (days, spans) in enumerate(rules) for day in days]

    def of(day: int) -> list[tuple[int, int]]:
        own = [(adds, spans) for d, adds, spans in records if d == day]
        since = max((i for i, (adds, _) in enumerate(own) if not adds), default=0)
        return [s for _, spans in own[since:] for s in spans]

    days = [of(day) for day in range(7)]
    if not any(days) and len({d for d, *_ in records}) < 7:
        return None
    open_ = [(a + day * DAY, b + day * DAY) for day in range(7) for a, b in days[day]]
    # what runs past the end of the week is the beginning of the next one
    return joined([(a, min(b, WEEK)) for a, b in open_] + [(0, b - WEEK) for _, b in open_ if b > WEEK])


@F.pandas_udf(RANGES)
def opening_hours(s: pd.Series) -> pd.Series:
    """The ranges of each value; a value that repeats in a batch is read once."""
    known = {v: week_ranges(v) for v in s.dropna().unique()}
    return s.map(lambda v: known.get(v) if isinstance(v, str) else None)
