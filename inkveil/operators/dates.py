"""Dates in text: candidates by form, context, validity, and the longest of overlapping ones."""

from __future__ import annotations

import datetime
import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions import patterns
from inkveil.functions.text import SPAN, accepted, let, spans_of

_DIGITS = str.maketrans("０１２３４５６７８９／－．　〇一二三四五六七八九", "0123456789/-. 0123456789")
_EIGHT_DIGITS = re.compile(next(pattern for name, pattern, *_ in patterns.DATE_FORMS if name == "digits"))

_ERA_YEAR = re.compile(rf"({'|'.join(sorted(patterns.ERAS, key=len, reverse=True))})(\d{{1,2}})")


@lru_cache(16)
def _parser(today: datetime.date):
    """dateutil's parser as of today: years of two digits are near its own year, which it takes from its clock."""
    from dateutil import parser

    info = parser.parserinfo(dayfirst=False, yearfirst=True)
    info._year, info._century = today.year, today.year // 100 * 100
    return parser.parser(info)


def normalised(raw: str) -> str:
    """A candidate in the form in which it is judged. A 10 and a digit become one number, as in 十一 (and in 2024101, which so is none)."""
    out = re.sub(r"10(\d)", lambda m: str(10 + int(m[1])), raw.translate(_DIGITS))
    out = _ERA_YEAR.sub(lambda m: str(patterns.ERAS[m[1]] + int(m[2])), out)
    return out.replace("年", "-").replace("月", "-").replace("日", "").strip("-").strip() if "年" in out or "月" in out else out


@lru_cache(1 << 16)
def is_date(raw: str, today: datetime.date) -> bool:
    """Whether a candidate is a date between 1900 and 2100; what it leaves out is as today. Of the strings a worker has judged, the last ones are known."""
    text = normalised(raw)
    if _EIGHT_DIGITS.fullmatch(text):  # months and days by their range alone
        return int(text[4:6]) in range(1, 13) and int(text[6:]) in range(1, 32)
    try:
        found = _parser(today).parse(text, default=datetime.datetime.combine(today, datetime.time()))
    except (ValueError, OverflowError):
        return False
    return 1900 <= found.year <= 2100


def _judged(raws: pa.Array, today: datetime.date) -> pa.Array:
    """For lists of candidates, whether each is a date; distinct strings are judged once."""
    coded = raws.flatten().dictionary_encode()
    valid = pa.array([is_date(raw, today) for raw in coded.dictionary.to_pylist()], pa.bool_()).take(coded.indices)
    sizes = pc.fill_null(pc.list_value_length(raws), 0).to_pylist()
    bounds = pc.cumulative_sum(pa.array([0, *sizes], pa.int32()))
    return pa.ListArray.from_arrays(bounds, valid)


def _valid(today: datetime.date):
    @F.arrow_udf("array<boolean>")
    def valid(raws: pa.Array) -> pa.Array:
        return _judged(raws, today)

    return valid


def date_candidates(text: Column, beside: tuple[Column, Column] | None = None) -> Column:
    """array<span>: all candidates by form and place; the short form only near a word that speaks of time, also in what stands beside (before and after) the text."""
    wide = patterns.CONTEXT_WIDTH
    context = "(?i)" + patterns.java(patterns.DATE_CONTEXT).replace("(?U)", "(?U)", 1)
    before, after = beside or (F.lit(""), F.lit(""))
    around = F.concat(before, text, after) if beside else text

    def near(x: Column, t: Column) -> Column:
        ahead = x["s"] + F.length(before) if beside else x["s"]
        first = F.greatest(ahead - wide, F.lit(0))
        return F.substring(t, first + 1, ahead + x["e"] - x["s"] + wide - first).rlike(context)

    unsure = F.array(*(F.lit(needs_context) for _, _, needs_context, _ in patterns.DATE_FORMS))
    every = spans_of(text, [(patterns.java(pattern), patterns.gate_for(pattern, gate)) for _, pattern, _, gate in patterns.DATE_FORMS])
    kept = lambda t: F.transform(every, lambda some, k: F.filter(some, lambda x: ~F.element_at(unsure, k + 1) | near(x, t)))
    return F.flatten(let(around, kept))


def valid_dates(candidates: Column, today: datetime.date) -> Column:
    """array<boolean> for candidates; needs Python, but only for what the patterns found."""
    return _valid(today)(F.transform(candidates, lambda x: x["raw"]))


def chosen_dates(candidates: Column, valid: Column) -> Column:
    """The valid candidates, longest first where they overlap (ties: in order), by place."""
    marked = F.transform(F.zip_with(candidates, valid, lambda c, v: F.struct(c.alias("c"), v.alias("v"))), lambda x, i: F.struct((x["c"]["s"] - x["c"]["e"]).alias("k"), i.alias("i"), x["c"].alias("c"), x["v"].alias("v")))
    longest = F.transform(F.array_sort(F.filter(marked, lambda x: x["v"])), lambda x: x["c"])
    return F.array_sort(accepted(longest, SPAN))
