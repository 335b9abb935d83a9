"""Names of persons and organisations, by custom names, titles, legal forms and surnames."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions import patterns
from inkveil.functions.text import accepted, empty, kinds_of, let, spans

ENTITY = "struct<s:int,e:int,raw:string,cat:string>"
PERSON, ORGANISATION = "人物", "組織"
MODES = {"heuristic": "辞書＋ヒューリスティック", "model": "系列モデル"}
ALIASES = {"人物": PERSON, "人名": PERSON, "PER": PERSON, "組織": ORGANISATION, "ORG": ORGANISATION}


def mode(model=None) -> str:
    """How names are found, as shown to users: by the model that detect is given (see tagger), or else by dictionaries and forms."""
    return MODES["heuristic" if model is None else "model"]


def custom_names(lines: list[str]) -> list[tuple[str, str]]:
    """(category, name) of lines `category,name`; comments, other lines and unknown categories are passed over."""
    rows = [[p.strip() for p in line.strip().split(",", 1)] for line in lines if line.strip() and not line.strip().startswith("#")]
    return sorted({(ALIASES[r[0]], r[1]) for r in rows if len(r) == 2 and r[0] in ALIASES and r[1]})


def _as(category: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["raw"].alias("raw"), F.lit(category).alias("cat")))


def _literal(text: Column, words: list[str], suffix: str = "") -> Column:
    """Spans of each word (and what suffix matches after it), word by word; only words that the text holds are searched."""
    held = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    return F.flatten(F.transform(held, lambda w: spans(text, F.concat(F.lit("(?U)\\Q"), w, F.lit("\\E" + suffix)))))


def entities(text: Column, custom: list[tuple[str, str]] | None = None, listed: Column | None = None) -> Column:
    """array<struct<s, e, raw, cat>> by place. Names of a table (listed: where they are, see gazetteer) come first, then custom persons, custom organisations, names before titles, organisations by form, surnames; what overlaps an earlier one is passed over."""
    found = [] if listed is None else [listed]
    for category in (PERSON, ORGANISATION):
        names = sorted({n for c, n in custom or [] if c == category}, key=lambda n: (-len(n), n))
        if names:
            found.append(_as(category, _literal(text, names)))
    titles = F.array(*map(F.lit, patterns.TITLES))
    any_surname = f"{patterns.first_letters(patterns.SURNAMES)}(?:{'|'.join(patterns.ORDERED_SURNAMES)})[\\u4E00-\\u9FFF]"

    def formed(has: Column) -> Column:
        """By titles, by forms of companies, by surnames."""
        titled = spans(text, patterns.java(patterns.TITLED_NAME), patterns.words_gate(patterns.TITLES).open(text, has))
        companies = spans(text, patterns.java(patterns.COMPANY), patterns.words_gate(patterns.COMPANY_FORMS + patterns.LEADING_FORMS).open(text, has))
        surnames = F.when(has["wide"] & text.rlike(any_surname), _literal(text, list(patterns.ORDERED_SURNAMES), patterns.GIVEN_NAME)).otherwise(empty("struct<s:int,e:int,raw:string>"))
        return F.concat(_as(PERSON, F.filter(titled, lambda x: ~F.array_contains(titles, x["raw"]))), _as(ORGANISATION, companies), _as(PERSON, surnames))

    found.append(let(kinds_of(text, {"wide"}), formed))
    sound = F.filter(F.concat(*found), lambda x: (F.length(x["raw"]) > 1) & x["raw"].rlike(r"[\p{L}_]|(?!\p{Nd})\p{N}"))
    return F.array_sort(accepted(sound, ENTITY))

