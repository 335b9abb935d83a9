"""Factors of patterns: known ones, and that no match lacks them."""

import random
import re
import time

import pytest
from test_long_texts import sentences

from inkveil.functions import patterns
from inkveil.functions.factors import alternatives, factors, literal, needs
from inkveil.operators import masking

KNOWN = [
    ("abc", ("abc",)), ("a?bc", ("bc",)), ("ab|cd", ("ab", "cd")), ("ab|c?", None), (r"\d+円", ("円",)), (r"[\d,]+(?=\s*(?:万|千)?円)", ("円",)), ("(?<!x)ab", ("ab",)), ("(?<=x!)a", ("x!",)), ("(?:foo|bar)baz", ("barbaz", "foobaz")),
    ("[ab]c!", ("ac!", "bc!")), (".*", None), ("(?i)abc", None), ("(?:abc)+d", ("abc",)), ("(?:abc)*", None), ("x{3}", ("x",)), (r"S/?N-\d", ("S/N-", "SN-")), ("(a|b)(c|d)", ("ac", "ad", "bc", "bd")), ("(?!no)yes", ("yes",)), ("a.b|cc", ("a", "cc")),
]


@pytest.mark.parametrize(("pattern", "expected"), KNOWN)
def test_known(pattern, expected):
    assert factors(pattern) == expected


def test_no_match_without_a_factor():
    """Over made sentences, for all patterns of dates, names and rules, and over random texts for the known ones."""
    every = [p for _, p, _, _ in patterns.DATE_FORMS] + [r.pattern for r in patterns.RULES] + [patterns.TITLED_NAME, patterns.COMPANY]
    assert sum(factors(p) is not None for p in every) >= 25
    said = sentences(600, 4)
    r = random.Random(1)
    noise = ["".join(r.choice("abcdxyzno円万千1,S/N-! ") for _ in range(12)) for _ in range(3000)]
    for pattern, texts in [(p, said) for p in every] + [(p, noise) for p, _ in KNOWN]:
        found = factors(pattern)
        for t in texts if found else ():
            if re.search(pattern, t):
                assert any(f in t for f in found), (pattern, t)


def test_kinds_of_characters():
    """What patterns need, and that no match over made sentences lacks it or passes by an alternative of its gate."""
    assert [sorted(needs(p)) for p in (r"\d+円", "[0-9０-９]a", "[一-九]", r"a\d?", r"a|\d", "(?i)k１", "(?<=年)x", "(?!年)x", "[^0-9]")] == [["digit", "wide"], ["digit"], ["wide"], [], [], [], ["wide"], [], []]
    assert alternatives(r"a|(b|c)|[|]|\||d") == ["a", "(b|c)", "[|]", r"\|", "d"] and literal(r"\.com/") == ".com/" and literal("S/?N") is None
    gates = [(p, patterns.gate_for(p, g)) for _, p, _, g in patterns.DATE_FORMS] + [(r.pattern, patterns.gate_of(r)) for r in patterns.RULES]
    assert sum("digit" in g.needs for _, g in gates) >= 15 and sum("wide" in g.needs for _, g in gates) >= 9
    of = {"digit": re.compile(r"\d"), "wide": re.compile(r"[^\x00-\xFF]")}
    for t in sentences(600, 4):
        has = {k for k, p in of.items() if p.search(t)}
        for pattern, gate in gates:
            if re.search(pattern, t):
                assert gate.needs <= has and any(kinds <= has and (g is None or (any(w in t for w in g) if isinstance(g, tuple) else re.search(g.replace("(?U)", "").replace(r"\x1c-\x1f", ""), t))) for kinds, g in gate.either), (pattern, t)


def test_texts_without_digits_are_not_searched(spark):
    """A row without digits costs no search by the date forms and rules that need one: their patterns aren't even run, so one that can't end is harmless."""
    slow = patterns.Rule("slow", "遅", r"(?:a|a)*(?:a|a)*(?:a|a)*b\d", "[ab]")
    df = spark.createDataFrame([(0, "a" * 4000)], "id long, text string")
    began = time.perf_counter()
    assert masking.mask_rows(masking.detect(df, rules=(slow,), only_rules=True)).first()["masked"] == "a" * 4000
    assert time.perf_counter() - began < 30


def test_rules_without_gates(spark):
    """Built-in rules give the same with derived gates; a user's rule needs none."""
    bare = tuple(patterns.Rule(r.name, r.category, r.pattern, None, r.pre, r.suf) for r in patterns.RULES)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(sentences(200, 6))], "id long, text string")
    one, two = (masking.mask_rows(masking.detect(df, rules=rules, only_rules=True)).select("id", "masked", "mapping").collect() for rules in (patterns.RULES, bare))
    assert sorted(one, key=lambda r: r["id"]) == sorted(two, key=lambda r: r["id"])
    user = (*patterns.RULES, patterns.Rule("room", "部屋", r"Room \d+[A-C]?"))
    row = spark.createDataFrame([(0, "Room 12B, then Room 7 and Room 12B; 42歳")], "id long, text string")
    assert masking.mask_rows(masking.detect(row, rules=user, only_rules=True)).first()["masked"] == "【部屋A】, then 【部屋B】 and 【部屋A】; 40代"
