r"""License scans: ordered signature rules over normalised words, in DataFrame functions alone.

A text is lower-cased (A-Z) and taken apart into words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`. Documents that hold no rule's
keyword end there. For the others, each rule whose keyword is among the words is matched against the words,
joined by two spaces (so that neighbouring matches don't share one). A detection is an interval of words. It is
suppressed where one of its priority or a higher one contains it (of equal intervals the higher priority's, then the
first rule's stays). All of this happens within the row: nothing is joined or shuffled, at any size.

Nulls: a null text is empty (no words, no labels, score 0). doc_id is passed on, null or repeated. Other columns
of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases and labels that every scan reports.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


@dataclass(frozen=True)
class Rule:
    """pattern: a regex over words with one space between them (` ?`: two words or one); keyword: a word of each match; a higher priority wins."""

    label: str
    pattern: str
    keyword: str
    priority: int
    confidence: float

    @property
    def regex(self) -> str:
        parts = (part.replace(" ", "  ") for part in self.pattern.split(" ?"))
        return f" {'(?:  )?'.join(parts)} "


def _versioned(label: str, name: str, keyword: str, versions: tuple[str, ...], confidence: float = 0.95) -> list[Rule]:
    """A license by name, and by name and version: `name`, `name version 2 0`, `name v2`, `name 2 0 only`, `name label version 2 of the license or at your option any later version`."""
    found = [Rule(label, name, keyword, 1, confidence - 0.15)]
    for version in versions:
        digits = version.split(".")
        number = digits[0] + ("(?: 0)?" if digits[1:] == ["0"] else "".join(f" {d}" for d in digits[1:]))
        lead = f"{name}(?: {label})?(?: as published by the free software foundation)?(?: either)?"
        itself = "(?: of th(?:e|is) license)?"
        found.append(Rule(f"{label}-{version}", f"{lead}(?: version| v| ver)? v?{number}", keyword, 2, confidence))
        found.append(Rule(f"{label}-{version}-only", f"{lead}(?: version| v| ver)? v?{number}{itself} only", keyword, 3, confidence))
        found.append(Rule(f"{label}-{version}-or-later", f"{lead}(?: version| v| ver)? v?{number}{itself} or(?: at your option)?(?: any)? later(?: version)?", keyword, 3, confidence))
    return found


def _rules() -> tuple[Rule, ...]:
    rules: list[Rule] = []
    gnu = (
        ("gpl", "gnu general public license", ("1.0", "2.0", "3.0")),
        ("lgpl", "gnu lesser general public license", ("2.1", "3.0")),
        ("lgpl", "gnu library general public license", ("2.0",)),
        ("agpl", "gnu affero general public license", ("1.0", "3.0")),
        ("gfdl", "gnu free documentation license", ("1.1", "1.2", "1.3")),
    )
    for label, name, versions in gnu:
        rules += _versioned(label, name, "gnu", versions)
    for short, versions in (("gpl", ("1.0", "2.0", "3.0")), ("lgpl", ("2.0", "2.1", "3.0")), ("agpl", ("1.0", "3.0")), ("gfdl", ("1.1", "1.2", "1.3"))):
        rules += _versioned(short, short, short, versions, 0.8)
        rules += [Rule(f"{short}-{v}", f"{short}v{v[0]}(?: {v[2]})?", f"{short}v{v[0]}", 2, 0.9) for v in versions if v[0] != "1"]
    rules += [r for v in ("1.0", "1.1", "2.0") for r in (
        Rule(f"apache-{v}", f"apache(?: software)? license(?: version| v)? v?{v[0]}(?: {v[2]})?" if v != "1.1" else "apache(?: software)? license(?: version| v)? v?1 1", "apache", 2, 0.95),
        Rule(f"apache-{v}", f"apache {v[0]} {v[2]}", "apache", 2, 0.85),
    )]
    rules += [Rule("apache", "(?:licensed under the )?apache(?: software)? license", "apache", 1, 0.8), Rule("apache-2.0", "www apache org licenses license 2 0", "apache", 3, 0.95)]
    # Creative Commons: short and spelled-out names, with and without a version
    spelled = {"by": "attribution", "nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?deriv(?:s|atives?)(?: works)?"}
    parts = (("by",), ("by", "sa"), ("by", "nd"), ("by", "nc"), ("by", "nc", "sa"), ("by", "nc", "nd"))
    for part, version in product(parts, ("", "1.0", "2.0", "2.5", "3.0", "4.0")):
        label, end = "-".join(("cc", *part, *[version] * bool(version))), f" {version.replace('.', ' ')}" * bool(version)
        level = len(part) + bool(version)
        rules.append(Rule(label, f"cc {' '.join(part)}{end}", "cc", level, 0.9))
        rules.append(Rule(label, f"creative commons {' '.join(spelled[p] for p in part)}{end}(?: international| unported| generic)?", "creative", level, 0.95))
    rules += [Rule("cc0-1.0", "cc0(?: 1 0)?(?: universal)?", "cc0", 2, 0.9), Rule("cc0-1.0", "creative commons zero(?: v?1 0)?", "creative", 2, 0.9)]
    for clauses, words in (("0", "zero"), ("1", "one"), ("2", "two"), ("3", "three"), ("4", "four")):
        rules += [
            Rule(f"bsd-{clauses}-clause", f"bsd (?:{clauses}|{words}) clause(?: license)?", "bsd", 2, 0.95),
            Rule(f"bsd-{clauses}-clause", f"(?:{clauses}|{words}) clause bsd(?: license)?", "bsd", 2, 0.95),
        ]
    rules += [
        Rule("bsd-2-clause", "simplified bsd(?: license)?", "bsd", 2, 0.9), Rule("bsd-2-clause", "freebsd license", "freebsd", 2, 0.9),
        Rule("bsd-3-clause", "(?:new|modified|revised) bsd(?: license)?", "bsd", 2, 0.9), Rule("bsd-4-clause", "(?:original|old) bsd(?: license)?", "bsd", 2, 0.9),
        Rule("bsd", "bsd(?: style)? license", "bsd", 1, 0.8),
        Rule("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution", 2, 0.9),
        Rule("bsd-3-clause", "neither the name of(?: [^ ]+){1,12} may be used to endorse or promote products", "endorse", 2, 0.85),
        Rule("mit", "(?:released|licensed|distributed|available) under the(?: terms of the)? mit license", "mit", 2, 0.95),
        Rule("mit", "(?:the )?mit license", "mit", 1, 0.9), Rule("mit-0", "mit no attribution(?: license)?", "mit", 2, 0.95), Rule("mit", "(?:x11|expat) license", "license", 1, 0.8),
        Rule("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission", 2, 0.95),
        Rule("mit", "the above copyright notice and this permission notice shall be included in all copies", "permission", 2, 0.85),
        Rule("isc", "isc license", "isc", 1, 0.9),
        Rule("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", "permission", 2, 0.9),
        Rule("unlicense", "the unlicense", "unlicense", 1, 0.9),
        Rule("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 2, 0.95),
        Rule("public-domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain", "domain", 1, 0.8), Rule("public-domain", "public domain", "domain", 0, 0.5),
        Rule("wtfpl", "do what the f[^ ]+ you want to public license", "public", 2, 0.95), Rule("wtfpl", "wtfpl", "wtfpl", 1, 0.9),
        Rule("zlib", "zlib(?: libpng)? license", "zlib", 1, 0.9), Rule("zlib", "this software is provided as is without any express or implied warranty", "warranty", 1, 0.6),
        Rule("bsl-1.0", "boost software license(?: version)?(?: 1 0)?", "boost", 2, 0.95), Rule("busl-1.1", "business source license(?: version)?(?: 1 1)?", "business", 2, 0.9),
        Rule("sspl-1.0", "server side public license(?: version)?(?: 1)?", "server", 2, 0.9), Rule("ncsa", "university of illinois(?: ncsa)? open source license", "illinois", 2, 0.9),
        Rule("psf-2.0", "python software foundation license(?: version)?(?: 2)?", "python", 2, 0.9), Rule("ruby", "ruby license", "ruby", 1, 0.8),
        Rule("php-3.01", "php license(?: version)?(?: 3 01)?", "php", 2, 0.9), Rule("postgresql", "postgresql license", "postgresql", 1, 0.9),
        Rule("openssl", "openssl license", "openssl", 1, 0.9), Rule("ofl-1.1", "sil open font license(?: version)?(?: 1 1)?", "sil", 2, 0.95),
        Rule("ms-pl", "microsoft public license", "microsoft", 1, 0.9), Rule("ms-rl", "microsoft reciprocal license", "microsoft", 1, 0.9),
        Rule("odc-by-1.0", "open data commons attribution license", "commons", 2, 0.9), Rule("odbl-1.0", "open database license", "database", 1, 0.9), Rule("pddl-1.0", "public domain dedication and license", "dedication", 2, 0.9),
        Rule("beerware", "(?:the )?beer ?ware license", "license", 1, 0.8), Rule("proprietary", "proprietary and confidential", "proprietary", 1, 0.7),
        Rule("all-rights-reserved", "all rights reserved", "reserved", 0, 0.5), Rule("copyright", "copyright(?: c)? (?:19|20)[0-9][0-9]", "copyright", 0, 0.5),
        Rule("spdx", "spdx license identifier [^ ]+", "spdx", 0, 0.6), Rule("commercial", "commercial license", "commercial", 0, 0.5),
    ]
    for label, name, keyword, versions in (
        ("mpl", "mozilla public license", "mozilla", ("1.0", "1.1", "2.0")), ("mpl", "mpl", "mpl", ("1.1", "2.0")), ("epl", "eclipse public license", "eclipse", ("1.0", "2.0")),
        ("cddl", "common development and distribution license", "development", ("1.0", "1.1")), ("cpl", "common public license", "common", ("1.0",)), ("eupl", "european union public licen[cs]e", "european", ("1.1", "1.2")),
        ("osl", "open software license", "software", ("1.0", "2.1", "3.0")), ("afl", "academic free license", "academic", ("2.1", "3.0")), ("artistic", "artistic license", "artistic", ("1.0", "2.0")),
        ("lppl", "latex project public license", "latex", ("1.2", "1.3", "1.3c")), ("qpl", "q public license", "q", ("1.0",)), ("npl", "netscape public license", "netscape", ("1.0", "1.1")),
        ("cecill", "cecill(?: free software)? license(?: agreement)?", "cecill", ("1.0", "2.1")), ("apsl", "apple public source license", "apple", ("1.0", "2.0")), ("zpl", "zope public license", "zope", ("2.0", "2.1")),
        ("openrail", "open rail m? ?license", "rail", ("1.0",)), ("llama", "llama(?: 2| 3)? community license", "llama", ()),
    ):
        rules += _versioned(label, name, keyword, versions)
    return tuple(rules)


RULES = _rules()


def _keywords(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({r.keyword for r in rules} | {p.split()[0] for p, _ in BASE})


def _literal(rules: tuple[Rule, ...]) -> Column:
    """The rules as a constant array, in order."""
    return F.array(*(F.struct(F.lit(i).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.regex).alias("regex"), F.lit(r.keyword).alias("keyword"), F.lit(r.priority).alias("priority"), F.lit(r.confidence).alias("confidence")) for i, r in enumerate(rules)))


#: No word goes on here: what WORD doesn't hold, or an end.
_BEFORE, _AFTER = r"(?<![0-9a-z\x{80}-\x{10FFFF}])", r"(?![0-9a-z\x{80}-\x{10FFFF}])"


def _one_of(words: list[str]) -> str:
    """A pattern of the words that tries only those of a first letter."""
    by_letter: dict[str, list[str]] = {}
    for w in words:
        by_letter.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items()) + ")"


def _count_words(joined: Column) -> Column:
    return F.regexp_count(joined, F.lit("[^ ]+"))


def _searches(rules: tuple[Rule, ...]) -> Column:
    """array<struct<rule, np, m, g>>: of the columns held (keywords) and joined, the rules that match, with their matches and the gaps between these.

    Each pattern is a constant of its own, so that it is compiled once and not for each document; in SQL's text, as there are hundreds.
    """
    by_keyword: dict[str, list[str]] = {}
    for i, r in enumerate(rules):
        both = f"'m', regexp_extract_all(j, '{r.regex}', 0), 'g', split(j, '{r.regex}', -1)"
        by_keyword.setdefault(r.keyword, []).append(f"CASE WHEN j RLIKE '{r.regex}' THEN named_struct('rule', {i}, 'np', {-r.priority}, {both}) END")
    groups = ", ".join(f"CASE WHEN array_contains(held, '{k}') THEN array({', '.join(some)}) END" for k, some in by_keyword.items())
    return F.expr(f"element_at(transform(array(joined), j -> filter(flatten(filter(array({groups}), x -> x IS NOT NULL)), x -> x IS NOT NULL)), 1)")


def _detections(search: Column) -> Column:
    """Of one rule: structs of s and e, in words, ordered as suppression needs them."""
    found, gaps = F.transform(search["m"], _count_words), F.transform(search["g"], _count_words)
    steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, n: F.struct(gap.alias("gap"), n.alias("n")))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,ne:int,np:int,rule:int>>)").alias("all"))

    def one(acc: Column, step: Column) -> Column:
        s = acc["at"] + step["gap"]
        e = s + step["n"]
        return F.struct(e.alias("at"), F.concat(acc["all"], F.array(F.struct(s.alias("s"), (-e).alias("ne"), search["np"].alias("np"), search["rule"].alias("rule")))).alias("all"))

    return F.aggregate(steps, start, one, lambda acc: acc["all"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, the base phrases' figures, and detections: structs of s, e (words), label, priority, confidence that no other suppresses."""
    levels = sorted({r.priority for r in rules})
    keywords = _keywords(rules)
    table = _literal(rules)
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    gate = f"{_BEFORE}{_one_of(keywords)}{_AFTER}"
    rows = docs.select("doc_id", text.alias("lower"))
    rows = rows.select("doc_id", F.regexp_count("lower", F.lit(WORD)).cast("long").alias("n_words"), F.when(F.col("lower").rlike(gate), F.col("lower")).alias("lower"))
    rows = rows.withColumn("joined", F.concat(F.lit(" "), F.array_join(F.regexp_extract_all("lower", F.lit(WORD), F.lit(0)), "  "), F.lit(" "))).drop("lower")
    rows = rows.withColumn("held", F.array_distinct(F.regexp_extract_all("joined", F.lit(f" ({_one_of(keywords)}) "), F.lit(1))))
    rows = rows.withColumn("searches", F.when(F.size("held") > 0, _searches(rules)))
    rows = rows.withColumn("found", F.array_sort(F.flatten(F.transform("searches", _detections)))).drop("held", "searches")
    state = F.struct(*(F.lit(0).alias(f"m{k}") for k in levels), F.expr("cast(array() as array<struct<s:int,ne:int,np:int,rule:int>>)").alias("kept"))

    def sift(acc: Column, x: Column) -> Column:
        reach = F.element_at(F.filter(F.array(*(F.struct(F.lit(k).alias("k"), acc[f"m{k}"].alias("m")) for k in levels)), lambda v: v["k"] == -x["np"]), 1)["m"]
        ends = (F.greatest(acc[f"m{k}"], F.when(-x["np"] >= k, -x["ne"]).otherwise(0)).alias(f"m{k}") for k in levels)
        return F.struct(*ends, F.when(reach >= -x["ne"], acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x))).alias("kept"))

    rows = rows.withColumn("found", F.aggregate("found", state, sift, lambda acc: acc["kept"]))
    kept = F.transform(F.coalesce("found", F.expr("cast(array() as array<struct<s:int,ne:int,np:int,rule:int>>)")), lambda x: F.struct(x["s"].alias("s"), (-x["ne"]).alias("e"), F.element_at(table, x["rule"] + 1)["label"].alias("label"), (-x["np"]).alias("priority"), F.element_at(table, x["rule"] + 1)["confidence"].alias("confidence")))
    total = _count_words(F.col("joined"))
    places, firsts, lasts, names = [], [], [], []
    for phrase, label in BASE:
        regex = f" {phrase.replace(' ', '  ')} "
        pieces = F.split("joined", regex, -1)
        n = F.when(F.col("joined").isNull(), 0).otherwise(F.size(pieces) - 1)
        places.append(n)
        firsts.append(F.when(n > 0, _count_words(F.element_at(pieces, 1))))
        lasts.append(F.when(n > 0, total - _count_words(F.element_at(pieces, -1)) - len(phrase.split())))
        names.append(F.when(n > 0, F.lit(label)))
    return rows.select(
        "doc_id", "n_words", sum(places[1:], places[0]).cast("long").alias("n_base"), F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*names))).alias("base_names"), kept.alias("detections"),
    )


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = F.array_sort(F.array_distinct(F.concat("base_names", F.transform("detections", lambda d: d["label"]))))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_names", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
    )


def _sql(rules: tuple[Rule, ...]) -> str:
    values = ", ".join(f"({i}, '{r.label}', '{r.regex}', '{r.keyword}', {r.priority}, {r.confidence}::DOUBLE)" for i, r in enumerate(rules))
    base = ", ".join(f"(' {p.replace(' ', '  ')} ', '{n}', {len(p.split())})" for p, n in BASE)
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    count = "len(regexp_extract_all({}, '[^ ]+'))"
    return f"""
WITH rules(rule, label, regex, keyword, priority, confidence) AS (VALUES {values}),
base(regex, label, n) AS (VALUES {base}),
d AS (SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT k, doc_id, regexp_extract_all(t, '{word}') AS words FROM d),
j AS MATERIALIZED (SELECT k, doc_id, len(words) AS n_words, ' ' || array_to_string(words, '  ') || ' ' AS joined FROM w),
b AS (SELECT j.k, base.label, len(string_split_regex(joined, regex)) - 1 AS places, {count.format("string_split_regex(joined, regex)[1]")} AS first_word, n_words - {count.format("string_split_regex(joined, regex)[-1]")} - n AS last_word FROM j JOIN base ON contains(joined, regex)),
bb AS (SELECT k, sum(places)::BIGINT AS n_base, min(first_word)::BIGINT AS first_word, max(last_word)::BIGINT AS last_word, string_agg(label, ',' ORDER BY label) AS base_labels FROM b GROUP BY k),
m AS (SELECT k, rule, label, priority, confidence, list_transform(regexp_extract_all(joined, regex), lambda x: {count.format("x")}) AS found, list_transform(string_split_regex(joined, regex), lambda x: {count.format("x")}) AS gaps
 FROM j JOIN rules ON contains(joined, ' ' || keyword || ' ') WHERE regexp_matches(joined, regex)),
i AS (SELECT k, rule, label, priority, confidence, found, gaps, unnest(range(1, len(found) + 1)) AS n FROM m),
s AS (SELECT k, rule, label, priority, confidence, list_sum(gaps[1:n]) + coalesce(list_sum(found[1:n - 1]), 0) AS s, list_sum(gaps[1:n]) + list_sum(found[1:n]) AS e FROM i),
kept AS (SELECT * FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.k = x.k AND y.s <= x.s AND y.e >= x.e AND y.priority >= x.priority
 AND (y.s < x.s OR y.e > x.e OR y.priority > x.priority OR y.rule < x.rule))),
l AS (SELECT k, label FROM kept UNION SELECT k, label FROM b),
ll AS (SELECT k, string_agg(label, ',' ORDER BY label) AS labels FROM l GROUP BY k),
c AS (SELECT k, max(confidence) AS score FROM kept GROUP BY k)
SELECT j.doc_id, j.n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM j LEFT JOIN bb USING (k) LEFT JOIN ll USING (k) LEFT JOIN c USING (k)
"""


QUERIES = {"op4_licenses": op4_licenses}
SQL = {"op4_licenses": _sql(RULES)}
