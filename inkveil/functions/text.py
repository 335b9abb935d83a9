"""Column functions: spans of matches with code-point offsets, greedy choice, splicing, labels."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<s:int,e:int,raw:string>"
#: A span that would be replaced: its place, category and text, what stays before and after the token, a fixed replacement instead of one, and which of the row's events it is.
PIECE = "struct<s:int,e:int,cat:string,raw:string,pre:string,suf:string,lit:string,ev:int>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def holds(text: Column, gate: str | tuple[str, ...]) -> Column:
    """Whether a text has a match of gate, or one of some strings; words and sets of characters are looked for as bytes, which is several times as fast as a pattern."""
    plain = r"[^\\\[\](){}|?*+.^$]"
    if isinstance(gate, tuple):
        words = gate
    elif re.fullmatch(rf"{plain}+(\|{plain}+)*", gate):
        words = gate.split("|")
    elif re.fullmatch(r"\[[^\]\\^\-]+\]", gate):
        words = list(gate[1:-1])
    else:
        return text.rlike(gate)
    found = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        found |= F.contains(text, F.lit(word))
    return found


#: Kinds of characters that few texts have, and patterns of these.
KINDS = {"digit": r"(?U)\d", "wide": r"[^\x00-\xFF]"}


@dataclass(frozen=True)
class Gate:
    """What a text with a match has: characters of all kinds in needs, and one at least of the gates in either, each with the kinds that go with it."""

    needs: frozenset[str]
    either: tuple[tuple[frozenset[str], str | tuple[str, ...] | None], ...]

    def kinds(self) -> frozenset[str]:
        return self.needs.union(*(kinds for kinds, _ in self.either))

    def open(self, text: Column, has: Column) -> Column:
        """has: of kinds_of(text)."""

        def every(kinds: frozenset[str], gate: str | tuple[str, ...] | None) -> Column:
            out = F.lit(True)
            for kind in sorted(kinds - self.needs):
                out &= has[kind]
            return out if gate is None else out & holds(text, gate)

        some = F.lit(False)
        for kinds, gate in self.either:
            some |= every(kinds, gate)
        for kind in sorted(self.needs, reverse=True):
            some = has[kind] & some
        return some


def kinds_of(text: Column, kinds: frozenset[str] | set[str] = frozenset(KINDS)) -> Column:
    """struct of booleans: whether a text has characters of each kind."""
    return F.struct(F.lit(True).alias("any"), *(text.rlike(KINDS[k]).alias(k) for k in sorted(kinds)))


#: Elements that a fold appends to one array: each step copies what is there already, so that longer arrays are made part by part.
STRIDE = 64
#: Candidates that are compared each with all others; of more, only those that touch.
FEW = 32


def _parts(values: Column) -> Column:
    """values in slices of STRIDE."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STRIDE).cast("int")), lambda k: F.slice(values, k * STRIDE + 1, STRIDE))


def scanned(values: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """array<kind>: what step(state, value) puts out beside the next state, for one value after another; linear in their number. State and what is put out are copied often, and so had better be numbers."""

    def inner(state: Column, part: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            after, out = step(acc["state"], x)
            return F.struct(after.alias("state"), F.concat(acc["all"], F.array(out)).alias("all"))

        return F.aggregate(part, F.struct(state.alias("state"), empty(kind).alias("all")), one)

    def outer(acc: Column, part: Column) -> Column:
        return let(inner(acc["state"], part), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["all"], F.array(r["all"])).alias("all")))

    many = F.aggregate(_parts(values), F.struct(start.alias("state"), empty(f"array<{kind}>").alias("all")), outer, lambda acc: F.flatten(acc["all"]))
    return F.when(F.size(values) <= STRIDE, inner(start, values)["all"]).otherwise(many)


#: Stands beside matches where a text is cut at them.
MARK = "\x01"


def found(text: Column, pattern: str | Column, gate: str | tuple[str, ...] | Column | None = None) -> Column:
    """array<string>: gap, match, gap, ..., match, gap for the non-overlapping matches of a pattern (none empty) in order, or null if there are none.

    A text in which the cheap pattern gate has no match (or for which the condition gate doesn't hold) isn't searched, others once: matches are put between marks that no text of the ordinary has.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern

    def searched(t: Column) -> Column:
        gaps = F.split(t, regex, -1)
        odd = F.transform(F.regexp_extract_all(t, regex, F.lit(0)), lambda m, k: F.array(F.element_at(gaps, k + 1), m))  # gaps are cut out again for each match
        marked = let(F.regexp_replace(t, regex, F.lit(f"{MARK}$0{MARK}")), lambda m: F.when(F.contains(m, F.lit(MARK)), F.split(m, MARK, -1)))
        return F.when(F.contains(t, F.lit(MARK)), let(F.flatten(odd), lambda o: F.when(F.size(o) > 0, F.concat(o, F.array(F.lit("")))))).otherwise(marked)

    every = let(text, searched)
    return every if gate is None else F.when(gate if isinstance(gate, Column) else holds(text, gate), every)


def placed(pieces: Column) -> Column:
    """array<struct<s, e, raw>> of what found() gives: offsets in code points, e excluded, by the running sum of the lengths."""

    def one(p: Column) -> Column:
        return let(F.length(F.element_at(p, 1)), lambda s: F.array(F.struct(s.alias("s"), (s + F.length(F.element_at(p, 2))).alias("e"), F.element_at(p, 2).alias("raw"))))

    def many(p: Column) -> Column:
        ends = scanned(F.transform(p, F.length), F.lit(0), lambda at, n: (at + n, at + n), "int")
        span = lambda e, k: F.struct(F.element_at(e, 2 * k - 1).alias("s"), F.element_at(e, 2 * k).alias("e"), F.element_at(p, 2 * k).alias("raw"))
        return let(ends, lambda e: F.transform(F.sequence(F.lit(1), F.floor(F.size(p) / 2).cast("int")), lambda k: span(e, k)))

    return F.when(pieces.isNull(), empty(SPAN)).when(F.size(pieces) == 3, one(pieces)).otherwise(many(pieces))


def spans(text: Column, pattern: str | Column, gate: str | tuple[str, ...] | Column | None = None) -> Column:
    """array<struct<s, e, raw>>: the non-overlapping matches of a pattern (none empty) in order; offsets in code points, e excluded."""
    return let(found(text, pattern, gate), placed)


def spans_of(text: Column, searches: list[tuple[str, str | tuple[str, ...] | Gate | None]]) -> Column:
    """array of such arrays, for each pattern and gate; one expression places the matches of all. Which kinds of characters a text has is found out once."""

    def every(has: Column | None) -> Column:
        return F.transform(F.array(*(found(text, pattern, gate.open(text, has) if isinstance(gate, Gate) else gate) for pattern, gate in searches)), placed)

    kinds = frozenset().union(*(gate.kinds() for _, gate in searches if isinstance(gate, Gate)))
    return let(kinds_of(text, kinds), every) if kinds else every(None)


def parts(text: Column, chars: int, cut: str) -> Column:
    """array<string>: text in parts of about so many characters, cut at places (empty matches of the pattern cut) only; where a stretch of so many characters has none, a part is longer."""

    def place(k: Column) -> Column:
        """The first place of a stretch, or null. A place needs the characters beside it, so the stretch goes on for two more."""
        window = F.substring(text, k * chars, F.lit(chars + 2))
        first = F.length(F.regexp_extract(window, f"(?s)^.*?(?:{cut})", 0))
        return let(first, lambda n: F.when(n > 0, k * chars - 1 + n))

    places = F.array_distinct(F.array_compact(F.transform(F.sequence(F.lit(1), F.floor(F.length(text) / chars).cast("int")), place)))
    bounds = F.concat(F.array(F.lit(0)), places, F.array(F.length(text)))
    pieces = lambda b: F.transform(F.slice(b, 2, F.size(b)), lambda end, k: F.substring(text, F.element_at(b, k + 1) + 1, end - F.element_at(b, k + 1)))
    return F.when(F.length(text) <= chars, F.array(text)).otherwise(let(bounds, pieces))


def overlaps(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def accepted(candidates: Column, kind: str, taken: Column | None = None) -> Column:
    """Of candidates in order those that overlap none accepted before, after what is taken already (whose spans are disjoint; no span is empty).

    Only spans of one cluster, a stretch of text that spans cover without a gap, can keep each other out: where there are many candidates they are
    sorted by place, cut into clusters in one pass, and chosen cluster by cluster.
    """
    # what is accepted is told by its place among all, and copied out at the end
    place = "struct<i:int,s:int,e:int>"
    free = lambda acc, c: F.when(F.exists(acc, lambda a: overlaps(a, c)), acc).otherwise(F.concat(acc, F.array(c)))
    greedy = lambda c: F.transform(F.aggregate(c, empty(place), free), lambda x: x["i"])

    def few(every: Column) -> Column:
        return greedy(F.transform(every, lambda c, i: F.struct(i.alias("i"), c["s"].alias("s"), c["e"].alias("e"))))

    def many(every: Column) -> Column:
        by_place = F.sort_array(F.transform(every, lambda c, i: F.struct(c["s"].alias("s"), c["e"].alias("e"), i.alias("i"))))

        def chosen(spans: Column) -> Column:
            begins = scanned(spans, F.lit(-1), lambda end, x: (F.greatest(end, x["e"]), x["s"] >= end), "boolean")
            firsts = let(begins, lambda b: F.filter(F.transform(b, lambda x, j: F.when(x, j + 1)), lambda j: j.isNotNull()))
            slices = let(firsts, lambda f: F.transform(f, lambda at, k: F.slice(spans, at, F.coalesce(F.try_element_at(f, k + 2), F.size(spans) + 1) - at)))
            in_order = lambda c: F.sort_array(F.transform(c, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"), x["e"].alias("e"))))
            # two that touch: the earlier one
            pair = lambda c: F.array(F.least(F.element_at(c, 1)["i"], F.element_at(c, 2)["i"]))
            own = lambda c: F.when(F.size(c) == 1, F.array(F.element_at(c, 1)["i"])).when(F.size(c) == 2, pair(c)).otherwise(greedy(in_order(c)))
            return F.sort_array(F.flatten(F.transform(slices, own)))

        return let(by_place, chosen)

    def chosen(every: Column) -> Column:
        kept = F.when(F.size(every) <= FEW, few(every)).otherwise(many(every))
        return F.when(F.size(every) <= 1, every).otherwise(F.transform(kept, lambda i: F.element_at(every, i + 1)))

    # candidates are used more than once, but found once
    return let(candidates if taken is None else F.concat(taken, candidates), chosen)


def spliced(text: Column, pieces: Column) -> Column:
    """text with each piece's span (s, e) replaced by its rep; pieces don't overlap."""

    def part(body: Column, from_: Column, some: Column) -> Column:
        """What becomes of body, which is the text from from_ to the end of the last of some pieces."""
        start = F.struct(F.lit("").alias("out"), from_.alias("at"))
        step = lambda acc, p: F.struct(F.concat(acc["out"], F.substring(body, acc["at"] - from_ + 1, p["s"] - acc["at"]), p["rep"]).alias("out"), p["e"].alias("at"))
        return F.aggregate(some, start, step, lambda acc: acc["out"])

    def step(acc: Column, some: Column) -> Column:
        end = F.element_at(some, -1)["e"]
        done = let(F.substring(text, acc["at"] + 1, end - acc["at"]), lambda body: part(body, acc["at"], some))
        return F.struct(F.concat(acc["out"], F.array(done)).alias("out"), end.alias("at"))

    start = F.struct(empty("string").alias("out"), F.lit(0).alias("at"))
    whole = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    one = lambda p: F.concat(F.substring(text, F.lit(1), p["s"]), p["rep"], F.substring(text, p["e"] + 1, F.length(text)))
    many = lambda p: F.aggregate(_parts(p), start, step, whole)
    return F.when(F.size(pieces) == 0, text).otherwise(let(pieces, lambda p: F.when(F.size(p) == 1, one(F.element_at(p, 1))).otherwise(let(F.sort_array(p), many))))


def md5_8(text: Column) -> Column:
    """The first eight hexadecimal digits of the MD5, in capitals."""
    return F.upper(F.substring(F.md5(text.cast("binary")), 1, 8))


def label(index: Column) -> Column:
    """A, B, ..., Z, AA, AB, ... for 0, 1, ..."""
    # n letters stand for the indexes from 26 + ... + 26 ** (n - 1) on
    def letters(n: int) -> Column:
        rest = index - sum(26**k for k in range(1, n))
        return F.concat(*(F.char((F.floor(rest / 26**k) % 26 + 65).cast("int")) for k in reversed(range(n))))

    out = letters(8)
    for n in range(7, 0, -1):
        out = F.when(index < sum(26**k for k in range(1, n + 1)), letters(n)).otherwise(out)
    return out


def token(category: Column, name: Column) -> Column:
    return F.concat(F.lit("【"), category, name, F.lit("】"))


def stripped(markup: Column) -> Column:
    """What is left of a text without its tags."""
    return F.regexp_replace(markup, "<[^>]+>", "")
