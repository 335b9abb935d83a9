"""What a text must hold for a pattern to match: words derived from the pattern's syntax tree, which gate the search for it.

A pattern's factors are a set of strings of which each text with a match has one at least. They come from its literals: of parts that follow
each other the best part's, of alternatives all alternatives', of what is repeated the repeated part's, and of what must stand before or after a match.
A set of characters counts as that many strings of one, if it is small. Parts that may be missing and classes of many characters give none.
"""

from __future__ import annotations

from re import _constants as sre
from re import _parser

#: A set of characters of more is no factor, nor are that many strings altogether.
MOST_CHARACTERS, MOST_STRINGS = 16, 64


def _weight(strings: frozenset[str] | None) -> tuple:
    """How well strings gate, the larger the better: long ones, rare characters (beyond ASCII, then neither letters nor digits), few."""
    if not strings:
        return (-1,)
    rarest = min(max(3 if ord(c) > 127 else 2 if not (c.isalnum() or c.isspace() or c in ".,-/") else 1 for c in s) * 10 + len(s) if len(s) > 1 or ord(s) > 127 or not (s.isalnum() or s.isspace() or s in ".,-/") else 0 for s in strings)
    return (rarest, -len(strings))


def _characters(items) -> frozenset[str] | None:
    """The characters of a set, if few."""
    out: set[str] = set()
    for kind, value in items:
        if kind is sre.LITERAL:
            out.add(chr(value))
        elif kind is sre.RANGE and value[1] - value[0] < MOST_CHARACTERS:
            out |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= MOST_CHARACTERS else None


def _joined(first: frozenset[str] | None, then: frozenset[str] | None) -> frozenset[str] | None:
    """Strings that follow each other; None if there are too many or some aren't known."""
    if first is None or then is None or len(first) * len(then) > MOST_STRINGS:
        return None
    return frozenset(a + b for a in first for b in then)


def _parts(tree) -> tuple[frozenset[str] | None, frozenset[str] | None]:
    """(the strings that are all there is to it, if known; the best factors) of a sequence."""
    best: frozenset[str] | None = None
    run: frozenset[str] | None = frozenset([""])  # strings that stand together up to here
    whole: frozenset[str] | None = frozenset([""])

    def offer(strings: frozenset[str] | None) -> None:
        nonlocal best
        if strings and "" not in strings and _weight(strings) > _weight(best):
            best = strings

    for kind, value in tree:
        exact: frozenset[str] | None = None
        inner: frozenset[str] | None = None
        if kind is sre.LITERAL:
            exact = inner = frozenset([chr(value)])
        elif kind is sre.IN:
            exact = inner = _characters(value)
        elif kind is sre.SUBPATTERN:
            exact, inner = _parts(value[3]) if not value[1] and not value[2] else (None, None)
        elif kind is sre.BRANCH:
            every = [_parts(b) for b in value[1]]
            exact = frozenset().union(*(e for e, _ in every)) if all(e is not None for e, _ in every) else None
            inner = frozenset().union(*(f for _, f in every)) if all(f for _, f in every) else None
            exact, inner = (x if x is not None and len(x) <= MOST_STRINGS else None for x in (exact, inner))
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, body = value
            own, inner = _parts(body)
            inner = inner if least else None
            exact = frozenset(["", *own]) if (least, most) == (0, 1) and own is not None else own if (least, most) == (1, 1) else None
        elif kind in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):  # of no width; what must stand there is in the text
            if kind is sre.ASSERT:
                offer(_parts(value[1])[1])
            continue
        offer(inner)
        longer = _joined(run, exact)
        offer(longer)
        run = longer if longer is not None else exact if exact is not None else frozenset([""])
        offer(run)
        whole = _joined(whole, exact)
    return whole, best


def factors(pattern: str) -> tuple[str, ...] | None:
    """Strings of which every text with a match of a pattern (in the dialect of Python's re) has one at least, in order; None if none are known."""
    tree = _parser.parse(pattern)
    if tree.state.flags & sre.SRE_FLAG_IGNORECASE:
        return None
    found = _parts(tree)[1]
    # a string that holds another one of them is none of its own
    return tuple(sorted(s for s in found if not any(o != s and o in s for o in found))) if found else None


def _has(tree, is_one) -> bool:
    """Whether every match has a character (or must have one beside it) for which is_one holds."""

    def item(kind, value) -> bool:
        if kind is sre.LITERAL:
            return is_one(chr(value))
        if kind is sre.IN:
            return all(k is sre.LITERAL and is_one(chr(v)) or k is sre.RANGE and v[1] - v[0] < 1 << 16 and all(is_one(chr(c)) for c in range(v[0], v[1] + 1)) or k is sre.CATEGORY and v is sre.CATEGORY_DIGIT and is_one is _digit for k, v in value)
        if kind is sre.SUBPATTERN:
            return not value[1] and not value[2] and _has(value[3], is_one)
        if kind is sre.BRANCH:
            return all(_has(b, is_one) for b in value[1])
        if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            return value[0] > 0 and _has(value[2], is_one)
        return kind is sre.ASSERT and _has(value[1], is_one)

    return any(item(kind, value) for kind, value in tree)


def _digit(c: str) -> bool:
    return c.isdecimal() and c <= "\uFFFF"  # later ones aren't known to every Java


def _beyond_latin(c: str) -> bool:
    return ord(c) > 0xFF


def needs(pattern: str) -> frozenset[str]:
    """The kinds of characters (text.KINDS) that every text with a match of a pattern (in the dialect of Python's re) has."""
    tree = _parser.parse(pattern)
    if tree.state.flags & (sre.SRE_FLAG_IGNORECASE | sre.SRE_FLAG_VERBOSE):
        return frozenset()
    return frozenset(kind for kind, is_one in (("digit", _digit), ("wide", _beyond_latin)) if _has(tree, is_one))


def alternatives(pattern: str) -> list[str]:
    """The alternatives that a pattern has on its outermost level."""
    out, depth, inside, i = [""], 0, False, 0
    while i < len(pattern):
        c = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        inside = c == "[" or inside and c != "]"
        depth += (c == "(") - (c == ")") if not inside else 0
        if c == "|" and not depth and not inside:
            out.append("")
        else:
            out[-1] += c
        i += len(c)
    return out


def literal(pattern: str) -> str | None:
    """The only string that a pattern matches, if its syntax tree shows one."""
    tree = list(_parser.parse(pattern))
    return "".join(chr(value) for _, value in tree) if all(kind is sre.LITERAL for kind, _ in tree) else None
