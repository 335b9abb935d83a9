"""A plain version of masking, text by text in Python, for comparison: patterns as they are, everything else by the obvious loops."""

import bisect
import hashlib
import re

from inkveil.functions import patterns
from inkveil.operators import dates, entities


def disjoint(candidates):
    """Of (s, e, ...) in order, those that touch none before; kept in a list by place."""
    starts, ends, out = [], [], []
    for c in candidates:
        i = bisect.bisect_left(starts, c[1])
        if i == 0 or ends[i - 1] <= c[0]:
            starts.insert(i, c[0])
            ends.insert(i, c[1])
            out.append(c)
    return out


def found(pattern, text, flags=0):
    return [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, text, flags)]


def plain_dates(text, today):
    out = []
    for _, pattern, needs_context, _ in patterns.DATE_FORMS:
        for s, e, raw in found(pattern, text):
            near = text[max(0, s - patterns.CONTEXT_WIDTH) : e + patterns.CONTEXT_WIDTH]
            if (not needs_context or re.search(patterns.DATE_CONTEXT, near, re.I)) and dates.is_date(raw, today):
                out.append((s, e, raw))
    return sorted(disjoint(sorted(out, key=lambda x: x[0] - x[1])))


def plain_names(text, custom=()):
    out = []
    for category in (entities.PERSON, entities.ORGANISATION):
        for name in sorted({n for c, n in custom if c == category}, key=lambda n: (-len(n), n)):
            out += [(*x, category) for x in found(re.escape(name), text)]
    out += [(*x, entities.PERSON) for x in found(patterns.TITLED_NAME, text) if x[2] not in patterns.TITLES]
    out += [(*x, entities.ORGANISATION) for x in found(patterns.COMPANY, text)]
    for name in patterns.ORDERED_SURNAMES:
        out += [(*x, entities.PERSON) for x in found(name + patterns.GIVEN_NAME, text)]
    return sorted(disjoint([x for x in out if len(x[2]) > 1 and re.search(r"[^\W\d]|[^\W]", re.sub(r"\d", "", x[2]))]))


def name_of(index):
    out = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def md5_8(text):
    return hashlib.md5(text.encode()).hexdigest()[:8].upper()


class Session:
    """Labels of one session, text after text."""

    def __init__(self):
        self.labels, self.originals = {}, {}

    def label(self, category, original):
        own = self.labels.setdefault(category, {})
        key = md5_8(original)
        self.originals.setdefault((category, original), key)
        return own.setdefault(key, name_of(len(own)))

    def mask(self, text, today, custom=(), rules=patterns.RULES):
        first = [(s, e, "日付", raw) for s, e, raw in plain_dates(text, today)]
        named = [(s, e, cat, raw) for s, e, raw, cat in plain_names(text, custom)]
        for _, _, cat, raw in first + named:
            self.label(cat, raw)
        ruled = [(s, e, rule.category, raw, rule) for rule in rules for s, e, raw in found(rule.pattern, text)]
        pieces = []
        for s, e, cat, raw, *rule in disjoint(first + named + ruled):
            if cat == "年齢":
                pieces.append((s, e, f"{int(re.sub('歳', '', raw)) // 10 * 10}代"))
                continue
            pre = suf = ""
            if rule:
                pre = (m := rule[0].pre and re.search(rule[0].pre, raw)) and m[0] or ""
                suf = (m := rule[0].suf and re.search(rule[0].suf, raw)) and m[0] or ""
            pieces.append((s, e, f"{pre}【{cat}{self.label(cat, raw)}】{suf}"))
        out, at = [], 0
        for s, e, rep in sorted(pieces):
            out += [text[at:s], rep]
            at = e
        return "".join(out) + text[at:]
