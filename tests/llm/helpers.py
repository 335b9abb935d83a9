"""Plain versions of the operators, and a table of awkward documents."""

import collections
import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows():
    """Documents with nulls, empty and long texts, ties, repeated rows, near copies, shared passages, and columns of clashing names."""
    r = random.Random(7)
    word = lambda lang: "".join(r.choice({"en": ["th", "er", "ing", "on", "at"], "fr": ["é", "eau", "ou", "que", "ment"]}[lang]) for _ in range(r.randint(1, 4)))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    passage, line = text("en", 90), text("en", 12)
    out = []
    for i in range(60):
        lang = "fr" if i % 3 == 0 else "en"
        body = text(lang, r.choice([4, 60, 90, 200])) + "\n" + text(lang, 30)
        if i % 4 == 0:
            body = f"{body}\n{passage}\n{text(lang, 60)}"
        if i % 5 == 0:
            body = f"{line}\n{body}\n{line}\n\n{line}"
        out.append((i, body, lang))
    base = text("en", 160).split(" ")
    for i in range(60, 90):  # near copies, each with some words changed
        copy = list(base)
        for _ in range(i % 7):
            copy[r.randrange(len(copy))] = word("en")
        out.append((i, " ".join(copy), "en"))
    for i in range(90, 100):  # exact copies
        out.append((i, out[1][1], "en"))
    out += [(100, None, None), (101, "", "en"), (102, " \n\t ", None), (103, "a", "en"), (104, "ab " * 300, "en"), (105, text("en", 12000), "en"), (106, "日本語のテキスト、𠮷野家 é é", "ja"), (107, "12 34 !!", "en"), (1, out[1][1], "en")]
    out += [(108, "Gnu General\nPublic License, version 2 or any later version. MIT License MIT license; CC BY-NC-SA 4.0 Apache License 2.0", "en"), (None, passage, "en")]
    return [(d, t, lang, "src", None if t is None else len(t), 0.5, "x") for d, t, lang in out]


def words(text):
    return WORDS.findall(text or "")


def brute_quality(text):
    w, seen, dup = words(text), set(), 0
    count, covered = collections.Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i, t in enumerate(zip(w, w[1:], w[2:], strict=False)):
        if count[t] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def brute_components(docs):
    sets = collections.defaultdict(set)
    for d, t in docs:
        w = words((t or "").translate(UPPER))
        sets[d] |= {frozenset(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def brute_windows(docs, size=35):
    count = collections.Counter(tuple(w[i : i + size]) for _, t in docs for w in [words(t)] for i in range(len(w) - size + 1))
    out = []
    for d, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def brute_passages(docs, size=50):
    last = float("inf")
    rank = lambda d: last if d is None else d
    first = {}
    for d, t in sorted(docs, key=lambda x: rank(x[0])):
        b = (t or "").encode()
        for i in range(len(b) - size + 1):
            first.setdefault(b[i : i + size], rank(d))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] < rank(d):
                gone[i : i + size] = b"\1" * size
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out
