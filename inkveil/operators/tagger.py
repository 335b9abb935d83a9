"""Names by a sequence model: a hidden Markov model over characters, counted by Spark from sentences whose names are known, decoded by Viterbi.

A text is a sequence of tags: outside, or begin or inside of a person or an organisation. A tag gives the one that follows it, and the character at
its place with the characters before and after it, which count as independent. Known names can be those of dictionaries and forms
(entities.entities), of custom names, or any column of spans. What is counted is bounded by the number of different characters, for any number of sentences; counts are summed
in tasks first, and one is added to each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import entities

TAGS = ("outside", "begin person", "inside person", "begin organisation", "inside organisation")
_BEGIN = {entities.PERSON: 1, entities.ORGANISATION: 3}
_CATEGORY = {1: entities.PERSON, 3: entities.ORGANISATION}
#: Places whose characters a tag gives: the one before, its own, the one after.
AROUND = (-1, 0, 1)
#: What stands before the first and after the last character.
EDGE = "\0"
#: Characters that are worked on together.
BLOCK = 1 << 16
#: Weight of the characters beside the own one.
BESIDE = 0.7


def tags_of(length: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    """The tags of a text with names at (s, e, category)."""
    out = np.zeros(length, np.int8)
    for s, e, category in spans:
        out[s] = _BEGIN[category]
        out[s + 1 : e] = _BEGIN[category] + 1
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind (0 to 2: a character at a place of AROUND; 3: the tag before, as its number), what, tag and count, summed in the task."""
    total: Counter = Counter()
    for batch in batches:
        for text, names in zip(batch.column("text").to_pylist(), batch.column("names").to_pylist(), strict=True):
            if text:
                tags = tags_of(len(text), [(x["s"], x["e"], x["cat"]) for x in names or ()]).tolist()
                padded = EDGE + text + EDGE
                for kind, off in enumerate(AROUND):
                    total.update(zip([kind] * len(text), padded[1 + off : 1 + off + len(text)], tags, strict=True))
                total.update((len(AROUND), str(a), b) for a, b in zip([0, *tags[:-1]], tags, strict=True))
    rows = list(total)
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()), pa.array([total[r] for r in rows], pa.int64())], ["kind", "what", "tag", "n"])


def _spans(text: str, tags: np.ndarray) -> list[dict]:
    """What tags say are names."""
    found, every = [], tags.tolist()
    for s in np.flatnonzero((tags == 1) | (tags == 3)).tolist():
        e = s + 1
        while e < len(text) and every[e] == every[s] + 1:
            e += 1
        if e - s > 1:
            found.append({"s": s, "e": e, "raw": text[s:e], "cat": _CATEGORY[every[s]]})
    return found


@dataclass
class Tagger:
    """Log-probabilities: of characters by place and tag (unseen ones: the last row), and of a tag after another."""

    places: list[dict[str, int]]
    given: list[np.ndarray]
    moves: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.array([BESIDE, 1.0, BESIDE]))

    def _rows(self, points: np.ndarray, place: dict[str, int]) -> np.ndarray:
        """The rows of a place's table for code points; -1 for unseen ones."""
        known = np.array([ord(c) for c in place] or [0], np.int64)  # in order, as place is
        at = np.minimum(np.searchsorted(known, points), len(known) - 1)
        return np.where((known[at] == points) & bool(place), at, -1)

    def scores(self, text: str) -> np.ndarray:
        """len x tags: how well the characters at and around each place go with a tag."""
        padded = EDGE + text + EDGE
        out = np.zeros((len(text), len(TAGS)))
        for place, given, off, weight in zip(self.places, self.given, AROUND, self.weights, strict=True):
            rows = [place.get(c, -1) for c in padded[1 + off : 1 + off + len(text)]]
            out += weight * given[rows]
        return out

    def tags(self, text: str) -> np.ndarray:
        """The likeliest tags of a text."""
        return self.likeliest([text])[0]

    def likeliest(self, texts: list[str]) -> list[np.ndarray]:
        """The likeliest tags of each text (none empty), by Viterbi over all of them at once; a name doesn't go on without having begun. Memory goes with the longest text times their number."""
        lengths = np.array([len(t) for t in texts])
        longest = int(lengths.max())
        points = np.full((len(texts), longest + 2), ord(EDGE), np.int64)
        for row, t in zip(points, texts, strict=True):
            row[1 : 1 + len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        rows = [self._rows(points, place) for place in self.places]

        def scores(i: int) -> np.ndarray:
            """How well the characters at and around place i of each text go with a tag."""
            out = np.zeros((len(texts), len(TAGS)))
            for row, given, off, weight in zip(rows, self.given, AROUND, self.weights, strict=True):
                out += weight * given[row[:, 1 + off + i]]
            return out

        back = np.zeros((longest, len(texts), len(TAGS)), np.int8)
        best = scores(0) + self.moves[0]
        for i in range(1, longest):
            paths = best[:, :, None] + self.moves
            back[i] = paths.argmax(1)
            after = np.take_along_axis(paths, back[i][:, None].astype(np.intp), 1)[:, 0] + scores(i)
            best = np.where((i < lengths)[:, None], after, best)
        out = np.empty((longest, len(texts)), np.int8)
        last, every = best.argmax(1), np.arange(len(texts))
        for i in range(longest - 1, -1, -1):
            out[i] = last
            last = np.where(i < lengths, back[i][every, last], last)
        return [out[:n, k] for k, n in enumerate(lengths)]

    def names(self, text: str | None) -> list[dict]:
        """s, e, raw and cat of each name, of two characters or more, in order."""
        return self.names_of([text])[0]

    def names_of(self, texts: list[str | None]) -> list[list[dict]]:
        """The names of each text; those of about equal length are worked on together."""
        out: list[list[dict]] = [[] for _ in texts]
        order = sorted((k for k, t in enumerate(texts) if t), key=lambda k: len(texts[k]))
        while order:
            width = max(1, BLOCK // len(texts[order[-1]]))
            some, order = order[-width:], order[:-width]
            for k, tags in zip(some, self.likeliest([texts[k] for k in some]), strict=True):
                out[k] = _spans(texts[k], tags)
        return out

    def entities(self, text: Column) -> Column:
        """array<struct<s, e, raw, cat>> by place, as entities.entities gives them."""

        @F.pandas_udf(f"array<{entities.ENTITY}>")
        def found(texts: pd.Series) -> pd.Series:
            return pd.Series(self.names_of(texts.tolist()), texts.index, object)

        return found(text)


def _allowed() -> np.ndarray:
    """Which tag may come after which."""
    out = np.ones((len(TAGS), len(TAGS)), bool)
    for begin in _CATEGORY:
        out[:, begin + 1] = False
        out[[begin, begin + 1], begin + 1] = True
    return out


def learn(sentences: DataFrame, text: str = "text", names: Column | None = None) -> Tagger:
    """The tagger of sentences whose names are known: array<struct<s, e, raw, cat>>, disjoint (default: what dictionaries and forms find)."""
    known = entities.entities(F.coalesce(text, F.lit(""))) if names is None else names
    rows = sentences.select(F.col(text).alias("text"), known.alias("names")).mapInArrow(_counted, "kind int, what string, tag int, n long")
    counts = rows.groupBy("kind", "what", "tag").agg(F.sum("n").alias("n")).collect()  # bounded by the different characters
    places, given = [], []
    for kind in range(len(AROUND)):
        own = [r for r in counts if r["kind"] == kind]
        place = {c: i for i, c in enumerate(sorted({r["what"] for r in own}))}
        table = np.ones((len(place) + 1, len(TAGS)))
        for r in own:
            table[place[r["what"]], r["tag"]] += r["n"]
        places.append(place)
        given.append(np.log(table / table.sum(0)))
    moves = np.ones((len(TAGS), len(TAGS)))
    for r in counts:
        if r["kind"] == len(AROUND):
            moves[int(r["what"]), r["tag"]] += r["n"]
    allowed = _allowed()
    moves = np.where(allowed, moves, 0)
    with np.errstate(divide="ignore"):
        return Tagger(places, given, np.log(moves / moves.sum(1, keepdims=True)))
