"""Spans of crowded texts, found, placed and chosen a batch at a time; and the column functions at the lengths at which they change their way."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.functions import crowds, text


def _greedy(spans):
    kept = []
    for s, e in spans:
        if all(b <= s or e <= a for a, b in kept):
            kept.append((s, e))
    return kept


@pytest.mark.parametrize("rounds", [0, 1, 8])
def test_choice_is_greedy_in_order(monkeypatch, rounds):
    monkeypatch.setattr(crowds, "ROUNDS", rounds)
    rng = random.Random(rounds)
    rows = [[(s, s + rng.randint(1, 9)) for s in (rng.randrange(60) for _ in range(n))] for n in (0, 1, 2, 3, 40, 0, 200)]
    rows.append([(s, s + 7) for s in range(0, 600, 5)])  # a chain: one long cluster
    rows.append(rows[-1][::-1])
    row, s, e = (np.array(x) for x in zip(*((i, s, e) for i, spans in enumerate(rows) for s, e in spans), strict=True))
    kept = crowds.chosen(row, s, e)
    for i, spans in enumerate(rows):
        assert [tuple(x) for x in np.stack([s, e], 1)[(row == i) & kept].tolist()] == _greedy(spans)


def test_batches_and_columns_agree_with_python(spark):
    words = ["", "no", "a1 b22 c333", "𠮷1𠮷22", "x\x01y 12 \x01 3a", None, "1", "a12" * 40, "ab 12, " * 500]
    searches = [("[a-z][0-9]", None), ("[0-9]+", "[0-9]"), ("[A-Z]{2}", "[A-Z]")]
    df = spark.createDataFrame(list(enumerate(words)), "id long, t string")
    col = F.coalesce("t", F.lit(""))
    batch = {r["id"]: r["k"] for r in crowds.accepted(df, col, searches, "k").collect()}
    every = df.select("id", F.flatten(text.spans_of(col, searches)).alias("c"))
    plain = {r["id"]: r for r in every.select("id", "c", text.accepted(F.col("c"), text.SPAN).alias("k")).collect()}
    for i, t in enumerate(words):
        want = [(m.start(), m.end(), m[0]) for pattern, _ in searches for m in re.finditer(pattern, t or "")]
        assert [tuple(x) for x in plain[i]["c"]] == want
        kept = set(_greedy([x[:2] for x in want]))
        want = [x for x in want if x[:2] in kept and kept.remove(x[:2]) is None]
        assert [tuple(x) for x in plain[i]["k"]] == want and [tuple(x) for x in batch[i]] == want


def test_a_text_is_searched_once(spark):
    """Matches and gaps come from one search; before, matches were found by one and gaps by another."""
    df = spark.createDataFrame([("a1",)], "t string").select(text.spans(F.col("t"), "[a-z][0-9]").alias("s"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") == 1 and "regexp_extract_all" not in plan.split("regexp_replace")[1]
