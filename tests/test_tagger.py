"""The sequence model of names: Viterbi against all paths, held-out F1, and masking by it."""

import datetime
import itertools
import random

import numpy as np
import plain
import pytest

from inkveil.operators import entities, masking, tagger

TODAY = datetime.date(2026, 3, 1)


def _said(n, seed, surnames=""):
    """Sentences with names, of which some are in no list: the model has to tell them by what stands around."""
    r = random.Random(seed)
    first, given = (surnames or "田中 鈴木 佐藤 高橋 神宮寺 綾小路 榎本 柊").split(), "太郎 花子 次郎 美咲 健一 翔".split()
    companies = "アルファ ベータ東 ガンマ 北斗 山海 サクラ".split()
    out = []
    for _ in range(n):
        person, company = r.choice(first) + r.choice(given), "株式会社" + r.choice(companies) + r.choice(["", "商事", "工業"])
        parts = r.choice([[("", person), ("部長は", company), ("へ行きました。", "")], [("昨日", company), ("の", person), ("様が来ます。", "")], [("今日は雨です。", ""), ("明日は", person), ("さんです。", "")], [("何もない日。", "")]])
        text, names = "", []
        for before, name in parts:
            text += before
            if name:
                names.append((len(text), len(text) + len(name), name, entities.ORGANISATION if name == company else entities.PERSON))
                text += name
        out.append((text, names))
    return out


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame([(t, n) for t, n in _said(600, 1)] + [(None, []), ("", [])], f"text string, names array<{entities.ENTITY}>").repartition(3)
    return tagger.learn(df, names=df["names"])


def test_viterbi_is_the_best_of_all_paths(model):
    r = random.Random(3)
    for _ in range(20):
        text = "".join(r.choice("田中太郎部長は株式会社の、ア") for _ in range(r.randint(1, 5)))
        scores = model.scores(text)
        value = lambda path: model.moves[0, path[0]] + sum(scores[i, t] for i, t in enumerate(path)) + sum(model.moves[a, b] for a, b in itertools.pairwise(path))  # noqa: E731, B023
        best = max(itertools.product(range(5), repeat=len(text)), key=value)
        assert value(model.tags(text).tolist()) == pytest.approx(value(best))


def test_counts_are_the_plain_ones(model):
    said = _said(600, 1)
    tags = [tagger.tags_of(len(t), [(s, e, c) for s, e, _, c in n]).tolist() for t, n in said]
    moves = np.ones((5, 5))
    for own in tags:
        for a, b in zip([0, *own[:-1]], own, strict=True):
            moves[a, b] += 1
    moves *= tagger._allowed()
    with np.errstate(divide="ignore"):
        assert np.allclose(model.moves, np.log(moves / moves.sum(1, keepdims=True)))
    c, t = "部", 0
    n = sum(x == c and y == t for (text, _), own in zip(said, tags, strict=True) for x, y in zip(text, own, strict=True))
    every = sum(y == t for own in tags for y in own)
    assert np.isclose(model.given[1][model.places[1][c], t], np.log((n + 1) / (every + len(model.places[1]) + 1)))


def test_held_out_names(spark, model):
    """F1 of whole names in sentences that the model hasn't seen."""
    said = _said(300, 77)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(said)] + [(300, None)], "id long, text string")
    got = {r["id"]: {(x["s"], x["e"], x["cat"]) for x in r["names"]} for r in df.select("id", model.entities(df["text"]).alias("names")).collect()}
    assert got[300] == set()
    hit = sum(len(got[i] & {(s, e, c) for s, e, _, c in n}) for i, (_, n) in enumerate(said))
    f1 = 2 * hit / (sum(len(got[i]) for i in range(300)) + sum(len(n) for _, n in said))
    assert f1 > 0.9
    # surnames of characters that the model hasn't seen
    new = _said(300, 78, "御手洗 五条 鳥居 蓮")
    found = [{(x["s"], x["e"]) for x in model.names(t)} for t, _ in new]
    hit = sum(len(a & {(s, e) for s, e, _, _ in n}) for a, (_, n) in zip(found, new, strict=True))
    unseen = 2 * hit / (sum(map(len, found)) + sum(len(n) for _, n in new))
    print("held-out F1", round(f1, 3), "with new surnames", round(unseen, 3))
    assert unseen > 0.5


def test_masking_by_the_model(spark, model):
    df = spark.createDataFrame([(0, "昨日株式会社北斗商事の神宮寺美咲様が来ます。"), (1, None)], "id long, text string")
    rows = {r["id"]: r["masked"] for r in masking.mask_rows(masking.detect(df, today=TODAY, model=model)).collect()}
    assert rows == {0: "昨日【組織A】の【人物A】様が来ます。", 1: None}
    both, _ = masking.mask(df, "id", today=TODAY, model=model, part_chars=5)
    assert {r["id"]: r["masked"] for r in both.collect()} == rows
    with pytest.raises(ValueError, match="not by both"):
        masking.detect(df, model=model, custom=[("人物", "x")])


def test_dictionaries_teach(spark):
    """Without known names, what dictionaries and forms find is learned."""
    texts = [t for t, _ in _said(300, 5)]
    taught = tagger.learn(spark.createDataFrame([(t,) for t in texts], "text string"))
    known = [{(s, e) for s, e, _, _ in plain.plain_names(t)} for t in texts]
    mine = [{(x["s"], x["e"]) for x in taught.names(t)} for t in texts]
    assert sum(len(a & b) for a, b in zip(known, mine, strict=True)) > 0.6 * sum(map(len, known))
