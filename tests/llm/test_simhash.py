"""SimHash near duplicates against brute force, with awkward rows and long posting lists."""

import collections
import random

import helpers
import numpy as np
import pytest
import xxhash

from inkveil.llm import simhash


def brute_fingerprint(text, words=4):
    w = helpers.words((text or "").translate(helpers.UPPER))
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits=4):
    """{doc_id: component} of (doc_id, fingerprint); null ids link others but have no component."""
    values = sorted({f for _, f in prints})
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = collections.defaultdict(lambda: float("inf"))
    for d, f in prints:
        if d is not None:
            least[find(f)] = min(least[find(f)], d)
    return collections.Counter((d, f"{f:016x}", least[find(f)] if d is not None else None) for d, f in prints)


@pytest.mark.parametrize("long", [simhash.LONG, 3])
def test_documents(spark, docs, folder, long):
    got = simhash.op12_simhash(spark, folder) if long > 3 else simhash.near_duplicates(docs, long=long)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    expected = brute_components([(r[0], brute_fingerprint(r[1])) for r in helpers.rows()])
    assert collections.Counter(map(tuple, got.collect())) == expected
    assert ("0" * 16) in {f for _, f, _ in expected}


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).count() == 0


def test_every_near_pair_shares_a_list():
    r = random.Random(2)
    assert all(set(simhash.PAIRS) & set(__import__("itertools").combinations(four, 2)) for four in __import__("itertools").combinations(range(8), 4))
    for _ in range(2000):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(0, 9)):
            b ^= 1 << bit
        same = sum(a >> 8 * p & 255 == b >> 8 * p & 255 for p in range(8))
        assert simhash.shared_bytes(np.array([a ^ b], np.uint64))[0] == same


@pytest.mark.parametrize("long", [5, 40, 100_000])
def test_crowded_lists_lose_no_link(spark, long):
    """Many fingerprints around a few centres: lists by two, three and four bytes are too long, and dealt out in tiles."""
    r = random.Random(4)
    values = set()
    for _ in range(4):
        centre = r.getrandbits(64)
        for _ in range(150):
            v = centre
            for bit in r.sample(range(64), r.choice([1, 2, 3, 9, 12])):
                v ^= 1 << bit
            values.add(v)
    values |= {r.getrandbits(64) for _ in range(200)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    lists, _ = simhash.lists_of(spark.createDataFrame([(v,) for v in signed], "fp long"), long)
    rows = lists.repartition("mask", "value", "tile").sortWithinPartitions("mask", "value", "tile").mapInArrow(lambda b: simhash._tallied(b, 4), "a long, b long").collect()
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in rows:
        a, b = a % (1 << 64), b % (1 << 64)
        assert (a ^ b).bit_count() <= 4
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 4:
                assert find(a) == find(b)


def test_long_texts_and_stretches(monkeypatch):
    words = [str(i % 977) for i in range(5000)]
    texts = [" ".join(words), "", "a b", " ".join(words[:300])]
    body = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    whole = simhash.fingerprints(*simhash.shingle_hashes(body, offsets, 4))
    monkeypatch.setattr(simhash, "STRETCH", 97)
    assert (simhash.fingerprints(*simhash.shingle_hashes(body, offsets, 4)) == whole).all()
    assert whole.tolist() == [brute_fingerprint(t) for t in texts]
