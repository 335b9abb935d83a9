"""The word model of the quality rules against a plain one."""

import collections

import helpers
import numpy as np
import pyarrow as pa

from inkveil.llm import quality


def plain(docs):
    """Log-perplexity of each (text, lang): an interpolated modified Kneser-Ney bigram model of all."""
    said = [[("<", lang), *((w, lang) for w in "".join("0" if c in "0123456789" else c for c in (t or "").translate(helpers.UPPER)).translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w)] for t, lang in docs]
    pairs = collections.Counter(g for w in said for g in zip(w, w[1:], strict=False))
    before = collections.Counter(b for _, b in pairs)

    def off(values):
        n = [sum(v == k for v in values) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        return {k: max(0.0, min(k, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else 0.5 for k in (1, 2, 3)}

    d, e = off(pairs.values()), off(before.values())
    spare = sum(e[min(v, 3)] for v in before.values())
    lower = {w: (v - e[min(v, 3)] + spare / (len(before) + 1)) / len(pairs) for w, v in before.items()}
    total, kept = collections.Counter(), collections.Counter()
    for (a, _), v in pairs.items():
        total[a] += v
        kept[a] += d[min(v, 3)]
    p = {(a, b): (v - d[min(v, 3)] + kept[a] * lower[b]) / total[a] for (a, b), v in pairs.items()}
    for a in total:
        assert sum(v for (x, _), v in p.items() if x == a) < 1 + 1e-9  # the rest is for bigrams that no document has
    return [-np.mean([np.log(p[g]) for g in zip(w, w[1:], strict=False)]) if len(w) > 1 else None for w in said]


def test_perplexities_are_the_plain_models(spark, docs):
    few = [("A b a c", "en"), ("a b a b d", "en"), ("b a 12 e", "en"), ("a b x", "fr"), ("y x\ta b", "fr"), ("a b", None), ("a b", ""), (" ", "en"), (None, None)]
    table = spark.createDataFrame([(t, lang, i) for i, (t, lang) in enumerate(few)], "text string, lang string, doc_id long").repartition(3)
    for frame, said in ((table, few), (docs, [(r[1], r[2]) for r in helpers.rows()])):
        got = [(r["lang"] or "", r["log_perplexity"]) for r in quality.document_stats(frame).collect()]
        every = [(lang or "", x) for x, (_, lang) in zip(plain(said), said, strict=True)]
        key = lambda r: (r[0], r[1] is None, r[1] or 0.0)
        for (lang, x), (own, y) in zip(sorted(got, key=key), sorted(every, key=key), strict=True):
            assert lang == own and (x is None) == (y is None) and (x is None or abs(x - y) < 1e-9)  # each document: no two words share a place


def test_words_carry_their_language():
    batch = pa.RecordBatch.from_pydict({"text": ["a b", "b", "", "b"], "lang": ["x", "x", None, "y"]})
    first, second, before = quality.words(batch)
    assert before.tolist() == [0, 2, 3, 3, 4] and first[1] == second[0] and second[1] == second[2] and first[0] == first[2]
    assert second[3] != second[2] and first[3] != first[2]


def test_one_block_has_a_bigram_as_its_own():
    keys = [np.array(k, np.uint64) for k in ([1, 5, 9], [5, 7], [1, 7, 9])]
    array = quality.HashArray(keys, [np.ones((1, len(k)), np.int64) for k in keys])
    assert [a[0].tolist() for a in array.answers()] == [[2, 2, 2], [2, 2], [2, 2, 2]]
    assert [o.tolist() for o in array.owned()] == [[1, 1, 1], [0, 1], [0, 0, 0]]


def test_the_model_grows_with_the_input(spark):
    """Texts of few byte 4-grams have ever more word bigrams."""
    r = np.random.default_rng(5)
    text = lambda n: " ".join("".join(r.choice(list("ab"), 5)) for _ in range(n))
    sizes = []
    for n in (50, 3000):
        blocks, size, buckets = quality.in_blocks(spark.createDataFrame([(1, text(n), "en")], "doc_id long, text string, lang string"), "doc_id", "lang")
        sizes.append(quality.model_of(blocks, size, buckets)[1].every)
    assert sizes[1] > 5 * sizes[0]


def test_copies_are_not_too_predictable(spark):
    """A clean text in many copies stays; one that is predictable by itself goes."""
    r = np.random.default_rng(11)
    text = lambda words, n: " ".join(r.choice(words, n))
    words = ["".join(r.choice(list("abcdefgh"), 4)) for _ in range(300)]
    copy = text(words, 200)
    rows = [(i, text(words, 200)) for i in range(60)] + [(i, copy) for i in range(60, 75)] + [(99, " | ".join("".join(r.choice(list("stuvwxyz"), 9)) for _ in range(100)))]
    got = {x["doc_id"]: x for x in quality.quality(spark.createDataFrame([(*x, "en") for x in rows], "doc_id long, text string, lang string")).collect()}
    assert got[60]["log_perplexity"] < got[60]["low"] and got[60]["kept"] and got[60]["shared"] == 1
    assert got[99]["log_perplexity"] < got[99]["low"] and not got[99]["kept"] and sum(got[i]["kept"] for i in range(60)) > 55


def test_own_counts():
    assert quality._own_counts(np.array([0, 0, 0, 1]), np.array([5, 5, 6, 5])).tolist() == [2, 2, 1, 1]


def test_blocks_are_worked_part_by_part(monkeypatch):
    text = [f"w{i % 7} w{i % 5} w{i % 3}" for i in range(40)]
    whole = pa.RecordBatch.from_pydict({"text": text, "lang": ["x", None] * 20})
    monkeypatch.setattr(quality, "_texts_of", lambda row: whole)
    one = quality._distinct({})
    monkeypatch.setattr(quality, "PART_BYTES", 20)
    assert len(list(quality._parts({}))) > 10 and all(np.array_equal(a, b) for a, b in zip(one, quality._distinct({}), strict=True))
    assert one[3].sum() == 120


def test_bits_grow_with_the_texts():
    """Fewer than one of 2 ** SPARE_BITS words or bigrams shares a hash, however long the texts are."""
    for size in (0, 1, 1000, 10**9, 10**12, 10**15):
        bits = quality.bits_for(size)
        assert bits == 64 or 2**bits >= (size // 2) << quality.SPARE_BITS
    first, second = np.arange(10**5, dtype=np.uint64), np.arange(10**5, dtype=np.uint64)[::-1]
    keys = quality.bigrams(first, second, quality.bits_for(2 * 10**5))
    assert len(np.unique(keys)) == 10**5 and keys.max() < 1 << quality.bits_for(2 * 10**5)


def test_tables_go_when_they_are_read(spark, docs):
    names = lambda: {t.name for t in spark.catalog.listTables()}
    before = names()
    kept = quality.quality(docs)
    assert names() == before and kept.count() == docs.count()


def test_shuffle_files_go_when_a_table_is_written(spark):
    import pathlib
    import time

    from inkveil.llm import blocks

    before = spark.conf.get(blocks._REMOVED, "false")
    folder = pathlib.Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    files = lambda: {p for p in folder.rglob("shuffle_*.data") if p.stat().st_size}
    old = files()
    table = blocks.bucketed(spark.range(1000).selectExpr("id", "id % 7 AS block").repartition(5, "block"), 3, "few")
    for _ in range(50):
        if not files() - old:
            break
        time.sleep(0.1)
    assert not files() - old and table.count() == 1000 and spark.conf.get(blocks._REMOVED, "false") == before
    blocks.forgotten(table)


def test_answers_are_written_once(spark, docs):
    """By the tasks that give them, not shuffled first; only they are brought to the blocks, whose texts stay."""
    table, size, buckets = quality.in_blocks(docs.select("doc_id", "text", "lang"), "doc_id", "lang")
    known, _, tables = quality.model_of(table, size, buckets)
    assert not any(hasattr(t, "_inkveil_table") for t in tables)
    assert known._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    quality.forgotten(table, *tables)


def test_hashes_are_added_up_a_stretch_at_a_time(monkeypatch):
    """With the same sums, owners and kinds, however few hashes are taken at once."""
    r = np.random.default_rng(7)
    keys = [np.unique(r.integers(0, 400, n).astype(np.uint64) << np.uint64(55)) for n in (200, 0, 90, 300)]
    values = [r.integers(1, 4, (2, len(k))) for k in keys]
    one = quality.HashArray(keys, values)
    monkeypatch.setattr(quality, "ADDED_AT_ONCE", 16)
    two = quality.HashArray(keys, values)
    every = collections.Counter()
    for k, v in zip(keys, values, strict=True):
        every.update(dict(zip(k.tolist(), v[1].tolist(), strict=True)))
    for array in (one, two):
        assert [a[1].tolist() for a in array.answers()] == [[every[x] for x in k.tolist()] for k in keys]
        assert array.kinds[1].tolist() == quality._kinds(np.array(list(every.values()))) and sum(o.sum() for o in array.owned()) == len(every)
    assert all(np.array_equal(a, b) for a, b in zip(one.owned(), two.owned(), strict=True))


def test_passes_ask_each_bigram_once(spark, docs):
    """A pass asks for its share of the bigrams, and all passes together for each of them once."""
    table, size, _ = quality.in_blocks(docs.select("doc_id", "text", "lang"), "doc_id", "lang")
    row, bits = table.first().asDict(), quality.bits_for(size)
    block = pa.RecordBatch.from_pylist([{k: row[k] for k in ("block", "ids", "offsets", "body", "more")}])
    passes = [next(quality._asked(iter([block]), 2 * 5, bits, turn, 2)).to_pylist() for turn in range(2)]
    assert [{x["range"] for x in rows} for rows in passes] == [set(range(5)), set(range(5, 10))]
    keys, _, _, count = quality._distinct(row, bits)
    asked = [(quality.unpack_ascending(x["keys"]), quality._unpacked(x["values"], 1)[0]) for rows in passes for x in rows]
    assert np.array_equal(np.concatenate([k for k, _ in asked]), keys) and np.array_equal(np.concatenate([c for _, c in asked]), count)
    quality.forgotten(table)
