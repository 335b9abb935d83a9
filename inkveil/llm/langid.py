"""Language identification by cross-parsing: how many phrases of a language's labelled text does a document need?

For each language a suffix automaton of a bounded sample of labelled text (TRAIN_BYTES, from the TRAIN_DOCS documents
of least hash) is built once, and sent to the executors as one transition table. A document's normalised bytes are cut
into pieces of PIECE bytes; in each piece the automaton follows the longest match in the sample, then begins anew. The
number of such phrases times the binary logarithm of the sample's size, by byte, is the cross-parsing entropy; the
language with the least wins (ties: the first by name). All pieces of a batch advance together, a byte at a time.

Only text is used for a prediction. Results: `und` and score 0 for a null, empty or letterless text, or if there is
nothing to learn from. A null or repeated doc_id is passed on (a null one is never learned from). Other columns of
the input are passed on only if asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, flat

TRAIN_BYTES, TRAIN_DOCS, PIECE = 20_000, 64, 512
#: The languages of one table; more are told apart by several tables, each in tasks of its own.
TABLE_LANGUAGES = 64
#: Above this entropy (bits a byte) no language explains the text; letters at random have 4.7.
MAX_BITS = 5.5

_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def normalised(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters and other non-ASCII bytes as they are; what lies between is one blank. Offsets follow."""
    out = _CLASS[body]
    high = np.flatnonzero((body[:-1] == 0xC3) & (body[1:] >= 0x80) & (body[1:] <= 0x9E) & (body[1:] != 0x97)) + 1
    out[high] |= 0x20  # À to Þ
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    keep[offsets[:-1][offsets[:-1] < len(out)]] = True
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def automaton(text: bytes) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of text, whose zero bytes are never crossed; state 0 is the start."""
    follow: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in text:
        if c == 0:
            last = 0
            continue
        if (at := follow[last].get(c)) is not None:  # only after a break: what follows it may be known
            if size[at] == size[last] + 1:
                last = at
                continue
            copy = len(follow)
            follow.append(dict(follow[at]))
            link.append(link[at])
            size.append(size[last] + 1)
            link[at], p = copy, last
            while p >= 0 and follow[p].get(c) == at:
                follow[p][c] = copy
                p = link[p]
            last = copy
            continue
        new = len(follow)
        follow.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            at = follow[p][c]
            if size[at] == size[p] + 1:
                link[new] = at
            else:
                copy = len(follow)
                follow.append(dict(follow[at]))
                link.append(link[at])
                size.append(size[p] + 1)
                while p >= 0 and follow[p].get(c) == at:
                    follow[p][c] = copy
                    p = link[p]
                link[at] = link[new] = copy
        last = new
    return follow


class Languages:
    """The languages' automata as one table: entry state + symbol holds the next state times two, plus one where a phrase ends."""

    def __init__(self, samples: dict[str, bytes]):
        self.names = sorted(samples)
        automata = [automaton(samples[k]) for k in self.names]
        used = sorted({c for a in automata for state in a for c in state})
        self.symbol = np.zeros(256, np.int64)  # 0: in no sample
        self.symbol[used] = np.arange(1, len(used) + 1)
        width, base, tables, self.roots = len(used) + 1, 0, [], []
        for states in automata:
            self.roots.append(base)
            start = np.full(width, base, np.int64)
            for c, to in states[0].items():
                start[self.symbol[c]] = base + to * width
            table = np.tile(start * 2 + 1, (len(states), 1))
            for i, state in enumerate(states):
                for c, to in state.items():
                    table[i, self.symbol[c]] = (base + to * width) * 2
            tables.append(table.ravel())
            base += table.size
        if base >= 1 << 30:
            raise ValueError("too long samples for one table: learn with fewer table_languages")
        self.table = np.concatenate(tables).astype(np.int32) if tables else np.zeros(0, np.int32)
        self.weight = np.array([np.log2(max(2, len(samples[k]))) for k in self.names])

    def phrases(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each language (row) and text (column): the number of phrases."""
        sizes, n = np.diff(offsets), len(offsets) - 1
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(n), pieces)
        begin = offsets[owner] + PIECE * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        length = np.minimum(begin + PIECE, offsets[owner + 1]) - begin
        order = np.argsort(-length, kind="stable")
        owner, begin, length = owner[order], begin[order], length[order]
        live = np.searchsorted(-length, -np.arange(PIECE), "left")  # how many pieces are longer than i
        symbols = self.symbol[body]
        roots = np.array(self.roots)[:, None]
        state = np.repeat(roots, len(owner), axis=1)
        count = np.zeros(state.shape, np.int32)
        for i in range(PIECE):
            k = live[i]
            if not k:
                break
            got = self.table[state[:, :k] + symbols[begin[:k] + i]]
            count[:, :k] += got & 1
            state[:, :k] = got >> 1
        count += state != roots
        out = np.zeros((len(self.names), n), np.int64)
        for row, each in zip(out, count, strict=True):
            row += np.bincount(owner, weights=each, minlength=n).astype(np.int64)
        return out


def held_out() -> Column:
    """Which documents nothing is learned from: a fifth, by doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, train_bytes: int = TRAIN_BYTES, train_docs: int = TRAIN_DOCS, table_languages: int = TABLE_LANGUAGES) -> Languages | list[dict[str, bytes]]:
    """The languages of the labelled documents that aren't held out; beyond table_languages, the samples of each table's languages. At most train_docs documents of a language come to the driver."""
    first = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", "doc_id", F.xxhash64("doc_id").alias("h"))
    rows = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= train_docs)
    # of each of them so much as could fill the sample alone
    table = rows.select("lang", "n", F.substring("text", 1, train_bytes).alias("text")).orderBy("lang", "n").toArrow()
    samples: dict[str, bytes] = {}
    for lang, text in zip(table["lang"].to_pylist(), table["text"].to_pylist(), strict=True):
        body, offsets = flat(pa.array([text]))
        have = samples.get(lang, b"")
        samples[lang] = (have + (b"\0" if have else b"") + normalised(body, offsets)[0].tobytes())[:train_bytes]
    if len(samples) > table_languages:
        names = sorted(samples)
        return [{k: samples[k] for k in names[i : i + table_languages]} for i in range(0, len(names), table_languages)]
    return Languages(samples)


def _identified(batches: Iterator[pa.RecordBatch], languages: Languages, carried: list[str]) -> Iterator[pa.RecordBatch]:
    names = pa.array([*languages.names, "und"])
    for batch in chunks(batches):
        body, offsets = normalised(*flat(batch.column("text")))
        known = batch.column("__has_letter").to_numpy(zero_copy_only=False) & bool(languages.names)
        best, score, bits = np.full(batch.num_rows, len(languages.names)), np.zeros(batch.num_rows), np.full(batch.num_rows, np.nan)
        if known.any():
            cost = languages.phrases(body, offsets) * languages.weight[:, None]
            two = np.sort(cost, axis=0)[:2]
            best[known] = np.argmin(cost, axis=0)[known]
            score[known] = (1 - two[0] / two[1])[known] if len(two) > 1 else 1.0
            bits[known] = (two[0] / np.maximum(np.diff(offsets), 1))[known]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), names.take(pa.array(best)), pa.array(score), pa.array(bits, mask=~known)], [*carried, "__lang_pred", "__score", "__bits"])


def _costs(batches: Iterator[pa.RecordBatch], samples: dict[str, bytes]) -> Iterator[pa.RecordBatch]:
    """key of each text, the best of the sampled languages, its cost, the next one's (null if there is none) and the normalised size."""
    languages = Languages(samples)
    names = pa.array(languages.names)
    for batch in chunks(batches):
        body, offsets = normalised(*flat(batch.column("text")))
        cost = languages.phrases(body, offsets) * languages.weight[:, None]
        two = np.sort(cost, axis=0)[:2]
        after = pa.array(two[1]) if len(two) > 1 else pa.nulls(batch.num_rows, pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column("key"), names.take(pa.array(np.argmin(cost, axis=0))), pa.array(two[0]), after, pa.array(np.diff(offsets))], ["key", "name", "cost", "after", "size"])


def _identified_by_tables(docs: DataFrame, tables: list[dict[str, bytes]], carried: list[str]) -> DataFrame:
    """As identify: each text's costs by each table, of which the least counts (ties: the first by name). A prediction is a text's, so texts are joined by their hashes."""
    rows = docs.select(*dict.fromkeys([*carried, "text"]), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__has_letter"))
    key = F.sha2(F.col("text"), 256)
    texts = rows.where("__has_letter").select(key.alias("key"), "text")
    costs = [texts.mapInArrow(lambda batches, samples=samples: _costs(batches, samples), "key string, name string, cost double, after double, size long") for samples in tables]
    every = costs[0]
    for more in costs[1:]:
        every = every.unionByName(more)
    # copies of a text first become one row for each table
    once = every.groupBy("key", "name").agg(F.first("cost").alias("cost"), F.first("after").alias("after"), F.first("size").alias("size"))
    both = F.array_sort(F.flatten(F.collect_list(F.array_compact(F.array("cost", "after")))))
    best = once.groupBy("key").agg(F.min(F.struct("cost", "name")).alias("best"), F.element_at(both, 2).alias("next"), F.first("size").alias("size"))
    best = best.select(F.col("key").alias("__key"), F.col("best.name").alias("__lang_pred"), (1 - F.col("best.cost") / F.col("next")).alias("__score"), (F.col("best.cost") / F.greatest("size", F.lit(1))).alias("__bits"))
    known = rows.where("__has_letter").withColumn("__key", key).join(best, "__key").select(*carried, "__lang_pred", "__score", "__bits")
    return known.unionByName(rows.where("NOT __has_letter").select(*carried, F.lit("und").alias("__lang_pred"), F.lit(0.0).alias("__score"), F.lit(None).cast("double").alias("__bits")))


def identify(docs: DataFrame, languages: Languages | list[dict[str, bytes]], carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns of each row, with __lang_pred, __score (0 to 1: how far the best is from the next) and __bits (entropy a byte; null for und)."""
    if isinstance(languages, list):
        docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
        return _identified_by_tables(docs, languages, list(carried))
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    sent = docs.sparkSession.sparkContext.broadcast(languages)
    rows = docs.select(*dict.fromkeys([*carried, "text"]), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__has_letter"))
    kept = list(carried)
    schema = rows.select(*kept).withColumns({"__lang_pred": F.lit(""), "__score": F.lit(0.0), "__bits": F.lit(0.0)}).schema
    for field in schema:
        field.nullable = True
    return rows.mapInArrow(lambda batches: _identified(batches, sent.value, kept), schema)


def op5_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, learn(docs))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"), F.col("__bits").alias("bits"))


QUERIES = {"op5_language": op5_language}
SQL: dict[str, str] = {}
