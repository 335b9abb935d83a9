"""Masking: detection, choice of what is replaced, labels by first appearance, rewriting.

Dates come first, then persons and organisations, then the rules in order; whatever overlaps an earlier choice is dropped
whole. A value's label is its category's next letter when it first appears; dates and names take one even where they are
dropped. With session "row", each row is a session of its own: labels are found within the row, and nothing is shuffled.
With a session column (or one session for all), first appearances are aggregated by value, ranked without putting a
session into one task, and joined back to the findings, those of frequent values without a shuffle (see joins); rows without any pass by. A long text is cut where no match can lie
(see patterns.cuts), and its parts are masked like rows of their own, by all tasks.

The cost of a row is near linear in its findings: choice goes by clusters of overlapping spans, labels by sorting, splicing part by part.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions import patterns
from inkveil.functions.joins import join_unique
from inkveil.functions.tables import written
from inkveil.functions.text import PIECE, accepted, empty, label, let, md5_8, parts, scanned, spans, spans_of, spliced, token

from . import dates, entities
from . import gazetteer as names_of_table

MAPPING = "category string, original string, md5 string, label string"
#: Texts of more characters are cut into parts of about so many.
PART_CHARS = 1 << 16
#: Events of a row that are compared each with all others; more are sorted.
FEW_EVENTS = 8
_RAW = "__text"


def _piece(s, e, cat, raw, pre=None, suf=None, lit=None, ev=None) -> Column:
    text = lambda c: F.lit(None).cast("string") if c is None else c
    event = F.lit(None) if ev is None else ev
    return F.struct(s.alias("s"), e.alias("e"), cat.alias("cat"), raw.alias("raw"), text(pre).alias("pre"), text(suf).alias("suf"), text(lit).alias("lit"), event.cast("int").alias("ev"))


def rule_pieces(text: Column, rules: tuple[patterns.Rule, ...]) -> Column:
    """array<struct<k, p>>: the pieces (p) of the rules' matches, rule by rule (k, from 0) and by place."""

    def kept(x: Column, k: Column, side: str) -> Column:
        """What stays before (pre) or after (suf) the token."""
        out = F.lit(None).cast("string")
        for i, rule in enumerate(rules):
            if pattern := getattr(rule, side):
                own = F.regexp_extract(x["raw"], patterns.java(pattern), 0)
                if rule.name == "patent" and side == "suf":
                    own = F.when(x["raw"].startswith("US") | x["raw"].startswith("EP") | x["raw"].startswith("JP") | x["raw"].startswith("WO"), F.lit("")).otherwise(own)
                out = F.when(k == i, own).otherwise(out)
        return out

    def piece(x: Column, k: Column) -> Column:
        category = F.element_at(F.array(*(F.lit(r.category) for r in rules)), k + 1) if len(rules) > 1 else F.lit(rules[0].category)
        digits = F.translate(F.regexp_replace(x["raw"], "歳", ""), "０１２３４５６７８９", "0123456789")
        age = F.when(category == "年齢", F.concat((F.floor(digits.try_cast("int") / 10) * 10).cast("string"), F.lit("代"))) if any(r.category == "年齢" for r in rules) else None
        return F.struct(k.alias("k"), _piece(x["s"], x["e"], category, x["raw"], kept(x, k, "pre"), kept(x, k, "suf"), age).alias("p"))

    every = spans_of(text, [(patterns.java(r.pattern), patterns.gate_of(r)) for r in rules])
    return F.flatten(F.transform(every, lambda some, k: F.transform(some, lambda x: piece(x, k))))


def detect(df: DataFrame, text: str = "text", today: datetime.date | None = None, custom: list[tuple[str, str]] | None = None, rules: tuple[patterns.Rule, ...] = patterns.RULES, only_rules: bool = False, beside: tuple[str, str] | None = None, gazetteer: DataFrame | None = None, model=None) -> DataFrame:
    """df with __pieces (array<piece>: what is replaced) and __events (array<struct<k, cat, raw>>: what takes labels, in order; k is the stage: dates, names, then each rule).

    A null text has none. An event without a category takes no label (its piece has a fixed replacement). beside: columns of the text before and after this one, in which words may stand that make a short form a date.
    custom: some names (category, name), looked for one by one; gazetteer: a table of category and name, of any size.
    model: a tagger.Tagger, which then finds names in place of all of these.
    """
    if model is not None and (custom or gazetteer is not None):
        raise ValueError("names are found by a model or by dictionaries, not by both")
    df = df if gazetteer is None or only_rules else names_of_table.listed(df, gazetteer, text)
    source = df.withColumn(_RAW, F.coalesce(F.col(text), F.lit("")))
    col = F.col(_RAW)
    if only_rules:
        source = source.withColumn("__dates", empty("struct<s:int,e:int,raw:string>")).withColumn("__names", empty(entities.ENTITY))
    else:
        around = tuple(F.coalesce(F.col(c), F.lit("")) for c in beside) if beside else None
        source = source.withColumn("__candidates", dates.date_candidates(col, around)).withColumn("__valid", dates.valid_dates(F.col("__candidates"), today or datetime.date.today()))
        source = source.withColumn("__dates", dates.chosen_dates(F.col("__candidates"), F.col("__valid"))).withColumn("__names", model.entities(col) if model is not None else entities.entities(col, custom, None if gazetteer is None else F.col("__listed")))
    source = source.withColumn("__ruled", rule_pieces(col, rules))
    taken = F.transform("__dates", lambda x, i: _piece(x["s"], x["e"], F.lit("日付"), x["raw"], ev=i))
    named = F.transform("__names", lambda x, i: _piece(x["s"], x["e"], x["cat"], x["raw"], ev=F.size("__dates") + i))
    # of the rules' pieces, ev is the place among all of them until it is known which stay
    numbered = F.transform("__ruled", lambda x, i: x["p"].withField("ev", i))
    source = source.withColumn("__first", accepted(named, PIECE, taken)).withColumn("__pieces", accepted(numbered, PIECE, F.col("__first")))
    source = source.withColumn("__later", F.slice("__pieces", F.size("__first") + 1, F.size("__pieces")))
    event = lambda k, cat, raw: F.struct(F.lit(k).alias("k"), cat.alias("cat"), raw.alias("raw"))
    by_rule = F.transform("__later", lambda p: F.struct((F.element_at(F.col("__ruled"), p["ev"] + 1)["k"] + 2).alias("k"), F.when(p["lit"].isNull(), p["cat"]).alias("cat"), p["raw"].alias("raw")))
    events = F.concat(F.transform(taken, lambda p: event(0, p["cat"], p["raw"])), F.transform(named, lambda p: event(1, p["cat"], p["raw"])), by_rule)
    before = F.size("__dates") + F.size("__names")
    source = source.withColumn("__events", events).withColumn("__pieces", F.concat("__first", F.transform("__later", lambda p, i: p.withField("ev", before + i))))
    return source.drop("__candidates", "__valid", "__dates", "__names", "__ruled", "__first", "__later", "__listed")


def _replacement(p: Column, name: Column) -> Column:
    """struct<s, e, rep> of a piece whose label is name."""
    shown = F.concat(F.coalesce(p["pre"], F.lit("")), token(p["cat"], name), F.coalesce(p["suf"], F.lit("")))
    return F.struct(p["s"].alias("s"), p["e"].alias("e"), F.coalesce(p["lit"], shown).alias("rep"))


def row_labels(events: Column) -> Column:
    """array<struct<i, cat, raw, md5, label>>: the events that take labels, by place (i, from 0), each value's label by its first place in its category; by sorting, in the row alone."""

    def labelled(keyed: Column) -> Column:
        """keyed: in order of cat, md5, i."""
        same = lambda x, j: (j > 0) & F.coalesce(F.try_element_at(keyed, F.greatest(j, F.lit(1)))["md5"] == x["md5"], F.lit(False)) & F.coalesce(F.try_element_at(keyed, F.greatest(j, F.lit(1)))["cat"] == x["cat"], F.lit(False))
        marked = F.transform(keyed, lambda x, j: F.struct(x.alias("x"), (~same(x, j)).alias("first")))

        def named(m: Column) -> Column:
            # values in order of cat and first place, with r, their place by cat and md5
            runs = F.transform(F.filter(m, lambda y: y["first"]), lambda y, r: F.struct(y["x"]["cat"].alias("cat"), y["x"]["i"].alias("i"), r.alias("r")))

            def given(values: Column) -> Column:
                cats = F.transform(values, lambda v: v["cat"])
                start = F.transform(F.array_distinct(cats), lambda c: F.struct(c.alias("cat"), (F.array_position(cats, c) - 1).alias("at")))
                names = lambda s: F.transform(values, lambda v, g: F.struct(v["r"].alias("r"), let(g - F.element_at(F.filter(s, lambda y: y["cat"] == v["cat"]), 1)["at"], label).alias("name")))
                return F.transform(F.sort_array(let(start, names)), lambda v: v["name"])

            number = scanned(m, F.lit(-1), lambda at, y: (at + F.when(y["first"], 1).otherwise(0), at + F.when(y["first"], 1).otherwise(0)), "int")
            row = lambda y, name: F.struct(y["x"]["i"].alias("i"), y["x"]["cat"].alias("cat"), y["x"]["raw"].alias("raw"), y["x"]["md5"].alias("md5"), name.alias("label"))
            return let(let(F.sort_array(runs), given), lambda names: F.sort_array(F.zip_with(m, number, lambda y, n: row(y, F.element_at(names, n + 1)))))

        return let(marked, named)

    def few(keyed: Column) -> Column:
        """Each value's first place is looked for, and the values of its category counted that come before."""
        same = lambda x, y: (x["cat"] == y["cat"]) & (x["md5"] == y["md5"])
        placed = F.transform(keyed, lambda x, j: F.struct(x.alias("x"), j.alias("j"), F.element_at(F.filter(keyed, lambda y: same(x, y)), 1)["i"].alias("at")))

        def named(p: Column) -> Column:
            before = lambda y: F.size(F.filter(p, lambda z: (z["x"]["cat"] == y["x"]["cat"]) & (z["x"]["i"] == z["at"]) & (z["at"] < y["at"])))
            return F.transform(p, lambda y: F.struct(y["x"]["i"].alias("i"), y["x"]["cat"].alias("cat"), y["x"]["raw"].alias("raw"), y["x"]["md5"].alias("md5"), let(before(y), label).alias("label")))

        return let(placed, named)

    def one(k: Column) -> Column:
        return F.array(F.struct(k["i"].alias("i"), k["cat"].alias("cat"), k["raw"].alias("raw"), k["md5"].alias("md5"), F.lit("A").alias("label")))

    keyed = F.filter(F.transform(events, lambda e, i: F.struct(e["cat"].alias("cat"), md5_8(e["raw"]).alias("md5"), i.alias("i"), e["raw"].alias("raw"))), lambda k: k["cat"].isNotNull())
    return let(keyed, lambda k: F.when(F.size(k) == 1, one(F.element_at(k, 1))).when(F.size(k) <= FEW_EVENTS, few(k)).otherwise(let(F.sort_array(k), labelled)))


def mask_rows(found: DataFrame, text: str = "text") -> DataFrame:
    """found (of detect) with masked and mapping (array<struct<category, original, md5, label>>), each row a session of its own."""
    kind = "struct<i:int,cat:string,raw:string,md5:string,label:string>"
    out = found.withColumn("__labels", F.when(F.size("__events") > 0, row_labels(F.col("__events"))).otherwise(empty(kind)))
    # events without a label leave gaps, so that a piece's label is found by the number of such before it: as many as the place it has lost
    named = F.transform("__labels", lambda x: F.struct(x["i"].alias("i"), x["label"].alias("label")))
    nothing = F.transform(F.filter(F.transform("__events", lambda e, i: F.struct(i.alias("i"), e["cat"].alias("cat"))), lambda e: e["cat"].isNull()), lambda e: F.struct(e["i"].alias("i"), F.lit(None).cast("string").alias("label")))
    every = F.when(F.size("__labels") == F.size("__events"), named).otherwise(F.sort_array(F.concat(named, nothing)))
    out = out.withColumn("__by_event", F.transform(every, lambda x: x["label"]))
    shown = F.transform("__pieces", lambda p: _replacement(p, F.element_at("__by_event", p["ev"] + 1)))
    # originals by their first place, each once
    distinct = F.transform(F.array_sort(F.transform(F.col("__labels"), lambda x: F.struct(x["cat"].alias("cat"), x["raw"].alias("raw"), x["i"].alias("i"), x["md5"].alias("md5"), x["label"].alias("label")))), lambda x: x)
    first = let(distinct, lambda d: F.filter(F.transform(d, lambda x, j: F.when((j > 0) & (F.try_element_at(d, F.greatest(j, F.lit(1)))["raw"] == x["raw"]) & (F.try_element_at(d, F.greatest(j, F.lit(1)))["cat"] == x["cat"]), F.lit(None)).otherwise(x)), lambda x: x.isNotNull()))
    rows = F.transform(F.array_sort(F.transform(first, lambda x: F.struct(x["i"].alias("i"), x["cat"].alias("cat"), x["raw"].alias("raw"), x["md5"].alias("md5"), x["label"].alias("label")))), lambda x: F.struct(x["cat"].alias("category"), x["raw"].alias("original"), x["md5"].alias("md5"), x["label"].alias("label")))
    masked = F.when(F.col(text).isNotNull(), spliced(F.col(_RAW), shown))
    return out.withColumn("masked", masked).withColumn("mapping", rows).drop("__labels", "__by_event", "__pieces", "__events", _RAW)


def ranked(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """df with the row's place (from 0) in its group by order: rows are dealt out by range, so that a large group is in many tasks; the offsets come from the counts of (part, group)."""
    columns = [*groups, *order]
    # written, as its part numbers are used twice and another run may cut the ranges elsewhere
    parts = written(df.repartitionByRange(*columns).withColumn("__part", F.spark_partition_id()), "ranked")
    counts = parts.groupBy("__part", *groups).agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(*groups).orderBy("__part")) - F.col("__n")).drop("__n")
    within = parts.withColumn("__own", F.row_number().over(Window.partitionBy("__part", *groups).orderBy(*order)) - 1)
    return within.join(before, ["__part", *groups]).withColumn(name, (F.col("__own") + F.col("__before")).cast("long")).drop("__part", "__own", "__before")


def label_events(events: DataFrame, mapping: DataFrame | None = None, places: bool = False) -> DataFrame:
    """session, category, original, md5, label of events (session, category, original, ord: any orderable column): the mapping's rows and the new ones.

    A new md5's label is that of its rank among the new ones by first appearance, after as many as its category has already.
    places: with place, the ord of the original's first appearance; null for the mapping's rows, which come before.
    """
    spark = events.sparkSession
    keyed = events.withColumn("md5", md5_8(F.col("original")))
    originals = keyed.groupBy("session", "category", "md5", "original").agg(F.min("ord").alias("ord"))
    first = originals.groupBy("session", "category", "md5").agg(F.min("ord").alias("ord"))
    old = mapping if mapping is not None else spark.createDataFrame([], f"session string, {MAPPING}")
    known = old.groupBy("session", "category", "md5").agg(F.max("label").alias("label"))
    held = known.groupBy("session", "category").agg(F.count("*").alias("held"))
    new = first.join(known, ["session", "category", "md5"], "left_anti")
    new = ranked(new, ["session", "category"], ["ord"], "rank").join(held, ["session", "category"], "left")
    labels = known.unionByName(new.select("session", "category", "md5", label(F.col("rank") + F.coalesce("held", F.lit(0))).alias("label")))
    rows = originals.join(labels, ["session", "category", "md5"]).select("session", "category", "original", "md5", "label", *([F.col("ord").alias("place")] if places else []))
    if not places:
        return rows.unionByName(old.join(rows, ["session", "category", "original"], "left_anti").select(rows.columns))
    if mapping is None:
        return rows
    known = old.select("session", "category", "original", "md5", "label", F.lit(None).cast(rows.schema["place"].dataType).alias("place"))
    return known.unionByName(rows.join(old, ["session", "category", "original"], "left_anti"))


def in_parts(df: DataFrame, text: str, chars: int, cut: str | None) -> DataFrame:
    """df, rows of long texts cut into parts: __doc (null for texts in one part), __part (from 0), __own (the part's text), __before and __after (the ends of the parts beside it).

    The other columns are null in all parts but the first. The parts of long texts are dealt out over all tasks.
    """
    whole = df.select("*", F.lit(None).cast("long").alias("__doc"), F.lit(0).alias("__part"), F.col(text).alias("__own"), F.lit("").alias("__before"), F.lit("").alias("__after"))
    if cut is None:
        return whole
    some = df.where(F.length(text) > chars).withColumn("__doc", F.monotonically_increasing_id())

    def rows_of(p: Column) -> Column:
        side = lambda at, body: F.coalesce(body(F.try_element_at(p, at)), F.lit(""))
        before = lambda k: side(F.when(k > 0, k), lambda t: F.right(t, F.lit(patterns.CONTEXT_WIDTH)))
        after = lambda k: side(k + 2, lambda t: F.left(t, F.lit(patterns.CONTEXT_WIDTH)))
        return F.transform(p, lambda x, k: F.struct(x.alias("own"), before(k).alias("before"), after(k).alias("after")))

    rows = some.select("*", F.posexplode(let(parts(F.col(text), chars, cut), rows_of)).alias("__part", "__x"))
    carried = ("__session", "__order")  # what every part needs
    columns = [F.col(c) if c in carried else F.when(F.col("__part") == 0, F.col(c)).alias(c) for c in df.columns]
    rows = rows.select(*columns, "__doc", "__part", F.col("__x.own").alias("__own"), F.col("__x.before").alias("__before"), F.col("__x.after").alias("__after"))
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    return whole.where(F.length(text).isNull() | (F.length(text) <= chars)).unionByName(rows.repartition(tasks, "__doc", "__part"))


def mask(df: DataFrame, key: str, text: str = "text", session: Column | None = None, order: list[str] | None = None, mapping: DataFrame | None = None, part_chars: int = PART_CHARS, places: bool = False, **detection) -> tuple[DataFrame, DataFrame]:
    """(df with masked, mapping of session, category, original, md5, label) over shared sessions.

    order: columns by which rows come in their session (default: the column key, then the text's hash); session: whose labels a row shares (default: one for
    all; null: that of ""). mapping: what earlier runs have labelled. Keys may be null or repeated: each row is masked by itself.
    Texts of more than part_chars characters are masked in parts, with the same result. places: the mapping has a column place, which restore heeds.
    """
    by = [F.col(c) for c in order] if order else [F.col(key), F.md5(F.col(text).cast("binary"))]
    source = df.withColumn("__session", F.coalesce(session, F.lit("")) if session is not None else F.lit("")).withColumn("__order", F.struct(*(c.alias(f"o{i}") for i, c in enumerate(by))))
    cut = None if detection.get("model") is not None else patterns.cuts(detection.get("rules", patterns.RULES), tuple(n for _, n in detection.get("custom") or ()))
    if cut and detection.get("gazetteer") is not None:  # what stands for its names: one with a stop, one with a blank
        odd = detection["gazetteer"].agg(F.max(F.col("name").rlike("[。、]")), F.max(F.col("name").rlike(r"(?U)[\s\x1c-\x1f]"))).first()
        cut = patterns.cuts(custom=("。" * bool(odd[0]), " " * bool(odd[1])))
    # read more than once: written, with a number for each row
    found = written(detect(in_parts(source, text, part_chars, cut), "__own", beside=("__before", "__after"), **detection).drop(_RAW, "__before", "__after").withColumn("__row", F.monotonically_increasing_id()), "found")
    some = found.where(F.size("__events") > 0)
    # the order of a text's events is by stage, then by place: in parts, by the part's number
    where = F.struct(F.col("__order"), F.col("__event.k").alias("__k"), F.col("__part"), F.col("__i").alias("__i"))
    events = some.select("__session", "__order", "__part", F.posexplode("__events").alias("__i", "__event")).where("__event.cat is not null")
    events = events.select(F.col("__session").alias("session"), F.col("__event.cat").alias("category"), F.col("__event.raw").alias("original"), where.alias("ord"))
    labels = label_events(events, mapping, places)
    short = labels.groupBy("session", "category", "md5").agg(F.max("label").alias("label"))
    uses = found.where(F.size("__pieces") > 0).select("__row", F.col("__session").alias("session"), F.explode("__pieces").alias("p")).select("__row", "session", F.col("p.cat").alias("category"), F.when(F.col("p.lit").isNull(), md5_8(F.col("p.raw"))).alias("md5"), F.struct("p.s", "p.e", "p.cat", "p.pre", "p.suf", "p.lit").alias("p"))
    shown = join_unique(uses, short, ["session", "category", "md5"]).groupBy("__row").agg(F.collect_list(_replacement(F.col("p"), F.col("label"))).alias("__shown"))
    joined = found.join(shown, "__row", "left")
    masked = F.when(F.col("__own").isNotNull(), spliced(F.col("__own"), F.coalesce("__shown", empty("struct<s:int,e:int,rep:string>"))))
    joined = joined.withColumn("masked", masked).select(*df.columns, "masked", "__doc", "__part")
    if cut is None:
        return joined.select(*df.columns, "masked"), labels
    # texts in parts: the parts' masked texts, joined, beside the first part's columns
    columns = F.struct(*(F.col(c) for c in df.columns))
    again = joined.where("__doc is not null").groupBy("__doc").agg(F.min_by(columns, "__part").alias("__row"), F.array_sort(F.collect_list(F.struct("__part", "masked"))).alias("__masked"))
    again = again.select("__row.*", F.array_join(F.transform("__masked", lambda x: x["masked"]), "").alias("masked"))
    return joined.where("__doc is null").select(*df.columns, "masked").unionByName(again), labels


_ADDRESS = rf"(〒|(?:{patterns._any(patterns.PREFECTURES)}))?(【住所[A-Z]+】)({patterns._any(patterns.OFFICES)})?"


def restored(text: Column, values: Column, plain: bool = False) -> Column:
    """text with its tokens replaced by values (map of token to original); unknown tokens stay.

    Address tokens come first, with the prefecture, post mark or office word beside them, which the original already
    has. plain: all tokens alike.
    """
    def address(x: Column) -> Column:
        pre, name, suf = (F.regexp_extract(x["raw"], _ADDRESS, k) for k in (1, 2, 3))
        original = F.coalesce(F.element_at(values, name), name)
        full = F.when((pre == "〒") & ~original.startswith("〒"), F.concat(F.lit("〒"), original)).otherwise(original)
        whole = F.when((suf != "") & ~full.endswith(suf), F.concat(full, suf)).otherwise(full)
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), whole.alias("rep"))

    def every(t: Column) -> Column:
        return let(t, lambda u: spliced(u, F.transform(spans(u, "【[^【】]+】", "【"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.coalesce(F.element_at(values, x["raw"]), x["raw"]).alias("rep")))))

    return every(text) if plain else every(let(text, lambda u: spliced(u, F.transform(spans(u, _ADDRESS, "【住所"), address))))


def restore(df: DataFrame, key: str, mapping: DataFrame, text: str = "masked", session: Column | None = None, plain: bool = False) -> DataFrame:
    """df with restored. mapping: session, category, original, md5, label. Only the tokens that a text holds are joined to it, and those in their originals.

    Originals that share a label, as the eight digits of their MD5 are the same, come back as the one that appeared last for the first time (as in the reference, where the last line of a token counts)
    if the mapping has their places, else as the greatest of them.
    What comes back depends on session and text alone, which is what they are joined by: key may be null or repeated, and is not needed.
    """
    source = df.withColumn("__session", F.coalesce(session, F.lit("")) if session is not None else F.lit("")).withColumn("__text", F.sha2(text, 256))
    last = F.struct(*(["place"] if "place" in mapping.columns else []), "md5", "original")
    held = mapping.groupBy("session", token(F.col("category"), F.col("label")).alias("token")).agg(F.max_by("original", last).alias("original"))
    texts = source.where(F.col(text).contains("【")).select("__text", F.col("__session").alias("session"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("【[^【】]+】"), F.lit(0)))).alias("token"))
    first = join_unique(texts.distinct(), held, ["session", "token"], "inner")
    nested = first.where(F.col("original").contains("【")).select("__text", "session", F.explode(F.array_distinct(F.regexp_extract_all("original", F.lit("【[^【】]+】"), F.lit(0)))).alias("token")).join(held, ["session", "token"])
    values = F.map_from_entries(F.collect_list(F.struct("token", "original"))).alias("__values")
    maps = first.unionByName(nested).select("__text", F.col("session").alias("__session"), "token", "original").distinct().groupBy("__text", "__session").agg(values)
    joined = source.join(maps, ["__text", "__session"], "left").drop("__text", "__session")
    nothing = F.expr("map_from_entries(cast(array() as array<struct<key:string,value:string>>))")
    return joined.withColumn("restored", F.when(F.col(text).isNotNull(), restored(F.col(text), F.coalesce("__values", nothing), plain))).drop("__values")
