"""The engine's own queries over the test tables, and their SQL equivalents."""

from __future__ import annotations

import datetime
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions import crowds, patterns, text
from inkveil.functions.tables import LONG_ROWS, ROWS, spread
from inkveil.operators import dates, entities, masking
from inkveil.sources import mappings

TODAY = datetime.date(2026, 1, 1)
_RULES = {r.name: r for r in patterns.RULES}
MAIL = _RULES["mail"]


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns), LONG_ROWS if name in ("documents", "pages") else ROWS)


def mail_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "documents", "doc_id", "text").withColumn("x", F.explode(text.spans(F.coalesce("text", F.lit("")), patterns.java(MAIL.pattern), "@")))
    return found.select("doc_id", F.col("x.s").cast("long").alias("s"), F.col("x.e").cast("long").alias("e"), "x.raw")


def mask_mail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    return masking.mask_rows(masking.detect(docs, rules=(MAIL,), only_rules=True)).select("doc_id", "masked")


def _mail_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return masking.mask(_table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", rules=(MAIL,), only_rules=True)


def mask_mail_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mail_corpus(spark, sf_dir)[0].select("doc_id", "masked")


def mail_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mail_corpus(spark, sf_dir)[1].select("category", "original", "md5", "label")


def restore_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked, mapping = _mail_corpus(spark, sf_dir)
    return masking.restore(masked.drop("text"), "doc_id", mapping).select("doc_id", "restored")


def mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors, one session for all documents."""
    return masking.mask(_table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", today=TODAY)[0].select("doc_id", "masked")


def mask_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors, a session for each conversation."""
    turns = _table(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    return masking.mask(turns, "id", session=F.col("conv_id").cast("string"), order=["turn"], today=TODAY)[0].select("conv_id", "turn", "masked")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", text.label(F.col("o_orderkey") % 20000).alias("label"))


def escaped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", mappings.escaped(F.col("text")).alias("escaped"))


def chosen_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail addresses first, then numbers that overlap none of them."""
    col = F.coalesce("text", F.lit(""))
    kept = crowds.accepted(_table(spark, sf_dir, "documents", "doc_id", "text"), col, [(patterns.java(MAIL.pattern), "@"), ("[0-9]+", None)], "k")
    return kept.select("doc_id", F.size("k").cast("long").alias("n"), F.aggregate("k", F.lit(0).cast("long"), lambda a, x: a + x["s"]).alias("starts"))


def html_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text between tags, without scripts and styles."""
    shown = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>", "%%SKIP%%")
    nodes = F.regexp_extract_all(shown, F.lit(">([^<]+)<"), F.lit(1))
    return _table(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.posexplode(nodes).alias("n", "node")).select("page_id", F.col("n").cast("long").alias("n"), "node")


#: A rule on sentences made of a table's columns: rule, table, key, the sentence in SQL, the masked one in DuckDB's SQL.
_MADE = (
    ("phone", "customer", "c_custkey", "concat('電話は03-', lpad(cast(c_custkey % 10000 as string), 4, '0'), '-5678です')", "'電話は【電話A】です'"),
    ("amount", "orders", "o_orderkey", "concat('金額', cast(o_orderkey as string), '万円、以上')", "'金額【金額A】万円、以上'"),
    ("iso_date", "orders", "o_orderkey", "concat('注文日', date_format(o_orderdate, 'yyyy-MM-dd'), '、確認')", "'注文日【日付A】、確認'"),
    ("age", "customer", "c_custkey", "concat('年齢', cast(c_custkey % 120 as string), '歳')", "CASE WHEN c_custkey % 120 < 100 THEN '年齢' || (c_custkey % 120 // 10 * 10) || '代' ELSE '年齢' || (c_custkey % 120) || '歳' END"),
    ("postal", "customer", "c_custkey", "concat('〒160-', lpad(cast(c_custkey % 10000 as string), 4, '0'), ' 以上')", "'〒【住所A】 以上'"),
    ("prefecture", "customer", "c_custkey", "concat('東京都千代田区', cast(c_custkey as string), '番地。')", "'東京都【住所A】。'"),
    ("branch", "customer", "c_custkey", "concat(cast(c_custkey as string), '大阪支店')", "c_custkey || '【住所A】支店'"),
    ("social", "customer", "c_custkey", "concat('連絡 @user', cast(c_custkey as string), ' まで')", "'連絡 【SNSA】 まで'"),
    ("patent", "part", "p_partkey", "concat('特許第', cast(p_partkey as string), '号')", "'特許第【特許A】号'"),
    ("serial", "part", "p_partkey", "concat('製造番号：', lpad(cast(p_partkey as string), 8, '0'), '。')", "'【シリアルA】。'"),
    ("model", "part", "p_partkey", "concat('型番：ABC-', lpad(cast(p_partkey as string), 5, '0'), '。')", "'【型番A】。'"),
    ("quantity", "part", "p_partkey", "concat('重量', cast(p_size as string), 'kg')", "'重量【数値A】kg'"),
    ("period", "part", "p_partkey", "concat('期間', cast(p_size as string), '週間')", "'期間【数値A】週間'"),
    ("days", "part", "p_partkey", "concat('納期', cast(p_size as string), '日以内')", "'納期【数値A】日以内'"),
    ("era_date", "part", "p_partkey", "concat('令和', cast(p_size as string), '年4月1日')", "'【日付A】'"),
    ("full_date", "orders", "o_orderkey", "concat(date_format(o_orderdate, 'yyyy'), '年', cast(month(o_orderdate) as string), '月')", "'【日付A】'"),
    ("month_day", "orders", "o_orderkey", "concat('締切', cast(month(o_orderdate) as string), '月1日')", "'締切【日付A】'"),
    ("city", "customer", "c_custkey", "concat('、横浜市港', cast(c_custkey as string), '。')", "'、【住所A】。'"),
    ("building", "customer", "c_custkey", "concat('、丸の内ビル', cast(c_custkey % 50 + 1 as string), '階、')", "'、【住所A】、'"),
)


def _made(spark: SparkSession, sf_dir: str, rule: str, table: str, key: str, sentence: str) -> DataFrame:
    rows = spread(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key, F.expr(sentence).alias("text")))
    return masking.mask_rows(masking.detect(rows, rules=(_RULES[rule],), only_rules=True)).select(key, "masked")


def _sentence() -> Column:
    return F.concat(F.lit("田中太郎部長は"), F.date_format("o_orderdate", "yyyy年M月d日"), F.lit("に株式会社"), F.col("o_orderkey").cast("string"), F.lit("商事へ、納期"), F.date_format("o_orderdate", "M/d"))


def made_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", _sentence().alias("t"))
    rows = rows.withColumn("c", dates.date_candidates(F.col("t"))).withColumn("v", dates.valid_dates(F.col("c"), TODAY))
    return rows.select("o_orderkey", F.array_join(F.transform(dates.chosen_dates(F.col("c"), F.col("v")), lambda x: x["raw"]), "|").alias("dates"))


def made_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", _sentence().alias("t"))
    return rows.select("o_orderkey", F.array_join(F.transform(entities.entities(F.col("t")), lambda x: F.concat(x["cat"], F.lit(":"), x["raw"])), "|").alias("names"))


QUERIES = {
    "mail_spans": mail_spans, "mask_mail_rows": mask_mail_rows, "mask_mail_corpus": mask_mail_corpus, "mail_mapping": mail_mapping, "restore_mail": restore_mail, "mask_documents": mask_documents,
    "mask_conversations": mask_conversations, "labels": labels, "escaped_texts": escaped_texts, "chosen_spans": chosen_spans, "html_nodes": html_nodes, "made_dates": made_dates, "made_names": made_names,
} | {f"rule_{rule}": partial(_made, rule=rule, table=table, key=key, sentence=sentence) for rule, table, key, sentence, _ in _MADE}

_P = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
_LABEL = "CASE WHEN {0} < 26 THEN chr((65 + {0})::INT) WHEN {0} < 702 THEN chr((65 + ({0} - 26) // 26)::INT) || chr((65 + ({0} - 26) % 26)::INT) ELSE chr((65 + ({0} - 702) // 676)::INT) || chr((65 + ({0} - 702) // 26 % 26)::INT) || chr((65 + ({0} - 702) % 26)::INT) END"
_FOUND = f"""m AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '{_P}') AS ms, string_split_regex(coalesce(text, ''), '{_P}') AS gs FROM documents),
u AS (SELECT doc_id, ms, gs, unnest(ms) AS raw, unnest(range(1, len(ms) + 1)) AS i FROM m)"""
_AT = "list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)"


def _masked(partition: str, order: str) -> str:
    key = "doc_id, raw" if partition else "raw"
    return f"""WITH {_FOUND},
f AS (SELECT {key}, min(struct_pack(d := doc_id, i := i)) AS first FROM u GROUP BY ALL),
l AS (SELECT {key}, row_number() OVER ({partition} ORDER BY first) - 1 AS k FROM f),
r AS (SELECT u.doc_id, string_agg('【メール' || {_LABEL.format("k")} || '】' || gs[i + 1], '' ORDER BY i) AS tail FROM u JOIN l USING ({key}) GROUP BY u.doc_id)
SELECT m.doc_id, CASE WHEN text IS NOT NULL THEN coalesce(gs[1] || tail, text) END AS masked FROM m LEFT JOIN r USING (doc_id)"""


SQL = {
    "mail_spans": f"WITH {_FOUND} SELECT doc_id, ({_AT})::BIGINT AS s, ({_AT} + length(raw))::BIGINT AS e, raw FROM u",
    "mask_mail_rows": _masked("PARTITION BY doc_id", ""),
    "mask_mail_corpus": _masked("", ""),
    "mail_mapping": f"""WITH {_FOUND}, f AS (SELECT raw, min(struct_pack(d := doc_id, i := i)) AS first FROM u GROUP BY raw), l AS (SELECT raw, row_number() OVER (ORDER BY first) - 1 AS k FROM f)
SELECT 'メール' AS category, raw AS original, upper(left(md5(raw), 8)) AS md5, {_LABEL.format("k")} AS label FROM l""",
    "restore_mail": "SELECT doc_id, text AS restored FROM documents",
    "labels": f"SELECT o_orderkey, {_LABEL.format('(o_orderkey % 20000)').replace('ELSE chr', 'WHEN (o_orderkey % 20000) < 18278 THEN chr').replace(' END', chr(32))} ELSE 'A' || chr((65 + ((o_orderkey % 20000) - 18278) // 676 % 26)::INT) || chr((65 + ((o_orderkey % 20000) - 18278) // 26 % 26)::INT) || chr((65 + ((o_orderkey % 20000) - 18278) % 26)::INT) END AS label FROM orders",
    "escaped_texts": r"SELECT doc_id, replace(replace(replace(replace(text, '\', '\\'), chr(9), '\t'), chr(10), '\n'), chr(13), '\r') AS escaped FROM documents",
    "chosen_spans": f"""WITH {_FOUND}, s AS (SELECT doc_id, 0 AS o, i, {_AT} AS s, {_AT} + length(raw) AS e FROM u),
m2 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[0-9]+') AS ms, string_split_regex(coalesce(text, ''), '[0-9]+') AS gs FROM documents),
u2 AS (SELECT doc_id, ms, gs, unnest(ms) AS raw, unnest(range(1, len(ms) + 1)) AS i FROM m2),
s2 AS (SELECT doc_id, 1 AS o, i, {_AT} AS s, {_AT} + length(raw) AS e FROM u2),
c AS (SELECT * FROM s UNION ALL SELECT * FROM s2 WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = s2.doc_id AND s.s < s2.e AND s2.s < s.e))
SELECT d.doc_id, count(c.s)::BIGINT AS n, coalesce(sum(c.s), 0)::BIGINT AS starts FROM documents d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id""",
    "html_nodes": """WITH s AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '%%SKIP%%', 'g'), '(?is)<style[^>]*>.*?</style>', '%%SKIP%%', 'g') AS h FROM pages),
n AS (SELECT page_id, regexp_extract_all(h, '>([^<]+)<', 1) AS nodes FROM s)
SELECT page_id, unnest(range(0, len(nodes)))::BIGINT AS n, unnest(nodes) AS node FROM n""",
    # in a common year, the 29th of February alone is no date
    "made_dates": """SELECT o_orderkey, year(o_orderdate) || '年' || month(o_orderdate) || '月' || day(o_orderdate) || '日'
|| CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN '' ELSE '|' || month(o_orderdate) || '/' || day(o_orderdate) END AS dates FROM orders""",
    "made_names": "SELECT o_orderkey, '人物:田中太郎|組織:株式会社' || o_orderkey || '商事' AS names FROM orders",
} | {f"rule_{rule}": f"SELECT {key}, {masked} AS masked FROM {table}" for rule, table, key, _, masked in _MADE}
