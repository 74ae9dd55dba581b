"""Registered queries of the operators on the given tables, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenprep.llm import (
    chat,
    decontaminate,
    disclosure,
    fingerprints,
    language,
    line_dedup,
    lm,
    mixing,
    near_dup,
    quality,
    runs,
    search,
    suffix_dedup,
)
from lumenprep.llm.words import WORD_PATTERN
from lumenprep.plans.session import ship_package

QUALITY = 0.3
SAID = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of every page without the lines that more than 30 % of its site's pages have."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", line_dedup.host_of(F.col("url")).alias("host"), line_dedup.html_lines(F.col("html")).alias("text")
    )
    out = line_dedup.drop_boilerplate(pages, F.col("host"), F.col("text"), "text")
    return out.select("page_id", "host", "lines", "lines_dropped", "text")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labelled = language.label_language(docs.select("doc_id", "text"), language.fit_language(docs))
    held_out = quality.remainder(F.col("doc_id"), 5) == 0
    return labelled.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op6_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_copies(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (quality.remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= QUALITY).cast("int").alias("predicted"),
    )


def op8_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.find_contamination(docs, items).drop("text_hash")


def conversation_events(rows: DataFrame) -> DataFrame:
    """A delta per row; rows that share a turn stay separate messages, by role and text."""
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    return rows.select(
        "conv_id",
        F.col("turn").alias("seq"),
        F.struct(F.col("turn"), F.row_number().over(same).alias("n")).alias("message"),
        F.lit("delta").alias("kind"),
        "role",
        "text",
    )


def op9_format_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", SAID), (-7, 1, "assistant", SAID)], rows.schema)
    formatted = chat.format_conversations(conversation_events(rows.unionByName(extra)))
    back = chat.read_back(formatted)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text; a tenth of the texts, by crc32 of the id, repeat a stretch of words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD_PATTERN), F.lit(0))

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), 1, n - a)
        return F.array_join(F.concat(F.slice(w, 1, a), tail), " ")

    # An array of one, so that the words are found once.
    edited = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise("")), 1)
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), edited).otherwise(F.col("text")).alias("text"))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.find_runs(with_periods(table(spark, sf_dir, "documents")))
    found = F.col("runs")
    listed = F.transform(found, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    # a/b > c/d compared as a*d > c*b; the list is in the order that ties ask for
    best = F.aggregate(
        found,
        found[0],
        lambda kept, r: F.when(r["length"] * kept["period"] > kept["length"] * r["period"], r).otherwise(kept),
    )
    best = F.when(F.size(found) > 0, best)
    return out.select(
        "doc_id",
        F.size(found).cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(listed, "\n"), F.when(F.size(found) > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = disclosure.sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("pii_spans")

    def number(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def listed(found: Column) -> Column:
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return out.select(
        "doc_id",
        *[number(k) for k in disclosure.KINDS],
        F.sha2(listed(F.filter(spans, lambda s: s["kind"] != disclosure.TERM)), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
    )


def shipped(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query after this package has been sent to the executors."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return function(spark, sf_dir)

    return run


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": shipped(op1_mix_sources),
    "op2_fingerprints": shipped(op2_fingerprints),
    "op3_line_dedup": shipped(op3_line_dedup),
    "op4_language": shipped(op4_language),
    "op5_lm_scoring": shipped(op5_lm_scoring),
    "op6_near_copies": shipped(op6_near_copies),
    "op7_quality": shipped(op7_quality),
    "op8_contamination": shipped(op8_contamination),
    "op9_format_conversations": shipped(op9_format_conversations),
    "op10_repeats": shipped(op10_repeats),
    "op11_word_runs": shipped(op11_word_runs),
    "op12_ranked_search": shipped(op12_ranked_search),
    "op13_personal_data": shipped(op13_personal_data),
}

_ESCAPES = [(chat.SIGN, chat.SIGN + chat.SELF), *[(c, chat.SIGN + k) for c, k in zip(chat.CONTROLS, chat.CODES)]]


def _escaped(column: str, newline: bool) -> str:
    out = column
    for old, new in [*_ESCAPES, *[("\n", chat.SIGN + chat.NEWLINE)] * newline]:
        quoted = "chr(10)" if old == "\n" else f"'{old}'"
        out = f"replace({out}, {quoted}, '{new}')"
    return out


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || md5('42:' || doc_id || ':mix')[1:13])::BIGINT AS k
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3.0::DOUBLE * source_size AS cap FROM src),
lev AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM w),
t AS (
  SELECT source, source_size,
    least(cap, coalesce(max(CASE WHEN level * weight <= cap THEN level END) OVER (), 0) * weight) AS target
  FROM lev),
p AS (
  SELECT doc_id, size, source_size, target, floor(target + 0.5)::BIGINT AS budget,
    coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized JOIN t USING (source))
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
   + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken
FROM p
"""

OP9_SQL = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{SAID}' UNION ALL SELECT -7, 1, 'assistant', '{SAID}')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('{chat.START}') + length({_escaped('role', True)}) + 1 + length({_escaped('text', False)}) + length('{chat.END}') + 1)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""

OP3_SQL = r"""
WITH p AS (
  SELECT page_id,
    nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g'),
      '(?i)\s*</?(?:p|div|li|ul|ol|nav|article|section|header|footer|h[1-6]|br|tr|table|title|head|body|html|blockquote|pre)\b[^>]*>\s*', chr(10), 'g'),
      '<[^>]*>', '', 'g'), '\n{2,}', chr(10), 'g'), chr(10)) AS text
  FROM pages),
l AS (SELECT page_id, coalesce(host, '') AS h, host, string_split(text, chr(10)) AS ls FROM p),
n AS (SELECT h, count(*) AS n FROM l GROUP BY h),
c AS (
  SELECT h, line, count(*) AS c FROM (SELECT DISTINCT page_id, h, unnest(list_transform(ls, lambda x: trim(x))) AS line FROM l) GROUP BY ALL),
b AS (SELECT h, list(line) AS drops FROM c JOIN n USING (h) WHERE n >= 5 AND c >= 2 AND c > 0.3::DOUBLE * n AND line <> '' GROUP BY h)
SELECT page_id, host, len(ls)::BIGINT AS lines, (len(ls) - len(kept))::BIGINT AS lines_dropped, array_to_string(kept, chr(10)) AS text
FROM (SELECT *, CASE WHEN drops IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(drops, trim(x))) END AS kept
      FROM l LEFT JOIN b USING (h))
""".replace("\\\\", "\\")

OP12_SQL = r"""
WITH found AS (
  SELECT doc_id, row_number() OVER () AS doc, text FROM documents),
dt AS (
  SELECT doc, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM found),
it AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
sizes AS (SELECT doc, count(*) AS n FROM dt GROUP BY doc),
s AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM sizes),
tf AS (SELECT doc, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM dt SEMI JOIN it USING (term) GROUP BY doc, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, s),
m AS (SELECT doc, 100 - 50 + (50 * n * nd) // nt AS m FROM sizes, s),
scored AS (
  SELECT item_id, doc, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM it JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc) GROUP BY item_id, doc)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 50
""".replace("\\\\", "\\")

LLM_ORACLES: dict[str, str] = {
    "op1_mix_sources": OP1_SQL,
    "op3_line_dedup": OP3_SQL,
    "op9_format_conversations": OP9_SQL,
    "op12_ranked_search": OP12_SQL,
}
