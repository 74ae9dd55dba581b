"""Drop lines that recur over the pages of a site. DataFrame functions only.

For each host, the pages that contain a line are divided by the pages of the host; lines above a
ratio are boilerplate of that host and go from all its pages. A line counts once per page. Lines
are compared by a 64-bit hash after trimming; blank lines are never boilerplate and stay.

A host has at most (distinct lines per page, on average) / ratio boilerplate lines, whatever its
size, so they fit one array per host. Pages of a large host are spread over salts, and that
array is repeated once per salt; lines are counted with partial aggregation.

Hosts with fewer than ``min_pages`` pages are left alone, since a ratio says nothing there. NULL
hosts form one host, NULL texts stay NULL, repeated pages count as often as they stand. All other
columns pass through; names that begin with ``_ld_`` are reserved. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without port; NULL if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(F.length(host) > 0, host)


def html_lines(html: Column) -> Column:
    """Text of an HTML page, a line per block element.

    Scripts, styles and comments go; block tags end a line; other tags vanish.
    """
    hidden = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
    block = r"(?i)\s*</?(?:p|div|li|ul|ol|nav|article|section|header|footer|h[1-6]|br|tr|table|title|head|body|html|blockquote|pre)\b[^>]*>\s*"
    flat = F.regexp_replace(html, hidden, "")
    lined = F.regexp_replace(flat, block, "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(lined, r"<[^>]*>", ""), r"\n{2,}", "\n"), F.lit("\n"))


def _hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def line_frequencies(lines: DataFrame, min_pages: int, ratio: float, large: tuple[float, int] | None = None) -> DataFrame:
    """Boilerplate of each host (_ld_host): an array of line hashes (_ld_drop).

    With ``large`` (ratio, pages) a line goes as well if more than that ratio of the pages, and so many pages at least, have it.
    """
    pages = lines.groupBy("_ld_host").agg(F.count("*").alias("_ld_pages"))
    distinct = F.array_distinct(F.transform("_ld_lines", _hash))
    counts = (
        lines.select("_ld_host", F.explode(distinct).alias("_ld_line"))
        .groupBy("_ld_host", "_ld_line")
        .agg(F.count("*").alias("_ld_with"))
        .where(F.col("_ld_with") >= F.least(F.lit(min_pages), F.lit(2)))
    )
    often = F.col("_ld_with") > F.lit(float(ratio)) * F.col("_ld_pages")
    if large is not None:
        often |= (F.col("_ld_with") > F.lit(float(large[0])) * F.col("_ld_pages")) & (F.col("_ld_with") >= large[1])
    return (
        counts.join(pages.where(F.col("_ld_pages") >= min_pages), "_ld_host")
        .where(often)
        .groupBy("_ld_host")
        .agg(F.collect_list("_ld_line").alias("_ld_drop"))
    )


def drop_boilerplate(
    docs: DataFrame,
    host: Column,
    text: Column,
    out: str,
    ratio: float = 0.3,
    min_pages: int = 5,
    large: tuple[float, int] | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """``docs`` with column ``out`` set to ``text`` without the boilerplate lines of ``host``.

    Adds ``lines`` and ``lines_dropped`` (bigint) unless ``docs`` has such columns. Lines are counted over the rows of
    ``counted`` (host, text) where it is given, and over those of ``docs`` otherwise.
    """
    blank = F.xxhash64(F.lit(""))
    split = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.coalesce(host, F.lit("")).alias("_ld_host"),
        F.split(text, "\n").alias("_ld_lines"),
    )
    pages = split
    if counted is not None:
        pages = counted.select(F.coalesce("host", F.lit("")).alias("_ld_host"), F.split("text", "\n").alias("_ld_lines"))
    drop = line_frequencies(pages.select("_ld_host", "_ld_lines"), min_pages, ratio, large)
    salts = drop.withColumn("_ld_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = split.withColumn("_ld_salt", F.pmod(F.xxhash64("_ld_lines"), F.lit(SALTS)).cast("int"))
    joined = salted.join(salts, ["_ld_host", "_ld_salt"], "left")
    kept = F.filter(
        "_ld_lines", lambda line: (_hash(line) == blank) | ~F.array_contains(F.col("_ld_drop"), _hash(line))
    )
    kept = F.when(F.col("_ld_drop").isNull(), F.col("_ld_lines")).otherwise(kept)
    done = joined.withColumn("_ld_kept", kept)
    values = {c: F.col(f"`{c}`") for c in docs.columns}
    values.setdefault("lines", F.coalesce(F.size("_ld_lines"), F.lit(0)).cast("bigint"))
    values.setdefault("lines_dropped", (F.size("_ld_lines") - F.size("_ld_kept")).cast("bigint"))
    values[out] = F.array_join("_ld_kept", "\n")
    return done.select(*[v.alias(c) for c, v in values.items()])
