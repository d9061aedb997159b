"""Line dedup by site-relative frequency.

For each host the number of pages that hold a line is divided by the number of pages of the host; a line is
boilerplate there where that ratio exceeds ``ratio`` and at least ``least_pages`` pages hold it.  Boilerplate lines
go from every page of the host; the other lines stay in order.

Lines are distinct within a page before they are counted, and counted by partial sums, so a line that a third of all
pages hold costs a row for each task.  A host has at most (mean lines of a page / ratio) boilerplate lines, so its
list of their hashes is bounded whatever the number of pages; it is joined to the pages of the host as one array.

Defined results: white space around a line doesn't count for equality, and lines without any other character are
never boilerplate; a null text stays null; null hosts are one host of their own; a page whose lines all go keeps an
empty text; repeated rows are pages of their own; texts of any length are read whole; an empty table gives an empty result; further
columns pass through, whatever their names; a column that has the name of a count is an error that says so.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodevein.llm.common import settle

RATIO = 0.05
LEAST_PAGES = 3


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\f\r"))


def _key(trimmed: Column) -> Column:
    return F.unhex(F.md5(trimmed.cast("binary")))


def line_key(line: Column) -> Column:
    """128 bits that stand for the trimmed line."""
    return _key(_trimmed(line))


def _blank() -> Column:
    return line_key(F.lit(""))


def boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, bad: array of line keys, from pages(host, keys: array of the keys of a page's lines, each once)."""
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    held = (
        pages.select("host", F.explode("keys").alias("key"))
        .groupBy("host", "key")
        .agg(F.count("*").alias("n"))
        .filter((F.col("n") >= least_pages) & (F.col("key") != _blank()))
    )
    over = held.join(totals, held["host"].eqNullSafe(totals["host"])).filter(F.col("n") > F.col("pages") * ratio)
    return over.groupBy(held["host"]).agg(F.collect_set("key").alias("bad"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def dedup_lines(docs: DataFrame, host: Column, text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, counts: tuple[str, str] | None = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with boilerplate lines gone from column ``text``, and beside it two columns of ``counts``: lines, and lines that went."""
    if clash := {c.lower() for c in docs.columns} & {c.lower() for c in counts or ()}:
        raise ValueError(f"docs have columns {sorted(clash)} already; name others in counts, or none")
    keys = F.transform(F.array_distinct(F.transform(_lines(F.col(text)), _trimmed)), _key)
    bad = settle(boilerplate(docs.select(host.alias("host"), F.coalesce(keys, F.array().cast("array<binary>")).alias("keys")), ratio, least_pages))
    # Names of this call's own, so that no column of the documents can clash.
    at, gone, rest = (f"{c}_{uuid.uuid4().hex}" for c in ("host", "bad", "rest"))
    bad = bad.select(F.col("host").alias(at), F.col("bad").alias(gone))
    # The optimizer knows the size of the settled lists: it broadcasts them where they are small and splits hot hosts where not.
    joined = docs.join(bad, host.eqNullSafe(F.col(at)), "left")
    lines = _lines(docs[text])
    # A column of its own, so that lines are looked up once; null where nothing goes.
    joined = joined.withColumn(rest, F.when(F.col(gone).isNotNull(), F.filter(lines, lambda line: ~F.array_contains(F.col(gone), line_key(line)))))
    own = [F.when(F.col(rest).isNull(), docs[text]).otherwise(F.array_join(rest, "\n")).alias(text) if c == text else docs[f"`{c}`"] for c in docs.columns]
    if counts is None:
        return joined.select(*own)
    return joined.select(
        *own,
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(counts[0]),
        F.when(F.col(rest).isNull(), 0).otherwise(F.size(lines) - F.size(rest)).cast("long").alias(counts[1]),
    )


#: Elements that end a line of text, and elements whose content is no text.
BLOCKS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul"
HIDDEN = ("script", "style")


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; empty where there is none."""
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^:/?#]*)", 1)


def html_lines(html: Column) -> Column:
    """Text of a page: a line for each block element; no comments, scripts, styles or tags."""
    for h in HIDDEN:
        html = F.regexp_replace(html, rf"(?is)<{h}[^>]*>.*?</{h}>", "")
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    html = F.regexp_replace(html, rf"(?i)</?(?:{BLOCKS})(?:[ /][^>]*+)?>", "\n")
    html = F.regexp_replace(html, r"<[^>]*+>", "")
    return F.regexp_replace(html, r"[\x20\x09\x0B-\x0D]*+\n[\x20\x09-\x0D]*+", "\n")


def dedup_pages(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, host, text, n_lines, n_dropped for every page(page_id, url, html)."""
    texts = settle(pages.select("page_id", host_of(F.col("url")).alias("host"), html_lines(F.col("html")).alias("text")))
    return dedup_lines(texts, F.col("host"), "text", ratio, least_pages)


_TRIM = r"regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"


def lines_sql(docs: str, key: str, host: str, ratio: float, least_pages: int) -> str:
    """DuckDB: {key}, host, text, n_lines, n_dropped of the relation ``docs`` with ``host`` and text."""
    return rf"""
WITH docs AS ({docs}), lines AS (
  SELECT rid, host, l, i, {_TRIM} AS t FROM (SELECT rid, host, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs WHERE text IS NOT NULL)
), totals AS (SELECT host, count(*) AS pages FROM docs GROUP BY host
), bad AS (
  SELECT h.host, h.t FROM (SELECT host, t, count(DISTINCT rid) AS n FROM lines WHERE t <> '' GROUP BY host, t) h JOIN totals p ON h.host IS NOT DISTINCT FROM p.host
  WHERE h.n >= {least_pages} AND h.n > p.pages * {ratio}::DOUBLE
), marked AS (
  SELECT l.*, b.t IS NOT NULL AS gone FROM lines l LEFT JOIN bad b ON l.host IS NOT DISTINCT FROM b.host AND l.t = b.t
), made AS (
  SELECT rid, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped FROM marked GROUP BY rid
)
SELECT {key}, d.host, m.text, coalesce(m.n_lines, 0)::BIGINT AS n_lines, coalesce(m.n_dropped, 0)::BIGINT AS n_dropped FROM docs d LEFT JOIN made m USING (rid)"""


_TEXT = "html"
for _h in HIDDEN:
    _TEXT = f"regexp_replace({_TEXT}, '(?is)<{_h}[^>]*>.*?</{_h}>', '', 'g')"
_TEXT = f"regexp_replace({_TEXT}, '(?s)<!--.*?-->', '', 'g')"
_TEXT = rf"regexp_replace({_TEXT}, '(?i)\n|</?(?:{BLOCKS})(?:[ /][^>]*)?>', chr(10), 'g')"
_TEXT = f"regexp_replace({_TEXT}, '<[^>]*>', '', 'g')"
_TEXT = rf"regexp_replace({_TEXT}, '[\x20\x09\x0B-\x0D]*\n[\x20\x09-\x0D]*', chr(10), 'g')"
_HOST = r"regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^:/?#]*)', 1)"

#: The same for pages, for DuckDB.
PAGES_SQL = lines_sql(f"SELECT row_number() OVER () AS rid, page_id, {_HOST} AS host, {_TEXT} AS text FROM pages", "d.page_id", "host", RATIO, LEAST_PAGES)
