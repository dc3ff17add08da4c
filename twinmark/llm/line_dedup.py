"""Operator 10: boilerplate lines by their frequency within a site, in DataFrame functions only.

Pages become lines; each page counts a line once; a line's count is divided by the number of its host's
pages, and lines above a ratio go. Lines travel as 64-bit hashes and are counted on the map side first, so
neither a hot host nor a hot line meets in one task. At most (lines a page) / ratio lines of a host can
exceed the ratio, which bounds the set that goes back to its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, table
from .url_filters import host_of

#: Bytes of boilerplate sets that may be broadcast; larger ones are joined by shuffle.
MAX_BROADCAST_BYTES = 8 << 20

# Patterns that turn HTML into lines, in this order: what to remove whole, what ends a line, other tags.
HIDDEN = (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->")
BREAKS = r"(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
TAGS = r"<[^>]*>"


def html_lines(html: Column) -> Column:
    """Array of the trimmed, non-empty text lines of a page."""
    text = html
    for pattern in HIDDEN:
        text = F.regexp_replace(text, pattern, "")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAGS, "")
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def site_line_dedup(pages: DataFrame, lines: Column, host: Column, max_ratio: float = 0.3, min_pages: int = 5, max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Add to each page host, lines, kept_lines: lines whose share of the host's pages is at most max_ratio stay.

    A line must be on at least min_pages pages of the host to go, so small sites keep all they have; its
    repeats within a page go or stay together. Null html or urls count as empty: no lines, host "". Repeated rows are
    pages of their own. An empty table gives no rows. All columns of pages are in the struct column "page", so
    no name can clash.
    """
    own = pages.select(F.struct("*").alias("page"), host.alias("host"), lines.alias("lines"))
    hashed = F.transform("lines", lambda x: F.xxhash64(x))
    # the null line counts the pages
    seen = pages.select(host.alias("host"), lines.alias("lines")).select("host", F.explode(F.concat(F.array_distinct(hashed), F.array(F.lit(None).cast("long")))).alias("line"))
    counts = materialize(seen.groupBy("host", "line").agg(F.count("*").alias("n")).filter((F.col("n") >= min_pages) | F.col("line").isNull()), "line_counts")
    totals = counts.filter(F.col("line").isNull()).select("host", F.col("n").alias("total"))
    often = counts.filter(F.col("line").isNotNull()).join(totals, "host").filter(F.col("n") > max_ratio * F.col("total"))
    sets = materialize(often.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("boilerplate")), "boilerplate")
    size = sets.agg(F.sum(F.size("boilerplate") * 8 + F.octet_length("host") + 64)).first()[0] or 0
    joined = own.join(F.broadcast(sets) if size <= max_broadcast else sets, "host", "left")
    kept = F.when(F.col("boilerplate").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("boilerplate", F.xxhash64(x))))
    return joined.select("page", "host", "lines", kept.alias("kept_lines"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, n_lines, n_dropped, kept_sha256 (of the kept lines joined by newlines)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = site_line_dedup(pages, html_lines(F.col("html")), host_of(F.col("url")))
    return out.select(
        F.col("page.page_id").alias("page_id"), "host", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept_lines")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("kept_lines", "\n"), 256).alias("kept_sha256"),
    )


OP10_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    list_filter(list_transform(string_split(coalesce(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'),
      '(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>', chr(10), 'g'),
      '<[^>]*>', '', 'g'), ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
  FROM pages),
t AS (SELECT host, count(*) AS total FROM p GROUP BY 1),
c AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY 1, 2),
b AS (SELECT host, list(line) AS boilerplate FROM c JOIN t USING (host) WHERE n >= 5 AND n > 0.3 * total GROUP BY 1),
k AS (SELECT page_id, host, lines, CASE WHEN boilerplate IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(boilerplate, x)) END AS kept
      FROM p LEFT JOIN b USING (host))
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
  sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256
FROM k
"""
