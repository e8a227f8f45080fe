"""Boilerplate lines by their frequency on a site.

Pages are grouped by host.  A line's ratio is the number of the host's pages
that contain it divided by all the host's pages; lines above a ratio that stand
on at least two pages of the host are dropped from every page of that host.  The
rule is the same on hosts of every size.  All of it is DataFrame operations.

The dropped lines of a host travel as one array of line hashes.  Its length is
bounded: the ratios of a host's lines add up to its mean number of distinct
lines a page, so fewer than mean / ratio lines exceed the ratio.  The arrays are
stored before they meet the pages, so Spark knows their size: it broadcasts them
or joins by host, where adaptive execution can split the pages of a large host.
Lines of equal 64-bit hashes count as one line.

Defined cases: a NULL or empty page has no lines and an empty text; a page
without a recognisable host belongs to the host ``''``; repeated rows count as
pages of their own; on the only page of a host every line is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.llm.shared import Workspace

RATIO = 0.3
#: A line on fewer pages of its host is no boilerplate, whatever its ratio.
LEAST_PAGES = 2
#: Where a page's text breaks into lines: newlines and block-level tags.
LINE_BREAK = r"\n|</?(?:html|head|body|title|p|br|div|li|ul|ol|nav|article|header|footer|section|h[1-6]|tr|td|table|script|style)(?:[ /][^>]*)?>|<!--[^>]*-->"
TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def lines_of(html: Column) -> Column:
    """The non-empty lines of a page, without inline tags."""
    parts = F.split(F.coalesce(html, F.lit("")), LINE_BREAK, -1)
    return F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, TAG, " "))), lambda x: x != "")


def drop_boilerplate(pages: DataFrame, work: Workspace, ratio: float = RATIO,
                     id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, host, n_lines, n_dropped, text`` per page (kept lines, one a line)."""
    lined = work.table(pages.select(
        F.col(f"`{id_col}`").alias("_id"), host_of(F.col(f"`{url_col}`").cast("string")).alias("_host"),
        lines_of(F.col(f"`{html_col}`").cast("string")).alias("_lines")), "lines")
    hashes = F.transform("_lines", lambda x: F.xxhash64(x))
    # a page without lines still counts as a page of its host
    counted = (lined.select("_host", F.explode_outer(F.array_distinct(hashes)).alias("_h"))
               .groupBy("_host", "_h").agg(F.count("*").alias("_n")))
    totals = lined.groupBy("_host").agg(F.count("*").alias("_pages"))
    often = (F.col("_n") > ratio * F.col("_pages")) & (F.col("_n") >= LEAST_PAGES)
    dropped = work.table(counted.filter("_h is not null").join(totals, "_host").filter(often)
                         .groupBy("_host").agg(F.collect_list("_h").alias("_drop")), "dropped")
    # the host's lines that this page has, by a hash set; then only these are looked up
    own = lined.join(dropped, "_host", "left").withColumn("_own", F.array_intersect(hashes, "_drop"))
    kept = F.filter("_lines", lambda x: ~F.array_contains(F.col("_own"), F.xxhash64(x)))
    out = own.select("_id", "_host", "_lines", F.when(F.coalesce(F.size("_own"), F.lit(0)) <= 0, F.col("_lines")).otherwise(kept).alias("_kept"))
    return out.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.size("_lines").cast("long").alias("n_lines"),
                      (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"), F.array_join("_kept", "\n").alias("text"))


ORACLE_SQL = f"""
WITH lined AS (
  SELECT page_id, coalesce(lower(regexp_extract(url, '{HOST}', 1)), '') AS host,
         list_filter(list_transform(regexp_split_to_array(coalesce(html, ''), '{LINE_BREAK}'),
                                    lambda x: trim(regexp_replace(x, '{TAG}', ' ', 'g'))), lambda x: x <> '') AS lines
  FROM pages),
totals AS (SELECT host, count(*) AS pages FROM lined GROUP BY host),
counted AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM lined) GROUP BY host, line),
dropped AS (SELECT host, list(line) AS lines FROM counted JOIN totals USING (host) WHERE n > {RATIO} * pages AND n >= {LEAST_PAGES} GROUP BY host),
kept AS (SELECT l.page_id, l.host, l.lines, list_filter(l.lines, lambda x: NOT list_contains(coalesce(d.lines, []), x)) AS kept
         FROM lined l LEFT JOIN dropped d USING (host))
SELECT page_id, host, cast(len(lines) AS bigint) AS n_lines, cast(len(lines) - len(kept) AS bigint) AS n_dropped,
       array_to_string(kept, chr(10)) AS text
FROM kept
"""
