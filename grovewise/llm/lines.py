"""Boilerplate lines by their frequency on a site.

Pages are grouped by host. A line's ratio is the number of the host's pages that have it over all of the
host's pages; lines above the boilerplate ratio go, wherever on the site they stand. A line on
a single page is no repetition: `min_pages` is 2, so that the ratio alone decides on a host of any size.
With `distinct`, pages of equal text count once on both sides, so that a text published many times is not
boilerplate to itself; that is for tables whose copies are still to be removed.

Lines are split at line feeds, compared without spaces at their ends, and blank lines stay. Cases: NULL
or empty text stays as it is; pages without a host belong to no site and stay; a host with one page loses
nothing; repeated rows are pages of their own; a line exactly at the ratio stays; very long texts are split whole;
an empty table gives an empty result; host and text may be of any name, other columns pass through, and where
one is named n_lines or n_dropped already, the new one, always among the last two, gets a trailing _.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovewise.llm.common import fresh, name_of, one_of, stored

RATIO, MIN_PAGES = 0.1, 2
#: Boilerplate lines of all hosts are broadcast up to this number (24 bytes each).
BROADCAST_LINES = 200_000


def _hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _lines(text: Column) -> Column:
    """The hashes of a text's lines that are not blank, each once."""
    return F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda s: F.trim(s) != ""), _hash))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, distinct: bool = False) -> DataFrame:
    """(_host, _line, n_pages, n_host_pages): hashes of the lines to drop. Lines are counted before they are shuffled."""
    x = pages.where(F.col(name_of(host)).isNotNull() & F.col(name_of(text)).isNotNull())
    x = x.select(F.col(name_of(host)).alias("_host"), *([F.xxhash64(name_of(text)).alias("_text")] if distinct else []), _lines(F.col(name_of(text))).alias("_lines"))
    if distinct:
        x = stored(x.groupBy("_host", "_text").agg(F.any_value("_lines").alias("_lines")), "site-lines")
    # the pages of a host are counted with its lines, as a line without a name
    each = x.select("_host", F.explode(F.concat(F.array(F.lit(None).cast("long")), "_lines")).alias("_line"))
    per = stored(each.groupBy("_host", "_line").agg(F.count("*").alias("n_pages")).where((F.col("n_pages") >= min_pages) | F.col("_line").isNull()), "line-counts", narrow=True)
    total = per.where("_line IS NULL").select("_host", F.col("n_pages").alias("n_host_pages"))
    return per.where("_line IS NOT NULL").join(total, "_host").where(F.col("n_pages") > ratio * F.col("n_host_pages"))


def drop_boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, distinct: bool = False, broadcast: int = BROADCAST_LINES) -> DataFrame:
    """`pages` with `text` without boilerplate lines, and n_lines, n_dropped.

    Up to `broadcast` lines to drop go to every executor. Beyond, pages shuffle no text to find them: the hashes of a
    page's lines meet the lines to drop by (host, line), and what they find meets the page by the hashes of host and text."""
    one_of(pages, host, text)
    bad = stored(boilerplate(pages, host, text, ratio, min_pages, distinct).select("_host", "_line"), "boilerplate", narrow=True)
    n_lines, n_dropped, site, drop, key, every, kept = fresh(pages, "n_lines", "n_dropped", "_host", "_bad", "_key", "_all", "_kept")
    h, t = F.col(name_of(host)), F.col(name_of(text))
    if bad.count() <= broadcast:
        listed = bad.groupBy(F.col("_host").alias(site)).agg(F.collect_set("_line").alias(drop))
        x = pages.join(F.broadcast(listed), h == F.col(site), "left").drop(site)
    else:
        mine = F.struct(F.xxhash64(h), F.xxhash64(t))
        met = pages.where(h.isNotNull() & t.isNotNull()).select(mine.alias(key), h.alias("_host"), F.explode(_lines(t)).alias("_line")).join(bad, ["_host", "_line"])
        listed = met.groupBy(key).agg(F.collect_set("_line").alias(drop))
        x = pages.withColumn(key, mine).join(listed, key, "left").drop(key)
    x = x.withColumn(every, F.split(t, "\n"))
    gone = F.col(drop)
    x = x.withColumn(kept, F.when(gone.isNotNull(), F.filter(every, lambda s: (F.trim(s) == "") | ~F.array_contains(gone, _hash(s)))).otherwise(F.col(every)))
    n = lambda c: F.when(t.isNull(), 0).otherwise(F.size(c)).cast("long")
    x = x.withColumn(n_lines, n(every)).withColumn(n_dropped, n(every) - n(kept))
    rest = F.when(F.col(n_dropped) == 0, t).otherwise(F.array_join(kept, "\n"))
    return x.select(*(rest.alias(c) if c == text else F.col(name_of(c)) for c in pages.columns), n_lines, n_dropped)


#: Fixed patterns: what of a page is not text, and which tags end a line.
NO_TEXT = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BLOCK = r"(?i)</?(?:html|head|title|body|nav|header|footer|main|article|section|aside|div|p|h[1-6]|ul|ol|li|table|tr|td|th|br|hr|pre|blockquote)\b[^>]*>"
TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)"


def html_text(html: Column) -> Column:
    """A page's text, a line for each block, without blank lines; NULL for NULL."""
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, NO_TEXT, ""), BLOCK, "\n"), TAG, "")
    return F.array_join(F.filter(F.transform(F.split(x, "\n"), lambda s: F.trim(s)), lambda s: s != ""), "\n")


def host_of(url: Column) -> Column:
    """The host in lower case; NULL where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))
