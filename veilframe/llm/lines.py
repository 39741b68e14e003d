"""Line dedup by site-relative frequency.

For each site, the pages that contain a line are divided by all pages of the site. Lines
above a ratio are boilerplate of that site and are dropped from its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import packed

RATIO = 0.05
"""Lines on a larger share of a site's pages are boilerplate."""

MIN_PAGES = 2
"""A line on one page only is no boilerplate, however small the site is."""


def line_key(line: Column) -> Column:
    """128 bits for a line without its outer white space; null for a blank line."""
    bare = F.trim(F.regexp_replace(line, r"\s+", " "))
    return F.when(bare != "", F.md5(bare.cast("binary")))


def boilerplate(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """site, line, n_pages, ratio of the lines to drop, for `pages` (site, keys).

    Pages are counted per site and line before anything is shuffled; then few lines are left.
    """
    lines = pages.select("site", F.explode(F.array_distinct("keys")).alias("line")).where("line is not null")
    counts = lines.groupBy("site", "line").agg(F.count(F.lit(1)).alias("n_pages"))
    totals = pages.groupBy("site").agg(F.count(F.lit(1)).alias("all_pages"))
    often = counts.where(F.col("n_pages") >= min_pages).alias("c")
    met = often.join(totals.alias("t"), F.col("c.site").eqNullSafe(F.col("t.site")))
    share = F.col("n_pages") / F.col("all_pages")
    return met.select("c.site", "line", "n_pages", share.alias("ratio")).where(F.col("ratio") > ratio)


def drop_boilerplate(
    df: DataFrame,
    site: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    length: str | None = None,
    counts: bool = True,
) -> DataFrame:
    """`df` with the boilerplate lines of each row's site taken out of its text.

    Each row is a page; repeated rows count, and are cleaned, each. Null sites form one
    site. Lines are compared without outer and repeated white space; blank lines stay.
    Null texts stay null. With `counts`, n_lines and n_dropped are added (null text: 0);
    columns with these names are replaced. `length` names a column to set to the new
    length. Only pages with a dropped line get one; an empty table gives an empty result.

    The texts are shuffled once, by content and site, to meet the places of their dropped
    lines, of which there are as many as lines in the text.
    """
    keys = F.transform(F.split(F.col(text), "\n"), line_key)
    pages = df.select(F.col(site).alias("site"), F.col(text).alias("text"), keys.alias("keys"))
    drop = boilerplate(pages.select("site", "keys"), ratio, min_pages)
    content = F.md5(F.concat_ws("\x00", F.coalesce("site", F.lit("")), F.col("site").isNull(), "text"))
    placed = pages.select("site", content.alias("key"), F.posexplode("keys").alias("at", "line"))
    hit = placed.alias("p").join(
        drop.alias("d"),
        (F.col("p.line") == F.col("d.line")) & F.col("p.site").eqNullSafe(F.col("d.site")),
        "left_semi",
    )
    dropped = hit.groupBy("key").agg(F.collect_set("at").alias("gone"))
    own = F.md5(
        F.concat_ws("\x00", F.coalesce(F.col(site), F.lit("")), F.col(site).isNull(), F.col(text))
    )
    rows = packed(df, _key=own).join(dropped, F.col("_key") == F.col("key"), "left")
    old = F.col("_row")[text]
    lines = F.split(old, "\n")
    left = F.filter(lines, lambda _, i: ~F.array_contains(F.col("gone"), i))
    new = F.when(F.col("gone").isNull(), old).otherwise(F.array_join(left, "\n"))
    extra = ("n_lines", "n_dropped") if counts else ()
    values = {text: new} | ({length: F.length(new).cast("long")} if length else {})
    return rows.select(
        *[values.get(c, F.col("_row")[c]).alias(c) for c in df.columns if c not in extra],
        *[
            c.alias(n)
            for n, c in (
                ("n_lines", F.coalesce(F.when(old.isNotNull(), F.size(lines)), F.lit(0))),
                ("n_dropped", F.coalesce(F.size(F.coalesce("gone", F.array().cast("array<int>"))), F.lit(0))),
            )
            if n in extra
        ],
    )
