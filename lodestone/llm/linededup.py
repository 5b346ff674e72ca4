"""Boilerplate lines by their frequency within a site."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import saved

#: A line is boilerplate on a site if more than this share of the site's pages contain it ...
RATIO = 0.1
#: ... and at least so many pages do.
MIN_PAGES = 3
#: Boilerplate lines of all sites together that are broadcast at most.
BROADCAST_LINES = 200_000
_BLANKS = " \t\r"


def _key(line: Column) -> Column:
    return F.unhex(F.md5(F.btrim(line, F.lit(_BLANKS)).cast("binary")))


def _bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x evaluated once however often it is used."""
    return F.transform(F.array(x), use)[0]


def boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, pages, keys): for each site with boilerplate, the 128-bit keys of its lines.

    A page counts a line once. Lines are counted map-side first and as keys,
    so neither a hot site nor a hot line meets in one task, and a line
    repeated on every page costs a row a task.
    """
    pages = docs.groupBy(F.col(site_col).alias("site")).agg(F.count("*").alias("pages"))
    lines = F.array_distinct(F.transform(F.split(text_col, "\n", -1), _key))
    counted = docs.select(F.col(site_col).alias("site"), F.explode(lines).alias("key")).groupBy("site", "key").agg(F.count("*").alias("n"))
    often = counted.where((F.col("n") >= min_pages) & (F.col("key") != F.unhex(F.md5(F.lit("").cast("binary")))))
    rate = often.alias("o").join(pages.alias("p"), F.col("o.site").eqNullSafe(F.col("p.site"))).where(F.col("n") > F.col("pages") * F.lit(float(ratio)))
    return rate.groupBy(F.col("o.site").alias("site"), "pages").agg(F.sort_array(F.collect_set("key")).alias("keys"))


def drop_boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = False) -> DataFrame:
    """docs with each site's boilerplate lines removed from the text; all rows and columns stay.

    Lines end at \\n and compare without outer blanks; blank lines stay. Null
    texts stay null, a text of boilerplate alone becomes empty, rows without
    site form a site, repeated rows count as pages of their own. With
    `counts`, columns _lines (not blank) and _dropped are added. Empty tables
    give empty results.

    The lists are broadcast if counted to be short; otherwise sites meet their
    pages in a shuffled join whose large sites are salted, without regrouping
    lines into pages.
    """
    lists = saved(boilerplate(docs, site_col, text_col, ratio, min_pages), "boilerplate")
    size, most = lists.agg(F.sum(F.size("keys")), F.max("pages")).first()
    lists = lists.select(F.col("site").alias("__lodestone_site"), F.col("keys").alias("__lodestone_keys"))
    same = F.col(site_col).eqNullSafe(F.col("__lodestone_site"))
    if (size or 0) <= BROADCAST_LINES:
        joined = docs.join(F.broadcast(lists), same, "left")
    else:
        salts = -(-most // 20_000)
        salted = lists.withColumn("__lodestone_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        # By place, not by text: the copies of a text are spread too.
        spread = docs.withColumn("__lodestone_at", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
        joined = spread.join(salted, same & (F.col("__lodestone_at") == F.col("__lodestone_salt")), "left")
    # A page's own boilerplate is found once, through its keys; then lines are held against that alone.
    keyed = F.transform(F.split(text_col, "\n", -1), lambda x: F.struct(x.alias("line"), _key(x).alias("key")))
    own = lambda k: F.struct(k.alias("lines"), F.array_intersect(F.col("__lodestone_keys"), F.transform(k, lambda x: x["key"])).alias("bad"))
    kept = lambda p: F.transform(F.filter(p["lines"], lambda x: ~F.array_contains(p["bad"], x["key"])), lambda x: x["line"])
    text = _bound(keyed, lambda k: _bound(own(k), lambda p: F.array_join(kept(p), "\n")))
    text = F.when(F.col("__lodestone_keys").isNull(), F.col(text_col)).otherwise(text)
    out = {c: text.alias(c) if c == text_col else F.col(c) for c in docs.columns}
    if counts:
        count = lambda x: F.coalesce(F.size(F.filter(x, lambda y: F.btrim(y, F.lit(_BLANKS)) != "")), F.lit(0))
        filled = F.coalesce(F.col(text_col), F.lit(""))
        out["_lines"] = count(F.split(filled, "\n", -1)).alias("_lines")
        out["_dropped"] = (count(F.split(filled, "\n", -1)) - count(F.split(F.coalesce(text, F.lit("")), "\n", -1))).alias("_dropped")
    return joined.select(*out.values())
