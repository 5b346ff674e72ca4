"""Prose rows: section lookup, listings, statistics, usage reports and catalogs."""

from __future__ import annotations

import hashlib
import urllib.request
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import importable
from lodestone.staging import cut


def section(rows: DataFrame, prefix: str, part: int | None = None, escape: bool = False) -> DataFrame:
    """Rows whose section id starts with `prefix`, by section id as text, then id; % and _ are wildcards unless escaped."""
    if escape:
        prefix = prefix.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    found = rows.where(F.col("section_id").like(prefix + "%"))
    if part is not None:
        found = found.where(F.col("part_number") == part)
    return found.orderBy(F.asc_nulls_last("section_id"), "id")


def section_page(rows: DataFrame, prefix: str, size: int, part: int | None = None, after: str | None = None) -> DataFrame:
    """The next `size` rows of `section`; `after` is the last row's mark, its section id, # and its id."""
    found = section(rows, prefix, part)
    if after is not None:
        name, _, number = after.rpartition("#")
        found = found.where((F.col("section_id") > name) | ((F.col("section_id") == name) & (F.col("id") > int(number))))
    return found.limit(size)


def sections_of(rows: DataFrame, asked: DataFrame, size: int = 50, block: int = 1_000) -> DataFrame:
    """For every asked prefix what a section report holds: prefix, place, the rows' columns, and `after`, the mark to go on from where more follow.

    asked: prefix; nulls ask for nothing. A report is the first `size` rows of
    `section`. Prefixes meet the beginnings of section ids by an equal join;
    those with a wildcard are matched in blocks of `block`, each a scan.
    """
    wanted = cut(asked.select("prefix").where("prefix IS NOT NULL").distinct())
    plain, wild = wanted.where("NOT (contains(prefix, '%') OR contains(prefix, '_'))"), wanted.where("contains(prefix, '%') OR contains(prefix, '_')")
    longest = plain.agg(F.max(F.length("prefix"))).first()[0]
    known = rows.where("section_id IS NOT NULL")
    hits = []
    if longest is not None:
        begins = F.transform(F.sequence(F.lit(0), F.least(F.length("section_id"), F.lit(longest))), lambda n: F.substring("section_id", F.lit(1), n))
        hits.append(known.withColumn("prefix", F.explode(begins)).join(plain, "prefix", "left_semi"))
    blocks = -(-wild.count() // block)
    for n in range(blocks):
        some = wild.where(F.pmod(F.xxhash64("prefix"), F.lit(blocks)) == n)
        hits.append(known.join(F.broadcast(some), F.like("section_id", F.concat("prefix", F.lit("%")))))
    columns = ["prefix", *rows.columns]
    found = reduce(DataFrame.unionByName, [x.select(*columns) for x in hits]) if hits else rows.limit(0).withColumn("prefix", F.lit("")).select(*columns)
    by = Window.partitionBy("prefix").orderBy("section_id", "id")
    # One row more than a report holds tells whether more follow.
    first = found.withColumn("place", F.row_number().over(by)).where(F.col("place") <= size + 1)
    mark = F.when((F.col("place") == size) & (F.lead("place").over(by) == size + 1), F.concat("section_id", F.lit("#"), F.col("id").cast("string")))
    return first.withColumn("after", mark).where(F.col("place") <= size)


def exact_section(rows: DataFrame, part: int, section_id: str) -> DataFrame:
    return rows.where((F.col("part_number") == part) & (F.col("section_id") == section_id)).orderBy("id")


def listing(rows: DataFrame, part: int | None = None) -> DataFrame:
    """Distinct titled sections (part_number, section_id, title)."""
    found = rows.where(F.col("title").isNotNull() & F.col("section_id").isNotNull())
    if part is not None:
        found = found.where(F.col("part_number") == part)
    return found.select("part_number", "section_id", "title").distinct()


def top_per_part(found: DataFrame, limit: int = 50) -> DataFrame:
    """The first `limit` rows of each part, with their place and how many more the part has."""
    by = Window.partitionBy("part_number")
    ranked = found.withColumns({"place": F.row_number().over(by.orderBy("section_id", "title")), "more": F.greatest(F.count("*").over(by) - limit, F.lit(0)).cast("int")})
    return ranked.where(F.col("place") <= limit)


def listed_parts(rows: DataFrame, limit: int = 50) -> DataFrame:
    """(part_number, lines, more): for every part the lines of its listing, and how many more sections it has."""
    line = F.concat(F.lit("- **"), "section_id", F.lit("**: "), "title")
    ranked = top_per_part(listing(rows), limit)
    return ranked.groupBy("part_number").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))["line"].alias("lines"), F.max("more").alias("more"))


def part_names(rows: DataFrame, names: dict[int, str]) -> DataFrame:
    """rows with `part_name`: the known name, else `Part n`."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.create_map().cast("map<int,string>")
    return rows.withColumn("part_name", F.coalesce(F.try_element_at(known, F.col("part_number")), F.concat(F.lit("Part "), F.col("part_number").cast("string"))))


def part_counts(rows: DataFrame) -> DataFrame:
    """Rows per part and in all (part_number null)."""
    return rows.rollup("part_number").agg(F.count("*").alias("n"))


def coverage(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count("embedding").alias("embedded"))


def usage_report(events: DataFrame, limit: int = 100) -> DataFrame:
    """Per user: last use, calls and tools, latest first, ties by user."""
    found = events.groupBy("user_id").agg(F.max("occurred_at").alias("last_used"), F.count("*").cast("int").alias("calls"), F.sort_array(F.collect_set("tool")).alias("tools"))
    return found.orderBy(F.desc("last_used"), "user_id").limit(limit)


def enrich_users(report: DataFrame, users: DataFrame) -> DataFrame:
    """report with the user's name, `(deleted user)` for those who are gone."""
    return report.join(users.select("user_id", "name"), "user_id", "left").withColumn("name", F.coalesce("name", F.lit("(deleted user)")))


def matches_any(fields: list[Column], query: str) -> Column:
    """Whether the fields, joined by spaces, contain the query, whatever the case; an empty query matches."""
    return F.lower(F.concat_ws(" ", *fields)).contains(query.lower())


def compared(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, state, sha256) of every file and every manifest entry: fine, changed, missing (no file) or unknown (no entry)."""
    there = files.select("name", F.sha2("content", 256).alias("sha256"))
    joined = there.join(manifest.select("name", F.col("sha256").alias("_want")), "name", "full")
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("_want").isNull(), "unknown").when(F.col("sha256") != F.col("_want"), "changed").otherwise("fine")
    return joined.select("name", state.alias("state"), "sha256")


def verified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, sha256) of the files, all of which must be in the manifest and as it says, and none missing; else an error."""
    fault = F.concat(F.lit("sha256 of "), F.col("name"), F.lit(": "), F.col("state"), F.coalesce(F.concat(F.lit(", "), F.col("sha256")), F.lit("")))
    return compared(files, manifest).where(F.when(F.col("state") != "fine", F.raise_error(fault)).otherwise(F.lit(True))).select("name", "sha256")


def fetched(manifest: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """(name, sha256, content) of every source of a manifest (name, url, sha256), read from its URL by the tasks.

    The digest is taken while the bytes come in; bytes that are not what the
    manifest says, a source without a URL or digest, and one that cannot be
    read fail the query, so nothing unverified is ever written.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, url, want in batch.itertuples(index=False):
                if not url or not want:
                    raise ValueError(f"{name}: a source needs a url and a sha256")
                digest, parts = hashlib.sha256(), []
                with urllib.request.urlopen(url) as stream:
                    while part := stream.read(chunk):
                        digest.update(part)
                        parts.append(part)
                if digest.hexdigest() != want.lower():
                    raise ValueError(f"{name}: sha256 is {digest.hexdigest()}, not {want}")
                yield pd.DataFrame({"name": [name], "sha256": [digest.hexdigest()], "content": [b"".join(parts)]})

    importable(manifest.sparkSession)
    return manifest.select("name", "url", "sha256").mapInPandas(run, "name string, sha256 string, content binary")


def docs_index(pages: DataFrame, headings: DataFrame) -> DataFrame:
    """(ordinal, url, title, text): a row per page, then one per heading with its anchor, text in lower case.

    pages: url, title, description. headings: url, place, heading.
    """
    from lodestone.functions.text import slug

    first = pages.select("url", F.lit(-1).alias("place"), F.col("url").alias("link"), "title", F.lower(F.concat_ws(" ", "title", "description")).alias("text"))
    second = headings.select("url", "place", F.concat("url", F.lit("#"), slug(F.col("heading"))).alias("link"), F.col("heading").alias("title"), F.lower("heading").alias("text"))
    return first.unionByName(second)


def search_index(index: DataFrame, query: str, limit: int = 8) -> DataFrame:
    return index.where(F.col("text").contains(query.lower())).orderBy("url", "place").limit(limit)


def guides(shapes: DataFrame) -> DataFrame:
    """(name, guides, place): each shape once, at its first place; the same shape with other guides is an error."""
    found = shapes.groupBy("name").agg(F.collect_set("guides").alias("g"), F.min("place").alias("place"))
    fault = F.raise_error(F.concat(F.lit("conflicting guides for "), F.col("name")))
    return found.select("name", F.when(F.size("g") > 1, fault).otherwise(F.col("g")[0]).alias("guides"), "place")
