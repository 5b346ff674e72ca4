"""Shapes and the names of their adjust guides, from XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.prose import guides

ROW = "_name string, avLst struct<gd:array<struct<_name:string>>>"


def xml_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """(place, row): the elements named `tag` of XML files, in a schema; one large file is read by many tasks.

    Files are cut behind every closing tag, as text files are behind a line
    end, so Spark can split them; what stands before an element is passed over.
    place orders elements by file, then as they stand in it. Elements of that
    name within one another, or their tags in comments, are not supported, nor
    is > in an attribute of an element without content. A malformed element
    fails the query.
    """
    end = f"</{tag}>"
    text = spark.read.text(path, lineSep=end).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    pieces = text.select("file", "block", "n", F.posexplode(F.split("value", rf"(?=<{tag}[\s/>])")).alias("k", "x")).where(F.col("x").rlike(rf"^<{tag}[\s/>]"))
    alone = F.regexp_extract("x", rf"^<{tag}(?:\s[^>]*)?/>", 0)
    element = F.when(alone != "", alone).otherwise(F.concat("x", F.lit(end)))
    return pieces.select(F.struct("file", "block", "n", "k").alias("place"), F.from_xml(element, schema, {"mode": "FAILFAST"}).alias("row"))


def write_shapes(shapes: DataFrame, path: str) -> None:
    """Write (name, guides) as XML: a shape element with its name, and a gd element with a name per guide. Files follow the frame's partitions."""
    listed = F.transform("guides", lambda g: F.struct(g.alias("_name")))
    shapes.select(F.col("name").alias("_name"), F.struct(listed.alias("gd")).alias("avLst")).write.format("xml").option("rootTag", "shapes").option("rowTag", "shape").mode("overwrite").save(path)


def read_shapes(spark: SparkSession, path: str, tag: str = "shape") -> DataFrame:
    """(name, guides, place) from files in which a shape is an element named `tag` with a name.

    Guides are in order, those without a name left out. A shape that occurs
    again with the same guides counts once, at its first place; with others it
    is an error. Elements without a name are left out.
    """
    found = xml_rows(spark, path, tag, ROW).where("row._name IS NOT NULL")
    names = F.filter(F.coalesce(F.transform("row.avLst.gd", lambda g: g["_name"]), F.array().cast("array<string>")), lambda x: x.isNotNull())
    return guides(found.select(F.col("row._name").alias("name"), names.alias("guides"), "place"))


def shapes_of(nodes: DataFrame, root: str = "presetShapeDefinitons") -> DataFrame:
    """(name, guides, place) from the nodes of documents in which a shape's element bears its name, as `xmlnodes.parse` gives them.

    Only children of a root named `root` are shapes; of several avLst elements
    the first counts. A document without that root, and one without a shape,
    are errors. A document is parsed in one task.
    """
    tops = nodes.where("size(path) = 0").select("doc", "tag")
    shape = nodes.where("size(path) = 1").select("doc", F.col("path")[0].alias("at"), F.col("tag").alias("name"))
    first = nodes.where("size(path) = 2 AND tag = 'avLst'").groupBy("doc", F.col("path")[0].alias("at")).agg(F.min(F.col("path")[1]).alias("list"))
    guide = nodes.where("size(path) = 3 AND tag = 'gd'").select("doc", F.col("path")[0].alias("at"), F.col("path")[1].alias("list"), F.col("path")[2].alias("n"), F.try_element_at("attrs", F.lit("name")).alias("g"))
    listed = guide.where("g IS NOT NULL").join(first, ["doc", "at", "list"]).groupBy("doc", "at").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "g"))), lambda x: x["g"]).alias("guides"))
    some = shape.groupBy("doc").agg(F.count("*").alias("shapes"))
    fault = F.when(F.col("tag") != root, F.concat(F.lit(f"no {root} root: "), F.col("doc"))).when(F.col("shapes").isNull(), F.concat(F.lit("no shapes: "), F.col("doc")))
    # The check sits in the name, on rows that an outer join keeps, so no plan can pass it by.
    found = tops.join(some, "doc", "left").join(shape, "doc", "left").join(listed, ["doc", "at"], "left")
    name = F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(F.col("name")).alias("name")
    return guides(found.select(name, F.coalesce("guides", F.array().cast("array<string>")).alias("guides"), F.struct("doc", "at").alias("place")))
