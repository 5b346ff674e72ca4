"""Order-preserving XML: one row per element, in a form that relational operators can walk."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import importable

NODE_SCHEMA = "doc string, path array<int>, tag string, attrs map<string,string>, text string"


def xml_nodes(xml: str) -> list[tuple[list[int], str, dict[str, str], str]]:
    """(path, tag, attrs, text) of every element in document order.

    path holds the element's place among its siblings at each level, the root
    having the empty path. Tags and attributes keep their prefixes, values
    stay strings, text is trimmed.
    """
    rows: list[tuple[list[int], str, dict[str, str], list[str]]] = []
    open_: list[int] = []
    seen: list[int] = [0]
    parser = expat.ParserCreate()

    def start(tag: str, attrs: dict[str, str]) -> None:
        path = [*rows[open_[-1]][0], seen[-1]] if open_ else []
        seen[-1] += 1
        seen.append(0)
        open_.append(len(rows))
        rows.append((path, tag, attrs, []))

    def end(_: str) -> None:
        open_.pop()
        seen.pop()

    parser.StartElementHandler = start
    parser.EndElementHandler = end
    parser.CharacterDataHandler = lambda x: rows[open_[-1]][3].append(x) if open_ else None
    parser.Parse(xml.encode("utf-8"), True)
    return [(path, tag, attrs, "".join(text).strip()) for path, tag, attrs, text in rows]


def parse(files: DataFrame, path_col: str = "path", text_col: str = "xml") -> DataFrame:
    """Node rows of every file; a file that is not well-formed fails the query with its name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, xml in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
                try:
                    rows = xml_nodes(xml)
                except expat.ExpatError as error:
                    raise ValueError(f"{name}: {error}") from error
                for at in range(0, len(rows), 10_000):
                    part = pd.DataFrame(rows[at : at + 10_000], columns=["path", "tag", "attrs", "text"])
                    part.insert(0, "doc", name)
                    yield part

    importable(files.sparkSession)
    return files.select(path_col, text_col).mapInPandas(run, NODE_SCHEMA)


def read_files(spark: SparkSession, folder: str, pattern: str = "*.xsd") -> DataFrame:
    """(path, xml): whole files below a folder, path relative to it."""
    base = folder.rstrip("/") + "/"
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    name = F.regexp_replace(F.expr("_metadata.file_path"), "^[a-z]+:/*", "/")
    return files.select(F.substring(name, F.length(F.regexp_replace(F.lit(base), "^[a-z]+:/*", "/")) + 1, F.length(name)).alias("path"), F.col("value").alias("xml"))
