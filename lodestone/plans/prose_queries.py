"""Registered queries of prose, text structure, vectors and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import prose, vector
from lodestone.plans.derived import sql, tables
from lodestone.plans.registry import register


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, "spec_content")["spec_content"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_COSINE = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1))"


def _first_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the vector with the smallest id."""
    return table(spark, sf_dir, "embeddings").agg(F.min_by("embedding", "vec_id").alias("embedding"))


@register("vec1_topk", f"SELECT vec_id, label, round({_COSINE}, 6) AS score FROM embeddings ORDER BY {_COSINE} DESC, vec_id LIMIT 5")
def vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vector.search(rows, _first_vector(spark, sf_dir), 5, "vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


@register("vec1_filtered_search", sql(f"SELECT id, part_number, round({_COSINE}, 6) AS score FROM spec_content WHERE embedding IS NOT NULL AND part_number = 2 AND content_type = 'text' ORDER BY {_COSINE} DESC, id LIMIT 20", "spec_content"))
def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector.search(content(spark, sf_dir), _first_vector(spark, sf_dir), vector.clamp_limit(99), part=2, content_type="text")
    return found.select("id", "part_number", F.round("score", 6).alias("score"))


@register("vec3_dimensions", "SELECT vec_id, CAST(len(embedding) + vec_id % 2 AS INT) AS size FROM embeddings WHERE len(embedding) + vec_id % 2 <> 64")
def dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second vector is made longer by one, and found."""
    longer = F.when(F.col("vec_id") % 2 == 1, F.concat("embedding", F.array(F.lit(0.0).cast("float")))).otherwise(F.col("embedding"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", longer.alias("embedding"))
    return vector.wrong_dimension(rows, dimensions=64).select("vec_id", F.size("embedding").alias("size"))


@register("vec4_batch_embedding", "SELECT item_id, CAST(1024 AS INT) AS size, CASE WHEN trim(text) = '' THEN 0::DOUBLE ELSE 1::DOUBLE END AS norm FROM benchmark")
def batch_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row gets a vector of its own, of the full length and of norm 1."""
    found = vector.embed(table(spark, sf_dir, "benchmark"), "text")
    return found.select("item_id", F.size("embedding").alias("size"), F.round(F.sqrt(vector.dot(F.col("embedding"), F.col("embedding"))), 4).alias("norm"))


@register("flt4_section_prefix", sql("SELECT id, section_id, part_number FROM spec_content WHERE section_id LIKE '17.3%' ORDER BY section_id, id", "spec_content"))
def section_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.section(content(spark, sf_dir), "17.3").select("id", "section_id", "part_number")


@register("flt5_section_exact", sql("SELECT id, section_id, part_number FROM spec_content WHERE section_id = '1.1' AND part_number = 1", "spec_content"))
def section_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.exact_section(content(spark, sf_dir), 1, "1.1").select("id", "section_id", "part_number")


@register("flt3_optional_filters", sql("SELECT count(*) AS every, count(*) FILTER (WHERE part_number = 1) AS by_part, count(*) FILTER (WHERE content_type = 'table') AS by_type, count(*) FILTER (WHERE part_number = 1 AND content_type = 'table') AS by_both FROM spec_content", "spec_content"))
def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search's filters, absent and given; every case is counted in one pass."""
    rows = content(spark, sf_dir).select("part_number", "content_type")
    cases = {"every": {}, "by_part": {"part": 1}, "by_type": {"content_type": "table"}, "by_both": {"part": 1, "content_type": "table"}}
    return rows.agg(*[F.count_if(vector.wanted(**case)).alias(name) for name, case in cases.items()])


@register("ds1_distinct_sections", sql("SELECT DISTINCT part_number, section_id, title FROM spec_content WHERE title IS NOT NULL AND section_id IS NOT NULL", "spec_content"))
def distinct_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.listing(content(spark, sf_dir))


@register("lm4_top_per_part", sql("""SELECT part_number, section_id, title, CAST(place AS INT) AS place, CAST(greatest(n - 50, 0) AS INT) AS more,
  CASE part_number WHEN 1 THEN 'Fundamentals' WHEN 2 THEN 'Packaging' ELSE 'Part ' || part_number END AS part_name
FROM (SELECT *, row_number() OVER (PARTITION BY part_number ORDER BY section_id, title) AS place, count(*) OVER (PARTITION BY part_number) AS n
  FROM (SELECT DISTINCT part_number, section_id, title FROM spec_content WHERE title IS NOT NULL AND section_id IS NOT NULL)) WHERE place <= 50""", "spec_content"))  # fmt: skip
def top_per_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.part_names(prose.top_per_part(prose.listing(content(spark, sf_dir))), {1: "Fundamentals", 2: "Packaging"})


@register("ag3_counts_by_part", sql("SELECT part_number, count(*) AS n FROM spec_content GROUP BY ROLLUP (part_number)", "spec_content"))
def counts_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.part_counts(content(spark, sf_dir))


@register("ag4_embedding_coverage", sql("SELECT count(*) AS total, count(*) FILTER (WHERE embedding IS NOT NULL) AS embedded FROM spec_content", "spec_content"))
def embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.coverage(content(spark, sf_dir))


@register("ag5_usage_report", sql("SELECT user_id, max(occurred_at) AS last_used, CAST(count(*) AS INT) AS calls, list_sort(list(DISTINCT tool)) AS tools FROM usage_events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100", "usage_events"))
def usage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.usage_report(tables(spark, sf_dir, "usage_events")["usage_events"])


@register("jn10_usage_names", sql("""SELECT r.user_id, r.calls, coalesce(c.c_name, '(deleted user)') AS name FROM (SELECT user_id, CAST(count(*) AS INT) AS calls, max(occurred_at) AS t FROM usage_events GROUP BY 1 ORDER BY t DESC, 1 LIMIT 100) r
LEFT JOIN customer c ON CAST(c.c_custkey AS STRING) = r.user_id AND c.c_custkey % 3 <> 0""", "usage_events"))  # fmt: skip
def usage_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = prose.usage_report(tables(spark, sf_dir, "usage_events")["usage_events"])
    users = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("user_id"), F.col("c_name").alias("name"))
    return prose.enrich_users(report, users).select("user_id", "calls", "name")


_PAGES = "SELECT doc_id + 10 AS physical, CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'header' ELSE chr(10) || CAST(doc_id + 3 - (doc_id % 3) // 2 AS VARCHAR) END || chr(10) || text AS text FROM documents"


@register("ag6_page_offset", f"""WITH p AS ({_PAGES}), l AS (SELECT physical, list_filter(list_slice(string_split(text, chr(10)), 1, 6), lambda x: trim(x) <> '')[1:3] AS head FROM p),
  n AS (SELECT physical, CAST(list_filter(head, lambda x: regexp_full_match(trim(x), '[0-9]{{1,4}}'))[1] AS INT) AS printed FROM l),
  v AS (SELECT physical - printed AS "offset", count(*) AS votes, min(physical) AS first FROM n WHERE printed IS NOT NULL GROUP BY 1)
SELECT "offset", votes, round(votes / (SELECT sum(votes) FROM v), 6) AS agreement FROM v ORDER BY votes DESC, first LIMIT 1""")  # fmt: skip
def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    number = F.expr("CAST(doc_id + 3 - (doc_id % 3) div 2 AS STRING)")
    head = F.when(F.col("doc_id") % 5 == 0, F.lit("\nheader")).otherwise(F.concat(F.lit("\n"), number))
    pages = docs.select((F.col("doc_id") + 10).alias("physical"), F.concat(head, F.lit("\n"), "text").alias("text"))
    return X.page_offset(pages).withColumn("agreement", F.round("agreement", 6))


@register("fn16_header_number", f"""WITH p AS ({_PAGES}), l AS (SELECT physical, list_filter(list_slice(string_split(text, chr(10)), 1, 6), lambda x: trim(x) <> '')[1:3] AS head FROM p)
SELECT physical, CAST(list_filter(head, lambda x: regexp_full_match(trim(x), '[0-9]{{1,4}}'))[1] AS INT) AS printed FROM l""")  # fmt: skip
def header_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    number = F.expr("CAST(doc_id + 3 - (doc_id % 3) div 2 AS STRING)")
    head = F.when(F.col("doc_id") % 5 == 0, F.lit("\nheader")).otherwise(F.concat(F.lit("\n"), number))
    return docs.select((F.col("doc_id") + 10).alias("physical"), X.header_number(F.concat(head, F.lit("\n"), "text")).alias("printed"))


# Documents as page-marked text: line i of a document is a heading where (doc_id + i) % 4 = 0, a marker where it is 2.
_LINES = """lines AS (SELECT doc_id, CAST(i AS INT) AS i, CASE (doc_id + i) % 4 WHEN 0 THEN '**' || (i % 9 + 1) || '.' || (doc_id % 7 + 1) || '** **' || replace(replace(replace(CASE WHEN length(trim(line)) = 0 THEN 'A' ELSE trim(line) END, '*', ''), '_', ''), '.', '') || '**'
  WHEN 2 THEN '<!--page:' || (i + 20) || '-->' ELSE line END AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents))"""


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    short = lambda x: F.replace(F.replace(F.replace(F.when(F.length(F.trim(x)) == 0, "A").otherwise(F.trim(x)), F.lit("*"), F.lit("")), F.lit("_"), F.lit("")), F.lit("."), F.lit(""))

    def line(x, i):  # noqa: ANN001, ANN202
        kind = (F.col("doc_id") + i) % 4
        heading = F.concat(F.lit("**"), (i % 9 + 1).cast("string"), F.lit("."), (F.col("doc_id") % 7 + 1).cast("string"), F.lit("** **"), short(x), F.lit("**"))
        return F.when(kind == 0, heading).when(kind == 2, F.concat(F.lit("<!--page:"), (i + 20).cast("string"), F.lit("-->"))).otherwise(x)

    return docs.select("doc_id", F.lit(10).alias("page_offset"), F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("md"))


@register("fn21_sections", f"""WITH {_LINES},
  h AS (SELECT doc_id, i, line, CASE WHEN line LIKE '<!--page:%' THEN CAST(regexp_extract(line, 'page:([0-9]+)', 1) AS INT) END AS page,
    regexp_matches(trim(line), '^\\*\\*[0-9.]+\\*\\* \\*\\*[A-Za-z0-9(][^*]*\\*\\*$') AS heading FROM lines),
  s AS (SELECT *, sum(CAST(heading AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS ordinal,
    greatest(1, coalesce(last_value(page IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), 1) - 10) AS printed FROM h)
SELECT doc_id, CAST(ordinal AS INT) AS ordinal, regexp_extract(min_by(line, i), '^\\*\\*([0-9.]+)', 1) AS section_id, CAST(min_by(printed, i) AS INT) AS page_start, CAST(max_by(printed, i) AS INT) AS page_end,
  CAST(2 AS INT) AS depth, regexp_extract(min_by(line, i), '^\\*\\*([0-9]+)', 1) AS parent_id FROM s WHERE ordinal > 0 GROUP BY 1, 2""")  # fmt: skip
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sections(_marked(spark, sf_dir)).select("doc_id", F.col("ordinal").cast("int").alias("ordinal"), "section_id", "page_start", "page_end", "depth", "parent_id")


@register("fn23_chunks", f"""WITH RECURSIVE {_LINES},
  p AS (SELECT *, greatest(1, coalesce(last_value(page IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) - 10, 11)) AS printed
    FROM (SELECT doc_id, i, CASE WHEN line LIKE '<!--page:%' THEN CAST(regexp_extract(line, 'page:([0-9]+)', 1) AS INT) END AS page,
      CASE WHEN line LIKE '<!--page:%' THEN '' ELSE regexp_replace(line, '^\\s+|\\s+$', '', 'g') END AS t FROM lines)),
  n AS (SELECT doc_id, t, printed, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INT) AS k FROM p WHERE t <> ''),
  c AS (SELECT doc_id, k, 0 AS chunk, length(t) AS size FROM n WHERE k = 1
    UNION ALL SELECT n.doc_id, n.k, CASE WHEN c.size + length(n.t) > {X.CHUNK_CHARS} THEN c.chunk + 1 ELSE c.chunk END,
      CASE WHEN c.size + length(n.t) > {X.CHUNK_CHARS} THEN length(n.t) ELSE c.size + 2 + length(n.t) END FROM c JOIN n ON n.doc_id = c.doc_id AND n.k = c.k + 1)
SELECT doc_id, chunk AS chunk_index, CAST(min_by(printed, k) AS INT) AS page_number, md5(string_agg(t, chr(10) || chr(10) ORDER BY k)) AS digest FROM c JOIN n USING (doc_id, k) GROUP BY 1, 2""")  # fmt: skip
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole page-marked documents at the real limit; a line is a paragraph."""
    docs = _marked(spark, sf_dir).select("doc_id", F.col("md").alias("content"), F.lit(11).alias("page_start"), "page_offset")
    return X.chunk_sections(docs, ["doc_id"], separator=r"\n").select("doc_id", "chunk_index", "page_number", F.md5(F.col("content").cast("binary")).alias("digest"))


@register("fn23_fixed_paragraphs", """SELECT doc_id, count(*) AS paragraphs, CAST(max(length(trim(p))) AS INT) AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) WHERE trim(p) <> '' GROUP BY 1""")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a limit of one character every paragraph is a chunk."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.lit(1).alias("page_start"), F.lit(0).alias("page_offset"))
    found = X.chunk_sections(docs, ["doc_id"], 1, r"\n")
    return found.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.max(F.length("content")).alias("longest"))


@register("ag7_chunk_lengths", "SELECT CAST(round(avg(length(text))) AS BIGINT) AS average, sum(length(text)) AS total, count(*) AS n FROM documents WHERE text <> ''")
def chunk_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf_dir, "documents").where("text <> ''").agg(F.round(F.avg(n)).cast("long").alias("average"), F.sum(n).alias("total"), F.count("*").alias("n"))


_TAGGED = "'<!--page:' || doc_id || '-->' || text || '<!--page:' || (doc_id + 1) || '-->'"


@register("fn24_page_markers", f"SELECT doc_id, CAST(regexp_extract_all(t, '<!--page:([0-9]+)-->', 1)[-1] AS INT) AS page, md5(regexp_replace(t, '<!--page:[0-9]+-->', '', 'g')) AS digest FROM (SELECT doc_id, {_TAGGED} AS t FROM documents) WHERE trim(t) = t")
def page_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tag = lambda n: F.concat(F.lit("<!--page:"), n.cast("string"), F.lit("-->"))
    tagged = docs.select("doc_id", F.concat(tag(F.col("doc_id")), F.col("text"), tag(F.col("doc_id") + 1)).alias("t"))
    plain = F.regexp_replace("t", X.MARKER, "")
    return tagged.select("doc_id", X.take_markers(F.col("t"))["page"].alias("page"), F.md5(plain.cast("binary")).alias("digest"))


@register("fn25_strip_for_embedding", """SELECT page_id, md5(coalesce(nullif(t, ''), html)) AS digest FROM (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '```[\\s\\S]*?```', ' ', 'g'), '<[^>]+>[\\s\\S]*?</[^>]+>', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM pages)""")
def strip_for_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.strip_for_embedding(F.col("html")).cast("binary")).alias("digest"))


@register("fn22_parent_sections", "SELECT o_orderkey, s, CASE WHEN position('.' IN s) > 0 THEN regexp_replace(s, '\\.[^.]+$', '') END AS parent, CAST(len(string_split(s, '.')) AS INT) AS depth FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderkey % 17 AS VARCHAR) WHEN 1 THEN (o_orderkey % 17) || '.' || (o_orderkey % 5) ELSE (o_orderkey % 17) || '.' || (o_orderkey % 5) || '.' || (o_orderkey % 7) END AS s FROM orders)")
def parent_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    a, b, c = ((k % n).cast("string") for n in (17, 5, 7))
    s = F.when(k % 3 == 0, a).when(k % 3 == 1, F.concat_ws(".", a, b)).otherwise(F.concat_ws(".", a, b, c))
    return table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s")).select("o_orderkey", "s", X.parent_section(F.col("s")).alias("parent"), X.section_depth(F.col("s")).alias("depth"))


@register("fn19_line_tests", "SELECT doc_id, CAST(i AS INT) AS i, line LIKE '**%' OR line LIKE '#%' AS marked, contains(line, '..') AS toc, trim(regexp_replace(regexp_replace(line, '\\*+|__', '', 'g'), '\\s+', ' ', 'g')) AS plain FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)")
def line_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    line = F.col("line")
    return lines.select("doc_id", "i", X.has_heading_markup(line).alias("marked"), X.looks_like_toc(line).alias("toc"), X.strip_emphasis(line).alias("plain"))


@register("fn26_page_sheets", "SELECT o_orderkey, greatest(1, least(CAST(o_orderkey % 6000 AS INT) - 100, 5016)) + 10 AS sheet, '/spec.pdf#page=' || (greatest(1, least(CAST(o_orderkey % 6000 AS INT) - 100, 5016)) + 10) AS url FROM orders")
def page_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = X.sheet_of((F.col("o_orderkey") % 6000).cast("int") - 100, F.lit(10), F.lit(5016))
    return table(spark, sf_dir, "orders").select("o_orderkey", sheet.alias("sheet"), F.concat(F.lit("/spec.pdf#page="), sheet.cast("string")).alias("url"))


@register("fn17_assemble", "SELECT conv_id, md5(string_agg('<!--page:' || turn || '-->' || chr(10) || chr(10) || text || chr(10) || chr(10), '' ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("physical"), "text")
    return X.assemble(pages, ("conv_id",)).select("conv_id", F.md5(F.col("md").cast("binary")).alias("digest"))


@register("prj5_display", sql("SELECT id, coalesce(title, substr(content, 1, 60)) AS head, CASE WHEN title IS NOT NULL THEN substr(content, 1, 120) END AS description FROM spec_content", "spec_content"))
def display(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = content(spark, sf_dir)
    return rows.select("id", X.display_title(F.col("title"), F.col("content")).alias("head"), X.display_description(F.col("title"), F.col("content")).alias("description"))


@register("prj6_section_metadata", sql("SELECT section_id, title, length(content) AS content_length, greatest(1, page_number - 10) AS printed_page FROM spec_content", "spec_content"))
def section_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content(spark, sf_dir).select("section_id", "title", F.length("content").cast("long").alias("content_length"), X.printed_page(F.col("page_number"), F.lit(10)).alias("printed_page"))


_HEADS = "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, unnest(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)) AS heading, url FROM pages"


@register("src17_docs_index", f"""SELECT url AS link, title, lower(title || ' ' || url) AS text FROM (SELECT url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
UNION ALL SELECT url || '#' || regexp_replace(lower(heading), '\\s+', '-', 'g'), heading, lower(heading) FROM ({_HEADS})""")  # fmt: skip
def docs_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).select("link", "title", "text")


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    first = pages.select("url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.col("url").alias("description"))
    heads = pages.select("url", F.posexplode(F.regexp_extract_all("html", F.lit("<h1>([^<]*)</h1>"), 1)).alias("place", "heading"))
    return prose.docs_index(first, heads)


@register("flt13_docs_search", f"""WITH i AS (SELECT url, -1 AS place, url AS link, lower(title || ' ' || url) AS text FROM (SELECT url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
  UNION ALL SELECT url, 0, url || '#' || regexp_replace(lower(heading), '\\s+', '-', 'g'), lower(heading) FROM ({_HEADS}))
SELECT link FROM i WHERE contains(text, 'the') ORDER BY url, place LIMIT 8""")  # fmt: skip
def docs_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.search_index(_index(spark, sf_dir), "THE").select("link")


@register("src8_sha256_verify", """SELECT CAST(item_id AS VARCHAR) AS name, CASE item_id % 5 WHEN 1 THEN 'missing' WHEN 2 THEN 'unknown' WHEN 3 THEN 'changed' ELSE 'fine' END AS state, CASE WHEN item_id % 5 <> 1 THEN sha256(text) END AS sha256 FROM benchmark""")
def sha256_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some files are not there, some are in no manifest, and some are not what the manifest says."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("name"), (F.col("item_id") % 5).alias("k"), F.col("text").cast("binary").alias("content"))
    manifest = rows.where("k <> 2").select("name", F.when(F.col("k") == 3, F.sha2(F.concat("content", F.lit(b"!")), 256)).otherwise(F.sha2("content", 256)).alias("sha256"))
    return prose.compared(rows.where("k <> 1").select("name", "content"), manifest)


@register("src18_shape_guides", "SELECT CAST(p_brand AS VARCHAR) AS name, list_sort(list(DISTINCT p_type)) AS guides, CAST(min(p_partkey) AS BIGINT) AS place FROM part GROUP BY 1")
def shape_guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    lists = part.groupBy("p_brand").agg(F.sort_array(F.collect_set("p_type")).alias("guides"))
    shapes = part.join(lists, "p_brand").select(F.col("p_brand").alias("name"), "guides", F.col("p_partkey").alias("place"))
    return prose.guides(shapes)


_HEADING = """CASE p_partkey % 10 WHEN 0 THEN '**' || n || '** **' || p_name || '**' WHEN 1 THEN '## ' || n || ' ' || p_name WHEN 2 THEN '# ' || p_size || ' ' || p_name WHEN 3 THEN '# ' || p_size || '. **' || p_name || '**'
  WHEN 4 THEN '**annex ' || substr('ABCDE', CAST(p_partkey % 5 + 1 AS INT), 1) || '.** **' || p_name || '**' WHEN 5 THEN '| **' || n || '** **' || p_name || '** |' WHEN 6 THEN '**' || n || '** **' || p_name || ' .... 7**'
  WHEN 7 THEN '**' || n || '**' WHEN 8 THEN n || ' ' || p_name ELSE '**' || n || '** . ' || p_name END"""


@register("fn18_headings", f"""SELECT p_partkey, line, CASE p_partkey % 10 WHEN 0 THEN n WHEN 1 THEN n WHEN 3 THEN CAST(p_size AS VARCHAR) WHEN 4 THEN 'Annex ' || substr('ABCDE', CAST(p_partkey % 5 + 1 AS INT), 1) END AS section_id,
  CASE WHEN p_partkey % 10 IN (0, 1, 3, 4) THEN p_name END AS title
FROM (SELECT *, {_HEADING} AS line FROM (SELECT p_partkey, p_name, p_size, p_size || '.' || (p_partkey % 9) || '.' || (p_partkey % 4) AS n FROM part))""")  # fmt: skip
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three forms that are headings, and six that only look like one."""
    named = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 9).cast("string"), (F.col("p_partkey") % 4).cast("string")).alias("n"))
    lines = named.select("p_partkey", F.expr(_HEADING).alias("line"))
    return lines.select("p_partkey", "line", X.match_heading(F.col("line")).alias("h")).select("p_partkey", "line", "h.section_id", "h.title")


@register("fn20_annex_titles", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '(normative) ' || p_name WHEN 1 THEN '(normative)' WHEN 2 THEN 'Own title' ELSE '(normative)' END AS title FROM part""")
def annex_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title that is a qualifier goes on in the next line, if that is the first and styled."""
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    styled = F.concat(F.lit("**"), name, F.lit("**"))
    head = F.when(k == 2, "**Annex B** **Own title**").otherwise("**Annex B** **(normative)**")
    after = F.when(k == 1, F.concat(F.lit("\n"), name, F.lit("\n"), styled)).when(k == 3, F.lit("\n\n- \n\ntext")).otherwise(F.concat(F.lit("\n\n"), styled))
    docs = table(spark, sf_dir, "part").select("p_partkey", F.concat(head, after).alias("md"), F.lit(0).alias("page_offset"))
    return X.sections(docs, ["p_partkey"]).where("ordinal = 1").select("p_partkey", "title")
