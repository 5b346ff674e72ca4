"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exactdedup, langid, lexical, linededup, mixing, packing, phrases, quality, sharding, simhash, substring, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(documents(spark, sf_dir))


OP9_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256,
             max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
             count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
      FROM documents)
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", "fingerprint", "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir), 24)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.drop_boilerplate(documents(spark, sf_dir), counts=True)
    return found.select("doc_id", F.col("_lines").alias("lines"), F.col("_dropped").alias("dropped"), F.sha2("text", 256).alias("text_sha256"))


OP4_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM lines),
pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
often AS (
  SELECT source, key, count(DISTINCT doc_id) AS n FROM keyed WHERE key <> '' GROUP BY source, key
  HAVING count(DISTINCT doc_id) >= {linededup.MIN_PAGES}),
boiler AS (
  SELECT o.source, o.key FROM often o JOIN pages p ON o.source IS NOT DISTINCT FROM p.source
  WHERE o.n > p.pages * {linededup.RATIO}::DOUBLE),
marked AS (
  SELECT k.*, b.key IS NOT NULL AS bad FROM keyed k
  LEFT JOIN boiler b ON b.source IS NOT DISTINCT FROM k.source AND b.key = k.key),
done AS (
  SELECT doc_id, CAST(count(*) FILTER (WHERE key <> '') AS INT) AS lines, CAST(count(*) FILTER (WHERE bad) AS INT) AS dropped,
         sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT bad), '')) AS text_sha256
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(x.lines, 0) AS lines, coalesce(x.dropped, 0) AS dropped, x.text_sha256
FROM documents d LEFT JOIN done x USING (doc_id)
"""


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(documents(spark, sf_dir), least_words=substring.PASSAGE_WORDS)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.scores(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.languages(docs, langid.fit(docs))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.scores(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 50)


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
b AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
s AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d),
t AS (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
p AS (SELECT row, doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, s GROUP BY term, docs),
x AS (
  SELECT b.item_id, p.row, p.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (100 - 50 + ((50 * p.n * s.docs) // s.total))))) AS BIGINT) AS score
  FROM b JOIN p USING (term) JOIN w USING (term), s GROUP BY b.item_id, p.row, p.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM x WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


OP13_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
spots AS (SELECT id, lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (SELECT lang, k AS words, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM spots, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, words, f, w, unnest(range(1, words)) AS k FROM c),
scores AS (
  SELECT x.lang, x.phrase, x.f AS a, k, h.f AS l, t.f AS r, CAST((1000000::HUGEINT * x.f * x.f) // (h.f::HUGEINT * t.f) AS BIGINT) AS score
  FROM cuts x JOIN f h ON h.lang = x.lang AND h.phrase = array_to_string(x.w[1:k], ' ') AND h.words = k
  JOIN f t ON t.lang = x.lang AND t.phrase = array_to_string(x.w[k + 1:], ' ') AND t.words = x.words - k),
low AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, phrase, max(f) AS most FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, f FROM c WHERE words = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), f FROM c WHERE words = 3) GROUP BY ALL)
SELECT low.lang, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank, low.phrase, a, l, r, n, score
FROM low JOIN n USING (lang) LEFT JOIN inside i ON i.lang = low.lang AND i.phrase = low.phrase
WHERE most IS NULL OR 100 * most < 50 * a
QUALIFY row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) <= 2000
"""


def queries() -> dict[str, Query]:
    return {
        "op1_mixing": op1_mixing,
        "op2_simhash": op2_simhash,
        "op3_sharding": op3_sharding,
        "op4_line_dedup": op4_line_dedup,
        "op5_nearest": op5_nearest,
        "op6_packing": op6_packing,
        "op7_substrings": op7_substrings,
        "op8_toxicity": op8_toxicity,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_language": op10_language,
        "op11_quality": op11_quality,
        "op12_lexical_search": op12_lexical_search,
        "op13_phrases": op13_phrases,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL, "op9_exact_dedup": OP9_SQL, "op12_lexical_search": OP12_SQL, "op13_phrases": OP13_SQL}
