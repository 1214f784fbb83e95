"""Queries that read names out of free texts, with gazetteers made of the texts' own words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import gazetteer
from waymark.plans.registry import query
from waymark.sources.tables import table
from waymark.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARKERS = ["the", "and", "des", "sch"]


def lowered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.translate("text", UPPER, LOWER).alias("text"))


def names(texts: DataFrame) -> DataFrame:
    """A gazetteer: word, kind, rank and alias, by the share of texts that have the word in a hundred thousand."""
    n = F.greatest(F.lit(1), F.lit(texts.count()))
    runs = texts.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]+"), 0))).alias("word"))
    seen = runs.groupBy("word").agg((F.count("*") * 100_000 / n).alias("share"))
    kind = F.when((F.length("word") >= 6) & F.col("share").between(600, 5_000), "local").when(F.length("word").between(3, 5) & F.col("share").between(3_000, 20_000), "metro")
    ranked = seen.withColumn("kind", kind).filter("kind is not null")
    alias = F.concat(F.lit("area of "), F.left("word", F.lit(3)))
    return ranked.select("word", "kind", F.when(F.col("kind") == "local", F.length("word")).otherwise(100 + F.length("word")).alias("rank"), F.when(F.length("word") % 2 == 0, alias).alias("alias"))


#: texts and names() in DuckDB.
NAMES_SQL = f"""texts AS (SELECT doc_id, translate(text, '{UPPER}', '{LOWER}') AS text FROM documents),
runs AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[a-z]+'))) AS word FROM texts),
shares AS (SELECT word, count(*) * 100000 / greatest(1, (SELECT count(*) FROM texts)) AS share FROM runs GROUP BY word),
kinds AS (SELECT word, CASE WHEN len(word) >= 6 AND share BETWEEN 600 AND 5000 THEN 'local' WHEN len(word) BETWEEN 3 AND 5 AND share BETWEEN 3000 AND 20000 THEN 'metro' END AS kind FROM shares),
names AS (SELECT word, kind, CASE WHEN kind = 'local' THEN len(word) ELSE 100 + len(word) END AS rank, CASE WHEN len(word) % 2 = 0 THEN 'area of ' || left(word, 3) END AS alias FROM kinds WHERE kind IS NOT NULL)"""

HINTS_SQL = f"""WITH {NAMES_SQL},
tokens AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]+')) AS run, generate_subscripts(regexp_extract_all(text, '[a-z]+'), 1) AS pos FROM texts),
heads AS (SELECT doc_id, pos, max(len(word)) AS n, arg_max(word, len(word)) AS word FROM (SELECT doc_id, pos, unnest(list_transform(range(1, len(run) + 1), lambda k: left(run, k))) AS word FROM tokens) z JOIN names USING (word) GROUP BY doc_id, pos),
firsts AS (SELECT doc_id, word, min(pos) AS pos FROM heads GROUP BY doc_id, word),
pieces AS (SELECT f.doc_id, f.word, f.pos, t.text, string_split(t.text, f.word) AS parts FROM firsts f JOIN texts t USING (doc_id)),
behind AS (SELECT doc_id, word, pos, list_transform(range(1, len(parts)), lambda k: substr(text, (list_sum(list_transform(parts[:k], lambda p: len(p))) + k * len(word) + 1)::BIGINT, 8)) AS after FROM pieces),
kept AS (SELECT b.doc_id, b.word, b.pos, n.kind FROM behind b JOIN names n USING (word) WHERE b.word NOT IN (SELECT word FROM names WHERE kind = 'metro' AND ends_with(word, 'th')) AND len(list_filter(after, lambda a: NOT regexp_matches(a, '{"|".join(MARKERS)}'))) > 0),
best AS (SELECT doc_id, list(word ORDER BY pos) FILTER (kind = 'local') AS own, list(word ORDER BY pos) AS every_one FROM kept GROUP BY doc_id)
SELECT t.doc_id, array_to_string(coalesce(own, every_one, []), ' ') AS hints, CASE WHEN own IS NOT NULL THEN 'local' WHEN every_one IS NOT NULL THEN 'metro' END AS kind FROM texts t LEFT JOIN best b ON b.doc_id = t.doc_id"""


@query(HINTS_SQL)
def region_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions each document is about: heads of its words in a gazetteer, local ones first, none that a marker follows everywhere."""
    texts = lowered(spark, sf_dir)
    known = cut(names(texts))
    odd = [r[0] for r in known.filter("kind = 'metro' and endswith(word, 'th')").select("word").collect()]  # some of a checked dimension
    found = gazetteer.region_hints(texts, ["doc_id"], "text", gazetteer.gazetteer(known, MARKERS, 8, "[a-z]+"), "local", odd)
    return found.select("doc_id", F.array_join("hints", " ").alias("hints"), "kind")


AREAS_SQL = f"""WITH {NAMES_SQL},
fields AS (SELECT doc_id, 1 AS field, left(text, 200) AS part FROM texts UNION ALL SELECT doc_id, 2, text FROM texts),
tokens AS (SELECT doc_id, field, unnest(regexp_extract_all(part, '[a-z]+')) AS run, generate_subscripts(regexp_extract_all(part, '[a-z]+'), 1) AS pos FROM fields),
ends AS (SELECT doc_id, field, pos, word, alias, row_number() OVER (PARTITION BY doc_id ORDER BY field, pos, len(word) DESC) AS nth
  FROM (SELECT doc_id, field, pos, unnest(list_transform(range(1, len(run) + 1), lambda k: right(run, k))) AS word FROM tokens) z JOIN (SELECT * FROM names WHERE kind = 'local') n USING (word)),
inside AS (SELECT doc_id, word, alias, row_number() OVER (PARTITION BY doc_id ORDER BY field, len(word) DESC, rank, word) AS nth FROM fields JOIN (SELECT * FROM names WHERE kind = 'metro') n ON contains(part, word))
SELECT t.doc_id, coalesce(e.alias, e.word, i.alias, i.word) AS area FROM texts t LEFT JOIN (SELECT * FROM ends WHERE nth = 1) e ON e.doc_id = t.doc_id LEFT JOIN (SELECT * FROM inside WHERE nth = 1) i ON i.doc_id = t.doc_id"""


@query(AREAS_SQL)
def text_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area each document names: in its first 200 characters, else anywhere, a word's end before a word inside."""
    texts = lowered(spark, sf_dir)
    known = gazetteer.gazetteer(cut(names(texts)), letters="[a-z]+")
    fields = texts.withColumn("head", F.left("text", F.lit(200)))
    return gazetteer.areas(fields, ["doc_id"], ["head", "text"], known, "local", "metro")


REGIONS_SQL = f"""WITH {NAMES_SQL}, free AS (SELECT doc_id, regexp_replace(text, '[a-z]+ (?:and|the|des|sch) ', '', 'g') AS text FROM texts),
best AS (SELECT doc_id, arg_min(coalesce(alias, word), rank * 1000000 + nth) AS region FROM free JOIN (SELECT *, row_number() OVER (ORDER BY word) AS nth FROM names) n ON contains(text, word) GROUP BY doc_id)
SELECT t.doc_id, region FROM texts t LEFT JOIN best b ON b.doc_id = t.doc_id"""


@query(REGIONS_SQL)
def text_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region of the first gazetteer word, by rank, in each document, without words that stand before a marker."""
    texts = lowered(spark, sf_dir)
    known = gazetteer.gazetteer(cut(names(texts)), letters="[a-z]+")
    return gazetteer.regions_in_text(texts, ["doc_id"], "text", known, "[a-z]+ (?:and|the|des|sch) ")
