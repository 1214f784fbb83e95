"""The registered queries of this subpackage: thin calls of the operators on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import bpe, bt_quality, decontamination, gru_language, importance, jaccard_join, kn_toxicity, license_scan, line_dedup, merkle_manifest, ngram_llr, suffix_dedup, token_counts
from waymark.llm.common import BLANKS, LOWER, UPPER, bucket_of_id, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.by_section(table(spark, sf_dir, "documents"), ["doc_id"])


def op2_bt_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = bt_quality.rank_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (bucket_of_id(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "rank_score")


def op3_ngram_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_llr.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 1"))


def op4_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.per_document(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id"])


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.per_document(table(spark, sf_dir, "documents"))


def op8_kn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = kn_toxicity.fit(documents, table(spark, sf_dir, "labels"), kn_toxicity.learnable())
    scored = kn_toxicity.score(documents, model, ["doc_id"])
    return scored.select("doc_id", (bucket_of_id(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted", *kn_toxicity.EVIDENCE)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"))


def op10_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    fold = bucket_of_id(F.col("doc_id"), 4)
    net = gru_language.fit(documents, fold != 2)
    return gru_language.identify(documents, net, ["doc_id"]).select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed(table(spark, sf_dir, "documents"), ["doc_id"], kept=False)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    fields = {c: F.col(c) for c in merkle_manifest.FIELDS}
    bent = F.when(bucket_of_id(F.col("doc_id"), 2) == 0, merkle_manifest.leaf(fields | {"text": F.replace("text", F.lit("\n"), F.lit(""))}))
    manifest = merkle_manifest.build(documents, "source", ["doc_id"], merkle_manifest.leaf(fields), {"doc_id": F.col("doc_id"), "bent": bent})
    found = manifest.proofs().withColumn("folded_root", merkle_manifest.folded(F.coalesce("bent", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", merkle_manifest.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:2] == "op" and name[2:3].isdigit()}


def shingles_sql(words: str) -> str:
    """The distinct 5-word shingles of a list of words; the whole sequence of a shorter one."""
    runs = f"list_distinct(list_transform(range(1, len({words}) - 3), lambda i: array_to_string({words}[i:i + 4], ' ')))"
    return f"CASE WHEN len({words}) = 0 THEN [] WHEN len({words}) < 5 THEN [array_to_string({words}, ' ')] ELSE {runs} END"


WORDS_SQL = f"list_filter(regexp_split_to_array(translate({{text}}, '{UPPER}', '{LOWER}'), '{BLANKS}'), lambda w: w <> '')"

#: Sets of equal tokens meet as one, by the first line that has them.
LINES_SQL = f"""WITH lines AS (SELECT doc_id, unnest(range(len(x))) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL) z),
  sets AS (SELECT doc_id, line_no, list_sort({shingles_sql("w")}) AS s FROM (SELECT doc_id, line_no, {WORDS_SQL.format(text="line")} AS w FROM lines) z WHERE len(w) > 0),
  ranked AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS k, row_number() OVER (PARTITION BY s ORDER BY doc_id, line_no) AS nth FROM sets),
  tokens AS (SELECT k, len(s) AS n, unnest(s) AS token FROM ranked WHERE nth = 1),
  pairs AS (SELECT a.k, any_value(a.n) AS n, any_value(b.n) AS n_0, count(*) AS both_have FROM tokens a JOIN tokens b ON a.token = b.token AND b.k < a.k GROUP BY a.k, b.k),
  gone AS (SELECT doc_id, line_no FROM ranked WHERE nth > 1 OR k IN (SELECT k FROM pairs WHERE 4 * both_have >= 3 * (n + n_0 - both_have))),
  per_document AS (SELECT doc_id, count(*) AS n, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed FROM documents d LEFT JOIN per_document g ON g.doc_id = d.doc_id"""

LINKS_SQL = f"""WITH RECURSIVE sets AS (SELECT doc_id, {shingles_sql("w")} AS s FROM (SELECT doc_id, coalesce({WORDS_SQL.format(text="text")}, []) AS w FROM documents) z),
  tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM sets),
  pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS both_have FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  links AS (SELECT a, b FROM pairs WHERE 100 * both_have >= 75 * (na + nb - both_have)),
  reached AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) z ON a = doc_id"""


#: The 256 steps of crc32, and the crc32 of a text (its bytes as hex digits in the column `hex`).
STEPS_SQL = "steps AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t)"
CRC_SQL = "xor(list_reduce(list_prepend(4294967295, list_transform(range(len(hex) // 2), lambda i: ('0x' || substr(hex, (2 * i + 1)::BIGINT, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
RUNS_SQL = f"unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w"

RESAMPLE_SQL = f"""WITH {STEPS_SQL}, own AS (SELECT doc_id, {RUNS_SQL} FROM documents), target AS (SELECT {RUNS_SQL} FROM benchmark),
  known AS (SELECT w, {CRC_SQL} % 10000 AS bucket FROM (SELECT w, hex(encode(w)) AS hex FROM (SELECT w FROM own UNION SELECT w FROM target) z) y, steps),
  s AS (SELECT bucket, count(*) AS n FROM own JOIN known USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM target JOIN known USING (w) GROUP BY bucket),
  gains AS (SELECT k AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM own) + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM target) + 10000))))::BIGINT AS gain
    FROM (SELECT unnest(range(10000)) AS k) b LEFT JOIN s ON s.bucket = k LEFT JOIN t ON t.bucket = k),
  weights AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM own JOIN known USING (w) JOIN gains USING (bucket) GROUP BY doc_id),
  scored AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM documents d LEFT JOIN weights w ON w.doc_id = d.doc_id),
  ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20 QUALIFY rank <= 10 * count(*) OVER () // 100)
SELECT s.doc_id, n_features, weight, score, rank FROM scored s LEFT JOIN ranked r ON r.doc_id = s.doc_id"""


def _framed(*fields: str) -> str:
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in fields) + ")"


def _tree_sql(name: str, leaves: str) -> str:
    """name: the nodes (tree, lvl, place, h, n) over leaves of the same columns; name_runs: each run's children, by the tree, their level and the run."""
    return f"""{name} AS (SELECT tree, 0 AS lvl, place, h, n FROM {leaves} UNION ALL SELECT tree, lvl + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), (max(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY tree, lvl, place // 3),
  {name}_runs AS (SELECT tree, lvl, place // 3 AS run, list(h ORDER BY place) AS hs FROM {name} WHERE n > 1 GROUP BY tree, lvl, place // 3)"""


def _walk_sql(name: str, start: str, runs: str) -> str:
    """name: start (doc_id, tree, lvl, place, acc, proof) and each step from there to the top."""
    before, after = "array_to_string(hs[:place % 3], '')", "array_to_string(hs[place % 3 + 2:], '')"
    return f"""{name} AS (SELECT doc_id, tree, lvl, place, acc, proof FROM {start} UNION ALL SELECT doc_id, w.tree, w.lvl + 1, place // 3, sha256({before} || acc || {after}), proof || {before} || {after}
    FROM {name} w JOIN {runs} r ON r.tree = w.tree AND r.lvl = w.lvl AND r.run = w.place // 3)"""


MANIFEST_SQL = f"""WITH RECURSIVE {STEPS_SQL}, crcs AS (SELECT doc_id, {CRC_SQL} AS crc FROM (SELECT DISTINCT doc_id, hex(encode(doc_id::VARCHAR)) AS hex FROM documents) z, steps),
  sources AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents) z),
  leaves AS (SELECT d.doc_id, tree, row_number() OVER (PARTITION BY tree ORDER BY d.doc_id) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n, {_framed("d.doc_id", "d.source", "lang", "n_chars", "text")} AS h,
    CASE WHEN crc % 2 = 0 THEN {_framed("d.doc_id", "d.source", "lang", "n_chars", "replace(text, chr(10), '')")} END AS bent FROM documents d JOIN crcs USING (doc_id) JOIN sources s ON s.source IS NOT DISTINCT FROM d.source),
  {_tree_sql("nodes", "leaves")},
  subroots AS (SELECT 0::BIGINT AS tree, tree AS place, h, count(*) OVER () AS n FROM nodes WHERE n = 1),
  {_tree_sql("top", "subroots")},
  start AS (SELECT doc_id, tree, 0 AS lvl, place, coalesce(bent, h) AS acc, '' AS proof FROM leaves),
  {_walk_sql("walk", "start", "nodes_runs")},
  low AS (SELECT doc_id, 0::BIGINT AS tree, 0 AS lvl, tree AS place, acc, proof FROM walk QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lvl DESC) = 1),
  {_walk_sql("climb", "low", "top_runs")},
  done AS (SELECT * FROM climb QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lvl DESC) = 1)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = r.h AS verified
FROM leaves l JOIN subroots s ON s.place = l.tree JOIN done d ON d.doc_id = l.doc_id, (SELECT h FROM top WHERE n = 1) r"""


def oracle_sql() -> dict[str, str]:
    """Twins of the queries that DuckDB can express; the others need trained weights, merges or every window of every text."""
    return {"op7_line_dedup": LINES_SQL, "op9_jaccard_join": LINKS_SQL, "op11_importance_resample": RESAMPLE_SQL, "op13_merkle_manifest": MANIFEST_SQL}
