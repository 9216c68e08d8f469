"""The numbered queries over the synthetic tables, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_conversations, read_back
from .decontamination import decontaminate, hit_words
from .html_text import extract_text
from .language_id import fit_unigrams, identify_language
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .quality_classifier import fit_quality, score_quality
from .quality_rules import quality_rules
from .substring_dedup import substring_dedup
from .url_filter import url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"), min_words=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"), weights=(3, 1, 2), total=1.5, max_epochs=2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return out.select(
        "doc_id",
        "n_words",
        hit_words(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


#: Two turns that say what the template says, to show that it reads back.
TRICKY = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(TRICKY, "conv_id long, turn long, role string, text string"))
    return read_back(format_conversations(turns, budget=1024, history=256))


RULES = """
SELECT * FROM VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block') AS rules(host, path, action)
"""


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), spark.sql(RULES)).select("page_id", "host", "path", "rule", "verdict")


def alias_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URL filter with a crawl log: pages in runs of eight, each redirected to the one before it or its canonical link."""
    pages = table(spark, sf_dir, "pages")
    after = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("b"))
    log = pages.filter("(page_id + 1) % 8 <> 0").select("page_id", F.col("url").alias("a")).join(after, "page_id").select("a", "b")
    return url_filter(pages, spark.sql(RULES), log).select("page_id", "verdict", "by_alias")


def _crc(by: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % by


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_unigrams(docs.filter(_crc(3) != 1), max_docs=1000)
    return identify_language(docs, model).select("doc_id", (_crc(3) == 1).alias("held_out"), "lang_pred", "score")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(_crc(5) != 0).select("doc_id", F.col("quality").alias("label"))
    scored = score_quality(docs, fit_quality(docs, labels, max_rows=20_000))
    return scored.select("doc_id", (_crc(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_mixing": op2_mixing,
    "op3_decontamination": op3_decontamination,
    "op4_near_dedup": op4_near_dedup,
    "op5_chat_format": op5_chat_format,
    "op6_url_filter": op6_url_filter,
    "alias_verdicts": alias_verdicts,
    "op7_language_id": op7_language_id,
    "op8_quality_rules": op8_quality_rules,
    "op9_html_text": op9_html_text,
    "op10_quality_classifier": op10_quality_classifier,
}

ORACLES: dict[str, str] = {}

ORACLES["op1_substring_dedup"] = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20)
), copies AS (
  SELECT doc_id, i FROM windows
  QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM copies, (SELECT unnest(range(0, 20)) AS k)
), word AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM words
), kept AS (
  SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.i) AS t, count(*) AS n
  FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i GROUP BY word.doc_id
)
SELECT words.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM words LEFT JOIN kept ON words.doc_id = kept.doc_id
"""

ORACLES["op3_decontamination"] = r"""
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), item AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), phrase AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)
), place AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM phrase) WHERE len(w) >= n)
), match AS (
  SELECT place.doc_id, place.i, place.n, phrase.item_id FROM place JOIN phrase ON place.n = phrase.n AND place.g = phrase.g
), hit AS (
  SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM match) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM match) GROUP BY doc_id
)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
       sha256(coalesce(named.items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit ON doc.doc_id = hit.doc_id LEFT JOIN named ON doc.doc_id = named.doc_id
"""

ORACLES["op4_near_dedup"] = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(w[i:i + 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM doc WHERE len(w) >= 2)
    UNION ALL SELECT doc_id, w[1] FROM doc WHERE len(w) = 1)
), size AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS f FROM shingle GROUP BY doc_id
), class AS (
  SELECT f, min(doc_id) AS rep, any_value(n) AS n FROM size GROUP BY f
), own AS (
  SELECT shingle.doc_id, g, n FROM shingle JOIN class ON shingle.doc_id = class.rep
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM own a JOIN own b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edge AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (
  SELECT rep AS a, rep AS b FROM class UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a
), component AS (
  SELECT a, min(b) AS c FROM reach GROUP BY a
)
SELECT doc.doc_id, coalesce(size.n, 0)::BIGINT AS n_shingles, coalesce(component.c, doc.doc_id) AS component_id,
       coalesce(component.c, doc.doc_id) = doc.doc_id AS kept
FROM doc LEFT JOIN size ON doc.doc_id = size.doc_id LEFT JOIN class ON size.f = class.f LEFT JOIN component ON class.rep = component.a
"""

_URL_RULES = """url AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail
  FROM (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), rule AS (
  SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS t(h, p, action)
), best AS (
  SELECT page_id, h || p AS rule, action FROM url JOIN rule ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, action) = 1
)"""

# pages of these tables have no redirects or canonical links, so without a rule every url is allowed
ORACLES["op6_url_filter"] = f"""
WITH {_URL_RULES}
SELECT url.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM url LEFT JOIN best ON url.page_id = best.page_id
"""

ORACLES["alias_verdicts"] = f"""
WITH RECURSIVE {_URL_RULES}, node AS (
  SELECT url.page_id, host || tail AS node, action FROM url LEFT JOIN best ON url.page_id = best.page_id
), link AS (
  SELECT a.node AS a, b.node AS b FROM node a JOIN node b ON b.page_id = a.page_id + 1 WHERE (a.page_id + 1) % 8 <> 0 AND a.node <> '' AND b.node <> ''
), edge AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (
  SELECT a, a AS b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a
), decided AS (
  SELECT reach.a, bool_or(action = 'allow') AS ok FROM reach JOIN node ON node.node = reach.b WHERE action IS NOT NULL GROUP BY reach.a
)
SELECT page_id, coalesce(action, CASE WHEN ok THEN 'allow' WHEN NOT ok THEN 'block' END, 'allow') AS verdict, action IS NULL AND ok IS NOT NULL AS by_alias
FROM node LEFT JOIN decided ON node.node = decided.a
"""
