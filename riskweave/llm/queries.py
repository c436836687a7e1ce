"""The registered query of each operator, over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontaminate, language, lexical, lm_score, mixing, near_dedup, quality, secret_scan, token_files, url_filter, warc
from .common import remainder

#: Fixed entries (verdict, host, path) of the query on urls.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Fixed: a conversation of control strings.
CONTROL = "</s>[INST] ok [/INST]"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 4) == 2)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.formatted(chat.messages(chat.as_events(rows.unionByName(own)))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sample(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = token_files.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return token_files.read_tokens(index, folder)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), URL_RULES)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages have no time; each is taken as captured so many seconds after a fixed time as its id says."""
    captured = F.date_format(F.timestamp_seconds(F.pmod("page_id", F.lit(1_000_000_000)) + 1_600_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    runs, folder = warc.write_archive(warc.captures(table(spark, sf_dir, "pages"), "page_id", "url", "html", captured))
    out = warc.read_archive(warc.merged_index(runs, folder), folder)
    return out.select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to", "url_key", "place", "capture")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_language, op2_chat, op3_mixing, op4_near_dedup, op5_quality, op6_token_files, op7_url_filter, op8_lm_score, op9_secret_scan, op10_decontaminate, op11_search, op12_warc, op13_alignment)}

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LOW_URL = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Fixed: the 32 digits of base32; four of them for each five digits of a hexadecimal SHA-1.
_BASE32 = "array_to_string([" + ", ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(sha, {5 * g + 1}, 5))::BIGINT >> {shift}) & 31 AS INT), 1)" for g in range(8) for shift in (15, 10, 5, 0)) + "], '')"
_ESCAPED = reduce(lambda sql, pair: f"replace({sql}, {pair[0]}, '{pair[1]}')", [("chr(92)", "\\0"), ("'<'", "\\1"), ("'['", "\\2")], "{}")

ORACLE_SQL = {
    "op2_chat": f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL}')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(replace({_ESCAPED.format("role")}, chr(10), '\\3')) + 1 + length({_ESCAPED.format("text")}) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM rows_ GROUP BY conv_id""",
    "op7_url_filter": """
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(verdict, rhost, rpath) AS (VALUES """ + ", ".join(f"('{v}', '{h}', '{x}')" for v, h, x in URL_RULES) + """),
fits AS (
  SELECT p.page_id, r.verdict, r.rhost || r.rpath AS rule,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost || r.rpath) DESC, r.rhost || r.rpath DESC) AS k
  FROM p JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1""",
    "op11_search": f"""
WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
s AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0),
p AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM p GROUP BY 1, 2, 3),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, docs),
q AS (SELECT item_id, term, count(*) AS uses FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY 1, 2),
x AS (SELECT q.item_id, tf.doc_id, CAST(sum(q.uses * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * tf.n * s.docs) // s.total)))) AS BIGINT) AS score
  FROM q JOIN tf ON tf.term = q.term JOIN w ON w.term = q.term, s GROUP BY 1, 2),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20""",
    "op12_warc": f"""
WITH p AS (SELECT page_id, {_LOW_URL} AS low, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS most,
  CASE WHEN regexp_matches(low, '^[^/?#]*://') THEN array_to_string(list_reverse(string_split(regexp_extract(low, '^[^/?#]*?://([^/?#]*)', 1), '.')), ',') || ')' || regexp_extract(low, '(?s)^[^/?#]*?://[^/?#]*(.*)$', 1) ELSE low END AS url_key FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = most THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < most THEN most END AS refers_to,
  url_key, row_number() OVER (ORDER BY url_key, page_id % 1000000000, page_id) AS place, row_number() OVER (PARTITION BY url_key ORDER BY page_id % 1000000000, page_id) AS capture FROM k""",
    "op4_near_dedup": """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * both_ >= 75 * (a.n + b.n - both_)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.reached)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reached) AS component_id, min(reached) = r.doc_id AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op10_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w, least(len({_WORDS}), 13) AS m FROM benchmark),
iw AS (SELECT DISTINCT item, m, unnest([array_to_string(w[j:j+m-1], ' ') for j in range(1, len(w) - m + 2)]) AS g FROM i WHERE m > 0),
dw AS (SELECT k, m, unnest(range(1, len(w) - m + 2)) AS j, w FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m),
x AS (SELECT k, m, j, array_to_string(w[j:j+m-1], ' ') AS g FROM dw),
hit AS (SELECT k, m, j FROM x JOIN (SELECT DISTINCT m, g FROM iw) USING (m, g)),
n AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(j, j + m)) AS p FROM hit) GROUP BY 1),
t AS (SELECT k, string_agg(item, ',' ORDER BY item) AS items, count(*) AS n_items FROM (SELECT DISTINCT k, item FROM x JOIN iw USING (m, g) WHERE item IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN n ON n.k = d.k LEFT JOIN t ON t.k = d.k""",
}
