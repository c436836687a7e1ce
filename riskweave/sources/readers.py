"""Readers of rules, corpora, models, forms and frames."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from riskweave.functions.text import category_name, fold, form_body
from riskweave.plans.packs import CONTENT_TYPES, EXCLUSION, PATTERN, Exclusion, Pattern

SCAN_CAP = 4 << 20


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a pattern file; an empty regex or an unknown content type fails the read."""
    rows = spark.read.schema(f"patterns array<struct<{_fields(PATTERN)}>>").json(path, multiLine=True).select(F.inline("patterns"))
    known = F.forall(F.coalesce("content_types", F.array()), lambda x: x.isin(*CONTENT_TYPES))
    valid = (F.coalesce("regex", F.lit("")) != "") & known
    category = F.when(F.coalesce("category", F.lit("")) == "", "uncategorized").otherwise(F.col("category"))
    return rows.withColumn("category", category).withColumn("regex", F.when(valid, F.col("regex")).otherwise(F.raise_error(F.concat(F.lit("pattern not valid: "), F.coalesce("name", F.lit("?"))))))


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(f"exclusions array<struct<{_fields(EXCLUSION)}>>").json(path, multiLine=True).select(F.inline("exclusions"))
    bad = (F.col("type") == "regex") & (F.coalesce("pattern", F.lit("")) == "")
    return rows.withColumn("type", F.when(bad, F.raise_error(F.lit("a regex exclusion needs a pattern"))).otherwise(F.col("type")))


def _fields(ddl: str) -> str:
    return ", ".join(re.sub(r"^(\w+) ", r"\1:", x.strip()) for x in ddl.split(","))


def as_patterns(rows: DataFrame) -> list[Pattern]:
    """The rule table as records for the plan; rules are a few hundred at most. Regexes compile here or fail."""
    out = []
    for r in rows.collect():
        re.compile(r.regex)
        values = {k: tuple(v) if isinstance(v, list) else v for k, v in r.asDict().items() if v is not None}
        out.append(Pattern(**values))
    return out


def as_exclusions(rows: DataFrame) -> list[Exclusion]:
    return [Exclusion(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.asDict().items() if v is not None}) for r in rows.collect()]


def read_domains(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of one entry per line -> source_ord, line_ord, category, host, is_wildcard. Blank lines and comments are dropped; the file's name gives the category."""
    out = None
    for i, path in enumerate(paths):
        rows = spark.read.text(path).select(F.lit(i).alias("source_ord"), F.monotonically_increasing_id().alias("line_ord"), category_name(F.col("_metadata.file_name")).alias("category"), fold(F.trim(F.split("value", "#")[0])).alias("entry")).where("entry <> ''")
        rows = rows.select("source_ord", "line_ord", "category", F.regexp_replace("entry", r"^\.", "").alias("host"), F.col("entry").startswith(".").alias("is_wildcard"))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_override(spark: SparkSession, path: str) -> DataFrame:
    """Entries as written: no folding, and only whole-line comments are dropped."""
    return spark.read.text(path).select(F.trim("value").alias("entry")).where("entry <> '' and not startswith(entry, '#')")


#: Fixed: the categories of what an administrator allows and blocks.
ALLOWED, BLOCKED = "allow_admin", "block_admin"


def override_rules(allowed: DataFrame, blocked: DataFrame, source_ord: int) -> DataFrame:
    """Entries of both lists as rules, in the form of read_domains: the allowed ones as source source_ord, the blocked ones as the next. An entry with a leading dot also fits subdomains."""
    out = None
    for k, (category, rows) in enumerate(((ALLOWED, allowed), (BLOCKED, blocked))):
        entry = fold(F.trim("entry"))
        own = rows.where(F.regexp_replace(entry, r"^\.", "") != "").select(F.lit(source_ord + k).alias("source_ord"), F.monotonically_increasing_id().alias("line_ord"), F.lit(category).alias("category"), F.regexp_replace(entry, r"^\.", "").alias("host"), entry.startswith(".").alias("is_wildcard"))
        out = own if out is None else out.unionByName(own)
    return out


CORPUS = "id string, category string, pattern string, content_b64 string, content string, expect_blocked boolean, context string, source string"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines below a folder -> the record with its text; a sample without content fails the read."""
    rows = spark.read.schema(CORPUS).option("recursiveFileLookup", True).json(path)
    text = F.decode(F.unbase64("content_b64"), "utf-8")
    return rows.select("id", "category", "pattern", F.when(F.col("content_b64").isNull(), F.raise_error(F.concat(F.lit("no content: "), F.col("id")))).otherwise(text).alias("text"), "expect_blocked", "context", "source")


def read_samples(spark: SparkSession, path: str, most: int) -> DataFrame:
    """Texts of JSON lines, rows that cannot be read left out, sorted, `most` at the most (the sample's size is a parameter)."""
    rows = spark.read.schema(CORPUS + ", _corrupt_record string").option("mode", "PERMISSIVE").option("recursiveFileLookup", True).json(path)
    text = F.coalesce(F.nullif("content", F.lit("")), F.decode(F.unbase64("content_b64"), "utf-8"))
    return rows.where("_corrupt_record is null").select(text.alias("content")).where("content <> ''").orderBy("content").limit(most)


def read_artefacts(spark: SparkSession, centroids: str) -> DataFrame:
    """dim, tp, tn; vectors of another length than dim fail the read."""
    rows = spark.read.schema("dim int, tp array<float>, tn array<float>").json(centroids, multiLine=True)
    return rows.withColumn("dim", F.when((F.size("tp") == F.col("dim")) & (F.size("tn") == F.col("dim")), F.col("dim")).otherwise(F.raise_error(F.lit("centroids of another length"))))


def read_head(spark: SparkSession, path: str) -> DataFrame:
    """weights and bias of a linear head; one without weights fails the read."""
    rows = spark.read.schema("weights array<float>, bias float").json(path, multiLine=True)
    return rows.withColumn("weights", F.when(F.size("weights") > 0, F.col("weights")).otherwise(F.raise_error(F.lit("a head without weights"))))


PROFILE = "name string, version string, categories map<string,string>, dlp_thresholds struct<critical:int,high:int,medium:int,low:int>"


def read_profile(json: Column) -> Column:
    return F.from_json(json, PROFILE)


def read_manifest(json: Column) -> Column:
    return F.from_json(json, "version string, files array<struct<name:string,sha256:string,url:string>>, signature string")


def capped(content: DataFrame, cap: int = SCAN_CAP) -> tuple[DataFrame, DataFrame]:
    """Contents within the cap, and those over it (to be refused)."""
    small = F.octet_length(F.coalesce("text", F.lit(""))) <= cap
    return content.where(small), content.where(~small)


def first_bytes(text: Column, cap: int = SCAN_CAP) -> Column:
    """The head of a body that is scanned while the rest passes; a cut character is replaced."""
    return F.make_valid_utf8(F.substring(F.encode(text, "utf-8"), 1, cap).cast("string"))


#: Fixed: input types of HTML that hold no plain text. Any other type, or none, counts as text.
NO_TEXT_INPUTS = ("button", "checkbox", "color", "date", "datetime-local", "email", "file", "hidden", "image", "month", "number", "password", "radio", "range", "reset", "submit", "tel", "time", "week")


#: A tag with its attributes; one that is not closed takes the rest, so it is looked at once.
_TAG = re.compile(r"""(?is)<(textarea|input)\b((?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+)(>|\Z)""")
_CLOSE = re.compile(r"(?i)</textarea>")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'<>]++))?""")
#: Fixed: names of characters in texts and values.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
_ENTITY = re.compile("|".join(ENTITIES))


def _attributes(text: str) -> dict[str, str]:
    """Values by lower-case name; the first of a name counts, and one without a value is empty."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), value[1:-1] if value[:1] in ("'", '"') else value)
    return out


def form_texts(html: str) -> list[str]:
    """Texts of a page's form, not empty; see form_text."""
    out, at = [], 0
    while (tag := _TAG.search(html, at)) and tag[3]:
        at = tag.end()
        if tag[1].lower() == "textarea":
            close = _CLOSE.search(html, at)
            text, at = html[at : close.start() if close else len(html)], close.end() if close else len(html)
            out.append(re.sub(r"^\r?\n", "", text))
        else:
            own = _attributes(tag[2])
            out.append("" if own.get("type", "").lower() in NO_TEXT_INPUTS else own.get("value", ""))
    return [_ENTITY.sub(lambda m: ENTITIES[m[0]], x) for x in out if x]


@F.pandas_udf(StringType())
def form_text(html: pd.Series) -> pd.Series:
    """Texts of textareas and of text, search and url inputs, in document order, joined by line ends. Null html has none; a textarea that is not closed reaches to the end, and a tag that is not closed holds nothing."""
    return html.map(lambda x: "\n".join(form_texts(x or "")))


def body_text(kind: Column, text: Column, raw: Column, names: Column, values: Column, cap: int = SCAN_CAP) -> Column:
    """What a request's body says: text as it is, params and form as pairs, bytes decoded up to the cap; any other kind (a stream) and missing parts are empty."""
    params = F.array_join(F.zip_with(names, values, lambda k, v: F.concat(F.url_encode(k), F.lit("="), F.url_encode(v))), "&")
    read = F.make_valid_utf8(F.substring(raw, 1, cap).cast("string"))
    return F.coalesce(F.when(kind == "text", text).when(kind == "params", params).when(kind == "form", form_body(names, values)).when(kind == "bytes", read), F.lit(""))


def frames(messages: DataFrame, cap: int = 1 << 20) -> DataFrame:
    """messages (body binary: a length in four little-endian bytes, then JSON) -> body, size, json; empty, oversized and cut frames have null json."""
    b = lambda i: F.conv(F.hex(F.substring("body", i, 1)), 16, 10).cast("long")
    size = b(1) + b(2) * 256 + b(3) * 65536 + b(4) * 16777216
    good = (F.col("size") > 0) & (F.col("size") <= cap) & (F.octet_length("body") >= F.col("size") + 4)
    return messages.withColumn("size", size).withColumn("json", F.when(good, F.decode(F.substring(F.col("body"), F.lit(5), F.col("size").cast("int")), "utf-8")))
