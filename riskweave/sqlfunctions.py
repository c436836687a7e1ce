"""The scan as functions of Spark SQL.

    register(spark)
    spark.sql("SELECT * FROM scan_text(TABLE(SELECT doc_id, text FROM documents))")
    spark.sql("SELECT classify(text), entropy(url), host_of(url) FROM ...")

`classify`, `entropy` and `host_of` are SQL functions, so the optimizer puts their bodies in place. `scan_text` is a
table function on a table of two columns, an id of any type and a text: for each row the id, blocked, pattern_name
and score, the same as the scan of a DataFrame gives. Its rows are taken in blocks of bounded size, each through one
automaton for all patterns.

Cases: null texts are empty and not blocked; repeated ids give a row each; other columns of the table are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import BooleanType, LongType, StringType, StructType

from riskweave.functions.text import CODE_START, KV_START, LOWER, UPPER
from riskweave.operators import automaton, scan
from riskweave.plans.packs import EXCLUSIONS, PATTERNS, Exclusion, Pattern, ScanConfig


def scan_text(patterns: list[Pattern] | None = None, rules: list[Exclusion] | None = None, cfg: ScanConfig | None = None):
    """The table function for a pack. Patterns with content types need the text's class, which a table function has not: they are refused."""
    patterns, rules, cfg = PATTERNS if patterns is None else patterns, EXCLUSIONS if rules is None else rules, cfg or ScanConfig()
    if any(p.content_types for p in patterns):
        raise ValueError("patterns with content types need scan.scan")

    class ScanText:
        def __init__(self):
            self.scorer, self.ids, self.texts, self.size = scan.Scorer(patterns, rules, cfg), [], [], 0

        @staticmethod
        def analyze(content: AnalyzeArgument) -> AnalyzeResult:
            if not content.isTable or len(content.dataType.fields) < 2:
                raise ValueError("scan_text takes a table of an id and a text")
            id_ = content.dataType.fields[0]
            return AnalyzeResult(StructType().add(id_.name, id_.dataType).add("blocked", BooleanType()).add("pattern_name", StringType()).add("score", LongType()))

        def eval(self, row):
            text = (row[1] or "").encode()
            self.ids.append(row[0])
            self.texts.append(text)
            self.size += len(text)
            if self.size >= automaton.SLICE or len(self.ids) >= 10_000:
                yield from self._told()

        def terminate(self):
            yield from self._told()

        def _told(self):
            ids, texts = self.ids, self.texts
            self.ids, self.texts, self.size = [], [], 0
            for i, said in zip(ids, self.scorer.verdicts(texts, ["natural"] * len(texts)), strict=True):
                yield (i, *said)

    return udtf(ScanText)


_LINE = r"(?m)^[ \t\f\r]*"
_TEXT = "coalesce(t, '')"
_COMMAS = rf"filter(transform(split({_TEXT}, '\n', -1), x -> length(x) - length(replace(x, ',', ''))), n -> n > 0)"
_CODES = "filter(split(hex(encode(v, 'utf-8')), r'(?<=\\G..)'), x -> x <> '')".replace("\\\\", "\\")
_SPACE = f"(length({_TEXT}) - length(translate({_TEXT}, ' \\t', '')))"
FUNCTIONS = [
    f"""classify(t STRING) RETURNS STRING RETURN CASE
  WHEN regexp_count({_TEXT}, r'{_LINE}{CODE_START}') >= 2 THEN 'code'
  WHEN contains({_TEXT}, '{{') AND contains({_TEXT}, '}}') AND (contains({_TEXT}, '":') OR contains({_TEXT}, '" :')) THEN 'structured'
  WHEN size({_COMMAS}) >= 3 AND array_min({_COMMAS}) = array_max({_COMMAS}) THEN 'structured'
  WHEN regexp_count({_TEXT}, r'{_LINE}{KV_START}') >= 3 AND {_SPACE} < 0.18D * length({_TEXT}) THEN 'credentials'
  ELSE 'natural' END""",
    f"""entropy(v STRING) RETURNS DOUBLE RETURN CASE WHEN octet_length(v) > 0 THEN
  round(aggregate(transform(array_sort(array_distinct({_CODES})), b -> size(filter({_CODES}, x -> x = b)) / octet_length(v)), 0D, (h, p) -> h - p * log2(p)), 12) ELSE 0D END""",
    f"""host_of(u STRING) RETURNS STRING RETURN regexp_extract(regexp_replace(translate(trim(u), '{UPPER}', '{LOWER}'), r'^[a-z][a-z0-9+.-]*://', ''), r'^([^/?#]*)', 1)""",
]


def register(spark: SparkSession, patterns: list[Pattern] | None = None, rules: list[Exclusion] | None = None, cfg: ScanConfig | None = None) -> None:
    """Makes the functions known to the session."""
    for text in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
    spark.udtf.register("scan_text", scan_text(patterns, rules, cfg))
