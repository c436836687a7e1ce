"""The content scan: prefix filter, regex matches with byte offsets, context, score, verdict.

One row per (content, pattern) match comes from one pass over the contents: an automaton finds the
prefixes of all patterns at once, and a pattern's regex runs only on texts that hold its prefix (with
`windowed`: near its places only); no cross join with a rule table. What leaves the pass is a match
with the bytes around it, never the text. For verdicts alone, matches are scored where the text is, and
a row of a few bytes leaves the pass for each content. Plans of both have one size for any number of
patterns; `scored` and `pattern_verdicts` give the same step by step, as columns.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions.text import content_type, entropy, fold
from riskweave.operators import automaton
from riskweave.plans.packs import Exclusion, Pattern, ScanConfig

#: Bytes looked at on both sides of a match where an exclusion names no window.
PROXIMITY = 50
SEVERE = ("critical", "high")
#: Bytes of input that fill a core's share of file splits.
FULL_SPLIT = 128 << 20


def spread(content: DataFrame) -> DataFrame:
    """Deals an input that is too small to fill all cores by its file splits; a larger one is read as it lies, without a shuffle."""
    cores = content.sparkSession.sparkContext.defaultParallelism
    size = int(content._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return content.repartition(cores) if size < cores * FULL_SPLIT else content


def admitted(p: Pattern, cfg: ScanConfig, text: Column, folded: Column, kind: Column) -> Column:
    """Prefix in the folded text, category enabled, content type and size allowed."""
    ok = F.lit((p.category or "uncategorized") not in cfg.disabled)
    if p.prefix:
        ok = ok & F.contains(folded, F.lit(p.prefix.lower()))
    if p.content_types:
        ok = ok & kind.isin(*p.content_types)
    if cfg.large and p.severity not in SEVERE:
        ok = ok & (F.octet_length(text) < cfg.large)
    return ok


def _typed(content: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """content_id, text (null texts are empty), kind."""
    rows = content.select("content_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = content_type(F.col("text")) if any(p.content_types for p in patterns) else F.lit("natural")
    return rows.select("content_id", "text", kind.alias("kind"))


def _folded(content: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """content_id, text, low (folded), kind."""
    return _typed(content, patterns).withColumn("low", fold(F.col("text")))


def candidates(content: DataFrame, patterns: list[Pattern], cfg: ScanConfig | None = None) -> DataFrame:
    """content (content_id, text) -> content_id, pattern, occurrences of the prefix (1 for patterns without)."""
    cfg = cfg or ScanConfig()
    count = lambda p: ((F.length("low") - F.length(F.replace(F.col("low"), F.lit(p.prefix.lower()), F.lit("")))) / len(p.prefix)).cast("long") if p.prefix else F.lit(1).cast("long")
    each = [F.when(admitted(p, cfg, *map(F.col, ("text", "low", "kind"))), F.struct(F.lit(p.name).alias("pattern"), count(p).alias("occurrences"))) for p in patterns]
    return _folded(content, patterns).select("content_id", F.inline(F.array_compact(F.array(*each))))


def severity_guard(found: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """candidates -> content_id, severe: one of them is critical or high, so nothing may cut the scan short."""
    return found.groupBy("content_id").agg(F.bool_or(_by_pattern(patterns, lambda p: F.lit(p.severity in SEVERE), F.lit(False))).alias("severe"))


def _bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _width(patterns: list[Pattern], rules: list[Exclusion]) -> int:
    return max([0, *(p.hotword_window for p in patterns if p.hotwords), *(r.window or PROXIMITY for r in rules if r.type != "regex" and r.match_type != "exact")])


def _found(content: DataFrame, patterns: list[Pattern], cfg: ScanConfig, rules: list[Exclusion]) -> DataFrame:
    """matches, and a row without a pattern for each content that has no match."""
    wide = _width(patterns, rules)
    rows = automaton.found(_typed(content, patterns), patterns, cfg, SEVERE, wide, cfg.windowed)
    return rows.withColumn("before", F.col("before").alias("before", metadata={"window": wide}))


def matches(content: DataFrame, patterns: list[Pattern], cfg: ScanConfig | None = None, rules: list[Exclusion] | None = None) -> DataFrame:
    """content (content_id, text) -> content_id, pattern, value, start, stop (bytes), num_matches, before, after: the folded bytes on each side, as wide as the widest window of patterns and rules. Null texts are empty."""
    return _found(content, patterns, cfg or ScanConfig(), rules or []).where("pattern is not null")


def _side(window: int) -> tuple[Column, Column]:
    """The bytes within the window before and after a match."""
    size = F.octet_length("before")
    return F.substring(F.col("before"), F.greatest(size - window, F.lit(0)) + 1, F.lit(window)), F.substring(F.col("after"), F.lit(1), F.lit(window))


def _words(words: tuple[str, ...]) -> list[str]:
    """Folded and trimmed; blank ones look for nothing."""
    return [w.strip().lower() for w in words if w.strip()]


def hotword_near(p: Pattern) -> Column:
    """A hotword within the window on one side; the match itself is left out. A window of 0 checks nothing."""
    out = F.lit(False)
    if p.hotword_window > 0:
        before, after = _side(p.hotword_window)
        for w in _words(p.hotwords):
            word = F.encode(F.lit(w), "utf-8")
            out = out | F.contains(before, word) | F.contains(after, word)
    return out


def _around(window: int) -> Column:
    """The text within the window, without the first place that holds the match's value (which may stand before the match, too)."""
    before, after = _side(window)
    value = fold(F.col("value"))
    hay = F.concat(before, F.encode(value, "utf-8"), after).cast("string")
    head = F.call_function("substring_index", hay, value, F.lit(1))
    return F.when(value == "", hay).otherwise(F.concat(head, F.substring(hay, F.length(head) + F.length(value) + 1, F.length(hay))))


def _holds_any(hay: Column, words: list[str]) -> Column:
    return _bound(hay, lambda h: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(h, w)))


def excluded(p: Pattern, rules: list[Exclusion]) -> tuple[Column, Column]:
    """(suppressed, penalised) for a match of the pattern."""
    suppressed, penalised = F.lit(False), F.lit(False)
    for r in rules:
        if r.applies_to not in ("", "*") and r.applies_to.lower() != p.name.lower():
            continue
        if r.type == "regex":
            hit = F.col("value").rlike(r.pattern)
            suppressed, penalised = (suppressed | hit, penalised) if r.suppress else (suppressed, penalised | hit)
        elif r.match_type == "exact":
            suppressed = suppressed | fold(F.col("value")).isin([w.strip().lower() for w in r.words])
        elif words := _words(r.words):
            penalised = penalised | _holds_any(_around(r.window or PROXIMITY), words)
    return suppressed, penalised


def _by_pattern(patterns: list[Pattern], of, other: Column) -> Column:
    """A column that differs by the row's pattern."""
    out = None
    for p in patterns:
        test = F.col("pattern") == p.name
        out = F.when(test, of(p)) if out is None else out.when(test, of(p))
    return other if out is None else out.otherwise(other)


def scored(found: DataFrame, patterns: list[Pattern], rules: list[Exclusion], cfg: ScanConfig | None = None) -> DataFrame:
    """matches (made with the same patterns and rules) -> with hotword, entropy, suppressed, penalised and score. A column `ml_score` in found enters borderline scores."""
    cfg = cfg or ScanConfig()
    if found.schema["before"].metadata.get("window", 0) < _width(patterns, rules):
        raise ValueError("the matches were cut with smaller windows than these rules ask for")
    has_ml = "ml_score" in found.columns
    keep = [c for c in ("content_id", "pattern", "value", "start", "stop", "num_matches", *(["ml_score"] if has_ml else []))]
    rows = found.select(
        *keep,
        _by_pattern(patterns, hotword_near, F.lit(False)).alias("hotword"),
        entropy(F.col("value")).alias("entropy"),
        _by_pattern(patterns, lambda p: excluded(p, rules)[0], F.lit(False)).alias("suppressed"),
        _by_pattern(patterns, lambda p: excluded(p, rules)[1], F.lit(False)).alias("penalised"),
    )

    def of(p: Pattern) -> Column:
        base = p.score_weight if p.score_weight > 0 else 1
        s = F.lit(base) + F.when(F.col("hotword"), p.hotword_boost or cfg.hotword).otherwise(0)
        if p.entropy_min > 0:
            s = s + F.when(F.col("entropy") >= p.entropy_min, cfg.entropy_boost).otherwise(cfg.entropy_penalty)
        return s

    score = _by_pattern(patterns, of, F.lit(1)) + F.lit(cfg.multi_match) * F.least(F.col("num_matches") - 1, F.lit(5)) + F.when(F.col("penalised"), cfg.exclusion).otherwise(0)
    if has_ml and cfg.ml > 0:
        limit = threshold(patterns, cfg)
        near = (F.col("ml_score") != 0) & (limit > 0) & (F.abs(score - limit) <= 1)
        score = score + F.when(near, F.greatest(F.lit(-cfg.ml), F.least(F.lit(cfg.ml), F.round(F.col("ml_score") * cfg.ml)))).otherwise(0)
    return rows.withColumn("score", score.cast("long"))


def threshold(patterns: list[Pattern], cfg: ScanConfig) -> Column:
    return _by_pattern(patterns, lambda p: F.lit(cfg.thresholds.get(p.severity.strip().lower(), cfg.thresholds["low"])), F.lit(cfg.thresholds["low"]))


def pattern_verdicts(rows: DataFrame, patterns: list[Pattern], cfg: ScanConfig | None = None) -> DataFrame:
    """scored -> content_id, pattern, num_matches, score (best unsuppressed; null: none), blocked."""
    cfg = cfg or ScanConfig()
    out = rows.groupBy("content_id", "pattern").agg(F.max("num_matches").alias("num_matches"), F.max(F.when(~F.col("suppressed"), F.col("score"))).alias("score"), F.bool_or(F.col("hotword") & ~F.col("suppressed")).alias("any_hotword"))
    enough = _by_pattern(patterns, lambda p: F.col("num_matches") >= max(p.min_matches, 0), F.lit(True))
    hot = _by_pattern(patterns, lambda p: F.col("any_hotword") if p.require_hotword else F.lit(True), F.lit(True))
    return out.select("content_id", "pattern", "num_matches", "score", F.coalesce(F.col("pattern").isNotNull() & enough & hot & (F.col("score") >= threshold(patterns, cfg)), F.lit(False)).alias("blocked"))


def entropy_of(value: bytes) -> float:
    n = len(value)
    return round(-sum(c / n * math.log2(c / n) for _, c in sorted(Counter(value).items())), 12) + 0.0 if n else 0.0


class Scorer:
    """Scores of a text's matches by the rules of scored and pattern_verdicts, where the text is."""

    def __init__(self, patterns: list[Pattern], rules: list[Exclusion], cfg: ScanConfig):
        self.rules = automaton.Rules(patterns, cfg, SEVERE, 0, cfg.windowed)
        self.patterns, self.cfg = self.rules.patterns, cfg
        self.regexes = self.rules.regexes()
        self.exclusions = [[(r, automaton.compiled(r.pattern) if r.type == "regex" else None, [w.encode() for w in _words(r.words)]) for r in rules if r.applies_to in ("", "*") or r.applies_to.lower() == p.name.lower()] for p in self.patterns]
        self.hotwords = [[w.encode() for w in _words(p.hotwords)] for p in self.patterns]

    def _excluded(self, j: int, low: bytes, start: int, stop: int, value: str) -> tuple[bool, bool]:
        suppressed = penalised = False
        own = low[start:stop]
        for r, regex, words in self.exclusions[j]:
            if regex is not None:
                hit = regex.search(value) is not None
                suppressed, penalised = (suppressed or hit, penalised) if r.suppress else (suppressed, penalised or hit)
            elif r.match_type == "exact":
                suppressed = suppressed or own in words
            elif words:
                wide = r.window or PROXIMITY
                hay = low[max(start - wide, 0) : stop + wide]
                head, _, tail = hay.partition(own) if own else (hay, b"", b"")
                penalised = penalised or any(w in head + tail for w in words)
        return suppressed, penalised

    def _score(self, j: int, low: bytes, text: bytes, start: int, stop: int, n: int) -> tuple[int, bool] | None:
        """Score and whether a hotword is near; None for a match that is suppressed."""
        p, cfg, value = self.patterns[j], self.cfg, text[start:stop]
        suppressed, penalised = self._excluded(j, low, start, stop, value.decode("utf-8", "replace"))
        if suppressed:
            return None
        sides = (low[max(start - p.hotword_window, 0) : start], low[stop : stop + p.hotword_window]) if p.hotword_window > 0 else ()
        hot = any(w in side for side in sides for w in self.hotwords[j])
        score = p.score_weight if p.score_weight > 0 else 1
        score += (p.hotword_boost or cfg.hotword) if hot else 0
        if p.entropy_min > 0:
            score += cfg.entropy_boost if entropy_of(value) >= p.entropy_min else cfg.entropy_penalty
        return score + cfg.multi_match * min(n - 1, 5) + (cfg.exclusion if penalised else 0), hot

    def verdicts(self, texts: list[bytes], kinds: list[str]) -> Iterator[tuple[bool, str, int]]:
        """blocked, pattern and score of each text."""
        best: dict[int, tuple[int, str]] = {}
        for i, j, ranges in self.rules.found(texts, kinds, self.regexes):
            p, low = self.patterns[j], texts[i].lower()
            scores = [s for a, b in ranges if (s := self._score(j, low, texts[i], a, b, len(ranges))) is not None]
            limit = self.cfg.thresholds.get(p.severity.strip().lower(), self.cfg.thresholds["low"])
            if not scores or len(ranges) < max(p.min_matches, 0) or p.require_hotword and not any(h for _, h in scores):
                continue
            score = max(s for s, _ in scores)
            if score >= limit:
                best[i] = min(best.get(i, (math.inf, "")), (-score, p.name))
        for i in range(len(texts)):
            yield (True, best[i][1], -best[i][0]) if i in best else (False, "", 0)


def scan(content: DataFrame, patterns: list[Pattern], rules: list[Exclusion], cfg: ScanConfig | None = None) -> DataFrame:
    """content (content_id, text) -> content_id, blocked, pattern_name, score: the best blocked pattern, by score and then name; no match: not blocked, '', 0. Repeated ids give one row, the best of theirs."""
    held = content.sparkSession.sparkContext.broadcast(Scorer(patterns, rules, cfg or ScanConfig()))
    kind = content.schema["content_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held.value
        for batch in automaton.batches_of(batches, "text"):
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            blocked, name, score = zip(*scorer.verdicts(texts, batch.column("kind").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("content_id"), pa.array(blocked), pa.array(name, pa.string()), pa.array(score, pa.int64())], ["content_id", "blocked", "pattern_name", "score"])

    rows = _typed(content, patterns).mapInArrow(run, f"content_id {kind}, blocked boolean, pattern_name string, score long")
    best = F.min(F.struct((~F.col("blocked")).alias("no"), (-F.col("score")).alias("s"), F.col("pattern_name").alias("p"))).alias("b")
    return rows.groupBy("content_id").agg(best).select("content_id", (~F.col("b.no")).alias("blocked"), F.col("b.p").alias("pattern_name"), (-F.col("b.s")).alias("score"))


def scan_distinct(content: DataFrame, patterns: list[Pattern], rules: list[Exclusion], cfg: ScanConfig | None = None) -> DataFrame:
    """scan, but equal texts are scanned once, by their digest: content_id, digest, and the verdict."""
    keyed = content.select("content_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    once = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    verdicts = scan(once.select(F.col("digest").alias("content_id"), "text"), patterns, rules, cfg).withColumnRenamed("content_id", "digest")
    return keyed.select("content_id", "digest").join(verdicts, "digest")
