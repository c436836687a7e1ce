"""The same results in SQL. Rules enter as literals made from the same records as the plans."""

from __future__ import annotations

from riskweave.plans.packs import DOMAINS, EXCLUSIONS, PATTERNS, POLICIES, ScanConfig

CFG = ScanConfig()
#: Fixed values, written out here once more so that a change of the plans' own shows.
CODE_START = r"(import\s+\S|from\s+\S+\s+import\s|def\s+\w+|class\s+\w+|function\s+\w+|const\s+\w+\s*=|let\s+\w+\s*=|var\s+\w+\s*=|#include\s*[<\"]|package\s+\w+|fn\s+\w+\(|public\s+class)"
KV_START = r"[A-Za-z_][A-Za-z0-9_.\-]*\s*[:=]\s*\S"
RISKY_EXTENSIONS = "exe scr com pif msi msp mst appx appxbundle msix bat cmd vbs vbe wsf wsh ps1 psm1 psd1 sh dll sys reg app pkg dmg deb rpm jar class iso img vhd vhdx".split()
BUDGET = {"fp_rate": 0.05, "fn_rate": 0.03, "category_fn_rate": 0.10}
RECALL_DROP, FP_RISE = 0.02, 0.01
_LINE = r"(?m)^\s*"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def fold(x: str) -> str:
    return f"translate({x}, '{_UP}', '{_LOW}')"


def hexed(word: str) -> str:
    return q(word.lower().encode().hex().upper())


def kind(t: str) -> str:
    commas = f"[n for n in [length(x) - length(replace(x, ',', '')) for x in string_split({t}, chr(10))] if n > 0]"
    return f"""CASE WHEN len(regexp_extract_all({t}, {q(_LINE + CODE_START)})) >= 2 THEN 'code'
 WHEN (contains({t}, '{{') AND contains({t}, '}}') AND (contains({t}, '":') OR contains({t}, '" :')))
   OR (len({commas}) >= 3 AND list_min({commas}) = list_max({commas})) THEN 'structured'
 WHEN len(regexp_extract_all({t}, {q(_LINE + KV_START)})) >= 3 AND (length({t}) - length(replace(replace({t}, ' ', ''), chr(9), ''))) < 0.18 * length({t}) THEN 'credentials'
 ELSE 'natural' END"""


def admitted(p, large: int = CFG.large) -> str:
    tests = ["TRUE"]
    if p.prefix:
        tests.append(f"contains({fold('text')}, {q(p.prefix.lower())})")
    if p.severity not in ("critical", "high"):
        tests.append(f"strlen(text) < {large}")
    return " AND ".join(tests)


def matches(table: str = "documents", key: str = "doc_id", large: int = CFG.large) -> str:
    """CTE hits(content_id, pattern, value, start, stop, num_matches, h: hex of the folded text)."""
    parts = []
    for p in PATTERNS:
        parts.append(f"""SELECT content_id, {q(p.name)} AS pattern, text, regexp_extract_all(text, {q(p.regex)}) AS v, regexp_split_to_array(text, {q(p.regex)}) AS g FROM c WHERE {admitted(p, large)}""")
    return f"""c AS (SELECT {key} AS content_id, coalesce(text, '') AS text FROM {table}),
found AS ({" UNION ALL ".join(parts)}),
each_ AS (SELECT content_id, pattern, text, v, g, unnest(range(1, len(v) + 1)) AS i FROM found WHERE len(v) > 0),
hits AS (SELECT content_id, pattern, v[i] AS value, len(v) AS num_matches, hex(encode({fold("text")})) AS h,
  CAST(list_sum([strlen(x) for x in g[1:i]]) + coalesce(list_sum([strlen(x) for x in v[1:i-1]]), 0) AS BIGINT) AS start FROM each_)"""


def windowed(window: int = 1024) -> str:
    """CTE hits(content_id, pattern, value, start, num_matches): prefixes' places, ranges around them, those that touch joined, cut at whole characters, and the regex on each."""
    packs = ", ".join(f"({q(p.name)}, {q(p.prefix.lower())}, {q(p.regex)}, {str(p.severity in ('critical', 'high')).upper()})" for p in PATTERNS)
    return f"""r(pattern, prefix, regex, severe) AS (VALUES {packs}),
c AS (SELECT doc_id AS content_id, coalesce(text, '') AS text FROM documents),
cand AS (SELECT content_id, pattern, prefix, regex, strlen(text) AS size, hex(encode(text)) AS h, string_split({fold("text")}, prefix) AS parts, prefix <> '' AND strlen(text) > {2 * window} AS near FROM c JOIN r ON prefix = '' OR contains({fold("text")}, prefix) WHERE severe OR strlen(text) < {CFG.large}),
o AS (SELECT content_id, pattern, size, unnest([list_sum([strlen(x) for x in parts[1:i]]) + (i - 1) * strlen(prefix) for i in range(1, len(parts))]) AS o FROM cand WHERE near),
w AS (SELECT content_id, pattern, greatest(o - {window}, 0) AS s, least(o + {window}, size) AS e FROM o),
f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY content_id, pattern ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM w),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY content_id, pattern ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM f),
isl AS (SELECT content_id, pattern, min(s) AS s, max(e) AS e FROM g GROUP BY content_id, pattern, k UNION ALL SELECT content_id, pattern, 0, size FROM cand WHERE NOT near),
cut AS (SELECT content_id, pattern, regex, s, substr(h, CAST(2 * s + 1 AS BIGINT), CAST(2 * (e - s) AS BIGINT)) AS x FROM isl JOIN cand USING (content_id, pattern)),
lead AS (SELECT *, length(regexp_extract(x, '^(?:[89AB][0-9A-F])*')) AS l FROM cut),
part AS (SELECT content_id, pattern, regex, s + l / 2 AS s, decode(unhex(regexp_replace(substr(x, l + 1), '(?:[CD][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-9A-F](?:[89AB][0-9A-F]){{0,2}})$', ''))) AS t FROM lead),
found AS (SELECT content_id, pattern, s, regexp_extract_all(t, regex) AS v, regexp_split_to_array(t, regex) AS g FROM part),
each_ AS (SELECT content_id, pattern, s, v, g, unnest(range(1, len(v) + 1)) AS i FROM found WHERE len(v) > 0),
hits AS (SELECT content_id, pattern, v[i] AS value, CAST(s + list_sum([strlen(x) for x in g[1:i]]) + coalesce(list_sum([strlen(x) for x in v[1:i-1]]), 0) AS BIGINT) AS start, count(*) OVER (PARTITION BY content_id, pattern) AS num_matches FROM each_)"""


_ENTROPY = "round(list_sum([-(len([y for y in string_split(value, '') if y = x])::DOUBLE / strlen(value)) * log2(len([y for y in string_split(value, '') if y = x])::DOUBLE / strlen(value)) for x in list_sort(list_distinct(string_split(value, '')))]), 12)"


def _sides(window: int) -> tuple[str, str]:
    low = f"greatest(start - {window}, 0)"
    return f"substr(h, 2 * {low} + 1, 2 * (start - {low}))", f"substr(h, 2 * (start + strlen(value)) + 1, {2 * window})"


def _case(of, other: str) -> str:
    return "CASE pattern " + " ".join(f"WHEN {q(p.name)} THEN {of(p)}" for p in PATTERNS) + f" ELSE {other} END"


def _hot(p) -> str:
    if not p.hotwords or not p.hotword_window:
        return "FALSE"
    a, b = _sides(p.hotword_window)
    return "(" + " OR ".join(f"contains({s}, {hexed(w)})" for w in p.hotwords for s in (a, b)) + ")"


def _excluded(p, suppress: bool) -> str:
    tests = ["FALSE"]
    for r in EXCLUSIONS:
        if r.applies_to not in ("", "*") and r.applies_to.lower() != p.name.lower():
            continue
        if r.type == "regex" and r.suppress == suppress:
            tests.append(f"regexp_matches(value, {q(r.pattern)})")
        elif r.type == "dictionary" and r.match_type == "exact" and suppress:
            tests.append(f"{fold('value')} IN ({', '.join(q(w.lower()) for w in r.words)})")
        elif r.type == "dictionary" and r.match_type != "exact" and not suppress:
            a, b = _sides(r.window or 50)
            tests += [f"contains({a} || {b}, {hexed(w)})" for w in r.words]
    return "(" + " OR ".join(tests) + ")"


def _score(p) -> str:
    s = f"{p.score_weight if p.score_weight > 0 else 1} + CASE WHEN hotword THEN {p.hotword_boost or CFG.hotword} ELSE 0 END"
    if p.entropy_min > 0:
        s += f" + CASE WHEN entropy >= {p.entropy_min} THEN {CFG.entropy_boost} ELSE {CFG.entropy_penalty} END"
    return s


def _threshold(p) -> str:
    return str(CFG.thresholds.get(p.severity, CFG.thresholds["low"]))


def scored(table: str = "documents", key: str = "doc_id", large: int = CFG.large) -> str:
    return f"""{matches(table, key, large)},
ctx AS (SELECT content_id, pattern, value, start, num_matches, {_case(_hot, "FALSE")} AS hotword, {_ENTROPY} AS entropy,
  {_case(lambda p: _excluded(p, True), "FALSE")} AS suppressed, {_case(lambda p: _excluded(p, False), "FALSE")} AS penalised FROM hits),
scored AS (SELECT *, CAST({_case(_score, "1")} + {CFG.multi_match} * least(num_matches - 1, 5) + CASE WHEN penalised THEN {CFG.exclusion} ELSE 0 END AS BIGINT) AS score FROM ctx)"""


def verdicts(table: str = "documents", key: str = "doc_id", large: int = CFG.large) -> str:
    return f"""{scored(table, key, large)},
best AS (SELECT content_id, pattern, max(num_matches) AS num_matches, max(CASE WHEN NOT suppressed THEN score END) AS score FROM scored GROUP BY content_id, pattern),
blocked_ AS (SELECT content_id, pattern, score, row_number() OVER (PARTITION BY content_id ORDER BY score DESC, pattern) AS k FROM best
  WHERE score >= {_case(_threshold, str(CFG.thresholds["low"]))} AND num_matches >= {_case(lambda p: str(p.min_matches), "0")}),
verdicts AS (SELECT i.content_id, b.content_id IS NOT NULL AS blocked, coalesce(b.pattern, '') AS pattern_name, CAST(coalesce(b.score, 0) AS BIGINT) AS score
  FROM (SELECT DISTINCT content_id FROM c) i LEFT JOIN blocked_ b ON b.content_id = i.content_id AND b.k = 1)"""


def _rules() -> str:
    rows = ", ".join(f"({s}, {i}, {q(c)}, {q(e.lstrip('.'))}, {str(e.startswith('.')).upper()})" for s, x in enumerate(DOMAINS) for i, (c, e) in enumerate(x))
    return f"""r(source_ord, line_ord, category, host, is_wildcard) AS (VALUES {rows}),
eff AS (SELECT host, is_wildcard, category FROM (SELECT *, row_number() OVER (PARTITION BY host, is_wildcard ORDER BY source_ord, line_ord) AS k FROM r) WHERE k = 1),
pol(category, action) AS (VALUES {", ".join(f"({q(a)}, {q(b)})" for a, b in POLICIES)})"""


_HOSTS = """p AS (SELECT page_id, regexp_extract(regexp_replace(translate(trim(url), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[a-z][a-z0-9+.-]*://', ''), '^([^/?#]*)', 1) AS host FROM pages),
fit AS (SELECT p.page_id, p.host, e.category, row_number() OVER (PARTITION BY p.page_id ORDER BY CASE WHEN e.is_wildcard THEN 1 ELSE 0 END, length(e.host) DESC) AS k
  FROM p JOIN eff e ON p.host = e.host OR (e.is_wildcard AND ends_with(p.host, '.' || e.host))),
res AS (SELECT p.page_id, p.host, f.category FROM p LEFT JOIN fit f ON f.page_id = p.page_id AND f.k = 1)"""

_PAGE_RULES = """p AS (SELECT page_id, regexp_extract(regexp_replace(translate(trim(url), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[a-z][a-z0-9+.-]*://', ''), '^([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*/([^/?#]*)', 1) AS category FROM pages),
eff AS (SELECT * FROM (SELECT *, page_id % 2 = 0 AS is_wildcard, row_number() OVER (PARTITION BY host, page_id % 2 ORDER BY page_id % 3, page_id) AS k FROM p WHERE host <> '') WHERE k = 1)"""

_RATES = """count(*) AS total, count(*) FILTER (WHERE expected AND blocked) AS tp, count(*) FILTER (WHERE expected AND NOT blocked) AS fn,
  count(*) FILTER (WHERE NOT expected AND blocked) AS fp, count(*) FILTER (WHERE NOT expected AND NOT blocked) AS tn"""


def _div(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE round(({a})::DOUBLE / ({b}), 9) END"


_DERIVED = f"{_div('tp', '(tp + fp)')} AS precision, {_div('tp', '(tp + fn)')} AS recall, {_div('fp', '(fp + tn)')} AS fp_rate, {_div('fn', '(tp + fn)')} AS fn_rate, {_div('2 * tp', '(2 * tp + fp + fn)')} AS f1"
_SAMPLES = f"""{verdicts()},
s AS (SELECT l.doc_id AS sample_id, l.toxic = 1 AS expected, d.lang, v.blocked, v.pattern_name, v.score FROM labels l JOIN documents d ON d.doc_id = l.doc_id JOIN verdicts v ON v.content_id = l.doc_id)"""

_CENTROIDS = """pos AS (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY label, i),
cen AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM pos)"""
_FLAT = "e AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"
_HEAD = f"""{_CENTROIDS}, {_FLAT},
diff AS (SELECT a.i, a.x - b.x AS d FROM cen a JOIN cen b ON a.i = b.i AND a.label = 0 AND b.label = 1),
w AS (SELECT i, d / sqrt(sum(d * d) OVER ()) AS w FROM diff),
proj AS (SELECT e.vec_id, e.label, sum(e.x * w.w) AS p FROM e JOIN w ON e.i = w.i GROUP BY e.vec_id, e.label),
bias AS (SELECT -(avg(p) FILTER (WHERE label = 0) + avg(p) FILTER (WHERE label = 1)) / 2 AS b FROM proj WHERE label < 2)"""
_POLLS = "p AS (SELECT event_id, user_id, ts, CAST(floor(value) AS BIGINT) AS counter FROM events)"
_DELTAS = f"{_POLLS}, d AS (SELECT *, counter - lag(counter) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM p), e AS (SELECT * FROM d WHERE delta > 0)"


def _group(column: str) -> str:
    return f"WITH {verdicts()} SELECT d.{column}, count(*) AS scans, count(*) FILTER (WHERE v.blocked) AS blocks, max(v.score) AS top_score FROM verdicts v JOIN documents d ON d.doc_id = v.content_id GROUP BY d.{column}"


_NUMBERED = "e AS (SELECT event_id, user_id, event_type, epoch(ts)::DOUBLE AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"
#: A bucket of 2 tokens that refills at 1 in 20,000 s: what is left after each row.
_BUCKET = f"""WITH RECURSIVE {_NUMBERED},
b AS (SELECT event_id, user_id, k, s, TRUE AS allowed, 1.0::DOUBLE AS tokens FROM e WHERE k = 1
  UNION ALL SELECT event_id, user_id, k, s, t >= 1, CASE WHEN t >= 1 THEN t - 1 ELSE t END
  FROM (SELECT e.event_id, e.user_id, e.k, e.s, least(2.0, b.tokens + greatest(0.0, e.s - b.s) * (1.0::DOUBLE / 20000)) AS t FROM b JOIN e ON e.user_id IS NOT DISTINCT FROM b.user_id AND e.k = b.k + 1))"""
_THROTTLE = f"""WITH RECURSIVE {_NUMBERED},
b AS (SELECT event_id, user_id, k, TRUE AS accepted, s AS last, event_type AS mark FROM e WHERE k = 1
  UNION ALL SELECT event_id, user_id, k, ok, CASE WHEN ok THEN s ELSE last END, CASE WHEN ok THEN event_type ELSE mark END
  FROM (SELECT e.event_id, e.user_id, e.k, e.s, e.event_type, b.last, b.mark, e.s - b.last >= 3600 AND e.event_type IS DISTINCT FROM b.mark AS ok FROM b JOIN e ON e.user_id IS NOT DISTINCT FROM b.user_id AND e.k = b.k + 1))"""


def hmac(key: str, message: str) -> str:
    """Key and message are blobs."""
    block = f"rpad(hex(CASE WHEN octet_length({key}) > 64 THEN unhex(sha256({key})) ELSE {key} END), 128, '0')"
    mixed = lambda byte: f"unhex(array_to_string([printf('%02X', xor(('0x' || substr({block}, 2 * i + 1, 2))::BIGINT, {byte})) for i in range(64)], ''))"
    return f"sha256({mixed(0x5C)} || unhex(sha256({mixed(0x36)} || {message})))"


def le32(n: str) -> str:
    return f"unhex(array_to_string([printf('%02X', ({n} >> (8 * j)) & 255) for j in range(4)], ''))"


#: Look-ups of a text in order; a miss starts a new 5 s, and only what is asked for within them is a hit.
_CACHED = """WITH RECURSIVE d AS (SELECT doc_id || '-a' AS who, doc_id * 10 AS asked, coalesce(text, '') AS text FROM documents UNION ALL SELECT doc_id || '-b', doc_id * 10 + CASE WHEN doc_id % 2 = 0 THEN 3000 ELSE 7000 END, coalesce(text, '') FROM documents),
k AS (SELECT *, md5(text) AS digest, row_number() OVER (PARTITION BY text ORDER BY asked, who) AS n FROM d),
c AS (SELECT who, digest, n, FALSE AS hit, who AS answered_by, asked AS inserted FROM k WHERE n = 1
  UNION ALL SELECT k.who, k.digest, k.n, k.asked - c.inserted <= 5000, CASE WHEN k.asked - c.inserted <= 5000 THEN c.answered_by ELSE k.who END, CASE WHEN k.asked - c.inserted <= 5000 THEN c.inserted ELSE k.asked END FROM c JOIN k ON k.digest = c.digest AND k.n = c.n + 1)"""


ORACLE_SQL = {
    "classify_documents": f"SELECT doc_id, {kind('text')} AS content_type FROM documents",
    "classify_conversations": f"SELECT {kind('text')} AS content_type, count(*) AS n FROM conversations GROUP BY 1",
    "prefix_candidates": "WITH c AS (SELECT doc_id AS content_id, coalesce(text, '') AS text FROM documents) " + " UNION ALL ".join(f"SELECT content_id, {q(p.name)} AS pattern, CAST({f'(length(text) - length(replace({fold("text")}, {q(p.prefix.lower())}, {q("")}))) // {len(p.prefix)}' if p.prefix else '1'} AS BIGINT) AS occurrences FROM c WHERE {admitted(p)}" for p in PATTERNS),
    "regex_matches": f"WITH {matches()} SELECT content_id, pattern, value, start, start + strlen(value) AS stop, num_matches FROM hits",
    "windowed_matches": f"WITH {windowed()} SELECT content_id, pattern, value, start, start + strlen(value) AS stop, num_matches FROM hits",
    "prefix_hits": f"""WITH r(prefix) AS (VALUES {", ".join(f"({q(x)})" for x in sorted({p.prefix.lower() for p in PATTERNS} - {""}))}),
s AS (SELECT doc_id AS content_id, prefix, string_split({fold("text")}, prefix) AS parts FROM documents JOIN r ON contains({fold("text")}, prefix))
SELECT content_id, prefix, CAST(unnest([list_sum([strlen(x) for x in parts[1:i]]) + (i - 1) * strlen(prefix) for i in range(1, len(parts))]) AS BIGINT) AS start FROM s""",
    "dictionary_counts": f"""WITH e AS (SELECT DISTINCT {fold("regexp_extract(text, '^[^ ]+ [^ ]+ [^ ]+')")} AS word FROM benchmark),
h AS (SELECT doc_id, word, (length(text) - length(replace({fold("text")}, word, ''))) // length(word) AS n FROM documents JOIN e ON word <> '' AND contains({fold("text")}, word))
SELECT word, CAST(sum(n) AS BIGINT) AS hits, count(DISTINCT doc_id) AS documents FROM h GROUP BY word""",
    "match_entropy": f"WITH {scored()} SELECT content_id, pattern, start, round(entropy, 6) AS entropy FROM scored",
    "hotword_context": f"WITH {scored()} SELECT content_id, pattern, start, hotword FROM scored",
    "exclusion_eval": f"WITH {scored()} SELECT content_id, pattern, start, suppressed, penalised FROM scored",
    "score_matches": f"WITH {scored()} SELECT content_id, pattern, start, score FROM scored",
    "scan_documents": f"WITH {verdicts()} SELECT * FROM verdicts",
    "scan_conversations": f"WITH {verdicts('conversations', 'struct_pack(conv_id := conv_id, turn := turn)')} SELECT content_id.conv_id AS conv_id, content_id.turn AS turn, blocked, pattern_name, score FROM verdicts",
    "scan_large": f"WITH {verdicts(large=2_000)} SELECT * FROM verdicts",
    "severity_guard": "WITH c AS (SELECT doc_id AS content_id, coalesce(text, '') AS text FROM documents), k AS (" + " UNION ALL ".join(f"SELECT content_id, {str(p.severity in ('critical', 'high')).upper()} AS severe FROM c WHERE {admitted(p)}" for p in PATTERNS) + ") SELECT content_id, bool_or(severe) AS severe FROM k GROUP BY content_id",
    "status_counts": f"WITH {_PAGE_RULES}, pack AS (SELECT source AS category, regexp_extract(coalesce(text, ''), '^([A-Za-z]*)', 1) AS prefix FROM documents) SELECT (SELECT count(*) FROM pack) AS patterns, (SELECT count(DISTINCT lower(prefix)) FROM pack WHERE prefix <> '') AS prefixes, (SELECT string_agg(category, ',' ORDER BY category) FROM (SELECT DISTINCT coalesce(nullif(category, ''), 'uncategorized') AS category FROM pack)) AS categories, count(*) FILTER (WHERE NOT is_wildcard) AS exact_hosts, count(*) FILTER (WHERE is_wildcard) AS wildcard_hosts, count(*) AS index_size FROM eff",
    "config_violations": """WITH c AS (SELECT n_name AS name, n_nationkey AS i, n_nationkey % 3 AS m FROM nation)
SELECT name, concat_ws(',', CASE WHEN m > 0 AND i % 2 = 0 THEN 'allowed_extension_ids' END, CASE WHEN m > 0 AND i % 5 = 0 THEN 'api_token_path' END, CASE WHEN m > 0 AND i % 7 = 0 THEN 'api_token_required' END,
  CASE WHEN m = 2 AND i % 4 = 0 THEN 'bridge_mac_required' END, CASE WHEN m = 2 AND i % 11 = 0 THEN 'profile_public_key' END, CASE WHEN m = 2 AND i % 8 = 0 THEN 'rule_update_public_key' END, CASE WHEN m = 2 AND i % 10 = 0 AND i <> 20 THEN 'profile_path or profile_url' END) AS violations FROM c""",
    "scan_dedup": f"WITH {verdicts()} SELECT * FROM verdicts",
    "scan_by_source": _group("source"),
    "scan_by_lang": _group("lang"),
    "blocked_counters": f"WITH {verdicts()} SELECT count(*) AS dlp_scans, count(*) FILTER (WHERE blocked) AS dlp_blocks FROM verdicts",
    "resolve_page_hosts": f"WITH {_rules()}, {_HOSTS} SELECT page_id, host, category FROM res",
    "dns_verdicts": f"WITH {_rules()}, {_HOSTS}, a AS (SELECT CASE WHEN res.category IS NULL THEN 'allow' ELSE coalesce(pol.action, 'deny') END AS action FROM res LEFT JOIN pol ON pol.category = res.category) SELECT action, CASE WHEN action = 'deny' THEN 'NXDOMAIN' ELSE 'FORWARD' END AS rcode, count(*) AS n FROM a GROUP BY 1, 2",
    "tier2_hosts": f"WITH {_PAGE_RULES} SELECT DISTINCT host FROM eff WHERE category IN ('de', 'fr')",
    "rule_precedence": f"WITH {_PAGE_RULES} SELECT host, is_wildcard, category FROM eff",
    "override_merge": "SELECT n_name AS name, CAST(CASE WHEN n_regionkey = 1 THEN 11 ELSE n_regionkey END AS BIGINT) AS weight FROM nation UNION ALL SELECT n_name || '*', CAST(n_regionkey AS BIGINT) FROM nation WHERE n_regionkey = 2",
    "accuracy_report": f"WITH {_SAMPLES}, k AS (SELECT {_RATES} FROM s) SELECT tp, fn, fp, tn, {_DERIVED}, total FROM k",
    "accuracy_by_lang": f"""WITH {_SAMPLES}, k AS (SELECT lang, 0 AS overall, {_RATES} FROM s GROUP BY lang UNION ALL SELECT NULL, 1, {_RATES} FROM s), t AS (SELECT lang, overall, tp, fn, fp, tn, {_DERIVED}, total FROM k)
SELECT *, fn_rate <= CASE WHEN overall = 1 THEN {BUDGET["fn_rate"]} ELSE {BUDGET["category_fn_rate"]} END AND (overall = 0 OR fp_rate <= {BUDGET["fp_rate"]}) AS within_budget FROM t""",
    "pattern_fp": f"WITH {_SAMPLES} SELECT pattern_name AS pattern, count(*) AS fp_count, (SELECT count(*) FROM s WHERE NOT expected) AS total_negatives, round(count(*)::DOUBLE / (SELECT count(*) FROM s WHERE NOT expected), 9) AS fp_rate FROM s WHERE NOT expected AND blocked GROUP BY 1",
    "pattern_fn": f"WITH {_SAMPLES} SELECT 'of ' || lang AS pattern, count(*) FILTER (WHERE NOT blocked) AS fn_count, count(*) AS total_positives, round((count(*) FILTER (WHERE NOT blocked))::DOUBLE / count(*), 9) AS fn_rate FROM s WHERE expected GROUP BY 1 HAVING fn_count > 0",
    "report_examples": f"""WITH {_SAMPLES}, x AS (SELECT 'fp' AS kind, pattern_name AS pattern, sample_id FROM s WHERE NOT expected AND blocked UNION ALL SELECT 'fn', lang, sample_id FROM s WHERE expected AND NOT blocked),
y AS (SELECT *, row_number() OVER (PARTITION BY kind, pattern ORDER BY sample_id) AS k FROM x)
SELECT kind, pattern, string_agg(sample_id::VARCHAR, ',' ORDER BY sample_id) AS example_ids FROM y WHERE k <= 5 GROUP BY 1, 2""",
    "corpus_categories": f"WITH {verdicts()}, k(pattern, category) AS (VALUES {', '.join(f'({q(p.name)}, {q(p.category)})' for p in PATTERNS if p.category != 'network')}) SELECT coalesce(k.category, 'other_generic') AS corpus_category, count(*) AS n FROM verdicts v LEFT JOIN k ON k.pattern = v.pattern_name WHERE v.blocked GROUP BY 1",
    "accuracy_regression": f"""WITH {_SAMPLES}, k AS (SELECT lang, {_RATES} FROM s GROUP BY lang), b AS (SELECT lang, {_DERIVED} FROM k),
n AS (SELECT lang, {_RATES} FROM (SELECT lang, expected, blocked OR lang = 'fr' AS blocked FROM s WHERE lang <> 'es') GROUP BY lang), m AS (SELECT lang, {_DERIVED} FROM n)
SELECT b.lang, CASE WHEN m.lang IS NULL THEN 'missing' WHEN m.recall < b.recall - {RECALL_DROP} THEN 'recall' WHEN m.fp_rate > b.fp_rate + {FP_RISE} THEN 'false positives' END AS violation FROM b LEFT JOIN m ON m.lang = b.lang""",
    "centroids": f"WITH {_CENTROIDS} SELECT CAST(label AS BIGINT) AS label, CAST(i AS BIGINT) AS pos, round(x, 6) AS x FROM cen",
    "prefilter_verdicts": f"""WITH {_CENTROIDS}, {_FLAT}, n AS (SELECT e.vec_id, sum(e.x * b.x) / sqrt(sum(e.x * e.x)) - sum(e.x * a.x) / sqrt(sum(e.x * e.x)) AS m FROM e JOIN cen a ON a.i = e.i AND a.label = 0 JOIN cen b ON b.i = e.i AND b.label = 1 GROUP BY e.vec_id)
SELECT vec_id, round(m, 6) AS margin, CASE WHEN round(m, 6) >= 0.1 THEN 'likely_benign' ELSE 'unknown' END AS verdict FROM n""",
    "linear_head": f"WITH {_HEAD} SELECT round(b, 6) AS bias, (SELECT round(w, 6) FROM w WHERE i = 0) AS first_weight, (SELECT count(*) FROM proj, bias WHERE label = 0 AND p + b > 0) AS tp_right, (SELECT count(*) FROM proj, bias WHERE label = 1 AND p + b <= 0) AS tn_right FROM bias",
    "disambiguator_scores": f"WITH {_HEAD} SELECT vec_id, round((exp(2 * (p + b)) - 1) / (exp(2 * (p + b)) + 1), 6) AS head_score FROM proj, bias",
    "scan_with_ml": f"""WITH {scored()}, {_HEAD}, hs AS (SELECT vec_id, round((exp(2 * (p + b)) - 1) / (exp(2 * (p + b)) + 1), 6) AS head FROM proj, bias),
t AS (SELECT scored.*, {_case(_threshold, "4")} AS lim, coalesce(round(hs.head), 0) AS ml FROM scored LEFT JOIN hs ON hs.vec_id = content_id),
m AS (SELECT content_id, pattern, num_matches, suppressed, lim, CAST(score + CASE WHEN abs(score - lim) <= 1 THEN ml ELSE 0 END AS BIGINT) AS score FROM t),
b AS (SELECT content_id, pattern, max(lim) AS lim, max(num_matches) AS num_matches, max(CASE WHEN NOT suppressed THEN score END) AS score FROM m GROUP BY 1, 2)
SELECT content_id, pattern, num_matches, score, coalesce(score >= lim AND num_matches >= {_case(lambda p: str(p.min_matches), "0")}, FALSE) AS blocked FROM b""",
    "tamper_edges": "WITH l AS (SELECT event_id, user_id, event_type <> 'error' AS ok, lag(event_type <> 'error', 1, TRUE) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) SELECT event_id, user_id FROM l WHERE was AND NOT ok",
    "counter_deltas": f"WITH {_DELTAS} SELECT event_id, user_id, delta FROM e",
    "last_notifications": f"WITH {_DELTAS}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM e) SELECT user_id, event_id, delta, place FROM k WHERE place <= 10",
    "id_rollback": f"WITH {_POLLS}, m AS (SELECT user_id, counter, max(counter) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM p) SELECT user_id, count(*) FILTER (WHERE counter <= greatest(coalesce(most, 0), 0)) AS rejected, count(*) AS n FROM m GROUP BY user_id",
    "byte_budget": "WITH f AS (SELECT conv_id, turn, strlen(text) AS size, coalesce(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations) SELECT conv_id, turn, CAST(greatest(0, least(size, 2000 - before)) AS BIGINT) AS taken, greatest(0, least(size, 2000 - before)) < size AS truncated FROM f",
    "enforcement_decisions": f"""WITH {verdicts()}, e AS (SELECT d.doc_id, d.n_chars * 400 AS size, CASE d.doc_id % 3 WHEN 0 THEN 'personal' WHEN 1 THEN 'team' ELSE 'managed' END AS mode, CASE WHEN d.doc_id % 7 <> 0 THEN v.blocked END AS blocked, v.pattern_name, v.score FROM documents d JOIN verdicts v ON v.content_id = d.doc_id)
SELECT doc_id, CASE WHEN size > 1048576 THEN CASE WHEN mode = 'managed' THEN 'block' ELSE 'allow' END WHEN blocked IS NULL THEN CASE mode WHEN 'managed' THEN 'block' WHEN 'team' THEN 'warn' ELSE 'allow' END WHEN blocked THEN 'block' ELSE 'allow' END AS decision,
  CASE WHEN size > 1048576 THEN 'policy:oversize' WHEN blocked IS NULL THEN 'policy:agent-unavailable' ELSE pattern_name END AS effective_pattern, CAST(CASE WHEN size > 1048576 OR blocked IS NULL THEN 0 ELSE score END AS BIGINT) AS effective_score FROM e""",
    "risky_extensions": f"""WITH n AS (SELECT regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^.*[/\\\\]', '') AS name FROM pages), x AS (SELECT regexp_extract({fold("name")}, '^.+\\.([^.]+)$', 1) AS extension FROM n)
SELECT extension, extension IN ({", ".join(q(x) for x in [*RISKY_EXTENSIONS, "html"])}) AS risky, count(*) AS n FROM x GROUP BY 1, 2""",
    "manifest_delta": "SELECT 'page' || page_id AS name, sha256(html) AS sha256 FROM pages WHERE page_id % 5 <> 0 AND page_id % 3 <> 0",
    "rate_limit": f"{_BUCKET} SELECT user_id, count(*) FILTER (WHERE allowed) AS allowed, count(*) AS n FROM b GROUP BY user_id",
    "clipboard_throttle": f"{_THROTTLE} SELECT user_id, count(*) FILTER (WHERE accepted) AS accepted, count(*) AS n FROM b GROUP BY user_id",
    "streamed_rate_limit": f"{_BUCKET} SELECT event_id, user_id, allowed FROM b",
    "streamed_throttle": f"{_THROTTLE} SELECT event_id, user_id, accepted FROM b",
    "streamed_edges": "WITH l AS (SELECT event_id, user_id, event_type <> 'error' AS ok, lag(event_type <> 'error', 1, TRUE) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) SELECT event_id, user_id FROM l WHERE was AND NOT ok",
    "streamed_hello": f"WITH {_NUMBERED} SELECT event_id, user_id FROM e WHERE k = 1",
    "clipboard_fingerprints": """WITH u AS (SELECT item_id, list_concat([2166136261::BIGINT], flatten([CASE WHEN c >= 65536 THEN [(55296 + ((c - 65536) >> 10))::BIGINT, (56320 + ((c - 65536) & 1023))::BIGINT] ELSE [c::BIGINT] END for c in [unicode(x) for x in string_split(text, '')]])) AS units FROM benchmark)
SELECT item_id, (len(units) - 1) || ':' || printf('%x', list_reduce(units, lambda h, c: (xor(h, c) * 16777619) & 4294967295)) AS fingerprint FROM u""",
    "cached_scans": f"{_CACHED} SELECT who, hit, answered_by FROM c",
    "cache_counts": f"{_CACHED} SELECT right(who, 1) AS turn, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses FROM c GROUP BY 1",
    "profile_snapshots": """WITH s AS (SELECT regexp_replace(lower(source), '[^a-z0-9]', '_', 'g') || '_admin' AS category, count(*) AS n, sum(n_chars) AS chars FROM documents WHERE source IS NOT NULL GROUP BY 1), v(version) AS (VALUES (1), (2), (3))
SELECT CAST(version AS BIGINT) AS version, category, CASE WHEN version = 2 AND chars > 2000 * n THEN 'deny' ELSE 'allow' END AS action, CASE WHEN version = 2 THEN 5 ELSE 2 END AS threshold_high, 4 AS threshold_low FROM s, v""",
    "framed_conversations": "SELECT conv_id, turn, role, text FROM conversations",
    "conversation_macs": f"""WITH m AS (SELECT conv_id, turn, encode(CASE WHEN conv_id % 5 = 0 THEN repeat('key ' || conv_id, 20) ELSE 'k' || conv_id END) AS k,
  unhex(substr(sha256(conv_id::VARCHAR), 1, 32)) || unhex('01') || {le32("turn")} || {le32("strlen(coalesce(role, ''))")} || encode(coalesce(role, '')) || {le32("strlen(coalesce(text, ''))")} || encode(coalesce(text, '')) AS msg FROM conversations)
SELECT conv_id, turn, {hmac("k", "msg")} AS mac FROM m""",
    # a word is one place with a sign; texts are the means of theirs, scaled to length 1
    "text_second_opinion": f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all({fold("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+')) AS w FROM documents),
h AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM t),
s AS (SELECT doc_id, h % 64 AS i, sum(CASE WHEN h // 64 % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS s FROM h GROUP BY 1, 2),
c AS (SELECT doc_id, count(*) AS n FROM h GROUP BY 1),
u AS (SELECT s.doc_id, s.i, s.s / n AS x FROM s JOIN c ON c.doc_id = s.doc_id),
e AS (SELECT doc_id, i, CASE WHEN sqrt(sum(x * x) OVER (PARTITION BY doc_id)) < 1e-12 THEN x ELSE x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) END AS x FROM u),
l AS (SELECT doc_id, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)),
m AS (SELECT toxic, count(*) AS n FROM l GROUP BY 1),
g AS (SELECT l.toxic, e.i, sum(e.x) / any_value(m.n) AS x FROM e JOIN l ON l.doc_id = e.doc_id JOIN m ON m.toxic = l.toxic GROUP BY 1, 2),
cen AS (SELECT toxic, i, x / sqrt(sum(x * x) OVER (PARTITION BY toxic)) AS x FROM g),
k(i) AS (SELECT unnest(range(0, 64))),
d AS (SELECT k.i, coalesce(a.x, 0) - coalesce(b.x, 0) AS d FROM k LEFT JOIN cen a ON a.i = k.i AND a.toxic = 1 LEFT JOIN cen b ON b.i = k.i AND b.toxic = 0),
w AS (SELECT i, d / sqrt(sum(d * d) OVER ()) AS w FROM d),
p AS (SELECT o.doc_id, coalesce(sum(e.x * w.w), 0) AS p, coalesce(sum(e.x * coalesce(b.x, 0)) - sum(e.x * coalesce(a.x, 0)), 0) AS margin
  FROM documents o LEFT JOIN e ON e.doc_id = o.doc_id LEFT JOIN w ON w.i = e.i LEFT JOIN cen a ON a.i = e.i AND a.toxic = 1 LEFT JOIN cen b ON b.i = e.i AND b.toxic = 0 GROUP BY 1),
bias AS (SELECT -(avg(p.p) FILTER (WHERE toxic = 1) + avg(p.p) FILTER (WHERE toxic = 0)) / 2 AS b FROM p JOIN l ON l.doc_id = p.doc_id)
SELECT p.doc_id, coalesce(c.n, 0) AS n_tokens, round(margin, 6) AS margin, CASE WHEN round(margin, 6) >= 0.01 THEN 'likely_benign' ELSE 'unknown' END AS verdict, round(tanh(p.p + b), 6) AS head_score FROM p LEFT JOIN c ON c.doc_id = p.doc_id, bias""",
    "planted_recall": "SELECT count(*) AS planted, count(*) AS found FROM documents",
    "sample_corpus": f"""WITH p AS (SELECT * FROM (VALUES {", ".join(f"({i}, {q(p.name)})" for i, p in enumerate(PATTERNS))}) AS t(k, name)),
n AS (SELECT * FROM (VALUES (0, 'code'), (1, 'log'), (2, 'documentation'), (3, 'yaml'), (4, 'json'), (5, 'markdown'), (6, 'stack trace'), (7, 'ticket'), (8, 'prompt'), (9, 'table'), (10, 'prose')) AS t(k, name))
SELECT name AS sample, count(*) AS n, count(*) AS found FROM documents JOIN p ON p.k = doc_id % {len(PATTERNS)} WHERE doc_id % 5 <> 0 GROUP BY 1
UNION ALL SELECT 'no value: ' || name, count(*), 0 FROM documents JOIN n ON n.k = doc_id // 5 % 11 WHERE doc_id % 5 = 0 GROUP BY 1""",
    "sql_scan": f"WITH {verdicts()} SELECT * FROM verdicts",
    "sql_columns": f"""WITH p AS (SELECT page_id, url AS value, html FROM pages)
SELECT page_id, regexp_extract(regexp_replace({fold("trim(value)")}, '^[a-z][a-z0-9+.-]*://', ''), '^([^/?#]*)', 1) AS host, round({_ENTROPY}, 6) AS entropy, {kind("html")} AS content_type FROM p""",
    "profile_checks": """WITH c AS (SELECT *, concat_ws(',', CASE WHEN c_custkey % 6 = 0 THEN 'name' END, CASE WHEN c_custkey % 4 = 3 THEN 'action of ' || c_mktsegment END, CASE WHEN c_custkey % 5 <> 0 AND floor(c_acctbal) < 0 THEN 'dlp_thresholds' END) AS violations FROM customer)
SELECT violations, count(*) AS n FROM c GROUP BY 1""",
    "exclusion_merge": """WITH r AS (SELECT p_partkey AS k, p_brand AS applies_to, CASE WHEN p_partkey % 2 = 0 THEN '' END AS pattern, 'w' || p_partkey % 40 AS word, p_size AS size FROM part),
b AS (SELECT *, row_number() OVER (PARTITION BY applies_to, pattern, word ORDER BY k DESC) AS back FROM r WHERE k % 3 <> 0),
o AS (SELECT applies_to, pattern, word, max_by(-size, k) AS size, min(k) AS k FROM r WHERE k % 4 = 0 GROUP BY 1, 2, 3),
u AS (SELECT 0 AS part, b.k, b.applies_to, b.pattern, b.word, coalesce(o.size, b.size) AS size FROM b LEFT JOIN o ON b.back = 1 AND o.applies_to = b.applies_to AND o.pattern IS NOT DISTINCT FROM b.pattern AND o.word = b.word
  UNION ALL SELECT 1, o.k, o.applies_to, o.pattern, o.word, o.size FROM o WHERE NOT EXISTS (SELECT 1 FROM b WHERE o.applies_to = b.applies_to AND o.pattern IS NOT DISTINCT FROM b.pattern AND o.word = b.word))
SELECT row_number() OVER (ORDER BY part, k) - 1 AS place, applies_to, word, pattern, CAST(size AS INT) AS wide FROM u""",
    "page_addresses": """WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || CASE WHEN page_id % 3 = 0 THEN ':8443' ELSE '' END AS address, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, CASE WHEN contains(address, ':') THEN left(address, length(address) - instr(reverse(address), ':')) ELSE address END AS host, CASE WHEN contains(address, ':') THEN right(address, instr(reverse(address), ':') - 1) ELSE '' END AS port,
  CASE WHEN path = '' THEN '.' WHEN rtrim(path, '/') = '' THEN '/' ELSE regexp_extract(rtrim(path, '/'), '([^/]*)$', 1) END AS base FROM p""",
}
