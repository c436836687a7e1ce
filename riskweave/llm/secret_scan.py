"""Secret scans with false positives removed by a random forest, with DataFrame functions alone.

Candidates come from the whole text, blank-delimited or not. A value assigned to a secret key (in
code, JSON, markup, query strings, calls) is one at any length and of any characters: in quotes up to
the closing quote; else up to a blank, quote, angle bracket, the next `,key=`, or closing brackets
and punctuation at its end, which do not count as the value's own. Outside these, each run of 12 or more
characters of keys that holds a digit is one, perhaps after a key and `=` or `:`. Rejection is the forest's. What the forest sees of it: its length, changes between kinds of characters, shares
of digits and capitals, distinct characters, coverage by a dictionary of ordinary and placeholder
words, signs of a path or address, and its key and the two words before it. The forest learns from
labelled findings (text, label); where the caller has none, a set of LABELLED findings is made by
rule. All runs in the JVM: built-in functions, and Spark's own forest.

Cases: null and empty texts have no candidates; findings within one text are scored each. Repeated
rows give repeated result rows, and rows without an id theirs. Very long texts are searched whole; an
empty table gives an empty result. Columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the labelled set made by rule: the bound of what the forest learns from.
LABELLED = 6_000
TREES, DEPTH, SEED = 24, 7, 5
THRESHOLD = 0.5

#: Fixed: white space between words; words that speak for and against a secret; the dictionary.
BLANK = r"[\x20\x09-\x0D]+"
#: A free-standing value and its key.
VALUE = r"(?<![A-Za-z0-9_.-])(?:([A-Za-z0-9_.-]*)[=:])?([A-Za-z0-9_+/.@:-]{12,}+(?:={1,2}(?![A-Za-z0-9]))?)"
SECRET_WORDS = r"pass(?:word|wd|phrase)?|pwd|token|secret|api[_-]?key|apikey|auth|bearer|credential|private|access[_-]?key|key"
#: Parts of names that make a secret key: anywhere in it, and as words of their own (also in camel case).
STRONG = r"(?i:pass(?:word|wd|phrase)|pwd|secret|token|credential|(?:api|access|private)[_.-]?key)"
_WEAK = ["pass", "auth", "authorization", "authentication", "bearer", "private", "key"]
WEAK = rf"(?<![A-Za-z])(?:{'|'.join(_WEAK)})(?![a-z])|(?<![A-Za-z])(?:{'|'.join(w.upper() for w in _WEAK)})(?![A-Za-z])|(?<![A-Z])(?:{'|'.join(w.title() for w in _WEAK)})(?![a-z])"
#: Each key holds one of these.
STEMS = ["pass", "pwd", "secret", "token", "credential", "key", "auth", "bearer", "private"]
#: What stands between key and value: quotes and brackets that close, then a separator; or the rest of a tag.
BETWEEN = r"(?:[\\\"'`\])]{0,6}(?:[ \t]++value)?[ \t]*+(?:=>|:=|={1,3}|:|>|,[ \t]*+(?=[\"']))|(?<=<[A-Za-z0-9_.:-]{1,60})\s[^<>]*+>)"
OPEN = r"(?:\s*+(?=[\[(]{0,3}\\{0,8}[\"'`])|[ \t]*+)(?:(?:[Bb]earer|[Bb]asic|[Tt]oken)[ \t]++)?[\[(]{0,3}(?:\\{1,8}[\"'`]|[\"'`](?![^\"'`\n]*+[\"'`]\s*+[:=]))??"
QUOTED = "|".join(rf"{q}(?:[^{q}\\\n]|\\.)++{q}(?!\s*[:=])" for q in "\"'`")
QUERY = r"(?<=[?&][A-Za-z0-9_.-]{1,60}=)[^&#\s\"'`<>]++"
BARE = r"(?![{\[(]*+(?:\\{0,8}[\"'`]|[<>\s]|$))(?!\{\s*+[A-Za-z0-9_.-]++\s*+[:=])[^\s\"'`<>]+?(?=[\s\"'`<>]|$|\\{1,8}[\"'`]|[,;&?][A-Za-z_][A-Za-z0-9_.-]*+[=:]|[)\]}](?:[^A-Za-z0-9]|$))"
#: Loops over more than one kind of character are possessive: others would go as deep as the value is long.
ASSIGNED = rf"((?=[AaBbCcKkPpSsTt])(?:{STRONG}|{WEAK})(?:(?!{STRONG})[A-Za-z0-9_.-])*+){BETWEEN}{OPEN}({QUOTED}|{QUERY}|{BARE})"
PLAIN_WORDS = r"commit|sha(?:1|256|512)?|md5|checksum|digest|hash|uuid|guid|version|build|revision|example|sample|order|invoice|phone|tel|isbn|id|ref|see|file|page|figure"
DICTIONARY = r"password|changeme|example|sample|placeholder|secret|token|value|your|test|dummy|hello|world|admin|user|name|document|report|version|release|index|image|page|file|data|home|config|module|service|server|client|local|public|static|build|main|http|https|www|com|org|net|html|mail|the|and|for|with|from|that|this|tion|ing|ment|able|1234|0000|abcd|xxxx"

FEATURES = ["length", "changes", "digits", "capitals", "distinct", "covered", "hex", "slashes", "dots", "address", "separators", "secret_near", "plain_near", "assigned"]


def _tail(text: Column) -> Column:
    """The two words at the end of the text, in lower case."""
    words = F.filter(F.split(text, BLANK, -1), lambda w: w != "")
    return F.lower(F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2)), " "))


def _plain(raw: Column) -> Column:
    """An assigned value without its quotes, or without brackets and punctuation at its end."""
    inner = F.when(raw.rlike("^[\"'`]"), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(F.rtrim(raw, F.lit(")]},.;!?")))
    return F.regexp_replace(inner, r"^(?i:bearer|basic|token)\s+", "")


def candidates(text: Column) -> Column:
    """Array of (value, key, before): before are the two words in front."""
    none = F.array().cast("array<struct<value:string,key:string,before:string>>")
    # a lambda evaluates again, for each element, what it refers to outside: so all it needs is bound or zipped
    bound = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    taken = lambda c, p: F.struct(F.regexp_extract_all(c, F.lit(p), F.lit(1)).alias("keys"), F.regexp_extract_all(c, F.lit(p), F.lit(2)).alias("raw"), F.split(c, p, -1).alias("gaps"))

    def found(t: Column, values: Column, lead: Column) -> Column:
        zipped = F.arrays_zip(t.keys.alias("key"), values.alias("value"), F.slice(t.gaps, F.lit(1), F.size(t.keys)).alias("gap"), F.slice(F.concat(F.array(lead), t.raw), F.lit(1), F.size(t.keys)).alias("last"))
        return F.transform(zipped, lambda x: F.struct(x.value.alias("value"), F.lower(F.regexp_replace(x.key, "(?<=[a-z])(?=[A-Z])", "_")).alias("key"), _tail(F.concat(x.last, F.lit(" "), x.gap)).alias("before")))

    def free(part: Column, lead: Column) -> Column:
        got = bound(taken(part, VALUE), lambda t: found(t, t.raw, lead))
        # parts without a digit are not searched at all
        return F.when(part.rlike("[0-9]"), F.filter(got, lambda x: x.value.rlike("[0-9]"))).otherwise(none)

    def both(t: Column) -> Column:
        assigned = F.filter(found(t, F.transform(t.raw, _plain), F.lit("")), lambda x: x.value != "")
        parts = F.arrays_zip(t.gaps.alias("gap"), F.concat(F.array(F.lit("")), t.raw).alias("last"))
        # what is quoted after a key may be a sentence that holds a value
        quoted = F.filter(t.raw, lambda r: r.rlike("^[\"'`].*[\\x20\\x09-\\x0D]"))
        return F.concat(assigned, F.flatten(F.concat(F.transform(parts, lambda x: free(x.gap, x.last)), F.transform(quoted, lambda r: free(r, F.lit(""))))))

    folded = F.lower(text)
    has_key = reduce(or_, [F.contains(folded, F.lit(w)) for w in STEMS])
    return F.when(has_key, bound(taken(text, ASSIGNED), both)).otherwise(free(text, F.lit("")))


def features(rows: DataFrame) -> DataFrame:
    """rows (value, key, before) with the columns in FEATURES; nulls give zeros."""
    v, n = F.coalesce("value", F.lit("")), F.greatest(F.length("value"), F.lit(1))
    near = F.concat_ws(" ", "before", "key")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    left = lambda chars: n - F.length(F.translate(v, chars, ""))
    columns = {
        "length": F.length(v),
        "changes": share(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "covered": (n - F.length(F.regexp_replace(F.lower(v), DICTIONARY, ""))) / n,
        "hex": v.rlike("^[0-9a-fA-F]+$").cast("int"),
        "slashes": left("/"),
        "dots": left("."),
        "address": v.rlike("@|://|^www").cast("int"),
        "separators": left("-_:"),
        "secret_near": near.rlike(rf"(?:^|[^a-z])(?:{SECRET_WORDS})s?(?:$|[^a-z])").cast("int"),
        "plain_near": near.rlike(rf"(?:^|[^a-z])(?:{PLAIN_WORDS})(?:$|[^a-z])").cast("int"),
        "assigned": (near.rlike("[=:][\"'`]?$") | (F.coalesce("key", F.lit("")) != "")).cast("int"),
    }
    return rows.withColumns({k: F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in columns.items()})


def labelled_findings(spark: SparkSession, n: int = LABELLED, first: int = 0) -> DataFrame:
    """n findings made by rule, the same for the same numbers from first on: text (one candidate with its words around) and label 1 for secrets. Random strings of usual formats with and without a key are secrets; digests, identifiers, placeholders, versions, numbers, addresses and paths are not."""
    i = F.col("id")
    salt = lambda k: F.sha2(F.concat_ws("-", F.lit(k), i.cast("string")), 256)
    pick = lambda k, values: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(F.lit(k), i), F.lit(len(values))) + 1).cast("int"))
    size = lambda k, low, high: (F.pmod(F.xxhash64(F.lit(k), i), F.lit(high - low + 1)) + low).cast("int")
    hexed = F.left(salt("hex"), size("hexsize", 16, 64))
    letters = F.regexp_replace(F.base64(F.unhex(salt("b64"))), "[=/+]", "x")
    based = F.left(F.concat(letters, F.regexp_replace(F.base64(F.unhex(salt("b642"))), "[=/+]", "y")), size("bsize", 20, 60))
    upper = F.concat(F.lit("AKIA"), F.upper(F.translate(F.left(salt("aki"), F.lit(16)), "0189", "KQZW")))
    digit = F.concat(F.lit("7"), based)
    assigned = F.concat(pick("key", ["password", "passwd", "token", "secret", "api_key", "auth_token", "access_key"]), pick("eq", ["=", ": ", " = \"", "=\""]))
    word = pick("word", ["report", "index", "document", "service", "image", "the", "release", "annual", "summary", "chapter"])
    number = F.pmod(F.xxhash64(F.lit("num"), i), F.lit(10**12)).cast("string")
    date = F.concat_ws("-", size("y", 1990, 2030).cast("string"), F.lpad(size("m", 1, 12).cast("string"), 2, "0"), F.lpad(size("d", 1, 28).cast("string"), 2, "0"))
    uuid = F.concat_ws("-", *[F.substring(salt("uuid"), a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    secrets = [F.concat(assigned, hexed), F.concat(assigned, digit), upper, F.concat(assigned, upper), F.concat(F.lit("Bearer "), digit), F.concat(assigned, F.left(hexed, F.lit(18)))]
    name = pick("name", ["password", "api_key", "token", "client_secret", "accessToken", "DB_PASSWORD", "S3_SECRET", "auth"])
    random = F.when(F.pmod(F.xxhash64(F.lit("rnd"), i), F.lit(2)) == 0, hexed).otherwise(digit)
    noun = lambda k: pick(k, ["purple", "falcon", "river", "copper", "window", "thunder", "garden", "marble", "winter", "saddle"])
    glue = pick("glue", ["-", "_", "."])
    mark = pick("mark", ["&", "#", "!", "$", "%", "^", "*", "~"])
    secrets += [
        F.concat(F.lit('{"'), name, F.lit('":"'), random, F.lit('"}')),
        F.concat(F.lit("https://h.io/x?"), name, F.lit("="), random),
        F.concat(F.lit("login("), name, F.lit('="'), random, F.lit('")')),
        F.concat(F.lit("<"), name, F.lit(">"), random, F.lit("</"), name, F.lit(">")),
        F.concat(name, F.lit("="), F.left(based, size("short", 4, 8)), mark, F.right(digit, size("short2", 3, 8))),
        F.concat(name, F.lit("="), noun("n1"), size("short3", 1, 999).cast("string")),
        F.concat(name, F.lit("="), noun("n1"), glue, noun("n2"), glue, noun("n3"), F.when(i % 3 == 0, F.concat(glue, noun("n4"))).otherwise("")),
    ]
    nothing = pick("nothing", ["required", "none", "null", "true", "false", "string", "optional", "value", "the", "here", "undefined", "text", "name", "12", "0", "256"])
    plain = [
        F.concat(name, pick("is", ["=", ": ", '": "', "="]), nothing),
        F.concat(F.lit('{"'), name, F.lit('":"'), nothing, F.lit('"}')),
        F.concat(F.lit("<"), name, F.lit(">"), nothing, F.lit("</"), name, F.lit(">")),
        F.concat(F.lit("max_tokens="), size("max", 1, 99_999).cast("string")),
        F.concat(name, F.lit('="'), pick("fill", ["your password here", "your-token-here", "example-secret", "changeme", "<value>", "***", "a test value"]), F.lit('"')),
        F.concat(F.lit('{"'), pick("other", ["id", "ref", "sha256", "commit", "uuid"]), F.lit('":"'), hexed, F.lit('"}')),
        F.concat(pick("sum", ["commit ", "sha256 ", "md5 ", "checksum ", "revision "]), hexed),
        F.concat(pick("idword", ["uuid ", "id ", "ref ", ""]), uuid),
        F.concat(F.lit("password="), pick("ph", ["changeme1234", "example_password1", "your_password_1", "xxxxxxxx0000", "test1234test1234", "password123456"])),
        F.concat(word, F.lit("-"), date, F.lit("."), word, F.lit("1")),
        F.concat(pick("telword", ["tel ", "phone ", "order ", ""]), F.rpad(number, 12, "0")),
        F.concat(word, F.lit("."), size("em", 1, 99).cast("string"), F.lit("@mail"), size("dom", 1, 9).cast("string"), F.lit(".example.com")),
        F.concat(F.lit("/home/"), word, F.lit("/v"), size("v", 1, 9).cast("string"), F.lit("/"), word, F.lit(".html")),
        F.concat(F.lit("https://www.example.com/"), word, F.lit("/"), number),
        F.concat_ws(".", *[size(f"ip{k}", 100, 255).cast("string") for k in range(4)]),
    ]
    choose = lambda forms, k: F.element_at(F.array(*forms), (F.pmod(F.xxhash64(F.lit(k), i), F.lit(len(forms))) + 1).cast("int"))
    rows = spark.range(first, first + n, 1, 4).withColumn("label", F.pmod(i, F.lit(2)).cast("double"))
    return rows.select(F.concat(pick("lead", ["and the ", "of ", "stet. ", "in a "]), F.when(i % 2 == 1, choose(secrets, "s")).otherwise(choose(plain, "p"))).alias("text"), "label")


def fitted(labelled: DataFrame) -> RandomForestClassificationModel:
    """A forest from labelled findings (text, label); of a text with several candidates each has its label."""
    rows = features(labelled.select("label", F.inline(candidates(F.col("text")))))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label").fit(rows)


def scored_candidates(docs: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """docs (doc_id, text) -> row_key, doc_id, value, key, before, probability; a row with a null value where a text has no candidate."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = features(rows.select("doc_id", "row_key", F.inline_outer(candidates(F.col("text")))))
    rows = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
    return rows.select("doc_id", "row_key", "value", "key", "before", F.when(F.col("value").isNotNull(), vector_to_array("probability")[1]).alias("probability"))


def secrets(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_candidates, n_secrets, max_probability (null: no candidate), digests (sorted SHA-256 of the secrets: no value leaves)."""
    model = fitted(labelled if labelled is not None else labelled_findings(docs.sparkSession))
    rows = scored_candidates(docs, model)
    found = F.col("probability") >= threshold
    digests = F.sort_array(F.collect_list(F.when(found, F.sha2("value", 256))))
    out = rows.groupBy("row_key", "doc_id").agg(F.count("value").alias("n_candidates"), F.count_if(found).alias("n_secrets"), F.max("probability").alias("max_probability"), digests.alias("digests"))
    return out.select("doc_id", "n_candidates", "n_secrets", "max_probability", "digests")
