"""A sample corpus: values that fit a pattern, planted into contexts and texts, and texts that hold none.

A value is drawn from the syntax tree of the pattern's regex, by a generator seeded with the row's key, so the
same row gives the same value on any machine; it is drawn again until the regex finds just that value in it.
Positives stand in one of CONTEXTS, in turn, with one of the pattern's hotwords that no exclusion would take for
a reason to leave the match alone. Negatives are of NEGATIVES, in turn. The rows are dealt by Spark: each task
draws for its own rows.

Cases: anchors and look-arounds are left to the check; repeats without an end take up to MORE turns more than
asked; a regex that no draw fits fails after TRIES draws. Patterns without hotwords have none in their contexts.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from re import _constants as K
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.automaton import batches_of, compiled
from riskweave.plans.packs import Exclusion, Pattern

MORE, TRIES = 8, 200
PRINTABLE = "".join(chr(i) for i in range(32, 127))
_CLASSES = {K.CATEGORY_DIGIT: string.digits, K.CATEGORY_SPACE: " \t", K.CATEGORY_WORD: string.ascii_letters + string.digits + "_"}
_CLASSES |= {no: "".join(c for c in PRINTABLE if c not in _CLASSES[yes]) for no, yes in ((K.CATEGORY_NOT_DIGIT, K.CATEGORY_DIGIT), (K.CATEGORY_NOT_SPACE, K.CATEGORY_SPACE), (K.CATEGORY_NOT_WORD, K.CATEGORY_WORD))}
#: Where a value stands: {hot} is a hotword or empty.
CONTEXTS = {
    "env file": "# {hot}\nVALUE= {value}\nNEXT=1\n",
    "json": '{{"{hot}": " {value} ", "on": true}}',
    "yaml": "service:\n  # {hot}\n  value: {value}\n  port: none\n",
    "go": "// {hot}\nvar v = ` {value} `\n",
    "python": "# {hot}\nvalue = ''' {value} '''\n",
    "javascript": "const v = ` {value} `; // {hot}\n",
    "markdown": "Use this ({hot}):\n\n```\n{value}\n```\n",
    "build log": "step seven {hot}\n+ run {value}\nstep eight\n",
    "shell": "$ export X= {value} ; {hot}\n",
    "chat": "hey, {hot} : {value} , thanks\n",
    "appsettings": '{{ "{hot}" : {{ "v" : " {value} " }} }}',
    "properties": "# {hot}\nv= {value}\n",
    "ruby": "# {hot}\nv = %q( {value} )\n",
    "php": "// {hot}\n$v = ' {value} ';\n",
    "prose": "We met on a wet day.\nThe {hot} was {value} as far as\nanyone knew.\n",
    "terraform": 'block {{\n  # {hot}\n  v = " {value} "\n}}\n',
}
#: Texts without a value: words are put in for {a}, {b} and {c}.
NEGATIVES = {
    "code": "def {a}({b}):\n    return {c}\n",
    "log": "INFO {a} began\nINFO {b} done\nWARN {c} slow\n",
    "documentation": "# {a}\n\nThe {b} keeps a {c} for later use.\n",
    "yaml": "{a}:\n  {b}: on\n  {c}: off\n",
    "json": '{{"{a}": "{b}", "{c}": null}}',
    "markdown": "* {a}\n* {b}\n\n**{c}**\n",
    "stack trace": "Error: {a}\n  at {b} (main)\n  at {c} (loop)\n",
    "ticket": "Steps: open {a}, press {b}.\nSeen: {c}\n",
    "prompt": "Please write a poem on {a}, {b} and {c}.\n",
    "table": "{a};{b};{c}\n{c};{a};{b}\n",
    "prose": "A {a} and a {b} went to see the {c}.\n",
}


def _set(items: list, negated: bool = False) -> str:
    chars = set()
    for op, arg in items:
        if op is K.NEGATE:
            negated = True
        elif op is K.LITERAL:
            chars.add(chr(arg))
        elif op is K.RANGE:
            chars.update(map(chr, range(arg[0], min(arg[1], arg[0] + 0x250) + 1)))
        elif op is K.CATEGORY:
            chars.update(_CLASSES[arg])
    return "".join(c for c in PRINTABLE if c not in chars) if negated else "".join(sorted(chars))


def drawn(tree, rng: random.Random, groups: dict[int, str] | None = None) -> str:
    """A text of the syntax tree."""
    out, groups = [], {} if groups is None else groups
    for op, arg in tree:
        if op is K.LITERAL:
            out.append(chr(arg))
        elif op is K.NOT_LITERAL:
            out.append(rng.choice(PRINTABLE.replace(chr(arg), "")))
        elif op is K.ANY:
            out.append(rng.choice(PRINTABLE))
        elif op is K.IN:
            out.append(rng.choice(_set(arg)))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            low, high, part = arg
            most = low + MORE if high is K.MAXREPEAT else min(high, low + MORE)
            out += [drawn(part, rng, groups) for _ in range(rng.randint(low, most))]
        elif op is K.SUBPATTERN:
            text = drawn(arg[3], rng, groups)
            if arg[0] is not None:
                groups[arg[0]] = text
            out.append(text)
        elif op is K.ATOMIC_GROUP:
            out.append(drawn(arg, rng, groups))
        elif op is K.BRANCH:
            out.append(drawn(rng.choice(arg[1]), rng, groups))
        elif op is K.GROUPREF:
            out.append(groups.get(arg, ""))
        elif op not in (K.AT, K.ASSERT, K.ASSERT_NOT):
            raise ValueError(f"no draw for {op}")
    return "".join(out)


def value_of(regex: str, seed: str) -> str:
    """A value that the regex finds as a whole, the same for the same seed."""
    rng, whole = random.Random(seed), compiled(regex)
    tree = _parser.parse(regex)
    for _ in range(TRIES):
        value = drawn(tree, rng)
        if [m.span() for m in whole.finditer(value)] == [(0, len(value))]:
            return value
    raise ValueError(f"no draw fits {regex}")


def safe_hotwords(p: Pattern, rules: list[Exclusion]) -> list[str]:
    """The pattern's hotwords that hold no word of an exclusion by nearness; all of them where none is safe."""
    words = [w.strip().lower() for r in rules if r.type != "regex" and r.match_type != "exact" and r.applies_to in ("", "*") for w in r.words if w.strip()]
    safe = [h for h in p.hotwords if not any(w in h.lower() for w in words)]
    return safe or list(p.hotwords)


def positive(p: Pattern, rules: list[Exclusion], n: int, seed: str) -> tuple[str, str, str, str]:
    """Context, text before the value, value, text after it: the n-th sample of a pattern."""
    rng, name = random.Random(f"{seed} context"), list(CONTEXTS)[n % len(CONTEXTS)]
    hot = rng.choice(hot) if (hot := safe_hotwords(p, rules)) else ""
    before, after = CONTEXTS[name].split("{value}")
    return name, before.format(hot=hot), value_of(p.regex, seed), after.format(hot=hot)


def negative(n: int, words: list[str]) -> tuple[str, str]:
    """Kind and text of the n-th sample without a value. words: three or more, letters only."""
    name = list(NEGATIVES)[n % len(NEGATIVES)]
    rng = random.Random(f"negative {n}")
    return name, NEGATIVES[name].format(**dict(zip("abc", rng.sample(words, 3), strict=True)))


def planted(content: DataFrame, patterns: list[Pattern], rules: list[Exclusion], seed: int = 0) -> DataFrame:
    """content (content_id, text) -> content_id, pattern, context, value, start (byte), text: each text with one value planted into its middle, between line ends. The row's pattern and context follow a digest of its id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "text"):
            out = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text, at = text or "", len(text or "") // 2
                p = patterns[key % len(patterns)]
                name, before, value, after = positive(p, rules, key // len(patterns), f"{seed} {key}")
                head = f"{text[:at]}\n{before}"
                out.append((p.name, name, value, len(head.encode()), f"{head}{value}{after}\n{text[at:]}"))
            pattern, name, value, start, full = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("content_id"), *map(pa.array, (pattern, name, value)), pa.array(start, pa.int64()), pa.array(full, pa.string())], ["content_id", "pattern", "context", "value", "start", "text"])

    kind = content.schema["content_id"].dataType.simpleString()
    key = F.pmod(F.crc32(F.concat_ws("\x00", F.col("content_id").cast("string"), "text").cast("binary")), F.lit(1 << 31)).alias("key")
    return content.select("content_id", F.col("text").cast("string").alias("text")).select("*", key).mapInArrow(run, f"content_id {kind}, pattern string, context string, value string, start long, text string")


def corpus(keys: DataFrame, patterns: list[Pattern], rules: list[Exclusion], words: list[str], negatives: float = 0.2, seed: int = 0) -> DataFrame:
    """keys (n long) -> id, pattern (null for negatives), context, value, text, expect_blocked: a sample for each number; of five, one without a value, or the share named."""
    every = max(2, round(1 / negatives)) if negatives > 0 else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n in batch.column("n").to_pylist():
                if every and n % every == 0:
                    name, text = negative(n // every, words)
                    out.append((f"tn-{n:05d}", None, name, None, text, False))
                else:
                    p = patterns[n % len(patterns)]
                    name, before, value, after = positive(p, rules, n // len(patterns), f"{seed} {n}")
                    out.append((f"tp-{n:05d}", p.name, name, value, before + value + after, True))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (*[pa.string()] * 5, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "pattern", "context", "value", "text", "expect_blocked"])

    return keys.select("n").mapInArrow(run, "id string, pattern string, context string, value string, text string, expect_blocked boolean")
