"""Quality rules by weak supervision: rules vote or abstain, and posteriors replace all-must-pass.

Every document gets base counts and shape measures in one pass over its whole text. Rules turn
the measures into votes: 1 (good), -1 (bad) or 0 (abstain). Votes are counted by pattern, of which
there are at most 3 to the number of rules whatever the corpus, and expectation-maximisation on
these counts estimates the share of good documents and each rule's vote probabilities in either
class, over the documents that pass the base rule. A document is kept if its posterior probability to be good is a half or more and the base
rule did not fail.

p_good is null where the base rule failed on a vote pattern of its own.

Cases: null, empty and blank texts have no words and fail the base rule. Very long texts are taken
whole. Rows without doc_id and repeated rows have a result row each. An empty table gives an empty
result. Columns are read by name: others than doc_id and text only if they are to be carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, grams, slices, stored, text_bytes

#: Fixed: the symbols counted, and white space between words.
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
_INNER, _FIRST, _MARKS = bytes(range(128, 192)), bytes(range(192, 256)), frozenset(SYMBOLS + b"!")
_UPPER, _LOWER, _DIGITS = (bytes(range(*r)) for r in ((65, 91), (97, 123), (48, 58)))

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_marks", "n_distinct", "n_letters", "n_marked_words"]

#: Votes as (name, bad if, good if); neither: abstains. All counts are of whole texts.
RULES = [
    ("symbols", "10 * n_symbols > n_words", "20 * n_symbols <= n_words"),
    ("symbol_share", "50 * n_symbols > word_chars", "200 * n_symbols <= word_chars"),
    ("marked_words", "10 * n_marked_words > n_words", "20 * n_marked_words <= n_words"),
    ("letters", "100 * n_letters < 88 * word_chars", "100 * n_letters >= 92 * word_chars"),
    ("shouting", "2 * n_upper > n_lower and n_upper > 20", "false"),
    ("exclamations", "5 * n_marks > n_words", "false"),
    ("some_repetition", "10 * n_repeat_words > n_words", "n_repeat_words < 1 and n_words >= 50"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines and n_lines > 3", "false"),
    ("word_length", "word_chars < 3 * n_words or word_chars > 12 * n_words", "word_chars between 4 * n_words and 9 * n_words"),
    ("digits", "5 * n_digits > word_chars", "false"),
    ("variety", "10 * n_distinct < 2 * least(n_words, 500)", "false"),
]
#: What is expected of a rule beforehand: probabilities of a bad vote, none, a good vote, in bad and in good documents; of good documents; and how many documents, as a share of all, this counts as. Without it, EM can explain two correlated rules (that see repetition, say) by a class of their own.
EXPECTED = np.array([[0.3, 0.4, 0.3], [0.02, 0.48, 0.5]])
EXPECTED_GOOD, WEIGHT = 0.85, 0.02
BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def measures(text: bytes | None, hashes: WordHashes) -> tuple[int, ...]:
    text = text or b""
    words = text.split()
    h = hashes.of(words)
    five = grams(h, 5)
    n_repeat = 0
    if len(five):
        _, back, count = np.unique(five, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(count[back] > 1)
        if len(twice):
            edges = np.zeros(len(words) + 1, np.int64)
            np.add.at(edges, twice, 1)
            np.add.at(edges, twice + 5, -1)
            n_repeat = int((np.cumsum(edges) > 0).sum())
    lines = [x for x in text.split(b"\n") if not x.isspace() and x]
    inner = len(text) - len(text.translate(None, _INNER))  # bytes of a code point after its first
    left = lambda drop: len(text) - len(text.translate(None, drop))
    return len(words), len(text) - inner - left(BLANKS), left(SYMBOLS), len(lines) - len(set(lines)), n_repeat, len(lines), left(_UPPER), left(_LOWER), left(_DIGITS), text.count(b"!"), len(set(h.tolist())), left(_UPPER + _LOWER + _FIRST), sum(w[-1] in _MARKS for w in words)


def _measuring(carry: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kept = ["doc_id", *carry]

    def run(batches):
        hashes = WordHashes()
        for batch in slices(batches):
            rows = np.array([measures(t, hashes) for t in text_bytes(batch.column("text"))], np.int64).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *(pa.array(rows[:, i]) for i in range(len(NAMES)))], [*kept, *NAMES])

    return run


def estimated(votes: np.ndarray, counts: np.ndarray, turns: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """EM over vote patterns: posterior of good by pattern, share of good, and probabilities [class, rule, vote + 1]. EXPECTED enters as pseudo-counts, which also fixes which class is the good one."""
    hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    share, table = EXPECTED_GOOD, np.repeat(EXPECTED[:, None, :], votes.shape[1], axis=1)
    beforehand = WEIGHT * counts.sum() + 1
    good = np.full(len(votes), share)
    for _ in range(turns):
        odds = np.log(share) - np.log(1 - share) + np.einsum("prv,rv->p", hot, np.log(table[1]) - np.log(table[0]))
        fresh = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        done, good = np.abs(fresh - good).max(initial=0) < 1e-9, fresh
        if done:
            break
        share = (counts @ good + beforehand * EXPECTED_GOOD) / (counts.sum() + beforehand)
        table = np.stack([(np.einsum("p,prv->rv", counts * side, hot) + beforehand * part * EXPECTED[i]) / (counts @ side + beforehand * part) for i, (side, part) in enumerate(((1 - good, 1 - EXPECTED_GOOD), (good, EXPECTED_GOOD)))])
    return good, float(share), table


def quality(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """docs (doc_id, text) -> doc_id, the measures in NAMES, base_failed, p_good, kept; and the columns in carry (other names than these), each row with its own."""
    spark = docs.sparkSession
    vote = lambda bad, good: F.when(F.expr(bad), 0).when(F.expr(good), 2).otherwise(1)
    code = sum((vote(bad, good) * 3**i for i, (_, bad, good) in enumerate(RULES)), F.lit(0)).cast("int")
    carry = [c for c in carry if c != "doc_id"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[c for c in carry if c != "text"])
    kinds = dict(rows.dtypes)
    measured = rows.mapInArrow(_measuring(carry), ", ".join(["doc_id long", *(f"`{c}` {kinds[c]}" for c in carry), *(f"{x} long" for x in NAMES)]))
    measured = stored(measured.withColumn("votes", code), "measures")
    seen = measured.where(~F.expr(BASE_FAILED)).groupBy("votes").count().collect()  # 3 ** len(RULES) rows at most
    codes = np.array([r.votes for r in seen], np.int64)
    votes = np.stack([codes // 3**i % 3 - 1 for i in range(len(RULES))], axis=1) if seen else np.zeros((0, len(RULES)), int)
    p = estimated(votes, np.array([r["count"] for r in seen], float))[0]
    table = spark.createDataFrame([(int(c), float(x)) for c, x in zip(codes, p, strict=True)], "votes int, p_good double")
    out = measured.join(F.broadcast(table), "votes", "left").withColumn("base_failed", F.expr(BASE_FAILED))
    return out.select("doc_id", *carry, *NAMES, "base_failed", "p_good", (~F.col("base_failed") & (F.coalesce("p_good", F.lit(0.0)) >= 0.5)).alias("kept"))
