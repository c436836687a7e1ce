"""Language-model scores: marginal probability over all segmentations into an existing vocabulary's pieces.

The vocabulary is a given subword model's: its pieces stay as they are. Their order gives first
probabilities (by rank), and expectation over all segmentations of all training words, weighted
by their counts, re-estimates them. A word's probability is the sum over all its segmentations,
by a log-space forward recursion, a character without a piece of its own costing its bytes. A text
is its words and one end, whose share among training tokens is its probability. That is `score`.
`word_score` is of a lattice with one edge more for each word that training texts hold, from start
to end, weighted by its share there; the share of words seen once (Good-Turing) is left to the pieces.

Each distinct word is scored once. Counts of all words go through one aggregation; the most
frequent words (HEAD at most) are broadcast and added up where the text is read, and only the
rest meets the word table in a join, so no frequent word is a hot key.

Cases: null texts are empty and have the end alone. Without training documents every count is 0
and probabilities stay those of the ranks. Repeated rows give repeated result rows, and rows without an
id theirs (they are trained on). Very long texts are taken whole; an empty table gives an empty result;
columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, remainder, slices, stored, text_bytes

#: Most words that are broadcast, each of HEAD_BYTES at most: the bound of the broadcast.
HEAD, HEAD_BYTES = 100_000, 64
#: Distinct words that a task counts before it hands its counts on.
COUNTED = 400_000
#: Re-estimations of the pieces' probabilities.
TURNS = 2
SMOOTH = 0.1
_P = np.uint64(0x9E3779B97F4A7C55)
_CELLS = 1 << 20


class Lattice:
    """Forward and backward recursions over batches of words of one length."""

    def __init__(self, pieces: list[str], logp: np.ndarray, byte_logp: float):
        """logp: natural logarithms. A word is written with the mark of a word's start before it."""
        self.byte_logp = byte_logp
        hashes = np.array([int(self._prefix(np.array([[ord(c) for c in x]], np.uint64))[0, -1]) for x in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids, self.logp = hashes[order], order, logp[order]
        self.lengths = sorted({len(x) for x in pieces})
        self.maybe = np.zeros(1 << 20, bool)  # most substrings are no piece; this tells without a search
        self.maybe[hashes >> np.uint64(44)] = True

    @staticmethod
    def _prefix(codes: np.ndarray) -> np.ndarray:
        h = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        for i in range(codes.shape[1]):
            h[:, i + 1] = h[:, i] * _P + (codes[:, i] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        return h

    def _edges(self, codes: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length: score of the piece that starts at each place (-inf: none), the places that have one, and its index (-1: bytes)."""
        h, n, out, power = self._prefix(codes), codes.shape[1], [], np.uint64(1)
        with np.errstate(over="ignore"):  # powers modulo 2^64
            powers = [power := power * _P for _ in range(max(self.lengths, default=1))]
        for size in [x for x in self.lengths if x <= n] or [1]:
            part = h[:, size:] - h[:, :-size] * powers[size - 1]
            flat = part.ravel()
            some = np.flatnonzero(self.maybe[flat >> np.uint64(44)])
            at = np.minimum(np.searchsorted(self.hashes, flat[some]), len(self.hashes) - 1)
            there = self.hashes[at] == flat[some]
            some, at = some[there], at[there]
            if size == 1:
                width = 1 + (codes > 0x7F).astype(int) + (codes > 0x7FF) + (codes > 0xFFFF)
                score, index = width * self.byte_logp, np.full(flat.shape, -1)
                score.ravel()[some], index[some] = self.logp[at], at
                some, at = np.arange(len(flat)), index
            else:
                score = np.full(part.shape, -np.inf)
                score.ravel()[some] = self.logp[at]
            out.append((size, score, some, at))
        return out

    def _forward(self, edges, n: int, rows: int) -> np.ndarray:
        a = np.full((rows, n + 1), -np.inf)
        a[:, 0] = 0
        for i in range(1, n + 1):
            for size, score, *_ in edges:
                if size <= i:
                    a[:, i] = np.logaddexp(a[:, i], a[:, i - size] + score[:, i - size])
        return a

    def marginal(self, codes: np.ndarray) -> np.ndarray:
        return self._forward(self._edges(codes), codes.shape[1], len(codes))[:, -1]

    def expected(self, codes: np.ndarray, counts: np.ndarray, into: np.ndarray) -> None:
        """Adds each piece's expected number of uses to into; what bytes are used for goes to its last place."""
        edges, n = self._edges(codes), codes.shape[1]
        a = self._forward(edges, n, len(codes))
        b = np.full_like(a, -np.inf)
        b[:, n] = 0
        for i in range(n - 1, -1, -1):
            for size, score, *_ in edges:
                if i + size <= n:
                    b[:, i] = np.logaddexp(b[:, i], score[:, i] + b[:, i + size])
        for size, score, some, at in edges:
            row, place = np.divmod(some, n - size + 1)
            use = np.exp(a[row, place] + score.ravel()[some] + b[row, place + size] - a[row, n]) * counts[row]
            into += np.bincount(np.where(at >= 0, self.ids[at], len(into) - 1), use, len(into))


@lru_cache(1)
def vocabulary(path: str) -> list[str]:
    """The model's pieces that stand for text, in order of rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = lambda i: model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i)
    return [p for i in range(model.get_piece_size()) if not odd(i) and (p := model.id_to_piece(i))]


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the words of one length, and their code points with the start mark, in blocks of bounded size."""
    places = defaultdict(list)
    for i, w in enumerate(words):
        places[len(w)].append(i)
    for n, at in places.items():
        step = max(1, _CELLS // (16 * (n + 1)))
        for j in range(0, len(at), step):
            some = at[j : j + step]
            codes = np.frombuffer("".join("▁" + words[i] for i in some).encode("utf-32-le"), "<u4").reshape(len(some), n + 1)
            yield np.array(some), codes.astype(np.uint64)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, learnt = Counter(), Counter()

    def rows():
        words = list(held)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([held[w] for w in words], pa.int64()), pa.array([learnt[w] for w in words], pa.int64())], ["word", "n", "c"])

    for batch in slices(batches):
        for text, learn in zip(text_bytes(batch.column("text")), batch.column("learn").to_pylist(), strict=True):
            words = (text or b"").lower().split()
            held.update(words)
            if learn:
                learnt.update(words)
        if len(held) > COUNTED:
            yield rows()
            held, learnt = Counter(), Counter()
    if held:
        yield rows()


def _expecting(path: str, logp: np.ndarray, byte_logp: float):
    def run(batches):
        lattice, into = Lattice(vocabulary(path), logp, byte_logp), np.zeros(len(logp) + 1)
        for batch in batches:
            words, counts = batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(float)
            for at, codes in by_length(words):
                lattice.expected(codes, counts[at], into)
        used = np.flatnonzero(into)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(into[used])], ["piece", "uses"])

    return run


def _scoring(path: str, logp: np.ndarray, byte_logp: float, total: int, novel: float):
    def run(batches):
        lattice = Lattice(vocabulary(path), logp, byte_logp)
        for batch in batches:
            words = batch.column("word").to_pylist()
            out = np.zeros(len(words))
            for at, codes in by_length(words):
                out[at] = lattice.marginal(codes)
            with np.errstate(divide="ignore"):
                whole = np.log(batch.column("c").to_numpy() / max(total, 1)) + np.log1p(-novel)
            edged = np.logaddexp(out + np.log(novel), whole)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), batch.column("c"), pa.array(out), pa.array(edged)], ["word", "n", "c", "logp", "edged"])

    return run


def _adding(head):
    """Sums over the head's words by document, and a row for each other word of it."""

    def run(batches):
        known = head.value
        base = TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text")), strict=True):
                base += 1
                words = (text or b"").lower().split()
                n_known, base_score, logp, edged, rest = 0, 0.0, 0.0, 0.0, []
                for w, n in Counter(words).items():
                    if (x := known.get(w)) is None:
                        rest.append((doc, base, w, n, 0, 0.0, 0.0, 0.0))
                    else:
                        n_known += n * x[0]
                        base_score += n * x[1]
                        logp += n * x[2]
                        edged += n * x[3]
                rows.append((doc, base, None, len(words), n_known, base_score, logp, edged))
                rows += rest
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            arrays[2] = arrays[2].cast(pa.string())
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row_key", "word", "n", "n_known", "base", "logp", "edged"])

    return run


def _log(counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Natural logarithms of the pieces' smoothed shares; of one byte, as the last count's 256th part."""
    share = (counts + SMOOTH) / (counts.sum() + SMOOTH * len(counts))
    return np.log(share[:-1]), float(np.log(share[-1] / 256))


def lm_scores(docs: DataFrame, vocabulary_path: str, fold: tuple[int, int] = (5, 1), turns: int = TURNS, head: int = HEAD) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, word_score. Held out: crc32(doc_id as text) mod fold[0] is fold[1]."""
    sc = docs.sparkSession.sparkContext
    held_out = F.coalesce(remainder(F.col("doc_id"), fold[0]) == fold[1], F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = docs.select("text", (~held_out).alias("learn")).mapInArrow(_counter, "word string, n long, c long")
    words = stored(counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c")), "words")
    ends = docs.where(~held_out).count()
    c_sum, v, once = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.expr("c > 0")), F.count_if(F.expr("c = 1"))).head()
    total, v = c_sum + ends, v + (ends > 0)

    pieces = vocabulary(vocabulary_path)
    logp, byte_logp = _log(np.append(1e6 / (np.arange(len(pieces)) + 10.0), 1.0))
    for _ in range(turns):
        uses = np.zeros(len(pieces) + 1)
        rows = words.where("c > 0").select("word", "c").mapInArrow(_expecting(vocabulary_path, logp, byte_logp), "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        for r in rows.collect():  # as many rows as the vocabulary has pieces at most
            uses[r.piece] = r.uses
        logp, byte_logp = _log(uses)
    scored = stored(words.mapInArrow(_scoring(vocabulary_path, logp, byte_logp, c_sum, (once + 1) / (c_sum + 2)), "word string, n long, c long, logp double, edged double"), "scored")
    discard(words)

    p_end = (ends + 0.5) / (total + 1)
    goes_on, ends_here = float(np.log1p(-p_end)), float(np.log(p_end))
    below = float(total + 0.5 * (v + 1))
    base = F.log10((F.col("c") + 0.5) / F.lit(below))
    sizes = scored.where(F.octet_length("word") <= HEAD_BYTES).groupBy(F.floor(F.log2("n") * 8).alias("step")).count().orderBy(F.desc("step")).collect()
    least, held = None, 0
    for r in sizes:  # the most frequent words, by steps of an eighth of a doubling
        held += r["count"]
        if held > head:
            break
        least = r.step
    top = scored.where((F.octet_length("word") <= HEAD_BYTES) & (F.floor(F.log2("n") * 8) >= (least if least is not None else 1 << 30))).select("word", (F.col("c") > 0).cast("int").alias("known"), base.alias("base"), "logp", "edged")
    known = sc.broadcast({r.word.encode(): (r.known, r.base, r.logp, r.edged) for r in top.toLocalIterator()})

    parts = stored(docs.mapInArrow(_adding(known), "doc_id long, row_key long, word string, n long, n_known long, base double, logp double, edged double"), "parts")
    rest = parts.where("word is not null").select("doc_id", "row_key", "word", "n").join(scored.select("word", "c", F.col("logp").alias("one"), F.col("edged").alias("other")), "word")
    rest = rest.select("doc_id", "row_key", F.lit(0).cast("long").alias("n_tokens"), F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("n_known"), (F.col("n") * base).alias("base"), (F.col("n") * F.col("one")).alias("logp"), (F.col("n") * F.col("other")).alias("edged"))
    sums = parts.where("word is null").select("doc_id", "row_key", F.col("n").alias("n_tokens"), "n_known", "base", "logp", "edged").unionByName(rest)
    sums = sums.groupBy("row_key").agg(F.max("doc_id").alias("doc_id"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "logp", "edged")])
    to_log10 = 1 / float(np.log(10))
    text_score = lambda words: (F.col(words) + F.col("n_tokens") * goes_on + ends_here) * to_log10
    return sums.select(
        "doc_id", held_out.alias("held_out"), (F.col("n_tokens") + 1).alias("n_tokens"), (F.col("n_known") + int(ends > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + float(np.log10((ends + 0.5) / below))).alias("base_score"), text_score("logp").alias("score"), text_score("edged").alias("word_score"))
