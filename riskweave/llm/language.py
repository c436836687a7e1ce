"""Language of texts by a byte convolutional network.

Filters of several widths slide over the bytes of fixed-length windows (A-Z lower-cased, zero
padding); each filter's maximum over the window, rectified, feeds a softmax. Since the input is one
byte of 256, a filter is a table by byte and offset. The network is trained in numpy on windows of
a bounded sample of labelled texts: SAMPLE documents in all, the same number from each language as
far as it has them, chosen by a hash, WINDOWS windows of each at places spread over the text. It is
applied to every window of every whole text; a text's language has the largest mean probability
over its bytes.

Cases: null texts and those without a letter are `und` with score 0, and so is every text where no
labelled text is there to learn from. Repeated rows give repeated result rows, and rows without an id
theirs; very long texts are scored to their end, BLOCK windows at once; an empty table gives an empty
result; columns besides doc_id, text and lang are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, text_bytes

LENGTH, WIDTHS, FILTERS = 128, (2, 3, 4), 16
#: Bounds of the training sample: documents in all, documents of a language, windows of a document.
SAMPLE, SAMPLE_EACH, WINDOWS = 16_000, 1_500, 4
EPOCHS, BATCH, RATE = 6, 64, 0.02
#: Windows that are scored at once.
BLOCK = 512
UNKNOWN = "und"


class ByteNet:
    def __init__(self, languages: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)
        self.pairs = None

    def compiled(self) -> ByteNet:
        """Tables by pairs of bytes, for fewer look-ups when scoring."""
        self.pairs = [[(t[i][:, None, :] + t[i + 1][None, :, :]).reshape(-1, FILTERS) if i + 1 < len(t) else t[i] for i in range(0, len(t), 2)] for t in self.tables]
        return self

    def _maps(self, x: np.ndarray) -> list[np.ndarray]:
        """Each width's filters at each place of the windows x (rows, LENGTH)."""
        if self.pairs is None:
            return [sum(t[j][x[:, j : LENGTH - len(t) + 1 + j]] for j in range(len(t))) for t in self.tables]
        two = x[:, :-1].astype(np.intp) * 256 + x[:, 1:]
        out = []
        for w, parts in zip(WIDTHS, self.pairs, strict=True):
            n = LENGTH - w + 1
            z = None
            for i, table in enumerate(parts):
                codes = two if 2 * i + 1 < w else x
                part = table.take(codes[:, 2 * i : 2 * i + n], axis=0)
                z = part if z is None else np.add(z, part, out=z)
            out.append(z)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        pooled = np.concatenate([z.max(axis=1) for z in self._maps(x)], axis=1)
        return _softmax(np.maximum(pooled, 0) @ self.dense + self.bias)

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 12) -> ByteNet:
        """Adam on the cross entropy, classes weighted alike."""
        rng = np.random.default_rng(seed)
        count = np.bincount(y, minlength=len(self.languages))
        weight = (len(y) / np.maximum(count, 1) / (count > 0).sum()).astype(np.float32)
        params = [*self.tables, self.dense, self.bias]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for start in range(0, len(x), BATCH):
                some = order[start : start + BATCH]
                xs, ys = x[some], y[some]
                maps = self._maps(xs)
                at = [z.argmax(axis=1) for z in maps]
                pooled = np.concatenate([np.take_along_axis(z, a[:, None, :], 1)[:, 0] for z, a in zip(maps, at, strict=True)], axis=1)
                held = np.maximum(pooled, 0)
                d = _softmax(held @ self.dense + self.bias)
                d[np.arange(len(ys)), ys] -= 1
                d *= weight[ys][:, None] / len(ys)
                back = (d @ self.dense.T) * (pooled > 0)
                grads = [np.zeros_like(t) for t in self.tables] + [held.T @ d, d.sum(axis=0)]
                filters = np.arange(FILTERS)
                for k, a in enumerate(at):
                    g = back[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(len(self.tables[k])):
                        np.add.at(grads[k][j], (np.take_along_axis(xs, a + j, 1), filters), g)
                step += 1
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows(text: bytes) -> np.ndarray:
    """The text's bytes as rows of LENGTH, the last one padded."""
    text = text.lower()
    return np.frombuffer(text + bytes(-len(text) % LENGTH), np.uint8).reshape(-1, LENGTH)


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (re.search(rb"[A-Za-z]", text) is not None or any(map(str.isalpha, text.decode())))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WINDOWS windows a text, spread evenly over it."""
    for batch in slices(batches):
        langs, out = [], []
        for lang, text in zip(batch.column("lang").to_pylist(), text_bytes(batch.column("text")), strict=True):
            if has_letter(text):
                rows = windows(text)
                for i in sorted({(2 * k + 1) * len(rows) // (2 * WINDOWS) for k in range(WINDOWS)}):
                    langs.append(lang)
                    out.append(rows[i].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "window"])


def trained(docs: DataFrame, learn: Column) -> ByteNet | None:
    """A network from those labelled texts for which learn holds; none if there are none."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE).collect()  # as many languages as documents in the sample at most
    if not counts:
        return None
    each = max(1, min(SAMPLE_EACH, SAMPLE // len(counts)))
    rates = docs.sparkSession.createDataFrame([(r.lang, min(1.0, each / r["count"])) for r in counts], "lang string, rate double")
    place = F.xxhash64(F.lit("sample"), "doc_id", "text")
    chance = place.bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    likely = rows.join(F.broadcast(rates), "lang").where(chance < F.col("rate")).select("lang", "text", place.alias("place"))
    # rows that no id tells apart enter together; the limit holds for them, too, and each task hands on no more than it allows
    limit = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    sample = likely.withColumn("nth", limit).where(F.col("nth") <= 2 * each).select("lang", "text").mapInArrow(_cut, "lang string, window binary")
    got = sorted((r.lang, bytes(r.window)) for r in sample.collect())
    languages = sorted({lang for lang, _ in got})
    if not languages:
        return None
    x = np.frombuffer(b"".join(w for _, w in got), np.uint8).reshape(-1, LENGTH)
    index = {lang: i for i, lang in enumerate(languages)}
    return ByteNet(languages).train(x, np.array([index[lang] for lang, _ in got]))


def _predictor(net) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def predict(batches):
        model = net.value.compiled() if net is not None else None
        for batch in slices(batches):
            texts = text_bytes(batch.column("text"))
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            real = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
            if real:
                rows = [windows(texts[i]) for i in real]
                x = np.concatenate(rows)
                p = np.concatenate([model.probabilities(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)])
                p *= (x != 0).sum(axis=1, keepdims=True)
                starts = np.cumsum([0, *map(len, rows)])[:-1]
                sums = np.add.reduceat(p, starts, axis=0)
                sums /= np.maximum(sums.sum(axis=1, keepdims=True), 1e-30)
                for i, k, s in zip(real, sums.argmax(axis=1), sums.max(axis=1), strict=True):
                    langs[i], scores[i] = model.languages[k], min(1.0, float(s))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return predict


def languages(docs: DataFrame, held_out: Column) -> DataFrame:
    """docs (doc_id, text, lang) -> doc_id, held_out, lang_pred, score; learns from rows that are not held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    net = trained(docs, ~F.col("held_out"))
    net = docs.sparkSession.sparkContext.broadcast(net) if net is not None else None
    return docs.select("doc_id", "held_out", "text").mapInArrow(_predictor(net), "doc_id long, held_out boolean, lang_pred string, score double")
