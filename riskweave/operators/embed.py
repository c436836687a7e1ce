"""Texts to vectors: token batches through a model, pooled by mask.

A model is anything with `dim`, `tokens(text)`, whole numbers, and `hidden(ids, mask)`, which gives a vector for
each place of a batch of padded sequences. A worker process loads it once and keeps it for all batches and tasks.
The texts of an Arrow batch are cut into sequences of LENGTH tokens, so none is cut short; sequences of like
length go through the model together, padded to the longest, and the vectors of all places that the mask names
are summed for each text. The mean of these, scaled to length 1, is the text's vector.

`Hashing`, the default, needs no file: a word is its own token, and its vector has one place, with a sign, both
from a digest of the word.

Cases: null and empty texts have no token and the zero vector; equal texts have equal vectors whatever stands
beside them; repeated rows give repeated rows; very long texts take as many sequences as they need.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.automaton import batches_of

#: Tokens of a sequence, and places of a batch, padding included.
LENGTH, PLACES = 128, 1 << 14
#: Below this length a vector is left as it is.
TINY = 1e-12


class Model(Protocol):
    dim: int

    def tokens(self, text: str) -> list[int]: ...

    def hidden(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray: ...


class Hashing:
    """A word's token is the first half of its MD5 digest: the place is its remainder by dim, the sign its next bit."""

    WORD = re.compile(rb"[^\x20\x09-\x0D]+")

    def __init__(self, dim: int = 64):
        self.dim, self.known = dim, {}

    def _token(self, word: bytes) -> int:
        if word not in self.known:
            if len(self.known) > 400_000:
                self.known.clear()
            self.known[word] = int.from_bytes(hashlib.md5(word).digest()[:4], "big")
        return self.known[word]

    def tokens(self, text: str) -> list[int]:
        return [self._token(w) for w in self.WORD.findall(text.encode().lower())]

    def hidden(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        out = np.zeros((*ids.shape, self.dim))
        sign = np.where(ids // self.dim % 2 == 0, 1.0, -1.0)
        np.put_along_axis(out, (ids % self.dim)[..., None], sign[..., None], axis=2)
        return out


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1."""
    norm = np.sqrt((v * v).sum(axis=-1, keepdims=True))
    return np.where(norm < TINY, v, v / np.maximum(norm, TINY))


def vectors(model: Model, texts: list[str], length: int = LENGTH, places: int = PLACES) -> tuple[np.ndarray, np.ndarray]:
    """Of each text its vector and the number of its tokens."""
    ids = [model.tokens(t) for t in texts]
    parts = sorted(((t, i, min(i + length, len(x))) for t, x in enumerate(ids) for i in range(0, len(x), length)), key=lambda p: p[2] - p[1])
    sums = np.zeros((len(texts), model.dim))
    at = 0
    while at < len(parts):
        stop = at + 1
        # sorted by length: the last one sets the width
        while stop < len(parts) and (stop + 1 - at) * (parts[stop][2] - parts[stop][1]) <= places:
            stop += 1
        own = parts[at:stop]
        width = own[-1][2] - own[-1][1]
        batch, mask = np.zeros((len(own), width), np.int64), np.zeros((len(own), width), np.int64)
        for row, (t, i, j) in enumerate(own):
            batch[row, : j - i], mask[row, : j - i] = ids[t][i:j], 1
        np.add.at(sums, [t for t, _, _ in own], (model.hidden(batch, mask) * mask[..., None]).sum(axis=1))
        at = stop
    n = np.array([len(x) for x in ids], np.int64)
    return unit(sums / np.maximum(n, 1)[:, None]), n


@lru_cache(4)
def _loaded(load: Callable[[], Model]) -> Model:
    return load()


def embedded(content: DataFrame, load: Callable[[], Model] = Hashing, length: int = LENGTH) -> DataFrame:
    """content (content_id, text) -> content_id, embedding array<double>, n_tokens. load: a function of a module, called once in a worker process."""
    kind = content.schema["content_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(load)
        for batch in batches_of(batches, "text"):
            rows, n = vectors(model, [t or "" for t in batch.column("text").to_pylist()], length)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * model.dim), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("content_id"), flat, pa.array(n)], ["content_id", "embedding", "n_tokens"])

    return content.select("content_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"content_id {kind}, embedding array<double>, n_tokens long")
