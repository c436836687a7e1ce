"""Token ids of whole documents in Arrow files of equal-length sequences.

Documents are dealt by ranges of doc_id and sorted inside them, so that partitions in order hold
the ids in order. Each task encodes its documents, ends each with the end id, and cuts the stream
into rows of two fixed-size lists, ids and mask (false on the last row's padding), written in
Arrow's file format. Record batches hold a fixed number of rows: row i lies in batch
i // BATCH_ROWS, and a mapped file gives any sequence without a copy. A file's name holds the attempt
that wrote it. The index is written as a table once all tasks have ended, and names the files of the
attempts that counted; what lost attempts left in the folder is in no index.

The index has a row per document: file, place in the file, place in the whole stream. The reader
takes only the index and the files.

Cases: null and empty texts have the end id alone; null ids come first; rows of one id are in order of
their texts, and repeated rows keep a place each; very long texts are encoded whole, into one file; an
empty table gives an empty index. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import os
import re
import string
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, shared_dir, slices, stored

LENGTH, BATCH_ROWS, END = 1024, 64, 2
#: A file is closed after the document with which it reaches this many ids.
FILE_IDS = 16 << 20
#: New words encoded at once.
JOINED = 256
#: Letters in every version of Unicode that stay letters, and as many, when composed and lower-cased; so a run of them is one word of the tokenizer.
PLAIN = "A-Za-zÀ-ÖØ-öø-įı-ſ"
LETTERS = re.compile(f"[{PLAIN}]+")
#: Signs, without the apostrophe, which begins words of its own.
SIGNS = string.punctuation.replace("'", "")
INDEX = "doc_id long, part int, file string, at long, before long, n_tokens long"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri.removeprefix("file:")


def values(column: pa.Array) -> list:
    """Its values; several times as fast as to_pylist."""
    return column.to_numpy(zero_copy_only=False).tolist()


class WordIds:
    """Ids of texts, as bytes of unsigned integers. White space separates the tokenizer's words, and so do signs after a letter or
    digit; so the ids of a text are those of its words and signs. Each is encoded once and remembered, one used since the last
    generation of the memory for one more."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [x.content.lower() for x in self.tokenizer.get_added_tokens_decoder().values()]
        vocab, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        self.last[[i for x, i in vocab.items() if suffix and x.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, words: list[str]) -> list[bytes]:
        """The same for words of plain letters, encoded as one text and parted after the ids that end a word; one by one if these are not as many."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.kind)
        ends = (np.flatnonzero(self.last[ids]) + 1) * self.kind.itemsize
        if len(ends) != len(words):
            return self.encoded(words)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in pairwise([0, *ends.tolist()])]

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        ids = list(map(self.known.get, words))
        fresh = [w for w, x in zip(words, ids, strict=True) if x is None]
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.older, self.known = self.known, {w: x for w, x in zip(words, ids, strict=True) if x is not None}
        new = {w: x for w, x in zip(fresh, map(self.older.get, fresh), strict=True) if x is not None}
        plain = [w for w in fresh if w not in new and LETTERS.fullmatch(w)]
        for i in range(0, len(plain), JOINED):
            some = plain[i : i + JOINED]
            new.update(zip(some, self.joined(some), strict=True))
        other = [w for w in fresh if w not in new]
        new.update(zip(other, self.encoded(other), strict=True))
        self.known.update(new)
        return [new[w] if x is None else x for w, x in zip(words, ids, strict=True)]

    def _words(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words of texts: those of the word without its last signs, and those of the signs."""
        core = pc.ascii_rtrim(words, SIGNS)
        core = pc.if_else(pc.match_substring_regex(core, rf"[0-9{PLAIN}]\z"), core, words)
        cut = np.flatnonzero(pc.not_equal(core, words).to_numpy(zero_copy_only=False))
        signs = np.full(len(words), "", object)
        signs[cut] = [w[len(c) :] for w, c in zip(values(words.take(cut)), values(core.take(cut)), strict=True)]
        pieces = pa.concat_arrays([core, pa.array(signs, words.type)]).dictionary_encode()
        ids = pa.array(self._known(values(pieces.dictionary)), pa.large_binary()).take(pieces.indices)
        return pc.binary_join_element_wise(ids[: len(words)], ids[len(words) :], pa.scalar(b"", ids.type))

    def of_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of a string column; null has none. A word is looked up once, however often the column holds it."""
        texts = pc.fill_null(texts, "")
        low = pc.ascii_lower(texts)
        # names of special tokens are matched before lower-casing
        whole = reduce(pc.or_, (pc.match_substring(low, x) for x in self.special), pa.repeat(False, len(texts)))
        # the tokenizer composes letters and marks before it lower-cases; without marks the order is all the same
        marks = pc.match_substring_regex(texts, "[\u0300-\u037f]")
        words = pc.ascii_split_whitespace(pc.if_else(whole, "", pc.if_else(marks, texts, low)))
        coded = words.values.dictionary_encode()
        ids = self._words(coded.dictionary).take(coded.indices)
        _, ends, raw = ids.buffers()
        ends, raw = np.frombuffer(ends, np.int64)[words.offsets.to_numpy()].tolist(), memoryview(raw or b"")
        out = [bytes(raw[a:b]) for a, b in pairwise(ends)]
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.encoded([texts[i].as_py()])[0]
        return out

    def of(self, text: bytes) -> bytes:
        return self.of_all(pa.array([text.decode()]))[0]


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    """One memory of words for all tasks that a worker process runs."""
    return WordIds(path)


class _Writer:
    """Files of one attempt at a task; their names hold the attempt, so no attempt meets another's files."""

    def __init__(self, folder: str, kind: np.dtype):
        self.where, self.folder = filesystem(folder)
        self.kind, self.n, self.size, self.before, self.parts, self.attempt = kind, 0, 0, 0, [], uuid.uuid4().hex

    def add(self, ids: bytes) -> tuple[str, int, int]:
        """The file, the place in it at which these ids start, and the place in the part."""
        name, at = self.name(), self.size
        self.parts.append(ids)
        self.size += len(ids) // self.kind.itemsize
        return name, at, self.before + at

    def name(self) -> str:
        return f"ids-{TaskContext.get().partitionId():06d}-{self.n:04d}-{self.attempt}.arrow"

    def close(self) -> None:
        if not self.size:
            return
        rows = -(-self.size // LENGTH)
        ids = np.zeros(rows * LENGTH, self.kind)
        ids[: self.size] = np.frombuffer(b"".join(self.parts), self.kind)
        mask = np.arange(rows * LENGTH) < self.size
        listed = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x), LENGTH)
        table = pa.RecordBatch.from_arrays([listed(ids), listed(mask)], ["ids", "mask"])
        with self.where.open_output_stream(f"{self.folder}/{self.name()}") as out, pa.ipc.new_file(out, table.schema) as file:
            for i in range(0, rows, BATCH_ROWS):
                file.write_batch(table.slice(i, BATCH_ROWS))
        self.n, self.before, self.size, self.parts = self.n + 1, self.before + self.size, 0, []


def _encoder(tokenizer: str, folder: str, end: int, file_ids: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches):
        words = word_ids(tokenizer)
        out, last = _Writer(folder, words.kind), np.array([end], words.kind).tobytes()
        part = TaskContext.get().partitionId()
        for batch in slices(batches):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), words.of_all(batch.column("text")), strict=True):
                ids += last
                rows.append((doc, part, *out.add(ids), len(ids) // words.kind.itemsize))
                if out.size >= file_ids:
                    out.close()
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "part", "file", "at", "before", "n_tokens"])
        out.close()

    return encode


class TokenFile:
    """Random access to one file."""

    def __init__(self, uri: str):
        where, path = filesystem(uri)
        self.reader = pa.ipc.open_file(pa.memory_map(path) if isinstance(where, pafs.LocalFileSystem) else where.open_input_file(path))
        self.batch, self.number = None, -1

    def _batch(self, i: int) -> pa.RecordBatch:
        if i != self.number:
            self.number, self.batch = i, self.reader.get_batch(i)
        return self.batch

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of a row; the ids are a view of the file."""
        batch, i = self._batch(row // BATCH_ROWS), row % BATCH_ROWS
        return batch.column("ids")[i].values.to_numpy(), batch.column("mask")[i].values.to_numpy(zero_copy_only=False)

    def ids(self, at: int, n: int) -> np.ndarray:
        """The ids from place at on."""
        size, out = LENGTH * BATCH_ROWS, []
        while n > 0:
            inside = at % size
            some = self._batch(at // size).column("ids").values.to_numpy()[inside : inside + n]
            out.append(some)
            at, n = at + len(some), n - len(some)
        return np.concatenate(out)


def write_tokens(docs: DataFrame, tokenizer: str, end: int = END, folder: str | None = None, file_ids: int = FILE_IDS) -> tuple[DataFrame, str]:
    """Writes the files; returns the index (doc_id, file, at, n_tokens, start in the whole stream) and the folder."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    where, path = filesystem(folder)
    where.create_dir(path, recursive=True)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    index = stored(ordered.mapInArrow(_encoder(tokenizer, folder, end, file_ids), INDEX), "index")
    # one row a part: as many as the shuffle has partitions, a setting
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    bases = list(accumulate((r.n for r in parts), initial=0))
    bases = F.broadcast(spark.createDataFrame([(r.part, base) for r, base in zip(parts, bases)], "part int, base long"))
    return index.join(bases, "part").select("doc_id", "file", "at", "n_tokens", (F.col("base") + F.col("before")).alias("start")), folder


def _reader(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches):
        name, file = None, None
        for batch in batches:
            crcs = []
            for f, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "n_tokens")), strict=True):
                if f != name:
                    name, file = f, TokenFile(f"{folder}/{f}")
                ids = file.ids(at, n)
                crcs.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            columns = [pa.array([x[i] for x in crcs], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), *columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_tokens(index: DataFrame, folder: str) -> DataFrame:
    """What the files hold for each document of the index: doc_id, start, n_tokens, ids_crc32 (as unsigned 32-bit integers)."""
    return index.mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
