"""Many literal prefixes in one pass over texts: an Aho-Corasick automaton in flat arrays.

Building it gives a table of next states by state and class of byte (bytes that no word holds share
one), and for each state the words that end there. It is sent to each task once, whatever the number of
words, so the plan of a scan has the same size for ten patterns and for a thousand.

A task lays its texts one after the other, a byte that UTF-8 never has between them, cuts that range
into lanes of equal length and moves all lanes on by one byte at a time: one look-up in the table for all
of them. A state depends on as many bytes before it as the longest word has, so each lane begins that
many bytes early. What leaves the pass are the places at which words end.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.plans.packs import Pattern, ScanConfig

#: Bytes of text that a task searches at once, one text at least; least bytes of a lane.
SLICE, LANE = 1 << 20, 256
#: Most bytes of an automaton's words: the bound of its table, 4 bytes for each and each class of byte.
MOST = 1 << 17
#: Never part of UTF-8: stands between texts.
GAP = b"\xff"
#: Texts of more than two windows are searched near their hits only, this many bytes to both sides.
WINDOW = 1024


class Automaton:
    """words: distinct non-empty bytes."""

    def __init__(self, words: list[bytes]):
        if len(set(words)) != len(words) or b"" in words:
            raise ValueError("words have to be distinct and not empty")
        if sum(map(len, words)) > MOST:
            raise ValueError("too many words for one automaton")
        self.words, self.longest = words, max(map(len, words), default=0)
        used = sorted({b for w in words for b in w})
        self.kind = np.zeros(256, np.int32)  # class of a byte; 0: of no word
        self.kind[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for i, word in enumerate(words):
            at = 0
            for k in self.kind[list(word)].tolist():
                if k not in children[at]:
                    children[at][k] = len(children)
                    children.append({})
                    ends.append([])
                at = children[at][k]
            ends[at].append(i)
        step = np.zeros((len(children), width), np.int32)
        fail = [0] * len(children)
        queue = deque()
        for k, child in children[0].items():
            step[0, k] = child
            queue.append(child)
        while queue:  # by depth: the table's row of a state's shorter state is whole before its own
            at = queue.popleft()
            ends[at] = ends[at] + ends[fail[at]]
            step[at] = step[fail[at]]
            for k, child in children[at].items():
                fail[child] = int(step[fail[at], k])
                step[at, k] = child
                queue.append(child)
        #: Next place in `step`, where a state is the start of its row; words that end in a state as ranges of `out`.
        self.width, self.step = width, (step * width).ravel()
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in ends])]).astype(np.int64)
        self.out = np.array([i for x in ends for i in x], np.int64)
        self.ending = np.array([len(x) > 0 for x in ends], bool).repeat(width)

    def find(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Word and end of each occurrence, overlapping ones too, in order of ends."""
        if not self.words or not data:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        before, n, lane = self.longest - 1, len(data), max(LANE, 4 * self.longest)
        lanes = -(-n // lane)
        kinds = np.zeros(before + lanes * lane, np.int32)
        kinds[before : before + n] = self.kind[np.frombuffer(data, np.uint8)]
        state, starts = np.zeros(lanes, np.int32), np.arange(lanes) * lane
        places, states = [], []
        # row t holds the byte that every lane reads in turn t
        turns = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(kinds, before + lane)[::lane].T)
        for t, kind in enumerate(turns):
            state = self.step[state + kind]
            if t >= before and (hit := np.flatnonzero(self.ending[state])).size:
                places.append(starts[hit] + (t - before + 1))
                states.append(state[hit])
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        places, states = np.concatenate(places), np.concatenate(states) // self.width
        order = np.argsort(places, kind="stable")
        places, states = places[order], states[order]
        count = np.diff(self.first)[states]
        at = np.repeat(self.first[states] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        return self.out[at], np.repeat(places, count)

    def occurrences(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, word and start of each occurrence, ordered by text, word and start; after one, the next of the same word begins at its end at the earliest."""
        word, end = self.find(GAP.join(texts))
        size = np.array([len(w) for w in self.words], np.int64)
        begins = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])]).astype(np.int64)
        start = end - size[word]
        text = np.searchsorted(begins, start, "right") - 1
        order = np.lexsort((start, word, text))
        text, word, start = text[order], word[order], start[order]
        close = np.zeros(len(start), bool)
        close[1:] = (text[1:] == text[:-1]) & (word[1:] == word[:-1]) & (start[1:] < start[:-1] + size[word[1:]])
        if close.any():  # only words that overlap themselves
            keep, last = np.ones(len(start), bool), None
            run = np.cumsum(~close) - 1
            for i in np.flatnonzero(np.isin(run, run[close])).tolist():
                if not close[i]:
                    last = start[i]
                elif start[i] < last + size[word[i]]:
                    keep[i] = False
                else:
                    last = start[i]
            text, word, start = text[keep], word[keep], start[keep]
        return text, word, start - begins[text]


def batches_of(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of a column, one row at least."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // most
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(size, size[start], "right"))
            yield batch.slice(start, stop - start)
            start = stop


def folded(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes with A-Z lower-cased; nulls are empty."""
    raw = pc.fill_null(column, "").cast(pa.large_binary())
    return [x.lower() for x in raw.to_pylist()]


def dictionary_hits(content: DataFrame, words: list[str], most: int = MOST) -> DataFrame:
    """content (content_id, text) -> content_id, word, start (bytes): each occurrence of the words, A-Z folded on both sides, non-overlapping for each word. Words that fold alike are one, empty ones none; null texts hold none. Words of more than `most` bytes together are searched in several passes."""
    known = sorted({_low(w) for w in words} - {""})
    part = np.cumsum([len(w.encode()) for w in known]) // most
    parts = [[w for w, p in zip(known, part, strict=True) if p == k] for k in np.unique(part)] or [[]]
    kind = content.schema["content_id"].dataType.simpleString()
    rows = content.select("content_id", F.col("text").cast("string").alias("text"))

    def searched(own: list[str]) -> DataFrame:
        held = content.sparkSession.sparkContext.broadcast(Automaton([w.encode() for w in own]))

        def run(batches):
            automaton, names = held.value, pa.array(own, pa.string())
            for batch in batches_of(batches, "text"):
                text, word, start = automaton.occurrences(folded(batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("content_id").take(pa.array(text)), names.take(pa.array(word)), pa.array(start)], ["content_id", "word", "start"])

        return rows.mapInArrow(run, f"content_id {kind}, word string, start long")

    return reduce(DataFrame.unionByName, map(searched, parts))


def _low(word: str) -> str:
    return word.encode().lower().decode()


def prefix_hits(content: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """content (content_id, text) -> content_id, prefix, start: the occurrences of the patterns' prefixes. Patterns with equal prefixes share one; those without have no hits."""
    return dictionary_hits(content, [p.prefix for p in patterns]).withColumnRenamed("word", "prefix")


def islands(starts: np.ndarray, size: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Ranges of bytes within `window` of a hit; ranges that touch or overlap are one."""
    low, high = np.maximum(starts - window, 0), np.minimum(starts + window, size)
    fresh = np.ones(len(low), bool)
    fresh[1:] = low[1:] > np.maximum.accumulate(high)[:-1]
    first = np.flatnonzero(fresh)
    return list(zip(low[first].tolist(), np.maximum.reduceat(high, first).tolist(), strict=True)) if len(first) else []


def _whole_characters(text: bytes, low: int, high: int) -> tuple[int, int]:
    """The range without characters that its borders cut."""
    while low < high and text[low] & 0xC0 == 0x80:
        low += 1
    while low < high < len(text) and text[high] & 0xC0 == 0x80:
        high -= 1
    return low, high


class Rules:
    """A pack as tasks use it: the automaton of its prefixes, its regexes, and which texts each pattern looks at."""

    def __init__(self, patterns: list[Pattern], cfg: ScanConfig, severe: tuple[str, ...], wide: int, windowed: bool):
        self.patterns = [p for p in patterns if (p.category or "uncategorized") not in cfg.disabled]
        prefixes = sorted({_low(p.prefix) for p in self.patterns} - {""})
        self.automaton = Automaton([x.encode() for x in prefixes])
        self.number = {x: i for i, x in enumerate(prefixes)}
        self.severe, self.large, self.wide, self.windowed = severe, cfg.large, wide, windowed

    def regexes(self) -> list[re.Pattern]:
        return [compiled(p.regex) for p in self.patterns]

    def admits(self, p: Pattern, kind: str, size: int) -> bool:
        return (not p.content_types or kind in p.content_types) and not (self.large and size >= self.large and p.severity not in self.severe)

    def matches(self, text: bytes, starts: np.ndarray | None, regex: re.Pattern) -> list[tuple[int, int]]:
        """Ranges of bytes of a pattern's matches, distinct and in order. starts: its prefix's hits; None: the whole text."""
        near = self.windowed and starts is not None and len(text) > 2 * WINDOW
        out = []
        for low, high in islands(starts, len(text)) if near else [(0, len(text))]:
            low, high = _whole_characters(text, low, high)
            part = text[low:high].decode("utf-8", "surrogateescape")  # bytes that are no UTF-8 keep their places
            if len(part) == high - low:
                out += [(low + m.start(), low + m.end()) for m in regex.finditer(part)]
            else:
                at, byte = 0, low
                for m in regex.finditer(part):
                    begin = byte + len(part[at : m.start()].encode("utf-8", "surrogateescape"))
                    end = begin + len(m[0].encode("utf-8", "surrogateescape"))
                    out.append((begin, end))
                    at, byte = m.end(), end
        return out

    def found(self, texts: list[bytes], kinds: list[str], regexes: list[re.Pattern]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """Text, pattern and ranges, for each text and pattern with a match."""
        text, word, start = self.automaton.occurrences([t.lower() for t in texts])
        keys, first = np.unique(text * max(len(self.number), 1) + word, return_index=True)
        hits = dict(zip(keys.tolist(), np.split(start, first[1:]), strict=True)) if len(keys) else {}
        by_text: dict[int, list[int]] = {}
        for k in hits:
            by_text.setdefault(k // len(self.number), []).append(k % len(self.number))
        of_word: dict[int, list[int]] = {}
        always = []
        for i, p in enumerate(self.patterns):
            always.append(i) if not p.prefix else of_word.setdefault(self.number[_low(p.prefix)], []).append(i)
        for i, t in enumerate(texts):
            wanted = [(j, None) for j in always] + [(j, hits[i * len(self.number) + w]) for w in by_text.get(i, ()) for j in of_word[w]]
            for j, starts in sorted(wanted, key=lambda x: x[0]):
                if self.admits(self.patterns[j], kinds[i], len(t)) and (ranges := self.matches(t, starts, regexes[j])):
                    yield i, j, ranges


def compiled(regex: str) -> re.Pattern:
    """Classes such as \\d hold ASCII only."""
    return re.compile(regex, re.ASCII)


def run_rules(held) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(content_id, text, kind) -> a row for each match, and one without a pattern for each content that has none."""

    def run(batches):
        rules = held.value
        regexes, names = rules.regexes(), pa.array([p.name for p in rules.patterns], pa.string())
        for batch in batches_of(batches, "text"):
            texts = pc.fill_null(batch.column("text"), "").cast(pa.large_binary()).to_pylist()
            at, pattern, count, value, start, stop, before, after = ([] for _ in range(8))
            for i, j, ranges in rules.found(texts, batch.column("kind").to_pylist(), regexes):
                t = texts[i]
                for s, e in ranges:
                    at.append(i), pattern.append(j), count.append(len(ranges)), value.append(t[s:e].decode("utf-8", "replace"))
                    start.append(s), stop.append(e), before.append(t[max(s - rules.wide, 0) : s].lower()), after.append(t[e : e + rules.wide].lower())
            rest = np.setdiff1d(np.arange(len(texts)), at)
            none = [None] * len(rest)
            ids = batch.column("content_id").take(pa.array(np.concatenate([np.array(at, np.int64), rest])))
            columns = [ids, names.take(pa.array(pattern + none, pa.int64())), *[pa.array(x + none, k) for x, k in ((value, pa.string()), (start, pa.int32()), (stop, pa.int32()), (count, pa.int64()), (before, pa.binary()), (after, pa.binary()))]]
            yield pa.RecordBatch.from_arrays(columns, ["content_id", "pattern", "value", "start", "stop", "num_matches", "before", "after"])

    return run


def found(content: DataFrame, patterns: list[Pattern], cfg: ScanConfig, severe: tuple[str, ...], wide: int, windowed: bool) -> DataFrame:
    """content (content_id, text, kind) -> see run_rules."""
    for p in patterns:
        compiled(p.regex)
    held = content.sparkSession.sparkContext.broadcast(Rules(patterns, cfg, severe, wide, windowed))
    kind = content.schema["content_id"].dataType.simpleString()
    return content.select("content_id", "text", "kind").mapInArrow(run_rules(held), f"content_id {kind}, pattern string, value string, start int, stop int, num_matches long, before binary, after binary")
