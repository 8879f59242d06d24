"""Removal of repeated word runs by recompression.

Every round names the runs of equal symbols and then the pairs of neighbours of which the first falls into the left and
the second into the right half of all symbols, drawn anew each round. A name is a hash of what it stands for, so all
tasks name alike without a dictionary, and equal word sequences get equal symbols but for some at their edges. On the
lowest levels each symbol has a reach too: the words that decided it. A window that holds a symbol's reach holds that
symbol wherever it stands.

Spark rounds then work from the top down. Pairs of neighbours on the last level are grouped over all documents: windows
inside a pair that a smaller document holds too are known to repeat. Every other window is looked up by its anchor, the
least key of the low symbols whose reach lies inside it; only windows whose anchor stands in two documents are
compared, by 128 bits of hashes. What a task finds is combined in it first, so that a passage that a third of all
documents share sends one row a task, not one a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..plans.scratch import materialize
from .columns import fresh
from .text import IS_WORD, mix, salted, signed, span_hasher, spans

#: Bytes of a batch that are parsed at once (or one text), and rows that are combined at once.
STEP_BYTES, STEP_ROWS = 3_000_000, 1_500_000
#: Rounds whose symbols are anchors; and every how many rounds runs are named. A run has to know both its
#: neighbours, which widens its reach, so runs are named above the anchors only.
ANCHOR_ROUNDS, RUN_ROUNDS = 3, 4


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of all texts, eight bytes at a time, and the number of words of each text."""
    joined = b"\n".join(texts)
    data = np.frombuffer(joined + bytes(8), np.uint8)
    starts, ends = spans(IS_WORD[data[: len(joined)]])
    eight = np.lib.stride_tricks.as_strided(data[:8].view(np.uint64), (len(joined) + 1,), (1,))
    left = ends - starts
    codes = left.astype(np.uint64)
    at, rows = starts, slice(None)
    while len(at):
        kept = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        codes[rows] = mix(codes[rows] * np.uint64(0x9E3779B97F4A7C15) ^ (eight[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - kept))))
        more = np.flatnonzero(left > 8)
        rows = more if isinstance(rows, slice) else rows[more]
        at, left = at[more] + 8, left[more] - 8
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return codes, np.diff(np.searchsorted(starts, bounds), prepend=0)


class Symbols(NamedTuple):
    """One level of documents that stand one after the other: names, where each starts, whether it is the last of its document."""

    name: np.ndarray
    start: np.ndarray
    tail: np.ndarray


def _name_runs(x: Symbols) -> Symbols:
    opens = np.ones(len(x.name), bool)
    opens[1:] = (x.name[1:] != x.name[:-1]) | x.tail[:-1]
    if opens.all():
        return x
    first = np.flatnonzero(opens)
    size = np.diff(first, append=len(opens))
    name = x.name[first]
    runs = size > 1
    name[runs] = mix(name[runs] + size[runs].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return Symbols(name, x.start[first], x.tail[first + size - 1])


def _paired(x: Symbols, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Which symbols are left ones, by a bit of their names that belongs to the level, and which open a pair."""
    left = (x.name >> np.uint64(level)).astype(np.uint8) & np.uint8(1) == 1
    paired = np.zeros(len(left), bool)
    paired[:-1] = left[:-1] & ~left[1:] & ~x.tail[:-1]
    return left, paired


def _name_pairs(x: Symbols, paired: np.ndarray) -> tuple[Symbols, np.ndarray]:
    """The next level, and which symbols of this one start a symbol of it."""
    stays = np.ones(len(paired), bool)
    stays[1:] = ~paired[:-1]
    one = np.flatnonzero(paired)
    name, tail = x.name.copy(), x.tail.copy()
    name[one] = mix(mix(name[one]) * np.uint64(3) + name[one + 1])
    tail[one] = tail[one + 1]
    return Symbols(name[stays], x.start[stays], tail[stays]), stays


def _words(words: np.ndarray, size: np.ndarray) -> Symbols:
    tail = np.zeros(len(words), bool)
    tail[np.cumsum(size[size > 0]) - 1] = True
    return Symbols(words, np.arange(len(words)), tail)


def anchor_keys(x: Symbols, starts: np.ndarray, window: int, hasher) -> tuple[np.ndarray, Symbols]:
    """The anchor of each window, and the level on which the anchors were named.

    ``low`` and ``high`` bound the reach of each symbol. A left symbol without a partner has seen its right neighbour, a
    right one its left neighbour, so a reach grows by a symbol at most a round. Where a document ends the reach
    leaves it. Reaches never run backwards, so the symbols of a window are neighbours, and the least of their keys is
    found from minima over 1, 2, 4, ... of them. A window that holds no reach of the highest level takes the level below; words
    themselves lie in every window.
    """
    n = len(x.name)
    low, high = x.start, x.start + 1
    every = []
    for level in range(ANCHOR_ROUNDS + 1):
        if level:
            left, paired = _paired(x, level)
            ends = np.r_[x.start[1:], n]
            lower = np.where(np.r_[True, x.tail[:-1]], x.start - 1, np.r_[low[:1], low[:-1]])
            upper = np.where(x.tail, ends + 1, np.r_[high[1:], high[-1:]])
            partner = np.r_[high[1:], high[-1:]]
            high = np.where(paired, partner, np.where(left, np.maximum(high, upper), high))
            low = np.where(left, low, np.minimum(low, lower))
            x, stays = _name_pairs(x, paired)
            low, high = low[stays], high[stays]
        every.append((low, high))
    key, todo = np.zeros(len(starts), np.uint64), np.arange(len(starts))
    for low, high in reversed(every):
        at = starts[todo]
        first = np.cumsum(np.bincount(low + 1, minlength=n + 2))[at]
        last = np.cumsum(np.bincount(high, minlength=n + window + 2))[at + window]
        some = last > first
        first, size, own = first[some], (last - first)[some], todo[some]
        least = hasher(np.maximum(low, 0), np.minimum(high, n))
        doubled = 1
        while len(own):
            here = (size >= doubled) & (size < 2 * doubled)
            key[own[here]] = np.minimum(least[first[here]], least[first[here] + size[here] - doubled])
            if not (size >= 2 * doubled).any():
                break
            least = np.minimum(least, np.r_[least[doubled:], least[-doubled:]][: len(least)])
            doubled *= 2
        todo = todo[~some]
        if not len(todo):
            break
    return key, x


class Parsed(NamedTuple):
    """What a batch of documents is looked up by. ``doc`` is the number of the document in the batch."""

    first: np.ndarray  # where each document starts
    size: np.ndarray
    pairs: np.ndarray  # (start, end) of the symbol pairs of the last level
    pair_doc: np.ndarray
    pair_key: np.ndarray
    pair_check: np.ndarray
    window: np.ndarray  # starts of all windows
    window_doc: np.ndarray
    window_anchor: np.ndarray
    anchor_doc: np.ndarray
    anchor_key: np.ndarray
    hashers: tuple


def parse(words: np.ndarray, size: np.ndarray, window: int, rounds: int, anchors: bool = True) -> Parsed:
    """Pairs and windows of documents whose words stand one after the other; anchors only if they are asked for."""
    first = np.cumsum(size) - size
    doc_of = np.repeat(np.arange(len(size)), size)
    hashers = span_hasher(words), span_hasher(salted(words, 13))
    starts = np.flatnonzero(np.repeat(first + size, size) - np.arange(len(words)) >= window)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return Parsed(first, size, np.zeros((0, 2), np.int64), *[none] * 8, hashers)
    x, changes = _words(words, size), np.zeros(0, bool)
    level = 0
    if anchors:
        key, x = anchor_keys(x, starts, window, hashers[0])
        level = ANCHOR_ROUNDS
        changes = np.r_[True, (key[1:] != key[:-1]) | (np.diff(doc_of[starts]) > 0)]
    for level in range(level + 1, rounds + 1):
        if level > ANCHOR_ROUNDS and level % RUN_ROUNDS == 0:
            x = _name_runs(x)
        x, _ = _name_pairs(x, _paired(x, level)[1])
    ends = np.r_[x.start[1:], len(words)]
    one = np.flatnonzero(~x.tail | np.r_[True, x.tail[:-1]])
    end = np.where(x.tail[one], ends[one], ends[np.minimum(one + 1, len(ends) - 1)])
    long = end - x.start[one] >= window
    pairs = np.stack([x.start[one][long], end[long]], 1)
    at = np.flatnonzero(changes)
    return Parsed(
        first, size, pairs, doc_of[pairs[:, 0]], signed(hashers[0](*pairs.T)), signed(hashers[1](*pairs.T)),
        starts, doc_of[starts], np.cumsum(changes) - 1, doc_of[starts[at]], signed(key[at]) if anchors else none, hashers,
    )


def combined(key: np.ndarray, check: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, check, doc) as an order of rows, whether each is the first document of its key, and whether its key has more."""
    order = np.lexsort((doc, check, key))
    key, check, doc = key[order], check[order], doc[order]
    opens = np.r_[True, (key[1:] != key[:-1]) | (check[1:] != check[:-1])][: len(order)]
    keep = opens | np.r_[True, doc[1:] != doc[:-1]][: len(order)]
    order, opens = order[keep], opens[keep]
    number = np.cumsum(opens) - 1
    return order, opens, np.bincount(number)[number] > 1 if len(order) else opens


def _steps(batches, id_at: int, text_at: int, *more: int) -> Iterator[tuple]:
    """(record batch, row numbers, ids, texts, word codes, words of each text, ...) of ``STEP_BYTES`` of texts at most, or of one text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(sizes):
            to = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), STEP_BYTES, "right")))
            texts = [(t or "").encode() for t in batch.column(text_at).slice(at, to - at).to_pylist()]
            yield (batch, range(at, to), batch.column(id_at).slice(at, to - at), texts, *word_codes(texts), *(batch.column(m) for m in more))
            at = to


def _held(keys: np.ndarray, docs: np.ndarray, lists: pa.Array, rows: list[int]) -> np.ndarray:
    """Whether each key is in the list of its document; ``docs`` ascend."""
    out = np.zeros(len(keys), bool)
    edges = np.searchsorted(docs, np.arange(len(rows) + 1))
    for k, row in enumerate(rows):
        if edges[k] < edges[k + 1] and lists[row].is_valid:
            out[edges[k] : edges[k + 1]] = np.isin(keys[edges[k] : edges[k + 1]], lists[row].values.to_numpy(zero_copy_only=False))
    return out


def _covered(parsed: Parsed, known: np.ndarray, window: int) -> np.ndarray:
    """Whether each window lies inside a pair that is ``known`` to repeat."""
    until = np.zeros(int(parsed.size.sum()) + 1, np.int64)
    np.maximum.at(until, parsed.pairs[known, 0], parsed.pairs[known, 1])
    return np.maximum.accumulate(until)[parsed.window] >= parsed.window + window


_ROWS = "key long, check long, doc long, kind int"
#: Kinds of rows: an anchor or a pair that is to be compared between tasks, and those of which the task knows enough.
ANCHOR, PAIR, ANCHOR_DONE, PAIR_DONE = range(4)


class _Gathered:
    """Rows of several steps, combined before they are sent."""

    def __init__(self):
        self.parts, self.rows = [], 0

    def add(self, key, check, doc):
        self.parts.append((key, check, doc))
        self.rows += len(key)

    def send(self, todo: int, done: int, mutual: bool) -> Iterator[pa.RecordBatch]:
        """The first document of each key is compared with other tasks. Later ones repeat it; with ``mutual``, all of a key that has more do."""
        if self.rows:
            key, check, doc = (np.concatenate(x) for x in zip(*self.parts))
            order, opens, shared = combined(key, check, doc)
            for kind, at in ((todo, order[opens]), (done, order[shared if mutual else ~opens])):
                yield pa.RecordBatch.from_arrays([*(pa.array(x[at]) for x in (key, check, doc)), pa.array(np.full(len(at), kind, np.int32))], ["key", "check", "doc", "kind"])
        self.parts, self.rows = [], 0


def _flags(rows: DataFrame) -> DataFrame:
    """(doc, key, pair) of rows that repeat: a pair in a smaller document, an anchor in any other."""
    # One window for both: rows that are done stand alone in theirs.
    own = rows.withColumn("own", F.when(F.col("kind") >= ANCHOR_DONE, F.col("doc")))
    same = Window.partitionBy("key", "check", "kind", "own")
    marked = own.select("*", F.min("doc").over(same).alias("least"), F.max("doc").over(same).alias("most"))
    repeats = (F.col("kind") >= ANCHOR_DONE) | F.when(F.col("kind") == PAIR, F.col("doc") > F.col("least")).otherwise(F.col("least") < F.col("most"))
    return marked.where(repeats).select("doc", "key", F.col("kind").isin(PAIR, PAIR_DONE).alias("pair"))


def repeated_symbols(docs: DataFrame, window: int, rounds: int) -> DataFrame:
    """(doc, key, pair): symbol pairs that a smaller document holds too, and anchors that another document holds too."""

    def rows(batches):
        pairs, anchors = _Gathered(), _Gathered()
        for _, _, ids, _, words, size in _steps(batches, 0, 1):
            ids, p = ids.to_numpy(zero_copy_only=False), parse(words, size, window, rounds)
            pairs.add(p.pair_key, p.pair_check, ids[p.pair_doc])
            anchors.add(p.anchor_key, np.zeros_like(p.anchor_key), ids[p.anchor_doc])
            if pairs.rows + anchors.rows > STEP_ROWS:
                yield from pairs.send(PAIR, PAIR_DONE, False)
                yield from anchors.send(ANCHOR, ANCHOR_DONE, True)
        yield from pairs.send(PAIR, PAIR_DONE, False)
        yield from anchors.send(ANCHOR, ANCHOR_DONE, True)

    return _flags(docs.mapInArrow(rows, _ROWS))


def repeated_windows(flagged: DataFrame, window: int, rounds: int) -> DataFrame:
    """(doc, key, pair false) of windows outside known pairs that a smaller document holds too, among those with a flagged anchor."""

    def rows(batches):
        found = _Gathered()
        for _, at, ids, _, words, size, pairs, anchors in _steps(batches, 0, 1, 2, 3):
            ids, p = ids.to_numpy(zero_copy_only=False), parse(words, size, window, rounds)
            known = _covered(p, _held(p.pair_key, p.pair_doc, pairs, at), window)
            asked = np.flatnonzero(_held(p.anchor_key, p.anchor_doc, anchors, at)[p.window_anchor] & ~known)
            start = p.window[asked]
            found.add(*(signed(h(start, start + window)) for h in p.hashers), ids[p.window_doc[asked]])
            if found.rows > STEP_ROWS:
                yield from found.send(PAIR, PAIR_DONE, False)
        yield from found.send(PAIR, PAIR_DONE, False)

    return _flags(flagged.mapInArrow(rows, _ROWS)).withColumn("pair", F.lit(False))


def _lists(flags: DataFrame, id_col: str, pairs: str, others: str) -> DataFrame:
    """One row a document, as long as its own repeats."""
    of = lambda wanted: F.collect_list(F.when(F.col("pair") == wanted, F.col("key")))
    return flags.groupBy(F.col("doc").alias(id_col)).agg(of(F.lit(True)).alias(pairs), of(F.lit(False)).alias(others))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, rounds: int = 13, words_col: str = "n_words", removed_col: str = "n_removed") -> DataFrame:
    """``docs`` with the words of repeated windows removed from ``text_col``, their number before and the number removed.

    A window is ``window`` consecutive words, split at ASCII white space, unchanged. A word goes if it is covered by a window that
    also starts in a document with a smaller id, judged on the input. Kept words are joined by one space, in every
    document. Ids are integers. A null text has no words and becomes empty. A document with a null id keeps its words
    and takes none from others. Rows that repeat an id take nothing from each other; each is judged by its own text.
    Texts of any length are read whole. The two new columns' names must be free, all other names may be anything. An
    empty table gives an empty table.
    """
    k, pairs, others, lost = fresh([*docs.columns, words_col, removed_col], "own_id", "pairs", "others", "lost")
    plain = docs.select(F.col(id_col).cast("long").alias(k), F.col(text_col).cast("string").alias("text")).where(F.col(k).isNotNull())
    symbols = materialize(repeated_symbols(plain, window, rounds), "symbols")
    flagged = plain.join(_lists(symbols, k, pairs, others), k)
    windows = materialize(repeated_windows(flagged, window, rounds), "windows")
    flags = _lists(symbols.where("pair").unionByName(windows), lost, pairs, others)
    joined = docs.join(flags, F.col(id_col).cast("long") == F.col(lost), "left").drop(lost)
    columns = docs.columns
    text_at, width = columns.index(text_col), len(columns)

    def keep(batches):
        for batch, at, _, texts, words, size, known, hit in _steps(batches, text_at, text_at, width, width + 1):
            gone = np.zeros(len(words) + 1, np.int64)
            touched = np.array([known[row].is_valid for row in at])
            if touched.any():
                rows = [row for row, yes in zip(at, touched) if yes]
                first = (np.cumsum(size) - size)[touched]
                p = parse(words[np.repeat(touched, size)], size[touched], window, rounds, anchors=False)
                repeats = _covered(p, _held(p.pair_key, p.pair_doc, known, rows), window)
                repeats |= _held(signed(p.hashers[0](p.window, p.window + window)), p.window_doc, hit, rows)
                start = (p.window + (first - p.first)[p.window_doc])[repeats]
                np.add.at(gone, start, 1)
                np.add.at(gone, start + window, -1)
            stays, edge = np.cumsum(gone[:-1]) == 0, 0
            for k, n in enumerate(size):
                own = texts[k].split()
                texts[k] = b" ".join(compress(own, stays[edge : edge + n]) if touched[k] else own).decode()
                edge += n
            lost_words = np.bincount(np.repeat(np.arange(len(size)), size), ~stays, len(size)).astype(np.int64)
            part = batch.slice(at[0], len(at))
            kept = [pa.array(texts, pa.string()) if c == text_at else part.column(c) for c in range(width)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(size.astype(np.int64)), pa.array(lost_words)], [*columns, words_col, removed_col])

    fields = [StructField(c.name, StringType()) if c.name == text_col else c for c in docs.schema]
    return joined.mapInArrow(keep, StructType([*fields, StructField(words_col, LongType()), StructField(removed_col, LongType())]))
