"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

The CGK walk reads a sequence with a pointer that stays or moves on by a random bit of (step, symbol). Sequences at a
small edit distance fall into step again after an edit, so their embeddings have a small Hamming distance. Each repetition
samples a few positions of the embedding as a key; windows of the documents, as long as the items, meet the items that
share a key, and an exact edit distance decides.

Symbols are words (letters and digits, lower-cased). Items are put into bands of similar length and embedded by their
first ``width`` words, the documents by every window of that width. Before embedding, windows that share too few word
4-grams with the band's items to be within the allowed distance of any are left out (the q-gram lemma); the 4-grams
are kept in one table of fixed size, so that it can be sent to all tasks whatever the benchmark's size.
Items too short for the first band allow no edits; all windows of as many words meet them by their hash (band ``-n``).

The longer the items of a band, the more edits are allowed and the fewer repetitions meet, so the number of repetitions
follows from the target recall by drawing copies with as many edits as are allowed; a copy without edits always meets.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .columns import fresh
from .text import IS_ALNUM, LOWER, mix, salted, signed, span_hashes, spans, texts, windows

WIDTHS = (8, 11, 15, 21, 29, 40, 56, 78, 109, 152, 213, 298)
#: On by 7/5 to 62 bands, as many as a mask of a signed 64-bit number holds: the last starts at over 5 * 10^9 words.
while len(WIDTHS) < 62:
    WIDTHS += (WIDTHS[-1] * 7 // 5,)
Q = 4
TABLE_BITS = 20
SAMPLES = 3
#: Most words of windows or pairs that are worked on, or sent on, at once.
MOST_WORDS = 1 << 21
#: Copies drawn to find a band's repetitions. Bands of over DRAWN_WORDS words take the number of the widest below.
DRAWN, DRAWN_WORDS = 200, 2000
#: So many would cost more than they find; a lower ``recall`` or ``rate`` is asked for instead.
MOST_REPETITIONS = 1024
PAD = np.uint64(0x5BD1E995)


def tokens(data: np.ndarray) -> np.ndarray:
    starts, ends = spans(IS_ALNUM[data])
    return span_hashes(LOWER[data], starts, ends)


def band_of(n: int) -> int:
    """The band of an item of ``n`` words; ``-n`` if it is too short for the first."""
    return -n if n < WIDTHS[0] else sum(w <= n for w in WIDTHS[:-1]) - 1


def most_edits(band: int, rate: float) -> int:
    return int(rate * (WIDTHS[band + 1] - 1))


def run_keys(t: np.ndarray, n: int) -> np.ndarray:
    """A key of every ``n`` consecutive words."""
    return salted(windows(t, n), 3000 + n)


def slots_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def cgk_keys(rows: np.ndarray, band: int, repetitions: int) -> np.ndarray:
    """``repetitions`` keys for each row (a window's word hashes, padded by PAD)."""
    n, width = rows.shape
    steps = width + width // 2
    rng = np.random.default_rng(band)
    at = rng.integers(0, steps, (repetitions, SAMPLES))
    pointer = np.zeros((repetitions, n), np.int64)
    keys = np.repeat(salted(np.arange(repetitions, dtype=np.uint64), 1000 + band)[:, None], n, 1)
    line = np.arange(n)[None, :]
    salts = salted(np.arange(repetitions, dtype=np.uint64), 2000 + band)[:, None]
    wide = np.concatenate([rows, np.full((n, 1), PAD)], 1)
    for step in range(steps):
        symbol = wide[line, np.minimum(pointer, width)]
        for r, times in enumerate((at == step).sum(1)):
            if times:
                keys[r] = mix(keys[r] + symbol[r])
        pointer += (mix(symbol ^ (salts + np.uint64(step))) & np.uint64(1)).astype(np.int64)
    return keys.T


@lru_cache(maxsize=None)
def repetitions_for(band: int, rate: float, recall: float, least: int) -> int:
    """The fewest repetitions, ``least`` or more, by which that share of copies with all allowed edits share a key.

    Only windows that start where the copy does are drawn; others that meet add to the recall.
    """
    if not 0 < recall < 1:
        raise ValueError("recall must lie between 0 and 1")
    band = min(band, max(b for b, w in enumerate(WIDTHS) if w <= DRAWN_WORDS))
    width, rng = WIDTHS[band], np.random.default_rng(band)
    whole, copies = np.full((2, DRAWN, width), PAD)
    for k in range(DRAWN):
        words = rng.integers(1, 1 << 62, int(rng.integers(width, WIDTHS[band + 1]))).astype(np.uint64)
        whole[k] = words[:width]
        # Each edit replaces a word, puts one before it or takes it out.
        edited = words.tolist()
        for kind, new in zip(rng.integers(0, 3, int(rate * len(words))).tolist(), rng.integers(1, 1 << 62, len(words)).tolist()):
            at = int(rng.integers(len(edited)))
            edited[at : at + (kind != 1)] = [] if kind == 2 else [new]
        edited = edited[:width]
        copies[k, : len(edited)] = edited
    tried = max(least, 32)
    while True:
        met = np.maximum.accumulate(cgk_keys(whole, band, tried) == cgk_keys(copies, band, tried), 1).mean(0)
        if met[-1] >= recall:
            return max(least, int(np.argmax(met >= recall)) + 1)
        if tried >= MOST_REPETITIONS:
            raise ValueError(f"no {tried} repetitions reach a recall of {recall} at {rate} edits a word for items of {width} words")
        tried *= 2


def _item_rows(repetitions: int, rate: float, recall: float):
    def run(batches):
        for batch in batches:
            out = []
            for item, data in zip(batch.column(0), texts(batch.column(1))):
                t = tokens(data)
                band = band_of(len(t))
                if band < 0:
                    key = run_keys(t, len(t))
                    out.append({"item": item.as_py(), "band": band, "allowed": 0, "item_tokens": signed(t).tolist(), "keys": signed(key).tolist(), "grams": slots_of(key).tolist()})
                elif len(t):
                    w = WIDTHS[band]
                    out.append({"item": item.as_py(), "band": band, "allowed": int(rate * len(t)), "item_tokens": signed(t).tolist(),
                                "keys": signed(cgk_keys(t[None, :w], band, repetitions_for(band, rate, recall, repetitions))[0]).tolist(),
                                "grams": slots_of(windows(t[:w], Q)).tolist()})
            kind = pa.schema([("item", batch.schema.field(0).type), ("band", pa.int64()), ("allowed", pa.int64()), ("item_tokens", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("grams", pa.list_(pa.int64()))])
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return run


def _window_rows(table: np.ndarray, short: np.ndarray, bands: dict[int, int], sizes: list[int], rate: float):
    names = ("at", "row", "band", "start", "doc_tokens", "keys")

    def packed(ids, out):
        lists = [pa.array(out[c], pa.list_(pa.int64())) for c in ("doc_tokens", "keys")]
        longs = [pa.array(out[c], pa.int64()) for c in ("row", "band", "start")]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(out["at"], pa.int64())), *longs, *lists], names=["id", "row", "band", "start", "doc_tokens", "keys"])

    def run(batches):
        for batch in batches:
            ids, out, held = batch.column(0), {k: [] for k in names}, 0
            for k, data in enumerate(texts(batch.column(1))):
                t = tokens(data)
                hits = table[slots_of(windows(t, Q))]
                row = int(salted(windows(t, 1), 5).sum(dtype=np.uint64).view(np.int64)) if len(t) else 0
                for n in sizes:
                    runs = run_keys(t, n)
                    met = np.flatnonzero((short[slots_of(runs)] >> np.uint8(n)) & np.uint8(1))
                    # The first place of each run of words is enough.
                    for s in met[np.unique(runs[met], return_index=True)[1]].tolist():
                        for name, value in zip(names, (k, row, -n, s, signed(t[s : s + n]), signed(runs[s : s + 1]))):
                            out[name].append(value)
                if not hits.any():
                    continue
                for band, repetitions in bands.items():
                    own = (hits >> hits.dtype.type(band)) & hits.dtype.type(1)
                    if not own.any():
                        continue
                    width, edits = WIDTHS[band], most_edits(band, rate)
                    need = max(1, width - Q + 1 - (Q + 1) * edits)
                    total = np.cumsum(np.r_[0, own.astype(np.int64)])
                    last = np.minimum(np.arange(len(own)) + width - Q + 1, len(own))
                    starts = np.flatnonzero(total[last] - total[:-1] >= need)
                    starts = starts[starts <= max(0, len(t) - width + edits)]
                    if not len(starts):
                        continue
                    padded = np.r_[t, np.full(width, PAD)]
                    reach = WIDTHS[band + 1] + edits
                    at_once = max(1, MOST_WORDS // (reach + edits))
                    for part in (starts[lo : lo + at_once] for lo in range(0, len(starts), at_once)):
                        keys = signed(cgk_keys(padded[part[:, None] + np.arange(width)[None, :]], band, repetitions))
                        for s, key in zip(part.tolist(), keys):
                            for name, value in zip(names, (k, row, band, s, signed(t[max(0, s - edits) : s + reach]), key)):
                                out[name].append(value)
                        held += len(part) * (reach + edits)
                        if held >= MOST_WORDS:
                            yield packed(ids, out)
                            out, held = {c: [] for c in names}, 0
            yield packed(ids, out)

    return run


def edit_distances(docs: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """For each pair the least edit distance of the whole item to any run of the document's words, all pairs at once."""
    longest_doc, longest = max(map(len, docs)), max(map(len, items))
    d, a = np.zeros((len(docs), longest_doc), np.int64), np.zeros((len(items), longest), np.int64)
    for k, (x, y) in enumerate(zip(docs, items)):
        d[k, : len(x)], a[k, : len(y)] = x, y
    length, size = np.array([len(y) for y in items]), np.array([len(x) for x in docs])
    ramp = np.arange(longest_doc + 1)
    valid = ramp[None, :] <= size[:, None]
    row = np.zeros((len(docs), longest_doc + 1), np.int64)
    best = np.where(length == 0, 0, 1 << 30)
    for i in range(1, longest + 1):
        new = row + 1
        new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + (d != a[:, i - 1 : i]))
        row = np.minimum.accumulate(new - ramp, 1) + ramp
        done = length == i
        if done.any():
            best[done] = np.where(valid[done], row[done], 1 << 30).min(1)
    return best


def _verify(batches):
    for batch in batches:
        docs, items = ([np.array(x, np.int64) for x in batch.column(k).to_pylist()] for k in (2, 3))
        out = np.zeros(len(docs), np.int64)
        at_once = max(1, min(2000, MOST_WORDS // max(map(len, docs), default=1)))
        for lo in range(0, len(docs), at_once):
            out[lo : lo + at_once] = edit_distances(docs[lo : lo + at_once], items[lo : lo + at_once])
        near = pa.array(out <= np.array(batch.column(4).to_pylist(), np.int64)) if len(docs) else pa.array([], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(5), pa.array(out)], names=["id", "item", "start", "distance"]).filter(near)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.1, recall: float = 0.95, repetitions: int = 16) -> DataFrame:
    """(id, item id, start, distance): documents that hold an item within ``rate`` word edits per item word.

    One row per document and item, with the least distance and the first window (in words) that has it. Items under
    8 words must occur word for word; items without a word are in no document. Null and empty texts hold nothing; repeated rows count once. All exact
    copies are found, and at least about ``recall`` of those at the allowed distance: as many repetitions as that takes, and
    no fewer than ``repetitions``.
    """
    spark = docs.sparkSession
    item_type, id_type = benchmark.schema[item_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).mapInArrow(
        _item_rows(repetitions, rate, recall), f"item {item_type}, band long, allowed long, item_tokens array<bigint>, keys array<bigint>, grams array<bigint>"
    )
    items = materialize(items, "items")
    slots, masks, bands, sizes, short = [], [], set(), set(), np.zeros(1 << TABLE_BITS, np.uint8)
    # At most 2 * 2^20 slots come back, whatever the benchmark's size.
    for r in items.select(F.explode("grams").alias("slot"), "band").groupBy("slot", (F.col("band") < 0).alias("short")).agg(F.bit_or(F.expr("shiftleft(1L, cast(abs(band) as int))")).alias("mask")).toLocalIterator():
        if r["short"]:
            short[r["slot"]] = r["mask"]
            sizes |= {n for n in range(1, WIDTHS[0]) if r["mask"] >> n & 1}
            continue
        slots.append(r["slot"])
        masks.append(r["mask"])
        bands |= {b for b in range(len(WIDTHS)) if r["mask"] >> b & 1}
    # As narrow as the longest item allows.
    table = np.zeros(1 << TABLE_BITS, np.uint16 if max(bands, default=0) < 16 else np.uint64)
    table[np.array(slots, np.int64)] = np.array(masks, table.dtype)
    sent = spark.sparkContext.broadcast((table, short))

    needed = {b: repetitions_for(b, rate, recall, repetitions) for b in sorted(bands)}

    def rows(batches, sizes=sorted(sizes)):
        return _window_rows(*sent.value, needed, sizes, rate)(batches)

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = materialize(own.mapInArrow(rows, f"id {id_type}, row long, band long, start long, doc_tokens array<bigint>, keys array<bigint>"), "windows")
    keyed = found.select("id", "row", "band", "start", F.explode("keys").alias("key"))
    item_keys = items.select("item", F.col("band").alias("item_band"), F.explode("keys").alias("item_key"))
    met = keyed.join(item_keys, (F.col("key") == F.col("item_key")) & (F.col("band") == F.col("item_band"))).select(F.col("id").alias("m_id"), F.col("row").alias("m_row"), F.col("start").alias("m_start"), F.col("band").alias("m_band"), "item").distinct()
    pairs = met.join(found, F.col("m_id").eqNullSafe(F.col("id")) & (F.col("m_row") == F.col("row")) & (F.col("m_start") == F.col("start")) & (F.col("m_band") == F.col("band")))
    pairs = pairs.join(items.select(F.col("item").alias("i_item"), "item_tokens", "allowed"), F.col("item").eqNullSafe(F.col("i_item")))
    checked = pairs.select("id", "item", "doc_tokens", "item_tokens", "allowed", "start").mapInArrow(_verify, f"id {id_type}, item {item_type}, start long, distance long")
    best = checked.groupBy("id", "item").agg(F.min(F.struct("distance", "start")).alias("best"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("best.start").alias("start"), F.col("best.distance").alias("distance"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns, whatever their names; rows of an id go or stay together."""
    (leak,) = fresh(docs.columns, "leak")
    leaks = find_leaks(docs, benchmark, id_col, text_col, **options).select(F.col(id_col).alias(leak)).distinct()
    return docs.join(leaks, F.col(id_col).eqNullSafe(F.col(leak)), "left_anti")
