"""Alignment of two tokenizers over a corpus, by inverted pair bitmaps.

Every text is encoded by a byte-level vocabulary (A) and by a piece vocabulary (B); tokens of both are laid over the bytes
of the text. Where tokens of both end, a group ends; an A and a B token that share bytes are linked.

Texts are cut into units in front of white space, where neither vocabulary can have a token across; a unit is encoded and
aligned once a task, however often it stands there, and all figures of a text are sums over its units. The linked
pairs of each block of documents are inverted: one posting per pair and block, with a compressed bitmap of the
documents that hold the pair (gaps between set bits as variable-length bytes) and bit planes of how often they hold it
beyond once. Bitmaps of one pair are merged over blocks by adding popcounts, for document counts, and popcounts of planes
times their weights, for link counts. The pairs' counts then go back to the blocks, where the postings hand them to
the documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from ..plans.scratch import materialize

BYTE_MODEL, PIECE_MODEL = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Links and documents of a block at most (one document may have more links), units that a task remembers, characters encoded at once.
BLOCK_LINKS, BLOCK_DOCS, UNITS, ENCODE_CHARS = 6_000_000, 1 << 16, 500_000, 10_000
#: Texts whose new units are learnt together.
STEP = 500
#: Where a unit ends: between a character and the space or newline after it, and after a newline alone. White space is
#: taken widely here, so that runs of it are never cut.
_BARE = "\ue000"
_EDGE = re.compile(r"(?<=\S)(?=[ \n])|(?<=\S\n)(?=\S)")


def _byte_letters() -> dict[str, int]:
    """The letter of each byte in byte-level vocabularies: printable bytes are themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(odd)}


class Vocabularies:
    """Both tokenizers, with the bytes of every token."""

    def __init__(self, byte_model: bytes, piece_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(byte_model)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        letters = _byte_letters()
        self.bytes_a = [b""] * (1 + max(self.a.get_vocab().values()))
        for token, k in self.a.get_vocab().items():
            self.bytes_a[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        if any(re.search("[^▁]▁|.\n|\n.", p) for p in pieces):
            raise ValueError("a piece reaches over the start of a word or a line, so texts cannot be cut there")
        self.size_a, self.size_b = (np.array([len(t) for t in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        say = lambda n, end: np.array([f"{k}{end}" for k in range(n)], object)
        self.say_a, self.say_b = (say(len(self.bytes_a), ","), say(len(self.bytes_a), "|")), (say(len(pieces), ","), say(len(pieces), ";"))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Token ids of a space and ``text`` by A and B; None if either does not give back its bytes."""
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        told = (" " + text).encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != told or b"".join(map(self.bytes_b.__getitem__, b)) != told:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def align(self, a: np.ndarray, b: np.ndarray):
        """Ends of tokens and of groups, the pair of every link with its end, and the texts of the tokens in order of groups, with their ends."""
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        groups = np.intersect1d(ends_a, ends_b, assume_unique=True)
        links = np.union1d(ends_a, ends_b)
        pairs = (a[np.searchsorted(ends_a, links)] << 32) | b[np.searchsorted(ends_b, links)]
        group_a, group_b = np.searchsorted(groups, ends_a), np.searchsorted(groups, ends_b)
        at_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
        at_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        said = np.empty(len(a) + len(b), object)
        said[at_a] = np.where(np.isin(ends_a, groups, assume_unique=True), self.say_a[1][a], self.say_a[0][a])
        said[at_b] = np.where(np.isin(ends_b, groups, assume_unique=True), self.say_b[1][b], self.say_b[0][b])
        return ends_a, ends_b, groups, links, pairs, said


class _Grown:
    """An array that rows are added to."""

    def __init__(self, shape: tuple[int, ...]):
        self._held, self._n = np.zeros((1024, *shape[1:]), np.int64), shape[0]

    @property
    def rows(self) -> np.ndarray:
        return self._held[: self._n]

    def add(self, rows: np.ndarray) -> None:
        if self._n + len(rows) > len(self._held):
            self._held = np.concatenate([self.rows, np.zeros((self._n + 2 * len(rows), *self._held.shape[1:]), np.int64)])
        self._held[self._n : self._n + len(rows)] = rows
        self._n += len(rows)


class _Slots(dict):
    """Numbers keys in the order in which they are first asked for, and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = slot = len(self)
        self.new.append(key)
        return slot


class Units:
    """Encoded and aligned units: per unit the numbers of tokens, groups and links, the pairs, and the groups as text.

    A unit is known by a key: what follows its leading space, or ``_BARE`` and the unit where it has none, twice
    ``_BARE`` if it ends a text with white space.
    """

    def __init__(self, vocabularies: Vocabularies):
        self.v = vocabularies
        self.slots, self.row = _Slots(), _Grown((0,))
        self.said: list[str] = []
        self.counts, self.start, self.pairs = _Grown((0, 4)), _Grown((1,)), _Grown((0,))

    def _append(self, a, b, cuts: np.ndarray) -> np.ndarray | None:
        """Add units that end at the bytes ``cuts`` after what ends at the first of them; None if a token lies across a cut."""
        ends_a, ends_b, groups, links, pairs, said = self.v.align(a, b)
        if not np.isin(cuts[cuts > 0], groups).all():
            return None
        at = [np.searchsorted(x, cuts, "right") for x in (ends_a, ends_b, groups, links)]
        words = at[0] + at[1]
        first = len(self.said)
        self.said += ["".join(said[s:e]) for s, e in zip(words[:-1], words[1:])]
        self.counts.add(np.diff(np.stack(at, 1), axis=0))
        self.start.add(self.start.rows[-1] + at[3][1:] - at[3][0])
        self.pairs.add(pairs[at[3][0] : at[3][-1]])
        return np.arange(first, len(self.said))

    def learn(self) -> None:
        """Encode new units, many at once where each ends in a character; those that cannot be cut out get row -1."""
        new, self.slots.new = self.slots.new, []
        rows, batch, size = np.full(len(new), -1, np.int64), [], 0
        for k, key in enumerate(new):
            unit = " " + key if key[:1] != _BARE else key.lstrip(_BARE)
            if key[:2] == 2 * _BARE or key == _BARE + "\n":
                rows[k] = self._learn([unit])[0]
            elif not unit or unit[-1].isspace() or (unit[0] not in " \n" and unit[0].isspace()):
                continue
            else:
                batch.append((k, unit))
                size += len(unit)
            if size > ENCODE_CHARS:
                at, units = zip(*batch)
                rows[list(at)] = self._learn(list(units))
                batch, size = [], 0
        if batch:
            at, units = zip(*batch)
            rows[list(at)] = self._learn(list(units))
        self.row.add(rows)

    def _learn(self, units: list[str]) -> np.ndarray:
        # A letter stands before all units, and a newline before each that has no white space in front; they belong to no unit.
        parts, cuts, own, at = ["a"], [2], [], 2
        for unit in units:
            if unit[0] not in " \n":
                parts.append("\n")
                at += 1
                cuts.append(at)
            parts.append(unit)
            own.append(len(cuts) - 1)
            at += len(unit.encode())
            cuts.append(at)
        tokens = self.v.encode("".join(parts))
        rows = self._append(*tokens, np.array(cuts)) if tokens else None
        if rows is not None:
            return rows[own]
        return np.concatenate([self._learn([u]) for u in units]) if len(units) > 1 else np.full(1, -1)

    def _keys(self, text: str) -> list[str]:
        if _BARE in text:
            return [_BARE]
        if not (text[0].isspace() or text[-1].isspace() or any(run in text for run in ("  ", " \n", "\n ", "\n\n"))):
            # White space stands alone everywhere, as far as spaces and newlines go; other white space has no key.
            return text.replace("\n", f" {_BARE}\n {_BARE}").split(" ")
        keys = [u[1:] if u[0] == " " else _BARE + u for u in _EDGE.split(" " + text)]
        if text[-1].isspace():
            last = keys[-1]
            keys[-1] = 2 * _BARE + (last[1:] if last[:1] == _BARE else " " + last)
        return keys

    def of(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Rows of the units of each text; a text that cannot be cut is a unit of its own, one without tokens has none."""
        slots = [np.fromiter(map(self.slots.__getitem__, keys), np.int64, len(keys)) for keys in (self._keys(t) if t else [] for t in texts)]
        if self.slots.new:
            self.learn()
        for text, own in zip(texts, slots):
            found = self.row.rows[own]
            if (found < 0).any():
                tokens = self.v.encode(text)
                found = self._append(*tokens, np.array([0, len(text.encode()) + 1])) if tokens else found[:0]
            yield found


def _byte_rows(values: np.ndarray, size: np.ndarray) -> pa.Array:
    """Binary values of the given sizes that stand one after the other."""
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.py_buffer(values)])


def pack(pair: np.ndarray, doc: np.ndarray, often: np.ndarray) -> tuple:
    """Postings of entries that are sorted by pair and document: pairs, numbers of documents and of links, bitmaps, planes."""
    opens = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
    n = np.diff(opens, append=len(pair))
    row = np.repeat(np.arange(len(n)), n)
    rank = np.arange(len(pair)) - opens[row]
    gap = doc - np.r_[-1, doc[:-1]]
    gap[opens] = doc[opens] + 1
    length = 1 + (gap >= 1 << 7) + (gap >= 1 << 14)
    at = np.cumsum(length) - length
    gaps = np.zeros(int(length.sum()), np.uint8)
    for k in range(3):
        has = length > k
        gaps[at[has] + k] = ((gap[has] >> (7 * k)) & 127) | ((length[has] > k + 1) << 7)
    more = often - 1
    width = np.zeros(len(n), np.int64)
    if len(n):
        most = np.maximum.reduceat(more, opens)
        width = np.where(most > 0, np.frexp(most.astype(float))[1], 0)
    size = (n + 7) // 8
    base = np.cumsum(width * size) - width * size
    planes = np.zeros(int((width * size).sum()), np.uint8)
    for k in range(int(width.max(initial=0))):
        has = (more >> k) & 1 == 1
        place = base[row[has]] + k * size[row[has]] + rank[has] // 8
        np.bitwise_or.at(planes, place, (1 << (rank[has] % 8)).astype(np.uint8))
    links = np.add.reduceat(often, opens) if len(n) else n
    return pair[opens], n, links, _byte_rows(gaps, np.add.reduceat(length, opens) if len(n) else n), _byte_rows(planes, width * size)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and the size of each value."""
    column = column.cast(pa.binary())
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return data, np.diff(bounds)


def unpack(n: np.ndarray, bitmaps: pa.Array, planes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, document, times) of all entries of postings with ``n`` documents each."""
    gaps, _ = _flat(bitmaps)
    opens = np.flatnonzero(np.r_[True, gaps[:-1] < 128][: len(gaps)])
    length = np.diff(opens, append=len(gaps))
    gap = np.zeros(len(opens), np.int64)
    for k in range(3):
        has = length > k
        gap[has] |= (gaps[opens[has] + k].astype(np.int64) & 127) << (7 * k)
    row = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    total = np.cumsum(gap)
    doc = total - (total[first] - gap[first])[row] - 1
    rank = np.arange(len(row)) - first[row]
    bits, held = _flat(planes)
    size = (n + 7) // 8
    width, base = held // np.maximum(size, 1), np.cumsum(held) - held
    often = np.ones(len(row), np.int64)
    for k in range(int(width.max(initial=0))):
        has = np.flatnonzero(width[row] > k)
        place = base[row[has]] + k * size[row[has]] + rank[has] // 8
        often[has] += ((bits[place].astype(np.int64) >> (rank[has] % 8)) & 1) << k
    return row, doc, often


_DOC = ("n_a", "n_b", "n_groups", "n_links")
_units: dict[bytes, Units] = {}


def _units_of(byte_model: bytes, piece_model: bytes) -> Units:
    """The units of this Python worker, which serves several tasks."""
    name = hashlib.sha256(byte_model + piece_model).digest()
    if name not in _units:
        _units[name] = Units(Vocabularies(byte_model, piece_model))
    elif len(_units[name].said) > UNITS:
        _units[name] = Units(_units[name].v)
    return _units[name]


def _blocks(batches, models) -> Iterator[pa.RecordBatch]:
    """The documents' own rows and the postings of one task, block by block."""
    part, block = TaskContext.get().partitionId(), 0
    ids, rows, numbers, links = [], [], [], 0
    units = _units_of(*models.value)

    def block_rows():
        doc = np.repeat(np.arange(len(numbers)), [len(x) for x in numbers])
        unit = np.concatenate([*numbers, np.zeros(0, np.int64)]).astype(np.int64)
        n = units.counts.rows[unit, 3]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - units.start.rows[unit], n)
        codes, dense = np.unique(units.pairs.rows, return_inverse=True)
        entries = (dense[place] << 16) | np.repeat(doc, n)
        entries.sort()
        opens = np.flatnonzero(np.r_[True, entries[1:] != entries[:-1]][: len(entries)])
        postings = pack(codes[entries[opens] >> 16], entries[opens] & 0xFFFF, np.diff(opens, append=len(entries)))
        number, said = (part << 32) | block, pa.array([r[-1] for r in rows], pa.string())
        own = [pa.array(np.array([r[k] for r in rows], np.int64)) for k in range(4)]
        yield _row_batch(len(rows), number, {"id": pa.concat_arrays(ids), "ordinal": pa.array(np.arange(len(rows))), **dict(zip(_DOC, own)), "groups_sha256": said})
        yield _row_batch(len(postings[0]), number, dict(zip(("pair", "docs", "links", "bitmap", "planes"), map(pa.array, postings))))

    def _row_batch(n, number, given):
        given = given | {"block": pa.array(np.full(n, number, np.int64))}
        return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    schema = None
    for batch in batches:
        if schema is None:
            named = {"pair": pa.int64(), "docs": pa.int64(), "links": pa.int64(), "bitmap": pa.binary(), "planes": pa.binary(), "ordinal": pa.int64(), "groups_sha256": pa.string()}
            schema = pa.schema([("block", pa.int64()), ("id", batch.schema[0].type), *((c, named.get(c, pa.int64())) for c in ("ordinal", *_DOC, "groups_sha256", "pair", "docs", "links", "bitmap", "planes"))])
        for at in range(0, batch.num_rows, STEP):
            texts = batch.column(1).slice(at, STEP).to_pylist()
            if len(units.said) > UNITS:
                # Unit numbers of the block at hand go with the units.
                if rows:
                    yield from block_rows()
                    ids, rows, numbers, links, block = [], [], [], 0, block + 1
                units = _units_of(*models.value)
            for i, own in enumerate(units.of(texts), at):
                counts = units.counts.rows[own].sum(0).tolist()
                if rows and (links + counts[3] > BLOCK_LINKS or len(rows) == BLOCK_DOCS):
                    yield from block_rows()
                    ids, rows, numbers, links, block = [], [], [], 0, block + 1
                said = hashlib.sha256("".join(map(units.said.__getitem__, own.tolist()))[:-1].encode()).hexdigest() if len(own) else ""
                ids.append(batch.column(0).slice(i, 1))
                rows.append((*counts, said))
                numbers.append(own)
                links += counts[3]
    if rows:
        yield from block_rows()


def invert(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table with a row per document (``pair`` null) and one per pair and block of documents."""
    told = []
    for path in (byte_model, piece_model):
        with open(path, "rb") as f:
            told.append(f.read())
    models = docs.sparkSession.sparkContext.broadcast(tuple(told))  # two files of a few MB
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    long = lambda *names: [StructField(c, LongType()) for c in names]
    schema = StructType([*long("block"), plain.schema["id"], *long("ordinal", *_DOC), StructField("groups_sha256", StringType()), *long("pair", "docs", "links"), StructField("bitmap", BinaryType()), StructField("planes", BinaryType())])
    return materialize(plain.mapInArrow(lambda batches: _blocks(batches, models), schema), "postings")


def pair_counts(inverted: DataFrame) -> DataFrame:
    """(pair, docs, links, best): documents and links that hold each pair, and whether no pair of its B id has more links."""
    pairs = inverted.where("pair is not null").groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))
    pairs = materialize(pairs, "pairs")
    piece = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    top = pairs.groupBy(piece.alias("piece")).agg(F.max("links").alias("most"))
    return pairs.join(top, piece == F.col("piece")).select("pair", "docs", "links", (F.col("links") == F.col("most")).alias("best"))


def token_pairs(docs: DataFrame, **how) -> DataFrame:
    """(a_id, b_id, n_docs, n_links, best) of every pair of tokens that are linked anywhere; parameters as in ``align_tokens``."""
    counted = pair_counts(invert(docs, **how))
    return counted.select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id"), F.col("docs").alias("n_docs"), F.col("links").alias("n_links"), "best")


def _hand_back(postings: pa.Table, scores: pa.Table) -> pa.Table:
    """Sums over the links of each document of one block."""
    postings, scores = postings.sort_by("pair").combine_chunks(), scores.sort_by("held").combine_chunks()
    none = np.zeros(0, np.int64)
    out = {"ordinal": none, "n_best": none, "count_sum": none}
    if postings.num_rows:
        n, bitmaps, planes = (postings.column(c).chunk(0) for c in ("docs", "bitmap", "planes"))
        row, doc, often = unpack(n.to_numpy(), bitmaps, planes)
        sums = np.zeros((2, int(doc.max()) + 1), np.int64)
        for k, score in enumerate(("best", "count")):
            np.add.at(sums[k], doc, often * scores.column(score).to_numpy().astype(np.int64)[row])
        out = {"ordinal": np.arange(sums.shape[1]), "n_best": sums[0], "count_sum": sums[1]}
    block = postings.column("block")[0].as_py() if postings.num_rows else 0
    return pa.table({"block": np.full(len(out["ordinal"]), block, np.int64), **out})


def align_tokens(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    A reads a space and the text, B the text, to which it adds the space; no special tokens. A text that is null or empty, or that
    either vocabulary does not give back byte by byte, has no tokens: zeros and an empty digest. ``n_best`` counts
    the links of pairs that hold the most links of all pairs of their B id, ties included; ``count_sum`` sums the links
    that each link's pair holds in all rows. Texts of any length are read whole. Rows that repeat an id are judged each by
    its own text and count each; null ids are ids like others. Columns besides id and text do not matter. An empty
    table gives an empty table.
    """
    inverted = invert(docs, byte_model, piece_model, id_col, text_col)
    postings = inverted.where("pair is not null")
    counted = pair_counts(inverted).select(F.col("pair").alias("held"), F.col("links").alias("count"), "best")
    scores = postings.select(F.col("block").alias("of"), F.col("pair").alias("held")).join(counted, "held")
    # A block holds a bounded number of links, whichever pairs they are.
    sums = postings.select("block", "pair", "docs", "bitmap", "planes").groupBy("block").cogroup(scores.select("of", "held", "count", "best").groupBy("of"))
    sums = sums.applyInArrow(_hand_back, "block long, ordinal long, n_best long, count_sum long")
    own = inverted.where("pair is null").select("block", "ordinal", "id", *_DOC, "groups_sha256")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return own.join(sums, ["block", "ordinal"], "left").select(F.col("id").alias(id_col), *_DOC, *zero, "groups_sha256")
