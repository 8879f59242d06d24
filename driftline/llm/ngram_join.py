"""N-gram Jaccard join by parity sketches.

A document's set is its distinct word shingles, as 64-bit hashes. A parity sketch XORs one code per member, so
members common to two sets cancel and the distance of two sketches never exceeds the sets' symmetric difference.
Two kinds of sketches are used:

* a bit sketch, one bit per member, 2 to 4 times as wide as the set's size band is large (sizes from 2^j to 2^(j+1) - 1);
  a wide one is folded by XOR to the width of a narrow one. Its Hamming distance discards pairs before their sets are fetched.
  Folded to 256 bits, it also discards pairs inside the join that finds them;
* one of segments, cut by a hash of the member, alike within a size band. A segment is the XOR of its members' 64-bit
  codes. A pair above the threshold differs in at most ``D(n)`` members, so in at most ``D(n)`` segments, and must agree in
  one of any ``D(n) + 1`` (pigeonhole). A set whose partner may lie in a lower band joins in that band too.

The first join is coarse, to shuffle little: segments of several members, of which a set emits its first ``D + 1`` with two
members or more. Of two partners, the one that gets to ``D + 1`` earlier shares one of these with the other, and the
other has not stopped before it. A set with fewer such segments also emits all its segments in a second space, and, if
those are fewer than ``D + 1``, each member in a third; any pair that the first space can miss meets there. So no link
between different sets is lost.

Equal sets are one class from the start, and each batch of rows sends only one of its classes of a bucket through
the shuffle that finds the buckets with company.

The classes with company join once more, by the finest segments, of one member each. They take these in one order, the
rarest among them first. Of two partners the first segment in this order that they share is preceded, in either set, by no
more than the members that the other lacks, for which there are tighter bounds than ``D`` (see ``prefixes``); so
both take it. What many share (a passage, a template, the original of a large group of variants) comes last and is
mostly left out, so variants too far apart to link hardly ever meet, whatever the size of their group. A fine bucket's classes
are compared with one pivot at a time (see ``_links``); only those still in different components after that are compared
with each other. Pairs are verified on whole sets.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..plans.scratch import materialize
from .columns import fresh
from .text import mix, salted, shingle_set, signed, texts

#: Words of the sketch that is compared inside the join.
SKETCH_WORDS = 4


def _class_id(members: np.ndarray) -> np.uint64:
    """A digest of the whole set: equal sets, and only they (but for a chance of 2^-64 a pair), have equal ids."""
    return mix(np.add.reduce(salted(members, 11))[None] + np.uint64(len(members)))[0]


def sketch_words(n: int) -> int:
    """The width of the bit sketch of a set of ``n`` members, in 64-bit words: a power of two."""
    return max(SKETCH_WORDS, (4 << n.bit_length() - 1) // 64)


def bit_sketch(members: np.ndarray, words: int) -> np.ndarray:
    bits = salted(members, 12) & np.uint64(64 * words - 1)
    odd = (np.bincount(bits.astype(np.int64), minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def members_per_segment(ratio: Fraction) -> float:
    """The most members a coarse segment may hold on average so that those with two or more still outnumber ``D``."""
    loads = np.arange(1.2, 8, 0.05)
    rich = (1 - np.exp(-loads) * (1 + loads)) / loads
    good = loads[rich >= 1.06 * float((1 - ratio) / ratio)]
    return float(good.max()) if len(good) else 1.8


def most_different(n: int, ratio: Fraction) -> int:
    """``D(n)``: the largest symmetric difference of a set of ``n`` members and one that it links with."""
    return int(n * (1 - ratio) / ratio)


def bands(n: int, ratio: Fraction) -> range:
    """The size bands of a set of ``n`` members and of all smaller sets that it may link with."""
    least = max(1, -(-n * ratio.numerator // ratio.denominator))
    return range(least.bit_length() - 1, n.bit_length())


def segment_sketch(members: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of the segments that have members, how many they have, and the XOR of the members' codes."""
    place = (salted(members, 13) % np.uint64(segments)).astype(np.uint16 if segments < 1 << 16 else np.int64)
    order = np.argsort(place, kind="stable")
    counts = np.bincount(place, minlength=segments)
    full = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[full]
    return full, counts[full], np.bitwise_xor.reduceat(salted(members, 14)[order], starts)


def segment_keys(members: np.ndarray, ratio: Fraction, load: float) -> np.ndarray:
    """The coarse bucket keys of one set (see the module's docstring)."""
    differ = most_different(len(members), ratio)
    out = [members[:0]]
    for scheme in bands(len(members), ratio) if differ else ():
        full, counts, content = segment_sketch(members, max(1, int((2 << scheme) / (load * float(ratio))) + 1))
        spaces = [np.flatnonzero(counts >= 2)[: differ + 1]]
        if len(spaces[0]) <= differ:
            spaces.append(np.arange(len(full)))
        for space, chosen in enumerate(spaces):
            out.append(mix(content[chosen] + salted(full[chosen].astype(np.uint64), 100 * scheme + space)))
        if len(spaces) > 1 and len(full) <= differ:
            out.append(salted(members, 100 * scheme + 2))
    return np.concatenate(out)


def prefixes(n: F.Column, ratio: Fraction) -> tuple[F.Column, F.Column]:
    """How many fine segments a set of ``n`` members must take to meet every larger, and every smaller, set that it links with.

    Linked sets of a and b members, a <= b, share ratio * b members or more, and 2 * ratio / (1 + ratio) * a or more.
    """
    p, q = ratio.numerator, ratio.denominator
    return F.floor((q - p) * n / (q + p)) + 1, F.floor((q - p) * n / q) + 1


def _profiles(text_at: int, words: int):
    def run(batches):
        for batch in batches:
            rows = []
            for data in texts(batch.column(text_at)):
                members = shingle_set(data, words)
                rows.append((len(members), int(_class_id(members).view(np.int64)), *bit_sketch(members, SKETCH_WORDS).tolist()))
            cols = list(zip(*rows)) if rows else [[]] * (2 + SKETCH_WORDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["id", "n", "cid", *(f"s{k}" for k in range(SKETCH_WORDS))])

    return run


def _bucket_rows(words: int, ratio: Fraction):
    load = members_per_segment(ratio)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            keys, owners = [], []
            for data in texts(batch.column(0)):
                members = shingle_set(data, words)
                cid = int(_class_id(members).view(np.int64))
                if len(members) and cid not in seen:
                    seen.add(cid)
                    keys.append(segment_keys(members, ratio, load))
                    owners.append(np.full(len(keys[-1]), cid, np.int64))
            if not keys:
                continue
            key, owner = np.concatenate(keys), np.concatenate(owners)
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            pivot = np.repeat(owner[first], np.diff(np.r_[first, len(key)]))
            leads = owner == pivot
            bucket = np.where(leads, key, mix(key ^ owner.view(np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(bucket)), pa.array(owner), pa.array(signed(key), mask=leads), pa.array(pivot, mask=leads)],
                names=["bucket", "cid", "key", "lead"],
            )

    return run


def _set_rows(words: int):
    def run(batches):
        for batch in batches:
            sets = [shingle_set(data, words) for data in texts(batch.column(0))]
            ids = [int(_class_id(s).view(np.int64)) for s in sets]
            lists = []
            for parts in ([bit_sketch(s, sketch_words(len(s))) for s in sets], [signed(s) for s in sets]):
                lengths = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
                lists.append(pa.ListArray.from_arrays(lengths, pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *lists], names=["cid", "sketch", "members"])

    return run


def fine_buckets(sets: DataFrame, ratio: Fraction) -> DataFrame:
    """(key, cid, size, small): the fine buckets with company, their classes and their size; ``small`` tells whether the class
    is there for larger partners too, or just for smaller ones.

    Keys are ranked by the number of classes that have them, then by themselves. Those that only one class has come first
    and are counted, not kept.
    """
    keys = sets.select("cid", F.explode("members").alias("key"))
    # Written first, so that Spark can split a very common key in the joins.
    counts = materialize(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key_counts")
    n_keys = sets.select(F.col("cid").alias("own"), F.size("members").alias("n"))
    shared = keys.join(counts, "key").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("size", "key"))).alias("keys"))
    shared = shared.join(n_keys, F.col("cid") == F.col("own")).withColumn("alone", F.col("n") - F.size("keys"))
    small, large = prefixes(F.col("n"), ratio)
    taken = shared.withColumn("take", (large - F.col("alone")).cast("int")).where("take > 0")
    rows = taken.select("cid", (small - F.col("alone")).alias("first"), F.posexplode(F.slice("keys", F.lit(1), F.col("take"))["key"]).alias("nth", "key"))
    rows = materialize(rows.select("key", "cid", (F.col("nth") < F.col("first")).alias("small")), "fine")
    met = materialize(rows.groupBy("key").agg(F.count("*").alias("size"), F.bool_or("small").alias("any")).where("size > 1 AND any").select("key", "size"), "fine_counts")
    return materialize(rows.join(met, "key"), "fine_buckets")


def _close(ratio: Fraction):
    """The condition on sizes and folded sketches that every pair above the threshold meets; for columns of a and b."""
    p, q = ratio.numerator, ratio.denominator
    size = (q * F.least("na", "nb") >= p * F.greatest("na", "nb"))
    distance = sum(F.bit_count(F.col(f"sa{k}").bitwiseXOR(F.col(f"sb{k}"))) for k in range(SKETCH_WORDS))
    return size & (distance * (p + q) <= (q - p) * (F.col("na") + F.col("nb")))


def _side(classes: DataFrame, side: str, *more) -> DataFrame:
    return classes.select(*more, F.col("cid").alias(side), F.col("n").alias(f"n{side}"), *(F.col(f"s{k}").alias(f"s{side}{k}") for k in range(SKETCH_WORDS)))


def _whole_sets(members: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(cid, sketch, members) of every class that meets another one in a bucket."""
    need = members.select("cid").distinct().join(classes.select("cid", "rep"), "cid").select("rep")
    own = docs.select("text", F.col("id").alias("_id")).join(need.distinct(), F.col("_id").eqNullSafe(F.col("rep")), "left_semi").select("text")
    return materialize(own.mapInArrow(_set_rows(words), "cid long, sketch array<bigint>, members array<bigint>").dropDuplicates(["cid"]), "sets")


def _folded(sketch: str, width) -> F.Column:
    """A sketch XORed down to ``width`` words."""
    parts = F.sequence(F.lit(0), (F.size(sketch) / width).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.aggregate(parts, F.lit(0).cast("long"), lambda x, k: x.bitwiseXOR(F.get(F.col(sketch), i + k * width))))


def _verified(pairs: DataFrame, sets: DataFrame, ratio: Fraction) -> DataFrame:
    """Those of ``pairs`` (a, na, b, nb) that meet the threshold: by their wide sketches first, then by their whole sets."""

    def both(df: DataFrame, col: str) -> DataFrame:
        for side in "ab":
            df = df.join(sets.select(F.col("cid").alias(side), F.col(col).alias(f"{col}_{side}")), side)
        return df

    p, q = ratio.numerator, ratio.denominator
    width = F.least(F.size("sketch_a"), F.size("sketch_b"))
    xor = F.zip_with(_folded("sketch_a", width), _folded("sketch_b", width), lambda x, y: x.bitwiseXOR(y))
    same = F.when(F.size("sketch_a") == F.size("sketch_b"), F.zip_with("sketch_a", "sketch_b", lambda x, y: x.bitwiseXOR(y))).otherwise(xor)
    distance = F.aggregate(same, F.lit(0), lambda n, x: n + F.bit_count(x))
    near = both(pairs, "sketch").where(distance * (p + q) <= (q - p) * (F.col("na") + F.col("nb"))).select("a", "na", "b", "nb")
    shared = F.size(F.array_intersect("members_a", "members_b"))
    return both(near, "members").where(q * shared >= p * (F.col("na") + F.col("nb") - shared)).select("a", "b")


def _links(members: DataFrame, classes: DataFrame, sets: DataFrame, ratio: Fraction, star_rounds: int) -> DataFrame:
    """(node, component) of the classes that link, from the fine buckets ``members`` (key, cid, size, small).

    Star rounds first: in every bucket all classes outside the pivot's component are compared with the pivot, which is
    the class with the most company over all its buckets (an original rather than one of its variants), later one drawn by
    a hash, another in each bucket. These rounds end when one finds no link, or after ``star_rounds``. What is still apart in a
    bucket then is compared pair by pair, the smaller set being there for larger ones.
    """
    company = materialize(members.groupBy("cid").agg(F.sum("size").alias("company")), "company")
    known = classes.drop("rep").join(company, "cid")
    members = members.select("key", "cid", "small")
    inside, links, tried, found = members.withColumn("component", F.col("cid")), None, None, None
    turn, last = 0, False
    while not last:
        last = turn >= star_rounds
        rows = materialize(inside.join(known, "cid"), "inside")
        left = _side(rows, "a", F.col("key").alias("ka"), F.col("component").alias("ca"), "small")
        if not last:
            order = F.struct("company", "cid") if turn == 0 else F.struct(F.xxhash64("cid", "key", F.lit(turn)), "cid")
            picked = F.max_by(F.struct("cid", "n", "component", *(f"s{k}" for k in range(SKETCH_WORDS))), order).alias("pivot")
            others = rows.groupBy("key").agg(picked).select("key", "pivot.*")
            wanted = F.col("ca") != F.col("cb")
        else:
            left, others = left.where("small"), rows
            wanted = (F.col("ca") != F.col("cb")) & (F.struct("na", "a") < F.struct("nb", "b"))
        right = _side(others, "b", F.col("key").alias("kb"), F.col("component").alias("cb"))
        pairs = left.join(right, (F.col("ka") == F.col("kb")) & wanted & _close(ratio))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        turn += 1
        if pairs.isEmpty():
            star_rounds = turn
            continue
        new = materialize(_verified(pairs, sets, ratio), "links")
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        if new.isEmpty():
            star_rounds = turn
            continue
        links = new if links is None else links.unionByName(new)
        found = connected_components(links)
        inside = members.join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
        differ = inside.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
        inside = inside.join(differ, "key", "left_semi")
    return found if found is not None else members.select(F.col("cid").alias("node"), F.col("cid").alias("component")).limit(0)


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: Fraction | str = "4/5", star_rounds: int = 5) -> DataFrame:
    """(id, n_shingles, component_id) for each row of ``docs``.

    ``component_id`` is the smallest id that can be reached by links, the row's own included; two rows link when the
    Jaccard similarity of their shingle sets is ``threshold`` or more. Texts without words (null too) have no shingles
    and link with nothing. A null id never is a component's id unless the component has no other. Rows that repeat
    an id stay rows of their own. Other columns of ``docs`` play no part. An empty table gives an empty table.
    """
    ratio = Fraction(threshold)
    if not 0 < ratio <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    sketches = ", ".join(f"s{k} long" for k in range(SKETCH_WORDS))
    profiles = materialize(docs.mapInArrow(_profiles(1, words), f"id {id_type}, n long, cid long, {sketches}"), "profiles")
    classes = profiles.where("n > 0").groupBy("cid").agg(F.min("id").alias("rep"), F.first("n").alias("n"), *(F.first(f"s{k}").alias(f"s{k}") for k in range(SKETCH_WORDS)))
    classes = materialize(classes, "classes")

    rows = docs.select("text").mapInArrow(_bucket_rows(words, ratio), "bucket long, cid long, key long, lead long")
    bucket = Window.partitionBy("bucket")
    met = rows.withColumn("least", F.min("cid").over(bucket)).withColumn("most", F.max("cid").over(bucket))
    met = met.where(F.col("key").isNotNull() | (F.col("least") < F.col("most")))
    met = materialize(met.select(F.coalesce("key", "bucket").alias("key"), "cid", F.coalesce("lead", "least").alias("lead")), "buckets")

    members = materialize(met.select("key", "cid").unionByName(met.select("key", F.col("lead").alias("cid"))).distinct(), "members")
    sets = _whole_sets(members, classes, docs, words)
    found = _links(fine_buckets(sets, ratio), classes, sets, ratio, star_rounds)

    grouped = classes.select("cid", "rep").join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = grouped.join(least, "component").select("cid", "component_id")
    out = profiles.join(named, "cid", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: Fraction | str = "4/5") -> DataFrame:
    """The rows of ``docs`` whose id is their component's id; all columns stay. Rows without a shingle all stay."""
    groups = ngram_jaccard_components(docs, id_col, text_col, words, threshold)
    (kept_id,) = fresh(docs.columns, "kept_id")
    kept = groups.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(kept_id)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(kept_id)), "left_semi")
