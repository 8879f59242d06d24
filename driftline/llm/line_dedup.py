"""Line dedup by content-defined chunks of lines.

Every line is hashed; blank lines do not count. Within a run of lines that all occur elsewhere too, each line starts one
chunk and ends one: the fewest lines, two at least, that hold ``least_chars`` characters; a line of ``long_line``
characters is a chunk of its own too. Chunks overlap and depend on their own lines alone, so whatever stands around a
passage moves none of its chunks, and together they cover every line of it. Chunks whose hash occurs more than once are
compared with their first occurrence by the SHA-256 of their bytes; equal ones are removed, the first stays.
Only hashes and positions are shuffled until the chunks that repeat are known. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .columns import fresh


def _least_chunk(lines: Column, i: Column, step: int, least_chars: int) -> Column:
    """How many lines the least chunk has that starts (``step`` 1) or ends (-1) at line ``i``; 0 if the run ends before."""
    here, other = F.get(lines, i), F.get(lines, i + step)
    if step > 0:
        ahead = F.slice(lines, i + 1, max(2, least_chars))
    else:
        first = F.greatest(i + 2 - max(2, least_chars), F.lit(1))
        ahead = F.reverse(F.slice(lines, first, i + 2 - first))
    full = lambda acc: (acc["n"] >= 2) & (acc["size"] >= least_chars)

    def add(acc, x):
        take = ~full(acc) & (x["nth"] == acc["next"])
        grown = F.struct((acc["n"] + 1).alias("n"), (acc["size"] + x["size"]).alias("size"), (acc["next"] + step).alias("next"))
        return F.when(take, grown).otherwise(acc)

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), here["nth"].alias("next"))
    walked = F.aggregate(ahead, start, add, lambda acc: F.when(full(acc), acc["n"]).otherwise(0))
    two = (i + step >= 0) & (other["nth"] == here["nth"] + step) & (here["size"] + other["size"] >= least_chars)
    return F.when(F.coalesce(two, F.lit(False)), 2).otherwise(walked)


def repeated_chunks(keyed: DataFrame, long_line: int, least_chars: int) -> DataFrame:
    """(id, k, start, end, chunk) for chunks whose hash occurs at least twice; ``chunk`` is that hash, ``end`` exclusive."""
    every = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x).alias("h"), F.length(F.trim(x)).alias("size")))
    lines = keyed.select("id", "k", F.posexplode(F.filter(every, lambda x: x["size"] > 0)).alias("nth", "line")).select("id", "k", "nth", "line.*")
    # Written first: a join right above the aggregation would reuse its partitioning, and Spark could not split a very common line.
    counts = materialize(lines.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "line_counts")
    # Rows that repeat an id and a text have the same positions twice; they count once.
    known = lines.join(counts, "h").groupBy("id", "k").agg(F.array_sort(F.collect_set(F.struct("nth", "pos", "h", "size"))).alias("lines"))
    # A chunk is its first line's place in ``lines`` and its number of lines, in one number.
    code = lambda at, n: F.when(n > 0, F.shiftleft(at.cast("long"), 32) + n)
    own = lambda step: F.transform("lines", lambda x, i: F.struct(i.alias("i"), _least_chunk(F.col("lines"), i, step, least_chars).alias("n")))
    known = known.select("id", "k", "lines", own(1).alias("starting"), own(-1).alias("ending"))
    codes = F.concat(
        F.transform("starting", lambda c: code(c["i"], c["n"])),
        F.transform("ending", lambda c: code(c["i"] - c["n"] + 1, c["n"])),
        F.transform("lines", lambda x, i: F.when(x["size"] >= long_line, code(i, F.lit(1)))),
    )
    known = known.select("id", "k", "lines", F.array_distinct(F.array_compact(codes)).alias("codes"))

    def chunk(c):
        at, n = F.shiftright(c, 32).cast("int"), c.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
        hashes = F.transform(F.slice("lines", at + 1, n), lambda x: x["h"])
        return F.struct(F.get("lines", at)["pos"].alias("start"), (F.get("lines", at + n - 1)["pos"] + 1).alias("end"), F.xxhash64(hashes).alias("chunk"))

    chunks = materialize(known.select("id", "k", F.explode(F.transform("codes", chunk)).alias("c")).select("id", "k", "c.*"), "every_chunk")
    twice = materialize(chunks.groupBy("chunk").agg(F.count("*").alias("n")).where("n > 1").select("chunk"), "chunk_counts")
    return chunks.join(twice, "chunk", "left_semi").select("id", "k", "start", "end", "chunk")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_line: int = 200, least_chars: int = 60, drop_emptied: bool = True, count_col: str | None = None) -> DataFrame:
    """``docs`` with repeated chunks of lines removed from ``text_col``, and how many went in ``count_col`` if that is given.

    A passage counts if it has two lines or more and ``least_chars`` characters, or a line of ``long_line`` characters. Each of
    its lines goes, with the blank lines between them, where equal lines stand earlier by (id, position); of every line
    that goes, an equal one stays. Lines keep their order; other columns are not touched (a stale character count
    too). Documents of which nothing but blanks is left are dropped unless ``drop_emptied`` is false; null and empty
    texts stay as they are. Rows that repeat both id and text count as one document. ``count_col`` must be a new name; all
    other names of ``docs`` may be anything. An empty table gives an empty table.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).withColumn("k", F.xxhash64("text"))
    chunks = materialize(repeated_chunks(keyed, long_line, least_chars), "chunks")
    per_doc = chunks.groupBy(F.col("id").alias("c_id"), F.col("k").alias("c_k")).agg(F.collect_set(F.struct("start", "end", "chunk")).alias("parts"))
    same = F.col("id").eqNullSafe(F.col("c_id")) & (F.col("k") == F.col("c_k"))
    full_lines = lambda p: F.filter(F.slice("lines", p["start"] + 1, p["end"] - p["start"]), lambda x: F.length(F.trim(x)) > 0)
    bodies = keyed.join(per_doc, same).withColumn("lines", F.split("text", "\n"))
    bodies = bodies.select("id", "k", F.explode(F.transform("parts", lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["chunk"].alias("chunk"), F.unhex(F.sha2(F.array_join(full_lines(p), "\n"), 256)).alias("body")))).alias("part"))
    bodies = materialize(bodies.select("id", "k", "part.*").distinct(), "bodies")
    place = F.struct("id", "k", "start")
    firsts = bodies.groupBy("chunk").agg(F.min_by("body", place).alias("first_body"), F.min(F.struct("id", "k", "start", "end")).alias("first"))
    # What overlaps the first occurrence in its own document is no second one.
    apart = ~F.col("id").eqNullSafe(F.col("first.id")) | (F.col("k") != F.col("first.k")) | (F.col("start") >= F.col("first.end"))
    gone = bodies.join(firsts, "chunk").where((F.col("body") == F.col("first_body")) & apart)
    # Chunks that overlap become one stretch of lines.
    document = Window.partitionBy("id", "k").orderBy("start", "end")
    opens = F.col("start") > F.coalesce(F.max("end").over(document.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    gone = gone.select("id", "k", "start", "end", opens.cast("int").alias("opens")).withColumn("number", F.sum("opens").over(document))
    gone = gone.groupBy("id", "k", "number").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    g_id, g_k, k, parts = fresh(docs.columns, "g_id", "g_k", "k", "gone")
    gone = gone.groupBy(F.col("id").alias(g_id), F.col("k").alias(g_k)).agg(F.collect_list(F.struct("start", "end")).alias(parts))

    out = docs.withColumn(k, F.xxhash64(text_col)).join(gone, F.col(id_col).eqNullSafe(F.col(g_id)) & (F.col(k) == F.col(g_k)), "left")
    stays = F.filter(F.split(text_col, "\n"), lambda line, i: ~F.exists(parts, lambda g: (i >= g["start"]) & (i < g["end"])))
    removed = F.aggregate(F.coalesce(parts, F.array().cast("array<struct<start:int,end:int>>")), F.lit(0).cast("long"), lambda n, g: n + g["end"] - g["start"])
    new = F.when(F.col(parts).isNotNull(), F.array_join(stays, "\n")).otherwise(F.col(text_col))
    out = out.select(*(new.alias(c) if c == text_col else F.col(c) for c in docs.columns), removed.alias(count_col or k), F.col(parts).isNull().alias(g_k))
    if drop_emptied:
        out = out.where(F.col(g_k) | F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*docs.columns, *([count_col] if count_col else []))
