"""Quality rules with adaptive thresholds.

Every text is measured. Per (lang, source) a KLL sketch of each measure is built; sketches are merged upwards
(language, then all) for groups in which too few documents have the measure. A document passes the adaptive rules while
each measure stays below the upper fence ``q75 + fence * (q75 - q25)`` of its group (shares: ``q75 / 4`` if that is more); measures that have two bad sides
also have a lower fence. No threshold is a constant: shares of symbols are smoothed by one, so that they vary
with the texts' lengths where nearly no text has a symbol, and shares of repeats are sketched over the documents that have any.
Thresholds are joined back to the documents and filter them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..plans.scratch import materialize
from .columns import fresh
from .text import IS_WORD, span_hashes, spans, texts, windows

SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_PUNCTUATION = np.zeros(256, bool)
_IS_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_STARTS_CHARACTER = (np.arange(256) & 0xC0) != 0x80
_IS_UPPER = np.zeros(256, bool)
_IS_UPPER[65:91] = True
_IS_LETTER = _IS_UPPER.copy()
_IS_LETTER[97:123] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_punctuation", "n_upper", "n_letters")
#: Measure -> (expression over the counts, documents that have it, whether a lower fence holds too).
MEASURES = {
    "symbol_ratio": ("(n_symbols + 1) / (word_chars + 1)", "n_words > 0", False),
    "punctuation_ratio": ("(n_punctuation + 1) / (word_chars + 1)", "n_words > 0", False),
    "upper_ratio": ("n_upper / n_letters", "n_letters > 0", False),
    "dup_line_ratio": ("n_dup_lines / n_lines", "n_dup_lines > 0", False),
    "repeat_ratio": ("n_repeat_words / n_words", "n_repeat_words > 0", False),
    "mean_word_chars": ("word_chars / n_words", "n_words > 0", True),
}


def count_text(data: np.ndarray) -> tuple[int, ...]:
    """``COUNTS`` of one text."""
    flags = IS_WORD[data]
    starts, ends = spans(flags)
    n = len(starts)
    repeated = 0
    if n >= 3:
        three = windows(span_hashes(data, starts, ends), 3)
        _, where, often = np.unique(three, return_inverse=True, return_counts=True)
        again = often[where] >= 2
        marked = np.zeros(n, bool)
        for k in range(3):
            marked[k : k + n - 2] |= again
        repeated = int(marked.sum())
    lines = [x for x in data.tobytes().split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return (
        n, int((_STARTS_CHARACTER[data] & flags.view(bool)).sum()), int(_IS_SYMBOL[data].sum()), len(lines) - len(set(lines)), repeated,
        len(lines), int(_IS_PUNCTUATION[data].sum()), int(_IS_UPPER[data].sum()), int(_IS_LETTER[data].sum()),
    )


def _counting(text_at: int, prefix: str):
    def run(batches):
        for batch in batches:
            rows = [count_text(data) for data in texts(batch.column(text_at))]
            cols = zip(*rows) if rows else [[] for _ in COUNTS]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in cols)], names=[*batch.schema.names, *(prefix + c for c in COUNTS)])

    return run


def with_counts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, prefix: str = "_q_") -> DataFrame:
    """``docs`` (its columns ``keep``, or all) plus the counts of the text, named by ``prefix``; null text counts as empty."""
    cols = keep if keep is not None else docs.columns
    (text,) = fresh(cols, "text")
    picked = docs.select(F.col(text_col).alias(text), *(F.col(c) for c in cols))
    schema = StructType([*picked.schema.fields, *(StructField(prefix + c, LongType()) for c in COUNTS)])
    return picked.mapInArrow(_counting(0, prefix), schema).drop(text)


def _measure(name: str, prefix: str = "_q_") -> F.Column:
    """The measure of a document that has it, else null."""
    expr, has, _ = (re.sub(r"\b(" + "|".join(COUNTS) + r")\b", rf"`{prefix}\1`", str(x)) for x in MEASURES[name])
    return F.expr(f"CASE WHEN {has} THEN cast({expr} as double) END")


def base_failed(prefix: str = "_q_") -> F.Column:
    words, repeats = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (words < 50) | (100 * repeats > 50 * words)


def thresholds(counted: DataFrame, lang_col: str = "lang", source_col: str = "source", fence: float = 5.0, min_group: int = 50, prefix: str = "_q_") -> DataFrame:
    """(lang, source, lo_*, hi_*): fences of every group, from merged sketches where fewer than ``min_group`` documents have a measure.

    Where too few have it even in all groups together, those few make the fence; a measure that no document has has none (null).
    Documents without a word have no measures. Null languages and sources are groups of their own.
    """
    measured = counted.where(F.col(f"{prefix}n_words") > 0).select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), *(_measure(m, prefix).alias(m) for m in MEASURES))
    own = measured.groupBy("lang", "source").agg(*(F.count(m).alias(f"n_{m}") for m in MEASURES), *(F.kll_sketch_agg_double(m).alias(m) for m in MEASURES))
    own = materialize(own, "sketches")
    merged = [*(F.sum(f"n_{m}").alias(f"n_{m}") for m in MEASURES), *(F.kll_merge_agg_double(m).alias(m) for m in MEASURES)]
    by_lang, of_all = own.groupBy("lang").agg(*merged), own.groupBy().agg(*merged)

    def named(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*(F.col(c).alias(f"{c}_{tag}") if c not in ("lang", "source") else F.col(c) for c in df.columns))

    lang = named(by_lang, "l").withColumnRenamed("lang", "lang_l")
    both = named(own, "o").join(lang, F.col("lang").eqNullSafe(F.col("lang_l"))).join(F.broadcast(named(of_all, "a")))
    out = []
    for m, (*_, two_sided) in MEASURES.items():
        sketch = F.when(F.col(f"n_{m}_o") >= min_group, F.col(f"{m}_o")).when(F.col(f"n_{m}_l") >= min_group, F.col(f"{m}_l")).when(F.col(f"n_{m}_a") > 0, F.col(f"{m}_a"))
        q1, q3 = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.75))
        # Shares may be alike in over half of the documents; then a quarter of the quantile itself stands for their spread.
        wide = q3 - q1 if two_sided else F.greatest(q3 - q1, q3 / 4)
        out.append((q3 + fence * wide).alias(f"hi_{m}"))
        out.append(((q1 - fence * wide) if two_sided else F.lit(None).cast("double")).alias(f"lo_{m}"))
    return both.select("lang", "source", *out)


def judged(counted: DataFrame, limits: DataFrame, lang_col: str = "lang", source_col: str = "source", prefix: str = "_q_") -> DataFrame:
    """``counted`` plus ``<prefix>base_failed`` and ``<prefix>kept``; the limits are joined on language and source."""
    names = dict(zip(limits.columns, fresh(counted.columns, *(f"{prefix}{c}" for c in limits.columns))))
    limits = limits.withColumnsRenamed(names)
    both = counted.join(limits, F.col(lang_col).eqNullSafe(F.col(names["lang"])) & F.col(source_col).eqNullSafe(F.col(names["source"])), "left")
    good = F.lit(True)
    for m in MEASURES:
        value = _measure(m, prefix)
        good &= F.coalesce(value <= F.col(names[f"hi_{m}"]), F.lit(True)) & F.coalesce(value >= F.col(names[f"lo_{m}"]), F.lit(True))
    both = both.withColumn(f"{prefix}base_failed", base_failed(prefix)).withColumn(f"{prefix}kept", ~base_failed(prefix) & good)
    return both.drop(*names.values())


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", fence: float = 5.0, min_group: int = 50) -> DataFrame:
    """One row per document: id, the counts, ``base_failed`` and ``kept``.

    Base rule: under 50 words, or over half of the words in 3-word windows that the text holds twice or more. Null and
    empty texts have counts of 0 and fail. Null languages and sources are groups like others. Repeated rows are judged alike and
    count each in the sketches. Other columns play no part. An empty table gives an empty table.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    counted = materialize(with_counts(own, "text", ["id", "lang", "source"]), "counts")
    out = judged(counted, thresholds(counted, fence=fence, min_group=min_group))
    return out.select(F.col("id").alias(id_col), *(F.col(f"_q_{c}").alias(c) for c in (*COUNTS, "base_failed", "kept")))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", fence: float = 5.0, min_group: int = 50) -> DataFrame:
    """The documents that pass the base rule and the adaptive rules, with the columns of ``docs``, whatever their names.

    Texts are counted again in the second pass, so that no text is shuffled. Odd rows: see ``quality_report``.
    """
    prefix = "_q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    own = docs.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    limits = materialize(thresholds(with_counts(own, "text", ["lang", "source"]), fence=fence, min_group=min_group), "limits")
    return judged(with_counts(docs, text_col, prefix=prefix), limits, lang_col, source_col, prefix).where(F.col(f"{prefix}kept")).select(*(F.col(c) for c in docs.columns))
