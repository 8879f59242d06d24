"""Toxicity: a logistic regression on word features, regularised by counterfactuals.

Terms are the listed identity terms and neutral words that are mined from the labelled texts themselves: those that a good share of
the toxic and of the clean ones hold. In texts that hold terms, they are swapped for others of their row; all other
labelled texts get a neutral mention of a group. The loss adds the mean squared change of the log odds over these pairs, so that
the mere mention of a group carries no weight, and one neutral word as much as another, however the labels go with
them by chance or by bias. All terms are features. Other features are the presence of words and of word beginnings
(4 to 8 bytes), chosen by the strength of their association with the label and counted by Spark.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import IS_ALNUM, LOWER, salted, signed, span_hasher, spans, texts

#: Identity terms by language; a term is swapped for another of its row.
IDENTITY_TERMS = (
    ("women", "men", "gays", "lesbians", "muslims", "christians", "jews", "blacks", "whites", "asians", "immigrants", "refugees"),
    ("woman", "man", "gay", "lesbian", "muslim", "christian", "jewish", "black", "white", "asian", "immigrant", "refugee", "trans", "disabled"),
    ("frauen", "männer", "schwule", "lesben", "muslime", "christen", "juden", "schwarze", "weiße", "ausländer", "flüchtlinge"),
    ("femmes", "hommes", "gais", "lesbiennes", "musulmans", "chrétiens", "juifs", "noirs", "blancs", "immigrés", "réfugiés"),
    ("mujeres", "hombres", "homosexuales", "lesbianas", "musulmanes", "cristianos", "judíos", "negros", "blancos", "inmigrantes", "refugiados"),
)
_PEERS = {term: row for row in IDENTITY_TERMS for term in row}
_TERM = re.compile(r"\b(?:" + "|".join(sorted(_PEERS, key=len, reverse=True)) + r")\b")
_LETTERS = re.compile(r"[^\W\d_]{2,20}")
BEGINNINGS = (4, 5, 6, 7, 8)


def features(data: np.ndarray) -> np.ndarray:
    """Distinct 64-bit feature hashes of a text."""
    starts, ends = spans(IS_ALNUM[data])
    if not len(starts):
        return np.zeros(0, np.uint64)
    hashed = span_hasher(LOWER[data])
    out = [salted(hashed(starts, ends), 1)]
    for k in BEGINNINGS:
        long = ends - starts > k
        out.append(salted(hashed(starts[long], starts[long] + k), k))
    return np.unique(np.concatenate(out))


def _pattern(terms) -> re.Pattern:
    return re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, terms), key=len, reverse=True)) + r")\b")


def _rotated(pattern: re.Pattern, row_of, low: str) -> list[str]:
    """Two versions of a text in which every match is another of its row."""

    def other(shift: int):
        def put(m: re.Match) -> str:
            row = row_of(m[0])
            return row[(row.index(m[0]) + shift) % len(row)]

        return put

    return [pattern.sub(other(k), low) for k in (1, 5)]


def swapped(text: str) -> list[str]:
    """Counterfactual versions of a text: two in which every identity term is another of its row; if it has none, one that mentions
    a group, which the text's own hash picks."""
    low = text.lower()
    if _TERM.search(low):
        return _rotated(_TERM, _PEERS.__getitem__, low)
    terms = sorted(_PEERS)
    return [f"{low} {terms[zlib.crc32(low.encode()) % len(terms)]}"]


def exchanged(text: str, mined: tuple[str, ...]) -> list[str]:
    """Two versions of a text in which every mined term is another one; none if it holds none."""
    low = text.lower()
    pattern = _pattern(mined) if mined else None
    return _rotated(pattern, lambda _: mined, low) if pattern and pattern.search(low) else []


def _words_of(batches):
    for batch in batches:
        counts: Counter = Counter()
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.update((w, toxic) for w in set(_LETTERS.findall((text or "").lower())))
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in counts], pa.string()), pa.array([t for _, t in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["word", "toxic", "n"])


def mined_terms(rows: DataFrame, n_toxic: int, n_clean: int, share: float = 0.05, most: int = 64) -> tuple[str, ...]:
    """Neutral words of labelled texts (``text``, ``toxic``): of all that at least ``share`` of the toxic and of the clean texts hold, the
    ``most`` frequent ones whose two shares differ by a factor of two at most, in order of the alphabet."""
    counted = rows.mapInArrow(_words_of, "word string, toxic long, n long").groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    t, c = F.col("t") / n_toxic, F.col("c") / n_clean
    even = counted.where((t >= share) & (c >= share) & (t <= 2 * c) & (c <= 2 * t)).orderBy(F.desc(F.least(t, c)), "word").limit(most)
    return tuple(sorted(r["word"] for r in even.collect() if r["word"] not in _PEERS))


def term_features(mined: tuple[str, ...] = ()) -> np.ndarray:
    """The word features of all terms."""
    return np.concatenate([_word_feature(t) for t in sorted({*_PEERS, *mined})])


def _word_feature(word: str) -> np.ndarray:
    data = np.frombuffer(word.encode(), np.uint8)
    return salted(span_hasher(LOWER[data])(np.array([0]), np.array([len(data)])), 1)


def _counting(batches):
    for batch in batches:
        toxic = np.array(batch.column(1).to_pylist(), bool)
        found = [features(data) for data in texts(batch.column(0))]
        if not found:
            continue
        owner = np.repeat(toxic, [len(f) for f in found])
        keys, where = np.unique(np.concatenate(found), return_inverse=True)
        hits = np.bincount(where, weights=owner, minlength=len(keys)).astype(np.int64)
        total = np.bincount(where, minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(hits), pa.array(total - hits)], names=["feature", "toxic", "clean"])


class Model:
    """Weights by feature hash, and a bias."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(chosen)
        self.chosen, self.weights, self.bias = chosen[order], weights[order], bias
        self.table = np.zeros(1 << 18, bool)
        self.table[(self.chosen >> np.uint64(46)).astype(np.int64)] = True

    def present(self, data: np.ndarray) -> np.ndarray:
        """Positions of the chosen features that a text holds."""
        starts, ends = spans(IS_ALNUM[data])
        if not len(starts) or not len(self.chosen):
            return np.zeros(0, np.int64)
        hashed = span_hasher(LOWER[data])
        found = []
        for k in (0, *BEGINNINGS):
            long = ends - starts > k
            h = salted(hashed(starts[long], starts[long] + k if k else ends[long]), k or 1)
            h = h[self.table[(h >> np.uint64(46)).astype(np.int64)]]
            at = np.minimum(np.searchsorted(self.chosen, h), len(self.chosen) - 1)
            found.append(at[self.chosen[at] == h])
        return np.unique(np.concatenate(found))

    def score(self, data: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[self.present(data)].sum() + self.bias, -30, 30))))


def _rows_of(model: Model, mined: tuple[str, ...]):
    def run(batches):
        for batch in batches:
            out = []
            for data, toxic in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                text = data.tobytes().decode()
                other, even = ([model.present(np.frombuffer(x.encode(), np.uint8)).tolist() for x in versions] for versions in (swapped(text), exchanged(text, mined)))
                out.append({"toxic": int(toxic), "has": model.present(data).tolist(), "other": other, "even": even})
            kind = pa.schema([("toxic", pa.int64()), ("has", pa.list_(pa.int64())), *((c, pa.list_(pa.list_(pa.int64()))) for c in ("other", "even"))])
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return run


def fit_weights(has: list[list[int]], toxic: list[int], other: list[list[list[int]]], n: int, fairness: float = 4.0, decay: float = 5e-4, rounds: int = 500, even: list[list[list[int]]] | None = None, evenness: float = 0.5) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on log loss + decay |w|^2 + the mean squared change of the log odds over pairs: ``fairness`` times that
    of the pairs with ``other``, ``evenness`` times that of the pairs with ``even``."""
    x = np.zeros((len(has), n + 1), np.float32)
    x[:, n] = 1
    for k, f in enumerate(has):
        x[k, f] = 1
    pairs: dict[tuple, float] = {}
    for versions, force in ((other, fairness), (even or [], evenness)):
        size = max(1, sum(map(len, versions)))
        for k, own in enumerate(versions):
            for f in own:
                change = (tuple(sorted(set(f) - set(has[k]))), tuple(sorted(set(has[k]) - set(f))))
                pairs[change] = pairs.get(change, 0.0) + force / size
    # The mean squared changes are a quadratic form over the few features in which any pair differs.
    moved = np.array(sorted({f for more, fewer in pairs for f in (*more, *fewer)}), np.int64)
    at = {f: k for k, f in enumerate(moved.tolist())}
    form = np.zeros((len(moved), len(moved)))
    for (more, fewer), force in pairs.items():
        where, sign = np.array([at[f] for f in (*more, *fewer)], np.int64), np.r_[np.ones(len(more)), -np.ones(len(fewer))]
        form[np.ix_(where, where)] += np.outer(sign, sign) * force
    form = form.astype(np.float32)
    y = np.array(toxic, np.float32)
    w, step = np.zeros(n + 1, np.float32), np.zeros(n + 1, np.float32)
    shrink = np.full(n + 1, decay, np.float32)
    shrink[n] = 0
    # The step is the inverse of the largest curvature, found by power iteration.
    v, bend = np.ones(n + 1, np.float32) / np.sqrt(n + 1), 1.0
    for _ in range(20):
        u = x.T @ (x @ v) / (4 * max(len(y), 1)) + shrink * v
        u[moved] += 2 * (form @ v[moved])
        bend = max(float(np.linalg.norm(u)), 1e-6)
        v = u / bend
    rate = 0.9 / bend
    for _ in range(rounds):
        ahead = w + 0.9 * step
        slope = x.T @ (1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30))) - y) / max(len(y), 1) + shrink * ahead
        slope[moved] += 2 * (form @ ahead[moved])
        step = 0.9 * step - rate * slope
        w = w + step
    return w[:n], float(w[n])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 10_000, max_features: int = 2048, fairness: float = 4.0, evenness: float = 0.5) -> Model:
    """Fit on at most ``max_rows`` labelled documents, those with the smallest id hashes, none of them held out.

    The bound keeps the label table that is broadcast and the rows that reach the driver (feature positions, no text)
    small. Features are the ``max_features`` with the largest likelihood ratio, of those that 4 of these documents hold and whose
    ratio is 6 or more (a chance of about 1 in 2,000 for a feature without a meaning), and all terms. Null labels and ids
    are left out; several labels of one id count as the largest, documents that repeat an id count each.
    """
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    usable = usable.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_toxic")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(usable), F.col("id") == F.col("_id")).select("text", F.col("_toxic").cast("long").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log((n_toxic + 0.5) / (n_clean + 0.5))))
    mined = mined_terms(rows, n_toxic, n_clean)
    counts = rows.mapInArrow(_counting, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    # The likelihood ratio of label and feature: unlike a z-score it ranks words that only toxic texts hold above common ones.
    cell = lambda seen, row, column: f"coalesce(({seen}) * ln(({seen}) * {n_toxic + n_clean}D / (({row}) * ({column}))), 0)"
    strength = F.expr(" + ".join((cell("t", "t + c", n_toxic), cell("c", "t + c", n_clean), cell(f"{n_toxic} - t", f"{n_toxic + n_clean} - t - c", n_toxic), cell(f"{n_clean} - c", f"{n_toxic + n_clean} - t - c", n_clean))))
    best = counts.where("t + c >= 4").withColumn("strength", strength).where("strength >= 6").orderBy(F.desc("strength"), "feature").limit(max_features).collect()
    chosen = np.unique(np.r_[np.array([r["feature"] for r in best], np.int64).view(np.uint64), term_features(mined)])
    model = Model(chosen, np.zeros(len(chosen)), 0.0)
    data = rows.mapInArrow(_rows_of(model, mined), "toxic long, has array<bigint>, other array<array<bigint>>, even array<array<bigint>>").collect()
    weights, bias = fit_weights([r["has"] for r in data], [r["toxic"] for r in data], [r["other"] for r in data], len(chosen), fairness, even=[r["even"] for r in data], evenness=evenness)
    return Model(model.chosen, weights, bias)


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def _scoring(model: Model):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(data) for data in texts(batch.column(1))], pa.float64())], names=["id", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", model: Model | None = None) -> DataFrame:
    """(id, held_out, score, predicted) per document; a score uses the whole text and nothing else.

    Null and empty texts have the score of a text without features. Rows whose crc32(id as text) mod 5 is 0 are held out
    from training; a null id is not held out. Without labels of both kinds the score is the smoothed base rate. Repeated rows are
    scored each, an empty table gives an empty table, and columns but id and text play no part.
    """
    model = model or train(docs, labels, id_col, text_col, label_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_scoring(model), f"id {id_type}, score double")
    return out.select(F.col("id").alias(id_col), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
