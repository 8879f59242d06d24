"""Token alignment, importance resampling and removal of repeated word runs against brute force and odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import resample, substring_dedup, token_align

LETTERS = [" ", "  ", "\n", "\n\n", "\t", "a", "word", "Ünïcode", "日本語", "　", "\xa0", "\x1c", "▁", "<|endoftext|>", "</s>", "<0x0A>", "\x00", "😀", "é", "ﬁ", "don't", "!!", "123", "\r\n", "​", " ", ""]


def _vocabularies():
    with open(token_align.BYTE_MODEL, "rb") as a, open(token_align.PIECE_MODEL, "rb") as b:
        return token_align.Vocabularies(a.read(), b.read())


def _aligned(texts):
    """Whole texts, token by token, with counts in a dictionary."""
    v, out, counts = _vocabularies(), [], Counter()
    for text in texts:
        tokens = v.encode(text) if text else None
        if tokens is None:
            out.append(None)
            continue
        ends = [np.cumsum([len(table[t]) for t in ids]).tolist() for table, ids in zip((v.bytes_a, v.bytes_b), tokens)]
        (a, b), links, groups, i, j, own = (x.tolist() for x in tokens), [], [], 0, 0, ([], [])
        own[0].append(a[0])
        own[1].append(b[0])
        while True:
            links.append((a[i], b[j]))
            x, y = ends[0][i], ends[1][j]
            i, j = i + (x <= y), j + (y <= x)
            if x == y:
                groups.append(own)
                own = ([], [])
            if i == len(a):
                break
            if x <= y:
                own[0].append(a[i])
            if y <= x:
                own[1].append(b[j])
        counts.update(links)
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((len(a), len(b), len(groups), links, hashlib.sha256(said.encode()).hexdigest()))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    rows = [(0,) * 6 + ("",) if o is None else (*o[:3], len(o[3]), sum(counts[p] == most[p[1]] for p in o[3]), sum(counts[p] for p in o[3]), o[4]) for o in out]
    return rows, counts


def _mixed_texts(n, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeiourstn") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    texts = [None, "", " ", "  ", "\n", " a", "a ", "a\n", "\n a     ", "a\tb c", "a \tb", "a\n\tb", "x" * 5000, "word " * 3000]
    texts += ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 30))) for _ in range(n)]
    return texts + [rng.choice([" ", "\n", ". "]).join(rng.choice(words) for _ in range(rng.randrange(80))) for _ in range(n)]


@pytest.mark.parametrize("links, units", [(6_000_000, 500_000), (300, 50)])
def test_alignment_equals_brute_force(spark, monkeypatch, links, units):
    """Also where every few texts make a block and units are forgotten between them."""
    monkeypatch.setattr(token_align, "BLOCK_LINKS", links)
    monkeypatch.setattr(token_align, "UNITS", units)
    texts = _mixed_texts(250)
    rows = [(k if k % 9 else None, t, "clash", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pair string, block int")
    wanted, counts = _aligned(texts)
    parts = docs.repartition(3)
    got = token_align.align_tokens(parts).collect()
    assert Counter(tuple(r)[1:] for r in got) == Counter(wanted)
    assert {r[0]: tuple(r)[1:] for r in got if r[0] is not None} == {k: w for k, w in enumerate(wanted) if k % 9}
    pairs = {(r.a_id, r.b_id): r.n_links for r in token_align.token_pairs(docs).collect()}
    assert pairs == dict(counts)


def test_alignment_blocks_and_document_counts(spark):
    texts = _mixed_texts(40, 8)
    table = token_align.token_pairs(spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string").repartition(4)).collect()
    held, v = Counter(), _vocabularies()
    for text in texts:
        tokens = v.encode(text) if text else None
        if tokens is not None:
            held.update(set(v.align(*tokens)[4].tolist()))
    assert {(r.a_id << 32) | r.b_id: r.n_docs for r in table} == {p: 2 * n for p, n in held.items()}


def test_alignment_of_an_empty_table(spark):
    assert token_align.align_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_postings_round_trip():
    rng = np.random.default_rng(2)
    entries = np.unique(rng.integers(0, 40, 6000) * 65536 + np.where(rng.random(6000) < 0.5, rng.integers(0, 65536, 6000), rng.integers(0, 300, 6000)))
    often = rng.choice([1, 1, 1, 2, 3, 9, 700], len(entries))
    pair, n, links, bitmaps, planes = token_align.pack(entries >> 16, entries & 65535, often)
    row, doc, times = token_align.unpack(n, bitmaps, planes)
    assert np.array_equal(pair[row] << 16 | doc, entries) and np.array_equal(times, often)
    assert links.sum() == often.sum()
    row, doc, times = token_align.unpack(n[7:19], bitmaps.slice(7, 12), planes.slice(7, 12))
    assert np.array_equal(times, often[n[:7].sum() : n[:19].sum()])


def _scored(texts, target, share=(10, 100), least=20, longest=1, buckets=10_000):
    words = lambda t: ["".join(c.lower() if c.isascii() else c for c in w) for w in "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in t or "").split(" ") if w]
    runs = lambda w: [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    of = lambda t: [zlib.crc32(x.encode()) % buckets for x in runs(words(t))]
    s, t = Counter(b for x in texts for b in of(x[1])), Counter(b for x in target for b in of(x))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in {*s}}
    rows = []
    for k, text in texts:
        own = of(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{k}".encode()).hexdigest()[:8], 16)
        rows.append((k, len(own), weight, None if k is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))))
    able = sorted((-r[3], r[0], *r[1:3]) for r in rows if r[0] is not None and r[4] >= least)
    drawn = Counter()
    out = []
    for place, key in enumerate(able[: len(able) * share[0] // share[1]], 1):
        out.append((key[1], key[2], key[3], -key[0], place))
        drawn[key] += 1
    for r in rows:
        key = r[0] is not None and r[4] >= least and (-r[3], r[0], *r[1:3])
        if key and drawn[key]:
            drawn[key] -= 1
        else:
            out.append((*r[:4], None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("share, longest", [((10, 100), 1), ((1, 3), 2), ((1, 1), 1), ((0, 1), 1)])
def test_resampling_equals_brute_force(spark, share, longest):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(50)] + ["Ünïcode", "MiXed", "über"]
    texts = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 19, 20, 60]))) + rng.choice(["", "!", "\n"])) for k in range(300)]
    texts += [(7, "w1 " * 30)] * 40 + [(8, None), (9, ""), (None, "w1 " * 30), (10, "--- --")]
    target = ["w1 w2 w3 über", None, "MiXed"]
    docs = spark.createDataFrame([(*t, "x", 2) for t in texts], "doc_id long, text string, score string, rank int").repartition(5)
    got = resample.score_documents(docs, spark.createDataFrame([(t,) for t in target], "text string"), fraction=f"{share[0]}/{share[1]}", longest=longest)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _scored(texts, target, share, longest=longest)


def test_drawn_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(k, "a b " * (15 + k), f"s{k}", k) for k in range(50)], "doc_id long, text string, rank string, drawn_id int")
    target = spark.createDataFrame([("a",)], "text string")
    drawn = resample.draw_documents(docs, target, fraction="1/5")
    assert drawn.columns == [*docs.columns, "rank_"] and sorted(r["rank_"] for r in drawn.collect()) == list(range(1, 11))
    assert resample.score_documents(docs.limit(0), target).collect() == []
    assert {r.rank for r in resample.score_documents(docs, target.limit(0), fraction="1/50").collect()} == {None, 1}


@pytest.mark.parametrize("k", [1, 2, 40, 41, 500, 999, 1000, 1001])
def test_kth_key(spark, k):
    """Ties of whole keys count each."""
    rng = random.Random(k)
    rows = [(rng.randrange(5), rng.randrange(6), 1, 2) for _ in range(960)] + [(2, 3, 1, 2)] * 40
    keys = spark.createDataFrame(rows, "below long, id long, n_features long, weight long")
    assert resample.kth_key(keys, k, pivots=3) == (sorted(rows)[k - 1] if k <= 1000 else None)


def _without_repeats(docs, window):
    first = {}
    for k, text in docs:
        words = (text or "").split()
        for p in range(len(words) - window + 1):
            run = tuple(words[p : p + window])
            if k is not None:
                first[run] = min(k, first.get(run, k))
    out = []
    for k, text in docs:
        words = (text or "").split()
        gone = set()
        for p in range(len(words) - window + 1):
            if k is not None and first[tuple(words[p : p + window])] < k:
                gone.update(range(p, p + window))
        out.append((k, " ".join(w for i, w in enumerate(words) if i not in gone), len(words), len(gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed, vocab, window, rounds", [(1, 3000, 13, 13), (2, 40, 13, 13), (3, 2, 13, 13), (4, 1, 13, 13), (5, 40, 5, 6), (6, 3, 2, 3), (7, 3000, 13, 3)])
def test_repeats_equal_brute_force(spark, seed, vocab, window, rounds):
    """Shared passages of all lengths, copies, periodic texts, repeated and null ids."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocab)]
    passages = [[rng.choice(words) for _ in range(rng.choice([5, 20, 100, 700]))] for _ in range(6)]
    docs = [(1, None), (2, ""), (3, " \n"), (4, "a b " * 30), (5, "b a " * 40)]
    for k in range(10, 70):
        text = []
        for _ in range(rng.randrange(5)):
            passage = rng.choice(passages)
            at = rng.randrange(len(passage))
            text += passage[at : at + rng.choice([3, 12, 13, 14, 30, 300])] + [rng.choice(words) for _ in range(rng.randrange(9))]
        docs.append((rng.choice([k, k, k, k // 2, None]), rng.choice([" ", "\n", "  \t"]).join(text)))
    table = spark.createDataFrame([(t, "x", k, 1) for k, t in docs], "text string, key string, doc_id long, pairs int").repartition(4)
    got = substring_dedup.remove_repeats(table, window=window, rounds=rounds)
    assert got.columns == [*table.columns, "n_words", "n_removed"]
    assert sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in got.collect()), key=repr) == _without_repeats(docs, window)


def test_a_key_of_many_documents_sends_one_row_to_other_tasks():
    gathered, todo = substring_dedup._Gathered(), {}
    for part in range(5):
        doc = np.arange(part * 200, part * 200 + 200)
        gathered.add(np.repeat([7, 8], 100), np.zeros(200, np.int64), doc)
    for batch in gathered.send(substring_dedup.PAIR, substring_dedup.PAIR_DONE, False):
        todo[batch.column(3)[0].as_py()] = batch.select(["key", "doc"]).to_pydict()
    assert todo[substring_dedup.PAIR] == {"key": [7, 8], "doc": [0, 100]}
    assert len(todo[substring_dedup.PAIR_DONE]["doc"]) == 998


def test_repeats_of_empty_and_giant_texts(spark):
    giant = " ".join(f"w{k % 70_001}" for k in range(300_000))
    docs = spark.createDataFrame([(2, giant), (1, " ".join(giant.split()[1000:1500]))], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()}
    # The words 1000 to 1499 of each of five turns, the last of which is cut short.
    assert got == {1: (500, 0), 2: (300_000, 2500)}
    assert substring_dedup.remove_repeats(docs.limit(0)).collect() == []


def test_tokens_of_a_megabyte_take_linear_time():
    """Long runs of punctuation before and inside a token, and a text that is one token."""
    import time

    from driftline.llm import secrets

    began = time.time()
    for token in ("." * 1_000_000 + "x=1", "x" + "(." * 500_000, "k" * 1_000_000):
        secrets.token_features(token, ("", "token"), 0.1, 0.1)
    assert time.time() - began < 20
    assert secrets.masked("word " * 50_000 + "lookalike password=abcdefgh1")[1][0].endswith("lookalike and so on")


def _runs(text, threshold=(17, 20)):
    """Labels and the best containment of any line or run, word by word."""
    import re

    from driftline.llm import license_scan

    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())
    blocks = [re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", line) for line in text.lower().split("\n")]
    labels, best = set(), 0
    for k, label, own in license_scan._template_words():
        for run in blocks + [words[i : i + license_scan.run_words(k)] for i in range(len(words))]:
            share = len(set(run) & set(own))
            if threshold[1] * share >= threshold[0] * len(own):
                labels.add(label)
                best = max(best, share / len(own))
    return labels, best


def test_license_runs_equal_brute_force(spark):
    """Wrapped notices with words left out, put in and doubled, and texts made of template words alone."""
    from driftline.llm import license_scan

    rng, texts = random.Random(6), []
    pool = sorted({w for _, _, ws in license_scan._template_words() for w in ws})
    for _, notice in license_scan.TEMPLATES * 4:
        words = notice.split()
        for _ in range(rng.randrange(5)):
            words.insert(rng.randrange(len(words)), rng.choice(["filler", *pool]))
        for _ in range(rng.randrange(3)):
            words.pop(rng.randrange(len(words)))
        texts.append("x y\n" + "".join(w + rng.choice([" ", " ", "\n# "]) for w in words))
    texts += [" ".join(rng.choice(pool) for _ in range(200)) for _ in range(6)] + [None, "", "mit\nlicense"]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts * 2)], "doc_id long, text string, label string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs.repartition(3)).collect()}
    assert len(got) == 2 * len(texts)
    for k, text in enumerate(texts * 2):
        labels, best = _runs(text or "")
        row = got[k]
        assert {*row.labels.split(",")} - {*row.base_labels.split(","), ""} == labels - {*row.base_labels.split(",")}, k
        assert row.n_base > 0 or row.score == best


def test_license_runs_take_linear_time(spark):
    import time

    from driftline.llm import license_scan

    rng = random.Random(3)
    pool = sorted({w for _, _, ws in license_scan._template_words() for w in ws})

    def seconds(n):
        docs = spark.createDataFrame([(1, " ".join(rng.choice(pool) for _ in range(n)))], "doc_id long, text string")
        began = time.time()
        assert license_scan.scan_licenses(docs).count() == 1
        return time.time() - began

    seconds(500)
    small = seconds(2_000)
    assert seconds(20_000) < 10 * small + 5


def test_the_counterfactual_penalty_changes_scores_on_the_given_tables(spark):
    """Mined words are in the given texts, so pairs differ in features that the labels move; identity terms are not."""
    from driftline.llm import toxicity

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("text", F.col("toxic").cast("long"))
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    mined = toxicity.mined_terms(rows, sizes[1], sizes[0])
    assert 8 <= len(mined) <= 64 and toxicity.exchanged(f"x {mined[0]}, y", mined)[0] == f"x {mined[1]}, y"
    held, free = (toxicity.train(docs, labels, evenness=e) for e in (0.5, 0.0))
    texts = [r.text or "" for r in docs.select("text").limit(300).collect()]
    score = lambda model, text: model.score(np.frombuffer(text.encode(), np.uint8))
    assert max(abs(score(held, t) - score(free, t)) for t in texts) > 0.01
    moves = lambda model: np.mean([abs(np.log(score(model, v) / (1 - score(model, v))) - np.log(score(model, t) / (1 - score(model, t)))) for t in texts for v in toxicity.exchanged(t, mined)])
    assert moves(held) < 0.8 * moves(free)
