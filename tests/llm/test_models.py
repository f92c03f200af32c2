"""Spelling variants, language model scores and vector codes."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks.compare import duck
from matchloom.llm import codes, language, mixing, variants
from matchloom.llm.flat import Texts
from matchloom.llm.queries import ORACLE_SQL, REGISTRY

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_variants(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 7 and k >= 2}
    near, shorter, masked = defaultdict(set), defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            shorter[w[:k] + w[k + 1 :]].add(w)
            masked[w[:k], w[k + 1 :]].add(w)
    for w in list(shorter):
        if w in n:
            near[w] |= shorter[w]
            for v in shorter[w]:
                near[v].add(w)
    for group in masked.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda v: (-n[v], v))
            if n[best] >= 10 * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


VARIANTS = ("word", "form", "root", "n", "n_near", "form_n")


def found_variants(df):
    return sorted(tuple(r) for r in df.select(*VARIANTS).collect())


def test_variants_of_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert found_variants(REGISTRY["op11_spelling_variants"](spark, SF)) == brute_variants(rows)


@pytest.mark.parametrize("options", [{}, {"hot_words": 2, "bucket_rows": 50}])
def test_variants_odd_rows(spark, options):
    random = np.random.default_rng(2)
    alphabet = list("aabé÷×Z")
    words = ["".join(random.choice(alphabet, n)) for n in random.integers(6, 11, 400)]
    words += ["aaaaaaa" + "a" * k for k in range(6)] * 3 + ["prefixpre" + c for c in "abcdefghij"] * 2
    rows = [(int(i), " ".join(random.choice(words, 60)), "x") for i in range(60)]
    rows += rows[:20] + [(None, "Missing, missing; missing missinG", "y"), (None, None, "y"), (3, "", "z")]
    rows += [(7, "longword" * 2000 + " " + "longword" * 2000 + " " + "longword" * 2000 + "x", "q")] * 2
    data = spark.createDataFrame(rows, "doc_id bigint, text string, word string").repartition(5)
    expected = brute_variants([r[:2] for r in rows])
    assert found_variants(variants.group_variants(data, **options)) == expected
    assert any(r[1] for r in expected) and max(r[4] for r in expected) > 3


def test_variants_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert variants.group_variants(empty).count() == 0
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "d")], "word string, form string")
    assert {tuple(r) for r in variants.roots(chain).collect()} == {(w, "d") for w in "abcx"}


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


def check_base(found, rows):
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in tokens_of(t))
    total, types = sum(counts.values()), len(counts)
    expected = Counter()
    for i, text in rows:
        own = tokens_of(text)
        base = sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in own)
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        expected[(i, held, len(own), sum(counts[w] > 0 for w in own), total, round(base, 6))] += 1
    ours = Counter(
        (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
        for r in found
    )
    assert ours == expected


def test_language_scores_of_a_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = REGISTRY["op12_lm_scoring"](spark, SF).collect()
    check_base(found, rows)
    held = [r for r in found if r["held_out"]]
    per_token = lambda c: sum(r[c] for r in held) / sum(r["n_tokens"] for r in held)
    assert per_token("score") > per_token("base_score") + 0.08
    again = {r["doc_id"]: r["score"] for r in REGISTRY["op12_lm_scoring"](spark, SF).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"], rel=1e-9) for r in found)


def test_language_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " \t"), (None, "b A b"), (None, None), (5, "a b " * 300_000), (6, "Été a")]
    rows += [(9, "same text")] * 40 + [(i, "unknown words of their own") for i in range(20, 60) if zlib.crc32(str(i).encode()) % 7 == 2]
    spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id bigint, text string, score double").repartition(3).write.parquet(str(tmp_path / "d"))
    data = spark.read.parquet(str(tmp_path / "d"))
    check_base(language.score_documents(data).collect(), rows)
    kept = language.score_texts(data).select("doc.score", "score").collect()
    assert all(r[0] == 0.5 and r[1] < 0 for r in kept)
    assert language.score_documents(data.limit(0)).count() == 0
    none_learned = data.filter("doc_id >= 20")
    check_base(language.score_documents(none_learned).collect(), [r for r in rows if r[0] and r[0] >= 20])


def test_language_model_is_a_distribution():
    random = np.random.default_rng(0)
    words = [f"w{i}{'abcdefgh'[i % 8]}" for i in range(700)]
    text = " ".join(random.choice(words, 20000, p=np.arange(700, 0, -1) / np.arange(701).sum()))
    tokens = language.Tokens.of(Texts.of(pa.array([text]), lower=True))
    ids, counts = np.unique(tokens.ids, return_counts=True)
    order = np.argsort(-counts)[: language.HEAD]
    tail_tokens = np.zeros(language.TAIL_CLASSES, np.int64)
    tail_types = np.zeros(language.TAIL_CLASSES, np.int64)
    rest = np.setdiff1d(np.arange(len(ids)), order)
    t = (ids[rest] & language.TAIL_MASK).astype(int)
    np.add.at(tail_tokens, t, counts[rest])
    np.add.at(tail_types, t, 1)
    by_id = np.argsort(ids[order])
    vocabulary = language.Vocabulary(
        int(counts.sum()), len(ids), ids[order][by_id], by_id, counts[order], tail_tokens, tail_types
    )
    weights = [w + random.normal(0, 0.3, w.shape).astype(np.float32) for w in vocabulary.initial()]
    # Every known word, and one unknown in each tail class, after the same history.
    unknown = (np.uint64(12345) << np.uint64(8)) + np.arange(language.TAIL_CLASSES, dtype=np.uint64)
    outcomes, known = np.append(ids, unknown), np.append(counts, np.zeros(len(unknown), np.int64))
    ids_line = np.stack([np.full(len(outcomes), ids[3]), outcomes], axis=1).ravel()
    line = language.Tokens(ids_line, np.arange(0, len(ids_line) + 1, 2))
    seen = np.stack([np.full(len(outcomes), counts[3]), known], axis=1).ravel()
    score = language.token_scores(line, seen, vocabulary, weights)[1::2]
    assert (10.0**score).sum() == pytest.approx(1, rel=1e-4)


def test_learner_follows_the_gradient():
    random = np.random.default_rng(3)
    learner = language.Learner(np.zeros((9, 4), np.float32))
    rows = np.column_stack([random.integers(0, 8, 3000), np.full(3000, 8)]).astype(np.uint16)
    target = rows[:, 0] % 4
    before = -language.softmax_log(learner.weights, rows)[np.arange(3000), target].mean()
    for _ in range(60):
        learner.step(rows, target)
    after = -language.softmax_log(learner.weights, rows)[np.arange(3000), target].mean()
    assert before == pytest.approx(math.log(4)) and after < 0.3


@pytest.mark.parametrize("told_apart", [True, False])
def test_outcomes_of_head_words_and_others(told_apart):
    random = np.random.default_rng(8)
    head = np.unique(np.append(random.integers(1, 1 << 63, 300, np.uint64), language.END))
    if not told_apart:  # no bits next to each other tell all of these apart
        head = np.unique(np.concatenate([np.arange(1 << 5, dtype=np.uint64) << np.uint64(s) for s in (0, 30, 59)]))
    slot = random.permutation(len(head))
    none = np.zeros(0, np.int64)
    vocabulary = language.Vocabulary(1, 1, head, slot, none, none, none)
    assert (vocabulary._places is not None) == told_apart
    ids = random.permutation(np.concatenate([head, head, random.integers(0, 1 << 63, 5000, np.uint64), head ^ np.uint64(1 << 62)]))
    known = dict(zip(head.tolist(), slot.tolist()))
    expected = [
        divmod(known[i], language.CLASS_WORDS) if i in known else (language.HEAD_CLASSES + i % language.TAIL_CLASSES, -1)
        for i in ids.tolist()
    ]
    assert list(zip(*(x.tolist() for x in vocabulary.outcome(ids)))) == expected


def test_target_log_is_the_softmax_at_the_target():
    random = np.random.default_rng(9)
    weights = random.normal(0, 2, (50, 32)).astype(np.float32)
    rows, target = random.integers(0, 50, (700, 6)).astype(np.uint16), random.integers(0, 32, 700)
    found = language.target_log(weights, rows, target)
    assert (found == language.softmax_log(weights, rows)[np.arange(700), target]).all()


CODES = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


def test_codes_equal_sql(spark):
    found = sorted(tuple(r) for r in REGISTRY["op13_vector_code_compression"](spark, SF).select(*CODES).collect())
    assert found == sorted(duck(SF).execute(ORACLE_SQL["op13_vector_code_compression"]).fetchall())


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [
        (i, [max(-(1 << 25), min(1 << 25, math.floor(4096 * float(x)))) for x in v], label) for i, v, label in rows
        if v and all(x is not None and math.isfinite(x) for x in v)
    ]
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    cut = [[(v + [0] * (width * parts))[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    smallest = {}
    for at, (i, v, _) in enumerate(kept):
        key = (i is None, i or 0)
        if key not in smallest or v < kept[smallest[key]][1]:
            smallest[key] = at
    seeds = [smallest[k] for k in sorted(smallest)[:entries]]
    books = [[cut[s][p] for s in seeds] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for x in cut:
                groups[nearest(x[p], books[p])[1]].append(x[p])
            books[p] = [
                [sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e
                for k, e in enumerate(books[p])
            ]
    out, by_label = [], Counter()
    for (i, _, label), x in zip(kept, cut):
        near = [nearest(x[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in near)
        by_label[label] += error
        out.append((i, "".join(f"{k:02x}" for _, k in near), error, label))
    return sorted(((i, c, e, by_label[label]) for i, c, e, label in out), key=str)


def test_codes_odd_rows(spark):
    random = np.random.default_rng(5)
    rows = [(int(i), random.normal(size=19).round(1).tolist(), int(i) % 3 if i % 4 else None) for i in range(40)]
    rows += [(1, None, 1), (2, [None] * 19, 1), (3, [float("nan")] + [0.0] * 18, 1), (4, [float("-inf")] * 19, 1),
             (5, [], 2), (6, [1e30, -1e30, 2.0], 2), (None, [0.25] * 19, 0), (0, [-9.0] * 19, 0)] + rows[:6]
    data = spark.createDataFrame([(*r, "c") for r in rows], "vec_id bigint, embedding array<double>, label int, code string")
    found = [tuple(r)[:4] for r in codes.compress_vectors(data.repartition(4)).select(*CODES).collect()]
    assert sorted(found, key=str) == brute_codes(rows)
    assert codes.compress_vectors(data.limit(0)).count() == 0
    assert codes.compress_vectors(data.filter("embedding is null")).count() == 0


def test_nearest_entry_and_decoding(spark):
    random = np.random.default_rng(6)
    x, entries = random.integers(-50, 50, (500, 5)), random.integers(-50, 50, (7, 5))
    entries[5] = entries[2]  # a tie
    entry, distance = codes.nearest_entry(x, entries)
    all_ = np.square(x[:, None] - entries).sum(2)
    assert (entry == all_.argmin(1)).all() and (distance == all_.min(1)).all()
    assert (codes.sequency(8) @ codes.sequency(8).T == 8 * np.eye(8)).all()
    data = spark.createDataFrame([(i, [float(i), 1.0] * 8, 0) for i in range(9)], "vec_id bigint, embedding array<double>, label int")
    books = codes.learn_codebooks(data)
    coded = codes.decode(codes.encode(data, books), books)
    assert all(list(r["approximation"]) == [4096 * r["vec_id"], 4096] * 8 for r in coded.collect())


def test_mixing_large_documents_and_equal_rows(spark):
    rows = [(i, "a " * (3000 if i == 0 else 20 + i % 30), f"s{i % 2}") for i in range(400)]
    rows += [(1000, "w " * 25, "s1")] * 300
    data = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for seed in range(3):
        found = mixing.mix_sources(data, seed=seed, group_rows=64, fan_in=4).toPandas()
        assert len(found) == len(rows) and (found["taken"] <= 3 * found["size"]).all()
        for _, own in found.groupby("source"):
            assert abs(own["taken"].sum() - own["target"].iloc[0]) <= 50


def test_mixing_last_document_is_made_up_for():
    sizes = np.array([5000.0, *np.arange(90, 10, -1)])
    worst = 0
    for seed in range(200):
        random = np.random.default_rng(seed)
        chances = np.full(len(sizes), 0.37)
        out = mixing._close(sizes, mixing._settle(sizes, chances, random), random)
        assert set(out) <= {0.0, 1.0}
        worst = max(worst, abs(sizes @ out - sizes @ chances))
    assert worst <= 20


def test_segment_sums_of_short_and_long_segments():
    rng = np.random.default_rng(5)
    sizes = np.concatenate([[1, 2, 500, language.SHORT, language.SHORT + 1], rng.integers(1, 6, 40)])
    first = np.cumsum(sizes) - sizes
    values = rng.random((64, 8)).astype(np.float32)
    at = rng.integers(0, 64, sizes.sum())
    found = language.segment_sums(values, at, first, sizes)
    # Bit for bit, whatever the sizes: scores must not change with how sums are added.
    assert np.array_equal(found, np.add.reduceat(values[at], first))
