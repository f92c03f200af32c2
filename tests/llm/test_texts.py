"""Operators on texts against brute force, with edge rows."""

import ctypes
import hashlib
import itertools
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from matchloom.llm import (
    exchange, fingerprint, flat, jaccard, license, mixing, packing, quality, substring, suffix,
)

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(n=120, seed=5):
    """Rows with copies, near copies, shared passages, nulls, empties and odd characters."""
    random.seed(seed)
    vocabulary = ["".join(random.choice("abcdé") for _ in range(random.randint(1, 6))) for _ in range(400)]
    line = " ".join(random.choices(vocabulary, k=60))
    texts = [None, "", " \n\t ", "one", "Two words", "a b c d", "x" * 5000, "é  ü", "\x00 \x7f ok"]
    while len(texts) < n:
        kind = random.random()
        if kind < 0.15:
            texts.append(random.choice(texts[9:] or ["seed text"]))
        elif kind < 0.35 and len(texts) > 20:
            words = (random.choice(texts[9:]) or "x").split()
            for _ in range(random.randint(1, 6)):
                words[random.randrange(len(words))] = random.choice(vocabulary)
            texts.append(" ".join(words))
        elif kind < 0.5:
            texts.append(" ".join(random.choices(vocabulary, k=40)) + "\n" + line + " tail")
        else:
            texts.append(" ".join(random.choices(vocabulary, k=random.randint(1, 300))))
    texts.append(" ".join(random.choices(vocabulary, k=9000)))
    texts.append("tick tock " * 300)
    rows = [(i * 7 % 1009, t, "en", None if i % 5 == 0 else f"s{i % 3}", None) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return (text or "").encode().split()


def test_substring_brute_force(docs, rows):
    width, count = 35, Counter()
    for r in rows:
        w = split(r[1])
        count.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    expected = {}
    for r in rows:
        w = split(r[1])
        gone = {
            j for i in range(len(w) - width + 1) if count[tuple(w[i : i + width])] > 1
            for j in range(i, i + width)
        }
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        expected[r[0]] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    found = {r[0]: tuple(r[1:]) for r in substring.removal_digests(docs).collect()}
    assert found == expected
    assert any(n for _, n, _ in expected.values())


def test_substring_keeps_columns_and_repeated_rows(spark):
    text = " ".join(str(i) for i in range(50))
    data = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, "a  b", "y")], "doc_id bigint, text string, batch string")
    found = substring.remove_repeats(data, as_is=True).select("doc.doc_id", "doc.batch", "n_removed", "kept").collect()
    assert sorted(map(tuple, found), key=str) == [(1, "x", 50, ""), (1, "x", 50, ""), (None, "y", 0, "a  b")]


@pytest.mark.parametrize("hot", [255, 1])
def test_suffix_brute_force(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT_BATCHES", hot)
    # Several batches, so that answers from other batches count.
    monkeypatch.setattr(exchange.Layout, "of", classmethod(lambda cls, d, bytes_per_hash=6.0: cls(7, 64)))
    monkeypatch.setattr(suffix.Layout, "of", exchange.Layout.of)
    seen, expected = set(), {}
    for r in sorted(rows):
        b, own = (r[1] or "").encode(), set()
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            own.add(b[i : i + 50])
            if b[i : i + 50] in seen:
                gone[i : i + 50] = [True] * 50
        seen |= own
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        expected[r[0]] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    found = {r[0]: tuple(r[1:]) for r in suffix.removal_digests(docs).collect()}
    assert found == expected


def test_suffix_sort_orders_suffixes():
    import numpy as np

    random.seed(1)
    data = bytes(random.choice(b"ab") for _ in range(600)) + b"ab" * 150 + bytes(60)
    start = np.arange(len(data) - 50)
    order = suffix.suffix_sort(np.frombuffer(data, np.uint8), start, np.zeros(len(start), np.int64), 50)
    strings = [data[i : i + 50] for i in order]
    assert strings == sorted(strings)
    assert sorted(order.tolist()) == start.tolist()


def brute_components(rows, percent=75):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets = {}
    for r in rows:
        w = (r[1] or "").encode().translate(lower).split()
        sets[r[0]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    names = sorted(sets)
    for i in names:
        for j in names:
            if j < i and sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in names}


@pytest.mark.parametrize("options", [{}, {"rounds": 0, "block_rows": 3}, {"rounds": 1, "block_rows": 2}])
def test_jaccard_brute_force(docs, rows, options):
    found = {r[0]: tuple(r[1:]) for r in jaccard.similar_components(docs, **options).collect()}
    expected = brute_components(rows)
    assert found == expected
    assert len({c for _, c in expected.values()}) < len(expected) - 10


def test_shingle_sets_are_sorted_text_by_text(monkeypatch):
    """One sort of all hashes by text and hash took most of the task's time."""
    def refuse(*_):
        raise AssertionError("all texts sorted at once")

    monkeypatch.setattr(np, "lexsort", refuse)
    random = np.random.default_rng(5)
    texts = ["", None, "one", "ONE", "a b c d", "a b c d e", "A b c d e", "a b a b a b a b a b", " \t\v\n ", "x" * 300]
    texts += [" ".join(random.choice(list("abcde"), random.integers(1, 60))) for _ in range(200)]
    for size in (1, 3, 5):
        hashes, first = jaccard.shingle_sets(flat.Texts.of(pa.array(texts), lower=True), size)
        named = {}
        for i, text in enumerate(texts):
            words = (text or "").lower().split()
            shingles = {tuple(words[j : j + size]) for j in range(max(1, len(words) - size + 1))} if words else set()
            found = hashes[first[i] : first[i + 1]]
            assert len(found) == len(shingles) and (found[1:] > found[:-1]).all()
            assert named.setdefault(frozenset(shingles), found.tolist()) == found.tolist()
        assert len({tuple(x) for x in named.values()}) == len(named)


def test_lowered_bytes():
    data = np.arange(256, dtype=np.uint8)
    assert flat.lowered(data).tobytes() == data.tobytes().lower()


def test_jaccard_chain_of_links(spark):
    """Neighbours link, the ends do not; all are one component."""
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(12):
        texts.append((100 - i, " ".join(base[i * 2 : i * 2 + 60]), 0))
    data = spark.createDataFrame(texts, "doc_id bigint, text string, label int")
    expected = brute_components(texts)
    found = {r[0]: tuple(r[1:]) for r in jaccard.similar_components(data, rounds=0, block_rows=4).collect()}
    assert found == expected


def test_jaccard_odd_rows(spark):
    data = spark.createDataFrame(
        [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "A B C D E F"), (9, None)],
        "doc_id bigint, text string",
    )
    found = sorted(map(tuple, jaccard.similar_components(data).collect()), key=str)
    assert found == sorted([(None, 2, None), (3, 2, 2), (3, 2, 2), (2, 2, 2), (9, 0, 9)], key=str)


def test_licenses(spark):
    texts = [
        "Under the MIT License. under THE mit license", None, "", "apache license version 2.0 cc-by-nc",
        "underthe mit license", "SPDX-License-Identifier: GPL-3.0-only", "the apachelicense version 2",
        "released under the GNU General Public License version 2 or later", "under the mit licenses",
    ]
    data = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, score int")
    found = {r.doc_id: r for r in license.scan_licenses(data).collect()}
    assert (found[0].n_words, found[0].n_base, found[0].first_word, found[0].last_word) == (8, 2, 0, 4)
    assert found[0].base_labels == "mit" and found[0].labels == "mit"
    assert (found[1].n_words, found[1].n_base, found[1].first_word, found[1].labels) == (0, 0, None, "")
    assert found[2].score == 0.0
    assert found[3].base_labels == "apache-2,cc-by-nc" and found[3].last_word == 5
    assert found[4].n_base == 0 and found[8].n_base == 0 and found[6].n_base == 0
    assert found[5].labels == "gpl-3" and found[5].base_labels == "" and found[5].score == 1.0
    assert found[7].labels == "gpl-2"
    assert all(0 <= r.score <= 1 for r in found.values())
    assert len(license.RULES) > 400


MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without restriction"""


def test_written_license_rules(spark):
    """Wordings by hand, with the labels they must give."""
    cases = [
        ("released under the GNU General Public License", "gpl"), ("licensed under the Mozilla Public License.", "mpl"),
        ("GPLv3", "gpl-3"), ("GPL v2 or later", "gpl-2"), ("licensed under the Apache License", "apache"),
        ("Apache License v2", "apache-2"), ("BSD license", "bsd"), (MIT_GRANT, "mit"), ("the MIT-licensed code", "mit"),
        ("(LGPLv2.1+)", "lgpl-2"), ("the Library, GNU Lesser General Public License, version 3", "lgpl-3"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
        ("https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa"), ("CC0 1.0 Universal", "cc0-1"),
        ("All rights reserved.", "all-rights-reserved"), ("three-clause BSD", "bsd-3-clause"),
        ("submitted to MIT in 2002; the apache tribe; gplus", ""), ("it is under the bridge, with a license plate", ""),
    ]
    data = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id bigint, text string")
    found = {r.doc_id: (r.labels, r.score) for r in license.scan_licenses(data).collect()}
    assert {cases[i][0]: r[0] for i, r in found.items()} == dict(cases)
    assert all((score > 0) == bool(labels) for labels, score in found.values())
    # A keyword is one word, so it is found however the words are set apart.
    assert all(re.fullmatch("[a-z0-9 ]+", rule["kw2"]) for rule in license.RULES)
    # Repeats are bounded, by 12 words at most.
    assert not any(re.search(r"[*+](?! )|\)\+", rule["rx"].replace("[^ ]+ ", "").replace("[0-9]+ ", "").replace("[a-z]*", "")) for rule in license.RULES)
    assert max(rule["rx"].count(" ") for rule in license.RULES) + 12 < license.MOST_WORDS


def test_licenses_against_brute_force(spark):
    """Every rule tried at every word with Python's expressions, and hits inside others removed."""
    parts = ["GPLv2+", "lgplv3", "MPL2.0", "apache2 licensed", "eupl v1.2", "SPDX-License-Identifier: CDDL-1.0", "asl2", "0BSD",
             "Creative Commons Attribution-NonCommercial", "placed into the public domain", "under the mit license", "GNU GPL v3", "Apache License, Version 2.0", "cc by-nc", "the", "license", MIT_GRANT,
             "the BSD license", "all rights reserved", "version 2 of the GNU General Public License", "é", "under"]
    random.seed(1)
    texts = [random.choice([" ", "\n", " - "]).join(random.choices(parts, k=random.randint(0, 8))) for _ in range(60)]
    data = spark.createDataFrame(list(enumerate(texts)) * 2, "doc_id bigint, text string")
    rows = license.scan_licenses(data).collect()
    assert len(rows) == 120
    for r in rows:
        words = re.findall(license.WORD, texts[r.doc_id].lower())
        norm = " " + " ".join(words) + " "
        starts = [0, *itertools.accumulate(len(w) + 1 for w in words)]
        hits = []
        for rule in license.RULES:
            for i in range(len(words)):
                m = re.compile(f"(?:{rule['rx']})(?= )").match(norm, starts[i] + 1)
                if m:
                    hits.append((i, -(i + len(m.group().split(" "))), rule["prio"], rule))
        end, labels, base = 0, set(), [h for h in hits if h[3]["base"]]
        for start, minus_end, _, rule in sorted(hits, key=lambda h: h[:3]):
            if -minus_end > end:
                end, labels = -minus_end, labels | {rule["label"]}
        assert (r.n_words, r.n_base) == (len(words), len(base))
        assert r.labels == ",".join(sorted(labels | {h[3]["label"] for h in base}))


def test_license_suppression(spark):
    """A longer interval hides those inside it; a tie goes to the better rule."""
    rules = [
        {"kw": "x", "kw2": "x", "rx": "x y z", "label": "long", "base": False, "conf": 0.5, "prio": 2},
        {"kw": "x", "kw2": "y", "rx": "y z", "label": "inside", "base": False, "conf": 0.9, "prio": 0},
        {"kw": "x", "kw2": "x", "rx": "x y z", "label": "later", "base": False, "conf": 0.9, "prio": 3},
        {"kw": "x", "kw2": "z", "rx": "z w", "label": "overlap", "base": False, "conf": 0.4, "prio": 1},
    ]
    data = spark.createDataFrame([(1, "x y z w")], "doc_id bigint, text string")
    row = license.scan_licenses(data, rules).first()
    assert (row.labels, row.score, row.n_detections) == ("long,overlap", 0.5, 2)


def test_fingerprints(spark, docs, rows):
    found = {r.doc_id: r for r in fingerprint.fingerprint_edits(docs).collect()}
    ordered = sorted(rows, reverse=True)
    exact = []
    for at, row in enumerate(ordered):
        text, after = row[1] or "", ordered[(at + 1) % len(ordered)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r = found[row[0]]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()

        def shingles(t):
            w = split(t)
            return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

        a, b = shingles(text), shingles(edited)
        true = len(a & b) / len(a | b) if a | b else 1.0
        exact.append(abs(true - r.near_edited))
        if len(a | b) <= fingerprint.SKETCH_SIZE:
            assert r.near_edited == pytest.approx(true)
    assert max(exact) < 0.2
    by_text = defaultdict(set)
    for row in rows:
        by_text[row[1] or ""].add(found[row[0]].fingerprint)
    assert all(len(f) == 1 for f in by_text.values())


def test_fingerprint_merge(spark):
    a, b = "a b c d e f g h " * 3, "q w e r t y u i o p"
    data = spark.createDataFrame([(a, b)], "a string, b string")
    for column in ("a", "b"):
        data = fingerprint.with_sketch(data, column, f"s{column}", 4)
    merged = fingerprint.merge(F.col("sa"), F.col("sb"), 4)
    row = data.select(merged.alias("m"), "sa", "sb").first()
    assert row.m == sorted(set(row.sa) | set(row.sb))[:4]


def test_one_document_follows_itself(spark):
    row = fingerprint.fingerprint_edits(spark.createDataFrame([(None, "abc def")], "doc_id bigint, text string")).first()
    assert (row.n_chars, row.near_next) == (7, 1.0)


@pytest.mark.parametrize("n", [0, 700])
def test_fingerprints_of_a_hot_id(spark, n):
    """One id holds a third of all rows, half of them equal; next by id, then by text's hash."""
    hot = [(5, f"hot {i} " + "w x y z " * (i % 4)) for i in range(n // 2)] + [(5, "same text of many rows")] * (n // 2)
    rows = hot + [(i, f"row {i} of the others") for i in range(2 * n // 3 + 4)] + [(None, "no id"), (None, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, _n string").repartition(6)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text, r.next_text) for r in fingerprint.with_next(docs).collect())
    tied = spark.createDataFrame([(r[0], r[1] or "") for r in rows], "id bigint, text string")
    tied = tied.select("id", "text", F.xxhash64("text").alias("tie")).collect()
    ordered = sorted(tied, key=lambda r: (r.id is not None, r.id or 0, r.tie, r.text), reverse=True)
    following = ordered[1:] + ordered[:1]
    assert got == sorted((a.id is not None, a.id or 0, a.text, b.text) for a, b in zip(ordered, following))


def test_hot_ids_are_cut():
    bounds, pieces = fingerprint._pieces([3, 9, 9, 9, 20])
    assert (bounds, pieces) == ([3, 9, 10, 20], {2: 4})


def test_word_encoder_forgets_and_stays_exact():
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for part in range(4):
        words = [f"w{n * 7919:x}é's" for n in range(part * 90_000, (part + 1) * 90_000)]
        (found,) = encoder.encode([" ".join(words).encode()])
        assert len(encoder._number) <= packing.KNOWN_WORDS + 90_000
        assert len(encoder._piece) <= packing.KNOWN_WORDS + 90_000
    assert packing.KNOWN_WORDS <= 300_000
    assert found.tolist() == encoder._whole(" ".join(words))


def test_packing_task_stays_small(spark):
    """A task over 4 MB of ever new words, run here: what it holds at most, and what it gives back."""
    tasks = []

    class Rows:  # takes the task, as a DataFrame would
        def select(self, *columns):
            return self

        def mapInArrow(self, task, schema):
            tasks.append(task)

    packing.cut_pieces(Rows(), public_tokenizers.path("word_bpe_49k.json"))
    texts = [" ".join(f"{n * 2654435761 % 2**32:x}" for n in range(i * 150, i * 150 + 150)) for i in range(3000)]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    n = sum(found.num_rows for found in tasks[0](iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(texts)
    assert most < 90e6, f"{most / 1e6:.0f} MB"


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="needs malloc_trim")
def test_released_memory_leaves_the_process():
    def used():
        return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    kept = []

    def task(batches):
        blocks = [bytes(4096) for _ in range(50_000)]
        kept.extend(blocks[::1000])  # between the others, which are freed
        yield len(blocks)

    before = used()
    assert list(flat.released(task)(iter([]))) == [50_000]
    assert used() - before < 50


def test_words_and_passages_by_parts_are_those_of_the_whole(monkeypatch):
    rng = np.random.default_rng(4)
    words = ["a", "été", "Xyz,", "\n", "", "longer-word", "12"]
    texts = [" ".join(rng.choice(words, n)) for n in rng.integers(0, 400, 300)] + ["", None, " ", "e" * 5000, "", " \t"]
    for some in (texts, texts[::-1], texts[-6:], [None], []):
        column = flat.Texts.of(pa.array(some, pa.string()))
        monkeypatch.setattr(flat, "PART_BYTES", 1 << 40)
        monkeypatch.setattr(quality, "PART_BYTES", 1 << 40)
        whole = [*vars(flat.Words.of(column)).values(), *quality.passages(column)]
        monkeypatch.setattr(flat, "PART_BYTES", 3000)
        monkeypatch.setattr(quality, "PART_BYTES", 4000)
        parts = [*vars(flat.Words.of(column)).values(), *quality.passages(column)]
        assert all(a.dtype == b.dtype and np.array_equal(a, b) for a, b in zip(whole, parts))


def test_words_and_passages_take_memory_of_a_part():
    texts = flat.Texts.of(pa.array(["some words of a text " * 100] * 1000))
    for task, most in ((flat.Words.of, 20), (quality.passages, 16)):
        tracemalloc.start()
        task(texts)
        peak = tracemalloc.get_traced_memory()[1] / len(texts.data)
        tracemalloc.stop()
        assert peak < most


def test_packing_against_whole_text_tokenizer(docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    capacity = 256
    found = packing.pack_documents(docs, path, capacity).collect()
    by_doc, by_sequence, total = defaultdict(list), defaultdict(list), 0
    for r in found:
        by_doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for row in rows:
        ids = tokenizer.encode(row[1] or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        raw = [b"".join(i.to_bytes(4, "little") for i in ids[a : a + capacity]) for a in range(0, len(ids), capacity)]
        assert sorted(by_doc[row[0]]) == [(k, k * capacity, len(p) // 4, zlib.crc32(p)) for k, p in enumerate(raw)]
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by_sequence) <= -(-total // capacity) * 1.1 + 1


def test_minimum_bin_slack():
    histogram = {7: 5, 5: 10, 3: 4, 2: 9, 1: 1}
    plan = packing.minimum_bin_slack(histogram, 10)
    used = Counter()
    for times, combination in plan:
        assert sum(n * c for n, c in combination.items()) <= 10
        for n, c in combination.items():
            used[n] += c * times
    assert used == histogram
    assert sum(t for t, _ in plan) <= 13
    assert packing.minimum_bin_slack({}, 10) == []


def test_mixing_targets_and_totals(spark):
    random.seed(2)
    rows = [(i, "w " * random.randint(1, 40), "x" if i % 3 else "y", 0) for i in range(3000)]
    rows += [(5000, None, None, 0), (5001, "a b c", None, 0), (5002, "", "y", 0)]
    data = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _node int")
    found = mixing.mix_sources(data, group_rows=100, fan_in=4).collect()
    assert len(found) == len(rows)
    again = {r.doc_id: r.taken for r in mixing.mix_sources(data.repartition(7), group_rows=100, fan_in=4).collect()}
    assert again == {r.doc_id: r.taken for r in found}
    totals = defaultdict(lambda: [0, 0, 0.0])
    for r in found:
        assert 0 <= r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
        totals[r.source][0] += r.size
        totals[r.source][1] += r.taken
        totals[r.source][2] = r.target
    everything = sum(t[0] for t in totals.values())
    # Sources x, y and null weigh 1, 2 and 3; the last is capped at 3 times its 3 words.
    assert totals[None][2] == 9
    assert totals["x"][2] == pytest.approx((everything - 9) / 3)
    assert totals["y"][2] == pytest.approx((everything - 9) * 2 / 3)
    for size, taken, target in totals.values():
        assert abs(taken - target) <= 40


def test_mixing_keeps_expectation(spark):
    """Over many seeds a document is taken as often as its chance says."""
    import numpy as np

    sizes = np.array([50, 20, 20, 7, 5, 3, 2, 1], float)
    chances = np.full(8, 0.3)
    mean = np.mean(
        [mixing._settle(sizes, chances, np.random.default_rng(s)) for s in range(4000)], axis=0
    )
    assert np.abs(mean - 0.3).max() < 0.05


def test_empty_tables(nothing):
    assert substring.removal_digests(nothing).count() == 0
    assert suffix.removal_digests(nothing).count() == 0
    assert jaccard.similar_components(nothing).count() == 0
    assert license.scan_licenses(nothing).count() == 0
    assert fingerprint.fingerprint_edits(nothing).count() == 0
    assert mixing.mix_sources(nothing).count() == 0
    assert packing.pack_documents(nothing, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_words_are_those_of_the_contract():
    import pyarrow as pa

    texts = ["a\x1cb \x0bc d", None, "", "  x  "]
    words = flat.Words.of(flat.Texts.of(pa.array(texts)))
    assert words.first.tolist() == [0, 2, 2, 2, 3]
