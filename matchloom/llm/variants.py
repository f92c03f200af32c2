"""Spelling variants by search schemes over bidirectional FM-indexes.

Two words are near if they differ by one inserted, deleted or replaced code point. Then one
half of the shorter word is found unchanged at the same end of both. So words meet in groups
of an equal half: a word of length m sends its first m // 2 code points and its other ones as
keys of level m, and as the longer partner the same of level m - 1. Groups share buckets, and
every bucket gets a bidirectional FM-index over its delimited words: the suffix order of the
words and of the reversed words, walked together as a pair of rank intervals. The search
matches a word's unchanged half from the middle out to its delimiter, then switches direction
and extends across the other half with at most one error, to the other delimiter. An
insertion is found from the longer word, as a deletion.

The error's place is the length of the common prefix, which picks one key for every pair: a
pair is found in one bucket, once from each side of a replacement and once for a deletion.
Buckets return counts and the best near word per word, so pairs never leave a task. A group
with more than ``HOT_WORDS`` rows is split by the same rule: its words have a common half, so
the rest of them is cut in two, of which one is unchanged; and so on until a single code
point is left, which bounds the group by the alphabet.

Defined cases: null and empty texts have no words; rows of one id and repeated rows count each
by itself; runs of any length are one word; near words of equal count are taken by code-point
order; an empty table gives no words; other columns are ignored.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.storage import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
DELETE_EVERY = 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Rows of one key that are searched together at most, and rows of a bucket on average.
HOT_WORDS = 20_000
BUCKET_ROWS = 30_000
# Places between two stored counts of the symbols before them.
STEP = 32
FOUND = "word string, n_near bigint, near_n bigint, near string"


def corpus_words(docs: DataFrame) -> DataFrame:
    """(word, n): lower-cased runs of letters, some with one deleted, of 7 or more code points."""
    # Shorter runs cannot give words: a deletion only shortens.
    run = F.explode(F.regexp_extract_all("text", F.lit(rf"([A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}})"), F.lit(1)))
    runs = docs.select(F.col("doc_id").cast("string").alias("_id"), run.alias("_run")).withColumn(
        "_run", F.translate("_run", UPPER, LOWER)
    )
    # A null id is the empty text.
    crc = F.crc32(F.concat(F.coalesce("_id", F.lit("")), F.lit(":"), "_run").cast("binary"))
    at = (crc % F.char_length("_run")).cast("int")
    cut = F.concat(F.expr("left(_run, _at)"), F.expr("substring(_run, _at + 2)"))
    return (
        runs.withColumns({"_crc": crc, "_at": at})
        .select(F.when(F.col("_crc") % DELETE_EVERY == 0, cut).otherwise(F.col("_run")).alias("word"))
        .filter(F.char_length("word") >= LEAST_LENGTH)
        .groupBy("word").agg(F.count("*").alias("n"))
        .filter(F.col("n") >= LEAST_COUNT)
    )


class HalfIndex:
    """FM-index of distinct words in one direction: counts of smaller symbols by rank.

    The text is ``|w1|w2|...|wk|`` with words in ascending order. Suffixes are ordered to
    their word's end and then by their word, so the row of ``|w`` is the number of w.
    """

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, symbols: int) -> None:
        n = len(codes) + len(lengths) + 1
        text = np.zeros(n, np.int64)
        word_of = np.repeat(np.arange(len(lengths)), lengths)
        text[np.arange(len(codes)) + word_of + 1] = codes
        ends = np.append(np.cumsum(lengths) + np.arange(len(lengths)), 0)  # delimiter after each
        # Places left to the delimiter that ends each suffix.
        stop = np.zeros(n, np.int64)
        at = np.arange(len(codes)) + word_of + 1
        stop[at] = (ends[:-1] + 1)[word_of] - at
        order = self._order(text, stop, symbols)
        self.n, self.symbols = n, symbols
        # Before the text there is nothing; the delimiter there is row 0.
        self.bwt = np.append(text[order - 1], np.full(STEP, symbols, np.int64)).astype(np.int16)
        self.bwt[0] = symbols
        counts = np.bincount(text, minlength=symbols)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        blocks = n // STEP + 1
        table = np.zeros((blocks + 1, symbols + 2), np.int32)
        np.add.at(table, (np.arange(n) // STEP + 1, self.bwt[:n].astype(np.int64) + 1), 1)
        self.table = np.cumsum(np.cumsum(table, axis=0, dtype=np.int32), axis=1, dtype=np.int32)

    @staticmethod
    def _order(text: np.ndarray, stop: np.ndarray, symbols: int) -> np.ndarray:
        """Suffix order by doubling; nothing after a delimiter is compared but the place."""
        n = len(text)
        bits = max(1, int(symbols - 1).bit_length())
        reach = 63 // bits
        key = np.zeros(n, np.int64)
        for j in range(reach):
            piece = np.zeros(n, np.int64)
            piece[: n - j] = text[j:]
            key = (key << bits) | np.where(j < stop, piece, 0)
        longest = int(stop.max(initial=0))
        while reach < longest:
            rank = np.unique(key, return_inverse=True)[1] + 1
            further = np.zeros(n, np.int64)
            further[: n - reach] = rank[reach:]
            key = rank * (n + 1) + np.where(reach < stop, further, 0)
            reach *= 2
        return np.argsort(key, kind="stable")

    def smaller(self, symbol: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """How many of the first ``rank`` symbols are smaller than ``symbol``."""
        block = rank // STEP
        inside = self.bwt[(block * STEP)[:, None] + np.arange(STEP)]
        hit = (inside < symbol[:, None]) & (np.arange(STEP) < (rank % STEP)[:, None])
        return self.table[block, symbol] + hit.sum(1)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Intervals with ``symbol`` put before, and how far the other direction's begin moves."""
        below, above = self.smaller(symbol, low), self.smaller(symbol, high)
        begin = self.first[symbol] + self.smaller(symbol + 1, low) - below
        end = self.first[symbol] + self.smaller(symbol + 1, high) - above
        return begin, end, above - below

    def children(self, low: np.ndarray, high: np.ndarray):
        """For each distinct interval its number, and the letters that come before it."""
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + low[owner]
        pair = np.unique(owner * (self.symbols + 1) + self.bwt[at])
        owner, symbol = np.divmod(pair, self.symbols + 1)
        letter = (symbol > 0) & (symbol < self.symbols)
        return owner[letter], symbol[letter]


@dataclass
class Query:
    """Rows of one direction: their words, and where their one error may be.

    Places count in this direction from the word's unchanged end, which has ``begin`` code
    points. Words of the level's own length may have one replaced at ``begin`` or later, up
    to ``limit``; longer ones may have one deleted, from ``begin`` or one place after.
    """

    word: np.ndarray
    longer: np.ndarray
    begin: np.ndarray
    limit: np.ndarray


def _search(main: HalfIndex, other: HalfIndex, codes: np.ndarray, first: np.ndarray, q: Query, mirrored: bool):
    """(row of ``q``, row of the word found in ``main``) of all words with one error.

    ``main`` extends away from the unchanged end, ``other`` towards it. Of deletions that
    give the same word, the one at the end of the common prefix of the words as written
    counts; ``mirrored`` says that the words are reversed here.
    """
    start, length = first[q.word], first[q.word + 1] - first[q.word]

    def own(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        inside = places < length[rows]
        return np.where(inside, codes[start[rows] + np.where(inside, places, 0)], 0)

    # The unchanged part, from its last code point out to the delimiter. The interval of the
    # other direction begins behind the delimiter at the text's begin.
    low, high = np.zeros(len(q.word), np.int64), np.full(len(q.word), other.n, np.int64)
    pair = np.ones(len(q.word), np.int64)
    for back in range(int(q.begin.max(initial=-1)) + 1):
        live = np.flatnonzero(back <= q.begin)
        at = q.begin[live] - 1 - back
        symbol = np.where(at >= 0, codes[start[live] + np.maximum(at, 0)], 0)
        low[live], high[live], moved = other.extend(symbol, low[live], high[live])
        pair[live] += moved

    # States without an error so far, and with one: row, interval and next place.
    row, none = np.arange(len(q.word)), np.zeros(0, np.int64)
    low, high, at = pair, pair + high - low, q.begin.copy()
    e_row, e_low, e_high, e_at = none, none, none, none
    done_row, done_word = [none], [none]
    while len(row) or len(e_row):
        here = own(row, at)
        # The longer word's code point is deleted, one of a run of equal ones.
        twin = own(row, at - 1 if mirrored else at + 1) == here
        d = np.flatnonzero(q.longer[row] & ~twin & ((at > q.begin[row]) | (not mirrored)))
        # Another letter stands in place of the own; equal intervals are looked at once.
        s = np.flatnonzero(~q.longer[row])
        spans, which = np.unique(low[s] * (main.n + 1) + high[s], return_inverse=True)
        span_low, span_high = np.divmod(spans, main.n + 1)
        owner, symbol = main.children(span_low, span_high)
        child_low, child_high, _ = main.extend(symbol, span_low[owner], span_high[owner])
        begin = np.searchsorted(owner, np.arange(len(spans) + 1))
        n = (begin[1:] - begin[:-1])[which]
        by = np.repeat(np.arange(len(s)), n)
        child = np.arange(len(by)) - np.repeat(np.cumsum(n) - n, n) + begin[which[by]]
        by = s[by]
        changed = symbol[child] != here[by]
        by, child = by[changed], child[changed]
        fresh = (
            np.concatenate([row[d], row[by]]), np.concatenate([low[d], child_low[child]]),
            np.concatenate([high[d], child_high[child]]), np.concatenate([at[d] + 1, at[by] + 1]),
        )
        # Behind an error everything is unchanged, up to the other delimiter.
        symbol = own(e_row, e_at)
        e_low, e_high, _ = main.extend(symbol, e_low, e_high)
        ended = (symbol == 0) & (e_high > e_low)
        done_row.append(e_row[ended])
        done_word.append(e_low[ended])
        alive = np.flatnonzero((symbol > 0) & (e_high > e_low))
        states = (e_row[alive], e_low[alive], e_high[alive], e_at[alive] + 1)
        e_row, e_low, e_high, e_at = (np.concatenate(x) for x in zip(states, fresh))
        # Without an error, as far as one may still come.
        go = np.flatnonzero(at < q.limit[row])
        row, at = row[go], at[go] + 1
        low, high, _ = main.extend(here[go], low[go], high[go])
        alive = np.flatnonzero(high > low)
        row, low, high, at = row[alive], low[alive], high[alive], at[alive]
    return np.concatenate(done_row), np.concatenate(done_word)


def near_in_bucket(words: list[str], counts: np.ndarray, rows: np.ndarray) -> pa.Table:
    """Near words of distinct ascending ``words`` that the rows' keys let them find.

    ``rows`` has the word's number, the level and the lengths of the unchanged parts at the
    start and at the end.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    letters, codes = np.unique(points, return_inverse=True)
    codes = codes + 1
    first = np.concatenate([[0], np.cumsum(lengths)])
    # The words reversed, in the order of the reversed.
    back = np.array(sorted(range(len(words)), key=lambda i: words[i][::-1]), np.int64)
    place = np.empty(len(back), np.int64)
    place[back] = np.arange(len(back))
    ends = np.cumsum(lengths[back])
    at = np.arange(len(codes))
    owner = np.repeat(np.arange(len(back)), lengths[back])
    back_codes = codes[first[back][owner] + (ends[owner] - 1 - at)]
    back_first = np.concatenate([[0], ends])
    forward = HalfIndex(codes, lengths, len(letters) + 1)
    reverse = HalfIndex(back_codes, lengths[back], len(letters) + 1)

    word, level, head, tail = rows.T
    longer = lengths[word] > level
    a = np.flatnonzero(head >= tail)
    # The error lies before the unchanged tail; a word's very last code point may be deleted.
    limit = level - tail - 1 + (longer & (tail == 0))
    hit_row, hit = _search(
        reverse, forward, codes, first, Query(word[a], longer[a], head[a], limit[a]), False
    )
    x, y, deleted = word[a][hit_row], back[hit], longer[a][hit_row]
    # From the end the same, mirrored: there a deletion is one place further.
    b = np.flatnonzero(head < tail)
    limit = level - head - 1 + longer
    hit_row, hit = _search(
        forward, reverse, back_codes, back_first, Query(place[word[b]], longer[b], tail[b], limit[b]), True
    )
    x, y = np.append(x, word[b][hit_row]), np.append(y, hit)
    deleted = np.append(deleted, longer[b][hit_row])
    # A deletion counts for both words.
    x, y = np.concatenate([x, y[deleted]]), np.concatenate([y, x[deleted]])
    order = np.lexsort((y, -counts[y], x))
    x, y = x[order], y[order]
    begin = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    best = y[begin]
    return pa.table(
        {
            "word": pa.array([words[i] for i in x[begin]], pa.string()),
            "n_near": pa.array(np.diff(np.append(begin, len(x))), pa.int64()),
            "near_n": pa.array(counts[best], pa.int64()),
            "near": pa.array([words[i] for i in best], pa.string()),
        }
    )


def _keyed(rows: DataFrame) -> DataFrame:
    """A hash of the unchanged parts, by which a group meets."""
    return rows.withColumn(
        "key",
        F.xxhash64("level", "head", "tail", F.expr("left(word, head)"), F.expr("right(word, tail)")),
    )


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: with the first, and with the second half of its open part unchanged."""
    middle = F.col("head") + F.floor((F.col("level") - F.col("head") - F.col("tail")) / 2).cast("int")
    both = F.array(F.struct(middle.alias("head"), "tail"), F.struct("head", (F.col("level") - middle).alias("tail")))
    parts = rows.select("word", "n", "level", F.explode(both).alias("_part"))
    return parts.select("word", "n", "level", "_part.*")


def near_words(words: DataFrame, hot_words: int = HOT_WORDS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(word, n_near, near_n, near) of the words that have near words; ``words`` is (word, n)."""
    length = F.char_length("word").cast("int")
    levels = F.expr(f"filter(array(_l, _l - 1), x -> x >= {LEAST_LENGTH})")
    whole = words.withColumn("_l", length).select("word", "n", F.explode(levels).alias("level"))
    zero = F.lit(0).cast("int")
    rows = _keyed(_halves(whole.withColumns({"head": zero, "tail": zero})))
    n_words = words.count()

    ready = None
    while True:
        counts = rows.groupBy("key").agg(F.count("*").alias("_n"), F.max(F.col("level") - F.col("head") - F.col("tail")).alias("_open"))
        hot = materialize(counts.filter((F.col("_n") > hot_words) & (F.col("_open") > 1)).select("key"), "hot-keys")
        if hot.isEmpty():
            break
        # At most rows / hot_words keys.
        cool = rows.join(hot, "key", "left_anti")
        ready = cool if ready is None else ready.unionByName(cool)
        rows = materialize(_keyed(_halves(rows.join(hot, "key", "left_semi"))), "hot-words")
    ready = rows if ready is None else ready.unionByName(rows)

    buckets = int(4 * n_words / bucket_rows) + 1
    ready = ready.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))

    def solve(table: pa.Table) -> pa.Table:
        # A word alone with its key has no near word there.
        _, which, alike = np.unique(table["key"].to_numpy(), return_inverse=True, return_counts=True)
        table = table.filter(pa.array(alike[which] > 1))
        words = pa.compute.unique(table["word"])
        names = words.to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        number = place[pa.compute.index_in(table["word"], words).to_numpy()]
        counts = np.zeros(len(order), np.int64)
        counts[number] = table["n"].to_numpy()
        columns = [number] + [table[c].to_numpy().astype(np.int64) for c in ("level", "head", "tail")]
        return near_in_bucket([names[i] for i in order], counts, np.stack(columns, axis=1))

    found = ready.groupBy("bucket").applyInArrow(solve, FOUND)
    best = F.min(F.struct((-F.col("near_n")).alias("_n"), F.col("near").alias("near"))).alias("_best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("_best._n")).alias("near_n"), "_best.near"
    )


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of ``links`` (word, form) without cycles, by pointer doubling."""
    reached = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = reached.select(F.col("word").alias("_word"), F.col("root").alias("_further"))
        moved = materialize(
            reached.join(step, F.col("root") == F.col("_word"), "left").select(
                "word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved")
            ),
            "roots",
        )
        reached = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            return reached


def group_variants(docs: DataFrame, **options: int) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words of ``docs``."""
    words = materialize(corpus_words(docs.select("doc_id", "text")), "words")
    near = near_words(words, **options)
    is_form = F.col("near_n") >= RATIO * F.col("n")
    known = materialize(
        words.join(near, "word", "left").select(
            "word", F.when(is_form, F.col("near")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(is_form, F.col("near_n")).alias("form_n"),
        ),
        "forms",
    )
    linked = roots(known.filter("form is not null").select("word", "form"))
    return known.join(linked, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
