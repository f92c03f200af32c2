"""Language model scoring: a hashed maximum-entropy model with class-factored softmax.

Every token is predicted in two steps: its class given the three words before it, then the
word given its class. The most frequent words of the training rows (``HEAD``) form classes
of 32 words by frequency, and a second softmax picks the word inside. All other words are
in classes by their last two bytes, and are picked there by their counts over the corpus,
with one share for words never seen. Both softmaxes are linear in hashed features: the words
one, two and three places back (skip features), and the pairs (-2, -1) and (-3, -1).

Training goes through all training rows once, in ``ROUNDS`` rounds. In a round each task
starts from the same weights, takes gradient steps over its share of the rows, and returns
what it changed with how often; a reduction tree in Spark averages the changes row by row.
Weights start at the classes' and words' log frequencies.

Counts are exact and cover all training rows: tasks pre-aggregate, buckets of word ids add
up. Batches of documents then send their distinct word ids to those buckets and get the
counts back, so no word leaves a batch more than once. A word is known by an id of 64 bits,
60 of them a hash: among n distinct words some two collide with a chance of about
n * n / 2**61 (two in a hundred for 2 * 10**8 words).

Defined cases: null and empty texts are one end token; rows without an id are learned from;
without training rows nothing is known and the model is uniform over classes; repeated rows
count each by itself, and are scored alike; texts of any length are whole in one batch; an
empty table gives no rows; other columns pass through inside ``doc``.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from matchloom.llm.flat import Texts, Words, mix
from matchloom.storage import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEAD_CLASSES, CLASS_WORDS, TAIL_CLASSES = 16, 32, 16
HEAD = HEAD_CLASSES * CLASS_WORDS
CLASSES = HEAD_CLASSES + TAIL_CLASSES
# Hash buckets of the features of classes, and of words inside one class.
CLASS_ROWS, WORD_ROWS = 1 << 14, 1 << 10
# Of the features, those that words inside a class are told by: one and two places back, and the pair.
WORD_FEATURES = 3
ROUNDS = 3
MINI_BATCH = 8192
# Lines of a segment that are added place by place, at most.
SHORT = 8
RATE = 0.5
# Changes that one task of the reduction tree adds up.
FAN_IN = 16
BLOCK_ROWS = 1 << 12
# Tokens counted or scored at a time.
COUNT_IDS, SCORE_TOKENS = 4_000_000, 1 << 12
BATCH_BYTES = 8 << 20
END, START = np.uint64(0), np.uint64((1 << 64) - 1)
TAIL_MASK = np.uint64(TAIL_CLASSES - 1)
# Bits of an id by which head words are looked up.
PLACE_BITS = 17


@dataclass
class Tokens:
    """Ids of all tokens, each text's words and then one end; ``first[i]`` is text i's first."""

    ids: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: Texts) -> Tokens:
        words = Words.of(texts)
        data = texts.data
        # The last two bytes decide the class of a word outside the head.
        last = data[words.end - 1].astype(np.uint64)
        before = data[np.maximum(words.end - 2, words.start)].astype(np.uint64)
        tail = mix((last << np.uint64(8)) | before) >> np.uint64(60)
        ids = (words.hashes & ~TAIL_MASK) | (tail & TAIL_MASK)
        ids[(ids == END) | (ids == START)] ^= np.uint64(1 << 60)
        n = len(texts)
        first = words.first + np.arange(n + 1)
        out = np.full(len(ids) + n, END, np.uint64)
        out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(words.first))] = ids
        return cls(out, first)

    def history(self, back: int) -> np.ndarray:
        """The token ``back`` places before each, START before a text's first."""
        out = np.full(len(self.ids), START, np.uint64)
        out[back:] = self.ids[:-back]
        place = np.arange(len(self.ids)) - np.repeat(self.first[:-1], np.diff(self.first))
        out[place < back] = START
        return out


def features(tokens: Tokens) -> np.ndarray:
    """Hashes of the five n-gram and skip features of every token."""
    one, two, three = (tokens.history(b) for b in (1, 2, 3))
    second = np.uint64(0x9E3779B97F4A7C15)
    return np.stack(
        [
            mix(one + np.uint64(1)),
            mix(two + np.uint64(2)),
            mix(one * second + mix(two + np.uint64(4))),
            mix(three + np.uint64(3)),
            mix(one * second + mix(three + np.uint64(5))),
        ],
        axis=1,
    )


def _logits(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the weights of each line of row numbers; the largest outcome of a line is 0."""
    logits = weights.take(rows[:, 0], 0)
    for j in range(1, rows.shape[1]):
        logits += weights.take(rows[:, j], 0)
    logits -= logits.max(1, keepdims=True)
    return logits


def softmax_log(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log probabilities of all outcomes for each line of row numbers."""
    logits = _logits(weights, rows)
    logits -= np.log(np.exp(logits).sum(1, keepdims=True))
    return logits


def target_log(weights: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log probability of one outcome for each line: ``softmax_log`` at ``target``."""
    logits = _logits(weights, rows)
    own = logits[np.arange(len(target)), target]
    return own - np.log(np.exp(logits, out=logits).sum(1))


def segment_sums(values: np.ndarray, at: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For every segment i, the sum of ``values`` in the lines at[first[i] : first[i] + sizes[i]].

    Most segments are short: their lines are added place by place, for all segments at once,
    in the order of ``np.add.reduceat``, which adds up the long ones.
    """
    # Numbers of 16 bits sort fastest.
    most = sizes.max()
    longest = np.argsort((most - sizes).astype(np.min_scalar_type(most)), kind="stable")
    begin, ordered = first[longest], sizes[longest]
    out = values.take(at[begin], 0)
    # How many segments go beyond each place; those beyond the last are long.
    beyond = np.searchsorted(-ordered, -np.arange(1, SHORT + 1))
    long = beyond[-1]
    if beyond[0] > long:
        rest = values.take(at[begin[long : beyond[0]] + 1], 0)
        for place, n in zip(range(2, SHORT), beyond[1:]):
            if n <= long:
                break
            rest[: n - long] += values.take(at[begin[long:n] + place], 0)
        out[long : beyond[0]] += rest
    if long:
        starts = np.cumsum(ordered[:long]) - ordered[:long]
        lines = np.repeat(begin[:long] - starts, ordered[:long]) + np.arange(ordered[:long].sum())
        out[:long] = np.add.reduceat(values.take(at[lines], 0), starts)
    back = np.empty(len(first), np.int64)
    back[longest] = np.arange(len(first))
    return out.take(back, 0)


class Learner:
    """Gradient steps on one table of weights; remembers how often each row was moved."""

    def __init__(self, weights: np.ndarray) -> None:
        self.start, self.weights = weights, weights.copy()
        self.steps = np.zeros(len(weights), np.float32)
        self.squares = np.full(len(weights), 1e-2, np.float32)

    def step(self, rows: np.ndarray, target: np.ndarray) -> None:
        if not len(rows):
            return
        gradient = softmax_log(self.weights, rows)
        np.exp(gradient, out=gradient)
        gradient[np.arange(len(target)), target] -= 1
        flat = rows.ravel()
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        found, sizes = ordered[first].astype(np.intp), np.diff(np.append(first, len(flat)))
        n = sizes.astype(np.float32)
        mean = segment_sums(gradient, order // rows.shape[1], first, sizes)
        mean /= n[:, None]
        # Rows seen often in one batch have a surer mean; each has its own rate.
        self.squares[found] += np.square(mean).sum(1) * np.minimum(n, 8)
        rate = RATE * np.sqrt(np.minimum(n, 8) / self.squares[found])
        mean *= np.minimum(rate, 1.0)[:, None]
        self.weights[found] = self.weights.take(found, 0) - mean
        self.steps[found] += n


@dataclass
class Vocabulary:
    """What the counts over the whole corpus say: sizes, head words and tail classes."""

    tokens: int
    types: int
    head: np.ndarray  # ids of head words in ascending order
    slot: np.ndarray  # their place: class * CLASS_WORDS + place in class
    head_count: np.ndarray  # counts by slot, 0 where unused
    tail_tokens: np.ndarray
    tail_types: np.ndarray

    @cached_property
    def _places(self) -> tuple[np.uint64, np.ndarray] | None:
        """How far ids are shifted, and where the head word with those last bits is; None when
        no shift tells all head words apart.
        """
        for shift in range(TAIL_CLASSES.bit_length() - 1, 65 - PLACE_BITS):
            keys = self._keys(self.head, np.uint64(shift))
            if len(np.unique(keys)) == len(keys):
                places = np.zeros(1 << PLACE_BITS, np.int16)
                places[keys] = np.arange(len(keys))
                return np.uint64(shift), places
        return None

    def _keys(self, ids: np.ndarray, shift: np.uint64) -> np.ndarray:
        return ((ids >> shift) & np.uint64((1 << PLACE_BITS) - 1)).view(np.int64)

    def outcome(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of every token, and place in the class (-1 in a tail class)."""
        if not len(self.head):
            slot = np.full(len(ids), -1)
        else:
            if self._places:
                shift, places = self._places
                at = places.take(self._keys(ids, shift))
            else:
                at = np.minimum(np.searchsorted(self.head, ids), len(self.head) - 1)
            slot = np.where(self.head.take(at) == ids, self.slot.take(at), -1)
        tail = HEAD_CLASSES + (ids & TAIL_MASK).astype(np.int64)
        return np.where(slot >= 0, slot // CLASS_WORDS, tail), np.where(slot >= 0, slot % CLASS_WORDS, -1)

    def initial(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights that give classes and words their frequencies, whatever comes before."""
        by_class = self.head_count.reshape(HEAD_CLASSES, CLASS_WORDS)
        mass = np.append(by_class.sum(1), self.tail_tokens + 1).astype(float)
        classes = np.zeros((CLASS_ROWS + 1, CLASSES), np.float32)
        with np.errstate(divide="ignore"):
            classes[-1] = np.maximum(np.log(mass / mass.sum()), -1e9)
            words = np.zeros((HEAD_CLASSES, WORD_ROWS + 1, CLASS_WORDS), np.float32)
            share = by_class / np.maximum(by_class.sum(1, keepdims=True), 1)
            words[:, -1] = np.maximum(np.log(share), -1e9)
        return classes, words.reshape(-1, CLASS_WORDS)


def _rows(hashes: np.ndarray, classes: np.ndarray | None = None) -> np.ndarray:
    """Numbers of the weight rows that features select, with the one that is always on."""
    size = CLASS_ROWS if classes is None else WORD_ROWS
    hashes = hashes if classes is None else hashes[:, :WORD_FEATURES]
    # Both tables have fewer than 2**16 rows, and 16-bit numbers sort fastest.
    rows = np.empty((len(hashes), hashes.shape[1] + 1), np.uint16)
    rows[:, :-1] = hashes & np.uint64(size - 1)
    rows[:, -1] = size
    if classes is not None:
        rows += (classes * (size + 1)).astype(np.uint16)[:, None]
    return rows


def token_scores(
    tokens: Tokens, counts: np.ndarray, vocabulary: Vocabulary, weights: tuple[np.ndarray, np.ndarray]
) -> np.ndarray:
    """log10 of every token's probability; ``counts`` are over the training rows."""
    hashes = features(tokens)
    classes, words = vocabulary.outcome(tokens.ids)
    out = np.empty(len(tokens.ids))
    for a in range(0, len(out), SCORE_TOKENS):
        part = slice(a, a + SCORE_TOKENS)
        own, word = classes[part], words[part]
        score = target_log(weights[0], _rows(hashes[part]), own).astype(float)
        head = np.flatnonzero(word >= 0)
        score[head] += target_log(weights[1], _rows(hashes[part][head], own[head]), word[head])
        tail = np.flatnonzero(word < 0)
        t = own[tail] - HEAD_CLASSES
        room = vocabulary.tail_tokens[t] + vocabulary.tail_types[t] + 1
        score[tail] += np.log((counts[part][tail] + 1) / room)
        out[part] = score
    return out / np.log(10)


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 when divided by seven."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _chunks(column: pa.ChunkedArray | pa.Array, size: int = 1 << 20) -> Iterator[Tokens]:
    """Tokens of about ``size`` bytes of text at a time."""
    for _, part in Texts.of(column, lower=True).parts(size):
        yield Tokens.of(part)


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """All distinct ids in ascending order; a sort takes less time than ``np.unique`` here."""
    ids = np.sort(np.concatenate(parts))
    return ids[np.append(True, ids[1:] != ids[:-1])]


def _summed(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in ascending order, with the sums of their counts."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    return ids[first], np.add.reduceat(counts[order], first) if len(ids) else counts


PIECE = "bucket int, ids binary, counts binary"


def _cuts(ids: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's ids begin in ascending ids, with the end."""
    edges = np.arange(1, buckets, dtype=np.uint64) * np.uint64((1 << 64) // buckets)
    return np.concatenate([[0], np.searchsorted(ids, edges), [len(ids)]])


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs."""
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def _wide(payload: bytes, n: int) -> np.ndarray:
    return np.frombuffer(payload, f"<u{len(payload) // n}").astype(np.int64)


def count_tokens(docs: DataFrame, buckets: int) -> DataFrame:
    """Ids and counts of all tokens of ``text``, packed: one row per bucket of ids."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def pieces() -> pa.RecordBatch:
            ids, counts = _summed(*map(np.concatenate, zip(*waiting)))
            cuts = _cuts(ids, buckets)
            full = np.flatnonzero(np.diff(cuts))
            parts = [slice(cuts[b], cuts[b + 1]) for b in full]
            return pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array(full, pa.int32()),
                    "ids": pa.array([ids[p].tobytes() for p in parts], pa.binary()),
                    "counts": pa.array([_narrow(counts[p]) for p in parts], pa.binary()),
                }
            )

        for batch in batches:
            for tokens in _chunks(batch.column("text")):
                waiting.append(np.unique(tokens.ids, return_counts=True))
                n += len(waiting[-1][0])
                if n > COUNT_IDS:
                    waiting = [_summed(*map(np.concatenate, zip(*waiting)))]
                    n = len(waiting[0][0])
                    if n > COUNT_IDS // 2:
                        yield pieces()
                        waiting, n = [], 0
        if waiting:
            yield pieces()

    def add(table: pa.Table) -> pa.Table:
        ids = [np.frombuffer(x, np.uint64) for x in table["ids"].to_pylist()]
        counts = [_wide(x, len(i)) for x, i in zip(table["counts"].to_pylist(), ids)]
        ids, counts = _summed(np.concatenate(ids), np.concatenate(counts))
        return pa.table({"bucket": table["bucket"][:1], "ids": [ids.tobytes()], "counts": [_narrow(counts)]})

    return docs.select("text").mapInArrow(send, PIECE).groupBy("bucket").applyInArrow(add, PIECE)


def vocabulary_of(counted: DataFrame) -> Vocabulary:
    """Totals and head words of packed counts."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, counts in zip(batch.column("ids").to_pylist(), batch.column("counts").to_pylist()):
                ids = np.frombuffer(ids, np.uint64)
                counts = _wide(counts, len(ids))
                tail = (ids & TAIL_MASK).astype(np.int64)
                words = ids != END
                n = np.bincount(tail[words], counts[words], TAIL_CLASSES).astype(np.int64)
                # Its most frequent ids, and those as frequent as the last of them.
                least = np.sort(counts)[-min(HEAD, len(counts))]
                top = np.flatnonzero(counts >= least)
                top = top[np.lexsort((ids[top], -counts[top]))][:HEAD]
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": pa.array(np.append(ids[top].view(np.int64), np.zeros(TAIL_CLASSES, np.int64))),
                        "tail": pa.array(np.append(np.full(len(top), -1), np.arange(TAIL_CLASSES)), pa.int32()),
                        "n": pa.array(np.append(counts[top], n)),
                        "types": pa.array(np.append(np.ones(len(top), np.int64), np.bincount(tail[words], minlength=TAIL_CLASSES))),
                    }
                )

    found = counted.mapInArrow(summary, "id bigint, tail int, n bigint, types bigint")
    tails = found.filter("tail >= 0").groupBy("tail").agg(F.sum("n").alias("n"), F.sum("types").alias("types"))
    tail_tokens, tail_types = np.zeros(TAIL_CLASSES, np.int64), np.zeros(TAIL_CLASSES, np.int64)
    for row in tails.collect():  # TAIL_CLASSES rows
        tail_tokens[row["tail"]], tail_types[row["tail"]] = row["n"], row["types"]
    # The end token, then the words by count; ids are compared as unsigned numbers.
    end = int(END)
    top = (
        found.filter("tail < 0")
        .orderBy((F.col("id") != end), F.col("n").desc(), F.col("id").bitwiseXOR(F.lit(-(1 << 63))))
        .limit(HEAD).collect()
    )
    ids = np.array([r["id"] for r in top], np.int64).view(np.uint64)
    n = np.array([r["n"] for r in top], np.int64)
    ends = int(n[ids == END].sum())
    tokens, types = int(tail_tokens.sum()) + ends, int(tail_types.sum()) + (ends > 0)
    word = ids != END
    np.subtract.at(tail_tokens, (ids[word] & TAIL_MASK).astype(np.int64), n[word])
    np.subtract.at(tail_types, (ids[word] & TAIL_MASK).astype(np.int64), 1)
    head_count = np.zeros(HEAD, np.int64)
    head_count[: len(n)] = n
    order = np.argsort(ids)
    return Vocabulary(tokens, types, ids[order], order, head_count, tail_tokens, tail_types)


def _add_changes(changes: DataFrame, tasks: int) -> DataFrame:
    """Sums per block by a tree: no task reads more than FAN_IN changes of one block."""

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")
        change, n = 0.0, 0.0
        for c, s in zip(table["change"].to_pylist(), table["steps"].to_pylist()):
            change = change + np.frombuffer(c, np.float32)
            n = n + np.frombuffer(s, np.float32)
        return pa.table(
            {"block": table["block"][:1], "task": pa.compute.divide(table["task"][:1], FAN_IN).cast(pa.int32()),
             "change": [change.tobytes()], "steps": [n.tobytes()]}
        )

    while tasks > 1:
        group = F.floor(F.col("task") / FAN_IN).alias("group")
        changes = changes.groupBy("block", group).applyInArrow(add, changes.schema)
        tasks = -(-tasks // FAN_IN)
    return changes


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights of classes and of words after one pass over ``docs`` in ``rounds`` parts."""
    weights = vocabulary.initial()
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds))
    for turn in range(rounds):
        start = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps((vocabulary, weights)))

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, weights = pickle.loads(start.value)
            learners = [Learner(w) for w in weights]
            for batch in batches:
                for tokens in _chunks(batch.column("text")):
                    hashes = features(tokens)
                    classes, words = vocabulary.outcome(tokens.ids)
                    for a in range(0, len(classes), MINI_BATCH):
                        one = slice(a, a + MINI_BATCH)
                        learners[0].step(_rows(hashes[one]), classes[one])
                        head = a + np.flatnonzero(words[one] >= 0)
                        learners[1].step(_rows(hashes[head], classes[head]), words[head])
            task, block = TaskContext.get().partitionId(), 0
            for learner in learners:
                change = (learner.weights - learner.start) * learner.steps[:, None]
                for a in range(0, len(change), BLOCK_ROWS):
                    if learner.steps[a : a + BLOCK_ROWS].any():
                        yield pa.RecordBatch.from_pydict(
                            {
                                "block": pa.array([block], pa.int32()),
                                "task": pa.array([task], pa.int32()),
                                "change": [change[a : a + BLOCK_ROWS].tobytes()],
                                "steps": [learner.steps[a : a + BLOCK_ROWS].tobytes()],
                            }
                        )
                    block += 1

        own = docs.filter(part == turn).select("text")
        changes = own.mapInArrow(learn, "block int, task int, change binary, steps binary")
        weights = tuple(w.copy() for w in weights)
        starts = [(w, a) for w in weights for a in range(0, len(w), BLOCK_ROWS)]
        # One row per block: the size of the model.
        for row in _add_changes(changes, own.rdd.getNumPartitions()).collect():
            table, a = starts[row["block"]]
            change = np.frombuffer(row["change"], np.float32).reshape(-1, table.shape[1])
            steps = np.frombuffer(row["steps"], np.float32)
            table[a : a + BLOCK_ROWS] += change / np.maximum(steps, 1)[:, None]
        start.unpersist()
    return weights


def score_texts(docs: DataFrame) -> DataFrame:
    """Columns ``doc`` (all but the text), held_out, n_tokens, n_known, train_tokens,
    base_score and score of every row; the model learns from rows that are not held out.

    ``docs`` must be a stored table: it is read several times, and rows that are equal in
    all columns are told apart by their place in it.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Batches and buckets grow with the root of the input, so the pieces between them do not
    # become too many or too small.
    scale = max(1.0, (size / (4 << 30)) ** 0.5)
    n_batches = int(size / (BATCH_BYTES * scale)) + 1
    buckets = max(16, int(size / ((16 << 20) * scale)) + 1)
    learned = docs.filter(~held_out(F.col("doc_id")))
    counted = materialize(count_tokens(learned, buckets), "token-counts")
    vocabulary = vocabulary_of(counted)
    model = spark.sparkContext.broadcast(
        cloudpickle.dumps((vocabulary, train(learned, vocabulary)))
    )

    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    key = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(n_batches))
    batches = docs.select(key.cast("int").alias("batch"), "text", F.struct(*others).alias("doc"))

    def ask(table: pa.Table) -> pa.Table:
        ids = _distinct([_distinct([tokens.ids]) for tokens in _chunks(table["text"])])
        cuts = _cuts(ids, buckets)
        full = np.flatnonzero(np.diff(cuts))
        return pa.table(
            {
                "bucket": pa.array(full, pa.int32()),
                "batch": pa.array(np.full(len(full), table["batch"][0].as_py()), pa.int32()),
                "ids": pa.array([ids[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()),
            }
        )

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        ids = np.frombuffer(known["ids"][0].as_py(), np.uint64) if known.num_rows else np.zeros(1, np.uint64)
        counts = _wide(known["counts"][0].as_py(), len(ids)) if known.num_rows else np.zeros(1, np.int64)
        replies = []
        for piece in asked["ids"].to_pylist():
            piece = np.frombuffer(piece, np.uint64)
            at = np.minimum(np.searchsorted(ids, piece), len(ids) - 1)
            replies.append(_narrow(np.where(ids[at] == piece, counts[at], 0)))
        return pa.table({"batch": asked["batch"], "bucket": asked["bucket"], "counts": pa.array(replies, pa.binary())})

    schema = T.StructType(
        [batches.schema["doc"]]
        + [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known")]
        + [T.StructField(n, T.DoubleType()) for n in ("base_score", "score")]
    )
    arrow = to_arrow_schema(schema)

    def score(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in arrow})
        vocabulary, weights = pickle.loads(model.value)
        chunks = [(tokens, *np.unique(tokens.ids, return_inverse=True)) for tokens in _chunks(table["text"])]
        ids = _distinct([own for _, own, _ in chunks])
        cuts, known = _cuts(ids, buckets), np.zeros(len(ids), np.int64)
        for b, payload in zip(replies["bucket"].to_pylist(), replies["counts"].to_pylist()):
            known[cuts[b] : cuts[b + 1]] = _wide(payload, cuts[b + 1] - cuts[b])
        found = []
        for tokens, distinct, at in chunks:
            counts = known[np.searchsorted(ids, distinct)]
            base = np.log10((counts + 1) / (vocabulary.tokens + vocabulary.types + 1)).take(at)
            counts = counts.take(at)
            own = token_scores(tokens, counts, vocabulary, weights)
            by_text = [np.add.reduceat(x, tokens.first[:-1]) for x in ((counts > 0).astype(np.int64), base, own)]
            found.append((np.diff(tokens.first), *by_text))
        columns = [pa.array(np.concatenate(c)) for c in zip(*found)]
        return pa.table(dict(zip(arrow.names, [table["doc"], *columns])))

    grouped = batches.groupBy("batch")
    asked = grouped.applyInArrow(ask, "bucket int, batch int, ids binary")
    replies = asked.groupBy("bucket").cogroup(counted.groupBy("bucket")).applyInArrow(
        answer, "batch int, bucket int, counts binary"
    )
    found = grouped.cogroup(replies.groupBy("batch")).applyInArrow(score, schema)
    return found.withColumns(
        {"held_out": held_out(F.col("doc.doc_id")), "train_tokens": F.lit(vocabulary.tokens).cast("bigint")}
    )


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    return score_texts(docs.select("doc_id", "text")).select(
        "doc.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
