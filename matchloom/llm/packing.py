"""Best-fit packing of documents into sequences by minimum bin slack.

Texts become token ids; each document ends with an end id. Longer ones than a sequence
are cut, the rest stay whole. A sequence starts with the largest length left and takes
the fullest combination of other lengths that still fits, found by subset sums in a
bitset. That combination is used as often as its lengths last, so the search works on the
histogram of lengths: its cost is bounded by the sequence length, not by the corpus.

Defined cases: a null text is empty and becomes the end id alone; repeated rows are
packed each by itself; very long texts give many pieces; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchloom.llm.flat import Texts, released, trim
from matchloom.storage import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 4096
END_ID = 1
# Rows of one length that are numbered in one task.
RANK_ROWS = 1 << 16
# Words whose ids a task remembers, and as many pieces; it starts anew beyond.
KNOWN_WORDS = 1 << 18
# Bytes of text, at least, that are cut in words at a time.
PART_BYTES = 1 << 18
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


# Bytes of words that Unicode composition leaves as they are: printable ASCII, and two-byte
# letters from À to ÿ. Lower-cased, the tokenizer cuts them as LINES does when each word is
# on a line of its own. Fixed values of its file.
ASCII = np.zeros(256, bool)
ASCII[33:127] = True
LETTER = np.zeros(256, bool)
LETTER[0x80:0xC0] = True
LETTER[[0x97, 0xB7]] = False
LINES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\n]+|\n")


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for; ``new`` has the latest."""

    def __init__(self) -> None:
        self.new: list = []

    def __missing__(self, key) -> int:
        number = self[key] = len(self)
        self.new.append(key)
        return number


class Lists:
    """Lists of ids by number, one after the other in one array."""

    def __init__(self) -> None:
        self._first, self._ids, self._n, self._used = np.zeros(1, np.int64), np.zeros(0, np.uint32), 0, 0

    def add(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        n, used = self._n + len(sizes), self._used + len(ids)
        if n >= len(self._first):
            self._first = np.append(self._first, np.zeros(n, np.int64))
        if used > len(self._ids):
            self._ids = np.append(self._ids, np.zeros(used, np.uint32))
        self._first[self._n + 1 : n + 1] = self._used + np.cumsum(sizes)
        self._ids[self._used : used] = ids
        self._n, self._used = n, used

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all asked lists, and where each list ends among them."""
        first = self._first[at]
        n = self._first[at + 1] - first
        ends = np.cumsum(n)
        return self._ids[np.repeat(first - (ends - n), n) + np.arange(n.sum())], ends


def plain_words(words: list[bytes]) -> np.ndarray:
    """Which words have only characters that LINES knows, and no mark of a special token."""
    data = np.frombuffer(b"\n".join(words) + b"\n", np.uint8)
    lead = data == 0xC3
    good = ASCII[data]
    good[:-1] |= lead[:-1] & LETTER[data[1:]]
    good[1:] |= lead[:-1] & LETTER[data[1:]]
    good[:-1] &= ~((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    bad = np.append(0, np.cumsum(~good))
    # The line's end is the one byte of a plain word that is not good.
    return bad[ends] - bad[np.append(0, ends[:-1])] == 1


class WordEncoder:
    """Ids of texts, word by word, remembering the ids of words and of their pieces.

    Right for tokenizers that never join bytes across white space. ``pieces`` says that
    the tokenizer lower-cases and cuts plain words as ``LINES`` does; others are encoded
    whole, as are words with a special token in them.
    """

    def __init__(self, path: str, limit: int = KNOWN_WORDS, pieces: bool | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer, self._limit = Tokenizer.from_file(path), limit
        self._model = self._tokenizer.model
        trim()  # a third of what reading the file took
        self._pieces = os.path.basename(path) == "word_bpe_49k.json" if pieces is None else pieces

        letters = {chr(c) for c in range(33, 127)} | {chr(c) for c in range(192, 256)}
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._bytes = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in letters}
        self._forget_words()
        self._forget_pieces()

    def _forget_words(self) -> None:
        self._number, self._ids = Numbers(), Lists()

    def _forget_pieces(self) -> None:
        self._piece, self._piece_ids = Numbers(), Lists()
        self._piece["\n"] = 0
        self._piece_ids.add(np.zeros(1, np.int64), np.zeros(0, np.uint32))

    def _whole(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _merged(self, piece: str) -> list[int]:
        """Ids of one piece, straight from the merges."""
        # Printable ASCII characters stand for their own bytes.
        return [t.id for t in self._model.tokenize(piece if piece.isascii() else piece.translate(self._bytes))]

    def _learn_plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids, and the ids, of words that are cut in pieces."""
        if len(self._piece) > self._limit:
            self._forget_pieces()
        found = LINES.findall((b"\n".join(words) + b"\n").decode().lower())
        at = np.fromiter(map(self._piece.__getitem__, found), np.int64, len(found))
        sizes, ids = _listed([self._merged(p) for p in self._piece.new])
        self._piece_ids.add(sizes, ids)
        self._piece.new.clear()
        ids, ends = self._piece_ids.take(at)
        return np.diff(ends[at == 0], prepend=0), ids

    def _learn(self) -> None:
        words = self._number.new
        plain = plain_words(words) if self._pieces else np.zeros(len(words), bool)
        parts = Lists()
        own = [w for w, p in zip(words, plain) if p]
        if own:
            parts.add(*self._learn_plain(own))
        others = [w for w, p in zip(words, plain) if not p]
        parts.add(*_listed([self._whole(w.decode()) for w in others]))
        # Plain words come first among the parts.
        place = np.where(plain, np.cumsum(plain) - 1, len(own) + np.cumsum(~plain) - 1)
        ids, ends = parts.take(place)
        self._ids.add(np.diff(ends, prepend=0), ids)
        words.clear()

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if len(self._number) > self._limit:
            self._forget_words()
        split = [t.split() for t in texts]
        total = sum(map(len, split))
        at = np.fromiter(map(self._number.__getitem__, chain.from_iterable(split)), np.int64, total)
        if self._number.new:
            self._learn()
        ids, ends = self._ids.take(at)
        ends = np.append(0, ends)[np.cumsum([len(words) for words in split], dtype=np.int64)]
        yield from np.split(ids, ends[:-1])


def _listed(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([len(x) for x in found], np.int64), np.fromiter(chain.from_iterable(found), np.uint32)


def cut_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
    ids: bool = False,
) -> DataFrame:
    """Pieces of every document's ids, with the ids themselves when ``ids`` is set."""
    schema = PIECES + (", ids array<bigint>" if ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        for batch in batches:
            texts = Texts.of(batch.column("text"))
            parts = np.unique(np.searchsorted(texts.offsets, np.arange(0, texts.offsets[-1] + 1, PART_BYTES)))
            parts = np.unique(np.concatenate([[0], parts, [len(texts)]]))
            names = batch.column("doc_id").to_pylist()
            for a, b in zip(parts[:-1], parts[1:]):
                rows = []
                for i, found in enumerate(encoder.encode([texts.text(i) for i in range(a, b)]), a):
                    whole = np.append(found, np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(whole), capacity)):
                        part = whole[start : start + capacity]
                        row = (names[i], piece, start, len(part), zlib.crc32(part.tobytes()))
                        rows.append(row + ((part.astype(np.int64),) if ids else ()))
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                kinds += [pa.list_(pa.int64())] * ids
                yield pa.record_batch(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(kinds)],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(released(cut), schema)


def _fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """Multiset of available lengths with the largest sum up to ``room``."""
    bits, steps, mask, target = 1, [], (1 << (room + 1)) - 1, 1 << room
    for length in lengths:  # descending
        if length > room:
            continue
        left, size = min(counts[length], room // length), 1
        while left:  # 1, 2, 4, ... copies at a time
            take = min(size, left)
            steps.append((length, take, bits))
            bits |= (bits << (length * take)) & mask
            left, size = left - take, size * 2
        if bits & target:
            break
    total, used = bits.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            used[length] = used.get(length, 0) + take
    return used


def minimum_bin_slack(
    histogram: dict[int, int], capacity: int = CAPACITY
) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: copies}) for all sequences; each is as full as it can be."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    plan = []
    while counts:
        lengths = sorted(counts, reverse=True)
        seed = lengths[0]
        counts[seed] -= 1
        used = _fullest([n for n in lengths if counts[n]], counts, capacity - seed)
        counts[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        times = min(counts[n] // c for n, c in used.items())
        for n, c in used.items():
            counts[n] -= c * times
            if not counts[n]:
                del counts[n]
        plan.append((times, used))
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; every piece is placed once."""
    histogram = {
        r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()
    }  # at most ``capacity`` rows
    slots, taken, sequence = [], dict.fromkeys(histogram, 0), 0
    for times, used in minimum_bin_slack(histogram, capacity):
        offset = 0
        for length, copies in sorted(used.items(), reverse=True):
            slots.append((length, taken[length], copies, sequence, offset))
            taken[length] += copies * times
            offset += copies * length
        sequence += times
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 5)

    blocks = -(-max(histogram.values(), default=1) // RANK_ROWS)
    order = ("doc_id", "piece", "ids_crc32", "start")
    # Pieces are a stored table; its row numbers tell pieces of one id apart.
    blocked = pieces.withColumn(
        "_block",
        F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"),
    )
    before = W.partitionBy("length").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        blocked.groupBy("length", "_block")
        .agg(F.count("*").alias("_n"))
        .select("length", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    rank = F.row_number().over(W.partitionBy("length", "_block").orderBy(*order)) - 1
    ranked = (
        blocked.withColumn("_rank", rank)
        .join(offsets, ["length", "_block"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
        .select(*pieces.columns, "_rank")
    )

    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Slots sorted by length, then by the first rank they take.
        first = np.searchsorted(table[:, 0], np.arange(capacity + 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            at = np.empty(len(rank), np.int64)
            for n in np.unique(length):
                own = length == n
                at[own] = first[n] - 1 + np.searchsorted(
                    table[first[n] : first[n + 1], 1], rank[own], side="right"
                )
            _, taken, copies, sequence, offset = table[at].T
            bin_, slot = np.divmod(rank - taken, copies)
            columns = [batch.column(c) for c in names]
            yield pa.record_batch(
                columns + [pa.array(sequence + bin_), pa.array(offset + slot * length)],
                names=[*names, "sequence_id", "offset"],
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    return pack(materialize(cut_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
