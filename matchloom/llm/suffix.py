"""Suffix-array dedup: remove bytes of stretches that an earlier document holds.

A byte goes when it lies in a ``width``-byte string that also starts in a document with a
smaller id. Sorting all suffixes of a corpus would move every byte many times, so the sort
is cut into independent parts that never separate equal strings:

* Every ``width``-byte string is assigned to the smallest hash of its ``ANCHOR``-byte
  parts. Equal strings have equal anchors; consecutive strings with one anchor form a
  stretch. Anchors that only one document holds need no sort.
* Batches of documents agree, through Spark, on the first document of every distinct
  stretch. Each distinct stretch enters the sort once, with that document.
* Stretches with one anchor meet in one task. Their suffixes are sorted by a mergesort
  that compares by hashes: prefix polynomial hashes and a binary search find the common
  extension, the next byte decides. Neighbours that share ``width`` bytes are verified
  byte by byte; the smallest document of such a run is its strings' first document.

Anchors held by very many batches are replaced by the strings themselves, so that no
group grows with the corpus. Strings are judged on the input. What the sort compares is
verified byte by byte. Whole stretches that are equal, and the strings that replace such
anchors, are decided without a sort by two hashes of different kinds, that of the anchor
(its bucket and 32 bits) and a 64-bit polynomial one of all bytes.

Defined cases: a null text is empty; texts shorter than ``width`` lose nothing; documents
of equal id never remove each other's bytes; a null id counts as the largest; an empty
table gives an empty one; other columns pass through inside ``doc``.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm.exchange import SENT, Layout, batched, batches_holding
from matchloom.llm.flat import Texts, mix, powers, prefix_hashes, stretch_hashes, BASE

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 50
ANCHOR = 20
# Anchors that this many batches hold are split up.
HOT_BATCHES = 255
# Suffixes compared at a time.
SLICE = 100_000
LARGEST = np.iinfo(np.int64).max
NOTES = "batch int, kind int, bucket int, payload binary"


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``ANCHOR`` bytes from every place on."""
    n = len(data) - ANCHOR + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = np.ndarray(len(data) - 7, np.uint64, data.tobytes(), 0, (1,)).copy()
    h = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= eight[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h ^= eight[12 : 12 + n] * np.uint64(0x165667B19E3779F9)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Stretches:
    """First and last string of every stretch, its anchor and its text's place."""

    def __init__(self, texts: Texts, width: int) -> None:
        low = anchor_hashes(texts.data)
        span, step = width - ANCHOR + 1, 1
        while 2 * step <= span and len(low) > step:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        rest = span - step
        low = np.minimum(low[: len(low) - rest], low[rest:]) if len(low) > rest else low[:0]
        sizes = np.maximum(np.diff(texts.offsets) - width + 1, 0)
        at = np.arange(int(sizes.sum())) + np.repeat(texts.offsets[:-1] - (np.cumsum(sizes) - sizes), sizes)
        low = low[at]
        new = np.ones(len(at), bool)
        new[1:] = (low[1:] != low[:-1]) | (at[1:] - at[:-1] != 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        # A minimum is small; spread it, as buckets are cut by value.
        self.low, self.high, self.anchor = at[first], at[last], mix(low[first])
        self.text = np.searchsorted(texts.offsets, self.low, "right") - 1

    def keep(self, chosen: np.ndarray) -> None:
        for name in ("low", "high", "anchor", "text"):
            setattr(self, name, getattr(self, name)[chosen])

    def split(self, chosen: np.ndarray, prefix: np.ndarray, width: int) -> None:
        """Replace the chosen stretches by their strings, each its own anchor."""
        n = np.where(chosen, self.high - self.low + 1, 1)
        back = np.repeat(np.cumsum(n) - n, n)
        step = np.arange(int(n.sum())) - back
        low = np.repeat(self.low, n) + step
        single = np.repeat(chosen, n)
        high = np.where(single, low, np.repeat(self.high, n))
        anchor = np.repeat(self.anchor, n)
        # The anchor's own hash stays part of the string's.
        whole = stretch_hashes(prefix, low[single], low[single] + width)
        anchor[single] = mix(whole + mix(anchor[single]))
        self.low, self.high, self.anchor, self.text = low, high, anchor, np.repeat(self.text, n)


def suffix_sort(data: np.ndarray, start: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """Order of the suffixes at ``start``, by group and then by their first ``width`` bytes.

    Groups and the first eight bytes are sorted at once; within what they leave equal,
    runs of 1, 2, 4, ... suffixes are merged for all groups together: every suffix
    finds its place in the neighbouring run by binary search.
    """
    eight = np.ndarray(max(0, len(data) - 7), np.uint64, data.tobytes(), 0, (1,)).byteswap()
    head = eight[start]
    order = np.lexsort((head, group))
    new = np.ones(len(order), bool)
    new[1:] = (group[order][1:] != group[order][:-1]) | (head[order][1:] != head[order][:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(order)))
    prefix = prefix_hashes(data.astype(np.uint64) + np.uint64(1))
    power = powers(BASE, len(data) + 1)

    def before(i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Is the suffix at i smaller than that at j (or equal to it, where asked)?"""
        common, over = np.zeros(len(i), np.int64), np.full(len(i), width + 1)
        while (over - common).max(initial=0) > 1:
            middle = (common + over) // 2
            same = (prefix[i + middle] - prefix[i]) * power[j] == (prefix[j + middle] - prefix[j]) * power[i]
            common, over = np.where(same, middle, common), np.where(same, over, middle)
        equal = common >= width
        at = np.minimum(common, width - 1)
        return np.where(equal, or_equal, data[i + at] < data[j + at])

    open_ = np.flatnonzero(size > 1)
    run = 1
    while len(open_):
        n = size[open_]
        base = np.repeat(begin[open_], n)
        stop = np.repeat(begin[open_] + n, n)
        rank = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        own = rank // run
        low = np.minimum(base + (own ^ 1) * run, stop)
        other = low.copy()
        high = np.minimum(low + run, stop)
        item = order[base + rank]
        right = (own & 1).astype(bool)
        waiting = np.flatnonzero(low < high)
        for at in range(0, len(waiting), SLICE):
            todo = waiting[at : at + SLICE]
            while len(todo):
                middle = (low[todo] + high[todo]) // 2
                goes_before = before(start[order[middle]], start[item[todo]], right[todo])
                low[todo] = np.where(goes_before, middle + 1, low[todo])
                high[todo] = np.where(goes_before, high[todo], middle)
                todo = todo[low[todo] < high[todo]]
        place = base + (own >> 1) * 2 * run + rank % run + (low - other)
        order[place] = item
        run *= 2
        open_ = open_[size[open_] > run]
    return order


def first_holders(
    data: np.ndarray, start: np.ndarray, group: np.ndarray, holder: np.ndarray, width: int
) -> np.ndarray:
    """Smallest holder of each suffix's first ``width`` bytes within its group."""
    order = suffix_sort(data, start, group, width)
    at = start[order]
    view = np.lib.stride_tricks.sliding_window_view(data, width)
    new = np.ones(len(order), bool)
    same_group = group[order][1:] == group[order][:-1]
    for a in range(1, len(order), 100_000):  # equal neighbours, verified byte by byte
        b = min(len(order), a + 100_000)
        same = (view[at[a:b]] == view[at[a - 1 : b - 1]]).all(1)
        new[a:b] = ~(same & same_group[a - 1 : b - 1])
    begin = np.flatnonzero(new)
    if not len(begin):
        return holder
    first = np.minimum.reduceat(holder[order], begin)
    out = np.empty_like(holder)
    out[order] = np.repeat(first, np.diff(np.append(begin, len(order))))
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(a) for a in arrays], np.int64)
    return b"".join([sizes.tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]])


def _unpack(payload: bytes, *kinds) -> list[np.ndarray]:
    sizes, out, at = np.frombuffer(payload, np.int64, len(kinds)), [], 8 * len(kinds)
    for n, kind in zip(sizes, kinds):
        out.append(np.frombuffer(payload, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _narrow(ids: np.ndarray) -> np.ndarray:
    """The bytes of ids, four each where all fit."""
    fit = not len(ids) or (ids.min() >= -(1 << 31) and ids.max() < 1 << 31)
    return np.ascontiguousarray(ids.astype(np.int32 if fit else np.int64)).view(np.uint8)


def _wide(data: np.ndarray, n: int) -> np.ndarray:
    return data.view(np.int32 if len(data) == 4 * n else np.int64).astype(np.int64)


def _pieces(batch: int, buckets, payloads) -> pa.Table:
    n = len(payloads)
    return pa.table(
        {"bucket": pa.array(buckets, pa.int32()), "batch": pa.array([batch] * n, pa.int32()),
         "payload": pa.array(payloads, pa.binary())}
    )


class _Batch:
    """What one batch of documents knows after the answers it has so far."""

    def __init__(self, table: pa.Table, layout: Layout, width: int, notes: pa.Table | None = None) -> None:
        self.texts, self.layout, self.width = Texts.of(table["text"]), layout, width
        ids = table["doc"].combine_chunks().field("doc_id")
        self.ids = ids.cast(pa.int64()).fill_null(LARGEST).to_numpy(zero_copy_only=False)
        self.runs = Stretches(self.texts, width)
        doc = self.ids[self.runs.text]
        order = np.lexsort((doc, self.runs.anchor))
        anchor, doc = self.runs.anchor[order], doc[order]
        new = np.append(True, anchor[1:] != anchor[:-1])[: len(anchor)]
        begin = np.flatnonzero(new)
        self.anchors = anchor[begin]
        self.local = np.zeros(len(begin), bool)
        if len(begin):
            self.local = doc[begin] != doc[np.append(begin[1:], len(doc)) - 1]
        if notes is None:
            return
        self.kinds = {
            k: notes.filter(pa.compute.equal(notes["kind"], k)) for k in (0, 1, 2)
        }
        holders = layout.receive(self.kinds[0], self.anchors, bits=False)
        shared, hot = self.local | (holders > 1), holders >= HOT_BATCHES
        place = np.searchsorted(self.anchors, self.runs.anchor)
        hot = hot[place][shared[place]]
        self.runs.keep(shared[place])
        self.prefix = prefix_hashes(self.texts.data.astype(np.uint64) + np.uint64(1))
        self.runs.split(hot, self.prefix, width)
        runs = self.runs
        self.key = mix(
            stretch_hashes(self.prefix, runs.low, runs.high + width)
            + (runs.high - runs.low).astype(np.uint64)
        )
        # Distinct stretches in the order of their anchors, each with its first document here.
        order = np.lexsort((self.ids[runs.text], self.key, runs.anchor))
        anchor, key = runs.anchor[order], self.key[order]
        new = np.ones(len(order), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (key[1:] != key[:-1])
        self.sample = order[new]
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.cuts = layout.cuts(runs.anchor[self.sample])

    def send_stretches(self, batch: int) -> pa.Table:
        runs, sample = self.runs, self.sample
        full = np.flatnonzero(np.diff(self.cuts))
        places = self.layout.places(runs.anchor[sample], self.cuts)
        parts = [slice(self.cuts[b], self.cuts[b + 1]) for b in full]
        return _pieces(batch, full, [
            _pack(self.key[sample[p]], places[p], _narrow(self.ids[runs.text[sample[p]]])) for p in parts
        ])

    def hear_stretches(self) -> None:
        """First document of every distinct stretch, and which of ours enter the sort."""
        self.first = np.zeros(len(self.sample), np.int64)
        contested = np.zeros(len(self.sample), bool)
        for bucket, payload in zip(*(self.kinds[1][c].to_pylist() for c in ("bucket", "payload"))):
            a, b = self.cuts[bucket], self.cuts[bucket + 1]
            several, first = _unpack(payload, np.uint8, np.uint8)
            self.first[a:b] = _wide(first, b - a)
            contested[a:b] = np.unpackbits(several, count=b - a)
        self.enters = contested & (self.ids[self.runs.text[self.sample]] == self.first)

    def entering(self):
        """(bucket, samples) of the distinct stretches that enter the sort."""
        for b in np.flatnonzero(np.diff(self.cuts)):
            own = np.arange(self.cuts[b], self.cuts[b + 1])
            own = own[self.enters[own]]
            if len(own):
                yield int(b), own

    def send_bytes(self, batch: int) -> pa.Table:
        buckets, payloads, data = [], [], self.texts.data
        for bucket, own in self.entering():
            s = self.sample[own]
            low, high = self.runs.low[s], self.runs.high[s] + self.width
            size = high - low
            at = np.arange(int(size.sum())) + np.repeat(low - (np.cumsum(size) - size), size)
            buckets.append(bucket)
            payloads.append(_pack(self.runs.anchor[s], self.ids[self.runs.text[s]], size, data[at]))
        return _pieces(batch, buckets, payloads)

    def removed(self) -> np.ndarray:
        """Which bytes go."""
        runs, width = self.runs, self.width
        n = len(self.texts.data)
        later = self.first[self.entry] < self.ids[runs.text]
        change = np.bincount(runs.low[later], minlength=n + 1)[: n + 1]
        change -= np.bincount(runs.high[later] + width, minlength=n + 1)
        answers = dict(zip(*(self.kinds[2][c].to_pylist() for c in ("bucket", "payload"))))
        held = [np.zeros(0, np.int64)]
        known = np.full(len(self.sample), -1)
        bits, total = [np.zeros(0, bool)], 0
        for bucket, own in self.entering():
            s = self.sample[own]
            size = runs.high[s] - runs.low[s] + 1
            bits.append(np.unpackbits(np.frombuffer(answers[bucket], np.uint8), count=int(size.sum())).astype(bool))
            known[own] = total + np.cumsum(size) - size
            total += int(size.sum())
        bits = np.concatenate(bits)
        # Strings of our first stretches, wherever they stand in documents of that id.
        mine = np.flatnonzero(~later & (known[self.entry] >= 0))
        size = runs.high[mine] - runs.low[mine] + 1
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        hit = bits[np.repeat(known[self.entry[mine]], size) + step]
        held = (np.repeat(runs.low[mine], size) + step)[hit]
        change += np.bincount(held, minlength=n + 1)
        change -= np.bincount(held + width, minlength=n + 1)
        return np.cumsum(change[:n]) > 0


def _judge_stretches(table: pa.Table) -> pa.Table:
    """For every stretch sent: its first document, and whether its anchor has others.

    Anchors that share a place count as one; then more stretches than need be are sorted.
    """
    parts = [_unpack(p, np.uint64, np.uint32, np.uint8) for p in table["payload"].to_pylist()]
    parts = [(place, key, _wide(doc, len(key))) for key, place, doc in parts]
    anchor, key, doc = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((doc, key, anchor))
    a, k = anchor[order], key[order]
    new_anchor = np.append(True, a[1:] != a[:-1])
    new = new_anchor | np.append(True, k[1:] != k[:-1])
    begin = np.flatnonzero(new)
    first = doc[order][begin][np.cumsum(new) - 1]
    kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_anchor))
    several = (kinds > 1)[np.cumsum(new_anchor) - 1]
    first_of, several_of = np.empty_like(first), np.empty(len(order), bool)
    first_of[order], several_of[order] = first, several
    ends = np.cumsum([len(p[0]) for p in parts])
    replies = [
        _pack(np.packbits(several_of[e - len(p[0]) : e]), _narrow(first_of[e - len(p[0]) : e]))
        for e, p in zip(ends, parts)
    ]
    return pa.table({"bucket": table["bucket"], "batch": table["batch"], "payload": pa.array(replies, pa.binary())})


def _judge_strings(table: pa.Table, width: int) -> pa.Table:
    """For every string of the stretches sent, one bit: does a smaller document hold it?"""
    parts = [_unpack(p, np.uint64, np.int64, np.int64, np.uint8) for p in table["payload"].to_pylist()]
    anchor, doc, size, data = (np.concatenate(x) for x in zip(*parts))
    strings = size - width + 1
    begin = np.cumsum(size) - size
    start = np.arange(int(strings.sum())) + np.repeat(begin - (np.cumsum(strings) - strings), strings)
    holder = np.repeat(doc, strings)
    smaller = first_holders(data, start, np.repeat(anchor, strings), holder, width) < holder
    replies, at = [], 0
    for part in parts:
        n = int((part[2] - width + 1).sum())
        replies.append(np.packbits(smaller[at : at + n]).tobytes())
        at += n
    return pa.table({"bucket": table["bucket"], "batch": table["batch"], "payload": pa.array(replies, pa.binary())})


def remove_seen(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Columns ``doc`` (all but the text), ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``.

    ``kept`` is binary, as what is left of a text need not be UTF-8. ``width`` is at
    least the anchor's length. One row per input row.
    """
    if width < ANCHOR:
        raise ValueError(f"width must be at least {ANCHOR}")
    # Buckets are small, as a task sorts many suffixes for each hash it gets.
    layout = Layout.of(docs, bytes_per_hash=4.0)
    batches = batched(docs, layout)
    grouped = batches.groupBy("batch")

    def number(table: pa.Table) -> int:
        return table["batch"][0].as_py()

    def send_anchors(table: pa.Table) -> pa.Table:
        return layout.send(number(table), _Batch(table, layout, width).anchors)

    def send_stretches(table: pa.Table, notes: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _pieces(0, [], [])
        return _Batch(table, layout, width, notes).send_stretches(number(table))

    def send_bytes(table: pa.Table, notes: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _pieces(0, [], [])
        batch = _Batch(table, layout, width, notes)
        batch.hear_stretches()
        return batch.send_bytes(number(table))

    schema = T.StructType(
        [batches.schema["doc"]]
        + [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
        + [T.StructField("kept", T.BinaryType())]
    )

    def remove(table: pa.Table, notes: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"doc": table["doc"]} | {
                n: pa.array([], pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")
            } | {"kept": pa.array([], pa.binary())})
        batch = _Batch(table, layout, width, notes)
        batch.hear_stretches()
        gone, offsets = batch.removed(), batch.texts.offsets
        before = np.append(0, np.cumsum(gone))
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        starts = np.minimum(offsets[:-1], max(0, len(gone) - 1))
        if len(gone):  # a span never crosses into the next document
            begins[starts] |= gone[starts] & (offsets[:-1] < offsets[1:])
        spans = np.append(0, np.cumsum(begins))
        left = batch.texts.data[~gone].tobytes()
        ends = offsets - before[offsets]
        return pa.table(
            {
                "doc": table["doc"],
                "n_bytes": np.diff(offsets),
                "n_removed": before[offsets[1:]] - before[offsets[:-1]],
                "n_spans": spans[offsets[1:]] - spans[offsets[:-1]],
                "kept": pa.array([left[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
            }
        )

    def heard(replies: DataFrame, kind: int) -> DataFrame:
        return replies.select("batch", F.lit(kind).alias("kind"), "bucket", "payload")

    notes = heard(batches_holding(grouped.applyInArrow(send_anchors, SENT)), 0)
    sent = grouped.cogroup(notes.groupBy("batch")).applyInArrow(send_stretches, SENT)
    notes = notes.union(heard(sent.groupBy("bucket").applyInArrow(_judge_stretches, SENT), 1))
    sent = grouped.cogroup(notes.groupBy("batch")).applyInArrow(send_bytes, SENT)
    judge = lambda table: _judge_strings(table, width)
    notes = notes.union(heard(sent.groupBy("bucket").applyInArrow(judge, SENT), 2))
    return grouped.cogroup(notes.groupBy("batch")).applyInArrow(remove, schema)


def removal_digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, counts and the SHA-256 of the bytes that are kept."""
    return remove_seen(docs.select("doc_id", "text"), width).select(
        "doc.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
