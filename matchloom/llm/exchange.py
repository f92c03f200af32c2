"""Batches of documents that ask each other which of their hashes recur.

Every batch sends its distinct 64-bit hashes, cut by value into buckets, and gets one bit
per hash back: whether another batch sent it too. A hash crosses the network once per
batch that holds it, however many rows do, and the answer is an eighth of a byte.

Hashes travel as four bytes, their rounded place inside the bucket. Unequal hashes that
share a place count as equal, so an answer may be too high but never too low: what recurs
is always found. Where that must be exact, the hashes found are sent again as a whole.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.flat import released_group

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SENT = "bucket int, batch int, payload binary"
MB = 1 << 20


@dataclass(frozen=True)
class Layout:
    """How many batches of documents and buckets of hashes an input is cut into."""

    batches: int
    buckets: int

    @classmethod
    def of(cls, docs: DataFrame, bytes_per_hash: float = 6.0) -> Layout:
        """Sizes that grow with the root of the input, from 1 MB of text and 1M hashes up
        to 16 times that, so that neither tasks nor the pieces between them get too many.
        """
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        scale = min(16.0, max(1.0, (total / (1 << 30)) ** 0.5))
        return cls(
            int(total / (MB * scale)) + 1,
            max(64, int(total / bytes_per_hash / (MB * scale)) + 1),
        )

    def edges(self) -> np.ndarray:
        return np.arange(1, self.buckets, dtype=np.uint64) * np.uint64((1 << 64) // self.buckets)

    def cuts(self, ordered: np.ndarray) -> np.ndarray:
        """Where the buckets begin in ascending hashes, with the end."""
        inner = np.searchsorted(ordered, self.edges())
        return np.concatenate([[0], inner, [len(ordered)]])

    def places(self, ordered: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Where in its bucket each hash lies, in 32 bits."""
        width = (1 << 64) // self.buckets
        shift = max(0, (width - 1).bit_length() - 32)
        begin = np.repeat(np.arange(self.buckets, dtype=np.uint64) * np.uint64(width), np.diff(cuts))
        place = (ordered - begin) >> np.uint64(shift)
        return np.minimum(place, np.uint64((1 << 32) - 1)).astype(np.uint32)

    def send(self, batch: int, ordered: np.ndarray, whole: bool = False) -> pa.Table:
        """One piece per bucket that any of the ascending, distinct hashes fall in."""
        cuts = self.cuts(ordered)
        full = np.flatnonzero(np.diff(cuts))
        if not whole:
            ordered = self.places(ordered, cuts)
        return pa.table(
            {
                "bucket": pa.array(full, pa.int32()),
                "batch": pa.array(np.full(len(full), batch), pa.int32()),
                "payload": pa.array([ordered[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary()),
            }
        )

    def receive(self, replies: pa.Table, ordered: np.ndarray, bits: bool = True) -> np.ndarray:
        """The bits or bytes that came back, in the order of the hashes sent."""
        cuts, out = self.cuts(ordered), np.zeros(len(ordered), np.uint8)
        for bucket, payload in zip(replies["bucket"].to_pylist(), replies["payload"].to_pylist()):
            a, b, found = cuts[bucket], cuts[bucket + 1], np.frombuffer(payload, np.uint8)
            out[a:b] = np.unpackbits(found, count=b - a) if bits else found
        return out.astype(bool) if bits else out


def batched(docs: DataFrame, layout: Layout) -> DataFrame:
    """Columns ``batch``, ``text`` and ``doc``, a struct of all other columns.

    Other columns keep their names inside the struct, so none can clash.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(layout.batches)).cast("int")
    return docs.select(key.alias("batch"), "text", F.struct(*others).alias("doc"))


def in_other_batches(sent: DataFrame, whole: bool = False) -> DataFrame:
    """For each piece sent, one bit per hash: does another batch send the same hash?"""
    kind = np.uint64 if whole else np.uint32

    def judge(table: pa.Table) -> pa.Table:
        return _reply(table, kind, lambda n: np.packbits(n > 1))

    return sent.groupBy("bucket").applyInArrow(released_group(judge), SENT)


def batches_holding(sent: DataFrame) -> DataFrame:
    """For each piece sent, one byte per hash: how many batches send it, 255 at most."""

    def judge(table: pa.Table) -> pa.Table:
        return _reply(table, np.uint32, lambda n: np.minimum(n, 255).astype(np.uint8))

    return sent.groupBy("bucket").applyInArrow(released_group(judge), SENT)


def _reply(table: pa.Table, kind: type, encode) -> pa.Table:
    pieces = [np.frombuffer(p, kind) for p in table["payload"].to_pylist()]
    ordered = np.sort(np.concatenate(pieces))
    # Where runs of an equal hash begin, of those that have more than one.
    begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    counts = np.diff(np.append(begins, len(ordered)))
    several, counts = ordered[begins[counts > 1]], counts[counts > 1]
    replies = []
    for piece in pieces:
        n = np.ones(len(piece), np.int64)
        if len(several):
            at = np.minimum(np.searchsorted(several, piece), len(several) - 1)
            n = np.where(several[at] == piece, counts[at], 1)
        replies.append(encode(n).tobytes())
    return pa.table(
        {"bucket": table["bucket"], "batch": table["batch"], "payload": pa.array(replies, pa.binary())}
    )
