"""Substring dedup: remove words inside windows that occur more than once.

Every window of ``width`` consecutive words gets a Rabin-Karp hash. Batches of documents
count their own windows and ask each other, through Spark, which recur elsewhere: first
by a part of the hash, then, for those found, by the whole.
Repeated windows merge into maximal intervals, which are removed. Windows are judged on
the input. Hashes have 64 bits: among n windows some pair collides with a chance of
about n * n / 2**65 (five in ten thousand for 10**8 windows).

Defined cases: a null text has no words; a text shorter than a window loses nothing;
repeated rows repeat all their windows; texts of any length are whole in one batch; an
empty table gives an empty one; other columns pass through inside ``doc``.
"""

from __future__ import annotations

import sys
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from matchloom.llm.exchange import SENT, Layout, batched, in_other_batches
from matchloom.llm.flat import Texts, Words, covered, released_group, released_pair

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 35


def remove_repeats(docs: DataFrame, width: int = WIDTH, as_is: bool = False) -> DataFrame:
    """Columns ``doc`` (all but the text), ``n_words``, ``n_removed`` and ``kept``.

    ``kept`` joins the kept words by one space; with ``as_is``, texts that lose nothing
    keep their own white space. One row per input row.
    """
    layout = Layout.of(docs)
    batches = batched(docs, layout)

    def windows(table: pa.Table):
        texts = Texts.of(table["text"])
        words = Words.of(texts)
        at, hashes = words.windows(width)
        distinct, counts = np.unique(hashes, return_counts=True)
        return texts, words, at, hashes, distinct, counts

    def send(table: pa.Table) -> pa.Table:
        return layout.send(table["batch"][0].as_py(), windows(table)[4])

    def found(distinct: np.ndarray, notes: pa.Table, turn: int) -> np.ndarray:
        answers = notes.filter(pa.compute.equal(notes["turn"], turn))
        return layout.receive(answers, distinct)

    def send_found(table: pa.Table, notes: pa.Table) -> pa.Table:
        if not table.num_rows:
            return layout.send(0, np.zeros(0, np.uint64))
        distinct = windows(table)[4]
        return layout.send(table["batch"][0].as_py(), distinct[found(distinct, notes, 1)], whole=True)

    def remove(table: pa.Table, notes: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in arrow})
        texts, words, at, hashes, distinct, counts = windows(table)
        elsewhere = found(distinct, notes, 1)
        elsewhere[elsewhere] = found(distinct[elsewhere], notes, 2)
        repeated = (counts > 1) | elsewhere
        starts = at[repeated[np.searchsorted(distinct, hashes)]]
        gone = covered(starts, width, len(words.start))
        before = np.concatenate([[0], np.cumsum(gone)])
        n_removed = before[words.first[1:]] - before[words.first[:-1]]
        kept = []
        for i, n in enumerate(n_removed):
            text = texts.text(i)
            own = text.split()
            if n:
                own = compress(own, ~gone[words.first[i] : words.first[i + 1]])
            kept.append(text if as_is and not n else b" ".join(own))
        return pa.table(
            {
                "doc": table["doc"],
                "n_words": pa.array(np.diff(words.first), pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "kept": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    schema = T.StructType(
        [batches.schema["doc"]]
        + [T.StructField(n, T.LongType()) for n in ("n_words", "n_removed")]
        + [T.StructField("kept", T.StringType())]
    )
    arrow = to_arrow_schema(schema)
    grouped = batches.groupBy("batch")

    def heard(replies: DataFrame, turn: int) -> DataFrame:
        return replies.select("batch", F.lit(turn).alias("turn"), "bucket", "payload")

    notes = heard(in_other_batches(grouped.applyInArrow(released_group(send), SENT)), 1)
    sent = grouped.cogroup(notes.groupBy("batch")).applyInArrow(released_pair(send_found), SENT)
    notes = notes.union(heard(in_other_batches(sent, whole=True), 2))
    return grouped.cogroup(notes.groupBy("batch")).applyInArrow(released_pair(remove), schema)


def removal_digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of what is kept."""
    return remove_repeats(docs.select("doc_id", "text"), width).select(
        "doc.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )
