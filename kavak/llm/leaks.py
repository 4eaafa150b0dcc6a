"""Evaluation items found, wholly or in part, inside the documents of a corpus.

A document holds part of an item if they share a run of ``run`` (10) words.
The search is MinHash containment between sets of one size.  A *passage* is a
run of ten words, taken as the set of its six five-word shingles.  Whole items
and whole documents differ in size without bound, and a ten-word run is a small
share of either, so both are partitioned into passages, the one size class in
which containment of the item's passage in the document's is equality; there a
single MinHash value (the least of the six shingle hashes) never misses.  A
document keeps one value for each change of the sliding minimum, so its sketch
grows with its length and a long text isn't diluted.

Passages whose MinHash meets are verified by their exact ten-word shingle, word
by word.  What comes out is the containment of each item in each document: its
passages found there, of all its passages.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kavak.llm.batches import mapped
from kavak.llm.plain import plain_many
from kavak.llm.words import mix, ngrams, words
from kavak.plans.lineage import written

_NBSP = re.compile("&nbsp;", re.IGNORECASE)
RUN = 10
SHINGLE = 5
#: Passages of items up to this number (some 100 bytes each) are sent to all workers; more are joined by shuffle.
SENT = 200_000
#: Bits of the filter that keeps passages no item has from the shuffle; two of them a passage.
FILTER_BITS = 1 << 25


def _clean(texts: list[str | None]) -> list[str | None]:
    """Plain form; the entity of the no-break space is a space."""
    return plain_many([_NBSP.sub(" ", t) if t and "&" in t else t for t in texts])


def _passages(texts: list[str | None], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(MinHash of each passage, its exact hash, its text, its first word, the hashes of all words)."""
    w = words(_clean(texts))
    exact, first = ngrams(w.hashes, w.text, run)
    if not len(exact):
        return np.zeros(0, np.uint64), exact, np.zeros(0, np.int64), first, w.hashes
    shingle = min(SHINGLE, run)
    # shingles are taken across texts too: a passage lies in one text, so its shingles do
    total = np.zeros(len(w.hashes) - shingle + 1, np.uint64)
    for k in range(shingle):
        total += w.hashes[k : k + len(total)] * np.uint64(2 * (0x2545F4914F6CDD1D * (k + 1) % 2**62) + 1)
    sets = np.lib.stride_tricks.sliding_window_view(mix(total), run - shingle + 1)
    return sets[first].min(1), exact, w.text[first], first, w.hashes


_PASSAGES = "id long, least long, exact long, words binary"


def _table(batch: pa.RecordBatch, run: int, held: np.ndarray | None = None) -> pa.RecordBatch:
    """The distinct passages of each text, with their words' hashes; of those whose MinHash passes the filter ``held`` if there is one."""
    least, exact, text, first, hashes = _passages(batch.column(1).to_pylist(), run)
    if held is not None:
        keep = np.flatnonzero(_held(held, least))
        least, exact, text, first = least[keep], exact[keep], text[keep], first[keep]
    order = np.lexsort((exact, text))
    new = np.ones(len(order), bool)
    new[1:] = (text[order][1:] != text[order][:-1]) | (exact[order][1:] != exact[order][:-1])
    keep = order[new]
    rows = hashes[first[keep][:, None] + np.arange(run)] if len(keep) else np.zeros((0, run), np.uint64)
    told = pa.Array.from_buffers(pa.binary(8 * run), len(keep), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text[keep])), pa.array(least[keep].view(np.int64)), pa.array(exact[keep].view(np.int64)), told], ["id", "least", "exact", "words"])


def _held(bits: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether each MinHash may be one of those that the filter was made of; never false for one that is."""
    out = np.ones(len(least), bool)
    for shift in (0, 32):
        spot = (least >> np.uint64(shift)) % np.uint64(FILTER_BITS)
        out &= (bits[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def _filter_bits(passages: DataFrame) -> np.ndarray:
    """The filter of the items' MinHashes, each task's part merged on the driver; its size is fixed."""

    def part(batches):
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            least = batch.column(0).to_numpy().view(np.uint64)
            for shift in (0, 32):
                bits[((least >> np.uint64(shift)) % np.uint64(FILTER_BITS)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["bits"])

    few = passages.select("least").coalesce(8)  # as many parts are merged at most
    merged = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in few.mapInArrow(part, "bits binary").toLocalIterator():
        merged |= np.frombuffer(row["bits"], np.uint8)
    return merged


def _found_sent(documents: DataFrame, passages: pa.Table, run: int) -> DataFrame:
    """Documents against passages that every worker holds."""
    spark = documents.sparkSession
    least = passages["least"].to_numpy().view(np.uint64)
    exact = passages["exact"].to_numpy().view(np.uint64)
    order = np.argsort(exact, kind="stable")
    told = np.frombuffer(b"".join(passages["words"].to_pylist()), np.uint64).reshape(-1, run)
    sent = spark.sparkContext.broadcast((np.unique(least), exact[order], passages["id"].to_numpy()[order], told[order]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lows, keys, items, told = sent.value
        low, key, text, first, hashes = _passages(batch.column(1).to_pylist(), run)
        near = np.minimum(np.searchsorted(lows, low), len(lows) - 1)
        hit = np.flatnonzero(lows[near] == low)  # passages whose MinHash meets one of an item
        a, b = np.searchsorted(keys, key[hit], "left"), np.searchsorted(keys, key[hit], "right")
        many = b - a
        spot = np.repeat(a - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        at = np.repeat(hit, many)
        same = (hashes[first[at][:, None] + np.arange(run)] == told[spot]).all(1) if len(at) else np.zeros(0, bool)
        found = np.unique(np.stack((text[at][same], items[spot][same], key[at][same].view(np.int64))), axis=1)
        pairs, shared = np.unique(found[:2], axis=1, return_counts=True)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs[0].astype(np.int64))), pa.array(pairs[1].astype(np.int64)), pa.array(shared.astype(np.int64))], ["id", "item", "shared"])

    return documents.mapInArrow(mapped("text", work), "id long, item long, shared long")


def _found_joined(documents: DataFrame, passages: DataFrame, run: int) -> DataFrame:
    """Documents against any number of passages, by a shuffle of those that may be an item's."""
    bits = documents.sparkSession.sparkContext.broadcast(_filter_bits(passages))
    held = documents.mapInArrow(mapped("text", lambda b: _table(b, run, bits.value)), _PASSAGES)
    met = held.join(passages.select("least", "exact", "words", F.col("id").alias("item")), ["least", "exact", "words"])
    return met.select("id", "item", "exact").distinct().groupBy("id", "item").agg(F.count("*").alias("shared"))


def containments(documents: DataFrame, id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = RUN) -> DataFrame:
    """``(id, item_id, shared, passages, containment)`` of each document that holds a passage of an item.

    ``shared`` of the item's distinct ``passages`` stand in the document.  Rows
    as for :func:`leaks`; a document id that stands twice counts its best row.
    """
    pieces = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).filter(F.col("id").isNotNull())
    passages = written(pieces.mapInArrow(mapped("text", lambda b: _table(b, run)), _PASSAGES).distinct(), "passages")
    rows = documents.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    many = passages.count()
    if many == 0:
        found = rows.select("id", F.col("id").alias("item"), F.lit(0).cast("long").alias("shared")).limit(0)
    elif many <= SENT:
        found = _found_sent(rows, passages.toArrow(), run)
    else:
        found = _found_joined(rows, passages, run)
    sizes = passages.groupBy(F.col("id").alias("item")).agg(F.count("*").alias("passages"))
    best = found.groupBy("id", "item").agg(F.max("shared").alias("shared"))
    return best.join(sizes, "item").select(F.col("id").alias(id), F.col("item").alias(item_id), "shared", "passages", (F.col("shared") / F.col("passages")).alias("containment"))


def leaks(documents: DataFrame, id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = RUN) -> DataFrame:
    """``(id, item_id)``: the document holds at least ``run`` consecutive words of the item.

    One row for each document and item, however often the passage stands.  Null
    and empty texts, and texts of fewer words, hold nothing; an empty table on
    either side gives no rows.  Ids are longs.
    """
    return containments(documents, id, text, items, item_id, item_text, run).select(id, item_id)
