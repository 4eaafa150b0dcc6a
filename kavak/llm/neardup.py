"""Near-duplicate records by a parity-sketch join.

Each text is the set of its runs of three consecutive words, in plain form and
without regard to case and punctuation.  Two records are alike to
``|A n B| / |A u B|``.

Join.  Equal sets are one class first.  All runs have one order, the same for
every text: rare ones first, then the ``LISTED`` that most records hold, the
commonest last; every run of every record counts.  Of two texts alike to the
threshold t, each shares at least t of its runs with the other, so their first
``size - ceil(t * size) + 1`` runs in that order have a run in common (the
pigeonhole).  Records meet on these runs within the band of sizes that the
threshold leaves, narrowed by the place at which they meet; no run is dropped
however many records hold it, so no pair is lost, whatever the order.
The records of a run that very many hold are cut in pieces, and every two
pieces meet under a key of their own.

Sketch.  Each run flips one of 448 bits.  Runs found on both sides cancel, so
the Hamming distance of two sketches is at most the symmetric difference; a
pair whose distance exceeds what its sizes allow is out where it meets.  (Texts
of more than some 300 runs differ by more bits than there are; for them the
sketch filters less, the result is the same.)  The rest pass their exact sets.

Layout.  The runs are dealt out to parts by their hash.  A batch of texts sends
each part one packed row: every text once with its sketch, however many of its
runs the part holds, and five bytes a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kavak.llm.batches import by_size, mapped
from kavak.llm.plain import plain_many
from kavak.llm.words import mix, ngrams, words
from kavak.plans.lineage import written

#: A run in more records than this is joined in pieces of about so many.
COMMON = 4096
#: A run is listed as common from this many records on; the most runs listed, those beyond it count as rare.
LISTED_FROM, LISTED = 3, 200_000
#: Runs that a task counts before it sends their counts on.
COUNTED = 2_000_000
SKETCH_LONGS = 7
#: Bytes of a run's hash that are kept: two different runs agree with 2 ** -40, in which case only a candidate more is checked.
RUN_BYTES = 5
#: Bytes that a part takes in its task, of which a record needs so many; pairs looked at together.
PART_BYTES, RECORD_BYTES, AT_ONCE = 256_000_000, 1_500, 2_000_000
#: Ids up to this number (8 bytes each) are sent to the texts; more meet them by shuffle.
SENT = 1_000_000

_SIGNATURE = "id long, size int, set1 long, set2 long"
_BLOCK = "part int, ids binary, sizes binary, counts binary, sketches binary, keys binary, places binary"


def _packed(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of whole numbers, all first bytes first, so that what is 0 throughout packs to nothing."""
    return np.ascontiguousarray(values.astype("<u8", copy=False)).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1)


def _sets(texts: list[str | None], n: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which texts take part, distinct runs, text of each run)."""
    texts = [t if t is not None and len(t) >= least else None for t in plain_many(texts)]
    w = words(texts)
    g, first = ngrams(w.hashes, w.text, n)
    text = w.text[first]
    count = np.bincount(w.text, minlength=len(texts))
    # a text of fewer words has one run of all its words
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        begins = np.searchsorted(w.text, few)
        short = np.array([mix(np.array([np.bitwise_xor.reduce(mix(w.hashes[b : b + count[t]] + np.arange(count[t], dtype=np.uint64)))]))[0] for b, t in zip(begins, few)], np.uint64)
        g, text = np.concatenate((g, short)), np.concatenate((text, few))
    order = np.lexsort((g, text))
    g, text = g[order], text[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
    return np.array([t is not None for t in texts], bool), g[new], text[new]


def _xor_by(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, np.uint64), np.bitwise_xor.accumulate(values)))
    return sums[ends] ^ sums[starts]


def _sketches(g: np.ndarray, text: np.ndarray, rows: int) -> np.ndarray:
    bit = text * (64 * SKETCH_LONGS) + (mix(g ^ np.uint64(0x5DEECE66D)) % np.uint64(64 * SKETCH_LONGS)).astype(np.int64)
    flips = np.bincount(bit, minlength=rows * 64 * SKETCH_LONGS) & 1
    return np.packbits(flips.astype(np.uint8).reshape(-1, 64), axis=1, bitorder="little").reshape(-1).view(np.int64).reshape(rows, SKETCH_LONGS)


def _sign(batch: pa.RecordBatch, n: int, least: int) -> pa.RecordBatch:
    rows = batch.num_rows
    takes, g, text = _sets(batch.column(1).to_pylist(), n, least)
    size = np.bincount(text, minlength=rows)
    bounds = np.concatenate(([0], np.cumsum(size)))
    set1, set2 = _xor_by(g, bounds[:-1], bounds[1:]), _xor_by(mix(g + np.uint64(1)), bounds[:-1], bounds[1:])
    kept = np.flatnonzero(takes & (size > 0))
    columns = [batch.column(0), pa.array(size.astype(np.int32)), pa.array(set1.view(np.int64)), pa.array(set2.view(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["id", "size", "set1", "set2"]).take(pa.array(kept))


def _runs(batch: pa.RecordBatch, n: int, least: int) -> pa.RecordBatch:
    """Each text's runs, ascending, packed."""
    _, g, text = _sets(batch.column(1).to_pylist(), n, least)
    bounds = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=batch.num_rows)))).tolist()
    short = g & np.uint64((1 << 8 * RUN_BYTES) - 1)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array([_packed(short[a:b], RUN_BYTES) for a, b in zip(bounds, bounds[1:])], pa.binary())], ["id", "runs"])


def _summed(runs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct runs, ascending; the sum of each one's times)."""
    order = np.argsort(runs)
    runs = runs[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(runs)), bool), runs[1:] != runs[:-1])))
    return runs[first], np.add.reduceat(times[order], first) if len(first) else times


def _counted(n: int, least: int, parts: int):
    """A function for ``mapInArrow``: in how many texts each run stands, as one packed row for each part."""

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        runs, times = _summed(*(np.concatenate(x) for x in zip(*held)))
        part = (runs % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        there, starts = np.unique(part[order], return_index=True)
        rows = [order[a:b] for a, b in zip(starts, [*starts[1:], len(order)])]
        return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array([_packed(runs[x], RUN_BYTES) for x in rows], pa.binary()), pa.array([_packed(times[x], 4) for x in rows], pa.binary())], ["part", "runs", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in by_size(batches, "text"):
            g = _sets(batch.column(1).to_pylist(), n, least)[1]
            held.append(np.unique(g & np.uint64((1 << 8 * RUN_BYTES) - 1), return_counts=True))
            size += len(held[-1][0])
            if size >= COUNTED:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    return run


def _commonest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a whole part, the runs that enough texts hold, no more than are listed of all parts."""
    blocks = [row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in (1, 2)))]
    if not blocks:
        return
    runs, times = _summed(np.concatenate([_unpacked(x, RUN_BYTES) for x, _ in blocks]), np.concatenate([_unpacked(x, 4) for _, x in blocks]).astype(np.int64))
    enough = np.flatnonzero(times >= LISTED_FROM)
    top = enough[np.lexsort((runs[enough], -times[enough]))[:LISTED]]
    yield pa.RecordBatch.from_arrays([pa.array(runs[top].view(np.int64)), pa.array(times[top])], ["run", "n"])


def _blocks(batch: pa.RecordBatch, n: int, least: int, threshold: float, listed: np.ndarray, held: np.ndarray, parts: int) -> pa.RecordBatch:
    """The first runs of each text, those of ``listed`` (ascending) last and by ``held``, as one row for each part."""
    _, g, text = _sets(batch.column(1).to_pylist(), n, least)
    often = np.zeros(len(g), np.int64)
    if len(listed):
        short = g & np.uint64((1 << 8 * RUN_BYTES) - 1)
        at = np.minimum(np.searchsorted(listed, short), len(listed) - 1)
        often = np.where(listed[at] == short, held[at], 0)
    rows, ids = batch.num_rows, batch.column(0).to_numpy().view(np.uint64)
    order = np.argsort(text.astype(np.int64) << 40 | often, kind="stable")
    g, often = g[order], often[order]
    size = np.bincount(text, minlength=rows)
    sketch = _sketches(g, text, rows)
    place = np.arange(len(g)) - (np.cumsum(size) - size)[text]
    first = np.flatnonzero(place <= (size - np.ceil(threshold * size - 1e-9))[text])
    # a run in pieces: one row for each piece that the text's own meets
    pieces = np.maximum(1, -(-often[first] // COMMON))
    other = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first, pieces = np.repeat(first, pieces), np.repeat(pieces, pieces)
    key, text, place = g[first], text[first], place[first]
    own = (mix(ids)[text] % pieces.astype(np.uint64)).astype(np.int64)
    cell = np.minimum(own, other) * pieces + np.maximum(own, other)
    key = np.where(pieces > 1, mix(key + mix(cell.astype(np.uint64))), key)
    part = (key >> np.uint64(40)).astype(np.int64) % parts
    key &= np.uint64((1 << 8 * RUN_BYTES) - 1)
    order = np.argsort(part, kind="stable")
    key, text, place, part = key[order], text[order], place[order], part[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (part[1:] != part[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.concatenate((head, [len(text)])))
    out: list[list] = [[] for _ in range(7)]
    there = np.unique(part)
    for p, a, b in zip(there.tolist(), np.searchsorted(part, there).tolist(), np.searchsorted(part, there, "right").tolist()):
        x, y = np.searchsorted(head, (a, b))
        t = text[head[x:y]]
        for column, value in zip(out, (p, _packed(ids[t], 8), _packed(size[t], 4), _packed(count[x:y], 4), sketch[t].T.tobytes(), _packed(key[a:b], RUN_BYTES), _packed(place[a:b], 4))):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], [f.split()[0] for f in _BLOCK.split(", ")])


def _meet(threshold: float):
    """A function for ``mapInArrow`` over a whole part: the pairs (a < b) that meet on a run and may reach the threshold."""
    ratio = threshold / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(1, 7)))]
        if not blocks:
            return
        join = lambda k, width: np.concatenate([_unpacked(row[k], width) for row in blocks])
        ids, sizes = join(0, 8).view(np.int64), join(1, 4).astype(np.int64)
        record = np.repeat(np.arange(len(ids), dtype=np.int32), join(2, 4).astype(np.int64))
        sketch = np.concatenate([np.frombuffer(row[3], np.uint64).reshape(SKETCH_LONGS, -1) for row in blocks], axis=1)
        key, place = join(4, RUN_BYTES), join(5, 4).astype(np.int32)
        blocks.clear()
        # by run, then by size: the partners of a run's record are those before it from the least size on that fits
        size = np.minimum(sizes, (1 << 24) - 1)[record]
        spot = key << np.uint64(24) | size.astype(np.uint64)
        order = np.argsort(spot)
        spot, record, place, size = spot[order], record[order], place[order], size[order]
        run_of = spot >> np.uint64(24) << np.uint64(24)
        most = np.floor((size - place) / ratio - size + 1e-6).astype(np.int64)
        lo = np.searchsorted(spot, run_of | np.ceil(threshold * size - 1e-9).astype(np.uint64))
        hi = np.searchsorted(spot, run_of | np.clip(most, 0, size).astype(np.uint64), "right")
        hi = np.where(size < (1 << 24) - 1, hi, len(spot))  # sizes beyond the scale: no bound from them
        count = np.maximum(np.minimum(hi, np.arange(len(spot))) - lo, 0)
        total, at = np.cumsum(count), 0
        while at < len(count):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, "right")))
            many = count[at:to]
            b = np.repeat(np.arange(at, to), many)
            a = np.repeat(lo[at:to] - (np.cumsum(many) - many), many) + np.arange(len(b))
            at = to
            rest = np.minimum(size[a] - place[a], size[b] - place[b])
            near = np.flatnonzero(rest >= ratio * (size[a] + size[b]) - 1e-6)
            a, b = record[a[near]], record[b[near]]
            allowed = (sizes[a] + sizes[b]) * (1 - 2 * ratio) + 1e-6
            distance = np.zeros(len(a), np.int64)
            for s in sketch:
                distance += np.bitwise_count(s[a] ^ s[b])
            near = distance <= allowed
            x, y = ids[a[near]], ids[b[near]]
            pairs = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _likeness(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The shared part of the two packed sets of each pair."""
    sets = [[_unpacked(r, RUN_BYTES) for r in batch.column(k).to_pylist()] for k in (2, 3)]
    sizes = [np.fromiter(map(len, s), np.int64, batch.num_rows) for s in sets]
    pair = np.concatenate([np.repeat(np.arange(batch.num_rows, dtype=np.uint64), n) for n in sizes])
    both = np.sort(pair << np.uint64(8 * RUN_BYTES) | np.concatenate(sets[0] + sets[1]))
    again = both[1:][both[1:] == both[:-1]] >> np.uint64(8 * RUN_BYTES)
    shared = np.bincount(again.astype(np.int64), minlength=batch.num_rows)
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared / (sizes[0] + sizes[1] - shared))], ["a", "b", "likeness"])


def _common(rows: DataFrame, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(the kept bytes of runs that many records hold, ascending; how many records hold each)."""
    # a record's runs are unpacked and sorted in the counting: parts a quarter of those that meet
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() * RECORD_BYTES * 4 // PART_BYTES))
    counts = rows.mapInArrow(_counted(n, least, parts), "part int, runs binary, times binary").repartitionById(parts, "part").mapInArrow(_commonest, "run long, n long")
    top = counts.orderBy(F.desc("n"), "run").limit(LISTED).toArrow()
    runs, held = top["run"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(runs)
    return runs[order], held[order]


def alike(records: DataFrame, id: str, text: str, threshold: float, n: int = 3, least: int = 120) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes, members of classes) of records alike to at least ``threshold``.

    ``records`` may have further columns; ``id`` is a unique long.  Null texts
    and texts under ``least`` signs take no part.  The first frame has ``a``,
    ``b`` (class ids, the least record id of each, a < b) and ``likeness``; the
    second ``class_id``, ``id`` for every record that takes part.  An empty
    table gives two empty frames.
    """
    spark = records.sparkSession
    rows = records.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).filter(F.col("text").isNotNull() & F.col("id").isNotNull())
    signed = written(rows.mapInArrow(mapped("text", lambda b: _sign(b, n, least)), _SIGNATURE), "signed")
    classes = signed.groupBy("set1", "set2", "size").agg(F.min("id").alias("class_id"))
    members = signed.join(classes, ["set1", "set2", "size"]).select("class_id", "id")
    # copies give way to the first of their class; there are few, or else Spark shuffles
    copies = written(members.filter("id <> class_id").select("id"), "copies")
    listed, held = _common(rows, n, least)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-signed.count() * RECORD_BYTES // PART_BYTES))
    blocks = rows.join(copies, "id", "left_anti").mapInArrow(mapped("text", lambda b: _blocks(b, n, least, threshold, listed, held, parts)), _BLOCK)
    met = written(blocks.repartitionById(parts, "part").mapInArrow(_meet(threshold), "a long, b long").distinct(), "met")
    wanted = met.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    if wanted.count() <= SENT:
        wanted = F.broadcast(wanted)
    runs = rows.join(wanted, "id", "left_semi").mapInArrow(mapped("text", lambda b: _runs(b, n, least)), "id long, runs binary")
    pairs = met.join(runs.select(F.col("id").alias("a"), F.col("runs").alias("x")), "a").join(runs.select(F.col("id").alias("b"), F.col("runs").alias("y")), "b")
    pairs = pairs.select("a", "b", "x", "y").mapInArrow(lambda batches: map(_likeness, batches), "a long, b long, likeness double")
    return written(pairs.filter(F.col("likeness") >= threshold), "alike"), members


def all_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Every pair of records (a < b): of alike classes, and within a class."""
    m = members.select(F.col("class_id").alias("a"), F.col("id").alias("x"))
    o = members.select(F.col("class_id").alias("b"), F.col("id").alias("y"))
    across = pairs.select("a", "b").join(m, "a").join(o, "b").select("x", "y")
    within = m.join(o, F.col("a") == F.col("b")).filter(F.col("x") < F.col("y")).select("x", "y")
    return across.union(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def links(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``(id, class_id, members, links)`` of each record: the records of its class, and the other classes alike to it."""
    both = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    sizes = members.groupBy("class_id").agg(F.count("*").alias("members")).join(both, "class_id", "left")
    return members.join(sizes, "class_id").select("id", "class_id", "members", F.coalesce("links", F.lit(0).cast("long")).alias("links"))
