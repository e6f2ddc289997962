"""Removal of repeated 100-byte strings by merging shard Burrows-Wheeler transforms.

Strings that are equal share the least hash of their 20-byte pieces, so all starts of 100-byte strings are dealt out by
that hash: a segment is a run of starts with one hash, with the bytes that their strings cover. Only hashes that occur
again matter, and equal segments are pre-aggregated to their first, so that a passage of any number of copies is one
segment. Positions travel; bytes are fetched only for the segments that remain. A hash with more bytes than one task
should hold is dealt out again by longer pieces, at last by the whole string, so no task's share grows with the corpus.

In a task, segments form shards of bounded size. Each shard's rotations are sorted once, by a bounded context, and kept
as its Burrows-Wheeler transform; the shards are merged by refining an interleave of them. Each round's new block
boundaries are common prefixes of that length, rotations alone in a block leave with theirs, and after 100 symbols a
block is a repeated interval: the starts of one 100-byte string, in all shards. All of a block but its first start in
the corpus are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import broadcast_if_small, cut, discard, small_batches
from scriptorium.llm.shingles import _LETTER, BASE, U, blocks, mix, utf8

LENGTH = 100
#: Lengths of the pieces by whose least hash strings are dealt out; the next one for hashes that are too large.
PIECES = (20, 50, 80, LENGTH)
#: Bytes of texts hashed at once; a number of arrays of eight times that size are held.
BLOCK_BYTES = 1 << 20
#: Bytes of a shard, of the segments that one task merges at once, and of a hash that is dealt out again.
SHARD_BYTES, TASK_BYTES, HEAVY_BYTES = 1 << 20, 4 << 20, 1 << 20
#: Symbols by which the rotations of a shard are sorted.
SORTED = 14
#: Bits of the filter of repeated hashes that goes to all tasks: 16 MB however large the corpus; more segments pass a full one.
FILTER_BITS = 27


def _sliding(values: np.ndarray, window: int, least: bool) -> np.ndarray:
    """Least (or largest) value of each run of `window` values."""
    pick, span = (np.minimum if least else np.maximum), 1
    while span * 2 <= window:
        values, span = pick(values[:-span], values[span:]), span * 2
    return pick(values[: len(values) - (window - span)], values[window - span :])


def piece_hashes(data: np.ndarray, piece: int) -> np.ndarray:
    """Hash of the piece that starts at each byte."""
    parts, size = {1: _LETTER[data]}, 1
    while size * 2 <= piece:
        h = parts[size]
        parts[size * 2] = h[:-size] * BASE ** U(size) + h[size:]
        size *= 2
    rolled, have = parts[size], size
    for s in sorted(parts, reverse=True)[1:]:
        if piece - have >= s:
            n = len(data) - have - s + 1
            rolled, have = rolled[:n] * BASE ** U(s) + parts[s][have : have + n], have + s
    return mix(rolled)


@dataclass
class Segments:
    """Runs of starts with one least hash: text, hash, first start in the text, number of starts, and whether the piece
    of that hash is in the text at several places. anchors: the hash of every piece that is the least of some string."""

    text: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    n: np.ndarray
    several: np.ndarray
    anchors: np.ndarray


def segments(data: np.ndarray, at: np.ndarray, piece: int = PIECES[0]) -> Segments:
    sizes = np.maximum(np.diff(at) - LENGTH + 1, 0)
    if not sizes.any():
        none = np.zeros(0, np.int64)
        return Segments(none, none.astype(np.uint64), none, none, none.astype(bool), none.astype(np.uint64))
    pieces, window = piece_hashes(data, piece), LENGTH - piece + 1
    least = _sliding(pieces, window, True)
    text = np.repeat(np.arange(len(sizes)), sizes)
    local = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if window == 1:  # every string by itself
        return Segments(text, least[at[text] + local], local, np.ones(len(text), np.int64), np.zeros(len(text), bool), least)
    inside = np.zeros(len(least), bool)
    inside[at[text] + local] = True
    # A piece is the least of some string of its text if the largest of the least hashes around it is its own.
    around = np.zeros(len(pieces) + window - 1, np.uint64)
    around[window - 1 : window - 1 + len(least)][inside] = least[inside]
    anchor = np.flatnonzero(_sliding(around, window, False) == pieces)
    owner = np.searchsorted(at, anchor, "right") - 1
    values = pieces[anchor]
    marks = values + mix(owner.astype(np.uint64) + U(1))
    seen, count = np.unique(marks, return_counts=True)
    h = least[at[text] + local]
    new = np.ones(len(text), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    of = np.searchsorted(seen, h[first] + mix(text[first].astype(np.uint64) + U(1)))
    return Segments(text[first], h[first], local[first], np.diff(np.append(first, len(text))), count[of] > 1, values)


def _parts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """First row, bytes, text beginnings and the offset of the first byte in its text. A longer text comes in parts
    that share LENGTH - 1 bytes, so that each string of LENGTH bytes lies in one part."""
    for a, b in blocks(column, BLOCK_BYTES):
        data, at = utf8(column.slice(a, b - a))
        if b - a > 1 or len(data) <= BLOCK_BYTES:
            yield a, data, at, 0
            continue
        for shift in range(0, max(len(data) - LENGTH + 1, 1), BLOCK_BYTES):
            part = data[shift : shift + BLOCK_BYTES + LENGTH - 1]
            yield a, part, np.array([0, len(part)]), shift


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, at, _ in _parts(batch.column(1)):
            seen, count = np.unique(segments(data, at).anchors, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(count.astype(np.int64))], names=["h", "n"])


def _cells(h: np.ndarray) -> list[np.ndarray]:
    bits = U(FILTER_BITS)
    return [(h >> (U(64) - bits)), (mix(h) >> (U(64) - bits))]


def _kept(filter_):
    """(id, v, text) -> segments whose hash passes the filter, as positions and a mark of their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = filter_.value
        for batch in batches:
            for row, data, at, shift in _parts(batch.column(2)):
                s = segments(data, at)
                ok = np.ones(len(s.hashes), bool)
                for cell in _cells(s.hashes):
                    ok &= (bitmap[(cell >> U(6)).astype(np.int64)] >> (cell & U(63))) & U(1) == 1
                text, h, start, n, several = s.text[ok], s.hashes[ok], s.start[ok], s.n[ok], s.several[ok]
                keys = pa.array(row + text)
                marks = _marks(data.tobytes(), at[text] + start, n)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), marks, batch.column(0).take(keys), batch.column(1).take(keys), pa.array(shift + start, pa.int64()), pa.array(n, pa.int64()), pa.array(several)], names=POSITION_NAMES)

    return run


def _marks(data: bytes, begin: np.ndarray, n: np.ndarray) -> pa.Array:
    """Hash of each segment's bytes; with the least hash beside it, 128 bits tell segments apart."""
    digest, view = xxhash.xxh3_64_intdigest, memoryview(data)
    return pa.array(np.fromiter((digest(view[x:y]) for x, y in zip(begin.tolist(), (begin + n + (LENGTH - 1)).tolist())), np.uint64, len(n)).view(np.int64))


POSITION = "h long, mark long, id long, v long, start long, n long, several boolean"
POSITION_NAMES = ["h", "mark", "id", "v", "start", "n", "several"]


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, v, text, parts) -> the parts with their bytes."""
    for batch in batches:
        for a, b in blocks(batch.column(2), BLOCK_BYTES):
            data, at = utf8(batch.column(2).slice(a, b - a))
            lists = batch.column(3).slice(a, b - a)
            parts, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
            begin = at[owner] + parts.field("start").to_numpy()
            stop = begin + parts.field("n").to_numpy() + (LENGTH - 1)
            whole, keys = data.tobytes(), pa.array(a + owner)
            body = [whole[x:y] for x, y in zip(begin.tolist(), stop.tolist())]
            yield pa.RecordBatch.from_arrays([parts.field("h"), batch.column(0).take(keys), batch.column(1).take(keys), parts.field("start"), parts.field("n"), parts.field("several"), pa.array(body, pa.binary())], names=[*POSITION_NAMES[:1], *POSITION_NAMES[2:], "bytes"])


def _split(piece: int):
    """Segments with bytes -> their parts by the least hash of longer pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bytes_ = batch.column(6)
            for a, b in blocks(bytes_, BLOCK_BYTES):
                data, at = utf8(bytes_.slice(a, b - a))
                s, whole = segments(data, at, piece), data.tobytes()
                begin = at[s.text] + s.start
                body = [whole[x:y] for x, y in zip(begin.tolist(), (begin + s.n + (LENGTH - 1)).tolist())]
                keys = pa.array(a + s.text)
                start = batch.column(3).take(keys).to_numpy() + s.start
                yield pa.RecordBatch.from_arrays([pa.array(s.hashes.view(np.int64)), _marks(whole, begin, s.n), batch.column(1).take(keys), batch.column(2).take(keys), pa.array(start), pa.array(s.n), pa.array(s.several), pa.array(body, pa.binary())], names=[*POSITION_NAMES, "bytes"])

    return run


def transform(symbols: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Order of a circular string's rotations by their first `depth` symbols or more, and the symbol before each."""
    n, bits = len(symbols), 9
    key, span = symbols.astype(np.int64), 1
    while span < 7:
        step = min(span, 7 - span)
        key = (key << (bits * step)) | (np.roll(key, -span) >> (bits * (span - step)))
        span += step
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, key[order][1:] != key[order][:-1]))
        if span >= depth or rank[order[-1]] == n - 1:
            return order, symbols[order - 1]
        key, span = rank * n + np.roll(rank, -span), span * 2


def last_to_first(order: np.ndarray) -> np.ndarray:
    """For each rotation by rank, the rank of the rotation that starts one symbol earlier.

    Read off the order itself: rotations that are equal to the sorted depth are in no further order, so counting
    symbols could exchange them.
    """
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[order - 1]


def interleave(shards: list[np.ndarray], orders: list[np.ndarray], wanted: list[np.ndarray], depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Merge of transforms by contexts of `depth` symbols: the rotations that share theirs, and the block of each.

    A round knows the interleave of the shards' rotations by some symbols of context, in blocks of equal ones. It
    places every rotation behind the two symbols before it (a round of one comes first if `depth` is odd), stably, which
    is the interleave by two symbols more. Rotations alone in their block never share a longer context with another,
    nor do those that precede them, so they leave the interleave. `orders` are the rotations that the transforms belong
    to; `wanted` are the ranks in each shard that it starts with, `depth` symbols behind the starts in question. Ranks
    are merged ones: shard by shard, one shard's after the other's.
    """
    base = np.cumsum([0, *map(len, shards)])
    values, symbols = np.unique(np.concatenate(shards), return_inverse=True)  # UTF-8 and the end mark are under 256
    if len(values) > 256:
        raise ValueError("more than 256 symbols")
    one, earlier = symbols.astype(np.uint16), np.concatenate([last_to_first(x) + o for x, o in zip(orders, base)]).astype(np.int32)
    two, before = (one[earlier] << np.uint16(8)) | one, earlier[earlier]
    order = np.concatenate([w + o for w, o in zip(wanted, base)]).astype(np.int32)
    block = np.zeros(len(order), np.int32)
    for context, back in [(one, earlier)] * (depth % 2) + [(two, before)] * (depth // 2):
        c = context[order]
        move = np.argsort(c, kind="stable")
        c, g, order = c[move], block[move], order[move]
        new = np.ones(len(order) + 1, bool)
        new[1:-1] = (c[1:] != c[:-1]) | (g[1:] != g[:-1])
        shared = ~(new[:-1] & new[1:])  # not alone in its block
        order, block = back[order[shared]], np.cumsum(new[:-1], dtype=np.int32)[shared]
        if not len(order):
            break
    return order, block


RANGE = "id long, v long, a long, b long"


def repeats(rows: pa.Table) -> pa.RecordBatch:
    """h, id, v, start, n, several, bytes of distinct segments -> (id, v, a, b): covered by strings that also start earlier."""
    h, several = rows.column("h").to_numpy(), rows.column("several").to_numpy()
    _, of, count = np.unique(h, return_inverse=True, return_counts=True)
    rows = rows.filter(pa.array((count[of] > 1) | several))
    ids, versions, begins, counts = (rows.column(c).to_numpy() for c in ("id", "v", "start", "n"))
    lengths = counts + (LENGTH - 1)
    shard_of = (np.cumsum(lengths + 1) - lengths) // SHARD_BYTES
    bodies = pa.concat_arrays(rows.column("bytes").chunks) if rows.num_rows else pa.array([], pa.binary())
    transforms, orders, owner, offset, wanted = [], [], [], [], []
    for s in np.unique(shard_of):
        own = np.flatnonzero(shard_of == s)
        data, at = utf8(bodies.slice(own[0], len(own)))
        text = np.zeros(len(data) + len(own), np.uint16)  # each segment with an end mark
        text[np.arange(len(data)) + np.repeat(np.arange(len(own)), lengths[own])] = data.astype(np.uint16) + 1
        ends = at[1:] + np.arange(1, len(own) + 1)
        order, symbols = transform(text, SORTED)
        at = np.searchsorted(ends, order, "right")
        transforms.append(symbols)
        orders.append(order)
        owner.append(own[at])
        offset.append(order - (ends[at] - lengths[own][at] - 1))
        wanted.append(np.flatnonzero(offset[-1] >= LENGTH))  # LENGTH symbols behind the starts, up to the end mark
    if not transforms:
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, names=["id", "v", "a", "b"])
    merged, block = interleave(transforms, orders, wanted)
    seg, off = np.concatenate(owner)[merged], np.concatenate(offset)[merged]
    if not (off < counts[seg]).all():
        raise AssertionError("a string that is not in its segment")
    ids, versions, starts = ids[seg], versions[seg], begins[seg] + off
    by = np.lexsort((starts, versions, ids, block))
    block, ids, versions, starts = block[by], ids[by], versions[by], starts[by]
    first = np.maximum.accumulate(np.where(np.append(True, block[1:] != block[:-1]), np.arange(len(block)), 0)) if len(block) else block
    again = (ids != ids[first]) | (versions != versions[first]) | (starts != starts[first])
    ids, versions, starts = ids[again], versions[again], starts[again]
    by = np.lexsort((starts, versions, ids))
    ids, versions, starts = ids[by], versions[by], starts[by]
    new = np.append(True, (ids[1:] != ids[:-1]) | (versions[1:] != versions[:-1]) | (starts[1:] > starts[:-1] + 1))[: len(ids)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ids))[: len(first)] - 1
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids[first], versions[first], starts[first], starts[last] + LENGTH)], names=["id", "v", "a", "b"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of h; whole hashes are gathered up to TASK_BYTES and merged together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column("bytes"))).as_py() or 0
        if size >= TASK_BYTES:
            rows = pa.Table.from_batches(held)
            h = rows.column("h").to_numpy()
            done = int(np.searchsorted(h, h[-1]))
            if done:
                yield repeats(rows.slice(0, done))
                held = rows.slice(done).combine_chunks().to_batches()
                size = sum(pc.sum(pc.binary_length(b.column("bytes"))).as_py() for b in held)
    if held:
        yield repeats(pa.Table.from_batches(held))


def _filter_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = batch.column(0).to_numpy().view(np.uint64)
        cells = np.concatenate(_cells(h))
        yield pa.RecordBatch.from_arrays([pa.array((cells >> U(6)).astype(np.int64)), pa.array((U(1) << (cells & U(63))).view(np.int64))], names=["word", "bits"])


def _filter(slim: DataFrame) -> np.ndarray:
    """Bits of all hashes that occur again. Its size is fixed."""
    again = cut(slim.mapInArrow(_hashes, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))
    cells = again.mapInArrow(_filter_cells, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    found = cells.toArrow()  # at most 2 ** (FILTER_BITS - 6) rows
    bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    discard(again)
    return bitmap


def _collapsed(kept: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Written segments -> ranges of those that equal an earlier one; first ones whose hash others have too, each with
    the bytes of its hash; and the written tables that these read."""
    aggregates = [F.min(F.struct("id", "v", "start")).alias("f"), F.first("n").alias("n"), F.max("several").alias("several"), F.count("*").alias("k")]
    first = cut(kept.groupBy("h", "mark").agg(*aggregates, *[F.first("bytes").alias("bytes")] * ("bytes" in kept.columns)))
    several = first.where("k > 1").select("h", "mark", "f")
    copies = kept.join(several, ["h", "mark"]).where("id != f.id or v != f.v or start != f.start")
    shared = cut(first.groupBy("h").agg(F.count("*").alias("c"), F.max("several").alias("s"), F.sum(F.col("n") + (LENGTH - 1)).alias("weight")).where("c > 1 or s").select("h", "weight"))
    open_ = first.join(broadcast_if_small(shared), "h").select("h", "f.id", "f.v", "f.start", "n", "several", *["bytes"] * ("bytes" in kept.columns), "weight")
    return copies.select("id", "v", F.col("start").alias("a"), (F.col("start") + F.col("n") + (LENGTH - 1)).alias("b")), open_, first, shared


def repeated_ranges(slim: DataFrame) -> DataFrame:
    """(id, v, text) -> (id, v, a, b): byte ranges covered by strings of LENGTH bytes that also start earlier. May overlap."""
    spark = slim.sparkSession
    filter_ = spark.sparkContext.broadcast(_filter(slim.select("id", "text")))
    kept = cut(slim.mapInArrow(_kept(filter_), POSITION))
    copies, open_, *made = _collapsed(kept)
    ranges = [cut(copies)]
    parts = open_.groupBy("id", "v").agg(F.collect_list(F.struct("h", "start", "n", "several")).alias("parts"))
    parts = cut(parts)  # a document's own segments
    weights = made[1].select("h", "weight")
    ids = cut(parts.select("id", "v"))
    texts = slim.join(broadcast_if_small(ids), ["id", "v"], "left_semi").join(parts, ["id", "v"])
    open_ = cut(texts.select("id", "v", "text", "parts").mapInArrow(_fetched, "h long, id long, v long, start long, n long, several boolean, bytes binary"))
    discard(kept, made[0], parts, ids)
    for piece in (*PIECES[1:], None):
        heavy = cut(weights.where(F.col("weight") > HEAVY_BYTES))
        hot = heavy.limit(1).count() > 0
        rest = open_.join(broadcast_if_small(heavy), "h", "left_anti") if hot and piece else open_
        size = rest.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
        dealt = rest.repartition(max(1, int(size // TASK_BYTES) + 1), "h").sortWithinPartitions("h")
        ranges.append(cut(dealt.mapInArrow(_merged, RANGE)))
        if not (hot and piece):
            break
        kept = cut(open_.join(broadcast_if_small(heavy), "h", "left_semi").select("h", "id", "v", "start", "n", "several", "bytes").mapInArrow(_split(piece), f"{POSITION}, bytes binary"))
        discard(open_, heavy, made[1])
        copies, deeper, *made = _collapsed(kept)
        ranges.append(cut(copies))
        open_, weights = cut(deeper.drop("weight")), made[1].select("h", "weight")
        discard(kept, made[0])
    discard(open_, heavy, made[1])
    out = ranges[0]
    for more in ranges[1:]:
        out = out.union(more)
    return out


def cut_out(data: bytes, spans) -> tuple[int, int, int, bytes]:
    """Bytes, removed bytes, removed runs and what is left of a text without the (a, b) byte ranges."""
    left, at, removed, runs, last = [], 0, 0, 0, -1
    for a, b in sorted(spans):
        if a > last:
            runs += 1
        left.append(data[at : max(a, at)])
        removed += max(b, at) - max(a, at)
        at, last = max(b, at), max(b, last)
    return len(data), removed, runs, b"".join([*left, data[at:]])


def _cut_texts(with_text: bool):
    """(id, text, a, b) with lists of range ends -> what dedup() returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, stop in blocks(batch.column(1), BLOCK_BYTES):
                part = batch.slice(begin, stop - begin)
                texts, ends = part.column(1).cast(pa.large_binary()), zip(part.column(2).to_pylist(), part.column(3).to_pylist())
                rows = [cut_out(t.as_py(), zip(a or (), b or ())) for t, (a, b) in zip(texts, ends)]
                columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
                columns.append(pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows], pa.string()))
                columns += [pa.array([r[3] for r in rows], pa.binary())] * with_text
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    return run


def dedup(docs: DataFrame, *, text: str = "text", key: str = "doc_id", with_text: bool = True) -> DataFrame:
    """Key, n_bytes, n_removed, n_spans, kept_sha256 and, with_text, kept (binary) of every row.

    Null and short texts lose nothing (null: empty). Keys are integers and order the corpus; a null key's text is left
    as it is. Rows with equal keys and texts are one document, with equal results; different texts under one key are
    different documents, in an order of their hashes. Empty tables give empty results; other columns are not carried.
    Texts of any length are used whole.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marks = slim.where("id is not null").groupBy("id").agg(F.min(F.xxhash64("text")).alias("x"), F.max(F.xxhash64("text")).alias("y"))
    shared = cut(marks.where("x != y").select("id", F.lit(True).alias("shared")))
    version = F.lit(0).cast("long")
    if shared.limit(1).count():
        slim = slim.join(broadcast_if_small(shared), "id", "left")
        version = F.when(F.col("shared"), F.xxhash64("text")).otherwise(version)
    slim = slim.select("id", version.alias("v"), "text")
    ranges = repeated_ranges(slim.where("id is not null"))
    listed = cut(ranges.groupBy("id", "v").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b")))  # a document's own ranges
    joined = slim.join(listed, ["id", "v"], "left").select("id", "text", "a", "b")
    kind = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return joined.mapInArrow(_cut_texts(with_text), kind).withColumnRenamed("id", key)
