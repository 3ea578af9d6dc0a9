"""Removal of repeated byte strings of 100 bytes and more, across all documents.

Every string of LENGTH bytes holds LENGTH - GRAM + 1 grams; the least hash
among them, its print, is the same wherever the string occurs. So only strings
whose print occurs twice can repeat. They are brought together by print, each
with the bytes around it, and ranked by bucket-pointer refinement: buckets of
short grams are refined by sorting on the buckets of later offsets, which
doubles the compared length each time, until it is LENGTH.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.llm.scratch import discard, stored
from rowferry.llm.words import mixed, powers
from rowferry.plans.session import ship_package

LENGTH, GRAM = 100, 52
_WINDOW = LENGTH - GRAM + 1

#: Text bytes meant for a block of documents and for a range of prints.
BLOCK_BYTES, RANGE_BYTES = 8 << 20, 16 << 20
#: Bytes hashed at a time, and bytes ranked at a time (prints with more are ranked whole).
CHUNK, RANKED = 1 << 18, 4 << 20
#: Bytes of the first buckets.
FIRST = 4
#: A print in more blocks than this is not gathered in one place: its strings are dealt out by their own bytes.
HOT_BLOCKS = 200

_LOW = np.uint64(63)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of so many values, by runs of doubled length."""
    reach, span = values, 1
    while span * 2 <= width:
        reach = np.minimum(reach[:-span], reach[span:])
        span *= 2
    rest = width - span
    return np.minimum(reach[: len(reach) - rest], reach[rest:]) if rest else reach


def _runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all strings that lie within one document: print, first start, number of neighbouring starts, and if its least hash occurs twice in one.

    ends are the documents' ends in data.
    """
    n = len(data) - LENGTH + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(bool)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    count = len(data) - GRAM + 1
    hashes = mixed((total[GRAM:] - total[:-GRAM]) * down[:count]) & ~_LOW
    # The low bits say where: places within a window differ in them. Both ways of breaking ties show if there are any.
    place = np.arange(count, dtype=np.uint64) & _LOW
    least, other = _least(hashes | place, _WINDOW), _least(hashes | (_LOW - place), _WINDOW)
    at = np.arange(n, dtype=np.uint64)
    anchor = ((least - at) & _LOW).astype(np.int64) + np.arange(n)
    tied = (least & _LOW) != _LOW - (other & _LOW)
    end = ends[np.searchsorted(ends, np.arange(n), "right")]
    inside = np.flatnonzero(end - np.arange(n) >= LENGTH)
    if not len(inside):
        return np.empty(0, np.uint64), inside, inside, np.empty(0, bool)
    new = np.ones(len(inside), bool)
    new[1:] = (np.diff(inside) > 1) | (np.diff(anchor[inside]) != 0)
    first = np.flatnonzero(new)
    # Least hashes are small numbers; mixed again they spread evenly.
    return mixed(least[inside[first]] >> np.uint64(6)), inside[first], np.diff(first, append=len(inside)), np.logical_or.reduceat(tied[inside], first)


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Short texts together and long ones in overlapping parts: first text, offset in it, bytes, ends of texts."""
    first, size = 0, 0
    for i in range(len(texts) + 1):
        length = len(texts[i]) if i < len(texts) else CHUNK + 1
        if size and size + length > CHUNK:
            yield first, 0, np.frombuffer(b"".join(texts[first:i]), np.uint8), np.cumsum([len(t) for t in texts[first:i]])
            first, size = i, 0
        if i < len(texts) and length > CHUNK:
            data = np.frombuffer(texts[i], np.uint8)
            for start in range(0, length - LENGTH + 1, CHUNK):
                part = data[start : start + CHUNK + LENGTH - 1]
                yield i, start, part, np.array([len(part)])
            first = i + 1
        else:
            size += length if i < len(texts) else 0
            first = first if size else i + 1


def _block_runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Print, text number, start in the text, number of starts, tie; by text and start."""
    for first, offset, data, ends in _chunks(texts):
        prints, starts, counts, ties = _runs(data, ends)
        text = np.searchsorted(ends, starts, "right")
        begins = np.concatenate([[0], ends[:-1]])
        yield prints, text + first, starts - begins[text] + offset, counts, ties


def _joined(parts: list[tuple[np.ndarray, ...]], n: int) -> list[np.ndarray]:
    return [np.concatenate(column) for column in zip(*parts)] if parts else [np.empty(0, np.int64)] * n


def _cuts(prints: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of ascending prints begins, and the end."""
    bounds = np.array([(r << 64) // ranges for r in range(1, ranges)], np.uint64)
    return np.concatenate([[0], np.searchsorted(prints, bounds), [len(prints)]]).astype(np.int64)


# ---------------------------------------------------------------- prints that occur twice


def shared_prints(blocks: DataFrame, ranges: int) -> DataFrame:
    """The prints of a block that occur twice there or in another block too: block, prints, hot (a bit for each)."""
    most = HOT_BLOCKS

    def collect(table: pa.Table) -> pa.Table:
        texts = [text or b"" for text in table["data"].to_pylist()]
        prints, _, _, _, ties = _joined(list(_block_runs(texts)), 5)
        prints = prints.astype(np.uint64)
        found, inverse, counts = np.unique(prints, return_inverse=True, return_counts=True)
        several = (counts > 1) | (np.bincount(inverse, ties, len(found)) > 0)
        cuts, block, rows = _cuts(found, ranges), table["block"][0].as_py(), []
        for r in range(ranges):
            part = slice(cuts[r], cuts[r + 1])
            if cuts[r + 1] > cuts[r]:
                rows.append({"range": r, "block": block, "prints": found[part].tobytes(), "several": np.packbits(several[part]).tobytes()})
        return pa.Table.from_pylist(rows, schema=pa.schema([("range", pa.int32()), ("block", pa.int32()), ("prints", pa.binary()), ("several", pa.binary())]))

    def meet(table: pa.Table) -> pa.Table:
        prints = [np.frombuffer(b, np.uint64) for b in table["prints"].to_pylist()]
        several = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(p)).astype(bool) for b, p in zip(table["several"].to_pylist(), prints)]
        blocks = table["block"].to_numpy()
        together = np.concatenate(prints)
        of = np.repeat(np.arange(len(prints)), [len(p) for p in prints])
        order = np.argsort(together, kind="stable")
        ascending = together[order]
        starts = np.flatnonzero(np.concatenate([[True], ascending[1:] != ascending[:-1]]))
        sizes = np.diff(starts, append=len(order))
        n_blocks = np.empty(len(order), np.int64)
        n_blocks[order] = np.repeat(sizes, sizes)
        shared = (n_blocks > 1) | np.concatenate(several)
        ends = np.searchsorted(of, np.arange(len(prints) + 1))
        rows = []
        for i, own in enumerate(prints):
            part = slice(ends[i], ends[i + 1])
            chosen = shared[part]
            if chosen.any():
                rows.append({"block": int(blocks[i]), "prints": own[chosen].tobytes(), "hot": np.packbits(n_blocks[part][chosen] > most).tobytes()})
        return pa.Table.from_pylist(rows, schema=pa.schema([("block", pa.int32()), ("prints", pa.binary()), ("hot", pa.binary())]))

    gathered = blocks.groupBy("block").applyInArrow(collect, "range int, block int, prints binary, several binary")
    return gathered.groupBy("range").applyInArrow(meet, "block int, prints binary, hot binary")


# ---------------------------------------------------------------- strings around shared prints

_SENT = pa.schema([("range", pa.int32()), ("kind", pa.int32()), ("block", pa.int32()), ("numbers", pa.binary()), ("data", pa.binary())])
_SPANS = pa.schema([("block", pa.int32()), ("numbers", pa.binary())])


def _ordered_texts(table: pa.Table) -> tuple[list[int], list[int], list[bytes]]:
    """Identifiers, keys and texts by identifier; a repeated row once, a null identifier as the least."""
    rows = {}
    for doc_id, key, data in zip(table["doc_id"].to_pylist(), table["key"].to_pylist(), table["data"].to_pylist()):
        rows[(-(1 << 63) if doc_id is None else doc_id, key)] = data or b""
    order = sorted(rows)
    return [o[0] for o in order], [o[1] for o in order], [rows[o] for o in order]


def repeated_strings(blocks: DataFrame, shared: DataFrame, ranges: int) -> DataFrame:
    """Spans of bytes that occur earlier: block, numbers (identifier, key, start, end of each)."""

    def send(docs: pa.Table, prints: pa.Table) -> pa.Table:
        if not docs.num_rows or not prints.num_rows:
            return pa.Table.from_pylist([], schema=_SENT)
        block = docs["block"][0].as_py()
        ids, keys, texts = _ordered_texts(docs)
        parts = [np.frombuffer(b, np.uint64) for b in prints["prints"].to_pylist()]
        bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(p)) for b, p in zip(prints["hot"].to_pylist(), parts)]
        wanted, hot = np.concatenate(parts), np.concatenate(bits).astype(bool)
        order = np.argsort(wanted)
        wanted, hot = wanted[order], hot[order]
        seen: dict[bytes, tuple[int, int]] = {}
        spans, numbers, strings = [], [], []
        for of, text, start, count, tie in _block_runs(texts):
            at = np.minimum(np.searchsorted(wanted, of), len(wanted) - 1)
            for i in np.flatnonzero(wanted[at] == of).tolist():
                t, upto = int(text[i]), int(start[i]) + int(count[i])
                each = bool(hot[at[i]])  # one string by one, or all neighbours together
                for s in range(int(start[i]), upto, 1 if each else upto):
                    c = 1 if each else upto - s
                    string = texts[t][s : s + c + LENGTH - 1]
                    here = (ids[t], s)
                    # Of equal strings in a block only the first is sent; the others repeat it.
                    if seen.setdefault(string, here) < here:
                        spans.append((ids[t], keys[t], s, s + len(string)))
                    else:
                        meets_at = int.from_bytes(blake2b(string, digest_size=8).digest(), "little", signed=True) if each else int(of[i].view(np.int64))
                        numbers.append((meets_at, ids[t], keys[t], s, c, int(tie[i])))
                        strings.append(string)
        rows = []
        if spans:
            rows.append({"range": block % ranges, "kind": 1, "block": block, "numbers": np.array(spans, np.int64).tobytes(), "data": b""})
        if numbers:
            table = np.array(numbers, np.int64)
            order = np.argsort(table[:, 0].view(np.uint64), kind="stable")
            cuts = _cuts(table[order, 0].view(np.uint64), ranges)
            for r in range(ranges):
                part = order[cuts[r] : cuts[r + 1]]
                if len(part):
                    rows.append({"range": r, "kind": 0, "block": block, "numbers": table[part].tobytes(), "data": b"".join([strings[i] for i in part.tolist()])})
        return pa.Table.from_pylist(rows, schema=_SENT)

    def settle(table: pa.Table) -> pa.Table:
        made = []
        sent: list[tuple] = []
        for kind, block, numbers, data in zip(*[table[c].to_pylist() for c in ("kind", "block", "numbers", "data")]):
            if kind:
                made.append({"block": block, "numbers": numbers})
                continue
            at = 0
            for of, doc_id, key, start, count, tie in np.frombuffer(numbers, np.int64).reshape(-1, 6).tolist():
                sent.append((of, doc_id, start, key, block, count, tie, data[at : at + count + LENGTH - 1]))
                at += count + LENGTH - 1
        sent.sort(key=lambda row: row[:3])
        spans: dict[int, list] = {}
        group: list[tuple] = []
        waiting: list[tuple] = []
        size = 0

        def close_group():
            nonlocal size
            seen: dict[bytes, tuple] = {}
            kept = []
            for row in group:
                if seen.setdefault(row[7], row[1:3]) < row[1:3]:
                    spans.setdefault(row[4], []).append((row[1], row[3], row[2], row[2] + len(row[7])))
                else:
                    kept.append(row)
            if len(kept) > 1 or kept and kept[0][6]:
                waiting.extend(kept)
                size += sum(len(row[7]) for row in kept)
            group.clear()

        def rank():
            nonlocal size
            for row, start, end in _later(waiting):
                spans.setdefault(row[4], []).append((row[1], row[3], row[2] + start, row[2] + end))
            waiting.clear()
            size = 0

        for row in sent:
            if group and row[0] != group[0][0]:
                close_group()
                if size >= RANKED:
                    rank()
            group.append(row)
        close_group()
        rank()
        made += [{"block": block, "numbers": np.array(found, np.int64).tobytes()} for block, found in spans.items()]
        return pa.Table.from_pylist(made, schema=_SPANS)

    strings = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(send, "range int, kind int, block int, numbers binary, data binary")
    return strings.groupBy("range").applyInArrow(settle, "block int, numbers binary")


def string_buckets(data: np.ndarray, length: int) -> np.ndarray:
    """Equal numbers for starts of equal strings of so many bytes, by bucket-pointer refinement.

    The first buckets are those of FIRST bytes. A refinement sorts the starts
    of a bucket by the buckets that the bytes behind them are in, so that the
    buckets it makes compare twice as much, and the next one uses those. Starts
    that are alone in their bucket are settled and not sorted again.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(length, np.uint8)]).astype(np.uint32)
    value = np.zeros(n, np.uint32)
    for i in range(FIRST):
        value = (value << np.uint32(8)) | padded[i : i + n]
    _, bucket = np.unique(value, return_inverse=True)
    bucket = bucket.astype(np.int64)
    depth, base = FIRST, n + 1
    while depth < length:
        counts = np.bincount(bucket, minlength=n)
        active = np.flatnonzero(counts[bucket] > 1)
        if not len(active):
            break
        behind = active + min(depth, length - depth)
        pointer = np.where(behind < n, bucket[np.minimum(behind, n - 1)], n)
        _, refined = np.unique(bucket[active] * base + pointer, return_inverse=True)
        # Settled starts keep numbers of their own; refined buckets are numbered after all others.
        fresh = np.full(n, -1, np.int64)
        fresh[active] = refined
        alone = np.flatnonzero(fresh < 0)
        fresh[alone] = np.arange(len(alone)) + (int(refined.max()) + 1)
        bucket = fresh
        depth += min(depth, length - depth)
    return bucket


def _later(rows: list[tuple]) -> Iterator[tuple[tuple, int, int]]:
    """The rows' strings that an earlier place has too: row, first and last byte after, for each run of them."""
    if not rows:
        return
    lengths = np.array([len(row[7]) for row in rows])
    offsets = np.cumsum(lengths) - lengths
    bucket = string_buckets(np.frombuffer(b"".join([row[7] for row in rows]), np.uint8), LENGTH)
    counts = lengths - LENGTH + 1
    of = np.repeat(np.arange(len(rows)), counts)
    shift = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    bucket = bucket[offsets[of] + shift]
    ids = np.array([row[1] for row in rows], np.int64)[of]
    starts = np.array([row[2] for row in rows], np.int64)[of] + shift
    order = np.lexsort((starts, ids, bucket))
    begins = np.flatnonzero(np.diff(bucket[order], prepend=bucket[order[0]] - 1))
    first = np.repeat(order[begins], np.diff(begins, append=len(order)))
    later = np.zeros(len(of), bool)
    later[order] = (ids[order] != ids[first]) | (starts[order] != starts[first])
    marked = np.flatnonzero(later)
    if not len(marked):
        return
    new = np.ones(len(marked), bool)
    new[1:] = (np.diff(marked) > 1) | (of[marked[1:]] != of[marked[:-1]])
    firsts = np.flatnonzero(new)
    lasts = np.append(firsts[1:], len(marked)) - 1
    for a, b in zip(marked[firsts].tolist(), marked[lasts].tolist()):
        yield rows[of[a]], int(shift[a]), int(shift[b]) + LENGTH


# ---------------------------------------------------------------- documents


def without_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay).

    A byte goes if a string of LENGTH bytes over it also starts earlier, in a
    document of smaller doc_id or before in the same one. Texts are bytes of
    UTF-8; null and texts shorter than LENGTH keep all. A null doc_id is smaller
    than any other. Rows that share a doc_id count as one document's: of equal
    strings that start at one place in both, neither is earlier. Other columns
    are not read.
    """
    ship_package(spark)
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, ranges = max(1, -(-total // BLOCK_BYTES)), max(1, -(-total // RANGE_BYTES))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int").alias("block")
    blocks = docs.select(F.col("doc_id").cast("bigint"), block, data.alias("data"), F.xxhash64(data).alias("key"))
    shared, shared_path = stored(spark, shared_prints(blocks, ranges), "shared-prints")
    spans, _ = stored(spark, repeated_strings(blocks, shared, ranges), "repeated-spans")
    discard(spark, shared_path)

    def cut(docs: pa.Table, found: pa.Table) -> pa.Table:
        by_text: dict[tuple, list] = {}
        for numbers in found["numbers"].to_pylist():
            for doc_id, key, start, end in np.frombuffer(numbers, np.int64).reshape(-1, 4).tolist():
                by_text.setdefault((doc_id, key), []).append((start, end))
        rows = []
        for doc_id, key, data in zip(docs["doc_id"].to_pylist(), docs["key"].to_pylist(), docs["data"].to_pylist()):
            at, kept, removed, n_spans = 0, [], 0, 0
            upto = -1  # end of the last span
            for start, end in sorted(by_text.get((-(1 << 63) if doc_id is None else doc_id, key), [])):
                if start > upto:
                    n_spans += 1
                    kept.append(data[at:start])
                removed += max(0, end - max(start, upto))
                at = upto = max(upto, end)
            kept.append(data[at:])
            rows.append((doc_id, len(data), removed, n_spans, b"".join(kept)))
        columns = list(zip(*rows)) or [()] * 5
        kinds = [pa.int64()] * 4 + [pa.binary()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    both = blocks.groupBy("block").cogroup(spans.groupBy("block"))
    return both.applyInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return without_repeats(spark, docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
