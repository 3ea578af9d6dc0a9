"""N-gram Jaccard join of whole documents, by signature trees over candidate blocks.

Documents with equal shingle sets are one set. Two linked sets share one of
their rarest shingles: with all shingles in one order, rarest first, sets of
sizes a <= b that overlap in 75 % of their union share one among the first
a - ceil(0.75 a) + 1 of the one and the first so many of the other. A set most
of whose shingles occur nowhere else is thus linked to nothing. The rest falls
into blocks, the components of "shares one of the first shingles"; signature
trees find the links in a block. A large block is dealt out in pieces, whose
trees have roots of their own: a set is sent to another piece only if that
piece's root admits a link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.llm.components import components
from rowferry.llm.scratch import discard, joined_by_size, stored
from rowferry.llm.signature_trees import MOST_BITS, admitted, root_of, signatures, spanning_links
from rowferry.llm.words import give_back, mixed, shingles, slices, word_lists
from rowferry.plans.session import ship_package

#: Words of a shingle, and the least similarity in per cent.
WORDS, PERCENT = 5, 75

#: Shingles gathered by a task before it sends them, and meant for one range of them.
GATHERED, RANGE_SHINGLES = 1_000_000, 2_000_000
#: Sets and shingles of a piece of a block.
PIECE_SETS, PIECE_SHINGLES = 100, 1_000_000
#: Roots, and pieces whose sets are compared with them, of one task; a root or a set is a bitmap of 2 KB there.
TILE_ROOTS, TILE_PIECES = 2_048, 50
#: A shingle in this share of all sets counts as common: it is not gathered in one place, only counted. There are
#: no more of them than the mean size of a set divided by this share.
COMMON = 0.02

#: Bits of the filter of documents whose texts are needed again; 64 of them are a row, which makes a million rows at most.
FILTER_BITS = 1 << 26

#: Shingles are compared by 48 bits when they are counted; two that agree there only share their count.
_SHORT = np.uint64(16)


def _set_ids(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each set."""
    found = np.zeros((2, len(sets)), np.uint64)
    for i, s in enumerate(sets):
        for k in (0, 1):
            found[k, i] = mixed(s ^ np.uint64((0x5851F42D4C957F2D, 0x14057B7EF767814F)[k])).sum(dtype=np.uint64)
    return mixed(found[0]).view(np.int64), mixed(found[1]).view(np.int64)


def _shingle_sets(texts: list) -> list[np.ndarray]:
    return [shingles(words, WORDS) for words in word_lists(texts)]


def shingle_sets(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n, set_id and check (null for empty sets), and rows of shingles that are common among the documents of a task."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        gathered = 0

        def common():
            if held:
                found, counts = np.unique(np.concatenate([s >> _SHORT for s in held.values()]), return_counts=True)
                chosen = counts >= max(2, COMMON * len(held))
                n = int(chosen.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(found[chosen].astype(np.int64)), pa.array(counts[chosen].astype(np.int64))],
                    names=names,
                )

        names = ["doc_id", "n", "set_id", "check", "shingle", "count"]
        for batch in (part for whole in batches for part in slices(whole)):
            sets = _shingle_sets(batch.column(1).to_pylist())
            ids, checks = _set_ids(sets)
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            none = n == 0
            nulls = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(ids, mask=none), pa.array(checks, mask=none), nulls, nulls], names=names)
            for key, s in zip(ids.tolist(), sets):
                if len(s) and key not in held:
                    held[key] = s
                    gathered += len(s)
                if gathered >= GATHERED:
                    yield from common()
                    held.clear()
                    gathered = 0
        yield from common()
        held.clear()
        give_back()

    schema = "doc_id bigint, n bigint, set_id bigint, check bigint, shingle bigint, count bigint"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


# ---------------------------------------------------------------- counting shingles


def _packed(ids: np.ndarray, n: np.ndarray, values: np.ndarray, which: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """Sets that have values, and the values ascending with the place of each one's set."""
    present, place = np.unique(which, return_inverse=True)
    steps = np.diff(values, prepend=values[:1])
    wide = len(steps) and int(steps.max()) >= 1 << 32
    head = np.array([len(present), len(values), int(values[0]) if len(values) else 0, bool(wide)], np.uint64)
    parts = [head, ids[present], n[present].astype(np.int64), steps.astype(np.uint64 if wide else np.uint32), place.astype(np.uint32 if len(present) > 0xFFFF else np.uint16)]
    return b"".join(part.tobytes() for part in parts)


def _unpacked(blob: pa.Buffer | bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set ids, sizes and values, one of each per value."""
    n_sets, n_values, first, wide = np.frombuffer(blob, np.uint64, 4).astype(np.int64).tolist()
    at = 32
    parts = []
    for kind, count in ((np.int64, n_sets), (np.int64, n_sets), (np.uint64 if wide else np.uint32, n_values), (np.uint32 if n_sets > 0xFFFF else np.uint16, n_values)):
        parts.append(np.frombuffer(blob, kind, count, at))
        at += parts[-1].nbytes
    ids, n, steps, place = parts
    return ids[place], n[place], np.cumsum(steps, dtype=np.uint64) + np.uint64(first)


def _all_unpacked(blobs: list[pa.Buffer]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of all blobs together, without a copy of them or of their parts."""
    ends = np.cumsum([int(np.frombuffer(blob, np.uint64, 2)[1]) for blob in blobs]).tolist()
    made = np.empty(ends[-1], np.int64), np.empty(ends[-1], np.int32), np.empty(ends[-1], np.uint64)
    for blob, start, end in zip(blobs, [0, *ends[:-1]], ends):
        for whole, part in zip(made, _unpacked(blob)):
            whole[start:end] = part
    return made


def _counted(part: int, ids: np.ndarray, n: np.ndarray, values: np.ndarray, counts: np.ndarray) -> dict:
    """Shingles of one part of the sets, with their counts, ordered by set."""
    order = np.argsort(ids, kind="stable")
    ids, n = ids[order], n[order]
    starts = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1))
    sizes = np.diff(starts, append=len(ids))
    head = np.array([len(starts), len(ids)], np.int64)
    pieces = [head, ids[starts], n[starts].astype(np.int64), sizes, values[order], counts[order].astype(np.int64)]
    return {"part": part, "blob": b"".join(p.tobytes() for p in pieces)}


def shared_shingles(spark: SparkSession, docs: DataFrame, ranges: int, common: np.ndarray, common_counts: np.ndarray) -> DataFrame:
    """The shingles that several sets have: part, blob; part is a hash of the set."""
    sent_common = spark.sparkContext.broadcast((common, common_counts))  # few, see COMMON

    def gather(batches):
        held: dict[int, np.ndarray] = {}
        gathered = 0

        def send():
            ids = np.fromiter(held, np.int64, len(held))
            n = np.fromiter(map(len, held.values()), np.int64, len(held))
            values = np.concatenate([s >> _SHORT for s in held.values()])
            which = np.repeat(np.arange(len(held)), n)
            at = np.minimum(np.searchsorted(sent_common.value[0], values), max(0, len(sent_common.value[0]) - 1))
            everywhere = sent_common.value[0][at] == values if len(sent_common.value[0]) else np.zeros(len(values), bool)
            for kind, chosen in ((0, ~everywhere), (1, everywhere)):
                of_kind, of_set = values[chosen], which[chosen]
                order = np.argsort(of_kind, kind="stable")
                of_kind, of_set = of_kind[order], of_set[order]
                if kind:  # spread by place, as they only pass through
                    cuts = np.linspace(0, len(of_kind), min(ranges, len(of_kind) // 50_000 + 1) + 1).astype(np.int64)
                    targets = [(int(ids[0]) + i) % ranges for i in range(len(cuts) - 1)]
                else:
                    bounds = np.array([(r << 48) // ranges for r in range(1, ranges)], np.uint64)
                    cuts = np.concatenate([[0], np.searchsorted(of_kind, bounds), [len(of_kind)]])
                    targets = list(range(ranges))
                rows = [
                    {"range": target, "kind": kind, "blob": _packed(ids, n, of_kind[start:end], of_set[start:end])}
                    for target, start, end in zip(targets, cuts[:-1].tolist(), cuts[1:].tolist()) if end > start
                ]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("range", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())]))

        for batch in (part for whole in batches for part in slices(whole)):
            sets = _shingle_sets(batch.column(0).to_pylist())
            for key, s in zip(_set_ids(sets)[0].tolist(), sets):
                if len(s) and key not in held:  # copies in one task count once
                    held[key] = s
                    gathered += len(s)
                if gathered >= GATHERED:
                    yield from send()
                    held, gathered = {}, 0
        if held:
            yield from send()
        held = {}
        give_back()

    def count(table: pa.Table) -> pa.Table:
        rows = []
        for kind in (0, 1):
            blobs = [b.as_buffer() for b, k in zip(table["blob"], table["kind"].to_pylist()) if k == kind]
            if not blobs:
                continue
            ids, n, values = _all_unpacked(blobs)
            order = np.lexsort((ids, values))
            values = values[order]  # one after the other, so that a task holds few such columns
            ids = ids[order]
            n = n[order]
            del order
            new = np.ones(len(ids), bool)
            new[1:] = (values[1:] != values[:-1]) | (ids[1:] != ids[:-1])
            if not new.all():
                ids, n, values = ids[new], n[new], values[new]
            if kind:
                counts = sent_common.value[1][np.searchsorted(sent_common.value[0], values)]
            else:
                starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
                sizes = np.diff(starts, append=len(values))
                counts = np.repeat(sizes.astype(np.int32), sizes)
            several = counts > 1
            ids, n, values, counts = ids[several], n[several], values[several], counts[several]
            part = (ids.view(np.uint64) >> np.uint64(32)) % np.uint64(ranges)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(ranges + 1))
            for p in range(ranges):
                at = order[edges[p] : edges[p + 1]]
                if len(at):
                    rows.append(_counted(p, ids[at], n[at], values[at], counts[at]))
        give_back()
        return pa.Table.from_pylist(rows, schema=pa.schema([("part", pa.int32()), ("blob", pa.binary())]))

    blobs = docs.select("text").mapInArrow(gather, "range int, kind int, blob binary")
    return blobs.groupBy("range").applyInArrow(count, "part int, blob binary")


def first_shingles(counted: DataFrame) -> DataFrame:
    """set_id, n and each shingle among the rarest of the set that another set has too."""

    def choose(table: pa.Table) -> pa.Table:
        found = []
        for blob in (value.as_buffer() for value in table["blob"]):
            n_sets, n_values = np.frombuffer(blob, np.int64, 2).tolist()
            numbers = np.frombuffer(blob, np.int64, offset=16)
            ids, n, sizes = numbers[:n_sets], numbers[n_sets : 2 * n_sets], numbers[2 * n_sets : 3 * n_sets]
            values, counts = numbers[3 * n_sets : 3 * n_sets + n_values], numbers[3 * n_sets + n_values :]
            found.append((np.repeat(ids, sizes), np.repeat(n, sizes), values, counts))
        ids, n, values, counts = (np.concatenate(parts) for parts in zip(*found))
        order = np.lexsort((values, counts, ids))
        ids, n, values = ids[order], n[order], values[order]
        new = np.ones(len(ids), bool)  # a common one may come from several tasks
        new[1:] = (values[1:] != values[:-1]) | (ids[1:] != ids[:-1])
        ids, n, values = ids[new], n[new], values[new]
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.empty(0, np.int64)
        sizes = np.diff(starts, append=len(ids))
        rank = np.arange(len(ids)) - np.repeat(starts, sizes)
        # One more than needed, should two shingles of the set agree in 48 bits.
        first = n - (n * PERCENT + 99) // 100 + 2
        alone = n - np.repeat(sizes, sizes)
        chosen = rank + alone < first
        give_back()
        return pa.table({"set_id": ids[chosen], "n": n[chosen], "shingle": values[chosen]})

    return counted.groupBy("part").applyInArrow(choose, "set_id bigint, n bigint, shingle bigint")


# ---------------------------------------------------------------- blocks


def _links_in_pieces(rows: DataFrame) -> DataFrame:
    """Links within each piece, a and b, and for each piece its root and the most typical set (a) of its largest component."""

    def join(table: pa.Table) -> pa.Table:
        ids = table["set_id"].to_pylist()
        sets = [np.frombuffer(b, np.uint64) for b in table["shingles"].to_pylist()]
        links = spanning_links(sets, ids, PERCENT)
        made = [{"a": ids[a], "b": ids[b]} for a, b in links]
        parent = {i: i for i in ids}

        def find(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for link in made:
            parent[find(link["a"])] = find(link["b"])
        _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        ends = np.cumsum([len(s) for s in sets])
        typical = np.add.reduceat(counts[inverse], np.concatenate([[0], ends[:-1]])) / np.maximum(1, np.diff(ends, prepend=0))
        best: dict = {}
        members: dict = {}
        for i, value in zip(ids, typical.tolist()):
            root = find(i)
            members[root] = members.get(root, 0) + 1
            best[root] = max(best.get(root, (-1.0, 0)), (value, i))
        largest = max(members, key=lambda root: (members[root], root))
        words, least, most, excess = root_of(signatures(sets, MOST_BITS))
        place = {name: table[name][0].as_py() for name in ("block", "pieces", "piece")}
        made.append({"a": best[largest][1], **place, "words": words, "least": least, "most": most, "excess": excess})
        return pa.Table.from_pylist(made, schema=schema)

    schema = pa.schema([(name, pa.binary() if name == "words" else pa.int64()) for name in ("a", "b", "block", "pieces", "piece", "words", "least", "most", "excess")])
    return rows.groupBy("block", "piece").applyInArrow(join, "a bigint, b bigint, block bigint, pieces bigint, piece bigint, words binary, least bigint, most bigint, excess bigint")


def _tiles(outside: DataFrame, roots: DataFrame) -> DataFrame:
    """Sets and roots of a block, each with all tiles (batch, chunk) it belongs to: a tile has the sets of some pieces and some of the roots."""

    def sign(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            words, n, _, excess = signatures([np.frombuffer(b, np.uint64) for b in batch.column(4).to_pylist()], MOST_BITS)
            columns = [*batch.columns[:4], pa.array([w.tobytes() for w in words], pa.binary()), pa.array(n), pa.array(n), pa.array(excess)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "block", "pieces", "piece", "words", "least", "most", "excess"])

    signed = outside.select("set_id", "block", "pieces", F.col("piece").cast("bigint"), "shingles").mapInArrow(
        sign, "id bigint, block bigint, pieces bigint, piece bigint, words binary, least bigint, most bigint, excess bigint"
    )

    def to(last, size):
        return F.explode(F.sequence(F.lit(0), F.floor(last / size).cast("int")))

    shared = ["id", "block", "words", "least", "most", "excess"]
    sets = signed.select(*shared, F.lit(False).alias("root"), F.floor(F.col("piece") / TILE_PIECES).cast("int").alias("batch"), to(F.col("pieces") - 1, TILE_ROOTS).alias("chunk"))
    of_pieces = roots.withColumn("id", F.col("piece")).select(
        *shared, F.lit(True).alias("root"), to(F.col("pieces") - 1, TILE_PIECES).alias("batch"), F.floor(F.col("piece") / TILE_ROOTS).cast("int").alias("chunk")
    )
    return sets.unionByName(of_pieces)


def _admitted(tiles: DataFrame) -> DataFrame:
    """Sets and the pieces whose roots admit a link with them: set_id, to."""

    def join(table: pa.Table) -> pa.Table:
        is_root = table["root"].to_numpy()
        ids = table["id"].to_numpy()
        words = np.frombuffer(b"".join(table["words"].to_pylist()), np.uint64).reshape(len(ids), -1)
        nodes = (words, *(table[name].to_numpy() for name in ("least", "most", "excess")))
        sets, roots = (tuple(part[chosen] for part in (ids, *nodes)) for chosen in (~is_root, is_root))
        found = [(sets[0][i], roots[0][j]) for i, j in admitted(sets[1:], roots[1:], PERCENT)]
        set_ids, to = (np.concatenate(parts) for parts in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
        return pa.table({"set_id": set_ids, "to": to})

    return tiles.groupBy("block", "batch", "chunk").applyInArrow(join, "set_id bigint, to bigint")


def _links_across(rows: DataFrame) -> DataFrame:
    """Links between the members of a piece and the sets sent to it from elsewhere."""

    def join(table: pa.Table) -> pa.Table:
        ids, labels, own = table["set_id"].to_pylist(), table["component"].to_pylist(), table["own"].to_pylist()
        sets = [np.frombuffer(b, np.uint64) for b in table["shingles"].to_pylist()]
        here, sent = [i for i, o in enumerate(own) if o], [i for i, o in enumerate(own) if not o]
        links = spanning_links([sets[i] for i in here], [labels[i] for i in here], PERCENT, [sets[i] for i in sent], [labels[i] for i in sent])
        both = here + sent
        return pa.Table.from_arrays([pa.array([ids[both[a]] for a, _ in links], pa.int64()), pa.array([ids[both[b]] for _, b in links], pa.int64())], names=["a", "b"])

    return rows.groupBy("block", "piece").applyInArrow(join, "a bigint, b bigint")


def _maybe_wanted(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows without those whose doc_id is none of the wanted ones, by bits of its hash, so that their texts are not
    shuffled. The bits are broadcast, as their number is fixed; the more are set, the more other rows pass too."""

    def bit(column: str) -> F.Column:
        return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)).alias("_bit")

    words = wanted.select(bit("_doc")).groupBy(F.shiftright("_bit", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_bit % 64 AS int)))").alias("_bits"))
    marked = rows.select("*", bit("doc_id")).join(F.broadcast(words), F.shiftright("_bit", 6) == F.col("_word"))
    return marked.where("bit_get(_bits, cast(_bit % 64 AS int)) = 1").select(*rows.columns)


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """A text for each wanted set, with the set's columns: that of its document, or, where several of the sets have
    one doc_id or none, any text with that set."""
    rows = _maybe_wanted(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), wanted)
    several = wanted.groupBy("_doc").agg(F.count("*").alias("c")).where("c > 1 OR _doc IS NULL").select("_doc")
    columns = [c for c in wanted.columns if c != "_doc"]
    if several.isEmpty():
        return rows.join(wanted, F.col("doc_id") == F.col("_doc")).select("text", *columns)
    once = wanted.join(several, "_doc", "left_anti").where("_doc IS NOT NULL")
    unclear = rows.join(several, F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")

    def name(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            sets = _shingle_sets(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_set_ids(sets)[0])], names=["text", "set_id"])
        give_back()

    named = unclear.where("text IS NOT NULL").select("text").mapInArrow(name, "text string, set_id bigint")
    named = named.join(wanted.select("set_id"), "set_id", "left_semi").groupBy("set_id").agg(F.min("text").alias("text"))
    others = named.join(wanted.join(once.select("set_id"), "set_id", "left_anti"), "set_id").select("text", *columns)
    return rows.join(once, F.col("doc_id") == F.col("_doc")).select("text", *columns).unionByName(others)


def links(spark: SparkSession, docs: DataFrame, sets: DataFrame, ranges: int, common: np.ndarray, common_counts: np.ndarray) -> tuple[DataFrame, list[str]]:
    """Links between sets, a and b, that connect all that are connected; and the paths of tables to discard after use."""
    firsts, firsts_path = stored(spark, first_shingles(shared_shingles(spark, docs, ranges, common, common_counts)), "first-shingles")
    # Sets whose sizes allow a link fall into one class or into neighbours.
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT)) - 1e-9)
    keyed = firsts.select("set_id", "shingle", F.explode(F.array(size_class, size_class + 1)).alias("class"))
    groups = keyed.groupBy("shingle", "class").agg(F.min("set_id").alias("first"), F.max("set_id").alias("last"), F.count("*").alias("size")).where("first < last")
    groups, groups_path = stored(spark, groups.drop("last"), "shingle-groups")
    pairs = joined_by_size(keyed, groups, ["shingle", "class"], 2 * firsts.count()).select(F.col("set_id").alias("a"), F.col("first").alias("b"))
    blocks, blocks_path = stored(spark, components(spark, pairs).withColumnsRenamed({"node": "set_id", "component": "block"}), "blocks")
    discard(spark, firsts_path, groups_path)

    first_docs = sets.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    wanted = blocks.join(first_docs, "set_id")
    sized = wanted.groupBy("block").agg(
        F.greatest(F.ceil(F.count("*") / PIECE_SETS), F.ceil(F.sum("n") / PIECE_SHINGLES)).alias("pieces"), F.count("*").alias("size")
    )
    sized, sized_path = stored(spark, sized, "block-sizes")
    wanted = joined_by_size(wanted, sized, ["block"], sets.count())
    wanted = wanted.select(F.col("doc_id").alias("_doc"), "set_id", "block", "pieces", F.pmod(F.xxhash64("set_id"), "pieces").cast("int").alias("piece"))
    wanted, wanted_path = stored(spark, wanted, "wanted-sets")

    def shingle(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            sets = _shingle_sets(batch.column(0).to_pylist())
            same = pa.array(_set_ids(sets)[0] == np.array(batch.column(1).to_pylist(), np.int64))  # rows may repeat a doc_id
            made = pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_id", "block", "pieces", "piece", "shingles"])
            yield made.filter(same)
        give_back()

    members = _texts_of(docs, wanted).mapInArrow(shingle, "set_id bigint, block bigint, pieces bigint, piece int, shingles binary")
    members, members_path = stored(spark, members, "block-members")
    inside, inside_path = stored(spark, _links_in_pieces(members), "piece-links")
    discard(spark, blocks_path, sized_path, wanted_path)
    paths = [members_path, inside_path]
    found = inside.where("b IS NOT NULL").select("a", "b")
    large = members.where("pieces > 1")
    if large.isEmpty():
        return found, paths

    # The most typical sets of all pieces of a block are joined next. What is then outside the block's largest
    # component is compared with the roots of all its pieces, and sent to those that admit a link.
    roots = inside.where("b IS NULL AND pieces > 1")
    typical = large.join(roots.select(F.col("a").alias("set_id")), "set_id").withColumn("piece", (F.col("piece") / PIECE_SETS).cast("int"))
    between, between_path = stored(spark, _links_in_pieces(typical).where("b IS NOT NULL").select("a", "b"), "typical-links")
    found = found.unionByName(between)
    placed = large.select("set_id", "block").join(components(spark, found).withColumnRenamed("node", "set_id"), "set_id", "left")
    placed, placed_path = stored(spark, placed.withColumn("component", F.coalesce("component", "set_id")), "placed")
    counts = placed.groupBy("block", "component").agg(F.count("*").alias("c"))
    largest = counts.groupBy("block").agg(F.max(F.struct("c", "component")).getField("component").alias("largest"), F.sum("c").alias("size"))
    largest, largest_path = stored(spark, largest, "largest-components")
    outer = joined_by_size(placed, largest, ["block"], placed.count()).where("component <> largest").select("set_id", "component")
    outer, outer_path = stored(spark, outer, "outside-sets")
    to_pieces, to_path = stored(spark, _admitted(_tiles(large.join(outer, "set_id", "left_semi"), roots)), "admitted-pieces")
    paths += [between_path, placed_path, largest_path, outer_path, to_path]
    if to_pieces.isEmpty():
        return found, paths
    home = large.join(placed.select("set_id", "component"), "set_id").withColumn("own", F.lit(True))
    elsewhere = large.join(outer, "set_id").join(to_pieces, "set_id").where("to <> piece").withColumn("piece", F.col("to").cast("int")).withColumn("own", F.lit(False))
    columns = ["set_id", "block", "piece", "component", "shingles", "own"]
    across, across_path = stored(spark, _links_across(home.select(*columns).unionByName(elsewhere.select(*columns))), "across-links")
    return found.unionByName(across), [*paths, across_path]


def join(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Words are what is between ASCII spaces, A-Z lower-cased; the set of a text
    with fewer than five words is its whole sequence. Null and empty texts, and
    those without words, have an empty set and are linked with nothing. Rows
    that repeat a text are linked; a null doc_id counts only where a component
    has no other. Other columns are not read.
    """
    ship_package(spark)
    rows, _ = stored(spark, shingle_sets(spark, docs), "shingle-sets")
    sets = rows.where("set_id IS NOT NULL").select("doc_id", "n", "set_id", "check")
    if not sets.groupBy("set_id").agg(F.min("check").alias("c"), F.max("check").alias("d")).where("c <> d").isEmpty():
        raise ValueError("two sets of shingles have one identifier")
    distinct = sets.groupBy("set_id").agg(F.first("n").alias("n")).agg(F.count("*").alias("sets"), F.sum("n").alias("n")).first()
    often = rows.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("count").alias("c")).where(F.col("c") >= max(2, COMMON * distinct.sets))
    common = often.orderBy("shingle").toPandas()  # few, see COMMON
    values, counts = common.shingle.to_numpy(np.int64).astype(np.uint64), common.c.to_numpy(np.int64)
    ranges = max(1, -(-(distinct.n or 0) // RANGE_SHINGLES))
    found, paths = links(spark, docs, sets, ranges, values, counts)
    linked = components(spark, found)
    discard(spark, *paths)
    by_set = sets.groupBy("set_id").agg(F.min("doc_id").alias("least"))
    by_set = by_set.join(linked.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    by_set, _ = stored(spark, by_set, "components-of-sets")
    least, _ = stored(spark, by_set.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("size")), "least-documents")
    by_set = joined_by_size(by_set, least, ["component"], distinct.sets).select("set_id", "component_id")
    return rows.where("shingle IS NULL").join(by_set, "set_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is the least of their component; all rows of a component without identifiers."""
    kept = join(spark, docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept_id"))
    kept, _ = stored(spark, kept.distinct(), "kept-rows")
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept_id"]), "left_semi")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
