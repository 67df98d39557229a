"""SimHash near-duplicates (operator 4): fingerprints, exact links within a radius, components.

``fingerprints`` gives each document one 64-bit SimHash of its word shingles. ``near_duplicates`` links
fingerprints that differ in at most ``radius`` bits and labels documents with the smallest id they can reach.

How it scales: equal fingerprints become one row first, so groups of exact copies cost nothing more. The distinct
fingerprints are cut into blocks of bits; two fingerprints within the radius must agree in all bits of one choice
of blocks (pigeonhole), so they meet in one bucket. The number of blocks follows the number of fingerprints, so
buckets stay small; every choice is exact. A bucket beyond ``tile_rows`` is dealt over pairs of tiles, so no task
holds an unbounded group. Within a task the bit-sliced comparison finds links, and at most one a row is given
out, joining each component, never all pairs. Components are found by rounds of large-star and small-star.

``one_of_each_group`` keeps one document of each group for a similarity threshold on the sets of word shingles. A wide
fingerprint only finds candidates (its share of differing bits estimates the angle between the sets): buckets are
samples of its bits, as many as bring a pair at the threshold together with ``recall``, and the radius lies well beyond
the threshold. Texts whose candidates hang together are then compared by their shingle sets themselves, and only pairs
whose Jaccard similarity reaches the threshold are links.

Defined cases: null, empty and white-space texts have fingerprint zero and are linked like any other; fewer words
than a shingle make one shingle of all words; repeated rows and equal texts share a fingerprint; an empty table
gives an empty one; other columns are ignored whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitslice import column_counts, group_labels, large_group, mix64_words
from .components import connected_components, join_groups
from .storage import partitions_for, written
from .textbatch import give_back, slices, texts_of

#: Shingles that are expanded into bit counts at a time.
CHUNK = 1 << 16


#: Ids of rows that are sent to every executor have at most so many bytes together, whatever their type.
MOST_ID_BYTES = 64 << 20
ID_BYTES = lambda c: F.coalesce(F.sum(F.octet_length(F.col(c).cast("string"))), F.lit(0))


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words of the text, A-Z lower-cased, joined by single spaces."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= size:
        starts, stops = [0], [len(joined)]
    else:
        starts, stops = [0, *(ends[: len(words) - size] + 1).tolist()], ends[size - 1 :].tolist()
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in zip(starts, stops)]), ">u8").astype(np.uint64)


def majority(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """The ``words`` x 64 bits that are set in over half of the hashes; zero without hashes."""
    counts = np.zeros(words * 64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        counts += column_counts(mix64_words(hashes[at : at + CHUNK], words))
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) with the fingerprint as a signed long; a narrow step."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            prints = np.concatenate([majority(shingle_hashes(t, shingle)) for t in texts_of(part, text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64))], names=[id_col, "fp"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(hashed, f"`{id_col}` {id_type}, fp long")


def block_choice(prints: int, radius: int, bits: int = 64, rows_per_bucket: int = 64) -> tuple[int, int]:
    """(blocks, agreeing blocks): the fewest blocks whose agreeing ones leave small buckets if bits are even.

    With b blocks and a radius r at least b - r of them agree, so fingerprints meet in one of C(b, b - r) tables.
    """
    for blocks in range(radius + 1, radius + 5):
        agree = blocks - radius
        if prints >> (bits * agree // blocks) <= rows_per_bucket:
            break
    return blocks, agree


def block_keys(blocks: int, agree: int, bits: int = 64) -> list[int]:
    """One mask of bits for each choice of agreeing blocks."""
    edges = [bits * i // blocks for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in itertools.combinations(masks, agree)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


#: Full buckets are sent to every executor up to this number; beyond it they are joined by shuffle.
MANY_FULL = 200_000


def _grouped(rows: DataFrame, full: DataFrame, tile_rows: int) -> DataFrame:
    """Rows (row, tab, key) as (columns of row, grp): one group for each bucket, or for each pair of tiles of a full one.

    ``full``: the buckets (tab, key, m) that may have more than ``tile_rows`` rows, written already. A clash of two
    group numbers only compares more rows.
    """
    group = F.xxhash64("tab", "key")
    n_full = full.count()
    if not n_full:
        return rows.select("row.*", group.alias("grp"))
    tiles = F.greatest(F.lit(1), F.ceil(F.coalesce(F.col("m"), F.lit(1)) / tile_rows)).cast("int")
    rows = rows.join(F.broadcast(full) if n_full <= MANY_FULL else full, ["tab", "key"], "left").select("row", group.alias("grp"), tiles.alias("tiles"))
    tile = F.pmod(F.xxhash64(F.lit("tile"), "row"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.struct(F.least(tile, j).alias("i"), F.greatest(tile, j).alias("j")))
    rows = rows.select("row", "grp", F.explode(pairs).alias("pair"))
    return rows.select("row.*", F.xxhash64("grp", "pair.i", "pair.j").alias("grp"))


#: Groups up to this size are compared many at a time; larger ones are searched one by one, breadth first.
TOGETHER = 1024


def bucket_links(nodes: np.ndarray, prints: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join each component within each group of rows, at most one a row; ``group`` is any key of equal length."""
    order = np.argsort(group, kind="stable")
    nodes, prints, group = nodes[order], prints[order], group[order]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.append(starts, len(group)))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    some = (size > 1) & (size <= TOGETHER)
    if some.any():
        at = np.flatnonzero(np.repeat(some, size))
        label = group_labels(prints[at], np.cumsum(size[some]) - size[some], radius)
        joined = np.flatnonzero(label != np.arange(len(at)))
        left.append(at[joined])
        right.append(at[label[joined]])
    for g in np.flatnonzero(size > TOGETHER).tolist():
        lo = int(starts[g])
        pairs = np.array(list(large_group(prints[lo : lo + int(size[g])], radius)), np.int64).reshape(-1, 2)
        left.append(lo + pairs[:, 0])
        right.append(lo + pairs[:, 1])
    return nodes[np.concatenate(left)], nodes[np.concatenate(right)]


def _batches_to_links(words: int, radius: int):
    """Arrow function over whole partitions of (node, words of the print, group): the links (u, v) between nodes.

    Without a column of nodes, the node of a 64-bit print is the print itself.
    """

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            if b.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        if held:
            columns = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            rows = np.column_stack(columns[-1 - words : -1]).view(np.uint64)
            u, v = bucket_links(columns[0], rows, columns[-1], radius)
            del rows, columns
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
            give_back()

    return linked


def links_within(prints: DataFrame, radius: int, tile_rows: int = 8192, task_rows: int = 400_000) -> DataFrame:
    """Links (u, v) of a forest that joins exactly the fingerprints reachable by steps of at most ``radius`` bits.

    ``prints`` has the distinct fingerprints as column fp and should be cheap to read again.
    """
    spark = prints.sparkSession
    n = prints.count()
    blocks, agree = block_choice(n, radius)
    masks = block_keys(blocks, agree)
    keys = F.array(*[F.struct(F.lit(t).alias("tab"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])
    rows = prints.select(F.struct("fp").alias("row"), F.explode(keys).alias("k")).select("row", "k.tab", "k.key")
    full = written(rows.groupBy("tab", "key").agg(F.count("*").alias("m")).filter(F.col("m") > tile_rows), "full-buckets")
    rows = _grouped(rows, full, tile_rows).repartition(partitions_for(spark, n * len(masks), task_rows), "grp")
    return rows.mapInArrow(_batches_to_links(1, radius), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) for each document."""
    printed = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes = written(printed.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("times")), "print-classes")
    roots = connected_components(links_within(classes.select("fp"), radius))
    label = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first", "times")
    smallest = label.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("degree"))
    n, n_prints = classes.agg(F.coalesce(F.sum("times"), F.lit(0)), F.count("*")).head()
    label = written(join_groups(label, smallest, "root", n_prints).select("fp", "component_id", F.col("times").alias("degree")), "labels")
    return join_groups(printed, label, "fp", n).select(F.col(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shared_bits(similarity: float) -> float:
    """Share of bits in which SimHashes of two sets of this Jaccard similarity agree (sets of equal size)."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def bit_samples(prints: int, bits: int, similarity: float, recall: float, rows_per_bucket: int = 128, least_bits: int = 12, seed: int = 17) -> np.ndarray:
    """(tables, bits of a key): sampled positions; keys grow with the number of fingerprints, tables follow ``recall``.

    A pair at the threshold shares a key of b bits with chance p ** b, so tables grow as a small power of the number
    of fingerprints (0.23 for a similarity of 0.8).
    """
    key_bits = max(least_bits, math.ceil(math.log2(max(prints, 1) / rows_per_bucket + 1)))
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - shared_bits(similarity) ** key_bits)))
    rng = np.random.default_rng(seed)
    order = np.concatenate([rng.permutation(bits) for _ in range(-(-tables * key_bits // bits))])
    return order[: tables * key_bits].reshape(tables, key_bits)


def wide_prints(docs: DataFrame, words: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, node, shingles, print): hash, size and SimHash of ``words`` x 64 bits of the set of shingles; a narrow step."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            nodes, sizes, prints = [], [], []
            for t in texts_of(part, text_col).to_pylist():
                own = np.unique(shingle_hashes(t, shingle))
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), 42))
                sizes.append(len(own))
                prints.append(majority(own, words).tobytes())
            node = pa.array(np.array(nodes, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), node, pa.array(sizes, pa.int64()), pa.array(prints, pa.binary())], names=[id_col, "text_hash", "node", "shingles", "print"])

    return docs.select(F.col(id_col), F.col(text_col), text_key(text_col).alias("text_hash")).mapInArrow(hashed, f"`{id_col}` {id_type}, text_hash long, node long, shingles long, print binary")


def text_key(text_col: str):
    return F.xxhash64(F.lit("text"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _table_keys(prints: pa.Array, samples: np.ndarray) -> np.ndarray:
    """(rows, tables) keys: the sampled bits of each print."""
    raw = np.frombuffer(b"".join(prints.to_pylist()), np.uint8).reshape(len(prints), -1)
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    keys = np.zeros((len(prints), len(samples)), np.int64)
    for k in range(samples.shape[1]):
        keys |= bits[:, samples[:, k]].astype(np.int64) << k
    return keys


def _sampled_keys(samples: np.ndarray, words: int):
    """Arrow function (node, print) to one row for each table: node, the print's first ``words`` words, tab, key."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = len(samples)
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                nodes, prints = (b.column(i).slice(at, 2048) for i in (0, 1))
                n = len(prints)
                take = np.repeat(np.arange(n), tables)
                head = np.frombuffer(b"".join(prints.to_pylist()), np.int64).reshape(n, -1)[:, :words]
                columns = [nodes.to_numpy(zero_copy_only=False)[take], *(head[take, k] for k in range(words)), np.tile(np.arange(tables, dtype=np.int32), n), _table_keys(prints, samples).ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", *(f"p{k}" for k in range(words)), "tab", "key"])

    return keyed


def similar_links(classes: DataFrame, bits: int, similarity: float, words: int = 4, recall: float = 0.999, margin: float = 4.0, tile_rows: int = 8192, task_rows: int = 300_000) -> DataFrame:
    """Links (u, v) that join the places (columns place, print) that may be of sets of at least this ``similarity``.

    Tables of sampled bits of the whole print (``bits`` long) bring places together; there the first ``words`` words
    of their prints are compared. The radius lies ``margin`` standard deviations above the mean distance at that
    similarity, so many that pairs at the threshold are not missed; pairs below it get in as well.
    """
    spark, n = classes.sparkSession, classes.count()
    samples = bit_samples(n, bits, similarity, recall)
    radius = candidate_radius(words, similarity, margin)
    names = ["node", *(f"p{k}" for k in range(words))]
    schema = ", ".join([*(f"{c} long" for c in names), "tab int", "key long"])
    placed = classes.select("place", "print")
    # Sizes of buckets are estimated on a sixteenth of the prints: they only decide how work is dealt, not what is linked.
    some = placed.filter(F.pmod(F.xxhash64(F.lit("size"), "place"), F.lit(16)) == 0).mapInArrow(_sampled_keys(samples, words), schema)
    full = written(some.groupBy("tab", "key").agg((F.count("*") * 16).alias("m")).filter(F.col("m") > tile_rows), "full-buckets")
    rows = placed.mapInArrow(_sampled_keys(samples, words), schema).select(F.struct(*names).alias("row"), "tab", "key")
    rows = _grouped(rows, full, tile_rows).repartition(partitions_for(spark, n * len(samples), task_rows), "grp")
    return rows.mapInArrow(_batches_to_links(words, radius), "u long, v long")


def candidate_radius(words: int, similarity: float, margin: float) -> int:
    """Differing bits of ``words`` x 64 up to which a pair may have this similarity."""
    bits, apart = words * 64, 1 - shared_bits(similarity)
    return int(bits * apart + margin * math.sqrt(bits * apart * (1 - apart)))


def jaccard_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of sets (distinct values each) of at least this Jaccard similarity that join each component, at most one a set.

    Each set is compared with all that are not yet placed, breadth first; sets that are found leave the comparison.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    sets, places = [sets[i] for i in np.flatnonzero(size)], np.flatnonzero(size)
    size = size[places]
    if len(sets) < 2:
        return []
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(size)])
    mine = np.zeros(len(values), bool)
    active, flat, pairs, queue = np.arange(len(sets)), codes, [], []
    while len(active):
        row = queue.pop() if queue else int(active[0])
        gone = active == row
        own = codes[bounds[row] : bounds[row + 1]]
        mine[own] = True
        shared = np.add.reduceat(mine[flat], np.cumsum(size[active]) - size[active], dtype=np.int64)
        mine[own] = False
        near = (shared / (size[row] + size[active] - shared) >= similarity) & ~gone
        found = active[near].tolist()
        pairs += [(int(places[row]), int(places[x])) for x in found]
        queue += found
        gone |= near
        if gone.any():
            flat = flat[np.repeat(~gone, size[active])]
            active = active[~gone]
    return pairs


def _proved(shingle: int, similarity: float):
    """Arrow function over partitions of (grp, node, text) sorted by grp: the links (u, v) between nodes of a group."""

    def links(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.array(jaccard_links(sets, similarity), np.int64).reshape(-1, 2)
        at = np.array(nodes, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(at[pairs[:, 0]]), pa.array(at[pairs[:, 1]])], names=["u", "v"])

    def proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sets = None, {}
        for part in slices(batches):
            out = []
            for g, node, text in zip(*(c.to_pylist() for c in part.columns)):
                if g != group:
                    out.append(links(list(sets), list(sets.values())))
                    group, sets = g, {}
                if node not in sets:
                    sets[node] = np.unique(shingle_hashes(text, shingle))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        if sets:
            yield links(list(sets), list(sets.values()))

    return proved


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, ...) without those whose node the partition has had, so that repeated rows are not shuffled."""
    seen: set[int] = set()
    for b in batches:
        keep = []
        for node in b.column(0).to_pylist():
            keep.append(node not in seen)
            seen.add(node)
        yield b.filter(pa.array(keep, pa.bool_()))


def proved_links(docs: DataFrame, sets: DataFrame, roots: DataFrame, shingle: int, similarity: float, broadcast_rows: int, id_col: str, text_col: str, tile_shingles: int = 1 << 19, task_shingles: int = 1 << 21) -> DataFrame:
    """Links (u, v) that join exactly the sets reachable by steps of at least ``similarity``, within groups of candidates.

    ``sets``: (node, place, shingles, first) with a row of ``docs`` for each distinct set; ``roots``: the groups that the
    places hang together in. A group with more than ``tile_shingles`` is dealt over pairs of tiles.
    """
    sets = sets.join(roots.select(F.col("node").alias("place"), "root"), "place", "left").withColumn("root", F.coalesce("root", "place"))
    sets = written(sets, "sets")
    crowds = sets.groupBy("root").agg(F.count("*").alias("degree"), F.sum("shingles").alias("total")).filter("degree > 1")
    # A group is cut into up to 16 tiles of at least an eighth of ``tile_shingles``, then into full ones.
    tile = F.greatest(F.lit(tile_shingles / 8), F.least(F.lit(float(tile_shingles)), F.col("total") / 16))
    tiles = F.greatest(F.lit(1), F.ceil(F.col("total") / tile)).cast("int").alias("tiles")
    some = written(join_groups(sets, crowds, "root", sets.count()).select("node", "root", tiles, "shingles", F.col("first.id").alias("__id"), F.col("first.h").alias("__h")), "candidates")
    n, total, id_bytes = some.agg(F.count("*"), F.coalesce(F.sum(F.col("shingles") * F.col("tiles")), F.lit(0)), ID_BYTES("__id")).head()
    keyed = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), text_key(text_col).alias("__text_hash"))
    same = keyed[id_col].eqNullSafe(F.col("__id")) & (keyed["__text_hash"] == F.col("__h"))
    rows = keyed.join(F.broadcast(some) if n <= broadcast_rows and id_bytes <= MOST_ID_BYTES else some, same).select("node", "root", "tiles", "text")
    rows = rows.mapInArrow(_once, rows.schema)
    tile = F.pmod(F.xxhash64(F.lit("tile"), "node"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.struct(F.least(tile, j).alias("i"), F.greatest(tile, j).alias("j")))
    rows = rows.select("root", "node", "text", F.explode(pairs).alias("pair")).select(F.xxhash64("root", "pair.i", "pair.j").alias("grp"), "node", "text")
    rows = rows.repartition(partitions_for(docs.sparkSession, total, task_shingles), "grp").sortWithinPartitions("grp")
    return rows.mapInArrow(_proved(shingle, similarity), "u long, v long")


def one_of_each_group(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, words: int = 12, drop_broadcast: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: of each group the row with the smallest id stays.

    Groups are linked by steps of at least ``similarity`` between sets of ``shingle``-word shingles, each step measured
    on the sets. Of the texts only one for each distinct set that has candidates is shuffled, while the candidates and
    the rows to drop number at most ``drop_broadcast`` each; beyond that texts are joined by shuffle.
    """
    prints = written(wide_prints(docs, words, shingle, id_col, text_col).withColumn("place", F.xxhash64("print")), "wide-prints")
    classes = written(prints.groupBy("place").agg(F.min("print").alias("print")), "wide-classes")
    near = connected_components(similar_links(classes, words * 64, similarity))
    sets = prints.groupBy("node", "place").agg(F.min("shingles").alias("shingles"), F.min(F.struct(F.col(id_col).alias("id"), F.col("text_hash").alias("h"))).alias("first"))
    roots = connected_components(proved_links(docs, sets, near, shingle, similarity, drop_broadcast, id_col, text_col))
    grouped = prints.select(id_col, "text_hash", "node").join(roots, "node", "left").select(id_col, "text_hash", F.coalesce("root", "node").alias("root"))
    rows = written(grouped.groupBy(id_col, "text_hash", "root").agg(F.count("*").alias("times")), "roots")
    # The row that stays: the smallest (id, text hash); a minimum is combined before the shuffle, however large the group.
    first = rows.groupBy("root").agg(F.min(F.struct(F.col(id_col).alias("id"), F.col("text_hash").alias("h"))).alias("first"), F.count("*").alias("degree"))
    stays = F.col(id_col).eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.h"))
    marked = written(join_groups(rows, first, "root", rows.count()).select(id_col, "text_hash", stays.alias("stays"), "times").filter(~F.col("stays") | (F.col("times") > 1)), "near-copies")
    n_marked, n_again, id_bytes = marked.agg(F.count("*"), F.count(F.when(F.col("stays"), 1)), ID_BYTES(id_col)).head()
    if not n_marked:
        return docs
    small = F.broadcast if n_marked <= drop_broadcast and id_bytes <= MOST_ID_BYTES else lambda x: x
    key = "__text_hash"
    keyed = docs.withColumn(key, text_key(text_col))
    marks = small(marked.select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__h"), "stays"))
    same = keyed[id_col].eqNullSafe(F.col("__id")) & (keyed[key] == F.col("__h"))
    out = keyed.join(marks.drop("stays"), same, "left_anti").drop(key)
    if n_again:  # repeated rows of a document that stays: the smallest by all columns
        again = keyed.join(marks.filter("stays").drop("stays"), same, "left_semi")
        if "map<" in docs.schema.simpleString():  # maps have no order: one of the rows
            again = again.dropDuplicates([id_col, key]).drop(key)
        else:
            again = again.groupBy(id_col, key).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("__row")).select("__row.*")
        out = out.unionByName(again)
    return out
