"""N-gram Jaccard self-join of documents: MinHash banding, then verification on full n-gram sets.

1. Each text gives two keys of its word sequence and the band hashes of its MinHash
   values. Texts of the same keys are copies: they are one node with a count.
2. Nodes that share a band hash meet in a bucket. A node's label is the least node of all
   its buckets, and nodes of one label are a block, cut into several where they are many.
   Two blocks are compared only if some bucket has nodes of both, and every pair of
   blocks once, however many buckets they share.
3. The n-gram sets are shuffled once, to their block. The task of a block compares all of
   it, hands on counts of links and a spanning forest, and, if other blocks have to be
   compared with it, leaves its sets in the shared folder, from where their task reads
   them: what is shuffled is a multiple of the sets, whatever the size of a group.
4. Components of the forests' links are the classes.

Every pair that shares a bucket is verified on its full sets, as is any other pair of the
compared blocks, so the recall is at least that of the bands.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm import store
from concord.llm.components import connected_components
from concord.llm.shared import cut, dealt_anew, free_name, remove, remove_folder, shared_dir, with_mapped
from concord.llm.words import mix, ragged_binary, sequence_keys, shingles, text_chunks, word_hashes

#: Nodes of a block, and n-grams of all of them, to be expected at most.
BLOCK, BLOCK_GRAMS = 1024, 1 << 20
#: Bytes up to which a block goes with the pairs that it is in; a larger one is read from the shared folder.
INLINE = 1 << 14


def choose_bands(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """(bands, rows) of at most ``most`` hashes that find a pair at the threshold with at least this probability.

    Of those, the one for which a pair at half the threshold is least likely to meet.
    """
    fits = [
        (1 - (1 - (threshold / 2) ** r) ** b, b, r)
        for r in range(1, 17)
        for b in [max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**r)))]
        if b * r <= most
    ]
    if not fits:
        raise ValueError("no banding of so few hashes has this recall")
    _, b, r = min(fits)
    return b, r


def _hash_family(k: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(977)
    return draw.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1), draw.integers(0, 1 << 32, k, dtype=np.uint32)


def minhashes(grams: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """MinHash values, uint32 [texts, k]; a text without n-grams has the largest value everywhere."""
    a, b = _hash_family(k)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full((len(at) - 1, k), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        for j in range(k):
            out[some, j] = np.minimum.reduceat(x * a[j] + b[j], at[some])
    return out


def _describe(n: int, bands: int, rows: int, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, column = batch.column(0), batch.column(1)
        for first, b, offsets in text_chunks(column):
            words, at = word_hashes(b, offsets)
            key, twin = _keys(words, at, bits)
            grams, grams_at = shingles(words, at, n)
            low = minhashes(grams, grams_at, bands * rows)
            count = len(at) - 1
            hashes = np.empty((count, bands), np.uint64)
            for j in range(bands):
                h = np.full(count, j + 1, np.uint64)
                for r in range(rows):
                    h = mix(h ^ (low[:, j * rows + r].astype(np.uint64) + np.uint64(0x9E3779B9)))
                hashes[:, j] = h
            has = np.diff(at) > 0
            lists = np.where(has, bands, 0)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(first, count),
                    pa.array(key, mask=~has),
                    pa.array(twin, mask=~has),
                    pa.array(np.diff(grams_at).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lists)]).astype(np.int32)), pa.array(hashes[has].reshape(-1).view(np.int64))),
                ],
                ["doc_id", "key", "twin", "weight", "bands"],
            )


def _keys(words: np.ndarray, at: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Two keys of each text's words, of which the first has so many bits; fewer than 64 are for tests of what happens where keys agree by chance."""
    key, twin = sequence_keys(words, at)
    return (key >> np.uint64(64 - bits)).view(np.int64), twin.view(np.int64)


def _with_keys(names: list[str], bits: int, drop: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with both keys of the last column, a text; null without words. ``drop``: without such rows."""
    for batch in batches:
        keys, twins = [], []
        for _, b, offsets in text_chunks(batch.column(batch.num_columns - 1)):
            words, at = word_hashes(b, offsets)
            empty = np.diff(at) == 0
            for out, x in zip((keys, twins), _keys(words, at, bits), strict=True):
                out.append(pa.array(x, mask=empty))
        none = [pa.array([], pa.int64())]
        out = pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays(keys or none), pa.concat_arrays(twins or none)], [*batch.schema.names, *names])
        yield out.filter(out.column(names[0]).is_valid()) if drop else out


def forest(near: np.ndarray) -> np.ndarray:
    """Labels of the components of square boolean matrices [groups, n, n]: the least index of each."""
    m, n, _ = near.shape
    labels = np.broadcast_to(np.arange(n, dtype=np.int32), (m, n)).copy()
    near = near | near.transpose(0, 2, 1) | np.eye(n, dtype=bool)
    while True:
        least = np.where(near, labels[:, None, :], n).min(axis=2)
        least = np.take_along_axis(least, least, axis=1)
        if (least == labels).all():
            return labels
        labels = least


def _sets(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with the last column, a text, as its sorted distinct n-gram hashes."""
    for batch in batches:
        for first, b, offsets in text_chunks(batch.column(batch.num_columns - 1)):
            words, at = word_hashes(b, offsets)
            grams, grams_at = shingles(words, at, n)
            sets = [np.unique(grams[i:j]) for i, j in zip(grams_at[:-1], grams_at[1:], strict=True)]
            columns = [batch.column(j).slice(first, len(sets)) for j in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, ragged_binary(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64))],
                [*batch.schema.names[:-1], "grams"],
            )


#: Columns of the membership matrix that are multiplied at a time.
_WIDTH = 4096


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of the other."""
    out = np.zeros((len(left), len(right)), np.float32)
    if len(left) * len(right) <= 16:
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                out[i, j] = len(np.intersect1d(x, y, assume_unique=True))
        return out.astype(np.int64)
    sides = []
    if left is right:  # an n-gram of one set only is in no intersection
        values, times = np.unique(np.concatenate(left), return_counts=True)
        both = values[times > 1]
    else:
        both = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    for sets in (left,) if left is right else (left, right):
        values = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        place = np.minimum(np.searchsorted(both, values), max(len(both) - 1, 0))
        known = both[place] == values if len(both) else np.zeros(len(values), bool)
        place, owner = place[known], owner[known]
        order = np.argsort(place, kind="stable")
        sides.append((place[order], owner[order]))
    for low in range(0, len(both), _WIDTH):
        parts, width = [], min(_WIDTH, len(both) - low)
        for (place, owner), sets in zip(sides, (left, right), strict=False):
            i, j = np.searchsorted(place, [low, low + width])
            m = np.zeros((len(sets), width), np.float32)
            m[owner[i:j], place[i:j] - low] = 1
            parts.append(m)
        out += parts[0] @ parts[-1].T
    if left is right:
        np.fill_diagonal(out, [len(x) for x in left])
    return np.rint(out).astype(np.int64)


def _linked(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    same = common(left, right)
    sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    return same >= threshold * (sizes - same) - 1e-9


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list, list, list]]:
    """(block, partners, nodes, copies, sets) of each run of rows of a block; a node that rows repeat is one."""
    held = None
    for batch in batches:
        grams = batch.column(4)
        for i, (block, partners, node, copies) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)):
            if held is None or held[0] != block:
                if held is not None:
                    yield held
                held = (block, partners, [], [], [])
            if not held[2] or held[2][-1] != node:
                held[2].append(node)
                held[3].append(copies)
                held[4].append(np.frombuffer(grams[i].as_py(), np.uint64))
    if held is not None:
        yield held


def _pack(nodes: np.ndarray, copies: np.ndarray, labels: np.ndarray, sets: list[np.ndarray]) -> bytes:
    head = np.concatenate([[len(nodes)], nodes, copies, labels, [len(x) for x in sets]]).astype("<i8")
    return head.tobytes() + np.concatenate(sets).astype("<u8").tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    m = int(np.frombuffer(data, "<i8", 1)[0])
    nodes, copies, labels, sizes = np.frombuffer(data, "<i8", 4 * m, 8).reshape(4, m)
    return nodes, copies, labels, np.split(np.frombuffer(data, "<u8", -1, 8 * (4 * m + 1)), np.cumsum(sizes)[:-1])


_FOUND = "u long, v long, links long"
_STORED = "block long, file string, at long, size long, data binary"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def _within(threshold: float, folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the nodes of each block, and for blocks with partners where their sets are."""
    file = stream = None
    at, out, held = 0, [], 0
    for block, partners, nodes, copies, sets in _blocks(batches):
        nodes, copies = np.array(nodes), np.array(copies)
        labels = np.zeros(len(nodes), np.int64)
        if len(nodes) > 1:
            linked = _linked(sets, sets, threshold)
            np.fill_diagonal(linked, False)
            labels = forest(linked[None])[0].astype(np.int64)
            count = linked.astype(np.int64) @ copies
            some, apart = np.flatnonzero(count), np.flatnonzero(labels != np.arange(len(nodes)))
            out += [(u, -1, w, None, None, None, None, None) for u, w in zip(nodes[some].tolist(), count[some].tolist(), strict=True)]
            out += [(u, v, 0, None, None, None, None, None) for u, v in zip(nodes[apart].tolist(), nodes[labels[apart]].tolist(), strict=True)]
        if partners:
            data = _pack(nodes, copies, labels, sets)
            if len(data) <= INLINE:
                held += len(data)
                out.append((None, None, None, block, None, 0, len(data), data))
            else:
                if stream is None:
                    file = store.new_file(folder, ".sets")
                    stream = store.create(file)
                stream.write(data)
                out.append((None, None, None, block, file, at, len(data), None))
                at += len(data)
        if len(out) > 10_000 or held > 1 << 22:
            yield _batch(out, f"{_FOUND}, {_STORED}")
            out, held = [], 0
    if stream is not None:
        stream.close()
    if out:
        yield _batch(out, f"{_FOUND}, {_STORED}")


def _across(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the nodes of two blocks: rows with file, at, size and data of either."""

    @lru_cache(2)
    def stored(file: str, at: int, size: int) -> tuple:
        with store.open_file(file) as f:
            return _unpack(f.read_at(size, at))

    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            sides = [_unpack(r[f"{s}_data"]) if r[f"{s}_data"] is not None else stored(r[f"{s}_file"], r[f"{s}_at"], r[f"{s}_size"]) for s in "ab"]
            (left, left_copies, left_labels, left_sets), (right, right_copies, right_labels, right_sets) = sides
            linked = _linked(left_sets, right_sets, threshold)
            if not linked.any():
                continue
            for nodes, count in ((left, linked.astype(np.int64) @ right_copies), (right, linked.T.astype(np.int64) @ left_copies)):
                some = np.flatnonzero(count)
                out += [(u, -1, w) for u, w in zip(nodes[some].tolist(), count[some].tolist(), strict=True)]
            # of nodes that are connected within a block, one stands for all
            (one, one_of), (other, other_of) = (np.unique(x, return_inverse=True) for x in (left_labels, right_labels))
            square = np.zeros((1, len(one) + len(other), len(one) + len(other)), bool)
            x, y = np.nonzero(linked)
            square[0, one_of[x], len(one) + other_of[y]] = True
            ends = np.concatenate([left[one], right[other]])
            labels = forest(square)[0]
            apart = np.flatnonzero(labels != np.arange(len(ends)))
            out += [(u, v, 0) for u, v in zip(ends[apart].tolist(), ends[labels[apart]].tolist(), strict=True)]
        if out:
            yield _batch(out, _FOUND)


def ngram_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id, class_size, n_links.

    Two documents are linked if the sets of runs of ``n`` words of their texts have a
    Jaccard similarity of at least ``threshold``; copies of one word sequence always
    are. n_links counts a row's links to other rows, class_id is the least doc_id of
    the rows connected by links, class_size their number. Bands are chosen for
    ``recall`` of a pair exactly at the threshold; no bucket is capped.

    Null and empty texts, and texts without a letter or digit, have no n-grams: each
    is a class of its own with its own doc_id and no links. A text of fewer than ``n``
    words has all of them as its only n-gram. Repeated rows are copies of each other
    and stay. A null doc_id is kept and is a class's id only where no row has another.
    Other columns of ``docs`` are ignored. An empty table gives an empty result.
    """
    return _classified(docs, n, threshold, recall).select("doc_id", "class_id", "class_size", "n_links")


def _described(docs: DataFrame, n: int, bands: int, rows: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their node, nodes): a node is one sequence of words, known by both of its keys."""
    schema = "doc_id long, key long, twin long, weight long, bands array<long>"
    described = cut(docs.mapInArrow(lambda it: _describe(n, bands, rows, bits, it), schema).withColumn("node", F.col("key")), "described")

    def grouped(df: DataFrame) -> DataFrame:
        parts = [F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("key").alias("key"), F.min("twin").alias("twin"), F.max("twin").alias("other"), F.max("weight").alias("weight"), F.min("bands").alias("bands")]
        return cut(df.where("node IS NOT NULL").groupBy("node").agg(*parts), "nodes")

    nodes = grouped(described)
    clash = nodes.where("twin <> other").select("node", F.col("twin").alias("first"))
    if not clash.isEmpty():  # different words of one first key: all but one get a node of both keys
        apart = F.when(F.col("twin") != F.col("first"), F.xxhash64("key", "twin")).otherwise(F.col("node"))
        described = cut(described.join(dealt_anew(clash, "node"), "node", "left").withColumn("node", apart).drop("first"), "described")
        nodes = grouped(described)
        if not nodes.where("twin <> other").isEmpty():
            raise RuntimeError("the keys of different texts agree")
    return described, nodes


def _in_blocks(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, block) of the nodes that share a bucket, (a, b): the pairs of blocks that share one)."""
    met = nodes.select("node", F.explode("bands").alias("band"))
    shared = met.groupBy("band").agg(F.count("*").alias("members"), F.min("node").alias("least")).where("members > 1").select("band", "least")
    met = cut(met.join(dealt_anew(shared, "band"), "band"), "buckets")
    labelled = cut(met.groupBy("node").agg(F.min("least").alias("label")).join(nodes.select("node", "weight"), "node"), "labels")
    sizes = labelled.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("weight") / F.lit(BLOCK_GRAMS))).alias("parts"))
    own = F.when(F.col("parts") <= 1, F.col("label")).otherwise(F.xxhash64("label", F.pmod(F.xxhash64("node", "label"), F.col("parts"))))
    blocks = cut(labelled.join(dealt_anew(sizes, "label"), "label").select("node", own.alias("block")), "blocks")
    seen = met.select("node", "band").join(blocks, "node").select("band", "block").distinct()
    several = seen.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    seen = cut(seen.join(dealt_anew(several, "band"), "band"), "met")
    pairs = seen.withColumnRenamed("block", "a").join(seen.select(F.col("band").bitwiseXOR(F.lit(0).cast("long")).alias("band"), F.col("block").alias("b")), "band")
    pairs = cut(pairs.where("a < b").select("a", "b").distinct(), "pairs")
    remove(met, labelled, seen)
    return blocks, pairs


def _links(docs: DataFrame, nodes: DataFrame, n: int, threshold: float, bits: int) -> DataFrame:
    """(u, v, links): counts of links of node u where v is -1, and with links 0 a forest of linked nodes."""
    spark = docs.sparkSession
    blocks, pairs = _in_blocks(nodes)
    ends = pairs.select(F.col("a").alias("block")).unionByName(pairs.select(F.col("b").alias("block"))).groupBy("block").agg(F.count("*").alias("partners"))
    wanted = blocks.join(dealt_anew(ends, "block"), "block", "left").join(nodes.select("node", "rep", "copies", "key", "twin"), "node")
    # the text of a node is that of a row with its least doc_id and both of its keys
    named = docs.withColumnRenamed("doc_id", "text_of")
    keyed = named.mapInArrow(lambda it: _with_keys(["key", "twin"], bits, True, it), "text_of long, text string, key long, twin long")
    wanted = wanted.select("block", F.coalesce("partners", F.lit(0).cast("long")).alias("partners"), "node", "copies", "rep", F.col("key").alias("own_key"), F.col("twin").alias("own_twin"))
    same = (F.col("key") == F.col("own_key")) & (F.col("twin") == F.col("own_twin")) & F.col("rep").eqNullSafe(F.col("text_of"))
    texts = wanted.join(keyed, same).select("block", "partners", "node", "copies", "text")
    sets = texts.mapInArrow(lambda it: _sets(n, it), "block long, partners long, node long, copies long, grams binary")
    folder = shared_dir(spark, "sets")
    dealt = sets.repartition("block").sortWithinPartitions("block", "node")
    found = cut(dealt.mapInArrow(lambda it: _within(threshold, folder, it), f"{_FOUND}, {_STORED}"), "within")
    links = found.where("u IS NOT NULL").select("u", "v", "links")
    count = pairs.count()
    if not count:
        return links
    stored = found.where("block IS NOT NULL")
    side = lambda s: stored.select(F.col("block").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("file", "at", "size", "data")))
    # comparing takes far longer than moving, so tasks are made by the number of pairs, not by their bytes
    tasks = min(max(spark.sparkContext.defaultParallelism, count // 64), 50_000)
    both = pairs.join(side("a"), "a").join(side("b"), "b").repartition(tasks, "a", F.pmod(F.xxhash64("b"), F.lit(16))).sortWithinPartitions("a_file", "a_at", "a", "b")
    across = cut(both.mapInArrow(lambda it: _across(threshold, it), _FOUND), "across")
    remove(blocks, pairs)
    remove_folder(spark, folder)
    return links.unionByName(across)


def _classified(docs: DataFrame, n: int, threshold: float, recall: float, bits: int = 64) -> DataFrame:
    """The rows of ngram_classes() with node, the text's words, and head, the node that stands for the class; both null without n-grams."""
    bands, rows = choose_bands(threshold, recall)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described, nodes = _described(docs, n, bands, rows, bits)
    found = _links(docs, nodes, n, threshold, bits)
    links = found.where("v = -1 AND links > 0").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    classes = connected_components(found.where("links = 0").select("u", "v"))
    per_node = (
        nodes.select("node", "rep", "copies")
        .join(classes, "node", "left")
        .join(links, "node", "left")
        .select("node", "rep", "copies", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node"))
    heads = per_node.groupBy("component").agg(first.alias("first"), F.sum("copies").alias("class_size"))
    heads = heads.select("component", F.col("first.rep").alias("class_id"), F.col("first.node").alias("head"), "class_size")
    per_node = per_node.join(dealt_anew(heads, "component"), "component").select("node", "head", "class_id", "class_size", "n_links")
    return (
        described.select("doc_id", "node", "key", "twin")
        .join(per_node, "node", "left")
        .select(
            "doc_id",
            F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("class_size", F.lit(1)).alias("class_size"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            "node",
            "head",
            "key",
            "twin",
        )
    )


def drop_near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one document of each class of ngram_classes(): that with the least doc_id.

    All columns are kept, whatever their names. Where that doc_id is on several rows of
    the class, the first of them by words and text stays. A doc_id on rows of several
    classes is a document of each of them. A row with a null doc_id stays only where its
    class has no other id. Rows without a letter or digit have no class and stay.
    """
    classes = cut(_classified(docs, n, threshold, 0.999), "classes")
    stays = F.col("node").isNull() | ((F.col("node") == F.col("head")) & F.col("doc_id").eqNullSafe(F.col("class_id")))
    counted = classes.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(stays).alias("kept"))
    gone, again = counted.where("rows = 1 AND NOT kept").select("doc_id"), counted.where("rows > 1").select("doc_id")
    own, other, key, twin, row = (free_name(docs, x) for x in ("own_id", "other_id", "key", "twin", "row"))
    named = docs.withColumn(own, F.col("doc_id").cast("long"))
    known = named.where(F.col(own).isNotNull())
    ids = lambda x: dealt_anew(x, "doc_id").withColumnRenamed("doc_id", other)
    match = F.col(own) == F.col(other)
    once = known.join(ids(gone), match, "left_anti").join(ids(again), match, "left_anti").drop(own)
    unsure = named.where(F.col(own).isNull()).unionByName(known.join(ids(again), match, "left_semi"))
    if unsure.isEmpty():
        return once
    # rows of one doc_id, or of none, are told apart by the keys of their words
    fields = [T.StructField(x, T.LongType()) for x in (key, twin)]
    keyed = with_mapped(unsure, F.col("text").cast("string"), lambda it: _with_keys([key, twin], 64, False, it), *fields)
    of = [free_name(docs, f"{x}_of") for x in ("id", "key", "twin")]
    kept = classes.where(F.col("node").isNotNull() & stays).select(*(F.col(c).alias(n) for c, n in zip(("doc_id", "key", "twin"), of, strict=True))).distinct()
    same = F.col(own).eqNullSafe(F.col(of[0])) & (F.col(key) == F.col(of[1])) & (F.col(twin) == F.col(of[2]))
    order = Window.partitionBy(own, key, twin).orderBy("text")
    first = keyed.join(kept, same, "left_semi").withColumn(row, F.row_number().over(order)).where(F.col(row) == 1)
    names = [F.col(f"`{c}`") for c in docs.columns]
    return once.unionByName(keyed.where(F.col(key).isNull()).select(*names)).unionByName(first.select(*names))
