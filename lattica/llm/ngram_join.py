"""N-gram Jaccard self-join by MinHash banding (operator 1).

A text is the set of its N-word shingles (lower-cased words; a text of fewer words is one shingle). Texts
of the same word sequence are one node. Nodes get MinHash signatures whose band and row counts are chosen
for a target recall; the shuffle is on band hashes, where nodes that share a band meet. Buckets with the
same members are looked at once. Within a bucket signatures tell which nodes may be similar; the candidate
groups so found are connected, and all pairs of a group are then verified on their full shingle sets.

Groups over BLOCK nodes are verified by pairs of blocks, one task each, so none has more than two blocks at
once; tasks return counts of links and a spanning forest, never the pairs. What a bucket or a group emits
is in proportion to its members times its blocks.

Result: a row for each row of docs: doc_id, class_id (least doc_id of all documents joined by links, or by
having the same words), node (hash of the word sequence), n_copies (rows with the same words, itself
included), n_links (other texts with a similarity of THRESHOLD or more).

Defined results: null, empty and wordless texts are alone: no links, n_copies 1, class_id their doc_id; a
null doc_id is passed on, and a class of null ids only has class_id null; repeated rows are copies; an empty table
gives an empty table; extra columns are not read. Shingles and nodes are compared by 64-bit hashes.
A text of any length is one row; a task's memory follows the longest text's distinct shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, kernel
from .components import components

N, THRESHOLD, TARGET_RECALL, MAX_HASHES = 5, 0.8, 0.9995, 128
BUCKET_BLOCK, BLOCK = 512, 512
BLOOM_BITS = 1 << 24
SLACK = 4.0  # standard errors by which a signature may fall short of the threshold


def choose_bands(threshold: float, recall: float = TARGET_RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows) with the most rows such that a pair at the threshold shares a band with the recall wanted."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            return bands, rows
    return most, 1


_rng = np.random.default_rng(5)
_A = _rng.integers(1, 1 << 63, MAX_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, MAX_HASHES, dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash) of each shingle in order, and the node of each document (0: no words)."""
    _, _, doc, h = kernel.word_hashes(data, offsets, kernel.ALNUM)
    size = kernel.counts(doc, len(offsets) - 1)
    at, grams = kernel.gram_hashes(h, doc, n)
    owner = doc[at]
    end = np.cumsum(size)
    first = end - size
    p, q = kernel._powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(kernel.mix(h + np.uint64(0x632BE59BD9B4E019)) * p[: len(h)], out=total[1:])
    node = np.where(size > 0, kernel.mix((total[end] - total[first]) * q[first] + size.astype(np.uint64)), np.uint64(0))
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):  # the whole text is the shingle
        owner, grams = np.concatenate([owner, short]), np.concatenate([grams, node[short]])
        order = np.argsort(owner, kind="stable")
        owner, grams = owner[order], grams[order]
    return owner, grams, node


def _signatures(owner: np.ndarray, grams: np.ndarray, n: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(band hashes, 16-bit signatures) of n documents that have a shingle each."""
    starts = np.searchsorted(owner, np.arange(n))
    least = np.empty((n, bands * rows), np.uint64)
    for k in range(bands * rows):
        least[:, k] = np.minimum.reduceat(grams * _A[k] + _B[k], starts)
    band = np.zeros((n, bands), np.uint64)
    for r in range(rows):
        band = band * np.uint64(kernel._P) + least[:, r::rows]
    band = kernel.mix(band + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return band, (kernel.mix(least) >> np.uint64(48)).astype(np.uint16)


NODES = "doc_id long, node long, bands array<long>, sig binary"


def _sign(bands: int, rows: int, n: int):
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in kernel.chunks(batch.column(1)):
                owner, grams, node = shingles(data, offsets, n)
                some = np.flatnonzero(node)
                ids = batch.column(0).slice(a, b - a)
                lists, sigs = [None] * (b - a), [None] * (b - a)
                if len(some):
                    place = np.cumsum(node > 0) - 1
                    band, sig = _signatures(place[owner], grams, len(some), bands, rows)
                    for k, x, y in zip(some.tolist(), band.view(np.int64), sig, strict=True):
                        lists[k], sigs[k] = x, y.tobytes()
                nodes = pa.array(node.view(np.int64), mask=node == 0)
                yield pa.RecordBatch.from_arrays([ids, nodes, pa.array(lists, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], ["doc_id", "node", "bands", "sig"])

    return run


def groups(batches, keys: int) -> Iterator[list[pa.Array]]:
    """Columns of each run of rows whose first key columns are equal; batches come sorted by them."""
    held: list[pa.RecordBatch] = []

    def whole():
        return [c.combine_chunks() for c in pa.Table.from_batches(held).columns]

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)])
        cuts = [*(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        at = 0
        for cut in cuts:
            part = batch.slice(at, cut - at)
            if held and any(held[0].column(k)[0] != part.column(k)[0] for k in range(keys)):
                yield whole()
                held = []
            held.append(part)
            at = cut
    if held:
        yield whole()


def _forest(m: int, similar) -> list[tuple[int, int]]:
    """Spanning forest of m nodes; similar(k, others) tells which of others are linked to k."""
    left, out = np.arange(1, m), []
    queue, root = [0], 0
    while True:
        while queue and len(left):
            k = queue.pop()
            hit = similar(k, left)
            new = left[hit]
            out += [(root, x) for x in new.tolist()]
            queue += new.tolist()
            left = left[~hit]
        if not len(left):
            return out
        root = int(left[0])
        queue, left = [root], left[1:]


def _bucket_edges(cutoff: int):
    def run(batches):
        a_out, b_out = [], []
        for columns in groups(batches, 3):
            nodes = columns[3].to_numpy()
            order = np.argsort(nodes)
            nodes = nodes[order]
            sig = np.frombuffer(b"".join(columns[4].to_pylist()), np.uint16).reshape(len(nodes), -1)[order]
            for x, y in _forest(len(nodes), lambda k, others, sig=sig: (sig[others] == sig[k]).sum(axis=1) >= cutoff):
                a_out.append(nodes[x])
                b_out.append(nodes[y])
            if len(a_out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])
                a_out, b_out = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return run


def _intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets left with the sets right."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    code = (np.cumsum(shared) - 1)[code[keep := shared[code]]]
    owner = owner[keep]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float32)
    width = 8192
    for a in range(0, int(shared.sum()), width):
        x, y = np.searchsorted(code, [a, a + width])
        dense = np.zeros((len(sets), width), np.float32)
        dense[owner[x:y], code[x:y] - a] = 1
        out += dense[left] @ dense[right].T
    return out


def _verify(threshold: float):
    def run(batches):
        for columns in groups(batches, 3):
            i, j = columns[1][0].as_py(), columns[2][0].as_py()
            nodes, side = columns[3].to_numpy(), columns[4].to_numpy()
            order = np.argsort(nodes)
            nodes, side = nodes[order], side[order]
            raw = columns[5].to_pylist()
            sets = [np.frombuffer(raw[k], np.uint64) for k in order.tolist()]
            sizes = np.array([len(s) for s in sets], np.float32)
            left, right = (np.arange(len(nodes)),) * 2 if i == j else (np.flatnonzero(side == i), np.flatnonzero(side == j))
            if not len(left) or not len(right):
                continue
            both = _intersections(sets, left, right)
            # In whole numbers, so that a similarity of just the threshold counts.
            link = both >= np.ceil((sizes[left][:, None] + sizes[right][None, :]) * (threshold / (1 + threshold)) - 1e-4)
            if i == j:
                np.fill_diagonal(link, False)
            full = np.zeros((len(nodes), len(nodes)), bool)
            full[np.ix_(left, right)] = link
            full |= full.T
            n = full.sum(axis=1)
            edges = _forest(len(nodes), lambda k, others, full=full: full[k, others])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([nodes, nodes[[y for _, y in edges]]])), pa.array([*[None] * len(nodes), *(nodes[x] for x, _ in edges)], pa.int64()), pa.array(np.concatenate([n, np.zeros(len(edges), np.int64)]))],
                ["a", "b", "n_links"],
            )

    return run


def _blocked(rows: DataFrame, size: str, node: str, block: int, *more: str) -> DataFrame:
    """Deals groups over block members out: each member goes to the pairs of blocks that its own is in."""
    n = F.ceil(F.col(size) / F.lit(float(block))).cast("int")
    own = F.pmod(F.xxhash64(node), F.col("_n")).cast("int")
    rows = rows.withColumn("_n", n).withColumn("side", F.when(F.col("_n") > 1, own).otherwise(0))
    rows = rows.withColumn("_o", F.explode(F.when(F.col("_n") > 1, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.array(F.lit(0)))))
    return rows.select(*more, F.least("side", "_o").alias("i"), F.greatest("side", "_o").alias("j"), node, "side")


def _bloom(nodes: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """A bit for each hash of a node, in words of 64 bits: a table of fixed size, whatever nodes there are."""
    spot = F.pmod(F.col("node"), F.lit(bits))
    words = nodes.select(F.shiftright(spot, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(node, {bits}) & 63 as int))").alias("v")).groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return out


def _sets(bloom, n: int):
    def run(batches):
        bits, seen = bloom.value, set()
        for batch in batches:
            for _, _, data, offsets in kernel.chunks(batch.column(0)):
                owner, grams, node = shingles(data, offsets, n)
                spot = (node % np.uint64(BLOOM_BITS)).astype(np.int64)
                hit = (node > 0) & ((bits[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1) == 1)
                bounds = np.searchsorted(owner, np.arange(len(node) + 1))
                out = {}
                for k in np.flatnonzero(hit).tolist():
                    key = int(node[k])
                    if key not in seen:
                        seen.add(key)
                        out[key] = np.unique(grams[bounds[k] : bounds[k + 1]]).tobytes()
                if len(seen) > 1_000_000:
                    seen.clear()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(list(out), np.uint64).view(np.int64)), pa.array(list(out.values()), pa.binary())], ["node", "grams"])

    return run


def joined(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = TARGET_RECALL) -> DataFrame:
    """doc_id, class_id, node, n_copies, n_links of each row of docs."""
    return _labelled(docs, threshold, n, recall).drop("label")


def _labelled(docs: DataFrame, threshold: float, n: int, recall: float = TARGET_RECALL) -> DataFrame:
    """joined() with the label of each row's class, which is set and distinct for classes without ids too; null for no words."""
    spark = docs.sparkSession
    common.ship(spark)
    bands, rows = choose_bands(threshold, recall)
    hashes = bands * rows
    cutoff = max(1, math.floor(hashes * threshold - SLACK * math.sqrt(hashes * threshold * (1 - threshold))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    signed = common.written(texts.mapInArrow(_sign(bands, rows, n), NODES), "signed")
    nodes = signed.filter(F.col("node").isNotNull()).groupBy("node").agg(F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    nodes = common.written(nodes, "nodes")

    keyed = nodes.select(F.explode("bands").alias("key"), "node")
    members = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).filter("m > 1")
    members = members.groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key", "m")
    met = _blocked(keyed.join(members, "key"), "m", "node", BUCKET_BLOCK, "key")
    met = met.join(nodes.select("node", "sig"), "node").select("key", "i", "j", "node", "sig")
    edges = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_bucket_edges(cutoff), "a long, b long")

    candidates = common.written(components(edges), "candidates")
    # Written, as in components: a large group's rows are then dealt anew by AQE's skew join.
    sizes = common.written(candidates.groupBy("label").agg(F.count(F.lit(1)).alias("m")), "sizes")
    bloom = spark.sparkContext.broadcast(_bloom(candidates))
    sets = texts.select("text").mapInArrow(_sets(bloom, n), "node long, grams binary")
    members = candidates.join(sizes, "label")
    sets = sets.join(members, "node").groupBy("node", "label", "m").agg(F.first("grams").alias("grams"))
    pairs = _blocked(sets, "m", "node", BLOCK, "label", "grams").select("label", "i", "j", "node", "side", "grams")
    found = common.written(pairs.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j").mapInArrow(_verify(threshold), "a long, b long, n_links long"), "links")

    links = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n_links").alias("n_links"))
    labels = components(found.filter("b is not null").select("a", "b"))
    known = nodes.select("node", "n_copies", "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = common.written(known.groupBy("label").agg(F.min("least").alias("class_id")), "least")
    known = known.join(least, "label").join(links, "node", "left").select("node", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), "label")
    alone = signed.filter(F.col("node").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), "node", F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("label"))
    return signed.filter(F.col("node").isNotNull()).select("doc_id", "node").join(known, "node").select("doc_id", "class_id", "node", "n_copies", "n_links", "label").unionByName(alone)


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """The rows of docs that are first of their class, with their columns; rows without words all stay.

    The first of a class is the row of the least id; of rows with that id, and of a class without ids, one row
    is kept. Ids and nodes of rows to keep are joined to docs by the id, so texts are shuffled once.
    """
    if docs.columns.count("doc_id") != 1:
        raise ValueError("docs has one column doc_id")
    found = common.written(_labelled(docs, threshold, n), "classes")
    # Rows of the least id may have different texts: the least node is kept.
    first = found.filter(F.col("node").isNotNull() & F.col("class_id").eqNullSafe(F.col("doc_id"))).groupBy("label").agg(F.min("doc_id").alias("doc_id"), F.min("node").alias("node"))
    keep = found.filter(F.col("node").isNull()).select("doc_id", "node").distinct().unionByName(first.select("doc_id", "node"))
    id_, node_, row_ = (common.free_name(docs.columns, x) for x in ("keep_id", "keep_node", "row_node"))
    keep = keep.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias(id_), F.coalesce(F.col("node"), F.lit(0)).alias(node_))
    with_node = _with_node(docs, row_, n)
    matched = with_node.join(keep, (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col(id_)) & (F.col(row_) == F.col(node_))).drop(id_, node_)
    # Rows of one id and the same words are copies: one stays. Rows without words (node 0) are no copies.
    unique = F.when(F.col(row_) == 0, F.monotonically_increasing_id()).otherwise(F.lit(-1))
    tie = common.free_name(matched.columns, "tie")
    return matched.withColumn(tie, unique).dropDuplicates(["doc_id", row_, tie]).select(*[F.col(f"`{c}`") for c in docs.columns])


NO_ID = -(1 << 62)


def _with_node(docs: DataFrame, name: str, n: int) -> DataFrame:
    """docs with the node of each row's text; 0 for a text without words."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in kernel.chunks(batch.column(at)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shingles(data, offsets, n)[2].view(np.int64))], [*part.schema.names, name])

    return common.map_rows(docs, run, [T.StructField(name, T.LongType())])


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(common.read(spark, sf_dir, "documents"))
