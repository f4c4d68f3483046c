"""N-gram Jaccard join by PartEnum signatures (operator 1).

A document is the set of its distinct word 5-grams.  Two sets of sizes a and b
with Jaccard similarity >= 0.8 differ in at most (a + b) / 9 elements.  Sizes
are cut into bands so that such a pair lies in one band or two neighbouring
ones, which bounds the difference by one k per band.  PartEnum splits the
domain of elements by hash into groups, each group into three parts, and signs
every pair of parts: with more than k / 2 groups some group holds at most one
difference, so two of its three parts agree and the pair shares a signature.
No similar pair is missed.

Signatures whose parts are empty say nothing and are left out; two groups more
than needed make a similar pair share three signatures, two at least after
documents with one such group have left it out, and the few documents with more
write their empty signatures too.  Small sets have one such group, or none, and
sign everything twice.  So a pair that shares one signature only is no candidate.

Candidates are pruned by an exact bound (a parity bitmap of the set: its
Hamming distance never exceeds the sets' difference, folded or not) and then verified on the
sets themselves.  Large signature groups are not expanded into pairs: a few
pivots link most members, and only members still in different components are
compared, in blocks, inside tasks that return links only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import _text as T
from ._graph import connected_components

WORDS = 5
PARTS = 3
#: From this difference on, two groups more than needed are signed.
TWO_SPARE = 8
#: Signature groups up to this size give all their pairs as candidates.
SMALL_GROUP = 6
#: Members of a larger signature group that one task compares with each other.
BLOCK = 2048

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = T.byte_table(lower=True)


def bands(largest: int) -> tuple[np.ndarray, np.ndarray]:
    """(lower, k): lower[c] is the smallest size in band c; k[c] bounds the
    difference of a similar pair whose smaller set lies in band c - 1 or whose
    sets both do."""
    lower = [1, 2]
    while lower[-1] <= largest:
        lower.append(max(lower[-1] + 1, 5 * (lower[-1] - 1) // 4 + 1))
    lower += [max(lower[-1] + 1, 5 * (lower[-1] - 1) // 4 + 1)]
    at = np.array(lower, np.int64)
    top = at - 1
    return at, (top + 5 * top // 4) // 9


def shingle_sets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(elements, bounds): the sorted distinct 52-bit shingle hashes of each text.

    Fewer than five words are one shingle together; no word gives no element.
    """
    starts, ends = T.runs(~_GAP[buf], off)
    words = T.span_hashes(_BYTE[buf], starts, ends)
    at = np.searchsorted(starts, off)
    counts = np.diff(at)
    n = np.maximum(counts - WORDS + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts), dtype=np.uint64), n)
    first = T.ragged(at[:-1], n)
    length = np.minimum(counts, WORDS)[doc.astype(np.int64)]
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    value = length.astype(np.uint64)
    for j in range(WORDS):
        value = np.where(j < length, value * np.uint64(0xC2B2AE3D27D4EB4F) + padded[first + j], value)
    keys = (doc << np.uint64(52)) | (T.mix(value) >> np.uint64(12))
    keys.sort()
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    bounds = np.searchsorted(keys, np.arange(len(counts) + 1, dtype=np.uint64) << np.uint64(52)) if len(counts) < 4096 else None
    return keys & np.uint64((1 << 52) - 1), bounds


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def nodes(elements: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    return _sums(T.mix(elements), bounds).view(np.int64)


def bitmap_bits(n: int) -> int:
    """Bits of the parity bitmap of a set of n elements: a power of two."""
    return max(64, 1 << int(np.ceil(np.log2(max(1, 5 * n // 2)))))


def _bitmaps(elements: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    sizes = np.diff(bounds)
    bits = np.array([bitmap_bits(int(n)) for n in sizes], np.int64)
    at = np.concatenate([[0], np.cumsum(bits)])
    place = np.repeat(at[:-1], sizes) + (elements & (np.repeat(bits, sizes) - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(place, minlength=int(at[-1])) & 1).astype(np.uint8)
    packed = np.packbits(odd, bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(at[:-1], at[1:], strict=True)]


#: node: a 64-bit hash of the set, so equal sets are one node.
SKETCH = "doc_id long, n_shingles long, node long, bitmap binary"


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in T.chunks(batches):
        elements, bounds = shingle_sets(*T.buffer(T.column(batch, "text")))
        n = np.diff(bounds)
        maps = _bitmaps(elements, bounds)
        yield pa.record_batch(
            [
                T.column_raw(batch, "doc_id"),
                pa.array(n),
                pa.array(nodes(elements, bounds)),
                pa.array([folded([b], min(8 * len(b), max(1024, 2 * len(b)))).tobytes() for b in maps], pa.binary()),
            ],
            names=["doc_id", "n_shingles", "node", "bitmap"],
        )


def signatures(elements: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, text): the PartEnum signatures of each set, in both bands it takes part in."""
    sizes = np.diff(bounds)
    if not len(elements):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lower, k = bands(int(sizes.max()))
    band = np.searchsorted(lower, sizes, "right") - 1
    out, owner = [], []
    mixed = T.mix(elements ^ np.uint64(0x2545F4914F6CDD1D))
    spread = (elements >> np.uint64(20)).astype(np.int64)
    part = (elements & np.uint64(0xFFFFF)).astype(np.int64) % PARTS
    for step in (0, 1):
        of = np.where(sizes > 0, band + step, 0)
        spare = np.where(k[of] >= TWO_SPARE, 2, np.where(k[of] >= 2, 1, 0))
        groups = np.where((sizes > 0) & (k[of] > 0), k[of] // 2 + 1 + spare, 0)  # sets without a difference are one node
        at = np.concatenate([[0], np.cumsum(groups)])
        group = np.repeat(at[:-1], sizes) + spread % np.repeat(np.maximum(groups, 1), sizes)
        cell = group * PARTS + part
        hashes = np.zeros(int(at[-1]) * PARTS, np.uint64)
        signed = np.repeat(groups > 0, sizes)
        cell = cell[signed]
        np.add.at(hashes, cell, mixed[signed])
        filled = np.bincount(cell, minlength=len(hashes)).reshape(-1, PARTS)
        hashes = hashes.reshape(-1, PARTS)
        empty = (filled.sum(1)[:, None] - filled) == 0
        text = np.repeat(np.arange(len(sizes)), groups)
        weak = np.bincount(text[empty.any(1)], minlength=len(sizes))
        keep = ~empty | (weak > np.minimum(spare, 1))[text][:, None]
        name = (np.repeat(of, groups).astype(np.uint64) << np.uint64(40)) + (np.arange(len(text)) - at[text]).astype(np.uint64) * np.uint64(PARTS)
        sign = T.mix((hashes.sum(1)[:, None] - hashes) + T.mix(name[:, None] + np.arange(PARTS, dtype=np.uint64)))
        own = np.repeat(text[:, None], PARTS, 1)[keep]
        once = spare[own] < 2  # signed twice, so that one shared signature counts as two
        out += [sign[keep], T.mix(sign[keep][once])]
        owner += [own, own[once]]
    return np.concatenate(out), np.concatenate(owner)


PACKED = "p int, docs binary, counts binary, signs binary"


def _packed(n_parts: int):
    """Signatures, with the copies of a set that one task meets signed once, dealt
    into rows of one part of the signature space each."""

    def pack(ids: np.ndarray, signs: np.ndarray) -> Iterator[pa.RecordBatch]:
        p = ((signs >> np.uint64(32)) % np.uint64(n_parts)).astype(np.int64)
        order = np.lexsort((ids, p))
        p, ids, signs = p[order], ids[order], signs[order].astype(np.uint32)
        cut = np.searchsorted(p, np.arange(n_parts + 1))
        rows = {"p": [], "docs": [], "counts": [], "signs": []}
        for i in np.flatnonzero(np.diff(cut)):
            own = slice(cut[i], cut[i + 1])
            docs, counts = np.unique(ids[own], return_counts=True)
            rows["p"].append(i)
            rows["docs"].append(docs.tobytes())
            rows["counts"].append(counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes())
            rows["signs"].append(signs[own].tobytes())
        yield pa.record_batch([pa.array(rows["p"], pa.int32()), *(pa.array(rows[c], pa.binary()) for c in ("docs", "counts", "signs"))], names=list(rows))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, n = [], 0
        for batch in T.chunks(batches):
            elements, bounds = shingle_sets(*T.buffer(T.column(batch, "text")))
            ids = nodes(elements, bounds)
            fresh = np.zeros(len(ids), bool)
            for i, h in enumerate(ids.tolist()):
                if h not in seen:
                    seen.add(h)
                    fresh[i] = True
            if len(seen) > 500_000:
                seen.clear()
            signs, owner = signatures(elements, bounds)
            keep = fresh[owner]
            held.append((ids[owner[keep]], signs[keep]))
            n += int(keep.sum())
            if n > 1_500_000:
                yield from pack(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield from pack(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return work


GROUPED = "a long, b long, sign long, g int"


def _grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, null, g): pairs that share g signatures, or that are candidates anyway if g is 2.
    Rows (a, null, sign, g): members of larger groups, of g members each."""

    def solve(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([np.repeat(np.frombuffer(d, np.int64), np.frombuffer(c, np.uint8 if 8 * len(c) == len(d) else np.uint32)) for d, c, _ in held])
        signs = np.concatenate([np.frombuffer(s, np.uint32) for _, _, s in held])
        order = np.lexsort((ids, signs))
        ids, signs = ids[order], signs[order]
        once = np.concatenate([[True], (signs[1:] != signs[:-1]) | (ids[1:] != ids[:-1])])
        ids, signs = ids[once], signs[once]
        new = np.concatenate([[True], signs[1:] != signs[:-1], [True]])
        at = np.flatnonzero(new)
        size = np.diff(at)
        pairs = []
        for g in range(2, SMALL_GROUP + 1):
            own = ids[at[:-1][size == g][:, None] + np.arange(g)]
            pairs += [own[:, [i, j]] for i in range(g) for j in range(i)]
        n_small = sum(map(len, pairs))
        large = np.flatnonzero(size > SMALL_GROUP)
        member = T.ragged(at[large], size[large])
        group = np.repeat(np.arange(len(large)), size[large])
        if len(member):
            # groups of the same members are one
            name = np.add.reduceat(T.mix(ids[member].view(np.uint64)), np.searchsorted(group, np.arange(len(large))))
            first = np.unique(name, return_index=True)[1]
            large, name = large[first], name[first]
            member = T.ragged(at[large], size[large])
            group = np.repeat(np.arange(len(large)), size[large])
            rank = np.lexsort((T.mix(ids[member].view(np.uint64) ^ name[group]), group))
            pivot = ids[member[rank[np.searchsorted(group, np.arange(len(large)))]]]
            pairs.append(np.stack([pivot[group], ids[member]], 1))
        if pairs:
            both = np.sort(np.concatenate(pairs), 1)
            shared = np.ones(len(both), np.int32)
            shared[n_small:] = 2
            real = both[:, 0] != both[:, 1]
            both, shared = both[real], shared[real]
            if len(both):
                order = np.lexsort((both[:, 1], both[:, 0]))
                both, shared = both[order], shared[order]
                head = np.flatnonzero(np.concatenate([[True], (both[1:] != both[:-1]).any(1)]))
                both, shared = both[head], np.minimum(np.add.reduceat(shared, head), 2)
                yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.nulls(len(both), pa.int64()), pa.array(shared.astype(np.int32))], names=["a", "b", "sign", "g"])
        if len(member):
            for i in range(0, len(member), 100_000):
                own, of = member[i : i + 100_000], group[i : i + 100_000]
                yield pa.record_batch([pa.array(ids[own]), pa.nulls(len(own), pa.int64()), pa.array(name[of].view(np.int64)), pa.array(size[large][of].astype(np.int32))], names=["a", "b", "sign", "g"])

    held, now = [], None
    for batch in batches:
        for p, *blobs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if held and p != now:
                yield from solve(held)
                held = []
            now = p
            held.append(tuple(blobs))
    if held:
        yield from solve(held)


def _unique_pairs(both: np.ndarray) -> np.ndarray:
    order = np.lexsort((both[:, 1], both[:, 0]))
    both = both[order]
    return both[np.concatenate([[True], (both[1:] != both[:-1]).any(1)])]


SETS = "node long, elements array<long>"


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in T.chunks(batches):
        elements, bounds = shingle_sets(*T.buffer(T.column(batch, "text")))
        yield pa.record_batch([pa.array(nodes(elements, bounds)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(elements.view(np.int64)))], names=["node", "elements"])


def folded(bitmaps: list[bytes], bits: int) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, folded by xor to the given number of bits."""
    out = np.empty((len(bitmaps), bits // 64), np.uint64)
    for i, b in enumerate(bitmaps):
        x = np.frombuffer(b, np.uint64)
        while len(x) * 64 > bits:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[i] = x
    return out


def _close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that the parity bitmaps don't rule out, with the distance."""
    for batch in batches:
        cols = {c: batch.column(c) for c in batch.schema.names}
        na, nb = np.asarray(cols["na"]), np.asarray(cols["nb"])
        keep = np.zeros(len(na), bool)
        far = np.zeros(len(na), np.int64)
        for i, (x, y) in enumerate(zip(cols["ba"].to_pylist(), cols["bb"].to_pylist(), strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            while len(x) > len(y):
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            while len(y) > len(x):
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            far[i] = int(np.bitwise_count(x ^ y).sum())
            keep[i] = 9 * far[i] <= na[i] + nb[i]
        yield pa.record_batch([cols["a"].filter(pa.array(keep)), cols["b"].filter(pa.array(keep)), pa.array(far[keep])], names=["a", "b", "far"])


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sign, x, y): a block pair of one signature group.  Pairs of
    members in different components that the bitmaps don't rule out."""

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        node, n, comp, side = (np.array([r[i] for r in rows], np.int64) for i in (0, 1, 2, 3))
        if len(np.unique(comp)) < 2:
            return
        bits = min(len(r[4]) for r in rows) * 8
        maps = folded([r[4] for r in rows], bits)
        most = np.argmax(np.bincount(np.unique(comp, return_inverse=True)[1]))
        main = np.unique(comp)[most]
        got = []
        for i in np.flatnonzero(comp != main):  # a pair inside the largest component needs no test
            other = (comp != comp[i]) & ((side != side[i]) | (side[i] < 0)) & ((comp == main) | (node > node[i]))
            other &= (4 * n <= 5 * n[i]) & (4 * n[i] <= 5 * n)
            j = np.flatnonzero(other)
            if len(j):
                far = np.bitwise_count(maps[j] ^ maps[i]).sum(1)
                j = j[9 * far <= n[j] + n[i]]
                if len(j):
                    got.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], 1))
        if got:
            both = _unique_pairs(np.concatenate(got))
            yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    held, now = [], None
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("sign", "x", "y", "node", "n", "component", "side", "bitmap")]
        for sign, x, y, *row in zip(*cols, strict=True):
            if held and (sign, x, y) != now:
                yield from solve(held)
                held = []
            now = (sign, x, y)
            held.append(tuple(row))
    if held:
        yield from solve(held)


def _small(df: DataFrame, broadcast_bytes: int) -> DataFrame:
    """df marked for a broadcast if, counted, it is known to be small; df is a checkpoint of one long column."""
    return F.broadcast(df) if 16 * df.count() <= broadcast_bytes else df


def _verified(pairs: DataFrame, docs: DataFrame, names: DataFrame, broadcast_bytes: int) -> DataFrame:
    """Those pairs (a, b) whose sets have 100 * intersection >= 80 * union.

    Only the texts of the pairs' nodes become sets again; names has one doc_id for each node.
    """
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = names.join(wanted, "node", "left_semi").select(F.col("doc").alias("doc_id")).distinct().checkpoint()
    sets = docs.join(_small(wanted, broadcast_bytes), "doc_id", "left_semi").mapInArrow(_sets, SETS).checkpoint()
    one = sets.select(F.col("node").alias("a"), F.col("elements").alias("ea"))
    two = sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
    both = F.size(F.array_intersect("ea", "eb"))
    return pairs.join(two, "b").join(one, "a").where(100 * both >= 80 * (F.size("ea") + F.size("eb") - both)).select("a", "b").repartition("a", "b").distinct().checkpoint()


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of nodes in different components so far."""
    one = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    two = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    got = pairs.join(one, "a", "left").join(two, "b", "left")
    return got.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _with_node(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in T.chunks(batches):
        yield batch.append_column("_node", pa.array(nodes(*shingle_sets(*T.buffer(T.column(batch, "text"))))))


def with_node(docs: DataFrame) -> DataFrame:
    """The rows of docs with the hash of the text's set as _node."""
    T.small_batches(docs.sparkSession)
    return docs.mapInArrow(_with_node, StructType([*docs.schema.fields, StructField("_node", LongType())]))


def ngram_jaccard_components(docs: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text), as in ngram_jaccard_nodes."""
    return ngram_jaccard_nodes(docs, broadcast_bytes).select("doc_id", "n_shingles", "component_id")


def ngram_jaccard_nodes(docs: DataFrame, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, n_shingles, node, component, component_id) for every row of docs(doc_id, text).

    node is the hash of the row's set and component the smallest node that links
    reach, both null for a row that is linked with nothing; texts under one
    doc_id may be in several components, which then can share a component_id.

    component_id is the smallest doc_id that links reach.  A null or blank text
    has an empty set (n_shingles 0), is linked with nothing and has its own
    doc_id as component_id; so does a row whose doc_id is null.  Rows stay
    apart, repeated doc_ids too, each by its own text.  Other columns of docs
    are ignored.  Equal sets are one node from the start, so copies cost a row
    each and no pairs.
    """
    spark = docs.sparkSession
    T.small_batches(spark)
    T.checkpoint_dir(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    sketch = docs.mapInArrow(_sketch, SKETCH).checkpoint()
    known = sketch.where("n_shingles > 0 and doc_id is not null")
    names = known.groupBy("node").agg(F.min("doc_id").alias("doc")).checkpoint()

    found = docs.where("doc_id is not null").mapInArrow(_packed(parts), PACKED).repartition(parts, "p").sortWithinPartitions("p").mapInArrow(_grouped, GROUPED).checkpoint()
    pairs = found.where("b is not null").groupBy("a", "b").agg(F.sum("g").alias("g")).where("g >= 2").select("a", "b").checkpoint()
    groups = found.where("sign is not null").select(F.col("a").alias("node"), "sign", "g")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(groups.select("node")).distinct().checkpoint()
    wanted = names.join(_small(wanted, broadcast_bytes), "node", "left_semi").withColumnRenamed("doc", "doc_id").checkpoint()
    if 32 * wanted.count() <= broadcast_bytes:
        wanted = F.broadcast(wanted)
    # by node and its doc_id, so that copies fall out before anything is moved
    size = known.select("doc_id", "node", "n_shingles", "bitmap").join(wanted, ["doc_id", "node"], "left_semi").drop("doc_id").checkpoint()

    def plausible(pairs: DataFrame) -> DataFrame:
        one = size.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("bitmap").alias("ba"))
        two = size.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("bitmap").alias("bb"))
        pairs = pairs.join(one, "a").join(two, "b").where("4 * na <= 5 * nb and 4 * nb <= 5 * na")
        return pairs.mapInArrow(_close, "a long, b long, far long")

    close = plausible(pairs).checkpoint()

    # each node first tries its closest partner, which links almost all that can be linked
    best = close.select("a", "b", "far", F.col("a").alias("of")).union(close.select("a", "b", "far", F.col("b")))
    best = best.groupBy("of").agg(F.min(F.struct("far", "a", "b")).alias("e")).select("e.a", "e.b").distinct()
    links = _verified(best.checkpoint(), docs, names, broadcast_bytes)
    labels = connected_components(links)
    links = links.union(_verified(_labelled(close.select("a", "b"), labels).checkpoint(), docs, names, broadcast_bytes))
    labels = connected_components(links)

    # larger groups: members still apart are compared in blocks, groups beyond one block only if they have such
    own = groups.join(labels, "node", "left").join(size.select("node", F.col("n_shingles").alias("n"), "bitmap"), "node")
    own = own.select("sign", "g", "node", F.coalesce("component", "node").alias("component"), "n", "bitmap")
    one = own.where(f"g <= {BLOCK}").select("sign", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(-1).alias("side"), "node", "component", "n", "bitmap")
    many = groups.where(f"g > {BLOCK}").join(labels, "node", "left").select("sign", F.coalesce("component", "node").alias("component"))
    mixed = many.groupBy("sign").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("sign")
    many = own.where(f"g > {BLOCK}").join(mixed, "sign").withColumn("nb", F.ceil(F.col("g") / BLOCK).cast("int"))
    many = many.withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    many = many.select("sign", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"), "node", "component", "n", "bitmap")
    own = one.union(many)
    more = own.repartition("sign", "x", "y").sortWithinPartitions("sign", "x", "y").mapInArrow(_blocks, "a long, b long").distinct().checkpoint()
    if not more.isEmpty():
        more = _verified(more, docs, names, broadcast_bytes)
        if not more.isEmpty():
            labels = connected_components(links.union(more))

    own = names.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = own.groupBy("component").agg(F.min("doc").alias("component_id"))
    own = own.join(least, "component").select("node", "component", "component_id")
    rows = sketch.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    return rows.join(own, "node", "left").select("doc_id", "n_shingles", "node", "component", F.coalesce("component_id", "doc_id").alias("component_id"))
