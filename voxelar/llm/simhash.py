"""SimHash fingerprints and near-duplicate groups with a Gray-order hierarchical index.

Index: every upper node is a masked bit pattern shared by all fingerprints below it.
The top masks are max_distance + 1 disjoint blocks, so two fingerprints within the
distance share at least one node; a node with too many members is split by the same
argument on its free bits. Spark shuffles members by node and sorts them by Gray rank.
Inside a node the sorted members are grouped bottom-up, each group factoring out the
bits its members share; a search walks pairs of groups and drops a pair as soon as the
differences accumulated on shared bits exceed the distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelar.plans.components import connected_components
from voxelar.plans.cut import broadcast_if_small, materialize

from ._common import LOWER, UPPER, fresh, id_back, id_of, join_hot, text_of

SEED = 42
#: Members of one node that a task searches; larger nodes are split further.
NODE_ROWS = 4096
LEAF, FANOUT = 16, 8
BITS = 64
BANDS, BAND_ROWS = 20, 5
#: Ids of changed rows are broadcast up to this many, beyond it they are joined by shuffle.
ID_ROWS = 200_000
#: Sets that hold one shingle meet in pairs of blocks of this many.
PAIR_ROWS = 1000
#: Longs of the parity bits that bound how far two sets differ before they are compared.
PARITY_LONGS = 16

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased text, repeats included."""
    words = text.translate(_FOLD).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, max(1, len(words) - size + 1))


def majority(hashes: np.ndarray, chunk: int = 1 << 15) -> int:
    """The fingerprint: a bit is set if it is set in more than half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), chunk):
        part = hashes[at : at + chunk].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``(id, fp)`` of every row; a text without words (or null) has fingerprint zero."""
    rows = docs.select(id_of(id_col).alias("id"), text_of(text_col).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            fps = [majority(shingle_hashes(t, size)) for t in batch.column("text").to_pylist()]
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), fp], ["id", "fp"])

    return rows.mapInArrow(run, "id long, fp long")


def _blocks(free: int, parts: int) -> list[int]:
    """``free`` bits cut into ``parts`` masks of nearly equal size, as signed longs."""
    bits = [i for i in reversed(range(BITS)) if free >> i & 1]
    cuts = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in bits[cuts[i] : cuts[i + 1]]) for i in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def index_nodes(fps: DataFrame, max_distance: int, node_rows: int = NODE_ROWS) -> DataFrame:
    """``(mask, pattern, fp)``: every distinct fingerprint under each of its index nodes.

    Nodes above ``node_rows`` are replaced by children that fix more bits, until all
    fit or a node has so few free bits that it cannot be large.
    """
    parts, full = max_distance + 1, (1 << BITS) - 1
    masks = _blocks(full, parts)
    nodes = fps.select(F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"), "fp")
    done = []
    while True:
        nodes = nodes.withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))
        masks = [m for m in masks if bin(full & ~m).count("1") > 10]
        if not masks:
            break
        big = nodes.groupBy("mask", "pattern").count().where(F.col("count") > node_rows).select("mask", "pattern")
        if big.isEmpty():
            break
        big = materialize(big.where(F.col("mask").isin([_signed(m) for m in masks])), "nodes")
        done.append(nodes.join(big, ["mask", "pattern"], "left_anti").select("mask", "pattern", "fp"))
        children = {m: [m | b for b in _blocks(full & ~m, parts)] for m in masks}
        lookup = F.create_map(
            *[x for m, c in children.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(k)) for k in c]))]
        )
        nodes = nodes.join(big, ["mask", "pattern"]).select(F.explode(lookup[F.col("mask")]).alias("mask"), "fp").distinct()
        masks = sorted({k for c in children.values() for k in c})
    out = nodes.select("mask", "pattern", "fp")
    for d in done:
        out = out.unionByName(d)
    return out


def _gray_rank(x):
    """Position of a bit string in reflected Gray order (Column in, Column out)."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, shift))
    return x


def search_node(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside one node, as a spanning forest of index pairs; ``fps`` in Gray order."""
    n = len(fps)
    levels = [(np.full(n, ~np.uint64(0)), fps)]
    for width in (LEAF, *[FANOUT] * 8):
        mask, pattern = levels[-1]
        if len(mask) == 1:
            break
        at = np.arange(0, len(mask), width)
        first = np.repeat(pattern[at], np.diff(np.append(at, len(mask))))
        varying = np.bitwise_or.reduceat(pattern ^ first, at) | ~np.bitwise_and.reduceat(mask, at)
        levels.append((~varying, pattern[at] & ~varying))
    left = right = np.zeros(1, np.int64)
    spent, seen = np.zeros(1, np.int64), np.zeros(1, np.uint64)
    for depth in range(len(levels) - 1, 0, -1):
        width = LEAF if depth == 1 else FANOUT
        mask, pattern = levels[depth - 1]
        a = (left[:, None] * width + np.arange(width)).repeat(width, axis=1)
        b = np.tile(right[:, None] * width + np.arange(width), (1, width))
        spent, seen = spent.repeat(width * width), seen.repeat(width * width)
        a, b = a.ravel(), b.ravel()
        ok = (a < len(mask)) & (b < len(mask)) & (a <= b)
        if depth == 1:
            ok &= a < b
        a, b, spent, seen = a[ok], b[ok], spent[ok], seen[ok]
        both = mask[a] & mask[b]
        spent = spent + np.bitwise_count((pattern[a] ^ pattern[b]) & both & ~seen).astype(np.int64)
        ok = spent <= distance
        left, right, spent, seen = a[ok], b[ok], spent[ok], both[ok]
    if len(levels) == 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    others = np.nonzero(label != np.arange(n))[0]
    return label[others], others


def _search(distance: int):
    def run(batches):
        held = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            mask, pattern, fp = now
            change = np.nonzero((mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1]))[0] + 1
            if not len(change):
                held = now
                continue
            held = [x[change[-1] :] for x in now]
            yield from _links(fp, np.append(0, change), distance)
        if held is not None and len(held[0]):
            yield from _links(held[2], np.array([0, len(held[0])]), distance)

    return run


def _links(fp: np.ndarray, bounds: np.ndarray, distance: int):
    sizes = np.diff(bounds)
    fp = fp.view(np.uint64)
    lefts, rights = [], []
    # Two members: one comparison each, for all such nodes at once.
    two = bounds[:-1][sizes == 2]
    near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance
    lefts.append(fp[two][near])
    rights.append(fp[two + 1][near])
    for at in np.nonzero(sizes > 2)[0]:
        part = fp[bounds[at] : bounds[at + 1]]
        a, b = search_node(part, distance)
        lefts.append(part[a])
        rights.append(part[b])
    a, b = np.concatenate(lefts).view(np.int64), np.concatenate(rights).view(np.int64)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links(fps: DataFrame, max_distance: int = 2, node_rows: int = NODE_ROWS) -> DataFrame:
    """Pairs ``(a, b)`` of fingerprints within the distance that connect all such pairs.

    ``fps`` has distinct values in ``fp``. Each node contributes a spanning forest of
    its links, so the result connects exactly what all links connect without listing
    every pair of a dense group.
    """
    nodes = index_nodes(fps, max_distance, node_rows)
    rank = _gray_rank(F.col("fp").bitwiseAND(F.bitwise_not("mask")))
    placed = nodes.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern", rank)
    return placed.mapInArrow(_search(max_distance), "a long, b long").distinct()


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, max_distance: int = 2
) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    Fingerprints at ``max_distance`` or fewer differing bits are linked; the component
    is the smallest id reachable. Texts without words share fingerprint zero and are
    linked like any other; a null id counts as the smallest id; repeated rows repeat in
    the result. An empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, size), "fingerprints")
    firsts = materialize(rows.groupBy("fp").agg(F.min("id").alias("first")), "firsts")
    groups = connected_components(links(firsts.select("fp"), max_distance)).withColumnRenamed("node", "fp")
    placed = firsts.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = placed.groupBy("component").agg(F.min("first").alias("root"))
    by_fp = materialize(placed.join(lowest, "component").select("fp", "root"), "roots")
    return join_hot(rows, by_fp, "fp").select(
        id_back("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        id_back("root").alias("component_id"),
    )


def band_fingerprints(rows: DataFrame, size: int) -> DataFrame:
    """``(rid, key, fp, bands)``: SimHash fingerprints of the distinct shingles and of min-wise samples of them; key: the text's hash.

    Copies of similarity s agree on a whole band sample with probability s^5, so with
    20 bands a pair at 0.8 shares an equal band fingerprint in 99.96 % of cases.
    """

    def run(batches):
        spread = np.random.default_rng(SEED)
        mul = spread.integers(1, 1 << 63, BANDS * BAND_ROWS, np.uint64) * 2 + 1
        add = spread.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64)
        for batch in batches:
            rids, keys, fps, bands = [], [], [], []
            for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                hashes = np.unique(shingle_hashes(text, size))
                if not len(hashes):
                    continue
                low = np.full(len(mul), ~np.uint64(0))
                for at in range(0, len(hashes), 4096):
                    mixed = hashes[at : at + 4096, None] * mul + add
                    mixed ^= mixed >> np.uint64(31)
                    low = np.minimum(low, mixed.min(axis=0))
                low *= np.uint64(0x9E3779B97F4A7C15)
                low ^= low >> np.uint64(29)
                low *= np.uint64(0xBF58476D1CE4E5B9)
                bits = np.unpackbits(low.astype(">u8").view(np.uint8).reshape(BANDS, BAND_ROWS, 8), axis=2)
                packed = np.packbits(2 * bits.sum(axis=1) > BAND_ROWS, axis=1)
                rids.append(rid)
                keys.append(xxhash.xxh64_intdigest(text, SEED))
                fps.append(majority(hashes))
                bands.append(np.ascontiguousarray(packed).view(">u8").ravel().astype(np.uint64).view(np.int64))
            flat = np.concatenate(bands) if bands else np.empty(0, np.int64)
            offsets = pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32))
            column = pa.ListArray.from_arrays(offsets, pa.array(flat))
            key, fp = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (keys, fps))
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), key, fp, column], ["rid", "key", "fp", "bands"])

    return rows.mapInArrow(run, "rid long, key long, fp long, bands array<long>")


def fingerprint_pairs(rows: DataFrame, max_distance: int = 2) -> DataFrame:
    """Pairs ``(a, b)`` of ``rows(rid, fp)`` that connect all rows whose fingerprints differ in ``max_distance`` bits or fewer."""
    firsts = materialize(rows.groupBy("fp").agg(F.min("rid").alias("first")), "firsts")
    near = materialize(links(firsts.select("fp"), max_distance), "near")
    for end, name in (("a", "x"), ("b", "y")):
        near = near.join(firsts.select(F.col("fp").alias(end), F.col("first").alias(name)), end)
    equal = rows.join(firsts, "fp").where("rid <> first").select(F.col("first").alias("a"), F.col("rid").alias("b"))
    return equal.unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def _shingle_sets(rows: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [np.unique(shingle_hashes(t, size)).view(np.int64) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(sets, pa.list_(pa.int64()))], ["rid", "shingles"])

    return rows.mapInArrow(run, "rid long, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    both = pairs.join(sets.select(F.col("rid").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(sets.select(F.col("rid").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b")


def prefix_pairs(sets: DataFrame, similarity: float, block_rows: int = PAIR_ROWS) -> DataFrame:
    """Pairs ``(a, b)`` of ``sets(rid, component, shingles)`` across components; none at the similarity is left out.

    Sets that similar share one of their rarest shingles: of n the first n - similarity * n + 1
    by frequency. A shingle of many sets is dealt to pairs of blocks of ``block_rows`` members.
    Where two sets meet they must also not differ too much: a shingle flips one parity bit of its
    set, so sets differ in at least as many shingles as bits, and in all shingles of their own.
    """
    words = sets.select("rid", "component", F.size("shingles").alias("size"), F.explode("shingles").alias("s"))
    often = words.groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    spot = F.shiftrightunsigned("s", 6).bitwiseAND(PARITY_LONGS - 1)
    flip = F.expr("shiftleft(1L, cast(s & 63 as int))")
    parity = [F.bit_xor(F.when(spot == k, flip).otherwise(F.lit(0).cast("long"))).alias(f"bits{k}") for k in range(PARITY_LONGS)]
    entries = F.sort_array(F.collect_list(F.struct("n", "s"))).alias("held")
    held = words.join(often, "s").groupBy("rid", "component", "size").agg(entries, *parity)
    held = held.withColumn("alone", F.col("size") - F.size("held"))
    carried = ["rid", "component", "size", "alone", *[f"bits{k}" for k in range(PARITY_LONGS)]]
    # Shingles of one set alone come first in the order and meet nothing.
    length = F.col("size") - F.ceil(similarity * F.col("size") - 1e-6) + 1 - F.col("alone")
    prefix = held.select(*carried, F.explode(F.slice("held", F.lit(1), F.greatest(F.lit(0), length.cast("int")))).alias("e"))
    prefix = materialize(prefix.select(*carried, F.col("e.s").alias("s")), "prefix")
    met = prefix.groupBy("s").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    blocks = materialize(met.where("low < high").select("s", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")), "blocks")
    dealt = prefix.join(blocks, "s").withColumn("own", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other")
    x, y = (dealt.select("s", "i", "j", *[F.col(c).alias(f"{c}_{e}") for c in (*carried, "own")]) for e in "xy")
    differ = F.col("alone_x") + F.col("alone_y")
    for k in range(PARITY_LONGS):
        differ += F.bit_count(F.col(f"bits{k}_x").bitwiseXOR(F.col(f"bits{k}_y")))
    close = differ * (1 + similarity) <= (1 - similarity) * (F.col("size_x") + F.col("size_y")) + 1e-6
    near = F.least("size_x", "size_y") >= similarity * F.greatest("size_x", "size_y") - 1e-6
    pairs = x.join(y, ["s", "i", "j"]).where("rid_x < rid_y and component_x <> component_y and (own_x <> own_y or i = j)").where(near & close)
    return pairs.select(F.col("rid_x").alias("a"), F.col("rid_y").alias("b")).distinct()


def similar_pairs(rows: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """Verified pairs ``(a, b)`` of ``rows(rid, text)`` that connect all pairs of a band group that are that similar.

    Texts whose fingerprints differ in two bits or fewer are compared along the links that connect them. That finds
    the closest copies; for the others, whose fingerprints differ more, samples have fingerprints of their own, the bands.
    Members of a band group are compared with two leaders, a pseudo-random one and of the others
    the one with most company over its bands (an original among its copies), which settles most
    groups at a bounded number of comparisons per member. Members of groups that fall into several
    components after that are compared across components by ``prefix_pairs``.
    """
    bands = materialize(band_fingerprints(rows, size), "bands")
    flat = bands.select("rid", "key", F.posexplode("bands").alias("band", "fp"))
    # Drawn by content, so that the choice does not depend on how rows are numbered.
    leader = F.min(F.struct(F.xxhash64("key", "band").alias("h"), F.col("rid").alias("leader")))
    groups = flat.groupBy("band", "fp").agg(leader.alias("m"), F.count("*").alias("n")).where("n > 1")
    # Written out so that the join below sits right on its exchanges and a large group can be split.
    groups = materialize(groups.select("band", "fp", F.col("m.leader").alias("leader"), "n"), "leaders")
    grouped = materialize(flat.join(groups, ["band", "fp"]).select("band", "fp", "rid", "key", "leader", "n"), "grouped")
    company = grouped.groupBy("rid").agg(F.sum("n").alias("company"))
    best = F.max(F.struct("company", "key", F.col("rid").alias("second")))
    seconds = grouped.where("rid <> leader and n > 2").join(company, "rid").groupBy("band", "fp").agg(best.alias("m"))
    seconds = materialize(seconds.select("band", "fp", F.col("m.second").alias("leader")), "seconds")
    pairs = grouped.select("rid", "leader").unionByName(grouped.drop("leader").join(seconds, ["band", "fp"]).select("rid", "leader"))
    pairs = pairs.where("rid <> leader").select(F.least("rid", "leader").alias("a"), F.greatest("rid", "leader").alias("b"))
    pairs = materialize(pairs.unionByName(fingerprint_pairs(bands.select("rid", "fp"))).distinct(), "pairs")
    members = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    sets = materialize(_shingle_sets(rows.join(broadcast_if_small(members, ID_ROWS), "rid", "left_semi"), size), "sets")
    linked = materialize(_verified(pairs, sets, similarity), "linked")

    # Two leaders settle groups of three; in larger ones only members of one component are settled.
    placed = connected_components(linked).withColumnRenamed("node", "rid")
    large = grouped.where("n > 3").select("band", "fp", "rid").join(placed, "rid", "left")
    large = materialize(large.withColumn("component", F.coalesce("component", "rid")), "placed")
    parted = large.groupBy("band", "fp").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    parted = materialize(parted.select("band", "fp"), "parted")
    unsettled = materialize(large.join(parted, ["band", "fp"], "left_semi").select("rid", "component").distinct(), "unsettled")
    rest = prefix_pairs(sets.join(broadcast_if_small(unsettled, ID_ROWS), "rid"), similarity)
    return linked.unionByName(_verified(materialize(rest, "rest"), sets, similarity))


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8
) -> DataFrame:
    """``docs`` with the smallest id of every group of near-duplicates, columns unchanged.

    A text with fewer words than a shingle is one shingle; texts without words are
    never duplicates of each other. A null id counts as the smallest; of rows that
    repeat id and text one stays. An empty table stays empty.
    """
    rid = fresh(docs, "_rid")
    table = materialize(docs.withColumn(rid, F.monotonically_increasing_id()), "rows")
    rows = table.select(F.col(rid).alias("rid"), text_of(text_col).cast("binary").alias("text"))
    members = connected_components(similar_pairs(rows, size, similarity))
    named = members.join(table.select(F.col(rid).alias("node"), id_of(id_col).alias("id")), "node")
    keep = named.groupBy("component").agg(F.min(F.struct("id", "node")).alias("keep"))
    gone = named.join(keep, "component").where("node <> keep.node").select(F.col("node").alias(rid))
    return table.join(broadcast_if_small(materialize(gone, "gone"), ID_ROWS), rid, "left_anti").drop(rid)
