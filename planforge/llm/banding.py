"""Classes of similar items from MinHash signatures: banding, verification, components.

Shared by document and line deduplication.  Items are nodes with a signature of
32-bit minima; two nodes are candidates if all minima of one band agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .repeats import pack, unpack
from .storage import discard, materialize

BLOCK_BYTES = 16 << 20  # of texts in a block
SIGNATURE_MARGIN = 5.5  # standard deviations below the threshold at which a signature still goes to the exact check
BUCKET_ROWS = 1 << 20  # band entries per bucket of the exchange, about


def band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    """(nodes, bands) hashes of each band's minima."""
    bands = signature.shape[1] // rows
    s = signature.astype(np.uint64).reshape(len(signature), bands, rows)
    h = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), 1))
    for r in range(rows):
        h = K.mix(h * np.uint64(0x9E3779B97F4A7C15) + s[:, :, r])
    return h


def pack_bands(h: np.ndarray, node: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Band entries (h, node) of a batch packed by bucket, one entry per hash.

    Nodes of the batch that share a hash follow its smallest node there and go
    along beside, in a bucket drawn from the batch: a hot hash costs one entry
    per batch.
    """
    order = np.argsort(h)
    h, node = h[order], node[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    start = np.flatnonzero(new)
    hs, ns = h[start], np.minimum.reduceat(node, start) if len(h) else node
    many = np.diff(start, append=len(h))
    lead = np.repeat(ns, many)
    local = np.repeat(many > 1, many)
    bucket = ((hs >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    out = [(b, pack(np.diff(hs[i:j], prepend=np.uint64(0)), ns[i:j])) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if i < j]
    if local.any():
        out.append((buckets + int(ns[0] % buckets), pack(h[local], node[local], lead[local])))
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "blob"])


def _send(rows: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            if len(node):
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(node), -1)
                h = band_hashes(sig, rows)
                yield pack_bands(h.ravel(), np.repeat(node, h.shape[1]), buckets)

    return run


FINE_ROWS, FINE_BANDS = 6, 40  # a pair at similarity 0.8 shares no band with probability 5e-6, one at 0.3 shares one with 3%
_RNG = np.random.default_rng(78)
FINE = _RNG.integers(0, 1 << 31, FINE_ROWS * FINE_BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1), _RNG.integers(0, 1 << 32, FINE_ROWS * FINE_BANDS, dtype=np.uint32)


def minima(h: np.ndarray, first: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Minimum of each universal hash over each non-empty set (others are zero)."""
    out = np.zeros((len(first) - 1, len(factors)), dtype=np.uint32)
    filled = np.flatnonzero(np.diff(first))
    if len(filled):
        x, starts = (h >> np.uint64(32)).astype(np.uint32), first[filled]
        for i in range(len(factors)):
            out[filled, i] = np.minimum.reduceat(x * factors[i] + terms[i], starts)
    return out


def _send_fine(sets: Callable, buckets: int):
    """Packs finer bands of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, node = [np.zeros((0, FINE_BANDS), np.uint64)], batch.column(0).to_numpy()
            for c in K.chunks(batch.column(1)):
                key, _, first = sets(c)
                h.append(band_hashes(minima(key, first, *FINE), FINE_ROWS))
            yield pack_bands(np.concatenate(h).ravel(), np.repeat(node, FINE_BANDS), buckets)

    return run


MEMBER_DDL = "h long, node long, leader long"


def _answer(buckets: int):
    def run(key, table):
        got = [unpack(x) for x in table.column("blob").to_pylist()]
        if key[0].as_py() >= buckets:
            h, node, lead = (np.concatenate(x) for x in zip(*got, strict=True))
        else:
            h = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in got])
            node = np.concatenate([x[1] for x in got])
            order = np.lexsort((node, h))
            h, node = h[order], node[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = h[1:] != h[:-1]
            group = np.cumsum(new) - 1
            lead = node[new][group]
            several = np.bincount(group, weights=lead != node)[group] > 0  # batches may repeat a node
            h, lead, node = h[several], lead[several], node[several]
        return pa.table({"h": h.view(np.int64), "node": node, "leader": lead})

    return run


LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27  # of the bitmap: at most 2,097,152 words of 16 bytes are sent to each executor


def _bitmap(needed: DataFrame, count: int, key: str) -> tuple[DataFrame, int] | None:
    """Words (_word, _mask) of a bitmap with about eight bits for each of the ``count`` keys, and its size in bits; None if that is too many."""
    bits_wanted = max(LEAST_BITS, 1 << (8 * count).bit_length())
    if bits_wanted > 4 * MOST_BITS:
        return None
    size = min(bits_wanted, MOST_BITS)
    place = F.pmod(F.xxhash64(key), F.lit(size))
    bits = needed.select(place.alias("p")).groupBy(F.expr("p div 64").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("_mask"))
    return materialize(bits, "filter-words"), size


def _by_bitmap(df: DataFrame, words: DataFrame, size: int, key: str, hit: bool) -> DataFrame:
    """The rows of ``df`` whose key's bit is set, or those whose bit is not."""
    placed = df.withColumn("_place", F.pmod(F.xxhash64(key), F.lit(size))).withColumn("_word", F.expr("_place div 64"))
    found = F.call_function("getbit", F.col("_mask"), F.expr("cast(_place % 64 as int)")) == 1
    both = placed.join(F.broadcast(words), "_word", "inner" if hit else "left")  # MOST_BITS / 64 rows at most
    return both.where(found if hit else ~F.coalesce(found, F.lit(False))).select(*df.columns)


def prefilter(df: DataFrame, needed: DataFrame, count: int, key: str = "node") -> DataFrame:
    """Drops most rows of ``df`` whose key is not needed, before a join shuffles the rest.

    The keys' hashes set bits of a bitmap with eight bits for each of the
    ``count`` keys, whose words are sent to all executors.  A set bit proves
    nothing, so the join must follow.  With more keys than ``MOST_BITS`` has
    room for the bitmap would keep nearly all rows, and none is made.
    """
    bitmap = _bitmap(needed, count, key)
    return df if bitmap is None else _by_bitmap(df, *bitmap, key, True)


def split_by(df: DataFrame, listed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose key is ``listed``, and all others.

    Only rows whose bit of :func:`prefilter`'s bitmap is set are joined, and
    so shuffled; a key without its bit is not listed.  The joins are no semi
    or anti joins, which Spark would move before the bitmap's.
    """
    listed = listed.select(key).distinct()
    bitmap = _bitmap(listed, listed.count(), key)
    maybe = df if bitmap is None else _by_bitmap(df, *bitmap, key, True)
    marked = maybe.join(listed.withColumn("_listed", F.lit(True)), key, "left")
    found, others = (marked.where(c).select(*df.columns) for c in ("_listed", "_listed is null"))
    return found, others if bitmap is None else _by_bitmap(df, *bitmap, key, False).union(others)


PACKED_DDL = "bucket long, blob binary"


def band_members(packed: DataFrame, buckets: int) -> DataFrame:
    """(h, node, leader) of the nodes that share a band with another; rows may repeat."""
    return packed.groupBy("bucket").applyInArrow(_answer(buckets), MEMBER_DDL)


def signature_members(nodes: DataFrame, rows: int, bands: int) -> DataFrame:
    """band_members of (node, sig)."""
    buckets = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.count() * bands // BUCKET_ROWS)
    return band_members(nodes.mapInArrow(_send(rows, buckets), PACKED_DDL), buckets)


def _bits(keys: list[np.ndarray]) -> np.ndarray:
    """(sets, words): each set as bits over the elements that several of the sets have."""
    flat, row = np.concatenate(keys), np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    order = np.argsort(flat, kind="stable")
    value = flat[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = value[1:] != value[:-1]
    group = np.cumsum(new) - 1
    several = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
    row, group = row[order][several], group[several]
    column = np.cumsum(np.diff(group, prepend=-1) > 0) - 1 if len(group) else group
    out = np.zeros((len(keys), (int(column[-1]) if len(column) else 0) // 64 + 1), dtype=np.uint64)
    np.bitwise_or.at(out, (row, column // 64), np.uint64(1) << (column % 64).astype(np.uint64))
    return out


def _links(keys: list[np.ndarray], side: np.ndarray, label: np.ndarray, sig: np.ndarray | None, percent: int, least: float) -> list[tuple[int, int]]:
    """Enough links to connect what is linked: pairs of sets on two sides, or of all sets on one.

    A set is compared only with those that are not connected to it yet (equal
    ``label``): first the sizes, then the signatures, then the exact intersections.
    """
    bits, size, out = _bits(keys), np.array([len(k) for k in keys]), []
    label = np.unique(label, return_inverse=True)[1]
    crossing = side.any()
    for i in np.flatnonzero(side == 0) if crossing else range(len(keys)):
        other = (label != label[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
        if crossing:
            other &= side == 1
        else:
            other[:i] = False
        at = np.flatnonzero(other)
        if sig is not None and len(at):
            at = at[(sig[at] == sig[i]).mean(axis=1) >= least]
        if not len(at):
            continue
        shared = np.bitwise_count(bits[at] & bits[i]).sum(axis=1, dtype=np.int64)
        for j in at[100 * shared >= percent * (size[at] + size[i] - shared)]:
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _near(keys: list[np.ndarray], me: int, sig: np.ndarray | None, percent: int, least: float) -> np.ndarray:
    """Which sets are linked to the one at ``me``: sizes, signatures, then the exact intersections."""
    size = np.array([len(k) for k in keys])
    near = 100 * np.minimum(size, size[me]) >= percent * np.maximum(size, size[me])
    near[me] = False
    if sig is not None:
        near &= (sig == sig[me]).mean(axis=1) >= least
    at = np.flatnonzero(near & (size > 0))
    if len(at):
        mine, flat = np.sort(keys[me]), np.concatenate([keys[j] for j in at])
        hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
        shared = np.add.reduceat(hit, np.cumsum(size[at]) - size[at], dtype=np.int64)
        at = at[100 * shared >= percent * (size[at] + size[me] - shared)]
    return at


def _join_first(keys: list[np.ndarray], label: np.ndarray, sig: np.ndarray | None, percent: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Labels after the first set's links, and one set of each label that those links join to it."""
    at = _near(keys, 0, sig, percent, least)
    joined, one = np.unique(label[at], return_index=True)
    at = at[one[joined != label[0]]]
    return np.where(np.isin(label, joined), label[0], label), at


LINKS = "a long, b long"


def _signature_floor(percent: int, minima: int) -> float:
    similarity = percent / 100
    return similarity - SIGNATURE_MARGIN * np.sqrt(similarity * (1 - similarity) / minima) if minima else 0.0


def _sets_of(table: pa.Table, sets: Callable) -> list[np.ndarray]:
    keys: list[np.ndarray] = []
    for c in K.chunks(table.column("text"), 1 << 20):
        h, _, first = sets(c)
        keys += np.split(h, first[1:-1])
    return keys


def _signatures_of(table: pa.Table, minima: int) -> np.ndarray | None:
    return np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(table), -1) if minima else None


def _compare(sets: Callable, percent: int, minima: int):
    """One task's homes: rows (home, side, node, label, text[, sig]) to links (a, b)."""
    least = _signature_floor(percent, minima)

    def run(key, table):
        table = table.sort_by([("home", "ascending"), ("node", "ascending")])
        home, side, node, label = (table.column(c).to_numpy() for c in ("home", "side", "node", "label"))
        label = label.copy()
        keys, sig = _sets_of(table, sets), _signatures_of(table, minima)
        cut = np.flatnonzero(np.diff(home, prepend=home[0] - 1, append=home[-1] + 1))
        a, b = [], []
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if not side[i:j].any():  # most homes are done by one comparison with their first node
                label[i:j], found = _join_first(keys[i:j], label[i:j], None if sig is None else sig[i:j], percent, least)
                a += [node[i]] * len(found)
                b += node[i + found].tolist()
                i += 1
                if j - i < 2 or (label[i:j] == label[i - 1]).all():
                    continue
            for x, y in _links(keys[i:j], side[i:j], label[i:j], None if sig is None else sig[i:j], percent, least):
                a.append(node[i + x])
                b.append(node[i + y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _follow(sets: Callable, percent: int, minima: int):
    """One part of a leader's followers: rows (leader, node, text[, sig]), the leader among them, to links (a, b)."""
    least = _signature_floor(percent, minima)

    def run(key, table):
        leader, node = table.column("leader")[0].as_py(), table.column("node").to_numpy()
        keys, sig = _sets_of(table, sets), _signatures_of(table, minima)
        me = int(np.flatnonzero(node == leader)[0])
        got = node[_near(keys, me, sig, percent, least)]
        return pa.table({"a": pa.array(got, pa.int64()), "b": pa.array([leader] * len(got), pa.int64())})

    return run


def _homes(members: DataFrame, what: str) -> tuple[DataFrame, DataFrame]:
    """(node, home): candidates connected through their leaders; and (leader, node, shared): in how many bands."""
    led = members.where("node != leader").groupBy("leader", "node").agg(F.count(F.lit(1)).alias("shared"))
    led = materialize(led, f"{what}-led")
    return materialize(components(led.select("leader", "node")).withColumnRenamed("component", "home"), f"{what}-homes"), led


def _sized(known: DataFrame, block: int) -> tuple[DataFrame, int]:
    """(home, blocks) of rows (node, home, text), and into how many tasks single blocks are packed."""
    sizes = known.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    sizes = materialize(sizes.select("home", F.expr(f"cast(greatest((n + {block - 1}) div {block}, (bytes + {BLOCK_BYTES - 1}) div {BLOCK_BYTES}) as int)").alias("blocks"), "n", "bytes"), "home-sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    return sizes.select("home", "blocks"), max(total.n // block, total.bytes // BLOCK_BYTES) + 1


LEADERS = "leader", "leader_parts", "parts"


def _with_leaders(homes: DataFrame, led: DataFrame, block: int) -> DataFrame:
    """``homes`` with each node's ``leader``, the one that it shares most bands with, and in how many parts of about ``block`` nodes
    that leader's followers (``leader_parts``) and the node's own (``parts``) are dealt."""
    mine = led.groupBy("node").agg(F.min(F.struct((-F.col("shared")).alias("less"), "leader")).alias("m")).select("node", "m.leader")
    mine = materialize(mine, "leaders")
    parts = materialize(mine.groupBy("leader").agg(F.expr(f"cast((count(1) + {block - 1}) div {block} as int)").alias("parts")), "leader-parts")
    mine = mine.join(parts.withColumnRenamed("parts", "leader_parts"), "leader")
    return homes.join(mine, "node", "left").join(parts.withColumnRenamed("leader", "node"), "node", "left")


def _leader_links(large: DataFrame, sets: Callable, percent: int, minima: int, what: str) -> DataFrame:
    """Links of nodes with their leaders (:func:`_with_leaders`).

    A node goes to its part of its leader's followers, and to each part of its
    own followers: rows grow with the nodes, however large a group is, and
    texts are shuffled once.
    """
    own = F.expr("case when leader is not null then array(struct(leader, cast(pmod(xxhash64(node), leader_parts) as int) as part)) else array() end")
    led_by = F.expr("case when parts is not null then transform(sequence(0, parts - 1), p -> struct(node as leader, p as part)) else array() end")
    rows = large.select("node", *[c for c in ("text", "sig") if c in large.columns], F.explode(F.concat(own, led_by)).alias("to")).select("to.leader", "to.part", *[c for c in ("node", "text", "sig") if c in ("node", *large.columns)])
    return materialize(rows.groupBy("leader", "part").applyInArrow(_follow(sets, percent, minima), LINKS), f"{what}-leader-links")


def dealt_rows(known: DataFrame, block: int) -> tuple[DataFrame, int]:
    """Rows (node, home, label, ...) dealt to tasks: (task, home, side, node, label, ...).

    Nodes of a home that have the home's largest label are connected already and
    are only compared with the others.  A home is dealt to blocks by a hash of the node: each pair
    of blocks is a task, but for the pairs within the largest label.  Homes of one block
    are packed.
    """
    blocks, packs = _sized(known, block)
    counts = known.groupBy("home", "label").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("home").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("n")).select("home", F.col("m.label").alias("main"), F.col("m.n").alias("n_main"), F.col("n"))
    # a home with one label is done
    shape = materialize(main.where("n_main < n").join(blocks, "home").select("home", "blocks", "main", F.expr("cast(ceil(blocks * (n_main / n)) as int)").alias("main_blocks"), F.expr("cast(ceil(blocks * ((n - n_main) / n)) as int)").alias("rest_blocks")), "home-shapes")
    known = known.join(shape, "home")
    single = known.where("blocks = 1").select(F.pmod(F.xxhash64("home"), F.lit(packs)).alias("task"), "home", F.lit(0).alias("side"), "node", "label", *[c for c in known.columns if c in ("text", "sig")])
    large = known.where("blocks > 1").withColumn("rest", F.col("label") != F.col("main"))
    # blocks of the rest come first, 0 .. rest_blocks - 1, then those of the largest label; a pair (lo, hi) has lo among the rest
    mine = F.when(F.col("rest"), F.pmod(F.xxhash64("node"), F.col("rest_blocks"))).otherwise(F.col("rest_blocks") + F.pmod(F.xxhash64("node"), F.col("main_blocks"))).cast("int")
    most = F.when(F.col("rest"), F.col("rest_blocks") + F.col("main_blocks")).otherwise(F.col("rest_blocks"))
    large = large.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), most - 1)))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    large = large.select(F.xxhash64("home", lo, hi).alias("task"), "home", (F.col("mine") > F.col("other")).cast("int").alias("side"), "node", "label", *[c for c in known.columns if c in ("text", "sig")])
    return single.unionByName(large), packs


def linked_classes(members: DataFrame, texts: Callable[[DataFrame, int], DataFrame], sets: Callable, *, percent: int, block: int, what: str, nodes: DataFrame | None = None, minima: int = 0) -> DataFrame:
    """(node, component) of the nodes linked to another at ``percent`` similarity.

    ``members``: see :func:`band_members`.  ``texts``: from a table of nodes and
    their count to their (node, text).  ``sets``: the distinct shingles of a chunk's texts.
    ``nodes`` (node, sig), one row per node: if given, signatures of ``minima``
    values are compared before sets are.

    Nodes connected by shared bands are of one *home*.  Homes of up to ``block``
    nodes are compared within a task.  In a larger one every node is first
    compared with the leader of most of its bands, which connects groups of near
    copies in as many comparisons as they have nodes.  What is not connected
    then is taken apart by finer bands, which weakly similar texts seldom share,
    and compared with the rest of its home in pairs of blocks
    (:func:`dealt_rows`).  So a task holds a bounded number of texts and of
    bytes (beyond one text), each pair that shares a band is compared in one task
    unless it is connected already, and only connecting links leave it.
    """
    homes, led = _homes(members, what)
    homes = materialize(_with_leaders(homes, led, block), f"{what}-led-homes")
    discard(led)
    known = texts(homes.select("node"), homes.count()).join(homes, "node")
    if nodes is not None:
        known = known.join(nodes, "node")
    known = materialize(known, f"{what}-texts")
    sizes, _ = _sized(known, block)
    big = materialize(sizes.where("blocks > 1").select("home"), f"{what}-large-homes")  # at most one for ``block`` nodes
    small = known.join(big, "home", "left_anti").drop(*LEADERS).withColumn("label", F.col("node"))
    links = []
    if not big.isEmpty():
        large = known.join(big, "home", "left_semi")
        links.append(_leader_links(large, sets, percent, minima, what))
        near = materialize(components(links[0]), f"{what}-near")
        label = F.coalesce("component", "node").alias("label")
        one = large.select("node", "home").join(near, "node", "left").groupBy("home").agg((F.min(label) != F.max(label)).alias("open")).where("open").select("home")
        # only texts of homes that are not connected yet are shuffled again
        large = large.drop(*LEADERS).join(materialize(one, f"{what}-open"), "home", "left_semi").join(near, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        large = materialize(large, f"{what}-large")
        buckets = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        fine = band_members(large.select("node", "text").mapInArrow(_send_fine(sets, buckets), PACKED_DDL), buckets)
        apart, _ = _homes(fine, f"{what}-fine")
        small = small.unionByName(large.drop("home").join(apart, "node"))
    dealt, _ = dealt_rows(small, block)
    links.append(materialize(dealt.groupBy("task").applyInArrow(_compare(sets, percent, minima), LINKS), f"{what}-links"))
    every = links[0] if len(links) == 1 else links[0].union(links[1])
    return materialize(components(every), f"{what}-classes")
