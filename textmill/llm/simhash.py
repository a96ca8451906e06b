"""Operator 10: SimHash near-duplicate groups by bit-sliced comparison.

1. A text's words are the runs without ASCII white space, A-Z lower-cased; each run of
   ``words`` of them is a shingle (a shorter text is one shingle), repeats included. A
   fingerprint bit is 1 if it is set in over half of the shingles' hashes.
2. Equal fingerprints are one node, so copies are never compared.
3. A node goes to one bucket per table, keyed by some of its bits. For the contract's
   radius the tables hold every choice of two of four 16-bit blocks: two fingerprints
   that differ in at most two bits agree on such a choice, so no link is lost.
4. Inside a bucket fingerprints are compared bit-sliced: bit planes stand vertically, 64
   fingerprints to a machine word; a query's planes are added into carry-save counters
   that start so high that going beyond the radius overflows them; a block is left as
   soon as all of its lanes have overflowed. Buckets above ``BLOCK`` nodes are compared
   as pairs of blocks in different tasks. Only a forest of the nearest links leaves a task.
5. Components of the links come from rounds of smallest-neighbour stars, each written to
   the shared folder; nothing is collected.

``drop_near_duplicates`` (further below) is the same for a corpus at a Jaccard similarity.

Defined results: a null or empty text, or one without words, has the fingerprint zero
and is linked like any other; rows with equal ids or texts are kept each; a null id
takes part, but names a component only if all ids in it are null; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, map_slices, remove_written, written

#: Nodes of one block of a bucket.
BLOCK = 4096
#: Size of the bitmap that tells which texts to look up (4 MB).
FILTER_BITS = 1 << 25
#: Shingles counted at once: their bits fit 8-bit counters.
_AT_ONCE = 255
#: Bytes of a text that are cut into words at once.
_CHUNK = 1 << 16
_SPACE = re.compile(rb"[ \t-\r]")


def shingles(text: str | None, words: int) -> Iterator[bytes]:
    """The text's shingles in order; a long text is cut into words a chunk at a time."""
    raw, held, at, short = (text or "").encode().lower(), [], 0, True
    while at < len(raw):
        cut = _SPACE.search(raw, at + _CHUNK)
        end = cut.start() if cut else len(raw)
        tokens = held + raw[at:end].split()
        if len(tokens) >= words:
            short = False
            yield from map(b" ".join, zip(*(tokens[k:] for k in range(words))))
            held = tokens[len(tokens) - words + 1 :]
        else:
            held = tokens
        at = end
    if short and held:
        yield b" ".join(held)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in shingles(text, words)), np.uint64)


def _majority(first: np.ndarray, bits: int) -> bytes:
    """Fingerprint of hashes, highest bit first; those beyond 64 bits are mixed from the first with odd constants."""
    if not len(first):
        return bytes(bits // 8)
    counts = np.zeros(bits, np.int64)
    for k in range(0, len(first), _AT_ONCE):
        some = first[k : k + _AT_ONCE]
        lanes = np.empty((len(some), bits // 64), np.uint64)
        lanes[:, 0] = some
        for lane in range(1, bits // 64):
            h = some * np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * lane & 0xFFFFFFFFFFFFFFFF | 1)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            lanes[:, lane] = h ^ (h >> np.uint64(32))
        counts += np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(first), bitorder="little").tobytes()[::-1]


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Hashes of a text's distinct shingles, in order."""
    return np.unique(shingle_hashes(text, words))


def node_of_set(own: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(own.tobytes(), 42))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, words: int = 3, bits: int = 64) -> DataFrame:
    """``doc_id`` and ``fp`` (binary, highest bit first) of every text."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        fps = [_majority(shingle_hashes(t, words), bits) for t in part.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.binary())], names=["doc_id", "fp"])

    return map_slices(docs.select("doc_id", "text"), run, "doc_id long, fp binary")


def all_choices(bits: int, blocks: int, agree: int) -> list[np.ndarray]:
    """Tables on every choice of ``agree`` of ``blocks`` equal blocks: exact for radius ``blocks - agree``."""
    size = bits // blocks
    return [np.concatenate([np.arange(b * size, (b + 1) * size) for b in chosen]) for chosen in combinations(range(blocks), agree)]


def _keys(fps: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Bucket of every fingerprint in every table: shape (rows, tables)."""
    bit = np.unpackbits(fps, axis=1, bitorder="little").astype(np.int64)
    return np.stack([bit[:, t] @ (np.int64(1) << np.arange(len(t), dtype=np.int64)) + (np.int64(k) << 48) for k, t in enumerate(tables)], axis=1)


def _add(counters: list[np.ndarray], over: np.ndarray, planes: list[np.ndarray]) -> None:
    """Add up to seven one-bit planes into the counters; what overflows stays in ``over``."""
    weights: list[list[np.ndarray]] = [list(planes)] + [[] for _ in counters]
    for level, counter in enumerate(counters):
        queue = weights[level]
        while len(queue) > 1:
            a, b, c = queue.pop(), queue.pop(), queue.pop() if queue else counter
            if c is counter:
                odd = a ^ b
                weights[level + 1].append((a & b) | (odd & counter))
                counter ^= odd
                break
            odd = a ^ b
            weights[level + 1].append((a & b) | (odd & c))
            queue.append(odd ^ c)
        else:
            if queue:
                weights[level + 1].append(counter & queue[0])
                counter ^= queue[0]
    for carried in weights[len(counters)]:
        over |= carried


def within(plane: Callable[[int], np.ndarray], shape: tuple, bits: int, radius: int) -> np.ndarray:
    """Lanes whose number of set planes is at most ``radius``; leaves once none is left."""
    size = max(1, radius.bit_length())
    start = (1 << size) - 1 - radius
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    counters = [np.full(shape, full if start >> k & 1 else np.uint64(0), np.uint64) for k in range(size)]
    over = np.zeros(shape, np.uint64)
    for b in range(0, bits, 7):
        _add(counters, over, [plane(k) for k in range(b, min(b + 7, bits))])
        if b >= radius and (over == full).all():
            break
    return ~over


def _planes(bit: np.ndarray) -> np.ndarray:
    """Bit planes of rows (a multiple of 64): shape (bits, rows / 64)."""
    return np.packbits(np.ascontiguousarray(bit.T), axis=1, bitorder="little").view(np.uint64)


def _pairs(mask: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and lane numbers of the set bits, in order; ``base`` is the first lane of each word."""
    r, w = np.nonzero(mask)
    lanes = np.unpackbits(mask[r, w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    k, lane = np.nonzero(lanes)
    return r[k], base[r[k], w[k]] + lane


def _components(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest member of each local component."""
    label = np.arange(n) if label is None else label
    while len(a):
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        if (x == y).all():
            break
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return label


def _forest(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the pairs of a minimum spanning forest by distance: every component takes its nearest pair out, in rounds."""
    label, at, out = np.arange(n), np.arange(len(a)), [np.empty(0, np.int64)]
    key = d.astype(np.int64) * (len(a) + 1) + at
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return np.concatenate(out)
        a, b, at, key, x, y = (v[apart] for v in (a, b, at, key, x, y))
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, x, key)
        np.minimum.at(best, y, key)
        chosen = (best[x] == key) | (best[y] == key)
        out.append(at[chosen])
        label = _components(n, a[chosen], b[chosen], label)


def compared(fps: np.ndarray, runs: np.ndarray, radius: int, asks: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bit-sliced comparison of fingerprints (rows of bytes) that stand in runs of equal bucket.

    ``runs`` holds the start of each run and the end of the last. Short runs share words
    of 64 lanes; of a longer run each row that ``asks`` (all do by default) is compared
    with all of its words, a slice of rows at a time. Gives asking rows, a mask of the lanes
    within the radius (rows x words), the first lane of each word, and the lanes' rows
    (what stands in a lane without a row is never set).
    """
    bits, sizes = fps.shape[1] * 8, np.diff(runs)
    bit = np.unpackbits(fps, axis=1, bitorder="little")
    zero, ones = np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF)
    short = np.flatnonzero((sizes > 1) & (sizes <= 64))
    place, used = np.empty(len(short), np.int64), 0
    for k, size in enumerate(sizes[short].tolist()):  # a run never straddles two words
        if used % 64 + size > 64:
            used += 64 - used % 64
        place[k], used = used, used + size
    if len(short):
        rows = np.concatenate([np.arange(s, e) for s, e in zip(runs[short], runs[short + 1])])
        slot = np.concatenate([np.arange(p, p + s) for p, s in zip(place, sizes[short])])
        owner, run = np.full(-(-used // 64) * 64, -1), np.full(-(-used // 64) * 64, -1)
        owner[slot], run[slot] = rows, np.repeat(short, sizes[short])
        for k in range(0, len(owner), 64 * 256):
            own, at = owner[k : k + 64 * 256], run[k : k + 64 * 256]
            here = bit[np.maximum(own, 0)]
            planes = _planes(here)
            mask = within(lambda b: np.repeat(planes[b], 64) ^ np.where(here[:, b], ones, zero), (len(own),), bits, radius)
            same = at.reshape(-1, 1, 64) == at.reshape(-1, 64, 1)  # lanes of other runs share the word
            mask &= np.packbits(same & (own >= 0).reshape(-1, 1, 64), axis=2, bitorder="little").view(np.uint64).ravel()
            held = np.flatnonzero(own >= 0)
            yield own[held], mask[held, None], (held // 64 * 64)[:, None], own
    for k in np.flatnonzero(sizes > 64):
        start, end = runs[k], runs[k + 1]
        m = end - start
        wide = np.zeros((-(-m // 64) * 64, bits), np.uint8)
        wide[:m] = bit[start:end]
        planes = _planes(wide)
        valid = np.packbits(np.arange(len(wide)) < m, bitorder="little").view(np.uint64)
        asking = np.arange(start, end) if asks is None else start + np.flatnonzero(asks[start:end])
        for q in range(0, len(asking), 128):
            some = asking[q : q + 128]
            here = bit[some]
            mask = within(lambda b: planes[b][None, :] ^ np.where(here[:, b], ones, zero)[:, None], (len(some), len(valid)), bits, radius)
            yield some, mask & valid[None, :], np.broadcast_to(np.arange(len(valid)) * 64, mask.shape), np.arange(start, start + len(wide))


def linked(fps: np.ndarray, runs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest links, as a forest, of fingerprints in runs of equal bucket: rows, rows."""
    wide_words = np.ascontiguousarray(fps).view(np.uint64)
    found = [(np.empty(0, np.int64),) * 3]
    for rows, mask, base, owner in compared(fps, runs, radius):
        r, lane = _pairs(mask, base)
        a, b = rows[r], owner[lane]
        a, b = a[a < b], b[a < b]
        d = np.bitwise_count(wide_words[a] ^ wide_words[b]).sum(1, dtype=np.int64)
        took = _local_forest(a, b, d)
        found.append((a[took], b[took], d[took]))
    a, b, d = (np.concatenate(column) for column in zip(*found))
    took = _local_forest(a, b, d)
    return a[took], b[took]


def _local_forest(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    rows, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    return _forest(len(rows), place[: len(a)], place[len(a) :], d)


def node_of(fp: bytes) -> int:
    """The node of a fingerprint: 64 bits as they are, more by their hash (as Spark's ``xxhash64``)."""
    return _signed(int.from_bytes(fp, "big") if len(fp) == 8 else xxhash.xxh64_intdigest(fp, 42))


def links(nodes: DataFrame, tables: list[np.ndarray], radius: int, paths: list[str] | None = None) -> DataFrame:
    """The links between nodes, of each bucket a forest of nearest ones: ``u`` and ``v``, the smaller.

    A row of the shuffle is a bucket and the fingerprint.
    """

    def key_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for k in range(0, part.num_rows, 1024):
                rows = part.slice(k, 1024)
                fps = np.stack([np.frombuffer(x, np.uint8) for x in rows.column(0).to_pylist()])
                at = pa.array(np.repeat(np.arange(len(fps)), len(tables)))
                yield pa.RecordBatch.from_arrays([pa.array(_keys(fps, tables).ravel()), rows.column(0).take(at)], names=["key", "fp"])

    def keys_only(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in key_of(batches):
            yield part.select(["key"])

    def compare(rows: pa.Table) -> pa.RecordBatch:
        raw = rows.column("fp").to_pylist()
        a, b = linked(_stacked(raw), _runs(rows.column("key").to_numpy()), radius)
        node = {k: node_of(raw[k]) for k in {*a.tolist(), *b.tolist()}}
        pairs = {(max(node[x], node[y]), min(node[x], node[y])) for x, y in zip(a.tolist(), b.tolist())}
        u, v = zip(*pairs) if pairs else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    keyed = nodes.select("fp").mapInArrow(key_of, "key long, fp binary")
    large = large_buckets(nodes.select("fp").mapInArrow(keys_only, "key long"), paths)
    if not large.isEmpty():
        rows = join_hot(keyed, large, "key", nodes.count() * len(tables), "left")
        many = rows.where("blocks IS NOT NULL").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
        many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        many = many.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
        keyed = rows.where("blocks IS NULL").select("key", "fp").unionByName(many)
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(by_bucket(compare), "u long, v long")


def large_buckets(keys: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """``key``, ``blocks`` and rows ``n`` of buckets above ``BLOCK``: each is dealt out as blocks, in buckets of their own.

    Those numbers are hashed: should two meet in one number, they are compared together,
    which adds no link that isn't one.
    """
    counted = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return written(counted.where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).alias("blocks"), "n"), "buckets", paths)


def by_bucket(run: Callable[[pa.Table], pa.RecordBatch], at_once: int = 8 * BLOCK):
    """``run`` on tables of whole buckets, of about ``at_once`` rows, given batches in order of ``key``."""

    def buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for part in batches:
            held.append(part)
            size += part.num_rows
            if size < at_once:
                continue
            rows = pa.Table.from_batches(held)
            key = rows.column("key").to_numpy()
            change = np.flatnonzero(key[1:] != key[:-1])
            if len(change):  # the last bucket may go on in the next batch
                cut = int(change[-1]) + 1
                yield run(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
                size = rows.num_rows - cut
        if held:
            yield run(pa.Table.from_batches(held))

    return buckets


def _runs(key: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])


def _stacked(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)


def components(edges: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """``node`` and ``root`` (its component's smallest node) of all nodes in ``edges`` (``u``, ``v``).

    Each round gives every node's neighbours to the smallest of them, first the larger
    neighbours, then the others, until nothing changes. The leaves of a large star are
    dealt to several tasks.
    """

    def star(of: DataFrame, both: bool, total: int) -> DataFrame:
        near = of.unionByName(of.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else of
        low = near.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        joined = join_hot(near, low, "u", 2 * total)
        if both:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def state(of: DataFrame) -> tuple:
        return tuple(of.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    old: list[str] = []
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges", old)
    seen = state(now)
    while seen[0]:
        fresh: list[str] = []
        now = written(star(star(now, True, seen[0]), False, seen[0]), "edges", fresh)
        after = state(now)
        remove_written(edges.sparkSession, *old)
        old = fresh
        if after == seen:
            break
        seen = after
    if paths is not None:
        paths += old
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_groups(docs: DataFrame, words: int, bits: int, tables: list[np.ndarray], radius: int) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``: the smallest id that links lead to, its own included."""
    paths: list[str] = []
    marked = written(fingerprints(docs, words, bits), "simhash")
    total = marked.count()
    node = F.xxhash64("fp") if bits > 64 else F.conv(F.hex("fp"), 16, -10).cast("long")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("node", node)
    nodes = written(nodes, "nodes", paths)
    rooted = nodes.join(components(links(nodes, tables, radius, paths), paths).hint("merge"), "node", "left")
    rooted = written(rooted.select("fp", "first", F.col("n").alias("copies"), F.coalesce("root", "node").alias("root")), "rooted", paths)
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = written(join_hot(rooted, lowest, "root", total).select("fp", "component_id", F.col("copies").alias("n")), "named")
    remove_written(docs.sparkSession, *paths)
    return join_hot(marked, named, "fp", total).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The contract's groups: 64 bits over three words, links at two or fewer differing bits."""
    groups = near_groups(docs, words=3, bits=64, tables=all_choices(64, 4, 2), radius=2)
    return groups.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


#: Corpus de-duplication: five words, similarity of 0.8 or more. At a Jaccard similarity of
#: 0.8 (a cosine of 0.89) a bit differs with probability 0.152, so of 512 bits 78 do, with a
#: standard deviation of 8: the radius is three deviations beyond. Texts that have such a
#: neighbour are compared by fingerprints of 4,096 bits after that, with the radius alike.
CORPUS = {"words": 5, "bits": 512, "radius": 102, "wide": 4096, "wide_radius": 690, "similarity": 0.8}
#: Tables, and the least hashes that key a bucket. Single bits of a fingerprint tell too
#: little to key buckets of a large corpus (16 of them make 65,536 buckets, whatever the
#: rows), so here a table's key is the least shingle hash in each of four orders: two texts
#: of similarity s meet in it with probability s^4, in one of 16 tables with 0.9998 at 0.8.
#: The key has 64 bits, so texts meet by what they share, not by chance.
CORPUS_TABLES = (16, 4)
#: Groups into which the links of one hub are dealt, so that no task holds all of them.
DEALT = 4096
_ORDERS = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def least_keys(own: np.ndarray, tables: int, size: int) -> np.ndarray:
    """Bucket keys of a set of shingle hashes, one for each table."""
    if not len(own):
        return np.empty(0, np.int64)
    odd, least = _ORDERS[: tables * size, None], None
    for k in range(0, len(own), 4096):
        some = (own[None, k : k + 4096] * odd).min(1)
        least = some if least is None else np.minimum(least, some)
    mixed = np.arange(1, tables + 1, dtype=np.uint64)
    for order in least.reshape(tables, size).T:
        mixed = (mixed ^ order) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


def corpus_marks(docs: DataFrame, words: int, bits: int, tables: tuple[int, int]) -> DataFrame:
    """``id`` and ``same`` (its hash) of every row, its ``node`` (its set of shingles), ``fp``, ``size`` of the set, and bucket ``keys``."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, words) for t in part.column(2).to_pylist()]
        columns = [
            pa.array([node_of_set(x) for x in sets], pa.int64()), pa.array([_majority(x, bits) for x in sets], pa.binary()),
            pa.array([len(x) for x in sets], pa.int64()), pa.array([least_keys(x, *tables) for x in sets], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["id", "same", "node", "fp", "size", "keys"])

    rows = docs.select(docs["doc_id"].alias("id"), row_hash(docs).alias("same"), docs["text"].alias("text"))
    return map_slices(rows, run, "id long, same long, node long, fp binary, size long, keys array<long>")


def _compare_by(radius: int, similarity: float, best: bool):
    """Compares buckets of rows ``key, node, part, size, ask, pivot, far, fp``: ``hub``, ``leaf``, their parts, ``rank``.

    Nodes whose parts differ and whose sizes allow the similarity are linked if they are
    within the radius. Two nodes whose Jaccard distances ``far`` from the same ``pivot``
    differ by more than that of a link can't be alike (the distance is a metric). ``ask`` is 1 for rows that are only compared with others, 0 for
    those that others are only compared with, 2 for both. With ``best`` a node is linked
    only to that of its neighbours that has most neighbours (``rank``); the rest of the
    nodes of a dealt bucket (``ask`` 3, as 2) come out without a hub.
    """

    def run(rows: pa.Table) -> pa.RecordBatch:
        key, node, part, size, ask, pivot, far = (rows.column(c).to_numpy() for c in ("key", "node", "part", "size", "ask", "pivot", "far"))
        runs, fps = _runs(key), _stacked(rows.column("fp").to_pylist())
        low, high = size * similarity, size / similarity

        def pairs(asking, mask, base, owner) -> tuple[np.ndarray, np.ndarray]:
            r, lane = _pairs(mask, base)
            a, b = asking[r], owner[lane]
            ok = (part[a] != part[b]) & (ask[a] > 0) & (ask[b] != 1) & (size[b] >= low[a] - 1e-9) & (size[b] <= high[a] + 1e-9)
            ok &= (pivot[a] != pivot[b]) | (np.abs(far[a] - far[b]) <= 1 - similarity + 1e-9)
            return a[ok], b[ok]

        none = np.empty(0, np.int64)
        if not best:
            found = [(none, none)]
            for block in compared(fps, _mixed(runs, part), radius, ask > 0):
                a, b = pairs(*block)
                once = (ask[a] == 1) | (a < b)
                found.append((a[once], b[once]))
            a, b = (np.concatenate(c) for c in zip(*found))
            hub, rank = pa.array(node[a], pa.int64()), np.zeros(len(a), np.int64)
        else:
            blocks = list(compared(fps, runs, radius))
            degree = np.zeros(len(node), np.int64)
            for asking, mask, _, _ in blocks:
                degree[asking] += np.bitwise_count(mask).sum(1, dtype=np.int64)
            order = np.lexsort((node, -degree))
            place = np.empty(len(node), np.int64)
            place[order] = np.arange(len(node))
            nearest = place.copy()
            for block in blocks:
                a, b = pairs(*block)
                np.minimum.at(nearest, a, place[b])
            b = np.flatnonzero((nearest < place) | (ask == 3))
            a = order[nearest[b]]
            hub, rank = pa.array(node[a], pa.int64(), mask=a == b), degree[a]
        columns = [hub, *(pa.array(x, pa.int64()) for x in (node[b], part[a], part[b], rank))]
        return pa.RecordBatch.from_arrays(columns, names=["hub", "leaf", "hub_part", "leaf_part", "rank"])

    return by_bucket(run, BLOCK if not best else 8 * BLOCK)


def _mixed(runs: np.ndarray, part: np.ndarray) -> np.ndarray:
    """``runs`` with those of one part only cut into single rows, which are not compared."""
    starts, sizes = runs[:-1], np.diff(runs)
    if not len(part):
        return runs
    one = np.minimum.reduceat(part, starts) == np.maximum.reduceat(part, starts)
    return np.unique(np.concatenate([runs, np.flatnonzero(np.repeat(one, sizes))]))


_LINK = "hub long, leaf long, hub_part long, leaf_part long, rank long"


def _compared(rows: DataFrame, radius: int, similarity: float, best: bool) -> DataFrame:
    rows = rows.select("key", "node", "part", "size", "ask", "pivot", "far", "fp").repartition("key").sortWithinPartitions("key", "node")
    return rows.mapInArrow(_compare_by(radius, similarity, best), _LINK)


def near_parts(docs: DataFrame, nodes: DataFrame, words: int, radius: int, wide: int, wide_radius: int, similarity: float, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """The ``part`` of every ``node`` that has a neighbour, and the ``root`` of parts that belong together.

    Every pair of a bucket that is within the radius and could be similar enough is
    either joined already or tested on the two sets of shingles:

    1. each node is tested against the neighbour that has most neighbours (in a large
       bucket, among those dealt to the same block): the centre of a group of copies;
    2. in large buckets, all nodes against the one that most tests have confirmed;
    3. in all buckets, whatever pairs of nodes are not joined by now.
    """
    nodes = nodes.where("size > 0")
    key = F.explode("keys").alias("key")
    large = large_buckets(nodes.select(key), paths)
    total = nodes.select(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    dealt = not large.isEmpty()
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    rows = nodes.select(key, "node", F.col("node").alias("part"), "size", F.col("node").alias("pivot"), F.lit(0.0).alias("far"), "fp")
    if dealt:
        rows = join_hot(rows, large, "key", total, "left").withColumns({"key": F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", block)), "ask": F.when(F.col("blocks").isNull(), 2).otherwise(3)})
    else:
        rows = rows.withColumn("ask", F.lit(2))
    first = _compared(rows, radius, similarity, True)
    first = first.groupBy("leaf").agg(F.max_by("hub", F.struct(F.col("hub").isNotNull(), "rank", "hub")).alias("hub"))
    first = written(first, "near", paths)
    near = first.where("hub IS NOT NULL")
    known = first.select(F.col("leaf").alias("node")).unionByName(near.select(F.col("hub").alias("node"))).distinct()
    known = written(nodes.join(known.hint("merge"), "node", "left_semi"), "known", paths)
    sets = written(shingle_sets(docs, known, words, wide), "sets", paths)
    edges, own = (F.col("hub").alias("u"), F.col("leaf").alias("v")), ("part", "size", "pivot", "far", "fp")
    tested = written(confirmed(near, sets, similarity), "tested", paths)
    alike = tested.where("alike").select(*edges)
    pivots = tested.select(F.col("leaf").alias("node"), F.col("hub").alias("pivot"), (1 - F.col("jaccard")).alias("far"))
    known = known.drop("fp").join(sets.select("node", F.col("wide").alias("fp")).hint("merge"), "node")
    known = known.join(pivots.hint("merge"), "node", "left").withColumns({"pivot": F.coalesce("pivot", "node"), "far": F.coalesce("far", F.lit(0.0))})
    known = written(known, "known", paths)
    now = _parted(known, components(alike, paths), paths)
    if dealt:
        degree = alike.groupBy(F.col("u").alias("node")).count()
        held = join_hot(now.select(key, "node", *own), large, "key", total)
        centre = held.join(degree, "node").groupBy("key", "blocks").agg(F.max_by(F.struct("node", *own), F.struct("count", "node")).alias("c"))
        asks = centre.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "c.*")
        asks = asks.select(F.xxhash64("key", "block").alias("key"), "node", *own, F.lit(1).alias("ask"))
        rows = held.withColumns({"key": F.xxhash64("key", block), "ask": F.lit(0)}).select(asks.columns).unionByName(asks)
        found = _compared(rows, wide_radius, similarity, False).groupBy("leaf").agg(F.max("hub").alias("hub"))
        second = written(confirmed(written(found, "near", paths), sets, similarity), "tested", paths)
        now = _parted(known, components(alike.unionByName(second.where("alike").select(*edges)), paths), paths)
    rows = now.select(key, "node", *own)
    if dealt:
        rows = join_hot(rows, large, "key", total, "left")
        few, many = rows.where("blocks IS NULL").drop("blocks"), rows.where("blocks IS NOT NULL")
        rows = few.withColumn("ask", F.lit(2)).unionByName(_left_over(many, total))
    else:
        rows = rows.withColumn("ask", F.lit(2))
    found = _compared(rows, wide_radius, similarity, False)
    last = found.groupBy(F.least("hub", "leaf").alias("a"), F.greatest("hub", "leaf").alias("b")).agg(F.max(F.struct("hub", "leaf", "hub_part", "leaf_part")).alias("x"))
    last = written(last.select("x.*"), "near", paths)
    joined = confirmed(last, sets, similarity).where("alike").join(last.hint("merge"), ["hub", "leaf"])
    again = components(joined.select(F.col("hub_part").alias("u"), F.col("leaf_part").alias("v")), paths)
    return now.select("node", "part"), again.select(F.col("node").alias("part"), "root")


def _parted(known: DataFrame, roots: DataFrame, paths: list[str]) -> DataFrame:
    joined = known.join(roots.hint("merge"), "node", "left").withColumn("part", F.coalesce("root", "node"))
    return written(joined.select("node", "part", "size", "pivot", "far", "fp", "keys"), "parted", paths)


def _left_over(held: DataFrame, total: int) -> DataFrame:
    """Rows of large buckets as blocks: nodes outside a bucket's greatest part against all of its nodes.

    Buckets in which all are joined give nothing.
    """
    by_part = held.groupBy("key", "part").count()
    by_key = by_part.groupBy("key").agg(F.max_by("part", F.struct("count", "part")).alias("most"), F.max("count").alias("top"), F.sum("count").alias("n"))
    by_key = by_key.where("top < n").select("key", "most", F.ceil((F.col("n") - F.col("top")) / BLOCK).alias("rest"), "n")
    rows = join_hot(held, by_key, "key", total)
    up_to = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(c))
    members = rows.select("*", own("blocks").alias("m"), up_to("rest").alias("r"), F.lit(0).alias("ask"))
    asks = rows.where("part <> most").select("*", own("rest").alias("r"), up_to("blocks").alias("m"), F.lit(1).alias("ask"))
    return members.unionByName(asks).select(F.xxhash64("key", "m", "r").alias("key"), "node", "part", "size", "pivot", "far", "fp", "ask")


def shingle_sets(docs: DataFrame, asked: DataFrame, words: int, wide: int) -> DataFrame:
    """``node``, ``shingles`` and a ``wide`` fingerprint of the nodes ``asked``.

    Only one row of each is dealt out: a bitmap of fixed size on the row's hash keeps
    most others from it, the node tells the rest apart.
    """
    place = F.col("first.same").bitwiseAND(FILTER_BITS - 1)
    parts = asked.select(F.shiftright(place, 15).alias("part"), place.bitwiseAND(0x7FFF).alias("bit"))
    bitmap = np.zeros((FILTER_BITS >> 15, 4096), np.uint8)
    for part, held in parts.groupBy("part").agg(F.bitmap_construct_agg("bit")).collect():
        bitmap[part] = np.frombuffer(held, np.uint8)
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap.ravel())

    def sets(part: pa.RecordBatch) -> pa.RecordBatch:
        at = part.column(0).to_numpy() & (FILTER_BITS - 1)
        hit = np.flatnonzero(bitmap.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
        found = [shingle_set(part.column(1)[int(k)].as_py(), words) for k in hit]
        columns = [pa.array([node_of_set(x) for x in found], pa.int64()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([_majority(x, wide) for x in found], pa.binary())], names=["node", "shingles", "wide"])

    looked_up = map_slices(docs.select(row_hash(docs).alias("same"), docs["text"].alias("text")), sets, "node long, shingles array<long>, wide binary")
    return looked_up.groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("wide").alias("wide")).join(asked.select("node").hint("merge"), "node", "left_semi")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``hub``, ``leaf``, their ``jaccard`` similarity and whether it makes them ``alike``.

    The links of a hub are dealt into groups by their leaf, and its set is sent to each
    group once, so that no task has all links of a hub, and no link carries its hub's set.
    """
    group = F.pmod(F.xxhash64("leaf"), F.lit(DEALT)).alias("group")
    pairs, sets = pairs.select("hub", "leaf", group), sets.select("node", "shingles")
    leaves = pairs.join(sets.hint("merge"), pairs["leaf"] == sets["node"]).select("hub", "group", "leaf", "shingles")
    hubs = pairs.select("hub", "group").distinct().join(sets.hint("merge"), F.col("hub") == sets["node"]).select("hub", "group", F.lit(None).cast("long").alias("leaf"), "shingles")
    rows = leaves.unionByName(hubs).repartition("hub", "group").sortWithinPartitions("hub", "group", F.col("leaf").asc_nulls_first())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.empty(0, np.int64)
        for part in batches:
            hubs, leaves, found = [], [], []
            lists = part.column(3)
            starts, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for k, (hub, leaf) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist())):
                other = values[starts[k] : starts[k + 1]].view(np.uint64)
                if leaf is None:
                    own = other.copy()
                    continue
                at = np.searchsorted(own, other).clip(0, len(own) - 1)
                shared = int((own[at] == other).sum())
                hubs.append(hub)
                leaves.append(leaf)
                found.append(shared / (len(own) + len(other) - shared))
            columns = [pa.array(hubs, pa.int64()), pa.array(leaves, pa.int64()), pa.array(found, pa.float64()), pa.array([x >= similarity - 1e-9 for x in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["hub", "leaf", "jaccard", "alike"])

    return rows.mapInArrow(run, "hub long, leaf long, jaccard double, alike boolean")


def similar_groups(
    docs: DataFrame, words: int, bits: int, radius: int, wide: int, wide_radius: int, similarity: float, tables: tuple[int, int], paths: list[str]
) -> tuple[DataFrame, DataFrame]:
    """``id`` and ``same`` of each group's row of smallest id (null after all others), and of the rows that are there more than once."""
    marked = written(corpus_marks(docs, words, bits, tables), "simhash", paths)
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "same")).alias("first")
    nodes = marked.groupBy("node").agg(first, F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    nodes = written(nodes, "nodes", paths)
    now, again = near_parts(docs, nodes, words, radius, wide, wide_radius, similarity, paths)
    by_part = nodes.select("node", "first").join(now.hint("merge"), "node", "left").groupBy(F.coalesce("part", "node").alias("part")).agg(F.min("first").alias("first"))
    groups = by_part.join(again.hint("merge"), "part", "left").groupBy(F.coalesce("root", "part").alias("root")).agg(F.min("first").alias("first"))
    return groups.select("first.id", "first.same"), marked.groupBy("id", "same").count().where("count > 1").select("id", "same")


def row_hash(docs: DataFrame) -> Column:
    """With the id it tells rows apart, but for those that share id and text."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all of their columns, of which each group keeps one: that of its smallest id.

    A text's words and shingles are as in the query; a group is what links join, and two
    texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8
    or more: fingerprints of the sets are compared bit-sliced within buckets, and every
    pair within the radius is confirmed on the sets themselves.

    Texts without words are one group. Of rows that share id and text one stays; of a
    group in which no row has an id, one row stays; an empty table gives no rows.
    """
    paths: list[str] = []
    groups, often = similar_groups(docs, **CORPUS, tables=CORPUS_TABLES, paths=paths)
    kept = written(groups, "keepers")
    often = written(often.join(kept.hint("merge"), _same(often, kept), "left_semi"), "often")
    remove_written(docs.sparkSession, *paths)
    if not often.isEmpty():
        kept = kept.join(often, _same(kept, often), "left_anti")
    # the same plan at every size: rows are dealt out by id and text once
    out = docs.join(kept.hint("merge"), docs["doc_id"].eqNullSafe(kept["id"]) & (row_hash(docs) == kept["same"]), "left_semi")
    if often.isEmpty():
        return out
    rows = docs.join(often.hint("merge"), docs["doc_id"].eqNullSafe(often["id"]) & (row_hash(docs) == often["same"]), "left_semi")
    rows = rows.select(F.struct(*(rows[c] for c in rows.columns)).alias("row"), rows["doc_id"].alias("id"), row_hash(rows).alias("same"))
    return out.unionByName(rows.groupBy("id", "same").agg(F.first("row").alias("row")).select("row.*"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["same"] == b["same"])
