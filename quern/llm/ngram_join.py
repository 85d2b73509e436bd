"""N-gram Jaccard join: subsets of small sets, prefixes of the rarest grams of all others."""

from __future__ import annotations

import math
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import ragged
from quern.llm.components import components
from quern.llm.shared import map_arrow, materialize, need, table, without_ids

#: Words of a gram and the Jaccard similarity from which two documents are near duplicates.  Above 1/2,
#: sets of one gram have no partner but their equals, and larger ones share at least two grams with any.
N, THRESHOLD = 3, 0.55
#: Bits of a gram's hash by which it is counted and posted; grams of a part that is counted at once, on average;
#: grams, and texts, that a worker packs at once.
BITS, PART, PACK, TEXTS = 40, 1 << 21, 1 << 21, 1 << 16
#: Lists up to this long give all their pairs at once.  Longer ones give stars and then the pairs that no star
#: has connected, in blocks of BLOCK sets.
LIGHT, BLOCK = 64, 1024
#: Pairs in a batch that a worker emits.
PAIRS = 1 << 18
#: One in so many grams, by hash, goes into the statistic from which the boundary is chosen.
STATISTIC = 1024
#: Subsets of small sets have two grams; a small set has so many of them at most.
SUBSET, MOST = 2, 2560

_ORDER, _PRINT = (np.uint64(x) for x in (0x8E9D5A1C3B7F2461, 0xD6E8FEB86659FD93))


class Sets:
    """Distinct grams of each text of a slice, sorted by text and hash; a text of fewer than n words is one gram."""

    def __init__(self, col: pa.Array, lo: int, hi: int, n: int):
        w = ragged.words(col, lo, hi)
        h, at = w.ngrams(n)
        doc = w.doc[at]
        count = np.diff(w.first)
        for i in np.flatnonzero((count > 0) & (count < n)):
            g = w.hash[w.first[i] : w.first[i + 1]]
            pw, _ = ragged.powers(64)
            h = np.append(h, ragged.mix(np.sum(g * pw[1 : g.size + 1], keepdims=True) + np.uint64(g.size)))
            doc = np.append(doc, i)
        # the upper 48 bits of each hash, which sort with the text's number in one word
        own = np.sort(doc.astype(np.uint64) << np.uint64(48) | h >> np.uint64(16))
        own = own[np.append(True, own[1:] != own[:-1])] if own.size else own
        self.hash, self.doc = own << np.uint64(16), (own >> np.uint64(48)).astype(np.int64)
        self.size = np.bincount(self.doc, minlength=hi - lo)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        acc = np.zeros(self.hash.size + 1, np.uint64)
        np.cumsum(ragged.mix(self.hash ^ _PRINT), out=acc[1:])
        #: a fingerprint of each set, which names it in the join
        self.node = ragged.mix(acc[self.start[1:]] - acc[self.start[:-1]] + self.size.astype(np.uint64)).view(np.int64)


def postings(s: Sets, boundary: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(list, text index): subsets of small sets, with an odd number."""
    lists, docs = [s.hash[:0]], [s.doc[:0]]
    order_of = ragged.mix(s.hash ^ _ORDER)
    for k in range(SUBSET, boundary + 1):
        own = np.flatnonzero(s.size == k)
        if not own.size:
            continue
        p = k - math.ceil(threshold * k - 1e-9) + SUBSET
        at = s.start[own][:, None] + np.arange(k)
        ordered = np.take_along_axis(s.hash[at], np.argsort(order_of[at], axis=1, kind="stable"), 1)[:, : min(p, k)]
        i, j = np.triu_indices(ordered.shape[1], 1)
        lists.append(ragged.mix(np.ravel(ordered[:, i] + np.uint64(3) * ordered[:, j])) | np.uint64(1))
        docs.append(np.repeat(own, i.size))
    return np.concatenate(lists), np.concatenate(docs)


def _planes(values: np.ndarray, width: int) -> bytes:
    """The lower `width` bytes of 64-bit values, byte by byte."""
    return values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _values(raw: bytes, n: int, width: int, at: int = 0) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    for k, plane in enumerate(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)):
        out |= plane.astype(np.uint64) << np.uint64(8 * k)
    return out


def _encoded(gram: np.ndarray, doc: np.ndarray, more: bytes = b"") -> bytes:
    """Sorted grams as differences, in as many bytes as the largest takes, and their texts' numbers in two."""
    step = np.diff(gram)
    width = (int(step.max(initial=1)).bit_length() + 7) // 8
    return bytes([width]) + gram[:1].tobytes() + _planes(step, width) + doc.astype(np.uint16).tobytes() + more


def _decoded(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Grams, texts' numbers, and where further bytes begin."""
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint16), len(raw)
    width = raw[0]
    step = np.concatenate([np.frombuffer(raw, np.uint64, 1, 1), _values(raw, n - 1, width, 9)])
    at = 9 + (n - 1) * width
    return np.cumsum(step, dtype=np.uint64), np.frombuffer(raw, np.uint16, n, at), at + 2 * n


_PACKED = "part int, slice long, n int, grams binary, nodes binary, sizes binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "slice", "n", "grams", "nodes", "sizes"])


def packed_grams(it, n: int, least: int, bits: int):
    """All grams of the sets of `least` grams or more, packed by parts of the hashes' range, 2**bits of them.

    The texts that are packed together, a slice, are numbered; their nodes and sizes go with its first part.
    """
    grams, nodes, sizes, names = [], [], [], count(TaskContext.get().partitionId() << 32)

    def done():
        word, node, size = np.sort(np.concatenate(grams)), np.concatenate(nodes), np.concatenate(sizes)
        told = np.sum(ragged.mix(node.view(np.uint64) + np.arange(node.size, dtype=np.uint64)), keepdims=True)  # by its texts too, lest other ones are taken for them
        name = int(ragged.mix(told ^ ragged.mix(np.array([next(names)], np.uint64))).view(np.int64)[0])
        gram, doc = word >> np.uint64(16), word & np.uint64(0xFFFF)
        ends = np.searchsorted(gram, np.arange(1, (1 << bits) + 1, dtype=np.uint64) << np.uint64(BITS - bits))
        rows, i = [], 0
        for part, j in enumerate(ends.tolist()):
            if i < j:
                own = (None, None) if rows else (node.tobytes(), size.astype(np.int32).tobytes())
                rows.append((part, name, j - i, _encoded(gram[i:j], doc[i:j]), *own))
            i = j
        for c in (grams, nodes, sizes):
            c.clear()
        return _batch(rows)

    for _, col in ragged.batches(it, "text"):
        for lo, hi in ragged.slices(col):
            s = Sets(col, lo, hi, n)
            large = s.size >= least
            if not large.any():
                continue
            if sum(c.size for c in nodes) + large.sum() > TEXTS:
                yield done()
            number = np.cumsum(large) - 1 + sum(c.size for c in nodes)
            own = large[s.doc]
            grams.append(s.hash[own] >> np.uint64(64 - BITS) << np.uint64(16) | number[s.doc[own]].astype(np.uint64))
            nodes.append(s.node[large])
            sizes.append(s.size[large])
            if sum(c.size for c in grams) >= PACK:
                yield done()
    if grams:
        yield done()


def repeated_grams(it):
    """Of the packed grams, by part: those that more than one text holds, with the class of their number of texts in a byte more."""
    for part, rows in _groups_of(it, 1):
        found = [_decoded(raw, n)[0] for _, n, raw, _, _ in rows]
        heads = [np.flatnonzero(np.append(True, g[1:] != g[:-1])) for g in found]
        gram = np.concatenate([g[h] for g, h in zip(found, heads)])
        times = np.concatenate([np.diff(np.append(h, g.size)) for g, h in zip(found, heads)])
        order = np.argsort(gram, kind="stable")
        gram, times = gram[order], times[order]
        head = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        gram, times = gram[head], np.add.reduceat(times, head)
        gram, level = gram[times > 1], np.floor(8 * np.log2(times[times > 1])).astype(np.uint8)
        out = []
        for (name, n, raw, nodes, sizes), g in zip(rows, found):
            at = np.searchsorted(gram, g)
            at[at == gram.size] = 0
            own = np.flatnonzero(gram[at] == g) if gram.size else np.empty(0, np.int64)
            if own.size or nodes is not None:
                _, doc, _ = _decoded(raw, n)
                out.append((part[0], name, own.size, _encoded(g[own], doc[own], level[at[own]].tobytes()) if own.size else b"", nodes, sizes))
        if out:
            yield _batch(out)


def prefixes(it, threshold: float):
    """(list, node, size, place) of the grams by which a set is found: as many of its rarest as leave too few for any partner.

    Grams are ordered by the class of their number of texts, then by hash, the same for all sets, so that two sets of
    the threshold share one of these.  Grams of one text come first; they take places and aren't posted.
    """
    for _, rows in _groups_of(it, 1, first=1):
        keys, node, size = [], None, None
        for _, n, raw, nodes, sizes in rows:
            if nodes is not None:
                node, size = np.frombuffer(nodes, np.int64), np.frombuffer(sizes, np.int32).astype(np.int64)
            if n:
                gram, doc, at = _decoded(raw, n)
                level = np.frombuffer(raw, np.uint8, n, at)
                keys.append(doc.astype(np.uint64) << np.uint64(48) | level.astype(np.uint64) << np.uint64(40) | gram)
        key = np.sort(np.concatenate(keys)) if keys else np.empty(0, np.uint64)
        doc = (key >> np.uint64(48)).astype(np.int64)
        times = np.bincount(doc, minlength=node.size)
        alone = size - times
        place = np.arange(key.size) - (np.cumsum(times) - times)[doc] + alone[doc]
        post = place <= (size - np.ceil(threshold * size - 1e-9).astype(np.int64))[doc]
        key, doc, place = key[post], doc[post], place[post]
        lists = (key & np.uint64((1 << BITS) - 1)) << np.uint64(1)
        yield pa.RecordBatch.from_arrays([pa.array(lists.view(np.int64)), pa.array(node[doc]), pa.array(size[doc].astype(np.int32)), pa.array(place.astype(np.int32))], names=["list", "node", "size", "place"])


def list_pairs(key: np.ndarray, node: np.ndarray, size: np.ndarray, place: np.ndarray, threshold: float):
    """Of whole lists, sorted by list, size, node and place: all candidate pairs (a, b) with a < b."""
    new = np.ones(key.size, bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    k, n, z, p = key[new], node[new], size[new], place[new]
    found = [(n[:0], n[:0])]
    for d in range(1, k.size):
        i = np.flatnonzero(k[:-d] == k[d:])
        if not i.size:
            break
        i = i[_may_match(z[i], z[i + d], p[i], p[i + d], threshold)]
        found.append((np.minimum(n[i], n[i + d]), np.maximum(n[i], n[i + d])))
    a, b = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    once = np.ones(a.size, bool)
    once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[once], b[once]


def _may_match(x, y, i, j, threshold: float):
    """Whether sets of sizes x and y reach the threshold if the first gram that they share is at places i and j.

    It is asked of each gram that they share; the first of them tells, so none is lost.
    """
    return np.minimum(x - i, y - j) * (1 + threshold) >= threshold * (x + y) - 1e-6


def block_pairs(left: tuple, right: tuple | None, threshold: float):
    """Candidate pairs of a block of a heavy list, or of two blocks, each (nodes, sizes, places, components), whose
    components differ; in parts of about PAIRS."""
    order = np.argsort((left if right is None else right)[1], kind="stable")
    y, zy, py, cy = (c[order] for c in (left if right is None else right))
    x, zx, px, cx = (y, zy, py, cy) if right is None else left
    lo = np.arange(x.size) + 1 if right is None else np.searchsorted(zy, np.floor(zx * threshold), side="left")
    n = np.maximum(np.searchsorted(zy, np.ceil(zx / threshold), side="right") - lo, 0)
    ends, at = np.cumsum(n), 0
    while at < x.size:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        m = n[at:to]
        i = np.repeat(np.arange(at, to), m)
        j = np.arange(i.size) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[at:to], m)
        apart = (cx[i] != cy[j]) & _may_match(zx[i], zy[j], px[i], py[j], threshold)
        i, j = i[apart], j[apart]
        if i.size:
            yield np.minimum(x[i], y[j]), np.maximum(x[i], y[j])
        at = to


def choose_boundary(histogram: dict[int, int], partners: float, threshold: float = THRESHOLD) -> int:
    """The size up to which sets are small: the one of least total cost.

    A small set costs its subsets; a large one costs its packed grams, a quarter each, and for each of its prefix
    a posting and the `partners` that a list of rare grams holds on average, which are sent and then compared.
    """
    sizes = sorted(histogram)
    small = lambda k: math.comb(min(k, k - math.ceil(threshold * k - 1e-9) + SUBSET), 2)
    large = lambda k: k / 4 + (k - math.ceil(threshold * k - 1e-9) + 1) * (1 + 2 * partners)
    best, cost = 1, sum(n * large(k) for k, n in histogram.items() if k >= SUBSET)
    at_one = cost
    for x in sizes:
        if x < SUBSET or small(x) > MOST:
            continue
        at_one += histogram[x] * (small(x) - large(x))
        # those that may match a large set are posted twice
        both = sum(histogram[k] * large(k) for k in sizes if math.ceil(threshold * x) <= k <= x)
        if at_one + both < cost:
            best, cost = x, at_one + both
    return best


def _candidates(pairs: DataFrame, name: str) -> DataFrame:
    return materialize(pairs.dropDuplicates(["a", "b"]), name)


def _linked(docs: DataFrame, n: int, threshold: float, text: str, key: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(doc_id, node, size) of the documents, (node, component) of those that links connect, and the sets of
    candidates (node, grams), in which every link between different sets is inside a component.

    Documents with equal sets are one node of the join, of which one document posts.  Small nodes, up to a
    boundary chosen by cost from the histogram of sizes, are matched by subsets of two grams out of the
    prefix that any partner must share; large ones, as are small ones that may match a large one, by the lists of
    a prefix of their rarest grams.  Both are exact.  How many texts hold a gram is counted by parts of the
    hashes' range, to which texts go packed, a few bytes a gram; what one text alone holds goes no further, and a
    text of which too little is repeated has no partner and posts nothing.  Lists of one node go no further.
    Light lists give all their pairs.  In heavy ones a node is first paired with four of its
    size band, the same for all, which is enough for most groups of near copies; then all pairs of a heavy list that are
    not yet in one component are candidates as well, list by list in blocks spread over tasks.
    """
    if not 0.5 < threshold <= 1:
        raise ValueError("threshold must be above 0.5")
    own = need(docs, key, text).toDF("doc_id", "text").where("doc_id is not null and text is not null")

    def measure(it):
        for batch, col in ragged.batches(it, "text"):
            ids = np.asarray(batch.column(0).cast(pa.int64()))
            for lo, hi in ragged.slices(col):
                s = Sets(col, lo, hi, n)
                has = np.flatnonzero(s.size)
                pick = s.hash[(s.hash >> np.uint64(16)) % np.uint64(STATISTIC) == 0].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([ids[lo:hi][has], pick])), pa.array(np.concatenate([s.node[has], np.zeros(pick.size, np.int64)])), pa.array(np.concatenate([s.size[has], np.zeros(pick.size, np.int64)]).astype(np.int32))],
                    names=["id", "node", "size"],
                )

    measured = materialize(map_arrow(own, measure, "id long, node long, size int"), "join-sizes")
    meta = measured.where("size > 0").select(F.col("id").alias("doc_id"), "node", "size")
    histogram = {r[0]: r[1] for r in meta.groupBy("size").count().collect()}  # one row for each length
    counts = measured.where("size = 0").groupBy("id").count().groupBy("count").agg(F.count("*").alias("n")).collect()  # one row for each length of list
    partners = _partners({r[0]: r[1] for r in counts}, threshold)
    boundary = choose_boundary(histogram, partners, threshold)
    firsts = meta.groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    own = without_ids(own, meta.select("doc_id").join(firsts, "doc_id", "left_anti"))

    least = max(SUBSET, math.ceil(threshold * boundary - 1e-9))  # of these none that is smaller matches a large one
    bits = min(16, max(0, math.ceil(math.log2(max(1, sum(k * v for k, v in histogram.items()) / PART)))))
    packed = map_arrow(own, lambda it: packed_grams(it, n, least, bits), _PACKED).repartition("part").sortWithinPartitions("part")
    again = map_arrow(packed, repeated_grams, _PACKED).repartition("slice").sortWithinPartitions("slice")
    post = map_arrow(again, lambda it: prefixes(it, threshold), "list long, node long, size int, place int")

    def subsets(it):
        for _, col in ragged.batches(it, "text"):
            for lo, hi in ragged.slices(col):
                s = Sets(col, lo, hi, n)
                lists, doc = postings(s, boundary, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(lists.view(np.int64)), pa.array(s.node[doc]), pa.array(s.size[doc].astype(np.int32)), pa.array(np.zeros(doc.size, np.int32))], names=["list", "node", "size", "place"])

    def pair(it):
        for key, node, size, place in _whole(it, 1):
            yield _rows(*list_pairs(key, node, size, place, threshold))

    if boundary >= SUBSET:
        post = post.unionByName(map_arrow(own, subsets, "list long, node long, size int, place int"))
    posted = materialize(post, "join-postings")
    counted = posted.join(posted.groupBy("list").agg(F.count("*").alias("length")).where("length > 1"), "list")
    light = counted.where(F.col("length") <= LIGHT).select("list", "node", "size", "place").repartition("list").sortWithinPartitions("list", "size", "node", "place")
    kept = materialize(counted.where(F.col("length") > LIGHT).groupBy("list", "node").agg(F.min("size").alias("size"), F.min("place").alias("place")), "join-heavy")
    # bands overlap, so that sizes that are near each other share one
    place = F.log("size") / math.log(1 / threshold) if threshold < 1 else F.col("size")
    banded = kept.withColumn("band", F.explode(F.array((2 * F.floor(place)).cast("int"), (2 * F.floor(place + 0.5)).cast("int") + 1)))
    ends = [F.struct("node", "size", "place"), F.struct(F.xxhash64("node").alias("order"), "node", "size", "place")]
    hubs = banded.groupBy("list", "band").agg(F.array(*[f(e).dropFields("order") if e is ends[1] else f(e) for e in ends for f in (F.min, F.max)]).alias("hubs"))
    hubs = hubs.select("list", "band", F.explode(F.array_distinct("hubs")).alias("hub"))
    near = F.least(F.expr("size - place"), F.expr("hub.size - hub.place")) * (1 + threshold) >= F.expr("size + hub.size") * threshold - 1e-6
    star = banded.join(hubs, ["list", "band"]).where((F.col("node") != F.col("hub.node")) & near)
    star = star.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))
    candidates = _candidates(map_arrow(light, pair, "a long, b long").unionByName(star), "join-candidates")
    sets = _sets_of(own, candidates, n)
    verified = materialize(_verified(candidates, sets, threshold), "join-verified")
    joined = components(verified)

    if not kept.isEmpty():
        more = _candidates(_across(kept, joined, threshold), "join-candidates")
        if not more.isEmpty():
            new = more.select(F.explode(F.array("a", "b")).alias("a")).join(sets.select(F.col("node").alias("a")), "a", "left_anti").withColumn("b", F.col("a"))
            sets = sets.unionByName(_sets_of(own, new, n))
            verified = verified.unionByName(materialize(_verified(more, sets, threshold), "join-verified"))
            joined = components(verified)
    return meta, joined, sets, verified


def _partners(counts: dict[int, int], threshold: float) -> float:
    """Others in a list on average, of the rarest of sampled grams, as many as a prefix has; `counts` are of grams by length of list."""
    left = (1 - threshold) * sum(k * v for k, v in counts.items())
    total = max(1.0, left)
    pairs = 0.0
    for k in sorted(counts):
        here = min(left, k * counts[k])
        pairs, left = pairs + here * (k - 1), left - here
    return pairs / total


def _across(kept: DataFrame, joined: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of heavy lists whose nodes are in different components."""
    placed = kept.join(joined, "node", "left").select("list", "node", "size", "place", F.coalesce("component", "node").alias("component"))
    spread = placed.groupBy("list").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    cut = placed.join(spread.select("list", F.ceil(F.col("n") / BLOCK).alias("blocks")), "list")
    cut = cut.withColumn("own", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cut = cut.select("list", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "size", "place", "component")

    def cross(it):
        for key, p, q, own, *rest in _whole(it, 3):
            head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]))
            for i, j in zip(head.tolist(), np.append(head[1:], key.size).tolist()):
                here, left = [c[i:j] for c in rest], own[i:j] == p[i]
                sides = (here, None) if p[i] == q[i] else ([c[left] for c in here], [c[~left] for c in here])
                for pairs in block_pairs(*sides, threshold):
                    yield _rows(*pairs)

    return map_arrow(cut.repartition("list", "p", "q").sortWithinPartitions("list", "p", "q"), cross, "a long, b long")


def _classes(meta: DataFrame, joined: DataFrame) -> DataFrame:
    """(node, class_id) of all nodes: the smallest doc_id of all documents that links connect."""
    firsts = meta.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(joined, "node", "left")
    smallest = firsts.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("class_id"))
    return firsts.join(smallest, "component", "left").select("node", F.coalesce("class_id", "doc_id").alias("class_id"))


def ngram_jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Near duplicates, a row for each document with words: (doc_id, class_id, n_copies, n_links).

    `class_id` is the smallest doc_id of all documents that chains of links and of equal sets connect, `n_copies` the
    number of other documents with an equal set of word n-grams, and `n_links` that of different sets of
    the table whose Jaccard similarity with this one is at least `threshold`: all of them, each compared in full
    (by 32-bit hashes of the grams).  Links are counted, not listed, so that a class of k near copies costs k
    rows.  No list or bucket is cut: the search is exact for sets of any size.

    Null and empty texts, those without words and null doc_ids are left out; a doc_id that is repeated has
    a row for each different set; an empty table gives an empty result; other columns are ignored.
    """
    meta, joined, sets, _ = _linked(docs, n, threshold, text, key)
    links = _links(joined, sets, threshold)
    members = meta.select("node", "doc_id").dropDuplicates()
    copies = members.groupBy("node").agg((F.count("*") - 1).alias("n_copies"))
    out = members.join(copies, "node").join(_classes(meta, joined), "node").join(links, "node", "left")
    return out.select("doc_id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def near_duplicate_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, class_id) of all documents with words, as `ngram_jaccard_join` has them, without counting links."""
    meta, joined, *_ = _linked(docs, n, threshold, text, key)
    return meta.join(_classes(meta, joined), "node").select("doc_id", "class_id")


def _whole(it, keys: int):
    """Columns of sorted batches, cut where the first `keys` columns change, so that no group is split."""
    rest = None
    for batch in it:
        cols = [np.asarray(c) for c in batch.columns]
        if rest is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(rest, cols)]
        if not cols[0].size:
            continue
        last = np.logical_and.reduce([c == c[-1] for c in cols[:keys]])  # the last group may go on
        cut = int(np.argmax(last))
        rest = [c[cut:] for c in cols]
        if cut:
            yield [c[:cut] for c in cols]
    if rest is not None:
        yield rest


def _rows(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


#: Bits of the filter that a text's set passes before it is sent to the verification.
_BITS = 24


def _sets_of(own: DataFrame, candidates: DataFrame, n: int) -> DataFrame:
    """(node, set) of the nodes of candidate pairs, sets as sorted 32-bit hashes, four bytes each."""
    nodes = candidates.select(F.explode(F.array("a", "b")).alias("node"))
    bits = nodes.groupBy(F.shiftrightunsigned("node", 64 - _BITS + 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(node, {64 - _BITS}) & 63 as int))")).alias("b"))
    bitmap = np.zeros(1 << (_BITS - 6), np.uint64)
    for w, b in bits.collect():  # at most 2**(_BITS - 6) rows
        bitmap[w] = np.uint64(b & 0xFFFFFFFFFFFFFFFF)
    shared = own.sparkSession.sparkContext.broadcast(bitmap.view(np.uint8))

    def emit(it):
        for _, col in ragged.batches(it, "text"):
            for lo, hi in ragged.slices(col):
                s = Sets(col, lo, hi, n)
                want = np.flatnonzero(ragged.in_bitmap(shared.value, s.node.view(np.uint64), _BITS) & (s.size > 0))
                if want.size:
                    short = (s.hash >> np.uint64(32)).astype(np.uint32)  # sorted, as the hashes are
                    yield pa.RecordBatch.from_arrays([pa.array(s.node[want]), pa.array([short[s.start[i] : s.start[i + 1]].tobytes() for i in want.tolist()], pa.binary())], names=["node", "grams"])

    sets = map_arrow(own, emit, "node long, grams binary").join(nodes.dropDuplicates(), "node", "left_semi")
    return materialize(sets.groupBy("node").agg(F.first("grams").alias("grams")), "join-sets")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many grams the sets of each pair have in common; all pairs are sorted at once."""
    i = np.arange(len(left), dtype=np.uint64) << np.uint64(32)
    keys = np.concatenate([np.repeat(i, [len(s) for s in left]) | np.concatenate(left), np.repeat(i, [len(s) for s in right]) | np.concatenate(right)])
    keys.sort(kind="stable")
    return np.bincount((keys[:-1][keys[1:] == keys[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(left))


#: Sets of a component that are brought together at once, with as many others, and the grams that they hold
#: on average at most; cells of the matrix by which they are compared.
_TOGETHER, _GRAMS, _CELLS = 256, 1 << 20, 1 << 23


def _products(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Grams in common of each set before `split` with each from `split` on, or of all with all where split is 0."""
    size = [len(s) for s in sets]
    _, gram, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    gram, row = gram[times[gram] > 1], row[times[gram] > 1]
    _, gram = np.unique(gram, return_inverse=True)
    order = np.argsort(gram, kind="stable")
    gram, row = gram[order], row[order]
    out = np.zeros((split or len(sets), len(sets) - split), np.float32)
    width = int(gram[-1]) + 1 if gram.size else 0
    step = max(1, min(width, _CELLS // len(sets)))
    for c in range(0, width, step):
        i, j = np.searchsorted(gram, [c, c + step])
        m = np.zeros((len(sets), step), np.float32)
        m[row[i:j], gram[i:j] - c] = 1
        out += (m[:split] if split else m) @ m[split:].T
    return out


def _placed(joined: DataFrame, sets: DataFrame) -> DataFrame:
    """(component, blocks, own, node, grams): the blocks of each component, and that of each node."""
    have = joined.join(sets.withColumn("n", F.octet_length("grams") / 4), "node")
    count = have.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / _TOGETHER), F.ceil(F.sum("n") / _GRAMS)).alias("blocks"))
    return have.drop("n").join(count, "component").withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))


def _links(joined: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(node, n_links): the nodes of its component whose Jaccard similarity reaches the threshold, block by block."""
    spread = _placed(joined, sets).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = spread.select("component", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "grams")
    rows = rows.repartition("component", "p", "q").sortWithinPartitions("component", "p", "q", "own")

    def count(group):
        own, node, grams = (list(c) for c in zip(*group[1]))
        sets = [np.frombuffer(g, np.uint32) for g in grams]
        p, q = group[0][1:]
        split = 0 if p == q else own.index(q) if q in own else len(own)
        if split == len(own) or (p != q and split == 0):
            return [], []
        both = _products(sets, split)
        size = np.array([len(s) for s in sets], np.float64)
        like = both >= threshold * (size[: split or None, None] + size[None, split:] - both) - 1e-9
        if p == q:
            np.fill_diagonal(like, False)
            return node, like.sum(1).tolist()
        return node, like.sum(1).tolist() + like.sum(0).tolist()

    def work(it):
        found: tuple[list, list] = ([], [])
        for group in _groups_of(it):
            for to, c in zip(found, count(group)):
                to.extend(c)
            if len(found[0]) > PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["node", "n"])
                found = ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["node", "n"])

    return map_arrow(rows, work, "node long, n long").groupBy("node").agg(F.sum("n").alias("n_links"))


def _groups_of(it, keys: int = 3, first: int = 0):
    """((component, p, q), [the other columns of each row]) of sorted batches; or of other columns, `keys` from `first` on."""
    now, held = None, []
    for batch in it:
        own = range(first, first + keys)
        where = zip(*(batch.column(i).to_pylist() for i in own))
        for here, row in zip(where, zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns) if i not in own))):
            if here != now:
                if held:
                    yield now, held
                now, held = here, []
            held.append(row)
    if held:
        yield now, held


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose Jaccard similarity reaches the threshold; a set goes once to each two blocks of its component, not to each pair."""
    placed = _placed(components(pairs.select("a", "b")), sets).drop("grams")
    at = lambda side: placed.select(F.col("node").alias(side), "component", F.col("own").alias(f"own_{side}"))
    lined = pairs.join(at("a"), "a").join(at("b").drop("component"), "b").select("component", F.least("own_a", "own_b").alias("p"), F.greatest("own_a", "own_b").alias("q"), "a", "b", F.lit(None).cast("binary").alias("grams"))
    used = lined.select("component", "p", "q", F.explode(F.array("a", "b")).alias("node")).dropDuplicates()
    brought = used.join(sets, "node").select("component", "p", "q", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "grams")
    rows = lined.unionByName(brought).repartition("component", "p", "q").sortWithinPartitions("component", "p", "q", F.col("b").asc_nulls_first())

    def check(it):
        now, held, a, b, left, right, cells = None, {}, [], [], [], [], 0

        def done():
            both = _common(left, right) if a else np.empty(0)
            size = np.array([x.size + y.size for x, y in zip(left, right)], np.float64)
            good = both >= threshold * (size - both) - 1e-9
            return pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)[good]) for c in (a, b)], names=["a", "b"])

        for batch in it:
            where = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            for i, (x, y, g) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5))):
                if where[i] != now:
                    now, held = where[i], {}
                if y is None:
                    held[x] = np.frombuffer(g.as_py(), np.uint32)
                    continue
                a.append(x)
                b.append(y)
                left.append(held[x])
                right.append(held[y])
                cells += held[x].size + held[y].size
                if cells > _CELLS:
                    yield done()
                    a, b, left, right, cells = [], [], [], [], 0
        yield done()

    return map_arrow(rows, check, "a long, b long")


def op8_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


QUERIES = {"op8_ngram_jaccard_join": op8_ngram_jaccard_join}
ORACLE_SQL: dict[str, str] = {}
