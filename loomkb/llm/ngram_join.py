"""Jaccard self-join of texts on word n-grams by count-vector R-trees.

A document is the set of its n-word shingles. Hashing the shingles into groups
gives a point of group counts, and for two documents

    |A and B| <= sum over groups of min(count_A, count_B),

so an R-tree over the points prunes node pairs by the summed minima of their
upper corners and by their sizes. The tree is distributed by routing: a
document goes to the partitions of its rarest shingles only, as many as a
partner must share at least one of, which keeps far-apart documents from ever
meeting and loses no link. Within a route an R-tree is built and joined with
itself; what survives is verified on the exact sets of the whole texts.

How work stays bounded:

* equal sets travel as one document; copies follow by their set's digest;
* shingles are ranked by the counts of 2^18 hash groups over all documents, a
  table of constant size, so very common lines and passages route nothing
  unless a document has little else;
* a route of a group far above the average is split into chunk pairs;
* tasks return spanning forests, never pairs, so a group of near copies costs
  rows in proportion to its size; groups beyond a block meet block by block,
  first with one hub block, then only those that are still apart.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomkb.llm.components import Forest, sorted_groups
from loomkb.operators.components import connected_components
from loomkb.session import table
from loomkb.storage import materialize

#: Hash groups of the ranking, and of the points in a tree.
RANK_BITS, GROUPS = 18, 64
#: A document's own vector has four times as many groups until so many shingles are left for each.
PER_GROUP = 11
#: A route is split into chunks where its group counts so many times the average.
HOT = 8
#: Documents that are joined by one R-tree at most, and those of a node.
TREE, FANOUT = 4096, 16
#: Documents of a verification block; a pair of blocks is a task's unit of work.
BLOCK = 96
#: Bits of the filter that spares texts nobody asks for their shuffle: 1 MB.
FILTER_BITS = 1 << 23
#: Words whose hashes a worker remembers, and rows taken from Arrow at a time.
REMEMBER, ROWS = 120_000, 256

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Shingler:
    """Sets of hashed n-word shingles; words end at space and the controls tab to carriage return."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        try:
            ids = [known[w] for w in words]
        except KeyError:
            ids = []
            for w in words:
                h = known.get(w)
                if h is None:
                    h = xxhash.xxh3_64_intdigest(w)
                    if len(known) < REMEMBER and len(w) < 64:
                        known[w] = h
                ids.append(h)
        hashed = np.array(ids, np.uint64)
        if len(hashed) < self.n:  # the whole sequence is one shingle of its own kind
            return np.array([xxhash.xxh3_64_intdigest(hashed.tobytes(), seed=len(hashed))], np.uint64)
        out = np.zeros(len(hashed) - self.n + 1, np.uint64)
        for i in range(self.n):
            out = (out ^ hashed[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out)


def rank_groups(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - RANK_BITS)).astype(np.int64)


def enough(both: np.ndarray | int, total: np.ndarray | int, num: int, den: int):
    """den * |A and B| >= num * |A or B|, with ``total`` = |A| + |B|; whole numbers only."""
    return (den + num) * both >= num * total


class RTree:
    """R-tree over count vectors, packed bottom-up in order of size and weight."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        """``points``: one row of group counts per document."""
        half = points[:, : points.shape[1] // 2].sum(axis=1)
        self.order = np.lexsort((half, sizes))
        self.points, self.sizes = points[self.order].astype(np.int64), sizes[self.order].astype(np.int64)
        #: Per level from the leaves up: upper corners, smallest and largest sizes.
        self.levels = []
        corner, low, high = self.points, self.sizes, self.sizes
        while len(corner) > 1 or not self.levels:
            starts = np.arange(0, len(corner), FANOUT)
            corner = np.maximum.reduceat(corner, starts, axis=0)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            self.levels.append((corner, low, high))

    def self_join(self, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
        """(i, partners) by position in the input: every pair that the bounds let through, once."""
        top = len(self.levels) - 1
        todo = [(top, 0, 0)]
        while todo:
            level, a, b = todo.pop()
            below = self.levels[level - 1] if level else (self.points, self.sizes, self.sizes)
            n = len(below[1])
            xs, ys = np.arange(a * FANOUT, min((a + 1) * FANOUT, n)), np.arange(b * FANOUT, min((b + 1) * FANOUT, n))
            low_x, low_y, high_x, high_y = below[1][xs], below[1][ys], below[2][xs], below[2][ys]
            # sizes of similar sets differ by at most the threshold's factor
            near = (den * high_x[:, None] >= num * low_y[None, :]) & (den * high_y[None, :] >= num * low_x[:, None])
            if a == b:
                near = np.triu(near, 0 if level else 1)
            i, j = np.nonzero(near)
            if not len(i):
                continue
            shared = np.minimum(below[0][xs[i]], below[0][ys[j]]).sum(axis=1)
            passed = enough(shared, low_x[i] + low_y[j], num, den)
            i, j = xs[i[passed]], ys[j[passed]]
            if level:
                todo.extend((level - 1, int(x), int(y)) for x, y in zip(i, j))
                continue
            for x in np.unique(i):
                yield int(self.order[x]), self.order[j[i == x]]


def unpack(counts: bytes) -> np.ndarray:
    return np.frombuffer(counts, "<u2").astype(np.int64)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """The same counts over fewer groups."""
    return counts.reshape(-1, groups).sum(axis=0)


def survivors(vectors: list[np.ndarray], sizes: np.ndarray, num: int, den: int) -> Iterator[tuple[int, list[int]]]:
    """(i, partners): pairs that an R-tree over the folded vectors and then the full vectors let through.

    The tree's points have ``GROUPS`` groups; what it lets through is bounded
    again over the finest groups that both documents have.
    """
    tree = RTree(np.stack([folded(v, GROUPS) for v in vectors]), sizes)
    for i, partners in tree.self_join(num, den):
        v, kept = vectors[i], []
        for j in map(int, partners):
            w = vectors[j]
            if len(v) > GROUPS and len(w) > GROUPS:
                groups = min(len(v), len(w))
                shared = int(np.minimum(folded(v, groups), folded(w, groups)).sum())
                if not enough(shared, int(sizes[i] + sizes[j]), num, den):
                    continue
            kept.append(j)
        if kept:
            yield i, kept


def candidate_forest(vectors: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest positions that each document hangs together with: by its label, and by surviving pairs as well."""
    forest, first = Forest(len(vectors)), {}
    for i, label in enumerate(labels):
        forest.union(first.setdefault(int(label), i), i)
    before, left = forest.roots(), len(first) - 1
    for i, partners in survivors(vectors, sizes, num, den) if left else ():
        for j in partners:
            left -= forest.union(i, j)
        if not left:
            break
    return before, forest.roots()


def similar_sets(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if den * min(len(a), len(b)) < num * max(len(a), len(b)) or not len(a) or not len(b):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return bool(enough(both, len(a) + len(b), num, den))


def _sets(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, digest, counts, routes, reach) of every row."""
    texts = docs.select("doc_id", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, total = Shingler(n), np.zeros(1 << RANK_BITS, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                found = [shingles(t) for t in batch.slice(start, ROWS).column(0).to_pylist()]
                total += np.bincount(rank_groups(np.concatenate(found)), minlength=len(total))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"g": hit.astype(np.int32), "c": total[hit]})

    ranks = np.zeros(1 << RANK_BITS, np.int64)
    counts = texts.select("text").mapInArrow(counted, "g int, c long").groupBy("g").agg(F.sum("c").alias("c")).toPandas()
    ranks[counts["g"].to_numpy()] = counts["c"].to_numpy()  # at most 2^18 numbers, whatever the corpus
    hot = max(1.0, HOT * float(ranks.mean()))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(n)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part, rows = batch.slice(start, ROWS), []
                for t in part.column(1).to_pylist():
                    s = shingles(t)
                    if not len(s):
                        rows.append((0, None, None, None, None))
                        continue
                    rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), count_vector(s), *routes_of(s, ranks, hot, num, den)))
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n", "digest", "counts", "routes", "reach"])

    out = texts.select("doc_id", "text").mapInArrow(described, "doc_id long, n long, digest binary, counts binary, routes array<long>, reach array<long>")
    return materialize(out, "sets")


def count_vector(shingles: np.ndarray) -> bytes:
    """Number of shingles in each group; the groups grow with the document, so that the bound stays sharp."""
    groups = GROUPS
    while len(shingles) > PER_GROUP * groups:
        groups *= 4
    return np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype("<u2").tobytes()


def routes_of(shingles: np.ndarray, ranks: np.ndarray, hot: float, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Routes of the rarest shingles, any similar set shares one of them with its own rarest; and the largest set that can be met by each.

    A similar set holds at least ceil(num / den * n) of the n shingles, so one
    of the first n - that + 1 in any common order is among the partner's first.
    If the first common shingle is at place i, at most n - i are common, which
    bounds the partner's size.
    """
    n = len(shingles)
    counts = ranks[rank_groups(shingles)]
    first = np.lexsort((shingles, counts))[: n + (-num * n // den) + 1]
    reach = (n - np.arange(len(first), dtype=np.int64)) * (den + num) // num - n
    keys, parts = shingles[first], np.ceil(counts[first] / hot).astype(np.int64)
    if (parts <= 1).all():
        return keys.view(np.int64), reach
    own = int(xxhash.xxh3_64_intdigest(shingles.tobytes()))
    out, most = [keys[parts <= 1].view(np.int64)], [reach[parts <= 1]]
    for key, p, r in zip(keys[parts > 1], parts[parts > 1], reach[parts > 1]):
        # one chunk of the hot route, met with every chunk
        c = xxhash.xxh3_64_intdigest(int(key).to_bytes(8, "little"), seed=own) % int(p)
        pairs = [(min(c, x), max(c, x)) for x in range(int(p))]
        out.append(np.array([xxhash.xxh3_64_intdigest(f"{key}:{i}:{j}") for i, j in pairs], np.uint64).view(np.int64))
        most.append(np.full(len(pairs), r))
    return np.concatenate(out), np.concatenate(most)


def shared_routes(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(documents, sizes) of each route, for those that may have a partner on it.

    Rows come sorted by route and size, and one route is held at a time. A
    document whose reach is below the smallest other size on the route has no
    partner there.
    """
    held = np.zeros((0, 4), np.int64)
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held = np.concatenate([held, batch[["route", "doc_id", "n", "reach"]].to_numpy(np.int64)])
        cuts = np.r_[0, np.flatnonzero(held[1:, 0] != held[:-1, 0]) + 1, len(held)]
        if batch is not None:  # the last route may go on
            cuts = cuts[:-1]
        rows, held = held[: cuts[-1]], held[cuts[-1] :]
        left = len(rows) + 1
        while len(rows) < left:
            left, lengths = len(rows), np.diff(cuts)
            first = np.repeat(cuts[:-1], lengths)
            shared = np.repeat(lengths > 1, lengths)
            # the smallest other one: the first of the route, for itself the second
            other = np.where(np.arange(left) == first, np.minimum(first + 1, left - 1), first)
            rows = rows[shared & (rows[:, 3] >= rows[other, 2])]
            cuts = np.r_[0, np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1, len(rows)]
        for start, end in zip(cuts[:-1], cuts[1:]):
            if end > start:
                yield rows[start:end, 1], rows[start:end, 2]


def _candidates(reps: DataFrame, num: int, den: int) -> DataFrame:
    """(doc_id, peer) edges of documents that some R-tree lets meet."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        rows: list[tuple[int, np.ndarray]] = []

        def add(members: np.ndarray) -> None:
            name = xxhash.xxh3_64_intdigest(members.tobytes()) - (1 << 63)
            if name not in seen:
                seen.add(name)
                rows.append((name, members))

        half = TREE // 2
        for doc, size in shared_routes(batches):
            if len(rows) >= 5000:
                yield pd.DataFrame(rows, columns=["list", "docs"])
                rows.clear()
            if len(doc) <= half:
                add(np.sort(doc))
                continue
            starts = range(0, len(doc), half)
            for i, x in enumerate(starts):
                end = min(x + half, len(doc))
                # larger documents than these cannot be similar to any of the chunk
                others = [y for y in starts[i + 1 :] if den * size[end - 1] >= num * size[y]]
                for y in others:
                    add(np.sort(np.r_[doc[x:end], doc[y : y + half]]))
                if not others and end - x > 1:
                    add(np.sort(doc[x:end]))
        if rows:
            yield pd.DataFrame(rows, columns=["list", "docs"])

    routed = reps.select("doc_id", "n", F.explode(F.arrays_zip("routes", "reach")).alias("r")).select("doc_id", "n", F.col("r.routes").alias("route"), F.col("r.reach").alias("reach"))
    routed = routed.repartition("route").sortWithinPartitions("route", "n", "doc_id")
    lists = routed.mapInPandas(runs, "list long, docs array<long>")
    # documents that share several routes make equal lists: one of each is enough
    once = materialize(lists.groupBy("list").agg(F.min("docs").alias("docs")), "lists")
    members = materialize(once.select("list", F.explode("docs").alias("doc_id")), "members")
    points = reps.select("doc_id", "n", "counts")

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, peers, held = [], [], 0
        for g in sorted_groups(batches, "list"):
            before, roots = candidate_forest([unpack(c) for c in g["counts"]], g["n"].astype(np.int64), g["label"], num, den)
            moved = np.flatnonzero(roots != before)
            if len(moved):
                # one edge for each tree that joined another
                moved = moved[np.unique(before[moved], return_index=True)[1]]
                docs.append(g["doc_id"][moved])
                peers.append(g["doc_id"][roots[moved]])
                held += len(moved)
            if held >= 20_000:
                yield pd.DataFrame({"a": np.concatenate(docs), "b": np.concatenate(peers)})
                docs, peers, held = [], [], 0
        if docs:
            yield pd.DataFrame({"a": np.concatenate(docs), "b": np.concatenate(peers)})

    def join_lists(labelled: DataFrame) -> DataFrame:
        dealt = labelled.join(points, "doc_id").repartition("list").sortWithinPartitions("list", "doc_id")
        return materialize(dealt.select("list", "doc_id", "label", "n", "counts").mapInPandas(joined, "a long, b long"), "met")

    # first every document in one list of its own choice: near copies choose alike and
    # hang together after it; then only the lists whose documents are still apart
    chosen = members.groupBy("doc_id").agg(F.min("list").alias("list")).select("list", "doc_id", F.col("doc_id").alias("label"))
    first = join_lists(chosen)
    joined_so_far = connected_components(first)
    labelled = members.join(joined_so_far.select(F.col("node").alias("doc_id"), F.col("component").alias("c")), "doc_id", "left")
    labelled = materialize(labelled.select("list", "doc_id", F.coalesce("c", "doc_id").alias("label")), "labelled")
    apart = labelled.groupBy("list").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("list")
    return first.unionByName(join_lists(labelled.join(apart, "list", "left_semi")))


def _wanted_only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """``texts`` of the ids, by a join; a Bloom filter keeps most others out of its shuffle.

    The filter has a fixed size. With more ids than it holds it lets all texts
    through, and the shuffle is what it would be without it.
    """
    hashes = [F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(FILTER_BITS)) for i in range(3)]
    words = ids.select(F.explode(F.array(*hashes)).alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("w"))
    rows = words.agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS INT))")).alias("bits")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[rows["w"].to_numpy()] = rows["bits"].to_numpy()  # at most FILTER_BITS / 64 rows

    @F.pandas_udf("boolean")
    def may_be(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        hit = np.ones(len(x), bool)
        for at in (x.to_numpy(), y.to_numpy(), z.to_numpy()):
            hit &= (bits[at >> 6] >> (at & 63)) & 1 == 1
        return pd.Series(hit)

    return texts.where(may_be(*hashes)).join(ids, "doc_id", "left_semi")


def _verified(texts: DataFrame, pairs: DataFrame, blocks: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Forest edges of verified links within the block pairs (pair, block)."""
    shipped = pairs.join(blocks, "block").join(texts, "doc_id").select("pair", "block", "doc_id", "label", "counts", "text")
    dealt = shipped.repartition("pair").sortWithinPartitions("pair", "doc_id")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(n)
        for g in sorted_groups(batches, "pair"):
            sets = [shingles(t) for t in g["text"]]
            sizes = np.array([len(s) for s in sets], np.int64)
            vectors = [unpack(c) for c in g["counts"]]
            forest = Forest(len(sets))
            first: dict[int, int] = {}
            for i, label in enumerate(g["label"]):  # what hangs together already is not compared again
                forest.union(first.setdefault(int(label), i), i)
            before, rows, block = forest.roots(), [], g["block"]
            left, two = len(set(before.tolist())) - 1, bool((block != block[0]).any())
            for i, partners in survivors(vectors, sizes, num, den) if left else ():
                for j in partners:
                    # a block by itself is a pair of its own
                    if two and block[i] == block[j] or forest.find(i) == forest.find(j):
                        continue
                    if similar_sets(sets[i], sets[j], num, den):
                        left -= forest.union(i, j)
                if not left:
                    break
            for i, root in enumerate(forest.roots()):
                if before[i] != root:
                    rows.append((int(g["doc_id"][i]), int(g["doc_id"][root])))
            if rows:
                yield pd.DataFrame(rows, columns=["a", "b"])

    return materialize(dealt.mapInPandas(verify, "a long, b long"), "links")


def jaccard_components(
    docs: DataFrame, n: int = 4, threshold: tuple[int, int] = (85, 100), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    ``threshold`` is the least Jaccard similarity as a fraction of whole
    numbers. A text with fewer than ``n`` words is one shingle, one without
    words has none and links with nothing, like a null text. Rows of one id are
    one node that links by any of its texts; null ids link with nothing and
    have no component. Other columns are not looked at; an empty table gives an
    empty result.
    """
    num, den = threshold
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = _sets(texts, n, num, den)
    full = sets.where("n > 0 AND doc_id IS NOT NULL")
    classes = materialize(full.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    # one row for each set: the smallest id that has it
    reps = materialize(
        full.join(classes, (F.col("doc_id") == F.col("rep")) & (full["digest"] == classes["digest"]), "left_semi").select("doc_id", "n", "counts", "routes", "reach"),
        "reps",
    )
    met = connected_components(_candidates(reps, num, den))
    links = _links_within(met, reps, texts, n, num, den)
    ids = full.join(classes, "digest").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    # an id may carry several sets; then it joins their classes
    several = full.groupBy("doc_id").agg(F.count_distinct("digest").alias("k")).where("k > 1").select("doc_id")
    bridges = ids.join(several, F.col("a") == F.col("doc_id"), "left_semi")
    found = materialize(connected_components(links.unionByName(bridges)), "found")
    reached = classes.join(found, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    reached = materialize(reached, "reached")
    linked = full.join(reached, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sets.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def _links_within(met: DataFrame, reps: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Verified links inside the groups of documents that met."""
    sizes = met.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    sizes = materialize(sizes, "sizes")
    placed = met.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    placed = placed.select(F.col("node").alias("doc_id"), "component", "parts", "part", F.xxhash64("component", "part").alias("block"))
    blocks = materialize(placed.join(reps.select("doc_id", "counts"), "doc_id"), "blocks")
    wanted = materialize(_wanted_only(texts, blocks.select("doc_id")), "texts")
    known = blocks.select("component", "parts", "part", "block").distinct()
    hub = F.xxhash64("component", F.lit(0).cast("long"))
    # each block by itself, and with the group's hub block
    own = known.select(F.col("block").alias("pair"), "block")
    with_hub = known.where("part > 0").select(F.xxhash64("block", hub).alias("pair"), F.array(F.col("block"), hub).alias("b"))
    first = own.unionByName(with_hub.select("pair", F.explode("b").alias("block")))
    unlabelled = blocks.select("block", "doc_id", "counts", F.col("doc_id").alias("label"))
    links = _verified(wanted, materialize(first, "pairs"), unlabelled, n, num, den)
    if not known.where("parts > 2").take(1):
        return links
    # what is still apart in groups of three blocks and more meets pair by pair
    joined = connected_components(links)
    parted, labelled = blocks.where("parts > 2").alias("p"), joined.alias("j")
    large = parted.join(labelled, F.col("p.doc_id") == F.col("j.node"), "left").select(
        *[F.col(f"p.{c}").alias(c) for c in ("component", "part", "block", "doc_id", "counts")],
        F.coalesce(F.col("j.component"), F.col("p.doc_id")).alias("label"),
    )
    large = materialize(large, "large")
    labels = large.groupBy("component", "part", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    labels = materialize(labels, "labels")
    other = labels.select("component", F.col("part").alias("part2"), F.col("block").alias("block2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    apart = (F.col("low") != F.col("high")) | (F.col("low2") != F.col("high2")) | (F.col("low") != F.col("low2"))
    pairs = labels.join(other, "component").where("part > 0 AND part < part2").where(apart)
    pairs = pairs.select(F.xxhash64("block", "block2").alias("pair"), F.explode(F.array("block", "block2")).alias("block"))
    more = _verified(wanted, materialize(pairs, "pairs"), large.select("block", "doc_id", "counts", "label"), n, num, den)
    return links.unionByName(more)


def keep_one_of_each(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with all their columns; null ids stay."""
    kept = jaccard_components(docs, n, threshold, id_col, text_col).where("doc_id = component_id").select(F.col("doc_id").alias("__keep")).distinct()
    known = docs.join(kept, F.col(id_col).cast("long") == F.col("__keep"), "left_semi")
    return known.unionByName(docs.where(F.col(id_col).isNull()))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
one AS (SELECT min(doc_id) AS rep, s FROM (SELECT doc_id, list_sort(s) AS s FROM sets) GROUP BY s),
items AS (SELECT rep, len(s) AS n, unnest(s) AS item FROM one),
shared AS (SELECT a.rep AS a, b.rep AS b, a.n + b.n AS total, count(*) AS i FROM items a JOIN items b ON a.item = b.item AND a.rep < b.rep GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * i >= 85 * (total - i)
          UNION ALL SELECT s.doc_id, o.rep FROM sets s JOIN one o ON list_sort(s.s) = o.s WHERE len(s.s) > 0 AND s.doc_id <> o.rep),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a)
SELECT doc_id, CAST(len(any_value(s)) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM sets JOIN reach r ON r.a = doc_id GROUP BY doc_id
"""
