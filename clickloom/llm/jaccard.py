"""N-gram Jaccard join with a count-vector R-tree.

A document is its set of distinct shingles. Shingles are hashed into GROUPS groups; the counts of a set in the groups are a point, and the
summed coordinate minima of two points bound the overlap of the sets from above. An R-tree over points
bounds a whole node by the minima against the upper corner of its box, and by its range of set sizes. Long sets have a second,
finer vector, which bounds single pairs. Pairs that survive the bounds are verified on the full sets.

One tree over all points would compare nearly everything with everything (unrelated long texts have alike count
vectors), so sets first meet by a rule that loses no pair. Two sets that link differ in at most
t = (100 - similarity) / (100 + similarity) * (|A| + |B|) shingles. If the shingles are split by hash into more than t cells, some cell has the same
content in both sets; the number of cells follows from a band of set sizes, a set takes part in its own band and the next
larger, and a set whose empty cells could hide the equal one adds those. What is exchanged for a cell is a row of two integers, its key and
the set's signature, whatever the number of partitions. Spark sorts these rows by key; all sets of a key but the smallest signature, the key's
centre, give a pair with it, and equal pairs are one with a count.

Only sets of such pairs are looked at further. Each set is compared with the centre with which it shares most keys, then,
where classes still differ, with its other centres; groups of one centre whose sets are still in different classes are last compared
all with all. If a group is of one class already, no pair of it can add anything. Comparisons take place in bins of about ``bin_shingles``
shingles, twice: first points alone meet in a bin's R-tree, then the full texts of the sets that survive there are fetched, the tree's
survivors verified, and links joined to a forest. Large groups are split into blocks, with their centre in every block, or for all pairs into pairs of blocks. So a group of copies costs no pairs, a link in a class is a verified
one, and nothing is capped.

Identical sets are one set from the start, told apart by 128 bits of hashes of cryptographic word hashes.

Defined cases: null and empty texts have an empty set, size 0, and are classes of their own; a text of fewer words than a shingle is one
shingle; rows with null doc_id link like others, but
do not name a class: one of such rows alone has a null component_id; repeated rows are identical sets; a text of any length is one set; a pair
at the similarity itself links; extra columns, whatever their names, are not read by the join and kept by representatives(); an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Forest, bound_batches, components, gather, inner, materialize, parallelism, read, split_by_keys
from .textnum import Words, mix, rolling, signed, whitespace_table

GROUPS = 64  # with fewer, counts of unrelated sets of some hundred shingles are too much alike to tell them apart
FINE, LONG = 512, 1024  # groups of a second vector, for sets of so many shingles, which are too much alike in the first
LEAF = 32  # points of a leaf, and children of a node
KEY_BYTES, PART_BYTES = 12, 128 << 20  # bytes of key rows for each shingle, and in a partition of them


def shingle_sets(texts, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, text after text, second hashes of the same shingles, where each text's begin, and signatures."""
    words = Words(texts, whitespace_table(lower=True))
    keys, doc = words.keys(), words.doc()
    runs, at = words.windows(keys[0], width)
    every, owner, check = [runs], [doc[at]], [words.windows(keys[1], width)[0]]
    for k in range(1, width):
        short = np.flatnonzero(words.counts == k)
        if len(short):
            own = (words.first[short][:, None] + np.arange(k)).ravel()
            every.append(rolling(keys[0][own], k)[::k])
            check.append(rolling(keys[1][own], k)[::k])
            owner.append(short)
    runs, owner, check = np.concatenate(every), np.concatenate(owner), np.concatenate(check)
    order = np.lexsort((runs, owner))
    runs, owner, check = runs[order], owner[order], check[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    first = np.searchsorted(owner[new], np.arange(len(words.counts) + 1))
    return runs[new], check[new], first, signatures(runs[new], first)


def summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, dtype=values.dtype, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return signed(mix(summed(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first) + np.diff(first).astype(np.uint64)))


def count_vectors(values: np.ndarray, first: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    group = (values >> np.uint64(64 - groups.bit_length() + 1)).astype(np.int64)
    return np.bincount(owner * groups + group, minlength=n * groups).reshape(n, groups)


def narrow(counts: np.ndarray) -> np.ndarray:
    """The same counts in the fewest bytes that hold them all."""
    return counts.astype(next(k for k, most in (("u1", 0xFF), ("<u2", 0xFFFF), ("<u4", 0xFFFFFFFF)) if counts.max(initial=0) <= most))


class Points:
    """Count vectors of sets: one of GROUPS groups each and, for long sets, one of FINE groups (row: where, or -1)."""

    def __init__(self, coarse: np.ndarray, similarity: int, fine: np.ndarray | None = None, row: np.ndarray | None = None):
        self.coarse, self.similarity, self.fine = coarse, similarity, fine
        self.sizes = coarse.sum(1, dtype=np.int64)
        self.row = np.full(len(coarse), -1) if row is None else row

    def take(self, at: np.ndarray) -> Points:
        return Points(self.coarse[at], self.similarity, self.fine, self.row[at])

    def need(self, a, b):
        """The least overlap with which sets of these sizes link."""
        return -(-self.similarity * (a + b) // (100 + self.similarity))

    def may_link(self, a, b: np.ndarray) -> np.ndarray:
        """Do the bounds let a (one set, or one for each b) link with each b?"""
        a = np.broadcast_to(a, b.shape)
        need = self.need(self.sizes[a], self.sizes[b])
        fits = np.minimum(self.coarse[a], self.coarse[b]).sum(1, dtype=np.int64) >= need
        both = np.flatnonzero(fits & (self.row[a] >= 0) & (self.row[b] >= 0))
        for c in range(0, len(both), 4096):
            k = both[c : c + 4096]
            fits[k] = np.minimum(self.fine[self.row[a[k]]], self.fine[self.row[b[k]]]).sum(1, dtype=np.int64) >= need[k]
        return fits


def packed(counts: np.ndarray) -> list[bytes]:
    return [narrow(row).tobytes() for row in counts]


def unpacked(blobs: list[bytes], groups: int) -> np.ndarray:
    """The rows that packed() made bytes of; their lengths tell how many bytes a count has."""
    out = np.zeros((len(blobs), groups), np.uint32)
    length = np.array([len(b) for b in blobs])
    for size, kind in ((1, "u1"), (2, "<u2"), (4, "<u4")):
        at = np.flatnonzero(length == size * groups)
        out[at] = np.frombuffer(b"".join(blobs[k] for k in at), kind).reshape(-1, groups)
    return narrow(out)


class Bands:
    """Bands of set sizes, and the cells of each."""

    def __init__(self, similarity: int):
        self.similarity = similarity
        edges = [1]
        while edges[-1] < 1 << 40:  # the next band begins at the first size that cannot link with the band's first
            edges.append(edges[-1] * 100 // similarity + 1)
        edges.append(edges[-1] * 100 // similarity + 1)
        self.edges = np.array(edges)
        #: sets of a band or the one below differ in at most so many shingles
        self.differ = (100 - similarity) * 2 * (self.edges[1:] - 1) // (100 + similarity)
        self.cells = np.maximum(self.differ + 1, self.differ + self.differ // 16 + 3)
        self.cells[self.differ == 0] = 0  # only equal sets link

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, sizes, side="right") - 1


def cell_keys(values: np.ndarray, first: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Keys of cell contents and the set of each."""
    sizes = np.diff(first)
    keys, owners = [], []
    owner = np.repeat(np.arange(len(sizes)), sizes)
    mixed = mix(values + np.uint64(0x1234567))
    for up in (0, 1):
        band = bands.of(np.maximum(sizes, 1)) + up
        n = np.where(sizes > 0, bands.cells[band], 0)
        base = np.cumsum(n) - n
        some = n[owner] > 0
        slot = base[owner[some]] + (mixed[some] % n[owner[some]].astype(np.uint64)).astype(np.int64)
        content = np.zeros(int(n.sum()), np.uint64)
        np.add.at(content, slot, values[some])
        full = np.bincount(slot, minlength=len(content)) > 0
        of = np.repeat(np.arange(len(sizes)), n)
        empty = np.bincount(of[~full], minlength=len(sizes))
        # an equal cell that is not empty is certain unless so many are empty
        hidden = empty >= n - bands.differ[band]
        full |= hidden[of]
        cell = np.arange(len(content)) - base[of]
        key = mix(content ^ mix(cell.astype(np.uint64) * np.uint64(4096) + band[of].astype(np.uint64)))
        keys.append(key[full])
        owners.append(of[full])
    return np.concatenate(keys), np.concatenate(owners)


class Tree:
    """An R-tree over count vectors, packed in order of set size and then of the first coordinates."""

    def __init__(self, points: Points):
        self.points = points
        coarse, sizes = points.coarse, points.sizes
        self.order = np.lexsort((coarse[:, 2], coarse[:, 1], coarse[:, 0], sizes))
        self.levels = []  # from the leaves up: upper corners, least and largest sizes
        hi, lo, top = coarse[self.order], sizes[self.order], sizes[self.order]
        while len(hi) > 1:
            cut = np.arange(0, len(hi), LEAF)
            hi, lo, top = np.maximum.reduceat(hi, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(top, cut)
            self.levels.append((hi, lo, top))

    def near(self, k: int) -> np.ndarray:
        """The points that may link with point k, itself among them."""
        points = self.points
        point, size, s = points.coarse[k], points.sizes[k], points.similarity
        at = np.arange(len(self.levels[-1][0])) if self.levels else np.arange(1)
        for level in range(len(self.levels) - 1, -1, -1):
            hi, lo, top = (x[at] for x in self.levels[level])
            least = np.maximum(lo, -(-s * size // 100))
            fits = (top * 100 >= s * size) & (size * 100 >= s * lo) & (np.minimum(point, hi).sum(1, dtype=np.int64) >= points.need(size, least))
            at = at[fits]
            below = len(points.coarse) if level == 0 else len(self.levels[level - 1][0])
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < below]
        at = self.order[at]
        return at[points.may_link(k, at)]


def points_of(values: np.ndarray, first: np.ndarray, similarity: int) -> Points:
    """The points of sets given as shingle hashes, set after set."""
    sizes = np.diff(first)
    long = sizes >= LONG
    row = np.where(long, np.cumsum(long) - 1, -1)
    fine = count_vectors(values[np.repeat(long, sizes)], np.concatenate([[0], np.cumsum(sizes[long])]), FINE)
    return Points(narrow(count_vectors(values, first)), similarity, narrow(fine), row)


def verified(values: np.ndarray, first: np.ndarray, similarity: int, queries: np.ndarray, forest: Forest) -> Forest:
    """Join to each query the sets that link with it; pairs already in one tree of the forest are not looked at."""
    tree = Tree(points_of(values, first, similarity))
    sizes = np.diff(first)
    for a in queries.tolist():
        own = values[first[a] : first[a + 1]]
        for b in tree.near(a).tolist():
            if forest.find(a) != forest.find(b):
                other = values[first[b] : first[b + 1]]
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                common = np.count_nonzero(own[at] == other)
                if 100 * common >= similarity * (sizes[a] + sizes[b] - common):
                    forest.union(a, b)
    return forest


def _linked(docs: DataFrame, similarity: int, width: int, text: str, doc_id: str, block: int, bin_shingles: int) -> DataFrame:
    """A row for each document: doc_id, text_id (two hashes), n, and root: the signature that names its class."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    bands = Bands(similarity)
    text_id = {"h": F.xxhash64("text"), "c": F.crc32(F.col("text").cast("binary"))}

    def describe(batches):
        for batch in gather(batches, "text"):
            values, second, first, s = shingle_sets(batch.column("text"), width)
            points = points_of(values, first, similarity)
            fine = np.array([b"", *packed(points.fine)], object)[points.row + 1]
            columns = [batch.column("doc_id"), batch.column("h"), batch.column("c"), pa.array(points.sizes), pa.array(s), pa.array(signatures(second, first))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(packed(points.coarse), pa.binary()), pa.array(fine, pa.binary())], names=["doc_id", "h", "c", "n", "s", "t", "coarse", "fine"])

    described = materialize(rows.withColumns(text_id).mapInArrow(describe, "doc_id long, h long, c long, n long, s long, t long, coarse binary, fine binary"), "sets")
    # two different sets may have one first signature: by chance alone, so these are a handful in 10^10 sets; they go by their second one
    clash = described.where("n > 0").groupBy("s").agg(F.min("t").alias("x"), F.max("t").alias("y"), F.sum("n").alias("n")).where("x <> y")
    clashes = frozenset(r["s"] for r in clash.collect())
    sets = described.withColumn("sig", F.when(F.col("s").isin(*clashes), F.col("t")).otherwise(F.col("s"))) if clashes else described.withColumnRenamed("s", "sig")

    def named(batch):
        values, second, first, s = shingle_sets(batch.column("text"), width)
        if clashes:
            s = np.where(np.isin(s, list(clashes)), signatures(second, first), s)
        return values, first, s

    def route(batches):
        seen: set[int] = set()
        for batch in gather(batches, "text"):
            values, first, sigs = named(batch)
            n = np.diff(first)
            own = [k for k, (s, n) in enumerate(zip(sigs.tolist(), n.tolist(), strict=True)) if n and not (s in seen or seen.add(s))]
            if len(seen) > 1_000_000:
                seen = set()
            keep = np.zeros(len(sigs), bool)
            keep[own] = True
            values = values[np.repeat(keep, n)]
            keys, owners = cell_keys(values, np.concatenate([[0], np.cumsum(n[keep])]), bands)
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(sigs[keep][owners])], names=["key", "sig"])

    # every set of a key but the first: linked for now with the first, its centre
    total = sets.agg(F.sum("n").alias("n")).first().n or 0
    parts = max(parallelism(docs), -(-total * KEY_BYTES // PART_BYTES))
    keyed = rows.select("text").mapInArrow(route, "key long, sig long").repartition(parts, "key")
    order = W.partitionBy("key").orderBy("sig")
    keyed = keyed.select("sig", F.first("sig").over(order).alias("centre"), F.lag("sig").over(order).alias("before"))
    stars = materialize(keyed.where("sig <> centre and sig <> before").groupBy("sig", "centre").agg(F.count("*").alias("keys")), "stars")

    # the points of the sets that share a key with another, one for each set
    nodes = stars.select("sig").unionByName(stars.select(F.col("centre").alias("sig"))).distinct()
    reps = sets.where("n > 0").join(nodes, "sig", "left_semi").groupBy("sig").agg(F.min(F.struct("h", "c", "n", "coarse", "fine")).alias("t"))
    reps = materialize(reps.select("sig", "t.*"), "nodes")
    sizes = reps.select("sig", "n")

    def texts_of(sigs: DataFrame) -> DataFrame:
        """sig and text of these sets: one text each, so that copies are not sent."""
        wanted = materialize(reps.select("sig", "h", "c").join(sigs.distinct(), "sig", "left_semi"), "wanted")
        some, _ = split_by_keys(rows.select("text"), text_id["h"], wanted.select("h"))
        once = some.where("text is not null").withColumns(text_id).groupBy("h", "c").agg(F.first("text").alias("text"))
        return once.join(wanted.hint("merge"), ["h", "c"]).select("sig", "text")

    def ordered_by_sig(group):  # so that the root of a tree is its least signature
        return group.take(pa.array(np.argsort(group.column("sig").to_numpy())))

    def sift(group):
        """The sets that may link with one of another class, by the bounds of the tree."""
        group = ordered_by_sig(group)
        fine = group.column("fine").to_pylist()
        long = np.array([len(b) > 0 for b in fine])
        points = Points(unpacked(group.column("coarse").to_pylist(), GROUPS), similarity, unpacked([b for b in fine if b], FINE), np.where(long, np.cumsum(long) - 1, -1))
        tree, label, keep = Tree(points), group.column("label").to_numpy(), np.zeros(len(fine), bool)
        for a in np.flatnonzero(group.column("query").to_numpy()).tolist():
            near = tree.near(a)
            near = near[label[near] != label[a]]
            keep[near] = True
            keep[a] |= len(near) > 0
        return group.select(["sig", "label", "query", "bin"]).filter(pa.array(keep))

    def check(group):
        """Verified links between sets of different classes; signatures are those of the texts that came."""
        group = ordered_by_sig(group)
        values, first, sigs = named(group)
        label: dict[int, int] = {}
        forest = Forest(len(sigs))
        for k, x in enumerate(group.column("label").to_pylist()):
            forest.union(label.setdefault(x, k), k)
        before = forest.roots()
        root = verified(values, first, similarity, np.flatnonzero(group.column("query").to_numpy()), forest).roots()
        moved = np.flatnonzero(root != before)
        return pa.Table.from_arrays([pa.array(sigs[moved], pa.int64()), pa.array(sigs[root[moved]], pa.int64())], names=["a", "b"])

    def dealt(members: DataFrame, copies) -> tuple[DataFrame, int]:
        """members (sig, group, n) with k, the number of blocks of their group, and home, the block of each; and how many bins to compare in."""
        k = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / bin_shingles)).cast("int")
        groups = materialize(members.groupBy("group").agg(k.alias("k"), F.count("*").alias("rows"), F.sum("n").alias("n")), "groups")
        most = groups.agg(F.sum(F.col("n") * copies).alias("n"), F.sum(F.col("rows") * copies).alias("rows")).first()
        bins = max(-(-int(most.n or 0) // bin_shingles), -(-int(most["rows"] or 0) // block), 1)
        return members.join(groups.select("group", "k"), "group").withColumn("home", F.pmod(F.xxhash64("sig"), F.col("k")).cast("int")), bins

    def compare(places: DataFrame, bins: int, name: str) -> DataFrame:
        """Links (a, b) found in bins of blocks. places: sig, label, query, and group and part, which name the block.

        Points are compared first; texts go only where a bound lets sets of different classes link.
        """
        placed = places.select("sig", "label", "query", F.pmod(F.xxhash64("group", "part"), F.lit(bins)).cast("int").alias("bin"))
        placed = placed.groupBy("sig", "bin").agg(F.min("label").alias("label"), F.bool_or("query").alias("query"))
        near = placed.join(reps.select("sig", "coarse", "fine").hint("merge"), "sig").groupBy("bin").applyInArrow(sift, "sig long, label long, query boolean, bin int")
        near = materialize(near, "survivors")
        return materialize(near.join(texts_of(near.select("sig")).hint("merge"), "sig").groupBy("bin").applyInArrow(check, "a long, b long"), name)

    def star(pairs: DataFrame, name: str) -> DataFrame:
        """Compare each set with its centre, which goes to every block of its group."""
        members, bins = dealt(pairs.join(sizes, "sig").select("sig", F.col("centre").alias("group"), "n"), 1 + F.col("k") / F.col("rows"))
        own = members.select("sig", "group", F.col("home").alias("part"), F.lit(False).alias("query"))
        hub = members.groupBy("group").agg(F.max("k").alias("k")).select(F.col("group").alias("sig"), "group", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"), F.lit(True).alias("query"))
        return compare(own.unionByName(hub).withColumn("label", F.col("sig")), bins, name)

    def labelled(df: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
        found = labels.select(F.col("id").alias(column), F.col("component").alias("found"))
        return df.join(found, column, "left").withColumn(name, F.coalesce("found", column)).drop("found")

    # first the centre with which a set shares most keys, then, where classes still differ, all its centres
    best = stars.groupBy("sig").agg(F.max(F.struct("keys", "centre")).alias("best")).select("sig", "best.centre")
    links = star(best, "links")
    labels = components(links)
    left = labelled(labelled(stars, labels, "sig", "x"), labels, "centre", "y").where("x <> y").select("sig", "centre")
    left = materialize(left.join(best, ["sig", "centre"], "left_anti"), "left")
    if not left.isEmpty():
        links = links.unionByName(star(left, "links"))
        labels = components(links)
    # groups of one centre whose sets are still of different classes: compare all of them
    members = labelled(stars.select("sig", F.col("centre").alias("group")), labels, "sig", "label")
    open_ = members.groupBy("group").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("group")
    members = materialize(members.join(open_, "group", "left_semi").join(sizes, "sig").select("sig", "group", "label", "n"), "open")
    if not members.isEmpty():
        tiled, bins = dealt(members, F.col("k"))
        tiles = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.concat_ws(" ", F.least(i, F.col("home")), F.greatest(i, F.col("home"))))
        tiled = tiled.select("sig", "group", "label", F.explode(tiles).alias("part"), F.lit(True).alias("query"))
        labels = components(links.unionByName(compare(tiled, bins, "links")))
    return labelled(sets, labels, "sig", "root").select("doc_id", "h", "c", "n", "root")


def classes(docs: DataFrame, similarity: int = 85, width: int = 4, text: str = "text", doc_id: str = "doc_id", block: int = 4096, bin_shingles: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id: the classes of documents connected by links of at least similarity percent."""
    named = materialize(_linked(docs, similarity, width, text, doc_id, block, bin_shingles), "named")
    least = materialize(named.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    out = named.join(least, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame, similarity: int = 80, width: int = 5, text: str = "text", doc_id: str = "doc_id", block: int = 4096, bin_shingles: int = 1_000_000) -> DataFrame:
    """One document of each class: the one of the least doc_id (of different texts with that id, the one of the least hash).

    Rows of equal doc_id and text count as one document; rows without a doc_id stay, and so do rows without words. Only documents that
    have to go, or that occur more than once, are exchanged.
    """
    p = inner(docs)
    named = materialize(_linked(docs, similarity, width, text, doc_id, block, bin_shingles), "named").where("doc_id is not null and n > 0")
    own = F.struct("doc_id", "h", "c")
    named = named.groupBy("root", "doc_id", "h", "c").agg(F.count("*").alias("rows"))
    least = named.groupBy("root").agg(F.min(own).alias("least"))
    suspects = named.join(least, "root").where((own != F.col("least")) | (F.col("rows") > 1))
    suspects = materialize(suspects.select(F.col("doc_id").alias(f"{p}id"), F.col("h").alias(f"{p}h"), F.col("c").alias(f"{p}c"), (own == F.col("least")).alias(f"{p}stays")), "suspects")
    some, others = split_by_keys(docs, F.col(doc_id), suspects.select(f"{p}id"))
    some = some.withColumns({f"{p}id": F.col(doc_id).cast("long"), f"{p}h": F.xxhash64(text), f"{p}c": F.crc32(F.col(text).cast("binary"))})
    key = [f"{p}id", f"{p}h", f"{p}c"]
    marked = some.join(suspects.hint("merge"), key, "left")
    stay = marked.where(F.col(f"{p}stays").isNull()).select(*docs.columns)
    once = marked.where(F.col(f"{p}stays")).dropDuplicates(key).select(*docs.columns)
    return others.unionByName(stay).unionByName(once)


def op9_ngram_jaccard(spark, sf_dir):
    return classes(read(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS g FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s AS x JOIN s AS y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM o JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), r(id, c) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, k.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS component_id FROM r GROUP BY id) AS k ON k.id = d.doc_id
"""
