"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius.  Two fingerprints within the
radius of each other share a variant, so shuffling on variants brings every pair together; at most
65 distinct fingerprints can meet in one variant (for radius 2), whatever the number of copies.
Links are verified and deduplicated, and components found by repeated contraction: each round every
node hooks to its smallest neighbour, the trees are flattened by pointer doubling, and the edges are
rewritten between their roots, which over two rounds at least halves the nodes of every unfinished
component.

The pipeline's near duplicates (:func:`drop_near_duplicates`) are texts 0.8 alike by five-word shingles.
They meet in the components of their fingerprints, found as above.  A pair at 0.8 differs in about a sixth
of the bits of any SimHash, though, so most lie beyond the radius: for these, texts meet in MinHash bands
too.  Where many unlike texts meet, prefix filtering finds the pairs; all are confirmed by their sets.

Defined results: a null or blank text has fingerprint zero, linked like any other; a null id never
names a component unless no member has an id (then the component's id is null); repeated rows are
kept; other columns are ignored by the queries and kept by :func:`drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textwork as tw
from .shared import discard, materialize, table

#: MinHash bands a text is looked up by, and the minima in each: two sets of 0.8 Jaccard similarity share
#: a band with probability 1 - (1 - 0.8 ** 6) ** 32 = 0.9999, whatever the edit that parts them.
BANDS = 32
BAND_ROWS = 6
#: Buckets of at most so many nodes are compared pair by pair; the rest by their rare shingles.
SMALL_BUCKET = 8
#: How often one pair of each two components is tried before all that are left.
ROUNDS = 3
#: Bits set in a byte value, one per byte lane of a 64-bit word.
_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """Per row of a matrix of 64-bit hashes: the bits set in over half of them."""
    n = hashes.shape[1]
    lanes = _LANES[np.ascontiguousarray(hashes).astype("<u8").view(np.uint8).reshape(*hashes.shape, 8)]
    sums = np.add.reduceat(lanes, np.arange(0, n, 255), axis=1)  # of 255 hashes at most, so no lane overflows
    counts = np.ascontiguousarray(sums).astype("<u8").view(np.uint8).reshape(len(hashes), -1, 64).sum(axis=1, dtype=np.int64)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view("<u8").ravel()


def shingle_hashes(words: list[bytes], k: int, seed: int) -> np.ndarray:
    """XXH64 of all k-word shingles joined by spaces, repeats included; of all words if they are fewer."""
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    n = len(words) - k + 1
    if n <= 1:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n)


def fingerprint(text: bytes, k: int, seed: int) -> int:
    """Majority bits of the hashes of all k-word shingles, repeats included."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    return int(majority(shingle_hashes(words, k, seed)[None, :])[0]) if words else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, seed: int = 42) -> DataFrame:
    """Per row: the id and ``fp``, the fingerprint as a signed long."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", k, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(rows, f"id {kind}, fp long")


def ball(fp: Column, radius: int, bits: int = 64) -> Column:
    """All values within ``radius`` of the low ``bits``, the value itself first."""
    masks = [0]
    layer = {0}
    for _ in range(radius):
        layer = {m | 1 << b for m in layer for b in range(bits) if not m >> b & 1}
        masks += sorted(layer)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.transform(F.array(*[F.lit(m) for m in signed]), lambda m: fp.bitwiseXOR(m))


def links(distinct: DataFrame, radius: int = 2, every_pair: bool = False) -> DataFrame:
    """Verified links (a < b) between distinct fingerprints ``fp``.

    By default each variant yields the chain of its members, which has the components of all pairs
    and fewer rows; ``every_pair`` yields each pair within the radius once.
    """
    near = (radius + 1) // 2
    every_pair = every_pair or radius % 2 == 1  # else the members of a variant may lie apart
    met = distinct.select("fp", F.explode(ball(F.col("fp"), near)).alias("variant"))
    if every_pair:
        groups = met.groupBy("variant").agg(F.collect_set("fp").alias("m")).where(F.size("m") > 1)
        left = groups.select("m", F.explode("m").alias("a"))
        pairs = left.select("a", F.explode("m").alias("b")).where("a < b")
    else:
        before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
        pairs = met.select(before.alias("a"), F.col("fp").alias("b")).where(F.col("a").isNotNull())
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of the component."""
    edges = materialize(edges.select("a", "b"), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    roots = None  # of all nodes seen, as far as contracted
    while True:
        both = edges.union(edges.select("b", "a"))
        hook = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "hook")
        while True:  # pointer doubling until all point at roots
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
            jumped = materialize(hook.join(up, "root").select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")), "jump")
            moved = jumped.where("moved").limit(1).count()
            discard(hook)
            hook = jumped.select("node", "root")
            if not moved:
                break
        if roots is None:
            done = materialize(nodes.join(hook, "node"), "roots")
        else:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
            done = materialize(roots.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        ends = [hook.select(F.col("node").alias(x), F.col("root").alias(x + "r")) for x in ("a", "b")]
        rest = edges.join(ends[0], "a").join(ends[1], "b").where("ar <> br")
        rest = materialize(rest.select(F.least("ar", "br").alias("a"), F.greatest("ar", "br").alias("b")).distinct(), "edges")
        for old in (edges, hook, roots):
            if old is not None:
                discard(old)
        edges, roots = rest, done
        if not edges.limit(1).count():
            discard(edges)
            return roots


def classed(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """``distinct`` (fp and more, a row per fingerprint) with ``root``: the smallest fingerprint reachable over links."""
    roots = components(links(distinct, radius)).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """Per row of ``docs``: id, ``fp``, and ``component`` (the smallest id reachable over links)."""
    marked = materialize(fingerprints(docs, id_col, text_col, k, seed), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    rooted = classed(distinct, radius)
    # Written first, so that the join exchanges both sides and a large component can be split.
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component")), "components")
    named = materialize(rooted.join(least, "root").select("fp", "component"), "named")
    return marked.join(named, "fp").select("id", "fp", "component")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def _seeds(n: int, start: int) -> np.ndarray:
    return tw.mix(np.arange(start + 1, start + n + 1, dtype=np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit value per MinHash band of a set of 64-bit hashes."""
    turn, odd = _seeds(BANDS * BAND_ROWS, 200)[:, None], _seeds(BANDS * BAND_ROWS, 1000)[:, None] | np.uint64(1)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):  # long texts have many shingles
        least = np.minimum(least, ((hashes[None, at : at + 2048] ^ turn) * odd).min(axis=1))
    value = _seeds(BANDS, 2000)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        value = tw.mix(value ^ row)
    return value


def shingles(text: bytes) -> np.ndarray:
    """The set of hashes of the text's five-word shingles, sorted; empty for a blank text."""
    words = text.lower().split()
    return np.unique(shingle_hashes(words, 5, 7)) if words else np.zeros(0, np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is 0.8 or more."""
    small, large = sorted((a, b), key=len)
    if 5 * len(small) < 4 * len(large):
        return False
    common = len(np.intersect1d(small, large, assume_unique=True))
    return 5 * common >= 4 * (len(a) + len(b) - common)


def sketch(text: bytes) -> np.ndarray:
    """A hash of the set of shingles, its size, the query's fingerprint and ``BANDS`` band values.  Blank
    texts are all zero."""
    out = np.zeros(3 + BANDS, np.uint64)
    whole = shingles(text)
    if len(whole):
        out[0] = xxhash.xxh64_intdigest(whole.tobytes(), 9)
        out[1] = len(whole)
        out[2] = fingerprint(text, 3, 42)
        out[3:] = bands(whole)
    return out


def grouped(met: DataFrame, alike: Callable[[DataFrame], DataFrame], joined: Callable[[DataFrame, bool], DataFrame], small: int = SMALL_BUCKET) -> DataFrame:
    """(node, root) for the components of all alike pairs that meet in a bucket; ``met`` has node, the size
    of its set, and bucket.

    Every node is compared with the smallest of each of its buckets.  Buckets that this leaves in several
    components go on: all pairs of different components of one of at most ``small`` nodes are compared;
    the nodes of larger ones (node, size, root) are handed to ``joined``, which gives all pairs that can be
    alike without pairing the members of a bucket.  First it is asked, a few times, for one pair of each two
    components: what these link needs no further pairs.  So no pair is lost that may join components.
    """
    heads = met.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head <> last").drop("last")
    shared = materialize(met.join(heads, "bucket"), "shared")
    first = materialize(shared.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = materialize(alike(first), "links")
    roots = components(links)
    name = lambda df, roots: df.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialize(name(shared.drop("head").distinct(), roots), "rooted")
    apart = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members")).where("low <> high")
    apart = materialize(apart.select("bucket", "members"), "apart")
    many = apart.where(F.col("members") > small)
    crowd = materialize(rooted.join(many, "bucket", "left_semi").select("node", "size", "root").distinct(), "crowd")
    crowded = bool(crowd.limit(1).count())
    for _ in range(ROUNDS if crowded else 0):
        found = materialize(alike(joined(crowd, True)), "links")
        if not found.limit(1).count():
            break
        links = materialize(links.unionByName(found), "links")
        roots = components(links)
        crowd = materialize(name(crowd.drop("root"), roots), "crowd")
    rooted = materialize(name(rooted.drop("root"), roots), "rooted")
    few = apart.where(F.col("members") <= small).select("bucket")
    sides = [rooted.join(few, "bucket").select("bucket", *[F.col(c).alias(x + c) for c in ("node", "size", "root")]) for x in ("a", "b")]
    sized = (5 * F.col("asize") >= 4 * F.col("bsize")) & (5 * F.col("bsize") >= 4 * F.col("asize"))
    rest = sides[0].join(sides[1], "bucket").where("anode < bnode AND aroot <> broot").where(sized)
    rest = rest.select(F.col("anode").alias("a"), F.col("bnode").alias("b"))
    if crowded:
        rest = rest.unionByName(joined(crowd, False))
    rest = materialize(rest.distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    if rest.limit(1).count():
        roots = components(links.unionByName(alike(rest)))
    for old in (shared, first, links, rooted, apart, crowd, rest):
        discard(old)
    return roots


def prefixes(crowd: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, node, size, place): the first tokens of each set, by rarity among all sets, of which an alike
    set must hold one: all but the last ceil(0.8 n), and one more.  ``crowd``: node and size; ``tokens``: node
    and each token of its set.  Tokens of a single set are left out, but have their places."""
    counts = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    held = tokens.join(counts, "token").join(crowd.select("node", "size"), "node")
    # Tokens of a single set come first in it; they pair nothing, and only their number counts.
    w = Window.partitionBy("node")
    place = F.row_number().over(w.orderBy("n", "token")) + F.col("size") - F.count("*").over(w)  # from 1
    placed = held.withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(4 * F.col("size") / 5) + 1)
    return materialize(placed.select("token", "node", "size", "place"), "prefixes")


def prefix_pairs(placed: DataFrame, roots: DataFrame, one_each: bool = False) -> DataFrame:
    """(a, b), a < b: the pairs of nodes of different roots whose sets can have a Jaccard similarity of
    0.8 or more; with ``one_each`` one such pair at most of each two roots.  ``placed``: as from
    :func:`prefixes`; ``roots``: node and root.

    Prefix filtering: of an alike pair the larger set has among its first tokens one that the smaller has
    among all but its last ceil(8/9 n) and one more, at places from which the rest can still overlap
    enough.  What many sets share comes last in all of them and pairs nothing.
    """
    known = placed.join(roots.select("node", "root"), "node")
    mixed = known.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    met = known.join(mixed, "token", "left_semi")
    small = met.where(F.col("place") <= F.col("size") - F.ceil(8 * F.col("size") / 9) + 1)
    if one_each:  # of each root the set that has the token foremost
        lead = lambda df: df.groupBy("token", "root").agg(F.min(F.struct("place", "node", "size")).alias("e")).select("token", "root", "e.*")
        small, met = lead(small), lead(met)
    side = lambda df, x: df.select("token", *[F.col(c).alias(x + c) for c in ("node", "size", "root", "place")])
    ordered = (F.col("ssize") < F.col("lsize")) | ((F.col("ssize") == F.col("lsize")) & (F.col("snode") < F.col("lnode")))
    most = F.least(F.col("ssize") - F.col("splace"), F.col("lsize") - F.col("lplace")) + 1
    enough = (5 * F.col("ssize") >= 4 * F.col("lsize")) & (9 * most >= 4 * (F.col("ssize") + F.col("lsize")))
    pairs = side(small, "s").join(side(met, "l"), "token").where(F.col("sroot") != F.col("lroot")).where(ordered & enough)
    pairs = pairs.select(F.least("snode", "lnode").alias("a"), F.greatest("snode", "lnode").alias("b"), F.least("sroot", "lroot").alias("ra"), F.greatest("sroot", "lroot").alias("rb"))
    if one_each:
        pairs = pairs.groupBy("ra", "rb").agg(F.min(F.struct("a", "b")).alias("p")).select("p.*")
    return pairs.select("a", "b").distinct()


def tokens_of(nodes: DataFrame, distinct: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, token) for every shingle of the texts of ``nodes``, once per set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0), batch.column(1), strict=True):
                found = shingles(text.as_buffer().to_pybytes()).view(np.int64)
                for at in range(0, len(found), 1 << 16):
                    part = found[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), node.as_py())), pa.array(part)], names=["node", "token"])

    keys = distinct.select("node", "key").join(nodes.select("node"), "node", "left_semi")
    return texts.join(keys, "key").select("node", "t").dropDuplicates(["node"]).mapInArrow(rows, "node long, token long")


def alike(pairs: DataFrame, distinct: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes of ``distinct`` whose texts' sets of shingles are 0.8 alike or more."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    keys = distinct.select("node", "key").join(ends, "node")
    held = materialize(texts.join(keys, "key").select("node", "t").dropDuplicates(["node"]), "texts")
    side = lambda x: held.select(F.col("node").alias(x), F.col("t").alias(x + "t"))

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, np.zeros(0, np.uint64)  # rows of one a follow each other
        for batch in batches:
            keep = []
            for i, a in enumerate(batch.column(0).to_pylist()):
                if a != last:
                    last, known = a, shingles(batch.column(2)[i].as_buffer().to_pybytes())
                keep.append(similar(known, shingles(batch.column(3)[i].as_buffer().to_pybytes())))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    lined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "at", "bt")
    found = materialize(lined.mapInArrow(confirmed, "a long, b long"), "alike")
    discard(held)
    return found


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, component, first) of near duplicates, a row per row of ``docs``: texts whose sets of
    five-word shingles have a Jaccard similarity of 0.8 or more, and texts that such pairs join.
    ``component`` is the group's smallest id, ``key`` a hash of the row's own text, and ``first`` tells
    whether the row has the smallest (id, key) of its group.

    Texts of one set of shingles are one node.  Nodes meet if their fingerprints, of all texts of a node, are
    linked by the query's ball hashing, over any number of links, or if they share a MinHash band, which
    finds the pairs beyond its radius.  They are compared as in :func:`grouped`; a large group of copies costs
    few comparisons each, and texts that only share much of their words are told apart by their rare
    shingles (:func:`prefix_pairs`).  Candidate pairs are deduplicated and confirmed on their texts.
    """
    names = ["node", "size", *(f"m{i}" for i in range(BANDS))]
    columns = [*names[:2], "fp", *names[2:]]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.stack([sketch(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(2)]) if batch.num_rows else np.zeros((0, len(columns)), np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in found.T)], names=["id", "key", *columns])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    texts = docs.select(F.xxhash64(text).alias("key"), text.alias("t"))
    cells = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("t"))
    marked = materialize(cells.mapInArrow(rows, ", ".join([f"id {kind}", "key long", *(f"{c} long" for c in columns)])), "sketches")
    # Rows without an id come after all others.
    own = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    distinct = materialize(marked.groupBy(*names).agg(F.min(own).alias("least"), F.min("key").alias("key")), "distinct")
    met = distinct.where("size > 0").select("node", "size", F.explode(F.array(*names[2:])).alias("bucket"))
    printed = materialize(marked.where("size > 0").select("node", "size", "fp").distinct(), "fingerprints")
    # Written first, so that the join exchanges both sides and a frequent fingerprint can be split.
    classes = materialize(classed(materialize(printed.select("fp").distinct(), "distinct")), "classes")
    linked = printed.join(classes, "fp").select("node", "size", F.xxhash64(F.lit("fingerprints"), "root").alias("bucket"))
    met = met.unionByName(materialize(linked.distinct(), "linked"))
    held: list[DataFrame] = []  # the prefixes of the crowd, the same in every round

    def joined(crowd: DataFrame, one_each: bool) -> DataFrame:
        if not held:
            held.append(prefixes(crowd, tokens_of(crowd, distinct, texts)))
        return prefix_pairs(held[0], crowd, one_each)

    roots = grouped(met, lambda pairs: alike(pairs, distinct, texts), joined)
    rooted = distinct.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    # Written first, so that the join exchanges both sides and a large component can be split.
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("first")), "components")
    named = materialize(rooted.join(least, "root").select("node", "first"), "named")
    found = marked.select("id", "key", "node").join(named, "node")
    return found.select("id", "key", F.col("first.id").alias("component"), (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key"))).alias("first"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep one row per group of :func:`similar_groups`, that of its smallest id, then hash of the text.

    Rows that repeat this id and text fall to one; different texts under one id are kept if they are
    not alike.  Rows with a null id cannot be named as anyone's copy and are kept."""
    found = similar_groups(docs, id_col, text_col)
    key, taken = "__key", {c.lower() for c in docs.columns}
    while key in taken:
        key += "_"
    keep = found.where(F.col("first") & F.col("id").isNotNull()).select(F.col("id").alias(id_col), F.col("key").alias(key)).distinct()
    keyed = docs.withColumn(key, F.xxhash64(F.col(text_col).cast("string")))
    kept = keyed.join(keep, [id_col, key], "left_semi").dropDuplicates([id_col, key])  # partitioned by both already
    return kept.select(*[f"`{c}`" for c in docs.columns]).unionByName(docs.where(F.col(id_col).isNull()))
