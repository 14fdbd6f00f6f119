"""Near-duplicate groups by an inverted join on MinHash coordinates.

Documents with equal shingle sets are one class. A class has a signature of
`COORDINATES` minima; each (coordinate, value) pair is a token under which the class is
posted. Two classes whose similarity reaches the limit agree in at least `matches` tokens
(but for a chance below `MISS`), so:

* tokens that only one class has need no posting, and a class with fewer than `matches`
  shared tokens is skipped;
* of the `s` shared tokens of a class, in one order for all (rarest first), only the first
  `s - matches + 1` are posted: the prefixes of two such classes must meet.

Within a posting list classes are first joined to the list's smallest class only. The
links that hold on full sets give components; lists whose members are all in one component
are done. In the others each class outside the first component meets `PIVOTS` members of
it, and what is still apart meets all the rest, in blocks where a list is large. So no pair of different components that
meets anywhere goes unseen, while a large group of near copies costs a few pairs per copy
and list. Every link is confirmed on the full
sets of shingle hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import id_text, staged
from tidewatch.llm.hashing import GOLDEN, MIX_A, MIX_B, Memo, mixed, word_hashes

COORDINATES = 64
SHINGLE = 2
PERCENT = 80
MISS = 1e-7
SEED = 20_011
PIVOTS = 2
LIST_PAIRS = 500  # beyond so many pairs a list's open nodes are compared in blocks
BLOCK = 2_000
# a Bloom filter of at most 4 MB, whatever the input's size, keeps texts that no pair needs
# out of the shuffle; beyond about 4 million classes it lets more of them through, losing none
TEXT_JOIN = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1MB",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1TB",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "4000000",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": "33554432",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def least_matches(n: int, p: float, miss: float = MISS) -> int:
    """Largest m for which fewer than m successes of n have a chance of at most `miss`."""
    total, m = 0.0, 0
    while True:
        total += comb(n, m) * p**m * (1 - p) ** (n - m)
        if total > miss:
            return m
        m += 1


def shingle_hashes(text: bytes, size: int, memo: Memo) -> np.ndarray:
    """Distinct hashes of the shingles, sorted; the whole sequence if it has fewer words."""
    words = word_hashes(text.lower().split(), memo)  # bytes.lower() changes A-Z only
    if not len(words):
        return words
    size = min(size, len(words))
    sums = np.full(len(words) - size + 1, size * GOLDEN % (1 << 64), np.uint64)
    for k in range(size):
        sums = mixed(sums * np.uint64(MIX_B) + words[k : len(words) - size + 1 + k])
    return np.unique(sums)


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _row_key(text_hash: Column) -> Column:
    """Tells rows apart by id and text; a chance collision costs a comparison of set keys."""
    return F.xxhash64(F.col("doc_id"), text_hash)


def sketch(docs: DataFrame, size: int, coordinates: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key, low bits and signature of every row."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        factors = mixed(np.arange(SEED, SEED + coordinates, dtype=np.uint64) * np.uint64(GOLDEN)) | np.uint64(1)
        offsets = mixed(factors * np.uint64(MIX_A))
        for batch in batches:
            sizes, keys, bits, signatures = [], [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                hashes = shingle_hashes(text or b"", size, memo)
                sizes.append(len(hashes))
                keys.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                least = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(hashes), 4096):  # keeps the table small for long texts
                    table = hashes[None, at : at + 4096] * factors[:, None] + offsets[:, None]
                    np.minimum(least, table.min(1), out=least)
                least = (mixed(least) >> np.uint64(32)).astype(np.uint32)
                bits.append(int.from_bytes(np.packbits((least[:64] & 1).astype(np.uint8)).tobytes(), "big", signed=True))
                signatures.append(least.view(np.int32))
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "text_hash": batch.column("text_hash"),
                    "n_shingles": pa.array(sizes, pa.int64()),
                    "set_key": pa.array(keys, pa.binary()),
                    "bits": pa.array(bits, pa.int64()),
                    "signature": pa.array(signatures, pa.list_(pa.int32())),
                }
            )

    rows = id_text(docs).withColumn("text_hash", _text_hash(F.col("text")))
    return rows.mapInArrow(
        sketched, "doc_id bigint, text_hash bigint, n_shingles bigint, set_key binary, bits bigint, signature array<int>"
    )


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node on an edge (a, b).

    Alternates two rewritings, which keep the components, until nothing changes: every
    node hands its larger neighbours, then its smaller ones, to its smallest neighbour.
    Rounds grow with the logarithm of the graph's diameter; each is one table.
    """
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a")
        edges = staged(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(small.select("a", F.col("m").alias("b")))
            .filter("a > b")
            .distinct(),
            "edges",
        )
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _close(one: str, other: str, percent: int, bits: int) -> Column:
    """Sizes and low bits do not rule out the similarity."""
    a, b = F.col(f"{one}.n_shingles"), F.col(f"{other}.n_shingles")
    agreeing = 64 - F.bit_count(F.col(f"{one}.bits").bitwiseXOR(F.col(f"{other}.bits")))
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (agreeing >= bits)


def _alike(pairs: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """The pairs whose whole signatures agree in at least `matches` coordinates."""
    signed = classes.select("node", "signature")
    compared = pairs.join(signed.withColumnsRenamed({"node": "a", "signature": "sa"}), "a").join(
        signed.withColumnsRenamed({"node": "b", "signature": "sb"}), "b"
    )
    agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda same: same))
    return compared.filter(agree >= matches).select("a", "b")


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def _sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """node and its full set, made again from one row of each class.

    The wanted classes are a table of their own, so that its size is known before the
    texts are read: texts of other classes are dropped before the shuffle, by a broadcast
    of that table while it is small and by its Bloom filter beyond.
    """
    wanted = staged(classes.select("node", "row_key", "set_key").join(nodes, "node", "left_semi"), "wanted")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            out_nodes, sets = [], []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for node, key, text in zip(batch.column("node").to_pylist(), batch.column("set_key").to_pylist(), texts):
                hashes = shingle_hashes(text or b"", size, memo)
                if hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() == key:
                    out_nodes.append(node)
                    sets.append(hashes.view(np.int64))
            yield pa.record_batch({"node": pa.array(out_nodes, pa.int64()), "set": pa.array(sets, pa.list_(pa.int64()))})

    # a class is found by the hash of one of its rows, so its other copies stay where they
    # are; the filter on `node` is always true, Spark makes Bloom filters of filtered tables
    texts = id_text(docs).select(_row_key(_text_hash(F.col("text"))).alias("row_key"), "text")
    found = texts.join(wanted.filter("node >= 0"), "row_key").dropDuplicates(["row_key", "node"])
    made = found.select("node", "set_key", "text").mapInArrow(hashed, "node bigint, set array<bigint>")
    return staged(made, "sets", TEXT_JOIN)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    compared = pairs.join(sets.withColumnsRenamed({"node": "a", "set": "sa"}), "a").join(
        sets.withColumnsRenamed({"node": "b", "set": "sb"}), "b"
    )
    shared = F.size(F.array_intersect("sa", "sb"))
    return staged(
        compared.filter(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b"), "links"
    )


def _plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that 31 bits of every hash do not rule out, for half the bytes.

    No similar pair is lost: shortening merges at most as many shared hashes as it merges
    in either set, and so many are added back.
    """
    short = F.array_distinct(F.transform("set", lambda h: h.bitwiseAND(0x7FFFFFFF).cast("int")))
    brief = sets.select("node", short.alias("short"), F.size("set").alias("n"))
    compared = pairs.join(brief.withColumnsRenamed({"node": "a", "short": "sa", "n": "na"}), "a").join(
        brief.withColumnsRenamed({"node": "b", "short": "sb", "n": "nb"}), "b"
    )
    merged = F.least(F.col("na") - F.size("sa"), F.col("nb") - F.size("sb"))
    shared = F.size(F.array_intersect("sa", "sb")) + merged
    return staged(
        compared.filter(100 * shared >= percent * (F.col("na") + F.col("nb") - shared)).select("a", "b"), "plausible"
    )


def _posts(classes: DataFrame, matches: int) -> DataFrame:
    """token, node, n_shingles and bits: the prefix of each class that shares enough tokens."""
    tokens = classes.select("node", F.posexplode("signature")).select(
        "node", F.shiftleft(F.col("col").cast("bigint"), 8).bitwiseOR(F.col("pos").cast("bigint")).alias("token")
    )
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = tokens.join(counts, "token")
    of_node = Window.partitionBy("node")
    ranked = shared.select(
        "node",
        "token",
        F.row_number().over(of_node.orderBy("n", "token")).alias("rank"),
        F.count(F.lit(1)).over(of_node).alias("shared"),
    )
    prefix = ranked.filter(F.col("rank") <= F.col("shared") - matches + 1).select("node", "token")
    return prefix.join(classes.select("node", "n_shingles", "bits"), "node")


def _block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of nodes outside their list's first component (`main`) to the list's others.

    `members` (main, node, component) are the nodes of large lists. The nodes outside are
    the queries; per `main` they meet all members in blocks of about `BLOCK` by `BLOCK`
    nodes. Of the links from one node to one component, one is returned.
    """
    sizes = members.groupBy("main").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).alias("rows"),
        F.ceil(F.sum((F.col("component") != F.col("main")).cast("bigint")) / BLOCK).alias("queries"),
    )
    placed = members.join(sizes, "main").filter("queries > 0").join(sets, "node")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    columns = ["main", "x", "y", "node", "component", "set"]
    rows = placed.withColumn("y", own("rows")).withColumn("x", every("queries")).select(*columns)
    queries = (
        placed.filter("component <> main")
        .withColumn("x", own("queries"))
        .withColumn("y", every("rows"))
        .select(*columns)
        .toDF(*columns)  # columns of their own beside `rows`
    )

    def compared(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        if len(left) and len(right):
            lengths = right["set"].map(len).to_numpy()
            flat = np.concatenate(right["set"].to_numpy())
            starts = np.cumsum(lengths) - lengths
            nodes, parts = right["node"].to_numpy(), right["component"].to_numpy()
            for node, part, own_set in zip(left["node"], left["component"], left["set"]):
                ordered = np.sort(own_set)
                at = np.minimum(np.searchsorted(ordered, flat), len(ordered) - 1)
                shared = np.add.reduceat((ordered[at] == flat).astype(np.int64), starts)
                hit = (100 * shared >= percent * (len(ordered) + lengths - shared)) & (parts != part)
                first = np.unique(parts[hit], return_index=True)[1]
                found += [(node, other) for other in nodes[hit][first]]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    keys = ["main", "x", "y"]
    return queries.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(compared, "a bigint, b bigint")


def _links(docs: DataFrame, classes: DataFrame, percent: int, size: int, coordinates: int) -> DataFrame:
    """Confirmed links between classes that keep all components together."""
    matches = least_matches(coordinates, percent / 100)
    bits = least_matches(64, (1 + percent / 100) / 2) if coordinates >= 64 else 0
    posts = _posts(classes, matches)
    lists = (
        posts.groupBy("token")
        .agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("token", "first")
    )
    posts = staged(posts.join(lists, "token"), "posts")

    def candidates(pairs: DataFrame) -> DataFrame:
        return staged(_alike(pairs, classes, matches), "candidates")

    def sifted(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The links among pairs of which few hold."""
        pairs = _plausible(pairs, sets, percent)
        return _confirmed(pairs, sets.join(_nodes(pairs), "node", "left_semi"), percent)

    def still_open(links: DataFrame) -> DataFrame:
        placed = posts.drop("first").join(components(links), "node", "left").withColumn(
            "component", F.coalesce("component", "node")
        )
        mixed_lists = (
            placed.groupBy("token")
            .agg(F.min("component").alias("main"), F.max("component").alias("other"))
            .filter("main < other")
            .select("token", "main")
        )
        return staged(placed.join(mixed_lists, "token"), "open-posts")

    def met(x: DataFrame, y: DataFrame, condition: Column) -> DataFrame:
        close = _close("x", "y", percent, bits) & (F.col("x.component") != F.col("y.component"))
        return (
            x.alias("x")
            .join(y.alias("y"), (F.col("x.token") == F.col("y.token")) & condition & close)
            .select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b"))
            .distinct()
        )

    # each class and the smallest of the list
    star = posts.filter("node > first").select(F.col("node").alias("a"), F.col("first").alias("b"), "n_shingles", "bits")
    star = star.groupBy("a", "b", "n_shingles", "bits").agg(F.count(F.lit(1)).alias("collisions")).alias("x")
    sized = classes.select("node", "n_shingles", "bits").alias("y")
    star = star.join(sized, F.col("x.b") == F.col("y.node")).filter(_close("x", "y", percent, bits)).select("a", "b")
    star = candidates(star)
    links = _confirmed(star, _sets(_nodes(star), classes, docs, size), percent)

    # each class outside the first component and some of that component, by hash
    rows = still_open(links)
    by_hash = Window.partitionBy("token").orderBy(F.xxhash64("node", "token"), "node")
    some = rows.filter("component = main").withColumn("_n", F.row_number().over(by_hash)).filter(F.col("_n") <= PIVOTS)
    pivots = candidates(met(rows.filter("component <> main"), some, F.lit(True)))
    links = links.unionByName(sifted(pivots, _sets(_nodes(pivots), classes, docs, size)))

    # what is still apart: everything that meets in a list
    rows = still_open(links)
    outside = F.sum((F.col("component") != F.col("main")).cast("bigint"))
    busy = rows.groupBy("token").agg((outside * F.count(F.lit(1)) > LIST_PAIRS).alias("busy"))
    rows = rows.join(busy, "token")
    quiet = rows.filter(~F.col("busy"))
    main = F.col("y.component") == F.col("y.main")
    rest = candidates(met(quiet.filter("component <> main"), quiet, main | (F.col("y.node") < F.col("x.node"))))
    members = staged(rows.filter("busy").select("main", "node", "component").distinct(), "members")
    sets = _sets(_nodes(rest).unionByName(members.select("node")), classes, docs, size)
    return links.unionByName(sifted(rest, sets)).unionByName(_block_links(members, sets, percent))


def near_duplicates(
    docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, coordinates: int = COORDINATES
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept and text_hash.

    Documents are linked if 100 * shared shingles >= percent * all shingles of both.
    `component_id` is the smallest id reachable over links. Null and empty texts have no
    shingles and stand alone. Repeated rows and equal sets are one class; a component
    without any id has none (null), and all its documents are kept. Rows that share an id
    but not a text are told apart by `text_hash`. Only id and text are read.
    """
    sketches = staged(sketch(docs, size, coordinates), "sketches")
    classes = staged(
        sketches.filter("n_shingles > 0")
        .groupBy("set_key", "n_shingles", "bits", "signature")
        .agg(F.min("doc_id").alias("first"), F.min(_row_key(F.col("text_hash"))).alias("row_key"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    parts = components(_links(docs, classes, percent, size, coordinates))
    placed = classes.select("set_key", "first", "node").join(parts, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    smallest = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    named = placed.join(smallest, "component").select("set_key", "component_id")
    linked = sketches.filter("n_shingles > 0").drop("bits", "signature").join(named, "set_key")
    alone = sketches.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id", "text_hash"]
    return (
        linked.select(*columns)
        .unionByName(alone.select(*columns))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select("doc_id", "n_shingles", "component_id", "kept", "text_hash")
    )


def drop_near(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """The rows of `docs`, all columns, that are kept: one id of each component."""
    kept = near_duplicates(docs, percent, size).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    rows = docs.withColumn("_text_hash", _text_hash(F.col("text").cast("string")))
    return rows.join(
        kept,
        rows["doc_id"].cast("bigint").eqNullSafe(kept["_id"]) & (rows["_text_hash"] == kept["_hash"]),
        "left_semi",
    ).select(*docs.columns)


def brute_force(
    texts: list[tuple[int, str | None]], percent: int = PERCENT, size: int = SHINGLE
) -> dict[int, tuple[int, int]]:
    """Set size and component of each id, comparing all pairs that share a shingle (for tests)."""
    sets = {}
    for i, text in texts:
        words = (text or "").encode().lower().split()
        n = min(size, len(words))
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()
    home = {i: i for i in sets}

    def find(i):
        while home[i] != i:
            i = home[i]
        return i

    having: dict[tuple, list[int]] = {}
    for i in sorted(sets, key=lambda i: len(sets[i])):
        # rarer shingles would do; with at least one shared shingle no linked pair is missed
        need = len(sets[i]) - -(-percent * len(sets[i]) // 100) + 1 if sets[i] else 0
        seen = set()
        for s in sorted(sets[i])[:need]:
            seen.update(having.get(s, ()))
            having.setdefault(s, []).append(i)
        for j in seen:
            shared = len(sets[i] & sets[j])
            if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                home[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}
