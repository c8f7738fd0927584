"""Groups of texts by the similarity of their shingles, for the pipeline's near-duplicate stage.

Candidates come in two ways, and all are verified by their distinct shingles. First from SimHash fingerprints of the shingles, by the blocks of operator 7: those within two bits, and equal ones.
This joins groups of close copies with a candidate or two a text. But at a similarity of 0.8 one bit in seven differs, and hundreds of blocks of 32 bits a text still miss 14 pairs
in 100. So what is still apart gets candidates from bands of least hash values: a band is the least values of the shingle set under ROWS random orders, and a pair of similarity s shares it
with probability s^ROWS. Of pairs at exactly 0.8, 99.4 in 100 share one of BANDS bands or more; of 0.85 and above all but one in a thousand.

A band's bucket may hold thousands of near copies, so its pairs are not formed. In the first turn every member is compared with one of them, which joins a group of copies; in the next all
pairs of small buckets that are still apart; then in large buckets more and more of the members outside their largest group, each with all members of other groups. Turns end when no pair in any
bucket is left that is neither compared nor in one group, so nothing depends on a draw.

To be verified, pairs are dealt over squares of two parts of the nodes, and a set of shingles goes to each square once, however many pairs it has there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftnet.llm.simhash import links as print_links
from driftnet.llm.simhash import print_of
from driftnet.operators.graph import connected_components
from driftnet.storage import fresh_path, remove, settle, written

#: Bands of a text, and the orders that make one.
BANDS, ROWS = 28, 8
#: Members of a bucket up to which all pairs that are apart are compared in the second turn; members of a larger one that are compared with all in the third, eight times as many in each turn after.
SMALL, DRAWN = 32, 8
#: Bytes of the sets in a part of the nodes, on average, and the least number of parts.
PART, PARTS = 1 << 23, 4
#: Shingles ordered at a time.
CHUNK = 256
_random = np.random.default_rng(20240229)
#: Multipliers (odd) and summands of the orders.
TIMES = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
PLUS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles; fewer words are one shingle, none are none."""
    words = (text or "").encode().lower().split()
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) > shingle else [b" ".join(words)] if words else []
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, 42) for g in grams), np.uint64))


def jaccard(a: bytes, b: bytes) -> float:
    """The similarity of two sets of sorted hashes; two empty ones are alike."""
    common = len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
    return common / ((len(a) + len(b)) // 8 - common) if a or b else 1.0


def band_keys(hashes: np.ndarray) -> list[int]:
    """The key of each band of a set of hashes, none of an empty one."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        z = hashes[at : at + CHUNK, None] * TIMES
        z += PLUS
        np.minimum(least, z.min(0), out=least)
    digest = xxhash.xxh64_intdigest
    keys = [digest(x.tobytes(), band) for band, x in enumerate(least.reshape(BANDS, ROWS))]
    return [k - (1 << 64) if k >> 63 else k for k in keys]


def _marked(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, n, k, print, keys): a row for each distinct set of shingles with its SimHash, k the first of its documents; a table in the shared folder."""

    @F.pandas_udf("whole binary, n int, print long, keys array<long>")
    def told(text: pd.Series) -> pd.DataFrame:
        out = []
        for t in text:
            h = shingle_hashes(t, shingle)
            out.append((xxhash.xxh128_digest(h.tobytes()), len(h), print_of(h), band_keys(h)))
        return pd.DataFrame(out, columns=["whole", "n", "print", "keys"])

    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("doc_id", "text").alias("text_hash"))
    rows = docs.select(key.alias("k"), told("text").alias("p")).select("k", "p.*")
    made = rows.groupBy("whole", "n").agg(F.min(F.struct("k", "print", "keys")).alias("m"))  # equal sets have equal keys
    return written(made.select(F.monotonically_increasing_id().alias("node"), "n", "m.k", "m.print", "m.keys"))


def _print_pairs(nodes: DataFrame, least: float) -> DataFrame:
    """(src, dst): candidates by fingerprint. Of equal ones each node with the first, and the first of each with that of those within two bits to which it is linked."""
    first = written(nodes.groupBy("print").agg(F.min(F.struct("node", "n")).alias("f")))
    equal = nodes.join(first, "print").select("f.node", "f.n", F.col("node").alias("node_b"), F.col("n").alias("n_b"))
    linked = print_links(first.select(F.col("print").alias("_dn_fp")))
    a, b = (first.select(F.col("print").alias(c), F.col("f").alias(f"f_{c}")) for c in ("src", "dst"))
    close = linked.join(a, "src").join(b, "dst").select("f_src.node", "f_src.n", F.col("f_dst.node").alias("node_b"), F.col("f_dst.n").alias("n_b"))
    met = equal.unionByName(close).where("node <> node_b").where(_long_enough(F.col("n"), F.col("n_b"), least))
    return met.select(F.least("node", "node_b").alias("src"), F.greatest("node", "node_b").alias("dst")).distinct()


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes): the sorted hashes of the shingles of the texts of ``wanted`` (node), which are read again."""

    @F.pandas_udf("binary")
    def hashes(text: pd.Series) -> pd.Series:
        return pd.Series([shingle_hashes(t, shingle).tobytes() for t in text], dtype="object")

    ids = settle(nodes.join(wanted, "node", "left_semi").select("node", F.col("k.doc_id").alias("_dn_id2"), F.col("k.text_hash").alias("_dn_hash2")))
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_dn_hash"))
    met = keyed.join(ids, (keyed["_dn_hash"] == ids["_dn_hash2"]) & keyed["doc_id"].eqNullSafe(ids["_dn_id2"])).dropDuplicates(["node"])
    return written(met.select("node", hashes("text").alias("hashes")))


def _long_enough(a: Column, b: Column, least: float) -> Column:
    """Sets that differ more in size cannot be as similar."""
    return F.least(a, b) >= F.lit(least) * F.greatest(a, b)


def _pairs(reps: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """(src, dst): each of ``reps`` (h, node, n, root) with the ``members`` of its bucket that lie in other groups."""
    a, b = (x.select("h", F.col("node").alias(f"node_{c}"), F.col("n").alias(f"n_{c}"), F.col("root").alias(f"root_{c}")) for x, c in ((reps, "a"), (members, "b")))
    met = a.join(b, "h").where("root_a <> root_b").where(_long_enough(F.col("n_a"), F.col("n_b"), least))
    return met.select(F.least("node_a", "node_b").alias("src"), F.greatest("node_a", "node_b").alias("dst")).distinct()


def _dealt(pairs: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """(square, src, dst, hashes): each of ``pairs`` (src, dst) in the square of its nodes' parts, and each set that a pair there asks for once, as src without dst."""
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts))
    squares = pairs.select((part("src") * parts + part("dst")).alias("square"), "src", "dst")
    asked = squares.select("square", F.explode(F.array("src", "dst")).alias("node")).distinct()
    known = asked.join(sets, "node").select("square", F.col("node").alias("src"), F.lit(None).cast("long").alias("dst"), "hashes")
    return known.unionByName(squares.withColumn("hashes", F.lit(None).cast("binary")))


def _verified(pairs: DataFrame, sets: DataFrame, least: float, parts: int) -> DataFrame:
    """The ``pairs`` (src, dst) of a similarity of ``least`` or more, by their shingles."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        for batch in batches:
            found = []
            for square, src, dst, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if square != now:
                    now, known = square, {}
                if dst is None:
                    known[src] = hashes
                elif jaccard(known[src], known[dst]) >= least:
                    found.append((src, dst))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["src", "dst"])

    return _dealt(pairs, sets, parts).repartition("square").sortWithinPartitions("square", F.col("dst").asc_nulls_first()).mapInArrow(each, "src long, dst long")


def _drawn(members: DataFrame, turn: int) -> DataFrame:
    """Of each bucket of ``members`` (h, node, n, root, size) the rows to compare with all others of it in this turn, from 0 on."""
    draw = F.struct(F.xxhash64("node").alias("by"), "node", "n", "root")
    if turn == 0:
        return members.groupBy("h").agg(F.min(draw).alias("d")).select("h", "d.node", "d.n", "d.root")
    if turn == 1:
        return members.where(F.col("size") <= SMALL).select("h", "node", "n", "root")
    groups = settle(members.groupBy("h", "root").agg(F.count(F.lit(1)).alias("n")))
    most = settle(groups.groupBy("h").agg(F.max(F.struct("n", "root")).alias("m")).select("h", F.col("m.root").alias("most")))
    outside = members.join(most, "h").where("root <> most AND NOT done")
    slot = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(DRAWN * 8 ** (turn - 2)))
    return outside.groupBy("h", slot.alias("slot")).agg(F.min(draw).alias("d")).select("h", "d.node", "d.n", "d.root")


def similar_groups(docs: DataFrame, nodes: DataFrame, least: float, shingle: int) -> DataFrame | None:
    """(node, component) of the ``nodes`` that links of a similarity of ``least`` or more connect with others; None if there are no links."""
    rows = written(nodes.select("node", "n", F.explode("keys").alias("h")))
    sizes = settle(rows.groupBy("h").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))  # kept, so that a full bucket's rows can be split in the join
    shared = written(rows.join(sizes, "h"))
    close = written(_print_pairs(nodes, least))
    wanted = shared.select("node").unionByName(close.select(F.explode(F.array("src", "dst")).alias("node"))).distinct()
    sets = _sets(docs, nodes, wanted, shingle)
    parts = max(PARTS, -(-(sets.agg(F.sum(F.length("hashes"))).first()[0] or 0) // PART))
    spark, found, done, turn = docs.sparkSession, None, None, 0
    links = written(_verified(close, sets, least, parts))
    if not links.isEmpty():
        found = written(connected_components(links))
    while True:
        members = shared.withColumn("root", F.col("node")) if found is None else shared.join(found, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
        open_ = settle(members.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("h"))
        members = members.join(open_, "h")
        if turn > 1:
            members = members.where(F.col("size") > SMALL)
            members = members.join(done.withColumn("done", F.lit(True)), ["h", "node"], "left").fillna(False, ["done"]) if done is not None else members.withColumn("done", F.lit(False))
        members = written(members, path := fresh_path(spark))
        reps = written(_drawn(members, turn))
        if turn > 1:
            if reps.isEmpty():
                break
            done = reps.select("h", "node") if done is None else done.unionByName(reps.select("h", "node"))
        fresh = written(_verified(written(_pairs(reps, members, least)), sets, least, parts))
        remove(spark, path)
        if not fresh.isEmpty():
            # the groups so far are stars already, so a turn's rounds are those of its own links
            links = fresh if found is None else fresh.unionByName(found.where("node <> component").select(F.col("node").alias("src"), F.col("component").alias("dst")))
            found = written(connected_components(links))
        turn += 1
    return found


def dedup_similar(docs: DataFrame, least: float = 0.8, shingle: int = 5) -> DataFrame:
    """One document, whole, of each group that links of a similarity of ``least`` or more connect: the one with the smallest doc_id, and of several
    such the one with the smallest hash.

    Similarity is Jaccard's, over distinct shingles of ``shingle`` words. Texts without words are alike. Equal sets of shingles are one before anything is compared.
    Null doc_ids come last; equal rows are one. Extra columns pass through. An empty table gives an empty result.
    """
    nodes = _marked(docs, shingle)
    found = similar_groups(docs, nodes, least, shingle)
    rooted = nodes.select(F.col("node").alias("root"), "k") if found is None else nodes.select("node", "k").join(found, "node", "left").select(F.coalesce("component", "node").alias("root"), "k")
    kept = rooted.groupBy("root").agg(F.min("k").alias("k")).select(F.col("k.doc_id").alias("_dn_id2"), F.col("k.text_hash").alias("_dn_hash2"))
    keyed = docs.withColumn("_dn_hash", F.xxhash64("doc_id", "text"))
    met = keyed.join(kept, (keyed["_dn_hash"] == kept["_dn_hash2"]) & keyed["doc_id"].eqNullSafe(kept["_dn_id2"]), "left_semi")
    return met.dropDuplicates(["doc_id", "_dn_hash"]).drop("_dn_hash")
