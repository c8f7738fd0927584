"""SimHash near-duplicates (operator 7): fingerprints, pigeonhole blocks, Hamming check, components.

``label`` and ``dedup`` link fingerprints of 64 bits that differ in at most two. The pipeline's stage takes such links as its first candidates and goes on to texts of
a similarity at which ten or more of 64 bits differ: see ``similar``.

Defined cases: a null or empty text, or one of white space only, has fingerprint zero, and zero links like any
other. Rows with equal doc_id and text get the same result. A null doc_id is never a representative; a component
of only such rows has a null component_id. Extra columns pass through ``label``; the columns fingerprint and component_id are
replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftnet.operators.graph import connected_components
from driftnet.storage import settle

#: Where the 64 bits are cut: two differing bits leave at least two of four blocks alike.
BLOCKS = ((0, 16), (16, 16), (32, 16), (48, 16))
#: Distinct fingerprints up to which a block's pairs are compared one by one; beyond, their one-bit neighbours are joined.
PAIRWISE = 32


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash as a signed 64-bit integer."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z, and only ASCII white space
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return print_of(np.fromiter((digest(g, 42) for g in grams), np.uint64))


def print_of(h: np.ndarray) -> int:
    """The SimHash of unsigned 64-bit hashes: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, shingle: int = 3) -> DataFrame:
    @F.pandas_udf("long")
    def fp(text: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in text], dtype="int64")

    return docs.withColumn("_dn_fp", fp("text"))


def _block(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def links(prints: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """(src, dst): links between distinct fingerprints ``_dn_fp`` such that all within two bits are connected.

    Each fingerprint is keyed by every two of its four blocks. A key with few fingerprints gets a join and a
    Hamming check. A key with more, say of a group of thousands of near copies, would give pairs without end: there each
    fingerprint is dealt under itself and each one-bit neighbour outside the two blocks. Two fingerprints are within two
    bits exactly if they meet under such a neighbour, and a link from each to the smallest there keeps them connected.
    """
    keyed = reduce(
        DataFrame.unionByName,
        [
            prints.select("_dn_fp", F.lit(n).alias("pair"), (_block(F.col("_dn_fp"), *a) * F.lit(1 << 16) + _block(F.col("_dn_fp"), *b)).alias("bucket"))
            for n, (a, b) in enumerate(combinations(BLOCKS, 2))
        ],
    )
    sizes = settle(keyed.groupBy("pair", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))  # kept, so that a full bucket's rows can be split in the join
    shared = settle(keyed.join(sizes, ["pair", "bucket"]))
    few, many = shared.where(F.col("n") <= pairwise), shared.where(F.col("n") > pairwise)
    near = F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= 2
    other = few.select("pair", "bucket", F.col("_dn_fp").alias("dst"))
    close = few.select("pair", "bucket", F.col("_dn_fp").alias("src")).join(other, ["pair", "bucket"]).where("src < dst").where(near).select("src", "dst")
    pairs = list(combinations(range(4), 2))
    outside = F.element_at(F.array(*[F.array(*[F.lit(b) for k in range(4) if k not in p for b in range(BLOCKS[k][0], sum(BLOCKS[k]))]) for p in pairs]), F.col("pair") + 1)
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(outside, lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    dealt = many.select("_dn_fp", "pair", F.explode(flips).alias("flip")).select("_dn_fp", "pair", F.col("_dn_fp").bitwiseXOR(F.col("flip")).alias("meet"))
    least = dealt.groupBy("pair", "meet").agg(F.min("_dn_fp").alias("src"), F.max("_dn_fp").alias("most")).where("src <> most").select("pair", "meet", "src")
    star = dealt.join(least, ["pair", "meet"]).select("src", F.col("_dn_fp").alias("dst")).where("src <> dst").where(near)
    return close.unionByName(star).distinct()


def label(docs: DataFrame, shingle: int = 3, pairwise: int = PAIRWISE) -> DataFrame:
    """doc_id, text_hash (of doc_id and text), fingerprint (16 hex digits) and component_id, a row for each of ``docs``.

    component_id is the smallest doc_id reachable by links of two or fewer bits. Texts are read once for the
    fingerprints, which are kept with their doc_id in the shared folder; copies fold into one fingerprint before anything
    is compared.
    """
    printed = settle(with_fingerprint(docs.select("doc_id", "text"), shingle).select("doc_id", F.xxhash64("doc_id", "text").alias("text_hash"), "_dn_fp"))
    groups = printed.groupBy("_dn_fp").agg(F.min("doc_id").alias("_dn_least"))
    found = connected_components(links(groups.select("_dn_fp"), pairwise)).select(F.col("node").alias("_dn_fp"), F.col("component").alias("_dn_root"))
    rooted = settle(groups.join(found, "_dn_fp", "left").withColumn("_dn_root", F.coalesce("_dn_root", "_dn_fp")))
    least = rooted.groupBy("_dn_root").agg(F.min("_dn_least").alias("component_id"))
    by_print = rooted.join(settle(least), "_dn_root").select("_dn_fp", "component_id")
    return printed.join(by_print, "_dn_fp").select("doc_id", "text_hash", F.lower(F.lpad(F.hex("_dn_fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, shingle: int = 3, pairwise: int = PAIRWISE) -> DataFrame:
    """One document of each component, whole: the one with the smallest doc_id, and of several such the one with the smallest hash.

    Documents that have no doc_id and belong to no component that has one are one component.
    """
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    kept = label(docs, shingle, pairwise).groupBy("component_id").agg(F.min(rank).alias("k")).select(F.col("k.doc_id").alias("_dn_id2"), F.col("k.text_hash").alias("_dn_hash2"))
    return _only(docs, kept)


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``kept`` (_dn_id2, _dn_hash2) names, one of each."""
    keyed = docs.withColumn("_dn_hash", F.xxhash64("doc_id", "text"))
    met = keyed.join(kept, (keyed["_dn_hash"] == kept["_dn_hash2"]) & keyed["doc_id"].eqNullSafe(kept["_dn_id2"]), "left_semi")
    return met.dropDuplicates(["doc_id", "_dn_hash"]).drop("_dn_hash")
