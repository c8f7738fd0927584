"""Maximum inner product search by score-aware quantisation (operator 6).

Vectors are coded in subspaces of ``WIDTH`` dimensions, four bits each. The codebooks and the codes minimise an
anisotropic loss: the part of the residual that is parallel to the vector, which is what changes large inner products, counts
``eta`` times as much as the rest. A search scans the codes of a block of candidates with a table of the query's
products with each code (two codes to a byte, so a table of 256), keeps the ``REFINE`` best of the block, and reranks
those with exact products of the original vectors. The codebooks are fitted in one task on at most ``SAMPLE`` distinct vectors,
those of smallest hash; every vector is coded and scanned.

Equal vectors are one candidate that stands for its members; as many of the smallest ids are kept as one result can
hold, so a vector that a third of all rows share neither fills a block nor crowds others out. Candidates stay where they are: a pass
broadcasts at most ``QUERY_BYTES`` of queries, each task scans its candidates block by block and sends a query's best alone, which are
merged by rank. No vector and no code is shuffled after the candidates are coded.

Defined cases: vectors that are null, zero, or hold nulls or non-finite components take no part; nor do those whose number of
dimensions is not the most frequent one, or a null vec_id. Repeated rows are separate candidates with the same id, and only the
query's own id is left out; repeated queries count once, and queries of one id with different vectors are ranked apart. Extra columns are ignored. With fewer candidates than asked for, all are returned. An empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftnet.storage import fresh_path, settle

#: Dimensions of a subspace; codes in it; distinct vectors to fit on; rounds of the fit; threshold of the loss.
WIDTH, CODES, SAMPLE, ROUNDS, THRESHOLD = 2, 16, 20_000, 8, 0.2
#: Distinct candidates of a block, and of these as many as are reranked for a query.
BLOCK, REFINE = 8192, 128
#: Bytes of queries that a pass broadcasts, and of candidates that a task holds at least where the cluster's cores leave a choice.
QUERY_BYTES, TASK_BYTES = 16 << 20, 128 << 20
#: Queries whose tables are made at once; rows of a batch that a task sends.
CHUNK, ROWS = 64, 20_000


def eta(dims: int, threshold: float = THRESHOLD) -> float:
    """Weight of the parallel part of the residual, for products above ``threshold`` of the largest possible."""
    return max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))


def _split(x: np.ndarray) -> np.ndarray:
    """(n, subspaces, WIDTH), filled up with zeros."""
    short = -x.shape[1] % WIDTH
    return np.pad(x, ((0, 0), (0, short))).reshape(len(x), -1, WIDTH)


def encode(x: np.ndarray, books: np.ndarray, weight: float, rounds: int = 3) -> np.ndarray:
    """Codes (n, subspaces) by coordinate descent on the anisotropic loss."""
    if len(x) > 1024:
        return np.concatenate([encode(x[at : at + 1024], books, weight, rounds) for at in range(0, len(x), 1024)])
    parts = _split(x)
    unit = _split(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30))
    m = parts.shape[1]
    codes = np.zeros((len(x), m), np.uint8)
    rows = np.arange(len(x))
    left = parts[:, :, None, :] - books[None]  # residuals of every code
    plain = (left**2).sum(-1)
    along = (left * unit[:, :, None, :]).sum(-1)
    codes[:] = plain.argmin(-1)
    total = sum(along[rows, j, codes[:, j]] for j in range(m))
    for _ in range(rounds):
        before = codes.copy()
        for j in range(m):
            rest = total - along[rows, j, codes[:, j]]
            codes[:, j] = (plain[:, j] + (weight - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(-1)
            total = rest + along[rows, j, codes[:, j]]
        if (codes == before).all():
            break
    return codes


def fit(x: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (subspaces, CODES, WIDTH) for vectors x."""
    weight = eta(x.shape[1])
    parts = _split(x)
    unit = _split(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30))
    rng = np.random.default_rng(0)
    m = parts.shape[1]
    books = np.stack([parts[rng.choice(len(x), CODES, replace=len(x) < CODES), j] for j in range(m)])
    outer = unit[..., :, None] * unit[..., None, :]
    for _ in range(rounds):
        codes = encode(x, books, weight, 2)
        total = sum(((parts[:, j] - books[j, codes[:, j]]) * unit[:, j]).sum(-1) for j in range(m))
        for j in range(m):
            rest = total - ((parts[:, j] - books[j, codes[:, j]]) * unit[:, j]).sum(-1)
            right = parts[:, j] + (weight - 1) * unit[:, j] * (rest + (unit[:, j] * parts[:, j]).sum(-1))[:, None]
            for c in range(CODES):
                of = codes[:, j] == c
                if of.any():
                    left = np.eye(WIDTH) * (of.sum() + 1e-9) + (weight - 1) * outer[of, j].sum(0)
                    books[j, c] = np.linalg.solve(left, right[of].sum(0))
            total = rest + ((parts[:, j] - books[j, codes[:, j]]) * unit[:, j]).sum(-1)
    return books


def scan(queries: np.ndarray, packed: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Approximate products (queries, candidates) from packed codes (candidates, ceil(subspaces / 2))."""
    tables = np.einsum("qmd,mcd->qmc", _split(queries), books)
    if tables.shape[1] % 2:
        tables = np.pad(tables, ((0, 0), (0, 1), (0, 0)))
    pairs = (tables[:, 1::2, :, None] + tables[:, 0::2, None, :]).reshape(len(queries), -1, CODES * CODES).astype("float32")
    out = np.zeros((len(queries), len(packed)), "float32")
    columns = np.ascontiguousarray(packed.T)
    for q in range(len(queries)):
        for b, column in enumerate(columns):
            out[q] += pairs[q, b].take(column)
    return out


def pack(codes: np.ndarray) -> np.ndarray:
    """Two codes to a byte, the even subspace in the low half."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, 0::2] | codes[:, 1::2] << 4


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part, as doubles."""
    v = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    sound = v.where(F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)))
    sizes = sound.groupBy(F.size("v").alias("dims")).count()
    most = sizes.orderBy(F.desc("count"), "dims").first()
    return sound.where(F.size("v") == (most["dims"] if most else 0))


def index(vectors: DataFrame, keep: int, sample: int = SAMPLE) -> tuple[DataFrame, np.ndarray | None]:
    """((v, ids, code), codebooks): distinct vectors with up to ``keep`` smallest ids of their rows, coded, dealt evenly.

    The limit per vector is applied on the map side too, so a frequent vector sends few rows. It drops nothing that could be a result.
    """
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = vectors.withColumn("rank", rank).where(F.col("rank") <= keep)
    distinct = settle(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows.sort_values("h", kind="stable")["v"].to_numpy()).astype("float64")
        return pd.DataFrame({"books": [fit(x).tobytes()], "dims": [x.shape[1]]})

    chosen = distinct.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(sample)
    got = chosen.groupBy(F.lit(0).alias("one")).applyInPandas(one, "books binary, dims int").first()
    if got is None:
        return distinct.select("v", "ids", F.lit(None).cast("binary").alias("code")), None
    books = np.frombuffer(got["books"]).reshape(-1, CODES, WIDTH)
    weight = eta(got["dims"])

    @F.pandas_udf("binary")
    def coded(v: pd.Series) -> pd.Series:
        return pd.Series([c.tobytes() for c in pack(encode(np.stack(v.to_numpy()).astype("float64"), books, weight))])

    tasks = max(vectors.sparkSession.sparkContext.defaultParallelism, math.ceil(distinct.count() * got["dims"] * 8 / TASK_BYTES))
    return settle(distinct.repartition(tasks, "v").select("v", "ids", coded("v").alias("code"))), books


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
    """(vectors, ids of each, packed codes) of ``BLOCK`` candidates at a time, by their smallest ids."""

    def block(rows: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        v, ids, code = (rows.column(c).combine_chunks() for c in ("v", "ids", "code"))
        n = rows.num_rows
        ids = np.split(ids.flatten().to_numpy(zero_copy_only=False), np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))[:-1])
        order = np.argsort([x[0] for x in ids], kind="stable")
        packed = np.frombuffer(b"".join(code.to_pylist()), np.uint8).reshape(n, -1)
        return v.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)[order], [ids[i] for i in order], packed[order]

    held = None
    for batch in batches:
        more = pa.Table.from_batches([batch])
        held = more if held is None else pa.concat_tables([held, more])
        while held.num_rows >= BLOCK:
            yield block(held.slice(0, BLOCK))
            held = held.slice(BLOCK)
    if held is not None and held.num_rows:
        yield block(held)


def _nearest(asked: Broadcast, k: int, refine: int):
    """For the candidates of a task: (row, query_id, vec_id, score) of the k best for each query of ``asked`` (rows, query ids, vectors, codebooks)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, query_ids, x, books = asked.value
        best = np.full((len(x), k), -np.inf)
        who = np.full((len(x), k), np.iinfo(np.int64).max)
        for v, ids, packed in _blocks(batches):
            for at in range(0, len(x), CHUNK):
                for q, approx in enumerate(scan(x[at : at + CHUNK], packed, books), at):
                    top = np.sort(np.argpartition(-approx, refine)[:refine]) if len(approx) > refine else np.arange(len(approx))
                    exact = v[top] @ x[q]
                    near = np.argsort(-exact, kind="stable")[: k + 1]
                    if exact[near[0]] < best[q, -1]:
                        continue
                    members = [ids[i] for i in top[near]]
                    found, score = np.concatenate(members), np.repeat(exact[near], [len(m) for m in members])
                    other = found != query_ids[q]
                    found, score = np.concatenate([who[q], found[other]]), np.concatenate([best[q], score[other]])
                    order = np.lexsort((found, -score))[:k]
                    best[q], who[q] = score[order], found[order]
        for at in range(0, len(x), step := max(1, ROWS // k)):
            row, rank = np.nonzero(best[at : at + step] > -np.inf)
            columns = [rows[at + row], query_ids[at + row], who[at + row, rank], best[at + row, rank]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "query_id", "vec_id", "score"])

    return each


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, sample: int = SAMPLE, refine: int = REFINE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of ``queries`` (vec_id, v) the k of ``vectors`` (vec_id, v) of largest product.

    A query's own id is left out. Equal scores go by vec_id. What is shuffled are k rows for each query from each task.
    """
    spark, kind = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    coded, books = index(vectors, k + 1, sample)
    asked = settle(queries.select("vec_id", "v").distinct().withColumn("row", F.monotonically_increasing_id()))
    if books is None or (n := asked.count()) == 0:
        return spark.createDataFrame([], kind)
    passes = math.ceil(n * asked.select(F.size("v")).first()[0] * 8 / QUERY_BYTES)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    path = fresh_path(spark)
    for turn in range(passes):
        part = asked.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == turn).toArrow()
        if part.num_rows == 0:
            continue
        x = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
        given = spark.sparkContext.broadcast((part.column("row").to_numpy(), part.column("vec_id").to_numpy(), x, books))
        found = coded.mapInArrow(_nearest(given, k, refine), "row long, query_id long, vec_id long, score double")
        found = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        found.write.mode("append").parquet(path)  # kept, so that the queries can be let go
        given.destroy()
    return spark.read.schema(kind).parquet(path)
