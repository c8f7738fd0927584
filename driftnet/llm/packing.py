"""Packing of documents into sequences by a grouping genetic algorithm on islands (operator 5).

Texts are read once and become pieces of at most a sequence's length; only the pieces' sizes and checksums go on.
Full pieces fill a sequence each. The others are dealt by hash into pools of about ``POOL``; several islands
evolve packings of each pool from different seeds, the best packing of every island migrates to the next one, and after the
last epoch the best of a pool's islands counts. Crossover injects whole well-filled bins of one packing
into another, drops the bins that share documents with them, and best-fits the displaced documents. The bins that have room left,
and a tenth of the full ones, are pooled again, across pools, and packed the same way, until one pool is left or a round saves
no bin. A last pool goes on until ``PATIENCE`` epochs have saved none.

Defined cases: a null or empty text is the end token alone. Rows with equal doc_id are separate documents. Extra columns are
ignored. An empty table gives an empty result. Very long texts are cut; nothing is dropped.
"""

from __future__ import annotations

import json
import math
import random
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftnet.storage import settle

LENGTH = 2048
#: Documents packed together on an island; islands of a pool; epochs between migrations; generations in an epoch.
POOL, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 8192, 2, 2, 16, 4
#: Of so many full bins one is pooled again with those that have room, so that its documents may fill them; epochs without gain that end a last pool.
AGAIN, PATIENCE = 10, 2

# Token ids


#: Texts are read in parts of about so many characters, cut where the vocabulary's pattern always cuts: before a space after a letter or digit.
PART = 1 << 18
CUT = re.compile("(?<=[A-Za-z0-9]) ")
#: A run of so many blanks, or of other characters, goes to the file's own library: the fast reader's pattern engine keeps a state for each of them.
RUN = re.compile(r"(?<!\s)\s{4096}|(?<!\S)\S{4096}")


@lru_cache(maxsize=2)
def _encoders(path: str | None):
    """Both readers of the same vocabulary file: a fast one, which is used for texts of Latin-1 characters, the file's own library, and the
    added tokens, which only the latter knows."""
    import tiktoken
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    vocab = told["model"]["vocab"]
    special = frozenset(x["content"] for x in told["added_tokens"])
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), own, special


def _parts(text: str) -> Iterator[str]:
    """The text in parts of at least PART characters that are read alone as they are read together."""
    start = 0
    while len(text) - start > PART and (found := CUT.search(text, start + PART)):
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def token_ids(text: str | None, path: str | None = None) -> np.ndarray:
    """The ids of a whole text, then id 0, as little-endian unsigned 32-bit integers."""
    if not text:
        return np.zeros(1, "<u4")
    fast, own, special = _encoders(path)
    ids = []
    for part in _parts(text):
        if any(x in part for x in special) or RUN.search(part):
            ids.append(np.array(own.encode(part, add_special_tokens=False).ids, "<u4"))
            continue
        try:
            part.encode("latin-1")
        except UnicodeEncodeError:
            ids.append(np.array(own.encode(part, add_special_tokens=False).ids, "<u4"))
        else:
            ids.append(np.array(fast.encode_ordinary(part), "<u4"))
    return np.concatenate([*ids, np.zeros(1, "<u4")])


def cuts(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: all but the first are full."""
    first = n % length or min(n, length)
    return [(0, first), *((s, length) for s in range(first, n, length))]


def pieces(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32): the pieces of each document, uid by task and place."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows, out = batch.slice(at, 256), [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = token_ids(text, tokenizer)
                    for k, (s, m) in enumerate(cuts(len(ids), length)):
                        rows.append(i)
                        out.append((uid, k, s, m, zlib.crc32(ids[s : s + m].tobytes())))
                        uid += 1
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), part.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                    names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(each, f"uid long, doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# The genetic algorithm


def best_fit(sizes: list[int], items: list[int], bins: list[list[int]], room: list[int], length: int) -> None:
    """Put each of ``items``, in order, into the bin of least sufficient room, or a new one; ``bins`` and ``room`` are changed."""
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, r in enumerate(room):
        by_room.setdefault(r, []).append(b)
        mask |= 1 << r
    for i in items:
        s = sizes[i]
        fits = mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                mask ^= 1 << r
            bins[b].append(i)
        else:
            r, b = length, len(bins)
            bins.append([i])
            room.append(length)
        room[b] = left = r - s
        by_room.setdefault(left, []).append(b)
        mask |= 1 << left


def cost(bins: list[list[int]], room: list[int]) -> tuple[int, int]:
    """Fewer bins are better; of as many, those whose room lies together."""
    return len(bins), -sum(r * r for r in room)


def crossover(sizes, a, b, length, rng, share: float = 0.5):
    """Packing ``a`` with well-filled bins of ``b``: bins that share documents go, their other documents are best-fitted."""
    bins_b, room_b = b
    limit = sorted(room_b)[len(room_b) // 2]
    injected = [x for x, r in zip(bins_b, room_b, strict=True) if r <= limit and rng.random() < share]
    taken = {i for x in injected for i in x}
    bins, room, displaced = [list(x) for x in injected], [length - sum(sizes[i] for i in x) for x in injected], []
    for x, r in zip(*a, strict=True):
        if taken.isdisjoint(x):
            bins.append(list(x))
            room.append(r)
        else:
            displaced += [i for i in x if i not in taken]
    displaced.sort(key=lambda i: -sizes[i])
    best_fit(sizes, displaced, bins, room, length)
    return bins, room


def mutate(sizes, a, length, rng, share: float = 0.1):
    """The emptiest bins and some others are dissolved and their documents best-fitted in a shaken order."""
    order = sorted(range(len(a[0])), key=lambda b: -a[1][b])
    n = max(2, int(share * len(order)))
    gone = {*order[:n], *rng.sample(range(len(order)), min(n, len(order)))}
    bins = [list(x) for b, x in enumerate(a[0]) if b not in gone]
    room = [r for b, r in enumerate(a[1]) if b not in gone]
    loose = [i for b in gone for i in a[0][b]]
    loose = fill_better(sizes, bins, room, loose, rng)
    loose.sort(key=lambda i: -sizes[i] * rng.uniform(0.9, 1.0))
    best_fit(sizes, loose, bins, room, length)
    return bins, room


def fill_better(sizes, bins, room, loose, rng, tries: int = 400, some_of: int = 8) -> list[int]:
    """Exchange one or two documents of a bin for a larger loose one that fills it better; returns what is loose now.

    A mutation tries ``tries`` bins, and ``some_of`` documents of each, drawn at random: these bound a generation's effort, and lose nothing.
    """
    free = sorted((sizes[i], i) for i in loose)
    open_bins = [b for b, r in enumerate(room) if r]
    for b in rng.sample(open_bins, min(tries, len(open_bins))):
        x = bins[b]
        some = x if len(x) <= some_of else rng.sample(x, some_of)
        for out in (*combinations(some, 2), *((i,) for i in some)):
            low = sum(sizes[i] for i in out)
            at = bisect_right(free, (low + room[b], math.inf)) - 1
            if at >= 0 and free[at][0] > low:
                size, new = free.pop(at)
                bins[b] = [i for i in x if i not in out] + [new]
                room[b] -= size - low
                for i in out:
                    insort(free, (sizes[i], i))
                break
    return [i for _, i in free]


def evolve(sizes: list[int], packings: list[list[int]], seed: int, length: int = LENGTH, generations: int = GENERATIONS) -> list[int]:
    """The best packing found (a bin for each document), from those given and fresh ones."""
    rng = random.Random(seed)
    least = -(-sum(sizes) // length)
    people = []
    for place in packings:
        bins: dict[int, list[int]] = {}
        for i, b in enumerate(place):
            bins.setdefault(b, []).append(i)
        made = list(bins.values())
        people.append((made, [length - sum(sizes[i] for i in x) for x in made]))
    while len(people) < POPULATION:
        shake = 0 if not people else 0.15 * len(people)
        order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 - shake * rng.random()))
        made, room = [], []
        best_fit(sizes, order, made, room, length)
        people.append((made, room))
    people.sort(key=lambda p: cost(*p))
    for _ in range(generations):
        if len(people[0][0]) == least:
            break
        a, b = people[0], people[1 + rng.randrange(len(people) - 1)]
        children = [crossover(sizes, a, b, length, rng), mutate(sizes, crossover(sizes, b, a, length, rng), length, rng)]
        people = sorted([*people, *children], key=lambda p: cost(*p))[:POPULATION]
    out = [0] * len(sizes)
    for b, x in enumerate(people[0][0]):
        for i in x:
            out[i] = b
    return out


def _epoch(length: int, generations: int, number: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["origin", "uid"])
        pool, island = int(rows["pool"].iloc[0]), int(rows["island"].iloc[0])
        given = [g for _, g in rows.groupby("origin", sort=True)]
        base = given[0]
        packings = [g["bin"].tolist() for g in given] if base["bin"].iloc[0] >= 0 else []
        found = evolve(base["length"].tolist(), packings, hash((pool, island, number)), length, generations)
        return pd.DataFrame({"pool": pool, "island": island, "uid": base["uid"].to_numpy(), "length": base["length"].to_numpy(), "bin": found})

    return run


def _pack_round(parts: DataFrame, seed: int, length: int, generations: int) -> tuple[DataFrame, int, int]:
    """(uid, length, pool, bin), the number of pools and that of bins, for parts (uid, length)."""
    n, size = parts.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    pools = max(1, math.ceil(n / POOL))
    kind = "pool long, island int, uid long, length long, bin int"
    dealt = parts.select(F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(pools)).alias("pool"), F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), "uid", "length", F.lit(-1).alias("bin"))
    dealt = dealt.withColumn("origin", F.col("island"))
    least, epoch, idle = None, 0, 0
    while True:
        elite = settle(dealt.groupBy("pool", "island").applyInPandas(_epoch(length, generations, epoch), kind))
        used = elite.groupBy("pool", "island").agg(F.max("bin").alias("bins"))
        best = used.groupBy("pool").agg(F.min(F.struct("bins", "island")).alias("k"))
        bins = best.agg(F.coalesce(F.sum(F.col("k.bins") + 1), F.lit(0))).first()[0]
        least, idle, epoch = (bins, 0, epoch + 1) if least is None or bins < least else (least, idle + 1, epoch + 1)
        if bins == -(-size // length) or (epoch >= EPOCHS and (pools > 1 or idle >= PATIENCE)):
            break
        # the elite of each island stays and goes to the next
        dealt = elite.select("pool", F.explode(F.array("island", (F.col("island") + 1) % ISLANDS)).alias("island"), "uid", "length", "bin", F.col("island").alias("origin"))
    best = best.select("pool", F.col("k.island").alias("island"))
    return elite.join(best, ["pool", "island"]).select("uid", "length", "pool", "bin"), pools, bins


def pack(parts: DataFrame, length: int = LENGTH, generations: int = GENERATIONS) -> DataFrame:
    """(uid, sequence_id) for pieces (uid, length): as few sequences as found, none over ``length``.

    A sequence's id is the smallest uid in it.
    """
    full = parts.where(F.col("length") == length).select("uid", F.col("uid").alias("sequence_id"))
    left, before, kept = parts.where(F.col("length") < length).select("uid", "length"), None, []
    while True:
        found, pools, bins = _pack_round(left, len(kept) + 1, length, generations)
        placed = found.select("uid", "length", F.lit(len(kept)).alias("round"), "pool", "bin")
        last = pools == 1 or before is not None and bins >= before
        if not last:
            open_ = placed.groupBy("pool", "bin").agg((F.sum("length") < length).alias("open"))
            again = F.col("open") | (F.pmod(F.xxhash64("pool", "bin"), F.lit(AGAIN)) == 0)
            placed = settle(placed.join(open_.select("pool", "bin", again.alias("again")), ["pool", "bin"]))
            left = placed.where("again").select("uid", "length")
            before = placed.where("again").select("pool", "bin").distinct().count()
            placed = placed.where("NOT again")
        kept.append(placed.select("uid", "round", "pool", "bin"))
        if last:
            break
    placed = reduce(DataFrame.unionByName, kept)
    placed = placed.select("uid", F.min("uid").over(Window.partitionBy("round", "pool", "bin")).alias("sequence_id"))
    return full.unionByName(placed)


def pack_documents(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, generations: int = GENERATIONS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of each document."""
    parts = settle(pieces(docs, length, tokenizer))
    placed = parts.join(pack(parts.select("uid", "length"), length, generations), "uid")
    before = Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
