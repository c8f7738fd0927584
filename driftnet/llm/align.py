"""Cross-tokenizer alignment (operator 13): which tokens of two vocabularies cover the same bytes of a text.

Tokenizer A reads a space and the text by byte-level pieces, tokenizer B reads the text by pieces of characters and adds the space itself. The tokens of B
make a static index of byte intervals, sorted by their ends; for each token of A two bisections give the first and the last token of B that it overlaps.
A gap between tokens of A that no token of B spans ends a group. Groups say how one tokenization maps onto the other; links are the pairs that overlap.

Texts are read once into a table with, for each document, its digest and its distinct pairs of ids with their multiplicity. Documents that hold a pair are counted from
that table; the counts come back to it in slices of bounded size, so no document's pairs are shuffled.

Defined cases: a null or empty text, and one whose tokens' bytes differ from a space and the text, has no tokens: zeros and an empty digest. Strings of special
tokens in a text are plain text. Repeated rows are documents of their own, also in the counts; a null doc_id is kept. Extra columns are ignored. An empty table gives an
empty result. Very long texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftnet.llm.packing import RUN, _parts
from driftnet.storage import written

#: Bytes of text aligned together; rows of the counted table sent to tasks at a time (24 bytes each).
TOGETHER, SLICE = 1 << 20, 1 << 21


@lru_cache(maxsize=2)
def _byte_level(path: str):
    """The readers of A's file, fast and own, and the bytes of each id."""
    import json

    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    special = {x["content"]: x["id"] for x in told["added_tokens"]}
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(byte[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in special}
    table = [b""] * (max([*ranks.values(), *special.values()]) + 1)
    for token, i in [*ranks.items(), *((k.encode(), i) for k, i in special.items())]:
        table[i] = token
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), own, table


@lru_cache(maxsize=2)
def _pieces(path: str):
    """The reader of B's file and the bytes of each id."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    told = ((own.id_to_piece(i), own.is_byte(i)) for i in range(own.get_piece_size()))
    return own, [bytes([int(piece[1:-1], 16)]) if byte else piece.replace("▁", " ").encode() for piece, byte in told]


class Pair:
    """Two vocabularies, by the paths of their files; None takes the public ones."""

    def __init__(self, a: str | None = None, b: str | None = None):
        import public_tokenizers

        self.paths = a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model")

    @property
    def tables(self) -> tuple[list[bytes], list[bytes]]:
        return _byte_level(self.paths[0])[2], _pieces(self.paths[1])[1]

    def a_ids(self, text: str) -> list[int]:
        """A's ids of a space and the text; the fast reader takes Latin-1 texts without very long runs."""
        fast, own, _ = _byte_level(self.paths[0])
        ids: list[int] = []
        for part in _parts(" " + text):
            plain = part.isascii() or (ord(max(part)) < 256)
            ids += own.encode(part, add_special_tokens=False).ids if RUN.search(part) or not plain else fast.encode_ordinary(part)
        return ids

    def ids(self, text: str | None) -> tuple[list[int], list[int]]:
        """A's and B's ids; none if either's bytes are not a space and the text."""
        if not text:
            return [], []
        a, b, whole = self.a_ids(text), _pieces(self.paths[1])[0].encode(text, num_threads=1), b" " + text.encode()
        if any(b"".join(map(table.__getitem__, ids)) != whole for table, ids in zip(self.tables, (a, b), strict=True)):
            return [], []
        return a, b


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last interval of B that each of A overlaps; both tile the same bytes, and are given by their ends."""
    first = np.searchsorted(ends_b, np.concatenate([[0], ends_a[:-1]]), "right")
    last = np.searchsorted(ends_b, ends_a, "left")
    return first, last


@lru_cache(maxsize=4)
def _shown(size: int, ends: str) -> np.ndarray:
    """Every id's digits with each of two marks after it: a row for each mark."""
    return np.array([[b"%d%c" % (i, ord(e)) for i in range(size)] for e in ends], dtype=object)


def aligned(told: list[tuple[list[int], list[int]]], pair: Pair) -> list[tuple]:
    """For each document's ids of A and B: n_a, n_b, n_groups, n_links, groups_sha256, its distinct pairs of ids (one number each) and their multiplicity.

    All documents are aligned at once, end to end: no token spans two of them.
    """
    sizes = [np.array([len(x[k]) for x in told]) for k in (0, 1)]
    a, b = (np.array([i for x in told for i in x[k]], np.int64) for k in (0, 1))
    widths = [np.fromiter(map(len, table), np.int64, len(table)) for table in pair.tables]
    ends_a, ends_b = np.cumsum(widths[0][a]), np.cumsum(widths[1][b])
    first, last = overlaps(ends_a, ends_b)
    stop = np.append(first[1:] > last[:-1], True)[: len(a)]  # no token of B spans the gap after this one of A
    group_a = np.cumsum(stop) - stop
    group_b = np.searchsorted(ends_a[stop], ends_b, "left")
    n = last - first + 1
    row = np.repeat(np.arange(len(a)), n)
    link = first[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
    doc_a = np.repeat(np.arange(len(told)), sizes[0])
    base = len(pair.tables[1])
    code = a[row] * base + b[link]
    order = np.lexsort((code, doc_a[row]))
    code, doc = code[order], doc_a[row][order]
    new = np.append(True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1]))[: len(code)]
    at = np.flatnonzero(new)
    many = np.diff(np.append(at, len(code)))
    pair_ends = np.cumsum(np.bincount(doc[at], minlength=len(told)))
    # ids in the order of the groups: each group's of A, then its of B
    in_a, in_b = np.bincount(group_a, minlength=int(stop.sum())), np.bincount(group_b, minlength=int(stop.sum()))
    put_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]
    put_b = np.arange(len(b)) + np.cumsum(in_a)[group_b]
    shown = np.empty(len(a) + len(b), dtype=object)
    last_b = np.append(group_b[1:] != group_b[:-1], True)[: len(b)]
    shown[put_a] = _shown(len(pair.tables[0]), ",|")[stop.astype(np.int8), a]
    shown[put_b] = _shown(base, ",;")[last_b.astype(np.int8), b]
    links = np.bincount(doc_a[row], minlength=len(told))
    groups = np.bincount(doc_a[stop], minlength=len(told))
    starts, out, p = np.cumsum(sizes[0] + sizes[1]), [], 0
    for i, (na, nb) in enumerate(zip(*sizes, strict=True)):
        digest = hashlib.sha256(b"".join(shown[starts[i] - na - nb : starts[i]].tolist())[:-1]).hexdigest() if na else ""
        out.append((int(na), int(nb), int(groups[i]), int(links[i]), digest, code[at[p : pair_ends[i]]], many[p : pair_ends[i]]))
        p = pair_ends[i]
    return out


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)]), kind))


FIELDS = ("n_a", "n_b", "n_groups", "n_links")


def alignment_table(docs: DataFrame, pair: Pair) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, many): a row for each of ``docs``, a table in the shared folder."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                end, total = at, 0
                while end < len(texts) and total < TOGETHER:
                    total += len(texts[end] or "") + 1
                    end += 1
                cols = list(zip(*aligned([pair.ids(t) for t in texts[at:end]], pair), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, end - at), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), _lists(cols[5], pa.int64()), _lists(cols[6], pa.int32())],
                    names=["doc_id", *FIELDS, "groups_sha256", "pairs", "many"],
                )
                at = end

    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, many array<int>"))


def pair_counts(table: DataFrame, base: int) -> DataFrame:
    """(pair, n, best): in how many documents of ``table`` each pair is linked, and whether no pair of the same id of A is in more."""
    counts = written(table.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    of_a = F.expr(f"pair div {base}")
    most = counts.groupBy(of_a.alias("a")).agg(F.max("n").alias("most"))
    return written(counts.withColumn("a", of_a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def align(docs: DataFrame, pair: Pair | None = None, rows: int = SLICE) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The counts go to the tasks in slices of about ``rows`` pairs, a pass over the table for each; a pass adds what its slice tells and leaves the rows where they are.
    """
    pair = pair or Pair()
    table = alignment_table(docs, pair).withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    counts = pair_counts(table, len(pair.tables[1]))
    slices = counts.count() // rows + 1
    for k in range(slices):
        part = counts.where(F.pmod(F.xxhash64("pair"), F.lit(slices)) == k).sort("pair").toArrow()
        sent = docs.sparkSession.sparkContext.broadcast(tuple(part[c].to_numpy() for c in ("pair", "n", "best")))

        def add(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known, n, best = sent.value
            for batch in batches:
                pairs, many = batch.column("pairs"), batch.column("many").flatten().to_numpy().astype(np.int64)
                code = pairs.flatten().to_numpy()
                doc = np.repeat(np.arange(batch.num_rows), pairs.value_lengths().to_numpy())
                at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
                hit = known[at] == code if len(known) else np.zeros(len(code), bool)
                at, doc, many = at[hit], doc[hit], many[hit]
                more = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
                np.add.at(more[0], doc, many * best[at])
                np.add.at(more[1], doc, many * n[at])
                cols = dict(zip(batch.schema.names, batch.columns, strict=True))
                cols |= {c: pa.array(cols[c].to_numpy() + x, pa.int64()) for c, x in zip(("n_best", "count_sum"), more, strict=True)}
                yield pa.RecordBatch.from_pydict(cols)

        table = table.mapInArrow(add, table.schema)
        if k < slices - 1:
            table = written(table)
    return table.drop("pairs", "many")
