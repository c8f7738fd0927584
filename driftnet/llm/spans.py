"""Repeated runs of sentences (operator 1) and repeated windows of lines (operator 4).

Both hash every run of consecutive pieces of every text, find over all texts which runs occur more than
once, and take out the pieces that a later occurrence covers. What is shuffled is one row of fixed width per
run, combined on the map side for the counts; the texts themselves are shuffled once, to meet their verdicts.

Defined cases, for both: a null or empty text has no pieces and stays as it is. Rows with equal doc_id and
equal text are one document given several times: they count once and get the same result. A null doc_id sorts
first. Occurrences are ordered by doc_id, then text hash, then position. Extra columns pass through; one that
bears the name of a result column is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftnet.llm.marks import marked, repeated
from driftnet.storage import fresh_path, remove, settle, written

#: A line with its line break and the blank space after it.
LINE = r"(?s).+?(?:\n[ \t\n\r\f]*|\z)"
#: The end of a sentence: closing marks and white space, or a line break. A run of marks is entered at its start only, so the search is linear;
#: the pattern begins with a set of characters, to which the engine skips.
SENTENCE_END = re.compile(r"[.!?\n](?:(?<=\n)\s*+|(?<![.!?][.!?])(?<!\n)[.!?]*+[\"')\]]*+\s++)")
WORD = re.compile(r"\S+\s*")
LONG = 16
#: One word in so many ends a part of a long sentence, by its hash.
ENDS = 2
KEY = ("_dn_id", "_dn_hash")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_dn_id": F.col("doc_id"), "_dn_hash": F.xxhash64("doc_id", "text")})


def later_occurrences(runs: DataFrame) -> DataFrame:
    """(_dn_id, _dn_hash, spans): the spans (pos, len) of each document's runs that occurred before.

    ``runs`` has (h, _dn_id, _dn_hash, pos, len). A frequent run is combined to a row per task before the
    shuffle. The repeated runs are kept in the shared folder, so both sides of the join are plain shuffles and adaptive execution can
    split the rows of a frequent run.
    """
    place = F.struct(*KEY, "pos")
    repeated = settle(runs.groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "first"))
    later = runs.join(repeated, "h").where(place != F.col("first"))
    return later.groupBy(*KEY).agg(F.collect_set(F.struct("pos", "len")).alias("_dn_spans"))


def _with_verdicts(docs: DataFrame, spans: DataFrame, *more: str) -> DataFrame:
    a, b = _keyed(docs), spans.select(F.col(KEY[0]).alias("_dn_id2"), F.col(KEY[1]).alias("_dn_hash2"), "_dn_spans", *more)
    return a.join(b, (a["_dn_hash"] == b["_dn_hash2"]) & a["_dn_id"].eqNullSafe(b["_dn_id2"]), "left").drop(*KEY, "_dn_id2", "_dn_hash2")


# Operator 4


def line_windows(docs: DataFrame, window: int = 3) -> DataFrame:
    """Every run of ``window`` consecutive lines, by the hash of the trimmed lines; blank lines belong to the line before."""
    lines = _keyed(docs.select("doc_id", "text")).select(*KEY, F.transform(F.regexp_extract_all("text", F.lit(LINE), 0), lambda x: F.btrim(x, F.lit(" \t\n\r\f"))).alias("lines"))
    starts = F.when(F.size("lines") >= window, F.sequence(F.lit(1), F.size("lines") - (window - 1)))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.element_at("lines", (i + j).cast("int")) for j in range(window)]))
    return lines.select(*KEY, F.posexplode(hashes).alias("pos", "h")).withColumn("len", F.lit(window))


def dedup_lines(docs: DataFrame, window: int = 3) -> DataFrame:
    """``docs`` with the lines taken out that a later occurrence of a repeated window covers.

    Adds n_lines and n_removed; text keeps its other lines byte for byte.
    """
    found = _with_verdicts(docs, later_occurrences(line_windows(docs, window)))
    pieces = found.withColumns(
        {
            "_dn_pieces": F.regexp_extract_all("text", F.lit(LINE), 0),
            "_dn_covered": F.array_distinct(F.flatten(F.transform("_dn_spans", lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1)))),
        }
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("_dn_pieces") - 1), "_dn_covered")
    return pieces.withColumns(
        {
            "n_lines": F.coalesce(F.size("_dn_pieces"), F.lit(0)).cast("long"),
            "n_removed": F.coalesce(F.size("_dn_covered"), F.lit(0)).cast("long"),
            "text": F.when(F.col("_dn_covered").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at("_dn_pieces", i + 1)), "")),
        }
    ).drop("_dn_pieces", "_dn_covered", "_dn_spans")


# Operator 1


class _Hashes(dict):
    """The hash of each word, kept for so many words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        h = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) * 2654435761 >> 7 & 0xFFFFFFFF
        return h


HASHES = _Hashes()


def _cuts(bare: list[str]) -> list[int]:
    """Where the parts of a long sentence of these words end: after the words whose hash ENDS divides, wherever a passage stands; of 16 words
    without one, after the last of least hash. A part has two words at least, but for the last."""
    hashes = [HASHES[x] for x in bare]
    out, start, n = [], 0, len(bare)
    for cut in [*[i for i, h in enumerate(hashes) if not h % ENDS], n - 1]:
        while cut - start >= LONG:
            start = min(range(start + LONG - 1, start, -1), key=hashes.__getitem__) + 1
            out.append(start)
        if cut > start or cut == n - 1 == start:
            start = cut + 1
            out.append(start)
    return out


def _sentences(text: str) -> Iterator[str]:
    start = 0
    for end in SENTENCE_END.finditer(text):
        yield text[start : end.end()]
        start = end.end()
    if start < len(text):
        yield text[start:]


def sentences(text: str) -> list[str]:
    """The text cut into sentences, nothing lost; a sentence of over ``LONG`` words is cut into parts."""
    out = []
    for piece in _sentences(text):
        bare = piece.split() if len(piece) > 2 * LONG else ()
        if len(bare) <= LONG:
            out.append(piece)
            continue
        words = WORD.findall(piece)
        words[0] = piece[: len(piece) - len(piece.lstrip())] + words[0]
        start = 0
        for end in _cuts(bare):
            out.append("".join(words[start:end]))
            start = end
    return out


def bare_sentences(text: str) -> tuple[list[str], list[int]]:
    """The words of each of ``sentences``, with single spaces, and their number, 1 at least."""
    clean, counts = [], []
    for piece in _sentences(text):
        bare = piece.split()
        if len(bare) <= LONG:
            clean.append(" ".join(bare))
            counts.append(len(bare) or 1)
            continue
        start = 0
        for end in _cuts(bare):
            clean.append(" ".join(bare[start:end]))
            counts.append(end - start)
            start = end
    return clean, counts


def sentence_runs(text: str, run: int = 3, words: int = 10) -> list[tuple[int, int, int]]:
    """(hash, position, length) of the run that begins at each sentence: ``run`` sentences, or as many more as make ``words`` words.

    Where a text ends before it has so many words, the run goes to its end, and compares only with others that do; a text of fewer than ``run`` sentences is one such run. So texts
    and endings of any length are compared whole.
    """
    return _runs(*bare_sentences(text), run, words)


def _runs(clean: list[str], counts: list[int], run: int, words: int) -> list[tuple[int, int, int]]:
    digest = xxhash.xxh64_digest
    digests = b"".join([digest(x) for x in clean])
    out, end, total, n = [], 0, 0, len(clean)
    for start in range(n):
        while end < n and (end - start < run or total < words):
            total += counts[end]
            end += 1
        if end - start < run and start:
            break
        at_end = end - start < run or total < words
        h = xxhash.xxh64_intdigest(digests[8 * start : 8 * end], 1 if at_end else 0)
        out.append((h - (1 << 64) if h >> 63 else h, start, end - start))
        total -= counts[start]
    return out


def sentence_index(docs: DataFrame, run: int = 3, words: int = 10, path: str | None = None) -> DataFrame:
    """(_dn_id, _dn_hash, n, hs, lens): each text's number of sentences, and the hash and length of the run that begins at each sentence from the first
    on. A table in the shared folder (at ``path``, if given), for which the texts are read once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cut = [bare_sentences(t) if t else ([], []) for t in part.column(2).to_pylist()]
                found = [_runs(*x, run, words) for x in cut]
                lists = [pa.array([[y[k] for y in x] for x in found], pa.list_(kind)) for k, kind in ((0, pa.int64()), (2, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x[0]) for x in cut], pa.int64()), *lists], names=[*KEY, "n", "hs", "lens"])

    source = _keyed(docs.select("doc_id", "text")).select(*KEY, "text")
    return written(source.mapInArrow(each, f"_dn_id {docs.schema['doc_id'].dataType.simpleString()}, _dn_hash long, n long, hs array<long>, lens array<int>"), path)


def repeated_runs(index: DataFrame) -> DataFrame:
    """(h, _dn_id, _dn_hash, pos, len): the runs of ``sentence_index`` that may be repeated. Hashes alone are counted first; wide rows are made only
    of those counted twice, into a table, whose columns take a fraction of the rows' bytes."""
    marks = repeated(index.select(F.explode("hs").alias("h")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, hs, lens = (batch.column(k) for k in range(4))
            sizes = hs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            h = hs.flatten().to_numpy(zero_copy_only=False)
            kept = np.flatnonzero(marked(marks, h))
            row = np.repeat(np.arange(batch.num_rows), sizes)[kept]
            pos = kept - (np.cumsum(sizes) - sizes)[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[kept]), ids.take(pa.array(row)), hashes.take(pa.array(row)), pa.array(pos.astype(np.int32)), lens.flatten().take(pa.array(kept))],
                names=["h", *KEY, "pos", "len"],
            )

    kind = index.schema["_dn_id"].dataType.simpleString()
    return written(index.select(*KEY, "hs", "lens").mapInArrow(each, f"h long, _dn_id {kind}, _dn_hash long, pos int, len int"))


def dedup_substrings(docs: DataFrame, run: int = 3, words: int = 10) -> DataFrame:
    """``docs`` without the sentences that a later occurrence of a repeated run of sentences covers.

    A run is at least ``run`` consecutive sentences and ``words`` words, or the end of a text that has no more (see ``sentence_runs``); sentences compare by their words, so white space
    does not count. Adds n_sentences and n_removed. Texts are cut into sentences once, for ``sentence_index``, and those that lose some once more.
    """

    @F.pandas_udf("text string, n_removed long")
    def cleaned(text: pd.Series, pos: pd.Series, length: pd.Series) -> pd.DataFrame:
        out = []
        for t, ps, ls in zip(text, pos, length, strict=True):
            gone = set() if t is None else {i for p, n in zip(ps, ls, strict=True) for i in range(p, p + n)}
            out.append(("".join(x for i, x in enumerate(sentences(t)) if i not in gone) if gone else None, len(gone)))
        return pd.DataFrame(out, columns=["text", "n_removed"])

    spark = docs.sparkSession
    index = sentence_index(docs, run, words, path := fresh_path(spark))
    counts = written(index.groupBy(*KEY).agg(F.max("n").alias("n")))  # equal rows are one
    runs = repeated_runs(index)
    remove(spark, path)  # the hashes of all runs are its bulk, and only those of repeated ones are needed from here on
    later = later_occurrences(runs)
    verdicts = counts.withColumn("_dn_spans", F.lit(None).cast(later.schema["_dn_spans"].dataType)).unionByName(later.withColumn("n", F.lit(None).cast("long")))
    found = _with_verdicts(docs, verdicts.groupBy(*KEY).agg(F.max("n").alias("_dn_n"), F.first("_dn_spans", ignorenulls=True).alias("_dn_spans")), "_dn_n")
    # only texts that change go through Python
    done = found.withColumn("_dn_out", cleaned(F.when(F.col("_dn_spans").isNotNull(), F.col("text")), F.col("_dn_spans.pos"), F.col("_dn_spans.len")))
    return done.withColumns(
        {
            "text": F.when(F.col("_dn_spans").isNull(), F.col("text")).otherwise(F.col("_dn_out.text")),
            "n_sentences": F.col("_dn_n"),
            "n_removed": F.col("_dn_out.n_removed"),
        }
    ).drop("_dn_out", "_dn_spans", "_dn_n")
