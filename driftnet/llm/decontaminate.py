"""Benchmark decontamination by a positional inverted index (operator 8); DataFrame functions only.

The index is a table of postings (term, document, position), made in one pass over the texts and kept in the shared folder: any number of
benchmarks can be searched in it. A window of benchmark words is found by its terms' lists, from the rarest on: the list of the term that is
rarest in the whole corpus, moved by the term's offset in the window, gives the places where the window could begin; of these stay those that
the list of the second rarest term, moved by its own offset, has too; and those that all other lists have are the exact matches. Only the
first two kinds of lists are read for all documents, so what is shuffled are their short lists; frequent terms are looked up only
in documents where two rarer ones stand as they should. With ``slop`` the lists are intersected by nearness instead (``near``).

The report's index holds the postings of the benchmark's terms only. Terms and windows belong to the benchmark and do not grow with the corpus; they
are broadcast where their measured size is at most ``BROADCAST_BYTES`` and joined by shuffle beyond, after they were kept, so that the rows of a
frequent term can be split.

Defined cases: a null or empty text has no words, and no items. An item without words has no window. An item
whose item_id is null marks words as hit but is not counted or listed. Rows with equal doc_id and text get the same
result, once for each row. Extra columns are ignored by ``report``. Empty tables give an empty result, or clean documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftnet.storage import settle, written

#: Measured bytes up to which a table made from the benchmark, or of candidates, is broadcast.
BROADCAST_BYTES = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The term of a document's head row, which tells its number of words; no word is empty.
HEAD = ""
DOC = ("doc_id", "text_hash")


def words_of(text: str | Column) -> Column:
    """Words of a text: runs of digits, letters and characters beyond ASCII, A-Z made small."""
    whole = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    small = F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))
    return F.array_remove(F.split(small, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _small(df: DataFrame, *texts: str) -> bool:
    """Whether the kept table ``df``, with text columns ``texts``, is small enough to be broadcast: 64 bytes a row and those of its texts."""
    size = F.lit(64)
    for c in texts:
        size = size + F.octet_length(c)
    return (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES


def _bounded(df: DataFrame, *texts: str) -> DataFrame:
    return F.broadcast(df) if _small(df, *texts) else df


def index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The postings (doc_id, text_hash, n_words, pos, term) of ``docs``, kept as a table; of ``terms`` (term) only, if given.

    A document has a head row besides, of term ``HEAD``.
    """
    tokens = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("text_hash"), words_of("text").alias("w"))
    rows = tokens.select(*DOC, F.size("w").alias("n_words"), F.posexplode(F.concat(F.array(F.lit(HEAD)), "w")).alias("k", "term"))
    posts = rows.select(*DOC, "n_words", (F.col("k") - 1).alias("pos"), "term")
    if terms is not None:
        head = docs.sparkSession.range(1).select(F.lit(HEAD).alias("term"))
        posts = posts.join(_bounded(settle(terms.select("term").unionByName(head).distinct().coalesce(4)), "term"), "term").select(*posts.columns)
    return written(posts)


def windows(benchmark: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Each run of ``n`` words of an item, all words of an item that has fewer: (win, words), once each; and the items that have it: (win, item_id)."""
    items = benchmark.select("item_id", words_of("text").alias("w")).where(F.size("w") > 0)
    starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array(F.lit(1)))
    each = settle(items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, n))).alias("words")).distinct().coalesce(4))
    wins = settle(each.select("words").distinct().coalesce(4).select(F.monotonically_increasing_id().alias("win"), "words"))
    return wins, settle(each.where("item_id IS NOT NULL").join(wins, "words").select("win", "item_id").coalesce(4))


def ordered(posts: DataFrame, wins: DataFrame) -> DataFrame:
    """(win, len, terms): the terms of each window with their offsets, struct(n, term, off), from the rarest in ``posts``; windows with a term
    that never occurs are out."""
    counts = posts.where(F.col("term") != HEAD).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    terms = wins.select("win", F.posexplode("words").alias("off", "term")).join(counts, "term")
    lists = terms.groupBy("win").agg(F.array_sort(F.collect_list(F.struct("n", "term", "off"))).alias("terms"))
    whole = wins.join(lists, "win").where(F.size("words") == F.size("terms"))
    return settle(whole.select("win", F.size("words").alias("len"), "terms").coalesce(4))


def _listed(posts: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings of ``terms`` (term), kept."""
    return posts.join(_bounded(settle(terms.select("term").distinct().coalesce(4)), "term"), "term", "left_semi")


def _of_documents(posts: DataFrame, found: DataFrame) -> DataFrame:
    """The postings of the documents of ``found``."""
    ids = settle(found.select(F.col("doc_id").alias("_dn_id2"), F.col("text_hash").alias("_dn_hash2")).distinct())
    few = F.broadcast(ids) if _small(ids) else ids
    return posts.join(few, (posts["text_hash"] == few["_dn_hash2"]) & posts["doc_id"].eqNullSafe(few["_dn_id2"]), "left_semi")


def _standing(wanted: DataFrame, posts: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (doc_id, text_hash, term, pos, ...) whose term stands there."""
    p = posts.select(F.col("doc_id").alias("_dn_id2"), F.col("text_hash").alias("_dn_hash2"), F.col("term").alias("_dn_term2"), F.col("pos").alias("_dn_pos2"))
    here = (wanted["text_hash"] == p["_dn_hash2"]) & (wanted["pos"] == p["_dn_pos2"]) & (wanted["term"] == p["_dn_term2"]) & wanted["doc_id"].eqNullSafe(p["_dn_id2"])
    return wanted.join(p, here, "left_semi")


def _first(posts: DataFrame, wins: DataFrame) -> DataFrame:
    """The list of each window's rarest term: (doc_id, text_hash, n_words, win, pos, off, len)."""
    rarest = settle(wins.select("win", "len", F.col("terms")[0]["term"].alias("term"), F.col("terms")[0]["off"].alias("off")))
    return posts.join(_bounded(rarest, "term"), "term").select(*DOC, "n_words", "win", "pos", "off", "len")


def _by_window(found: DataFrame, wins: DataFrame, rank: int) -> DataFrame:
    """The rows of ``found`` (win, ...) that have a term of that rank, with term and off."""
    own = settle(wins.where(F.size("terms") > rank).select("win", F.col("terms")[rank]["term"].alias("term"), F.col("terms")[rank]["off"].alias("off")))
    return found.join(_bounded(own, "term"), "win")


def phrases(posts: DataFrame, wins: DataFrame) -> DataFrame:
    """(doc_id, text_hash, win, start, len): every place of ``posts`` where a window of ``wins`` (``ordered``) stands word for word."""
    begins = _first(posts, wins).withColumn("start", F.col("pos") - F.col("off")).where("start >= 0 AND start + len <= n_words")
    begins = settle(begins.select(*DOC, "win", "start", "len").distinct())
    second = _listed(posts, wins.where(F.size("terms") > 1).select(F.col("terms")[1]["term"].alias("term")))
    two = settle(_standing(_by_window(begins, wins, 1).withColumn("pos", F.col("start") + F.col("off")), second).select(*begins.columns))
    short = two.join(F.broadcast(one) if _small(one := settle(wins.where(F.size("terms") == 2).select("win"))) else one, "win", "left_semi")
    others = settle(wins.where(F.size("terms") > 2).select("win", F.explode(F.slice("terms", 3, F.size("terms"))).alias("t")).select("win", "t.term", "t.off"))
    wanted = two.join(_bounded(others, "term"), "win").withColumn("pos", F.col("start") + F.col("off"))
    stand = _standing(wanted, _of_documents(_listed(posts, others), two)).groupBy(*DOC, "win", "start", "len").agg(F.count(F.lit(1)).alias("n"))
    return settle(begins.where("len = 1").unionByName(short.select(*begins.columns)).unionByName(stand.where("n = len - 2").select(*begins.columns)))


def near(posts: DataFrame, wins: DataFrame, slop: int) -> DataFrame:
    """(doc_id, text_hash, win, start, len): the words of proximity matches, in any order, each a span of one word.

    A match is a stretch of at most ``slop`` tokens more than the window has, in which each of the window's words occurs as often as in
    the window or oftener; it hits the tokens of the stretch that are words of the window.
    """
    reach = (wins.agg(F.max("len")).first()[0] or 1) + slop
    bucket = lambda c: F.floor(F.col(c) / reach).cast("int")
    anchors = settle(_first(posts, wins).select(*DOC, "win", F.col("pos").alias("at"), (F.col("len") + slop).alias("most")).distinct())
    here = F.abs(F.col("_dn_pos2") - F.col("at")) < F.col("most")

    def met(found: DataFrame, own: DataFrame, lists: DataFrame, how: str) -> DataFrame:
        """``found`` with the postings of ``own`` terms (win, term) within its reach."""
        wide = found.join(_bounded(settle(own.distinct()), "term"), "win").withColumn("bucket", F.explode(F.array(bucket("at") - 1, bucket("at"), bucket("at") + 1)))
        p = lists.select(F.col("doc_id").alias("_dn_id2"), F.col("text_hash").alias("_dn_hash2"), F.col("term").alias("_dn_term2"), F.col("pos").alias("_dn_pos2"), bucket("pos").alias("_dn_bucket2"))
        same = (wide["text_hash"] == p["_dn_hash2"]) & (wide["term"] == p["_dn_term2"]) & (wide["bucket"] == p["_dn_bucket2"]) & wide["doc_id"].eqNullSafe(p["_dn_id2"])
        return wide.join(p, same & here, how)

    second = wins.where(F.size("terms") > 1).select("win", F.col("terms")[1]["term"].alias("term"))
    two = met(anchors, second, _listed(posts, second), "left_semi").select(*anchors.columns).distinct()
    two = settle(two.unionByName(anchors.where(F.col("most") == 1 + slop)))
    own = wins.select("win", F.explode("terms").alias("t")).select("win", "t.term")
    around = met(two, own, _of_documents(_listed(posts, own), two), "inner").select(*DOC, "win", "most", F.col("_dn_pos2").alias("pos"), "term").distinct()
    ahead = Window.partitionBy(*DOC, "win").orderBy("pos").rangeBetween(0, reach - 1)
    seen = around.withColumn("ahead", F.collect_list(F.struct("pos", "term")).over(ahead))
    stretch = F.filter("ahead", lambda x: x["pos"] < F.col("pos") + F.col("most"))
    needs = settle(wins.select("win", F.transform("terms", lambda x: x["term"]).alias("needs")))
    told = seen.withColumn("ahead", stretch).join(F.broadcast(needs) if _small(wins.select(F.array_join(F.col("terms")["term"], " ").alias("t")), "t") else needs, "win")
    times = lambda array, t: F.size(F.filter(array, lambda x: x == t))
    words = F.transform("ahead", lambda x: x["term"])
    whole = F.forall("needs", lambda t: times(words, t) >= times(F.col("needs"), t))
    hit = told.where(whole).select(*DOC, "win", F.explode(F.transform("ahead", lambda x: x["pos"])).alias("start")).distinct()
    return settle(hit.withColumn("len", F.lit(1)))


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10, slop: int = 0, posts: DataFrame | None = None) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items, contaminated: a row for each of ``docs``.

    ``posts`` is an ``index`` of docs that is at hand already. With ``slop`` 0 a hit is an exact phrase, else see ``near``.
    """
    wins, items_of = windows(benchmark, n)
    if posts is None:
        posts = index(docs, wins.select(F.explode("words").alias("term")))
    order = ordered(posts, wins)
    hits = near(posts, order, slop) if slop else phrases(posts, order)
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("stop"))))
    zero = F.struct(F.lit(0).alias("stop"), F.lit(0).cast("long").alias("n"))
    merged = F.aggregate("spans", zero, lambda a, s: F.struct(F.greatest(a["stop"], s["stop"]).alias("stop"), (a["n"] + F.greatest(s["stop"] - F.greatest(a["stop"], s["start"]), F.lit(0))).alias("n")))["n"]
    n_hit = hits.groupBy(*DOC).agg(spans.alias("spans")).select(F.col("doc_id").alias("_dn_id2"), F.col("text_hash").alias("_dn_hash2"), merged.alias("n_hit"))
    named = hits.select(*DOC, "win").distinct().join(F.broadcast(items_of) if _small(items_of) else items_of, "win")
    items = named.groupBy(*DOC).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")).select(F.col("doc_id").alias("_dn_id3"), F.col("text_hash").alias("_dn_hash3"), "items")
    heads = posts.where(F.col("term") == HEAD).select(*DOC, F.col("n_words").cast("long").alias("n_words"))
    told = heads.join(n_hit, (heads["text_hash"] == n_hit["_dn_hash2"]) & heads["doc_id"].eqNullSafe(n_hit["_dn_id2"]), "left")
    told = told.join(items, (told["text_hash"] == items["_dn_hash3"]) & told["doc_id"].eqNullSafe(items["_dn_id3"]), "left")
    told = told.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return told.select(*DOC, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, slop: int = 0) -> DataFrame:
    """The rows of ``docs`` that no benchmark window hits, with all their columns."""
    bad = report(docs, benchmark, n, slop).where("contaminated").select(F.col("doc_id").alias("_dn_id2"), F.col("text_hash").alias("_dn_hash2")).distinct()
    keyed = docs.withColumn("_dn_hash", F.xxhash64("doc_id", "text"))
    return keyed.join(bad, (keyed["_dn_hash"] == bad["_dn_hash2"]) & keyed["doc_id"].eqNullSafe(bad["_dn_id2"]), "left_anti").drop("_dn_hash")
