"""Benchmark decontamination by a positional inverted index, with DataFrame functions only.

Texts are lower-cased (A-Z) and cut into words. A benchmark item's windows are its runs of ``window`` words; an item of fewer
words is one window. How often each benchmark word occurs in the documents is counted first: windows with a word that never
occurs are out, and of each other window the ``anchors`` rarest words are chosen. Of these words postings (word, document,
position) are stored. The lists of a window's anchors, adjusted by the words' offsets in the window, are intersected from the
rarest one on; what is left is compared with the whole window in the document's words, so that matches are exact.

Benchmark tables are broadcast only up to ``MOST_BROADCAST`` rows, counted first, and joined by shuffles beyond that; likewise
the ids of documents with candidates, without which texts are never shuffled. A frequent word is counted before the shuffle,
and only rare words have postings; where even the rarest word of a window is frequent, as in a passage that a third of all
documents share, its postings are spread by document.

Edge cases: a null or empty text has no words and no hits; items without words are ignored; repeated items each count; repeated
rows (equal doc_id) are each judged by their own words; rows with a null doc_id are judged like others; texts of any length
are read whole; empty tables give rows without hits, or none; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import free_name, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what stands between words, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MOST_BROADCAST = 200_000
FOUND = "own_found"
#: Stands for a null doc_id in the index.
NO_ID = -(1 << 63)


def words(text: Column) -> Column:
    cut = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN)
    return F.array_remove(cut, "")


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def windows(benchmark: DataFrame, window: int) -> DataFrame:
    """window_id, words, item_ids of the distinct windows."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = items.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))).alias("s"))
    cut = starts.select("item_id", F.slice("w", F.col("s") + 1, F.lit(window)).alias("words"))
    return cut.groupBy("words").agg(F.collect_set("item_id").alias("item_ids")).withColumn("window_id", F.xxhash64("words"))


def chosen_anchors(docs: DataFrame, cut: DataFrame, anchors: int) -> DataFrame:
    """window_id, word, offset, rank of the rarest words of each window all of whose words occur in the documents."""
    terms = cut.select("window_id", F.size("words").alias("n"), F.posexplode("words").alias("offset", "word"))
    vocabulary = written(terms.select("word").distinct())
    rows = vocabulary.count()
    spread = docs.select(F.explode(words(F.col("text"))).alias("word")).join(_sized(vocabulary, rows), "word")
    count = spread.groupBy("word").agg(F.count("*").alias("occurs"))
    known = terms.join(count, "word").groupBy("window_id").agg(F.any_value("n").alias("n"), F.array_sort(F.collect_list(F.struct("occurs", "offset", "word"))).alias("rarest"))
    full = known.where(F.size("rarest") == F.col("n"))
    return full.select("window_id", F.posexplode(F.slice("rarest", 1, anchors)).alias("rank", "t")).select("window_id", "rank", "t.offset", "t.word", "t.occurs")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """word, doc, position of the terms' occurrences in the documents: the stored index."""
    own = terms.select("word").distinct()
    spread = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.posexplode(words(F.col("text"))).alias("position", "word"))
    return written(spread.join(_sized(own, own.count()), "word").select("word", "doc", "position"))


def candidates(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """window_id, doc, start where all anchors of a window stand at their offsets."""
    rows = anchors.count()
    first = anchors.where("rank = 0").select("window_id", "word", "offset")
    at = index.join(_sized(first, rows), "word").select("window_id", "doc", (F.col("position") - F.col("offset")).alias("start")).where("start >= 0")
    at = written(at.distinct())
    held = written(at.select("doc").distinct())
    further = anchors.where("rank > 0").groupBy("window_id").agg(F.collect_list(F.struct("word", "offset")).alias("more"))
    need = at.join(_sized(further, rows), "window_id", "left")
    alone = need.where("more is null").select("window_id", "doc", "start")
    asked = need.where("more is not null").select("window_id", "doc", "start", F.size("more").alias("n"), F.explode("more").alias("t"))
    asked = asked.select("window_id", "doc", "start", "n", F.col("t.word").alias("word"), (F.col("start") + F.col("t.offset")).alias("position"))
    near = index.join(_sized(held, held.count()), "doc", "left_semi").join(_sized(further.select(F.explode("more.word").alias("word")).distinct(), rows), "word", "left_semi")
    met = asked.join(near, ["doc", "position", "word"], "left_semi").groupBy("window_id", "doc", "start").agg(F.count("*").alias("met"), F.any_value("n").alias("n"))
    return alone.union(met.where("met = n").select("window_id", "doc", "start"))


def near_matches(index: DataFrame, anchors: DataFrame, slack: int) -> DataFrame:
    """Proximity matches: window_id, doc, start where each anchor of a window stands at most ``slack`` words from its place."""
    place = index.join(_sized(anchors, anchors.count()), "word").select("window_id", "rank", "doc", (F.col("position") - F.col("offset")).alias("start"))
    first = place.where("rank = 0").select("window_id", "doc", "start", F.explode(F.array(*(F.floor(F.col("start") / (slack + 1)) + k for k in (-1, 0, 1)))).alias("near"))
    other = place.where("rank > 0").select("window_id", "doc", "rank", F.col("start").alias("at"), F.floor(F.col("start") / (slack + 1)).alias("near"))
    met = first.join(other, ["window_id", "doc", "near"], "left").where(F.col("rank").isNull() | (F.abs(F.col("at") - F.col("start")) <= slack))
    number = anchors.groupBy("window_id").agg(F.max("rank").alias("n"))
    return met.groupBy("window_id", "doc", "start").agg(F.count_distinct("rank").alias("met")).join(_sized(number, number.count()), "window_id").where("met = n").select("window_id", "doc", "start")


def _found(docs: DataFrame, benchmark: DataFrame, window: int, anchors: int) -> tuple[DataFrame, DataFrame, int]:
    """The windows, and of each document with candidates a list of (start, window), with their number."""
    cut = written(windows(benchmark, window))
    rare = written(chosen_anchors(docs, cut, anchors))
    at = candidates(postings(docs, rare), rare)
    named = at.join(_sized(cut.select("window_id", "words", "item_ids"), cut.count()), "window_id")
    listed = written(named.groupBy("doc").agg(F.collect_list(F.struct("start", "words", "item_ids")).alias("found")))
    return cut, listed, listed.count()


def _split(docs: DataFrame, listed: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """The rows with candidates, joined with them (in the column FOUND, or a longer name where ``docs`` has that), and the others."""
    key = free_name(docs, "own_doc")
    keyed = docs.withColumn(key, F.coalesce("doc_id", F.lit(NO_ID)))
    ids = _sized(listed.select(F.col("doc").alias(key)), number)
    found = listed.select(F.col("doc").alias(key), F.col("found").alias(free_name(docs, FOUND)))
    return keyed.join(ids, key, "left_semi").join(found, key).drop(key), keyed.join(ids, key, "left_anti").drop(key)


def _hits(w: Column, found: Column) -> Column:
    return F.filter(found, lambda c: F.slice(w, c["start"] + 1, F.size(c["words"])) == c["words"])


def _result(doc_id: Column, n_words: Column, n_hit: Column, items: Column) -> list[Column]:
    return [
        doc_id.alias("doc_id"),
        n_words.cast("long").alias("n_words"),
        n_hit.cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    ]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, anchors: int = 3) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    _, listed, number = _found(docs, benchmark, window, anchors)
    some, none = _split(docs, listed, number)
    held = some.select("doc_id", words(F.col("text")).alias("w"), FOUND).select("doc_id", F.size("w").alias("n_words"), _hits(F.col("w"), F.col(FOUND)).alias("h"))
    covered = F.array_distinct(F.flatten(F.transform("h", lambda c: F.sequence(c["start"], c["start"] + F.size(c["words"]) - 1))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("h", lambda c: c["item_ids"]))))
    hit = held.select("doc_id", "n_words", F.size(covered).alias("n_hit"), items.alias("items"))
    empty = F.array().cast("array<string>")
    return hit.select(*_result(F.col("doc_id"), F.col("n_words"), F.col("n_hit"), F.col("items"))).union(
        none.select(*_result(F.col("doc_id"), F.size(words(F.col("text"))), F.lit(0), empty))
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, anchors: int = 3) -> DataFrame:
    """The rows of ``docs`` without any window of the benchmark, with all their columns."""
    _, listed, number = _found(docs.select("doc_id", "text"), benchmark, window, anchors)
    some, none = _split(docs, listed, number)
    free = some.where(F.size(_hits(words(F.col("text")), F.col(free_name(docs, FOUND)))) == 0)
    return free.select(docs.columns).union(none.select(docs.columns))
