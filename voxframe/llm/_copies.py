"""Rows of a table by lists of ids, without a shuffle of texts where the list is small enough to broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers that are broadcast at most (32 MB); longer lists are joined by a shuffle.
MOST_IDS = 4_000_000
#: Numbers in lists of documents that are broadcast at most (64 MB).
MOST_LISTED = 8_000_000


def sized(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= MOST_IDS else ids


def among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids, "doc_id", "left_semi")


def not_among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids, "doc_id", "left_anti")


def with_lists(docs: DataFrame, lists: DataFrame, column: str) -> DataFrame:
    """doc_id, text and list of the documents that have one."""
    short = (lists.select(F.sum(F.size(column))).first()[0] or 0) <= MOST_LISTED
    return docs.join(F.broadcast(lists) if short else lists, "doc_id").select("doc_id", "text", column)
