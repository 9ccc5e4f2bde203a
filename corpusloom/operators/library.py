"""The library of videos and books under all its filters, and jobs that move or mend its items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import upkeep

# The media that kinds of videos stand for, and the columns that order the list.
KINDS = {"video": "Instagram", "youtube": "YouTube"}
ORDERS = ("title", "media", "account", "subject", "words", "duration", "title_format", "you_freq", "readability", "url", "added")


def _with_tag(rows: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    """Items that have a tag, in any case of its letters."""
    return rows.join(tags.where(F.lower("tag") == tag.lower()).select("item").distinct(), "item", "left_semi")


def library_items(videos: DataFrame, books: DataFrame, subjects: list[str], terms: tuple[DataFrame, DataFrame] | None = None, examples: tuple[DataFrame, DataFrame] | None = None, *, kind: str = "", account: str = "", text: str = "", title_format: str = "", least: int | None = None, most: int | None = None, term: str = "", example: str = "", subject: str = "", order: str = "added", up: bool = False) -> DataFrame:
    """Videos and books in one list (kind, then the union of columns) under all filters, in an order.

    Both have item, title, account, subject (their own), profile_subject, words, added, url; videos also media, duration,
    title_format, you_freq and readability. A video's subject is its profile's before its own, a book's its own before
    its profile's. kind is video, youtube (videos of one medium), book or nothing; a title format leaves out books.
    subject Unassigned is null or none of the subjects; any other word that is none of them is no filter. Text is part of
    the title in any case. terms and examples are (of videos, of books) rows of item and tag. A word range leaves out
    items without a count. Nulls come first on the way up, ties are by kind and item."""
    shown = {"videos": ("profile_subject", "subject"), "books": ("subject", "profile_subject")}
    tags = [(terms, term, "terms"), (examples, example, "examples")]
    for given, asked, name in tags:
        if asked and given is None:
            raise ValueError(f"no {name} to filter by")

    def kept(rows: DataFrame, which: str) -> DataFrame:
        rows = rows.withColumn("subject", F.coalesce(*shown[which])).drop("profile_subject")
        known = F.coalesce(F.col("subject").isin(*subjects), F.lit(False))
        if account:
            rows = rows.where(F.col("account") == account)
        if text:
            rows = rows.where(F.contains(F.lower("title"), F.lit(text.lower())))
        if least is not None:
            rows = rows.where(F.col("words") >= least)
        if most is not None:
            rows = rows.where(F.col("words") <= most)
        if subject == "Unassigned":
            rows = rows.where(~known)
        elif subject in subjects:
            rows = rows.where(F.col("subject") == subject)
        for given, asked, _ in tags:
            if asked:
                rows = _with_tag(rows, given[which == "books"], asked)
        return rows.withColumn("subject", F.when(known, F.col("subject")))

    parts = []
    if kind != "book":
        rows = videos.where(F.col("media") == KINDS[kind]) if kind in KINDS else videos
        rows = rows.where(F.col("title_format") == title_format) if title_format else rows
        parts.append(kept(rows, "videos").withColumns({"kind": F.lit("video"), "media": F.coalesce("media", F.lit("Instagram"))}))
    if kind not in KINDS and not title_format:
        parts.append(kept(books, "books").withColumn("kind", F.lit("book")))
    if not parts:  # a title format of books: none
        parts = [kept(books.limit(0), "books").withColumn("kind", F.lit("book"))]
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    by = order if order in ORDERS and order in out.columns else "added"
    key = F.lower(by) if dict(out.dtypes)[by] == "string" else F.col(by)
    return out.orderBy(key.asc_nulls_first() if up else key.desc_nulls_last(), "kind", "item")


def reassigned(items: DataFrame, moves: DataFrame, item: str, account: str) -> DataFrame:
    """items with the accounts that moves (item, account) gives them; of several moves of one item the smallest account
    holds, a null one or an unknown item changes nothing."""
    to = moves.where(F.col(account).isNotNull()).groupBy(item).agg(F.min(account).alias("_to"))
    return items.join(to, item, "left").withColumn(account, F.coalesce("_to", account)).select(*items.columns)


def reassign_and_rebuild(items: DataFrame, moves: DataFrame, prints: DataFrame, item: str, account: str, build: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """items, accounts and prints after a move, as one commit of a RunStore: accounts that lost or got an item are built
    again from their items alone, all others keep their rows, and one that lost its last item loses its profile.

    build makes fingerprint rows (with the account as its column, as prints has it) from items."""
    after = reassigned(items, moves, item, account)
    accounts = upkeep.touched_accounts(items, after, item, account)
    new = build(after.join(accounts, account, "left_semi"))
    return {"items": after, "accounts": accounts, "prints": upkeep.replace_profiles(prints, new.select(*prints.columns), accounts, account)}


def corrected_media(items: DataFrame, media: str, right: Column) -> DataFrame:
    """items with the media type that their link tells: the repair that repaired_media() reports. Items without a media
    type, and those whose link tells none (right is null), stay as they are."""
    return items.withColumn(media, F.when(F.col(media).isNotNull() & right.isNotNull(), right).otherwise(F.col(media)))
