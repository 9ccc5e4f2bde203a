"""Books and creations: one book an author and title, scores against book profiles, listings with their filters and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.activity import valuation
from corpusloom.operators.profiles import rank
from corpusloom.operators.scoring import complete_scores


def first_editions(books: DataFrame, author: str, title: str, book: str) -> DataFrame:
    """The row of the smallest id of each author and title (null titles are one title); books without author are left out."""
    rows = books.where(F.col(author).isNotNull())
    keep = rows.groupBy(author, title).agg(F.min(book).alias(book)).select(book)
    return rows.join(keep, book, "left_semi")


def book_scores(items: DataFrame, profiles: DataFrame, item: str, profile: str, media: str = "media", status: str = "status") -> DataFrame:
    """item, profile, score, n_attributes, breakdown, place: books against book profiles alone, the confirmed ones or all
    where none is confirmed; every attribute counts once, and a book without any scores 0."""
    books = profiles.where(F.col(media) == "Book")
    some = books.agg(F.coalesce(F.bool_or(F.col(status) == "confirmed"), F.lit(False)).alias("_some"))
    chosen = books.join(F.broadcast(some), F.lit(True)).where(~F.col("_some") | (F.col(status) == "confirmed")).drop("_some")  # one row
    return rank(complete_scores(items, chosen, item, profile, book=""), item, profile)


#: Orders of the list of books: columns, and whether from the largest on.
BOOK_ORDERS = {"newest": [("added", True)], "title": [("title", False)], "author": [("author", False), ("title", False)], "year": [("year", True), ("title", False)], "words": [("words", True)], "subject": [("subject", False), ("title", False)]}


def book_list(books: DataFrame, subjects: list[str], text: str = "", subject: str = "", status: str = "", read: str = "", order: str = "newest") -> DataFrame:
    """Books (book, title, author, subject, year, words, added, read, classified_by) under all filters, in an order.

    text: part of title or author in any case; subject: one of subjects, or Unassigned for none of them; status:
    classified, pending or needs_review; read: read or unread. Unknown filters and orders are as none (newest first).
    Text orders ignore case, nulls come first upwards and last downwards; ties are by book."""
    like = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower()))
    known = F.coalesce(F.col("subject").isin(*subjects), F.lit(False))
    by = F.coalesce("classified_by", F.lit("pending"))
    rows = books.withColumn("classified_by", by)
    if text:
        rows = rows.where(like("title") | like("author"))
    if subject == "Unassigned":
        rows = rows.where(~known)
    elif subject in subjects:
        rows = rows.where(F.col("subject") == subject)
    if status == "classified":
        rows = rows.where(~F.col("classified_by").isin("pending", "needs_review"))
    elif status in ("pending", "needs_review"):
        rows = rows.where(F.col("classified_by") == status)
    if read in ("read", "unread"):
        seen = F.coalesce(F.col("read") == 1, F.lit(False))
        rows = rows.where(seen if read == "read" else ~seen)
    kinds = dict(rows.dtypes)
    shown = lambda c: F.lower(c) if kinds[c] == "string" else F.col(c)
    keys = [shown(c).desc_nulls_last() if down else shown(c).asc_nulls_first() for c, down in BOOK_ORDERS.get(order, BOOK_ORDERS["newest"])]
    return rows.orderBy(*keys, "book")


def format_input_list(inputs: DataFrame, profile: str = "", status: str = "", text: str = "") -> DataFrame:
    """Format inputs (input, profile, status, excluded, title, account, added) under all filters, newest first. The status
    excluded is a flag of its own, beside any status."""
    if profile:
        inputs = inputs.where(F.col("profile") == profile)
    if status:
        inputs = inputs.where(F.coalesce("excluded", F.lit(0)) == 1 if status == "excluded" else F.col("status") == status)
    if text:
        part = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower()))
        inputs = inputs.where(part("title") | part("account"))
    return inputs.orderBy(F.col("added").desc_nulls_last(), F.col("input").desc())


def creation_list(creations: DataFrame, scores: DataFrame, creation: str, profile: str, only: str = "", text: str = "", made_by: str = "", least: float | None = None, order: str = "made_at", up: bool = False) -> DataFrame:
    """Creations (creation, profile: the target, title, label, made_by, made_at) with the target's score, the original's
    against the same profile and the gain (scores: creation, profile, score, before), under all filters, in an order.
    Creations without a score stay, unless a least gain is asked for."""
    target = scores.select(creation, profile, "score", "before", (F.col("score") - F.col("before")).alias("gain"))
    rows = creations.join(target, [creation, profile], "left")
    if only:
        rows = rows.where(F.col(profile) == only)
    if text:
        part = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower()))
        rows = rows.where(part("title") | part("label"))
    if made_by:
        rows = rows.where(F.col("made_by") == made_by)
    if least is not None:
        rows = rows.where(F.col("gain") >= least)
    by = order if order in ("made_at", "title", "score", "before", "gain") else "made_at"
    return rows.orderBy(F.col(by).asc_nulls_first() if up else F.col(by).desc_nulls_last(), creation)


def creations_valuation(targets: DataFrame, macros: dict[str, list[str]], weights: dict[str, float] | None = None) -> DataFrame:
    """macro, weight, share, start, end, valued, total: the weight of all attributes that stand in the breakdowns of
    creations against their targets, by macro (Other without one); valued breakdowns of total. A null breakdown isn't
    valued but counted, an empty one too."""
    of = F.create_map(*(F.lit(x) for m, fields in macros.items() for f in fields for x in (f, m)))
    own: Column = F.lit(1.0)
    if weights:
        own = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("attribute")), F.lit(1.0))
    each = targets.select(F.explode(F.map_keys("breakdown")).alias("attribute"))
    rows = each.select(F.coalesce(F.try_element_at(of, F.col("attribute")), F.lit("Other")).alias("macro"), own.alias("w"))
    told = targets.agg(F.count_if(F.coalesce(F.size("breakdown"), F.lit(0)) > 0).alias("valued"), F.count("*").alias("total"))
    return valuation(rows, "macro", "w").join(F.broadcast(told), F.lit(True))  # one row
