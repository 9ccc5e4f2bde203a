"""Pages of books by the tokens they hold: each page is read once for all tokens that its book is asked for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.matching import example_tokens
from corpusloom.operators.topk import best_matches

PART_CHARS = 4_000_000  # characters of pages read by one automaton
PART_TOKENS = 20_000  # tokens of one automaton
SALTS = 32  # shares of a book's pages that meet its size apart


def _found(tokens: pd.DataFrame, pages: pd.DataFrame) -> pd.DataFrame:
    """The distinct tokens in each page of a part, by one pass of an automaton over its text."""
    import ahocorasick

    rows = []
    if len(tokens) and len(pages):
        machine = ahocorasick.Automaton()
        for t in tokens["t"]:
            machine.add_word(t, t)
        machine.make_automaton()
        pages = pages.drop_duplicates(["page", "version"])  # equal rows stand in one part
        for b, p, v, text in zip(pages["book"], pages["page"], pages["version"], pages["text"], strict=True):
            rows.extend((b, p, v, t) for t in {t for _, t in machine.iter(text)})
    return pd.DataFrame(rows, columns=["book", "page", "version", "t"])


def page_tokens(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """book, page, version, t: the distinct tokens (book, t) that stand anywhere in a page (book, page, version, text);
    version tells a page's texts apart, and equal rows count once.

    A book's pages are dealt in parts of about PART_CHARS and its tokens in parts of PART_TOKENS, so a book of any size
    is spread over tasks; a page is read once for each part of tokens. Rows with a null book and empty tokens find nothing."""
    t = tokens.where("book is not null and t <> ''").select("book", "t").distinct()
    p = pages.where("book is not null and text <> ''").select("book", "page", "version", "text")
    sizes = p.groupBy("book").agg(F.ceil(F.sum(F.length("text")) / PART_CHARS).alias("_parts"))
    sizes = sizes.join(t.groupBy("book").agg(F.ceil(F.count("*") / PART_TOKENS).alias("_blocks")), "book")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda n, *of: F.pmod(F.xxhash64(*of), F.col(n))
    salts = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = p.withColumn("_salt", F.pmod(F.xxhash64("version", "page"), F.lit(SALTS))).join(salts, ["book", "_salt"])
    left = t.join(sizes, "book").select("book", each("_parts").alias("_part"), dealt("_blocks", "t").alias("_block"), "t")
    right = salted.select("book", dealt("_parts", "page", "version").alias("_part"), each("_blocks").alias("_block"), "page", "version", "text")
    kinds = {f.name: f.dataType.simpleString() for f in p.schema}
    key = ["book", "_part", "_block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_found, f"book {kinds['book']}, page {kinds['page']}, version string, t string")


def page_match(examples: DataFrame, pages: DataFrame, book: str, item: str, text: Column, page: str, page_text: str, least: int = 4) -> DataFrame:
    """The page of its book that holds most of an example's weighted tokens (numbers 3, names of several words 2, single
    names 1), from a score on; the last page at a tie. A token that stands twice counts twice; a page key that stands on
    several texts counts each text alone. Null keys and texts have no row."""
    asked = example_tokens(examples, book, item, text).select(F.col(book).alias("book"), F.col(item).alias("item"), F.col(book).alias("of"), "t", F.col("w").alias("x"))
    asked = asked.where("book is not null and item is not null")
    rows = pages.select(F.col(book).alias("book"), F.col(page).alias("page"), F.md5(page_text).alias("version"), F.col(page_text).alias("text")).where("page is not null")
    known = page_tokens(asked, rows).select(F.col("book").alias("of"), "page", "version", "t", F.lit(1.0).alias("y"))
    # the book is a part of the term: an example meets pages of its own book alone
    best = best_matches(asked, known, ["book", "item"], ["page", "version"], ["of", "t"], 1, least, 6, last=True)
    return best.select(F.col("book").alias(book), F.col("item").alias(item), F.col("page").alias(page), F.col("score").cast("long").alias("score"))
