"""How tables of items change: ingest without copies, upserts, seeds, merged accounts, removed items, checked replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.operators.ranking import running_before
from corpusloom.sources.staging import staged


def ingest_status(batch: DataFrame, stored: DataFrame, key: str, order: str) -> DataFrame:
    """status of each row of a batch: in_corpus (its key is stored), in_batch (an earlier row has its key) or inserted."""
    first = batch.groupBy(key).agg(F.min(order).alias("_first"))
    known = stored.select(key).distinct().withColumn("_known", F.lit(True))
    marks = first.join(known, key, "left")
    status = F.when(F.col("_known"), "in_corpus").when(F.col(order) > F.col("_first"), "in_batch").otherwise("inserted")
    return batch.join(marks, key).withColumn("status", status).drop("_first", "_known")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], replaced: list[str], filled: list[str]) -> DataFrame:
    """One row a key: of new where it has the key, else of old. In filled columns a null in new keeps the old value.
    Keys are unique on either side."""
    o = old.select(*keys, *(F.col(c).alias(f"_o_{c}") for c in replaced + filled), F.lit(True).alias("_old"))
    n = new.select(*keys, *replaced, *filled, F.lit(True).alias("_new"))
    both = o.join(n, keys, "full")
    took = [F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_o_{c}")).alias(c) for c in replaced]
    kept = [F.coalesce(c, f"_o_{c}").alias(c) for c in filled]
    change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new"), "updated").otherwise("kept")
    return both.select(*keys, *took, *kept, change.alias("change"))


def latest(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The values of the newest row of each key, combined before the shuffle."""
    best = F.max(F.struct(F.struct(*order).alias("o"), F.struct(*values).alias("v"))).alias("_b")
    return rows.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_b.v.{v}").alias(v) for v in values))


def insert_missing(table: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """The table and those seeds whose key it lacks."""
    return table.unionByName(seeds.join(table, key, "left_anti"), allowMissingColumns=True)


def settled_merges(mapping: DataFrame, account: str, most_rounds: int = 64) -> DataFrame:
    """account, into, status: where each account of an edit list (account, into) ends, whatever the length of the chain.

    merged: into is the end of the chain; cycle: the chain runs into a circle and has no end (into is null). An account
    that is merged into itself stays and has no row; of several targets the smallest counts; null ends are left out. The
    steps double from round to round (pointer doubling), so a chain of n takes about log2(n) rounds; each is written to
    the shared folder. A chain that meets a circle stops growing the number of settled accounts, and that ends the rounds.
    """
    rows = mapping.where(F.col(account).isNotNull() & F.col("into").isNotNull() & (F.col(account) != F.col("into")))
    rows = rows.groupBy(F.col(account).alias("a")).agg(F.min("into").alias("b"))
    ends = rows.select(F.col("a").alias("b"), F.lit(True).alias("goes_on"))
    rows = staged(rows.join(ends, "b", "left").select("a", "b", F.col("goes_on").isNull().alias("settled")), "merges")
    open_ones = rows.where("not settled").count()
    for _ in range(most_rounds):
        if not open_ones:
            break
        step = rows.select(F.col("a").alias("b"), F.col("b").alias("next"), F.col("settled").alias("ends"))
        joined = rows.where("not settled").join(step, "b")  # the target of an open account is an account of the list
        rows = staged(rows.where("settled").unionByName(joined.select("a", F.col("next").alias("b"), F.col("ends").alias("settled"))), "merges")
        left = rows.where("not settled").count()
        if left == open_ones:
            break
        open_ones = left
    return rows.select(F.col("a").alias(account), F.when(F.col("settled"), F.col("b")).alias("into"), F.when(F.col("settled"), "merged").otherwise("cycle").alias("status"))


def merge_accounts(items: DataFrame, mapping: DataFrame, account: str) -> DataFrame:
    """Items with accounts renamed by mapping (account, into); the mapping is an edit list, its size left to the optimizer.
    One step: chains are for settled_merges()."""
    return items.join(mapping.select(account, F.col("into").alias("_into")), account, "left").withColumn(account, F.coalesce("_into", account)).drop("_into")


def merge_everywhere(mapping: DataFrame, account: str, media: str, profiles: DataFrame, items: dict[str, DataFrame], references: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables after accounts were merged along chains: items move, profiles move where there is room, references to
    profiles' accounts that are gone become null. Accounts in circles stay as they are; merges tells them.

    The result has each table under its name, profiles and merges; it is one commit of a RunStore."""
    merges = settled_merges(mapping, account)
    moves = merges.where("status = 'merged'").select(account, "into")
    out = {name: merge_accounts(t, moves, account) for name, t in items.items()}
    out["profiles"] = merge_profiles(profiles, moves, account, media)
    there = out["profiles"].select(account).distinct().withColumn("_there", F.lit(True))
    for name, t in references.items():
        moved = merge_accounts(t, moves, account).join(there, account, "left")
        out[name] = moved.withColumn(account, F.when(F.col("_there"), F.col(account))).select(*t.columns)
    return out | {"merges": merges}


def remove_items(table: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    return table.join(removed, key, "left_anti")


def replace_children(children: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents that new names give way to new's rows."""
    return children.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def fill_missing(existing: Column, computed: Column) -> Column:
    return F.coalesce(existing, computed)


def next_codes(keys: DataFrame, taken: DataFrame, prefix: str, key: str, first_seen: str, code: str = "code") -> DataFrame:
    """PREFIX.N for each key in the order first seen, from the number after the largest that is taken in its prefix. The
    order is found in ranges, so one prefix may hold all keys."""
    number = F.regexp_extract(code, r"\.(\d+)$", 1).try_cast("long")
    top = taken.groupBy(prefix).agg(F.max(number).alias("_top"))
    seen = keys.groupBy(prefix, key).agg(F.min(first_seen).alias("_seen"))
    placed = running_before(seen, [prefix], ["_seen", key], F.lit(1), "_place")
    rows = placed.join(top, prefix, "left").withColumn(code, F.concat(F.col(prefix), F.lit("."), (F.coalesce("_top", F.lit(0)) + F.col("_place") + 1).cast("string")))
    return rows.select(prefix, key, code)


def vocabulary_errors(items: DataFrame, key: str, allowed: dict[str, list[str]], optional: tuple[str, ...] = ()) -> DataFrame:
    """key, n_errors and errors: fields that are missing (unless optional) or hold a value outside the vocabulary, in
    the order of the vocabulary. No shuffle: the vocabulary is part of the expression."""
    told = []
    for field, values in allowed.items():
        v = F.col(field).cast("string")
        missing = F.lit(None).cast("string") if field in optional else F.lit(f"missing {field}")
        told.append(F.when(v.isNull(), missing).when(~v.isin(values), F.concat(F.lit(f"invalid {field}: "), v)))
    errors = F.filter(F.array(*told), lambda e: e.isNotNull())
    return items.select(key, F.size(errors).cast("long").alias("n_errors"), F.array_join(errors, "; ").alias("errors"))


def replace_profiles(prints: DataFrame, new: DataFrame, rebuilt: DataFrame, profile: str) -> DataFrame:
    """prints with all rows of the rebuilt profiles replaced by new's: attributes that lost their data vanish, and so do
    profiles without rows in new."""
    names = rebuilt.select(profile).distinct()
    return prints.join(names, profile, "left_anti").unionByName(new.join(names, profile, "left_semi"))


def snapshot(prints: DataFrame, taken: DataFrame, label: str, at: Column) -> DataFrame:
    """taken (earlier snapshots) and a copy of prints under the next snapshot id."""
    last = taken.agg(F.coalesce(F.max("snapshot_id"), F.lit(0)).alias("_last"))  # one row
    copy = prints.join(F.broadcast(last), F.lit(True)).withColumns({"snapshot_id": F.col("_last") + 1, "label": F.lit(label), "at": at}).drop("_last")
    return taken.unionByName(copy, allowMissingColumns=True)


def merge_profiles(profiles: DataFrame, mapping: DataFrame, account: str, media: str) -> DataFrame:
    """Profiles after accounts were merged (account, into): one moves to the other account, unless that has one of its
    media type; of several that move the one of the smallest account stays."""
    moved = profiles.join(mapping.withColumnRenamed("into", "_into"), account)
    there = profiles.join(mapping.select(account), account, "left_anti")
    free = moved.join(there.select(F.col(account).alias("_into"), media).distinct(), ["_into", media], "left_anti")
    first = W.partitionBy("_into", media).orderBy(account)
    moves = free.withColumn("_r", F.row_number().over(first)).where("_r = 1").withColumn(account, F.col("_into"))
    return there.unionByName(moves.select(*profiles.columns))


def touched_accounts(before: DataFrame, after: DataFrame, item: str, account: str) -> DataFrame:
    """Accounts whose profiles must be rebuilt: those that lost or got an item."""
    key = [item, account]
    gone = before.select(*key).join(after.select(*key), key, "left_anti")
    new = after.select(*key).join(before.select(*key), key, "left_anti")
    return gone.union(new).select(account).where(F.col(account).isNotNull()).distinct()


def remove_with_children(removed: DataFrame, item: str, children: dict[str, DataFrame], references: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables after items were removed: their child rows go, references to them become null."""
    names = removed.select(item).distinct()
    out = {n: t.join(names, item, "left_anti") for n, t in children.items()}
    marked = names.withColumn("_gone", F.lit(True))
    for n, t in references.items():
        out[n] = t.join(marked, item, "left").withColumn(item, F.when(F.col("_gone").isNull(), F.col(item))).select(*t.columns)
    return out


def repaired_media(items: DataFrame, key: str, media: str, right: Column) -> DataFrame:
    """key, old and new of the items whose media type differs from what their link says: the report of a dry run. Items
    without a media type and those whose link says none (right is null) are left out."""
    return items.select(key, F.col(media).alias("old"), right.alias("new")).where(F.col("old") != F.col("new"))


def with_closing_shot(shots: DataFrame, items: DataFrame, item: str, number: str, start: str, end: str, seconds: str, least: float = 0.15) -> DataFrame:
    """shots and, for items whose duration goes on after the last shot by more than `least`, one closing shot."""
    last = shots.groupBy(item).agg(F.max(number).alias("_n"), F.max(end).alias("_end"))
    gap = last.join(items.select(item, seconds), item).where(F.col(seconds) - F.col("_end") > least)
    new = gap.select(item, (F.col("_n") + 1).alias(number), F.col("_end").alias(start), F.col(seconds).alias(end))
    return shots.unionByName(new, allowMissingColumns=True)


def reingested_shots(stored: DataFrame, new: DataFrame, item: str, captured: str) -> DataFrame:
    """Shots after inputs came again: a list with a missing frame, or none, gives way to the new one; a complete one stays.

    Of each part only keys are held, one an item: rows are neither sorted nor met by keys sent whole to every task."""
    whole = stored.groupBy(item).agg(F.bool_and(F.coalesce(captured, F.lit(False))).alias("_whole")).where("_whole").select(item)
    again = new.join(whole.hint("shuffle_hash"), item, "left_anti")
    return stored.join(again.select(item).distinct().hint("shuffle_hash"), item, "left_anti").unionByName(again, allowMissingColumns=True)


def replace_visuals(visuals: DataFrame, new: DataFrame, item: str, marker: str) -> DataFrame:
    """As replace_children(), with seconds from the marker; rows whose marker is no time are left out."""
    from corpusloom.functions.titles import seconds_of

    timed = new.withColumn("seconds", seconds_of(F.col(marker))).where("seconds is not null")
    return visuals.join(new.select(item).distinct(), item, "left_anti").unionByName(timed)


def repaired_durations(items: DataFrame, ends: DataFrame, item: str, seconds: str) -> DataFrame:
    """items with missing durations filled from the last subtitle cue (item, last_end)."""
    return items.join(ends.groupBy(item).agg(F.max("last_end").alias("_end")), item, "left").withColumn(seconds, F.coalesce(seconds, "_end")).drop("_end")
