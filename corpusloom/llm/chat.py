"""Chat formatting in budgeted windows. DataFrame functions only.

A conversation's turns are ordered by turn (then role and text, where a number repeats). Prefix sums of turn tokens cut
it into turn-aligned spans: a turn of more than a quarter of the room stands alone, and the turns between such ones are
cut where their first token, counted from the stretch's start, passes a multiple of the other three quarters. So a window of short turns stays within the
budget, and a window of one long turn exceeds it only if that turn does. Each window holds the system turn, the turns
just before its span that fit the history budget, and the span; loss falls on the assistant texts of the span, not on
repeated ones.

The template marks each turn as <s>role, a line break, the text, </s>; user texts stand between [INST] and [/INST].
Control strings inside texts get a backslash after their first sign, and backslashes are doubled before, so that the
way back is exact. Null roles and texts are empty; a null turn number comes first; a null conv_id is one conversation.
Equal rows are turns of their own; texts may be of any length and are never cut; an empty table gives no rows; columns
beside conv_id, turn, role and text play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tokens of a window, and of the history repeated in it.
BUDGET, HISTORY = 1024, 128
#: Control strings of the template, and the letter that stands for a line break in a role.
CONTROL = r"([<\[])(/?s>|/?INST\]|n\])"
ESCAPED = r"([<\[])\\(/?s>|/?INST\]|n\])"
OPEN, CLOSE, ASK, ASKED = "<s>", "</s>", "[INST] ", " [/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, ESCAPED, "$1$2"), F.lit("\\\\"), F.lit("\\"))


def tokens(text: Column) -> Column:
    """Tokens as the budget counts them: runs of letters and digits, and single other signs; at least one a turn."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")), F.lit(1)).cast("long")


def role_text(role: Column) -> Column:
    """An escaped role on one line."""
    return F.replace(escape(role), F.lit("\n"), F.lit("[\\n]"))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, formatted, repeated (leading turns not of the span), tokens, spans (start and length in
    characters of the assistant texts under the loss mask)."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = W.partitionBy("conv_id")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"k": F.row_number().over(order), "n": tokens(F.col("text"))})
    rows = rows.withColumns({"end": F.sum("n").over(so_far), "is_system": (F.col("role") == "system") & (F.col("k") == 1)})
    rows = rows.withColumn("system_n", F.max(F.when(F.col("is_system"), F.col("n")).otherwise(0)).over(whole))
    room = budget - history - F.col("system_n")
    rows = rows.withColumns({"begin": F.col("end") - F.col("n"), "most": F.greatest(F.lit(1), F.floor(room / 4))})
    rows = rows.withColumn("alone", F.col("n") > F.col("most"))
    stretch = F.col("alone") | F.coalesce(F.lag("alone").over(order), F.lit(True))  # begins between long turns
    rows = rows.withColumn("from", F.max(F.when(stretch, F.col("begin"))).over(so_far))
    rows = rows.withColumn("cell", F.floor((F.col("begin") - F.col("from")) / F.greatest(F.lit(1), room - F.col("most"))))
    opens = (F.col("begin") == F.col("from")) | (F.lag("cell").over(order) != F.col("cell"))
    rows = rows.withColumn("opens", opens.cast("int")).withColumn("window", (F.sum("opens").over(so_far) - 1).cast("long"))
    # the first turn that begins within the history budget before this one
    back = F.min("k").over(W.partitionBy("conv_id").orderBy("begin").rangeBetween(-history, 0))
    firsts = rows.withColumn("from_k", back).where("opens = 1").select("conv_id", "window", F.col("k").alias("first_k"), "from_k")
    system = rows.where("is_system").select("conv_id", F.col("text").alias("system_text"), F.col("n").alias("system_tokens"))

    past = firsts.where("from_k < first_k").select("conv_id", "window", F.explode(F.sequence("from_k", F.col("first_k") - 1)).alias("k"))
    same = F.col("r.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("r.k") == F.col("f.k"))
    repeated = past.alias("f").join(rows.where(~F.col("is_system")).alias("r"), same)
    repeated = repeated.select("r.conv_id", "f.window", "r.k", "role", "text", "n", F.lit(True).alias("again"))
    again = firsts.alias("f").where("first_k > 1").join(system.alias("r"), F.col("r.conv_id").eqNullSafe(F.col("f.conv_id")))
    again = again.select("f.conv_id", "f.window", F.lit(1).alias("k"), F.lit("system").alias("role"), F.col("system_text").alias("text"), F.col("system_tokens").alias("n"), F.lit(True).alias("again"))
    own = rows.select("conv_id", "window", "k", "role", "text", "n", F.lit(False).alias("again"))
    all_rows = own.union(repeated).union(again)

    asks = F.col("role") == "user"
    head = F.concat(F.lit(OPEN), role_text(F.col("role")), F.lit("\n"), F.when(asks, F.lit(ASK)).otherwise(""))
    body, tail = escape(F.col("text")), F.concat(F.when(asks, F.lit(ASKED)).otherwise(""), F.lit(CLOSE))
    turns = all_rows.select("conv_id", "window", "k", "again", "n", head.alias("head"), body.alias("body"), tail.alias("tail"), ((F.col("role") == "assistant") & ~F.col("again")).alias("target"))
    turns = turns.withColumn("length", F.length("head") + F.length("body") + F.length("tail"))
    inside = W.partitionBy("conv_id", "window").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum("length").over(inside), F.lit(0)) + F.length("head"))
    span = F.when(F.col("target"), F.struct(F.col("start"), F.length("body").cast("long").alias("length")))
    out = turns.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("k", F.concat("head", "body", "tail").alias("s")))).alias("parts"),
        F.sum(F.col("again").cast("int")).cast("int").alias("repeated"),
        F.sum("n").alias("tokens"),
        F.sort_array(F.collect_list(span)).alias("spans"),
    )
    return out.select("conv_id", "window", F.array_join(F.transform("parts", lambda p: p["s"]), "").alias("formatted"), "repeated", "tokens", "spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text, in order), targets (texts under the loss mask, in order), formatted_chars."""

    def turn(part: Column) -> Column:
        role = F.replace(F.substring_index(part, "\n", 1), F.lit("[\\n]"), F.lit("\n"))
        text = F.substr(part, F.instr(part, "\n") + 1, F.length(part) - F.instr(part, "\n") - len(CLOSE))
        asked = F.substr(text, F.lit(len(ASK) + 1), F.length(text) - len(ASK) - len(ASKED))
        return F.struct(unescape(role).alias("role"), unescape(F.when(role == "user", asked).otherwise(text)).alias("text"))

    parts = F.split(F.substr("formatted", F.lit(len(OPEN) + 1)), OPEN)
    fresh = F.slice(parts, F.col("repeated") + 1, F.size(parts))
    masked = F.transform("spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    rows = formatted.select("conv_id", "window", F.transform(fresh, turn).alias("turns"), masked.alias("targets"), F.length("formatted").cast("long").alias("chars"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return rows.select("conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), F.flatten(F.transform("w", lambda x: x["targets"])).alias("targets"), "formatted_chars")


def digests(conversations: DataFrame) -> DataFrame:
    back = read_back(windows(conversations))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("targets", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
