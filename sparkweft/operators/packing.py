"""Consecutive rows of a name packed greedily into parts, for names of any length.

Where a part that begins at a row ends is known without folding over the rows
before: by running sums, and a search of each row's sum plus the budget among
all sums. Which rows begin a part is then a walk along these successors. Rows
are numbered through and cut into blocks of ``BLOCK``; a block tells for each
of its rows where a walk from there leaves it. Walks that enter a block soon
meet, so few rows are ever left to, and over these alone pointer jumping marks
which ones a walk from a name's first row passes, in as many rounds as the
longest walk over blocks has binary digits. No task sees more than a block,
whatever the names' lengths.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.operators.ranking import runnings
from sparkweft.sources.store import spent, stored

#: Rows of a block.
BLOCK = 1 << 16


def _successors(rows: DataFrame, budget: int) -> DataFrame:
    """(name, pos, n, first, next): each row's number, its name's first number, and the number at which a part that begins here is over; 0 where that is the name's end."""
    numbered = runnings(rows.withColumn("one", F.lit(1).cast("long")), {"n": "one", "upto": "tokens"}, "name", "pos", "tokens")
    placed = stored(numbered, "placed")
    spent(numbered)
    ends = placed.groupBy("name").agg(F.min("n").alias("first"), F.max("n").alias("last"))
    # How many sums are at most a row's own start plus the budget: sums stand before starts of equal value.
    sums = placed.select("name", "pos", "n", F.col("upto").alias("at"), F.lit(1).cast("long").alias("sum"))
    starts = placed.select("name", "pos", "n", (F.col("upto") - F.col("tokens") + budget).alias("at"), F.lit(0).cast("long").alias("sum"))
    searched = runnings(sums.unionByName(starts), {"fit": "sum"}, "at", F.desc("sum"), "n")
    found = searched.where("sum = 0").alias("f").join(ends.alias("e"), F.col("f.name").eqNullSafe(F.col("e.name")))
    after = F.greatest(F.col("fit") + 1, F.col("n") + 2)
    out = stored(found.select("f.name", "pos", "n", "first", F.when(after <= F.col("last"), after).otherwise(0).alias("next")), "successors")
    spent(placed, searched)
    return out


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """(n, next) -> (n, exit): where the walk from each row leaves the block; 0 where it ends there."""
    rows = rows.sort_values("n")
    n, to = rows["n"].to_numpy(), rows["next"].tolist()
    base, size = int(n[0]), len(n)
    for i in range(size - 1, -1, -1):
        if base < to[i] < base + size:
            to[i] = to[to[i] - base]
    return pd.DataFrame({"n": n, "exit": np.array(to, np.int64)})


def _begun(rows: pd.DataFrame) -> pd.DataFrame:
    """(n, next, begins) -> (n): rows of a block that begin a part, by the walks from those that are known to."""
    rows = rows.sort_values("n")
    n, to, begins = rows["n"].to_numpy(), rows["next"].tolist(), rows["begins"].tolist()
    base, size = int(n[0]), len(n)
    for i in range(size):
        if begins[i] and base < to[i] < base + size:
            begins[to[i] - base] = True
    return pd.DataFrame({"n": n[np.array(begins, bool)]})


def _entries(walks: DataFrame) -> DataFrame:
    """(n): rows at which the walks from all names' first rows enter a block. walks: (n, first, exit) of all rows."""
    left_to = walks.where("exit > 0").select(F.col("exit").alias("n")).distinct()
    jumps = stored(walks.where("exit > 0").join(left_to, "n", "left_semi").select("n", F.col("exit").alias("to")), "jumps")
    passed = stored(walks.where("n = first and exit > 0").select(F.col("exit").alias("n")).distinct(), "passed")
    # After k rounds all rows within 2^k jumps are marked, and a jump spans as many.
    while jumps.limit(1).count():
        before = passed, jumps
        passed = stored(passed.unionByName(passed.join(jumps, "n").select(F.col("to").alias("n"))).distinct(), "passed")
        jumps = stored(jumps.alias("a").join(jumps.alias("b"), F.col("a.to") == F.col("b.n")).select("a.n", "b.to"), "jumps")
        spent(*before)
    spent(jumps)
    return passed


def pack_groups(descriptions: DataFrame, budget: int, block: int = BLOCK) -> DataFrame:
    """(name, pos, part) of ``descriptions(name, pos, tokens)``: consecutive rows, by pos, packed greedily into parts of at most ``budget`` tokens, two a part at least.

    Rows of equal pos follow each other by tokens; null or negative tokens count
    as none; a null name is a name, a null pos comes first. Other columns are
    ignored, and an empty table gives none.
    """
    rows = descriptions.select("name", F.col("pos").cast("long").alias("pos"), F.greatest(F.coalesce(F.col("tokens").cast("long"), F.lit(0)), F.lit(0)).alias("tokens"))
    successors = _successors(rows, budget)
    linked = successors.withColumn("block", F.floor((F.col("n") - 1) / block))
    exits = linked.select("block", "n", "next").groupBy("block").applyInPandas(_exits, "n long, exit long")
    walks = stored(linked.select("n", "first").join(exits, "n"), "walks")
    entries = _entries(walks)
    known = linked.join(entries.withColumn("_in", F.lit(True)), "n", "left").withColumn("begins", F.col("_in").isNotNull() | (F.col("n") == F.col("first")))
    begun = known.select("block", "n", "next", "begins").groupBy("block").applyInPandas(_begun, "n long")
    flagged = linked.join(begun.withColumn("_in", F.lit(1).cast("long")), "n", "left").select("name", "pos", "n", "first", F.coalesce("_in", F.lit(0)).alias("begins"))
    counted = runnings(flagged, {"begun": "begins"}, "n")
    told = stored(counted, "parts")
    spent(successors, walks, entries, counted)
    base = told.where("n = first").select("first", F.col("begun").alias("base"))
    return told.join(base, "first").select("name", "pos", (F.col("begun") - F.col("base")).alias("part"))
