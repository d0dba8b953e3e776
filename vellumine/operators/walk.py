"""Greedy walks over ranked items, for many keys at once: each choice depends on those before it.

The walk of a key is a row of a table: what it has chosen, in which phase it is and where it stands.
A round joins these rows with the items that the quotas still admit and that come after, keeps the
best ``window`` of each key (a limit within groups, so no key is gathered), and lets each key go on
through them in a task of its own.  Keys that have chosen enough, or that have no items left in their
last phase, are done; only the others take part in the next round.  Quotas only close within
a phase, so what a phase has passed over it needn't look at again.  The driver sees how many keys
go on, nothing else; a task holds a window and what one key has chosen.
"""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Callable, Sequence
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Similarity of fingerprints that are near, and least length of which that is asked.
NEAR, LONG = 0.92, 80


def cut_lineage(rows: DataFrame) -> DataFrame:
    """``rows`` from a checkpoint in the folder of ``spark.checkpoint.dir``; a temporary one only where Spark runs on this machine alone."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="vellumine-walk-"))
    return rows.checkpoint()


def alike(a: str, b: str) -> bool:
    """Whether two fingerprints are equal, or long and near; cheap bounds of the similarity are asked first."""
    if a == b:
        return True
    if len(a) < LONG or len(b) < LONG:
        return False
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= NEAR and m.quick_ratio() >= NEAR and m.ratio() >= NEAR


def _named(value) -> bool:
    return value is not None and value != "" and value == value  # noqa: PLR0124  not NaN


def walked(
    items: DataFrame, key: str, groups: Sequence[str], quotas: Sequence[Sequence[int | None]], limit: int, window: int, admits: Callable[[list[Counter], dict, int], bool] | None = None
) -> DataFrame:
    """(key, candidate_id, place) of what each key chooses of items (key, candidate_id, score, groups[, print]).

    Items come by score (missing ones last), then identifier.  ``quotas``: for each phase how often a value of each
    group may be chosen; None: any number.  Values that are missing or empty have no quota.  ``admits`` may
    refuse an item by the counts so far.  With a ``print`` an item near to a chosen one is passed over.
    """
    types, with_print = dict(items.dtypes), "print" in items.columns
    held = f"array<struct<id: {types['candidate_id']}, {''.join(f'{g}: {types[g]}, ' for g in groups)}print: string>>"
    shape = f"key {types[key]}, chosen {held}, phase int, fresh boolean, last_score double, last {types['candidate_id']}, {''.join(f'shut_{g} array<{types[g]}>, ' for g in groups)}done boolean"
    none = F.array().cast(held)
    state = items.select(F.col(key).alias("key")).distinct().select(
        "key", none.alias("chosen"), F.lit(0).alias("phase"), F.lit(True).alias("fresh"), F.lit(None).cast("double").alias("last_score"), F.lit(None).cast(types["candidate_id"]).alias("last"),
        *(F.array().cast(f"array<{types[g]}>").alias(f"shut_{g}") for g in groups), F.lit(limit <= 0).alias("done"),
    )

    def go_on(own: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
        walk = own.iloc[0].to_dict()
        chosen, phase = [dict(x.asDict() if hasattr(x, "asDict") else x) for x in walk["chosen"]], int(walk["phase"])
        counts = [Counter(x[g] for x in chosen if _named(x[g])) for g in groups]
        fresh, last_score, last = walk["fresh"], walk["last_score"], walk["last"]
        for row in best.sort_values("rank").to_dict("records"):
            fresh, last_score, last = False, row["score"], row["candidate_id"]
            if any(most is not None and _named(row[g]) and c[row[g]] >= most for c, g, most in zip(counts, groups, quotas[phase], strict=True)):
                continue
            if (admits and not admits(counts, row, phase)) or any(x["id"] == row["candidate_id"] for x in chosen):
                continue
            if with_print and any(alike(row["print"], x["print"]) for x in chosen):
                continue
            chosen.append({"id": row["candidate_id"], **{g: row[g] if _named(row[g]) else None for g in groups}, "print": row["print"] if with_print else None})
            for c, g in zip(counts, groups, strict=True):
                if _named(row[g]):
                    c[row[g]] += 1
            if len(chosen) == limit:
                break
        if len(chosen) < limit and len(best) < window:
            phase, fresh, last_score, last = phase + 1, True, None, None
        done = len(chosen) >= limit or phase == len(quotas)
        shut = {f"shut_{g}": [[v for v, n in c.items() if not done and quotas[phase][i] is not None and n >= quotas[phase][i]]] for i, (g, c) in enumerate(zip(groups, counts, strict=True))}
        return pd.DataFrame({"key": [walk["key"]], "chosen": [chosen], "phase": [phase], "fresh": [fresh], "last_score": [last_score], "last": [last], **shut, "done": [done]})

    slim = items.persist(StorageLevel.DISK_ONLY)
    finished = []
    while True:
        going = state.where("NOT done")
        same = F.col(key).eqNullSafe(F.col("key"))
        after = F.col("fresh") | (F.col("score") < F.col("last_score")) | (F.col("score").isNull() & F.col("last_score").isNotNull())
        after = after | (F.col("score").eqNullSafe(F.col("last_score")) & (F.col("candidate_id") > F.col("last")))
        free = after & ~F.array_contains(F.transform("chosen", lambda x: x["id"]), F.col("candidate_id"))
        for g in groups:
            free = free & (F.col(g).isNull() | (F.col(g).cast("string") == "") | ~F.array_contains(f"shut_{g}", F.col(g)))
        rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc_nulls_last("score"), F.asc("candidate_id")))
        best = slim.join(going, same).where(free).select("key", "candidate_id", "score", *groups, *(["print"] if with_print else [])).withColumn("rank", rank).where(F.col("rank") <= window)
        # a struct is never null, so a missing key is a key too
        by = lambda rows, name: rows.groupBy(F.struct(F.col(name).alias("key")).alias("of"))
        best = best.withColumn("of_key", F.col("key")).drop("key")
        state = cut_lineage(by(going, "key").cogroup(by(best, "of_key")).applyInPandas(lambda own, best: go_on(own, best), shape))
        finished.append(state.where("done"))
        if state.where("NOT done").isEmpty():
            break
    slim.unpersist()
    rows = reduce(DataFrame.unionByName, finished)
    return rows.select(F.col("key").alias(key), F.posexplode("chosen").alias("place", "x")).select(key, F.col("x.id").alias("candidate_id"), (F.col("place") + 1).cast("long").alias("place"))
