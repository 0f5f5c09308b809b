"""Routers whose decisions depend on all before them, over whole streams.

A decision needs the state that the arrivals before it left, so a stream is cut into ranges of arrivals:

* The calibrated routers' state is the sizes of groups relative to the least one. All ranges are folded at
  once from a guessed state. A range whose true entry state, the exit state of the range before it, differs from the
  one it was folded from is folded again, until none is left. Picks go to the least group, so two states that
  meet the same arrivals soon become one, and a second round mostly finds nothing to do.
* The adaptive router changes its table of buckets only between windows. Stretches without a
  change are found and counted in parallel, blocks of windows with one are folded, a block a task, from
  counts by window and bucket.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.murmur import murmur
from .frames import checkpoint_dir, cut, running, with_rank
from .routing import SALT, bucket, pure_hash, snake_map


def _fold(groups: int, assign: bool):
    """A range's arrivals (part, i, base, pick) from its entry state: its exit state, or a group for each arrival."""

    def run(rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        count, out = [int(x) for x in entry["entry"].iloc[0]], []
        for base, pick in zip(rows["base"].tolist(), rows["pick"].tolist()):
            g = count.index(min(count)) if pick else base
            count[g] += 1
            out.append(g)
        if assign:
            return pd.DataFrame({"i": rows["i"], "group_id": np.array(out, np.int32)})
        least = min(count)
        return pd.DataFrame({"part": [int(rows["part"].iloc[0])], "entry": [entry["entry"].iloc[0]], "exit": [[x - least for x in count]]})

    return run


def fold_ranges(arrivals: DataFrame, groups: int = 10, size: int = 100_000, guess: list[int] | None = None) -> DataFrame:
    """arrivals: (i, base, pick), i the place from 0 without gaps. Returns (i, group_id): a picked arrival goes to the
    smallest group so far, of equals the first, others to base. A task folds `size` arrivals; states are a row a range."""
    rows = cut(arrivals.select(F.floor(F.col("i") / size).alias("part"), "i", "base", "pick"))
    start = F.array(*[F.lit(0).cast("long")] * groups)
    guessed = F.when(F.col("part") == 0, start).otherwise(F.array(*[F.lit(int(x)).cast("long") for x in guess]) if guess else start)

    def fold(todo: DataFrame, assign: bool, schema: str) -> DataFrame:
        todo = todo.select(F.col("part").alias("_p"), "entry")
        own = rows.join(todo.select(F.col("_p").alias("_q")), F.col("part") == F.col("_q"), "left_semi")
        return own.groupBy("part").cogroup(todo.groupBy("_p")).applyInPandas(_fold(groups, assign), schema)

    state = "part long, entry array<long>, exit array<long>"
    known = cut(fold(rows.select("part").distinct().withColumn("entry", guessed), False, state))
    while True:
        before = known.select((F.col("part") + 1).alias("part"), F.col("exit").alias("right"))
        wrong = cut(known.join(before, "part").filter("entry <> right").select("part", F.col("right").alias("entry")))
        if not wrong.limit(1).count():
            break
        again = fold(wrong, False, state)
        known = cut(known.join(wrong, "part", "left_anti").unionByName(again))
    return fold(known.select("part", "entry"), True, "i long, group_id int")


def _routed(arrivals: DataFrame, base: Column, pick: Column, groups: int, size: int, guess: list[int] | None) -> DataFrame:
    ranked = cut(arrivals.withColumns({"_base": base.cast("int"), "_pick": pick}))
    found = fold_ranges(ranked.select(F.col("k").alias("i"), F.col("_base").alias("base"), F.col("_pick").alias("pick")), groups, size, guess)
    return ranked.drop("_base", "_pick").join(found.withColumnRenamed("i", "k").hint("merge"), "k")


def calibrated_route(arrivals: DataFrame, order: list[str], groups: int = 10, buckets: int = 1000, salt: str = SALT, user: str = "user_id", size: int = 100_000, guess: list[int] | None = None) -> DataFrame:
    """Adds k and group_id: the hash's group, but arrivals (after the first) of calibration group 0 go to the smallest group so far."""
    pick = (murmur(user, F.lit(salt), F.lit("calib")) % 1000 % groups == 0) & (F.col("k") > 0)
    return _routed(with_rank(arrivals, order), pure_hash(user, salt, buckets, groups), pick, groups, size, guess)


def _share(user: str, salt: str, share: float) -> Column:
    return murmur(F.lit(salt), F.col("k").cast("string"), user) / float(2**32) < share


def share_calibrated_route(arrivals: DataFrame, order: list[str], groups: int = 10, share: float = 0.7, salt: str = SALT, user: str = "user_id", size: int = 100_000, guess: list[int] | None = None) -> DataFrame:
    """Adds k and group_id: a share of arrivals, chosen by hash, goes to the smallest group so far, others to their hash's."""
    return _routed(with_rank(arrivals, order), murmur(user, F.lit(salt)) % groups, _share(user, salt, share), groups, size, guess)


def sticky_route(arrivals: DataFrame, order: list[str], groups: int = 10, share: float = 0.7, buckets: int = 1000, salt: str = SALT, user: str = "user_id", size: int = 100_000, guess: list[int] | None = None) -> DataFrame:
    """Adds k and group_id: share_calibrated_route for a user's first arrival, whose group later ones keep."""
    ranked = cut(with_rank(arrivals, order))
    first = ranked.groupBy(user).agg(F.min("k").alias("k")).withColumns({"base": pure_hash(user, salt, buckets, groups).cast("int"), "pick": _share(user, salt, share)})
    first = cut(with_rank(first, ["k"], "i"))
    found = fold_ranges(first, groups, size, guess)
    return ranked.join(first.select(user, "i").join(found.hint("merge"), "i").select(user, "group_id").hint("merge"), user)


class _Adaptive:
    """The adaptive router's state: a number or two a bucket and a group."""

    def __init__(self, group_of: list[int], place: list[int], groups: int, limit: float):
        self.group_of, self.place, self.groups, self.limit = list(group_of), place, groups, limit
        self.seen, self.count, self.met = [0] * len(group_of), [0] * groups, []

    def add(self, cells: list[tuple[int, int, int, int]]) -> None:
        """cells: (bucket, events, new users, first place) of some windows."""
        first: dict[int, int] = {}
        for b, n, new, k in cells:
            g = self.group_of[b]
            self.count[g] += n
            self.seen[b] += new
            first[g] = min(k, first.get(g, k))
        self.met += sorted((g for g in first if g not in self.met), key=first.get)  # of equal groups the one met first counts

    def check(self) -> bool:
        """At the end of a window: buckets move from the largest to the smallest group if it is over the limit."""
        mean = sum(self.count) / self.groups
        hi, lo = max(self.met, key=self.count.__getitem__), min(self.met, key=self.count.__getitem__)
        if mean <= 0 or abs(self.count[hi] - mean) / mean < self.limit:
            return False
        own = sorted((b for b, g in enumerate(self.group_of) if g == hi and self.seen[b] > 1), key=lambda b: (-self.seen[b], self.place[b]))
        own = own[: int(mean * self.limit / 0.5)]
        for b in own:
            self.group_of[b] = lo
        if own:  # the sizes are patched by the last bucket's users times the buckets moved
            step = self.seen[own[-1]] * len(own)
            self.count[hi] -= step
            self.count[lo] += step
        return bool(own)


def adaptive_route(arrivals: DataFrame, order: list[str], groups: int = 10, buckets: int = 1000, window: int = 500, limit: float = 0.05, salt: str = SALT, user: str = "user_id", block: int = 2000) -> DataFrame:
    """Adds k, w (the window) and group_id: buckets start dealt by their users, and move between groups
    at the end of each window of arrivals that finds the largest group over the mean by the limit.

    A block of windows with a change is folded by one task, which sees at most a row a window and bucket;
    what the driver holds between steps is the state, a few numbers a bucket and group.
    """
    spark = arrivals.sparkSession
    ranked = with_rank(arrivals, order).withColumns({"w": F.floor(F.col("k") / window), "_b": bucket(user, salt, buckets).cast("int")})
    ranked = cut(ranked)
    first = ranked.groupBy(user, "_b").agg(F.min("k").alias("k"))
    fresh = first.groupBy(F.floor(F.col("k") / window).alias("w"), "_b").agg(F.count("*").alias("new"))
    cells = cut(ranked.groupBy("w", "_b").agg(F.count("*").alias("n"), F.min("k").alias("first")).join(fresh.hint("merge"), ["w", "_b"], "left").fillna(0, ["new"]))
    deal = snake_map(first.groupBy(F.col("_b").cast("long").alias("bucket")).agg(F.count("*").alias("n")), buckets, groups).orderBy("bucket").collect()  # a row a bucket
    place = {r["bucket"]: i for i, r in enumerate(sorted(deal, key=lambda r: (r["group_id"], -r["n"], r["bucket"])))}
    state = _Adaptive([r["group_id"] for r in deal], [place[b] for b in range(buckets)], groups, limit)
    n, last = ranked.count(), cells.agg(F.max("w")).first()[0]
    if last is None:
        return ranked.drop("_b").withColumn("group_id", F.lit(None).cast("int"))
    whole = n // window  # windows that are full and so end with a check
    folder, step, w, span = f"{checkpoint_dir(spark)}/adaptive-{uuid.uuid4().hex}", 0, 0, block
    schema = "kind int, w long, bucket int, group int, value long, place long"

    def fold(own: _Adaptive):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            out, wide = [], pdf.sort_values(["w", "first"])
            for w, one in wide.groupby("w", sort=True):
                out += [(0, w, b, own.group_of[b], 0, 0) for b in one["_b"].tolist()]
                own.add(list(zip(one["_b"].tolist(), one["n"].tolist(), one["new"].tolist(), one["first"].tolist())))
                if w < whole:
                    own.check()
            out += [(1, 0, b, g, own.seen[b], 0) for b, g in enumerate(own.group_of)]
            out += [(2, 0, 0, g, own.count[g], own.met.index(g) if g in own.met else -1) for g in range(groups)]
            return pd.DataFrame(out, columns=["kind", "w", "bucket", "group", "value", "place"])

        return run

    while w <= last:
        # the first window of the stretch that would change something under the table as it is
        table = spark.createDataFrame([(b, g) for b, g in enumerate(state.group_of)], "_b int, group int")
        held = spark.createDataFrame([(g, c) for g, c in enumerate(state.count)], "group int, had long")
        stretch = cells.filter((F.col("w") >= w) & (F.col("w") < w + span)).join(F.broadcast(table), "_b")  # a row a bucket
        per = stretch.groupBy("w", "group").agg(F.sum("n").alias("n"))
        grid = per.select("w").distinct().join(F.broadcast(held))  # a row a group
        sizes = running(grid.join(per, ["w", "group"], "left").fillna(0, ["n"]), ["w"], {"_c": F.col("n")}, ["group"])
        total = sizes.groupBy("w").agg(F.max(F.col("had") + F.col("_c") + F.col("n")).alias("top"), F.sum(F.col("had") + F.col("_c") + F.col("n")).alias("all"))
        over = total.filter((F.col("w") < whole) & (F.abs(F.col("top") - F.col("all") / groups) / (F.col("all") / groups) >= limit))
        at = over.agg(F.min("w")).first()[0]
        quiet = min(w + span, last + 1) if at is None else w + (at - w) // block * block
        if quiet > w:
            calm = stretch.filter(F.col("w") < quiet)
            state.add([tuple(r) for r in calm.groupBy("_b").agg(F.sum("n"), F.sum("new"), F.min("first")).collect()])  # a row a bucket
            calm.select(F.lit(0).alias("kind"), "w", F.col("_b").alias("bucket"), "group", F.lit(0).cast("long").alias("value"), F.lit(0).cast("long").alias("place")).write.parquet(f"{folder}/step={step}")
            step, w, span = step + 1, quiet, span * 2
        if at is not None:
            one = cells.filter((F.col("w") >= w) & (F.col("w") < w + block)).groupBy(F.lit(0).alias("_all")).applyInPandas(fold(state), schema)
            one.write.parquet(f"{folder}/step={step}")
            for r in spark.read.schema(schema).parquet(f"{folder}/step={step}").filter("kind > 0").orderBy("kind", "place").collect():  # a row a bucket and group
                if r["kind"] == 1:
                    state.group_of[r["bucket"]], state.seen[r["bucket"]] = r["group"], r["value"]
                else:
                    state.count[r["group"]] = r["value"]
                    if r["place"] >= 0 and r["group"] not in state.met:
                        state.met.append(r["group"])
            step, w, span = step + 1, w + block, block
    routed = spark.read.schema(schema).parquet(folder).filter("kind = 0").select("w", F.col("bucket").alias("_b"), F.col("group").alias("group_id"))
    # its files are small for a row a window and bucket: Spark's own choice would broadcast them
    return ranked.join(routed.hint("merge"), ["w", "_b"]).drop("_b")
