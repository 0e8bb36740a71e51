"""Leakage-free split: whole source groups, exact quotas by class, copies with their parent.

Groups of one size are alike to the rule, so a class is dealt as a histogram of sizes. The rule gives the
largest groups first, each to the emptiest partition relative to its target among those that it fits; over
groups of one size this merges three falling arithmetic sequences, of which any place can be worked out
alone. Where the rule would end without a fit, every group goes to the emptiest partition that leaves the
rest one, as told by a table of what the smaller sizes can fill (subset sums).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotable.sources.scratch import Tables

SPLITS = ("train", "val", "test")
RATIOS = (0.7, 0.15, 0.15)
#: Cells of a table of subset sums; beyond, larger groups are dealt by the rule until the rest has that few.
CELLS = 1 << 19
_FREE = 1 << 62


def quotas(n: Column) -> list[Column]:
    """Train, validation and test counts of ``n`` clips: the shares rounded half to even, the rest to test."""
    train, val = (F.bround(n * share).cast("long") for share in RATIOS[:2])
    return [train, val, n - train - val]


class Turns:
    """Picks of groups of one size: partition s takes its j-th group at emptiness ``(room[s] - j * size) / target[s]``.

    Fuller partitions wait; of equals the earlier one goes first. A partition takes as many as fit, or
    without ``fits`` any number.
    """

    def __init__(self, size: int, room: list[int], target: list[int], fits: bool = True):
        self.size, self.room, self.target = size, room, target
        self.most = [max(0, r) // size if t > 0 else 0 for r, t in zip(room, target)] if fits else [_FREE] * len(room)

    def place(self, s: int, j: np.ndarray) -> np.ndarray:
        """Turns, from 0, at which partition s takes its j-th groups: those of the others that come before."""
        level, before = self.room[s] - j * self.size, j
        for o, (room, target) in enumerate(zip(self.room, self.target)):
            if o != s and self.most[o]:
                # groups i of o with (room - i * size) * target[s] over level * target (or equal, for earlier partitions)
                ahead, step = room * self.target[s] - level * target, self.size * self.target[s]
                before = before + np.clip(ahead // step + 1 if o < s else -(-ahead // step), 0, self.most[o])
        return before

    def taken(self, turns: np.ndarray) -> list[np.ndarray]:
        """Groups that each partition has after so many turns."""
        large = max(map(abs, self.room)) + self.size * int(turns.max(initial=0))
        turns = turns.astype(object if 2 * large * max(self.target) >= _FREE else np.int64)
        out = []
        for s, most in enumerate(self.most):
            low, high = turns * 0, np.minimum(turns, most)
            while (open_ := low < high).any():
                mid = (low + high) // 2
                more = open_ & (self.place(s, mid) < turns)
                low, high = np.where(more, mid + 1, low), np.where(open_ & ~more, mid, high)
            out.append(low)
        return out

    def total(self, turns: int) -> list[int]:
        return [int(x[0]) for x in self.taken(np.array([turns]))]

    def at(self, turns: np.ndarray) -> np.ndarray:
        """Partition of each turn: the one that it adds a group to."""
        before, after = self.taken(turns), self.taken(turns + 1)
        return np.argmax(np.array(after) > np.array(before), axis=0)


def fills(sizes: list[int], counts: list[int], width: int, height: int) -> list[np.ndarray]:
    """For each i, the fewest groups of size i by which they and all smaller ones make a fill (of two partitions, up to width and height); over their count where none do."""
    made = np.zeros((width + 1, height + 1), bool)
    made[0, 0] = True
    out = []
    for size, count in zip(reversed(sizes), reversed(counts)):
        used = np.where(made, 0, count + 1).astype(np.int32)
        for a in range(size, width + 1):
            used[a] = np.minimum(used[a], used[a - size] + 1)
        for b in range(size, height + 1):
            used[:, b] = np.minimum(used[:, b], used[:, b - size] + 1)
        made = used <= count
        out.append(used)
    return out[::-1]


def deal(sizes: list[int], counts: list[int], target: list[int], room: list[int], on_overflow: str = "error") -> list[dict]:
    """How the ``counts[i]`` groups of ``sizes[i]`` clips, sizes falling, are dealt to partitions with ``room`` left.

    Each entry holds ``turns`` (a list of ``(n, Turns)``) or ``listed`` (partitions by place). Where no fit is
    found it is an error, or with ``largest_room`` groups that fit nowhere go to the roomiest.
    """
    by_rule, left, fits = [], list(room), True
    for size, count in zip(sizes, counts):
        turns = Turns(size, list(left), target)
        n = min(count, sum(turns.most))
        steps = [(n, turns)]
        left = [r - size * k for r, k in zip(left, turns.total(n))]
        if n < count:
            fits = False
            over = Turns(size, list(left), [1] * len(left), fits=False)
            steps.append((count - n, over))
            left = [r - size * k for r, k in zip(left, over.total(count - n))]
        by_rule.append({"turns": steps})
    if fits:
        return by_rule
    exact = _look_ahead(sizes, counts, target, list(room))
    if exact is None and on_overflow == "error":
        raise ValueError(f"groups of {sizes} clips, {counts} of each, fit no partitions of {room}")
    return by_rule if exact is None else exact


def _look_ahead(sizes: list[int], counts: list[int], target: list[int], room: list[int]) -> list[dict] | None:
    """Every group to the emptiest partition that leaves the rest a fit; None without one."""
    if min(room) < 0 or sum(s * c for s, c in zip(sizes, counts)) != sum(room):
        return None
    out, first = [], 0
    while (room[1] + 1) * (room[2] + 1) > CELLS and first < len(sizes):
        turns = Turns(sizes[first], list(room), target)
        n = min(counts[first], sum(turns.most))
        if n < counts[first]:
            return None
        room = [r - sizes[first] * k for r, k in zip(room, turns.total(n))]
        out.append({"turns": [(n, turns)]})
        first += 1
    rest = fills(sizes[first:], counts[first:], room[1], room[2])
    if not rest or rest[0][room[1], room[2]] > counts[first]:
        return None if rest or any(room) else out
    for used, size, count in zip(rest, sizes[first:], counts[first:]):
        listed = []
        for others in reversed(range(count)):  # groups of this size still to come
            after = {s: [r - size * (o == s) for o, r in enumerate(room)] for s in range(3) if room[s] >= size}
            leave = [s for s, x in after.items() if used[x[1], x[2]] <= others]
            s = max(leave, key=lambda s: (room[s] / max(target[s], 1), -s))
            room = after[s]
            listed.append(s)
        out.append({"listed": listed})
    return out


def _dealer(on_overflow: str):
    """Of one class: where each slice's groups of a size begin, and by what their partitions are worked out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "slice"], ascending=[False, True])
        pdf["start"] = pdf.groupby("size", sort=False)["n"].cumsum() - pdf["n"]
        n = pdf.groupby("size", sort=False)["n"].sum()
        target = [int(x) for x in pdf.quota.iloc[0]]
        room = [target[0] - int(pdf.taken.iloc[0]), *target[1:]]
        dealt = dict(zip(n.index, deal(n.index.tolist(), n.tolist(), target, room, on_overflow)))
        steps = {size: [[k, *t.room, *t.target, int(t.most[0] == _FREE)] for k, t in d.get("turns", [])] for size, d in dealt.items()}
        pdf["steps"] = [steps[s] for s in pdf["size"]]
        pdf["listed"] = [dealt[s].get("listed", []) for s in pdf["size"]]
        return pdf[["class_label", "size", "slice", "start", "steps", "listed"]]

    return run


def _partition(at: pd.Series, size: pd.Series, steps: pd.Series, listed: pd.Series) -> pd.Series:
    """Partition of each group from its place and what its class and size were dealt by; alike groups are worked out together."""
    out = np.full(len(at), -1, np.int64)
    alike: dict[tuple, list] = {}
    for i, (place, z, turns, named) in enumerate(zip(at, size, steps, listed)):
        if len(named):
            out[i] = named[place]
            continue
        for step in turns:
            if place < step[0]:
                alike.setdefault((int(z), *map(int, step)), []).append((i, int(place)))
                break
            place -= step[0]
    for (z, _, *x), rows in alike.items():
        i, place = np.array(rows).T
        out[i] = Turns(z, x[:3], x[3:6], not x[6]).at(place)
    return pd.Series(out).astype("int32")


def split(manifest: DataFrame, seed: int = 42, on_overflow: str = "error") -> DataFrame:
    """``(audio_id, class_label, role, group, split)`` of every clip; ``role`` is 'original', or its clip follows its parent.

    Only the number of groups of each size is gathered by class, in 256 slices of the hash range; a group's
    place among those of its class and size, in hash order, gives its partition, so no window holds a
    whole class. A group of several labels goes to train first. An original without a group is one
    of its own. A copy without a parent among the originals, or of another label than its, is an error.
    """
    tables = Tables(manifest.sparkSession, "split")
    own = F.coalesce("source_group", F.concat(F.lit("clip:"), "audio_id"))
    originals = manifest.where("role = 'original'").select("audio_id", "class_label", "role", own.alias("group"))
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), "group"), 256)
    by = originals.groupBy("group", "class_label").agg(F.count("*").alias("size"))
    labels = F.count("*").over(Window.partitionBy("group"))
    groups = tables.save(by.withColumn("mixed", labels > 1).withColumn("order", order).withColumn("slice", F.substring("order", 1, 2)))
    slices = groups.groupBy("class_label", "mixed", "size", "slice").agg(F.count("*").alias("n"))
    total = slices.groupBy("class_label").agg(F.sum(F.col("n") * F.col("size")).alias("clips"), F.sum(F.when(F.col("mixed"), F.col("n") * F.col("size")).otherwise(0)).alias("taken"))
    slices = slices.where("not mixed").join(total, "class_label").select("class_label", "size", "slice", "n", "taken", F.array(*quotas(F.col("clips"))).alias("quota"))
    dealt = slices.groupBy("class_label").applyInPandas(_dealer(on_overflow), "class_label string, size long, slice string, start long, steps array<array<long>>, listed array<int>")
    within = F.row_number().over(Window.partitionBy("class_label", "size", "slice").orderBy("order", "group")) - 1
    placed = groups.where("not mixed").withColumn("at", within).join(dealt, ["class_label", "size", "slice"])
    name = F.element_at(F.array(*[F.lit(s) for s in SPLITS]), F.pandas_udf(_partition, "int")(F.col("start") + F.col("at"), "size", "steps", "listed") + 1)
    placed = placed.select("group", "class_label", name.alias("split"))
    placed = placed.unionByName(groups.where("mixed").select("group", "class_label", F.lit(SPLITS[0]).alias("split")))
    first = tables.save(originals.join(placed, ["group", "class_label"]).select("audio_id", "class_label", "role", "group", "split"))
    parents = first.select(F.col("audio_id").alias("parent_audio_id"), F.col("class_label").alias("_label"), "group", "split")
    kids = manifest.where("role is null or role <> 'original'").select("audio_id", "class_label", "role", "parent_audio_id").join(parents, "parent_audio_id", "left")
    wrong = F.when(F.col("split").isNull(), "has no parent among the originals").when(~F.col("class_label").eqNullSafe(F.col("_label")), "has another label than its parent")
    fault = F.raise_error(F.concat(F.coalesce("audio_id", F.lit("null")), F.lit(" "), wrong)).cast("string")
    kids = kids.select("audio_id", "class_label", "role", "group", F.when(wrong.isNotNull(), fault).otherwise(F.col("split")).alias("split"))
    return first.unionByName(kids)


def split_counts(assigned: DataFrame, tolerance: int = 1) -> DataFrame:
    """Originals of each class by partition against the quotas."""
    counts = assigned.where("role = 'original'").groupBy("class_label").pivot("split", list(SPLITS)).count().na.fill(0, list(SPLITS))
    n = F.col("train") + F.col("val") + F.col("test")
    near = [F.abs(F.col(s) - q) <= tolerance for s, q in zip(SPLITS, quotas(n))]
    return counts.withColumn("ok", near[0] & near[1] & near[2])
