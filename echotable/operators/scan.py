"""Ordered folds of sessions of any length: parts of a session are folded at once, and their effects combined.

Rows are range-partitioned by session and time into parts of bounded size, so that a hot session spreads over
many. A part that ends in another session than it begins with leaves a state that doesn't depend on what
came before. For a part within one session the fold states its effect as a map from the state before
to the state after; maps are followed along the session, and every part then runs once with the
state that it begins with. A fold without such maps starts from guesses: parts whose true state before differs from the
guessed one run again, until none does.

Within a part a fold works on whole arrays.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotable.sources.scratch import Tables

#: Rows of a part, and parts at most (one small row of each comes to the driver).
PART, PARTS = 200_000, 20_000


class Streaks:
    """Repeat confirmation. State: class, windows on record, time of the last one, and whether the streak has fired.

    A window that doesn't qualify or is of another class ends a streak; so does a gap, unless no window is on
    record, as right after the streak has fired.
    """

    start = (False, 0, 0.0, False)

    def __init__(self, needed: int, seconds: float):
        self.needed, self.seconds = needed, seconds

    def run(self, state: tuple, session: np.ndarray, at: np.ndarray, name: np.ndarray, ok: np.ndarray) -> tuple[dict, tuple]:
        """Counts and flags of each row, and the state after the last. ``state`` is that before the first row."""
        n = len(at)
        out = {"consecutive": np.zeros(n, np.int64), "confirmed": np.zeros(n, bool), "newly_confirmed": np.zeros(n, bool)}
        rows = np.flatnonzero(ok)
        if not len(rows):
            return out, self.start
        # runs: neighbouring qualifying rows of one session and class; segments: runs cut at gaps
        joined = np.zeros(len(rows), bool)
        joined[1:] = (np.diff(rows) == 1) & (session[rows[1:]] == session[rows[:-1]]) & (name[rows[1:]] == name[rows[:-1]])
        gap = np.zeros(len(rows), bool)
        gap[1:] = at[rows[1:]] - at[rows[:-1]] > self.seconds
        first = np.flatnonzero(~joined | gap)
        size = np.diff(np.append(first, len(rows)))
        kind, n0, last, fired = state
        carried = rows[0] == 0 and kind is not False and kind == name[0] and not (n0 and at[0] - last > self.seconds)
        before = np.zeros(len(first), np.int64)
        before[0] = n0 if carried else 0
        # a segment that ends on the window that fires is followed across the gap; such ones alternate
        full = size + before == self.needed
        full[0] &= not (carried and fired)
        follows = np.append(False, full[:-1]) & joined[first]
        follows[0] = carried and fired
        base = np.maximum.accumulate(np.where(np.append(True, ~(full[:-1] & joined[first[1:]])), np.arange(len(first)), 0))
        over = ((np.arange(len(first)) - base) % 2 == 1) ^ (follows[0] & (base == 0))
        count = np.arange(len(rows)) - np.repeat(first, size) + 1 + np.repeat(before, size)
        over = np.repeat(over, size)
        after = ~over & (count > self.needed)
        out["consecutive"][rows] = np.where(after, count - self.needed, count)
        out["confirmed"][rows] = over | (count >= self.needed)
        out["newly_confirmed"][rows] = ~over & (count == self.needed)
        if rows[-1] != n - 1:
            return out, self.start
        newly = bool(out["newly_confirmed"][-1])
        return out, (name[-1], 0 if newly else int(out["consecutive"][-1]), float(at[-1]), bool(out["confirmed"][-1]))

    def effect(self, session, at, name, ok) -> dict:
        """The state after for each kind of state before: fresh, 1 to needed - 1 windows, or fired with any number."""
        ends = [self.run((name[0], k, at[0], False), session, at, name, ok)[1] for k in range(self.needed)]
        fired = self.run((name[0], 0, at[0], True), session, at, name, ok)[1]
        more = self.run((name[0], 1, at[0], True), session, at, name, ok)[1]
        return {"name": name[0] if ok[0] else False, "at": float(at[0]), "ends": ends, "fired": fired, "adds": more[1] != fired[1]}

    def after(self, effect: dict, state: tuple) -> tuple:
        name, n, last, fired = state
        if effect["name"] is False or name != effect["name"] or (n and effect["at"] - last > self.seconds):
            return effect["ends"][0]
        if not fired:
            return effect["ends"][n]
        end = effect["fired"]
        return (end[0], end[1] + n, *end[2:]) if effect["adds"] else end


class RateLimit:
    """At most ``most`` allowed rows in any ``seconds``; refused ones don't count. State: times of the last allowed rows."""

    start = ()

    def __init__(self, most: int, seconds: float):
        self.most, self.seconds = most, seconds

    def run(self, state: tuple, session: np.ndarray, at: np.ndarray) -> tuple[dict, tuple]:
        allowed = np.zeros(len(at), bool)
        edges = np.append(np.flatnonzero(np.append(True, session[1:] != session[:-1])), len(at)).tolist()
        kept: list[float] = list(state)
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            t, kept, i = at[a:b], kept if not k else [], 0
            open_at = t - self.seconds  # a row passes where the `most`-th last allowed time is at most this
            dense = np.flatnonzero(t[: -self.most] > open_at[self.most :]) + self.most if self.most else t[:0]
            while i < len(t) and self.most:
                old = np.array(([float("-inf")] * self.most + kept)[-self.most :])
                fail = np.flatnonzero(old[: len(t) - i] > open_at[i : i + self.most])
                if len(fail):
                    end = i + int(fail[0])
                else:  # those on record are past: all pass up to the first that is too dense
                    p = int(np.searchsorted(dense, i + self.most))
                    end = int(dense[p]) if p < len(dense) else len(t)
                allowed[a + i : a + end] = True
                kept = (kept + t[max(i, end - self.most) : end].tolist())[-self.most :]
                i = end
                if i < len(t):
                    i = int(np.searchsorted(open_at, kept[-self.most]))
        return {"allowed": allowed}, tuple(kept)


class Lockouts:
    """A lock of ``seconds`` after ``failures`` in a row; attempts while locked are refused. State: failures in a row, end of the lock."""

    start = (0, float("-inf"))

    def __init__(self, failures: int, seconds: float):
        self.failures, self.seconds = failures, seconds

    def run(self, state: tuple, session: np.ndarray, at: np.ndarray, failed: np.ndarray) -> tuple[dict, tuple]:
        n = len(at)
        locked, refused = np.zeros(n, bool), np.zeros(n, bool)
        new = np.append(True, session[1:] != session[:-1])
        run_start = np.maximum.accumulate(np.where(new | ~failed | np.append(True, ~failed[:-1]), np.arange(n), 0))
        length = np.where(failed, np.arange(n) - run_start + 1, 0)
        full = np.flatnonzero(length == self.failures)
        starts = np.flatnonzero(new)
        streak, until = state
        for k, (a, b) in enumerate(zip(starts.tolist(), np.append(starts[1:], n).tolist())):
            streak, until = (streak, until) if not k else self.start
            i = a + int(np.searchsorted(at[a:b], until))
            refused[a:i] = True
            while i < b:
                # the lock that attempts from i on lead to
                stop = i
                while stop < b and stop - i < self.failures and failed[stop]:
                    stop += 1
                    if streak + stop - i >= self.failures:
                        break
                if streak + stop - i >= self.failures:
                    j = stop - 1
                else:
                    p = int(np.searchsorted(full, stop))
                    j = int(full[p]) if p < len(full) and full[p] < b else b
                if j == b:
                    tail = int(length[b - 1])
                    streak = min(tail, b - i) + (streak if tail >= b - i else 0)
                    break
                locked[j] = True
                streak, until = 0, float(at[j]) + self.seconds
                i, before = a + int(np.searchsorted(at[a:b], until)), j + 1
                i = max(i, before)
                refused[before:i] = True
        return {"locked": locked, "refused": refused}, (int(streak), float(until) if until > at[-1] else float("-inf"))


def fold(rows: DataFrame, by: str, at: str, tie: str, how, columns: list[str], results: str, part_rows: int = PART) -> DataFrame:
    """``rows`` with the columns ``results`` of a fold over each session's rows in the order of ``at``, then ``tie``.

    ``columns`` are those that the fold reads besides the session and the time. A null session is a session of its own.
    """
    tables = Tables(rows.sparkSession, "scan")
    seconds = F.col(at).cast("timestamp").cast("double")
    parts = min(PARTS, max(1, -(-rows.count() // part_rows)))
    rows = rows.withColumn("_at", seconds)
    if parts > 1:
        rows = tables.save(tables.save(rows).repartitionByRange(parts, by, at, tie).withColumn("_part", F.spark_partition_id()))
    else:
        rows = rows.withColumn("_part", F.lit(0))

    def arrays(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list]:
        pdf = pdf.sort_values([by, at, tie], kind="stable", na_position="first").reset_index(drop=True)
        session = pdf[by].fillna("" if pdf[by].dtype == object else 0)
        null = pdf[by].isna().to_numpy()
        same = np.append(False, (session.to_numpy()[1:] == session.to_numpy()[:-1]) & (null[1:] == null[:-1])) if len(pdf) else np.zeros(0, bool)
        return pdf, [np.cumsum(~same), pdf["_at"].to_numpy(), *[pdf[c].to_numpy() for c in columns]]

    def ends(given: dict):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            part = int(pdf["_part"].iloc[0])
            pdf, x = arrays(pdf)
            single = bool(x[0][-1] == x[0][0])
            lone = single and hasattr(how, "effect")
            told = how.effect(*x) if lone else how.run(given.get(part, how.start), *x)[1]
            keys = [pickle.dumps(None if pd.isna(v) else v) for v in (pdf[by].iloc[0], pdf[by].iloc[-1])]
            return pd.DataFrame({"part": [part], "first": keys[:1], "last": keys[1:], "single": [single], "told": [pickle.dumps(told)]})

        return run

    told = "part int, first binary, last binary, single boolean, told binary"
    narrow = rows.select(*dict.fromkeys([by, at, tie, "_at", *columns, "_part"]))
    known = {r.part: r for r in narrow.groupBy("_part").applyInPandas(ends({}), told).collect()} if parts > 1 else {}
    given: dict[int, tuple] = {}
    while parts > 1:
        entry, state, last, left = {}, how.start, None, {p: pickle.loads(r.told) for p, r in known.items()}
        for p in sorted(known):
            before = state if known[p].first == last else how.start
            entry[p] = before
            state = how.after(left[p], before) if known[p].single and hasattr(how, "effect") else left[p]
            last = known[p].last
        again = [p for p in entry if known[p].single and not hasattr(how, "effect") and entry[p] != given.get(p, how.start)]
        given = entry
        if not again:
            break
        known |= {r.part: r for r in narrow.where(F.col("_part").isin(again)).groupBy("_part").applyInPandas(ends(given), told).collect()}

    names = [c for c in rows.columns if c not in ("_at", "_part")]
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["_part"].iloc[0])
        pdf, x = arrays(pdf)
        return pdf[names].assign(**how.run(given.get(part, how.start), *x)[0])

    return rows.groupBy("_part").applyInPandas(final, f"{typed}, {results}")
