"""Chains of single events per key, by a keyed state processor with timers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# Keys that share a state, without a caller's word on the stream's size; and rows that one takes well.
GROUPS = 1024
GROUP_ROWS = 1 << 13


def group_count(rows: int) -> int:
    """States for a stream of ``rows``: each costs calls and commits a batch, whatever it holds."""
    return max(1, -(-rows // GROUP_ROWS))


def last_before(
    events: DataFrame,
    key: str,
    time: str,
    kind: str,
    steps: Sequence[str],
    within: int,
    groups: int = GROUPS,
) -> DataFrame:
    """For each event of the last step, the last event of each step before it.

    Backwards from the last step: the latest event of the step before that is
    strictly earlier, not more than ``within`` seconds; then the same from that
    one on. Each event of the last step gives one row: ``key``, and the steps'
    times as microseconds in columns named ``<step>_time``, null from where the
    chain breaks. Rows without a key or a time belong to no chain.

    ``events`` is a stream with a watermark on ``time`` (a timestamp). Keys are
    dealt by hash to ``groups`` states, fixed by a checkpoint's first start, so that
    calls and commits follow the rows and not the keys. Events are held until
    the watermark has passed them, and are then taken in the order of key and
    time, all of a group at once: the work is n log n in a group's events,
    however many a key has. What stays of a key is the last chain of each step,
    until it is too old to be met; then nothing does. A group holds its events
    of one batch and of the watermark's delay, 9 bytes each and the key.
    """
    known = F.array_position(F.array(*map(F.lit, steps)), F.col(kind)) - 1
    used = events.select(
        F.pmod(F.xxhash64(key), F.lit(groups)).alias("of"), F.col(key).alias("key"),
        F.unix_micros(time).alias("at"), known.alias("step"), F.col(time)
    )
    # The optimizer takes a filter without the event time below the watermark, which would then
    # not see the rows of other kinds. No time is before this one.
    used = used.where((F.col("key").isNotNull() & F.col("at").isNotNull() & (F.col("step") >= 0))
                      | (F.col(time) < F.lit("0001-01-01").cast("timestamp")))
    names = [f"{step}_time" for step in steps]
    kept_key = used.schema["key"].dataType.simpleString()
    out = f"key {kept_key}, " + ", ".join(f"c{at} long" for at in range(len(steps)))
    chained = used.groupBy("of").transformWithStateInPandas(
        _processor(len(steps), within * 1_000_000)(), out, "Append", "EventTime")
    return chained.select(F.col("key").alias(key), *[
        F.col(f"c{at}").alias(name) for at, name in enumerate(names)])


def _processor(count: int, within: int) -> type[StatefulProcessor]:
    # A nested class travels by value, so workers need only pyspark, numpy and pandas.
    class Chains(StatefulProcessor):
        """``held``: events the watermark has not passed. ``last``: a chain for each key and step."""

        def init(self, handle) -> None:
            self.handle = handle
            self.held = handle.getListState("held", "keys binary, times binary, steps binary")
            self.last = handle.getValueState("last", "keys binary, steps binary, chains binary")

        def handleInputRows(self, key, rows, timerValues):
            import pickle

            import numpy as np

            low = None
            chunks = []
            for frame in rows:
                times = frame["at"].to_numpy(np.int64)
                chunks.append((pickle.dumps(frame["key"].to_numpy()), times.tobytes(),
                               frame["step"].to_numpy(np.int8).tobytes()))
                low = times.min() if low is None else min(low, times.min())
            self.held.appendList(chunks)
            self.handle.registerTimer(int(low) // 1000 + 1)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pickle

            import numpy as np
            import pandas as pd

            passed = timerValues.getCurrentWatermarkInMs() * 1000
            chunks = list(self.held.get())
            times = np.concatenate([np.frombuffer(one[1], np.int64) for one in chunks] or [np.zeros(0, np.int64)])
            due = times <= passed
            kept = self.last.get()
            keys = [pickle.loads(one[0]) for one in chunks]
            # Chains: rows of the times of steps 0 to their own, -1 where the chain breaks.
            steps = [np.frombuffer(one[2], np.int8) for one in chunks]
            before = np.zeros((0, count), np.int64)
            if kept:
                keys.append(pickle.loads(kept[0]))
                steps.append(np.frombuffer(kept[1], np.int8))
                before = np.frombuffer(kept[2], np.int64).reshape(-1, count)
            if not keys:
                return
            keys, steps = np.concatenate(keys), np.concatenate(steps)
            if due.any():
                if due.all():
                    self.held.clear()
                else:
                    left = np.flatnonzero(~due)
                    self.held.put([(pickle.dumps(keys[left]), times[left].tobytes(), steps[left].tobytes())])
            if not due.all():
                self.handle.registerTimer(int(times[~due].min()) // 1000 + 1)
            who, distinct = pd.factorize(keys, use_na_sentinel=False)
            carried = np.arange(len(times), len(keys))
            chains, owners = [], []
            for step in range(count):
                own = np.flatnonzero(due & (steps[:len(times)] == step))
                own = own[np.lexsort((times[own], who[own]))]
                rows = np.full((own.size, count), -1, np.int64)
                rows[:, step] = times[own]
                if step and own.size and len(chains[-1]):
                    earlier = chains[-1]
                    place = _last_before(who[own], times[own], owners[-1], earlier[:, step - 1])
                    found = earlier[np.maximum(place, 0)]
                    good = ((place >= 0) & (owners[-1][np.maximum(place, 0)] == who[own])
                            & (times[own] - found[:, step - 1] <= within))
                    rows[good, :step] = found[good, :step]
                old = steps[carried] == step
                rows = np.concatenate((before[old], rows))
                whose = np.concatenate((who[carried[old]], who[own]))
                order = np.lexsort((rows[:, step], whose))
                chains.append(rows[order])
                owners.append(whose[order])
            # Only what a later event can still meet is kept.
            stay = []
            for step in range(count - 1):
                rows, whose = chains[step], owners[step]
                final = np.append(whose[1:] != whose[:-1], True)[:len(whose)]
                final &= rows[:, step] + within > passed
                stay.append((whose[final], np.full(int(final.sum()), step, np.int8), rows[final]))
            whose, of, last = (np.concatenate(one) for one in zip(*stay)) if stay else (steps[:0],) * 3
            if not len(last):
                if kept:
                    self.last.clear()
            else:
                self.last.update((pickle.dumps(distinct[whose]), of.tobytes(), last.tobytes()))
                self.handle.registerTimer(int(last.max() + within) // 1000 + 1)
            done = chains[-1]
            if len(done):
                columns = {"key": pd.Series(distinct[owners[-1]])}
                for at in range(count):
                    values = pd.array(done[:, at], dtype="Int64")
                    values[done[:, at] < 0] = pd.NA
                    columns[f"c{at}"] = values
                yield pd.DataFrame(columns)

        def close(self) -> None:
            pass

    def _last_before(whose, at, others, earlier):
        """The place, in order of owner and time, of the last of ``earlier`` before each row."""
        import numpy as np

        flag = np.repeat(np.array([0, 1], np.int8), (len(at), len(earlier)))
        order = np.lexsort((flag, np.concatenate((at, earlier)), np.concatenate((whose, others))))
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(flag[order], dtype=np.int64) - 1
        return place[:len(at)]

    return Chains
