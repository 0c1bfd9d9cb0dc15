"""Rolling sequences and lookback over streams, with a bounded state per stream.

Rows of a stream are taken in order of time within a trigger; a row older than one that was taken is late and is dropped.
For rolling sequences, rows can wait in the state until the stream's latest row is `delay_us` later: those that come out
of order by up to that, over any triggers, are then put in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logweave.operators.logs import LOOKBACK, height


def stream_rolling_sequences(events: DataFrame, *, window_us: int, shortest: int = 2, longest: int = 16, delay_us: int = 0) -> DataFrame:
    """(stream, seq, items) of events(stream, us, seq, item), as rolling_sequences has them; the state is one window, and the
    rows of the last delay_us, which wait."""
    item = events.schema["item"].dataType.simpleString()

    def kernel(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, times, items, *waiting = state.get if state.exists else (0, [], [], [], [], [])
        times, items, out = list(times), list(items), []
        new = pd.concat(list(frames))
        rows = sorted([*zip(*waiting, strict=True), *new[["us", "seq", "item"]].itertuples(index=False, name=None)], key=lambda r: r[:2])
        until = rows[-1][0] - delay_us
        for us, _, x in (r for r in rows if r[0] <= until):
            if times and us < times[-1]:
                continue
            gone = 0
            while gone < len(times) and times[gone] <= us - window_us:
                gone += 1
            times, items, count = [*times[gone:], us], [*items[gone:], x], count + 1
            if len(items[:longest]) >= shortest:
                out.append((key[0], count, items[:longest]))
        state.update((count, times, items, *([r[k] for r in rows if r[0] > until] for k in range(3))))
        yield pd.DataFrame(out, columns=["stream", "seq", "items"])

    stream = events.schema["stream"].dataType.simpleString()
    return events.groupBy("stream").applyInPandasWithState(kernel, f"stream {stream}, seq long, items array<{item}>", f"n long, times array<long>, items array<{item}>, late_us array<long>, late_seq array<long>, late_item array<{item}>", "append", GroupStateTimeout.NoTimeout)


def stream_lookback_values(events: DataFrame, parents: dict[str, str], *, lookback: int = LOOKBACK) -> DataFrame:
    """(stream, seq, values) of events(stream, seq, type, value), as lookback_values has them.

    The state holds the events that later ones can reach: `lookback` times the height of the forest of types.
    """
    value = events.schema["value"].dataType.simpleString()
    steps = max(1, height(parents))

    def kernel(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        out = []
        for seq, kind, x in sorted(pd.concat(list(frames))[["seq", "type", "value"]].itertuples(index=False, name=None), key=lambda r: r[0]):
            if held and seq <= held[-1][0]:
                continue
            held.append((seq, kind, x))
            found, level = {x}, {(seq, kind)}
            for _ in range(steps):
                level = {(s, k, v) for at, child in level if child in parents for s, k, v in held if k == parents[child] and at - lookback <= s < at}
                found |= {v for _, _, v in level}
                level = {(s, k) for s, k, _ in level}
            out.append((key[0], seq, sorted(v for v in found if v is not None)))
            held = [r for r in held if r[0] > seq - lookback * steps]
        if held:
            state.update(tuple(list(c) for c in zip(*held, strict=True)))
        yield pd.DataFrame(out, columns=["stream", "seq", "values"])

    stream = events.schema["stream"].dataType.simpleString()
    return events.groupBy("stream").applyInPandasWithState(kernel, f"stream {stream}, seq long, values array<{value}>", f"seq array<long>, type array<string>, value array<{value}>", "append", GroupStateTimeout.NoTimeout)
