"""Streams: the last n observations and the temporal ensemble of each episode, kept as state, as rows arrive."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def history_stream(stream: DataFrame, episode: str, step: str, value: str, n: int) -> DataFrame:
    """episode, step, history: of each row the last n values of its episode, the first one filling what is missing.

    Rows of an episode must arrive in order of step across batches; state is n numbers an episode.
    """
    kind = stream.schema[episode].dataType.simpleString()

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(step, kind="stable")
        out = []
        for v in rows[value].to_list():
            kept = [*kept, v][-n:] if kept else [v] * n
            out.append(list(kept))
        state.update((kept,))
        yield pd.DataFrame({episode: [key[0]] * len(rows), step: rows[step].to_list(), "history": out})

    return stream.groupBy(episode).applyInPandasWithState(run, f"{episode} {kind}, {step} long, history array<double>", "kept array<double>", "append", GroupStateTimeout.NoTimeout)


def ensemble_stream(stream: DataFrame, episode: str, step: str, chunk: str, alpha: float, most: int) -> DataFrame:
    """episode, step, action: for each arriving chunk (made at its step), the mean of what the newest `most` chunks say for
    that step, weighted by exp(alpha * cosine with the newest). State is `most` chunks an episode."""
    kind = stream.schema[episode].dataType.simpleString()

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(step, kind="stable")
        steps, actions = [], []
        for made, c in zip(rows[step].to_list(), rows[chunk].to_list(), strict=True):
            kept = [*kept, [int(made), [[float(x) for x in v] for v in c]]][-most:]
            votes = np.array([v[made - m] for m, v in kept if 0 <= made - m < len(v)])
            top = votes[-1]
            cos = votes @ top / (np.linalg.norm(votes, axis=1) * np.linalg.norm(top) + 1e-7)
            w = np.exp(alpha * cos)
            steps.append(made)
            actions.append((w[:, None] * votes).sum(0) / w.sum())
        state.update((json.dumps(kept),))
        yield pd.DataFrame({episode: [key[0]] * len(rows), step: steps, "action": [a.tolist() for a in actions]})

    return stream.groupBy(episode).applyInPandasWithState(run, f"{episode} {kind}, {step} long, action array<double>", "kept string", "append", GroupStateTimeout.NoTimeout)


def replay(stream: DataFrame, step: str, horizon: int) -> DataFrame:
    """Rows where a new chunk is asked for: every `horizon` steps."""
    return stream.where(F.col(step) % horizon == 0)
