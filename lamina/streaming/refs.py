"""Ref updates, change bursts, open transactions, subscriptions and incremental upkeep, on streams and on tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def updates(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``old`` and ``new`` of every update of a key, on a table."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("old", F.lag(value).over(w)).withColumn("new", F.col(value))


def stream_updates(events: DataFrame) -> DataFrame:
    """The same on a stream of ``repo, name, hash, origin, ts``: the state is the last hash of each ref.

    A batch's events of one ref are taken in order of time; each gives ``repo, name, old, new, origin``, so a subscriber leaves out its own.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        old = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "hash"], kind="stable")
        out = []
        for new, origin in zip(rows["hash"], rows["origin"], strict=True):
            out.append((key[0], key[1], old, new, origin))
            old = new
        state.update((old,))
        yield pd.DataFrame(out, columns=["repo", "name", "old", "new", "origin"])

    return events.groupBy("repo", "name").applyInPandasWithState(step, "repo string, name string, old string, new string, origin string", "hash string", "append", "NoTimeout")


def bursts(events: DataFrame, key: str, time: str, quiet: str) -> DataFrame:
    """Runs of events without a pause of ``quiet``: ``key, first, last, n``; on a stream, behind a watermark, a burst is given out once it is over."""
    rows = events.groupBy(F.col(key), F.session_window(F.col(time), quiet)).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n"))
    return rows.select(key, "first", "last", "n")


def on_change(stream: DataFrame, regenerate: Callable[[DataFrame, int], None], every: str = "100 milliseconds"):
    """Start a query that calls ``regenerate`` with each micro-batch of changed files."""
    return stream.writeStream.trigger(processingTime=every).foreachBatch(regenerate).start()


def maintain(stream: DataFrame, merge: Callable[[DataFrame], None]):
    """Incremental upkeep: each micro-batch's last row per id is merged into the index."""

    def apply(batch: DataFrame, _: int) -> None:
        merge(batch.groupBy("id").agg(F.max_by("node_hash", "ts").alias("node_hash")))

    return stream.writeStream.foreachBatch(apply).start()


def _ordered(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values("at", kind="stable")


def stream_transactions(events: DataFrame) -> DataFrame:
    """``conn, at, outcome, n_open`` on a stream of ``conn, kind, at``: begin, commit and rollback by connection; a disconnect rolls back what is open.

    The state of a connection is its number of open transactions. A commit or
    rollback without an open transaction is an outcome of its own and changes nothing.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        out = []
        for kind, at in _ordered(batches)[["kind", "at"]].itertuples(index=False):
            if kind == "begin":
                n, outcome = n + 1, "begun"
            elif kind == "disconnect":
                n, outcome = 0, "rolled back" if n else "closed"
            elif n:
                n, outcome = n - 1, "committed" if kind == "commit" else "rolled back"
            else:
                outcome = "nothing open"
            out.append((key[0], int(at), outcome, n))
        if n:
            state.update((n,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["conn", "at", "outcome", "n_open"])

    return events.groupBy("conn").applyInPandasWithState(step, "conn string, at long, outcome string, n_open long", "n long", "append", "NoTimeout")


def stream_subscriptions(accesses: DataFrame) -> DataFrame:
    """``conn, repo, at, change`` on a stream of ``conn, repo, kind, at``: the first access of a repository subscribes, a disconnect ends all of the connection's."""

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        out = []
        for kind, repo, at in _ordered(batches)[["kind", "repo", "at"]].itertuples(index=False):
            if kind == "disconnect":
                out += [(key[0], r, int(at), "ended") for r in held]
                held = []
            elif repo not in held:
                held.append(repo)
                out.append((key[0], repo, int(at), "subscribed"))
        if held:
            state.update((held,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["conn", "repo", "at", "change"])

    return accesses.groupBy("conn").applyInPandasWithState(step, "conn string, repo string, at long, change string", "held array<string>", "append", "NoTimeout")


def deliveries(moves: DataFrame, subscribed: DataFrame) -> DataFrame:
    """``conn, repo, name, old, new``: updates of ``repo, name, old, new, origin`` go to the repository's subscribers but their origin."""
    return moves.join(subscribed, "repo").where(~F.col("conn").eqNullSafe(F.col("origin"))).select("conn", "repo", "name", "old", "new")
