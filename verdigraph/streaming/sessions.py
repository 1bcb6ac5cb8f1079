"""Conversations of users, kept from what they do: start a new one, switch to one, delete one, ask in the active one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from verdigraph.functions.text import title

UNTITLED = "Nova Conversa"
_OUT = "user string, number int, session string, title string, n_questions long, status string"


class Sessions(StatefulProcessor):
    """State per user: the sessions by number, and the active number with the last one given out.

    A user's first event finds a session that is there already, number 1. Deleting the active session makes the oldest
    one active; the last session can't be deleted; sessions that aren't there, and unknown actions, change nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sessions = handle.getMapState("sessions", "number int", "title string, n_questions long")
        self.place = handle.getValueState("place", "active int, last int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.place.exists():
            active, last = self.place.get()
        else:
            active = last = 1
            self.sessions.updateValue((1,), (UNTITLED, 0))
        gone, prefix = set(), f"{key[0]}-"
        for e in pd.concat(rows).sort_values("seq", kind="stable").itertuples():
            number = int(e.session[len(prefix) :]) if isinstance(e.session, str) and e.session.startswith(prefix) and e.session[len(prefix) :].isdigit() else 0
            known = number > 0 and self.sessions.containsKey((number,))
            if e.action == "new":
                active = last = last + 1
                self.sessions.updateValue((active,), (UNTITLED, 0))
            elif e.action == "switch" and known:
                active = number
            elif e.action == "delete" and known:
                others = [n for (n,) in self.sessions.keys() if n != number]
                if others:
                    self.sessions.removeKey((number,))
                    gone.add(number)
                    active = min(others) if active == number else active
            elif e.action == "ask":
                name, n = self.sessions.getValue((active,))
                self.sessions.updateValue((active,), ((e.title or UNTITLED) if name == UNTITLED else name, n + 1))
        self.place.update((active, last))
        kept = [(key[0], n, f"{prefix}{n}", name, count, "active" if n == active else "open") for (n,), (name, count) in self.sessions.iterator()]
        kept += [(key[0], n, f"{prefix}{n}", None, 0, "deleted") for n in gone]
        yield pd.DataFrame(sorted(kept), columns=["user", "number", "session", "title", "n_questions", "status"])

    def close(self) -> None:
        pass


def sessions(events: DataFrame) -> DataFrame:
    """(user, number, session, title, n_questions, status) after events (user, seq, action, session, text), streamed or not.

    A batch of a stream gives all sessions of the users it has events of, and those that it deleted. The events of a
    user's batch are taken in the order of seq, batches as they come. Events without a user are left out. A session is
    named after its user and number, and titled by the first question asked in it.
    """
    rows = events.where("user is not null").select(F.col("user").cast("string").alias("user"), "seq", F.col("action").cast("string").alias("action"), F.col("session").cast("string").alias("session"), title(F.coalesce("text", F.lit(""))).alias("title"))
    _ = events.sparkSession.streams.active  # a batch query needs the coordinator of state stores that this starts
    return rows.groupBy("user").transformWithStateInPandas(statefulProcessor=Sessions(), outputStructType=_OUT, outputMode="Update", timeMode="None")
