"""Leases on queued change-sets, so that of several workers one processes each, and another takes over from one that died.

A change-set has a chain of numbered entries, small files made only if absent: taken (by whom, until when), renewed, done.
Its state is the last entry, and every step adds the next number, so of two workers who saw the same state one succeeds:
a take-over and the renewal it races with can't both be made. A worker that lost its lease sees so at its next step, and
what it commits late is refused: a change-set is committed under its own id as token, once.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import names, put_if_absent, read_text
from .commit import Conflict, Outcome, next_in_queue

ENTRY = "proposal_id string, n long, state string, owner string, at double, until double, committed boolean, revision long"


@dataclass(frozen=True)
class Lease:
    proposal_id: str
    owner: str
    n: int
    until: float


class Claims:
    """The claims of a model's change-sets, under a folder that all workers share."""

    def __init__(self, spark: SparkSession, path: str, seconds: float = 600, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.seconds, self.clock = spark, path.rstrip("/"), seconds, clock

    def _folder(self, proposal_id: str) -> str:
        return f"{self.path}/claims/{quote(proposal_id, safe='')}"

    def last(self, proposal_id: str) -> dict | None:
        found = [x for x in names(self.spark, self._folder(proposal_id)) if x[:8].isdigit()]
        return json.loads(read_text(self.spark, f"{self._folder(proposal_id)}/{found[-1]}")) if found else None

    def _add(self, proposal_id: str, n: int, state: str, owner: str, **more) -> dict | None:
        now = self.clock()
        entry = {"proposal_id": proposal_id, "n": n, "state": state, "owner": owner, "at": now, "until": now + self.seconds, **more}
        return entry if put_if_absent(self.spark, f"{self._folder(proposal_id)}/{n:08d}.json", json.dumps(entry) + "\n") else None

    def take(self, proposal_id: str, owner: str) -> Lease | None:
        """The lease, where the change-set is free or its lease has run out; None where it is held, done, or another was faster."""
        last = self.last(proposal_id)
        if last and (last["state"] == "done" or self.clock() < last["until"]):
            return None
        made = self._add(proposal_id, (last["n"] if last else 0) + 1, "taken", owner)
        return Lease(proposal_id, owner, made["n"], made["until"]) if made else None

    def renew(self, lease: Lease) -> Lease | None:
        """The lease with a new end; None where another has taken over."""
        made = self._add(lease.proposal_id, lease.n + 1, "renewed", lease.owner)
        return Lease(lease.proposal_id, lease.owner, made["n"], made["until"]) if made else None

    def finish(self, lease: Lease, outcome: Outcome) -> bool:
        """Marks the change-set done; False where another has taken over, who will come to the same outcome by its token."""
        return self._add(lease.proposal_id, lease.n + 1, "done", lease.owner, committed=outcome.committed, revision=outcome.revision) is not None

    def states(self) -> DataFrame:
        """The last entry of each change-set that was ever claimed."""
        if not names(self.spark, f"{self.path}/claims"):
            return self.spark.createDataFrame([], ENTRY)
        rows = self.spark.read.schema(ENTRY).option("recursiveFileLookup", True).json(f"{self.path}/claims").where("proposal_id is not null")
        return rows.groupBy("proposal_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "proposal_id"]), "n").alias("e")).select("proposal_id", "e.*")

    def queue(self, proposals: DataFrame) -> DataFrame:
        """Queued and processing change-sets that are neither done nor held, with what of them has run out of time."""
        s = self.states().select(F.col("proposal_id").alias("id"), F.col("state").alias("__state"), F.col("until").alias("__until"))
        rows = proposals.where(F.col("status").isin("queued", "processing")).join(s, "id", "left")
        rows = rows.where(F.col("__state").isNull() | ((F.col("__state") != "done") & (F.col("__until") <= F.lit(self.clock()))))
        return rows.withColumn("status", F.lit("queued")).drop("__state", "__until")

    def next(self, proposals: DataFrame, owner: str) -> Lease | None:
        """Takes the oldest change-set that can be had. Those that others take meanwhile are passed over."""
        while True:
            row = next_in_queue(self.queue(proposals)).first()
            if row is None:
                return None
            if lease := self.take(row["id"], owner):
                return lease


def work(model, claims: Claims, proposals: DataFrame, changes: DataFrame, owner: str) -> list[tuple[str, Outcome]]:
    """Processes queued change-sets one after the other until none is left; those that other workers hold are left to them."""
    done = []
    while lease := claims.next(proposals, owner):
        while True:
            try:
                outcome = model.commit(changes.where(F.col("proposal_id") == lease.proposal_id), token=lease.proposal_id)
                break
            except Conflict:  # another worker made a revision meanwhile: the change-set is tried on that one
                lease = claims.renew(lease)
                if lease is None:
                    break
        if lease is not None and claims.finish(lease, outcome):
            done.append((lease.proposal_id, outcome))
    return done


