"""Staged runs: an append-only ledger, what to run again, and the run's identity."""

from __future__ import annotations

import hashlib
import json
import os
import re
import subprocess
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators.dedupe import latest

STAGES = ("bronze", "silver", "gold")
LEDGER_SCHEMA = ("run_id string, stage string, status string, sequence int, reason string, source_fingerprint string, "
                 "config_hash string, code_sha string, event_at timestamp")


@dataclass(frozen=True)
class Identity:
    source_fingerprint: str
    config_hash: str
    code_sha: str


def fingerprint(root: str | Path) -> str:
    """Digest of names, sizes and contents of all files below a folder, in order of names."""
    sha = hashlib.sha256()
    root = Path(root)
    for p in sorted(x for x in root.rglob("*") if x.is_file()):
        sha.update(f"{p.relative_to(root).as_posix()}\0{p.stat().st_size}\0".encode())
        sha.update(hashlib.sha256(p.read_bytes()).digest())
    return sha.hexdigest()


def config_hash(config: Mapping) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def code_sha(root: str | Path) -> str:
    done = subprocess.run(["git", "-C", str(root), "rev-parse", "HEAD"], capture_output=True, text=True)
    return done.stdout.strip() if done.returncode == 0 else "unknown"


def substituted(value, env: Mapping[str, str] | None = None):
    """``${NAME}`` and ``${NAME:-default}`` in texts of any nested configuration."""
    env = os.environ if env is None else env
    if isinstance(value, Mapping):
        return {k: substituted(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [substituted(v, env) for v in value]
    if isinstance(value, str):
        return re.sub(r"\$\{([A-Za-z_]\w*)(?::-([^}]*))?\}", lambda m: env.get(m[1]) or (m[2] if m[2] is not None else ""), value)
    return value


class Ledger:
    """Events of stages in an append-only parquet folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, run_id: str, stage: str, status: str, sequence: int, reason: str, identity: Identity,
            at: datetime | None = None) -> None:
        row = (run_id, stage, status, sequence, reason, identity.source_fingerprint, identity.config_hash,
               identity.code_sha, at or datetime.now(timezone.utc).replace(tzinfo=None))
        self.spark.createDataFrame([row], LEDGER_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def events(self) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(LEDGER_SCHEMA).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], LEDGER_SCHEMA)

    def statuses(self, identity: Identity) -> dict[str, str]:
        """The newest status of each stage for this identity (a few rows)."""
        mine = self.events().where((F.col("source_fingerprint") == identity.source_fingerprint)
                                   & (F.col("config_hash") == identity.config_hash) & (F.col("code_sha") == identity.code_sha))
        newest = latest(mine, ["stage"], [F.col("event_at").desc(), F.col("sequence").desc()])
        return {r["stage"]: r["status"] for r in newest.collect()}


def stage_plan(statuses: Mapping[str, str], first: str = STAGES[0], last: str = STAGES[-1], force: bool = False,
               stages: Sequence[str] = STAGES) -> list[str]:
    """Stages to run: from the first in the range that didn't succeed, and all after it."""
    lo, hi = stages.index(first), stages.index(last)
    if lo > hi:
        raise ValueError(f"{first} comes after {last}")
    span = list(stages[lo:hi + 1])
    if force:
        return span
    for k, stage in enumerate(span):
        if statuses.get(stage) != "SUCCEEDED":
            return span[k:]
    return []


def run_stages(ledger: Ledger, run_id: str, identity: Identity, work: Mapping[str, Callable[[], str | None]],
               first: str = STAGES[0], last: str = STAGES[-1], force: bool = False) -> dict[str, str]:
    """Each planned stage's work, noted before and after.  Work that returns a reason is held and ends the run."""
    out = {}
    for stage in stage_plan(ledger.statuses(identity), first, last, force):
        ledger.add(run_id, stage, "RUNNING", 0, "stage_started", identity)
        try:
            held = work[stage]()
        except Exception as e:
            ledger.add(run_id, stage, "FAILED", 2, type(e).__name__, identity)
            raise
        out[stage] = "HELD" if held else "SUCCEEDED"
        ledger.add(run_id, stage, out[stage], 1, "stage_held" if held else "stage_completed", identity)
        if held:
            break
    return out
