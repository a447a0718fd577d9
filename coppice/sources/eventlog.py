"""The append-only, hash-chained log of a tree: written durably by one driver, read and verified as a DataFrame."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VERSION = 1
FOLDER = ".coppice"
# What may be said of a leaf's origin.
PROVENANCE = ("creator", "timestamp", "source", "confidence", "verification_state", "verifier", "validity_interval")
RECORD = "schemaVersion int, kind string, operation string, operationHashes array<string>, prevHash string, sequence long, timestamp string, transactionId string, hash string"


def canonical(value: object) -> str:
    """JSON with sorted keys, without spaces; whole floats are written as integers."""

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, list | tuple):
            return [plain(x) for x in v]
        return int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 1e21 else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def event_hash(record: dict) -> str:
    return digest(canonical({k: v for k, v in record.items() if k != "hash"}))


def replace(path: Path, text: str, fault: Callable[[str], None] = lambda stage: None) -> None:
    """Writes a file whole or not at all. fault is called before each step that a crash may cut off."""
    path.parent.mkdir(parents=True, exist_ok=True)
    new = path.with_name(f".{path.name}.new")
    with open(new, "w", encoding="utf-8", newline="") as f:
        f.write(text)
        fault("before-fsync")
        f.flush()
        os.fsync(f.fileno())
    fault("before-rename")
    os.replace(new, path)
    fault("after-rename")
    folder = os.open(path.parent, os.O_RDONLY)
    try:
        fault("before-directory-fsync")
        os.fsync(folder)
    finally:
        os.close(folder)


@dataclass
class Log:
    """What could be read: the valid records from the start, and what is wrong with the rest."""

    records: list[dict]
    errors: list[dict]
    warnings: list[dict]
    head: dict | None

    @property
    def integrity(self) -> bool:
        return not self.errors


@dataclass
class State:
    leaves: dict[str, dict] = field(default_factory=dict)
    changes: dict[str, int] = field(default_factory=dict)
    forgotten: set[str] = field(default_factory=set)
    edges: dict[str, dict] = field(default_factory=dict)
    checkpoints: dict[str, dict] = field(default_factory=dict)
    committed: dict[str, dict] = field(default_factory=dict)
    operations: list[dict] = field(default_factory=list)


class EventLog:
    def __init__(self, tree: str | Path):
        self.folder = Path(tree) / FOLDER
        self.file, self.anchor = self.folder / "events.jsonl", self.folder / "event-head.json"

    @contextmanager
    def held(self) -> Iterator[None]:
        """One writer of a tree at a time; the operating system lets go of a writer that dies."""
        import fcntl

        self.folder.mkdir(parents=True, exist_ok=True)
        with open(self.folder / "lock", "w") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            yield

    def read(self) -> Log:
        head = json.loads(self.anchor.read_text()) if self.anchor.exists() else None
        source = self.file.read_text(encoding="utf-8") if self.file.exists() else ""
        lines, records, errors, warnings, before = source.split("\n"), [], [], [], None
        ended = lines[-1] == ""
        lines = lines[:-1] if ended else lines
        for n, line in enumerate(lines, 1):
            try:
                record = json.loads(line)
            except ValueError:
                if n < len(lines):
                    errors.append({"code": "corrupted-record", "line": n})
                else:
                    (errors if ended else warnings).append({"code": "corrupted-tail" if ended else "truncated-tail", "line": n})
                break
            if record.get("sequence") != n or record.get("prevHash") != before or record.get("hash") != event_hash(record):
                errors.append({"code": "hash-chain-corruption", "line": n})
                break
            if record["schemaVersion"] > VERSION:
                warnings.append({"code": "unsupported-schema-version", "line": n})
            records.append(record)
            before = record["hash"]
        if head and (head["sequence"], head["hash"]) != (len(records), before):
            if head["sequence"] < len(records) and (not head["sequence"] or records[head["sequence"] - 1]["hash"] == head["hash"]):
                warnings.append({"code": "unanchored-tail"})
            else:
                errors.append({"code": "log-truncated" if head["sequence"] > len(records) else "head-mismatch"})
        elif records and not head:
            warnings.append({"code": "missing-head-anchor"})
        return Log(records, errors, warnings, head)

    def append(self, transaction: str, operations: list[dict], before_commit: Callable[[], None] | None = None, timestamp: str | None = None, fault=lambda stage: None) -> dict:
        """Writes the operations and the commit that names them; the caller holds the log. A tail cut off by a crash is removed first."""
        if not transaction or not operations:
            raise ValueError("a transaction needs an id and operations")
        log = self.read()
        if not log.integrity:
            raise ValueError(f"the log isn't whole: {[e['code'] for e in log.errors]}")
        if any(w["code"] == "truncated-tail" for w in log.warnings):
            text = self.file.read_text(encoding="utf-8")
            replace(self.file, text[: text.rindex("\n") + 1] if "\n" in text else "")
        sequence, before = len(log.records), log.records[-1]["hash"] if log.records else None
        stamp = timestamp or datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        hashes: list[str] = []

        def write(kind: str, more: dict) -> dict:
            nonlocal sequence, before
            sequence += 1
            record = {"schemaVersion": VERSION, "kind": kind, **more, "prevHash": before, "sequence": sequence, "timestamp": stamp, "transactionId": transaction}
            record["hash"] = before = event_hash(record)
            with open(self.file, "a", encoding="utf-8", newline="") as f:
                f.write(canonical(record) + "\n")
                f.flush()
                os.fsync(f.fileno())
            replace(self.anchor, canonical({"schemaVersion": VERSION, "hash": before, "sequence": sequence}) + "\n", fault)
            return record

        for operation in operations:
            hashes.append(write("operation", {"operation": operation})["hash"])
        if before_commit:
            before_commit()
        return write("commit", {"operationHashes": hashes})

    def state(self, log: Log | None = None) -> State:
        """The committed state, folded on the driver; `operators.replay` folds tables of any size the same way."""
        s, pending = State(), {}
        for r in (log or self.read()).records:
            if r["schemaVersion"] != VERSION:
                continue
            if r["kind"] == "operation":
                pending.setdefault(r["transactionId"], []).append(r)
            elif r["kind"] == "commit" and [x["hash"] for x in pending.get(r["transactionId"], [])] == r["operationHashes"]:
                s.operations += pending.pop(r["transactionId"], [])
                s.committed[r["transactionId"]] = r
        for r in s.operations:
            self._apply(s, r["operation"] or {}, r["sequence"])
        return s

    @staticmethod
    def _apply(s: State, op: dict, at: int) -> None:
        kind, id_ = op.get("type"), op.get("id")
        if kind == "leaf.upsert":
            id_ = op["leaf"]["id"]
            if id_ in s.forgotten:
                return
            s.leaves[id_] = {**op["leaf"], "sequence": at}
        elif kind == "leaf.provenance":
            if id_ not in s.leaves:
                return
            s.leaves[id_] = {**s.leaves[id_], **{k: v for k, v in (op.get("provenance") or {}).items() if k in PROVENANCE}, "sequence": at}
        elif kind in ("leaf.delete", "leaf.forget"):
            s.leaves.pop(id_, None)
            if kind == "leaf.forget":
                s.forgotten.add(id_)
        elif kind == "edge.upsert":
            s.edges[op["edge"]["id"]] = {**op["edge"], "sequence": at}
        elif kind == "edge.delete":
            s.edges.pop(id_, None)
        elif kind == "view.checkpoint":
            s.checkpoints[op["file"]] = {**op, "sequence": at}
        if kind and kind.startswith("leaf."):
            s.changes[id_] = at


@F.pandas_udf(StringType())
def _hash_of(lines: pd.Series) -> pd.Series:
    def one(line: str) -> str | None:
        try:
            return event_hash(json.loads(line))
        except (ValueError, AttributeError):
            return None

    return lines.map(one, na_action="ignore")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """All records of the logs under path (a file, or a pattern for many trees): tree, line, the record's fields, valid.

    A log is read in parts and checked by a prefix scan over ranges of its lines, so a long one is many tasks' work. valid holds up to a tree's first
    record that can't be read, isn't in its place, doesn't follow the one before or doesn't have its own hash. A last
    line without an end is left out. operation stays JSON, to be read by type."""
    from ..operators.replay import before_bad
    from ..operators.scan import numbered
    from ..operators.skew import lookup

    # a file is read in parts, each in its order; a part's place in the file and the row's in the part give the line
    told = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).select(told["file_path"].alias("tree"), told["file_block_start"].alias("_part"), told["file_size"].alias("_size"), F.monotonically_increasing_id().alias("_at"), F.octet_length("value").alias("_held"), F.regexp_replace("value", r"\r\z", "").alias("raw"))
    rows = lines.select("*", F.from_json("raw", RECORD).alias("_r"), _hash_of(F.col("raw")).alias("_own")).select(*lines.columns, "_r.*", "_own")
    rows = numbered(rows, ["tree"], ["_part", "_at"], "line", {"_before": "hash"})
    # what has no end is a file's last line, and only if the lines with their ends are more than the file
    sizes = rows.groupBy(F.col("tree").alias("_of")).agg(F.count("*").alias("_n"), (F.sum(F.col("_held") + 1) > F.max("_size")).alias("_open")).where("_open")
    rows = lookup(rows, "tree", sizes, "_of", "_n").where("not (coalesce(_open, false) and line = _n)")
    good = F.col("sequence").eqNullSafe(F.col("line")) & F.col("hash").eqNullSafe(F.col("_own")) & F.col("hash").isNotNull() & F.col("prevHash").eqNullSafe(F.col("_before"))
    out = rows.withColumn("_good", good)
    bad = out.groupBy(F.col("tree").alias("_bad_of")).agg(F.min(F.when(~F.col("_good"), F.col("line"))).alias("_bad"), F.count("*").alias("_lines")).where("_bad is not null")
    out = lookup(out, "tree", bad, "_bad_of", "_lines")
    return out.select("tree", "line", "raw", *(c.split()[0] for c in RECORD.split(", ")), F.coalesce(F.col("line") < F.col("_bad"), F.lit(True)).alias("valid"))


def committed_operations(records: DataFrame) -> DataFrame:
    """(tree, commit_seq, seq, type, id, leaf, operation) of valid records' operations whose transaction is committed as it stands."""
    from ..operators import replay

    own = records.where(F.col("valid") & (F.col("schemaVersion") == VERSION))
    tx = F.concat_ws("\n", "tree", "transactionId").alias("tx")
    ops = own.where("kind = 'operation'").select(tx, "tree", F.col("sequence").alias("seq"), "hash", "operation")
    commits = own.where("kind = 'commit'").select(tx, F.col("sequence").alias("seq"), F.col("operationHashes").alias("hashes"))
    get = F.get_json_object
    op = F.col("operation")
    id_ = F.coalesce(get(op, "$.id"), get(op, "$.leaf.id"), get(op, "$.edge.id"), get(op, "$.file"))
    return replay.committed(ops, commits).select("tree", "commit_seq", "seq", get(op, "$.type").alias("type"), id_.alias("id"), "operation")


def leaves_of(operations: DataFrame) -> DataFrame:
    """(tree, id, leaf, seq, provenance fields) of the live leaves of every tree; leaf is JSON."""
    from ..operators import replay

    get = F.get_json_object
    own = operations.where("type like 'leaf.%'").select(
        F.concat_ws("\n", "tree", "id").alias("id"), "commit_seq", "seq", F.substring_index("type", ".", -1).alias("type"), get("operation", "$.leaf").alias("value"),
        F.from_json(get("operation", "$.provenance"), "map<string,string>").alias("provenance"),
    )
    out = replay.leaf_state(own, ("commit_seq", "seq"), PROVENANCE)
    return out.select(F.substring_index("id", "\n", 1).alias("tree"), F.substring_index("id", "\n", -1).alias("id"), F.col("value").alias("leaf"), "seq", *PROVENANCE)
