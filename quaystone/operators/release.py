"""Fingerprints of data and design, and a single-use release: frozen manifest, keyed approval, atomic receipt.

Fingerprints of tables are aggregates of row hashes, so they don't depend on partitions or order. The release
itself is metadata and files of the driver's own; no row is read here.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import json
import os
import re
import secrets
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MANIFEST_VERSION, APPROVAL_VERSION = 1, 1
ACTION = "single_locked_release"
MOST_SNAPSHOT_LAG = 35
_APPROVAL = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]{7,99}")


class ReleaseError(RuntimeError):
    """A release is refused."""


def canonical_json(value: Any) -> bytes:
    """Sorted, compact ASCII; a value that JSON can't hold raises."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False).encode()


def digest(value: Any) -> str:
    return hashlib.sha256(canonical_json(value)).hexdigest()


def content_fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows, and a digest of the column names, types and multiset of rows. Repeated rows count."""
    names = df.columns
    cells = [F.coalesce(F.sha2(F.to_json(F.struct(F.col(f"`{c}`").alias("v"))), 256), F.lit("")) for c in names]
    row = F.sha2(F.concat_ws("|", *cells), 256)
    part = lambda k: F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    sums = df.select(row.alias("h")).agg(F.count("*").alias("rows"), *(F.coalesce(F.sum(part(k)), F.lit(0)).cast("string").alias(f"s{k}") for k in range(4)))
    schema = digest([[f.name, f.dataType.simpleString()] for f in df.schema.fields])
    return sums.select("rows", F.sha2(F.concat_ws("|", F.lit(schema), F.col("rows").cast("string"), "s0", "s1", "s2", "s3"), 256).alias("fingerprint"))


def sequence_hash(pairs: Iterable[Iterable[str]]) -> str:
    """A digest of text in order, each part led by its length, so that joins can't be confused."""
    out = hashlib.sha256()
    for pair in pairs:
        for part in pair:
            raw = part.encode()
            out.update(f"{len(raw)}:".encode() + raw)
        out.update(b";")
    return out.hexdigest()


def provenance_hash(**parts: str) -> str:
    return sequence_hash(sorted(parts.items()))


def file_sha256(path: str | Path, block: int = 1 << 20) -> str:
    out = hashlib.sha256()
    with open(path, "rb") as file:
        while part := file.read(block):
            out.update(part)
    return out.hexdigest()


def source_sha256(package: str | Path, *more: str | Path) -> str:
    """A digest of the names and bytes of a package's Python files, at any depth, and of further files."""
    root, out = Path(package), hashlib.sha256()
    named = [(str(p.relative_to(root)), p) for p in sorted(root.rglob("*.py"))] + [(Path(p).name, Path(p)) for p in more]
    for name, path in named:
        out.update(name.encode() + b"\0" + path.read_bytes() + b"\0")
    return out.hexdigest()


def specification_hash(cohort: Any, frozen: Iterable[str], champions: dict[str, str], families: dict[str, tuple[str, ...]], seed: int) -> str:
    """A digest of who is in which split and what will be evaluated; the members are hashed as a table."""
    members = content_fingerprint(cohort.frame.select(F.col("ID").cast("string"), F.col("matched_company_number").cast("string"), "split")).first()
    return digest({"observed": cohort.observed.isoformat(), "seed": seed, "frozen": list(frozen), "champions": champions, "families": {k: list(v) for k, v in families.items()}, "members": members["fingerprint"], "rows": members["rows"]})


def require_snapshot_lag(observed: dt.date, snapshot: dt.date, path: str | Path = "", most: int = MOST_SNAPSHOT_LAG) -> int:
    """Days from the company snapshot to the observation, 0 to ``most``; a day in the file's name must be the snapshot's."""
    lag = (observed - snapshot).days
    if not 0 <= lag <= most:
        raise ReleaseError(f"the company snapshot is {lag} days before the observation, not 0 to {most}")
    named = set(re.findall(r"(?<!\d)20\d{2}-\d{2}-\d{2}(?!\d)", Path(path).name))
    if named and named != {snapshot.isoformat()}:
        raise ReleaseError(f"the file's name says {', '.join(sorted(named))}, not {snapshot.isoformat()}")
    return lag


def build_manifest(judgments: str | Path, companies: str | Path, observed: dt.date, snapshot: dt.date, settings: dict[str, Any], package: str | Path, sources: Iterable[str | Path] = (), bound: dict[str, str | Path] | None = None, contract: dict[str, Any] | None = None) -> dict[str, Any]:
    """Inputs, code, settings and contract of one release, with the manifest's own digest."""
    bound = bound or {}
    if unsafe := [n for n in bound if not re.fullmatch(r"[a-z][a-z0-9_]{2,63}", n)]:
        raise ReleaseError(f"unsafe name of a bound file: {unsafe[0]!r}")
    sources = sorted({Path(s).resolve() for s in sources})
    for path in (judgments, companies, *sources, *bound.values()):
        if not Path(path).is_file():
            raise ReleaseError(f"{path} is no file")
    lag = require_snapshot_lag(observed, snapshot, companies)
    manifest = {
        "schema_version": MANIFEST_VERSION,
        "observation_date": observed.isoformat(),
        "company_snapshot_date": snapshot.isoformat(),
        "company_snapshot_lag_days": lag,
        "inputs": {"judgments_sha256": file_sha256(judgments), "companies_sha256": file_sha256(companies), "bound_sha256": {n: file_sha256(p) for n, p in sorted(bound.items())}},
        "source_sha256": source_sha256(package, *sources),
        "settings": settings,
        "contract": contract or {},
    }
    return {"manifest": manifest, "manifest_sha256": digest(manifest)}


def checked_manifest(envelope: dict[str, Any]) -> str:
    """The digest of a manifest whose recorded one is right."""
    manifest, recorded = envelope.get("manifest"), envelope.get("manifest_sha256")
    if not isinstance(manifest, dict) or not isinstance(recorded, str) or manifest.get("schema_version") != MANIFEST_VERSION:
        raise ReleaseError("this is no manifest of this version")
    if not hmac.compare_digest(digest(manifest), recorded):
        raise ReleaseError("the manifest was changed")
    return recorded


def _write_new(path: str | Path, text: str | bytes, mode: int = 0o644) -> Path:
    """Create a file; one that is there already raises, also if another process makes it at the same time."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    try:
        handle = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, mode)
    except FileExistsError:
        raise ReleaseError(f"{path} is there already") from None
    with os.fdopen(handle, "wb") as file:
        file.write(text.encode() if isinstance(text, str) else text)
    return path


def read_json(path: str | Path) -> dict[str, Any]:
    try:
        value = json.loads(Path(path).read_text("utf-8"))
    except (OSError, ValueError) as fault:
        raise ReleaseError(f"{path} can't be read: {fault}") from fault
    if not isinstance(value, dict):
        raise ReleaseError(f"{path} holds no JSON object")
    return value


def _pretty(value: Any) -> str:
    return json.dumps(value, indent=2, sort_keys=True) + "\n"


def write_manifest(path: str | Path, envelope: dict[str, Any]) -> Path:
    checked_manifest(envelope)
    return _write_new(path, _pretty(envelope))


def generate_key(path: str | Path) -> Path:
    return _write_new(path, secrets.token_bytes(32), 0o600)


def _key(path: str | Path) -> bytes:
    key = Path(path).read_bytes()
    if len(key) < 32:
        raise ReleaseError("a key has 32 bytes or more")
    return key


def approve(manifest: str | Path, key: str | Path, approval: str | Path, approval_id: str) -> dict[str, Any]:
    """Sign one manifest for one release and write the approval as a new file."""
    if not _APPROVAL.fullmatch(approval_id):
        raise ReleaseError("an approval's name has 8 to 100 letters, digits and _ . -")
    granted = {"schema_version": APPROVAL_VERSION, "approval_id": approval_id, "authorized_action": ACTION, "manifest_sha256": checked_manifest(read_json(manifest))}
    envelope = {"authorization": granted, "hmac_sha256": hmac.new(_key(key), canonical_json(granted), hashlib.sha256).hexdigest()}
    _write_new(approval, _pretty(envelope))
    return envelope


def verify(manifest: str | Path, approval: str | Path, key: str | Path) -> dict[str, Any]:
    """The authorization of an approval that is sound in form, signature and manifest."""
    envelope = read_json(approval)
    granted, signature = envelope.get("authorization"), envelope.get("hmac_sha256")
    if not isinstance(granted, dict) or not isinstance(signature, str) or granted.get("schema_version") != APPROVAL_VERSION:
        raise ReleaseError("this is no approval of this version")
    if not hmac.compare_digest(hmac.new(_key(key), canonical_json(granted), hashlib.sha256).hexdigest(), signature):
        raise ReleaseError("the approval's signature is wrong")
    if granted.get("authorized_action") != ACTION or not _APPROVAL.fullmatch(str(granted.get("approval_id", ""))):
        raise ReleaseError("the approval is for something else")
    if not hmac.compare_digest(str(granted.get("manifest_sha256", "")), checked_manifest(read_json(manifest))):
        raise ReleaseError("the approval is for another manifest")
    return granted


def verify_sources(manifest: str | Path, **now: Any) -> str:
    """The frozen digest, if a manifest built of the present inputs has the same."""
    frozen = checked_manifest(read_json(manifest))
    if not hmac.compare_digest(build_manifest(**now)["manifest_sha256"], frozen):
        raise ReleaseError("inputs, code, settings or contract were changed after the freeze")
    return frozen


def reserve(registry: str | Path, granted: dict[str, Any]) -> Path:
    """Use an approval up: its receipt is created in one step, and only once."""
    name = str(granted.get("approval_id", ""))
    if not _APPROVAL.fullmatch(name):
        raise ReleaseError("the approval's name is not sound")
    record = {"approval_id": name, "manifest_sha256": granted.get("manifest_sha256"), "status": "reserved", "reserved_utc": dt.datetime.now(dt.UTC).isoformat()}
    return _write_new(Path(registry) / f"{name}.json", _pretty(record))


def finalise(receipt: str | Path, status: str, run_id: str | None = None) -> None:
    """Close a reserved receipt as completed or failed; a second time raises."""
    if status not in ("completed", "failed"):
        raise ValueError("a receipt ends as completed or failed")
    record, path = read_json(receipt), Path(receipt)
    if record.get("status") != "reserved":
        raise ReleaseError("the receipt is not open")
    record |= {"status": status, "finished_utc": dt.datetime.now(dt.UTC).isoformat()} | ({"run_id": run_id} if run_id else {})
    new = path.with_suffix(".new")
    new.write_text(_pretty(record), "utf-8")
    os.replace(new, path)
