"""A streaming source of file events: a directory tree compared with itself, look by look.

``spark.dataSource.register(DirectoryEvents)``, then
``spark.readStream.format("directory_events").option("journal", folder).load(root)``
gives ``path, op, ts``. The journal keeps the last listing and the events of
each look, so a batch that is asked for again after a failure is the same.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from lodestone.sources.scan import SKIPPED

SCHEMA = "path string, op string, ts timestamp"


class DirectoryEvents(DataSource):
    """Options: ``journal`` (a folder), ``maxEvents`` (a batch's events at most; the rest comes with the next)."""

    @classmethod
    def name(cls) -> str:
        return "directory_events"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options["journal"], int(self.options.get("maxevents", self.options.get("maxEvents", 0))))


def listing(root: str) -> dict[str, list[int]]:
    """Size and time of every file below a root, folders that are never looked into left out."""
    out = {}
    for base, folders, names in os.walk(root):
        folders[:] = [f for f in folders if f not in SKIPPED]
        for name in names:
            try:
                at = os.stat(os.path.join(base, name))
            except OSError:
                continue  # gone since
            out[os.path.relpath(os.path.join(base, name), root)] = [at.st_size, at.st_mtime_ns]
    return out


def differences(old: dict[str, list[int]], new: dict[str, list[int]]) -> list[tuple[str, str]]:
    """``path, op`` of what came, changed and went, by path."""
    ops = {p: "Remove" for p in old.keys() - new.keys()} | {p: "Add" for p in new.keys() - old.keys()}
    ops |= {p: "Change" for p in new.keys() & old.keys() if new[p] != old[p]}
    return sorted(ops.items())


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, root: str, journal: str, most: int):
        self.root, self.journal, self.most = root, journal, most
        os.makedirs(journal, exist_ok=True)

    def initialOffset(self) -> dict:
        return {"look": 0}

    def _file(self, name: str) -> str:
        return os.path.join(self.journal, f"{name}.json")

    def _load(self, name: str):
        with open(self._file(name), encoding="utf-8") as f:
            return json.load(f)

    def _save(self, name: str, value) -> None:
        with open(self._file(f"{name}.new"), "w", encoding="utf-8") as f:
            json.dump(value, f)
        os.replace(self._file(f"{name}.new"), self._file(name))

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        look = start["look"]
        if os.path.exists(self._file(f"events-{look + 1}")):  # this look was taken before a failure
            return self.readBetweenOffsets(start, {"look": look + 1}), {"look": look + 1}
        old = self._load(f"listing-{look}") if look else {}
        new = listing(self.root)
        found = differences(old, new)
        if not found:
            return iter(()), start
        if self.most and len(found) > self.most:
            found = found[: self.most]
            taken = {p for p, _ in found}
            new = {p: v for p, v in old.items() if p not in taken} | {p: new[p] for p in taken if p in new}
        at = datetime.now(timezone.utc).timestamp()
        self._save(f"listing-{look + 1}", new)
        self._save(f"events-{look + 1}", [[p, op, at] for p, op in found])
        return self.readBetweenOffsets(start, {"look": look + 1}), {"look": look + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        looks = range(start["look"] + 1, end["look"] + 1)
        # the engine copies the iterator, which a generator doesn't allow
        return iter([(path, op, datetime.fromtimestamp(at, timezone.utc)) for look in looks for path, op, at in self._load(f"events-{look}")])

    def commit(self, end: dict) -> None:
        """Looks before the committed one aren't asked for again."""
        for name in os.listdir(self.journal):
            kind, _, look = name.removesuffix(".json").partition("-")
            if kind in ("events", "listing") and look.isdigit() and int(look) < end["look"]:
                os.remove(os.path.join(self.journal, name))
