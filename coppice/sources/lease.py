"""A lease on a folder, for stores whose file locks other machines don't see: a file that its holder keeps renewing."""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from pathlib import Path

#: Seconds after which a lease that isn't renewed is anyone's, and the share of them after which it is renewed.
STALE, RENEW = 10.0, 0.2


class Lost(Exception):
    """Another holds the lease: what was done under it must not be committed."""


class Lease:
    """Held within a with block. Whoever finds it stale takes it over; its former holder learns that by `check`."""

    def __init__(self, folder: str | Path, stale: float = STALE, wait: float = 60.0):
        self.file, self.stale, self.wait = Path(folder) / "lease.json", stale, wait
        self.token = uuid.uuid4().hex
        self._over = threading.Event()

    def _read(self, file: Path | None = None) -> dict | None:
        try:
            return json.loads((file or self.file).read_text())
        except (FileNotFoundError, ValueError):
            return None

    def _own(self, name: str) -> Path:
        return self.file.with_name(f"lease-{self.token}.{name}")

    def _write(self) -> Path:
        new = self._own("new")
        new.write_text(json.dumps({"token": self.token, "updatedAt": time.time()}))
        return new

    def _take(self) -> bool:
        new = self._write()
        try:
            os.link(new, self.file)  # fails if there is one
            return True
        except FileExistsError:
            return False
        finally:
            new.unlink()

    def _remove_stale(self) -> None:
        """Puts a lease that isn't renewed aside. Only one of several gets it, and one that was renewed meanwhile is put back."""
        seen = self._read()
        if seen is not None and time.time() - seen["updatedAt"] <= self.stale:
            return
        aside = self._own("aside")
        try:
            os.rename(self.file, aside)
        except FileNotFoundError:
            return
        if (got := self._read(aside)) is not None and got != seen and time.time() - got["updatedAt"] <= self.stale:
            try:
                os.link(aside, self.file)
            except FileExistsError:
                pass
        aside.unlink()

    def check(self) -> None:
        if (now := self._read()) is None or now["token"] != self.token:
            raise Lost(str(self.file))

    def _renew(self) -> None:
        while not self._over.wait(self.stale * RENEW):
            try:
                self.check()
                os.replace(self._write(), self.file)
            except (Lost, OSError):
                return

    def __enter__(self) -> Lease:
        self.file.parent.mkdir(parents=True, exist_ok=True)
        until = time.time() + self.wait
        while not self._take():
            if time.time() > until:
                raise TimeoutError(f"held by another: {self.file}")
            self._remove_stale()
            time.sleep(min(0.05, self.stale / 10))
        self._over.clear()
        self._thread = threading.Thread(target=self._renew, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._over.set()
        self._thread.join()
        if (now := self._read()) is not None and now["token"] == self.token:
            self.file.unlink(missing_ok=True)
