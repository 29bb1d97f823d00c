"""The lock of a running index: one file beside the store, with the progress that readers show."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime
from pathlib import Path

from ..sources.files import read_json, write_json

FILE = "lock.json"


def alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True


class IndexLock:
    def __init__(self, folder: str | Path):
        self.path = Path(folder, FILE)

    def info(self) -> dict | None:
        """What the holder last said; None, and the file goes, if there is none or its process has ended."""
        found = read_json(self.path)
        if found is None or not alive(int(found.get("pid", 0) or -1)):
            if self.path.exists():
                self.path.unlink(missing_ok=True)
            return None
        return found

    def acquire(self) -> bool:
        """False while another process, or another run of this one, holds the lock."""
        self.info()
        self.path.parent.mkdir(parents=True, exist_ok=True)
        mine = self.path.with_name(f"{FILE}.{os.getpid()}.{id(self)}")
        mine.write_text(json.dumps({"pid": os.getpid(), "started": datetime.now(UTC).isoformat(), "current": 0, "total": 0}), "utf-8")
        try:
            os.link(mine, self.path)  # fails if there is one, and shows the whole file at once
            return True
        except FileExistsError:
            return False
        finally:
            mine.unlink(missing_ok=True)

    def update(self, current: int, total: int, **facts) -> None:
        """current_stage, failed_count and provider_health keep what they were where None is given."""
        found = read_json(self.path) or {}
        write_json(self.path, found | {"current": current, "total": total} | {k: v for k, v in facts.items() if v is not None})

    def release(self) -> None:
        self.path.unlink(missing_ok=True)
