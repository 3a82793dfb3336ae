"""Lists of folders that must not, or may always, be indexed, kept in one JSON file."""

from __future__ import annotations

import json
from pathlib import Path, PurePosixPath

from lodeseek.config import write_json


def home_ancestors(home: str) -> list[str]:
    """`/` and every folder on the way to the home folder, itself included."""
    return [str(p) for p in reversed(PurePosixPath(home).parents)] + ([home] if home != "/" else [])


class SafetyLists:
    """blacklist and whitelist; a missing or unreadable file is two empty lists."""

    def __init__(self, path: str | Path, home: str) -> None:
        self.path, self.home = Path(path), home

    def _read(self) -> dict[str, list[str]]:
        try:
            found = json.loads(self.path.read_text("utf-8"))
        except (OSError, ValueError):
            found = {}
        if not self.path.exists():
            write_json(self.path, {"blacklist": [], "whitelist": []})
        return {k: list(found.get(k) or []) if isinstance(found, dict) else [] for k in ("blacklist", "whitelist")}

    def show(self, name: str) -> list[str]:
        own = self._read()[name]
        return list(dict.fromkeys([*home_ancestors(self.home), *own])) if name == "blacklist" else own

    def add(self, name: str, path: str) -> list[str]:
        lists = self._read()
        lists[name] = list(dict.fromkeys([*lists[name], self._full(path)]))
        write_json(self.path, lists)
        return lists[name]

    def remove(self, name: str, path: str) -> list[str]:
        lists = self._read()
        lists[name] = [x for x in lists[name] if x != self._full(path)]
        write_json(self.path, lists)
        return lists[name]

    def clear(self, name: str) -> None:
        write_json(self.path, self._read() | {name: []})

    def _full(self, path: str) -> str:
        return str(Path(path.replace("~", self.home, 1) if path.startswith("~") else path).absolute())

    def is_whitelisted(self, path: str) -> bool:
        target = PurePosixPath(self._full(path))
        return any(target == PurePosixPath(w) or PurePosixPath(w) in target.parents for w in self._read()["whitelist"])

    def is_blacklisted(self, path: str) -> bool:
        return not self.is_whitelisted(path) and self._full(path) in self.show("blacklist")
