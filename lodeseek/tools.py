"""The host's side: tools and hooks by name, with those that settings switch off left out."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek import config as C
from lodeseek.config import ProjectConfig
from lodeseek.engine import Engine
from lodeseek.operators.eligibility import redirects_grep
from lodeseek.safety import SafetyLists


def to_tool_output(value: Any) -> str:
    """Text as it is, anything else as JSON with two blanks of indentation."""
    return value if isinstance(value, str) else json.dumps(value, indent=2, ensure_ascii=False, default=str)


def _one(df: DataFrame) -> dict[str, Any]:
    return df.first().asDict(recursive=True)


@dataclass
class Host:
    """What tools and hooks work on. `files` gives the present listing (file_path, content, size_bytes)."""

    engine: Engine
    project: ProjectConfig
    safety: SafetyLists
    files: Callable[[], DataFrame]
    now_ms: Callable[[], int]

    def search(self, query: str, top_k: int | None = None, threshold: float | None = None, path: str | None = None, hybrid: bool | None = None) -> list[dict[str, Any]]:
        """One query's results, at most top_k rows."""
        asked = self.engine.spark.createDataFrame([(1, query)], "query_id bigint, query_text string")
        rows = self.engine.matches(asked, top_k=top_k, threshold=threshold, path=path, hybrid=hybrid).orderBy("place").collect()
        shown = ({"file": r.file, "lines": r.lines, "similarity": r.similarity, "score": r.score, "preview": r.preview, "_note": r.note} for r in rows)
        return [{k: v for k, v in x.items() if v is not None} for x in shown]

    def index(self) -> dict[str, Any]:
        """The overview; its list of files is read from the index by `Engine.file_list`."""
        if not self.engine.warehouse.exists():
            return {"status": "no_index", "message": "No index yet; the next session makes one.", "config": self.engine._config()}
        return _one(self.engine.overview(self.files()))

    def lists(self, name: str, action: str, path: str | None = None) -> dict[str, Any]:
        """show, add, remove or clear one of the folder lists."""
        if action == "add" and path:
            self.safety.add(name, path)
        elif action == "remove" and path:
            self.safety.remove(name, path)
        elif action == "clear":
            self.safety.clear(name)
        elif action != "show":
            raise ValueError(f"{action} needs a path" if action in ("add", "remove") else f"no such action: {action}")
        return {name: self.safety.show(name)}

    def config(self, action: str, key: str | None = None, value: str | None = None) -> Any:
        """view, set, provider or reset."""
        if action == "view":
            return [{"key": k, "value": v, "source": s} for k, v, s in self.project.show()]
        if action == "set":
            return self.project.set(key or "", value or "")
        if action == "provider":
            return self.project.provider(key)
        if action == "reset":
            self.project.reset(key)
            return {"reset": key or "all"}
        raise ValueError(f"no such action: {action}")


def tools(host: Host, disabled: list[str] | None = None) -> dict[str, Callable[..., str]]:
    """The tools by name, each giving text; those in `disabled` (by default the setting) are left out."""
    e = host.engine
    every: dict[str, Callable[..., Any]] = {
        "search": host.search,
        "index": host.index,
        "status": lambda: _one(e.status()),
        "reindex": lambda: e.reindex(host.files()),
        "run_indexer": lambda: e.sync(host.files(), force=True),
        "terminate_indexer": e.terminate,
        "config": host.config,
        "blacklist": lambda action="show", path=None: host.lists("blacklist", action, path),
        "whitelist": lambda action="show", path=None: host.lists("whitelist", action, path),
    }
    off = set(C.get(e.settings, "disabled_tools") if disabled is None else disabled)
    return {name: (lambda *a, f=f, **kw: to_tool_output(f(*a, **kw))) for name, f in every.items() if name not in off}


def hook_enabled(settings: dict[str, Any], name: str, flag: str) -> bool:
    """Neither named in disabled_hooks nor switched off by its own flag."""
    return name not in C.get(settings, "disabled_hooks") and bool(C.get(settings, f"hooks.{flag}"))


def hooks(host: Host) -> dict[str, Callable[..., Any]]:
    """The enabled hooks by the host's event."""
    e, s = host.engine, host.engine.settings

    def edited(path: str) -> str | None:
        return e.reembed(host.files().where(F.col("file_path") == path)) if path else None

    def before_tool(tool: str, args: dict[str, Any], output: dict[str, Any]) -> None:
        """Blocks a text search that reads like a question, if the index is in order."""
        if tool != "grep" or not C.get(s, "intercept.enabled"):
            return
        text = {k: args.get(k) if isinstance(args.get(k), str) else None for k in ("pattern", "path", "output_mode")}
        row = e.spark.createDataFrame([(text["pattern"] or "", text["path"], text["output_mode"])], "pattern string, path string, mode string")
        if not row.select(redirects_grep(F.col("pattern"), F.col("path"), F.col("mode"), C.get(s, "intercept.min_pattern_length"))).first()[0] or not e.health().first().healthy:
            return
        output.update(blocked=True, message="The index answers this better: use the search tool first, then search by text in the files it names.")
        output["metadata"] = (output.get("metadata") or {}) | {"redirect": {"pattern": text["pattern"], "suggested_tool": "search"}}

    def after_tool(tool: str) -> str | None:
        return e.collect_garbage(host.files(), host.now_ms()) if tool == "bash" else None

    def compacting(output: dict[str, list[str]]) -> None:
        output.setdefault("context", []).append(e.sentence().first().sentence)

    every = {
        "session.created": ("auto-sync", "auto_sync", lambda: e.sync(host.files())),
        "file.edited": ("reembed-file", "reembed_on_edit", edited),
        "tool.execute.before": ("grep-redirect", "grep_redirect", before_tool),
        "tool.execute.after": ("gc-after-bash", "gc_after_bash", after_tool),
        "session.compacting": ("compact-status", "compact_status", compacting),
    }
    return {event: f for event, (name, flag, f) in every.items() if hook_enabled(s, name, flag)}
