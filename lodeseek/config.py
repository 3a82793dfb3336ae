"""Configuration: defaults, layered merge, dot-path access, typed values, provider presets."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from copy import deepcopy
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The defaults.
DEFAULTS: dict[str, Any] = {
    "embedding": {"api_base": "http://localhost:11434/v1", "model": "nomic-embed-text", "api_key_env": "", "dimensions": 768, "batch_size": 10, "query_prefix": "search_query: "},
    "chunking": {"strategy": "hybrid", "max_tokens": 512, "overlap_tokens": 50},
    "indexing": {
        "include": ["**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx", "**/*.py", "**/*.go", "**/*.rs", "**/*.java", "**/*.rb", "**/*.php", "**/*.sql", "**/*.md"],
        "exclude": ["node_modules/**", "dist/**", "build/**", ".next/**", "*.lock", "*.min.js"],
        "max_file_size_kb": 500,
        "auto_index": True,
        "max_files": 10000,
        "concurrency": 4,
    },
    "search": {"top_k": 10, "similarity_threshold": 0.35, "hybrid": {"enabled": True, "weight_vector": 0.4, "weight_bm25": 0.3, "weight_rrf": 0.3, "doc_penalty": 0.5, "identifier_boost": 1.5, "debug": False}},
    "storage": {"path": ".lodeseek"},
    "intercept": {"enabled": True, "min_pattern_length": 4},
    "hooks": {"auto_sync": True, "reembed_on_edit": True, "gc_after_bash": True, "grep_redirect": True, "compact_status": True},
    "disabled_tools": [],
    "disabled_hooks": [],
    "safety": {"global_config_path": "~/.config/lodeseek/safety.json"},
}

# Provider -> api_base, model, api_key_env, dimensions, batch_size, query_prefix.
PROVIDERS = {
    "ollama": ("http://localhost:11434/v1", "nomic-embed-text", "", 768, 10, "search_query: "),
    "openai": ("https://api.openai.com/v1", "text-embedding-3-small", "OPENAI_API_KEY", 1536, 100, ""),
    "voyage": ("https://api.voyageai.com/v1", "voyage-code-3", "VOYAGE_API_KEY", 1024, 50, ""),
    "litellm": ("http://localhost:4000/v1", "voyage-code-3", "LITELLM_API_KEY", 1024, 50, ""),
}
PROVIDER_KEYS = ("api_base", "model", "api_key_env", "dimensions", "batch_size", "query_prefix")


class ConfigError(ValueError):
    pass


def merge(*layers: dict[str, Any]) -> dict[str, Any]:
    """Later layers over earlier ones: objects merge key by key, lists are joined without repeats, other values replace."""
    out: dict[str, Any] = {}
    for layer in layers:
        for key, value in layer.items():
            have = out.get(key)
            if isinstance(have, dict) and isinstance(value, dict):
                out[key] = merge(have, value)
            elif isinstance(have, list) and isinstance(value, list):
                out[key] = list({json.dumps(x): x for x in have + value}.values())
            elif value is not None:
                out[key] = deepcopy(value)
    return out


def flatten(tree: dict[str, Any], prefix: str = "") -> Iterator[tuple[str, Any]]:
    """Dot-path and value of every leaf; lists are leaves."""
    for key, value in tree.items():
        if isinstance(value, dict):
            yield from flatten(value, f"{prefix}{key}.")
        else:
            yield prefix + key, value


def get(tree: dict[str, Any], path: str) -> Any:
    for part in path.split("."):
        if not isinstance(tree, dict) or part not in tree:
            return None
        tree = tree[part]
    return tree


def put(tree: dict[str, Any], path: str, value: Any) -> dict[str, Any]:
    """A copy with the value at the path; folders on the way are made."""
    out = deepcopy(tree)
    *way, last = path.split(".")
    at = out
    for part in way:
        if not isinstance(at.get(part), dict):
            at[part] = {}
        at = at[part]
    at[last] = value
    return out


def drop(tree: dict[str, Any], path: str) -> dict[str, Any]:
    """A copy without the path, and without objects that it leaves empty."""
    head, _, rest = path.partition(".")
    out = deepcopy(tree)
    if not rest:
        out.pop(head, None)
    elif isinstance(out.get(head), dict):
        below = drop(out[head], rest)
        if below:
            out[head] = below
        else:
            del out[head]
    return out


def parse_value(raw: str, default: Any) -> Any:
    """A text as the type of the default: number, true/false, list (JSON or comma-separated), else text."""
    if isinstance(default, bool):
        if raw.lower() not in ("true", "false"):
            raise ConfigError(f"not true or false: {raw}")
        return raw.lower() == "true"
    if isinstance(default, (int, float)):
        try:
            x = float(raw)
        except ValueError as e:
            raise ConfigError(f"not a number: {raw}") from e
        return int(x) if x.is_integer() else x
    if isinstance(default, list):
        if raw.lstrip().startswith("["):
            try:
                value = json.loads(raw)
            except ValueError as e:
                raise ConfigError(f"not a JSON list: {raw}") from e
            if not isinstance(value, list):
                raise ConfigError(f"not a list: {raw}")
            return value
        return [x.strip() for x in raw.split(",") if x.strip()]
    return raw


_JSONC = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/|,(?=\s*[}\]])', re.DOTALL)


def read_jsonc(path: str | Path) -> dict[str, Any]:
    """JSON with comments and trailing commas; `.jsonc` is preferred to `.json`; {} if neither exists."""
    for p in (Path(path).with_suffix(".jsonc"), Path(path).with_suffix(".json")):
        if p.exists():
            return json.loads(_JSONC.sub(lambda m: m[1] or "", p.read_text("utf-8")) or "{}")
    return {}


def write_json(path: str | Path, tree: dict[str, Any]) -> None:
    """Pretty JSON by way of a draft that is renamed, so readers never see half a file."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    draft = p.with_name(p.name + ".draft")
    draft.write_text(json.dumps(tree, indent=2, ensure_ascii=False) + "\n", "utf-8")
    os.replace(draft, p)


def load(*paths: str | Path) -> dict[str, Any]:
    """Defaults under the given files, later files over earlier ones, checked."""
    return check(merge(DEFAULTS, *(read_jsonc(p) for p in paths)))


def check(tree: dict[str, Any]) -> dict[str, Any]:
    """The tree, if every known leaf has the type of its default and lies in its range."""
    for path, default in flatten(DEFAULTS):
        value = get(tree, path)
        fits = isinstance(value, bool) if isinstance(default, bool) else isinstance(value, (int, float)) and not isinstance(value, bool) if isinstance(default, (int, float)) else isinstance(value, type(default))
        if not fits:
            raise ConfigError(f"{path}: {value!r}")
    if get(tree, "chunking.strategy") not in ("syntax", "hybrid", "fixed"):
        raise ConfigError("chunking.strategy")
    if not 0 <= get(tree, "search.similarity_threshold") <= 1:
        raise ConfigError("search.similarity_threshold")
    return tree


class ProjectConfig:
    """A project's own settings over the defaults."""

    def __init__(self, path: str | Path) -> None:
        self.path = Path(path)

    @property
    def user(self) -> dict[str, Any]:
        return read_jsonc(self.path)

    @property
    def effective(self) -> dict[str, Any]:
        return check(merge(DEFAULTS, self.user))

    def show(self) -> list[tuple[str, Any, str]]:
        """(key, value, source) with source user or default."""
        own = dict(flatten(self.user))
        return [(k, v, "user" if k in own else "default") for k, v in flatten(self.effective)]

    def set(self, key: str, raw: str) -> dict[str, Any]:
        default = get(DEFAULTS, key)
        if default is None or isinstance(default, dict):
            raise ConfigError(f"no such key: {key}")
        before = get(self.effective, "embedding.dimensions")
        value = parse_value(raw, default)
        tree = put(self.user, key, value)
        check(merge(DEFAULTS, tree))
        write_json(self.path, tree)
        return {"key": key, "value": value, "dimensions_changed": get(self.effective, "embedding.dimensions") != before}

    def provider(self, name: str | None = None) -> dict[str, Any]:
        """Without a name the presets; with one, its settings are taken over."""
        if name is None:
            return {k: dict(zip(PROVIDER_KEYS, v, strict=True)) for k, v in PROVIDERS.items()}
        if name not in PROVIDERS:
            raise ConfigError(f"no such provider: {name}")
        before = get(self.effective, "embedding.dimensions")
        write_json(self.path, merge(self.user, {"embedding": dict(zip(PROVIDER_KEYS, PROVIDERS[name], strict=True))}))
        return {"provider": name, "dimensions_changed": get(self.effective, "embedding.dimensions") != before}

    def reset(self, section: str | None = None) -> None:
        if section is not None and get(DEFAULTS, section) is None:
            raise ConfigError(f"no such section: {section}")
        write_json(self.path, drop(self.user, section) if section else {})


# Provider -> what it is.
PROVIDER_NOTES = {"ollama": "Ollama (local)", "openai": "OpenAI", "voyage": "Voyage AI", "litellm": "LiteLLM proxy (Vertex AI, Bedrock, etc.)"}


def summary(tree: dict[str, Any], storage: str) -> dict[str, Any]:
    """The settings that status reports show, with the preset they agree with."""
    e = tree["embedding"]
    name = next((k for k, v in PROVIDERS.items() if (v[0], v[1], v[3]) == (e["api_base"], e["model"], e["dimensions"])), "custom")
    return {
        "model": e["model"], "endpoint": e["api_base"], "dimensions": e["dimensions"], "provider": name, "provider_description": PROVIDER_NOTES.get(name, "Custom"),
        "chunking_strategy": get(tree, "chunking.strategy"), "max_tokens_per_chunk": get(tree, "chunking.max_tokens"), "storage_path": storage,
    }


def providers_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v[0], v[1], v[3]) for k, v in PROVIDERS.items()], "provider string, api_base string, model string, dimensions int")


def detect_provider(settings: DataFrame) -> DataFrame:
    """`settings` (api_base, model, dimensions, ...) with `provider`: the preset that agrees in all three, else custom."""
    presets = F.broadcast(providers_table(settings.sparkSession))
    return settings.join(presets, ["api_base", "model", "dimensions"], "left").withColumn("provider", F.coalesce("provider", F.lit("custom")))


def sources_table(spark: SparkSession, user: dict[str, Any]) -> DataFrame:
    """key, value (as JSON text) and source of every setting."""
    default = spark.createDataFrame([(k, json.dumps(v)) for k, v in flatten(DEFAULTS)], "key string, default_value string")
    own = spark.createDataFrame([(k, json.dumps(v)) for k, v in flatten(user)], "key string, user_value string")
    return default.join(own, "key", "left").select("key", F.coalesce("user_value", "default_value").alias("value"), F.when(F.col("user_value").isNotNull(), "user").otherwise("default").alias("source"))
