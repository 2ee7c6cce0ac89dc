"""Run and project files in YAML, and environment files."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

DEFAULT_POLICIES = ("recorded", "query_only", "last_answer_x3", "compact_state", "public_trace")
GATES = ("min_recall_at_5", "max_zero_recall_at_k", "max_stale_at_1", "max_false_lead_at_k")


class ConfigError(ValueError):
    """A file holds something that no setting allows."""


def load_yaml(path: str | Path) -> dict[str, Any]:
    import yaml

    data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if data is None:
        return {}
    if not isinstance(data, dict):
        raise ConfigError(f"{path}: a mapping is expected")
    return data


def load_env(path: str | Path) -> int:
    """Set variables of NAME=value lines that are not set yet; the number set. A missing file has none."""
    file = Path(path)
    if not file.is_file():
        return 0
    done = 0
    for raw in file.read_text(encoding="utf-8").splitlines():
        line = raw.strip().removeprefix("export ").strip()
        name, sign, value = line.partition("=")
        name, value = name.strip(), value.strip()
        if not sign or not name or line.startswith("#") or name in os.environ:
            continue
        if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
            value = value[1:-1]
        os.environ[name] = value
        done += 1
    return done


def pick(given: Any, config: dict[str, Any], key: str, default: Any = None) -> Any:
    """A setting by precedence: command line, file (dotted key), default."""
    if given is not None:
        return given
    at: Any = config
    for part in key.split("."):
        if not isinstance(at, dict) or part not in at:
            return default
        at = at[part]
    return default if at is None else at


def names_of(value: Any) -> list[str]:
    """A list of names from a list or a text with commas, each once."""
    parts = value.split(",") if isinstance(value, str) else list(value or [])
    if not all(isinstance(p, str) for p in parts):
        raise ConfigError("a list of names is expected")
    return list(dict.fromkeys(p.strip() for p in parts if p.strip()))


@dataclass
class RunSpec:
    """All settings of a run."""

    name: str | None = None
    registry: str = ".sextant/runs"
    root: str = "."
    rag_config: str | None = None
    baseline_report: str | None = None
    primary_metric: str = "retrieval_source_recall"
    regression_metric: str | None = None
    max_drop: float = 0.02
    trace_input: str | None = None
    trace_source: str | None = None
    trace_format: str = "auto"
    require_gold: bool = False
    corpus: str | None = None
    policies: tuple[str, ...] = DEFAULT_POLICIES
    k: int = 10
    gate_policy: str | None = None
    gates: dict[str, float] = field(default_factory=dict)
    retriever_url: str | None = None
    retriever_headers: tuple[str, ...] = ()
    retriever_timeout: float = 10.0
    debug_artifacts: bool = False
    snapshot_inputs: bool = False


#: The keys that each part of a project file may have.
PROJECT_KEYS = {
    "": {"name", "registry", "repo_root", "rag", "trace", "artifacts"},
    "rag": {"config", "baseline_report", "primary_metric", "regression_metric", "max_drop"},
    "trace": {"input", "source", "corpus", "policies", "k", "retriever", "gate"},
    "trace.source": {"input", "format", "require_gold"},
    "trace.retriever": {"url", "headers", "timeout_s"},
    "trace.gate": {"policy", *GATES},
    "artifacts": {"debug_artifacts", "snapshot_inputs"},
}


def _part(data: dict[str, Any], name: str) -> dict[str, Any] | None:
    got = pick(None, data, name) if name else data
    if got is None:
        return None
    if not isinstance(got, dict):
        raise ConfigError(f"{name} must be a mapping")
    if unknown := set(got) - PROJECT_KEYS[name]:
        raise ConfigError(f"unknown keys in {name or 'the project file'}: {', '.join(sorted(unknown))}")
    return got


def load_project(path: str | Path) -> RunSpec:
    """The run that a project file describes. Unknown keys, missing parts and contradictions are errors."""
    data = load_yaml(path)
    part = {name: _part(data, name) for name in PROJECT_KEYS}
    top, rag, trace = part[""] or {}, part["rag"], part["trace"]
    if rag is None and trace is None:
        raise ConfigError("at least one of rag or trace is required")
    source, retriever, gate = part["trace.source"], part["trace.retriever"], part["trace.gate"]
    if trace is not None and (trace.get("input") is None) == (source is None):
        raise ConfigError("exactly one of trace.input and trace.source is required")
    for name, got, key in (("trace.source", source, "input"), ("trace.retriever", retriever, "url"), ("trace.gate", gate, "policy")):
        if got is not None and not got.get(key):
            raise ConfigError(f"{name}.{key} is required")
    rag, trace, art = rag or {}, trace or {}, part["artifacts"] or {}
    spec = RunSpec(name=top.get("name"))
    spec.registry = top.get("registry") or spec.registry
    root = Path(top.get("repo_root") or ".")
    spec.root = (root if root.is_absolute() else (Path(path).resolve().parent / root).resolve()).as_posix()
    spec.rag_config, spec.baseline_report, spec.regression_metric = rag.get("config"), rag.get("baseline_report"), rag.get("regression_metric")
    spec.primary_metric = rag.get("primary_metric") or spec.primary_metric
    spec.max_drop = spec.max_drop if rag.get("max_drop") is None else float(rag["max_drop"])
    spec.trace_input, spec.corpus, spec.k = trace.get("input"), trace.get("corpus"), int(trace.get("k", spec.k))
    spec.policies = tuple(names_of(trace.get("policies"))) or DEFAULT_POLICIES
    if source:
        spec.trace_source, spec.trace_format, spec.require_gold = source["input"], source.get("format", "auto"), bool(source.get("require_gold"))
    if gate:
        spec.gate_policy, spec.gates = gate["policy"], {k: float(gate[k]) for k in GATES if gate.get(k) is not None}
    if retriever:
        spec.retriever_url, spec.retriever_headers, spec.retriever_timeout = retriever["url"], tuple(retriever.get("headers") or ()), float(retriever.get("timeout_s", 10.0))
    spec.debug_artifacts, spec.snapshot_inputs = bool(art.get("debug_artifacts")), bool(art.get("snapshot_inputs"))
    return spec


def options_of(spec: RunSpec) -> dict[str, Any]:
    """A spec as plain values for a manifest."""
    return {f.name: list(v) if isinstance(v := getattr(spec, f.name), tuple) else v for f in fields(spec)}
