"""Configuration files: sources, taxonomy, classifier, deduplication."""

from dataclasses import dataclass, field
from pathlib import Path

from .adapters import FIELDS


class ConfigError(Exception):
    pass


def _yaml(path) -> object:
    import yaml

    try:
        return yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError as e:
        raise ConfigError(f"config not found: {path}") from e
    except yaml.YAMLError as e:
        raise ConfigError(f"config is not valid YAML: {e}") from e


def check_source(raw: object) -> dict:
    """A complete source config; unknown types, missing or extra fields fail."""
    if not isinstance(raw, dict):
        raise ConfigError("a source must be a mapping")
    kind, name = raw.get("type"), raw.get("name")
    if kind not in FIELDS:
        raise ConfigError(f"unknown source type: {kind!r}")
    if not isinstance(name, str) or not name:
        raise ConfigError("a source needs a name")
    required, optional = FIELDS[kind]
    if extra := set(raw) - set(required) - set(optional) - {"type", "name"}:
        raise ConfigError(f"{name}: unknown field(s) {sorted(extra)}")
    out = {"name": name, "type": kind}
    for k, t in required.items():
        if not isinstance(raw.get(k), t):
            raise ConfigError(f"{name}: {k} is required")
        out[k] = raw[k]
    for k, (t, default) in optional.items():
        out[k] = raw.get(k, default)
        if not isinstance(out[k], t) or isinstance(out[k], bool):
            raise ConfigError(f"{name}: {k} must be {t.__name__}")
    return out


def load_sources(path) -> list[dict]:
    raw = _yaml(path)
    entries = raw.get("sources") if isinstance(raw, dict) else None
    if not isinstance(entries, list) or not entries:
        raise ConfigError("sources must be a non-empty list")
    out = [check_source(e) for e in entries]
    names = [s["name"] for s in out]
    if twice := {n for n in names if names.count(n) > 1}:
        raise ConfigError(f"duplicate source name(s): {sorted(twice)}")
    return out


@dataclass
class AgentConfig:
    taxonomy: list[dict]
    provider: str = "gemini"
    model: str = "gemini-2.5-flash"
    batch_size: int = 10
    token_budget: int | None = None
    temperature: float = 0.2
    max_items_per_run: int | None = 200
    title_threshold: float = 0.92
    window_hours: int = 48
    entity_threshold: float = 0.85
    vault_path: str | None = None
    research_focus: str | None = None
    tracking: list[str] = field(default_factory=list)

    @property
    def slugs(self) -> set[str]:
        return {t["slug"] for t in self.taxonomy}

    def render_taxonomy(self) -> str:
        lines = []
        for t in self.taxonomy:
            examples = f" (e.g. {', '.join(t['examples'])})" if t.get("examples") else ""
            lines.append(f"- {t['slug']}: {t['description']}{examples}")
        return "\n".join(lines)


def load_agent(path) -> AgentConfig:
    raw = _yaml(path)
    if not isinstance(raw, dict) or not raw.get("taxonomy"):
        raise ConfigError("the agent config must define a non-empty taxonomy")
    for t in raw["taxonomy"]:
        if not isinstance(t, dict) or not isinstance(t.get("slug"), str) or not isinstance(t.get("description"), str) or set(t) - {"slug", "description", "examples"}:
            raise ConfigError(f"bad taxonomy entry: {t!r}")
    c, d = raw.get("classifier") or {}, raw.get("dedup") or {}
    out = AgentConfig(raw["taxonomy"], vault_path=raw.get("vault_path"), research_focus=raw.get("research_focus"), tracking=raw.get("tracking_params_to_strip") or [])
    for key in ("provider", "model", "batch_size", "token_budget", "temperature", "max_items_per_run"):
        setattr(out, key, c.get(key, getattr(out, key)))
    out.title_threshold = d.get("fuzzy_title_threshold", out.title_threshold)
    out.window_hours = d.get("fuzzy_window_hours", out.window_hours)
    out.entity_threshold = d.get("entity_title_threshold", out.entity_threshold)
    whole = lambda v, least, none: (none and v is None) or (isinstance(v, int) and not isinstance(v, bool) and v >= least)
    share = lambda v: isinstance(v, (int, float)) and 0 <= v <= 1
    checks = {
        "provider": out.provider in ("gemini", "ollama", "anthropic"), "batch_size": whole(out.batch_size, 1, False), "token_budget": whole(out.token_budget, 1, True),
        "max_items_per_run": whole(out.max_items_per_run, 1, True), "temperature": isinstance(out.temperature, (int, float)) and out.temperature >= 0,
        "fuzzy_title_threshold": share(out.title_threshold), "entity_title_threshold": share(out.entity_threshold), "fuzzy_window_hours": whole(out.window_hours, 0, False)}
    if bad := [k for k, ok in checks.items() if not ok]:
        raise ConfigError(f"invalid agent config: {', '.join(bad)}")
    return out
