"""Settings of a project: plain frozen classes, checked when they are made."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path
from typing import Any

import yaml

# What settings may be.
PROJECT_TYPES = ("web_app", "api", "cli", "library", "research", "mobile", "fullstack", "data_pipeline")
PHASE_STYLES = ("phased", "continuous")
TRIGGERS = ("manual", "file_watch", "time_interval", "commit_count")
TIERS = ("api", "local")
PROVIDERS = ("stub", "anthropic", "openai", "ollama", "llama_cpp")
OUTPUT_FORMATS = ("markdown", "yaml_graph", "hybrid")
COMPRESSION = ("verbose", "balanced", "minimal")
SECTION_FORMATS = ("table", "prose", "yaml", "tree_and_yaml", "ascii_diagram", "qa", "code_blocks")
DEPTHS = ("all", "non_obvious_only", "complex_only")
FOLDER = ".siltstone"


def _check(name: str, value: Any, allowed: tuple[str, ...] | None = None, least: float | None = None, most: float | None = None) -> None:
    if allowed is not None and value not in allowed:
        raise ValueError(f"{name} is {value!r}; allowed: {', '.join(allowed)}")
    if least is not None and value < least or most is not None and value > most:
        raise ValueError(f"{name} is {value}; allowed: {'any' if least is None else least} to {'any' if most is None else most}")


@dataclass(frozen=True)
class Project:
    name: str = "my-project"
    language: str = "python"
    type: str = "api"
    phase_style: str = "continuous"

    def __post_init__(self) -> None:
        _check("type", self.type, PROJECT_TYPES)
        _check("phase_style", self.phase_style, PHASE_STYLES)


@dataclass(frozen=True)
class Cadence:
    n_value: int = 5
    trigger: str = "manual"
    commit_threshold: int = 5
    time_interval_minutes: int = 30

    def __post_init__(self) -> None:
        _check("n_value", self.n_value, least=1, most=50)
        _check("trigger", self.trigger, TRIGGERS)
        _check("commit_threshold", self.commit_threshold, least=1)
        _check("time_interval_minutes", self.time_interval_minutes, least=5)


@dataclass(frozen=True)
class Model:
    tier: str = "local"
    provider: str = "stub"
    model_name: str = "stub"
    api_key_env: str = ""
    max_input_tokens: int = 3000
    max_output_tokens: int = 5000

    def __post_init__(self) -> None:
        _check("tier", self.tier, TIERS)
        _check("provider", self.provider, PROVIDERS)
        _check("max_input_tokens", self.max_input_tokens, least=500)
        _check("max_output_tokens", self.max_output_tokens, least=1000)


@dataclass(frozen=True)
class Section:
    id: str
    name: str
    priority: int = 2
    format: str = "prose"
    depth: str | None = None

    def __post_init__(self) -> None:
        _check("priority", self.priority, least=1, most=3)
        _check("format", self.format, SECTION_FORMATS)
        if self.depth is not None:
            _check("depth", self.depth, DEPTHS)


# The default sections.
SECTIONS = (
    Section("status", "Phase Execution Summary", 1, "table"),
    Section("architecture", "Code Architecture", 1, "tree_and_yaml"),
    Section("decisions", "Decision Rationale", 1, "table"),
    Section("logic", "Component Logic", 2, "prose", "non_obvious_only"),
    Section("data_flow", "Integration & Data Flow", 2, "ascii_diagram"),
    Section("edge_cases", "Edge Cases & Error Handling", 2, "table"),
    Section("interview", "Interview & Learning Notes", 3, "qa"),
    Section("debt", "Technical Debt", 3, "table"),
    Section("commands", "Quick Reference", 1, "code_blocks"),
)


@dataclass(frozen=True)
class Focus:
    include_patterns: tuple[str, ...] = ("**/*.py",)
    exclude_patterns: tuple[str, ...] = ("tests/**", "*.lock", "node_modules/**", "__pycache__/**", ".git/**", f"{FOLDER}/**", "*.pyc", ".venv/**", "venv/**")
    highlight: tuple[str, ...] = ()
    skip_trivial: bool = True


@dataclass(frozen=True)
class Output:
    format: str = "markdown"
    compression: str = "balanced"
    include_line_numbers: bool = True
    include_ascii_diagrams: bool = True
    max_doc_tokens: int = 8000

    def __post_init__(self) -> None:
        _check("format", self.format, OUTPUT_FORMATS)
        _check("compression", self.compression, COMPRESSION)
        _check("max_doc_tokens", self.max_doc_tokens, least=1000)


@dataclass(frozen=True)
class Classifier:
    trivial_max_files: int = 2
    trivial_max_lines: int = 30
    minor_max_files: int = 5
    minor_max_lines: int = 150
    standard_max_files: int = 15
    standard_max_lines: int = 500
    max_deferred_sessions: int = 5
    flush_threshold: float = 0.40

    def __post_init__(self) -> None:
        _check("flush_threshold", self.flush_threshold, least=0.0, most=1.0)


@dataclass(frozen=True)
class Config:
    project: Project = field(default_factory=Project)
    cadence: Cadence = field(default_factory=Cadence)
    model: Model = field(default_factory=Model)
    template_sections: tuple[Section, ...] = SECTIONS
    focus: Focus = field(default_factory=Focus)
    output: Output = field(default_factory=Output)
    classifier: Classifier = field(default_factory=Classifier)


_PARTS = {"project": Project, "cadence": Cadence, "model": Model, "focus": Focus, "output": Output, "classifier": Classifier}


def from_dict(data: dict[str, Any] | None) -> Config:
    """A checked Config; null or missing parts have their defaults, unknown names are errors."""
    data = dict(data or {})
    out: dict[str, Any] = {}
    for name, kind in _PARTS.items():
        own = dict(data.pop(name, None) or {})
        known = {f.name for f in fields(kind)}
        if extra := set(own) - known:
            raise ValueError(f"unknown settings in {name}: {', '.join(sorted(extra))}")
        out[name] = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in own.items()})
    sections = data.pop("template_sections", None)
    if data:
        raise ValueError(f"unknown settings: {', '.join(sorted(data))}")
    return Config(**out, **({"template_sections": tuple(Section(**s) for s in sections)} if sections else {}))


def to_dict(config: Config) -> dict[str, Any]:
    def plain(x: Any) -> Any:
        return {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else [plain(v) for v in x] if isinstance(x, (list, tuple)) else x

    return plain(asdict(config))


# Named settings. Limits of tokens, names and priorities of sections, patterns.
_SKIP = ["__pycache__/**", ".git/**", f"{FOLDER}/**", ".venv/**"]
_PLAIN = ["**/*.py", "*.yaml", "*.toml"]
_FORM = {s.id: (s.format, s.depth) for s in SECTIONS}


def _sections(*named: tuple[str, str, int]) -> list[dict[str, Any]]:
    """Sections (id, name, priority) in the form and depth of the default ones."""
    return [{"id": i, "name": n, "priority": p, "format": _FORM[i][0], "depth": _FORM[i][1]} for i, n, p in named]


def _preset(kind: str, tokens: tuple[int, int], most: int, every: int, sections: list[dict[str, Any]], include: list[str], exclude: list[str], language: str = "python", style: str = "continuous", compression: str = "balanced") -> dict[str, Any]:
    return {
        "project": {"language": language, "type": kind, "phase_style": style},
        "cadence": {"n_value": every},
        "model": {"max_input_tokens": tokens[0], "max_output_tokens": tokens[1]},
        "template_sections": sections,
        "focus": {"include_patterns": include, "exclude_patterns": exclude},
        "output": {"compression": compression, "max_doc_tokens": most},
    }


_STATUS, _WHY, _QUICK = ("status", "Phase Execution Summary", 1), ("decisions", "Decision Rationale", 1), ("commands", "Quick Reference", 1)
_EDGES, _NOTES, _DEBT = ("edge_cases", "Edge Cases & Error Handling", 2), ("interview", "Interview & Learning Notes", 3), ("debt", "Technical Debt", 3)
PRESETS: dict[str, dict[str, Any]] = {
    "minimal": _preset("library", (1500, 2000), 3000, 7, _sections(("architecture", "Code Architecture", 1), ("decisions", "Key Decisions", 1), _QUICK), ["**/*.py"], ["tests/**", *_SKIP], compression="minimal"),
    "cli_tool": _preset("cli", (2000, 3000), 5000, 3, _sections(("status", "Implementation Status", 1), ("architecture", "Command Structure", 1), _WHY, ("logic", "Command Logic & I/O", 2), ("data_flow", "Data Flow", 2), _QUICK), _PLAIN, ["tests/**", *_SKIP]),
    "python_api": _preset("api", (3000, 5000), 8000, 5, _sections(_STATUS, ("architecture", "Code Architecture", 1), _WHY, ("logic", "Component Logic", 2), ("data_flow", "API Endpoints & Data Flow", 1), _EDGES, _NOTES, _DEBT, _QUICK), _PLAIN, ["tests/**", "*.lock", *_SKIP, "venv/**"]),
    "data_pipeline": _preset(
        "data_pipeline", (2500, 4000), 6000, 3,
        _sections(("status", "Pipeline Status", 1), ("architecture", "Pipeline Architecture", 1), _WHY, ("logic", "ETL & Transformation Logic", 1), ("data_flow", "Data Flow & Schema", 1), ("edge_cases", "Edge Cases & Data Validation", 2), _QUICK),
        ["**/*.py", "**/*.sql", "*.yaml", "*.toml"], ["tests/**", *_SKIP],
    ),
    "ml_research": _preset(
        "research", (3500, 6000), 8000, 3,
        _sections(("status", "Experiment Status", 1), ("architecture", "Model Architecture & Training Pipeline", 1), ("decisions", "Design Decisions & Hypotheses", 1), ("logic", "Training Loop & Loss Functions", 1), ("data_flow", "Data Pipeline & Metrics Flow", 2), ("edge_cases", "Edge Cases & Failure Modes", 2), ("interview", "Interview & Learning Notes", 2), _QUICK),
        [*_PLAIN, "**/*.json"], ["data/**", "checkpoints/**", "wandb/**", *_SKIP], style="phased",
    ),
    "react_frontend": _preset(
        "web_app", (3000, 5000), 8000, 5,
        _sections(_STATUS, ("architecture", "Component Hierarchy", 1), _WHY, ("logic", "State Management & Hooks", 1), ("data_flow", "Props & Data Flow", 2), ("edge_cases", "Edge Cases & Error Boundaries", 2), _NOTES, _QUICK),
        [*(f"src/**/*.{e}" for e in ("js", "jsx", "ts", "tsx")), "*.json"], ["node_modules/**", "build/**", "dist/**", ".git/**", f"{FOLDER}/**", "*.lock"], language="javascript",
    ),
    "fullstack": _preset(
        "fullstack", (4000, 8000), 10000, 5,
        _sections(_STATUS, ("architecture", "Code Architecture (Backend + Frontend)", 1), _WHY, ("logic", "Component Logic", 2), ("data_flow", "API ↔ Frontend Data Flow", 1), _EDGES, _NOTES, _DEBT, _QUICK),
        ["**/*.py", *(f"**/*.{e}" for e in ("js", "jsx", "ts", "tsx")), "*.yaml", "*.toml", "*.json"], ["tests/**", "node_modules/**", "build/**", "dist/**", "__pycache__/**", ".git/**", f"{FOLDER}/**", "*.lock", ".venv/**"],
    ),
}


def list_presets() -> list[str]:
    return sorted(PRESETS)


def load_preset(name: str) -> Config:
    if name not in PRESETS:
        raise ValueError(f"no preset {name!r}; there are: {', '.join(list_presets())}")
    return from_dict(PRESETS[name])


def config_path(root: str | Path) -> Path:
    return Path(root) / FOLDER / "config.yaml"


def load_config(root: str | Path) -> Config:
    path = config_path(root)
    if not path.exists():
        raise FileNotFoundError(path)
    return from_dict(yaml.safe_load(path.read_text(encoding="utf-8")))


def save_config(root: str | Path, config: Config) -> Path:
    path = config_path(root)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(yaml.safe_dump(to_dict(config), sort_keys=False), encoding="utf-8")
    return path


def init_project(root: str | Path, preset: str | None = None, name: str | None = None, language: str | None = None) -> Config:
    """Write the settings of a new project; an error if there are some. No name gives that of the folder."""
    if config_path(root).exists():
        raise FileExistsError(config_path(root))
    config = load_preset(preset) if preset else Config()
    own = {"name": name if name else config.project.name if name == "" else Path(root).resolve().name} | ({"language": language} if language else {})
    config = replace(config, project=replace(config.project, **own))
    save_config(root, config)
    return config
