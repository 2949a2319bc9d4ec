"""Loads pattern definitions, category weights and model profiles.

A library is a folder of YAML files, each with one definition or a list of them; names that begin with ``_`` are settings. The one
that comes with the package is the default; any other folder may be given.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

#: What a definition may say.
CATEGORIES = ("tropes", "punctuation", "phrases", "structure", "emoji", "vocabulary")
KINDS = ("regex", "html_regex", "frequency", "structural", "linguistic")
METRICS = {"structural": ("bullet_density", "header_ratio", "paragraph_cv_inverted", "emoji_density"), "linguistic": ("sentence_burstiness", "type_token_ratio", "question_rate", "avg_sentence_length", "word_freq_variance")}
#: Kinds of detection that callers added, see detectors.register_kind.
OWN_KINDS: set[str] = set()
REQUIRED = ("id", "name", "category", "weight", "detection_type", "params")
#: Category weights where no file gives any. They aren't checked, as they sum to 1.05.
DEFAULT_WEIGHTS = {"tropes": 0.40, "phrases": 0.20, "punctuation": 0.15, "structure": 0.10, "vocabulary": 0.10, "emoji": 0.10}
HERE = Path(__file__).parent / "data"


class PatternError(ValueError):
    """A definition that can't be used; the message names its file."""


@dataclass(frozen=True)
class Pattern:
    id: str
    name: str
    category: str
    weight: float
    detection_type: str
    params: dict
    description: str = ""
    version: int = 1
    severity: str = "medium"
    references: list = field(default_factory=list)
    added_by: str = ""

    @property
    def hash(self) -> str:
        """Changes with whatever decides a score: 16 hex digits of the SHA-256 of the deciding fields as sorted, compact JSON."""
        deciding = {k: getattr(self, k) for k in ("id", "category", "detection_type", "version", "weight", "params", "severity")}
        return hashlib.sha256(json.dumps(deciding, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def make_pattern(raw: dict, source: str = "") -> Pattern:
    if not isinstance(raw, dict):
        raise PatternError(f"{source}: a definition must be a mapping")
    if missing := [k for k in REQUIRED if k not in raw]:
        raise PatternError(f"{source}: missing {', '.join(missing)}")
    try:
        p = Pattern(str(raw["id"]), str(raw["name"]), raw["category"], float(raw["weight"]), raw["detection_type"], dict(raw["params"]), str(raw.get("description", "")).strip(), int(raw.get("version", 1)), str(raw.get("severity", "medium")), list(raw.get("references") or []), str(raw.get("added_by") or ""))
    except (TypeError, ValueError) as e:
        raise PatternError(f"{source}: {e}") from e
    if not 0 <= p.weight <= 1:
        raise PatternError(f"{source}: the weight of {p.id} must be between 0 and 1")
    if p.category not in CATEGORIES:
        raise PatternError(f"{source}: {p.category} is no category")
    if p.detection_type not in KINDS and p.detection_type not in OWN_KINDS:
        raise PatternError(f"{source}: {p.detection_type} is no kind of detection")
    return p


def load_patterns(folder: str | Path = HERE) -> list[Pattern]:
    """All definitions below a folder, in order of path; of two with one id the later one holds."""
    found: dict[str, Pattern] = {}
    for path in sorted(Path(folder).rglob("*.yaml")):
        if path.name.startswith("_") or "models" in path.relative_to(folder).parts[:-1]:
            continue
        try:
            raw = yaml.safe_load(path.read_text(encoding="utf-8"))
        except yaml.YAMLError as e:
            raise PatternError(f"{path.name}: {e}") from e
        for r in raw if isinstance(raw, list) and raw and all(isinstance(x, dict) for x in raw) else [raw]:
            p = make_pattern(r, path.name)
            found.pop(p.id, None)
            found[p.id] = p
    return list(found.values())


def load_weights(folder: str | Path = HERE) -> dict[str, float]:
    """Weights by category. What a file leaves out has its default (emoji .05 then); they must sum to 1."""
    path = Path(folder) / "_weights.yaml"
    if not path.exists():
        return dict(DEFAULT_WEIGHTS)
    given = (yaml.safe_load(path.read_text(encoding="utf-8")) or {}).get("weights") or {}
    weights = {**DEFAULT_WEIGHTS, "emoji": 0.05, **{k: float(v) for k, v in given.items()}}
    if abs(sum(weights.values()) - 1) > 0.01:
        raise PatternError(f"category weights must sum to 1, not {sum(weights.values()):g}")
    return weights


def load_profiles(folder: str | Path = HERE) -> dict[str, dict[str, float]]:
    """Expected scores by model and pattern, from _profiles.yaml or from the files in models/."""
    raw = yaml.safe_load((Path(folder) / "_profiles.yaml").read_text()) if (Path(folder) / "_profiles.yaml").exists() else [yaml.safe_load(p.read_text()) for p in sorted((Path(folder) / "models").glob("*.yaml"))]
    return {r["model_id"]: {k: float(v) for k, v in r["profile"].items()} for r in raw or []}


def profile(name: str, folder: str | Path = HERE) -> dict[str, float]:
    profiles = load_profiles(folder)
    if name not in profiles:
        raise PatternError(f"no profile {name}; there are {', '.join(sorted(profiles))}")
    return profiles[name]


def usable(p: Pattern) -> bool:
    """Whether a detector can be built; one that can't is left out of scores and weights."""
    if p.detection_type in OWN_KINDS:
        return True
    if p.detection_type in METRICS:
        return p.params.get("metric") in METRICS[p.detection_type]
    if p.detection_type == "frequency":
        return bool(p.params.get("terms"))
    return "patterns" in p.params and all(_compiles(x) for c in ("patterns", "text_patterns") for x in p.params.get(c) or [])


def _compiles(expression: str) -> bool:
    try:
        re.compile(expression)
    except (re.error, TypeError, OverflowError):
        return False
    return True


def patterns_table(spark: SparkSession, patterns: list[Pattern]) -> DataFrame:
    rows = [(p.id, p.name, p.description, p.category, p.weight, p.detection_type, json.dumps(p.params, ensure_ascii=False), p.version, p.severity, p.references, p.added_by, p.hash) for p in patterns]
    return spark.createDataFrame(rows, "id string, name string, description string, category string, weight double, detection_type string, params string, version int, severity string, ref_links array<string>, added_by string, hash string")


def profiles_table(spark: SparkSession, profiles: dict[str, dict[str, float]]) -> DataFrame:
    return spark.createDataFrame([(m, k, v) for m, p in profiles.items() for k, v in p.items()], "model_id string, pattern_id string, expected double")
