"""Settings, presets and dictionaries: values that are passed to the operators, never global state."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from .functions.text import Corrections

#: The steps of a pipeline in order, with their parameters.
STEPS: dict[str, dict[str, str]] = {
    "vision_ocr": {"render_scale": "2.0", "languages": "en,zh"},
    "column_reconstruction": {"force_columns": "auto"},
    "punctuation_normalize": {"mode": "auto"},
    "special_char_normalize": {},
    "hyphen_merge": {},
    "dictionary_correct": {"dict_path": "default"},
    "noise_removal": {},
    "quality_report": {},
    "structured_output": {"extract_claims": "false", "extract_metadata": "true"},
}


@dataclass(frozen=True)
class Step:
    name: str
    enabled: bool = True
    parameters: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Preset:
    """Named steps, on or off, and the outputs wanted. A step that isn't listed is off."""

    name: str
    description: str
    steps: tuple[Step, ...]
    output_formats: tuple[str, ...] = ("markdown",)

    def enabled(self, step: str) -> bool:
        return next((s.enabled for s in self.steps if s.name == step), False)

    def parameter(self, step: str, name: str, default: str = "") -> str:
        return next((s.parameters.get(name, default) for s in self.steps if s.name == step), default)

    def toggled(self, step: str, on: bool) -> Preset:
        steps = tuple(Step(s.name, on, s.parameters) if s.name == step else s for s in self.steps)
        return Preset(self.name, self.description, steps, self.output_formats)

    @property
    def file_name(self) -> str:
        return self.name.lower().replace(" ", "_") + ".json"

    def to_json(self) -> str:
        shown = {"name": self.name, "description": self.description, "steps": [asdict(s) for s in self.steps], "outputFormats": list(self.output_formats)}
        return json.dumps(shown, indent=2, sort_keys=True, ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> Preset:
        held = json.loads(text)
        steps = tuple(Step(s["name"], bool(s["enabled"]), dict(s["parameters"])) for s in held["steps"])
        return Preset(held["name"], held["description"], steps, tuple(held["outputFormats"]))


def preset(name: str, description: str, outputs: tuple[str, ...] = ("markdown",), **overrides: dict[str, str]) -> Preset:
    """All steps on; an override takes the place of a step's whole parameters."""
    return Preset(name, description, tuple(Step(k, True, overrides.get(k, v)) for k, v in STEPS.items()), outputs)


PRESETS = (
    preset("Default", "All steps, Markdown output"),
    preset(
        "Patent-3GPP", "All steps, with claims, cover data and report", ("markdown", "claims", "metadata", "report"),
        structured_output={"extract_claims": "true", "extract_metadata": "true"},
    ),
    preset(
        "Technical-Spec", "Documents without claims or cover data",
        structured_output={"extract_claims": "false", "extract_metadata": "false"},
    ),
)


def presets_from(files: dict[str, str]) -> list[Preset]:
    """The presets in JSON texts by file name, by name; unreadable ones are left out, without any the built-in ones."""
    found = []
    for name, text in sorted(files.items()):
        if name.endswith(".json"):
            try:
                found.append(Preset.from_json(text))
            except (ValueError, KeyError, TypeError, AttributeError):
                continue
    return sorted(found or PRESETS, key=lambda p: p.name)


@dataclass(frozen=True)
class Settings:
    """``punctuation`` is auto, half or full; half-width marks are made in mode half, or auto with English first."""

    punctuation: str = "auto"
    primary_language: str = "en"
    secondary_language: str = "zh-Hans"
    detect_language: bool = True
    render_scale: float = 3.0
    correct: bool = True
    book_output: str = "single"
    preset: Preset = PRESETS[0]
    corrections: Corrections = field(default_factory=Corrections)
    escape_pipes: bool = True

    @property
    def languages(self) -> list[str]:
        return list(dict.fromkeys((self.primary_language, self.secondary_language)))

    @property
    def half_width(self) -> bool:
        return self.punctuation == "half" or (self.punctuation == "auto" and self.primary_language.startswith("en"))


#: Some pairs of the default dictionary, to start from.
DEFAULT_CORRECTIONS = Corrections(
    spaced_words={"sy stem": "system", "net work": "network", "sig nal": "signal"},
    word_replacements={"cnable": "enable", "reccive": "receive", "cxample": "example", "mcthod": "method", "systcm": "system", "loT": "IoT"},
    patterns=((r"\bconnccted\b", "connected", False),),
    whitelist=frozenset(["UE", "IE", "gNB", "eNB", "NR", "LTE"]),
)


def corrections_from(text: str) -> Corrections:
    """A dictionary from its JSON text; keys of a wrong type are left out, as are patterns that can't be read."""
    try:
        held = json.loads(text)
    except ValueError:
        return Corrections()
    if not isinstance(held, dict):
        return Corrections()

    def strings(key: str) -> dict[str, str]:
        value = held.get(key)
        good = isinstance(value, dict) and all(isinstance(v, str) for v in value.values())
        return value if good else {}

    def listed(key: str) -> list[str]:
        value = held.get(key)
        return value if isinstance(value, list) and all(isinstance(v, str) for v in value) else []

    patterns = []
    for entry in held.get("pattern_replacements") if isinstance(held.get("pattern_replacements"), list) else ():
        if isinstance(entry, dict) and isinstance(entry.get("pattern"), str) and isinstance(entry.get("replacement"), str):
            try:
                re.compile(entry["pattern"])
            except re.error:
                continue
            patterns.append((entry["pattern"], entry["replacement"], entry.get("case_insensitive") is True))
    return Corrections(
        strings("spaced_words"), strings("word_replacements"), tuple(patterns), frozenset(listed("whitelist")), tuple(listed("custom_hint_words"))
    )
