"""Settings: one flat table of what operators take, and overrides from a YAML or JSON file.

A setting belongs to a parameter of an operator.  ``bound`` returns the operator with the values that
differ from its own defaults; an operator that no setting names comes back as it is.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import partial
from pathlib import Path
from typing import Any, NamedTuple

from .functions import geometry, text
from .operators import assembly, layout, quality
from .sources import files


class Setting(NamedTuple):
    default: Any
    operator: Callable
    parameter: str


# The defaults, equal to those of the operators.
SETTINGS: dict[str, Setting] = {
    "words.low_confidence": Setting(60.0, quality.region_confidence, "threshold"),
    "regions.low_fraction": Setting(0.15, quality.is_low, "fraction"),
    "regions.winner": Setting("highest_confidence", assembly.reconcile, "strategy"),
    "bands.min_gap": Setting(0.015, layout.page_bands, "min_gap_fraction"),
    "bands.gap_density": Setting(0.02, layout.page_bands, "threshold"),
    "bands.margin_width": Setting(0.12, layout.segment_pages, "margin_fraction"),
    "line_numbers.margin_width": Setting(0.12, layout.line_number_run, "max_width_fraction"),
    "pages.megapixels": Setting(40.0, geometry.page_scale, "megapixels"),
    "pages.longest_side": Setting(4000, geometry.page_scale, "max_side"),
    "files.extensions": Setting([".pdf"], files.scan, "extensions"),
    "documents.without_line_numbers": Setting(False, assembly.docx_rows, "strip_line_numbers"),
    "languages": Setting(["eng", "deu", "fra"], text.language_hint, "known"),
}


def flat(values: dict, prefix: str = "") -> dict[str, Any]:
    """Nested names joined by dots."""
    out: dict[str, Any] = {}
    for name, value in values.items():
        out |= flat(value, f"{prefix}{name}.") if isinstance(value, dict) else {prefix + name: value}
    return out


def load(path: str | None = None) -> dict[str, Any]:
    """All settings, with the overrides of a file if one is named; an empty file overrides nothing, an unknown name is an error."""
    given: dict[str, Any] = {}
    if path is not None:
        raw = Path(path).read_text(encoding="utf-8")
        try:
            import yaml
        except ImportError:
            given = json.loads(raw) if raw.strip() else {}
        else:
            given = yaml.safe_load(raw) or {}
    given = flat(given)
    if strange := sorted(set(given) - set(SETTINGS)):
        raise ValueError(f"no such settings: {', '.join(strange)}")
    return {name: given.get(name, s.default) for name, s in SETTINGS.items()}


def bound(operator: Callable, values: dict[str, Any]) -> Callable:
    """The operator with its settings."""
    own = {s.parameter: values[name] for name, s in SETTINGS.items() if s.operator is operator and name in values}
    return partial(operator, **own) if own else operator
