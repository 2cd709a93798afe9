"""The mapping of a survey's columns to questions: reading it and checking it. Data never passes here."""

from __future__ import annotations

import json

PLAIN = ("text", "number", "scale", "date")


def read_mapping(text: str) -> dict:
    """YAML where a parser for it is at hand, else JSON (which is YAML too)."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def columns_of(question: dict) -> list[str]:
    source = question.get("source") or {}
    return list(source.get("columns") or []) or ([question["source_column"]] if question.get("source_column") else [])


def check_mapping(mapping: dict) -> tuple[list[str], list[str]]:
    """Errors and warnings; with errors there is nothing to run."""
    errors, warnings = [], []
    if not (mapping.get("form") or {}).get("name"):
        errors.append("form: a name is missing")
    seen = set()
    for q in mapping.get("questions") or []:
        code, kind, options = q.get("code") or "?", q.get("type"), q.get("options") or []
        if code in seen:
            errors.append(f"{code}: the code occurs twice")
        seen.add(code)
        if kind == "single_choice":
            if not q.get("source_column"):
                errors.append(f"{code}: single_choice needs source_column")
            if q.get("options_from_values") and options:
                warnings.append(f"{code}: options and options_from_values together")
            if not options and not q.get("options_from_values"):
                errors.append(f"{code}: single_choice needs options or options_from_values")
        elif kind == "multi_choice":
            if not options and not q.get("options_from_values"):
                errors.append(f"{code}: multi_choice needs options or options_from_values")
        elif kind == "free_text":
            if not columns_of(q):
                errors.append(f"{code}: free_text needs a source")
        elif kind in PLAIN:
            if not q.get("source_column"):
                errors.append(f"{code}: {kind} needs source_column")
        else:
            errors.append(f"{code}: unknown type {kind!r}")
    return errors, warnings
