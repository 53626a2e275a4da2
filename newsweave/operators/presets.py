"""What a view keeps between runs: named filters, and the rules for lists of options and focus words."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import asdict

from newsweave.operators.search import FilterSpec


class PresetStore:
    """Named filters in one small JSON document. A missing or broken document is an empty store; a save replaces the
    document as a whole, so a reader never sees half of one."""

    def __init__(self, path: str):
        self.path = path

    def _all(self) -> dict[str, dict]:
        try:
            with open(self.path, encoding="utf-8") as f:
                out = json.load(f)
        except (OSError, ValueError):
            return {}
        return out if isinstance(out, dict) else {}

    def _write(self, every: dict[str, dict]) -> None:
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        part = f"{self.path}.part"
        with open(part, "w", encoding="utf-8") as f:
            json.dump(every, f, ensure_ascii=False, indent=2)
        os.replace(part, self.path)

    def names(self) -> list[str]:
        return sorted(self._all())

    def save(self, name: str, spec: FilterSpec) -> None:
        if not name.strip():
            raise ValueError("a preset needs a name")
        self._write(self._all() | {name.strip(): asdict(spec)})

    def load(self, name: str) -> FilterSpec:
        """The named filter; what the stored one doesn't say is left at its default."""
        known = FilterSpec.__dataclass_fields__
        return FilterSpec(**{k: v for k, v in self._all()[name].items() if k in known})

    def delete(self, name: str) -> bool:
        every = self._all()
        if name not in every:
            return False
        del every[name]
        self._write(every)
        return True


def reset(feeds: list[str] = ()) -> FilterSpec:
    """The filter that lets everything through, with all feeds selected."""
    return FilterSpec(feeds=list(feeds))


def clean_selection(selected, options: list[str], name: Callable[[str], str] = lambda x: x) -> list[str]:
    """What of a stored selection still is an option, under its present name, once each, in its order; [] for no list."""
    if not isinstance(selected, (list, tuple)):
        return []
    return list(dict.fromkeys(x for x in map(name, selected) if x in set(options)))


def focus_words(chosen, candidates: list[str], least: int = 2, most: int = 5) -> list[str]:
    """The chosen words that are candidates, at most ``most``; with fewer than ``least`` of them the first candidates."""
    kept = [w for w in dict.fromkeys(chosen or []) if w in set(candidates)]
    return (kept if len(kept) >= least else candidates)[:most]


def summary(spec: FilterSpec, shown: int, total: int) -> str:
    """One line on the active filters and the rows that they leave."""
    parts = [f"search: {spec.text.strip()}"] if spec.text.strip() else []
    parts += [f"feeds: {len(spec.feeds)}"] if spec.feeds else []
    parts += [f"score >= {spec.min_score:g}"] if spec.min_score > 0 else []
    parts += [f"sectors: {', '.join(spec.sectors)}"] if spec.sectors else []
    parts += [f"places: {spec.places.strip()}"] if spec.places.strip() else []
    parts += [f"dates: {spec.dates[0]} to {spec.dates[1]}"] if spec.dates else []
    return f"{shown} of {total} rows" + (f" ({'; '.join(parts)})" if parts else "")
