"""Plug-ins: conventions, metrics and languages as functions over tables."""

from __future__ import annotations

import importlib
import json
import pkgutil
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame

SDK_MAJOR = 1
# Names that manifests use.
KINDS = ("commit-convention", "git-metric", "language")
RETIRED_KINDS = ("ai-provider",)
OUTPUTS = ("graph", "metrics", "findings", "commits", "aggregate")
NEEDED = ("id", "name", "kind", "version", "sdk", "main")


def _filled(value: object) -> bool:
    return isinstance(value, str) and bool(value.strip())


def _names(value: object) -> bool:
    return isinstance(value, list) and all(map(_filled, value))


def _stage_fault(manifest: dict) -> str | None:
    """What is wrong with what a manifest says about its stage; all four fields can be left out."""
    asked = manifest.get("consumes", [])
    if not isinstance(asked, list):
        return "consumes isn't a list"
    for output in asked + ([manifest["produces"]] if "produces" in manifest else []):
        if output not in OUTPUTS:
            return f"unknown output {output!r}"
    if "exclusive" in manifest and not _filled(manifest["exclusive"]):
        return "exclusive isn't the name of a group"
    if "filter" not in manifest:
        return None
    chosen = manifest["filter"]
    if not isinstance(chosen, dict) or not all(_names(chosen.get(f, [])) for f in ("extensions", "globs")):
        return "filter needs lists of extensions or globs"
    if not chosen.get("extensions") and not chosen.get("globs"):
        return "filter lets no file through"
    dotted = [e for e in chosen.get("extensions", []) if e.startswith(".")]
    return f"extension {dotted[0]} has a dot" if dotted else None


def manifest_fault(manifest: object) -> str | None:
    """Why a manifest (parsed JSON) can't be used; None if it can.  Its module is not imported for that."""
    if not isinstance(manifest, dict):
        return "a manifest is a JSON object"
    empty = [f for f in NEEDED if not _filled(manifest.get(f))]
    if empty:
        return f"{empty[0]} is missing"
    kind, sdk = manifest["kind"], manifest["sdk"]
    if kind not in KINDS:
        return f"kind {kind} is no longer used" if kind in RETIRED_KINDS else f"unknown kind {kind}"
    if sdk.split(".")[0] != str(SDK_MAJOR):
        return f"made for SDK {sdk}, this is {SDK_MAJOR}"
    return _stage_fault(manifest)


def read_manifest(path: str) -> tuple[dict, str]:
    """A manifest and the file that it names as `main`, which must lie in the manifest's own folder.

    Whatever is wrong is a ValueError."""
    try:
        manifest = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise ValueError(f"{path}: {e}") from e
    fault = manifest_fault(manifest)
    folder = Path(path).resolve().parent
    main = folder if fault else (folder / manifest["main"]).resolve()
    if not fault and (main == folder or not main.is_relative_to(folder)):
        fault = "main is outside the plug-in's folder"
    if fault:
        raise ValueError(f"{path}: {fault}")
    return manifest, str(main)


@dataclass(frozen=True)
class Plugin:
    """run: for a convention commits to parsed commits, for a metric tables to rows, for a language files to tables.

    series: a metric's rows as (series, subject, value, meta); none is needed if they have that form, or are to have none."""

    id: str
    kind: str
    version: str
    run: Callable[..., DataFrame | dict[str, DataFrame]]
    sdk: int = SDK_MAJOR
    extensions: tuple[str, ...] = ()
    series: Callable[[DataFrame], DataFrame] | None = None


@dataclass
class Registry:
    """Loaded plug-ins in order, and why others were refused."""

    plugins: dict[str, Plugin] = field(default_factory=dict)
    refused: list[tuple[str, str]] = field(default_factory=list)

    def add(self, p: Plugin) -> bool:
        """Of two with one id the first stays.  A refusal is recorded, not raised."""
        why = self._fault(p)
        if why:
            self.refused.append((getattr(p, "id", "?"), why))
            return False
        self.plugins[p.id] = p
        return True

    def _fault(self, p: Plugin) -> str | None:
        if not isinstance(p, Plugin) or not p.id or not p.version:
            return "id and version are needed"
        if p.kind not in KINDS:
            return f"unknown kind {p.kind}"
        if p.sdk != SDK_MAJOR:
            return f"made for SDK {p.sdk}, this is {SDK_MAJOR}"
        if not callable(p.run):
            return "run isn't a function"
        if p.kind == "language" and not p.extensions:
            return "a language needs extensions"
        return f"{p.id} is loaded already" if p.id in self.plugins else None

    def of_kind(self, kind: str) -> list[Plugin]:
        return [p for p in self.plugins.values() if p.kind == kind]

    def discover(self, package: str) -> None:
        """Adds PLUGIN of each module of a package, in order of names; a missing package has none."""
        try:
            found = importlib.import_module(package)
        except ImportError:
            return
        for m in sorted(pkgutil.iter_modules(found.__path__), key=lambda m: m.name):
            try:
                self.add(importlib.import_module(f"{package}.{m.name}").PLUGIN)
            except Exception as e:  # noqa: BLE001  one broken plug-in must not stop the others
                self.refused.append((m.name, str(e)))
