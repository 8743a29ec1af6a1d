"""Weights, stopwords and profiles from files of a repository."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import fields
from pathlib import Path

from ..functions.text import STOPWORDS
from ..operators.retrieval import Weights
from ..operators.verify import PROFILES, Profile

TOKEN_VARIABLES = ("EVIDENTIA_GITHUB_TOKEN", "GITHUB_TOKEN", "GH_TOKEN")


def config_path(root: str, name: str) -> Path:
    """The file in the repository's own ``config`` folder, else in that of the working directory."""
    own = Path(root) / "config" / name
    return own if own.exists() else Path("config") / name


def weights(root: str) -> Weights:
    """The weights of ``config/scoring.toml``; those that are missing, or all if the file is missing or broken, by default. Read at each call."""
    try:
        values = tomllib.loads(config_path(root, "scoring.toml").read_text(encoding="utf-8"))
        return Weights(**{f.name: float(values[f.name]) for f in fields(Weights) if f.name in values})
    except (OSError, ValueError, TypeError):
        return Weights()


def stopwords(root: str) -> list[str]:
    """The built-in words and those of ``config/stopwords.txt``, one a line, ``#`` begins a comment."""
    try:
        lines = config_path(root, "stopwords.txt").read_text(encoding="utf-8").splitlines()
    except OSError:
        lines = []
    own = (line.split("#")[0].strip().lower() for line in lines)
    return sorted({*STOPWORDS, *filter(None, own)})


def _bare(text: str) -> str:
    """A scalar without its quotes, or without the comment behind it."""
    text = text.strip()
    if text[:1] in ("'", '"'):
        end = text.find(text[0], 1)
        return text[1:end] if end > 0 else text[1:]
    return text.split(" #")[0].strip()


def _yaml_profile(text: str) -> Profile:
    """A profile of a YAML subset: ``name: value`` and lists of strings, one a line or in brackets, with comments."""
    name, lists, key = "", {}, ""
    for line in text.splitlines():
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        if bare.startswith("- "):
            lists.setdefault(key, []).append(_bare(bare[2:]))
            continue
        key, _, value = bare.partition(":")
        value = value.strip()
        if value.startswith("["):
            inner = value[1 : value.rindex("]")] if "]" in value else value[1:]
            lists[key] = [_bare(m[0]) for m in re.finditer(r"\"[^\"]*\"|'[^']*'|[^,\s][^,]*", inner)]
        elif key == "name":
            name = _bare(value)
    if not name or not lists.get("detect"):
        raise ValueError("a profile needs a name and patterns")
    return Profile(name, tuple(lists["detect"]), tuple(lists.get("checks", ())))


def profiles(root: str) -> tuple[Profile, ...]:
    """The profiles of ``config/verification`` in order of the file names, broken ones left out; the built-in ones without that folder."""
    folder = config_path(root, "verification")
    if not folder.is_dir():
        return PROFILES
    out = []
    for path in sorted(p for p in folder.iterdir() if p.suffix in (".yaml", ".yml")):
        try:
            out.append(_yaml_profile(path.read_text(encoding="utf-8")))
        except (OSError, ValueError):
            continue
    return tuple(out)


def token() -> str | None:
    """The first access token that is set."""
    return next((v for name in TOKEN_VARIABLES if (v := os.environ.get(name, "").strip())), None)
