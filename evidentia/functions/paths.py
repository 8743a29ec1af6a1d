"""Classification of file paths and import targets, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories that a walk skips, and the largest file that it takes.
SKIPPED_DIRECTORIES = (".git", "node_modules", "target", "dist", "build", ".venv", "venv", "__pycache__", ".next", ".cache", "vendor", ".idea", ".vscode")
MAX_FILE_BYTES = 1_500_000

#: Languages by extension, and those whose structure is extracted.
LANGUAGES = {"rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "go": "go"}
SUPPORTED = ("rust", "python", "typescript", "javascript")

_TEST = r"(/tests/|/test/|/__tests__/|^tests/|^test/|_test\.(rs|go|py)$|(^|/)test_[^/]*$|\.(test|spec)\.(ts|js)$|\.test\.tsx$)"
_CHANGES = ("CHANGES", "CHANGELOG", "HISTORY", "NEWS")
_DOCS = r"\.(md|markdown|txt|rst|adoc)$"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language(path: Column) -> Column:
    """By the part behind the last dot, case-sensitive; a path without a dot is looked up whole."""
    ending = F.element_at(F.split(path, r"\."), -1)
    out = F.lit("other")
    for name in dict.fromkeys(LANGUAGES.values()):
        out = F.when(ending.isin([e for e, n in LANGUAGES.items() if n == name]), name).otherwise(out)
    return out


def is_test(path: Column) -> Column:
    """Whether a path is a test: by directory, or by the file's name."""
    return F.lower(path).rlike(_TEST)


def doc_class(path: Column) -> Column:
    """``changelog``, ``doc`` or ``code``."""
    name = file_name(path)
    stem = F.upper(F.element_at(F.split(name, r"\."), 1))
    return F.when(stem.isin(*_CHANGES), "changelog").when(name.rlike(_DOCS), "doc").otherwise("code")


def supported(path: Column) -> Column:
    return language(path).isin(*SUPPORTED)


def admitted(path: Column) -> Column:
    """Files of no known language count only as Markdown, TOML or JSON."""
    return (language(path) != "other") | path.rlike(r"\.(md|toml|json)$")


def in_skipped_directory(path: Column) -> Column:
    """Whether a directory of the path (not the file itself) is one that a walk skips."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin(*SKIPPED_DIRECTORIES))


def normalized_target(raw: Column) -> Column:
    """An import's target as a path of lower-case segments, without ending, relative parts and crate words."""
    out = F.regexp_replace(F.lower(F.trim(raw)), r"\.(ts|tsx|js|jsx|mjs|cjs|json)$", "")
    out = F.regexp_replace(F.replace(out, F.lit("::"), F.lit("/")), r"[.\\]", "/")
    return F.array_join(F.filter(F.split(out, "/"), lambda s: ~s.isin("", ".", "..", "crate", "self", "super")), "/")


def module_needles(path: Column) -> Column:
    """The names under which a file can be imported: ``parent/stem`` and ``stem``; none for stems under three bytes."""
    bare = F.regexp_replace(F.lower(path), r"\.[^./]*$", "")
    parts = F.filter(F.split(bare, "/"), lambda s: s != "")
    inner = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    parts = F.when((F.size(parts) > 0) & F.element_at(parts, -1).isin("mod", "index", "__init__", "lib", "main"), inner).otherwise(parts)
    joined = F.concat(F.lit("/"), F.array_join(parts, "/"))
    # trailing structural directories go while a segment is left in front of them
    joined = F.regexp_replace(joined, r"^(/[^/]+(?:/[^/]+)*?)(?:/(?:src|lib|crates|packages|pkg))+$", "$1")
    parts = F.filter(F.split(joined, "/"), lambda s: s != "")
    stem = F.try_element_at(parts, F.lit(-1))
    both = F.when(F.size(parts) >= 2, F.array(F.concat_ws("/", F.try_element_at(parts, F.lit(-2)), stem), stem)).otherwise(F.array(stem))
    return F.when(F.octet_length(stem) >= 3, both).otherwise(F.array().cast("array<string>"))


def candidate_keys(target: Column) -> Column:
    """Of a normalised target the adjacent pairs of segments, then the single segments."""
    parts = F.filter(F.split(target, "/"), lambda s: s != "")
    pairs = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s, i: F.concat_ws("/", s, F.get(parts, i + 1)))
    return F.concat(pairs, parts)


def crate_manifest(path: Column) -> Column:
    """The manifest beside the source directory of a crate's root file, else null."""
    found = F.regexp_extract(F.lower(path), r"^(.*?)/?src/(?:lib|main)\.rs$", 1)
    return F.when(F.lower(path).rlike(r"^.+/src/(?:lib|main)\.rs$"), F.concat(found, F.lit("/Cargo.toml")))


def package_name(manifest: Column) -> Column:
    """The name in the ``[package]`` section of a manifest, lower-case with underscores, else null."""
    section = F.regexp_extract(manifest, r"(?s)(?:^|\n)[ \t]*\[package\][^\n]*\n(.*?)(?=\n[ \t]*\[|\z)", 1)
    name = F.regexp_extract(section, r"(?m)^[ \t]*name[ \t]*=[ \t]*[\"']?([^\"'\n]*?)[\"']?[ \t]*$", 1)
    return F.nullif(F.replace(F.lower(F.trim(name)), F.lit("-"), F.lit("_")), F.lit(""))


def repository_slug(remote: Column) -> Column:
    """(owner, name) of a remote's address, or nulls."""
    bare = F.regexp_replace(F.trim(remote), r"\.git$", "")
    tail = F.when(bare.contains("github.com"), F.regexp_replace(F.element_at(F.split(bare, r"github\.com"), -1), r"^[:/]+", "")).otherwise(bare)
    parts = F.filter(F.split(tail, "/"), lambda s: s != "")
    enough = F.size(parts) >= 2
    return F.struct(F.when(enough, F.try_element_at(parts, F.lit(-2))).alias("owner"), F.when(enough, F.try_element_at(parts, F.lit(-1))).alias("name"))


def routed(path: Column, state_dir: str = ".evidentia") -> Column:
    """Where a change event goes: ``head`` (history), ``ignored`` or ``file``."""
    top = F.element_at(F.split(path, "/"), 1)
    head = path.isin(".git/HEAD", ".git/logs/HEAD")
    ignored = path.startswith(".git/") | top.isin(".git", state_dir, "target", "node_modules", "dist", "build", ".venv", "__pycache__")
    return F.when(head, "head").when(ignored, "ignored").otherwise("file")
