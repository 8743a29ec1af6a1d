"""Verification plans: profiles by globs, checklists, test commands, and tests that change along."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.globs import glob_regex
from .history import strongest

#: Strongest co-change rows of a changed file among which its tests are looked for.
TEST_ROWS = 10


@dataclass(frozen=True)
class Profile:
    name: str
    detect: tuple[str, ...]
    checks: tuple[str, ...]


#: The profiles that come with the engine.
PROFILES = (
    Profile(
        "backend",
        ("**/*.rs", "**/*.go", "**/*.java", "**/*.kt", "src/**/*.py", "app/**/*.py", "src/**/*.ts", "server/**/*.ts"),
        (
            "Unit tests cover new and changed logic",
            "Integration tests exercise changed endpoints or services",
            "Public types and function signatures are type-checked",
            "Error handling and edge cases are covered (no silent failures)",
            "Authorization is enforced on new or changed endpoints",
            "Retryable operations are idempotent",
            "Performance-sensitive paths reviewed for regressions",
            "Existing abstractions reused instead of reimplemented",
        ),
    ),
    Profile(
        "database",
        ("**/migrations/**", "**/migrate/**", "**/*.sql", "**/schema.rs", "**/schema.prisma", "**/models.py"),
        (
            "Migration applies cleanly on a fresh database",
            "A rollback or backward-compatible path exists",
            "Schema change is compatible with currently-deployed code",
            "Indexes exist for new query patterns",
            "Constraints (nullability, foreign keys, uniqueness) are correct",
            "Locking / long-running migration risk assessed",
            "Data backfill plan defined for non-null columns",
            "Deploy ordering (migrate vs. code) is documented",
        ),
    ),
    Profile(
        "frontend",
        ("**/*.tsx", "**/*.jsx", "**/*.vue", "**/*.svelte", "**/*.css", "**/*.scss", "components/**/*.ts", "web/**/*.ts"),
        (
            "Existing design-system components reused before adding new ones",
            "Loading, error, and empty states handled",
            "Accessibility: roles, labels, keyboard navigation",
            "Responsive behavior verified at key breakpoints",
            "API contract matches the backend it consumes",
            "Component and end-to-end tests updated",
        ),
    ),
    Profile(
        "infra",
        ("**/Dockerfile", "**/*.tf", "**/*.yaml", "**/*.yml", "**/*.toml", ".github/workflows/**", "**/helm/**", "**/k8s/**"),
        (
            "Configuration validated (lint / plan / dry-run)",
            "Deployment plan and rollback behavior defined",
            "Secrets handled via a secret store, never committed",
            "Resource changes (CPU/memory/limits) reviewed",
            "Environment compatibility (dev/staging/prod) checked",
        ),
    ),
)

#: Test commands by the manifests that call for them, in order.
COMMANDS = (
    ("cargo test", ("Cargo.toml",)),
    ("go test ./...", ("go.mod",)),
    ("pytest", ("pyproject.toml", "setup.py", "setup.cfg", "pytest.ini", "tox.ini", "requirements.txt")),
    ("npm test", ("package.json",)),
)


def profile_regex(profile: Profile) -> str:
    return "|".join(glob_regex(g) for g in profile.detect)


def matched_profiles(changes: DataFrame, profiles: tuple[Profile, ...] = PROFILES) -> DataFrame:
    """(change_set, profile, position): profiles that any path of a change set (change_set, path) fits, in their order."""
    hits = F.array_compact(F.array(*[F.when(F.col("path").rlike(profile_regex(p)), F.lit(i)) for i, p in enumerate(profiles)]))
    found = changes.select("change_set", F.explode(hits).alias("position")).distinct()
    names = F.array(*[F.lit(p.name) for p in profiles])
    return found.select("change_set", F.get(names, F.col("position")).alias("profile"), F.col("position").cast("long").alias("position"))


def checklist(matched: DataFrame, profiles: tuple[Profile, ...] = PROFILES) -> DataFrame:
    """(change_set, check, profile_position, check_position): checks of the matched profiles, repeated ones at their first place."""
    checks = F.array(*[F.array(*[F.lit(c) for c in p.checks]) for p in profiles])
    rows = matched.select("change_set", F.col("position").alias("p"), F.posexplode(F.get(checks, F.col("position").cast("int"))).alias("c", "check"))
    first = rows.groupBy("change_set", "check").agg(F.min(F.struct("p", "c")).alias("at"))
    return first.select("change_set", "check", F.col("at.p").alias("profile_position"), F.col("at.c").cast("long").alias("check_position"))


def test_commands(files: DataFrame) -> DataFrame:
    """(command, position) for the manifests at the root among files (path)."""
    rows = None
    for i, (command, manifests) in enumerate(COMMANDS):
        one = files.agg(F.coalesce(F.max(F.col("path").isin(*manifests)), F.lit(False)).alias("has")).where("has").select(F.lit(command).alias("command"), F.lit(i).cast("long").alias("position"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def tests_along(cochange: DataFrame, changes: DataFrame) -> DataFrame:
    """(change_set, path): tests among the TEST_ROWS strongest co-change rows of each changed file, distinct."""
    near = strongest(cochange, TEST_ROWS).select(F.col("path_a").alias("path"), "path_b")
    found = changes.select("change_set", "path").distinct().join(near, "path").where(P.is_test(F.col("path_b")))
    return found.select("change_set", F.col("path_b").alias("path")).distinct()
