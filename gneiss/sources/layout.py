"""Workspaces and their modules, found in a folder on the driver."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from .buildfiles import pom_modules, settings_modules

# Folders that hold no projects of their own.
EXCLUDED = {"build", "target", "out", "dist", "node_modules", ".gradle", ".idea", ".git"}
SETTINGS = ("settings.gradle.kts", "settings.gradle")
JAVA_ROOT, KOTLIN_ROOT = os.path.join("src", "main", "java"), os.path.join("src", "main", "kotlin")


@dataclass(frozen=True)
class Module:
    name: str
    root: str
    java_roots: tuple[str, ...] = ()
    kotlin_roots: tuple[str, ...] = ()

    def __post_init__(self):
        if not self.java_roots and not self.kotlin_roots:
            raise ValueError("a module has at least one source root")

    @property
    def roots(self) -> tuple[str, ...]:
        return self.java_roots + self.kotlin_roots


@dataclass(frozen=True)
class Workspace:
    name: str
    root: str
    modules: tuple[Module, ...] = field(default=())

    @property
    def several(self) -> bool:
        return len(self.modules) > 1

    @property
    def roots(self) -> tuple[str, ...]:
        return tuple(r for m in self.modules for r in m.roots)


def normal(path: str) -> str:
    return os.path.normpath(os.path.abspath(path))


def module_at(root: str, name: str) -> Module | None:
    """The module whose conventional source roots lie here, if any do."""
    java, kotlin = (tuple(p for p in [os.path.join(root, r)] if os.path.isdir(p)) for r in (JAVA_ROOT, KOTLIN_ROOT))
    return Module(name, root, java, kotlin) if java or kotlin else None


def base_name(root: str) -> str:
    return os.path.basename(root) or "root"


def assembled(root: str, paths: list[str]) -> Workspace | None:
    """The workspace of these module folders; those outside of the root or without sources are left out."""
    found = []
    for p in dict.fromkeys(paths):
        where = normal(os.path.join(root, p))
        if os.path.isdir(where) and os.path.commonpath([root, where]) == root and (m := module_at(where, os.path.relpath(where, root).replace(os.sep, "__"))):
            found.append(m)
    return Workspace(base_name(root), root, tuple(found)) if found else None


def scanned(root: str) -> list[str]:
    """Direct children that have a conventional source root."""
    return [n for n in sorted(os.listdir(root)) if os.path.isdir(os.path.join(root, n)) and module_at(os.path.join(root, n), n)]


def detect(root: str, depth: int = 0) -> list[Workspace]:
    """Workspaces here: by sources, then settings, then a reactor; at the top, else those of the child folders."""
    root = normal(root)
    if not os.path.isdir(root):
        return []
    own = module_at(root, base_name(root))
    if own:
        return [Workspace(base_name(root), root, (own,))]
    for name in SETTINGS:
        file = os.path.join(root, name)
        if os.path.isfile(file):
            with open(file, encoding="utf-8") as f:
                found = assembled(root, settings_modules(f.read()) or scanned(root))
            if found:
                return [found]
    pom = os.path.join(root, "pom.xml")
    if os.path.isfile(pom):
        with open(pom, encoding="utf-8") as f:
            found = assembled(root, pom_modules(f.read()))
        if found:
            return [found]
    if depth:
        return []
    children = [n for n in sorted(os.listdir(root)) if os.path.isdir(os.path.join(root, n)) and not n.startswith(".") and n.lower() not in EXCLUDED]
    return [w for n in children for w in detect(os.path.join(root, n), depth + 1)]


def resolve(repo: str, sources: list[str] | None = None) -> list[Workspace]:
    """Workspaces of a repository, or the one that the given source roots make; a leaf `kotlin` is a Kotlin root."""
    repo = normal(repo)
    if sources:
        roots = [normal(s if os.path.isabs(s) else os.path.join(repo, s)) for s in sources]
        kotlin = tuple(r for r in roots if os.path.basename(r) == "kotlin")
        return [Workspace(base_name(repo), repo, (Module(base_name(repo), repo, tuple(r for r in roots if r not in kotlin), kotlin),))]
    return detect(repo) or [Workspace(base_name(repo), repo, (Module(base_name(repo), repo, (os.path.join(repo, JAVA_ROOT),)),))]


def collection_name(workspace: Workspace, given: str | None, several: bool) -> str:
    if not given or not given.strip():
        return workspace.name
    return f"{given.strip()}__{workspace.name}" if several else given.strip()


def state_dir(workspace: Workspace, given: str | None, several: bool, default: str = ".gneiss") -> str:
    if not given:
        return os.path.join(workspace.root, default)
    return os.path.join(normal(given), workspace.name) if several else normal(given)
