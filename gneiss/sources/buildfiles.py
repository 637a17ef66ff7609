"""What build files say about modules and their dependencies."""

from __future__ import annotations

import os
import re
from xml.etree import ElementTree

# The forms in which settings name projects and build files depend on them.
INCLUDE_CALL = re.compile(r"\binclude\s*\(([^)]*)\)")
INCLUDE_LIST = re.compile(r"^\s*include[ \t]+([\"'].*)$", re.MULTILINE)
QUOTED = re.compile(r"[\"']([^\"']+)[\"']")
PROJECT = re.compile(r"\b(?:implementation|api|compileOnly|runtimeOnly)\s*\(?\s*project\s*\(\s*(?:path\s*[=:]\s*)?[\"']([^\"']+)[\"']")
BLOCK_COMMENT = re.compile(r"/\*.*?\*/", re.DOTALL)


def line_comment_start(line: str) -> int:
    """Where // begins outside of quotes, or -1; a backslash hides the next character."""
    quote, i = "", 0
    while i < len(line):
        c = line[i]
        if c == "\\":
            i += 1
        elif quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif line.startswith("//", i):
            return i
        i += 1
    return -1


def without_line_comments(text: str) -> str:
    return "\n".join(line if (at := line_comment_start(line)) < 0 else line[:at] for line in text.splitlines())


def project_folder(path: str) -> str:
    """A project path as a relative folder."""
    return path.strip().replace(".", "/").lstrip(":").replace(":", "/")


def settings_modules(text: str) -> list[str]:
    """Folders of the projects that a settings file includes, each once, in order."""
    clean = without_line_comments(BLOCK_COMMENT.sub(" ", text))
    names = [n for form in (INCLUDE_CALL, INCLUDE_LIST) for m in form.finditer(clean) for n in QUOTED.findall(m.group(1))]
    return list(dict.fromkeys(f for n in names if (f := project_folder(n))))


def project_dependencies(text: str) -> list[str]:
    """Folders of the projects that a build file depends on, repeats included; test configurations do not count."""
    return [project_folder(p) for p in PROJECT.findall(without_line_comments(text))]


def pom_modules(text: str) -> list[str]:
    """Modules of a reactor: the first <modules> below the root, whatever its namespace prefix."""
    if "<!DOCTYPE" in text.upper():
        raise OSError("document types are not read")
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise OSError(f"not a project file: {e}") from e

    def named(element, name: str) -> bool:
        return element.tag.rsplit("}", 1)[-1].rsplit(":", 1)[-1].lower() == name

    for modules in root:
        if named(modules, "modules"):
            return [t for m in modules if named(m, "module") and (t := (m.text or "").strip().replace("\\", "/"))]
    return []


def module_dependencies(modules: list[dict]) -> list[tuple[str, str]]:
    """(module, depends_on) of every build file of modules(name, root); a Kotlin script goes before a Groovy one."""
    known, out = {m["name"] for m in modules}, []
    for m in modules:
        file = next((p for n in ("build.gradle.kts", "build.gradle") if os.path.isfile(p := os.path.join(m["root"], n))), None)
        if file:
            with open(file, encoding="utf-8") as f:
                out += [(m["name"], d) for p in project_dependencies(f.read()) if (d := p.replace("/", "__")) in known]
    return out
