"""Path functions as columns: rule chains, globs, ancestors, normal form."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """One named rule; a path matches if any of its tests does."""

    name: str
    exact: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    contains: tuple[str, ...] = ()
    regex: tuple[str, ...] = ()

    def test(self, path: Column) -> Column:
        tests = [path == item for item in self.exact]
        tests += [path.startswith(item) for item in self.prefixes]
        tests += [path.contains(item) for item in self.contains]
        tests += [path.rlike(item) for item in self.regex]
        found = F.lit(False)
        for test in tests:
            found = found | test
        return found


@dataclass(frozen=True)
class PathRules:
    """Ordered rules, first match wins, and the name of everything else."""

    rules: tuple[Rule, ...] = field(default_factory=tuple)
    default: str = "other"

    def name(self, path: Column) -> Column:
        found = None
        for rule in self.rules:
            found = (F if found is None else found).when(rule.test(path), rule.name)
        return F.lit(self.default) if found is None else found.otherwise(self.default)


def first_match(path: Column, patterns: Sequence[tuple[str, str]], fallback: str) -> Column:
    """The value of the first (regex, value) pair the whole path matches."""
    found = None
    for pattern, value in patterns:
        found = (F if found is None else found).when(path.rlike(f"^(?:{pattern})$"), value)
    return F.lit(fallback) if found is None else found.otherwise(fallback)


def shell_glob(pattern: str) -> str:
    """Regex of a shell glob in which ``*`` also crosses ``/`` (path classes)."""
    out, at = [], 0
    while at < len(pattern):
        char = pattern[at]
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif char == "[" and "]" in pattern[at + 2:]:
            end = pattern.index("]", at + 2)
            body = pattern[at + 1:end].replace("\\", r"\\")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            at = end
        else:
            out.append(re.escape(char))
        at += 1
    return "".join(out)


# The taxonomy dialect as a table: longest token first, everything else is literal.
_GLOB_TOKEN = re.compile(r"\*\*/|/\*\*$|\*\*|\*|\?|[^*?/]+|/")
_GLOB_REGEX = {"**/": "(?:.*/)?", "/**": "(?:/.*)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def tree_glob(pattern: str) -> str:
    """Regex of a taxonomy glob: ``*`` stays inside a segment; without a slash it matches at any depth."""
    tokens = _GLOB_TOKEN.findall(pattern.lstrip("/"))
    regex = "".join(_GLOB_REGEX.get(token, re.escape(token)) for token in tokens)
    return regex if "/" in pattern else "(?:.*/)?" + regex


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the file name; empty for none and for dotfiles."""
    base = F.substring_index(path, "/", -1)
    has = base.contains(".") & ~base.startswith(".")
    return F.when(has, F.lower(F.substring_index(base, ".", -1))).otherwise("")


def ancestors(path: Column, proper: bool = False) -> Column:
    """``a/b/c`` to [a, a/b, a/b/c]: what turns a prefix test into an equality."""
    parts = F.split(path, "/")
    last = F.size(parts) - (1 if proper else 0)
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    )


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def normalize(path: Column) -> Column:
    """Resolve ``.`` and ``..``; leading ``..`` of an escape above the root stay."""
    def step(done: Column, part: Column) -> Column:
        pops = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        return (
            F.when(part.isin("", "."), done)
            .when(pops, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.concat(done, F.array(part)))
        )

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def join_relative(link: Column, target: Column) -> Column:
    """Where a link at ``link`` with text ``target`` points, in normal form."""
    return normalize(F.concat_ws("/", directory(link), target))


def arch_of(name: Column, prefixes: Mapping[str, str], separator: str = "-") -> Column:
    """The architecture a name's first part stands for, else empty."""
    table = F.create_map(*[F.lit(item) for pair in prefixes.items() for item in pair])
    known = F.try_element_at(table, F.substring_index(name, separator, 1))
    return F.when(name.contains(separator), F.coalesce(known, F.lit(""))).otherwise("")
