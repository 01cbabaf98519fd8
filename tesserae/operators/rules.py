"""Which files are indexed: path rules, ignore patterns, secret names, binary content."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.columns import basename, is_binary

IGNORE_FILE = ".tesseraeignore"
#: Directories, suffixes and names that are never indexed.
IGNORED_DIRS = ".git .hg .svn .tesserae .mypy_cache .pytest_cache __pycache__ node_modules .venv venv .tox .next dist build coverage_html".split()
IGNORED_SUFFIXES = ".lock .png .jpg .svg .pyc".split()
IGNORED_ENDINGS = ".min.js .min.css .map".split()
LOCK_FILES = "package-lock.json yarn.lock pnpm-lock.yaml npm-shrinkwrap.json".split()
#: Names that hold secrets, and endings of templates that do not.
SECRET_NAMES = ".env .env.local .env.development .env.production .npmrc id_rsa id_dsa id_ed25519 id_ecdsa .netrc .pgpass .htpasswd credentials.json service-account.json secrets.json secrets.yml secrets.yaml".split()
SECRET_SUFFIXES = ".p8 .ppk .key .pem .p12 .pfx .crt .cer .der .jks .keystore".split()
SECRET_GLOBS = r"\A(?:\.env\..*|.*\.tfstate|.*\.tfvars|.*\.secret|.*\.secrets)\z"
TEMPLATE_ENDINGS = ".example .sample .template".split()


def _suffix(name: Column) -> Column:
    """Suffix with its dot, as paths have it: none for dotfiles and for names that end with a dot."""
    return F.regexp_extract(name, r"^.+(\.[^./]+)$", 1)


def _ends_with(name: Column, endings: list[str]) -> Column:
    return name.rlike("(?:" + "|".join("\\Q" + e + "\\E" for e in endings) + r")\z")


def is_secret(path: Column) -> Column:
    """Whether a name holds secrets; templates of such files do not."""
    name = F.lower(basename(path))
    secret = name.isin(*SECRET_NAMES) | _suffix(name).isin(*SECRET_SUFFIXES) | name.rlike("(?s)" + SECRET_GLOBS)
    return ~_ends_with(name, TEMPLATE_ENDINGS) & secret


def in_ignored_directory(path: Column) -> Column:
    """Whether a parent component is an ignored directory; a file may have such a name."""
    parents = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return F.arrays_overlap(parents, F.array(*map(F.lit, IGNORED_DIRS)))


def glob_regex(pattern: str) -> str:
    """Java regex of a shell pattern in which ``*`` crosses slashes; whole-string, case-sensitive."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = i + 1 if pattern[i : i + 1] in ("!", "]") else i
            if pattern[i : i + 2] == "!]":
                end = i + 2
            end = pattern.find("]", end)
            if end < 0:
                out.append("\\[")
                continue
            inside = pattern[i:end]
            negated = inside.startswith("!")
            inside = re.sub(r"([\\\[\]&^~])", r"\\\1", inside[1:] if negated else inside)
            out.append(f"[{'^' if negated else ''}{inside}]")
            i = end + 1
        else:
            out.append("\\Q" + c + "\\E" if not c.isalnum() else c)
    return r"(?s)\A(?:" + "".join(out) + r")\z"


def matches_pattern(path: Column, pattern: str) -> Column:
    """Whether one line of an ignore file rejects a path.

    Leading dots and slashes are dropped. A trailing slash makes a literal directory prefix from the
    root; otherwise the pattern is matched to the whole path, and a plain word to any component.
    """
    cleaned = pattern.strip().lstrip("./")
    if not cleaned:
        return F.lit(False)
    if cleaned.endswith("/"):
        folder = cleaned.rstrip("/")
        return (path == folder) | path.startswith(folder + "/")
    found = path.rlike(glob_regex(cleaned))
    if "/" not in cleaned and not re.search(r"[*?\[]", cleaned):
        found = found | F.array_contains(F.split(path, "/"), cleaned)
    return found


def ignored_by(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern rejects a path; the patterns of an ignore file are few and folded into one expression."""
    out = F.lit(False)
    for pattern in sorted(set(patterns)):
        out = out | matches_pattern(path, pattern)
    return out


def read_patterns(text: str) -> set[str]:
    """Patterns of an ignore file: lines that are not blank and do not begin with ``#``."""
    return {line.strip() for line in text.splitlines() if line.strip() and not line.startswith("#")}


def path_skip_reason(path: Column, patterns: list[str]) -> Column:
    """Why the path alone keeps a file out, in the order of the rules; null if it does not."""
    name = basename(path)
    return (
        F.when(path == IGNORE_FILE, "ignore file")
        .when(in_ignored_directory(path), "directory")
        .when(_suffix(name).isin(*IGNORED_SUFFIXES), "suffix")
        .when(_ends_with(name, IGNORED_ENDINGS), "ending")
        .when(name.isin(*LOCK_FILES), "lock file")
        .when(is_secret(path), "secret")
        .when(ignored_by(path, patterns), "pattern")
    )


def skip_reason(path: Column, content: Column, patterns: list[str]) -> Column:
    """Why a file is not indexed; null if it is."""
    return F.coalesce(path_skip_reason(path, patterns), F.when(is_binary(content), "binary"))


def indexable(files: DataFrame, patterns: list[str], path: str = "rel_path", content: str = "content") -> DataFrame:
    """Rows of ``files`` that are indexed; the cheap path rules come before the content."""
    return files.filter(path_skip_reason(F.col(path), patterns).isNull()).filter(~is_binary(F.col(content)))
