"""Commit state of a working tree."""

from __future__ import annotations

import subprocess


def _rev(root: str, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, "rev-parse", *args], capture_output=True, text=True, timeout=30)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout.strip() or None if done.returncode == 0 else None


def commit_state(root: str) -> tuple[str | None, str | None]:
    """(HEAD, its parent); None where there is none or git fails."""
    head = _rev(root, "--verify", "HEAD")
    return head, _rev(root, "--verify", "--quiet", "HEAD^") if head else None
