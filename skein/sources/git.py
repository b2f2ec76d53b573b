"""Where a tree stands in version control; absence of any of it is no error."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass


@dataclass(frozen=True)
class Provenance:
    commit_sha: str | None = None
    branch: str | None = None
    dirty: bool | None = None


def _ask(root: str, *words: str, seconds: int = 5) -> str | None:
    try:
        run = subprocess.run(["git", "-C", root, *words], capture_output=True, text=True, timeout=seconds, check=False)
    except (OSError, subprocess.SubprocessError):
        return None
    return run.stdout.strip() if run.returncode == 0 else None


def provenance(root: str) -> Provenance:
    """Commit, branch and whether tracked files differ.  Without a commit nothing is known; a detached head has no branch; a state that cannot be read is None, not clean."""
    root = root.removeprefix("file://")
    commit = _ask(root, "rev-parse", "HEAD")
    if not commit:
        return Provenance()
    branch, changed = _ask(root, "rev-parse", "--abbrev-ref", "HEAD"), _ask(root, "status", "--porcelain", "--untracked-files=no")
    return Provenance(commit, None if branch in ("HEAD", "", None) else branch, None if changed is None else bool(changed))
