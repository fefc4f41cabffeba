"""A managed block in the rule file of a coding agent, which asks it to run the audit before it calls a task done."""

from __future__ import annotations

import os

#: The rule file of each target.
TARGETS = {"claude": "CLAUDE.md", "cursor": ".cursorrules", "codex": "AGENTS.md", "agents": "AGENTS.md"}
BEGIN, END = "<!-- auditloom:begin -->", "<!-- auditloom:end -->"


def rule_block(min_score: float) -> str:
    command = f"python -m auditloom.plans.cli analyze . --format json --min-score {min_score:g}"
    told = ["## Audit before a task is done", "", f"Run `{command}`.", "", "- Exit code 0: the bar is met.", "- Exit code 1: below the bar; mend the findings that are real, then run it again.", "- Exit code 2: the command itself was wrong."]
    return "\n".join([BEGIN, *told, END])


def upsert_block(text: str, block: str) -> str:
    """`text` with the block in place of the one it has, or after all else; the rest stays as it is."""
    before, begin, rest = text.partition(BEGIN)
    _, end, after = rest.partition(END)
    if begin and end:
        return before + block + after
    return f"{text.rstrip()}\n\n{block}\n" if text.strip() else f"{block}\n"


def install(target: str, folder: str, min_score: float = 6.0) -> tuple[str, bool]:
    """File that was written, and whether it is new. Raises ValueError for an unknown target."""
    if target not in TARGETS:
        raise ValueError(f"unknown target {target}; one of {', '.join(TARGETS)}")
    path = os.path.join(folder, TARGETS[target])
    new, text = not os.path.exists(path), ""
    if not new:
        with open(path, encoding="utf-8", newline="") as f:
            text = f.read()
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(upsert_block(text, rule_block(min_score)))
    return path, new
