"""Which complete-list read a question asks for; the first that fits."""

from __future__ import annotations

import re

from bitempo.functions.dates import query_window

_LANES = [
    ("unassigned_items", re.compile(r"(?i)\b(unassigned|without (an )?assignee|nobody is assigned|no assignee)\b")),
    ("assigned_to", re.compile(r"(?i)\b(assigned to|working on|works on|on .+'s plate)\b")),
    ("latest_commits", re.compile(r"(?i)\b(latest|last|newest|most recent) commits?\b")),
    ("api_consumers", re.compile(r"(?i)\b(consum\w+|call\w*|use[sd]?) .*\b(api|endpoint)\b")),
    ("work_items_by_key", re.compile(r"\b[A-Z][A-Z0-9]{1,11}-\d+\b")),
    ("commits_by_sha", re.compile(r"(?i)\b(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{7,40}\b")),
]


def route(question: str) -> str | None:
    """The name of the lane, or None for a question that only search can answer."""
    for name, pattern in _LANES:
        if pattern.search(question):
            return name
    start, end, _ = query_window(question)
    return "window_activity" if start and end and re.search(r"(?i)\b(happened|changed|activity|worked|done)\b", question) else None


def knowledge_layers(question: str) -> dict[str, bool]:
    """Whether a question asks for proposals or for findings."""
    return {"wisdom": bool(re.search(r"(?i)\b(lesson|advice|recommend|should we|wisdom|best practice)", question)), "findings": bool(re.search(r"(?i)\b(finding|risk|issue found|violation|breaking)", question))}
