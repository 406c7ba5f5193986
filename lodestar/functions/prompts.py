"""Prompts for row-wise annotation, in our own wording: placeholders are columns."""

from __future__ import annotations

PROMPTS: dict[str, str] = {
    "field": "Name the mathematical fields that this problem belongs to, separated by commas, and nothing else.\n\nProblem:\n{problem}\n\nSolution:\n{solution}\n",
    "explain": "Work out this problem step by step so that it ends in the given answer.\n\nProblem:\n{problem}\n\nAnswer:\n{answer}\n",
    "solve": "Solve this problem. Give the reasoning, then the answer on a line of its own.\n\nProblem:\n{problem}\n",
    "all_hints": "Repeat the problem unchanged, then add every step of the solution as a numbered hint. Never state the answer.\n\nProblem:\n{problem}\n\nSolution:\n{solution}\n\nAnswer:\n{answer}\n",
    "half_hints": "Repeat the problem unchanged, then add the first half of the solution's steps as numbered hints. Never state the answer.\n\nProblem:\n{problem}\n\nSolution:\n{solution}\n\nAnswer:\n{answer}\n",
    "one_hint": "Repeat the problem unchanged, then add the first step of the solution as the only hint. Never state the answer.\n\nProblem:\n{problem}\n\nSolution:\n{solution}\n\nAnswer:\n{answer}\n",
}
