"""Named components: register and build preprocessors, indexers, fusers, rerankers, models and agents."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

KINDS = ("preprocessor", "indexer", "fuser", "reranker", "llm", "agent")
_known: dict[tuple[str, str], Callable[..., Any]] = {}


def register(kind: str, name: str) -> Callable:
    if kind not in KINDS:
        raise ValueError(f"unknown kind: {kind}")

    def keep(make: Callable) -> Callable:
        _known[kind, name] = make
        return make

    return keep


def build(kind: str, name: str, **options: Any) -> Any:
    if (kind, name) not in _known:
        raise KeyError(f"no {kind} named {name}; there are {', '.join(registered(kind)) or 'none'}")
    return _known[kind, name](**options)


def registered(kind: str) -> list[str]:
    return sorted(n for k, n in _known if k == kind)


@register("llm", "fake")
class ScriptedModel:
    """Answers prompts from a list in turn, the last one again and again; keeps the prompts."""

    def __init__(self, answers: list[str]):
        self.answers, self.prompts = list(answers), []

    def __call__(self, prompt: str) -> str:
        self.prompts.append(prompt)
        return self.answers[min(len(self.prompts), len(self.answers)) - 1]
