"""A small state graph for driver-side workflows: named steps, edges, routers, retries and resume.

A step takes and returns a dict of state; Spark's plans stay lazy inside it."""

from __future__ import annotations

import time
from collections.abc import Callable

END = "__end__"
MOST_STEPS, RETRY_SECONDS = 64, 0.4


class StateGraph:
    def __init__(self):
        self.nodes: dict[str, tuple[Callable, int]] = {}
        self.edges: dict[str, tuple[Callable | None, tuple[str, ...]]] = {}

    def add_node(self, name: str, step: Callable[[dict], dict], retries: int = 0) -> StateGraph:
        if name in self.nodes or name == END:
            raise ValueError(f"duplicate node {name}")
        self.nodes[name] = (step, retries)
        return self

    def add_edge(self, source: str, target: str) -> StateGraph:
        return self.add_conditional(source, None, (target,))

    def add_conditional(self, source: str, router: Callable[[dict], str] | None, targets: tuple[str, ...]) -> StateGraph:
        if source in self.edges:
            raise ValueError(f"{source} has an exit already")
        self.edges[source] = (router, targets)
        return self

    def compile(self, start: str) -> CompiledGraph:
        known = {*self.nodes, END}
        if start not in self.nodes:
            raise ValueError(f"unknown start {start}")
        for source, (_, targets) in self.edges.items():
            if source not in self.nodes or not known.issuperset(targets):
                raise ValueError(f"unknown node at {source} -> {targets}")
        if lone := [n for n in self.nodes if n not in self.edges]:
            raise ValueError(f"no exit from {lone}")
        return CompiledGraph(self, start)


class CompiledGraph:
    def __init__(self, graph: StateGraph, start: str):
        self.graph, self.start = graph, start

    def describe(self) -> list[tuple[str, str]]:
        return [(s, t) for s, (_, targets) in self.graph.edges.items() for t in targets]

    def run(self, state: dict, on_event: Callable[[dict], None] | None = None, resume: str | None = None, aborted: Callable[[], bool] = lambda: False, sleep=time.sleep) -> dict:
        """Merges each step's result into the state until the end; a failing step is tried again as often as allowed."""
        tell = on_event or (lambda e: None)
        state, at = dict(state), resume or self.start
        for _ in range(MOST_STEPS):
            if at == END:
                return state
            if aborted():
                raise InterruptedError(at)
            step, retries = self.graph.nodes[at]
            for attempt in range(retries + 1):
                tell({"type": "start" if not attempt else "retry", "node": at, "at": time.time()})
                try:
                    state |= step(state) or {}
                    break
                except Exception as e:
                    if attempt == retries:
                        tell({"type": "error", "node": at, "at": time.time(), "message": str(e)})
                        raise
                    sleep(RETRY_SECONDS * 2**attempt)
            router, targets = self.graph.edges[at]
            to = router(state) if router else targets[0]
            if to not in targets:
                raise ValueError(f"{at} routed to {to}, which it does not declare")
            tell({"type": "end", "node": at, "at": time.time(), "to": to})
            at = to
        raise RuntimeError(f"more than {MOST_STEPS} steps")
