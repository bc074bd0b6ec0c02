"""A pipeline of stages with dependencies: order, states, resume."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from ..schemas import STATES


@dataclass(frozen=True)
class Stage:
    """needs must be completed before run(); after only orders. run() returns where its output is."""

    name: str
    run: Callable[[], str]
    needs: tuple[str, ...] = ()
    after: tuple[str, ...] = ()


@dataclass
class States:
    """States of stages, in a JSON file of a mounted folder; on a cluster the shared one, so that another driver can go on."""

    path: Path
    known: dict[str, dict] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.path = Path(self.path)
        if self.path.exists():
            self.known = json.loads(self.path.read_text(encoding="utf-8"))

    def of(self, name: str) -> str:
        state = self.known.get(name, {}).get("status", "pending")
        return state if state in STATES else "pending"

    def put(self, name: str, status: str, **more: str | None) -> None:
        now = datetime.now(UTC).isoformat()
        own = self.known.setdefault(name, {"name": name})
        own |= {"status": status, "updated_at": now, "error": None} | more
        own[{"running": "started_at"}.get(status, "finished_at")] = now
        self.path.parent.mkdir(parents=True, exist_ok=True)
        # a reader, or a driver that comes back, sees the old states or the new ones
        new = self.path.with_name(f".{self.path.name}.{uuid.uuid4().hex}")
        new.write_text(json.dumps(self.known, ensure_ascii=False, indent=1), encoding="utf-8")
        new.replace(self.path)


def ordered(stages: Iterable[Stage]) -> list[Stage]:
    """Stages after those they need or follow, by name among those ready; unknown names count as done. A cycle raises ValueError."""
    left = {s.name: s for s in stages}
    out: list[Stage] = []
    while left:
        ready = sorted(n for n, s in left.items() if not any(d in left for d in (*s.needs, *s.after)))
        if not ready:
            raise ValueError(f"stages in a cycle: {sorted(left)}")
        out.append(left.pop(ready[0]))
    return out


def run(stages: Iterable[Stage], states: States) -> bool:
    """Runs what is not completed, in order; stops at the first failure or unready stage and tells whether all is done."""
    for stage in ordered(stages):
        if states.of(stage.name) == "completed":
            continue
        if any(states.of(d) != "completed" for d in stage.needs):
            return False
        states.put(stage.name, "running")
        try:
            states.put(stage.name, "completed", output_path=stage.run())
        except Exception as e:
            states.put(stage.name, "failed", error=str(e))
            return False
    return True
