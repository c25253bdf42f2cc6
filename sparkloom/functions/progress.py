"""Progress of a run and the status of generated fields."""

from __future__ import annotations

#: Stages of indexing with their share of the work.  Fixed values.
STAGES = {"scan": 5, "parse": 15, "graph": 20, "summarize": 25, "metadata": 10, "embed": 25}


def percent(done: dict[str, tuple[int, int]]) -> float:
    """Weighted percentage from (done, total) per stage; a stage without work counts as done, unknown stages not."""
    got = sum(w * (min(done[s][0] / done[s][1], 1.0) if done[s][1] else 1.0) for s, w in STAGES.items() if s in done)
    return min(100.0, round(got, 2))


def status(completed: int, failed: int) -> str:
    if failed and completed:
        return "partial"
    return "failed" if failed else "completed" if completed else "pending"
