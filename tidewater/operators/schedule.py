"""Learning-rate rules, metric schedules, epoch gates and path selectors."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def rule_value(step: Column, start: int, durations: list[int], rates: list[float], transitions: list[str], loop: bool = False) -> Column:
    """A rule's rate at a step: segments of the given durations from rate to rate, CONSTANT, LINEAR or COSINE.

    Segments of no length are skipped. Past the end the last rate holds, or the segments repeat.
    """
    period, rel = sum(durations), step - F.lit(start)
    if loop and period:
        rel = F.pmod(rel, F.lit(period))
    last = rates[-1] if rates else 0.0
    found, at = None, 0
    for i, length in enumerate(durations):
        if length <= 0:
            continue
        a, b = float(rates[min(i, len(rates) - 1)]), float(rates[min(i + 1, len(rates) - 1)])
        t = (rel - F.lit(at)) / F.lit(float(length))
        kind = transitions[i] if i < len(transitions) else "CONSTANT"
        value = {"CONSTANT": F.lit(a), "LINEAR": F.lit(a) + F.lit(b - a) * t, "COSINE": F.lit(a) + F.lit(0.5 * (b - a)) * (F.lit(1.0) - F.cos(F.pi() * t))}[kind]
        inside = (rel >= at) & (rel < at + length)
        found = F.when(inside, value) if found is None else found.when(inside, value)
        at += length
    return F.lit(float(last)) if found is None else found.otherwise(F.lit(float(last)))


def scheduled(step: Column, rules: list[dict]) -> Column:
    """The rate at a step by the rule of the largest start at or before it; before all, the earliest rule's first rate."""
    if not rules:
        return F.lit(0.0)
    rules = sorted(rules, key=lambda r: r["starting_step"])
    out = F.lit(float(rules[0]["lr"][0]) if rules[0]["lr"] else 0.0)
    for r in rules:
        out = F.when(step >= r["starting_step"], rule_value(step, r["starting_step"], r["duration_steps"], r["lr"], r.get("transition", []), r.get("loop", False))).otherwise(out)
    return out


def warmed(rate: Column, step: Column, steps: int) -> Column:
    """The rate scaled up from 0 over the first steps."""
    return rate * F.least(F.lit(1.0), (step + 1) / F.lit(float(steps))) if steps else rate


def due(global_step: Column, local_step: Column, period: int, use_global: bool = True, after_epoch: bool = False, last: Column | None = None) -> Column:
    """Whether a metric is to be computed: every period steps, or at an epoch's last."""
    if after_epoch:
        return last if last is not None else F.lit(False)
    return ((global_step if use_global else local_step) + 1) % F.lit(period) == 0


def gate(to_wait: int, per_net: int, used: Iterable[int]) -> list[int]:
    """What each epoch waits for: what the epoch before used goes off, and half a share is the least. A fold over epochs."""
    out = []
    for n in used:
        to_wait = max(to_wait + per_net - n, per_net // 2)
        out.append(to_wait)
    return out


def open_gate(since_anchor: Column, to_wait: Column, forced: Column) -> Column:
    return (since_anchor >= to_wait) | forced


def glob_regex(glob: str) -> str:
    """A shell pattern as a regular expression of the whole path; * crosses separators."""
    out = []
    i = 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2)
        if c == "[" and end > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out.append(f"[{'^' + inner[1:] if inner[0] == '!' else inner}]")
            i = end + 1
            continue
        out.append({"*": ".*", "?": "."}.get(c) or re.escape(c))
        i += 1
    return f"^{''.join(out)}$"


def selected(path: Column, rules: list[tuple[str, object]], default: object) -> Column:
    """The value of the first rule whose glob meets the path, else the default."""
    out = None
    for glob, value in rules:
        met = path.rlike(glob_regex(glob))
        out = F.when(met, F.lit(value)) if out is None else out.when(met, F.lit(value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))
