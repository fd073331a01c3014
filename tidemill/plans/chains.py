"""Chains of loads: `1>>[2,3]>>4` read into a tree and carried out in order.

`>>` is a sequence, a list in brackets runs side by side, and either may hold
the other to any depth.
"""

from __future__ import annotations

import re
import threading
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

Node = "int | Serial | Parallel"


@dataclass(frozen=True)
class Serial:
    items: tuple


@dataclass(frozen=True)
class Parallel:
    items: tuple


class ChainError(ValueError):
    """A chain that can't be read, or that names unknown objects."""


def parse(text: str) -> Serial | Parallel | int:
    """The tree of a chain."""
    tokens = re.findall(r">>|[\[\],]|\d+|\S", text)
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take(want: str | None = None) -> str:
        nonlocal at
        got = peek()
        if got is None or (want and got != want):
            raise ChainError(f"{text!r}: expected {want or 'an object'}, found {got or 'the end'}")
        at += 1
        return got

    def atom():
        if peek() == "[":
            take()
            inner = group()
            take("]")
            return inner
        got = take()
        if not got.isdigit():
            raise ChainError(f"{text!r}: expected an object, found {got!r}")
        return int(got)

    def sequence():
        items = [atom()]
        while peek() == ">>":
            take()
            items.append(atom())
        return items[0] if len(items) == 1 else Serial(tuple(items))

    def group():
        items = [sequence()]
        while peek() == ",":
            take()
            items.append(sequence())
        return items[0] if len(items) == 1 else Parallel(tuple(items))

    tree = group()
    if peek() is not None:
        raise ChainError(f"{text!r}: {peek()!r} left over")
    return tree


def nested(tree) -> list:
    """Steps as nested lists: a list of steps, each a list of what runs side by side."""

    def member(n):
        return n if isinstance(n, int) else steps(n)

    def steps(n) -> list:
        if isinstance(n, Serial):
            return [step(x) for x in n.items]
        return [step(n)]

    def step(n) -> list:
        return [member(x) for x in n.items] if isinstance(n, Parallel) else [n] if isinstance(n, int) else steps(n)

    return steps(tree)


def objects(tree) -> list[int]:
    return [tree] if isinstance(tree, int) else [o for x in tree.items for o in objects(x)]


def run(tree, work: Callable[[int], object], workers: int = 3) -> None:
    """Carry out a tree; a failure stops its sequence and is raised once its side runs have ended."""
    room = threading.Semaphore(workers)

    def go(n) -> None:
        if isinstance(n, int):
            with room:
                work(n)
        elif isinstance(n, Serial):
            for x in n.items:
                go(x)
        else:
            with ThreadPoolExecutor(len(n.items)) as pool:
                for f in [pool.submit(go, x) for x in n.items]:
                    f.exception()
                    errors.append(f.exception()) if f.exception() else None
            if errors:
                raise errors[0]

    errors: list[BaseException] = []
    go(tree)


def lanes(ids: Iterable[int], count: int = 3) -> list[list[int]]:
    """Objects in order of their ids dealt to lanes in turn; a lane is a sequence."""
    out: list[list[int]] = [[] for _ in range(count)]
    for k, i in enumerate(sorted(ids)):
        out[k % count].append(i)
    return [x for x in out if x]


def as_lanes(ids: Iterable[int], count: int = 3):
    serial = [Serial(tuple(x)) if len(x) > 1 else x[0] for x in lanes(ids, count)]
    return serial[0] if len(serial) == 1 else Parallel(tuple(serial))


def order(active: Iterable[int], edges: Iterable[tuple[int, int]], known: Iterable[int] | None = None) -> tuple[list[int], dict[int, set[int]]]:
    """(objects without edges, predecessors of the others).

    An edge is (object, what it depends on) and counts among active objects
    only.  Ids that aren't known, and circles, raise.
    """
    active = set(active)
    edges = list(edges)
    if known is not None and (wrong := {i for e in edges for i in e} - set(known)):
        raise ChainError(f"dependencies name unknown objects: {sorted(wrong)}")
    before: dict[int, set[int]] = {}
    for obj, dep in edges:
        if obj in active and dep in active:
            before.setdefault(obj, set()).add(dep)
            before.setdefault(dep, set())
    try:
        TopologicalSorter(before).prepare()
    except CycleError as e:
        raise ChainError(f"dependencies run in a circle: {e.args[1]}") from e
    return sorted(active - set(before)), before


def run_ordered(before: dict[int, set[int]], work: Callable[[int], object], workers: int = 3) -> list[int]:
    """Carry out objects once all before them are done, ``workers`` at a time; returns them as they ended.

    What depends on a failed object isn't run; the first failure is raised at the end.
    """
    sorter, done, errors = TopologicalSorter(before), [], []
    sorter.prepare()
    with ThreadPoolExecutor(workers) as pool:
        running: dict = {}
        wake = threading.Condition()
        while True:
            for i in sorter.get_ready():
                f = pool.submit(work, i)
                running[f] = i
                f.add_done_callback(lambda _: _notify(wake))
            if not running:
                break
            with wake:
                wake.wait_for(lambda: any(f.done() for f in running))
            for f in [f for f in running if f.done()]:
                i = running.pop(f)
                if f.exception():
                    errors.append(f.exception())
                else:
                    done.append(i)
                    sorter.done(i)
    if errors:
        raise errors[0]
    return done


def _notify(wake: threading.Condition) -> None:
    with wake:
        wake.notify_all()
