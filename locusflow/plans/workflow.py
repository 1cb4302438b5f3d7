"""Resumable runs: stages with hashed inputs, staged writes, and results that appear by renaming."""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import re
import secrets
import shutil
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

TASK_ID = re.compile(r"[a-z0-9][a-z0-9_-]{0,63}")
MAX_TASKS = 1000
#: Files up to this size are identified by content, larger ones by size and time unless that is asked for.
HASHED_BYTES = 16 << 20


class WorkflowError(ValueError):
    """A plan or its inputs are wrong."""


@dataclass
class Stage:
    """A task: ``run(inputs, out)`` gets the result folders of what it depends on and fills the folder ``out``."""

    name: str
    run: Callable[[dict[str, str], str], None]
    depends_on: list[str] = field(default_factory=list)
    params: dict = field(default_factory=dict)
    version: str = "1"
    inputs: list[str] = field(default_factory=list)


def levels(tasks: dict[str, list[str]]) -> dict[str, int]:
    """The length of the longest chain of dependencies before each task."""
    out: dict[str, int] = {}
    for t in ordered(tasks):
        out[t] = max((out[n] + 1 for n in tasks[t]), default=0)
    return out


def ordered(tasks: dict[str, list[str]]) -> list[str]:
    """Tasks after all they depend on, by name among those that are free."""
    if len(tasks) > MAX_TASKS:
        raise WorkflowError(f"more than {MAX_TASKS} tasks")
    for t, needs in tasks.items():
        if not TASK_ID.fullmatch(t):
            raise WorkflowError(f"bad task id {t!r}")
        for n in needs:
            if n not in tasks:
                raise WorkflowError(f"{t} depends on {n!r}, which doesn't exist")
    sorter = TopologicalSorter(tasks)
    try:
        sorter.prepare()
    except CycleError as e:
        raise WorkflowError(f"cycle: {' -> '.join(e.args[1])}") from e
    out: list[str] = []
    while sorter.is_active():
        ready = sorted(sorter.get_ready())
        out += ready
        sorter.done(*ready)
    return out


def identity(path: str, full: bool = False) -> dict:
    """Path, size and time of a file, and its SHA-256 if it is small or ``full``."""
    info = os.stat(path)
    out = {"path": os.path.abspath(path), "size": info.st_size, "mtime": info.st_mtime_ns}
    if full or info.st_size <= HASHED_BYTES:
        with open(path, "rb") as f:
            out["sha256"] = hashlib.file_digest(f, "sha256").hexdigest()
    return out


def inventory(folder: str) -> dict[str, dict]:
    """The files below a folder with size and SHA-256, by relative path."""
    out = {}
    for base, _, names in os.walk(folder):
        for n in sorted(names):
            path = os.path.join(base, n)
            with open(path, "rb") as f:
                out[os.path.relpath(path, folder)] = {"size": os.path.getsize(path), "sha256": hashlib.file_digest(f, "sha256").hexdigest()}
    return out


def write_json(path: str, value) -> None:
    """Writes a file that is either whole or not there."""
    draft = f"{path}.{secrets.token_hex(4)}"
    with open(draft, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=1, sort_keys=True, ensure_ascii=False)
    os.replace(draft, path)


def read_json(path: str):
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (FileNotFoundError, ValueError):
        return None


@contextmanager
def locked(folder: str):
    """Holds a folder for one run at a time."""
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, ".lock"), "w", encoding="utf-8") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            raise WorkflowError(f"{folder} is in use by another run") from e
        yield


def publish(staged: str, target: str, replace: bool = False) -> None:
    """Renames a finished folder into place. An old one is kept aside until the new one stands, and comes back if it fails."""
    if not os.path.exists(target):
        os.rename(staged, target)
        return
    if not replace:
        raise WorkflowError(f"{target} exists")
    backup = f"{target}.old-{secrets.token_hex(4)}"
    os.rename(target, backup)
    try:
        os.rename(staged, target)
    except OSError:
        os.rename(backup, target)
        raise
    shutil.rmtree(backup)


class Workflow:
    """Stages in a work folder, which only its owner may use.

    A stage runs again if its version, parameters, input files or what it depends on changed, or if its result isn't what
    its completion record says. Results stand in ``results/<stage>/<attempt>``; a record is written last.
    """

    def __init__(self, folder: str, stages: list[Stage]):
        self.folder = os.path.abspath(folder)
        self.stages = {s.name: s for s in stages}
        if len(self.stages) != len(stages):
            raise WorkflowError("two stages have one name")
        self.order = ordered({s.name: s.depends_on for s in stages})

    def spec(self, name: str, specs: dict[str, str]) -> str:
        """The hash of all that a stage's result depends on."""
        s = self.stages[name]
        value = [s.name, s.version, s.params, [identity(p) for p in s.inputs], {d: specs[d] for d in s.depends_on}]
        return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()

    def plan(self, verify: bool = False) -> list[dict]:
        """What would run: (stage, spec, reuse) in order. ``verify`` looks at the contents of results, too."""
        specs: dict[str, str] = {}
        out, stale = [], set()
        for name in self.order:
            specs[name] = self.spec(name, specs)
            reuse = not stale & set(self.stages[name].depends_on) and self._valid(name, specs[name], verify)
            if not reuse:
                stale.add(name)
            out.append({"stage": name, "spec": specs[name], "reuse": reuse})
        return out

    def _record(self, name: str) -> str:
        return os.path.join(self.folder, "state", f"{name}.json")

    def _valid(self, name: str, spec: str, verify: bool) -> bool:
        done = read_json(self._record(name))
        if not done or done.get("spec") != spec or not os.path.isdir(done["result"]):
            return False
        if {d: (read_json(self._record(d)) or {}).get("attempt") for d in self.stages[name].depends_on} != done["dependencies"]:
            return False
        found = inventory(done["result"]) if verify else {os.path.relpath(os.path.join(b, n), done["result"]): {"size": os.path.getsize(os.path.join(b, n))} for b, _, names in os.walk(done["result"]) for n in names}
        return {k: x["size"] for k, x in found.items()} == {k: x["size"] for k, x in done["files"].items()} and (not verify or found == done["files"])

    def run(self, verify: bool = False) -> dict:
        """Runs what isn't done. Returns which stages ran, which were reused, and where their results are."""
        with locked(self.folder):
            for sub in ("state", "results", "attempts"):
                os.makedirs(os.path.join(self.folder, sub), exist_ok=True)
            plan = self.plan(verify)
            write_json(os.path.join(self.folder, "plan.json"), plan)
            ran, reused, results = [], [], {}
            for step in plan:
                name = step["stage"]
                if step["reuse"]:
                    reused.append(name)
                else:
                    self._execute(name, step["spec"], results)
                    ran.append(name)
                results[name] = read_json(self._record(name))["result"]
            out = {"ran": ran, "reused": reused, "results": results}
            write_json(os.path.join(self.folder, "last-run.json"), out | {"finished_ms": int(time.time() * 1000)})
            return out

    def _execute(self, name: str, spec: str, results: dict[str, str]) -> None:
        stage, attempt = self.stages[name], secrets.token_hex(16)
        staged = os.path.join(self.folder, "attempts", f"{name}-{attempt}")
        os.makedirs(staged)
        try:
            stage.run({d: results[d] for d in stage.depends_on}, staged)
            target = os.path.join(self.folder, "results", name, attempt)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            publish(staged, target)
        except BaseException:
            shutil.rmtree(staged, ignore_errors=True)
            raise
        needs = {d: read_json(self._record(d))["attempt"] for d in stage.depends_on}
        write_json(self._record(name), {"stage": name, "spec": spec, "attempt": attempt, "result": target, "files": inventory(target), "dependencies": needs})
