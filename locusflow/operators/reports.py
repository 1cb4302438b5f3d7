"""Trimming reports: JSON that may need mending, checked against counts of the reads themselves."""

from __future__ import annotations

import json
import os

from locusflow.operators.sets import GateError

LARGEST = 64 << 20
#: The last field of a report, whose text isn't escaped by some versions of the tool that writes it (fixed value).
LAST = '"command":'


def parse_report(text: str) -> tuple[dict, bool]:
    """(report, was it mended). Only a last field with an unescaped command line can be mended: it becomes null."""
    try:
        return json.loads(text), False
    except ValueError:
        pass
    head, found, tail = text.rpartition(LAST)
    tail = tail.strip()
    if not found or not tail.startswith('"') or not tail.endswith("}") or not tail[:-1].rstrip().endswith('"') or len(tail[:-1].rstrip()) < 2:
        raise GateError("the trimming report isn't JSON and can't be mended")
    try:
        return json.loads(f"{head}{LAST} null}}"), True
    except ValueError as e:
        raise GateError(f"the trimming report isn't JSON: {e}") from e


def normalised_report(path: str, pairs_before: int, pairs_after: int) -> dict:
    """A trimming report as sound JSON with a note on what was done to it.

    Its numbers of reads before and after must be those of the pairs that were counted in the files themselves.
    """
    if os.path.getsize(path) > LARGEST:
        raise GateError("the trimming report is too large")
    with open(path, encoding="utf-8") as f:
        report, mended = parse_report(f.read())
    for name, pairs in (("before_filtering", pairs_before), ("after_filtering", pairs_after)):
        found = report.get("summary", {}).get(name, {}).get("total_reads")
        if found != 2 * pairs:
            raise GateError(f"the trimming report has {found} reads {name.replace('_', ' ')}, the files have {2 * pairs}")
    return report | {"adapter": {"command_removed": mended, "counts_checked": True}}
