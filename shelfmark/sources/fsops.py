"""Moves, undo and verified copies of files that every executor can reach.

A plan's rows are applied in their partitions; what comes back is one row of
outcome for each. Nothing is ever overwritten or deleted, and a row that was
already applied is recognised, so a task that runs again changes nothing.
"""

from __future__ import annotations

import hashlib
import os
import shutil
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def digest(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def move(source: str, target: str) -> tuple[str, str]:
    """(outcome, place): done, or skipped if the source is gone. A target that
    is taken gets the first free _conflict_N; a link is made before the source
    goes, so two movers cannot take the same name."""
    if not os.path.exists(source):
        return ("done", target) if os.path.exists(target) else ("skipped", "")
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    head, tail = os.path.splitext(target)
    n, place = 0, target
    while True:
        try:
            os.link(source, place)
            break
        except FileExistsError:
            if os.path.samefile(source, place):
                break
            n += 1
            place = f"{head}_conflict_{n}{tail}"
        except OSError:
            # another volume or no links: the name is reserved, filled, and read back before the source goes
            try:
                os.close(os.open(place, os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                n += 1
                place = f"{head}_conflict_{n}{tail}"
                continue
            shutil.copy2(source, place)
            if digest(place) != digest(source):
                os.unlink(place)
                raise OSError(f"the copy differs: {place}") from None
            break
    os.unlink(source)
    return "done", place


def copy_verified(source: str, target: str, sha256: str | None, tries: int = 2) -> tuple[str, str]:
    """(outcome, sha256): the copy is read back and compared, with one more try."""
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    want = sha256 or digest(source)
    for _ in range(tries):
        shutil.copy2(source, target + ".part")
        got = digest(target + ".part")
        if got == want:
            os.replace(target + ".part", target)
            return "done", got
    os.unlink(target + ".part")
    return "error", got


def _apply(rows: DataFrame, columns: list[str], act: Callable[..., tuple[str, str]]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, *args in frame.itertuples(index=False):
                try:
                    outcome, detail = act(*[None if a is None or a != a else a for a in args])
                except OSError as e:
                    outcome, detail = "error", str(e)
                out.append((key, outcome, detail))
            yield pd.DataFrame({"op_id": [o[0] for o in out], "status": pd.Series([o[1] for o in out], dtype=object), "detail": pd.Series([o[2] for o in out], dtype=object)})

    return rows.select("op_id", *columns).mapInPandas(run, "op_id long, status string, detail string")


def execute(operations: DataFrame) -> DataFrame:
    """(op_id, status, detail) of moves (op_id, source_path, target_path)."""
    return _apply(operations, ["source_path", "target_path"], move)


def undo(operations: DataFrame) -> DataFrame:
    """(op_id, status, detail): moves turned round, the last executed first.

    Moves that touch the same place have to keep their order, so all moves of
    one file (file_id; without that column every move stands alone) go to one task
    and are sorted there; an occupied old
    place is an error and nothing is moved."""
    key = "file_id" if "file_id" in operations.columns else "op_id"
    last = [F.desc(c) for c in ("executed_at", "op_id") if c in operations.columns]
    ordered = operations.repartition(key).sortWithinPartitions(key, *last)
    return _apply(ordered, ["target_path", "source_path"], move_back)


def move_back(source: str, target: str) -> tuple[str, str]:
    """(outcome, place): done, skipped if the file is gone, error if its old place is taken."""
    if not os.path.exists(source):
        return ("done", target) if os.path.exists(target) else ("skipped", "")
    if os.path.exists(target) and not os.path.samefile(source, target):
        return "error", f"taken: {target}"
    return move(source, target)


def clone(rows: DataFrame) -> DataFrame:
    """(op_id, status, detail) of copies (op_id, source_path, target_path, sha256)."""
    return _apply(rows, ["source_path", "target_path", "sha256"], copy_verified)
