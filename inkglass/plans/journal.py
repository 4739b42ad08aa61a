"""Carrying out a plan and taking it back: effects stay outside DataFrame programs.

Moves of a plan are streamed to the driver row by row and made on the file
system that holds the files; each is written to the run's journal before the
next, so an interrupted run can be undone, too.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterable
from datetime import datetime
from pathlib import Path

from ..sources.readers import INDEX_NAME, MASTER_NAME

DATA = ".organizer"


def _escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n")


def _unescape(s: str) -> str:
    out, it = [], iter(s)
    for c in it:
        if c == "\\":
            c = next(it, "\\")
            c = {"t": "\t", "n": "\n"}.get(c, c)
        out.append(c)
    return "".join(out)


def free_name(path: Path) -> Path:
    """The path, or with " (2)" and so on if it is taken."""
    n, out = 2, path
    while out.exists():
        out, n = path.with_name(f"{path.stem} ({n}){path.suffix}"), n + 1
    return out


def move(source: Path, target: Path) -> None:
    """Renames, or copies, compares sizes and only then deletes."""
    target.parent.mkdir(parents=True, exist_ok=True)
    try:
        os.rename(source, target)
        return
    except OSError:
        pass
    shutil.copy2(source, target)
    if target.stat().st_size != source.stat().st_size:
        target.unlink()
        raise OSError("the copy did not finish")
    source.unlink()


def apply(moves: Iterable[tuple[str, str]], root: str, output: str) -> tuple[str, int, list[tuple[str, str]]]:
    """(run id, moved, failed) of (rel_path, target) moves below ``root`` into ``output``."""
    runs = Path(output, DATA, "runs")
    runs.mkdir(parents=True, exist_ok=True)
    stamp = datetime.now().strftime("%Y%m%d-%H%M%S-%f")[:-3]
    run, n = stamp, 2
    while any(Path(runs, run + e).exists() for e in (".tsv", ".undone")):
        run, n = f"{stamp}-{n}", n + 1
    moved, failed, log = 0, [], Path(runs, run + ".tsv")
    with log.open("w", encoding="utf-8") as f:
        for rel, to in moves:
            source = Path(root, rel)
            if not source.exists():
                failed.append((rel, "it was no longer there"))
                continue
            try:
                target = free_name(Path(output, to))
                move(source, target)
            except OSError as e:
                failed.append((rel, str(e)))
                continue
            f.write(f"{_escape(str(source))}\t{_escape(str(target))}\n")
            f.flush()
            moved += 1
    if not moved:
        log.unlink()
    return run, moved, failed


def last_run(output: str) -> str | None:
    """The last run that was not undone."""
    return max((p.stem for p in Path(output, DATA, "runs").glob("*.tsv")), default=None)


def undo_last(output: str) -> tuple[int, list[tuple[str, str]]]:
    """(restored, failed) of the last run that was not undone, in reverse order."""
    runs = sorted(Path(output, DATA, "runs").glob("*.tsv"))
    if not runs:
        return 0, []
    restored, failed = 0, []
    for line in reversed([x for x in runs[-1].read_text(encoding="utf-8").splitlines() if x.strip()]):
        parts = [_unescape(x) for x in line.split("\t")]
        if len(parts) < 2:
            continue
        home, now = map(Path, parts[:2])
        if not now.exists():
            failed.append((str(now), "it has been moved or deleted since"))
            continue
        try:
            move(now, free_name(home))
            restored += 1
        except OSError as e:
            failed.append((str(now), str(e)))
    runs[-1].rename(runs[-1].with_suffix(".undone"))
    drop_empty(output)
    return restored, failed


def drop_empty(output: str) -> None:
    """Folders with nothing but an index of them."""
    for folder, _, _ in os.walk(output, topdown=False):
        if folder == output or DATA in Path(folder).parts:
            continue
        left = list(Path(folder).iterdir())
        if all(p.is_file() and p.name.startswith((INDEX_NAME, MASTER_NAME)) for p in left):
            for p in left:
                p.unlink()
            Path(folder).rmdir()
