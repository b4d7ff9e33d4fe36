"""Names of reports: file-system-safe segments, made unique, and the layout of the output folder."""

from __future__ import annotations

from pathlib import Path, PurePath

from ..sources.tables import COMPRESSED, FORMATS

#: Longest segment of a path, and names that some systems reserve (fixed values).
LONGEST = 80
RESERVED = {"con", "prn", "aux", "nul"} | {f"{d}{i}" for d in ("com", "lpt") for i in range(1, 10)}
#: Names used when nothing is left of a text, without a column, and for all columns joined (fixed values).
FALLBACK, NO_COLUMN, MERGED = "unnamed", "sequence", "merged"
TRIM = "-._"


def stem(path: str) -> str:
    """File name without the extensions of known formats; other dots are part of the name."""
    name = PurePath(path).name
    for suffix in COMPRESSED:
        if name.lower().endswith(suffix):
            name = name[: -len(suffix)]
    known = next((s for s in FORMATS if name.lower().endswith(s)), "")
    return name[: len(name) - len(known)]


#: Characters of a segment besides letters; a dash stands for every stretch of others.
PLAIN = frozenset("abcdefghijklmnopqrstuvwxyz0123456789._-")


def _cut(name: str, room: int = LONGEST) -> str:
    """The first ``room`` characters without marks at either end."""
    return name.strip(TRIM)[:room].strip(TRIM)


def slug(text: object, fallback: str = FALLBACK) -> str:
    """Lower case; every stretch of dashes and of other characters than ``PLAIN`` is one dash; no marks at the ends; at most ``LONGEST`` characters."""
    spaced = "".join(c if c in PLAIN and c != "-" else " " for c in str(text).strip().lower())
    name = _cut("-".join(f" {spaced} ".split()))
    return name if name and name not in RESERVED else fallback


def _numbered(base: str, number: int) -> str:
    tail = f"-{number}" if number > 1 else ""
    return _cut(base, LONGEST - len(tail)) + tail


def unique_slugs(texts: list, hints: list | None = None) -> list[str]:
    """One slug per text, all different. Slugs that are unique stay; others get their hint (as a parent folder) before them, then a number."""
    groups: dict[str, list[int]] = {}
    for place, text in enumerate(texts):
        groups.setdefault(slug(text), []).append(place)
    names = {places[0]: name for name, places in groups.items() if len(places) == 1}
    clashing = sorted((place, name) for name, places in groups.items() if len(places) > 1 for place in places)
    for place, name in clashing:
        parent = slug(hints[place], "") if hints and hints[place] is not None else ""
        base = _cut("-".join(filter(None, (parent, name))))
        held = set(names.values())
        names[place] = next(n for n in (_numbered(base, k) for k in range(1, len(texts) + 2)) if n not in held)
    return [names[place] for place in range(len(texts))]


def column_folders(columns: list[str]) -> list[str]:
    """Folders of the analyses of ``tables.column_sets``: one per column, and one for all joined if there are several."""
    return unique_slugs([*columns, MERGED]) if len(columns) > 1 else [slug(c) for c in columns] or [NO_COLUMN]


def comparison_folder(out: str | Path, command: str, column: str, slug_1: str | None = None, slug_2: str | None = None) -> Path:
    """``<out>/<class or split>/<column>[/<A>_vs_<B>]``."""
    folder = Path(out) / command / column
    return folder / f"{slug_1}_vs_{slug_2}" if slug_1 else folder
