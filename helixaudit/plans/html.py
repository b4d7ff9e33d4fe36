"""Rendering of reports on the driver, from rows that are already small."""

from __future__ import annotations

import html
import json

STYLE = "body{font-family:sans-serif;margin:2em;max-width:70em}table{border-collapse:collapse}td,th{padding:.2em .8em;border-bottom:1px solid #ddd;text-align:left}.Fail{color:#b00020}.Warning{color:#a66300}.Pass{color:#1b6e2a}.Unknown{color:#666}pre{background:#f6f6f6;padding:.6em;overflow:auto}"


def escaped(value: object) -> str:
    """Text safe in HTML and in templates that fill braces."""
    return html.escape(str(value)).replace("{", "&#123;").replace("}", "&#125;")


def payload(value: object) -> str:
    """JSON that can stand in a script element."""
    text = json.dumps(value, separators=(",", ":"), sort_keys=True)
    for c in "<>&":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


def number(value: float | None) -> str:
    return "" if value is None else f"{value:.3f}"


def table(header: list[str], rows: list[list[object]], flag_at: int | None = None) -> str:
    head = "".join(f"<th>{escaped(h)}</th>" for h in header)
    body = "".join("<tr>" + "".join(f'<td class="{escaped(c)}">{escaped(c)}</td>' if i == flag_at else f"<td>{escaped(c)}</td>" for i, c in enumerate(r)) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def page(title: str, sections: list[tuple[str, str]]) -> str:
    """A standalone page: a title, links to the sections, and the sections (title, HTML)."""
    links = " &middot; ".join(f'<a href="#s{i}">{escaped(t)}</a>' for i, (t, _) in enumerate(sections))
    body = "".join(f'<h2 id="s{i}">{escaped(t)}</h2>{b}' for i, (t, b) in enumerate(sections))
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{escaped(title)}</title><style>{STYLE}</style></head><body><h1>{escaped(title)}</h1><p>{links}</p>{body}</body></html>'


def midline(top: str, low: str) -> str:
    """``|`` under equal letters, ``.`` under different ones, a blank under gaps."""
    return "".join(" " if "-" in (a, b) else "|" if a == b else "." for a, b in zip(top, low))


def checked_alignment(hit: dict, query: str, target: str) -> None:
    """Raise unless the ungapped rows of a hit are the stretches its coordinates name; descending ones are not checked."""
    for side, row, text in (("q", hit["qaln"], query), ("t", hit["taln"], target)):
        first, last = hit[f"{side}start"], hit[f"{side}end"]
        if first <= last and text[first - 1 : last] != row.replace("-", ""):
            raise ValueError(f"alignment of {hit['query']} and {hit['target']} does not fit its coordinates")
    if len(hit["qaln"]) != len(hit["taln"]):
        raise ValueError(f"alignment of {hit['query']} and {hit['target']} has rows of different length")


def alignment(hit: dict, width: int = 80) -> str:
    """Text of one alignment, wrapped, with coordinates of both rows."""
    top, low = hit["qaln"], hit["taln"]
    mid = midline(top, low)
    q, t = hit["qstart"], hit["tstart"]
    step_q, step_t = (1 if hit[f"{s}start"] <= hit[f"{s}end"] else -1 for s in "qt")
    out = []
    for at in range(0, len(top), width):
        a, b = top[at : at + width], low[at : at + width]
        out += [f"query  {q:>8} {a}", f"{'':15} {mid[at : at + width]}", f"target {t:>8} {b}", ""]
        q += step_q * (len(a) - a.count("-"))
        t += step_t * (len(b) - b.count("-"))
    return "\n".join(out)


def bars(rows: list[tuple[str, int]]) -> str:
    """A plain histogram of (name, count)."""
    most = max([n for _, n in rows], default=0) or 1
    lines = "".join(f'<tr><td>{escaped(k)}</td><td><svg width="320" height="12"><rect width="{320 * n / most:.1f}" height="12" fill="#4a7ab5"/></svg></td><td>{n:,}</td></tr>' for k, n in rows)
    return f"<table>{lines}</table>"
