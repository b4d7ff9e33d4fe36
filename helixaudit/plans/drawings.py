"""SVG drawings for reports, from rows of :mod:`distribution` and the position payload; no plotting library."""

from __future__ import annotations

from .html import escaped

#: Kinds of drawings of distributions (fixed values): nested boxes of letter values, or mirrored histograms.
KINDS = ("boxen", "violin")
COLOURS = ("#3366aa", "#cc7722", "#2d8f5a", "#aa3355", "#7755aa", "#888833", "#33889a", "#555555")
#: Fill behind what came out as a warning or a failure.
SHADES = {"Warning": "#fff0cc", "Fail": "#fbd5d5"}
WIDE, HIGH, MARGIN = 64, 180, 22


def _svg(width: float, height: float, body: str, title: str) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" role="img" width="{width:.0f}" height="{height:.0f}" font-size="10" font-family="sans-serif"><title>{escaped(title)}</title>{body}</svg>'


def _text(x: float, y: float, value: object, anchor: str = "middle") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}">{escaped(value)}</text>'


def boxes(centre: float, letters: list[float], low: float, high: float, place, colour: str) -> str:
    """Letter values as nested boxes, the widest from quarter to quarter, with the median and the whole range."""
    out = [f'<line x1="{centre:.1f}" x2="{centre:.1f}" y1="{place(low):.1f}" y2="{place(high):.1f}" stroke="{colour}"/>']
    for depth, (a, b) in enumerate(zip(letters[1::2], letters[2::2])):
        half = 12 / (1 + 0.6 * depth)
        out.append(f'<rect x="{centre - half:.1f}" width="{2 * half:.1f}" y="{place(b):.1f}" height="{max(place(a) - place(b), 0.5):.1f}" fill="{colour}" fill-opacity="0.35"/>')
    out.append(f'<line x1="{centre - 12:.1f}" x2="{centre + 12:.1f}" y1="{place(letters[0]):.1f}" y2="{place(letters[0]):.1f}" stroke="#000"/>')
    return "".join(out)


def violin(centre: float, cells: dict[int, int], number: int, low: float, high: float, place, colour: str) -> str:
    """A histogram of ``number`` cells from ``low`` to ``high``, mirrored."""
    most = max(cells.values(), default=0) or 1
    step = (high - low) / number
    out = []
    for cell, n in sorted(cells.items()):
        half, top = 13 * n / most, place(low + (cell + 1) * step)
        out.append(f'<rect x="{centre - half:.1f}" width="{2 * half:.1f}" y="{top:.1f}" height="{max(place(low + cell * step) - top, 0.5):.1f}" fill="{colour}" fill-opacity="0.6"/>')
    return "".join(out)


def spread_of_features(features: list[str], classes: tuple[str, str], values: dict, cells: dict, number: int, kind: str, flags: dict[str, str], title: str) -> str:
    """Both classes side by side for every feature of a check, on one scale.

    ``values`` maps (class, feature) to (low, high, letters), ``cells`` to its counts by cell; flagged features are shaded.
    """
    known = [values[k] for k in ((c, f) for c in classes for f in features) if k in values]
    if not known:
        return ""
    low, high = min(v[0] for v in known), max(v[1] for v in known)
    span = (high - low) or 1.0
    place = lambda v: MARGIN + (HIGH - 2 * MARGIN) * (1 - (v - low) / span)
    out = [_text(38, place(high) + 3, f"{high:.3g}", "end"), _text(38, place(low) + 3, f"{low:.3g}", "end")]
    for i, feature in enumerate(features):
        left = 44 + i * WIDE
        if flags.get(feature) in SHADES:
            out.append(f'<rect x="{left}" y="{MARGIN - 8}" width="{WIDE - 4}" height="{HIGH - 2 * MARGIN + 16}" fill="{SHADES[flags[feature]]}"/>')
        for k, name in enumerate(classes):
            if (name, feature) in values:
                centre = left + 15 + 30 * k
                own = values[name, feature]
                # Cells span what all classes of a feature do together.
                ends = [values[c, feature] for c in {c for c, f in values if f == feature}]
                a, b = min(v[0] for v in ends), max(v[1] for v in ends)
                out.append(boxes(centre, own[2], own[0], own[1], place, COLOURS[k]) if kind == "boxen" else violin(centre, cells.get((name, feature), {}), number, a, b, place, COLOURS[k]))
        out.append(_text(left + 30, HIGH - 6, feature or "all"))
    legend = "".join(f'<span style="color:{COLOURS[k]}">&#9632;</span> {escaped(c)} ' for k, c in enumerate(classes))
    return f'<div style="overflow:auto">{_svg(48 + WIDE * len(features), HIGH, "".join(out), title)}</div><p>{legend}</p>'


def shares_by_position(lines: dict[str, list[float]], flags: dict[tuple[str, int], str], title: str, width: int = 640) -> str:
    """One line per base: the share of sequences that have it at each position; positions with a flagged base are shaded.

    Long windows are drawn by the mean of as many positions as fall on one point.
    """
    n = max(map(len, lines.values()), default=0)
    if not n:
        return ""
    group = -(-n // width)
    points = -(-n // group)
    x = lambda i: 40 + (width - 50) * (i + 0.5) / points
    y = lambda v: MARGIN + (HIGH - 2 * MARGIN) * (1 - v)
    out = [_text(36, y(1) + 3, "1", "end"), _text(36, y(0) + 3, "0", "end"), _text(x(0), HIGH - 6, 1), _text(x(points - 1), HIGH - 6, n, "end")]
    worst: dict[int, str] = {}
    for (_, pos), flag in flags.items():
        if flag in SHADES and pos <= n:
            at = (pos - 1) // group
            worst[at] = "Fail" if "Fail" in (flag, worst.get(at)) else flag
    step = (width - 50) / points
    out += [f'<rect x="{x(i) - step / 2:.1f}" width="{step:.2f}" y="{y(1):.1f}" height="{y(0) - y(1):.1f}" fill="{SHADES[flag]}"/>' for i, flag in sorted(worst.items())]
    for k, (base, shares) in enumerate(sorted(lines.items())):
        means = [sum(part) / len(part) for part in (shares[i : i + group] for i in range(0, len(shares), group))]
        path = " ".join(f"{x(i):.1f},{y(v):.1f}" for i, v in enumerate(means))
        out.append(f'<polyline points="{path}" fill="none" stroke="{COLOURS[k % len(COLOURS)]}"/>')
    legend = "".join(f'<span style="color:{COLOURS[k % len(COLOURS)]}">&#9632;</span> {escaped(b)} ' for k, b in enumerate(sorted(lines)))
    return f"<p>{escaped(title)} {legend}</p>{_svg(width, HIGH, ''.join(out), title)}"
