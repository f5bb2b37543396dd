"""Small SVG charts from rows that were reduced on the cluster (at most a few thousand points)."""

from __future__ import annotations

from html import escape

WIDTH, HEIGHT, PAD = 900, 180, 56
#: Points that a chart takes; decimate before (operators.order.decimated).
MOST_POINTS = 2048


def _scaled(points: list[tuple[float, float]], top: float | None) -> list[tuple[float, float]]:
    right = max(1.0, max((x for x, _ in points), default=1.0))
    high = top or max(1.0, 1.08 * max((y for _, y in points), default=1.0))
    return [(PAD + (WIDTH - 2 * PAD) * min(max(x / right, 0), 1), HEIGHT - 30 - (HEIGHT - 60) * min(max(y / high, 0), 1)) for x, y in points]


def panel(title: str, series: dict[str, list[tuple[float, float]]], offset: int = 0, top: float | None = None) -> str:
    """One panel with a line for each series; series share the scale."""
    every = [p for s in series.values() for p in s]
    if len(every) > MOST_POINTS * max(1, len(series)):
        raise ValueError("too many points; decimate first")
    high = top or max(1.0, 1.08 * max((y for _, y in every), default=1.0))
    out = [f'<g transform="translate(0,{offset})"><text x="{PAD}" y="20">{escape(title)}</text>']
    out.append(f'<path d="M{PAD} {HEIGHT - 30}H{WIDTH - PAD}M{PAD} {HEIGHT - 30}V30" fill="none" stroke="#888"/>')
    for k, (name, points) in enumerate(sorted(series.items())):
        colour = f"hsl({k * 137 % 360},60%,40%)"
        path = " ".join(f"{x:.1f},{y:.1f}" for x, y in _scaled(sorted(points), high))
        out.append(f'<polyline points="{path}" fill="none" stroke="{colour}"/><text x="{PAD + 140 * k}" y="{HEIGHT - 8}" fill="{colour}">{escape(name)}</text>')
    return "".join(out) + "</g>"


def chart(panels: list[tuple[str, dict[str, list[tuple[float, float]]]]], title: str = "") -> str:
    body = "".join(panel(t, s, 40 + k * HEIGHT) for k, (t, s) in enumerate(panels))
    tall = 60 + len(panels) * HEIGHT
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {tall}" font-family="sans-serif" font-size="13"><text x="{PAD}" y="28" font-size="18">{escape(title)}</text>{body}</svg>'
