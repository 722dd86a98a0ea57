"""Small results as Markdown and SVG. Everything here works on rows that are on the driver already."""

from __future__ import annotations

import math
from html import escape


def number(value: object, places: int = 4) -> str:
    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return "n/a"
    if isinstance(value, bool):
        return "yes" if value else "no"
    return f"{value:,}" if isinstance(value, int) else f"{value:,.{places}f}" if isinstance(value, float) else str(value)


def percent(value: float | None, places: int = 2) -> str:
    return "n/a" if value is None or not math.isfinite(value) else f"{100 * value:.{places}f} %"


def table(rows: list[dict], columns: list[str] | None = None, places: int = 4) -> str:
    """A Markdown table; numbers to the right."""
    if not rows:
        return "(no rows)\n"
    columns = columns or [*rows[0]]
    right = [all(isinstance(r[c], (int, float)) or r[c] is None for r in rows) for c in columns]
    lines = ["| " + " | ".join(columns) + " |", "|" + "|".join("--:" if x else "---" for x in right) + "|"]
    return "\n".join(lines + ["| " + " | ".join(number(r[c], places).replace("|", "\\|") for c in columns) + " |" for r in rows]) + "\n"


def report(title: str, sections: list[tuple[str, str, list[dict]]]) -> str:
    """A document of (heading, text, rows)."""
    return "\n".join([f"# {title}", ""] + [x for heading, text, rows in sections for x in (f"## {heading}", "", text, "", table(rows) if rows else "")])


def ticks(low: float, high: float, most: int = 6) -> list[float]:
    """Round numbers that cover a range: 1, 2 or 5 times a power of ten apart."""
    if high <= low:
        return [low]
    raw = (high - low) / most
    power = 10 ** math.floor(math.log10(raw))
    step = next(m * power for m in (1, 2, 5, 10) if m * power >= raw)
    first = math.ceil(low / step - 1e-9)
    return [round(k * step, 12) for k in range(first, int(math.floor(high / step + 1e-9)) + 1)]


class Figure:
    """One plot of marks over two axes; either axis may be logarithmic."""

    def __init__(self, title: str, x_label: str = "", y_label: str = "", width: int = 640, height: int = 400, log_x: bool = False, log_y: bool = False):
        self.title, self.x_label, self.y_label, self.width, self.height = title, x_label, y_label, width, height
        self.log_x, self.log_y, self.marks = log_x, log_y, []

    def bars(self, labels: list[str], values: list[float], color: str = "#4878a8") -> Figure:
        self.marks.append(("bars", [*range(len(values))], values, color, labels))
        return self

    def line(self, xs: list[float], ys: list[float], color: str = "#4878a8", name: str = "") -> Figure:
        self.marks.append(("line", xs, ys, color, name))
        return self

    def scatter(self, xs: list[float], ys: list[float], color: str = "#4878a8") -> Figure:
        self.marks.append(("dots", xs, ys, color, ""))
        return self

    def diagonal(self, color: str = "#999999") -> Figure:
        self.marks.append(("diagonal", [], [], color, ""))
        return self

    def note(self, x: float, y: float, text: str) -> Figure:
        self.marks.append(("note", [x], [y], "#333333", text))
        return self

    def svg(self) -> str:
        fit = lambda v, log: math.log10(v) if log else v
        usable = lambda v, log: v is not None and math.isfinite(v) and (v > 0 or not log)
        xs = [fit(x, self.log_x) for k, x_, *_ in self.marks for x in x_ if usable(x, self.log_x)] or [0, 1]
        ys = [fit(y, self.log_y) for k, _, y_, *_ in self.marks for y in y_ if usable(y, self.log_y)] or [0, 1]
        bars = any(m[0] == "bars" for m in self.marks)
        x0, x1 = (min(xs) - 0.5, max(xs) + 0.5) if bars else (min(xs), max(xs))
        y0, y1 = (min(0, *ys, 0) if bars and not self.log_y else min(ys)), max(ys)
        x1, y1 = x1 + (x1 == x0), y1 + (y1 == y0)
        left, right, top, bottom = 64, 16, 36, 52
        px = lambda x: left + (x - x0) / (x1 - x0) * (self.width - left - right)
        py = lambda y: self.height - bottom - (y - y0) / (y1 - y0) * (self.height - top - bottom)
        out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{self.width}" height="{self.height}" font-family="sans-serif" font-size="11">', f'<text x="{left}" y="20" font-size="14">{escape(self.title)}</text>']
        shown = lambda t, log: f"{10**t:g}" if log else f"{t:g}"
        for t in ticks(y0, y1):
            out.append(f'<line x1="{left}" x2="{self.width - right}" y1="{py(t):.1f}" y2="{py(t):.1f}" stroke="#e4e4e4"/><text x="{left - 6}" y="{py(t) + 4:.1f}" text-anchor="end">{shown(t, self.log_y)}</text>')
        for t in [] if bars else ticks(x0, x1):
            out.append(f'<text x="{px(t):.1f}" y="{self.height - bottom + 16}" text-anchor="middle">{shown(t, self.log_x)}</text>')
        for kind, mx, my, color, extra in self.marks:
            points = [(px(fit(x, self.log_x)), py(fit(y, self.log_y)), i) for i, (x, y) in enumerate(zip(mx, my, strict=True)) if usable(x, self.log_x) and usable(y, self.log_y)]
            if kind == "bars":
                wide = 0.8 * (px(1) - px(0))
                for x, y, i in points:
                    out.append(f'<rect x="{x - wide / 2:.1f}" y="{min(y, py(y0)):.1f}" width="{wide:.1f}" height="{abs(py(y0) - y):.1f}" fill="{color}"/><text x="{x:.1f}" y="{self.height - bottom + 16}" text-anchor="middle">{escape(str(extra[i]))}</text>')
            elif kind == "line":
                out.append(f'<polyline fill="none" stroke="{color}" stroke-width="2" points="{" ".join(f"{x:.1f},{y:.1f}" for x, y, _ in points)}"/>')
            elif kind == "dots":
                out += [f'<circle cx="{x:.1f}" cy="{y:.1f}" r="2.5" fill="{color}" fill-opacity="0.6"/>' for x, y, _ in points]
            elif kind == "diagonal":
                a, b = max(x0, y0), min(x1, y1)
                out.append(f'<line x1="{px(a):.1f}" y1="{py(a):.1f}" x2="{px(b):.1f}" y2="{py(b):.1f}" stroke="{color}" stroke-dasharray="4 3"/>')
            else:
                out += [f'<text x="{x + 4:.1f}" y="{y - 4:.1f}" fill="{color}">{escape(extra)}</text>' for x, y, _ in points]
        out.append(f'<text x="{(left + self.width - right) / 2:.0f}" y="{self.height - 12}" text-anchor="middle">{escape(self.x_label)}</text><text transform="translate(14 {(self.height - bottom + top) / 2:.0f}) rotate(-90)" text-anchor="middle">{escape(self.y_label)}</text></svg>')
        return "\n".join(out)
