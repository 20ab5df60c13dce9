"""Pictures as SVG, drawn from counts; the bytes depend on the counts alone."""

from __future__ import annotations

import hashlib
import os
import re
from html import escape

INK, BAR = "#333333", "#0072b2"


def safe_path(folder: str, name: str) -> str:
    """Path of a picture; a name that had to be changed or cut gets eight digits of its hash."""
    plain = re.sub(r"[^A-Za-z0-9_-]+", "_", name)[:80]
    if plain != name:
        plain = f"{plain}_{hashlib.sha256(name.encode()).hexdigest()[:8]}"
    return os.path.join(folder, f"{plain}.svg")


def cut(text: str, most: int = 22) -> str:
    return text if len(text) <= most else text[: most - 1] + "…"


def compact(value: float) -> str:
    """20000 as 20k, 1500000 as 1.5M; three digits at most."""
    for size, mark in ((1e9, "B"), (1e6, "M"), (1e3, "k")):
        if abs(value) >= size:
            return f"{value / size:.3g}{mark}"
    return f"{value:.3g}"


def _page(width: int, height: int, parts: list[str]) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="11" fill="{INK}">\n' + "\n".join(parts) + "\n</svg>\n"


def bars(title: str, values: list[tuple[str, int]]) -> str:
    """A horizontal bar for each label."""
    most = max((n for _, n in values), default=1) or 1
    parts = [f'<text x="8" y="18" font-size="13">{escape(cut(title, 60))}</text>']
    for i, (label, n) in enumerate(values):
        y = 30 + 16 * i
        parts.append(f'<text x="150" y="{y + 11}" text-anchor="end">{escape(cut(label))}</text><rect x="156" y="{y}" width="{400 * n / most:.1f}" height="12" fill="{BAR}"/><text x="{160 + 400 * n / most:.1f}" y="{y + 11}">{compact(n)}</text>')
    return _page(640, 40 + 16 * len(values), parts)


def heatmap(names: list[str], matrix: list[list[float | None]]) -> str:
    """Blue for positive, red for negative; numbers up to fifteen columns."""
    size, left = 34, 150
    parts = []
    for i, name in enumerate(names):
        parts.append(f'<text x="{left - 6}" y="{60 + size * i}" text-anchor="end">{escape(cut(name))}</text>')
        for j, r in enumerate(matrix[i]):
            tone = "#dddddd" if r is None else f"rgb({round(255 - 255 * max(0, r))},{round(255 - 140 * abs(r))},{round(255 - 255 * max(0, -r))})"
            parts.append(f'<rect x="{left + size * j}" y="{40 + size * i}" width="{size}" height="{size}" fill="{tone}"/>')
            if r is not None and len(names) <= 15:
                parts.append(f'<text x="{left + size * j + size / 2}" y="{60 + size * i}" text-anchor="middle">{r:.2f}</text>')
    return _page(left + size * len(names) + 10, 50 + size * len(names), parts)


def save(picture: str, path: str) -> str:
    if not path.endswith(".svg"):
        raise ValueError("pictures are written as .svg")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        f.write(picture)
    return path
