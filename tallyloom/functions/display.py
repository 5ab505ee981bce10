"""How numbers are shown."""

from __future__ import annotations


def span(ms: int | None) -> str:
    """2h 05m, 12m, 40s, or a dash."""
    if ms is None:
        return "—"
    seconds = ms // 1000
    if seconds < 60:
        return f"{seconds}s"
    hours, minutes = divmod(seconds // 60, 60)
    return f"{hours}h {minutes:02d}m" if hours else f"{minutes}m"


def percent(x: float | None) -> str:
    return "—" if x is None else f"{100 * x:.0f}%"


def ratio(x: float | None) -> str:
    return "—" if x is None else f"{x:.1f}"


def dollars(x: float | None) -> str:
    return "—" if x is None else f"${x:,.2f}"


def tokens(n: int | None) -> str:
    if n is None:
        return "—"
    for size, unit in ((10**9, "B"), (10**6, "M"), (10**3, "k")):
        if n >= size:
            return f"{n / size:.1f}{unit}"
    return str(n)


def size(n: int | None) -> str:
    if n is None:
        return "—"
    x = float(n)
    for unit in ("B", "KiB", "MiB", "GiB"):
        if x < 1024 or unit == "GiB":
            return f"{x:.0f} {unit}" if unit == "B" else f"{x:.1f} {unit}"
        x /= 1024
    return "—"


def arrow(now: float | None, before: float | None, show=percent) -> str:
    """Up, down or flat; flat if the difference would be shown as none."""
    if now is None or before is None:
        return ""
    if show(abs(now - before)) == show(0):
        return "→"
    return "↑" if now > before else "↓"


def logged(text: str, most: int = 120) -> str:
    """Control characters escaped, cut to `most` characters."""
    shown = "".join(c if c.isprintable() else c.encode("unicode_escape").decode() for c in text)
    return shown if len(shown) <= most else shown[:most] + "…"
