"""Figures as PDF, written without a plotting library: scatter plots and stacked line panels.

The frames are summaries (one row a target, the logs of a few runs); more than MOST points raise.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

MOST = 200_000
WIDTH, HEIGHT, MARGIN = 560, 320, 56
#: Colours of lines, and the ends of the scale for values (low, middle, high), as red, green, blue.
LINES = ((0.12, 0.47, 0.71), (1.0, 0.5, 0.05), (0.17, 0.63, 0.17), (0.84, 0.15, 0.16))
SCALE = ((0.27, 0.0, 0.33), (0.13, 0.57, 0.55), (0.99, 0.91, 0.14))


@dataclass
class Panel:
    title: str
    x: str
    y: str
    #: (x, y, colour or None for a ring, radius)
    points: list[tuple] = field(default_factory=list)
    #: (label, colour, [(x, y), ...])
    lines: list[tuple] = field(default_factory=list)
    #: (x, colour, dashes) of vertical marks
    marks: list[tuple] = field(default_factory=list)
    x_range: tuple[float, float] | None = None
    y_range: tuple[float, float] | None = None


def shade(share: float) -> tuple[float, float, float]:
    """A colour of the scale, 0 to 1."""
    low, high, t = (SCALE[0], SCALE[1], share * 2) if share < 0.5 else (SCALE[1], SCALE[2], share * 2 - 1)
    return tuple(a + (b - a) * t for a, b in zip(low, high, strict=True))


def extent(values: list[float]) -> tuple[float, float]:
    low, high = min(values, default=0.0), max(values, default=1.0)
    pad = (high - low or 1.0) * 0.05
    return low - pad, high + pad


def text(x: float, y: float, s: str, size: int = 9) -> str:
    safe = s.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)")
    return f"BT /F1 {size} Tf {x:.1f} {y:.1f} Td ({safe}) Tj ET"


def circle(x: float, y: float, r: float) -> str:
    k = 0.5523 * r
    return f"{x + r:.2f} {y:.2f} m {x + r:.2f} {y + k:.2f} {x + k:.2f} {y + r:.2f} {x:.2f} {y + r:.2f} c {x - k:.2f} {y + r:.2f} {x - r:.2f} {y + k:.2f} {x - r:.2f} {y:.2f} c {x - r:.2f} {y - k:.2f} {x - k:.2f} {y - r:.2f} {x:.2f} {y - r:.2f} c {x + k:.2f} {y - r:.2f} {x + r:.2f} {y - k:.2f} {x + r:.2f} {y:.2f} c"


def draw(p: Panel, bottom: float) -> str:
    xs = [q[0] for q in p.points] + [q[0] for _, _, line in p.lines for q in line]
    ys = [q[1] for q in p.points] + [q[1] for _, _, line in p.lines for q in line]
    (x0, x1), (y0, y1) = p.x_range or extent(xs), p.y_range or extent(ys)
    wide, high = WIDTH - 2 * MARGIN, HEIGHT - 2 * MARGIN
    at = lambda x, y: (MARGIN + (x - x0) / (x1 - x0) * wide, bottom + MARGIN + (y - y0) / (y1 - y0) * high)
    out = [f"0 0 0 RG 0 0 0 rg 0.5 w {MARGIN} {bottom + MARGIN} {wide} {high} re S", text(MARGIN, bottom + HEIGHT - MARGIN + 10, p.title, 12), text(MARGIN + wide / 2 - 20, bottom + 18, p.x), text(8, bottom + HEIGHT - MARGIN + 10, p.y)]
    for i in range(5):
        x, y = x0 + (x1 - x0) * i / 4, y0 + (y1 - y0) * i / 4
        out += [text(at(x, y0)[0] - 8, bottom + MARGIN - 12, f"{x:.3g}", 7), text(MARGIN - 34, at(x0, y)[1] - 3, f"{y:.3g}", 7)]
    out.append(f"q {MARGIN} {bottom + MARGIN} {wide} {high} re W n")
    for x, colour, dashes in p.marks:
        a, b = at(x, y0), at(x, y1)
        out.append(f"{' '.join(map(str, colour))} RG [{dashes}] 0 d 1.5 w {a[0]:.1f} {a[1]:.1f} m {b[0]:.1f} {b[1]:.1f} l S [] 0 d")
    for _, colour, line in p.lines:
        if line:
            out.append(f"{' '.join(map(str, colour))} RG 1 w " + " ".join(f"{at(x, y)[0]:.1f} {at(x, y)[1]:.1f} {'l' if i else 'm'}" for i, (x, y) in enumerate(line)) + " S")
    for x, y, colour, r in p.points:
        out.append("0 0 0 RG 0.5 w " + (f"{' '.join(f'{c:.2f}' for c in colour)} rg " if colour else "") + circle(*at(x, y), r) + (" B" if colour else " S"))
    out.append("Q 0 0 0 rg")
    for i, (label, colour, _) in enumerate(p.lines):
        y = bottom + HEIGHT - MARGIN - 14 - 11 * i
        out += [f"{' '.join(map(str, colour))} RG 2 w {WIDTH - MARGIN - 120} {y + 3} m {WIDTH - MARGIN - 104} {y + 3} l S", text(WIDTH - MARGIN - 100, y, label, 8)]
    return "\n".join(out)


def pdf(panels: list[Panel]) -> bytes:
    """One page with the panels from top to bottom."""
    body = "\n".join(draw(p, HEIGHT * (len(panels) - 1 - i)) for i, p in enumerate(panels)).encode("latin-1", "replace")
    parts = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {WIDTH} {HEIGHT * max(1, len(panels))}] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>".encode(),
        b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
    ]
    out, places = b"%PDF-1.4\n", []
    for i, part in enumerate(parts, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, part)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(parts) + 1, table, len(parts) + 1, len(out))


def rows_of(df: DataFrame) -> list:
    rows = df.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} points: summarise first")
    return rows


def scatter(df: DataFrame, x: str, y: str, colour: str, detected: str | None = None, title: str = "") -> bytes:
    """Points coloured and sized by a value. With ``detected``, rows where it is false are small rings behind, and a missing value of the others is 0; without, rows that lack the value are left out."""
    rows = [r for r in rows_of(df.filter(f"`{x}` is not null and `{y}` is not null")) if detected or r[colour] is not None]
    front = [r for r in rows if not detected or r[detected]]
    value = [float(r[colour] or 0) for r in front]
    low, high = min(value, default=0.0), max(value, default=0.0)
    share = [(v - low) / (high - low) if high > low else 0.5 for v in value]
    rings = [(float(r[x]), float(r[y]), None, 2.5) for r in rows if detected and not r[detected]]
    label = lambda c: c.replace("_", " ").title() + (" (nm2)" if "sasa" in c else "")
    points = rings + [(float(r[x]), float(r[y]), shade(s), 3 + 5 * s) for r, s in zip(front, share, strict=True)]
    return pdf([Panel(title or f"{label(y)} by {label(x)}, {label(colour)}", label(x), label(y), points)])


def curves(logs: DataFrame, chosen: DataFrame, least: int = 0, values: tuple[str, ...] = ("train_accuracy", "validation_accuracy"), run: str = "run") -> bytes:
    """A panel for each row (label, run, mem, event) of chosen: its run's curves, with marks at both epochs where they are not -1. All share the x range."""
    wanted = rows_of(chosen)
    rows = rows_of(logs.join(chosen.select(run).distinct(), run, "left_semi").select(run, "epoch", *values).orderBy(run, "epoch"))
    far = max([least, *(r["epoch"] for r in rows)])
    panels = []
    for w in wanted:
        own = [r for r in rows if r[run] == w[run]]
        lines = [(v.replace("_", " ").title(), LINES[i % len(LINES)], [(float(r["epoch"]), float(r[v])) for r in own if r[v] is not None]) for i, v in enumerate(values)]
        marks = [(float(w[c]), colour, dashes) for c, colour, dashes in (("mem", (0.5, 0, 0.5), "2 2"), ("event", (0, 0.5, 0), "6 3")) if w[c] is not None and w[c] != -1]
        panels.append(Panel(w["label"] if own else f"{w['label']}: no log of {w[run]}", "Epoch", "Accuracy", [], lines, marks, (-0.02 * far, 1.05 * far or 1.0), (0.4, 1.05)))
    return pdf(panels)


def write_bytes(spark: SparkSession, content: bytes, path: str) -> None:
    """One file, through the file system of the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
