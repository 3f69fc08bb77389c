"""Small results as Markdown and SVG. A report takes aggregates, so a table of too many rows is refused."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

#: Rows that a report shows at most; more are an error, not a cut.
MOST_ROWS = 1000


def rows_of(df: DataFrame) -> list:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report takes {MOST_ROWS} rows at most; aggregate first")
    return rows


def _shown(value) -> str:
    return "" if value is None else f"{value:.4f}" if isinstance(value, float) else str(value)


def markdown(df: DataFrame, title: str = "") -> str:
    cell = lambda v: _shown(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", ""] if title else []
    lines += ["| " + " | ".join(map(cell, df.columns)) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows_of(df))]) + "\n"


def bars(df: DataFrame, label: str, value: str, title: str = "", width: int = 640) -> str:
    """A horizontal bar for each row, as long as its value beside the largest; nulls and negative values have none."""
    rows = [(_shown(r[label]), r[value]) for r in rows_of(df.select(label, value))]
    top = max((float(v) for _, v in rows if v is not None), default=0.0)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{40 + 24 * len(rows)}" font-family="sans-serif" font-size="13">', f'<text x="8" y="20" font-weight="bold">{escape(title)}</text>']
    for i, (name, v) in enumerate(rows):
        y, long_ = 36 + 24 * i, max(0.0, float(v or 0)) / top * (width - 300) if top > 0 else 0.0
        out.append(f'<text x="8" y="{y + 14}">{escape(name)}</text><rect x="200" y="{y}" width="{long_:.1f}" height="18" fill="#4878a8"/><text x="{206 + long_:.1f}" y="{y + 14}">{escape(_shown(v))}</text>')
    return "\n".join([*out, "</svg>"]) + "\n"
