"""SK5: a trace as an SVG waveform, one picture for each trace."""

from __future__ import annotations

from html import escape

import pandas as pd
from pyspark.sql import DataFrame

ROW, STEP, LEFT = 24, 28, 110


def draw(names: list[str], values: dict[str, list[str]], fail: int | None) -> str:
    """Names from above to below and their values by cycle; one-bit values as levels, others as text."""
    cycles = max((len(v) for v in values.values()), default=0)
    out = []
    if fail is not None and 0 <= fail < cycles:
        out.append(f'<rect x="{LEFT + fail * STEP}" y="0" width="{STEP}" height="{ROW * len(names)}" fill="#fdd"/>')
    for k, name in enumerate(names):
        top, low = k * ROW + 5, k * ROW + ROW - 5
        out.append(f'<text x="4" y="{low}" font-size="11">{escape(name)}</text>')
        points = []
        for i, v in enumerate(values[name]):
            x = LEFT + i * STEP
            if v in ("0", "1"):
                y = top if v == "1" else low
                points.append(f"{x},{y} {x + STEP},{y}")
            else:
                out.append(f'<text x="{x + 2}" y="{low}" font-size="9">{escape(v)}</text>')
        if points:
            out.append(f'<polyline points="{" ".join(points)}" fill="none" stroke="black"/>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{LEFT + cycles * STEP}" height="{ROW * len(names)}">{"".join(out)}</svg>'


def waveforms(sampled: DataFrame, shown: DataFrame, anchors: DataFrame) -> DataFrame:
    """(trace_id, svg). sampled: (trace_id, cycle, sig, val), see ``trace.last_before_next_edge``; shown: (trace_id, sig,
    rank), see ``facts.signals_to_show``, a dozen a trace; anchors: (trace_id, anchor). A cycle without a value has "?"."""
    rows = sampled.join(shown, ["trace_id", "sig"]).join(anchors, "trace_id", "left")
    kind = sampled.schema["trace_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = pdf.sort_values("rank")["sig"].drop_duplicates().to_list()
        cycles = int(pdf["cycle"].max()) + 1
        values = {n: ["?"] * cycles for n in names}
        for sig, cycle, val in zip(pdf["sig"], pdf["cycle"], pdf["val"], strict=True):
            values[sig][int(cycle)] = str(val)
        fail = pdf["anchor"].iloc[0]
        return pd.DataFrame({"trace_id": [pdf["trace_id"].iloc[0]], "svg": [draw(names, values, None if pd.isna(fail) else int(fail))]})

    return rows.groupBy("trace_id").applyInPandas(run, f"trace_id {kind}, svg string")
