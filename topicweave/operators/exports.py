"""Result tables as Markdown, CSV and LaTeX. A table has a row per model, so it is formatted on the driver."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import DataFrame

from .statistics import best_flags, summarise

NAMES = {"coherence_emb": "Coherence", "npmi": "NPMI", "diversity": "Diversity", "silhouette": "Silhouette", "separation": "Separation", "coverage": "Coverage", "nmi": "NMI", "ari": "ARI", "purity": "Purity", "n_topics_found": "Topics", "runtime_sec": "Runtime (s)"}


def _cells(long: DataFrame, metrics: Sequence[str]) -> tuple[list[str], dict[str, dict[str, tuple[float, float, bool]]], list[str]]:
    rows = best_flags(summarise(long)).collect()
    table: dict[str, dict] = {}
    for r in sorted(rows, key=lambda r: r["model"]):
        table.setdefault(r["model"], {})[r["metric"]] = (r["mean"], r["std"], r["is_best"])
    return list(table), table, [m for m in metrics if any(m in t for t in table.values())]


def markdown(long: DataFrame, metrics: Sequence[str]) -> str:
    models, table, used = _cells(long, metrics)
    if not models:
        return "(no results)"
    show = lambda c: "" if c is None else ("**{}**" if c[2] else "{}").format(f"{c[0]:.4f} ± {c[1]:.4f}")
    lines = ["| model | " + " | ".join(NAMES.get(m, m) for m in used) + " |", "|" + "---|" * (len(used) + 1)]
    return "\n".join(lines + ["| " + " | ".join([m, *(show(table[m].get(k)) for k in used)]) + " |" for m in models])


def csv_text(long: DataFrame, metrics: Sequence[str]) -> str:
    models, table, used = _cells(long, metrics)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["model", *(f"{m}_{part}" for m in used for part in ("mean", "std"))])
    for m in models:
        writer.writerow([m, *(v for k in used for v in (table[m].get(k) or ("", ""))[:2])])
    return out.getvalue()


def latex(long: DataFrame, metrics: Sequence[str], caption: str = "Topic models compared (mean and standard deviation)", label: str = "tab:topic-models") -> str:
    models, table, used = _cells(long, metrics)
    if not models:
        return "% (no results)"
    show = lambda c: "--" if c is None else ("\\textbf{{{}}}" if c[2] else "{}").format(f"{c[0]:.3f} $\\pm$ {c[1]:.3f}")
    safe = lambda s: s.replace("&", "\\&").replace("%", "\\%").replace("_", "\\_").replace("#", "\\#")
    body = [" & ".join([safe(m), *(show(table[m].get(k)) for k in used)]) + " \\\\" for m in models]
    head = " & ".join(["Model", *(safe(NAMES.get(m, m)) for m in used)]) + " \\\\"
    return "\n".join(["\\begin{table}[t]", "\\centering", f"\\caption{{{caption}}}", f"\\label{{{label}}}", f"\\begin{{tabular}}{{l{'c' * len(used)}}}", "\\toprule", head, "\\midrule", *body, "\\bottomrule", "\\end{tabular}", "\\end{table}"])
