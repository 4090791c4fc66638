"""Text reports from small results on the driver."""

from __future__ import annotations

import textwrap

LIMITS = {"files": 20, "symbols": 20, "partners": 8}


def _listed(rows: list[str], most: int) -> list[str]:
    more = [f"  … {len(rows) - most} more"] if len(rows) > most else []
    return [f"  {x}" for x in rows[:most]] + more or ["  none"]


def explain(found: dict) -> str:
    """A symbol's numbers in words."""
    lines = [
        found["qualified"],
        f"  {found['path']}, lines {found['span_start']} to {found['span_end']}; {found['kind']}, {found['loc']} lines",
        f"  hotspot     {found['hotspot']:.2f} ({found['heat']}), {found['churn']} commits",
        f"  complexity  {found['complexity']} ({found['complexity_note']})",
        f"  called from {found['fanin']} ({found['fanin_note']}); calls {found['fanout']} ({found['fanout_note']})",
    ]
    patterns = set(found["patterns"] or ())
    if patterns:
        lines.append(f"  patterns    {', '.join(sorted(patterns))}")
    warnings = (({"lock", "await"}, "a lock is held while waiting: deadlock"), ({"block_on"}, "blocks inside asynchronous code: starvation"), ({"spawn", "loop"}, "starts tasks in a loop: no bound on their number"))
    lines += [f"  ! {text}" for need, text in warnings if need <= patterns]
    if found["cochange"]:
        lines.append("  changes together with")
        for c in found["cochange"]:
            s = max(c["strength"], c["strength_rev"])
            often = "always" if s >= 0.8 else "often" if s >= 0.5 else "sometimes"
            lines.append(f"    {s * 100:3.0f}%  {c['partner']}  ({often})")
    return "\n".join([*lines, f"  risk        {found['risk']}"]) + "\n"


def pull_request(name: str, base: str, found: dict) -> str:
    flags = lambda r: ", ".join(x for x, on in (("hot", r["hotspot"] > 0.7), ("complex", r["complexity"] > 10), ("central", r["fanin"] > 8)) if on) or "-"
    lines = [f"{name} against {base}: {len(found['changed'])} files changed, {found['symbols']} symbols in them", "", "changed files", *_listed(found["changed"], LIMITS["files"])]
    lines += ["", f"symbols at high risk ({len(found['high_risk'])})", *_listed([f"{r['qualified']}  hotspot {r['hotspot']:.2f}, complexity {r['complexity']}, called from {r['fanin']}; {flags(r)}" for r in found["high_risk"]], LIMITS["symbols"])]
    lines += ["", f"files that usually change with these ({len(found['missed'])})", *_listed([f"{r['strength'] * 100:3.0f}%  {r['partner']}" for r in found["missed"]], LIMITS["partners"])]
    if found["patterns"]:
        lines += ["", "patterns in touched code", *(f"  {k:<12}{n} symbols" for k, n in sorted(found["patterns"].items(), key=lambda x: (-x[1], x[0])))]
    return "\n".join([*lines, "", f"risk: {found['verdict']}"]) + "\n"


def signals(rows: list[dict], width: int = 72) -> str:
    order = {"high": 0, "medium": 1, "info": 2}
    shown = (f"[{r['severity']}] {r['kind']}" + (f": {r['id']}" if r["id"] else "") for r in sorted(rows, key=lambda r: (order[r["severity"]], r["kind"], r["id"] or "")))
    return "".join(textwrap.fill(x, width, subsequent_indent="  ") + "\n" for x in shown)


def smells(rows: list[dict], most: int = 3) -> str:
    """Findings by section and kind, the first few of each."""
    groups: dict[tuple[str, str], list[str]] = {}
    for r in rows:
        groups.setdefault((r["section"], r["kind"]), []).append(f"{r['subject']}" + (f"  {r['detail']}" if r["detail"] else ""))
    return "".join("\n".join([f"{section}: {kind} ({len(found)})", *_listed(sorted(found), most)]) + "\n" for (section, kind), found in sorted(groups.items()))


def hotspots(rows: list[dict]) -> str:
    return "".join(f"{r['hotspot']:5.2f}  {r['heat']:<12}  {r['churn']:>6} commits  {r['age']:>8}  {r['path']}\n" for r in rows)


def coupled(rows: list[dict]) -> str:
    return "changes together with\n" + "\n".join(_listed([f"{r['strength']:.2f}  {r['support']:>5} commits  {r['partner']}" for r in rows], len(rows))) + "\n"


def age(rows: list[dict]) -> str:
    return "".join(f"{r['age_days']:>6} days  {r['path']}\n" for r in rows)


def overview(rows: list[dict]) -> str:
    return "".join(f"{r['weight']:5.2f}  {r['n_symbols']:>5} symbols  {r['path']}\n" for r in rows)
