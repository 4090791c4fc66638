"""Trees, folded stacks, JSON, HTML, Mermaid and DOT from small results on the driver."""

from __future__ import annotations

import html
import json
import math
from collections.abc import Iterable
from dataclasses import dataclass, field

COLORS = {"+": "32", "-": "31", "~": "33"}
SCHEMA = 1


@dataclass
class Node:
    id: str
    name: str
    qualified: str = ""
    file: str = ""
    span: tuple[int, int] = (0, 0)
    confidence: float = 1.0
    weight: float = 0.0
    mark: str | None = None
    external: bool = False
    children: list[Node] = field(default_factory=list)

    def as_dict(self) -> dict:
        return {"id": self.id, "name": self.name, "qualified": self.qualified, "file": self.file, "span": list(self.span), "confidence": self.confidence, "weight": self.weight, "mark": self.mark, "external": self.external, "children": [c.as_dict() for c in self.children]}

    def chain(self) -> list[Node]:
        """First children all the way down."""
        out = [self]
        while out[-1].children:
            out.append(out[-1].children[0])
        return out


def from_rows(rows: Iterable) -> Node:
    """The tree of rows in preorder (number, parent_number, id, confidence, and what is known of symbols); ids without a name are outside of the index."""
    nodes: dict[int, Node] = {}
    for r in rows:
        info, name = r.asDict(), r["id"].removeprefix("external:")
        if info["name"] is None:
            node = Node(r["id"], name, name, confidence=r["confidence"], external=True)
        else:
            node = Node(r["id"], info["name"], info["qualified"], info["path"], (info["span_start"], info["span_end"]), r["confidence"], info.get("weight") or 0.0)
        nodes[r["number"]] = node
        if r["parent_number"] is not None:
            nodes[r["parent_number"]].children.append(node)
    return nodes[0]


def bar(weight: float) -> str:
    full = min(math.floor(weight * 6 + 0.5), 6)
    return "█" * full + " " * (6 - full) + f" {weight:.2f}"


def tree(roots: Iterable[Node], color: bool = False, collapse: int | None = None) -> str:
    lines: list[str] = []

    def show(node: Node, lead: str, joint: str, level: int) -> None:
        mark = ""
        if node.mark in COLORS:
            mark = f"\x1b[{COLORS[node.mark]}m{node.mark}\x1b[0m " if color else f"{node.mark} "
        note = " (ext)" if node.external else f" ┄┄ {node.confidence:.1f}" if node.confidence < 0.7 else ""
        lines.append(f"{lead}{joint}{mark}{node.name}{note}" + (f"  {bar(node.weight)}" if node.weight > 0 else ""))
        below = lead + ("│  " if joint == "├─ " else "   ")
        if node.children and collapse is not None and level + 1 >= collapse:
            lines.append(f"{below}└─ ▸ ({len(node.children)} more)")
            return
        for i, child in enumerate(node.children):
            show(child, below, "└─ " if i == len(node.children) - 1 else "├─ ", level + 1)

    for root in roots:
        show(root, "", "", 0)
    return "".join(x + "\n" for x in lines)


def file_list(rows: list[tuple[str, float]], weighted: bool = True) -> str:
    return "".join(("└─ " if i == len(rows) - 1 else "├─ ") + path + (f"  {bar(w)}" if weighted else "") + "\n" for i, (path, w) in enumerate(rows))


def folded(roots: Iterable[Node]) -> str:
    """One line for each way from a root to a leaf, with the leaf's weight in thousandths, at least 1."""

    def walk(node: Node, above: tuple[str, ...]) -> Iterable[str]:
        here = (*above, node.name)
        if not node.children:
            yield f"{';'.join(here)} {max(math.floor(node.weight * 1000 + 0.5), 1)}\n"
        for child in node.children:
            yield from walk(child, here)

    return "".join(line for root in roots for line in walk(root, ()))


def to_json(command: str, target: str, depth: int, weight: str, roots: list[Node], cochange: list[dict], truncated: int = 0, unresolved: int = 0) -> str:
    partners = [{"file": c["partner"], "strength": max(c["strength"], c["strength_rev"]), "support": c["support"]} for c in cochange]
    return json.dumps({"tool": "loomgraph", "schema": SCHEMA, "query": {"cmd": command, "target": target, "depth": depth, "weight": weight}, "unresolved_edges": unresolved, "root": roots[0].as_dict() if len(roots) == 1 else [r.as_dict() for r in roots], "cochange": partners, "truncated": {"depth": truncated > 0, "nodes_omitted": truncated}, "unresolved": []}, indent=2, ensure_ascii=False)


def page(title: str, roots: Iterable[Node]) -> str:
    def item(node: Node) -> str:
        style = ' style="opacity:.6"' if node.confidence < 0.7 else ""
        text = f"{html.escape(node.name)} <small>{html.escape(node.file)}</small>" + (f'<i style="width:{round(node.weight * 80)}px"></i>' if node.weight > 0 else "")
        if not node.children:
            return f"<li{style}>{text}</li>"
        return f"<li{style}><details open><summary>{text}</summary><ul>{''.join(map(item, node.children))}</ul></details></li>"

    css = "body{font-family:monospace}i{display:inline-block;height:8px;background:#c33;margin-left:6px}ul{list-style:none}"
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><style>{css}</style><h1>{html.escape(title)}</h1><ul>{''.join(map(item, roots))}</ul>\n"


# ---------------------------------------------------------------- diagrams


def _id(prefix: str, text: str, size: int) -> str:
    return prefix + "".join(c if c.isalnum() or c == "_" else "_" for c in text)[:size]


def _fenced(kind: str, lines: list[str], fence: bool) -> str:
    body = "".join(x + "\n" for x in lines)
    return f"```{kind}\n{body}```\n" if fence else body


def _percent(confidence: float) -> str:
    return f"{confidence * 100:.0f}%"


def mermaid_sequence(root: Node, fence: bool = True) -> str:
    chain = root.chain()
    ids = [_id("P", n.id, 24) for n in chain]
    lines = ["sequenceDiagram", *(f"    participant {i} as {n.name}" for i, n in zip(ids, chain, strict=True))]
    for a, b, n in zip(ids, ids[1:], chain[1:], strict=False):
        lines.append(f"    {a}->>+{b}: calls" + (f" [{_percent(n.confidence)}]" if n.confidence < 1 else ""))
    return _fenced("mermaid", lines, fence)


def mermaid_flowchart(roots: Iterable[Node], direction: str = "TD", fence: bool = True) -> str:
    lines, arrows = [f"flowchart {direction}"], []

    def walk(node: Node, level: int) -> None:
        pad, me = "    " * (level + 1), _id("N", node.id, 30)
        label = node.name + (f"\\nw={node.weight:.2f}" if node.weight > 0 else "")
        lines.append(f"{pad}{me}(({label}));" if node.external else f'{pad}{me}["{label}"];')
        arrows.extend(f"{pad}{me}-->{_id('N', c.id, 30)}" for c in node.children)
        for c in node.children:
            walk(c, level + 1)

    for root in roots:
        walk(root, 0)
    return _fenced("mermaid", lines + arrows, fence)


def mermaid_dependency(target: str, partners: list[dict], fence: bool = True) -> str:
    me = _id("T", target, 30)
    lines = ["flowchart LR", f'    {me}["{target}"]:::target']
    for c in partners:
        other = _id("P", c["partner"], 30)
        lines += [f'    {other}["{c["partner"]}"]', f'    {me} <-->|"{c["strength"]:.2f} ({c["support"]} commits)"| {other}']
    return _fenced("mermaid", [*lines, "    classDef target fill:#cde,stroke:#468"], fence)


def _by_file(findings: Iterable[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    out: dict[str, list[str]] = {}
    for path, kind in findings:
        out.setdefault(path, []).append(kind)
    return sorted(out.items())


def mermaid_class(findings: Iterable[tuple[str, str]], fence: bool = True, most: int = 6) -> str:
    lines = ["classDiagram"]
    for path, kinds in _by_file(findings):
        more = [f"        +…{len(kinds) - most} more"] if len(kinds) > most else []
        lines += [f"    class {_id('C', path, 28)} {{", f"        <<{path}>> ", *(f"        +{k}" for k in kinds[:most]), *more, "    }"]
    return _fenced("mermaid", lines, fence)


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _dot(name: str, body: list[str], fence: bool) -> str:
    return _fenced("dot", [f"digraph {name} {{", "    rankdir=LR;", "    node [shape=box fontname=monospace];", *(f"    {x}" for x in body), "}"], fence)


def _dot_node(node: Node) -> str:
    heat = f' fillcolor="/reds/9/{max(math.ceil(node.weight * 8), 1)}" style=filled' if node.weight > 0 else ""
    heat += " style=dashed" if node.external else ""
    name = _quoted(node.qualified or node.name)
    return f"{name} [label={name}{heat}];"


def _dot_arrow(a: Node, b: Node) -> str:
    note = f' [label="{_percent(b.confidence)}"' + (" style=dashed]" if b.external else "]") if b.confidence < 1 else ""
    return f"{_quoted(a.qualified or a.name)} -> {_quoted(b.qualified or b.name)}{note};"


def dot_sequence(root: Node, fence: bool = True) -> str:
    chain = root.chain()
    return _dot("path", [*map(_dot_node, chain), *(_dot_arrow(a, b) for a, b in zip(chain, chain[1:], strict=False))], fence)


def dot_flowchart(roots: Iterable[Node], fence: bool = True) -> str:
    nodes: dict[str, None] = {}
    arrows: dict[str, None] = {}

    def walk(node: Node) -> None:
        nodes[_dot_node(node)] = None
        for c in node.children:
            arrows[_dot_arrow(node, c)] = None
            walk(c)

    for root in roots:
        walk(root)
    return _dot("calls", [*nodes, *arrows], fence)


def dot_dependency(target: str, partners: list[dict], fence: bool = True) -> str:
    return _dot("coupling", [f"{_quoted(target)} -> {_quoted(c['partner'])} [dir=both label=\"{c['strength']:.2f} ({c['support']})\"];" for c in partners], fence)


def dot_class(findings: Iterable[tuple[str, str]], fence: bool = True) -> str:
    return _dot("smells", [f"{_quoted(path)} [label={_quoted(path + chr(10) + chr(10).join(kinds))}];" for path, kinds in _by_file(findings)], fence)
