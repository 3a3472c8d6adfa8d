"""Coordinate systems in well-known text, read as trees.

A node is a keyword and its values: texts, numbers and nodes. What a unit belongs to is told by the
path to it, so a vertical or angular unit is never taken for that of the plane.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(r'\s*(?:([A-Za-z_][A-Za-z_0-9]*)\s*[\[(]|"((?:[^"]|"")*)"|([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|([A-Za-z_][A-Za-z_0-9]*)|([\])])|(,))')
#: Fixed by the formats (versions 1 and 2): keywords of systems, units and identifiers.
PLANE, ANGULAR, VERTICAL, COMPOUND = ("PROJCS", "PROJCRS", "PROJECTEDCRS", "LOCAL_CS", "ENGCRS"), ("GEOGCS", "GEOGCRS", "GEODCRS", "GEOCCS", "GEOGRAPHICCRS"), ("VERT_CS", "VERTCRS", "VERTICALCRS"), ("COMPD_CS", "COMPOUNDCRS")
UNITS, IDS = ("UNIT", "LENGTHUNIT", "ANGLEUNIT", "SCALEUNIT"), ("AUTHORITY", "ID")


@dataclass
class Node:
    keyword: str
    values: list = field(default_factory=list)

    def children(self, *keywords: str) -> list[Node]:
        return [v for v in self.values if isinstance(v, Node) and v.keyword in keywords]

    @property
    def name(self) -> str | None:
        return self.values[0] if self.values and isinstance(self.values[0], str) else None


def parse(text: str) -> Node:
    """The tree of a text; ValueError if it isn't one node with balanced brackets."""
    root = Node("")
    open_nodes, at = [root], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no well-known text at {at}: {text[at : at + 20]!r}")
        at = m.end()
        keyword, quoted, number, word, close, _ = m.groups()
        if keyword:
            node = Node(keyword.upper())
            open_nodes[-1].values.append(node)
            open_nodes.append(node)
        elif quoted is not None:
            open_nodes[-1].values.append(quoted.replace('""', '"'))
        elif number:
            open_nodes[-1].values.append(float(number))
        elif word:
            open_nodes[-1].values.append(word)
        elif close:
            if len(open_nodes) == 1:
                raise ValueError("a bracket too many")
            open_nodes.pop()
    if len(open_nodes) != 1 or len(root.values) != 1 or not isinstance(root.values[0], Node):
        raise ValueError("a bracket is missing, or there isn't one system")
    return root.values[0]


def _unit(system: Node) -> tuple[str | None, float | None]:
    """The unit of a system's own axes: its child, or that of its first axis."""
    found = system.children(*UNITS) or [u for a in system.children("AXIS") for u in a.children(*UNITS)]
    if not found:
        return None, None
    numbers = [v for v in found[0].values if isinstance(v, float)]
    return found[0].name, numbers[0] if numbers else None


def facts(tree: Node) -> dict:
    """kind, name, unit and its factor of the horizontal axes, unit and factor of the vertical one, and the EPSG code of the whole."""
    parts = [p for p in tree.values if isinstance(p, Node)] if tree.keyword in COMPOUND else [tree]
    horizontal = next((p for p in parts if p.keyword in PLANE), None) or next((p for p in parts if p.keyword in ANGULAR), None)
    vertical = next((p for p in parts if p.keyword in VERTICAL), None)
    kind = "compound" if tree.keyword in COMPOUND else "projected" if tree.keyword in PLANE else "geographic" if tree.keyword in ANGULAR else "vertical" if tree.keyword in VERTICAL else "other"
    unit, factor = _unit(horizontal) if horizontal else (None, None)
    vertical_unit, vertical_factor = _unit(vertical) if vertical else (None, None)
    code = next((str(int(v.values[1])) if isinstance(v.values[1], float) else str(v.values[1]) for v in tree.children(*IDS) if len(v.values) > 1 and str(v.values[0]).upper() == "EPSG"), None)
    return {"kind": kind, "name": tree.name, "unit": unit, "unit_factor": factor, "vertical_unit": vertical_unit, "vertical_factor": vertical_factor, "epsg": code}
