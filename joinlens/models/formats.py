"""Exchange formats of discrete networks: BIF, XMLBIF, XBN and UAI. Text in, text out."""

from __future__ import annotations

import re
from itertools import product
from xml.etree import ElementTree as ET

import numpy as np

from joinlens.models.dag import Dag
from joinlens.models.network import Network, Table


def _build(states: dict[str, list[str]], tables: list[Table]) -> Network:
    out = Network(Dag(((p, t.name) for t in tables for p in t.parents), states), states, {t.name: t for t in tables})
    out.check()
    return out


def _numbers(text: str) -> list[float]:
    return [float(x) for x in re.findall(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", text)]


_NAME = r"[^\s,{}()\[\];|]+"


def read_bif(text: str) -> Network:
    text = re.sub(r"//[^\n]*|/\*.*?\*/", "", text, flags=re.S)
    states = {m[1]: [s.strip().strip('"') for s in m[2].split(",")] for m in re.finditer(rf"variable\s+({_NAME})\s*\{{[^}}]*?type\s+discrete\s*\[\s*\d+\s*\]\s*\{{([^}}]*)\}}", text)}
    tables = []
    for m in re.finditer(rf"probability\s*\(\s*({_NAME})\s*(?:\|\s*([^)]*))?\)\s*\{{(.*?)\}}", text, re.S):
        name, parents = m[1], tuple(p.strip() for p in (m[2] or "").split(",") if p.strip())
        shape = [len(states[x]) for x in (name, *parents)]
        table = re.search(r"\btable\b([^;]*);", m[3])
        if table:
            values = np.array(_numbers(table[1])).reshape(shape)
        else:
            values = np.full(shape, 1 / shape[0])
            default = re.search(r"\bdefault\b([^;]*);", m[3])
            if default:
                values[:] = np.array(_numbers(default[1])).reshape([-1] + [1] * len(parents))
            for row in re.finditer(r"\(([^)]*)\)([^;]*);", m[3]):
                at = tuple(states[p].index(s.strip().strip('"')) for p, s in zip(parents, row[1].split(","), strict=True))
                values[(slice(None), *at)] = _numbers(row[2])
        tables.append(Table(name, parents, values))
    return _build(states, tables)


def write_bif(net: Network, name: str = "network") -> str:
    out = [f"network {name} {{\n}}"]
    for n in net.graph.nodes:
        out.append(f"variable {n} {{\n  type discrete [ {len(net.states[n])} ] {{ {', '.join(map(str, net.states[n]))} }};\n}}")
    for n in net.graph.nodes:
        t = net.tables[n]
        head = f"probability ( {n}" + (f" | {', '.join(t.parents)}" if t.parents else "") + " ) {"
        if not t.parents:
            out.append(f"{head}\n  table {', '.join(map(repr, t.values.tolist()))};\n}}")
            continue
        rows = []
        for combo in product(*(range(len(net.states[p])) for p in t.parents)):
            label = ", ".join(str(net.states[p][i]) for p, i in zip(t.parents, combo, strict=True))
            rows.append(f"  ({label}) {', '.join(map(repr, t.values[(slice(None), *combo)].tolist()))};")
        out.append("\n".join([head, *rows, "}"]))
    return "\n".join(out) + "\n"


def read_xmlbif(text: str) -> Network:
    root = ET.fromstring(text)
    states = {v.findtext("NAME").strip(): [o.text.strip() for o in v.findall("OUTCOME")] for v in root.iter("VARIABLE")}
    tables = []
    for d in root.iter("DEFINITION"):
        name, parents = d.findtext("FOR").strip(), tuple(g.text.strip() for g in d.findall("GIVEN"))
        # The variable itself changes fastest.
        values = np.array(_numbers(d.findtext("TABLE"))).reshape([len(states[x]) for x in (*parents, name)])
        tables.append(Table(name, parents, np.moveaxis(values, -1, 0)))
    return _build(states, tables)


def write_xmlbif(net: Network, name: str = "network") -> str:
    root = ET.Element("BIF", VERSION="0.3")
    top = ET.SubElement(root, "NETWORK")
    ET.SubElement(top, "NAME").text = name
    for n in net.graph.nodes:
        v = ET.SubElement(top, "VARIABLE", TYPE="nature")
        ET.SubElement(v, "NAME").text = n
        for s in net.states[n]:
            ET.SubElement(v, "OUTCOME").text = str(s)
    for n in net.graph.nodes:
        t = net.tables[n]
        d = ET.SubElement(top, "DEFINITION")
        ET.SubElement(d, "FOR").text = n
        for p in t.parents:
            ET.SubElement(d, "GIVEN").text = p
        ET.SubElement(d, "TABLE").text = " ".join(map(repr, np.moveaxis(t.values, 0, -1).ravel().tolist()))
    ET.indent(root)
    return ET.tostring(root, encoding="unicode")


def read_xbn(text: str) -> Network:
    root = ET.fromstring(text)
    states = {v.get("NAME"): [s.text.strip() for s in v.findall("STATENAME")] for v in root.iter("VAR")}
    tables = []
    for d in root.iter("DIST"):
        name = d.find("PRIVATE").get("NAME")
        parents = tuple(e.get("NAME") for e in d.iter("CONDELEM"))
        values = np.zeros([len(states[x]) for x in (name, *parents)])
        for p in d.iter("DPI"):
            at = tuple(int(i) for i in (p.get("INDEXES") or "").split())
            values[(slice(None), *at)] = _numbers(p.text)
        tables.append(Table(name, parents, values))
    return _build(states, tables)


def write_xbn(net: Network, name: str = "network") -> str:
    root = ET.Element("ANALYSISNOTEBOOK", ROOT=name)
    model = ET.SubElement(root, "BNMODEL", NAME=name)
    variables, structure, distributions = (ET.SubElement(model, x) for x in ("VARIABLES", "STRUCTURE", "DISTRIBUTIONS"))
    for i, n in enumerate(net.graph.nodes):
        v = ET.SubElement(variables, "VAR", NAME=n, TYPE="discrete", XPOS="0", YPOS=str(i))
        for s in net.states[n]:
            ET.SubElement(v, "STATENAME").text = str(s)
    for a, b in net.graph.edges:
        ET.SubElement(structure, "ARC", PARENT=a, CHILD=b)
    for n in net.graph.nodes:
        t = net.tables[n]
        d = ET.SubElement(distributions, "DIST", TYPE="discrete")
        if t.parents:
            c = ET.SubElement(d, "CONDSET")
            for p in t.parents:
                ET.SubElement(c, "CONDELEM", NAME=p)
        ET.SubElement(d, "PRIVATE", NAME=n)
        dpis = ET.SubElement(d, "DPIS")
        for combo in product(*(range(len(net.states[p])) for p in t.parents)):
            dpi = ET.SubElement(dpis, "DPI", **({"INDEXES": " ".join(map(str, combo))} if combo else {}))
            dpi.text = " ".join(map(repr, t.values[(slice(None), *combo)].tolist()))
    ET.indent(root)
    return ET.tostring(root, encoding="unicode")


def read_uai(text: str) -> tuple[str, list[int], list[tuple[tuple[int, ...], np.ndarray]]]:
    """Kind (BAYES or MARKOV), each variable's number of states, and the functions: scope and table (the last variable changes fastest)."""
    words = text.split()
    at = iter(words[1:])
    take = lambda: int(next(at))
    cards = [take() for _ in range(take())]
    scopes = [tuple(take() for _ in range(take())) for _ in range(take())]
    functions = []
    for scope in scopes:
        values = np.array([float(next(at)) for _ in range(take())])
        functions.append((scope, values.reshape([cards[v] for v in scope])))
    return words[0], cards, functions


def uai_network(text: str) -> Network:
    """A BAYES file as a network: in each scope the child is last."""
    kind, cards, functions = read_uai(text)
    if kind != "BAYES":
        raise ValueError("a MARKOV file has no directions")
    name = lambda v: f"var_{v}"
    states = {name(v): list(range(k)) for v, k in enumerate(cards)}
    return _build(states, [Table(name(s[-1]), tuple(map(name, s[:-1])), np.moveaxis(f, -1, 0)) for s, f in functions])


def write_uai(net: Network) -> str:
    nodes = net.graph.nodes
    number = {n: i for i, n in enumerate(nodes)}
    scopes, tables = [], []
    for n in nodes:
        t = net.tables[n]
        scopes.append(" ".join(map(str, [len(t.parents) + 1, *(number[p] for p in t.parents), number[n]])))
        values = np.moveaxis(t.values, 0, -1).ravel()
        tables.append(f"{values.size}\n{' '.join(map(repr, values.tolist()))}")
    return "\n".join(["BAYES", str(len(nodes)), " ".join(str(len(net.states[n])) for n in nodes), str(len(nodes)), *scopes, *tables]) + "\n"
