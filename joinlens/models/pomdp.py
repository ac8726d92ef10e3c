"""Factored decision processes in XML (POMDPX): read into dictionaries and written back."""

from __future__ import annotations

from xml.etree import ElementTree as ET

#: Element names that the format fixes: sections with the element of their functions.
SECTIONS = {"InitialStateBelief": "CondProb", "StateTransitionFunction": "CondProb", "ObsFunction": "CondProb", "RewardFunction": "Func"}
VARIABLES = ("StateVar", "ObsVar", "ActionVar", "RewardVar")


def read(text: str) -> dict:
    """description, discount, variables (kind, attributes, values) and, for each section, functions: var, parents and a table or diagram."""
    root = ET.fromstring(text)
    out = {"description": (root.findtext("Description") or "").strip(), "discount": float(root.findtext("Discount") or 1.0), "variables": [], "functions": {}}
    for v in root.find("Variable") if root.find("Variable") is not None else ():
        number, names = v.findtext("NumValues"), v.findtext("ValueEnum")
        values = names.split() if names else [f"s{i}" for i in range(int(number))] if number else []
        out["variables"].append({"kind": v.tag, **v.attrib, "values": values})
    for section, tag in SECTIONS.items():
        found = root.find(section)
        out["functions"][section] = [_function(f) for f in (found.findall(tag) if found is not None else ())]
    return out


def _function(f: ET.Element) -> dict:
    p = f.find("Parameter")
    out = {"var": f.findtext("Var").strip(), "parents": (f.findtext("Parent") or "").split(), "type": p.get("type", "TBL")}
    if out["type"] == "TBL":
        out["table"] = [(e.findtext("Instance").split(), (e.findtext("ProbTable") or e.findtext("ValueTable")).split()) for e in p.findall("Entry")]
    else:
        out["diagram"] = _diagram(p.find("DAG"))
    return out


def _diagram(node: ET.Element):
    """A terminal's number, or (variable, {value: sub-diagram})."""
    if (end := node.find("Terminal")) is not None:
        return float(end.text)
    inner = node.find("Node")
    return inner.get("var"), {e.get("val"): _diagram(e) for e in inner.findall("Edge")}


def write(model: dict) -> str:
    root = ET.Element("pomdpx", version="1.0")
    ET.SubElement(root, "Description").text = model["description"]
    ET.SubElement(root, "Discount").text = repr(model["discount"])
    top = ET.SubElement(root, "Variable")
    for v in model["variables"]:
        e = ET.SubElement(top, v["kind"], {k: x for k, x in v.items() if k not in ("kind", "values")})
        if v["values"]:
            ET.SubElement(e, "ValueEnum").text = " ".join(v["values"])
    for section, tag in SECTIONS.items():
        s = ET.SubElement(root, section)
        for f in model["functions"].get(section, ()):
            e = ET.SubElement(s, tag)
            ET.SubElement(e, "Var").text = f["var"]
            if f["parents"]:
                ET.SubElement(e, "Parent").text = " ".join(f["parents"])
            p = ET.SubElement(e, "Parameter", type=f["type"])
            for instance, numbers in f.get("table", ()):
                entry = ET.SubElement(p, "Entry")
                ET.SubElement(entry, "Instance").text = " ".join(instance)
                ET.SubElement(entry, "ValueTable" if section == "RewardFunction" else "ProbTable").text = " ".join(numbers)
            if "diagram" in f:
                _write_diagram(ET.SubElement(p, "DAG"), f["diagram"])
    ET.indent(root)
    return ET.tostring(root, encoding="unicode")


def _write_diagram(at: ET.Element, diagram) -> None:
    if isinstance(diagram, float):
        ET.SubElement(at, "Terminal").text = repr(diagram)
        return
    node = ET.SubElement(at, "Node", var=diagram[0])
    for value, below in diagram[1].items():
        _write_diagram(ET.SubElement(node, "Edge", val=value), below)
