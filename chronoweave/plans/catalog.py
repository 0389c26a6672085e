"""Rule catalog: declarative concept definitions read from XML into plain records.

A folder holds one concept a file (extensions in any case).  Kinds: numeric-raw-concept,
nominal-raw-concept, event, state, trend, context and pattern; the root element decides.  References to
concepts that no file defines are reported as warnings; such a branch can never fire.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from pathlib import Path
from xml.etree import ElementTree

log = logging.getLogger(__name__)
Duration = tuple[int, str]


@dataclass(frozen=True)
class Test:
    """A comparison of a concept's value, or an and/or of such."""

    operator: str
    concept: str = ""
    right: float | str | None = None
    parts: tuple[Test, ...] = ()

    def sources(self) -> set[str]:
        return {self.concept} if not self.parts else set().union(*(p.sources() for p in self.parts))


@dataclass(frozen=True)
class Inducer:
    concept: str
    constraints: tuple[tuple[str, str], ...]
    start: tuple[str, Duration] = ("start", (0, "second"))
    end: tuple[str, Duration] = ("end", (0, "second"))


@dataclass(frozen=True)
class Component:
    concept: str
    alias: str
    constraints: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Pairwise:
    operator: str
    i: str
    j: str
    max_duration: Duration | None = None


@dataclass(frozen=True)
class Concept:
    id: str
    name: str
    kind: str
    concatenable: bool = False
    before: Duration = (0, "second")
    after: Duration = (0, "second")
    bridge: Duration | None = None
    sources: tuple[str, ...] = ()
    range: tuple[float, float] | None = None
    domain: tuple[str, ...] = ()
    attributes: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    cases: tuple[tuple[int, str, Test], ...] = ()
    variation: float = 0.0
    steady: Duration = (0, "day")
    inducers: tuple[Inducer, ...] = ()
    clippers: tuple[Inducer, ...] = ()
    relation: str = "all"
    components: tuple[Component, ...] = ()
    pairwise: tuple[Pairwise, ...] = ()
    periodic: tuple[int, Duration, str] | None = None
    output: tuple = ()
    bounds: tuple[tuple[str, str, Duration], ...] = ()
    at_contexts: tuple[str, ...] = ()
    flags: dict = field(default_factory=dict, compare=False, hash=False)


def _span(e, default: Duration = (0, "second")) -> Duration:
    return default if e is None else (int(e.get("value") or 0), e.get("granularity") or default[1])


def _constraints(e) -> tuple[tuple[str, str], ...]:
    if e is None:
        return ()
    return tuple((c.get("operator"), c.get("value")) for c in e.iter() if c.tag in ("value-constraint", "clipper-value-constraint"))


def _test(e) -> Test:
    """A tree below an evaluation-tree or operand; its kind is the child's, whatever data-type says."""
    for c in e:
        if c.tag == "logical-function":
            op = c.get("logical-operator")
            if op not in ("and", "or"):
                raise ValueError(f"logical operator {op!r}")
            return Test(op, parts=tuple(_test(o) for o in c.find("operands")))
        if c.tag == "comparison-function":
            right = c.find("right")
            number = right.find("double")
            value = float(number.text) if number is not None else (right.findtext("string") or "").strip()
            return Test(c.get("comparison-operator"), c.find("left/concept-id-allowed-values").get("id"), value)
    raise ValueError("empty evaluation tree")


def _operand(e) -> str:
    c = e.find("concept-id-allowed-values")
    return "current-time" if e.get("data-type") == "current-time" or c is None else c.get("id")


def parse(text: str | bytes) -> Concept:
    """One concept from its XML."""
    root = ElementTree.fromstring(text)
    if root.tag not in ("numeric-raw-concept", "nominal-raw-concept", "event", "state", "trend", "context", "pattern"):
        raise ValueError(f"unknown concept kind {root.tag}")
    flags = dict(root.find("temporal-semantic").attrib) if root.find("temporal-semantic") is not None else {}
    get: dict = {"id": root.get("id"), "name": root.get("name"), "kind": root.tag, "concatenable": flags.get("concatenable") == "true", "flags": flags}
    local = root.find(".//local-persistence")
    if local is not None:
        get |= {"before": _span(local.find("good-before")), "after": _span(local.find("good-after"))}
    wide = root.find(".//global-persistence")
    cells = [int(v.text or v.get("value") or 0) for v in wide.iter() if v.tag in ("column", "cell", "value")] if wide is not None else []
    if cells:
        get["bridge"] = (max(cells), wide.get("granularity") or "second")
    get["sources"] = tuple(e.text.strip() for e in root.iterfind("derived-from/derived-from-id"))
    get["at_contexts"] = tuple(e.get("id") or (e.text or "").strip() for e in root.iterfind("abstraction-at-contexts/*"))
    numeric = root.find("numeric-allowed-values")
    if numeric is not None:
        low, high = (numeric.get(f"{k}-value") or numeric.get(f"{k}_value") for k in ("min", "max"))
        get["range"] = (float(low), float(high)) if low and high else None
    get["domain"] = tuple(v for e in root.iter() if e.tag in ("nominal-allowed-value", "ordinal-allowed-value", "boolean-allowed-value", "persistence-value") for v in [(e.get("value") or e.text or "").strip()] if v)
    if root.tag == "event":
        get["attributes"] = tuple(e.text.strip() for e in root.iterfind("Attributes/Attribute-id"))
        get["tags"] = tuple(t.strip() for t in (root.findtext("Event-Types") or "").split(",") if t.strip())
    if root.tag == "state":
        cases = [(int(m.get("order")), m.get("value"), _test(m.find("evaluation-tree"))) for m in root.iter("mapping-function-2-value")]
        get["cases"] = tuple(sorted(cases, key=lambda c: c[0]))
    if root.tag == "trend":
        get |= {"variation": float(root.get("significant-variation")), "steady": _span(root.find("time-steady"), (0, "day"))}
    if root.tag == "context":
        def inducer(e):
            out = {"concept": e.get("id"), "constraints": _constraints(e.find("value-constraints") if e.tag == "inducer-entity" else e.find("clipper-value-constraints"))}
            for side, tag in (("start", "from"), ("end", "until")):
                b = e.find(tag)
                if b is not None:
                    out[side] = (b.get("boundary-point"), _span(b.find("time-gap")))
            for t in e.iterfind("time-constraints/time-constraint"):
                sign = -1 if t.get("time-operator") == "minus" else 1
                out[t.get("time-window")] = (t.get("ref-point"), (sign * int(t.get("value") or 0), t.get("granularity")))
            return Inducer(**out)

        get["inducers"] = tuple(inducer(e) for e in root.iter("inducer-entity"))
        get["clippers"] = tuple(inducer(e) for e in root.iter("clipper-entity"))
        get["sources"] = tuple(dict.fromkeys(i.concept for i in (*get["inducers"], *get["clippers"])))
    if root.tag == "pattern":
        body, out = root.find("pattern-definition"), root.find("pattern-output")
        get["relation"] = body.get("relation") or "all"
        get["components"] = tuple(Component(c.get("id"), c.get("alias") or c.get("id"), _constraints(c.find("local-constraints"))) for c in body.iterfind("components/component"))
        pairs = []
        for p in body.iter("pairwise-constraint"):
            most = p.find("max-duration")
            pairs.append(Pairwise(p.get("time-comparison-operator"), p.find("pairwise-constraint-component-i").get("alias"), p.find("pairwise-constraint-component-j").get("alias"), None if most is None else _span(most)))
        get["pairwise"] = tuple(pairs)
        period = body.find("periodic-constraints")
        if period is not None and period.find("calendar-frequency") is not None:
            f = period.find("calendar-frequency")
            get["periodic"] = (int(period.get("cardinality-min") or 1), (int(f.get("frequency-value")), f.get("frequency-granularity")), f.get("relative-component-id"))
        get["sources"] = get["sources"] or tuple(c.concept for c in get["components"])
        if out is not None:
            math, stat, trap = out.find(".//mathematical-function"), out.find(".//statistical-function"), out.find(".//time-constraint-compliance")
            if math is not None:
                get["output"] = (math.get("mathematical-operator"), _operand(math.find("left")), _operand(math.find("right")))
            elif stat is not None:
                get["output"] = (stat.get("statistical-operator"),)
            elif trap is not None:
                get["output"] = ("trapezoid", *(float(trap.get(f"trapeze{k}")) for k in "ABCD"))
            get["bounds"] = tuple((side, f"{e.get('alias')}.{e.get('boundary-point')}", _span(e.find("time-shift"))) for side, tag in (("start", "start-local-pattern"), ("end", "end-local-pattern")) for e in [out.find(tag)] if e is not None)
    return Concept(**get)


class Catalog:
    """Concepts by id, their evaluation levels and the references that lead nowhere."""

    def __init__(self, concepts: list[Concept]):
        self.concepts = {c.id: c for c in concepts}
        self.missing = sorted({(c.id, s) for c in concepts for s in c.sources if s not in self.concepts})
        for c, s in self.missing:
            log.warning("concept %s refers to %s, which is not defined", c, s)
        gated = [c.id for c in concepts if c.at_contexts]
        if gated:
            raise ValueError(f"abstraction-at-contexts is not supported: {gated}")
        self.levels = self._levels()

    @staticmethod
    def read(folder: str | Path) -> Catalog:
        files = sorted(p for p in Path(folder).iterdir() if p.suffix.lower() == ".xml")
        return Catalog([parse(p.read_bytes()) for p in files])

    def _levels(self) -> list[list[Concept]]:
        level: dict[str, int] = {}

        def depth(i: str, path: tuple[str, ...]) -> int:
            if i in path:
                raise ValueError(f"concepts depend on each other: {' > '.join((*path, i))}")
            if i not in level:
                level[i] = 1 + max((depth(s, (*path, i)) for s in self.concepts[i].sources if s in self.concepts), default=-1)
            return level[i]

        for i in self.concepts:
            depth(i, ())
        return [[self.concepts[i] for i in level if level[i] == k] for k in range(max(level.values(), default=-1) + 1)]

    def by_name(self) -> dict[str, Concept]:
        return {c.name.lower(): c for c in self.concepts.values()}
