"""What a mapping says about each row, resolved on the driver.

A declaration is small and known before the job starts, so its short forms and
schemes are resolved here once. What is left for the executors are column
expressions over literals.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from urllib.parse import unquote

from ..model import ColumnRule, MappingSpec
from ..vocab import DEFAULT_CLASS, DEFAULT_CLASSIFICATION, DPA, RDF_TYPE, XSD, XSD_LOCAL_BY_TYPE


@dataclass(frozen=True)
class TripleRule:
    """One triple per row: a fixed object, a column's text, or a template filled from a column."""

    predicate: str
    o_type: str
    constant: str | None = None
    column: str | None = None
    template: str | None = None
    datatype: str | None = None


@dataclass(frozen=True)
class MappingPlan:
    subject_column: str
    subject_template: str
    rules: tuple[TripleRule, ...]

    def columns(self) -> list[str]:
        """Source columns that have to be read, each once."""
        used = [self.subject_column] + [rule.column for rule in self.rules if rule.column is not None]
        return list(dict.fromkeys(used))

    def bound_to(self, predicate: str) -> MappingPlan:
        kept = tuple(rule for rule in self.rules if rule.predicate == predicate)
        return MappingPlan(self.subject_column, self.subject_template, kept)


def expand(value: str) -> str:
    """Short form of a declaration to an IRI, for values known on the driver."""
    if value.startswith(("http://", "https://")):
        return value
    prefix, colon, local = value.partition(":")
    if not colon:
        return DPA + prefix
    known = {"dpa": DPA, "xsd": XSD}
    return known.get(prefix, f"{DPA}{prefix}/") + local


def _template(schemes: Mapping[str, str], scheme: str) -> str:
    if scheme not in schemes:
        raise ValueError(f"Unknown identifier scheme: {scheme}")
    return schemes[scheme]


def _rule(column: ColumnRule, schemes: Mapping[str, str]) -> TripleRule | None:
    if column.kind == "classification":
        predicate = expand(column.predicate) if column.predicate else DEFAULT_CLASSIFICATION
        return TripleRule(predicate, "uri", constant=expand(column.term))
    if column.kind not in ("literal", "entity_reference"):
        return None
    if not column.predicate:
        what = column.kind.replace("_", " ")
        raise ValueError(f"Column {column.name} {what} mapping requires predicate")
    predicate = expand(column.predicate)
    if column.kind == "entity_reference":
        return TripleRule(predicate, "uri", column=column.name, template=_template(schemes, column.scheme))
    local = XSD_LOCAL_BY_TYPE.get((column.type_name or "STRING").upper(), "string")
    datatype = expand(column.datatype) if column.datatype else XSD + local
    return TripleRule(predicate, "literal", column=column.name, datatype=datatype)


def plan_mapping(spec: MappingSpec, schemes: Mapping[str, str]) -> MappingPlan:
    """Resolve a declaration. Raises ``ValueError`` where it cannot be run."""
    if not spec.name.strip():
        raise ValueError("dataset.name is required")
    column, scheme = spec.subject_column.strip(), spec.subject_scheme.strip()
    if not column or not scheme:
        raise ValueError("dataset.subject_identifier requires column and scheme")
    template = _template(schemes, scheme)
    typing = TripleRule(RDF_TYPE, "uri", constant=expand(spec.rdf_class or DEFAULT_CLASS))
    stated = [_rule(entry, schemes) for entry in spec.columns]
    return MappingPlan(column, template, (typing, *[rule for rule in stated if rule is not None]))


def template_key(template: str, iri: str) -> str | None:
    """Text of the key that a template turned into ``iri``.

    None if no key does, or if the template repeats its slot.
    """
    head, slot, tail = template.partition("{value}")
    if not slot or "{value}" in tail:
        return None
    if not (iri.startswith(head) and iri.endswith(tail)) or len(iri) < len(head) + len(tail):
        return None
    return unquote(iri[len(head) : len(iri) - len(tail)], errors="replace")
