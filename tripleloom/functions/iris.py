"""IRIs: short forms, templates, encoding and display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import DPA, UCSCHAR, XSD
from .text import strip

_PLAIN = "^[A-Za-z0-9._~-]*$"
_RUNS = f"[{UCSCHAR}]+|[^{UCSCHAR}]+"
_KEPT_RUN = f"^[{UCSCHAR}]"


def _after_colon(value: Column) -> Column:
    return F.substr(value, F.instr(value, ":") + 1)


def expand_curie(value: Column) -> Column:
    """Expand the short forms a mapping declaration may use for ontology terms."""
    prefix = F.substring_index(value, ":", 1)
    return (
        F.when(value.startswith("http://") | value.startswith("https://"), value)
        .when(prefix == value, F.concat(F.lit(DPA), value))
        .when(prefix == "dpa", F.concat(F.lit(DPA), _after_colon(value)))
        .when(prefix == "xsd", F.concat(F.lit(XSD), _after_colon(value)))
        .otherwise(F.concat(F.lit(DPA), prefix, F.lit("/"), _after_colon(value)))
    )


def term_prefix(term: Column) -> Column:
    """The prefix under which a Turtle term must be looked up, null if it has none."""
    bare = strip(term)
    bracketed = bare.startswith("<") & bare.endswith(">")
    return F.when(~bracketed & bare.contains(":"), F.substring_index(bare, ":", 1))


def expand_known_prefix(term: Column, namespace: Column) -> Column:
    """Expand a Turtle term. ``namespace`` is what its prefix stands for, or null."""
    bare = strip(term)
    return (
        F.when(bare.startswith("<") & bare.endswith(">"), F.substr(bare, F.lit(2), F.length(bare) - 2))
        .when(namespace.isNotNull(), F.concat(namespace, _after_colon(bare)))
        .otherwise(bare)
    )


def iri_safe(value: Column) -> Column:
    """Percent-encode what RFC 3987 does not let stand in an IRI segment."""
    encoded = F.replace(
        F.replace(F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")),
        F.lit("%7E"),
        F.lit("~"),
    )
    mixed = F.array_join(
        F.transform(
            F.regexp_extract_all(value, F.lit(_RUNS), F.lit(0)),
            lambda run: F.when(run.rlike(_KEPT_RUN), run).otherwise(
                F.replace(
                    F.replace(F.replace(F.url_encode(run), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")),
                    F.lit("%7E"),
                    F.lit("~"),
                )
            ),
        ),
        "",
    )
    only_ascii = F.length(value) == F.octet_length(value)
    return F.when(value.rlike(_PLAIN), value).when(only_ascii, encoded).otherwise(mixed)


def iri_template(template: str, value: Column, encode: bool = True) -> Column:
    """Fill every ``{value}`` of a template. Pass ``encode=False`` for values that are safe as they are."""
    filler = iri_safe(value) if encode else value
    parts: list[Column] = []
    for index, piece in enumerate(template.split("{value}")):
        if index:
            parts.append(filler)
        if piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def iri_label(iri: Column) -> Column:
    """Display label: what follows the last ``#`` or ``/`` once one closing ``>`` or ``#`` is gone."""
    trimmed = F.when(
        iri.endswith(">") | iri.endswith("#"), F.substr(iri, F.lit(1), F.length(iri) - 1)
    ).otherwise(iri)
    return F.coalesce(F.substring_index(F.substring_index(trimmed, "#", -1), "/", -1), F.lit(""))


def iri_local_part(iri: Column) -> Column:
    """What follows the last ``/`` only, the default label of an ontology class."""
    return F.substring_index(iri, "/", -1)


def iri_suffixes(iri: Column) -> Column:
    """Every tail of an IRI that starts just behind a ``/`` or ``#``.

    A term names an IRI iff it is the IRI itself or one of these tails, which
    turns suffix look-ups into an equality join.
    """
    marks = F.array_compact(
        F.transform(
            F.split(iri, ""),
            lambda char, at: F.when((char == "/") | (char == "#"), at + 2),
        )
    )
    return F.transform(marks, lambda start: F.substr(iri, start))
