"""Mapping declarations, the builder that makes them, and the working schemas."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .vocab import ONTOLOGY_ID, PROFILES

if TYPE_CHECKING:
    from .workspace import Workspace

STRING, LONG, TIMESTAMP = T.StringType(), T.LongType(), T.TimestampType()


def _struct(names: str = "", **others: T.DataType) -> T.StructType:
    """A struct of string fields, then fields of other types."""
    fields = [T.StructField(name, STRING) for name in names.split()]
    return T.StructType(fields + [T.StructField(name, data_type) for name, data_type in others.items()])


COLUMN_RULE_SCHEMA = _struct("name type_name comment kind predicate datatype language scheme term")
SPEC_SCHEMA = _struct(
    "mapping_id ontology profile",
    dataset=_struct(
        "name",
        row_subject=_struct("rdf_class label"),
        subject_identifier=_struct("column scheme"),
        source_uri=STRING,
        storage_location=STRING,
        columns=T.ArrayType(COLUMN_RULE_SCHEMA),
    ),
)
DOCUMENT_SCHEMA = _struct("mapping_id rml")
SCHEME_SCHEMA = _struct("scheme_id label template")
CLASS_SCHEMA = _struct("iri label comment")
EVENT_SCHEMA = _struct(
    "mapping_id",
    seq=LONG,
    ts=TIMESTAMP,
    op=STRING,
    source=STRING,
    ontology=STRING,
    profile=STRING,
    status=STRING,
    payload=STRING,
    rml=STRING,
)
JOB_SCHEMA = _struct("job_id status", created_at=TIMESTAMP, mapping_id=STRING, target=STRING)
TRIPLE_SCHEMA = _struct("graph s p o o_type o_datatype o_lang")
CATALOG_COLUMN_SCHEMA = _struct(
    "name type_text type_json type_name", position=T.IntegerType(), nullable=T.BooleanType(), comment=STRING
)
CATALOG_TABLE_SCHEMA = _struct(
    "full_name table_type data_source_format storage_location comment",
    properties=T.MapType(STRING, STRING),
    columns=T.ArrayType(CATALOG_COLUMN_SCHEMA),
)


@dataclass(frozen=True)
class ColumnRule:
    """How one source column takes part in a mapping."""

    name: str
    type_name: str = "STRING"
    comment: str = ""
    kind: str = "ignore"
    predicate: str = ""
    datatype: str = ""
    language: str = ""
    scheme: str = ""
    term: str = ""


@dataclass(frozen=True)
class MappingSpec:
    """One dataset mapping, as data."""

    name: str
    mapping_id: str = ""
    ontology: str = ONTOLOGY_ID
    profile: str = PROFILES[0]
    rdf_class: str = ""
    label: str = ""
    subject_column: str = ""
    subject_scheme: str = ""
    source_uri: str = ""
    storage_location: str = ""
    columns: tuple[ColumnRule, ...] = field(default=())

    def dataset(self) -> dict[str, Any]:
        """The ``dataset`` member of the declaration's JSON form."""
        return {
            "name": self.name,
            "row_subject": {"rdf_class": self.rdf_class, "label": self.label},
            "subject_identifier": {"column": self.subject_column, "scheme": self.subject_scheme},
            "source_uri": self.source_uri,
            "storage_location": self.storage_location,
            "columns": [dict(vars(column)) for column in self.columns],
        }

    def payload(self) -> dict[str, Any]:
        return {"ontology": self.ontology, "profile": self.profile, "dataset": self.dataset()}

    def preview_id(self) -> str:
        return "mapping-" + (self.name or "dataset").replace(".", "-")

    def with_id(self, mapping_id: str) -> MappingSpec:
        return replace(self, mapping_id=mapping_id)

    @staticmethod
    def from_row(row: Any) -> MappingSpec:
        """Inverse of :func:`specs_frame` for one row."""
        data = row.dataset
        subject, identifier = data.row_subject, data.subject_identifier
        return MappingSpec(
            mapping_id=row.mapping_id or "",
            ontology=row.ontology or "",
            profile=row.profile or "",
            name=data.name or "",
            rdf_class=(subject.rdf_class or "") if subject else "",
            label=(subject.label or "") if subject else "",
            subject_column=(identifier.column or "") if identifier else "",
            subject_scheme=(identifier.scheme or "") if identifier else "",
            source_uri=data.source_uri or "",
            storage_location=data.storage_location or "",
            columns=tuple(
                ColumnRule(**{key: value or "" for key, value in column.asDict().items()})
                for column in data.columns or []
            ),
        )


def specs_frame(spark: SparkSession, specs: Iterable[MappingSpec]) -> DataFrame:
    """Declarations as rows, with the preview id where no id was given."""
    rows = [
        {
            "mapping_id": spec.mapping_id or spec.preview_id(),
            "ontology": spec.ontology,
            "profile": spec.profile,
            "dataset": spec.dataset(),
        }
        for spec in specs
    ]
    return spark.createDataFrame(rows, SPEC_SCHEMA)


def schemes_frame(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """Identifier schemes given as ``id -> template``; labels default to the id."""
    return spark.createDataFrame([(key, key, value) for key, value in templates.items()], SCHEME_SCHEMA)


class ColumnStep:
    """A column waiting to be told what it means; every choice leads back to the dataset."""

    def __init__(self, owner: DatasetBuilder, rule: ColumnRule):
        self._owner = owner
        self._rule = rule

    def _done(self, kind: str, **given: str) -> DatasetBuilder:
        self._owner._rules.append(replace(self._rule, kind=kind, **given))
        return self._owner

    def literal(self, *, predicate: str, datatype: str = "", language: str = "") -> DatasetBuilder:
        """A typed literal. ``language`` is kept in the declaration but makes no language tag."""
        return self._done("literal", predicate=predicate, datatype=datatype, language=language)

    def entity_reference(self, *, scheme: str, predicate: str) -> DatasetBuilder:
        """A link to the entity that the scheme builds from the column's value."""
        return self._done("entity_reference", scheme=scheme, predicate=predicate)

    def classification(self, *, term: str, predicate: str = "") -> DatasetBuilder:
        """A fixed term stated for every row."""
        return self._done("classification", term=term, predicate=predicate)

    def ignore(self) -> DatasetBuilder:
        return self._done("ignore")


class DatasetBuilder:
    """Collects one dataset's declaration; calls can be chained or made one by one."""

    def __init__(self, mapper: Mapper, name: str):
        self._mapper = mapper
        self._given: dict[str, str] = {"name": name}
        self._rules: list[ColumnRule] = []

    def row_subject(self, *, rdf_class: str, label: str = "") -> DatasetBuilder:
        self._given.update(rdf_class=rdf_class, label=label)
        return self

    def subject_identifier(self, *, column: str, scheme: str) -> DatasetBuilder:
        self._given.update(subject_column=column, subject_scheme=scheme)
        return self

    def storage(self, *, source_uri: str, storage_location: str = "") -> DatasetBuilder:
        self._given.update(source_uri=source_uri, storage_location=storage_location)
        return self

    def column(self, name: str, type_name: str = "STRING", comment: str = "") -> ColumnStep:
        return ColumnStep(self, ColumnRule(name, type_name, comment))

    def spec(self) -> MappingSpec:
        return MappingSpec(
            ontology=self._mapper.ontology,
            profile=self._mapper.profile,
            columns=tuple(self._rules),
            **self._given,
        )

    def to_payload(self) -> dict[str, Any]:
        return self.spec().payload()

    def register(self) -> dict[str, Any]:
        return self._mapper._home().register(self.spec())

    def register_and_project(self) -> dict[str, Any]:
        """Register, validate, activate and project in one go, and look at what the catalog then says.

        Raises ``RuntimeError`` if it is not what the mapping says.
        """
        home = self._mapper._home()
        record = home.register(self.spec())
        checked = home.validate(record["id"])
        active = home.activate(record["id"])
        projection = home.project([record["id"]])
        if wrong := home.check([record["id"]]).collect():
            said = "; ".join(f"{row.full_name}: {row.fact} is {row.actual!r}, not {row.expected!r}" for row in wrong)
            raise RuntimeError(f"the catalog does not say what was projected: {said}")
        return {"mapping": active, "validation": checked, "projection": projection}


class Mapper:
    """Entry point for declaring mappings against one ontology and profile.

    Without a workspace it only builds declarations; with one, they can be
    registered, activated and projected.
    """

    def __init__(self, workspace: Workspace | None = None, ontology: str = "", profile: str = ""):
        self.workspace = workspace
        self.ontology = ontology or ONTOLOGY_ID
        self.profile = profile or PROFILES[0]

    def _home(self) -> Workspace:
        if self.workspace is None:
            raise RuntimeError("this mapper has no workspace to register mappings in")
        return self.workspace

    def dataset(self, name: str) -> DatasetBuilder:
        return DatasetBuilder(self, name)

    def register_rml(self, ttl: str) -> dict[str, Any]:
        return self._home().register_document(ttl, ontology=self.ontology, profile=self.profile)

    def register_rml_file(self, path: str) -> dict[str, Any]:
        return self.register_rml(Path(path).read_text(encoding="utf-8"))

    def validate_mapping(self, mapping: str | dict[str, Any]) -> dict[str, Any]:
        return self._home().validate(reference_id(mapping))

    def activate_mapping(self, mapping: str | dict[str, Any]) -> dict[str, Any]:
        return self._home().activate(reference_id(mapping))

    def project_unity_catalog(self, mapping: str | dict[str, Any]) -> dict[str, Any]:
        return self._home().project([reference_id(mapping)])


def reference_id(mapping: str | dict[str, Any]) -> str:
    """Id of a mapping named by id or by its record."""
    found = mapping if isinstance(mapping, str) else (mapping or {}).get("id")
    if found is None or found == "" and not isinstance(mapping, str):
        raise ValueError(f"no mapping id in {mapping!r}")
    return str(found)


def payload_json(spec: MappingSpec) -> str:
    return json.dumps(spec.payload(), sort_keys=True)
