"""An example of our own: river gauges, each in a basin."""

from tripleloom import Mapper

D = "https://data-pipeline.local/ontology/"
ROWS = [("K-17", "Ammer", 1.25, 3, "x.png"), ("K-18", "Loisach", 0.5, 3, None), ("B-02", "Rott", 12.0, 8, "y.png")]
GAUGES_DDL = "code string, river string, depth double, basin int, photo string"
SCHEMES = {
    "hydro:gauge": "https://rivers.example/gauge/{value}",
    "hydro:basin": "https://rivers.example/basin/{value}",
}
ONTOLOGY = f"""@prefix owl: <http://www.w3.org/2002/07/owl#> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix dpa: <{D}> .

dpa:Gauge a owl:Class ; rdfs:label "River gauge" ; rdfs:comment "A place where water levels are read." .
dpa:Basin a rdfs:Class ; rdfs:label "Basin" .
<{D}Reading>
    rdfs:comment "One level at one time." ;
    a owl:Class .
dpa:depth a owl:DatatypeProperty ; rdfs:label "Depth in metres" .
"""
# Fixed value: the layout of rendered documents.
GOLDEN = """@prefix dpa: <https://data-pipeline.local/ontology/> .
@prefix rr: <http://www.w3.org/ns/r2rml#> .
@prefix rml: <http://semweb.mmlab.be/ns/rml#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .

<mapping-unity-default-gauges>
    a rr:TriplesMap ;
    dpa:unityCatalogObject "unity.default.gauges" ;
    dpa:unityCatalogStorageLocation "s3://rivers/gauges" ;
    dpa:unityCatalogColumn "code:STRING:Code on the plate" ;
    dpa:unityCatalogColumn "river:STRING:River as on the map" ;
    dpa:unityCatalogColumn "depth:DOUBLE" ;
    dpa:unityCatalogColumn "basin:INT:Number of the basin" ;
    rml:logicalSource [
        rml:source "s3a://rivers/gauges" ;
        rml:referenceFormulation <http://semweb.mmlab.be/ns/ql#CSV>
    ] ;
    rr:subjectMap [
        rr:template "https://rivers.example/gauge/{code}" ;
        rr:class <https://data-pipeline.local/ontology/Gauge>
    ] ;
    rr:predicateObjectMap [
        rr:predicate <https://data-pipeline.local/ontology/code> ;
        rr:objectMap [
            rml:reference "code" ;
            rr:datatype <http://www.w3.org/2001/XMLSchema#string>
        ]
    ] ;
    rr:predicateObjectMap [
        rr:predicate <https://data-pipeline.local/ontology/river> ;
        rr:objectMap [
            rml:reference "river" ;
            rr:datatype <http://www.w3.org/2001/XMLSchema#string>
        ]
    ] ;
    rr:predicateObjectMap [
        rr:predicate <https://data-pipeline.local/ontology/depth> ;
        rr:objectMap [
            rml:reference "depth" ;
            rr:datatype <http://www.w3.org/2001/XMLSchema#double>
        ]
    ] ;
    rr:predicateObjectMap [
        rr:predicate <https://data-pipeline.local/ontology/inBasin> ;
        rr:objectMap [
            rr:template "https://rivers.example/basin/{basin}"
        ]
    ] .
"""


def declare(workspace=None):
    dataset = Mapper(workspace).dataset("unity.default.gauges")
    dataset.row_subject(rdf_class="dpa:Gauge")
    dataset.subject_identifier(column="code", scheme="hydro:gauge")
    dataset.storage(source_uri="s3a://rivers/gauges", storage_location="s3://rivers/gauges")
    dataset.column("code", "STRING", "Code on the plate").literal(predicate="dpa:code")
    dataset.column("river", "STRING", "River as on the map").literal(predicate="dpa:river", language="de")
    dataset.column("depth", "DOUBLE").literal(predicate="dpa:depth")
    dataset.column("basin", "INT", "Number of the basin").entity_reference(scheme="hydro:basin", predicate="dpa:inBasin")
    dataset.column("photo", "STRING", "Not for the graph").ignore()
    return dataset
