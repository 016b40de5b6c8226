"""Namespaces, type tables and patterns shared by the whole package.

Everything in this module is a fixed value: results only agree with existing
mapping documents, catalogs and graphs if these strings are kept as they are.
"""

# Namespaces.
DPA = "https://data-pipeline.local/ontology/"
RR = "http://www.w3.org/ns/r2rml#"
RML = "http://semweb.mmlab.be/ns/rml#"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_CLASS = "http://www.w3.org/2000/01/rdf-schema#Class"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
RDFS_COMMENT = "http://www.w3.org/2000/01/rdf-schema#comment"
OWL_CLASS = "http://www.w3.org/2002/07/owl#Class"
CSV_FORMULATION = "http://semweb.mmlab.be/ns/ql#CSV"

# Service identity.
ONTOLOGY_ID = "manufacturing-rdl"
ONTOLOGY_LABEL = "Manufacturing RDL"
PROFILES = ("spark-delta", "rml")
MAPPINGS_GRAPH = "https://data-pipeline.local/graph/mappings"
PROJECTION_TARGET = "unity-catalog"
PROPERTY_SOURCE = "semantic-mapper"

DEFAULT_CLASS = "dpa:Dataset"
DEFAULT_CLASSIFICATION = DPA + "classifiedAs"

# Declared column type -> XSD datatype. Anything else is xsd:string.
XSD_LOCAL_BY_TYPE = {
    "BOOLEAN": "boolean",
    "BYTE": "byte",
    "SHORT": "short",
    "INT": "integer",
    "INTEGER": "integer",
    "LONG": "long",
    "FLOAT": "float",
    "DOUBLE": "double",
    "DATE": "date",
    "TIMESTAMP": "dateTime",
    "STRING": "string",
}

# Declared column type -> type name in a catalog column's JSON.
# The two tables differ on INTEGER and BINARY, and both are kept that way.
CATALOG_TYPE = {
    "BOOLEAN": "boolean",
    "BYTE": "byte",
    "SHORT": "short",
    "INT": "integer",
    "LONG": "long",
    "FLOAT": "float",
    "DOUBLE": "double",
    "DATE": "date",
    "TIMESTAMP": "timestamp",
    "STRING": "string",
    "BINARY": "binary",
}

# White space and line ends as Unicode text handling knows them.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
UNUSUAL_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
LINE_BREAK = "\\r\\n|[\\n\\x0b\\x0c\\r\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"

# Lines that belong to no statement (blank ones, comments, prefixes), and
# statements: up to the next full stop that only white space parts from its line's end, or
# up to the end of the text.
_SPACE = "\\t\\x1f\\x20\\xa0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000"
SKIPPED_LINE = rf"(?md)^[{_SPACE}]*+(?:(?:#|@prefix).*+)?(?:\n|\z)"
STATEMENT = rf"(?=[^\n])[^.]*+(?:\.(?![{_SPACE}]*+(?:\n|\z))[^.]*+)*+(?:\.[{_SPACE}]*+)?"

# Patterns that find things in Turtle text (Java regex syntax,
# (?U) makes \s and \w cover all of Unicode).
PREFIX_PATTERN = r"(?U)@prefix\s+([A-Za-z][\w-]*):\s+<([^>]+)>\s*\."
CLASS_PATTERN = (
    r"(?U)(?:^|[;\s])a\s+(?:owl:Class|rdfs:Class"
    r"|<http://www\.w3\.org/2002/07/owl#Class>"
    r"|<http://www\.w3\.org/2000/01/rdf-schema#Class>)"
)
LABEL_PATTERN = r'(?U)rdfs:label\s+"([^"]+)"'
COMMENT_PATTERN = r'(?U)rdfs:comment\s+"([^"]+)"'
MAP_CLASS_PATTERN = r"(?U)rr:class\s+([^\s;\]]+)"
OBJECT_NAME_PATTERN = r'(?U)dpa:unityCatalogObject\s+"([^"]+)"'
LOCATION_PATTERN = r'(?U)dpa:unityCatalogStorageLocation\s+"([^"]+)"'
COLUMN_PATTERN = r'(?U)dpa:unityCatalogColumn\s+"([^"]+)"'
BUCKET_PATTERN = r"(?i)^s3a://([^/?#]+)"

# Characters RFC 3987 lets stand beside the ASCII unreserved ones in an IRI.
UCSCHAR = (
    r"\u00A0-\uD7FF\uF900-\uFDCF\uFDF0-\uFFEF"
    + "".join(rf"\x{{{plane:X}0000}}-\x{{{plane:X}FFFD}}" for plane in range(1, 14))
    + r"\x{E1000}-\x{EFFFD}"
)

# Explorer limits.
FETCH_LIMIT = 100
DRAW_LIMIT = 150

TRIPLE_COLUMNS = ("graph", "s", "p", "o", "o_type", "o_datatype", "o_lang")
