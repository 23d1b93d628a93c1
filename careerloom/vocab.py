"""IRIs, fixed names and display constants of the career graph."""

from __future__ import annotations

# Namespaces: our own for resources and terms, public ones otherwise.
RES = "urn:careerloom:resource/"
ONT = "urn:careerloom:ontology#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
SCHEMA = "http://schema.org/"
ESCO = "http://data.europa.eu/esco/"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
XSD = "http://www.w3.org/2001/XMLSchema#"

XSD_STRING = XSD + "string"
XSD_DATE = XSD + "date"
XSD_DATETIME = XSD + "dateTime"
XSD_BOOLEAN = XSD + "boolean"
XSD_DOUBLE = XSD + "double"
NUMERIC_TYPES = (XSD + "double", XSD + "float", XSD + "decimal")

# Node types.
TYPE_IRI = {
    "person": SCHEMA + "Person",
    "job": SCHEMA + "JobPosting",
    "skill": ESCO + "Skill",
    "education": SCHEMA + "EducationalOccupationalCredential",
    "certification": ONT + "Certification",
    "organization": SCHEMA + "Organization",
}

# Predicates.
PREF_LABEL = SKOS + "prefLabel"
ALT_LABEL = SKOS + "altLabel"
DEFINITION = SKOS + "definition"
EXACT_MATCH = SKOS + "exactMatch"
BROADER = SKOS + "broader"
NARROWER = SKOS + "narrower"
RELATED = SKOS + "related"
HAS_JOB = ONT + "hasJob"
HAS_SKILL = ONT + "hasSkill"
HAS_CERT = ONT + "hasCertification"
ALUMNI_OF = SCHEMA + "alumniOf"
HIRING_ORG = SCHEMA + "hiringOrganization"
RECOGNIZED_BY = SCHEMA + "recognizedBy"
USED_SKILL = ONT + "usedSkill"
USED_TECH = ONT + "usedTechnology"
CONFIDENCE = ONT + "confidence"
SOURCE_DOC = ONT + "sourceDocument"
CREATED_AT = ONT + "createdAt"
NAME = SCHEMA + "name"
TITLE = SCHEMA + "title"
START = SCHEMA + "startDate"
END = SCHEMA + "endDate"
IS_CURRENT = ONT + "isCurrent"
ACHIEVEMENT = ONT + "achievement"
CATEGORY = ONT + "skillCategory"
PROFICIENCY = ONT + "proficiencyLevel"
YEARS = ONT + "yearsExperience"
EMAIL = SCHEMA + "email"
ADDRESS = SCHEMA + "address"
DEGREE = SCHEMA + "credentialCategory"
FIELD = SCHEMA + "educationalCredentialAwarded"

CORE_RELATIONS = (HAS_JOB, HAS_SKILL, HAS_CERT, USED_SKILL, HIRING_ORG, ALUMNI_OF, RECOGNIZED_BY)
HIERARCHY_RELATIONS = (BROADER, NARROWER, RELATED)

# Fixed values that results depend on: edge classes, labels and styles.
EDGE_CLASS = {
    HAS_JOB: "ownership",
    HAS_SKILL: "ownership",
    HAS_CERT: "ownership",
    ALUMNI_OF: "ownership",
    HIRING_ORG: "organizational",
    RECOGNIZED_BY: "organizational",
    USED_SKILL: "usage",
    USED_TECH: "usage",
    BROADER: "hierarchical",
    NARROWER: "hierarchical",
    RELATED: "hierarchical",
    RDF_TYPE: "typing",
}
PREDICATE_LABEL = {
    HAS_JOB: "has job",
    HAS_SKILL: "has skill",
    HAS_CERT: "has certification",
    ALUMNI_OF: "alumni of",
    HIRING_ORG: "works at",
    USED_SKILL: "uses skill",
    USED_TECH: "uses tech",
    RECOGNIZED_BY: "from",
    BROADER: "broader than",
    NARROWER: "narrower than",
    RELATED: "related to",
    RDF_TYPE: "type",
}
EDGE_COLOR = {
    "ownership": "#2E7D32",
    "organizational": "#1565C0",
    "usage": "#6A1B9A",
    "hierarchical": "#EF6C00",
    "typing": "#BDBDBD",
    "other": "#757575",
}
EDGE_WIDTH = {"ownership": 3, "organizational": 2, "usage": 2, "hierarchical": 1, "typing": 1, "other": 1}
NODE_COLOR = {
    "person": "#FF6B6B",
    "job": "#4ECDC4",
    "skill": "#45B7D1",
    "education": "#96CEB4",
    "certification": "#FFEAA7",
    "organization": "#DDA15E",
    "unknown": "#95A5A6",
}
NODE_SHAPE = {
    "person": "diamond",
    "job": "box",
    "skill": "ellipse",
    "education": "box",
    "certification": "ellipse",
    "organization": "box",
    "unknown": "dot",
}
NODE_BASE_SIZE = {
    "person": 30,
    "job": 20,
    "organization": 20,
    "skill": 15,
    "education": 15,
    "certification": 15,
    "unknown": 10,
}
BAND_COLOR = {"high": "#2E7D32", "medium": "#F9A825", "low": "#C62828"}
# Fixed display order of the type summary.
TYPE_ORDER = ("person", "job", "organization", "education", "certification", "skill")

# Fixed skill hierarchy by category name (label, broader, narrower).
SKILL_CATEGORIES = {
    "technical": (None, ("programming", "data_science", "cloud_infrastructure", "databases")),
    "programming": ("technical", ("python", "javascript", "java", "sql", "r")),
    "data_science": (
        "technical",
        ("machine_learning", "data_analysis", "statistical_analysis", "data_visualization"),
    ),
    "cloud_infrastructure": ("technical", ("aws", "azure", "docker", "kubernetes")),
    "soft_skills": (None, ("leadership", "communication", "problem_solving", "teamwork")),
}
