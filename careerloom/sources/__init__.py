"""Readers and writers."""

from careerloom.sources.documents import decode_text, document_metadata, scan_documents  # noqa: F401
from careerloom.sources.graph_files import (  # noqa: F401
    jsonld_triples,
    scan_jsonld,
    to_jsonld,
    to_ntriples,
    write_jsonld,
    write_turtle,
)
from careerloom.sources.records import (  # noqa: F401
    scan_entities,
    scan_gold,
    scan_manifest,
    scan_session_index,
    scan_test_run,
    write_entities,
    write_insights,
    write_norm_report,
)
