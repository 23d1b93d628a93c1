"""Column -> Column functions. All run inside whole-stage codegen unless noted."""

from careerloom.functions.dates import (  # noqa: F401
    dates_within_days,
    duration_months,
    duration_years,
    is_expired,
    parse_any_date,
    parse_any_timestamp,
    parse_partial_date,
)
from careerloom.functions.display import (  # noqa: F401
    confidence_band,
    edge_class,
    edge_color,
    edge_width,
    font_size,
    node_color,
    node_label,
    node_shape,
    node_size,
    predicate_label,
)
from careerloom.functions.scoring import (  # noqa: F401
    edit_similarity,
    is_circular_broader,
    prf,
    ratio,
    taxonomy_match_score,
    title_similarity,
)
from careerloom.functions.text import (  # noqa: F401
    alnum_key,
    bracket_citations,
    case_key,
    content_hash,
    degree_label,
    email_domains,
    first_nonempty,
    iri_local_name,
    match_key,
    mint_iri,
    org_dedup_key,
    org_match_key,
    org_slug,
    recover_json,
    secret_flags,
    strip,
    taxonomy_key,
    url_decode_label,
)
