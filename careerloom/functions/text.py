"""Label keys, identifiers and text probes."""

from __future__ import annotations

from pyspark.sql import Column, types as T
from pyspark.sql import functions as F

from careerloom.vocab import RES

# Every code point that counts as blank at the ends of a label.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)

# Fixed patterns: what counts as a secret, and how an e-mail address looks.
SECRET_PATTERNS = {
    "api_token": r"sk-[A-Za-z0-9_-]{8,}",
    "cloud_key": r"AKIA[0-9A-Z]{16}",
    "repo_token": r"ghp_[A-Za-z0-9]{20,}",
    "private_key": r"BEGIN( RSA| EC)? PRIVATE KEY",
    "key_assignment": r"(?i)api[_-]?key\s*[:=]",
    "national_id": r"\b\d{3}-\d{2}-\d{4}\b",
}
EMAIL_PATTERN = r"[\w.+-]+@[\w-]+\.[\w.]+"
SYNTHETIC_DOMAINS = ("example.com", "example.org")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every kind of Unicode blank, not just the ASCII space."""
    return F.btrim(_c(c), F.lit(BLANKS))


def url_decode_label(c: Column | str) -> Column:
    """Percent-decode; a plus sign stays one, and undecodable text stays whole."""
    c = _c(c)
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def case_key(c: Column | str) -> Column:
    return F.lower(strip(c))


def match_key(c: Column | str) -> Column:
    """Case-folded label with runs of blanks collapsed; null becomes ''."""
    folded = F.lower(strip(F.regexp_replace(_c(c), r"(?U)\s+", " ")))
    return F.coalesce(F.replace(folded, F.lit("ß"), F.lit("ss")), F.lit(""))


def org_match_key(c: Column | str) -> Column:
    """Scoring key of an organization: one legal suffix and a leading 'the' dropped."""
    base = F.regexp_replace(match_key(c), r"[,.]?\s*(inc|llc|ltd|corp|co)\.?$", "")
    return F.regexp_replace(F.btrim(base, F.lit(" ,.")), r"^the ", "")


def org_dedup_key(c: Column | str) -> Column:
    """Identity key of an organization: every trailing legal suffix dropped."""
    base = strip(F.regexp_replace(case_key(c), r"^the ", ""))
    return strip(F.regexp_replace(base, r"(\s*,? (inc|llc|ltd|corp|co)\.?\s*)+$", ""))


def alnum_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", "")


def taxonomy_key(c: Column | str) -> Column:
    return F.replace(F.lower(_c(c)), F.lit(" "), F.lit("_"))


def quote(c: Column | str) -> Column:
    """Percent-encode everything but letters, digits and ``_ . - ~``."""
    q = F.replace(F.url_encode(_c(c)), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(q, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def mint_iri(c: Column | str, namespace: str = RES) -> Column:
    return F.concat(F.lit(namespace), quote(c))


def iri_local_name(c: Column | str, spaces: bool = False) -> Column:
    """Part after '#', else after the last '/', decoded."""
    c = _c(c)
    tail = (
        F.when(c.contains("#"), F.substring_index(c, "#", -1))
        .when(c.contains("/"), F.substring_index(c, "/", -1))
        .otherwise(c)
    )
    name = url_decode_label(tail)
    return F.replace(name, F.lit("_"), F.lit(" ")) if spaces else name


def org_slug(candidate: Column | str, name: Column | str) -> Column:
    """Kebab-case organization id; template left-overs in the candidate are ignored."""
    cand = strip(F.coalesce(_c(candidate), F.lit("")))
    junk = cand.contains("{{") | cand.contains("}}") | F.lower(cand).contains("uuid")
    cand = F.when(junk, F.lit("")).otherwise(cand)
    cand = F.lower(F.btrim(F.regexp_replace(cand, "[^a-zA-Z0-9_-]+", "-"), F.lit("-")))
    nm = F.lower(strip(F.coalesce(_c(name), F.lit(""))))
    nm = F.btrim(F.regexp_replace(nm, "[^a-z0-9]+", "-"), F.lit("-"))
    base = F.coalesce(F.nullif(cand, F.lit("")), F.nullif(nm, F.lit("")))
    return F.when(base.startswith("org-"), base).otherwise(F.concat(F.lit("org-"), base))


def degree_label(degree: Column | str, field: Column | str, institution: Column | str) -> Column:
    """'degree in field', the non-empty one of both, 'Degree at x', or 'Education'."""
    d, f = F.nullif(strip(degree), F.lit("")), F.nullif(strip(field), F.lit(""))
    inst = F.nullif(strip(institution), F.lit(""))
    return F.coalesce(
        F.nullif(F.concat_ws(" in ", d, f), F.lit("")),
        F.concat(F.lit("Degree at "), inst),
        F.lit("Education"),
    )


def first_nonempty(*cols: Column | str) -> Column:
    return F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in cols])


def content_hash(c: Column | str) -> Column:
    return F.md5(_c(c).cast("binary"))


def bracket_citations(c: Column | str) -> Column:
    """All ``[...]`` spans of a text."""
    return F.regexp_extract_all(_c(c), F.lit(r"\[([^\[\]]*)\]"), F.lit(0))


def secret_flags(c: Column | str) -> dict[str, Column]:
    return {name: _c(c).rlike(pattern) for name, pattern in SECRET_PATTERNS.items()}


def email_domains(c: Column | str) -> Column:
    """Domain of every e-mail address in a text."""
    hits = F.regexp_extract_all(_c(c), F.lit(EMAIL_PATTERN), F.lit(0))
    return F.transform(hits, lambda e: F.rtrim(F.substring_index(e, "@", -1), F.lit(".")))


def recover_json(c: Column | str, schema: T.StructType | str) -> Column:
    """Parse a model reply: as it is, without code fences, or its outermost object.

    Null where none of the three parses.
    """
    text = strip(F.coalesce(_c(c), F.lit("")))
    fenced = strip(F.regexp_replace(F.regexp_replace(text, r"^```(json)?", ""), r"```$", ""))
    outer = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    pick = F.coalesce(
        *[F.when(F.try_parse_json(cand).isNotNull() & cand.startswith("{"), cand) for cand in (text, fenced, outer)]
    )
    return F.from_json(pick, schema)
