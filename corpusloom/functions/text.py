"""Scalar text functions as Column expressions; everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of headings by kind, in the order in which kinds are tried.
HEADING_KINDS = [
    ("always", ["abstract", "introduction", "conclusion", "conclusions"]),
    ("method", ["method", "methods", "approach", "model", "architecture", "proposed"]),
    ("results", ["experiment", "experiments", "result", "results", "evaluation", "ablation"]),
    ("limits", ["limitation", "limitations", "discussion", "future work"]),
    ("related", ["related work", "related works", "prior work", "background", "literature"]),
    ("appendix", ["appendix", "supplement", "supplementary", "supplemental"]),
    ("biblio", ["reference", "references", "bibliography", "acknowledgment", "acknowledgements"]),
]
#: Reading order of kinds under a budget.
HEADING_PRIORITY = {"always": 0, "method": 1, "results": 2, "limits": 3, "related": 4, "other": 5, "appendix": 6, "biblio": 7}
# Signatures of files by kind, as kind, place of the first byte from 1, bytes.
SIGNATURES = [("pdf", 1, b"%PDF"), ("gzip", 1, b"\x1f\x8b"), ("tar", 258, b"ustar")]


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_text(x) -> Column:
    """Soft hyphens dropped, words joined over hyphenated breaks, white space collapsed and trimmed."""
    t = F.replace(_col(x), F.lit("­"), F.lit(""))
    t = F.regexp_replace(t, r"(?U)(\w)-\s+(\w)", "$1$2")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def normalize_heading(x) -> Column:
    t = F.regexp_replace(F.lower(_col(x)), r"(?U)^(appendix|section|chapter)\s+", "")
    t = F.regexp_replace(t, r"^[\d.]+\s*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9\s]", " "), r"\s+", " "))


def heading_kind(x) -> Column:
    """Kind of a section by the first list with a word inside the normalised heading, else other."""
    norm = normalize_heading(x)
    out = None
    for kind, words in HEADING_KINDS:
        hit = norm.rlike("|".join(words))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("other")


def heading_priority(kind) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for pair in HEADING_PRIORITY.items() for v in pair]), _col(kind))


def headings_match(a, b) -> Column:
    """Equal after normalising, or one inside the other; empty headings match nothing."""
    x, y = normalize_heading(a), normalize_heading(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def sentence_parts(x) -> Column:
    """Pieces between sentence ends: after . ! ? and before a capital ASCII letter or a digit, normalised."""
    return F.filter(F.split(normalize_text(x), r"(?<=[.!?])\s+(?=[A-Z0-9])"), lambda s: s != "")


def id_core(x) -> Column:
    """A paper id without address and version."""
    return F.regexp_replace(_address_free(x), r"(?i)v\d+$", "")


def id_version(x) -> Column:
    """The version a paper id ends with, such as v2, or null."""
    return F.lower(F.regexp_substr(_address_free(x), F.lit(r"(?i)v\d+$")))


def _address_free(x) -> Column:
    t = F.regexp_replace(F.trim(_col(x)), r"^.*arxiv\.org/(?:abs|e-print)/", "")
    t = F.regexp_replace(t, r"^.*arxiv\.org/pdf/(.*?)(?:\.pdf)?$", "$1")
    return F.trim(F.regexp_replace(t, r"^(?:https?://)?(?:arxiv\.org/)?", ""))


def format_version(x) -> Column:
    """v1 for null and blank, vN for N, vN and VN, other text as it is."""
    return F.regexp_replace(F.coalesce(F.nullif(F.trim(_col(x)), F.lit("")), F.lit("v1")), r"^[vV]?(\d+)$", "v$1")


def version_number(x) -> Column:
    """The number in a version, 0 for other text."""
    return F.coalesce(F.regexp_extract(format_version(x), r"^v(\d+)$", 1).try_cast("int"), F.lit(0))


def paper_key(core_or_id, version=None) -> Column:
    """Versionless id and vN; a given version wins over the one in the id."""
    given = F.nullif(F.trim(_col(version)), F.lit("")) if version is not None else F.lit(None).cast("string")
    return F.concat(id_core(core_or_id), format_version(F.coalesce(given, id_version(core_or_id))))


def lenient_int(x) -> Column:
    """Whole part of a number in any form; null for null, NaN and text that is no whole number."""
    c = _col(x)
    return c.try_cast("int")


def clip(x, most: int) -> Column:
    """At most `most` characters, the last an ellipsis if something was cut."""
    return F.when(F.length(_col(x)) <= most, _col(x)).otherwise(F.concat(F.rtrim(F.left(_col(x), F.lit(most - 1))), F.lit("…")))


def trim_to_blank(x, most: int) -> Column:
    """At most `most` characters, cut back to the last blank."""
    return F.when(F.length(_col(x)) <= most, _col(x)).otherwise(F.regexp_replace(F.left(_col(x), F.lit(most)), r" [^ ]*$", ""))


def escape_markdown(x) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(x), r"([\\`*_{}\[\]()#+!|<>-])", r"\\$1"), r"[\r\n]+", " ")


def estimate_tokens(x) -> Column:
    """UTF-8 bytes and 64."""
    return F.octet_length(_col(x)) + 64


def short_hash(n: int, *parts) -> Column:
    return F.left(F.sha2(F.concat_ws("|", *[_col(p) for p in parts]), 256), F.lit(n))


def extract_json(x) -> Column:
    """The outermost {...} of a model's answer, without fences; null if there is none."""
    return F.nullif(F.regexp_extract(_col(x), r"(?s)\{.*\}", 0), F.lit(""))


def rfc_timestamp(x) -> Column:
    """Timestamp of an RFC 2822 date such as `Mon, 2 Apr 2007 19:18:42 GMT`."""
    return F.try_to_timestamp(F.regexp_replace(_col(x), r"^\w+,\s*", ""), F.lit("d MMM yyyy HH:mm:ss z"))


def year_of(created, core) -> Column:
    """Year of a date, else the one in a YYMM id: below 50 means 20yy."""
    yy = F.regexp_extract(_col(core), r"^(\d\d)\d\d\.", 1).try_cast("int")
    return F.coalesce(F.year(rfc_timestamp(created)), F.when(yy < 50, 2000 + yy).otherwise(1900 + yy))


def retry_seconds(header, now) -> Column:
    """Seconds to wait: a number as it is, a date as the time until it, never negative; null for other text."""
    until = F.unix_timestamp(rfc_timestamp(header)) - F.unix_timestamp(_col(now))
    return F.greatest(F.coalesce(_col(header).try_cast("double"), until.cast("double")), F.lit(0.0))


def sniff(content) -> Column:
    """Kind of a payload by its first bytes: pdf, gzip, tar, html, tex (a backslash after white space) or unknown; null for null."""
    c = _col(content).cast("binary")
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for kind, at, signature in SIGNATURES:
        out = out.when(F.substring(c, at, len(signature)) == F.lit(signature), kind)
    head = F.lower(F.decode(F.substring(c, 1, 256), "ISO-8859-1"))
    blanks = r"^[ \t\n\r\x0b\f]*"
    out = out.when(head.rlike(blanks + "<!doctype") | F.contains(head, F.lit("<html")), "html")
    return out.when(F.decode(c, "ISO-8859-1").rlike(blanks + r"\\"), "tex").otherwise("unknown")


def redact(x, secrets: list[str]) -> Column:
    """Text with each secret of four characters or more replaced."""
    out = _col(x)
    for s in sorted({s for s in secrets if s and len(s) >= 4}, key=lambda s: (-len(s), s)):
        out = F.replace(out, F.lit(s), F.lit("[redacted]"))
    return out


def l2_normalize(v) -> Column:
    """A vector divided by its length, which counts as 1e-12 at least."""
    length = F.sqrt(F.aggregate(F.transform(_col(v), lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x))
    return F.transform(F.arrays_zip(_col(v).alias("x"), F.array_repeat(length, F.size(_col(v))).alias("n")), lambda z: z.getField("x") / F.greatest(z.getField("n"), F.lit(1e-12)))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def blended_confidence(grounded, local) -> Column:
    """The confidence of what a model wrote, and a twentieth of the local one more; 1 at most, three digits. A null local one counts as 0."""
    return F.round(F.least(F.lit(1.0), _col(grounded) + 0.05 * F.coalesce(_col(local), F.lit(0.0))), 3)


def grounding_confidence(pdf, abstract_only, proposed, kept) -> Column:
    """1, less 0.1 for pdf, 0.35 for an abstract alone and a quarter of what was not kept; within 0 and 1, three digits."""
    lost = F.when(_col(proposed) > 0, 1 - _col(kept) / _col(proposed)).otherwise(F.lit(0.0))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - F.when(_col(pdf), 0.1).otherwise(0.0) - F.when(_col(abstract_only), 0.35).otherwise(0.0) - 0.25 * lost)), 3)
