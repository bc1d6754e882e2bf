"""Column builders for text: trigrams, tokens, highlights, paths, normalisation."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How path segments that vary are named.
ENDPOINT_RULES = (
    (r"(?i)/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "/:uuid"),
    (r"(?i)/[0-9a-f]{32,}", "/:hash"),
    (r"/[0-9]+", "/:id"),
)

TOKEN = "[a-zA-Z0-9\\u00C0-\\u024F]"


def let(value: Column, use) -> Column:
    """use(value), value being found once; the same expression at several places, or inside a lambda, would be found anew each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trigrams(text: Column) -> Column:
    """Distinct 3-grams of the lower-cased words, each padded by two blanks before and one after."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    padded = F.transform(F.array_distinct(words), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def array_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct members, 0.0 where both are empty."""

    def share(a: Column) -> Column:
        return let(F.size(F.array_intersect(a, b)), lambda both: F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0)))

    return let(a, share)


def trgm_similarity(a: Column, b: Column) -> Column:
    return array_similarity(trigrams(a), trigrams(b))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters (Latin) and digits, as the reranker counts them."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN}+)"), F.lit(1))


def mark(text: Column, query_tokens: list[str]) -> Column:
    """text with each query token of two or more characters in <mark> tags, in any case."""
    kept = [t for t in query_tokens if len(t) >= 2]
    if not kept:
        return text
    return F.regexp_replace(text, f"(?i)({'|'.join(kept)})", "<mark>$1</mark>")


def normalize_endpoint(path: Column) -> Column:
    for pattern, to in ENDPOINT_RULES:
        path = F.regexp_replace(path, pattern, to)
    return path


def short_hash(text: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.left(F.sha2(text, 256), F.lit(16))


def normalize_path(path: Column) -> Column:
    """Trimmed, forward slashes, no empty and no '.' parts."""
    parts = F.split(F.regexp_replace(F.trim(path), r"\\", "/"), "/")
    return F.array_join(F.filter(parts, lambda p: (p != "") & (p != ".")), "/")


def safe_path(path: Column) -> Column:
    """Relative, without NUL and without a part '..'."""
    bad = path.isNull() | (path == "") | path.contains("\0") | path.rlike(r"^[/\\]|^[A-Za-z]:[/\\]") | path.rlike(r"(^|[/\\])\.\.([/\\]|$)")
    return ~bad


def binary_like(text: Column) -> Column:
    """NUL, or more than 0.3 of the first 8192 characters neither printable ASCII nor usual white space."""
    head = F.left(text, F.lit(8192))
    odd = F.length(F.regexp_replace(head, r"[\x20-\x7E\t\n\r]", ""))
    return F.coalesce(head.contains("\0") | (F.try_divide(odd, F.length(head)) > 0.3), F.lit(False))


def pad_preview(text: Column, n: int = 300) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def age_text(seconds: Column) -> Column:
    """'42s ago', '5m ago' or '3h ago'."""
    s = seconds.cast("long")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s ago"))).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m ago"))).otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago")))


def severity(level: Column) -> Column:
    """One of error, warning, info, debug for the many ways in which logs write levels."""
    low = F.lower(F.coalesce(level, F.lit("")))
    return F.when(low.rlike("err|crit|fatal|emerg|panic"), "error").when(low.contains("warn"), "warning").when(low.rlike("info|notice"), "info").when(low.rlike("debug|trace"), "debug").otherwise("info")


def status_class(status: Column) -> Column:
    return F.when(status >= 500, "5xx").when(status >= 400, "4xx").when(status >= 300, "3xx").when(status >= 200, "2xx").otherwise("other")


def service_component(service: Column) -> Column:
    s = F.coalesce(service, F.lit("unknown"))
    return F.when(s.contains("api"), "backend-api").when(s.contains("mcp"), "mcp-server").when(s.rlike("worker|conversation"), "background-worker").otherwise(s)


def noise_log(path: Column, method: Column, status: Column) -> Column:
    """Successful health probes and preflight requests."""
    probe = path.isin("/health", "/healthz", "/ready", "/favicon.ico") & (status == 200)
    return F.coalesce(probe, F.lit(False)) | F.coalesce(method == "OPTIONS", F.lit(False))
