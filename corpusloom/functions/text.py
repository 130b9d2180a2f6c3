"""Column functions over text, identifiers, URLs and hashes. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F



def lines(text: Column) -> Column:
    """Lines of a text; one newline at the end starts no line."""
    return F.split(F.regexp_replace(text, r"\n\z", ""), "\n")


def expand_identifiers(text: Column) -> Column:
    """Words of camel-case, snake-case and dotted names, in lower case."""
    spaced = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), r"[_.]+", " ")
    return F.lower(F.trim(F.regexp_replace(spaced, r"[ \t]+", " ")))


def normalize_query(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "))


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def stable_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    """A deterministic id: prefix and the first hex digits of the parts' SHA-256."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length))


def fingerprint(fields: Mapping[str, Column]) -> Column:
    """SHA-256 of ``key=value`` pairs in key order."""
    return F.sha2(F.concat_ws("&", *[F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit(""))) for k, v in sorted(fields.items())]), 256)


def preview(text: Column, limit: int = 320) -> Column:
    """White space collapsed, cut with an ellipsis beyond ``limit`` characters."""
    flat = F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))).otherwise(flat)


def tokens(text: Column) -> Column:
    """ASCII word tokens in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def clean_markdown(text: Column) -> Column:
    """Link texts for links, no emphasis or code marks, white space collapsed."""
    out = F.regexp_replace(text, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[*_`#>]+", ""), r"[ \t\r\n]+", " "))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def normalize_url(url: Column) -> Column:
    """Without fragment and closing slashes."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")


def redact_url(url: Column) -> Column:
    """Without credentials, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"://[^/@]*@", "://")


def redact_secrets(text: Column) -> Column:
    """Values of assignments to secret-looking names, and e-mail addresses, masked."""
    masked = F.regexp_replace(text, r"(?i)((?:api[_-]?key|token|secret|password)\s*[=:]\s*)(\"[^\"]*\"|'[^']*'|[^\s,;]+)", "$1[redacted]")
    return F.regexp_replace(masked, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[redacted]")


def request_path(target: Column) -> Column:
    """A local request path: no scheme or host, no closing slash, ``{}`` for each parameter; null where there is none."""
    path = F.regexp_replace(F.regexp_replace(target, r"[?#].*$", ""), r"(?<=.)/+$", "")
    named = F.regexp_replace(F.regexp_replace(path, r"\{[^}]*\}", "{}"), r"\[[^\]]*\]", "{}")
    return F.when(target.startswith("/") & ~target.startswith("//"), named)


def package_name(specifier: Column) -> Column:
    """The package of an import: two segments if scoped, else one."""
    parts = F.split(specifier, "/")
    return F.when(specifier.startswith("@"), F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise(F.get(parts, F.lit(0)))


def first_match(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """The label of the first rule that holds."""
    out = F.lit(default)
    for condition, label in reversed(rules):
        out = F.when(condition, F.lit(label)).otherwise(out)
    return out


def confidence_bucket(confidence: Column, verified: float, inferred: float) -> Column:
    return F.when(confidence >= verified, "verified").when(confidence >= inferred, "inferred").otherwise("unknown")


def clamp01(x: Column) -> Column:
    """Within 0 and 1, to three places."""
    return F.round(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), 3)


def truncated(text: Column, limit: int) -> Column:
    """Texts above a limit cut to it, with an ellipsis for the last character."""
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))).otherwise(text)


def ignore_regex(rule: str) -> tuple[str, bool]:
    """A rule of an ignore file as a regular expression on paths, and whether it takes back what earlier rules ignored.

    A rule with a slash before its end is meant from the root, others at any depth; ``*`` and ``?`` stay within a
    name, ``**`` goes over directories, and what a rule names is ignored with everything below it. A rule
    that ends in a slash names directories only.
    """
    import re

    back = rule.startswith("!")
    body = rule[1:] if back else rule
    only_directory = body.endswith("/")
    body = body.rstrip("/")
    rooted = "/" in body
    body = body.removeprefix("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] in "*?":
            out, i = out + ("[^/]*" if body[i] == "*" else "[^/]"), i + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("^" if rooted else "(?:^|/)") + out + ("/" if only_directory else "(?:/|$)"), back


def ignored(path: Column, rules: Sequence[str]) -> Column:
    """Whether rules of ignore files, in order, leave a path out; the last one that matches decides, blank and comment lines don't count."""
    out = F.lit(False)
    for rule in rules:
        rule = rule.strip()
        if rule and not rule.startswith("#"):
            pattern, back = ignore_regex(rule)
            out = F.when(path.rlike(pattern), F.lit(not back)).otherwise(out)
    return out


def route_path(path: Column) -> Column:
    """The request path of a route file below ``app/api``; groups in brackets are left out, dynamic and private parts have none."""
    parts = F.split(path, "/")
    at = F.array_position(F.zip_with(parts, F.slice(parts, 2, 1 << 30), lambda a, b: F.coalesce((a == "app") & (b == "api"), F.lit(False))), F.lit(True))
    inside = F.slice(parts, (at + 1).cast("int"), F.greatest(F.size(parts) - at.cast("int") - 1, F.lit(0)))
    named = F.lower(F.element_at(parts, -1)).isin("route.ts", "route.tsx", "route.js", "route.jsx")
    odd = F.exists(inside, lambda p: F.contains(p, F.lit("[")) | F.contains(p, F.lit("]")) | p.startswith("@") | p.startswith("_"))
    kept = F.filter(inside, lambda p: ~(p.startswith("(") & p.endswith(")")))
    return F.when(named & (at > 0) & ~odd, F.concat(F.lit("/"), F.array_join(kept, "/")))


#: Patterns of the concepts that a chunk may show.
CONCEPTS = {"async_await": r"\b(async|await)\b", "promise": r"\bPromise\b", "class": r"\bclass\s+\w+", "generic_type": r"\b\w+\s*<[^>]+>", "exception_handling": r"\b(try|catch|throw)\b", "recursion": r"\bfunction\s+(\w+)[\s\S]*\b\1\s*\("}
#: Patterns of what has to be known to read a chunk, in order of importance.
REQUIRED = {
    "async": r"\basync\b|\bawait\b", "http": r"\bfetch\s*\(|\baxios\.", "state": r"\buseState\s*\(|\bset[A-Z]\w*\s*\(", "storage": r"\b(?:localStorage|sessionStorage)\.", "navigation": r"\b(?:router\.(?:push|replace)|redirect)\s*\(",
    "events": r"\bon(?:Click|Submit|Change)=", "errors": r"\btry\s*\{|\bcatch\s*\(", "conditional": r"\bif\s*\(", "return": r"\breturn\b",
}


def concept_candidates(text: Column, language: Column) -> Column:
    """Concepts that a chunk's text shows, in the rules' order; components only in languages that have them."""
    component = F.when(language.isin("tsx", "jsx") & text.rlike("<[A-Z][A-Za-z0-9]*"), F.lit("react_component"))
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in CONCEPTS.items()], component))


def required_concepts(text: Column, language: Column, most: int = 6) -> Column:
    """What has to be known to read a text, the first few; the order of execution where no rule fits."""
    typed = F.when(language.isin("typescript", "tsx") & text.rlike(r"\w+\s*:\s*[A-Za-z]"), F.lit("types"))
    found = F.slice(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in REQUIRED.items()], typed)), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("sequence")))


def urls(text: Column) -> Column:
    """Sorted distinct values of all url fields in a JSON text, at any depth, normalised."""
    raw = F.regexp_extract_all(text, F.lit(r'"url"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(raw, lambda u: normalize_url(F.replace(u, F.lit("\\/"), F.lit("/"))))))


def usage_of(response: Column, embedding: bool = False) -> dict[str, Column]:
    """Token counts of a provider's response as JSON text; absent ones are 0, and an embedding's input counts apart."""
    at = lambda *paths: F.coalesce(*[F.nullif(F.get_json_object(response, f"$.usage.{p}").cast("bigint"), F.lit(0).cast("bigint")) for p in paths], F.lit(0).cast("bigint"))
    given = at("input_tokens", "prompt_tokens")
    none = F.lit(0).cast("bigint")
    return {
        "input_tokens": none if embedding else given,
        "embedding_tokens": given if embedding else none,
        "cached_input_tokens": at("input_tokens_details.cached_tokens"),
        "output_tokens": at("output_tokens", "completion_tokens"),
        "reasoning_tokens": at("output_tokens_details.reasoning_tokens"),
    }
