"""Text functions as columns: normalising, hashing, tokens, identifiers, slugs, routes, validation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- normalising

#: White space at the end of a line, in Unicode.
_TRAILING = r"(?U)[\s&&[^\n]]+(?=\n|\z)"
_ENDS = r"(?U)\A\s+|\s+\z"


def normalize_content(text: Column) -> Column:
    """CRLF to LF, no white space at line ends or around the whole; null is the empty text."""
    lf = F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    return F.regexp_replace(F.regexp_replace(lf, _TRAILING, ""), _ENDS, "")


def content_hash(text: Column) -> Column:
    """SHA-256 of the normalised text, in hexadecimal."""
    return F.sha2(normalize_content(text), 256)


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def truncated(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


# ---------------------------------------------------------------- tokens


def tokens(text: Column, least: int = 2) -> Column:
    """Lower-case runs of letters, digits and underscores of at least `least` characters, in order."""
    # \w alone says the same; most characters are found faster among the named ones.
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^a-z0-9_\w]+"), lambda x: F.length(x) >= least)


def counted(words: Column) -> Column:
    """(term, tf) of each different one of an array of words without nulls, in order: how often it stands there; null without words."""
    one = lambda v, f: F.get(F.transform(F.array(v), f), F.lit(0))

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return one(starts, lambda b: F.transform(b, lambda at, k: F.struct(F.get(s, at).alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s)) - at).alias("tf"))))

    return one(F.sort_array(words), lambda s: F.when(F.size(s) > 0, runs(s)))


#: What a name in code looks like (fixed value).
IDENTIFIER = r"\b[A-Z][A-Za-z0-9]*[a-z][A-Za-z0-9]*\b"


def identifiers(text: Column, most: int = 20) -> Column:
    """Distinct words that look like CamelCase names, in the order first seen, `most` at most."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0))
    return F.slice(F.array_distinct(found), 1, most)


# fixed values: beginnings of lines that read like instructions
INSTRUCTION_LINES = (
    r"^\s*<system\b",
    r"^\s*<user\b",
    r"^\s*ignore\s+(all\s+)?(previous|prior|above)\s+instructions",
    r"^\s*disregard\s+(all\s+)?(previous|prior|above)",
    r"^\s*you\s+are\s+now\b",
    r"^\s*forget\s+(all\s+)?(previous|prior)",
    r"^\s*system\s+instruction",
)


#: What ends a line, the form feed and Unicode's separators included, so that no instruction hides behind one.
LINE_END = r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])"


def sanitize_lines(text: Column) -> Column:
    """The text without the lines that read like instructions, its lines joined by line feeds; a line end at the end goes."""
    # (?U): white space and letters of all of Unicode.
    pattern = "(?iU)" + "|".join(f"(?:{p})" for p in INSTRUCTION_LINES).replace(r"\s", r"[\s\x1f]")
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), LINE_END + r"\z", ""), LINE_END)
    return F.array_join(F.filter(lines, lambda x: ~x.rlike(pattern)), "\n")


def source_key(path: Column, title: Column) -> Column:
    """The last part of a path with either slash, else the trimmed title, else null."""
    name = F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), blank_to_null(title))


# ---------------------------------------------------------------- slugs


def decomposed(text: Column) -> Column:
    """Letters and their marks apart (NFD), which Spark has no function for."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: None if x is None else unicodedata.normalize("NFD", x))

    return run(text)


def slugify(name: Column, most: int = 140, decompose: bool = True) -> Column:
    """A name in a-z, 0-9 and single dashes, at most `most` long; `project` where nothing is left.

    Letters with marks lose the marks (decompose, which needs Python as Spark has no such function); other characters beyond ASCII go.
    """
    text = decomposed(name) if decompose else name
    dashed = F.translate(F.lower(F.regexp_replace(text, r"[^A-Za-z0-9\-_. ]", "")), "_. ", "---")
    single = F.regexp_replace(F.regexp_replace(dashed, "-{2,}", "-"), "^-+|-+$", "")
    return F.rtrim(F.substring(F.when(single == "", F.lit("project")).otherwise(single), 1, most), F.lit("-"))


# ---------------------------------------------------------------- routes

# fixed values: attribute names and the verbs they stand for, in order of precedence
VERBS = (("HttpGet", "GET"), ("HttpPost", "POST"), ("HttpPut", "PUT"), ("HttpPatch", "PATCH"), ("HttpDelete", "DELETE"))


def http_verb(signature: Column) -> Column:
    out = F.lit(None).cast("string")
    for token, verb in reversed(VERBS):
        out = F.when(signature.contains(token), F.lit(verb)).otherwise(out)
    return out


def _slashless(text: Column) -> Column:
    return F.regexp_replace(text, "^/+|/+$", "")


def controller_route(signature: Column) -> Column:
    """The text in Route("..."), null without one."""
    return F.nullif(_slashless(F.regexp_extract(signature, r'Route\(\s*"([^"]+)"', 1)), F.lit(""))


def full_route(prefix: Column, signature: Column) -> Column:
    part = _slashless(F.regexp_extract(F.coalesce(signature, F.lit("")), r'Http(?:Get|Post|Put|Patch|Delete)\(\s*"([^"]+)"', 1))
    kept = F.filter(F.array(_slashless(F.coalesce(prefix, F.lit(""))), part), lambda x: F.trim(x) != "")
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def request_type(parameters: Column) -> Column:
    return F.get(F.filter(parameters, lambda p: ~p.contains("CancellationToken")), F.lit(0))


def response_type(return_type: Column) -> Column:
    return F.when(return_type.startswith("Task<"), F.regexp_extract(return_type, r"^Task<(.*).$", 1)).otherwise(return_type)


# ---------------------------------------------------------------- symbols


def project_of(path: Column) -> Column:
    """src/X/... is X, else the first folder, null for a bare name."""
    parts = F.split(path, "/")
    return F.when((F.get(parts, F.lit(0)) == "src") & (F.size(parts) >= 3), F.get(parts, F.lit(1))).when(F.size(parts) > 1, F.get(parts, F.lit(0)))


def declaring_type(fqn: Column) -> Column:
    return F.regexp_extract(F.substring_index(fqn, "(", 1), r"^(.*)\.[^.]*$", 1)


def declaration_header(text: Column, most: int = 14) -> Column:
    """The lines before the one that opens the body, `most` at most."""
    lines = F.split(text, "\n")
    body = F.array_position(F.transform(lines, lambda x: F.trim(x).startswith("{")), F.lit(True)).cast("int")
    return F.array_join(F.slice(lines, F.lit(1), F.least(F.when(body > 0, body - 1).otherwise(F.size(lines)), F.lit(most))), "\n")


def normalized_path(path: Column) -> Column:
    return F.lower(F.ltrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/")))


def literal_hints(text: Column) -> Column:
    """(endpoints, timeout, retry): string literals that are paths, five at most; the first that names a timeout; the first that names retrying."""
    literals = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit('"([^"]*)"'), F.lit(1))
    ends = F.slice(F.filter(literals, lambda x: x.startswith("/") | x.startswith("v1/")), 1, 5)
    first = lambda p: F.get(F.filter(literals, p), F.lit(0))
    return F.struct(ends.alias("endpoints"), first(lambda x: F.lower(x).contains("timeout")).alias("timeout"), first(lambda x: F.lower(x).contains("retr")).alias("retry"))


# ---------------------------------------------------------------- validation


def repository_url_valid(url: Column) -> Column:
    t = F.trim(F.coalesce(url, F.lit("")))
    low = F.lower(t)
    web = low.rlike(r"^https?://[^/\s?#]+")
    local = ~t.startswith("/") & ~t.contains("\\") & ~t.contains(" ") & ~t.contains("..") & ~t.contains("://") & (F.substring(t, 2, 1) != ":")
    return F.when((t == "") | (F.length(F.coalesce(url, F.lit(""))) > 500), F.lit(False)).when(low.rlike("^https?://"), web).when(t.startswith("git@"), t.contains(":") & ~t.contains(" ")).when(low.startswith("file://"), ~t.contains(" ")).otherwise(local)


def safe_identifier(value: Column) -> Column:
    return ~value.contains("..") & ~value.rlike("[/\\\\:;|$`\"'<>\n\r]") & ~F.lower(value).rlike("^(file|http)")


# fixed values: failure codes and their categories; all others are INTERNAL
FAILURE_CATEGORIES = {"AI_VALIDATION_FAILED": "VALIDATION", "LLM_RATE_LIMITED": "RATE_LIMIT", "AI_TIMEOUT": "TIMEOUT", "AI_UNAVAILABLE": "AI_PROVIDER", "JOB_TIMEOUT": "TIMEOUT", "TOOL_CALL_LIMIT_EXCEEDED": "VALIDATION"}


def failure_category(code: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in FAILURE_CATEGORIES.items() for x in pair))
    return F.coalesce(F.element_at(known, F.coalesce(code, F.lit(""))), F.lit("INTERNAL"))


def backoff(base: Column, attempt: Column, cap: Column) -> Column:
    return F.least(cap, base * F.pow(F.lit(2.0), attempt))


# ---------------------------------------------------------------- change previews


def diff_preview(base: Column, target: Column, most: int = 20_000) -> Column:
    """Both texts' lines between their common beginning and end, with a header; a text alone is itself; null for equal texts."""
    one = lambda v, f: F.get(F.transform(F.array(v), f), F.lit(0))
    lines = lambda t: F.split(F.replace(t, F.lit("\r\n"), F.lit("\n")), "\n")

    def same_prefix(a: Column, b: Column, most: Column) -> Column:
        equal = F.zip_with(F.slice(a, F.lit(1), most), F.slice(b, F.lit(1), most), lambda x, y: x == y)
        at = F.array_position(equal, F.lit(False)).cast("int")
        return F.when(at > 0, at - 1).otherwise(most)

    def preview(a: Column, b: Column) -> Column:
        shared = F.least(F.size(a), F.size(b))

        def after_start(s: Column) -> Column:
            def parts(e: Column) -> Column:
                na, nb = F.size(a) - s - e, F.size(b) - s - e
                head = F.concat(F.lit("@@ -"), s + 1, F.lit(","), na, F.lit(" +"), s + 1, F.lit(","), nb, F.lit(" @@"))
                minus = F.transform(F.slice(a, s + 1, na), lambda x: F.concat(F.lit("-"), x))
                plus = F.transform(F.slice(b, s + 1, nb), lambda x: F.concat(F.lit("+"), x))
                return F.substring(F.array_join(F.concat(F.array(head), minus, plus), "\n"), 1, most)

            return one(same_prefix(F.reverse(a), F.reverse(b), shared - s), parts)

        return one(same_prefix(a, b, shared), after_start)

    both = one(lines(base), lambda a: one(lines(target), lambda b: preview(a, b)))
    return F.when(base.isNull(), truncated(target, most)).when(target.isNull(), truncated(base, most)).when(base == target, F.lit(None).cast("string")).otherwise(both)
