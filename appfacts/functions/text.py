"""Text, URI, signature and hash expressions.  Everything here is a column expression evaluated by Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from appfacts import constants as K
from appfacts.functions.automata import AUTOMATON, accepts, compile_patterns

# Documented URL pattern: scheme, two slashes, then everything up to white space, a quote, a bracket or a back slash.
URL_PATTERN = r"(?:https?|ftp)://[^\s\"'<>()\[\]{}\\]+"


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def parse_intent_uri(uri) -> Column:
    """Struct of scheme, host, port, path of a data URI; the fields are null where the text has no such part.

    ``tel:``/``file:`` and texts without ``://`` only give the scheme.  What follows the first ``=`` is URL-encoded
    before parsing.  A text that is no URI gives nulls.
    """
    u = _col(uri)
    hierarchical = ~u.startswith("tel:") & ~u.startswith("file:") & u.contains("://")
    eq = F.instr(u, "=")
    legal = F.when(eq > 0, F.concat(F.substring(u, F.lit(1), eq), F.url_encode(F.substring(u, eq + 1, F.length(u))))).otherwise(u)

    def part(p):
        return F.nullif(F.try_parse_url(legal, F.lit(p)), F.lit(""))

    scheme = F.when(hierarchical, part("PROTOCOL")).when(u.contains(":"), F.nullif(F.substring_index(u, ":", 1), F.lit("")))
    authority = part("AUTHORITY")
    port = F.nullif(F.regexp_extract(authority, r":(\d+)$", 1), F.lit(""))
    path = part("PATH")
    # The parsed path has its percent escapes decoded; a stray escape keeps the raw text.
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.struct(
        scheme.alias("scheme"),
        F.when(hierarchical, part("HOST")).alias("host"),
        F.when(hierarchical & part("HOST").isNotNull(), port).alias("port"),
        F.when(hierarchical, decoded).alias("path"),
        F.lit(None).cast("string").alias("path_prefix"),
        F.lit(None).cast("string").alias("path_pattern"),
    )


def mime_matches(mimes, mime) -> Column:
    """Filter MIME types against one intent type (see ``data_matches`` for the null rules)."""
    ts, m = _col(mimes), _col(mime)
    shape = r"^(?:[^*/]+|\*)/(?:[^*]+|\*)$"

    def one(t):
        t_tail, m_tail = F.split_part(t, F.lit("/"), F.lit(2)), F.split_part(m, F.lit("/"), F.lit(2))
        return (
            t.rlike(shape)
            & m.rlike(shape)
            & (F.substring_index(t, "/", 1) == F.substring_index(m, "/", 1))
            & ((t_tail == m_tail) | (t_tail == "*") | (m_tail == "*"))
        )

    no_types = F.coalesce(F.size(ts) <= 0, F.lit(True))
    return F.coalesce(F.when(no_types, m.isNull()).otherwise(F.exists(ts, one)), F.lit(False))


def _no_items(a: Column) -> Column:
    return F.coalesce(F.size(a) <= 0, F.lit(True))


# Path patterns come from apps and may be broken expressions: each is compiled before it is used, and one that does not
# compile matches nothing (``rejected_patterns`` lists them).  The expression engine may use stack for each repetition of
# a group, and an overflow would take the executor down: patterns with such groups run as automata, unless they have the
# plain form below.  Possessive repetitions keep the check of the form itself from using the stack.
PLAIN_PATTERN = (
    r"^(?:(?:\\.|\[[^\[\]\\&]+\]|\((?:(?:\\.|[^\\()\[\]{}*+?|^$])[*+?]?)++\)|[^\\()\[\]{}*+?|^$])[*+?]?)*+$"
)
REPEATED_GROUP = r"\)[*+?{]"


def path_pattern(pattern) -> Column:
    """The expression that a path pattern stands for: its Java-string escapes undone."""
    return F.regexp_replace(_col(pattern), r"\\(.)", "$1")


def _whole(expression: Column) -> Column:
    return F.concat(F.lit(r"\A(?:"), expression, F.lit(r")\z"))


def compiles(expression) -> Column:
    """Whether an expression is valid, alone and as a group."""
    e = _col(expression)

    def ok(x):
        return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), x).isNotNull()

    return e.isNotNull() & ok(e) & ok(_whole(e))


def _grouped(expression: Column) -> Column:
    """Whether an expression repeats a group in a way that needs stack."""
    return expression.rlike(REPEATED_GROUP) & ~expression.rlike(PLAIN_PATTERN)


def needs_table(patterns) -> Column:
    """Whether any path pattern has to run as an automaton."""
    return F.coalesce(F.exists(_col(patterns), lambda x: _grouped(path_pattern(x))), F.lit(False))


def pattern_table(patterns) -> Column:
    """Path patterns with automata for those that repeat groups: array of (pattern, automaton).

    Null where no pattern needs one.  It is evaluated in Python, so in a lambda or a join condition a column that holds
    it has to be used.
    """
    p = _col(patterns)
    expressions = F.transform(p, lambda x: F.when(_grouped(path_pattern(x)) & compiles(path_pattern(x)), path_pattern(x)))
    needed = needs_table(p)
    return compile_patterns(F.when(needed, p), F.when(needed, expressions))


def _path_matches(path: Column, pattern: Column, table: Column) -> Column:
    """Whole-path test.  A pattern that repeats groups and has no automaton matches nothing (``undecided_patterns``)."""
    p = path_pattern(pattern)
    return (
        F.when(table.isNotNull(), accepts(table, path))
        .when(p.rlike(PLAIN_PATTERN) | (compiles(p) & ~p.rlike(REPEATED_GROUP)), F.rlike(path, _whole(p)))
        .otherwise(F.lit(False))
    )


def uri_matches(data, uri, table=None) -> Column:
    """Scheme, then authority, then path of an intent URI against a filter's data.

    ``table`` is the column of ``pattern_table`` for the filter's path patterns (made here if it isn't given).
    """
    d, u = _col(data), _col(uri)
    table = pattern_table(d["path_patterns"]) if table is None else _col(table)
    simple = F.transform(d["path_patterns"], lambda p: F.struct(p.alias("pattern"), F.lit(None).cast(AUTOMATON).alias("automaton")))
    schemes, auths = d["schemes"], d["authorities"]
    paths, prefixes, patterns = d["paths"], d["path_prefixes"], d["path_patterns"]
    path = u["path"]
    any_host = F.coalesce(F.exists(auths, lambda a: a["host"].isNotNull()), F.lit(False))
    authority_ok = F.coalesce(
        F.exists(
            auths,
            lambda a: a["host"].eqNullSafe(u["host"])
            & (a["port"].isNull() | F.coalesce(a["port"] == u["port"], F.lit(False))),
        ),
        F.lit(False),
    )
    no_paths = _no_items(paths) & _no_items(prefixes) & _no_items(patterns)
    path_ok = (
        F.coalesce(F.array_contains(paths, path), F.lit(False))
        | F.coalesce(F.exists(prefixes, lambda p: path.startswith(p)), F.lit(False))
        | F.coalesce(F.exists(F.coalesce(table, simple), lambda t: _path_matches(path, t["pattern"], t["automaton"])), F.lit(False))
    )
    return (
        F.when(_no_items(schemes), u["scheme"].isNull())
        .when(~F.coalesce(F.array_contains(schemes, u["scheme"]), F.lit(False)), F.lit(False))
        .when(~any_host, F.lit(True))
        .when(~authority_ok, F.lit(False))
        .when(no_paths, F.lit(True))
        .when(path.isNull(), F.lit(False))
        .otherwise(path_ok)
    )


def uri_part_matches(data, uri, table=None) -> Column:
    """URI half of the data test: a filter without schemes takes no URI, a scheme-less one, ``content:`` or ``file:``."""
    d, u = _col(data), _col(uri)
    no_scheme = _no_items(d["schemes"])
    return F.when(u.isNull(), no_scheme).otherwise(
        uri_matches(d, u, table) | F.coalesce(u["scheme"].isin("content", "file") & no_scheme, F.lit(False))
    )


def data_matches(data, uri, mime, table=None) -> Column:
    """Whole data test: the URI half and the MIME half."""
    return uri_part_matches(data, uri, table) & mime_matches(_col(data)["mimes"], mime)


# --- signatures ---------------------------------------------------------------------------------------------------
def signature_parts(sig) -> Column:
    """Class, method name, sub-signature and parameter text of ``Lpkg/Cls;.name:(params)ret``."""
    s = _col(sig)
    descriptor = F.substring_index(s, ";.", 1)
    sub = F.regexp_extract(s, r";\.([^:]+:\(.*\).+)$", 1)
    return F.struct(
        F.translate(F.regexp_replace(descriptor, r"^L", ""), "/", ".").alias("cls"),
        F.substring_index(sub, ":", 1).alias("name"),
        sub.alias("sub_sig"),
        F.regexp_extract(sub, r"\((.*)\)", 1).alias("params"),
    )


def parameter_types(sig) -> Column:
    """Java names of the object parameters of a signature, e.g. ``['android.os.Bundle', 'int[]', 'int']``."""
    names = {v: k for k, v in K.PRIMITIVE_DESCRIPTORS.items() if k != "void"}
    params = F.regexp_extract(_col(sig), r"\((.*)\)", 1)
    tokens = F.regexp_extract_all(params, F.lit(r"(\[*(?:L[^;]+;|[ZBCSIJFD]))"), F.lit(1))
    prim = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])

    def name(t):
        base = F.ltrim(t, F.lit("["))
        dims = F.length(t) - F.length(base)
        plain = F.when(
            base.startswith("L"), F.translate(F.regexp_extract(base, r"^L(.*);$", 1), "/", ".")
        ).otherwise(F.element_at(prim, base))
        return F.concat(plain, F.repeat(F.lit("[]"), dims))

    return F.transform(tokens, name)


def java_to_jvm_signature(line) -> Column:
    """``<a.B: ret name(p1,p2)> (…)`` to ``La/B;.name:(P1P2)RET``; null when the line has another shape."""
    s = _col(line)
    pattern = r"<([^\s:]+):\s([^\s]+)\s([^\s(]+)\(([^\s)]*)\)>\s+\(.*\)"

    def descriptor(t):
        base = F.regexp_replace(t, r"(\[\])+$", "")
        dims = ((F.length(t) - F.length(base)) / 2).cast("int")
        prim = F.create_map(*[F.lit(x) for kv in K.PRIMITIVE_DESCRIPTORS.items() for x in kv])
        plain = F.coalesce(
            F.try_element_at(prim, base), F.concat(F.lit("L"), F.translate(base, ".", "/"), F.lit(";"))
        )
        return F.concat(F.repeat(F.lit("["), dims), plain)

    cls, ret, name, params = (F.regexp_extract(s, pattern, i) for i in (1, 2, 3, 4))
    args = F.array_join(
        F.transform(F.filter(F.split(params, ","), lambda p: p != ""), descriptor), ""
    )
    return F.when(
        s.rlike(pattern),
        F.concat(
            F.lit("L"), F.translate(cls, ".", "/"), F.lit(";."), name, F.lit(":("), args, F.lit(")"), descriptor(ret)
        ),
    )


# --- text mining --------------------------------------------------------------------------------------------------
def extract_all(text, pattern: str) -> Column:
    """All different matches of a regular expression."""
    return F.array_distinct(F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(0)))


def extract_urls(text) -> Column:
    return extract_all(text, URL_PATTERN)


def url_host(url) -> Column:
    """Host of a URL, null when malformed."""
    return F.try_parse_url(_col(url), F.lit("HOST"))


def count_substring(text, literal: str) -> Column:
    """Occurrences of a literal that do not overlap."""
    t = _col(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(literal), F.lit("")))) / F.lit(len(literal))).cast("int")


def contains_any(text, needles: list[str]) -> Column:
    """True when at least one of a fixed list of needles occurs."""
    t = _col(text)
    out = F.lit(False)
    for n in needles:
        out = out | t.contains(n)
    return out


def string_and_class_literals(code) -> Column:
    """Quoted strings and class literals of a code text, split into class names and bare names.

    A value with a ``.`` after its first character names a class, one without any ``.`` may name a method.
    """
    c = _col(code)
    strings = F.regexp_extract_all(c, F.lit('"([^\n]*)"'), F.lit(1))
    consts = F.regexp_extract_all(c, F.lit(r"constclass\s@type\s\^`([^\n]*)`"), F.lit(1))
    consts = F.transform(
        consts,
        lambda x: F.when(F.instr(x, ";") > 1, F.translate(F.regexp_extract(x, r"^\[*L([^;]*);", 1), "/", ".")).otherwise(x),
    )
    values = F.array_distinct(F.concat(strings, consts))
    return F.struct(
        F.filter(values, lambda v: F.instr(v, ".") == 0).alias("names"),
        F.filter(values, lambda v: F.instr(v, ".") > 1).alias("classes"),
    )


# --- hashes -------------------------------------------------------------------------------------------------------
def fingerprints(der) -> Column:
    """MD5, SHA-1 and SHA-256 of certificate bytes as upper-case hex pairs joined by colons."""

    def pairs(h):
        return F.regexp_replace(F.upper(h), r"(..)(?!$)", "$1:")

    d = _col(der)
    return F.struct(
        pairs(F.md5(d)).alias("md5"), pairs(F.sha1(d)).alias("sha1"), pairs(F.sha2(d, 256)).alias("sha256")
    )


# --- small rules --------------------------------------------------------------------------------------------------
def sanitize_port(port) -> Column:
    return F.replace(_col(port), F.lit("\\ "), F.lit(""))


def normalize_sdk(min_sdk, target_sdk, max_sdk) -> Column:
    """min >= 1, target >= min, max >= target."""
    lo = F.greatest(_col(min_sdk), F.lit(1))
    target = F.greatest(_col(target_sdk), lo)
    return F.struct(lo.alias("min"), target.alias("target"), F.greatest(_col(max_sdk), target).alias("max"))


def intent_kind(component_names, actions, categories, uris, mimes) -> Column:
    """EXPLICIT when only names are known, MIXED when other attributes are known too, IMPLICIT without names."""
    named = F.size(_col(component_names)) > 0
    other = (F.size(_col(actions)) > 0) | (F.size(_col(categories)) > 0) | (F.size(_col(uris)) > 0) | (
        F.size(_col(mimes)) > 0
    )
    return F.when(named & other, "MIXED").when(named, "EXPLICIT").otherwise("IMPLICIT")


def is_implicit(actions, categories, uris, mimes, precise_implicit) -> Column:
    """Any attribute besides names is known, or one could not be resolved."""
    other = (F.size(_col(actions)) > 0) | (F.size(_col(categories)) > 0) | (F.size(_col(uris)) > 0) | (
        F.size(_col(mimes)) > 0
    )
    return other | ~_col(precise_implicit)


def bucket(value, width: int) -> Column:
    return (F.floor(_col(value) / F.lit(width)) * width).cast("bigint")


def int_median(value) -> Column:
    """Aggregate: median with the integer mean of the middle pair, 0 for no rows (values must not be negative)."""
    return F.coalesce(F.floor(F.median(_col(value))), F.lit(0)).cast("bigint")


def problem_category(source_category, sink_category) -> Column:
    """Problem named by a source and a sink category, null when the pair is none."""
    s, k = _col(source_category), _col(sink_category)
    return (
        F.when(s.isin("API_SOURCE", "CALLBACK_SOURCE") & (k == "API_SINK"), "information_theft")
        .when(s.isin("API_SOURCE", "CALLBACK_SOURCE") & (k == "ICC_SINK"), "information_leak")
        .when(s.isin("ICC_SOURCE", "STMT_SOURCE") & (k == "API_SINK"), "capability_leak")
        .when(s.isin("ICC_SOURCE", "STMT_SOURCE") & (k == "ICC_SINK"), "confused_deputy")
    )


def starts_with_any(name, prefixes: list[str]) -> Column:
    n = _col(name)
    out = F.lit(False)
    for p in prefixes:
        out = out | n.startswith(p)
    return out


def is_library_class(class_name) -> Column:
    """True when the class's package begins with a known library prefix."""
    return starts_with_any(class_name, K.LIBRARY_PREFIXES)


def qualify_component_name(name, package) -> Column:
    """Full class name of a component named in a manifest."""
    n, p = _col(name), _col(package)
    first = F.substring(n, 1, 1)
    dotted = F.concat(p, F.lit("."), n)
    return (
        F.when(n.startswith("."), F.concat(p, n))
        .when(first == F.upper(first), dotted)
        .when((F.coalesce(p, F.lit("")) != "") & ~n.contains("."), dotted)
        .otherwise(n)
    )
