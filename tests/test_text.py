"""Truth tables of the text, URI and filter expressions."""

import hashlib

from pyspark.sql import functions as F

from appfacts.functions import text as X

DATA = "struct<schemes:array<string>,authorities:array<struct<host:string,port:string>>,paths:array<string>,path_prefixes:array<string>,path_patterns:array<string>,mimes:array<string>>"


def data(schemes=(), authorities=(), paths=(), prefixes=(), patterns=(), mimes=()):
    return (list(schemes), list(authorities), list(paths), list(prefixes), list(patterns), list(mimes))


def table(spark, cases, column, schema):
    """Value of ``column`` for every case (the last item of a case is what is expected)."""
    rows = [(i, *case[:-1]) for i, case in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, " + schema)
    got = {r["id"]: r["v"] for r in df.select("id", column.alias("v")).collect()}
    return [(case, got[i]) for i, case in enumerate(cases)]


def one(spark, column, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


URIS = [
    ("tel:1", ("tel", None, None, None)),
    ("http:", ("http", None, None, None)),
    ("http://h:80/p", ("http", "h", "80", "/p")),
    ("http://h/p?q=a b", ("http", "h", None, "/p")),
    ("http://h", ("http", "h", None, None)),
    ("file:///x", ("file", None, None, None)),
    ("abc", (None, None, None, None)),
    ("http:// bad^", (None, None, None, None)),
    ("content://a/b%20c", ("content", "a", None, "/b c")),
    (None, (None, None, None, None)),
]


def test_parse_intent_uri(spark):
    for case, got in table(spark, URIS, X.parse_intent_uri("u"), "u string"):
        assert (got["scheme"], got["host"], got["port"], got["path"]) == case[-1], case


MIMES = [
    ([], None, True),
    ([], "text/plain", False),
    (["text/*"], "text/plain", True),
    (["text/plain"], "text/*", True),
    (["*/*"], "text/plain", False),
    (["*/*"], "*/png", True),
    (["text/plain"], None, False),
    (["image/png", "text/plain"], "image/png", True),
    (["text"], "text", False),
    (["te*t/x"], "te*t/x", False),
]


def test_mime_matches(spark):
    for case, got in table(spark, MIMES, X.mime_matches("ts", "m"), "ts array<string>, m string"):
        assert got is case[-1], case


U = "struct<scheme:string,host:string,port:string,path:string>"


FILTER_DATA = [
    (data(), None, None, True),
    (data(), ("content", None, None, None), None, True),
    (data(), ("file", None, None, "/x"), None, True),
    (data(), ("http", "h", None, None), None, False),
    (data(), (None, None, None, None), None, True),
    (data(schemes=["http"]), None, None, False),
    (data(schemes=["http"]), ("http", "h", None, None), None, True),
    (data(schemes=["http"]), ("https", "h", None, None), None, False),
    (data(schemes=["http"], authorities=[("h", None)]), ("http", "h", "80", None), None, True),
    (data(schemes=["http"], authorities=[("h", "80")]), ("http", "h", "80", None), None, True),
    (data(schemes=["http"], authorities=[("h", "80")]), ("http", "h", None, None), None, False),
    (data(schemes=["http"], authorities=[("h", None)]), ("http", "g", None, None), None, False),
        # Paths only count next to a host.
    (data(schemes=["http"], paths=["/a"]), ("http", "h", None, "/ab"), None, True),
    (data(schemes=["http"], authorities=[("h", None)], paths=["/a"]), ("http", "h", None, "/a"), None, True),
    (data(schemes=["http"], authorities=[("h", None)], paths=["/a"]), ("http", "h", None, "/ab"), None, False),
    (data(schemes=["http"], authorities=[("h", None)], prefixes=["/a"]), ("http", "h", None, "/ab"), None, True),
    (data(schemes=["http"], authorities=[("h", None)], patterns=["/a.*c"]), ("http", "h", None, "/abc"), None, True),
    (data(schemes=["http"], authorities=[("h", None)], patterns=["/a"]), ("http", "h", None, "/ab"), None, False),
    (data(schemes=["http"], authorities=[("h", None)], patterns=["/.*\\\\.pdf"]), ("http", "h", None, "/x.pdf"), None, True),
    (data(schemes=["http"], authorities=[("h", None)], patterns=["/.*\\\\.pdf"]), ("http", "h", None, "/xpdf"), None, False),
        # Broken expressions match nothing and do not fail the job.
    (data(schemes=["http"], authorities=[("h", None)], patterns=["*.pdf", "(", "[a", "a**"]), ("http", "h", None, "/x.pdf"), None, False),
    (data(schemes=["http"], authorities=[("h", None)], paths=["/a"]), ("http", "h", None, None), None, False),
    (data(mimes=["text/*"]), None, "text/plain", True),
    (data(mimes=["text/*"]), None, None, False),
    (data(), None, "text/plain", False),
]


def test_data_matches(spark):
    column = X.data_matches("d", F.col("u"), F.col("m"))
    for case, got in table(spark, FILTER_DATA, column, f"d {DATA}, u {U}, m string"):
        assert got is case[-1], case


NAMES = [
    (".A", "p.q", "p.q.A"),
    ("A", "p.q", "p.q.A"),
    ("a", "p.q", "p.q.a"),
    ("a.B", "p.q", "a.B"),
    ("a", "", "a"),
]


def test_qualify_component_name(spark):
    for case, got in table(spark, NAMES, X.qualify_component_name("n", F.col("p")), "n string, p string"):
        assert got == case[-1], case


def test_signatures(spark):
    p = one(spark, X.signature_parts("s"), "s string", ("La/B$C;.m:(I[Lx/Y;)V",))
    assert (p["cls"], p["name"], p["sub_sig"], p["params"]) == ("a.B$C", "m", "m:(I[Lx/Y;)V", "I[Lx/Y;")
    types = one(spark, X.parameter_types("s"), "s string", ("La/B;.m:(I[[Lx/Y;JLz/Q$R;[B)V",))
    assert types == ["int", "x.Y[][]", "long", "z.Q$R", "byte[]"]
    java = one(spark, X.java_to_jvm_signature("s"), "s string", ("<a.B: int[] m(java.lang.String,byte)>  (x)",))
    assert java == "La/B;.m:(Ljava/lang/String;B)[I"
    assert one(spark, X.java_to_jvm_signature("s"), "s string", ("<broken>",)) is None


def test_fingerprints(spark):
    got = one(spark, X.fingerprints("d"), "d binary", (b"abc",))
    for field in ("md5", "sha1", "sha256"):
        h = hashlib.new(field, b"abc").hexdigest().upper()
        assert got[field] == ":".join(h[i : i + 2] for i in range(0, len(h), 2))


def test_literals(spark):
    code = 'const "a.B"\nconst "m"\nconstclass @type ^`Lx/Y;`\nconst ".dot"'
    got = one(spark, X.string_and_class_literals("c"), "c string", (code,))
    assert sorted(got["classes"]) == ["a.B", "x.Y"] and got["names"] == ["m"]


def test_problem_category(spark):
    data_problem = {"API_SINK": "information_theft", "ICC_SINK": "information_leak", "STMT_SINK": None}
    control_problem = {"API_SINK": "capability_leak", "ICC_SINK": "confused_deputy", "STMT_SINK": None}
    cases = [
        (source, sink, problems[sink])
        for source, problems in (
            ("API_SOURCE", data_problem), ("CALLBACK_SOURCE", data_problem), ("ICC_SOURCE", control_problem), ("STMT_SOURCE", control_problem),
        )
        for sink in problems
    ]
    for case, got in table(spark, cases, X.problem_category("s", "k"), "s string, k string"):
        assert got == case[-1], case


def test_counts_and_urls(spark):
    assert one(spark, X.count_substring("t", "aa"), "t string", ("aaaaa",)) == 2
    urls = one(spark, X.extract_urls("t"), "t string", ('see http://a.b/c?d="x" and https://e.f, http://a.b/c?d=',))
    assert urls == ["http://a.b/c?d=", "https://e.f,"]
    assert one(spark, X.url_host("t"), "t string", ("http://a.b:8/c",)) == "a.b"
    assert one(spark, X.url_host("t"), "t string", ("http:// bad",)) is None
