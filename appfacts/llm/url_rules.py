"""URL rules found through their rarest literal token; DataFrame operations only.

A rule is a regular expression that stands for a pattern such as ``example.com/en/`` or ``*casino*``.  Each rule is
stored under that of its literal tokens which the fewest URLs have.  A URL fetches the rules stored under its own tokens
by an equality join, and only those rules' expressions run on it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from appfacts.session import local_table

#: Rules whose result is given, as (verdict, rule).
BASE_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]

#: Rules of the method's own for URLs that no rule above fits: words in host or path.
WORD_RULES = [
    ("block", word)
    for word in ("casino", "bets", "pills", "viagra", "porn", "xxx", "escort", "payday", "jackpot", "torrent")
]

TOKEN = "[^a-z0-9]+"


def host_of(url: Column) -> Column:
    """Lower-cased part between the first ``://`` and the next ``/``, ``?`` or ``#``; empty without ``://`` or url."""
    rest = F.when(url.contains("://"), F.substring_index(F.concat(_after(url), F.lit("#")), "#", 1))
    for mark in "/?":
        rest = F.substring_index(rest, mark, 1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(rest, letters, letters.lower()), F.lit(""))


def _after(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def path_of(url: Column) -> Column:
    """From the first ``/`` behind the host up to ``?`` or ``#``; empty if there is none."""
    rest = F.when(url.contains("://"), _after(url))
    for mark in "#?":
        rest = F.substring_index(rest, mark, 1)
    return F.coalesce(F.when(rest.contains("/"), F.substring(rest, F.instr(rest, "/"), F.length(rest))), F.lit(""))


def compile_prefix(rule: str) -> tuple[str, list[str]]:
    """Expression over ``host + path`` of a host-and-path rule, and the tokens that every URL it fits has.

    The last piece of the path may go on in the URL, so it is no token unless a separator ends it.
    """
    host, slash, path = rule.partition("/")
    path = slash + path
    whole = path[: max((m.end() for m in re.finditer(TOKEN, path.lower())), default=0)]
    tokens = [t for t in re.split(TOKEN, f"{host} {whole}".lower()) if t]
    return rf"(?s)^(?:[^/]*\.)?{_quoted(host + path)}", tokens


def compile_word(word: str) -> tuple[str, list[str]]:
    """Expression and tokens of a rule that fits a whole token anywhere in host or path."""
    return rf"(?is)(?:^|[^a-z0-9]){_quoted(word)}(?:[^a-z0-9]|$)", [t for t in re.split(TOKEN, word.lower()) if t]


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    words: list[tuple[str, str]],
    default: str = "allow",
    url: str = "url",
    keep: list[str] | None = None,
) -> DataFrame:
    """host, path, rule and verdict for every row of ``pages``; ``keep`` are its columns to return (all without it).

    The longest rule that fits wins, ties by the rule's text.  Where none fits, a word rule gives the verdict but no
    rule, and else ``default``.  Null URLs and those without ``://`` have empty host and path, so rules don't fit.
    Repeated rows stay repeated.  The rules are a list of the caller's; the table of them is broadcast while small
    (``local_table``), else joined by shuffle.  Rules without a token are tried on every URL.
    """
    rows = []
    for kind, made, compiler in ((1, rules, compile_prefix), (0, words, compile_word)):
        for verdict, rule in made:
            pattern, tokens = compiler(rule)
            rows.append((kind, len(rule), rule, verdict, pattern, tokens or [""]))
    book = local_table(
        pages.sparkSession,
        [(*r[:5], t) for r in rows for t in sorted(set(r[5]))],
        "kind int, size int, rule string, verdict string, pattern string, token string",
    )
    # Pages are judged by their different URLs; a URL that fills a third of the table is one row here.
    urls = pages.where(F.col(url).isNotNull()).groupBy(F.col(url).alias("__url")).agg(F.count(F.lit(1)).alias("__n"))
    site = urls.select("__url", "__n", F.concat(host_of(F.col("__url")), path_of(F.col("__url"))).alias("__site"))
    site = site.where(F.col("__site") != "")
    tokens = site.withColumn(
        "token", F.explode(F.array_distinct(F.split(F.concat(F.lit(" "), F.lower("__site")), TOKEN)))
    )
    # How many pages have each token that occurs in rules, over all pages; at most as many rows as the rules have tokens.
    common = (
        tokens.join(book.select("token").distinct(), "token").groupBy("token").agg(F.sum("__n").alias("__pages"))
    )
    index = (
        book.join(F.broadcast(common) if len(rows) <= 100_000 else common, "token", "left")
        .groupBy("kind", "size", "rule", "verdict", "pattern")
        .agg(F.min(F.struct(F.coalesce("__pages", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    )
    fetched = tokens.join(F.broadcast(index) if len(rows) <= 100_000 else index, "token")
    best = (
        fetched.where(F.regexp("__site", F.col("pattern")))
        .groupBy("__url")
        .agg(F.max(F.struct("kind", "size", "rule", "verdict")).alias("__best"))
    )
    out = pages.select(*[F.col(f"`{c}`") for c in keep or pages.columns if c not in ("host", "path", "rule", "verdict")], F.col(url).alias("__url"))
    fits = F.col("__best.kind") == 1
    return out.join(best, "__url", "left").select(
        *[F.col(f"`{c}`") for c in out.columns if c != "__url"],
        host_of(F.col("__url")).alias("host"),
        path_of(F.col("__url")).alias("path"),
        F.when(fits, F.col("__best.rule")).alias("rule"),
        F.coalesce("__best.verdict", F.lit(default)).alias("verdict"),
    )
