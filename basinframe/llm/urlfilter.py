r"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host with a path (``example.net/en/`` fits that host and its subdomains if the path starts so) or a pattern in
the public filter-list notation: ``||`` a host's start, ``|`` an end of the url, ``*`` anything, ``^`` a separator, ``@@`` in
front for an exception. Each becomes a regular expression. Patterns see the url with A-Z in lower case, as hosts have it; a host rule's path
keeps its case.

*Index.* Tokens are runs of a-z and 0-9 of the lower-cased url. A rule's literal tokens are those that any url it fits has whole.
How often tokens occur is counted over all urls, and each rule is filed under its rarest one. A url's tokens fetch the
candidate rules, and only their regular expressions run; a rule without a literal token is a candidate everywhere.

Host rules come first, the longest wins; a block wins over an exception of the same length. Where no host rule fits, patterns decide:
an exception allows, else a match blocks, else the url is allowed.

Rules go to the tasks in blocks of ``RULES_AT_ONCE``; urls pass the blocks in turn and the best rule so far is carried on, so a rule
set of any size is covered without a shuffle of the urls.

Null urls and urls without ``://`` have an empty host and path: no host rule fits them (patterns see the empty string for null). Repeated
rows are judged alike. An empty table gives no rows. Other columns are carried by ``judge``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, unused

RULES_AT_ONCE = 50_000
#: Tokens of rules that are broadcast at most, some 60 MB.
TOKENS_SENT = 1_000_000
ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = re.compile(r"[a-z0-9]+")
_SEPARATOR = r"(?:[^\w.%-]|$)"


@dataclass(frozen=True)
class Rule:
    name: str
    action: str
    #: run on host + path for a host rule, else on the url
    regex: str
    #: of which any url that fits has all
    tokens: tuple[str, ...]
    host: bool

    def rank(self) -> tuple:
        """The largest wins: host rules by length, then patterns with exceptions first."""
        if self.host:
            return (1, len(self.name), self.action == BLOCK, self.name)
        return (0, self.action == ALLOW, len(self.name), self.name)


def host_rule(action: str, text: str) -> Rule:
    """Of ``host/path``, the path being a prefix."""
    host, slash, path = text.partition("/")
    host, path = host.translate(str.maketrans(_UPPER, _LOWER)), slash + path
    tokens = _TOKEN.findall(host) + _whole_tokens(path, open_end=True)
    return Rule(host + path, action, rf"(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(tokens), True)


def _whole_tokens(literal: str, open_start: bool = False, open_end: bool = False) -> list[str]:
    """Tokens of a literal that stay whole, whatever stands beside an open end."""
    low = literal.translate(str.maketrans(_UPPER, _LOWER))
    found = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(low)]
    return [t for a, b, t in found if not (open_start and a == 0) and not (open_end and b == len(low))]


def pattern_rule(text: str) -> Rule:
    """Of one line in filter-list notation."""
    body = text.removeprefix("@@").translate(str.maketrans(_UPPER, _LOWER))
    regex, tokens = "", []
    start = "||" if body.startswith("||") else "|" if body.startswith("|") else ""
    end = "|" if body.endswith("|") and len(body) > len(start) else ""
    core = body[len(start) : len(body) - len(end)]
    regex += {"||": r"^[^:/?#]+://(?:[^/?#]*\.)?", "|": "^", "": ""}[start]
    parts = re.split(r"([*^])", core)
    for k, part in enumerate(parts):
        if part == "*":
            regex += ".*"
        elif part == "^":
            regex += _SEPARATOR
        elif part:
            opens = (not start) if k == 0 else parts[k - 1] == "*"
            ends = (not end) if k == len(parts) - 1 else parts[k + 1] == "*"
            regex += re.escape(part)
            tokens += _whole_tokens(part, opens, ends)
    return Rule(text, ALLOW if text.startswith("@@") else BLOCK, regex + ("$" if end else ""), tuple(tokens), False)


def tokens_of(url: str) -> set[str]:
    return set(_TOKEN.findall(url.translate(str.maketrans(_UPPER, _LOWER))))


def token_counts(urls: DataFrame, url: str, rules: list[Rule]) -> dict[str, int]:
    """In how many urls each token of a rule occurs; as many numbers as the rules have tokens. Other tokens go before anything is counted: where
    the rules' tokens are few enough to be sent to the tasks, without a shuffle."""
    wanted = sorted({t for r in rules for t in r.tokens})
    those = urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    low = F.translate(F.col(url), _UPPER, _LOWER)
    own = urls.select(F.explode(F.array_distinct(F.split(low, "[^a-z0-9]+"))).alias("token"))
    if len(wanted) <= TOKENS_SENT:
        counted = own.join(F.broadcast(those), "token", "left_semi").groupBy("token").count()
    else:  # counted before the join: a token of every url is one row of each task then
        counted = own.groupBy("token").count().join(those, "token", "left_semi")
    return {r.token: r["count"] for r in counted.collect()}


@lru_cache(maxsize=1 << 16)
def _compiled(regex: str) -> re.Pattern:
    """Compiled when a url first fetches its rule, and kept by the worker."""
    return re.compile(regex, re.DOTALL | re.ASCII)


class Index:
    """Rules by their rarest token."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list] = {}
        for rule in sorted(rules, key=Rule.rank, reverse=True):
            filed = min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default="")
            self.by_token.setdefault(filed, []).append(rule)

    def best(self, url: str, target: str) -> Rule | None:
        """The rule that decides on a url in lower case; ``target`` is its host and path."""
        found = None
        for token in ("", *tokens_of(url)):
            for rule in self.by_token.get(token, ()):
                if found is not None and rule.rank() <= found.rank():
                    break  # they come by rank
                regex = _compiled(rule.regex)
                if regex.match(target) if rule.host else regex.search(url):
                    found = rule
                    break
        return found


FOUND = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("host", T.BooleanType()),
    ]
)


def _judge(rules: list[Rule], counts: dict[str, int]):
    built: list[Index] = []

    @F.arrow_udf(FOUND)
    def judged(urls: pa.Array, targets: pa.Array, before: pa.Array) -> pa.Array:
        if not built:
            built.append(Index(rules, counts))
        rows = []
        for url, target, old in zip(urls.to_pylist(), targets.to_pylist(), before.to_pylist(), strict=True):
            best = built[0].best(url or "", target or "")
            if old is not None:
                last = Rule(old["name"], old["action"], "", (), old["host"])
                best = last if best is None or last.rank() > best.rank() else best
            rows.append(None if best is None else {"name": best.name, "action": best.action, "host": best.host})
        return pa.array(rows, pa.struct([("name", pa.string()), ("action", pa.string()), ("host", pa.bool_())]))

    return judged


def host_of(url: str) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(urls: DataFrame, rules: list[Rule], url: str = "url", rules_at_once: int = RULES_AT_ONCE) -> DataFrame:
    """``urls`` and host, path, rule (a host rule's name, else null), pattern (the deciding pattern, else null), verdict.
    Columns of ``urls`` with these names are replaced."""
    new = ("host", "path", "rule", "pattern", "verdict")
    urls = urls.drop(*[c for c in urls.columns if c.lower() in new and c != url])
    found, target = unused(urls, "found", "target")
    now = urls.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    now = now.withColumn(target, F.concat("host", "path")).withColumn(found, F.lit(None).cast(FOUND))
    counts = token_counts(urls, url, rules) if rules else {}
    for k in range(0, len(rules), rules_at_once):
        now = now.withColumn(found, _judge(rules[k : k + rules_at_once], counts)(F.translate(F.col(url), _UPPER, _LOWER), F.col(target), F.col(found)))
    by_host = F.col(f"{found}.host")
    return now.select(
        *urls.columns,
        "host",
        "path",
        F.when(by_host, F.col(f"{found}.name")).alias("rule"),
        F.when(~by_host, F.col(f"{found}.name")).alias("pattern"),
        F.coalesce(F.col(f"{found}.action"), F.lit(ALLOW)).alias("verdict"),
    )


#: Host and path rules of the query.
HOST_RULES = (
    host_rule(BLOCK, "net/"),
    host_rule(ALLOW, "example.net/en/"),
    host_rule(BLOCK, "example.com/de/"),
    host_rule(ALLOW, "org/fr/"),
)
#: Patterns for urls that no host rule fits: ad and tracking servers, banners, installers; and one exception.
PATTERN_RULES = tuple(map(pattern_rule, ("||ads.", "||adserver.", "||tracker.", "/banner/", "/adclick/*", ".exe|", "@@||example.org^")))
#: Addresses that are blocked because most pages have them.
REPEATED = 2000


def repeated_addresses(urls: DataFrame, url: str = "url", most: int = REPEATED) -> list[Rule]:
    """Patterns that block the ``most`` addresses (host and path, query left out) that occur most often, ties by address. Only addresses of plain characters count, so that none is read as
    notation. A top list, so what comes to the driver is bounded."""
    low = urls.select(F.translate(F.col(url), _UPPER, _LOWER).alias("low"))
    address = F.concat(host_of("low"), path_of("low"))
    counted = low.select(address.alias("address")).where(F.col("address").rlike(PLAIN)).groupBy("address").count()
    top = counted.orderBy(F.desc("count"), "address").limit(most)
    return [pattern_rule(f"||{r.address}^") for r in top.collect()]


PLAIN = r"^[a-z0-9.-]+/[a-z0-9./_-]+\z"


def op10_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page, by host rules, general patterns and a block list of the addresses that the pages repeat most."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = [*HOST_RULES, *PATTERN_RULES, *repeated_addresses(pages)]
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS id FROM p),
a AS (SELECT address FROM (SELECT host || translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS address FROM h)
  WHERE regexp_full_match(address, '[a-z0-9.-]+/[a-z0-9./_-]+') GROUP BY address ORDER BY count(*) DESC, address LIMIT 2000),
b AS (SELECT split_part(address, '/', 1) AS ah, address[strpos(address, '/'):] AS ap FROM a),
l AS (SELECT id, host, low[strpos(low, '://') + 3 + length(host):] AS tail FROM h WHERE regexp_matches(low, '^[^:/?#]+://')),
m AS (SELECT DISTINCT id FROM l JOIN b ON (host = ah OR ends_with(host, '.' || ah)) AND starts_with(tail, ap)
  AND regexp_matches(tail[strlen(ap) + 1:], '^([^\w.%-]|$)')),
r(rh, rp, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
  ('org', '/fr/', 'allow')),
f AS (
  SELECT h.*, rh || rp AS rule, action, row_number() OVER (PARTITION BY h.id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
  FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(action, CASE
  WHEN regexp_matches(low, '^[^:/?#]+://([^/?#]*\.)?example\.org([^\w.%-]|$)') THEN 'allow'
  WHEN list_has_any(string_split(regexp_extract(low, '^[^:/?#]+://([^/?#]*)', 1), '.')[:-2], ['ads', 'adserver', 'tracker'])
    OR regexp_matches(low, '/banner/|/adclick/|\.exe$') OR m.id IS NOT NULL THEN 'block'
  ELSE 'allow' END) AS verdict
FROM f LEFT JOIN m ON m.id = f.id WHERE k = 1
"""
