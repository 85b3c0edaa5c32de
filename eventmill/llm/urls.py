"""URL filters: rules indexed by their rarest literal token.

Each rule has literal tokens (runs of letters and digits that every URL it fits must contain).  How many URLs
hold each rule token is counted over the whole table; a rule is filed under its rarest.  A URL's tokens fetch the
rules filed under them, and only those run their regular expressions.  Rules are a parameter, so their number
bounds what is sent to the tasks.

Contract rules (host, path) come first, the longest that fits wins; a URL that none fits is judged by patterns.
Ties in length: block before allow.

Cases: a null URL, or one without "://", has an empty host and path, fits no rule and is allowed.  Rows repeat
freely.  Only the id and URL columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    verdict: str
    name: str
    regex: str  #: searched in host + "\n" + path, the host in lower case
    tokens: tuple[str, ...]  #: literal tokens of what it fits; at least one
    listed: bool  #: a (host, path) rule of the contract rather than a pattern
    size: int = 0


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and all its subdomains if the path starts with `path`."""
    # a path's last token may go on in the URL (/en/1 fits /en/123), so only tokens that end inside are literal
    whole = re.findall(r"[a-z0-9]+(?=[^A-Za-z0-9])", path.lower())
    return Rule(verdict, host + path, rf"(?:^|\.){re.escape(host)}\n{re.escape(path)}", (*re.findall(r"[a-z0-9]+", host.lower()), *whole), True, len(host + path))


def pattern_rule(verdict: str, name: str, regex: str, *tokens: str) -> Rule:
    return Rule(verdict, name, regex, tokens, False)


#: Fixed by the contract.
LISTED = (
    host_rule("allow", "org", "/"),
    host_rule("block", "example.org", "/es/"),
    host_rule("block", "example.org", "/en/1"),
    host_rule("allow", "com", "/fr/"),
    host_rule("block", "com", "/de/"),
)
#: What is blocked where no listed rule fits: hosts that say what they are.
PATTERNS = (
    pattern_rule("block", "spam host", r"(?:^|[.-])spam[.-][^\n]*\n", "spam"),
    pattern_rule("block", "adult host", r"(?:^|[.-])adult[.-][^\n]*\n", "adult"),
    pattern_rule("block", "casino host", r"(?:^|[.-])casino[.-][^\n]*\n", "casino"),
    pattern_rule("block", "malware host", r"(?:^|[.-])malware[.-][^\n]*\n", "malware"),
    pattern_rule("block", "tracker host", r"(?:^|[.-])tracker[.-][^\n]*\n", "tracker"),
)
RULES = LISTED + PATTERNS


def host_and_path(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


TOKEN = re.compile(r"[a-z0-9]+")


def tokens_of(host: str, path: str) -> set[str]:
    return set(TOKEN.findall(f"{host}\n{path}".lower()))


class Index:
    """Rules by their rarest token; `fetch` gives those whose regular expression has to run."""

    def __init__(self, rules: tuple[Rule, ...], seen: dict[str, int]):
        self.by: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        self.key = {}
        for r in rules:
            rarest = min(r.tokens, key=lambda t: (seen.get(t, 0), t))
            self.key[r.name] = rarest
            self.by.setdefault(rarest, []).append((r, re.compile(r.regex)))

    def judge(self, host: str, path: str) -> tuple[str | None, str, int]:
        """Rule, verdict, regular expressions run."""
        if not host and not path:
            return None, "allow", 0
        text, ran, best, blocked = f"{host}\n{path}", 0, None, False
        for token in tokens_of(host, path) & self.by.keys():
            for rule, regex in self.by[token]:
                ran += 1
                if regex.search(text):
                    if rule.listed:
                        best = max(best or rule, rule, key=lambda r: (r.size, r.verdict == "block", r.name))
                    else:
                        blocked |= rule.verdict == "block"
        if best:
            return best.name, best.verdict, ran
        return None, "block" if blocked else "allow", ran


def token_counts(pages: DataFrame, url_col: str, rules: tuple[Rule, ...]) -> dict[str, int]:
    """URLs that hold each of the rules' tokens, over the whole table; at most one number for each token."""
    known = frozenset(t for r in rules for t in r.tokens)

    def count(batches):
        seen = Counter()
        for batch in batches:
            for url in batch.column(0).to_pylist():
                seen.update(tokens_of(*host_and_path(url)) & known)
        yield pa.RecordBatch.from_pydict({"token": list(seen), "n": pa.array(list(seen.values()), pa.int64())})

    rows = pages.select(url_col).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r["token"]: r["n"] for r in rows}


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: the id, host, path, rule (its name, null if no listed rule fits), verdict, n_tried (expressions run)."""
    index = Index(rules, token_counts(pages, url_col, rules))
    slim = pages.select(F.col(id_col), F.col(url_col).alias("_url"))

    def judge(batches):
        for batch in batches:
            host, path, rule, verdict, ran = [], [], [], [], []
            for url in batch.column(1).to_pylist():
                h, p = host_and_path(url)
                r, v, n = index.judge(h, p)
                host.append(h), path.append(p), rule.append(r), verdict.append(v), ran.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(ran, pa.int32())],
                names=[id_col, "host", "path", "rule", "verdict", "n_tried"],
            )

    kind = pages.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, n_tried int")


URLS_SQL = r"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (SELECT u.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
    FROM u JOIN r ON ('.' || u.host) LIKE ('%.' || r.host) AND starts_with(u.path, r.path) GROUP BY u.page_id)
SELECT u.page_id, u.host, u.path, f.rule,
  coalesce(f.verdict, CASE WHEN regexp_matches(u.host, '(^|[.-])(spam|adult|casino|malware|tracker)[.-]') THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN f ON u.page_id = f.page_id
"""
