"""Allow and block lists for urls: a trie over reversed host labels and path segments.

Rules are few beside the urls, so tries of at most ``BLOCK_RULES`` rules are broadcast,
one after another; every url meets every block and keeps its longest rule.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geotext.llm.common import cut, query, table

#: Rules in one broadcast trie, of about 1 KB each at most in a worker's memory.
BLOCK_RULES = 200_000

#: (host, path, verdict); the path starts with a slash or is empty.
Rule = tuple[str, str, str]

#: The rules of the registered query.
RULES: list[Rule] = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# (?s) and \z: a newline is a character like any other.
_HOST = r"(?s)\A.*?://([^/?#]*)"
_PATH = r"(?s)\A.*?://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """From the first ``://`` to the next ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, _HOST, 1)
    return F.coalesce(F.translate(host, _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


@dataclass
class Segment:
    """Whole path segments lead down; ``tails`` are rules that end inside the next one, ``lengths`` theirs in order."""

    below: dict[str, Segment] = field(default_factory=dict)
    tails: dict[str, tuple[str, str]] = field(default_factory=dict)
    lengths: list[int] = field(default_factory=list)

    def add(self, tail: str, found: tuple[str, str]) -> None:
        at = bisect_left(self.lengths, len(tail))
        if at == len(self.lengths) or self.lengths[at] != len(tail):
            self.lengths.insert(at, len(tail))
        self.tails[tail] = found

    def longest(self, part: str) -> tuple[str, str] | None:
        """The longest rule that ends inside ``part``: a look-up for each length that rules have."""
        for n in reversed(self.lengths[: bisect_right(self.lengths, len(part))]):
            if found := self.tails.get(part[:n]):
                return found
        return None


@dataclass
class Label:
    """One host label, read from the right."""

    below: dict[str, Label] = field(default_factory=dict)
    paths: Segment | None = None


def build_trie(rules: Iterable[Rule]) -> Label:
    """A trie of the rules; of rules alike in host and path the later one holds."""
    root = Label()
    for host, path, verdict in rules:
        host = host.lower()
        label = root
        for name in reversed(host.split(".")):
            label = label.below.setdefault(name, Label())
        label.paths = label.paths or Segment()
        segment = label.paths
        *whole, tail = path.split("/")
        for name in whole:
            segment = segment.below.setdefault(name, Segment())
        segment.add(tail, (host + path, verdict))
    return root


def longest_match(trie: Label, host: str, path: str) -> tuple[str, str] | None:
    """The rule with most characters, host and path together, or None.

    Ties (a longer host with a shorter path) go to the longer host.
    """
    best: tuple[str, str] | None = None
    segments = path.split("/")
    label: Label | None = trie
    for name in reversed(host.split(".")):
        label = label.below.get(name)
        if label is None:
            break
        node: Segment | None = label.paths
        for part in segments:
            if node is None:
                break
            found = node.longest(part)
            if found and (best is None or len(found[0]) >= len(best[0])):
                best = found
            node = node.below.get(part)
    return best


def judge_urls(
    pages: DataFrame,
    rules: Iterable[Rule],
    url: str = "url",
    default: str = "allow",
    block_rules: int = BLOCK_RULES,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; columns of these names are replaced.

    A rule fits its host and all subdomains if the path starts with its path. A url that
    no rule fits, a null url and a text without ``://`` get ``rule`` null and ``default``.
    Rows are kept as they are, repeats too. More than ``block_rules`` rules go round in
    blocks, so no broadcast exceeds that many.
    """
    context = pages.sparkSession.sparkContext
    out = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    out = out.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    source = iter(rules)
    block = list(islice(source, block_rules))
    while block:
        shared = context.broadcast(build_trie(block))

        @F.pandas_udf("struct<rule: string, verdict: string>")
        def judge(host: pd.Series, path: pd.Series, rule: pd.Series, verdict: pd.Series) -> pd.DataFrame:
            rows = [
                found if (found := longest_match(shared.value, h, p)) and (r is None or longer(found[0], r)) else (r, v)
                for h, p, r, v in zip(host, path, rule, verdict, strict=True)
            ]
            return pd.DataFrame(rows, columns=["rule", "verdict"], dtype=object)

        out = out.withColumn("_judged", judge("host", "path", "rule", "verdict"))
        out = out.withColumns({"rule": F.col("_judged.rule"), "verdict": F.col("_judged.verdict")}).drop("_judged")
        block = list(islice(source, block_rules))
        if block:
            out = cut(out)
    return out


def longer(new: str, old: str) -> bool:
    """Whether a rule of a later block goes before: more characters, or as many and no shorter host."""
    return (len(new), -_path_length(new)) >= (len(old), -_path_length(old))


def _path_length(rule: str) -> int:
    at = rule.find("/")
    return 0 if at < 0 else len(rule) - at


def rules_of(lines: Iterable[str]) -> Iterator[Rule]:
    """Rules from lines such as ``block example.com/en/``; blank lines are skipped."""
    for line in lines:
        if m := re.fullmatch(r"\s*(allow|block)\s+([^/\s]+)(\S*)\s*", line):
            yield m[2], m[3], m[1]
        elif line.strip():
            raise ValueError(f"not a rule: {line!r}")


SQL = r"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(host, path, verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (
  SELECT h.host, h.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
    arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) h JOIN rules r
    ON (h.host = r.host OR h.host LIKE '%.' || r.host) AND starts_with(h.path, r.path)
  GROUP BY h.host, h.path)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""


@query("op7_url_rules", SQL)
def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")
