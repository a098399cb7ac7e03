"""URL filters: a trie over reversed host labels, then path segments, with allow and block entries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import lean, table, tidied

#: Verdict of a url that no rule fits.
DEFAULT_VERDICT = "allow"
#: A trie is built of at most so many characters of rules; more rules go into further tries, each its own pass.
TRIE_CHARS = 8_000_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def rank(self) -> tuple:
        """Longest host first, then longest path; a block beats an allow of the same place."""
        return (self.host.count(".") + 1 if self.host else 0, len(self.path), self.verdict == "block")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no ://."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    stop = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return host.translate(_LOWER), rest[:stop]


class Trie:
    """Host labels from the last one on, then path segments; a rule's last segment may end inside a segment."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for rule in rules:
            if rule.verdict not in ("allow", "block"):
                raise ValueError(f"verdict {rule.verdict!r} of {rule.name!r}")
            node = self.root
            for label in reversed(rule.host.translate(_LOWER).split(".")) if rule.host else ():
                node = node.setdefault(("h", label), {})
            *whole, last = rule.path.split("/")
            for segment in whole:
                node = node.setdefault(("p", segment), {})
            ends = node.setdefault("ends", {})  # by length, then by the characters: a look for each length there is
            same = ends.setdefault(len(last), {})
            if last not in same or same[last].rank < rule.rank:
                same[last] = rule

    def find(self, host: str, path: str) -> Rule | None:
        best: Rule | None = None
        segments = path.split("/")
        node: dict | None = self.root
        labels = host.split(".")
        while node is not None:
            at = node
            for k, segment in enumerate(segments):
                for n, same in at.get("ends", {}).items():
                    rule = same.get(segment[:n]) if n <= len(segment) else None
                    if rule is not None and (best is None or rule.rank > best.rank):
                        best = rule
                if k == len(segments) - 1 or (at := at.get(("p", segment))) is None:
                    break
            node = node.get(("h", labels.pop())) if labels else None
        return best


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """(id, host, path, rule, verdict) of each row; rules are (host, path prefix, "allow" or "block").

    A rule fits its host and all subdomains where the path starts with its path. The longest wins: more
    host labels, then the longer path, then block. The trie is built once and broadcast; its
    size is bounded by TRIE_CHARS, and a longer rule list takes one pass for each trie of that size.

    Null url, no "://", empty host: host and path are empty, and only a rule with an empty host and path
    can fit. Ports and user names stay part of the host. Null ids stay null; repeated rows are judged each;
    an empty table gives an empty result; other columns are not read. Verdict without a rule: default.
    """
    blocks: list[list[Rule]] = [[]]
    size = 0
    for rule in sorted({Rule(*r) for r in rules}):
        if size + len(rule.name) > TRIE_CHARS and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append(rule)
        size += len(rule.name)
    kind = dict(pages.dtypes)[id_col]
    out = lean(pages).selectExpr(f"`{id_col}`", f"cast(`{url_col}` as string) as `__url`", "cast(null as struct<host:string,path:string,verdict:string>) as `__best`")
    for block in blocks:
        out = out.mapInArrow(tidied(_pass(pages.sparkSession.sparkContext.broadcast(Trie(block)))), f"`{id_col}` {kind}, `__url` string, `__best` struct<host:string,path:string,verdict:string>")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            best = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([p[0] for p in parts], pa.string()),
                    pa.array([p[1] for p in parts], pa.string()),
                    pa.array([r and r["host"] + r["path"] for r in best], pa.string()),
                    pa.array([r["verdict"] if r else default for r in best], pa.string()),
                ],
                [id_col, "host", "path", "rule", "verdict"],
            )

    return out.mapInArrow(tidied(finish), f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def _pass(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = sent.value
        for b in batches:
            best = []
            for url, so_far in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                old = Rule(**so_far) if so_far else None
                new = trie.find(*split_url(url))
                top = new if old is None or (new is not None and new.rank > old.rank) else old
                best.append(top._asdict() if top else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best, b.schema.field(2).type)], names=b.schema.names)

    return run


#: Fixed values of the registered query: host, path prefix, verdict.
QUERY_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), QUERY_RULES)


OP7_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(rhost, rpath, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT page_id, host, path, rhost || rpath AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC NULLS LAST, length(rpath) DESC) AS k
  FROM p LEFT JOIN r ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""
