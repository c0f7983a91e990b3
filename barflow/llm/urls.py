"""URL filter: a trie over reversed host labels, then path segments, broadcast to the tasks; the longest rule that fits wins."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.llm.common import query, read

#: A broadcast trie holds no more rules than this; about 300 bytes each.
MAX_RULES = 1_000_000


class Trie:
    """Host labels from the top-level label down, and at each host a second trie of path segments. A rule's last, open segment
    (the part after its last slash) is kept as a string prefix, so that ``/ab`` fits ``/abc`` while ``/ab/`` does not."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault("next", {}).setdefault(label, {})
            *closed, tail = path.split("/")
            spot = node.setdefault("paths", {})
            for segment in closed:
                spot = spot.setdefault("next", {}).setdefault(segment, {})
            known = spot.setdefault("tails", {})
            if tail not in known or known[tail][0] != "allow":      # of an allow and a block entry for the same place, allow stands
                known[tail] = (verdict, host + path)

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the most specific rule: more host labels first, then the longer path."""
        spots, node = [], self.root
        if "paths" in node:
            spots.append(node["paths"])
        for label in reversed(host.split(".")):
            node = node.get("next", {}).get(label)
            if node is None:
                break
            if "paths" in node:
                spots.append(node["paths"])
        segments = path.split("/")
        for spot in reversed(spots):
            best = None
            for segment in segments:
                fitting = [t for t in spot.get("tails", ()) if segment.startswith(t)]
                if fitting:
                    best = spot["tails"][max(fitting, key=len)]
                spot = spot.get("next", {}).get(segment)
                if spot is None:
                    break
            if best:
                return best
        return None


def host_and_path(url):
    """Host (after the first ``://``, A-Z lower-cased) and path of a URL column; both empty for NULL or without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """``pages`` (page_id, url, ...) -> page_id, host, path, rule, verdict for every row.

    ``rules``: (allow or block, host, path prefix). A rule fits its host and all subdomains; of the fitting ones the longest
    stands, ``default`` where none fits. A NULL, empty or scheme-less url has an empty host and path, so no rule with a host fits
    it. Repeated rows are judged one by one; other columns of the table are not read. More than MAX_RULES rules raise."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; a broadcast trie holds {MAX_RULES} at most")
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))
    host, path = host_and_path(F.col("url"))
    out = T.StructType([T.StructField("page_id", pages.schema["page_id"].dataType)]
                       + [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = trie.value.longest
        for b in batches:
            found = [longest(h, p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([f and f[1] for f in found], pa.string()),
                 pa.array([f[0] if f else default for f in found], pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path")).mapInArrow(look_up, out)


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
         ("block", "net", "/fr/")]

SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM parts),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM split)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


@query("op10_url_filter", SQL)
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), RULES)
