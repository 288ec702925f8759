"""URL filters: a trie over reversed host labels and path segments.

A rule is a host with a path prefix.  It fits its host and all subdomains where the URL's
path starts with the rule's.  The longest fitting rule wins, be it an allow or a block
entry; of equal ones block wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rules that a trie may hold. It goes to every worker, so its size must have a bound.
MAX_RULES = 1_000_000

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): after the first ``://`` up to ``/ ? #``, A-Z lowered; then up to ``? #``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


class UrlTrie:
    """Nodes by host label from the right; in each, nodes by path segment.

    A node of the path part maps the beginning of its next segment to a rule, so a rule
    whose path ends within a segment fits all segments that begin so.
    """

    def __init__(self, rules: Iterable[tuple[str, str]]):
        """``rules``: (verdict, rule), verdict ``allow`` or ``block``, rule ``host/path``."""
        self.root: dict = {}
        n = 0
        for verdict, rule in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict must be allow or block: {verdict!r}")
            if (n := n + 1) > MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules")
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault("hosts", {}).setdefault(label, {})
            if not slash:
                key, node = None, node  # fits every path, an empty one too
            else:
                *segments, key = path.split("/")
                node = node.setdefault("paths", {})
                for s in segments:
                    node = node.setdefault("segments", {}).setdefault(s, {})
            kept = node.setdefault("rules", {}).setdefault(key, (rule, verdict))
            if verdict == "block":
                node["rules"][key] = (kept[0], verdict)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest fitting rule and its verdict."""
        best: tuple[str, str] | None = None

        def offer(found: tuple[str, str] | None) -> None:
            nonlocal best
            if found and (best is None or (len(found[0]), found[1]) > (len(best[0]), best[1])):
                best = found

        segments = path[1:].split("/") if path else None
        node = self.root
        for label in reversed(host.split(".")):
            node = node.get("hosts", {}).get(label)
            if node is None:
                break
            offer(node.get("rules", {}).get(None))
            at = node.get("paths") if segments is not None else None
            for s in segments or ():
                if at is None:
                    break
                begins = at.get("rules")
                if begins:
                    for k in range(len(s) + 1) if len(s) < len(begins) else [len(b) for b in begins if s.startswith(b)]:
                        offer(begins.get(s[:k]))
                at = at.get("segments", {}).get(s)
        return best


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], default: str = "allow", url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict of each URL.

    Without a fitting rule, rule is null and the verdict is ``default``.  A null URL or one
    without ``://`` has an empty host and path.  All rows stay; columns of ``pages`` with
    those four names are replaced.
    """
    spark = pages.sparkSession
    trie = spark.sparkContext.broadcast(UrlTrie(rules))
    added = ["host", "path", "rule", "verdict"]
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in added])
    rows = pages.select(row.alias("_row"), F.col(url_col).alias("_url"))
    schema = T.StructType([rows.schema["_row"], *(T.StructField(f"_{c}", T.StringType()) for c in added)])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = trie.value.match
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule, verdict = match(host, path) or (None, default)
                for column, x in zip(out, (host, path, rule, verdict)):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in out)], names=schema.names)

    judged = rows.mapInArrow(judge, schema)
    return judged.select("_row.*", *[F.col(f"_{c}").alias(c) for c in added])
