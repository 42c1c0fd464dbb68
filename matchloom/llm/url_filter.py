"""URL allow and block lists: a trie over reversed host labels and path segments.

A rule is a host and a path. It fits its host and every subdomain if the url's path starts
with the rule's path; of several that fit, the one with most host labels wins, then the one
with the longest path, then block before allow. A url that no rule fits gets the default.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of all rules together up to which the trie is broadcast; more rules are joined.
BROADCAST_CHARS = 20_000_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` and path; both empty without ``://`` or for null."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


class Trie:
    """Nested dicts: host labels from the last one on, then full path segments, then the begun last segment."""

    HOST_END, HIT = "/", ""

    def __init__(self, rules: Sequence[Rule]):
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.setdefault("." + label, {})
            node = node.setdefault(self.HOST_END, {})
            *full, begun = rule.path.split("/")
            for segment in full:
                node = node.setdefault("/" + segment, {})
            hits = node.setdefault(self.HIT, {})
            if hits.get(begun, rule).verdict == rule.verdict or rule.verdict == "block":
                hits[begun] = rule

    def match(self, host: str, path: str) -> Rule | None:
        """The longest rule that fits; one walk over labels and, at each depth that has rules, over segments."""
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get("." + label)
            if node is None:
                break
            if self.HOST_END in node:
                best = self._path(node[self.HOST_END], path) or best
        return best

    def _path(self, node: dict, path: str) -> Rule | None:
        best, at = None, 0
        while True:
            hits = node.get(self.HIT)
            if hits:
                fits = [begun for begun in hits if path.startswith(begun, at)]
                if fits:
                    best = hits[max(fits, key=len)]
            end = path.find("/", at)
            if end < 0:
                return best
            node = node.get("/" + path[at:end])
            if node is None:
                return best
            at = end + 1


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages``.

    A null url, or one without ``://``, has an empty host and path. Rules whose text is within
    ``BROADCAST_CHARS`` become a broadcast trie; a longer list is joined (``judge_by_join``).
    Other columns are not read; repeated rows stay; an empty table gives an empty table.
    """
    if sum(len(r.host) + len(r.path) for r in rules) > BROADCAST_CHARS:
        return judge_by_join(pages, rules, default, id_column, url_column)
    host, path = host_and_path(F.col(url_column).cast("string"))
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def run(batches):
        match = trie.value.match
        for batch in batches:
            found = [match(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r and r.text for r in found], pa.string()), pa.array([r.verdict if r else default for r in found], pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    parted = pages.select(F.col(id_column).cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    return parted.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def judge_by_join(pages: DataFrame, rules: Sequence[Rule] | DataFrame, default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """The same result for rule lists of any length (or a DataFrame verdict, host, path).

    Each distinct (host, path) meets the rules of its host suffixes and full leading segments
    by an equi join, so the pairs are at most labels x segments of a url.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    listed = rules.select(
        F.col("host").alias("suffix"), F.regexp_extract("path", r"(?s)^(.*/)?", 0).alias("folder"),
        F.col("path").alias("rule_path"), F.concat("host", "path").alias("rule"), "verdict",
    )
    host, path = host_and_path(F.col(url_column).cast("string"))
    parted = pages.select(F.col(id_column).cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.", -1)
    segments = F.split("path", "/", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    folders = F.transform(F.sequence(F.lit(0), F.size(segments) - 1), lambda i: F.concat(F.array_join(F.slice(segments, 1, i), "/"), F.when(i > 0, "/").otherwise("")))
    looks = parted.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes)).withColumn("folder", F.explode(folders))
    fits = looks.join(listed, ["suffix", "folder"]).where(F.expr("startswith(path, rule_path)"))
    order = F.struct(F.size(F.split("suffix", r"\.", -1)), F.length("rule_path"), "verdict")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), order).alias("b"))
    return parted.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
