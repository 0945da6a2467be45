"""URL filters by a sort-merge range join of reversed-host keys with prefix rules.

A host's labels, reversed and each closed by a dot, make a key (`www.example.com` -> `com.example.www.`) under
which a rule's host with all its subdomains is one interval: the keys that begin with the rule's key. Pages and rules are
one stream of events, range-partitioned and sorted by key; a sweep keeps the stack of rule intervals that are
open at the current key. Intervals of label prefixes nest or are disjoint, so the stack is popped from its top.
Each stack entry holds the rules of one host by path.

A partition that starts inside open intervals needs their rules. They are those whose key is a prefix of the
partition's first key. A rule table within `RULE_BYTES` goes to every task; a larger one is cut down by an
equi-join of each partition's first key's label prefixes (at most one per label) with the rules.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, ascii_lower

RULE_BYTES = 8 << 20


def url_parts(url):
    """(host, path) columns: host lies between the first `://` and `/`, `?`, `#` or the end; path follows up to `?` or `#`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def host_key(host):
    """Reversed labels, each closed by a dot; empty for an empty host, which no rule covers."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


class _Open:
    """Rules of one host: verdicts by path, probed by the path lengths that occur."""

    def __init__(self, key: str):
        self.key, self.paths = key, {}

    def add(self, host: str, path: str, verdict: str) -> None:
        old = self.paths.get(path)
        if old is None or verdict < old[1]:
            self.paths[path] = (host + path, verdict)
        self.lengths = sorted({len(p) for p in self.paths}, reverse=True)

    def best(self, path: str):
        for n in self.lengths:
            if n <= len(path) and (found := self.paths.get(path[:n])):
                return found
        return None


def _push(stack: list[_Open], key: str, host: str, path: str, verdict: str) -> None:
    while stack and not key.startswith(stack[-1].key):
        stack.pop()
    if not stack or stack[-1].key != key:
        stack.append(_Open(key))
    stack[-1].add(host, path, verdict)


def _sweep(batches: Iterable[pa.RecordBatch], carried: list[tuple[str, str, str, str]], default: str) -> Iterator[pa.RecordBatch]:
    """Sorted events to judged pages.

    carried: (key, host, path, verdict) of rules that may be open where the task starts. Events with a `part`
    bring the open rules along; there the stack is emptied where the part changes.
    """
    stack: list[_Open] = []
    fresh, part = True, None
    for batch in batches:
        ids, hosts, paths, rules, verdicts = [], [], [], [], []
        rows = zip(*(batch.column(c).to_pylist() for c in ("part", "key", "is_page", "host", "path", "verdict", "page_id")), strict=True)
        for at, key, is_page, host, path, verdict, page_id in rows:
            if fresh:
                for k, h, p, v in sorted(c for c in carried if key.startswith(c[0])):
                    _push(stack, k, h, p, v)
                fresh, part = False, at
            elif at != part:
                stack.clear()
                part = at
            if not is_page:
                _push(stack, key, host, path, verdict)
                continue
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            best = None
            for entry in reversed(stack):
                found = entry.best(path)
                if found and (best is None or len(found[0]) > len(best[0])):
                    best = found
            ids.append(page_id)
            hosts.append(host)
            paths.append(path)
            rules.append(best[0] if best else None)
            verdicts.append(best[1] if best else default)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), *(pa.array(x, pa.string()) for x in (hosts, paths, rules, verdicts))], ["page_id", "host", "path", "rule", "verdict"]
        )


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", rule_bytes: int = RULE_BYTES) -> DataFrame:
    """Every row of `pages` as (page_id, host, path, rule, verdict).

    `rules` has host, path, verdict. A rule fits its host and all subdomains when the path starts with the
    rule's; the longest host + path wins, the longer host first among equals. Of rules with the same host and
    path, the verdict that sorts first stands ("allow" before "block"). Rules with a null or empty host fit
    nothing. Null urls and urls without `://` have an empty host and path and get `default`; repeated rows
    and null page_ids are judged like others. Other columns of `pages` are not read.
    """
    host, path = url_parts(F.col("url"))
    flat = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    page_events = flat.select(
        host_key(F.col("host")).alias("key"), F.lit(True).alias("is_page"), "host", "path", F.lit(None).cast("string").alias("verdict"), "page_id"
    )
    known = rules.select(
        ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("verdict").cast("string").alias("verdict")
    ).filter("host <> '' AND verdict IS NOT NULL")
    rule_events = known.select(
        host_key(F.col("host")).alias("key"), F.lit(False).alias("is_page"), "host", "path", "verdict", F.lit(None).cast("bigint").alias("page_id")
    )
    size = known.agg(F.sum(F.length("host") + F.length("path") + 64).alias("n")).first()["n"] or 0
    # Path and page_id deal a popular host's pages over several partitions; a host's rules precede its pages.
    order = ["key", "is_page", "path", "page_id"]
    schema = "page_id bigint, host string, path string, rule string, verdict string"
    ranged = page_events.unionByName(rule_events).repartitionByRange(*order).sortWithinPartitions(*order)
    if size <= rule_bytes:
        carried = [tuple(r) for r in rule_events.select("key", "host", "path", "verdict").collect()]
        events = ranged.withColumn("part", F.lit(0))
    else:
        carried = []
        scratch = Scratch(pages.sparkSession, "url-filter")
        placed = scratch.table(ranged.withColumn("part", F.spark_partition_id()), "events")
        firsts = placed.groupBy("part").agg(F.min("key").alias("first_key"))
        labels = F.split(F.rtrim("first_key", F.lit(".")), r"\.")
        prefix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(".")))
        # The rules that are open where a part starts; as prefixes of its first key they sort before its own events.
        opens = rule_events.join(firsts.select("part", F.explode(prefix).alias("key")), "key")
        both = placed.unionByName(opens.select(*placed.columns))
        events = both.repartition("part").sortWithinPartitions("part", *order)
    return events.mapInArrow(lambda batches: _sweep(batches, carried, default), schema)
