"""Many taxonomy globs on many paths: the patterns become the edges of one segment trie, and paths walk it by joins.

A regex per rule costs paths times rules. Here a segment without wildcards is an equality, so a path meets only the rules that share its
beginning: one join per level on (state, segment), with the trie as a table. ``**`` is a state that any segment leads back to. Wildcards
inside a segment are tested against that segment only, for the few edges of the state it is in.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import tree_glob
from ..session import checkpointed

# Keys of edges that no segment can equal: the path has ended; any segment that fits the regex.
ENDED, FITS = "/", "/*"
# Levels walked before the plan is cut by a checkpoint.
LEVELS = 12


@dataclass
class Trie:
    """Edges (state, key, regex, next), the states of an empty path, (state, rule) ends, and (rule, regex) that are no list of segments."""

    edges: list[tuple[int, str, str | None, int]] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    ends: list[tuple[int, str]] = field(default_factory=list)
    irregular: list[tuple[str, str]] = field(default_factory=list)


def compiled(rules: Iterable[tuple[str, str]]) -> Trie:
    """The trie of (rule, glob) pairs; a rule may have many globs. Globs with ``**`` beside other characters, or with an empty segment, stay regexes."""
    trie, states = Trie(), {(): 0}
    for rule, glob in rules:
        bare = glob.lstrip("/")
        parts = bare.split("/")
        if any(part == "" or ("**" in part and part != "**") for part in parts):
            trie.irregular.append((rule, tree_glob(glob)))
            continue
        prefix: tuple[str, ...] = ()
        for part in parts if "/" in glob or parts == ["**"] else ["**", *parts]:
            # Any number of levels twice in a row is any number of levels.
            if part != "**" or prefix[-1:] != ("**",):
                prefix = (*prefix, part)
            states.setdefault(prefix, len(states))
        trie.ends.append((states[prefix], rule))

    def reached(prefix: tuple[str, ...]) -> list[int]:
        """The state itself and the one of any number of levels below it, which needs no segment."""
        return [states[prefix]] + ([states[*prefix, "**"]] if (*prefix, "**") in states else [])

    trie.starts = reached(())
    for prefix, state in states.items():
        trie.edges.append((state, ENDED, None, state))
        if not prefix:
            continue
        last, before = prefix[-1], states[prefix[:-1]]
        if last == "**":
            trie.edges.append((state, FITS, None, state))
        else:
            plain = not re.search(r"[*?]", last)
            segment = None if plain else "^(?s:" + "".join({"*": ".*", "?": "."}.get(char, re.escape(char)) for char in last) + ")$"
            trie.edges += [(before, last if plain else FITS, segment, to) for to in reached(prefix)]
    return trie


def matched(paths: DataFrame, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """(path, rule) of every distinct path and every rule one of whose globs the whole path matches.

    The work is that of the states a path is in, not of all rules; after the first exchange by path no level needs another one while
    the trie is small enough to be broadcast by Spark's own size check. Null paths match nothing; an empty path is one empty segment.
    """
    spark, trie = paths.sparkSession, compiled(rules)
    known = paths.select("path").filter("path is not null").distinct()
    parts = F.split("path", "/")
    deepest = known.agg(F.max(F.size(parts))).first()[0] or 0
    edges = spark.createDataFrame(trie.edges, "state int, key string, regex string, next int")
    walk = known.select("path", F.explode(F.array(*[F.lit(state) for state in trie.starts])).alias("state"))
    for level in range(deepest):
        here = F.coalesce(F.get(parts, F.lit(level)), F.lit(ENDED))
        looked = walk.select("path", "state", here.alias("segment")).withColumn("key", F.explode(F.array("segment", F.lit(FITS))))
        fits = (F.col("key") != FITS) | ((F.col("segment") != ENDED) & (F.col("regex").isNull() | F.expr("segment rlike regex")))
        walk = looked.join(edges, ["state", "key"]).filter(fits).select("path", F.col("next").alias("state")).distinct()
        if level % LEVELS == LEVELS - 1:
            walk = checkpointed(walk)
    found = walk.join(spark.createDataFrame(trie.ends, "state int, rule string"), "state").select("path", "rule")
    if trie.irregular:
        tests = F.array_compact(F.array(*[F.when(F.col("path").rlike(f"^(?:{regex})$"), rule) for rule, regex in trie.irregular]))
        found = found.unionByName(known.select("path", F.explode(tests).alias("rule")))
    return found.distinct()


def glob_components(paths: DataFrame, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """(sha, component, path_count), as ``intrinsic.components``, for any number of (id, glob) rules."""
    found = matched(paths, rules).withColumnRenamed("rule", "component")
    return paths.select("sha", "path").distinct().join(found, "path").groupBy("sha", "component").agg(F.count(F.lit(1)).alias("path_count"))


def unmatched(paths: DataFrame, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """Distinct (sha, path) that no rule matches."""
    return paths.select("sha", "path").distinct().join(matched(paths, rules).select("path").distinct(), "path", "left_anti").select("sha", "path")
