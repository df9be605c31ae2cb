"""The trie of globs against one regex per rule, on paths and patterns drawn at random and on awkward ones."""

import random
import re

from tidemark.functions.paths import tree_glob
from tidemark.operators import globs as G


def test_trie_agrees_with_regexes(spark):
    rng = random.Random(3)
    names = ["a", "b", "ab", "a.py", "b.c", ".x", "a[1]"]
    paths = {"/".join(rng.choices(names, k=rng.randint(1, 6))) for _ in range(150)} | {"", "a//b", "a/"}
    pieces = ["a", "b", "ab", "*", "?", "*.py", "a*", "**", "a[1]", "*b*"]
    globs = {"/".join(rng.choices(pieces, k=rng.randint(1, 4))) for _ in range(120)} | {"/a", "**", "/**", "a/**", "**/**/b", "a**b", "a/**/", "x**/b", "a//b"}
    rules = [(f"r{at}", glob) for at, glob in enumerate(sorted(globs))]
    frame = spark.createDataFrame([(path,) for path in [*paths, None]], "path string")
    found = {tuple(row) for row in G.matched(frame, rules).collect()}
    assert found == {(path, rule) for path in paths for rule, glob in rules if re.fullmatch(tree_glob(glob), path)}


def test_deep_paths_and_empty_inputs(spark):
    deep = "/".join(["d"] * 30) + "/f.py"
    frame = spark.createDataFrame([(1, deep), (1, "x"), (2, None)], "sha int, path string")
    rules = [("py", "*.py"), ("under", "d/**"), ("under", "d/d/**"), ("exact", "/x")]
    assert {tuple(row) for row in G.glob_components(frame, rules).collect()} == {(1, "py", 1), (1, "under", 1), (1, "exact", 1)}
    assert {tuple(row) for row in G.unmatched(frame, rules[:1]).filter("path is not null").collect()} == {(1, "x")}
    assert G.matched(frame.limit(0), rules).count() == 0
    assert G.matched(frame, []).count() == 0
