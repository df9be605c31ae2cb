import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import lines as N
from tidemark.functions import text as T
from tidemark.functions.paths import ancestors, arch_of, extension, normalize, shell_glob, tree_glob
from tidemark.operators import diff as D
from tidemark.operators import intrinsic as I


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize("subject,want", [
    ('Revert "Fix a (#1)" (#2)', (1, "Fix a (#1)", "Fix a (#1)", False)),
    ('Revert "Revert "Add x" (#3)"', (2, "Add x", 'Revert "Add x" (#3)', False)),
    ("Revert PR#12 because of y (#13)", (1, "PR#12 because of y", "PR#12 because of y", True)),
    ("Reverting nothing", (0, "Reverting nothing", "Reverting nothing", False)),
])
def test_revert_chains(spark, subject, want):
    got = one(spark, subject, T.unwrap_reverts)
    assert (got["depth"], got["innermost"], got["first_inner"], got["bare"]) == want


@pytest.mark.parametrize("subject,want", [("[A b][a  B] x", ["a b"]), ("src/net: fix", ["src/net"]), ("plain words", [])])
def test_subject_tags(spark, subject, want):
    assert one(spark, subject, T.subject_tags) == want


def test_message_parts(spark):
    message = "\r\nFix  it\r\nnow (#7)\r\n\r\nbody\r\n\r\nmore"
    subject, body = T.split_message(F.col("v"))
    got = spark.createDataFrame([(message,)], "v string").select(subject.alias("s"), body.alias("b")).first()
    assert (got["s"], got["b"]) == ("Fix it now (#7)", "body\n\nmore")


def test_sections_and_clean_body(spark):
    message = (
        "Subject\n\n<!-- hint -->\n#### Why I did it\nBecause.\n\n\n\nMail me@x.org\n**How I did it**:\nSo\n```\n```\n"
        "## How to verify it?\nRun\n### Other\nlost\nSigned-off-by: A <a@b.co>\n"
    )
    clean = one(spark, message, T.clean_body)
    assert "Signed-off" not in clean and "<email>" in clean and "\n\n\n" not in clean and "```" not in clean
    got = one(spark, clean, T.sections)
    assert (got["why"], got["how"], got["verify"]) == ("Because.\n\nMail <email>", "So", "Run")


@pytest.mark.parametrize("text,want", [
    ("by Jane Q. Public's hand", "by <name>'s hand"), ("JANE (Q) PUBLIC ok", "<name> ok"), ("Linusx Linus Li", "Linusx <name> Li"),
    ("Li Jane", "Li Jane"), ("see Jane (Q Public) end", "see <name> end"), ("linus GitHub", "linus GitHub"), ("well-Linus", "well-Linus"),
])
def test_name_redaction(spark, text, want):
    redact = T.name_redactor(["Jane Q Public", "Linus", "Li", "GitHub", "a@b.c"], ["github"])
    assert spark.createDataFrame([(text,)], "v string").select(redact("v")).first()[0] == want


@pytest.mark.parametrize("url,want", [
    ("https://me:pw@Host/x?y#z", "https://Host/x"), ("git@host.org:a/b.git", "host.org:a/b.git"), ("file:///a/b", None), ("/a/b", None),
])
def test_safe_url(spark, url, want):
    assert one(spark, url, T.safe_url) == want


@pytest.mark.parametrize("path,line,want", [
    ("a/b.py", "  # x", "comment"), ("a/b.py", "#!/bin/sh", "code"), ("a.c", "#include", "code"), ("a.c", " * x", "comment"), ("a.c", "*", "comment"),
    ("x.yml.j2", "{# x", "comment"), ("x.yml.j2", "# x", "comment"), ("Makefile.in", "# x", "comment"), ("noext", "# x", "comment"), ("a.txt", "# x", "code"),
    ("a.py", "   ", "blank"), (".bashrc", "# x", "comment"),
])
def test_line_kinds(spark, path, line, want):
    df = spark.createDataFrame([(path, line)], "p string, l string")
    assert df.select(N.line_kind(F.col("l"), N.comment_markers(F.col("p")))).first()[0] == want


@pytest.mark.parametrize("line,want", [('  a \t b "x  y"  c', 'a b "x  y" c'), ("it's  a  b", "it's  a  b"), (r'"a\"  b"  c', r'"a\"  b" c')])
def test_squeeze(spark, line, want):
    assert one(spark, line, N.squeeze) == want


@pytest.mark.parametrize("pattern,path,hit", [
    ("docs/**", "docs/a/b", True), ("docs/**", "docs", True), ("*.py", "a/b.py", True), ("a/*.py", "a/b/c.py", False), ("**/x?", "p/q/x1", True),
    ("/Makefile", "a/Makefile", False), ("a/**/z", "a/z", True),
])
def test_tree_globs(spark, pattern, path, hit):
    import re

    assert bool(re.fullmatch(tree_glob(pattern), path)) is hit


def test_shell_globs_cross_directories():
    import re

    assert re.fullmatch(shell_glob("device/*/x[0-3]"), "device/a/b/x2") and not re.fullmatch(shell_glob("a?"), "a")


def test_path_columns(spark):
    assert one(spark, "a/./b/../c", normalize) == "a/c" and one(spark, "../x/..", normalize) == ".."
    assert one(spark, "a/b/c", ancestors) == ["a", "a/b", "a/b/c"] and one(spark, "a", lambda p: ancestors(p, proper=True)) == []
    assert [one(spark, p, extension) for p in ("a.b/c", "x/.rc", "x/y.TAR.Gz")] == ["", "", "gz"]
    assert one(spark, "arm64-x-1", lambda n: arch_of(n, {"arm64": "arm64"})) == "arm64" and one(spark, "arm64", lambda n: arch_of(n, {"arm64": "arm64"})) == ""


def test_numbering_and_runs(spark):
    patch = "@@ -3,2 +3,3 @@ f()\n ctx\n-old\n+new\n+more\n\\ No newline\n@@ -9 +10 @@\n-x\n+y"
    df = spark.createDataFrame([("s", "a.py", patch)], "sha string, path string, patch string")
    rows = D.number_lines(D.patch_lines(df)).orderBy("pos").collect()
    assert [(r["kind"], r["old_lineno"], r["new_lineno"]) for r in rows if r["kind"] in ("context", "removed", "added")] == [
        ("context", 3, 3), ("removed", 4, None), ("added", None, 4), ("added", None, 5), ("removed", 9, None), ("added", None, 10)]
    runs = {r["kind"]: (r["line_start"], r["line_end"], r["quote"]) for r in D.first_runs(D.number_lines(D.patch_lines(df))).collect()}
    assert runs == {"added": (4, 5, "new\nmore"), "removed": (4, 4, "old")}
    ranges = D.hunk_ranges(D.patch_lines(df)).orderBy("pos").collect()
    assert [(r["old_start"], r["old_count"], r["new_start"], r["new_count"]) for r in ranges] == [(3, 2, 3, 3), (9, 1, 10, 1)]


def brute_kinds(lines):
    """Pairing line by line: an added line takes a waiting removed one of the same squeezed text."""
    blank, ws, comment, waiting = [0, 0], 0, [0, 0], {}

    def flush():
        for kinds in waiting.values():
            comment[1] += kinds.count("comment")
        waiting.clear()

    for line in lines:
        if line.startswith("@@"):
            flush()
            continue
        text = " ".join(line[1:].split())
        kind = "blank" if not text else "comment" if text.startswith("//") else "code"
        if kind == "blank":
            blank[0 if line[0] == "+" else 1] += 1
        elif line[0] == "-":
            waiting.setdefault(text, []).append(kind)
        elif waiting.get(text):
            waiting[text].pop()
            ws += 1
        elif kind == "comment":
            comment[0] += 1
    flush()
    return blank[0], blank[1], ws, comment[0], comment[1]


@pytest.mark.parametrize("seed", range(3))
def test_line_pairing_in_any_order(spark, seed):
    rng = random.Random(seed)
    lines = ["@@ -1 +1 @@"] + [
        "@@ -1 +1 @@" if rng.random() < 0.1 else rng.choice("+-") + rng.choice(["a b", "a  b", "// c", "//  c", "", "x"]) for _ in range(80)]
    df = spark.createDataFrame([("s", "m.c", "\n".join(lines))], "sha string, path string, patch string")
    got = D.changed_line_kinds(D.number_lines(D.patch_lines(df))).first()
    assert (got["blank_added"], got["blank_removed"], got["whitespace_only"], got["comment_added"], got["comment_removed"]) == brute_kinds(lines)


def test_origins_of_removed_lines(spark):
    hunks = "array<struct<old_start:bigint,old_count:bigint,new_start:bigint,new_count:bigint>>"
    events = [("f", 0, "c0", [(0, 0, 1, 3)]), ("f", 1, "c1", [(2, 1, 2, 2)]), ("f", 2, "c2", [(1, 1, 1, 0), (4, 1, 3, 1)]), ("g", 1, "c1", [(0, 0, 1, 1)]), ("g", 3, "c3", [(1, 1, 1, 1)])]
    got = D.replay_origins(spark.createDataFrame(events, f"lineage string, idx bigint, sha string, hunks {hunks}")).collect()
    assert sorted((r["lineage"], r["idx"], r["line"], r["origin_sha"]) for r in got) == [
        ("f", 1, 2, "c0"), ("f", 2, 1, "c0"), ("f", 2, 4, "c0"), ("g", 3, 1, "c1")]


def test_budget_ends_a_file_and_goes_on_with_the_next(spark):
    rows = [("s", 0, 1, "x" * 9), ("s", 0, 2, "x" * 99), ("s", 0, 3, "x"), ("s", 1, 1, "x" * 4), ("s", 1, 2, "x" * 30)]
    got = D.commit_budget(spark.createDataFrame(rows, "sha string, file_no bigint, n bigint, line string"), budget=30).orderBy("file_no").collect()
    assert [(r["kept"], r["truncated"]) for r in got] == [(1, True), (1, True)]


@pytest.mark.parametrize("subject,files,tags,body,want,fix", [
    ('Revert "Fix"', [], [], "", "revert", False), ("Bump pointer", [("M", "src/sub", "submodule")], [], "", "submodule-bump", False),
    ("Words", [("M", "a.md", "doc")], [], "", "docs", False), ("Words", [("M", "t.py", "test")], [], "", "test", False),
    ("Update lib to 1.2.3", [("M", "a.c", "code")], [], "", "dependency-bump", False), ("x", [("A", "device/v/p/f", "config")], [], "", "platform-support", False),
    ("Fix crash", [("M", "a.c", "code")], [], "", "fix", True), ("x", [("M", "a.c", "code")], [], "Fixes #12", "fix", True),
    ("x", [("M", ".github/w.yml", "config")], [], "", "build-ci", False), ("x", [("M", "a.c", "code")], ["ci"], "", "build-ci", False),
    ("Add thing", [("M", "a.c", "code")], [], "", "feature", False), ("Words", [("M", "a.c", "code")], [], "", "chore", False),
])
def test_change_types(spark, subject, files, tags, body, want, fix):
    m = spark.createDataFrame([("s", subject, tags, body, subject.startswith("Revert"))], "sha string, subject string, tags array<string>, body string, is_revert boolean")
    f = spark.createDataFrame([("s", st, p, p, c) for st, p, c in files], "sha string, status string, path string, new_path string, file_class string")
    got = I.change_types(m, f).first()
    assert (got["change_type"], got["fix_like"]) == (want, fix)
