import pytest
from pyspark.sql import functions as F

from sluiceway.functions.regexes import glob, java, split_list
from sluiceway.functions.settings import expand, layered, properties
from sluiceway.operators.redact import redact
from sluiceway.operators.rules import K8sRules, LineRules, PathRules, k8s_passes

POD = "/var/log/containers/{}_{}_box-" + "a" * 64 + ".log"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    "include,exclude,line,kept",
    [
        ((), ("DEBUG", "(?i:TRACE)"), "debug", True),
        ((), ("DEBUG", "(?i:TRACE)"), "a trace value", False),
        (("WARN", "(?i:error)"), ("VERBOSE",), "ERROR VERBOSE", False),
        (("WARN", "(?i:error)"), ("VERBOSE",), "an Error", True),
        (("WARN",), (), "nothing", False),
    ],
)
def test_line_rules(spark, include, exclude, line, kept):
    assert one(spark, LineRules(include, exclude).passes(F.lit(line)))[0] is kept


def test_no_rules_is_no_stage_and_null_lines_drop(spark):
    lines = spark.createDataFrame([("a",), (None,)], "line string")
    assert LineRules().apply(lines) is lines
    assert [r.line for r in LineRules(exclude=("x",)).apply(lines).collect()] == ["a"]


@pytest.mark.parametrize(
    "patterns,line,out",
    [
        ([r"\S+@\S+\.\S+", "(?i:SENSITIVE)", r"\d{1,2}-\d{1,2}-\d{4}"], "my email is someone@example.com", "my email is [REDACTED]"),
        (["(?i:AB)", "(?i:CD)", r"\w{2}", r"\w{3}"], "CD 1 CDA 2 AB 3 CD", "[REDACTED] 1 [REDACTED] 2 [REDACTED] 3 [REDACTED]"),
        (["(?i:SENSITIVE)", "(?i:SENSITIVE INFORMATION)", "(?i:VE )"], "Five  messages", "Fi[REDACTED] messages"),
        (["ab", "cd"], "abcd", "[REDACTED]"),
        (["bcde", "ab", "ef"], "xabcdefx", "x[REDACTED]x"),
        (["é+", "🙂"], "aéé🙂b", "a[REDACTED]b"),
        (["zz"], "plain", "plain"),
        (["x*"], "axxb", "a[REDACTED]b"),
        ([], "same", "same"),
        (["a"], "", ""),
    ],
)
def test_redact(spark, patterns, line, out):
    assert one(spark, redact(F.lit(line), patterns))[0] == out


def test_redact_null(spark):
    assert one(spark, redact(F.lit(None).cast("string"), ["a"]))[0] is None


def test_redact_against_marked_characters(spark):
    import random
    import re

    rnd, patterns = random.Random(3), ["ab", "b+c", "ca", "[de]{2}"]
    lines = ["".join(rnd.choice("abcdef ") for _ in range(rnd.randint(0, 40))) for _ in range(200)]

    def plain(line):
        spans = sorted(m.span() for p in patterns for m in re.finditer(p, line))
        merged = []
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out, at = "", 0
        for a, b in merged:
            out, at = out + line[at:a] + "[REDACTED]", b
        return out + line[at:]

    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").select("i", redact(F.col("line"), patterns).alias("out")).collect()
    assert {r.i: r.out for r in rows} == {i: plain(x) for i, x in enumerate(lines)}


@pytest.mark.parametrize(
    "include,exclude,file,labels,annotations,kept",
    [
        (["namespace:sample"], [], POD.format("p", "sample"), None, None, True),
        (["namespace:sample"], [], POD.format("p", "other"), None, None, False),
        (["name:p-1"], [], POD.format("p-1", "other"), None, None, True),
        ([], ["name:p-1"], POD.format("p-1", "other"), None, None, False),
        (["label.app:web"], [], POD.format("p", "n"), {"app": "web"}, None, True),
        (["label.app:web"], [], POD.format("p", "n"), {"app": "db"}, None, False),
        (["label.app:web"], [], POD.format("p", "n"), {"zone": "x"}, None, True),
        ([], ["annotation.owner:core"], POD.format("p", "n"), None, {"owner": "core"}, False),
        ([], ["annotation.owner:core"], POD.format("p", "n"), None, None, True),
        (["namespace:sample"], [], None, None, None, True),
    ],
)
def test_k8s_rules(spark, include, exclude, file, labels, annotations, kept):
    row = spark.createDataFrame([(file, labels, annotations)], "file string, labels map<string,string>, annotations map<string,string>")
    ok = k8s_passes(K8sRules.parse(include), K8sRules.parse(exclude), F.col("file"), F.col("labels"), F.col("annotations"))
    assert row.select(ok).first()[0] is kept


def test_path_rules(spark):
    r = PathRules()
    paths = {"/var/log/a.log": "ok", "/var/log/deep/b.log": "ok", "/var/log/pods/x/c.log": "excluded", "/var/log/wtmp": "not_included", "/x/y.txt": "not_included"}
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", r.status(F.col("path"))).collect()
    assert dict(map(tuple, rows)) == paths
    assert one(spark, PathRules(()).status(F.lit("/a.log")))[0] == "not_included"


def test_patterns(spark):
    assert java("(?P<n>a)$") == r"(?dU)(?<n>a)\z"
    assert glob("/a/*.l?g") == r"(?s)^/a/.*\.l.g\z"
    assert split_list(r"a, b\,c ,, d") == ["a", "b,c", "d"]
    assert one(spark, F.lit("a\n").rlike(java("a$")))[0] is False


def test_settings():
    s = layered({"log_dirs": "/a, /b", "body_size": "10 MB"}, properties("exclude = *.tmp\n# no\nlookback: start\nother=1"), {"lookback": "tail"})
    assert s.log_dirs == ("/a", "/b") and s.body_size == 10_000_000 and s.exclude == ("*.tmp",) and s.lookback == "tail" and s.extra["other"] == "1"
    assert expand("${A}-${B|x}-${C}", {"A": "1"}) == "1-x-${C}"


def test_redaction_of_empty_matches_lookbehind_and_anchors(spark):
    from sluiceway.operators.redact import MARK, cover, finder, redact

    def plain(text, patterns):
        """A mark for each run of places that matches cover; two runs that touch are one."""
        inside = {i for p in patterns for m in finder(p).finditer(text) for i in range(*m.span())}
        return "".join(MARK if i in inside and i - 1 not in inside else "" if i in inside else c for i, c in enumerate(text))

    cases = [("foo=1 bar=2", ["(?<==)[0-9]", "x*"]), ("abcd", ["ab", "cd"]), ("abc", ["ab", "bc"]), ("aab", ["^a", "b$"]), ("xxa", ["x*"]), ("", ["x*"]), ("a1b22c", ["[0-9]+", "[a-b]", "(?=c)"]), ("CD 1 CDA 2", ["(?i:AB)", "(?i:CD)", "\\w{2}", "\\w{3}"]), ("none", ["z", "q+"])]
    for text, patterns in cases:
        want = plain(text, patterns)
        assert cover(text, [finder(p) for p in patterns], MARK) == want
        assert spark.createDataFrame([(text,)], "line string").select(redact(F.col("line"), patterns)).first()[0] == want
    assert "1" not in cover("foo=1 bar=2", [finder(p) for p in cases[0][1]], MARK)
    many = spark.createDataFrame([("a$b aa",), (None,)], "line string").select(redact(F.col("line"), ["a|a\\$"], "<$1>")).collect()
    assert [r[0] for r in many] == ["<$1>$b <$1>", None]


def test_rules_are_read_up_to_what_they_can_hold():
    from sluiceway.operators.rules import K8sRules

    got = K8sRules.parse(["namespace:nation-3", "name:a--b", "label.app.k8s.io/name:x-y-", "annotation.owner:core!", "label.none", "namespace:Upper"])
    assert got == K8sRules(("nation-3", ""), ("a",), (("app.k8s.io/name", "x-y"),), (("owner", "core"),))


def test_settings_from_yaml_environment_and_arguments():
    from sluiceway.functions.settings import from_arguments, from_env, from_yaml, overridden

    yaml = """
http:
  body_size: 1000
  retry_disk_limit: 2 MiB
  params: {hostname: box, tags: [a, b]}
log:
  dirs: ["${ROOT}/x"]
  include: {glob: ["*.txt"], regex: []}
  line_exclusion_regex: ["DEBUG"]
  db_path: /state
"""
    base = layered(from_yaml(yaml, {"ROOT": "/srv"}))
    assert (base.log_dirs, base.include, base.include_regex, base.body_size, base.retry_disk_limit) == (("/srv/x",), ("*.txt",), (), 1000, 2 << 20)
    assert (base.hostname, base.tags, base.extra) == ("box", ("a", "b"), {"log.db_path": "/state"})
    more = overridden(base, from_env("AGENT", {"AGENT_TAGS": "b,c", "AGENT_LOOKBACK": "start", "AGENT_IP": ""}), from_arguments(["-d", "/y,/z", "--logdir", "/w", "--lookback", "none", "--ingest-buffer-size", "2000"]))
    assert (more.tags, more.log_dirs, more.lookback, more.body_size, more.ip) == (("a", "b", "c"), ("/srv/x", "/y", "/z", "/w"), "none", 2000, "")
    assert layered(from_yaml("")) == layered()


def test_classes_of_characters_are_redacted_by_their_union(spark):
    """The same text as by places of matches; patterns that aren't plain classes don't take this way."""
    from sluiceway.operators.redact import cover, finder, redact, union_of_classes

    assert [union_of_classes([p]) for p in ("[^a]", "[a-c", "[a][b]", r"[\\d]", "[[a]]", "[a&&b]", "a+", "[a]*")] == [None] * 8
    lines = ["a1b2--x.@y", "", None, "zzz", "é-9.f", "a" * 50 + "!"]
    for patterns in (["[0-9]+", "[a-f]+", "[.@]"], ["[-a]", "[z-]+"], ["[$.]+", "[é]"]):
        assert union_of_classes(patterns)
        rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string")
        got = [r.y for r in rows.orderBy("i").select(redact(F.col("x"), patterns, "<$>").alias("y")).collect()]
        assert got == [None if x is None else cover(x, [finder(p) for p in patterns], "<$>") for x in lines]
