"""Patterns of arguments against Python's re, which they are written for."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyrule.functions import patterns
from tallyrule.functions.patterns import compiled, translated
from tallyrule.operators.evaluate import evaluate_specs
from tallyrule.operators.instructions import constrained_start

pytestmark = pytest.mark.filterwarnings("ignore::FutureWarning", "ignore::DeprecationWarning")

ATOMS = ["a", "B", "é", "É", "ß", "ı", "İ", "ſ", "K", "µ", "안", "녕", "٣", "²", "_", "-", " ", "\u00a0", "\u0085", "\u2028", "\\.", ".", "\\w", "\\W", "\\d", "\\D", "\\s", "\\S", "\\b", "\\B", "^", "$", "\\A", "\\Z", "\n", "\\n", "\U0001d11e", "\\x41", "\\u00e9", "#", "&", "{", "}", "x{", "a{,2}", "(?#c)", "]", "\\-", "\\]"]
SETS = ["[ab]", "[^ab]", "[a-f]", "[^\\w]", "[\\W_]", "[\\s\\d]", "[^\\D-]", "[a&&b]", "[[]", "[]a]", "[^]a]", "[a\\-z]", "[A-Z]", "[à-ÿ]", "[\\S]", "[^\\S\\n]", "[\\b]", "[#-&]", "[|~|]", "[^\\W\\d_]", "[\U0001d11e-\U0001d120]"]
TEXT = ["a", "b", "B", "é", "É", "ß", "ẞ", "ı", "İ", "i", "I", "ſ", "s", "K", "k", "µ", "μ", "안", "녕", "٣", "3", "²", "_", "-", " ", "\u00a0", "\u0085", "\u2028", "\n", "\r", ".", "A", "&", "[", "]", "x", "{", "}", "#", "\U0001d11e", "|"]


def random_pattern(r, depth=0, groups=None):
    groups = [0] if groups is None else groups
    out = ""
    for _ in range(r.randint(1, 3)):
        k = r.random()
        if k < 0.45 or depth > 2:
            piece = r.choice(ATOMS)
        elif k < 0.6:
            piece = r.choice(SETS)
        elif k < 0.72:
            groups[0] += 1
            piece = f"({random_pattern(r, depth + 1, groups)})"
        elif k < 0.8:
            piece = f"(?:{random_pattern(r, depth + 1, groups)}|{random_pattern(r, depth + 1, groups)})"
        elif k < 0.86:
            piece = f"(?{r.choice(['=', '!', '<=', '<!', '>', 'i:', 's:', '-i:', 'a:', 'm:', 'x:'])}{random_pattern(r, depth + 1, groups)})"
        elif k < 0.92 and groups[0]:
            n = r.randint(1, groups[0])
            piece = r.choice([f"\\{n}", f"(?({n})a|b)", f"(?({n})é)"])
        else:
            piece = r.choice(["(?P<n>a)", "(?P<n>.)(?P=n)", "(?i)", "(", ")", "*", "a**", "[", "(?<n>a)", "\\", "a{2", "(?P=m)", "\\q", "(?(9)a)"])
            groups[0] += "(?P<" in piece
        out += piece
        if r.random() < 0.25:
            out += r.choice(["*", "+", "?", "{2}", "{1,2}", "*?", "+?", "{,1}", "?+", "*+", "{0,5000000000}"])
    return out


def test_random_patterns(spark):
    """The same verdict and the same number of matches on random texts; what Python refuses is refused, and nothing else."""
    r, rows = random.Random(11), []
    for k in range(4000):
        source = r.choice(["", "i", "m", "im"]) + ":" + random_pattern(r)
        text = "".join(r.choice(TEXT) for _ in range(r.randint(0, 14)))
        rows.append((k, source, text))
    df = spark.createDataFrame(rows, "k int, source string, text string")
    df = df.withColumn("p", F.get(F.get(compiled(F.array(F.array("source"))), F.lit(0)), F.lit(0)))
    got = {x.k: (x.p.java is None, x.found, x.n, x.p.groups) for x in df.select("k", "p", F.regexp("text", F.col("p.java")).alias("found"), F.regexp_count("text", F.col("p.java")).alias("n")).collect()}
    wrong, refused = [], 0
    for k, source, text in rows:
        letters, _, pattern = source.partition(":")
        try:
            c = re.compile(pattern, ("i" in letters) * re.I | ("m" in letters) * re.M)
        except (re.error, OverflowError):
            want = (True, None, None, 0)
        else:
            matches = list(c.finditer(text))
            n = got[k][2] if any(m.end() == m.start() for m in matches) else len(matches)
            want = (False, bool(matches), n, c.groups)
        if got[k][0] and not want[0] and re.search(r"\(\?<.*(\\\d|\(\?\(|\(\?P=)|\(.*\(\?\(", pattern, re.S):
            continue  # what the module says that it refuses
        refused += want[0]
        if got[k] != want:
            wrong.append((source, text, got[k], want, translated(source)))
    print("\n".join(map(repr, wrong)))
    assert wrong == []
    assert 200 < refused < 3000


PROBES = [
    ("ko:keywords:existence", {"keywords": ["안\\w"]}, "안녕", True),
    ("en:keywords:existence", {"keywords": ["caf\\w+ x"]}, "café x", True),
    ("ko:keywords:existence", {"keywords": ["\\d+개"]}, "٣개", True),
    ("en:keywords:existence", {"keywords": ["a\\sb"]}, "a\u00a0b", True),
    ("en:keywords:frequency", {"keyword": "\\w+", "frequency": 2, "relation": "at least"}, "éà üö", True),
    ("en:keywords:existence", {"keywords": ["[a&&b]"]}, "a", True),
    ("en:keywords:existence", {"keywords": ["end\\Z"]}, "the end\n", False),
    ("en:keywords:existence", {"keywords": ["[[]x", "a(?#c)b", "(x)?(?(1)y|z)"]}, "[x ab xy", True),
    ("ko:keywords:existence", {"keywords": ["한\\S", "\\s국"]}, "한글\u3000국", True),
    ("ko:keywords:frequency", {"keyword": "\\b한\\w*", "frequency": 2, "relation": "equal to"}, "한국 대한 한글", True),
    ("ko:keywords:frequency", {"keyword": "\\d", "frequency": 2, "relation": "equal to"}, "1٢ ²", True),
    ("ko:keywords:forbidden_words", {"forbidden_words": ["고\\w이"]}, "나는 고양이", False),
    ("ko:keywords:forbidden_words", {"forbidden_words": ["고양이"]}, "나는 고양이를", True),
    ("en:keywords:forbidden_words", {"forbidden_words": ["a|bc"]}, "xbc", False),
    ("en:keywords:forbidden_words", {"forbidden_words": ["new york"]}, "New York!", False),
    ("en:keywords:forbidden_words", {"forbidden_words": ["(?<n>x)"]}, "x", "fatal"),
    ("en:keywords:existence", {"keywords": ["(?P<n>x)(?P=n)"]}, "aXx", True),
    ("en:keywords:existence", {"keywords": ["a++b", "x(?i)"]}, "aab", "fatal"),
    ("en:detectable_content:postscript", {"postscript_marker": "\\S\\."}, "x a. y", False),
    ("en:detectable_content:postscript", {"postscript_marker": "note|ps"}, "the ps", True),
    ("en:detectable_format:multiple_sections", {"section_spliter": "장", "num_sections": 2}, "장 ١ 가 장 ٢ 나", True),
    ("ko:detectable_format:multiple_sections", {"section_spliter": "(장)(\\s)?", "num_sections": 6}, "장 1 가 장2 나", True),
    ("ko:detectable_format:constrained_custom_response", {"choices": ["\\w+:$"]}, "\n답변:\n끝", True),
    ("ko:detectable_format:constrained_custom_response", {"choices": ["예\\b"]}, "예입니다", False),
]


def test_patterns_in_arguments(spark):
    rows = [(k, 0, i, json.dumps(a, ensure_ascii=False), t) for k, (i, a, t, _) in enumerate(PROBES)]
    df = spark.createDataFrame(rows, "item int, pos int, instruction_id string, kwargs string, response string")
    got = {r.item: "fatal" if r.status == "fatal" else r.strict for r in evaluate_specs(df, ["item"]).collect()}
    assert [(p, got[k]) for k, p in enumerate(PROBES) if got[k] != p[3]] == []


def test_words_need_no_python(spark, monkeypatch):
    sources = ["i:cat", "i:\\bcat\\b", "i:\\bnew york\\b", ":안녕 a_1", "i:\\ba\\b", "m:x"]
    df = spark.createDataFrame([(s,) for s in sources], "s string")
    assert df.where(patterns.plain(F.col("s"))).count() == len(sources)
    text = F.lit("CAT concat new york New Yorks 안녕 a_1 a, x")
    got = {r.s: r.n for r in df.select("s", F.regexp_count(text, patterns.of_plain(F.col("s"))["java"]).alias("n")).collect()}
    want = {s: len(re.findall(s.split(":")[1], "CAT concat new york New Yorks 안녕 a_1 a, x", re.I if s[0] == "i" else 0)) for s in sources}
    assert got == want
    assert spark.createDataFrame([("i:a.b",), ("i:\\b",), ("i:\\b a\\b",), ("i:a\n",), ("i:",), ("i:a:b",)], "s string").where(patterns.plain(F.col("s"))).count() == 0


@pytest.mark.parametrize(("starter", "text", "want"), [("my\\s+view", "x\n  my\u00a0view is", True), ("a|b$", "xb", True), ("(", "(", None), ("b", "ab", False)])
def test_constrained_start(spark, starter, text, want):
    df = spark.createDataFrame([(text, starter)], "x string, starter string")
    assert df.select(constrained_start(F.col("x"), F.col("starter")).alias("v")).first().v is want
