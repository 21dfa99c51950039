"""Patterns are looked for in a part of a response only where they may be found there though not in the whole."""

import json
import random
import re
import warnings

from test_patterns import random_pattern

from tallyrule.functions.patterns import translated
from tallyrule.functions.text import SPACES
from tallyrule.operators.evaluate import evaluate_specs

KNOWN = {
    r"\bdes\b": "local", r"\w+ción\W": "local", r"(the )?(?(1)cat|dog)": "local", r"[^\W\d_]ation(?!s)": "local", r"(.)\1": "local",
    r"\w\Z": "tail", r"(?-i:[A-Z]\w+)$": "tail", r"\Aa": "ends", r"(?m:^the\b)": "ends", r"(?m)a$": "ends", r"a|b$": "ends",
    r"^": None, r"a $": None, r"a(?!$)": None, r"a(?=\s)": None, r"(?>a)": None, r"a.\Z": None, r"[^a]\Z": None,
}


def test_reach():
    """all but the last were looked for in every part."""
    assert {p: translated(f"i:{p}")[2] for p in KNOWN} == KNOWN


def variants(x):
    lines = x.split("\n")
    cuts = [x] + ["\n".join(c).strip(SPACES) for c in (lines[1:], lines[:-1], lines[1:-1])]
    return [v for c in cuts for v in (c, c.replace("*", "")) if v.strip(SPACES)]


def test_parts_of_random_texts(spark):
    """Both modes are as if every pattern were looked for in every part."""
    r, rows, reach = random.Random(5), [], []
    odd = [*KNOWN, "^a", "a$", r"\Ab", r"b\Z", "(?m:^b)", "(?m:a$)", "(?m:^ab?$)", r"\b\w\Z", r"(?:^|b)a(?:$|\b)", "a+$", "(a|b)*a$", "ab(?!b)$", "(?<!b)a$", r"\Ba$", "^a|b", "[ab]+", "a\\sb", "a b$", "^$", "^\\s*a", "a\nb"]
    signs = ["a", "b", "A", "_", "the", "cat", "dog", "1", "é", ".", " ", " ", "\n", "\n", "\n", "*", "*", "\t", " ", " "]
    while len(rows) < 6000:
        p = r.choice(odd) if len(rows) % 2 else random_pattern(r)
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                c = re.compile(p, re.I)
        except (re.error, OverflowError):
            continue
        made = translated(f"i:{p}")
        if made[0] is None:
            continue
        x = "".join(r.choice(signs) for _ in range(r.randint(1, 16)))
        strict = bool(x.strip(SPACES) and c.search(x))
        rows.append((len(rows), 0, "en:keywords:existence", json.dumps({"keywords": [p]}), x, strict, any(c.search(v) for v in variants(x))))
        reach.append(made[2])
    df = spark.createDataFrame(rows, "k int, pos int, instruction_id string, kwargs string, response string, s boolean, l boolean")
    got = evaluate_specs(df, ["k"], ["en:keywords:existence"]).collect()
    assert [(x.kwargs, x.response, reach[x.k], x.strict, x.s, x.loose, x.l) for x in got if (x.strict, x.loose) != (x.s, x.l)] == []
    assert min(map(reach.count, ("local", "ends", "tail", None))) > 200
    assert len([1 for *_, s, l in rows if l and not s]) > 100
