"""Strict and lenient evaluation of responses against their instructions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.korean import confirming
from ..functions.language import detect
from ..functions.patterns import compiled
from .instructions import ARGS_SCHEMA, LIST_ARGS, NORMALISED, NUMBER_ARGS, REGISTRY, Context, Instruction, nfc, twins

SPECS, TEXTS, PAIRS, CONFIRMED, PATTERNS, OUTCOMES = ("__specs", "__texts", "__pairs", "__confirmed", "__patterns", "__outcomes")
STARLESS, FIRST = "__starless", "__first"
EVALUATED = ("ok", "fallback_en")


def resolve(instruction_id: Column, assume_lang: str | None = None) -> tuple[Column, Column]:
    """The id that decides, and the status: ok, fallback_en, unsupported or malformed_id.

    An unknown id falls back on en: and what follows its first colon. assume_lang: the language of ids without one."""
    known = lambda c: c.isin(*REGISTRY)
    if assume_lang:
        named = F.concat(F.lit(f"{assume_lang}:"), instruction_id)
        instruction_id = F.when(~known(instruction_id) & known(named), named).otherwise(instruction_id)
    english = F.concat(F.lit("en:"), F.regexp_replace(instruction_id, "^[^:]*:", ""))
    colon = F.instr(instruction_id, ":") > 0
    resolved = F.when(known(instruction_id), instruction_id).when(colon & known(english), english)
    status = F.when(known(instruction_id), "ok").when(~colon, "malformed_id").when(known(english), "fallback_en").otherwise("unsupported")
    return resolved, status


def bound(specs: Column, assume_lang: str | None = None) -> Column:
    """An array of (instruction_id, kwargs) with resolved_id, status and args, the typed arguments of kwargs (a JSON object).

    Expected texts of Korean instructions are brought into NFC; the response never is."""

    def parsed(s: Column) -> Column:
        resolved, status = resolve(s["instruction_id"], assume_lang)
        return F.struct(s["instruction_id"].alias("instruction_id"), s["kwargs"].alias("kwargs"), resolved.alias("resolved_id"), status.alias("status"), F.from_json(s["kwargs"], ARGS_SCHEMA).alias("args"))

    def normalised(s: Column) -> Column:
        args = s["args"]
        for a in NORMALISED:
            args = args.withField(a, F.transform(s["args"][a], nfc) if a in LIST_ARGS else nfc(s["args"][a]))
        return s.withField("args", F.when(F.startswith(s["resolved_id"], F.lit("ko:")), args).otherwise(s["args"]))

    return F.transform(F.transform(specs, parsed), normalised)


def mistyped(kwargs: Column, names: tuple[str, ...]) -> Column:
    """Whether an argument is there with a type that its instruction can't use."""

    def wrong(parsed: Column, name: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant"))
        fits = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)" if name in NUMBER_ARGS else "^ARRAY<(STRING|VOID)" if name in LIST_ARGS else "^STRING"
        return F.coalesce((kind != "VOID") & ~kind.rlike(fits), F.lit(False))

    return X.bind(F.try_parse_json(kwargs), lambda parsed: reduce(Column.__or__, (wrong(parsed, a) for a in names)))


def _defaulted(i: Instruction, c: Context) -> Column:
    """Whether an argument is missing, or negative where a number is counted."""
    out = F.lit(False)
    for a in i.accepts:
        out = out | c[a].isNull() | (F.coalesce(c[a] < 0, F.lit(False)) if a in NUMBER_ARGS else F.lit(False))
    return out


def _same(s: Column, pos: Column, names: list[str]) -> Column:
    """A text that is equal for specs of a row which the same verdict holds for, whatever their language.

    That is so for the rules named, if the arguments are spelled alike, all there, and mean the same in both languages."""
    name, one = F.substring_index(s["resolved_id"], ":", -2), F.lit(False)
    for n in reversed(names):
        i, c = REGISTRY[f"en:{n}"], Context(s["args"], "en", F.lit(0))
        given = ~_defaulted(i, c)
        for a in i.accepts:
            if a in LIST_ARGS:
                given = given & (F.size(c[a]) > 0)
            elif a not in NUMBER_ARGS:
                given = given & (c[a] != "equal to") & ~X.blank(c[a])
        one = F.when(name == n, F.coalesce(given, F.lit(False))).otherwise(one)
    kwargs = F.coalesce(s["kwargs"], F.lit(""))
    alike = ~kwargs.rlike(r"[^\x00-\x7f]|\\u") & one
    return F.when(F.coalesce(alike, F.lit(False)), F.concat(name, F.lit(" "), kwargs)).otherwise(pos.cast("string"))


def _decide(s: Column, pos: Column, draw: Column, name: str, i: Instruction, variants: Column | None = None, known: Column | None = None) -> Column:
    """status, strict, loose and args_defaulted of a spec that resolves to an instruction.

    variants: what makes the variants of the response where they are needed, if they aren't in TEXTS. known: whether an
    earlier spec's verdict holds; strict and loose are then null unless the arguments are refused."""
    c = Context(s["args"], name.split(":")[0], draw, F.get(F.col(PATTERNS), pos) if i.patterns else None)
    bad = i.bad(c) if i.bad else F.lit(False)
    if i.accepts:
        bad = bad | mistyped(s["kwargs"], i.accepts)
    ok = lambda x, hint: ~X.blank(x) & F.coalesce(i.rule(x, hint, c), F.lit(False))
    nothing = F.lit(None).cast("string")
    if i.needs == "rephrase":
        tried = F.zip_with(TEXTS, F.get(F.col(CONFIRMED), pos), lambda x, b: F.struct(x.alias("x"), F.when(b, F.lit("yes")).alias("l")))
    else:
        tried = F.col(PAIRS if i.needs == "language" else TEXTS)
    test = (lambda x: ok(x, nothing)) if i.needs == "text" else (lambda p: ok(p["x"], p["l"]))
    defaulted = _defaulted(i, c).alias("args_defaulted")
    out = lambda status, strict, loose: F.struct(status.alias("status"), strict.alias("strict"), loose.alias("loose"), defaulted)
    # The response is decided once; its variants only if it doesn't comply.
    strict = F.array(F.exists(F.slice(tried, 1, 1), test))
    whole = tried if variants is None or i.needs != "text" else variants
    rest = F.slice(whole, F.lit(2), F.size(whole)) if whole is tried else F.slice(whole, 2, 7)
    loose = F.exists(rest, test)
    if i.parts and i.needs == "text":
        # Lines are cut off at white space, so it may suffice to try the whole text without stars.
        loose = F.exists(F.col(STARLESS), test) | F.exists(rest, lambda x: i.parts(x, c) & test(x))
    elif i.whole and i.needs == "text":
        alone = i.whole(F.get(F.col(TEXTS), F.lit(0)), c) & F.forall(F.col(STARLESS), lambda x: i.whole(x, c))
        loose = F.exists(F.when(F.coalesce(alone, F.lit(False)), F.col(STARLESS)).otherwise(rest), test)
    done = F.get(F.transform(strict, lambda v: out(s["status"], v, v | loose)), F.lit(0))
    no = lambda status: out(F.lit(status), F.lit(False), F.lit(False))
    if known is not None:
        unsaid = F.lit(None).cast("boolean")
        done = F.when(known, out(s["status"], unsaid, unsaid)).otherwise(done)
    verdict = F.when(bad, no("bad_args")).otherwise(done)
    if i.patterns:
        broken = F.exists(c.compiled, lambda p: p.isNotNull() & p["java"].isNull())
        verdict = F.when(F.coalesce(broken, F.lit(False)), no("fatal")).otherwise(verdict)
    return F.when(i.fatal(c), no("fatal")).otherwise(verdict) if i.fatal else verdict


def with_outcomes(rows: DataFrame, specs: Column, response: Column, seed: Column, ids: list[str] | None = None, assume_lang: str | None = None, single: bool = False) -> DataFrame:
    """rows with __outcomes: (instruction_id, resolved_id, status, evaluated, strict, loose, args_defaulted) for each of specs.

    One pass: nothing is shuffled or joined, and each row's variants are made once for all its instructions; with a single
    instruction only if it needs them. Python runs
    only if an instruction that needs a guess of the language, the likeness to a prompt, or patterns may occur (ids), and
    gets the texts of those rows alone; of patterns those that are more than words. seed(pos) is what decides defaults."""
    own = {n: i for n, i in REGISTRY.items() if ids is None or n in ids}
    needs = lambda need: [n for n, i in own.items() if i.needs == need]
    occurs = lambda need: F.exists(SPECS, lambda s: s["resolved_id"].isin(*needs(need)))
    texts = F.coalesce(X.loose_variants(response), F.array(F.lit(None).cast("string")))
    number = lambda pos: F.pmod(seed(pos), F.lit(2**31))
    out = rows.withColumn(SPECS, bound(specs, assume_lang))
    if patterned := {n: i for n, i in own.items() if i.patterns}:

        def sources(s: Column, pos: Column) -> Column:
            made = None
            for n, i in patterned.items():
                made = (F if made is None else made).when(s["resolved_id"] == n, i.patterns(Context(s["args"], n.split(":")[0], number(pos))))
            return made

        out = out.withColumn(PATTERNS, compiled(F.transform(SPECS, sources)))
    if single:
        out = out.withColumn(TEXTS, F.when(occurs("language") | occurs("rephrase"), texts).otherwise(F.array(response)))
    else:
        out = out.withColumn(TEXTS, texts)
    if any(i.parts or i.whole for i in own.values()):
        star = F.lit("*")
        out = out.withColumn(STARLESS, F.when(F.contains(response, star), F.array(F.replace(response, star, F.lit("")))).otherwise(F.array().cast("array<string>")))
    both = [] if single else twins(own)
    if both:
        same = F.transform(SPECS, lambda s, pos: _same(s, pos, both))
        out = out.withColumn(FIRST, X.bind(same, lambda keys: F.transform(keys, lambda k: (F.array_position(keys, k) - 1).cast("int"))))
    if needs("language"):
        out = out.withColumn(PAIRS, detect(F.when(occurs("language"), F.col(TEXTS))))
        out = out.withColumn(PAIRS, F.zip_with(TEXTS, PAIRS, lambda x, l: F.struct(x.alias("x"), l.alias("l"))))
    if needs("rephrase"):
        out = out.withColumn(CONFIRMED, confirming(F.when(occurs("rephrase"), F.col(TEXTS)), F.transform(SPECS, lambda s: s["args"]["prompt_to_rephrase"])))

    def outcome(s: Column, pos: Column) -> Column:
        draw = number(pos)
        none = F.struct(s["status"].alias("status"), F.lit(False).alias("strict"), F.lit(False).alias("loose"), F.lit(False).alias("args_defaulted"))

        def one(n: str) -> Column:
            known = F.get(F.col(FIRST), pos) != pos if n.split(":", 1)[1] in both else None
            return _decide(s, pos, draw, n, own[n], texts if single else None, known)

        def among(number: Column, first: int, names: list[str]) -> Column:
            """What the name with a number, from first on, comes to: found by halves, as there are many."""
            if len(names) == 1:
                return one(names[0])
            half = len(names) // 2
            return F.when(number < first + half, among(number, first, names[:half])).otherwise(among(number, first + half, names[half:]))

        names = list(own)
        made = none
        if own:
            made = X.bind(F.coalesce(F.array_position(F.array(*map(F.lit, names)), s["resolved_id"]), F.lit(0)), lambda k: F.when(k > 0, among(k, 1, names)).otherwise(none))
        return F.struct(s["instruction_id"].alias("instruction_id"), s["resolved_id"].alias("resolved_id"), made.alias("o"))

    def flat(x: Column) -> Column:
        o = x["o"]
        return F.struct(x["instruction_id"].alias("instruction_id"), x["resolved_id"].alias("resolved_id"), o["status"].alias("status"), o["status"].isin(*EVALUATED).alias("evaluated"), o["strict"].alias("strict"), o["loose"].alias("loose"), o["args_defaulted"].alias("args_defaulted"))

    def told(made: Column) -> Column:
        """The outcomes, with verdicts that are null taken from the earlier spec."""
        earlier = lambda x, pos, name: F.coalesce(x["o"][name], F.get(made, F.get(F.col(FIRST), pos))["o"][name]).alias(name)
        return F.transform(made, lambda x, pos: flat(x.withField("o", F.struct(x["o"]["status"].alias("status"), earlier(x, pos, "strict"), earlier(x, pos, "loose"), x["o"]["args_defaulted"].alias("args_defaulted")))))

    outcomes = F.transform(SPECS, outcome)
    out = out.withColumn(OUTCOMES, X.bind(outcomes, told) if both else F.transform(outcomes, flat))
    return out.drop(SPECS, TEXTS, STARLESS, FIRST, PAIRS, CONFIRMED, PATTERNS)


def evaluate_specs(specs: DataFrame, key: list[str], ids: list[str] | None = None, assume_lang: str | None = None) -> DataFrame:
    """specs (key..., pos, instruction_id, kwargs, response) with resolved_id, status, evaluated, strict, loose and args_defaulted.

    strict is the verdict on the response, loose whether any of its variants complies. Blank responses comply with
    nothing but count as evaluated. Instructions that can't be used (unsupported, malformed_id, bad_args, fatal) are
    neither followed nor evaluated; fatal are unknown language codes and patterns that don't compile. Missing arguments
    get defaults that the key and the position decide, which args_defaulted tells. kwargs: a JSON object or null; other
    arguments than the instruction's own are ignored.

    ids: the resolved ids that occur, where the caller knows them; rules of others are then left out of the plan."""
    one = F.array(F.struct(F.col("instruction_id").alias("instruction_id"), F.col("kwargs").alias("kwargs")))
    out = with_outcomes(specs, one, F.col("response"), lambda _: F.xxhash64(*key, "pos"), ids, assume_lang, single=True)
    o = F.get(F.col(OUTCOMES), F.lit(0))
    return out.select(*specs.columns, *(o[c].alias(c) for c in ("resolved_id", "status", "evaluated", "strict", "loose", "args_defaulted")))


def explode_specs(turns: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each instruction of a turn: pos, instruction_id, kwargs. Turns without instructions give none."""
    one = turns.select(*keep, F.posexplode(_specs()).alias("pos", "spec"))
    return one.select(*keep, "pos", F.col("spec.instruction_id").alias("instruction_id"), F.col("spec.kwargs").alias("kwargs"))


def _specs() -> Column:
    """Ids with their arguments; missing arguments are null, those too many are left out."""
    ids = F.coalesce("instruction_id_list", F.array().cast("array<string>"))
    return F.transform(ids, lambda i, n: F.struct(i.alias("instruction_id"), F.get("kwargs", n).alias("kwargs")))


def evaluate_turns(turns: DataFrame, key: list[str], ids: list[str] | None = None, assume_lang: str | None = None) -> DataFrame:
    """turns (key..., instruction_id_list, kwargs, response) with the outcome in both modes, in the instructions' order.

    follow_all is true only if all instructions are evaluated and followed; with no instruction it is true. Rows stay as
    they are, repeated ones too; empty tables stay empty."""
    out = with_outcomes(turns, _specs(), F.col("response"), lambda pos: F.xxhash64(*key, pos), ids, assume_lang)
    pick = lambda name: F.transform(OUTCOMES, lambda f: f[name])
    every = lambda a: F.forall(a, lambda f: f)
    out = out.withColumns({"is_evaluated_list": pick("evaluated"), "strict_list": pick("strict"), "loose_list": pick("loose"), "status_list": pick("status"), "args_defaulted_list": pick("args_defaulted")}).drop(OUTCOMES)
    done = every(F.col("is_evaluated_list"))
    return out.withColumns({"strict_all": done & every(F.col("strict_list")), "loose_all": done & every(F.col("loose_list"))})


def occurring(turns: DataFrame, assume_lang: str | None = None) -> list[str]:
    """The resolved ids in turns' instruction_id_list, for ids: no more than there are instructions. Only that column is read."""
    one = turns.select(F.explode("instruction_id_list").alias("i")).select(resolve(F.col("i"), assume_lang)[0].alias("i"))
    return sorted(r.i for r in one.where("i IS NOT NULL").distinct().collect())


def exploded(outcome: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each instruction of evaluated turns: pos, instruction_id, status, evaluated, strict and loose."""
    parts = {"instruction_id": "instruction_id_list", "status": "status_list", "evaluated": "is_evaluated_list", "strict": "strict_list", "loose": "loose_list"}
    one = outcome.select(*keep, F.posexplode(F.arrays_zip(*parts.values())).alias("pos", "o"))
    return one.select(*keep, "pos", *(F.col(f"o.{c}").alias(n) for n, c in parts.items()))
