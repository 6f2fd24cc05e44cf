"""Text and scalar functions as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sediment.functions import words as W

_ASCII = r"(?<![A-Za-z0-9_])"
_ASCII_END = r"(?![A-Za-z0-9_])"


def matches(c: Column, pattern: str) -> Column:
    """Case-insensitive search in which \\b is an ASCII word boundary."""
    return c.rlike("(?i)" + pattern.replace(r"\b(", _ASCII + "(").replace(r")\b", ")" + _ASCII_END))


def normalized(c: Column) -> Column:
    """Lower case, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def fingerprint(c: Column) -> Column:
    """Equal for texts that differ in case and punctuation only; word order and negation count."""
    return F.substring(F.sha2(normalized(c), 256), 1, 16)


def is_noise(c: Column, category: Column) -> Column:
    return F.coalesce(category.isin(W.NOISE_CATEGORIES), F.lit(False)) | matches(F.lower(F.trim(c)), W.NOISE_START) | matches(F.lower(c), W.NOISE_WORDS)


def is_negative(c: Column, category: Column) -> Column:
    return F.coalesce(category == "negative_constraint", F.lit(False)) | matches(c, W.NEGATIVE)


def outcome(c: Column) -> Column:
    return F.when(matches(c, W.FAILURE), "failure").otherwise("neutral")


def memory_type(negative: Column, category: Column) -> Column:
    return F.when(negative | category.isin("rule", "negative_constraint"), "imperative").otherwise("declarative")


def redact_secrets(c: Column) -> tuple[Column, Column]:
    """(text, number of replacements); later patterns see the text the earlier ones left."""
    n = F.lit(0)
    for kind, pattern in W.SECRETS:
        n = n + F.regexp_count(c, F.lit(pattern))
        c = F.regexp_replace(c, pattern, ("$1=" if kind == "env_secret" else "") + f"[REDACTED:{kind}]")
    return c, n


def canonical_units(c: Column) -> Column:
    """Entity name without outer spaces and end punctuation, sizes as number and lower-case unit, whole
    thousands of MB in GB."""
    v = F.regexp_replace(F.regexp_replace(F.trim(c), r"[.,;:]+$", ""), r"\s+", " ")
    v = F.regexp_replace(v, r"(?i)(\d+(?:\.\d+)?)\s*MB(?![A-Za-z0-9_])", "$1mb")
    for unit in ("TB", "GB", "KB"):
        v = F.regexp_replace(v, rf"(?i)(\d+(?:\.\d+)?)\s*{unit}(?![A-Za-z0-9_])", "$1" + unit.lower())
    amount = F.try_to_number(F.regexp_extract(v, r"(\d{4,9})mb", 1), F.lit("999999999")).cast("long")
    whole = F.coalesce((amount >= 1024) & (amount % 1024 == 0), F.lit(False))
    return F.when(whole, F.regexp_replace(v, r"\d{4,9}mb", F.concat((amount / 1024).cast("long").cast("string"), F.lit("gb")))).otherwise(v)


def tokenize(c: Column) -> Column:
    """Lower-case tokens, those with - or _ followed by their parts of two letters or more."""
    tokens = F.filter(F.split(F.lower(c), r"[\s,.;:!?/\\()\[\]{}'\"]+"), lambda t: t != "")
    parts = lambda t: F.when(t.rlike("[-_]"), F.filter(F.split(t, "[-_]+"), lambda p: F.length(p) > 1)).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), parts(t))))


def fnv1a(c: Column, seed: int = 0) -> Column:
    """32-bit FNV-1a over the code points (of the basic plane, as UTF-16 units)."""
    start = F.lit(0x811C9DC5 ^ seed).cast("long")
    step = lambda h, x: F.expr("0L") + (h.bitwiseXOR(F.ascii(x).cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), start, step)


def recency(last: Column, category: Column, as_of: Column) -> Column:
    life = F.lit(W.DEFAULT_HALF_LIFE)
    for name, days in W.HALF_LIFE.items():
        life = F.when(category == name, F.lit(days)).otherwise(life)
    days = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(last)) / F.lit(86_400_000_000.0))
    return F.exp(-F.log(F.lit(2.0)) / life * days)


def estimate_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.length(c) / F.lit(3.8)))


def informative(c: Column) -> Column:
    e = F.lower(F.trim(c))
    return (F.length(e) > 2) & ~e.isin(W.STOPWORDS + W.GENERIC)


def candidate(c: Column, has_triples: Column) -> tuple[Column, Column]:
    """(confidence, category) of a statement heard in a conversation."""
    t = F.trim(c)
    score = (
        F.lit(0.45) + F.when(has_triples, 0.2).otherwise(0.0) + F.when(matches(t, W.IMPERATIVE), 0.15).otherwise(0.0)
        + F.when(matches(t, W.GUARD), 0.3).otherwise(0.0) + F.when(F.length(t).between(30, 250), 0.05).otherwise(0.0)
    )
    kind = F.when(matches(t, W.GUARD), "negative_constraint").when(matches(t, W.PREFERENCE), "preference").when(has_triples, "architecture").otherwise("fact")
    return F.least(F.lit(0.95), F.round(score, 2)), kind


def intent(c: Column) -> Column:
    """struct(intent, confidence, tool) of a prompt by the first rule that matches."""
    low = F.lower(F.trim(c))
    chain = None
    for name, conf, tool, pattern in W.INTENTS:
        value = F.struct(F.lit(name).alias("intent"), F.lit(conf).alias("confidence"), F.lit(tool).alias("tool"))
        hit = matches(low, pattern)
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    name, conf, tool = W.DEFAULT_INTENT
    return chain.otherwise(F.struct(F.lit(name).alias("intent"), F.lit(conf).alias("confidence"), F.lit(tool).alias("tool")))


def usage_multiplier(helped: Column, misled: Column) -> Column:
    return F.least(F.lit(1.5), F.greatest(F.lit(0.35), F.lit(1.0) + 0.05 * helped - 0.2 * misled))


def slug(c: Column, longest: int = 32) -> Column:
    s = F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"[^A-Za-z0-9_\s-]", "")), r"\s+", "-")
    s = F.regexp_replace(F.substring(s, 1, longest), "-+$", "")
    return F.when(s == "", "memory").otherwise(s)


def block_name_ok(c: Column) -> Column:
    """1 to 64 letters, digits, underscores, hyphens or dots; no reserved name and no two dots in a row."""
    name = F.trim(c)
    return name.rlike(r"^[A-Za-z0-9_.-]{1,64}$") & ~name.isin(W.RESERVED_BLOCKS) & ~name.contains("..")


def commit_class(subject: Column) -> Column:
    """struct(category, importance, outcome) of a commit by its subject line."""
    s = F.lower(subject)

    def kind(*v: str) -> Column:
        return F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("category", "importance", "outcome"))])

    return (
        F.when(s.startswith("fix") | s.contains("bugfix") | s.contains("hotfix"), kind("episodic", "high", "success"))
        .when(s.startswith("perf") | s.contains("optimize"), kind("rule", "high", "neutral"))
        .when(s.startswith("refactor") | s.startswith("arch"), kind("architecture", "normal", "neutral"))
        .when(s.contains("forbid") | s.contains("prevent") | s.contains("never"), kind("negative_constraint", "critical", "neutral"))
        .otherwise(kind("fact", "normal", "neutral"))
    )


def triples(c: Column) -> Column:
    """array<struct(subject, predicate, object)> of the facts a text states: port listeners and declarative
    verbs per clause, guardrails and aliases per text."""
    text = F.translate(F.trim(c), "\x01", " ")
    clauses = F.filter(
        F.transform(F.split(text, W.CLAUSE_END), lambda x: F.regexp_replace(F.trim(x), "[.,;]$", "")), lambda x: x != ""
    )
    fact = lambda s, p, o: F.struct(F.trim(s).alias("subject"), p.alias("predicate"), F.trim(o).alias("object"))
    def parts(pattern: str, sign: str) -> Column:
        """Of each clause the groups of the first match; clauses without the sign that every match holds are not tried,
        as looking for a subject takes long where there is none."""
        cut = lambda x: F.when(x.rlike(sign), F.split(F.regexp_replace(x, pattern, "\x01$1\x01$2\x01$3\x01"), "\x01"))
        return F.filter(F.transform(clauses, cut), lambda p: F.size(p) > 3)

    def predicate(raw: Column) -> Column:
        p = F.regexp_replace(F.upper(F.trim(raw)), r"\s+", "_")
        out = p
        for name, spellings in W.CANONICAL_PREDICATES.items():
            out = F.when(p.isin(spellings), F.lit(name)).otherwise(out)
        return out

    listens = F.transform(parts(W.PORT, r"\s\d{2,5}"), lambda p: fact(p[1], F.lit("LISTENS_ON_PORT"), p[2]))
    states = F.transform(parts(W.STATEMENT, rf"(?i)\s(?:{W.VERBS})\s"), lambda p: fact(p[1], predicate(p[2]), F.regexp_replace(F.trim(p[3]), "[.,;]$", "")))
    none = F.array().cast("array<struct<subject:string,predicate:string,object:string>>")
    guard = F.when(text.rlike(W.GUARDRAIL), F.array(fact(F.lit("SafetyGuardrail"), F.lit("FORBIDS"), F.substring(text, 1, 100)))).otherwise(none)
    alias, paren = W.ALIAS, W.ABBREVIATION
    named = (
        F.when(text.rlike(alias), F.array(fact(F.lower(F.regexp_extract(text, alias, 1)), F.lit("ALIAS_OF"), F.regexp_extract(text, alias, 2))))
        .when(text.rlike(paren), F.array(fact(F.lower(F.regexp_extract(text, paren, 2)), F.lit("ALIAS_OF"), F.regexp_extract(text, paren, 1))))
        .otherwise(none)
    )
    return F.filter(F.concat(listens, states, guard, named), lambda t: (t["subject"] != "") & (t["object"] != ""))
