"""Search for secrets in reports before they are published: a trigram index picks the texts, patterns verify them."""

from __future__ import annotations

from dataclasses import dataclass
from re import _parser as regex_parts

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelgrain.session import materialize
from voxelgrain.llm.records import REPORT, STACK

MOST_STRINGS = 64


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` finds spans from left to right; those whose ``group`` has fewer than ``least`` characters are dropped.

    ``probe`` is a pattern that every text with a remaining span matches; it saves listing short matches.
    """

    kind: str
    pattern: str
    group: int
    least: int
    probe: str


# fixed values: the patterns and least lengths of the published contract
RULES = (
    SecretRule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8,
               r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}"""),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]{12}"),
    SecretRule("hex", r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32}"),
)


def _strings(parts) -> tuple[set[str] | None, list[set[str]]]:
    """All strings that a parsed pattern matches, if few, and otherwise sets of which every match contains one string."""
    exact: set[str] | None = {""}
    needed: list[set[str]] = []

    def close() -> None:
        nonlocal exact
        if exact is not None:
            needed.append(exact)
        exact = {""}

    for op, value in parts:
        name = str(op)
        if name == "LITERAL":
            own, inner = {chr(value).lower()}, []
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in value) and len(value) <= 4:
            own, inner = {chr(v).lower() for _, v in value}, []
        elif name == "SUBPATTERN":
            own, inner = _strings(value[-1])
        elif name == "BRANCH":
            found = [_strings(p) for p in value[1]]
            whole = all(e is not None for e, _ in found)
            own, inner = (set().union(*[e for e, _ in found]), []) if whole else (None, [])
        elif name == "MAX_REPEAT":
            low, high, body = value
            one, inner = _strings(body)
            own = {""} | one if one is not None and (low, int(high)) == (0, 1) else None
            inner = inner + ([one] if one is not None else []) if low else []
        else:
            own, inner = None, []
        grown = {a + b for a in exact for b in own} if own is not None and exact is not None else None
        if grown is not None and len(grown) <= MOST_STRINGS:
            exact = grown
            continue
        close()
        needed.extend(inner)
        if own is not None:
            exact = own
    if needed:
        close()
        return None, needed
    return exact, []


def trigram_query(pattern: str) -> list[list[str]]:
    """A Boolean query in disjunctive form: lower-case trigrams of which every match holds one whole list.

    Empty if matches need not contain any trigram; such a rule has to scan every text.
    """
    exact, needed = _strings(regex_parts.parse(pattern))
    queries = []
    for strings in [exact] if exact is not None else needed:
        if strings and min(map(len, strings)) >= 3:
            queries.append(sorted({tuple(dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2))) for s in strings}))
    # the query with the fewest alternatives of the longest strings decides; the others would only narrow it further
    best = max(queries, key=lambda q: min(map(len, q)), default=[])
    return [list(q) for q in best if not any(set(o) < set(q) for o in best)]


def trigram_postings(reports: DataFrame, grams: list[str], *, key: str = STACK, text: str = REPORT) -> DataFrame:
    """(gram, key): the inverted index over the trigrams that the rules ask for, in lower-cased texts."""
    lowered = reports.select(F.col(key).alias("id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return lowered.select(F.explode(present).alias("gram"), F.col("id").alias(key))


def candidate_kinds(postings: DataFrame, rules: tuple[SecretRule, ...], *, key: str = STACK) -> DataFrame:
    """(key, kinds): rules whose trigram query the posting lists of a report satisfy together."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted({g for q in queries.values() for one in q for g in one})
    bit = F.create_map(*[x for i, g in enumerate(grams) for x in (F.lit(g), F.lit(1 << i))])
    held = postings.groupBy(key).agg(F.bit_or(bit[F.col("gram")]).alias("held"))

    def satisfied(query: list[list[str]]) -> Column:
        masks = [sum(1 << grams.index(g) for g in one) for one in query]
        return F.exists(F.array(*[F.lit(m) for m in masks]), lambda m: F.col("held").bitwiseAND(m) == m)

    kinds = F.array_compact(F.array(*[F.when(satisfied(q), F.lit(k)) for k, q in queries.items() if q]))
    return held.select(key, kinds.alias("kinds")).where(F.size("kinds") > 0)


def _spans(rule: SecretRule, order: int, wanted: Column) -> Column:
    """Array of (start, order, kind, end) in code points, for texts in column ``body``."""
    pattern = F.lit(rule.pattern)
    between = F.split("body", rule.pattern, -1)
    hits = F.regexp_extract_all("body", pattern, F.lit(0))
    values = hits if rule.group == 0 else F.regexp_extract_all("body", pattern, F.lit(rule.group))
    steps = F.arrays_zip(F.transform(between, F.length).alias("gap"), F.transform(hits, F.length).alias("size"), F.transform(values, F.length).alias("own"))
    kind = "array<struct<start:int,order:int,kind:string,end:int>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found"))

    def step(state: Column, s: Column) -> Column:
        start = state["at"] + s["gap"]
        end = start + F.coalesce(s["size"], F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(s["own"] >= rule.least, F.concat(state["found"], one)).otherwise(state["found"]).alias("found"))

    listed = F.aggregate(steps, begin, step, lambda s: s["found"])
    return F.when(wanted & F.col("body").rlike(rule.probe), listed).otherwise(F.array().cast(kind))


def find_secrets(reports: DataFrame, *, key: str = STACK, text: str = REPORT, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """One row per report: (key, secrets array of (start, order, kind, end) by start, then rule order).

    Positions count code points, ends are exclusive. Null and empty texts have no secrets; repeated rows give repeated
    results; rows that share a key share the candidates of all of them and are verified one by one. Other columns are
    not read. Rules whose pattern needs no trigram scan every text. Texts of any length are searched whole; no rows in, no rows out.

    Texts stay where they are read while the table of candidates is small enough for Spark to broadcast; beyond that they meet it
    in a shuffle by key.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted({g for q in queries.values() for one in q for g in one})
    texts = reports.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    if grams:
        postings = trigram_postings(texts, grams, key="id", text="body")
        # written, so that its size is known: while candidates are few they go to the texts, and no text is shuffled
        chosen = materialize(candidate_kinds(postings, rules, key="id").withColumnRenamed("id", "chosen_id"))
        texts = texts.join(chosen, F.col("id").eqNullSafe(F.col("chosen_id")), "left")
    else:
        texts = texts.withColumn("kinds", F.lit(None).cast("array<string>"))
    found = []
    for order, rule in enumerate(rules):
        wanted = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)) if queries[rule.kind] else F.lit(True)
        found.append(_spans(rule, order, wanted))
    return texts.select(F.col("id").alias(key), F.array_sort(F.concat(*found)).alias("secrets"))
