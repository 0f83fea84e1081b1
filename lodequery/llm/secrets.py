"""Secret scans with a trigram inverted index, in DataFrame functions only.

Each rule's regex is parsed on the driver into a Boolean query over lower-cased trigrams: an OR
of ANDs that every match must satisfy. The index posts, for each block of documents, which rows
hold a trigram; a posting list never outgrows its block, so a trigram that a third of all
documents hold costs as much as any other. Queries intersect a block's lists and the rows that
satisfy one are verified with the rule's regex. Rules without mandatory trigrams scan all rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts_for, text_of

BLOCK = 4096
#: Literal alternatives beyond which a part of a regex counts as unknown.
MOST = 64


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """Matches of pattern (syntax common to Java, RE2 and Python) whose group is at least `least` long.

    Matches are taken leftmost first and don't overlap; a match that is too short is used up all the same.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


_NAMES = "|".join([*(either_case(w) for w in ("password", "passwd", "secret", "token")), f"{either_case('api')}_?{either_case('key')}"])

#: The first three are the base kinds, in the order in which they are listed.
RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", "[0-9a-f]{16,}"),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", "AIza[0-9A-Za-z_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
BASE = 3


def _literals(node) -> set[str] | None:
    """All lower-cased strings that a parsed item matches, or None if they are many or unknown."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN":
        out = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                out.add(chr(value).lower())
            elif str(kind) == "RANGE" and value[1] - value[0] < MOST:
                out.update(chr(c).lower() for c in range(value[0], value[1] + 1))
            else:
                return None
        return out if len(out) <= 8 else None
    if op == "SUBPATTERN":
        return _sequence(arg[-1])
    if op == "BRANCH":
        parts = [_sequence(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[1] == 1:
        inner = _sequence(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _sequence(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        one = _literals(node)
        if one is None or len(out) * len(one) > MOST:
            return None
        out = {a + b for a, b in product(out, one)}
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """An OR of ANDs of lower-cased trigrams that any text with a match satisfies; None: no trigram is mandatory."""
    best: list[frozenset[str]] | None = None

    def offer(strings: set[str]) -> None:
        nonlocal best
        query = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if frozenset() in query:
            return
        query = [q for q in query if not any(p < q for p in query)]
        if best is None:
            best = query
        elif len(best) * len(query) <= MOST:  # both hold of any match
            best = [a | b for a in best for b in query]

    def walk(nodes) -> None:
        run = {""}
        for node in nodes:
            one = _literals(node)
            if one is not None and len(run) * len(one) <= MOST:
                run = {a + b for a, b in product(run, one)}
                continue
            offer(run)
            run = {""} if one is None else one
            if one is None and str(node[0]) == "SUBPATTERN":
                walk(node[1][-1])
            elif one is None and "REPEAT" in str(node[0]) and node[1][0] >= 1:
                walk(node[1][2])
        offer(run)

    walk(re._parser.parse(pattern))
    return sorted(best, key=sorted) if best else None


def row_key(docs: DataFrame) -> Column:
    """A hash of a row's id and text. Equal keys only ever add candidates, since each row's own text is verified."""
    return F.xxhash64(F.col("doc_id"), text_of())


def postings(docs: DataFrame, vocabulary: list[str] | None, blocks: int) -> DataFrame:
    """(block, trigram, rows): which rows of a block hold a trigram; all trigrams if there is no vocabulary.

    docs has _row and text. A list has at most as many entries as its block has rows.
    """
    low = F.lower(text_of())
    if vocabulary is None:
        grams = F.array_distinct(F.regexp_extract_all(low, F.lit("(?s)(?=(...))"), F.lit(1)))
    else:
        grams = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in vocabulary]))
    held = docs.select("__secret_row", F.explode(grams).alias("trigram"))
    block = F.pmod(F.col("__secret_row"), F.lit(blocks)).alias("block")
    return held.groupBy(block, "trigram").agg(F.collect_set("__secret_row").alias("rows"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(_row, kinds): the rows that satisfy each rule's query. The term table is as small as the rules."""
    spark = index.sparkSession
    terms = [(kind, n, g, len(q)) for kind, query in queries.items() for n, q in enumerate(query) for g in sorted(q)]
    table = spark.createDataFrame(terms, "kind string, conj int, trigram string, needed int")
    lists = index.join(F.broadcast(table), "trigram").groupBy("block", "kind", "conj", "needed").agg(F.collect_list("rows").alias("lists"))
    full = lists.filter(F.size("lists") == F.col("needed"))
    met = full.select("kind", F.explode(F.aggregate(F.slice("lists", 2, F.size("lists")), F.element_at("lists", 1), F.array_intersect)).alias("__secret_row"))
    return met.groupBy("__secret_row").agg(F.collect_set("kind").alias("kinds"))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, order, end, kind>> of a rule's matches: code points, end exclusive.

    What lies between the matches (split) and the matches themselves add up to the offsets.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    kind = "array<struct<start:int,order:int,end:int,kind:string>>"
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), whole.alias("hit"), value.alias("value"))
    state = f"struct<at:int,found:{kind}>"

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.array(F.struct(start, F.lit(order), end, F.lit(rule.kind)).cast(kind[6:-1]))
        keep = F.length(x["value"]) >= rule.least
        return F.struct(F.coalesce(end, start).alias("at"), F.when(keep, F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found")).cast(state)

    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found")).cast(state)
    found = F.aggregate(parts, start, step, lambda acc: acc["found"])
    return F.when(F.rlike(text, F.lit(rule.pattern)), found).otherwise(F.array().cast(kind))


def scan(docs: DataFrame, rules=RULES, block: int = BLOCK) -> DataFrame:
    """docs with `spans`, an array of (start, order, end, kind) by start, then the rules' order.

    A null text counts as empty and has none; very long texts are scanned whole; an empty table
    stays empty. Rows that are repeated are each scanned; a column that is named spans is replaced.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    keyed = docs.drop("spans").withColumn("__secret_row", row_key(docs))
    blocks = parts_for(docs.count(), block)
    vocabulary = sorted({g for q in queries.values() for c in q for g in c})
    found = candidates(postings(keyed, vocabulary, blocks), queries).withColumnRenamed("kinds", "__secret_kinds")
    joined = keyed.join(found, "__secret_row", "left")
    text = text_of()
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    each = []
    for order, rule in enumerate(rules):
        spans = spans_of(text, rule, order)
        each.append(F.when(F.array_contains("__secret_kinds", rule.kind), spans).otherwise(none) if rule.kind in queries else spans)
    return joined.withColumn("spans", F.array_sort(F.concat(*each))).drop("__secret_row", "__secret_kinds")


def render(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(scanned: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Texts with every span replaced by the mark (overlapping spans by one), n_chars brought up to date; spans goes. Null texts stay null."""
    state = "struct<out:string,at:int>"

    def step(acc, s):
        piece = F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.when(s["start"] >= acc["at"], F.struct(piece.alias("out"), s["end"].alias("at")).cast(state)).otherwise(
            F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")).cast(state)
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at")).cast(state)
    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, F.length("text"))))
    out = scanned.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")))
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out).drop("spans")


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of the query: counts, the base kinds' digest, and all spans as text."""
    count = lambda order: F.size(F.filter("spans", lambda s: s["order"] == order)).cast("long")
    base = F.filter("spans", lambda s: s["order"] < BASE)
    return scan(docs.select("doc_id", "text")).select(
        "doc_id",
        *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(RULES[:BASE])],
        F.sha2(render(base).cast("binary"), 256).alias("base_sha256"),
        render(F.col("spans")).alias("spans"),
    )


def oracle_sql() -> str:
    """DuckDB SQL for report()."""

    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    finds = []
    for order, r in enumerate(RULES):
        finds.append(
            f"select doc_id, {order} as ord, {q(r.kind)} as kind, text, regexp_extract_all(text, {q(r.pattern)}, 0) as hits,"
            f" regexp_extract_all(text, {q(r.pattern)}, {r.group}) as vals, string_split_regex(text, {q(r.pattern)}) as gaps, {r.least} as least from d"
            f" where regexp_matches(text, {q(r.pattern)})"
        )
    return f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
f as ({" union all ".join(finds)}),
e as (select *, unnest(generate_series(1, len(hits))) as i from f),
s as (select doc_id, ord, kind, list_sum(list_transform(gaps[1:i], lambda x: length(x)))::bigint
   + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0)::bigint as start, length(hits[i]) as len from e where length(vals[i]) >= least),
g as (select doc_id, sum((ord = 0)::int)::bigint as n_assign, sum((ord = 1)::int)::bigint as n_access, sum((ord = 2)::int)::bigint as n_hex,
   coalesce(string_agg(kind || ':' || start || ':' || (start + len), ',' order by start, ord) filter (where ord < {BASE}), '') as base,
   string_agg(kind || ':' || start || ':' || (start + len), ',' order by start, ord) as spans from s group by doc_id)
select d.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
   sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (doc_id)"""
