"""Secret scans through a trigram index, with DataFrame functions only."""

from __future__ import annotations

import re
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from graphwarden.llm.streams import rows_like

try:  # the parser of the standard library, under its present and its former name
    from re import _constants as ops, _parser as parser
except ImportError:  # pragma: no cover
    import sre_constants as ops
    import sre_parse as parser

#: fixed patterns: kind, regular expression, group whose length counts (0: all), least length; in the order of the kinds
RULES = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
BASE = [kind for kind, *_ in RULES]
#: kinds beyond the base: private key blocks, signed web tokens, credentials in connection addresses
MORE = [
    ("private", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\x20\r\n]*", 0, 0),
    ("signed", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    ("address", r"(?:postgres(?:ql)?|mysql|mongodb|redis|amqps?|https?|ftp)://[^\x00-\x20:/@]+:([^\x00-\x20/@]+)@", 1, 4),
]
#: matches whose spans are made together before they join the others, so that long lists are not copied for each match
BLOCK = 256
#: more alternatives of a literal than this are given up as unknown text
ALTERNATIVES = 64


def _texts(items) -> set[str] | None:
    """All texts a sequence of parsed items can stand for (lower case), or None if they are too many."""
    out = {""}
    for item in items:
        some = _texts_of(item)
        if some is None:
            return None
        out = {a + b for a, b in product(out, some)}
        if len(out) > ALTERNATIVES:
            return None
    return out


def _texts_of(item) -> set[str] | None:
    kind, value = item
    if kind is ops.LITERAL:
        return {chr(value).lower()}
    if kind is ops.SUBPATTERN:
        return _texts(value[-1])
    if kind is ops.BRANCH:
        parts = [_texts(x) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if kind is ops.IN and all(k is ops.LITERAL for k, _ in value):
        return {chr(v).lower() for _, v in value}
    if kind in (ops.MAX_REPEAT, ops.MIN_REPEAT) and value[1] <= 1:
        inner = _texts(value[2])
        return None if inner is None else inner | ({""} if value[0] == 0 else set())
    if kind is ops.AT:
        return {""}
    return None


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Trigrams (lower case) that every match holds: a list of clauses, all needed, each a list of alternatives.

    An alternative is a set of trigrams that occur together.  Runs of items with few possible texts become one clause:
    the text is one of its alternatives, and so are its trigrams; a run with an alternative shorter than three letters says
    nothing.  No clause means that the rule has no mandatory trigrams.
    """
    clauses, run = [], {""}

    def end(texts):
        if texts and all(len(t) >= 3 for t in texts):
            clauses.append(sorted({frozenset(t[i:i + 3] for i in range(len(t) - 2)) for t in texts}, key=sorted))

    def walk(items):
        nonlocal run
        for item in items:
            some = _texts_of(item)
            if some is not None and len(run) * len(some) <= ALTERNATIVES:
                run = {a + b for a, b in product(run, some)}
                continue
            end(run)
            run = {""}
            if some is not None:
                run = some
            elif item[0] is ops.SUBPATTERN:
                walk(item[1][-1])
            elif item[0] in (ops.MAX_REPEAT, ops.MIN_REPEAT) and item[1][0] >= 1:
                walk(item[1][2])
                end(run)
                run = {""}

    walk(parser.parse(pattern))
    end(run)
    return clauses


def postings(texts: DataFrame, rules=RULES + MORE) -> DataFrame:
    """The inverted index: ``(trigram, row_key)`` for each mandatory trigram of any rule and each text that holds it.

    Trigrams that no rule asks for are never looked up, so they are not listed.
    """
    wanted = sorted({t for _, pattern, _, _ in rules for clause in trigram_query(pattern) for way in clause for t in way})
    held = F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in wanted]) if wanted else F.array().cast("array<string>")
    return texts.withColumn("low", F.lower("text")).select("row_key", F.explode(F.array_compact(held)).alias("trigram"))


def candidate_rows(index: DataFrame, rules=RULES + MORE) -> DataFrame:
    """``(row_key, c_<kind>...)``: for each row of the index whether a rule's Boolean query holds.

    Postings are intersected by one aggregate: the set of trigrams of a row, at most as many as the rules name.
    """
    per_row = index.groupBy("row_key").agg(F.collect_set("trigram").alias("held"))
    flags = []
    for kind, pattern, _, _ in rules:
        if clauses := trigram_query(pattern):
            has = [reduce(lambda a, b: a | b, [F.size(F.array_except(F.array(*map(F.lit, sorted(way))), "held")) == 0 for way in clause])
                   for clause in clauses]
            flags.append(reduce(lambda a, b: a & b, has).alias(f"c_{kind}"))
    return per_row.select("row_key", *flags)


def _spans(kind: str, order: int, pattern: str, group: int, least: int, text: Column, candidate: Column) -> Column:
    """Array of (start, order, kind, end) of the rule's matches, in code points.

    The text is split at the matches; a match starts where the pieces and matches before it end.
    """
    empty = F.array().cast("array<struct<start:bigint,ord:int,kind:string,end:bigint>>")
    whole = F.when(candidate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    counted = F.when(candidate, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))) if group else whole
    gaps = F.split(text, pattern, -1)
    parts = F.arrays_zip(whole.alias("m"), counted.alias("g"), F.slice(gaps, 1, F.size(whole)).alias("p"))
    at = F.lit(0).cast("bigint").alias("at")

    def step(acc, x):
        begin = acc["at"] + F.length(x["p"])
        end = begin + F.length(x["m"])
        span = F.array(F.struct(begin.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["g"]) >= least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def block(acc, some):
        made = F.aggregate(some, F.struct(acc["at"].alias("at"), empty.alias("out")), step)
        return F.get(F.transform(F.array(made), lambda m: F.struct(
            m["at"].alias("at"), F.concat(acc["out"], F.array(m["out"])).alias("out"))), F.lit(0))

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / BLOCK).cast("int")), lambda b: F.slice(parts, b * BLOCK + 1, BLOCK))
    none = F.array().cast("array<array<struct<start:bigint,ord:int,kind:string,end:bigint>>>")
    made = F.aggregate(blocks, F.struct(at, none.alias("out")), block, lambda acc: F.flatten(acc["out"]))
    return F.when(candidate & (F.size(whole) > 0), made).otherwise(empty)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, rules=RULES + MORE) -> DataFrame:
    """doc_id, n_<kind> for each base rule, base_sha256, spans, n_<kind> for each further rule, for each row of ``docs``.

    ``spans`` names the matches of all rules, ``base_sha256`` those of the base rules alone.

    Spans are whole matches as kind:start:end in code points (end exclusive), by start and then by the rules' order.  A
    null or empty text has none; rows with equal or null ids are scanned one by one.  ``rules`` are (kind, pattern, group,
    least length); patterns must mean the same to Java and Python and never match an empty text.

    The index names for each text the mandatory trigrams it holds; texts it doesn't name for a rule are never given to the
    rule's expression.  Rules without mandatory trigrams scan every text.
    """
    texts = rows_like(docs, ["doc_id", "text"]).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("row_key", F.xxhash64("doc_id", "text"))
    found = candidate_rows(postings(texts, rules), rules)
    joined = texts.join(found.withColumnRenamed("row_key", "found_key"), F.col("row_key") == F.col("found_key"), "left")
    columns = []
    for order, (kind, pattern, group, least) in enumerate(rules):
        candidate = F.coalesce(F.col(f"c_{kind}"), F.lit(False)) if trigram_query(pattern) else F.lit(True)
        columns.append(_spans(kind, order, pattern, group, least, F.col("text"), candidate).alias(f"s_{kind}"))
    spans = joined.select("doc_id", *columns)
    spans = spans.withColumn("all", F.sort_array(F.concat(*[F.col(f"s_{kind}") for kind, *_ in rules])))
    counts = {kind: F.size(f"s_{kind}").cast("long").alias(f"n_{kind}") for kind, *_ in rules}
    base = F.filter("all", lambda x: x["kind"].isin(*BASE))
    return spans.select(
        "doc_id", *[c for k, c in counts.items() if k in BASE], F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("all")).alias("spans"), *[c for k, c in counts.items() if k not in BASE])


def _sql_rule(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
    SELECT row, doc_id, {order} AS ord, '{kind}' AS kind, m, g, s + lag_len AS start FROM (
      SELECT row, doc_id, m[i] AS m, g[i] AS g,
             list_sum(list_transform(p[:i], lambda x: length(x)))::BIGINT AS s,
             coalesce(list_sum(list_transform(m[:i-1], lambda x: length(x))), 0)::BIGINT AS lag_len
      FROM (SELECT row, doc_id, m, g, p, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT row, doc_id, regexp_extract_all(text, '{quoted}') AS m, regexp_extract_all(text, '{quoted}', {group}) AS g,
               string_split_regex(text, '{quoted}') AS p FROM d)))
    WHERE length(g) >= {least}"""


_COUNTS = {kind: f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in RULES + MORE}
_SPAN = "kind || ':' || start || ':' || (start + length(m)), ',' ORDER BY start, ord"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({' UNION ALL '.join(_sql_rule(k, i, p, g, n) for i, (k, p, g, n) in enumerate(RULES + MORE))}),
j AS (SELECT row, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _COUNTS)},
             string_agg({_SPAN}) FILTER (ord < {len(BASE)}) AS base, string_agg({_SPAN}) AS spans
      FROM s GROUP BY row)
SELECT d.doc_id, {', '.join(_COUNTS.values())}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (row)
"""
