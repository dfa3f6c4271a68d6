"""Secret scans with a trigram inverted index.

Each rule's regex is turned into a Boolean query of trigrams that any match must contain.
The trigrams of all rules are the index's vocabulary. The index holds posting lists: per block
of texts and trigram, the keys of the texts that hold it. Queries intersect and unite posting
lists block by block, and the candidates they leave come back to the rows by key, a slim list
that meets the texts where they are scanned. The regex then runs on candidates only. A rule
without mandatory trigrams has the query "all" and scans every text. DataFrame functions only
on the main path; the regexes are analysed once, on the driver.
"""

from __future__ import annotations

from itertools import product
from math import ceil
from re import _parser as regex_parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallycast.llm.common import BROADCAST_BYTES, fresh, salted_join, table, text_of
from tallycast.storage import drop_scratch, write_scratch


class Rule(NamedTuple):
    kind: str
    regex: str
    fold: bool = False  # letters match in either case
    group: int = 0  # the group whose length counts
    least: int = 1  # shorter matches are dropped


# The base rules come first, in the order in which they are listed in digests.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosting", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("login", r"[a-z]{3,10}://[A-Za-z0-9._-]+:[^\s:@/]+@"),
)
RULES = BASE_RULES + MORE_RULES

_MOST_STRINGS = 64  # a set of possible strings larger than this is no longer tracked


class _Found(NamedTuple):
    """What is known of a part of a regex: the exact strings it matches, or else the strings it
    may start and end with; and the trigram sets (alternatives) collected so far, None for all."""

    exact: frozenset | None
    start: frozenset
    end: frozenset
    query: frozenset | None


_ANY = _Found(None, frozenset([""]), frozenset([""]), None)


def _all_of(a, b):
    if a is None or b is None:
        return b if a is None else a
    return _fewest(frozenset(x | y for x, y in product(a, b)))


def _fewest(alternatives):
    """Without alternatives that ask for more than another one does."""
    return frozenset(x for x in alternatives if not any(y < x for y in alternatives))


def _grams(strings) -> frozenset | None:
    sets = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings]
    return None if not sets or any(not s for s in sets) else _fewest(frozenset(sets))


def _exactly(strings) -> _Found:
    return _Found(frozenset(strings), frozenset(strings), frozenset(strings), None)


def _open(x: _Found) -> _Found:
    """The same part without exact strings, their trigrams moved into the query."""
    return x if x.exact is None else _Found(None, x.start, x.end, _all_of(x.query, _grams(x.exact)))


def _joined(x: _Found, y: _Found) -> _Found:
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= _MOST_STRINGS:
        return _exactly(a + b for a, b in product(x.exact, y.exact))
    seam = _grams([a + b for a, b in product(x.end, y.start)]) if len(x.end) * len(y.start) <= _MOST_STRINGS else None
    start = frozenset(a + b for a, b in product(x.exact, y.start)) if x.exact is not None else x.start
    end = frozenset(a + b for a, b in product(x.end, y.exact)) if y.exact is not None else y.end
    if len(start) > _MOST_STRINGS:
        start = x.start
    if len(end) > _MOST_STRINGS:
        end = y.end
    return _Found(None, start, end, _all_of(_all_of(_open(x).query, _open(y).query), seam))


def _either(parts: list[_Found]) -> _Found:
    if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= _MOST_STRINGS:
        return _exactly(s for p in parts for s in p.exact)
    opened = [_open(p) for p in parts]
    query = None if any(p.query is None for p in opened) else _fewest(frozenset(s for p in opened for s in p.query))
    return _Found(
        None, frozenset(s for p in opened for s in p.start), frozenset(s for p in opened for s in p.end), query
    )


def _part(op, value) -> _Found:
    name = str(op)
    if name == "LITERAL":
        return _exactly([chr(value).lower()])
    if name == "IN":
        chars = set()
        for kind, x in value:
            if str(kind) == "LITERAL":
                chars.add(chr(x).lower())
            elif str(kind) == "RANGE" and x[1] - x[0] < 8:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return _ANY
        return _exactly(chars) if len(chars) <= 8 else _ANY
    if name == "SUBPATTERN":
        return _sequence(value[-1])
    if name == "BRANCH":
        return _either([_sequence(x) for x in value[1]])
    if name == "MAX_REPEAT":
        low, high, inner = value
        part = _sequence(inner)
        if (low, high) == (0, 1):
            return _either([part, _exactly([""])])
        if low == 0:
            return _ANY
        repeated = part
        for _ in range(min(low, 8) - 1):
            repeated = _joined(repeated, part)
        return repeated if low == high <= 8 else _joined(_joined(repeated, _ANY), _Found(None, frozenset([""]), part.end, None))
    return _ANY


def _sequence(parsed) -> _Found:
    found = _exactly([""])
    for op, value in parsed:
        found = _joined(found, _part(op, value))
    return found


def trigram_query(regex: str) -> list[list[str]] | None:
    """Alternatives of lower-case trigrams, one of which every match contains whole; None: no bound."""
    query = _open(_sequence(regex_parser.parse(regex))).query
    return None if query is None else sorted(sorted(x) for x in query)


def vocabulary(rules=RULES) -> list[str]:
    return sorted({g for r in rules for alternative in trigram_query(r.regex) or [] for g in alternative})


POSTINGS = 1 << 15  # postings to a block of the index, about
_KEYS = "array<bigint>"
_ROWS = "key bigint, gram string, n bigint"
_CHOSEN = "key bigint, rules array<int>, n bigint"


def held_trigrams(texts: DataFrame, text: str, grams: list[str]) -> DataFrame:
    """(key, gram, n): the trigrams that each distinct text holds, and in how many rows it stands.

    The key is a hash of the text, so copies are one text. Two texts of one key share their
    postings, which adds candidates and loses none.
    """
    lowered = texts.select(F.xxhash64(text).alias("key"), F.lower(text).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    return lowered.select("key", F.explode(held).alias("gram")).groupBy("key", "gram").agg(F.count(F.lit(1)).alias("n"))


def posting_lists(held: DataFrame, rows: int) -> DataFrame:
    """(block, gram, keys): the keys of a block's texts that hold the trigram.

    Blocks are hash classes of keys, as many as the number of postings asks for, so that the
    lists of a block stay of one size whatever the table's size.
    """
    block = F.pmod(F.col("key"), F.lit(max(1, ceil(rows / POSTINGS)))).alias("block")
    return held.groupBy(block, "gram").agg(F.collect_list("key").alias("keys"))


def candidates(index: DataFrame, rules) -> DataFrame:
    """(key, rule): texts whose posting lists satisfy a rule's query. Rules without a query are left out."""
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("lists"))
    queries = F.array(
        *[
            F.struct(F.lit(number).alias("rule"), F.array(*map(F.lit, grams)).alias("grams"))
            for number, rule in enumerate(rules)
            for grams in trigram_query(rule.regex) or []
        ]
    )

    def posted(gram):
        return F.coalesce(F.try_element_at("lists", gram), F.array().cast(_KEYS))

    def met(query):
        keys = F.aggregate(query.grams, posted(query.grams[0]), lambda kept, gram: F.array_intersect(kept, posted(gram)))
        return F.struct(query.rule.alias("rule"), keys.alias("keys"))

    found = lists.select(F.explode(F.transform(queries, met)).alias("f"))
    return found.select(F.explode("f.keys").alias("key"), "f.rule").distinct()


def _chosen_rules(texts: DataFrame, text: str, rules) -> DataFrame:
    """(key, rules, n): the rules for which a text is a candidate; kept, with the index dropped again."""
    spark = texts.sparkSession
    path = write_scratch(held_trigrams(texts, text, vocabulary(rules)), "postings")
    held = spark.read.schema(_ROWS).parquet(path)
    found = candidates(posting_lists(held.select("key", "gram"), held.count()), rules)
    found = found.groupBy("key").agg(F.collect_set("rule").alias("rules"))
    kept = write_scratch(found.join(held.groupBy("key").agg(F.max("n").alias("n")), "key"), "candidates")
    drop_scratch(spark, path)
    return spark.read.schema(_CHOSEN).parquet(kept)


def _with_candidates(docs: DataFrame, text: str, column: str, rules) -> DataFrame:
    """``docs`` with the array of rules for which its text is a candidate, or null.

    A list of candidates within the broadcast bound meets the texts in place. Beyond it the rows
    move once, those of a text that stands in very many dealt over several tasks.
    """
    chosen = _chosen_rules(docs, text, rules)
    rows = docs.select(F.xxhash64(text).alias("key"), F.struct("*").alias("row"))
    if (64 + 4 * len(rules)) * chosen.count() <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(chosen.drop("n")), "key", "left")
    else:
        joined = salted_join(rows, chosen, ["key"], "n", "monotonically_increasing_id()", "left")
    return joined.select("row.*", F.col("rules").alias(column))


_SPANS = "array<struct<start: int, kind_no: int, stop: int>>"


def _let(value: str, name: str, body: str) -> str:
    """SQL that computes ``value`` once and uses it as ``name`` in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _chunks(items: str) -> str:
    """SQL of an array cut into about as many pieces as each has items. Appending copies an array, so
    what appends item by item does so within a piece."""
    step = f"greatest(1, CAST(sqrt(size({items})) AS INT))"
    return _let(step, "step", f"transform(sequence(0, CAST((size({items}) - 1) div step AS INT)), i -> slice({items}, i * step + 1, step))")


def _spans(rule: Rule, order: int, text: str) -> Column:
    """Spans of the rule in code points: matches, and the pieces between them, laid end to end."""
    regex = ("(?i)" if rule.fold else "") + rule.regex
    if rule.group == 0 and rule.least > 1 and regex.endswith("]+") and regex.count("[") == 1:
        # one class repeated to the end: a run that is long enough is found as such
        fixed = len(regex[: regex.index("[")])
        regex = f"{regex[:-1]}{{{max(1, rule.least - fixed)},}}"
    quoted = "r'" + regex.replace("'", r"\x27") + "'"
    found = f"transform(regexp_extract_all({text}, {quoted}, 0), m -> struct(length(m) AS n, length(m) AS c))"
    if rule.group:
        groups = f"regexp_extract_all({text}, {quoted}, {rule.group})"
        found = f"zip_with(regexp_extract_all({text}, {quoted}, 0), {groups}, (m, g) -> struct(length(m) AS n, length(g) AS c))"
    items = f"zip_with({found}, split({text}, {quoted}, -1), (m, p) -> struct(m.n AS n, m.c AS c, length(p) AS p))"
    starts = """aggregate(pieces, struct(0 AS pos, CAST(array() AS array<int>) AS starts),
        (a, piece) -> struct(a.pos + aggregate(piece, 0, (n, x) -> n + x.p + coalesce(x.n, 0)) AS pos,
            array_append(a.starts, a.pos) AS starts), a -> a.starts)"""
    walk = f"""flatten(zip_with(pieces, {starts}, (piece, start) -> aggregate(piece,
        struct(start AS pos, CAST(array() AS {_SPANS}) AS spans),
        (a, x) -> struct(a.pos + x.p + coalesce(x.n, 0) AS pos, IF(x.c >= {rule.least},
            array_append(a.spans, struct(a.pos + x.p AS start, {order} AS kind_no, a.pos + x.p + x.n AS stop)), a.spans) AS spans),
        a -> a.spans)))"""
    walk = _let(items, "items", _let(_chunks("items"), "pieces", walk))
    return F.expr(f"IF({text} RLIKE {quoted}, {walk}, CAST(array() AS {_SPANS}))")


def find_secrets(docs: DataFrame, rules=RULES, column: str = "spans") -> DataFrame:
    """``docs`` with a column of spans: array of (start, kind_no, stop), sorted, ends exclusive.

    Positions count code points. A null text is empty. Spans of different rules may overlap;
    within one rule they do not. Other columns stay, repeated rows too; one of the same name
    as ``column`` is replaced. The index is built at the call, from one scan of the texts.
    """
    text, chosen = fresh(docs, "whole"), fresh(docs, "chosen")
    scanned = docs.withColumn(text, text_of())
    if vocabulary(rules):
        scanned = _with_candidates(scanned, text, chosen, rules)
    none = F.expr(f"CAST(array() AS {_SPANS})")
    parts = []
    for k, rule in enumerate(rules):
        spans = _spans(rule, k, f"`{text}`")
        if trigram_query(rule.regex) is not None:
            spans = F.when(F.array_contains(chosen, F.lit(k)), spans).otherwise(none)
        parts.append(spans)
    return scanned.withColumn(column, F.array_sort(F.flatten(F.array(*parts)))).drop(text, chosen)


def redact(docs: DataFrame, rules=RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark`` (overlapping spans by one), columns unchanged;
    n_chars, where present, follows the new text. Rows without a span keep their text as it is."""
    spans, hit = fresh(docs, "spans"), fresh(docs, "hit")
    found = find_secrets(docs, rules, spans).withColumn(hit, F.size(spans) > 0)
    ends = """aggregate(pieces, struct(0 AS pos, CAST(array() AS array<int>) AS ends),
        (a, piece) -> struct(greatest(a.pos, array_max(transform(piece, x -> x.stop))) AS pos,
            array_append(a.ends, greatest(a.pos, array_max(transform(piece, x -> x.stop)))) AS ends), a -> a.ends)"""
    # a piece of spans rewrites its own stretch of the text, from the end of those before it
    stretch = f"""aggregate(piece, struct(begin AS pos, CAST(array() AS array<string>) AS parts),
        (a, x) -> struct(greatest(a.pos, x.stop) AS pos, IF(x.start >= a.pos, array_append(a.parts,
            concat(substring(part, a.pos - begin + 1, x.start - a.pos), '{mark}')), a.parts) AS parts),
        a -> array_join(a.parts, ''))"""
    stretch = _let("IF(k = 0, 0, ends[greatest(k - 1, 0)])", "begin", _let("substring(text, begin + 1, ends[k] - begin)", "part", stretch))
    merged = f"concat(array_join(transform(pieces, (piece, k) -> {stretch}), ''), substring(text, element_at(ends, -1) + 1))"
    merged = _let(_chunks(spans), "pieces", _let(ends, "ends", merged))
    cleaned = found.withColumn("text", F.expr(f"IF({hit}, {merged}, text)"))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        cleaned = cleaned.withColumn("n_chars", F.when(F.col(hit), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)


def op10(spark, folder: str) -> DataFrame:
    docs = find_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    names = "array(" + ", ".join(f"'{r.kind}'" for r in RULES) + ")"
    listed = "array_join(transform({}, s -> concat(" + names + "[s.kind_no], ':', s.start, ':', s.stop)), ',')"
    count = "CAST(size(filter(spans, s -> s.kind_no = {})) AS BIGINT)"
    return docs.select(
        "doc_id",
        *[F.expr(count.format(k)).alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)],
        F.sha2(F.expr(listed.format(f"filter(spans, s -> s.kind_no < {len(BASE_RULES)})")), 256).alias("base_sha256"),
        F.expr(listed.format("spans")).alias("spans"),
    )


def _sql_spans(rule: Rule, order: int) -> str:
    regex = (("(?i)" if rule.fold else "") + rule.regex).replace("'", "''")
    return f"""SELECT k, {order} AS kind_no, unnest(s) AS s FROM (
    SELECT k, list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'start':
        list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0),
        'n': length(m[i]), 'c': length(g[i])}}), lambda x: x.c >= {rule.least}) AS s
    FROM (SELECT k, regexp_extract_all(t, '{regex}', 0) AS m, regexp_extract_all(t, '{regex}', {rule.group}) AS g,
      string_split_regex(t, '{regex}') AS p FROM docs))"""


OP10_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(_sql_spans(r, k) for k, r in enumerate(RULES))}),
named AS (SELECT k, kind_no, CAST(s.start AS BIGINT) AS start,
  [{', '.join(f"'{r.kind}'" for r in RULES)}][kind_no + 1] || ':' || CAST(s.start AS BIGINT) || ':' || CAST(s.start + s.n AS BIGINT) AS span
  FROM found),
per AS (SELECT k, {', '.join(f'count(*) FILTER (kind_no = {i}) AS n_{r.kind}' for i, r in enumerate(BASE_RULES))},
  coalesce(string_agg(span, ',' ORDER BY start, kind_no) FILTER (kind_no < {len(BASE_RULES)}), '') AS base,
  string_agg(span, ',' ORDER BY start, kind_no) AS spans FROM named GROUP BY k)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in BASE_RULES)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN per ON d.k = per.k
"""
