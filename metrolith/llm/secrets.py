"""Secret scan over a trigram inverted index, with built-in functions only.

From each rule's regex a Boolean trigram query is derived: any text that matches
the regex satisfies the query.  The index holds, for each trigram that some
query mentions and each block of documents, the list of documents that contain
it (lower-cased).  Queries intersect and unite these lists; the candidates are
verified by running the rule's regex over their whole texts.  A rule from which
no mandatory trigram can be derived scans every document.

A document's key is a hash of its id and text, so equal rows are one entry.  Blocks
are dealt by the key and hold a bounded number of rows, so no list grows with the
corpus.  Candidates are written to the shared
folder; being few they are broadcast when Spark finds the written table under
its threshold, and joined by a shuffle beyond it.

Places are in code points, the end exclusive; matches are leftmost and do not
overlap within a kind.

Defined cases: null and empty texts have no spans (the hash is that of the empty
string); documents that repeat an id each get their own spans; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, text_or_empty
from .spans import match_spans

try:  # the regex parser of the standard library, under its name since 3.11
    from re import _parser as sre
except ImportError:
    import sre_parse as sre

#: Documents of an index block, about.
BLOCK_ROWS = 20_000
#: More literal alternatives than this are not followed.
MOST_LITERALS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regex; the least length of one of its groups (0: whole match)."""

    kind: str
    regex: str
    least: int = 1
    group: int = 0


# The base rules and public token formats.
BASE = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
ADDED = (
    Rule("temporary", r"ASIA[A-Z0-9]{16,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("pypi", r"pypi-[A-Za-z0-9_-]{50,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("basic", r"(?i)authorization:\x20*(?:basic|bearer)\x20+[A-Za-z0-9+/_.=-]{8,}"),
    Rule("url", r"[a-z]{2,12}://[A-Za-z0-9_.-]+:[^\x20@/:]{3,}@[A-Za-z0-9.-]+"),
)

# --- trigram queries ------------------------------------------------------------------

ANY = ("and", ())
Query = tuple  # ("tri", t) | ("and", (q, ...)) | ("or", (q, ...))


def _and(*parts: Query) -> Query:
    flat = []
    for p in parts:
        flat += p[1] if p[0] == "and" else [p]
    flat = sorted(set(flat), key=repr)
    return flat[0] if len(flat) == 1 else ("and", tuple(flat))


def _or(*parts: Query) -> Query:
    if any(p == ANY for p in parts):
        return ANY
    flat = sorted(set(parts), key=repr)
    return flat[0] if len(flat) == 1 else ("or", tuple(flat))


def _of_literal(s: str) -> Query:
    return _and(*(("tri", s[i : i + 3]) for i in range(len(s) - 2)))


def _of_literals(found: set[str]) -> Query:
    return _or(*map(_of_literal, found)) if found else ANY


class _Walk:
    """Collects, along a sequence, the possible literal strings since the last break."""

    def __init__(self):
        self.query, self.open = ANY, {""}

    def broken(self):
        self.query, self.open = _and(self.query, _of_literals(self.open)), {""}

    def literals(self, found: set[str]):
        if len(self.open) * len(found) > MOST_LITERALS:
            self.broken()
        self.open = {a + b for a in self.open for b in found}

    def sequence(self, items):
        for op, value in items:
            name = str(op).lower()
            if name == "literal":
                self.literals({chr(value).lower()})
            elif name == "in" and (found := _members(value)):
                self.literals(found)
            elif name == "subpattern":
                self.sequence(value[-1])
            elif name == "branch":
                self.branch(value[1])
            elif name in ("max_repeat", "min_repeat", "possessive_repeat"):
                least, most, inner = value
                if least == 0 and most == 1 and (found := _literals_of(inner)):
                    self.literals(found | {""})
                elif least == most == 1:
                    self.sequence(inner)
                elif least >= 1:
                    self.sequence(inner)
                    self.broken()
                else:
                    self.broken()
            elif name == "at":
                continue
            else:
                self.broken()

    def branch(self, options):
        found = [_literals_of(o) for o in options]
        if all(found):
            self.literals(set().union(*found))
            return
        self.broken()
        self.query = _and(self.query, _or(*(_query(o) for o in options)))


def _members(items) -> set[str]:
    if len(items) <= 4 and all(str(op).lower() == "literal" for op, _ in items):
        return {chr(v).lower() for _, v in items}
    return set()


def _literals_of(items) -> set[str]:
    """Every string of a small finite pattern, or nothing."""
    walk = _Walk()
    walk.sequence(items)
    return walk.open if walk.query == ANY and walk.open != {""} and _finite(items) else set()


def _finite(items) -> bool:
    for op, value in items:
        name = str(op).lower()
        if name == "literal" or (name == "in" and _members(value)):
            continue
        if name == "subpattern" and _finite(value[-1]):
            continue
        if name == "branch" and all(_finite(o) for o in value[1]):
            continue
        if name == "max_repeat" and value[1] == 1 and _finite(value[2]):
            continue
        return False
    return True


def _query(items) -> Query:
    walk = _Walk()
    walk.sequence(items)
    walk.broken()
    return walk.query


def trigram_query(regex: str) -> Query:
    """The Boolean trigram query of a regex, over lower-cased text; ANY if none is mandatory."""
    return _query(sre.parse(regex))


def trigrams(query: Query) -> set[str]:
    return {query[1]} if query[0] == "tri" else set().union(set(), *map(trigrams, query[1]))


# --- the index --------------------------------------------------------------------------


def _key(id_column: str, text_column: str) -> Column:
    return F.xxhash64(F.col(id_column), F.col(text_column))


def build_index(docs: DataFrame, wanted: set[str], id_column="doc_id", text_column="text", block_rows=BLOCK_ROWS) -> DataFrame:
    """(block, trigram, keys): the documents of each block that contain a trigram."""
    blocks = max(1, -(-docs.count() // block_rows))
    low = docs.select(_key(id_column, text_column).alias("key"), F.lower(text_or_empty(text_column)).alias("low"))
    have = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in sorted(wanted))))
    postings = low.select("key", F.explode(have).alias("trigram"))
    return postings.groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "trigram").agg(F.collect_set("key").alias("keys"))


def clauses(query: Query) -> list[frozenset[str]]:
    """The query as alternatives, each a set of trigrams that must all occur (never of ANY)."""
    if query[0] == "tri":
        return [frozenset([query[1]])]
    parts = [clauses(q) for q in query[1]]
    if query[0] == "or":
        return [c for p in parts for c in p]
    out = [frozenset()]
    for p in parts:
        out = [a | b for a in out for b in p]
    return out


def candidates(docs: DataFrame, rules: tuple[Rule, ...], id_column="doc_id", text_column="text") -> DataFrame:
    """(key, kinds): for each document that satisfies a rule's query, those rules' kinds."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex)) != ANY}
    wanted = set().union(set(), *map(trigrams, queries.values()))
    index = build_index(docs, wanted, id_column, text_column)
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists"))
    table = [
        {"kind": kind, "first": min(c), "rest": sorted(c - {min(c)})} for kind, q in queries.items() for c in clauses(q)
    ]
    known = F.from_json(F.lit(json.dumps(table)), "array<struct<kind:string,first:string,rest:array<string>>>")

    def keys_of(trigram: Column) -> Column:
        return F.coalesce(F.try_element_at("lists", trigram), F.array().cast("array<bigint>"))

    def met(c: Column) -> Column:
        both = F.aggregate(c["rest"], keys_of(c["first"]), lambda acc, t: F.array_intersect(acc, keys_of(t)))
        return F.struct(c["kind"].alias("kind"), both.alias("keys"))

    return (
        lists.select(F.explode(F.transform(known, met)).alias("x"))
        .select(F.col("x.kind").alias("kind"), F.explode("x.keys").alias("key"))
        .groupBy("key")
        .agg(F.collect_set("kind").alias("kinds"))
    )


# --- verification -----------------------------------------------------------------------


def _spans(text: Column, kinds: Column, rules: tuple[Rule, ...]) -> Column:
    """The spans of the rules whose kinds are listed, unordered."""
    table = [
        {"kind": r.kind, "o": o, "re": r.regex, "least": r.least, "grp": r.group} for o, r in enumerate(rules)
    ]
    known = F.from_json(F.lit(json.dumps(table)), "array<struct<kind:string,o:int,re:string,least:int,grp:int>>")

    def of_rule(r: Column) -> Column:
        lengths = F.transform(F.regexp_extract_all(text, r["re"], r["grp"]), F.length)
        zipped = F.arrays_zip(match_spans(text, r["re"]).alias("m"), lengths.alias("n"))
        return F.transform(
            F.filter(zipped, lambda z: z["n"] >= r["least"]),
            lambda z: F.struct(
                z["m"]["s"].alias("s"), r["o"].alias("o"), z["m"]["e"].alias("e"), r["kind"].alias("kind")
            ),
        )

    return F.flatten(F.transform(F.filter(known, lambda r: F.array_contains(kinds, r["kind"])), of_rule))


def _long_enough(rule: Rule) -> str:
    """A regex for 'some match is long enough', where the rule is one repeated class; else the rule's."""
    simple = re.fullmatch(r"\[[^\]]+\]\+", rule.regex)
    return f"{rule.regex[:-1]}{{{rule.least}}}" if simple and rule.least > 1 else rule.regex


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, id_column="doc_id", text_column="text") -> DataFrame:
    """(doc_id, spans): array of struct<s, o: rule number, e, kind> by start, then rule."""
    found = materialize(candidates(docs, rules, id_column, text_column), "secret-candidates")
    found = found.select(F.col("key").alias("_key"), "kinds")
    texts = docs.select(F.col(id_column), _key(id_column, text_column).alias("_k"), text_or_empty(text_column).alias("text"))
    joined = texts.join(found, F.col("_k") == F.col("_key"), "left")
    # Rules without a mandatory trigram scan every document.
    full = [
        F.when(F.col("text").rlike(_long_enough(r)), F.lit(r.kind)) for r in rules if trigram_query(r.regex) == ANY
    ]
    none = F.array().cast("array<string>")
    kinds = F.concat(F.coalesce("kinds", none), F.array_compact(F.array(*full)) if full else none)
    live = joined.select(id_column, "text", kinds.alias("kinds"))
    empty = F.array().cast("array<struct<s:int,o:int,e:int,kind:string>>")
    spans = F.when(F.size("kinds") > 0, F.array_sort(_spans(F.col("text"), F.col("kinds"), rules))).otherwise(empty)
    return live.select(id_column, spans.alias("spans"))


def digest(scanned: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The contract's row for each document."""
    kinds = [r.kind for r in BASE]

    def joined(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["s"].cast("string"), m["e"].cast("string"))), ","
        )

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda m: m["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda m: m["o"] < len(BASE))
    return scanned.select(
        id_column,
        *(count(k) for k in kinds),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
