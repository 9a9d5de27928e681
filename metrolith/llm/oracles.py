"""DuckDB SQL for the corpus queries that SQL expresses, over whole tables."""

from __future__ import annotations

from . import licenses, secrets
from .decontaminate import EPSILON, MIN_IDENTITY, MIN_ITEM
from .decontaminate import MIN_WORDS as MIN_OVERLAP
from .quality import LINE_LIMIT, MIN_WORDS, NGRAM_LIMITS, SYMBOL_LIMIT

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]"


def line_dedup() -> str:
    """Classes of lines by token set; pairs of classes by prefix and length, then whole sets."""
    return rf"""
WITH lines AS (
  SELECT doc_id, k, list_sort(list_distinct(regexp_extract_all(line, '{WORD}'))) AS toks
  FROM (SELECT doc_id, unnest(pieces) AS line, generate_subscripts(pieces, 1) - 1 AS k
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS pieces FROM documents))
  WHERE regexp_matches(line, '{WORD}')),
firsts AS (
  SELECT toks, len(toks) AS n, min(struct_pack(d := doc_id, k := k)) AS f FROM lines GROUP BY toks),
classes AS (
  SELECT row_number() OVER (ORDER BY f.d, f.k) AS id, toks, n, f.d AS class_doc, f.k AS class_no FROM firsts),
toks AS (SELECT id, n, unnest(toks) AS tok FROM classes),
placed AS (
  SELECT id, n, tok, row_number() OVER (PARTITION BY id ORDER BY c, tok) AS place
  FROM toks JOIN (SELECT tok, count(*) AS c FROM toks GROUP BY tok) USING (tok)),
prefix AS (SELECT id, n, tok FROM placed WHERE place <= n - (4 * n + 4) // 5 + 1),
pairs AS (
  SELECT DISTINCT a.id AS a, b.id AS b FROM prefix a JOIN prefix b
  ON a.tok = b.tok AND a.id < b.id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
gone AS (
  SELECT DISTINCT p.b AS id FROM pairs p JOIN classes x ON x.id = p.a JOIN classes y ON y.id = p.b
  WHERE 9 * len(list_intersect(x.toks, y.toks)) >= 4 * (x.n + y.n)),
marked AS (
  SELECT doc_id, k, class_doc || ':' || class_no AS class,
         doc_id <> class_doc OR k <> class_no OR gone.id IS NOT NULL AS removed
  FROM lines JOIN classes USING (toks) LEFT JOIN gone USING (id))
SELECT doc_id, count(k) AS n_lines, count(k) FILTER (removed) AS n_removed,
       coalesce(string_agg(k::VARCHAR, ',' ORDER BY k) FILTER (removed), '') AS removed_lines,
       coalesce(string_agg(class, ',' ORDER BY k), '') AS classes
FROM documents LEFT JOIN marked USING (doc_id) GROUP BY doc_id
"""


def quality() -> str:
    """Counts, coverages by exact n-grams, and the verdict."""
    sizes = [n for n, _ in NGRAM_LIMITS]
    shares = ", ".join(f"coalesce(max(chars) FILTER (n = {n}), 0) AS chars_{n}" for n in sizes)
    share = {n: f"coalesce(chars_{n}, 0)::DOUBLE / greatest(1, word_chars)" for n in sizes}
    columns = ", ".join(f"{share[n]} AS dup_{n}gram_share" for n in sizes)
    runs = ", ".join(f"concat_ws(' ', w, {', '.join(f'lead(w, {k}) OVER z' for k in range(1, n))}) AS run_{n}" for n in [3, *sizes])
    windows = " UNION ALL ".join(f"SELECT doc_id, {n} AS n, i, run_{n} AS key FROM runs WHERE i <= n_words - {n - 1}" for n in [3, *sizes])
    above = " OR ".join(f"dup_{n}gram_share > {limit}::DOUBLE" for n, limit in NGRAM_LIMITS)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
runs AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id) AS n_words, {runs} FROM words WINDOW z AS (PARTITION BY doc_id ORDER BY i)),
windows AS ({windows}),
found AS (SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, n, key) AS c FROM windows),
covered AS (
  SELECT DISTINCT doc_id, n, i + k AS i FROM (SELECT doc_id, n, i, unnest(range(0, n)) AS k FROM found WHERE c > 1)),
inside AS (
  SELECT doc_id, n, count(*) AS words, sum(length(w)) AS chars FROM covered JOIN words USING (doc_id, i) GROUP BY doc_id, n),
repeats AS (
  SELECT doc_id, coalesce(max(words) FILTER (n = 3), 0) AS n_repeat_words, {shares} FROM inside GROUP BY doc_id),
lines AS (
  SELECT doc_id, line, count(*) AS c, length(regexp_replace(line, '{SPACES}', '', 'g')) AS chars
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id, line),
dups AS (SELECT doc_id, sum(c - 1) AS n_dup_lines, sum((c - 1) * chars) AS dup_chars FROM lines GROUP BY doc_id),
measured AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '{SPACES}', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
joined AS (
  SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(dup_chars, 0)::DOUBLE / greatest(1, word_chars) AS dup_line_share, {columns}
  FROM measured LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words OR {above}
            OR n_symbols > {SYMBOL_LIMIT}::DOUBLE * greatest(1, word_chars) OR dup_line_share > {LINE_LIMIT}::DOUBLE) AS kept
FROM joined
"""


def decontamination() -> str:
    """All diagonals on which a document and an item share enough words, and all stretches between two matches."""
    share = f"{MIN_IDENTITY}::DOUBLE"
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS ws FROM benchmark),
doc AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
item AS (
  SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS j,
         greatest(1, least({MIN_OVERLAP}, ceil({share} * len(ws) - {EPSILON}::DOUBLE))) AS needed
  FROM b WHERE len(ws) >= {MIN_ITEM}),
same AS (SELECT doc_id, item_id, i - j AS diagonal, j, needed FROM doc JOIN item USING (w)),
likely AS (SELECT doc_id, item_id, diagonal FROM same GROUP BY ALL HAVING count(*) >= any_value(needed)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY j) AS r
  FROM same JOIN likely USING (doc_id, item_id, diagonal)),
best AS (
  SELECT a.doc_id, a.item_id, max(z.r - a.r + 1) AS n_equal
  FROM placed a JOIN placed z ON a.doc_id = z.doc_id AND a.item_id = z.item_id AND a.diagonal = z.diagonal AND a.r <= z.r
  WHERE z.r - a.r + 1 >= a.needed AND z.r - a.r + 1 >= {share} * (z.j - a.j + 1) - {EPSILON}::DOUBLE
  GROUP BY a.doc_id, a.item_id)
SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items, max(n_equal)::BIGINT AS n_equal
FROM best GROUP BY doc_id
"""


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _spans(matches: str, gaps: str, i: str) -> str:
    """Start and end of the i-th match, from what stands before and between the matches."""
    start = f"list_sum(list_transform({gaps}[1:{i}], lambda x: length(x))) + coalesce(list_sum(list_transform({matches}[1:{i} - 1], lambda x: length(x))), 0)"
    return f"({start})::BIGINT AS s, ({start} + length({matches}[{i}]))::BIGINT AS e"


def licenses_scan() -> str:
    """Base phrases by words; every rule behind its keywords, and suppression by pairs of detections."""
    known = ", ".join(f"({r['i']}, {_text(r['label'])}, {r['p']}, {_text(r['k1'])}, {_text(r['k2'])}, {_text(r['re'])})" for r in licenses.rules())
    places = " UNION ALL ".join(
        f"SELECT doc_id, {_text(label)} AS label, i - 1 AS w FROM places WHERE "
        + " AND ".join(f"ws[i + {k}] = {_text(w)}" for k, w in enumerate(phrase))
        for phrase, label in licenses.PHRASES
    )
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH rules(i, label, p, k1, k2, re) AS (VALUES {known}),
d AS (
  SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low,
         regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{licenses.WORD}') AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM d),
base AS ({places}),
found AS (
  SELECT doc_id, r.i, r.label, r.p, regexp_extract_all(t, r.re) AS ms, string_split_regex(t, r.re) AS gaps
  FROM d JOIN rules r ON contains(low, r.k1) AND contains(low, r.k2)),
each AS (SELECT *, unnest(generate_series(1, len(ms))) AS k FROM found WHERE len(ms) > 0),
spans AS (SELECT doc_id, i, label, p, {_spans("ms", "gaps", "k")} FROM each),
kept AS (
  SELECT * FROM spans d WHERE NOT EXISTS (
    SELECT 1 FROM spans o WHERE o.doc_id = d.doc_id AND o.s <= d.s AND o.e >= d.e AND (o.p > d.p OR (o.p = d.p AND
      (o.e - o.s > d.e - d.s OR (o.e - o.s = d.e - d.s AND o.i < d.i)))))),
labels AS (SELECT doc_id, label FROM base UNION SELECT doc_id, lower(label) FROM kept),
named AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM labels GROUP BY doc_id),
bases AS (
  SELECT doc_id, count(*) AS n_base, min(w) AS first_word, max(w) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n FROM kept GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       1 - pow(0.5::DOUBLE, coalesce(n, 0) + coalesce(n_base, 0)) AS score
FROM d LEFT JOIN bases USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN counted USING (doc_id)
"""


def secrets_scan() -> str:
    """Every rule over every text."""
    rules = secrets.BASE + secrets.ADDED
    found = " UNION ALL ".join(
        f"SELECT doc_id, {o} AS o, {_text(r.kind)} AS kind, regexp_extract_all(t, {_text(r.regex)}) AS ms, "
        f"regexp_extract_all(t, {_text(r.regex)}, {r.group}) AS gs, string_split_regex(t, {_text(r.regex)}) AS gaps, {r.least} AS least FROM d"
        for o, r in enumerate(rules)
    )
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)
    joined = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o){}, '')"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
each AS (SELECT *, unnest(generate_series(1, len(ms))) AS k FROM found WHERE len(ms) > 0),
spans AS (SELECT doc_id, o, kind, {_spans("ms", "gaps", "k")} FROM each WHERE length(gs[k]) >= least)
SELECT doc_id, {counts}, sha256({joined.format(f" FILTER (o < {len(secrets.BASE)})")}) AS base_sha256, {joined.format("")} AS spans
FROM d LEFT JOIN spans USING (doc_id) GROUP BY doc_id
"""


ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": decontamination(),
    "op4_licenses": licenses_scan(),
    "op5_secrets": secrets_scan(),
    "op8_line_dedup": line_dedup(),
    "op10_quality": quality(),
}
