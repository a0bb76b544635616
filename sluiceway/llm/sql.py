"""The same results in SQL, for an engine that shares no code with the Spark side."""

from __future__ import annotations

from sluiceway.llm import licenses, quality

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def quality_ctes(docs: str = "documents", iterations: int = quality.ITERATIONS) -> str:
    """CTEs up to scored(doc_id, statistics, base_failed, posterior, kept) over a table of documents with unique ids."""
    sym = "".join(quality.SYMBOLS)
    votes = ",\n".join(f"CASE WHEN n_words = 0 THEN 0 WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for _, bad, good in quality.RULES)
    k = len(quality.RULES)
    parts = [
        f"q_w AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM {docs})",
        "q_win AS (SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS i FROM q_w WHERE len(w) >= 3))",
        "q_twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM q_win) WHERE c > 1)",
        "q_rep AS (SELECT doc_id, sum(least(3, i - prev)) AS n FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -3) AS prev FROM q_twice) GROUP BY doc_id)",
        f"""q_stats AS MATERIALIZED (SELECT q_w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
length(regexp_replace(t, '[^{sym}]+', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
coalesce(q_rep.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '\\P{{Lu}}+', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(t, '\\P{{L}}+', '', 'g'))::BIGINT AS n_letters,
len(list_distinct(w))::BIGINT AS n_distinct, len(list_filter(l, lambda x: regexp_matches(x, '[.!?][\\x20\\x09-\\x0D]*$')))::BIGINT AS n_ended
FROM q_w LEFT JOIN q_rep USING (doc_id))""",
        f"q_votes AS MATERIALIZED (SELECT *, [{votes}] AS votes FROM q_stats)",
        "q_pat AS MATERIALIZED (SELECT votes, count(*)::DOUBLE AS n FROM q_votes GROUP BY votes)",
        f"q_long AS MATERIALIZED (SELECT votes, n, k, votes[k] AS v FROM q_pat, range(1, {k + 1}) AS r(k))",
        "q_r0 AS MATERIALIZED (SELECT votes, n, (1 + len(list_filter(votes, lambda x: x = 1))) / (2 + len(list_filter(votes, lambda x: x <> 0)))::DOUBLE AS r FROM q_pat)",
    ]
    for i in range(iterations):
        parts.append(
            f"""q_m{i} AS MATERIALIZED (SELECT k, 1 + sum(n * r) FILTER (v = 1) AS gg, 1 + sum(n * r) FILTER (v = -1) AS gb, 1 + sum(n * (1 - r)) FILTER (v = 1) AS bg, 1 + sum(n * (1 - r)) FILTER (v = -1) AS bb
FROM q_long JOIN (SELECT votes, r FROM q_r{i}) USING (votes) GROUP BY k)"""
        )
        g = "ln(CASE v WHEN 1 THEN coalesce(gg, 1) ELSE coalesce(gb, 1) END / (coalesce(gg, 1) + coalesce(gb, 1)))"
        b = "ln(CASE v WHEN 1 THEN coalesce(bg, 1) ELSE coalesce(bb, 1) END / (coalesce(bg, 1) + coalesce(bb, 1)))"
        parts.append(
            f"""q_r{i + 1} AS MATERIALIZED (SELECT votes, n, 1 / (1 + exp(e - (SELECT ln((1 + sum(n * r)) / (1 + sum(n * (1 - r)))) FROM q_r{i}))) AS r
FROM (SELECT votes, any_value(n) AS n, coalesce(sum(CASE WHEN v <> 0 THEN {b} - {g} END), 0) AS e FROM q_long JOIN q_m{i} USING (k) GROUP BY votes))"""
        )
    parts.append(
        f"""scored AS MATERIALIZED (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({quality.BASE_FAILED}) AS base_failed,
(NOT ({quality.BASE_FAILED}) AND r >= 0.5) AS kept, round(r, 4) AS quality_prob FROM q_votes JOIN (SELECT votes, r FROM q_r{iterations}) USING (votes))"""
    )
    return ",\n".join(parts)


def quality_sql() -> str:
    return f"WITH {quality_ctes()} SELECT * FROM scored"


def license_sql() -> str:
    def canonical(x: str) -> str:
        t = f"regexp_replace(lower(coalesce({x}, '')), '{licenses.BREAK}', chr(10) || '{chr(92)}1', 'g')"
        t = f"regexp_replace({t}, '{licenses.COPYRIGHT_LINE}', chr(10), 'g')"
        t = rf"regexp_replace({t}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')"
        return f"trim(regexp_replace({t}, '{licenses.SPELLING}', '{''.join(chr(92) + str(n) for n in licenses.SPELLING_KEPT)}', 'g'))"

    known = ", ".join(f"('{i}', '{t.replace(chr(39), chr(39) * 2)}')" for i, t in licenses.known_texts())
    return f"""WITH k AS (SELECT sha256(c) AS digest, min(i) AS license_id FROM (SELECT i, {canonical("t")} AS c FROM (VALUES {known}) AS v(i, t)) WHERE c <> '' GROUP BY 1),
d AS (SELECT doc_id, sha256({canonical("text")}) AS digest FROM documents)
SELECT doc_id, d.digest, license_id FROM d LEFT JOIN k USING (digest)"""


def mix_targets_sql() -> str:
    return f"""WITH s AS (SELECT source, sum(len({WORDS}))::BIGINT AS source_size FROM documents GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight FROM s),
c AS (SELECT *, 3 * source_size AS cap, sum(3 * source_size) OVER o AS cum, sum(weight) OVER o AS cw, sum(source_size) OVER () AS total, sum(weight) OVER () AS tw FROM w
  WINDOW o AS (ORDER BY 3 * source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, total - coalesce(cum, 0) AS lft, tw - coalesce(cw, 0) AS heavy FROM c),
f AS (SELECT arg_min(lft, cap / weight) AS lft, arg_min(heavy, cap / weight) AS heavy FROM x WHERE cap * heavy > weight * lft)
SELECT source, source_size, weight::BIGINT AS weight, (CASE WHEN x.cap * x.heavy <= weight * x.lft THEN cap ELSE weight * f.lft / f.heavy END)::DOUBLE AS target FROM x, f"""


def filter_audit_sql() -> str:
    """Every document's failures, every order, every step: what was removed before a step is looked up in the order's letters."""
    return rf"""WITH t AS MATERIALIZED (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
f AS MATERIALIZED (SELECT t.doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'),
  coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)] AS v FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS MATERIALIZED (SELECT part, v, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, v),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS a),
o AS (SELECT p.a || q.a || r.a || s.a || z.a AS filter_order FROM x p, x q, x r, x s, x z WHERE len(list_distinct([p.a, q.a, r.a, s.a, z.a])) = 5),
g AS (SELECT c.*, filter_order, step, filter_order[step] AS letter, v[ascii(filter_order[step]) - 64] AS fails,
  len(list_filter(range(1, 6), lambda i: i < step AND v[ascii(filter_order[i]) - 64])) > 0 AS gone FROM c, o, range(1, 6) AS st(step)),
m AS (SELECT part, filter_order, step::INTEGER AS step, letter, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND len(list_filter(v, lambda b: b)) = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost FROM g GROUP BY part, filter_order, step, letter)
SELECT m.* EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM m"""
